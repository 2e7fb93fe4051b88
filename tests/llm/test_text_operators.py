"""Language, toxicity, licenses, fingerprints and token counts against brute force and by hand."""

import hashlib
import itertools
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.llm import langid, licenses, sketches, tokencounts, toxicity

DOCS = "doc_id long, text string, lang string, source string, row int"
#: Nulls, blanks, a long text, repeated rows, a null id; ``row`` clashes with an inner name.
ODD = [(1, None, "en", "a", 1), (2, "", None, None, 1), (3, " \n\t", "de", "a", 1), (4, "12 !!", "en", "b", 1), (5, "x" * 300_000, "en", "b", 1), (6, "plain words here", "en", "b", 1), (6, "plain words here", "en", "b", 1), (None, "no id at all", "en", None, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    scores, start, move = rng.normal(size=(30, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    edges = [0, 5, 6, 13, 20, 26, 30]
    begins = np.zeros(30, bool)
    begins[edges[:-1]] = True
    got = langid.forward_backward(scores, begins, start, move)
    for a, b in itertools.pairwise(edges):
        p = np.zeros((b - a, 3))
        for y in itertools.product(range(3), repeat=b - a):
            w = np.exp(start[y[0]] + sum(move[u, v] for u, v in itertools.pairwise(y)) + sum(scores[a + i, k] for i, k in enumerate(y)))
            for i, k in enumerate(y):
                p[i, k] += w
        assert np.allclose(got[a:b], p / p.sum(axis=1, keepdims=True))


def test_word_features_do_not_depend_on_the_neighbours():
    alone, n, _ = langid.word_features("straße")
    among, m, _ = langid.word_features("über die straße, und")
    assert (n, m) == (1, 4)
    for (a, oa), (b, ob) in zip(alone, among, strict=True):
        assert (a == (b[2:3] if ob is None else b[ob[2] : ob[3]])).all()


def test_language_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = langid.identify(docs, docs.where("doc_id % 2 = 0")).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1")
    right, n = found.selectExpr("sum(int(lang_pred = lang))", "count(*)").first()
    assert right / n > 0.95


def test_words_in_switched_text_get_their_own_language():
    de, en = "der und nicht sich auch ".split(), "the and with that was ".split()
    rng = np.random.default_rng(3)
    train = [(lang, " ".join(rng.choice(w, 16))) for _ in range(200) for lang, w in (("de", de), ("en", en))]
    tagger = langid.fit(train)
    features, n, _ = langid.word_features(" ".join(de * 2 + en * 2))
    begins = np.zeros(n, bool)
    begins[0] = True
    p = langid.forward_backward(tagger.scores(features, n).astype(float), begins, tagger.start, tagger.move)
    assert (p.argmax(axis=1) == [0] * 10 + [1] * 10).all()


def test_stretches_of_switched_text_come_out_as_rows(spark):
    words = {"de": "der und nicht sich auch".split(), "en": "the and with that was".split()}
    rng = np.random.default_rng(3)
    tagger = langid.fit([(lang, " ".join(rng.choice(w, 16))) for _ in range(200) for lang, w in words.items()])
    docs = spark.createDataFrame([(1, " ".join(words["de"] * 2 + words["en"] * 2 + words["de"])), (2, None), (3, "12 !"), (None, "the and")], "doc_id long, text string")
    rows = langid.label_words(docs, tagger).collect()
    assert sorted((r.doc_id or 0, r.first_word, r.last_word, r.lang) for r in rows) == [(0, 0, 1, "en"), (1, 0, 9, "de"), (1, 10, 19, "en"), (1, 20, 24, "de")]
    assert all(0.5 < r.score <= 1 for r in rows)
    found = {r.doc_id: r for r in docs.select("doc_id", langid.tagger_of(spark, tagger)("text").alias("x")).select("doc_id", "x.*").collect()}
    assert [(found[i].lang_pred, found[i].n_words, found[i].n_stretches) for i in (1, 2, 3, None)] == [("de", 25, 3), ("und", 0, 0), ("und", 0, 0), ("en", 2, 1)]
    assert langid.label_words(docs, langid.fit([])).count() == langid.label_words(docs.limit(0), tagger).count() == 0


def test_long_texts_are_cut_between_words_only():
    rng = np.random.default_rng(4)
    for size in (7, 50):
        text = "".join("x" * rng.integers(1, 30) + rng.choice([" ", ", ", "-"]) for _ in range(200))
        cuts = list(langid.windows(text, size))
        assert "".join(cuts) == text and sum(langid.word_features(c)[1] for c in cuts) == langid.word_features(text)[1] == 200
        assert all(len(c) <= size or not re.search("[^x].*x", c[1:]) for c in cuts)
    assert list(langid.windows("", 5)) == [""] and list(langid.windows("y" * 40, 5)) == ["y" * 40]


def test_training_sample_has_every_language(spark):
    rows = [(10 * k + i, f"l{k}a l{k}b l{k}c " * 9, f"l{k}") for k in range(70) for i in range(1 + k % 3)]
    found = langid.training_stretches(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", docs_per_lang=2)
    assert {lang for lang, _ in found} == {f"l{k}" for k in range(70)}


def test_language_of_odd_rows(odd, empty):
    got = langid.identify(odd, odd).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), ("und", 0.0))
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(empty, empty).count() == 0
    assert langid.identify(odd, empty).where("lang_pred <> 'und'").count() == 0


@pytest.fixture(scope="module")
def model():
    return toxicity.CharModel.of_words(Counter({"idiot": 30, "moron": 20, "scum": 20, "trash": 20, "words": 20, "plain": 20, "the": 90, "and": 50, "other": 20}))


@pytest.mark.parametrize(("seen", "meant"), [("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiiiot", "idiot"), ("m0r0n", "moron"), ("$cum", "scum"), ("tr@sh!!", "trash"), ("id-iot", "idiot")])
def test_disguises_are_restored(model, seen, meant):
    assert meant in toxicity.words_in(f"the {seen} and", model)


@pytest.fixture(scope="module")
def wide_model():
    words = Counter({"idiot": 30, "moron": 20, "scum": 20, "trash": 20, "stupid": 20, "clown": 20, "loser": 20, "words": 20, "plain": 20, "the": 90, "and": 50, "other": 20, "it": 60, "is": 60, "an": 40, "all": 40, "good": 20, "letter": 20})
    return toxicity.CharModel.of_words(words)


@pytest.mark.parametrize(("seen", "meant"), [("!diot", "idiot"), ("idio+", "idiot"), ("|oser", "loser"), ("(lown", "clown"), ("(lown!", "clown"), ("iddiot", "idiot"), ("stuppid", "stupid"), ("moronn", "moron"), ("1 d 1 0 t", "idiot"), ("t r @ s h", "trash"), ("! d i o +", "idiot"), ("id iot", "idiot"), ("stup id", "stupid"), ("i d iot", "idiot"), ("id 10 t", "idiot"), ("mor on", "moron"), ("1d 10t", "idiot")])
def test_disguises_at_edges_doubled_and_in_pieces_are_restored(wide_model, seen, meant):
    assert meant in toxicity.words_in(f"the {seen} and", wide_model)


def test_short_words_doubled_letters_and_numbers_stay_as_they_are(wide_model):
    assert toxicity.words_in("It is an other good letter, and all is plain 10 (the words)", wide_model) == "it is an other good letter and all is plain the words".split()


def test_array_counts_of_grams_equal_plain_ones():
    words = Counter({"idiot": 3, "a": 2, "straße": 1, "𝔘nd": 4, "aaaa": 5})
    plain = Counter()
    for w, n in words.items():
        for g in toxicity.grams_of(w):
            plain[g] += n
    context, gram, n = toxicity.count_grams(words)
    assert dict(zip(gram.tolist(), n.tolist(), strict=True)) == {toxicity.gram_hash(g): k for g, k in plain.items()}
    assert dict(zip(gram.tolist(), context.tolist(), strict=True)) == {toxicity.gram_hash(g): toxicity.gram_hash(g[:-1]) for g in plain}
    assert len(toxicity.count_grams(Counter())[0]) == 0


def test_array_costs_equal_plain_ones(wide_model):
    pairs = [("id", "iot"), ("mor", "on"), ("an", "other"), ("a", "ll"), ("it", "i"), ("straße", "zz")]
    code = lambda x: [ord(c) + 1 if c != "\0" else 0 for c in x]
    ends = np.array([code((" " + a)[-3:].rjust(3, "\0")) for a, _ in pairs], np.uint64)
    starts = np.array([code((b + " ")[:3].ljust(3, "\0")) for _, b in pairs], np.uint64)
    assert np.allclose(wide_model.all_apart(ends, starts), [wide_model.apart(a, b) for a, b in pairs])


def test_words_wanted_are_those_of_a_full_reading(spark, sf, wide_model):
    wanted = {"idiot", "moron", "scum", "trash", "stupid", "clown", "loser", "fool"}
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["id iot", "the !diot", "i d i o t " * 300, None, "", "stuppid, mor on", "and 1 d 1 0 t the", "x" * 50 + " tr@sh"]
    plain, quick = toxicity.Reader(wide_model), toxicity.Reader(wide_model, wanted)
    assert quick.wanted_in(texts) == [wanted & set(x) for x in plain.words_of(texts)]
    assert sum(map(len, quick.wanted_in(texts))) > 5


def test_a_word_in_a_long_run_of_single_letters_is_found(wide_model):
    for before in (0, 130, 132, 233):  # the word lies across the first cut for two of them
        assert "idiot" in toxicity.words_in("t h e " * before + "i d i o t" + " a n d" * 150, wide_model)


def test_plain_text_stays_as_it_is(model):
    assert toxicity.words_in("The plain words, and other.", model) == ["the", "plain", "words", "and", "other"]


def test_restoration_is_the_cheapest_path(model):
    def price(observed, out):  # every way to read the characters as ``out``
        best = float("inf")
        stack = [(0, "", 0.0)]
        while stack:
            i, made, cost = stack.pop()
            if i == len(observed):
                if made.strip() == out:
                    line = " " + made
                    lm = sum(model.cost(line[max(0, k - 3) : k], line[k]) for k in range(1, len(line)))
                    best = min(best, cost + lm + (0 if line.endswith(" ") else model.cost(line[-3:], " ")))
                continue
            run = 1
            while i - run >= 0 and observed[i - run] == observed[i]:
                run += 1
            for c, extra in toxicity._readings(observed[i], run):
                stack.append((i + 1, made + ("" if c == " " and (" " + made).endswith(" ") else c), cost + extra))
        return best

    for observed in ("1d10t", "sc-um", "m0rr"):
        got = toxicity.restore(observed, model)
        others = {"idiot", "ldlot", "scum", "sc um", "moror", "morr", "mor", "d ot"}
        assert price(observed, got) <= min(price(observed, x) for x in others) + 1e-9


def test_toxicity_on_held_out_documents(spark):
    toxic, clean = "you are an awful idiot and moron".split(), "the plain words and other plain things".split()
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(400):
        words = list(rng.choice(clean, 12)) + ([f"w{rng.integers(50)}"] * 2)
        if i % 4 == 0:
            words.insert(int(rng.integers(12)), str(rng.choice(["idiot", "moron"])))
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    rows += [(900, "the plain 1d10t and other"), (901, "the plain words and other"), (902, None), (903, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, docs, labels.where("doc_id % 5 <> 0")).collect()}
    assert all(got[i].predicted == y for i, y in marks)
    assert [got[i].predicted for i in (900, 901, 902, 903)] == [1, 0, 0, 0]
    assert toxic


def test_language_model_has_all_grams(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join("".join(map(chr, rng.integers(0x4E00, 0x9FA0, 6))) for _ in range(1200)) for _ in range(40)]
    docs, labels = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    want = Counter(g for t in texts for w in set(t.split()) for g in toxicity.grams_of(w))
    count, total, kinds = toxicity.train(docs, labels).tables
    assert len(want) > 400_000 and count.sum(dtype=float) == total.sum(dtype=float) == want.total() and kinds.sum(dtype=float) == len(want)
    shift = 64 - toxicity.TABLE_BITS
    assert all(count[toxicity.gram_hash(g) >> shift] >= n for g, n in want.items())


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (6, 1, 1), (7, None, 1)], "doc_id long, toxic int, quality int")
    assert toxicity.score(odd, odd, labels).count() == len(ODD)
    assert toxicity.score(odd, odd, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score(empty, empty, labels).count() == 0


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_equal_brute_force(spark, sf, odd, empty):
    more = [(1000, "CC BY cc-by, all rights reserved. ALL RIGHTS RESERVED", "en", "s", 1), (1001, "all rights all rights reserved general public general public license", "en", "s", 1), (1002, "a cc", "en", "s", 1), (1002, "cc by", "en", "s", 1), (1002, "cc by", "en", "s", 1)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "1 AS row").unionByName(odd).unionByName(spark.createDataFrame(more, DOCS))
    want = sorted(((r.doc_id, *brute_base(r.text)) for r in docs.collect()), key=repr)
    got = sorted((tuple(r) for r in licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=repr)
    assert got == want
    assert licenses.scan(empty).count() == 0


def test_changed_wordings_are_found(spark):
    texts = ["x " * 50 + "Licensed under the new Apache License, version 2.0", "released under the MIT license", "you may not use the words in the text of the file", "redistribution and use in source or binary forms, with or without modification, are permitted"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].labels for i in range(4)] == ["apache-2.0", "mit", "", "bsd"]
    assert got[1].score == 1.0 and 0.8 <= got[0].score < 1


def test_both_patterns_cut_texts_alike(spark):
    rng = np.random.default_rng(12)
    signs = [*" \n\t\x1c\x85\xa0\u2003\u200b  ", *"abZ_9²½Ⅷ٣é", "e\u0301", *"ßЖ漢一🙂.-'\"!", "\x00", "\ufeff"]
    texts = ["x² y", "a  \n b", "", " ", *("".join(rng.choice(signs, int(n))) for n in rng.integers(1, 40, 3000))]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r.t for r in frame.select("i", F.regexp_extract_all("text", F.lit(tokencounts.SPARK_PRETOKEN), F.lit(0)).alias("t")).collect()}
    assert [got[i] for i in range(len(texts))] == [tokencounts.PRETOKEN.findall(t) for t in texts]


def test_windows_hold_every_stretch_that_may_be_like_a_phrase():
    for first, last, size in ((0, 5, 9), (7, 500, 9), (3, 4000, 160), (0, 22, 9)):
        parts = list(licenses.windows(first, last, size))
        reach = int(size / licenses.LIKENESS) + 1
        assert parts[0][0] == first and parts[-1][1] == last and max(b - a + 1 for a, b in parts) <= max(2 * (reach + 1), 1) + 1
        assert all(any(a <= x and min(x + reach - 1, last) <= b for a, b in parts) for x in range(first, last + 1))


def test_a_wording_that_comes_thousands_of_times_is_verified_piece_by_piece(spark):
    """One merged span of 60,000 words: comparing it whole would take the square of that."""
    line = "this work has been dedicated to the public domain "
    texts = [line * 7000, (line + "and once more ") * 400 + "x " * 40, "y " * 30 + line]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert all(r.labels == "public-domain" and r.score >= 0.8 for r in got.values()) and got[2].score == 1.0
    assert time.monotonic() - began < 120


def test_recall_by_share_of_changed_words(spark):
    """Of licence bodies with 5, 10 and 20 in a hundred words changed, how many are found."""
    rng = np.random.default_rng(11)
    rows, label_of = [], {}
    for share in (0.05, 0.1, 0.2):
        for _ in range(20):
            for text, label in licenses.WORDINGS[:7]:
                words = text.split()
                at = rng.choice(len(words), int(share * len(words)), replace=False)
                for k in at:
                    words[k] = f"w{rng.integers(10**6)}"
                label_of[len(rows)] = (share, label)
                rows.append((len(rows), "some words before it " + " ".join(words) + " and some after"))
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {s: np.mean([label in got[i].split(",") for i, (share, label) in label_of.items() if share == s]) for s in (0.05, 0.1, 0.2)}
    print("recall by share of changed words", recall)
    assert recall[0.05] >= 0.99 and recall[0.1] >= 0.95


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edited_texts_and_estimates(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 10 AS doc_id", "text", "lang", "source", "1 AS row").unionByName(odd)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sketches.edited_likeness(docs, bucket_chars=50_000).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.edited_sha256): r for r in got}
    off = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = by[i, hashlib.sha256(edited.encode()).hexdigest()]
        assert r.n_chars == len(text) and r.fingerprint == sketches.to_text(sketches.sketch(text.encode()))
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingle_set(text), shingle_set(other)
            off.append(abs(near - (len(a & b) / len(a | b) if a and b else float(not a and not b))))
    assert max(off) < 0.2 and np.mean(off) < 0.03
    assert sketches.edited_likeness(docs.limit(0)).count() == 0


def test_a_hot_id_is_cut_by_its_texts(spark):
    rows = [(i, f"text of {i} " * 9) for i in range(5)] + [(None, f"no id {i} " * 9) for i in range(60)] + [(3, f"same id {i} " * 9) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many, one = (sketches.edited_likeness(docs, bucket_chars=size).select("doc_id", "edited_sha256", "near_next").collect() for size in (500, 10**9))
    assert len(many) == len(rows) and sorted(map(repr, many)) == sorted(map(repr, one))


def test_sketches_merge_and_estimate():
    words = [f"w{i}" for i in range(5000)]
    a, b = " ".join(words[:4000]).encode(), " ".join(words[2000:]).encode()
    x, y = sketches.sketch(a), sketches.sketch(b)
    whole = sketches.sketch(" ".join(words).encode())
    assert (sketches.merge([x, y]) == whole).all()
    assert abs(sketches.resemblance(x, y) - 0.4) < 0.13 and abs(sketches.containment(x, y) - 0.5) < 0.15
    assert abs(sketches.distinct_count(whole) / 4996 - 1) < 0.25
    assert (sketches.from_text(sketches.to_text(x)) == x).all()


def test_sketches_of_parts_merge_in_spark(spark):
    parts = spark.createDataFrame([(1, "a b c d e f", "g"), (2, "c d e f g h", "g"), (3, None, "g"), (4, "q r s t u", "h")], "doc_id long, text string, part string")
    got = {r.part: r.sketch for r in sketches.merge_sketches(sketches.fingerprints(parts).join(parts.select("doc_id", "part"), "doc_id"), "part").collect()}
    both = sketches.merge([sketches.sketch(b"a b c d e f"), sketches.sketch(b"c d e f g h")])
    assert (sketches.from_text(got["g"]) == both).all() and len(sketches.from_text(got["h"])) == 1


def plain_run(scores, letter, n):
    """Tokens of the best cut of a run of one letter, prefix by prefix."""
    pieces = [(k, scores[letter * k]) for k in range(1, 40) if letter * k in scores]
    best, tokens = [0.0] * (n + 1), [0] * (n + 1)
    for end in range(1, n + 1):
        best[end], minus = max((best[end - k] + s, -tokens[end - k]) for k, s in pieces if k <= end)
        tokens[end] = 1 - minus
    return tokens[n]


def test_piece_scores_equal_a_plain_training(spark):
    texts = ["the cat and the hat", "a cat sat", None, "", "the the cat!", "hat hat"]
    ranks = {p.encode(): k for k, p in enumerate([*"abcdefghijklmnopqrstuvwxyz !", "th", "the", " the", " cat", "at", " hat", "an", "and", " a"])}
    scores = tokencounts.first_scores(ranks)
    for _ in range(2):
        counts = Counter()
        for word in (w for t in texts for w in tokencounts.pretokens(t or "")):
            cuts = [[word]] if len(word) == 1 else [[word[a:b] for a, b in itertools.pairwise((0, *c, len(word)))] for k in range(len(word)) for c in itertools.combinations(range(1, len(word)), k)]
            counts.update(min((c for c in cuts if all(x.encode() in scores for x in c)), key=lambda c: (-round(sum(scores[x.encode()] for x in c), 9), len(c))))
        scores = tokencounts.next_scores({p.encode(): n for p, n in counts.items()}, ranks)
    got = tokencounts.train_scores(spark.createDataFrame(enumerate(texts), "doc_id int, text string"), ranks, rounds=2)
    assert got.keys() == scores.keys() and all(got[p] == pytest.approx(scores[p]) for p in got)
    assert sum(np.exp(list(got.values()))) == pytest.approx(1)
    assert len(set(tokencounts.train_scores(spark.createDataFrame([], "doc_id int, text string"), ranks).values())) == 1


def test_token_counts_equal_plain_dynamic_programming(spark, odd, empty):
    import public_tokenizers

    v = tokencounts.first_scores(tokencounts.load_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken")))

    def plain(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            best.append(min((best[s][0] - v[word[s:e]], best[s][1] + 1) for s in range(max(0, e - 200), e) if word[s:e] in v))
        return best[-1][1]

    texts = ["Some words, and someone's words again!", "über 12345 straße \n\n x", "  two  spaces ", ""]
    for t in texts:
        assert "".join(tokencounts.pretokens(t)) == t
        assert tokencounts._token_sums([t], tokencounts.Trie(v))[0][1] == sum(plain(w.encode()) for w in tokencounts.pretokens(t))
    got = tokencounts.count_tokens(odd, v).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    long = next(r for r in got if r.doc_id == 5)  # the best cut of a run of one letter takes the fewest tokens of the longest pieces' cost
    assert (long.n_pretokens, long.n_tokens) == (1, plain_run(v, b"x", 300_000))
    assert tokencounts.count_tokens(empty, v).count() == 0
