"""Every registered query of this part over whole tables: its columns, its rows and what can be said by brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import __spark_entry__
from facetlake.llm import langid, licenses, packing, queries, sketches, tokencounts
from test_manifest_quality_runs import plain_manifest

pytest.importorskip("public_tokenizers")
COLUMNS = {
    "op1_language_crf": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_embedding_int8": {"vec_id", "n_links", "component_id", "kept"},
    "op3_packing": {"doc_id", "size", "piece", "piece_start", "piece_size", "bin_id", "bin_offset", "bin_capacity", "bin_used"},
    "op4_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op5_token_counts": {"doc_id", "n_pretokens", "n_tokens"},
    "op6_simhash_trie": {"doc_id", "fingerprint", "component_id"},
    "op7_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op8_licenses": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op9_bottom_k": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op11_merkle_manifest": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op12_quality_discriminant": {"doc_id", "held_out", "score", "predicted"},
    "op13_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
}


@pytest.fixture(scope="module")
def docs(spark, sf):
    return sorted((r.doc_id, r.text or "", r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


@pytest.fixture(scope="module")
def result(spark, sf):
    made = {}

    def get(name):
        if name not in made:
            frame = queries.queries()[name](spark, sf)
            assert COLUMNS[name] <= set(frame.columns)
            made[name] = frame.collect()
        return made[name]

    return get


def test_all_are_registered():
    assert set(COLUMNS) | {"pipeline"} <= set(__spark_entry__.queries()) and set(COLUMNS) == set(queries.queries())


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - {"op2_embedding_int8", "op3_packing"}))
def test_each_document_has_one_row(result, docs, name):
    assert sorted(r.doc_id for r in result(name)) == [d[0] for d in docs]


def test_language_query(result, docs):
    by = {r.doc_id: r for r in result("op1_language_crf")}
    for i, text, _, _ in docs:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= by[i].score <= 1
        assert (by[i].lang_pred == "und") == (not any(c.isalpha() for c in text))
    known = [(by[i].lang_pred, lang) for i, _, lang, _ in docs if lang and by[i].held_out]
    assert np.mean([a == b for a, b in known]) > 0.95


def test_language_query_is_the_tagger_of_its_training_rows(result, docs, spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet").where("NOT (crc32(CAST(doc_id AS STRING)) % 4 = 2)")
    taught = langid.training_stretches(frame, "doc_id", "text", "lang", docs_per_lang=500, stretches_per_doc=6)
    words = {w for i, text, _, _ in docs if zlib.crc32(str(i).encode()) % 4 != 2 for w in text.split()}
    assert all(set(x.split()) <= words for _, x in taught) and {lang for lang, _ in taught} == {lang for _, _, lang, _ in docs if lang}
    found, score, _, _ = langid.fit(taught).predict([text for _, text, _, _ in docs])
    by = {r.doc_id: r for r in result("op1_language_crf")}
    assert [by[i].lang_pred for i, _, _, _ in docs] == list(found) and np.allclose([by[i].score for i, _, _, _ in docs], score, atol=1e-9)


def test_embedding_query(result, spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    vec = {r.vec_id: np.array(r.embedding, float) for r in rows}
    label = {r.vec_id: r.label for r in rows}
    links = Counter()
    ids = sorted(vec)
    unit = np.stack([vec[i] / np.linalg.norm(vec[i]) for i in ids])
    near = (unit @ unit.T >= 0.98) & (np.array([label[i] for i in ids])[:, None] == np.array([label[i] for i in ids]))
    for k, i in enumerate(ids):
        links[i] = int(near[k].sum()) - 1
    got = {r.vec_id: r for r in result("op2_embedding_int8")}
    assert {i: got[i].n_links for i in ids} == dict(links) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    reach = near.copy()
    while (wider := reach @ reach).sum() > reach.sum():
        reach = wider
    assert {i: got[i].component_id for i in ids} == {i: ids[int(np.argmax(reach[k]))] for k, i in enumerate(ids)}


def test_packing_query(result, docs):
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text)) for i, text, _, _ in docs}
    total, bins = Counter(), Counter()
    for r in result("op3_packing"):
        total[r.doc_id] += r.piece_size
        if r.bin_id is not None:
            bins[r.bin_id, r.bin_capacity, r.bin_used] += r.piece_size
    assert total == Counter(words) and all(held == used <= capacity for (_, capacity, used), held in bins.items())


def test_packing_query_overlaps_nowhere_and_costs_no_more_than_plain_best_fit(result):
    held, sizes = {}, []
    for r in result("op3_packing"):
        if r.bin_id is not None:
            held.setdefault((r.bin_id, r.bin_capacity), []).append((r.bin_offset, r.piece_size))
            sizes.append(r.piece_size)
    for (_, capacity), pieces in held.items():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert capacity == min((c for c in packing.CAPACITIES if c >= sum(n for _, n in pieces)), key=lambda c: (packing.cost(c), c))
    paid = sum(packing.cost(c) for _, c in held)
    for fixed in packing.CAPACITIES:
        room = []
        for n in sorted(sizes, reverse=True):
            fits = [k for k, (free, _) in enumerate(room) if free >= n]
            if fits:
                k = min(fits, key=lambda k: room[k][0])
                room[k] = (room[k][0] - n, room[k][1])
            else:
                c = min((c for c in packing.CAPACITIES if c >= max(n, fixed)))
                room.append((c - n, c))
        assert paid <= sum(packing.cost(min(x for x in packing.CAPACITIES if x >= c - free)) for free, c in room) + 1e-9


def test_token_count_query(result, docs):
    """Two rounds of best cuts over all pre-tokens and then counts, with a plain table of prefixes for each pre-token."""
    import public_tokenizers

    pieces = tokencounts.load_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = {i: tokencounts.PRETOKEN.findall(text) for i, text, _, _ in docs}
    every = Counter(w.encode() for x in tokens.values() for w in x)
    total = sum(1 / (r + 10) for r in pieces.values())
    score = {p: -np.log((r + 10) * total) for p, r in pieces.items()}
    longest = max(map(len, pieces))

    def cut(word):
        best = [(0.0, 0, 0)]
        for end in range(1, len(word) + 1):
            ways = [(best[a][0] + score[word[a:end]], -best[a][1] - 1, a) for a in range(max(0, end - longest), end) if word[a:end] in score]
            top = max(w[0] for w in ways)
            _, n, a = max(w for w in ways if w[0] >= top - 1e-9)  # as good but for rounding: the fewest tokens
            best.append((top, -n, a))
        return best

    for _ in range(2):
        found = Counter()
        for word, n in every.items():
            best, end = cut(word), len(word)
            while end:
                found[word[best[end][2] : end]] += n
                end = best[end][2]
        whole = np.log(sum(found.get(p, 0) + tokencounts.SHRINK for p in pieces))
        score = {p: np.log(found.get(p, 0) + tokencounts.SHRINK) - whole for p in pieces}
    count = {word: cut(word)[-1][1] for word in every}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in result("op5_token_counts")}
    want = {i: (len(x), sum(count[w.encode()] for w in x)) for i, x in tokens.items()}
    assert {i: n[0] for i, n in got.items()} == {i: n[0] for i, n in want.items()}
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.98 and max(abs(got[i][1] - want[i][1]) for i in want) <= 2


def test_token_file_query(result, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, start, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, {r.doc_id: r for r in result("op4_token_files")}
    for i, text, _, _ in docs:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(result, docs):
    fps = {i: plain_fingerprint(text) for i, text, _, _ in docs}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in result("op6_simhash_trie")} == {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_license_query(result, docs):
    got = {r.doc_id: r for r in result("op8_licenses")}
    for i, text, _, _ in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(k, label) for p, label in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        want = (len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want and 0 <= r.score <= 1
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        labels = set(filter(None, r.labels.split(",")))
        line, pairs = f" {' '.join(words)} ", set(zip(words, words[1:]))  # noqa: B905
        phrases = [(x[0], label) for text, label in licenses.WORDINGS if (x := [b" ".join(licenses.words_of(text.encode())).decode()])]
        assert {label for x, label in phrases if f" {x} " in line} <= labels
        for label in labels - set(filter(None, r.base_labels.split(","))):  # what the method adds is like one of its wordings
            shared = [np.mean([p in pairs for p in zip(x.split(), x.split()[1:])]) for x, own in phrases if own == label]  # noqa: B905
            assert max(shared) >= 0.5 and r.score >= licenses.LIKENESS


def test_fingerprint_query(result, docs):
    got = {r.doc_id: r for r in result("op9_bottom_k")}
    for k, (i, text, _, _) in enumerate(docs):
        after, cut = docs[(k + 1) % len(docs)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == sketches.to_text(sketches.sketch(text.encode())) and r.edited_fingerprint == sketches.to_text(sketches.sketch(edited.encode()))
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = word_shingles(text), word_shingles(other)
            share = len(a & b) / len(a | b) if a or b else 1.0
            assert near == pytest.approx(share, abs=1e-9 if len(a | b) <= sketches.K else 0.25)


def word_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_toxicity_query(result, docs, spark, sf):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in result("op10_toxicity")}
    for i, _, _, _ in docs:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
    clean = [got[i].predicted for i, y in toxic.items() if y == 0 and i in got]
    assert np.mean(clean) < 0.05


def test_toxicity_query_catches_toxic_documents_that_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.queries()["op10_toxicity"](spark, sf).collect()}
    for held in (False, True):
        caught = [got[i].predicted for i, y in toxic.items() if y == 1 and i in got and got[i].held_out == held]
        wrong = [got[i].predicted for i, y in toxic.items() if y == 0 and i in got and got[i].held_out == held]
        assert len(caught) >= 5 and np.mean(caught) >= 0.6 and np.mean(wrong) < 0.02


def test_manifest_query(result, spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    tampered = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and bool(re.search("[A-Z]", r["text"] or "")) for r in rows}
    got = result("op11_merkle_manifest")
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=repr) == [x[:5] for x in plain_manifest(rows)]
    assert {r.doc_id: r.verified for r in got} == {i: not t for i, t in tampered.items()} and any(tampered.values())
    assert all(r.verified == (r.folded_root == r.root) for r in got)


def test_quality_query(result, docs, spark, sf):
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in result("op12_quality_discriminant")}
    for i, _, _, _ in docs:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
    held = [(got[i].predicted, y) for i, y in good.items() if i in got and got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.9 and any(p == y == 0 for p, y in held)


def test_periodic_run_query(result, docs):
    got = {r.doc_id: r for r in result("op13_periodic_runs")}
    for i, text, _, _ in docs:
        w, h = re.findall(r"[^\x20\x09-\x0D]+", text), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        runs = periodic_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(top or (None,) * 3)) and r.exponent_milli == (top and 1000 * top[1] // top[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


def periodic_runs(w):
    """Runs by comparing the words of every distance with numpy."""
    known = {}
    w = np.array([known.setdefault(x, len(known)) for x in w])
    out = []
    for q in range(1, len(w) // 4 + 1):
        edge = np.diff(np.concatenate(([0], w[q:] == w[:-q], [0])).astype(int))
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            n = int(e - s) + q
            if n >= max(6, 4 * q) and not any((w[s + p : s + n] == w[s : s + n - p]).all() for p in range(1, q)):
                out.append((int(s), n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_near_duplicate_stage_keeps_what_all_pairs_say(spark, sf, docs):
    import corpus_pipeline

    sets = {i: word_shingles(text) for i, text, _, _ in docs}
    ids, root = sorted(sets), {i: i for i in sets}
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root.values())) and len(kept) < len(ids)
    assert {r.doc_id: r.text or "" for r in kept} == {i: text for i, text, _, _ in docs if root[i] == i}


def test_pipeline_run_keeps_to_its_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    want = Counter((r.doc_id, r["size"], r.piece_start, r.piece_size) for r in corpus_pipeline.pack(spark, docs, sf).collect())
    assert Counter((r.doc_id, r["size"], r.piece_start, r.piece_size) for r in corpus_pipeline.run(spark, sf).collect()) == want
