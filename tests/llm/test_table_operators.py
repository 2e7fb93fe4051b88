"""SimHash, embeddings, mixing, packing, token files and the pipeline against brute force."""

import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from facetlake.llm import embdedup, mixing, packing, simhash, tokenfiles
from facetlake.storage import shared_dir

pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, fp string"
ODD = [(1, None, "en", "a", "x"), (2, "", None, None, "x"), (3, " \n\t", "de", "a", "x"), (4, "one", "en", "b", "x"), (5, "x " * 100_000, "en", "b", "x"), (6, "plain words here", "en", "b", "x"), (6, "plain words here", "en", "b", "x"), (None, "no id at all", "en", None, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).selectExpr("doc_id + 10 AS doc_id", "text", "lang", "source", "'' AS fp").unionByName(odd)
    got = sorted((r.doc_id or -1, r.fp % 2**64) for r in simhash.fingerprints(docs).collect())
    assert got == sorted((r.doc_id or -1, plain_fingerprint(r.text)) for r in docs.collect())


def test_trie_walk_finds_every_link_once():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 200)] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    fps = np.unique(np.concatenate((base, near, [np.uint64(0), np.uint64(2**64 - 1)])))
    for radius in (0, 1, 2, 3):
        i, j = simhash.trie_links(np.array([0, len(fps)]), fps, radius)
        want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if bin(int(fps[a] ^ fps[b])).count("1") <= radius}
        assert len(i) == len(want) and {(min(x), max(x)) for x in zip(i.tolist(), j.tolist(), strict=True)} == want


@pytest.mark.parametrize(("max_group", "radius"), [(2, 2), (16, 2), (2048, 2), (2048, 6), (8, 4)])
def test_near_pairs_have_all_components(spark, max_group, radius):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = list(base)
    for _ in range(4):  # chains of near copies
        fps += [int(x) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for x in list(fps)[-60:]]
    fps = sorted({int(x) for x in fps} | {0, 1, 3, 2**64 - 1})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash.near_pairs(spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long"), radius, max_group).collect()
    links = [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if bin(fps[a] ^ fps[b]).count("1") <= radius]
    assert components(len(fps), [(r.a, r.b) for r in edges]) == components(len(fps), links)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert {by[i].component_id for i in (1, 2, 3)} == {1} and by[6].component_id == 6 and by[None].component_id is None and by[None].kept
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6]


VECTORS = "vec_id long, embedding array<float>, label int, rep string"


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(20, 16))
    rows = [(i, (base[rng.integers(20)] + rng.normal(size=16) * rng.choice([0.02, 0.2])).astype(np.float32).tolist(), int(rng.integers(3)), "x") for i in range(240)]
    rows += [(300 + i, rows[i][1], rows[i][2], "x") for i in range(20)] + [(400, None, 1, "x"), (401, [0.0] * 16, 1, "x"), (402, [float("nan")] + [1.0] * 15, 1, "x"), (403, [float("inf")] * 16, 1, "x"), (404, rows[0][1], None, "x"), (405, rows[0][1], None, "x"), (406, [], 1, "x"), (407, [None] * 16, 1, "x"), (408, [2 * x for x in rows[0][1]], rows[0][2], "x"), (409, rows[0][1] + [0.0], rows[0][2], "x"), (None, rows[0][1], rows[0][2], "x")]
    ids = [r[0] for r in rows if r[0] is not None]
    vec = {r[0]: np.array([np.nan if x is None else x for x in r[1] or []], float) for r in rows}
    label = {r[0]: r[2] for r in rows}
    good = [i for i in ids if label[i] is not None and len(vec[i]) and np.isfinite(vec[i]).all() and vec[i].any()]
    links = [(i, j) for a, i in enumerate(good) for j in good[a + 1 :] if label[i] == label[j] and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] / np.linalg.norm(vec[i]) / np.linalg.norm(vec[j]) >= 0.98]
    assert len(links) > 100
    at = {i: k for k, i in enumerate(sorted(ids))}
    comp = components(len(ids), [(at[i], at[j]) for i, j in links])
    count = dict.fromkeys(ids, 0)
    for x in (y for link in links for y in link):
        count[x] += 1
    for tile in (16, 100, 16384):
        got = embdedup.near_duplicates(spark.createDataFrame(rows, VECTORS), tile_rows=tile).collect()
        assert len(got) == len(rows)
        found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
        assert found.pop(None) == (0, None, True)
        assert found == {i: (count[i], sorted(ids)[comp[at[i]]], sorted(ids)[comp[at[i]]] == i) for i in ids}
    assert embdedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(8)
    a, b = embdedup.Quantised(rng.normal(size=(300, 64))), embdedup.Quantised(rng.normal(size=(200, 64)) ** 3)
    true = a.unit @ b.unit.T
    upper = a.upper(slice(0, 300), b, slice(0, 200))
    assert (upper >= true - 1e-6).all() and (upper - true).max() < 0.1


def test_mixture_meets_its_targets(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 10 AS doc_id", "text", "lang", "source", "'' AS fp").unionByName(odd)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    con = duckdb.connect()
    documents = docs.toArrow()  # pandas would make doubles of ids with a null
    con.register("documents", documents)
    want = con.sql(mixing.MIX_SQL).fetchall()
    assert sorted(((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in rows), key=repr) == sorted(want, key=repr)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault((r.source, r.source_size, r.target), []).append(r.taken)
    for (_, size, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.5 + 1e-6 * size
    assert sum(t for _, _, t in by) == pytest.approx(1.5 * sum(s for _, s, _ in by))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets_share_what_full_sources_leave(spark):
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 0)], "source string, source_size long")).collect()}
    level = (1.5 * 1110 - 20 - 200) / 1
    assert got == {"a": 20.0, "b": pytest.approx(level), "c": 200.0, None: 0.0}


def test_mixed_documents_carry_the_words_taken(spark, odd):
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.mix(odd).collect())


def test_mixed_documents_tell_rows_of_one_id_apart(spark):
    sizes = [100, 1000, 40, 7, 300, 300]
    rows = [(i, " ".join(f"r{k}w{j}" for j in range(n)), "en", s, "x") for i in (None, 3) for k, (n, s) in enumerate(zip(sizes, "abcaba", strict=True))]
    rows += [(None, "same row " * 50, "en", "b", "x")] * 3
    docs = spark.createDataFrame(rows, DOCS)
    for factor in (0.5, 1.0, 1.5):
        got, plan = mixing.mixed_documents(docs, total_factor=factor).collect(), mixing.mix(docs, total_factor=factor).collect()
        for key in {(i, s) for i, _, _, s, _ in rows}:
            parts = lambda size, taken: [size] * (taken // size) + [taken % size] * (taken % size > 0)
            want = sorted(x for r in plan if (r.doc_id, r.source) == key for x in parts(r["size"], r.taken))
            assert sorted(len(r.text.split()) for r in got if (r.doc_id, r.source) == key) == want


def test_packing_holds_every_piece(spark, odd):
    docs = odd.unionByName(spark.createDataFrame([(10 + i, "w " * (i * 37 % 3000 + 1), "en", "a", "x") for i in range(150)], DOCS))
    for shard in (40, 50_000):
        rows = packing.pack_documents(docs, shard_pieces=shard).collect()
        assert sum(r.piece_size for r in rows) == sum(len((r.text or "").split()) for r in docs.collect())
        bins = {}
        for r in rows:
            if r.bin_id is None:
                assert r["size"] == 0 and r.piece_size == 0
            else:
                bins.setdefault((r.bin_id, r.bin_capacity, r.bin_used), []).append((r.bin_offset, r.piece_size))
        for (_, capacity, used), held in bins.items():
            held.sort()
            assert capacity in packing.CAPACITIES and used <= capacity and all(c >= used for c in packing.CAPACITIES if c >= capacity)
            assert [o for o, _ in held] == [sum(s for _, s in held[:i]) for i in range(len(held))] and sum(s for _, s in held) == used
            assert capacity == min(c for c in packing.CAPACITIES if c >= used)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_bin():
    places, offsets, sizes = packing.pack([8000, 4000, 600, 190, 150, 2], (512, 1024, 8192), price=lambda c: c + 500)
    assert places == [0, 1, 1, 0, 1, 0] and offsets == [0, 0, 4000, 8000, 4600, 8190] and sizes == [8192, 8192]
    assert packing.pack([300, 200, 100], (512, 1024), price=lambda c: c * c)[2] == [512, 512]


def total_cost(sizes, places, capacities, price):
    held = Counter()
    for size, k in zip(sizes, places, strict=True):
        held[k] += size
    return sum(min(price(c) for c in capacities if c >= used) if used <= max(capacities) else float("inf") for used in held.values())


def partitions(n):
    """Every way to put n items into bins, as a bin for each item."""
    ways = [[0]]
    for _ in range(n - 1):
        ways = [[*w, k] for w in ways for k in range(max(w) + 2)]
    return ways


def test_packing_is_close_to_the_best_of_all_partitions():
    rng = np.random.default_rng(2)
    gaps = []
    for trial in range(60):
        capacities = ((8, 16, 32), (4, 10, 30), (16, 64))[trial % 3]
        price = (lambda c: c + 2.0, lambda c: c + c * c / 32, lambda c: c + 5.0 - c / 8)[trial // 3 % 3]
        sizes = sorted(rng.integers(1, max(capacities) * 2 // 3, 7).tolist(), reverse=True)
        places, offsets, chosen = packing.pack(sizes, capacities, price)
        got = sum(map(price, chosen))
        assert got == pytest.approx(total_cost(sizes, places, capacities, price))
        gaps.append(got / min(total_cost(sizes, w, capacities, price) for w in partitions(7)) - 1)
    assert np.mean(gaps) < 0.02 and max(gaps) < 0.25


def test_packing_settles_lengths_jointly():
    # Twelve of 40 fill 480 of 512; opening 1,024 for them would leave 64 places or need more than two of them.
    sizes = [600] + [424] + [40] * 12
    assert sorted(packing.pack(sizes, (512, 1024), price=lambda c: c)[2]) == [512, 1024]
    for fixed in (512, 1024):
        sizes = sorted(np.random.default_rng(fixed).integers(1, 512, 400).tolist(), reverse=True)
        got = sum(map(packing.cost, packing.pack(sizes, (512, 1024, 2048))[2]))
        alone = packing.best_fit(sizes, lambda size, _: fixed)[2]  # noqa: B023
        assert got <= sum(packing.cost(packing.cheapest(u, (512, 1024, 2048), packing.cost)) for u in alone)


def test_sequences_hold_every_token(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(1, 9999, int(n)).tolist()) for i, n in enumerate([*rng.integers(0, 90, 40), 300, 0])]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("n", F.size("ids"))
    packed = packing.pack_documents(docs, size_col="n", capacities=(16, 64, 128), shard_pieces=20)
    ids, places = dict(rows), packed.where("bin_id is not null").collect()
    seqs = {r.bin_id: r for r in packing.sequences(packed, docs, pad=0).collect()}
    assert sum(r.ids.count(0) == 0 or r.ids.index(0) == sum(x > 0 for x in r.ids) for r in seqs.values()) == len(seqs)
    for r in places:
        seq = seqs[r.bin_id]
        assert len(seq.ids) == len(seq.documents) == seq.capacity == r.bin_capacity
        assert seq.ids[r.bin_offset : r.bin_offset + r.piece_size] == ids[r.doc_id][r.piece_start : r.piece_start + r.piece_size]
        assert len(set(seq.documents[r.bin_offset : r.bin_offset + r.piece_size])) == 1
    assert sum(sum(x > 0 for x in r.documents) for r in seqs.values()) == sum(map(len, ids.values()))


def test_packed_sequences_of_rows_that_share_an_id_or_have_none(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 3 if i % 4 else None, rng.integers(1, 9999, int(n)).tolist()) for i, n in enumerate([*rng.integers(1, 90, 30), 300])] + [(1, []), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumns({"row": F.lit("x"), "size": F.lit(3), "id": F.lit(4)})
    got = packing.pack_sequences(docs, pad=0, capacities=(16, 64, 128), shard_pieces=20).collect()
    pieces = []
    for r in got:
        assert len(r.ids) == len(r.documents) == r.capacity and set(r.documents) <= set(range(len(r.doc_ids) + 1))
        pieces += [(i, tuple(t for t, k in zip(r.ids, r.documents, strict=True) if k == n)) for n, i in enumerate(r.doc_ids, 1)]
    whole = [(i, tuple(ids)) for i, ids in rows if ids and len(ids) <= 128]
    assert Counter(x for x in pieces if x in whole) == Counter(whole)
    assert sum(len(x) for _, x in pieces) == sum(len(ids or []) for _, ids in rows)
    assert packing.pack_sequences(docs.limit(0), pad=0).count() == 0


def test_rows_of_one_id_are_dealt_to_many_shards(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 300, "doc_id long, text string")
    rows = packing.pack_documents(docs, shard_pieces=30).collect()
    assert len(rows) == 300 and len({r.bin_id >> 32 for r in rows}) > 5


def test_token_files_round_trip(spark, sf, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    hard = [(20 + i, t, "en", "a", "x") for i, t in enumerate(["a  b", "a \n b", "x\n  y", " lead", "trail ", "<|endoftext|> hi", "don't  x\t y", "\n", "ünï ½ x\x00y", "a b"])]
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "'' AS fp").unionByName(odd).unionByName(spark.createDataFrame(hard, DOCS))
    docs = docs.unionByName(spark.createDataFrame([(-(1 << 63), "the least id", "en", "a", "x"), (0, "zero", "en", "a", "x")], DOCS))
    out = shared_dir(spark, "tokens")
    tokenfiles.write_shards(docs, out, path, 50_257, 2, partitions=3, sample_docs=50, dictionary_bytes=8192)
    tok = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, want = 0, []
    for i, text in rows:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenfiles.read_shards(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1:]) == sorted(want, key=lambda r: r[1:])
    assert tokenfiles.read_document(out, 26).tolist() == [*tok.encode("don't  x\t y", add_special_tokens=False).ids, 2]
    assert tokenfiles.read_document(out, 10**9) is None
    assert tokenfiles.read_document(out, 0).tolist() == [*tok.encode("zero", add_special_tokens=False).ids, 2]
    assert len(tokenfiles.read_document(out, -(1 << 63))) > 1
    nothing = shared_dir(spark, "tokens")
    tokenfiles.write_shards(docs.limit(0), nothing, path, 50_257, 2)
    assert tokenfiles.read_shards(spark, nothing).count() == 0


def test_pipeline_stages_keep_columns_and_take_effect(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{shared_dir(spark, name)}"
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert docs.columns == columns
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in docs.collect()) == jaccard_kept([(r.doc_id, r.text) for r in before.collect()])
        elif name == "mixture":
            want = sum(r.taken for r in mixing.mix(before).collect())
            assert sum(len(r.text.split()) for r in docs.collect()) == want
            assert all(r.text == texts[r.doc_id] or texts[r.doc_id].split()[: len(r.text.split())] == r.text.split() for r in docs.collect())
        else:
            assert 0.5 * n < docs.count() <= before.count()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r.piece_size for r in rows) == want
    assert os.path.basename(path)


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, texts = public_tokenizers.path("word_bpe_49k.json"), ["Some Words, and someone's", "über 123 straße", "", "a  b"]
    packed = tokenfiles.ChunkEncoder(path, np.dtype("<u2")).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in packed] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_keep_one_tells_texts_of_one_id_apart(spark):
    alpha = "alpha beta gamma delta epsilon"
    rows = [(3, alpha), (7, alpha), (7, "wholly other words stand in this one"), (7, "wholly other words stand in this one"), (None, alpha), (None, alpha)]
    left = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, alpha), (0, alpha), (3, alpha), (7, "wholly other words stand in this one")]


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_kept(rows):
    """Smallest ids of the components that five-word Jaccard of 0.8 makes, over all pairs."""
    ids, sets = zip(*sorted((i, shingle_set(t)) for i, t in rows), strict=True)
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    comp = components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a + 1, len(ids)) if alike(sets[a], sets[b])])
    return [ids[c] for i, c in enumerate(comp) if i == c]


def test_marks_bound_what_two_sets_share_and_come_near_it(spark):
    from facetlake.llm import minhash

    rng = np.random.default_rng(9)
    rows, common = [], []
    for n, kept in ((5, 1.0), (150, 0.9), (150, 0.7), (150, 0.0), (1500, 0.8), (9000, 0.5)):
        a = rng.integers(0, 1 << 64, n, np.uint64)
        b = np.unique(np.concatenate((a[rng.random(n) < kept], rng.integers(0, 1 << 64, n // 4, np.uint64))))
        both = len(np.intersect1d(a, b))
        common.append((both, n))
        rows.append([dict(zip(("once", "twice", "beyond"), minhash.marks(x), strict=True)) for x in (a, b)])
    kind = "struct<marks:struct<once:array<long>,twice:array<long>,beyond:int>>"
    frame = spark.createDataFrame([(k, {"marks": a}, {"marks": b}) for k, (a, b) in enumerate(rows)], f"k int, x {kind}, y {kind}")
    got = [r[0] for r in frame.orderBy("k").select(minhash.most_common("x", "y")).collect()]
    assert all(g >= both for g, (both, _) in zip(got, common, strict=True))
    assert all(g - both <= 0.12 * n for g, (both, n) in zip(got, common, strict=True) if n <= 1500)


def test_near_duplicate_stage_finds_all_pairs_at_a_jaccard_of_0_8(spark):
    import corpus_pipeline

    rng = np.random.default_rng(7)
    texts = []
    for k in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        texts.append(" ".join(base))
        for changes in (1, 3, 5, 6, 6, 7, 12):  # 6 words change about a tenth of the shingles: 0.82
            copy = list(base)
            for at in rng.choice(300, changes, replace=False):
                copy[at] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    rows = [(i, t, "en", "a", "x") for i, t in enumerate(texts)]
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect())
    want = jaccard_kept([r[:2] for r in rows])
    assert got == want and 12 < len(want) < 40
    base = [f"v{x}" for x in rng.integers(0, 5000, 150)]
    many = []  # copies of one text that are near it, but seldom near each other
    for i in range(120):
        copy = list(base)
        for at in rng.choice(150, int(rng.integers(0, 6)), replace=False):
            copy[at] = f"new{rng.integers(10**6)}"
        many.append((i, " ".join(copy), "en", "a", "x"))
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(many, DOCS), "").collect())
    assert got == jaccard_kept([r[:2] for r in many]) and 1 <= len(got) < 100
    clash = [(7, texts[0], "en", "a", "x"), (7, texts[9], "en", "a", "x"), (7, texts[9], "en", "a", "x"), (None, texts[0], "en", "a", "x"), (None, texts[0], "en", "a", "x"), (8, None, "en", "a", "x"), (9, " ", "en", "a", "x")]
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(clash, DOCS), "").collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in left) == sorted([(7, texts[0]), (7, texts[9]), (-1, texts[0]), (-1, texts[0]), (8, "")])
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], DOCS), "").count() == 0
