"""The Merkle manifest, the quality discriminant and periodic runs against plain versions on small tables."""

import hashlib
import random

import numpy as np
import pytest
from facetlake.llm import merkle, periodic, quality
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def plain_tree(nodes):
    """Root and, for each leaf, its siblings from below up as (left, right)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for leaf, i in enumerate(at):
            run = runs[i // 16]
            ways[leaf].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at = [i // 16 for i in at]
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], ways


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s])]) for s in order}
    root, tops = plain_tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (known, i, leaf), way in zip(sorted(by[s]), trees[s][1], strict=True):
            proof = "".join(a + b for a, b in [*way, *top])
            out.append((i if known else None, leaf, trees[s][0], root, sha(proof), proof))
    return sorted(out, key=repr)


def some_rows(sizes, seed=1):
    rnd = random.Random(seed)
    rows = [{"doc_id": rnd.randrange(10**6), "text": rnd.choice([None, "", "A b", "Ünï C", "x" * 300]), "lang": rnd.choice([None, "en"]), "source": s, "n_chars": rnd.choice([None, 5])} for s, n in sizes.items() for _ in range(n)]
    rnd.shuffle(rows)
    return rows


def found_manifest(spark, rows, **options):
    frame = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS)
    return merkle.manifest(frame, with_proofs=True, **options).collect()


@pytest.mark.parametrize("part_rows", [1000, 40, 7])
def test_manifest_of_many_sources_in_partitions_of_any_size(spark, part_rows):
    rows = some_rows({None: 3, "": 1, "a": 300, "B": 17, "é": 16, **{f"host{i}": 1 + i % 3 for i in range(40)}})
    rows += [rows[5], rows[5], {**rows[9], "doc_id": None}, {**rows[9], "doc_id": None, "text": "other"}]
    got = found_manifest(spark, rows, part_rows=part_rows)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.proof) for r in got), key=repr) == plain_manifest(rows)
    assert all(r.verified and r.folded_root == r.root and r.n_siblings * 64 == len(r.proof) for r in got)


def test_manifest_of_one_row_and_of_none(spark):
    rows = some_rows({"a": 1})
    (r,) = found_manifest(spark, rows)
    assert r.leaf == r.subroot == r.root == r.folded_root == plain_leaf(rows[0]) and r.proof == "" and r.proof_sha256 == sha("")
    assert found_manifest(spark, []) == []


def test_a_changed_row_does_not_verify(spark):
    rows = [{**r, "text": t} for r, t in zip(some_rows({"a": 40, "b": 2}), ["Upper", "lower", None] * 14, strict=True)]
    frame = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS)
    got = {r.doc_id: r for r in merkle.manifest(frame.withColumns({"leaf": F.lit(1), "part": F.lit("x"), "at": F.lit(2)}), changed=F.lower("text")).collect()}
    assert {r["doc_id"]: got[r["doc_id"]].verified for r in rows} == {r["doc_id"]: r["text"] != "Upper" for r in rows}


@given(st.integers(1, 5000), st.data())
@settings(max_examples=60, deadline=None)
def test_missing_nodes_are_least_and_enough(size, data):
    """No node is asked for that known ones give, and all siblings of all held leaves are there."""
    first = data.draw(st.integers(0, size - 1))
    end = data.draw(st.integers(first + 1, size))
    known, asked = {(0, i) for i in range(first, end)}, set(merkle.missing(first, end, size))
    counts = merkle.levels(size)
    for level, n in enumerate(counts[:-1]):
        runs = {i // 16 for lv, i in known if lv == level}
        need = {(level, i) for run in runs for i in range(run * 16, min(run * 16 + 16, n))}
        assert {x for x in asked if x[0] == level} == need - known
        known |= {(level + 1, run) for run in runs}


def plain_runs(w, least_length=6, least_exponent=4):
    out = []
    for q in range(1, len(w) // least_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, n = i, j - i + q
            if n >= max(least_length, least_exponent * q) and not any(all(w[k] == w[k + p] for k in range(s, s + n - p)) for p in range(1, q)):
                out.append((s, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@given(st.lists(st.lists(st.integers(0, 2), max_size=50), max_size=6), st.sampled_from([(6, 4), (2, 2), (3, 3), (10, 2)]))
@settings(max_examples=150, deadline=None)
def test_runs_of_small_alphabets(lines, least):
    assert periodic.runs_of_texts([np.array(x, np.int64) for x in lines], *least) == [plain_runs(x, *least) for x in lines]


def test_runs_inside_long_and_in_wholly_periodic_texts():
    rnd = random.Random(3)
    noise = [rnd.randrange(30) for _ in range(3000)]
    long = noise[:1000] + [7, 8, 9] * 5 + noise[1000:2000] + [1] * 9 + noise[2000:] + list(range(40, 60)) * 4
    assert periodic.runs_of_texts([np.array(long)])[0] == plain_runs(long)
    assert periodic.runs_of_texts([np.zeros(50_000, np.int64)])[0] == [(0, 50_000, 1)]
    assert periodic.runs_of_texts([np.arange(60_000) % 777])[0] == [(0, 60_000, 777)]


def test_find_runs_with_nulls_repeats_and_clashing_columns(spark):
    texts = [(1, "a b a b a b a b c"), (1, "a b a b a b a b c"), (None, "x x x x x x"), (2, None), (3, " \t\n"), (4, "x x x x  x x\tx x\nx x x x"), (5, "x x x x x")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"runs": F.lit(1), "n_words": F.lit("z"), "collapsed": F.lit(2)})
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(frame).collect()), key=repr)
    want = [(1, 9, [(0, 8, 2)], "a b c")] * 2 + [(None, 6, [(0, 6, 1)], "x"), (2, 0, [], ""), (3, 0, [], ""), (4, 6, [(0, 6, 1)], "x x"), (5, 5, [], "x x x x x")]
    assert got == sorted(want, key=repr)
    d = {r.doc_id: r for r in periodic.digests(periodic.find_runs(frame)).collect()}
    assert (d[1].n_runs, d[1].start, d[1].length, d[1].period, d[1].exponent_milli, d[1].runs_sha256, d[1].collapsed_sha256) == (1, 0, 8, 2, 4000, sha("0,8,2\n"), sha("a b c"))
    assert (d[2].n_runs, d[2].start, d[2].runs_sha256, d[2].collapsed_sha256) == (0, None, sha(""), sha(""))
    assert periodic.find_runs(frame.limit(0)).collect() == []


def junk_and_prose(n=120):
    rnd = random.Random(5)
    words = "the of and a river stone garden morning letter window paper light found under always little".split()
    prose = [" ".join(rnd.choice(words) for _ in range(rnd.randint(20, 60))).capitalize() + "." for _ in range(n)]
    junk = [" ".join(rnd.choice(words).upper() + "!!" for _ in range(rnd.randint(20, 60))) for _ in range(n // 3)]
    return [(i, t, 1) for i, t in enumerate(prose)] + [(1000 + i, t, 0) for i, t in enumerate(junk)]


def test_quality_is_learned_and_nulls_are_scored(spark):
    rows = junk_and_prose()
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t, _ in rows] + [(None, rows[0][1], "s", 1), (7777, None, None, None), (7778, "", None, None), (0, rows[0][1], "s", 1)], "doc_id long, text string, label string, x long")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000, 1), (None, 0), (3, None), (4, 9)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].predicted == y for i, _, y in rows]) > 0.97
    assert by[None].score == by[0].score and by[7777].score == by[7778].score
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_quality_without_labels_of_both_classes(spark):
    rows = junk_and_prose(6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert len({r.score for r in quality.score(docs, spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")).collect()}) == 1
    assert quality.score(docs.limit(0), none).collect() == []


def test_density_difference_is_that_of_two_normal_distributions():
    rng = np.random.default_rng(4)
    x = {c: np.rint(quality.SCALE * (rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + c)).astype(np.int64) for c in (0, 1)}
    model = quality.fit({c: (len(v), v.sum(axis=0).astype(float), (v.T @ v).astype(float)) for c, v in x.items()})
    every = np.concatenate((x[0], x[1])) / quality.SCALE
    unit = every.std(axis=0)
    density = []
    for c in (0, 1):
        own = x[c] / quality.SCALE
        cov = quality.shrunk(np.cov(own.T, bias=True) / np.outer(unit, unit), len(own))
        z = (every - own.mean(axis=0)) / unit
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(model.score(every), 1 / (1 + np.exp(density[0] - density[1])), atol=1e-9)
