"""SimHash near-duplicates: 64-bit fingerprints of word shingles, joined by a walk over node pairs of a binary trie."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.operators.components import connected_components
from facetlake.storage import materialize

#: Shingle hashes that are unpacked to bits at a time.
BLOCK = 1 << 16
#: Bounds the links that one walk may find, and so its memory.
PAIR_BUDGET = 4_000_000


def shingle_hashes(text: bytes | None, shingle_words: int = 3, seed: int = 42) -> np.ndarray:
    """Hash of every ``shingle_words`` consecutive words of a UTF-8 text; of all words where they are fewer; none of no words."""
    words = (text or b"").lower().split()
    h = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) < shingle_words:
        return np.array([h(line, seed)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle_words + 1
    spans = zip(starts[:n].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)
    return np.fromiter((h(line[s:e], seed) for s, e in spans), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned fingerprint."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a UTF-8 text; zero if it has no words."""
    return majority(shingle_hashes(text, shingle_words, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row, ``fp`` being the fingerprint's bits as a signed long.

    Null and blank texts have fingerprint zero; null ids stay null; repeated rows each have a row; an
    empty table gives an empty table.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x, shingle_words) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, fp long")


def trie_links(groups: np.ndarray, fps: np.ndarray, radius: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints in one group that differ in at most ``radius`` bits.

    ``groups`` holds the first row of each group and the row count at its end; within a group ``fps``
    are distinct and ascending, so a trie node is a range of rows. All node pairs of a level advance
    together: a pair splits into its children's pairs, unequal branches add a differing bit, and a
    pair goes as soon as it has more than ``radius`` of them or one side is empty.
    """
    lo, hi = groups[:-1], groups[1:]
    some = hi - lo > 1
    a0, a1 = lo[some], hi[some]
    b0, b1, diff = a0.copy(), a1.copy(), np.zeros(len(a0), np.int8)
    for bit in range(63, -1, -1):
        if not len(a0):
            break
        zeros = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1) == 0)))
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        own = a0 == b0  # a node with itself: its two children meet once only
        rest = ~own
        a_lo = np.concatenate((a0, am, a0, am[rest]))
        a_hi = np.concatenate((am, a1, am, a1[rest]))
        b_lo = np.concatenate((b0, bm, bm, b0[rest]))
        b_hi = np.concatenate((bm, b1, b1, bm[rest]))
        d = np.concatenate((diff, diff, diff + 1, diff[rest] + 1))
        keep = (a_lo < a_hi) & (b_lo < b_hi) & (d <= radius) & ~((a_lo == b_lo) & (a_hi - a_lo < 2))
        a0, a1, b0, b1, diff = a_lo[keep], a_hi[keep], b_lo[keep], b_hi[keep], d[keep]
    return a0, b0


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` items reaches over the links ``(i, j)``."""
    root = np.arange(n)
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(step := root[root], root):
            root = step
    return root


def _walk(radius: int):
    """Rows ``(key, fp, rep)`` sorted by key and fp, to star edges ``(a, b)`` between representatives."""

    def stars(fps: np.ndarray, keys: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        i, j = trie_links(first, fps, radius)
        root = local_roots(len(fps), i, j)
        moved = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(reps[moved]), pa.array(reps[root[moved]])], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def slabs(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            keys, fps, reps = (np.concatenate(x) for x in zip(*held, strict=True))
            edge = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            if not last:  # the last group may go on in the next batch
                edge = edge[:-1]
            size = np.diff(edge)
            spent = np.cumsum(size * np.minimum(size, 2081))
            at = 0
            while at < len(size):
                to = max(at + 1, int(np.searchsorted(spent, (spent[at - 1] if at else 0) + PAIR_BUDGET, "right")))
                s = slice(edge[at], edge[to])
                yield stars(fps[s], keys[s], reps[s])
                at = to
            done = int(edge[-1])
            held = [(keys[done:], fps[done:], reps[done:])] if done < len(keys) else []

        for b in batches:
            keys, fps, reps = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            held.append((keys, fps.view(np.uint64), reps))
            yield from slabs(False)
        yield from slabs(True)

    return each


def _split(rows: DataFrame, radius: int) -> DataFrame:
    """A row for each way to fix some blocks of the bits that are left: the key grows by them, the others stay free.

    With one block more than ``radius`` (two more beyond a radius of 2) differing bits spoil at most
    ``radius`` blocks, so any two fingerprints within the radius agree on the rest and meet there.
    """
    blocks = radius + (1 if radius <= 2 else 2)
    ways = [list(c)[::-1] for c in itertools.combinations(range(blocks), blocks - radius)]  # higher blocks first: taking one out leaves lower ones where they are
    x = rows.withColumn("way", F.explode(F.array(*[F.array(*map(F.lit, w)) for w in ways]))).withColumn("whole", F.col("width"))
    shift = lambda f, c, n: F.call_function(f, c, n)
    ones = lambda n: shift("shiftleft", F.lit(1).cast("long"), n) - F.lit(1)
    for k in range(blocks - radius):
        block = F.element_at("way", k + 1)
        x = x.withColumns({"at": F.floor(F.col("whole") * block / blocks).cast("int"), "to": F.floor(F.col("whole") * (block + 1) / blocks).cast("int")})
        value = shift("shiftrightunsigned", F.col("rest"), F.col("at")).bitwiseAND(ones(F.col("to") - F.col("at")))
        above = F.when(F.col("to") < F.col("width"), shift("shiftleft", shift("shiftrightunsigned", F.col("rest"), F.col("to")), F.col("at"))).otherwise(F.lit(0).cast("long"))
        rest = above.bitwiseOR(F.col("rest").bitwiseAND(ones(F.col("at"))))
        x = x.withColumns({"key": F.xxhash64("key", block, value), "rest": rest, "width": F.col("width") - (F.col("to") - F.col("at"))})
    return x.select("key", "fp", "rep", "rest", "width")


def near_pairs(distinct: DataFrame, radius: int = 2, max_group: int = 2048, levels: int = 12) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all links between fingerprints.

    ``distinct`` has each fingerprint once as ``(fp, rep)``. Fingerprints meet in groups that agree on
    some blocks of their bits; groups above ``max_group`` are dealt again by blocks of the bits left,
    and so on until the bits that stay free allow no larger group; nothing is dropped. A level runs only
    if the one before it left such a group. Within a group the trie walk finds every link and only a spanning star of each local component
    leaves the task. Rows for each fingerprint: 3 at a radius of 2, 28 at a radius of 6.
    """
    rows = _split(distinct.select(F.lit(0).cast("long").alias("key"), "fp", "rep", F.col("fp").alias("rest"), F.lit(64).alias("width")), radius)
    found = None
    for level in range(levels):
        rows = materialize(rows, "blocks")
        size = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sized = rows.join(size, "key")
        last = level == levels - 1
        ready = sized if last else sized.where(F.col("n") <= max_group)
        edges = ready.select("key", "fp", "rep").repartition("key").sortWithinPartitions("key", _unsigned("fp")).mapInArrow(_walk(radius), "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        hot = sized.where(F.col("n") > max_group)
        if last or size.where(F.col("n") > max_group).isEmpty():
            break
        rows = _split(hot.drop("n"), radius)
    return found.distinct()


def _unsigned(name: str) -> Column:
    """Sorts a signed long as the unsigned bits it stands for."""
    return F.col(name).bitwiseXOR(F.lit(-(1 << 63)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id, kept)`` for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    smallest doc_id that links reach and ``kept`` marks the row that carries it. Null and blank texts
    have fingerprint zero and link like any other; rows with a null id get a null component of their
    own and are kept; repeated rows fall into one component; an empty table gives an empty table.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = materialize(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    groups = connected_components(near_pairs(distinct, radius))
    label = distinct.join(groups, distinct.rep == groups.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    known = rows.where("doc_id is not null").join(label, "fp").select("doc_id", "fp", "component")
    lost = rows.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component"))
    return known.unionByName(lost).select("doc_id", "fp", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each near-duplicate group does, all columns kept.

    Rows with a null id stay. Different texts under one id are documents of their own and stay or go by
    their own fingerprints; of rows that share the kept id and fingerprint the one with the first text stays.
    """
    words = options.get("shingle_words", 3)

    @F.arrow_udf("long")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(x, words) for x in texts.to_pylist()], np.uint64).view(np.int64))

    kept = near_duplicates(docs, id_col, text_col, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp")).distinct()
    rows = docs.where(F.col(id_col).isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    met = rows.join(kept.select("__id").distinct(), "__id", "left_semi").withColumn("__fp", fp(F.col("__text").cast("binary"))).join(kept, ["__id", "__fp"], "left_semi")
    with_id = met.groupBy("__id", "__fp").agg(F.min_by("__row", F.coalesce("__text", F.lit(""))).alias("__row")).select("__row.*")
    return with_id.unionByName(docs.where(F.col(id_col).isNull()))
