"""Near-duplicates by Jaccard similarity of word shingles: SimHash and MinHash propose pairs, the whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.llm.simhash import majority, near_pairs, shingle_hashes
from facetlake.operators.components import connected_components
from facetlake.storage import materialize

#: A pair of similarity s meets with a chance of 1 - (1 - s ** ROWS) ** BANDS: 0.99993 at 0.8, more above.
BANDS, ROWS = 24, 5
#: Differing bits of SimHash fingerprints that propose a pair.
RADIUS = 2
#: Places that the marks of a set have, a multiple of 64.
MARKS = 2048
#: Shingles whose permuted values are held at a time.
BLOCK = 2048
_DRAWS = np.random.default_rng(20).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FLIP, _TIMES = _DRAWS[0], _DRAWS[1] | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set's MinHash values."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        x = (hashes[at : at + BLOCK, None] ^ _FLIP) * _TIMES
        np.minimum(low, x.min(axis=0), out=low)
    data = low.tobytes()
    return np.array([xxhash.xxh64_intdigest(data[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)], np.uint64).view(np.int64)


def _sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``(doc_id, text_hash, node, size, fp, keys)``; ``node`` is a 128-bit hash of the shingle set, so equal sets are one node."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x, shingle_words)) for x in b.column(2).to_pylist()]
            nodes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            fps = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), nodes, pa.array(map(len, sets), pa.int32()), fps, keys], ["doc_id", "text_hash", "node", "size", "fp", "keys"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(each, "doc_id long, text_hash long, node binary, size int, fp long, keys array<long>")


def _by_simhash(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes, each with its size, that the trie walk over their fingerprints links."""
    lead = materialize(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("lead")), "fingerprints")
    apart = near_pairs(lead.select("fp", F.col("fp").alias("rep")), radius)
    for side in ("a", "b"):
        apart = apart.join(lead.select(F.col("fp").alias(side), F.col("lead").alias(f"{side}_node")), side)
    same = nodes.join(lead, "fp").where(F.col("node") != F.col("lead.node")).select(F.col("lead").alias("a"), F.struct("node", "size").alias("b"))
    return same.unionByName(apart.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def _sets(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """``(node, hashes)``: the whole shingle sets of the nodes ``(node, doc_id, text_hash)``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x, shingle_words)).view(np.int64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    met = docs.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    return met.select("node", "text").mapInArrow(each, "node binary, hashes array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have a Jaccard similarity of at least ``least``."""
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a")
    x = x.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")
    x = x.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("both"), (F.size("of_a") + F.size("of_b")).alias("sum"))
    return x.where(F.col("both") / (F.col("sum") - F.col("both")) >= least).select("a", "b")


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with the component of their node as ``part``, of the keys that hold several parts."""
    part = connected_components(edges).withColumnRenamed("component", "part")
    rows = materialize(rows.drop("part").join(part, "node", "left").withColumn("part", F.coalesce("part", "node")), "parts")
    mixed = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    return materialize(rows.join(mixed, "key"), "open")


def marks(hashes: np.ndarray) -> tuple[list[int], list[int], int]:
    """A set as marks: the places of ``MARKS`` that its hashes fall on, those that two or more fall on, and how many hashes are beyond the second of their place."""
    n = np.bincount((hashes % MARKS).astype(np.int64), minlength=MARKS)
    bits = lambda least: np.packbits(n >= least, bitorder="little").view(np.int64).tolist()
    return bits(1), bits(2), int(np.maximum(n - 2, 0).sum())


@F.arrow_udf(T.StructType([T.StructField("once", T.ArrayType(T.LongType())), T.StructField("twice", T.ArrayType(T.LongType())), T.StructField("beyond", T.IntegerType())]))
def _marked(sets: pa.Array) -> pa.Array:
    found = [marks(np.array(x, np.int64).view(np.uint64)) for x in sets.to_pylist()]
    kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32())
    return pa.StructArray.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["once", "twice", "beyond"])


def most_common(x: str, y: str) -> Column:
    """No fewer than the hashes that two marked sets have in common: places that both have, places that both have twice, and what either has beyond."""
    both = [F.bit_count(F.col(f"{x}.marks.{c}")[i].bitwiseAND(F.col(f"{y}.marks.{c}")[i])) for c in ("once", "twice") for i in range(MARKS // 64)]
    return reduce(Column.__add__, both) + F.least(f"{x}.marks.beyond", f"{y}.marks.beyond")


def _shared(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``rows`` with how many shingles of their node another one of them has too and with the ``marks`` of these, without nodes of which these are too few.

    What no other node has is in no intersection, so a node with more than ``1 - least`` of such shingles
    is like none, however many it meets.
    """
    open_sets = sets.join(rows.select("node").distinct(), "node", "left_semi")
    tokens = open_sets.select("node", F.explode("hashes").alias("hash"))
    alone = tokens.groupBy("hash").agg(F.count("*").alias("n"), F.first("node").alias("node")).where("n = 1").groupBy("node").agg(F.collect_list("hash").alias("alone"))
    left = F.when(F.col("alone").isNull(), F.col("hashes")).otherwise(F.array_except("hashes", "alone"))
    about = open_sets.join(alone, "node", "left").select("node", left.alias("left"), F.size("hashes").alias("all")).where(F.size("left") >= least * F.col("all"))
    about = materialize(about.select("node", F.size("left").alias("shared"), _marked("left").alias("marks")), "marked")
    return materialize(rows.join(about, "node"), "shared")


def links(docs: DataFrame, nodes: DataFrame, least: float, shingle_words: int) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs that meet and are alike.

    Nodes meet by a SimHash fingerprint within ``RADIUS`` bits or in a MinHash band. First the pairs of
    the trie walk and each node of a band's group beside the group's smallest one are compared. Nodes
    that this puts into one component need no further comparison. Of the others, those go that share
    too little with any; then each meets the node of its groups that shares most of its shingles, which
    in a group of copies is the one nearest to their original; and only pairs that are still in
    different components, and may share enough by the marks of their sets, are compared one by one.
    """
    rows = materialize(nodes.select("node", "size", F.explode("keys").alias("key")), "bands")
    groups = materialize(rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("lead")).where("n > 1").drop("n"), "groups")
    rows = materialize(rows.join(groups, "key"), "meeting")
    close = lambda x, y: F.least(x, y) >= least * F.greatest(x, y)
    stars = rows.where(F.col("node") != F.col("lead.node")).select(F.col("lead").alias("a"), F.struct("node", "size").alias("b")).unionByName(_by_simhash(nodes, RADIUS))
    stars = materialize(stars.where(close(F.col("a.size"), F.col("b.size"))).select("a.node", F.col("b.node").alias("b")).toDF("a", "b").distinct(), "stars")
    met = rows.select("node").unionByName(stars.select(F.col("a").alias("node"))).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.join(met, "node", "left_semi").select("node", "best.doc_id", "best.text_hash")
    sets = materialize(_sets(docs, wanted, shingle_words), "sets")
    found = materialize(_alike(stars, sets, least), "links")

    def may(x: str, y: str):
        """Both in different parts, and what either shares at all is enough for the two sizes."""
        most = F.least(f"{x}.shared", f"{y}.shared")
        return (F.col(f"{x}.part") != F.col(f"{y}.part")) & ((1 + least) * most >= least * (F.col(f"{x}.size") + F.col(f"{y}.size")))

    rows = _shared(_labelled(rows.drop("lead"), found), sets, least)
    hubs = rows.groupBy("key").agg(F.max_by(F.struct("node", "size", "shared", "part"), F.struct(F.col("shared") / F.col("size"), "node")).alias("hub"))
    x = rows.alias("x").join(hubs.select("key", "hub.*").alias("y"), (F.col("x.key") == F.col("y.key")) & may("x", "y"))
    second = materialize(x.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct(), "hubs")
    found = materialize(found.unionByName(_alike(second, sets, least)), "links")
    rows = _labelled(rows, found).join(nodes.select("node", "keys"), "node")
    enough = (1 + least) * most_common("x", "y") >= least * (F.col("x.size") + F.col("y.size"))
    once = F.col("x.key") == F.array_min(F.array_intersect("x.keys", "y.keys"))  # a pair meets in several keys and is put out in the first of them
    x = rows.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & may("x", "y") & enough & once)
    across = x.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return found.unionByName(_alike(materialize(across.join(second, ["a", "b"], "left_anti"), "across"), sets, least))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each near-duplicate group does, all columns kept.

    Documents link when the sets of their ``shingle_words``-word shingles have a Jaccard similarity of
    at least ``least``; the smallest id of a component stays. Null and blank texts have the empty set
    and link with each other. Rows with a null id stay; different texts under one id are documents of
    their own; of equal rows one stays.
    """
    # a row's columns travel in one struct, so they may have any name
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).cast("binary").alias("text"), F.struct("*").alias("row"))
    plain = keyed.where("doc_id is not null").select("doc_id", "text_hash", "text")
    nodes = _sketches(plain, shingle_words).groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = materialize(nodes, "nodes")
    found = connected_components(links(plain, nodes, least, shingle_words))
    best = nodes.select("node", "best").join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("best").alias("best"))
    with_id = keyed.join(best.select("best.*"), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return with_id.select("row.*").unionByName(keyed.where("doc_id is null").select("row.*"))
