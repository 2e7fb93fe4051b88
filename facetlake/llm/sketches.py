"""Document fingerprints: the k smallest distinct hashes of a text's word shingles."""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.llm import shingles

#: Words are all but ASCII white space.
IS_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Hashes that a sketch keeps.
K = 128
SHINGLE_WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def sketch(text: bytes, k: int = K, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The ``k`` smallest distinct shingle hashes, ascending; all of them where they are fewer; none of a text without words."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    h = shingles.rolling(shingles.word_hashes(data, *shingles.word_spans(data, IS_WORD)), shingle_words)
    if len(h) > 4 * k:
        low = np.unique(h[h <= np.partition(h, 2 * k)[2 * k]])
        if len(low) >= k:
            return low[:k]
    return np.unique(h)[:k]


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of what the parts were made of."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.empty(0, np.uint64)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles in all shingles of either; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge([a, b], k)
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has too; 1 for an empty ``a``."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_count(merge([a, b], k), k)
    return min(1.0, both / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, sketch, n_shingles)`` for every row: the sketch as text and the estimated number of distinct shingles.

    Null texts count as empty and have an empty sketch. ``merge_sketches`` joins sketches of parts.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketch(x or b"", k, shingle_words) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(to_text, found), pa.string()), pa.array([distinct_count(x, k) for x in found])], ["doc_id", "sketch", "n_shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, sketch string, n_shingles double")


def merge_sketches(sketches: DataFrame, group_col: str, k: int = K) -> DataFrame:
    """``(group, sketch)`` of all parts of a group: of the distinct union of their hashes the k smallest stay, all in Spark.

    Hashes are kept as hexadecimal text, whose order is theirs. Distinct hashes spread over all tasks,
    each task passes on its k smallest of a group, and only these meet, so no group is gathered whole.
    A null group is a group; null and empty sketches add nothing, and a group of these alone has the
    empty sketch; an empty table gives an empty table.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pa.array([[f"{x:016x}" for x in from_text(s or "").tolist()] for s in b.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["grp", "hashes"])

    kind = sketches.schema[group_col].dataType.simpleString()
    rows = sketches.select(F.col(group_col).alias("grp"), "sketch").mapInArrow(spread, f"grp {kind}, hashes array<string>")
    single = rows.select("grp", F.explode_outer("hashes").alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("h").asc_nulls_last()))
    low = single.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("grp").agg(F.array_sort(F.collect_list("h")).alias("low"))
    return low.select(F.col("grp").alias(group_col), F.base64(F.unhex(F.array_join("low", ""))).alias("sketch"))


#: Most cuts between buckets; beyond them buckets grow, which streaming through them allows.
MOST_BUCKETS = 16_384
_SPAN = (1 << 63) - 1
_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained double, n_shingles double"


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_chars: int = 4_000_000, k: int = K, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Each text against its edit, whose last quarter gives way to the start of the next document.

    Returns ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained, n_shingles)``. The next document is the one with the next doc_id, after the last one
    the first; rows that repeat an id follow each other by a hash of the text, null ids come first, null
    texts are empty; an empty table gives an empty table.

    Neighbours meet without one sort of everything: doc_id quantiles, from ids and lengths alone, cut
    the table into buckets of about ``bucket_chars`` characters, an id (or null) that fills more is cut
    by its texts' hashes, and a bucket's first document goes to the bucket before it as well. Every text
    crosses the network once, and a task streams through its sorted buckets holding two texts at a time.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("hash"))
    total, known = rows.agg(F.sum(F.length("text")), F.count("doc_id")).first()
    buckets = min(MOST_BUCKETS, max(1, int((total or 0) // bucket_chars)))
    marks = sorted(int(x) for x in rows.stat.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.1 / buckets)) if buckets > 1 and known else []
    cuts = sorted({*marks, *(a + 1 for a, b in itertools.pairwise(marks) if a == b)})  # an id that holds two quantiles stands alone
    keyed = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_place(cuts, "doc_id")))
    # One row a bucket comes to the driver, twice MOST_BUCKETS at most: its size if all its ids are one.
    spark = docs.sparkSession
    sizes = keyed.groupBy("bucket").agg(F.sum(F.length("text")), F.min("doc_id").eqNullSafe(F.max("doc_id"))).collect()
    if not sizes:
        return spark.createDataFrame([], _EDITED)
    parts = [(b, min(_SPAN, _SPAN // min(MOST_BUCKETS, max(1, int(chars // bucket_chars))) + 1) if one else _SPAN) for b, chars, one in sizes]
    keyed = keyed.join(F.broadcast(spark.createDataFrame(parts, "bucket int, step long")), "bucket").withColumn("part", F.expr(f"if(step = {_SPAN}, 0, cast(hash div step AS int))")).drop("step")
    # And one row a part: its first row.
    first = keyed.groupBy("bucket", "part").agg(F.min(F.struct("doc_id", "hash")).alias("low")).orderBy("bucket", "part").collect()
    heads = [(r.bucket, r.part, r.low.doc_id, r.low.hash, *first[i - 1][:2]) for i, r in enumerate(first)]
    heads = spark.createDataFrame(heads, "bucket int, part int, head long, low long, to int, to_part int")
    extra = keyed.join(F.broadcast(heads), ["bucket", "part"]).where(F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("hash") == F.col("low")))
    extra = extra.groupBy("to", "to_part").agg(F.min("text").alias("text")).select(F.col("to").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("hash"), F.col("to_part").alias("part"), F.lit(True).alias("extra"))
    met = keyed.withColumn("extra", F.lit(False)).unionByName(extra).repartition("bucket", "part")
    met = met.sortWithinPartitions("bucket", "part", "extra", F.col("doc_id").asc_nulls_first(), "hash", "text")
    schema = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.simpleString()]) for f in T.StructType.fromDDL(_EDITED)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for doc_id, text, bucket, part, extra in zip(*(c.to_pylist() for c in b.select(["doc_id", "text", "bucket", "part", "extra"]).columns), strict=True):
                mine = sketch(_utf8(text), k, shingle_words)
                if held is not None and held[2] == (bucket, part):
                    was, before = held[1], held[3]
                    cut = len(was) // 4
                    edited = _utf8(was[: len(was) - cut] + text[:cut])
                    theirs = sketch(edited, k, shingle_words)
                    out.append((held[0], len(was), hashlib.sha256(edited).hexdigest(), to_text(before), to_text(theirs), resemblance(before, theirs, k), resemblance(before, mine, k), containment(before, theirs, k), distinct_count(before, k)))
                held = None if extra else (doc_id, text, (bucket, part), mine)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return met.mapInArrow(each, _EDITED)


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _place(cuts: list[int], column: str):
    """Number of cuts at or below a column, as a search through nested conditions: its depth grows with the logarithm of the cuts."""

    def among(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) < cuts[mid], among(lo, mid)).otherwise(among(mid + 1, hi))

    return among(0, len(cuts))
