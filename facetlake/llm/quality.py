"""Document quality by a regularised quadratic discriminant over transformed statistics of whole texts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.llm import shingles
from facetlake.storage import materialize

#: Statistics are whole multiples of 1 / SCALE, so that their sums do not depend on the order of tasks.
SCALE = 1 << 12
#: Least variance of a statistic beside its variance over all labelled documents.
RIDGE = 1e-2
STATISTICS = (
    "words", "word length", "longest word", "lines", "letters", "upper case", "digits", "stops", "calls", "symbols", "bars", "wordless", "ends of sentences",
    "repeats of the word before", "different words", "commonest word", "repeated pairs", "repeated lines", "entropy of bytes",
)


def _kinds() -> np.ndarray:
    """One row for each kind of byte, 256 flags each."""
    at = np.arange(256)
    chars = lambda s: np.isin(at, np.frombuffer(s, np.uint8))
    upper, lower, digit = (at >= 65) & (at <= 90), (at >= 97) & (at <= 122), (at >= 48) & (at <= 57)
    letter = upper | lower | (at >= 128)
    space, stop, call, bar = chars(b" \t\n\r\x0b\x0c"), chars(b".,;:'\"-()"), chars(b"!?"), chars(b"|")
    symbol = ~(letter | digit | space | stop | call | bar)
    return np.stack([letter, upper, digit, stop, call, symbol, bar, space])


_KINDS = _kinds().astype(np.int64)
#: Bytes that are neither of letters nor white space; bytes that end sentences.
_OTHERS = bytes(b for b in range(256) if not _KINDS[0, b] and not _KINDS[7, b])
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def statistics(text: bytes) -> np.ndarray:
    """Numbers of ``STATISTICS`` for a whole text, as whole multiples of 1 / SCALE; zeros of an empty one.

    Counts go through a logarithm and shares through a square root, which brings their spread within a
    class nearer to a normal one.
    """
    data = np.frombuffer(text, np.uint8)
    starts, ends = shingles.word_spans(data, _KINDS[7] == 0)
    n = len(starts)
    if not n:
        return np.zeros(len(STATISTICS), np.int64)
    counts = np.bincount(data, minlength=256)
    letter, upper, digit, stop, call, symbol, bar, space = _KINDS @ counts
    seen = len(text) - space
    _, word, times = np.unique(shingles.word_hashes(data, starts, ends), return_inverse=True, return_counts=True)
    pairs = len(np.unique(word[:-1] * len(times) + word[1:]))
    lines = [x for x in (line.strip() for line in text.split(b"\n")) if x]
    p = counts[counts > 0] / len(text)
    shares = (
        letter / seen, upper / max(1, letter), digit / seen, stop / seen, call / seen, symbol / seen, bar / seen,
        1 - len(text.translate(None, _OTHERS).split()) / n, _ENDS[data[ends - 1]].sum() / n, (word[1:] == word[:-1]).sum() / n, len(times) / n, times.max() / n,
        1 - pairs / max(1, n - 1), 1 - len(set(lines)) / max(1, len(lines)),
    )
    logs = (math.log1p(n), math.log(seen / n), math.log((ends - starts).max()), math.log1p(len(lines)))
    return np.rint(SCALE * np.array([*logs, *np.sqrt(np.maximum(shares, 0.0)), float(-(p * np.log2(p)).sum())])).astype(np.int64)


class Discriminant:
    """Two normal densities, each held as its mean, its inverse Cholesky factor and its log determinant."""

    def __init__(self, means: list[np.ndarray], factors: list[np.ndarray], log_dets: list[float], log_odds: float):
        self.means, self.factors, self.log_dets, self.log_odds = means, factors, log_dets, log_odds

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row of statistics."""
        if not self.means:
            return np.full(len(x), 1 / (1 + math.exp(-self.log_odds)))
        away = [np.square((x - m) @ f.T).sum(axis=1) + d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip((away[0] - away[1]) / 2 + self.log_odds, -40, 40)))


def shrunk(cov: np.ndarray, n: int) -> np.ndarray:
    """A covariance drawn to a multiple of the identity by the oracle approximating share, which needs only its size, its traces and ``n``."""
    d = len(cov)
    mean, square = np.trace(cov) / d, float((cov * cov).sum())
    apart = (n + 1 - 2 / d) * (square - d * mean * mean)
    share = 1.0 if apart <= 0 else min(1.0, ((1 - 2 / d) * square + (d * mean) ** 2) / apart)
    return (1 - share) * cov + (share * mean + RIDGE) * np.eye(d)


def fit(sums: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Discriminant:
    """The discriminant of ``{class: (rows, sums, sums of products)}`` in units of 1 / SCALE.

    One class alone, or none, gives every document one score: the classes' log odds, a row added to either.
    """
    n = {c: sums[c][0] if c in sums else 0 for c in (0, 1)}
    odds = math.log((n[1] + 1) / (n[0] + 1))
    if not n[0] or not n[1]:
        return Discriminant([], [], [], odds)
    mean = {c: sums[c][1] / (n[c] * SCALE) for c in n}
    cov = {c: sums[c][2] / (n[c] * SCALE * SCALE) - np.outer(mean[c], mean[c]) for c in n}
    middle = (n[0] * mean[0] + n[1] * mean[1]) / (n[0] + n[1])
    spread = sum(n[c] * (np.diag(cov[c]) + (mean[c] - middle) ** 2) for c in n) / (n[0] + n[1])
    unit = 1 / np.sqrt(np.where(spread > 1e-9, spread, 1.0))
    factors, log_dets = [], []
    for c in (0, 1):
        root = np.linalg.cholesky(shrunk(cov[c] * np.outer(unit, unit), n[c]))
        factors.append(np.linalg.inv(root) * unit[None, :])
        log_dets.append(2 * float(np.log(np.diag(root)).sum()))
    return Discriminant([mean[0], mean[1]], factors, log_dets, odds)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x)``: the statistics of each row's whole text; null texts are empty."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([statistics(t.as_py() or b"").tolist() for t in texts], pa.list_(pa.int32()))

    return docs.select(F.col(id_col).alias("doc_id"), each(F.col(text_col).cast("binary")).alias("x"))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """The discriminant of all labelled rows of ``document_statistics``.

    Every labelled row counts, none is sampled: tasks add up counts, sums and products of their rows, and
    Spark adds these up by class and place, so a few hundred sums are what comes to the driver. They are
    whole numbers, so reruns agree. Labels other than 0 and 1 and labels of null ids teach nothing; of
    several labels of one id the lowest holds; rows that repeat an id teach each.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    met = stats.join(known, "doc_id").select("label", "x")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, x = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), np.int64).reshape(b.num_rows, -1)
            rows = [(int(c), np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel())).tolist()) for c in np.unique(label) if len(own := x[label == c])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["label", "sums"])

    parts = met.mapInArrow(add, "label int, sums array<long>").select("label", F.posexplode("sums").alias("at", "sum"))
    total: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for r in parts.groupBy("label", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect():
        total[r["label"]][r["at"]] = int(r["sum"])
    d = len(STATISTICS)
    return fit({c: (t[0], np.array([t[k + 1] for k in range(d)], float), np.array([t[k + 1 + d] for k in range(d * d)], float).reshape(d, d)) for c, t in total.items() if t})


def scorer_of(spark: SparkSession, model: Discriminant) -> Callable[[Column], Column]:
    """A function of a column of statistics: the probability of class 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            rows = np.array(x.to_pylist(), float).reshape(len(x), -1) / SCALE
            yield pa.array(shared.value.score(rows), pa.float64())

    return each


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs``, learned from those that ``labels`` has.

    Texts are read once; their statistics, a few numbers each, are written down, learned from and scored.
    Null and blank texts have statistics of zero and are scored by them; null ids and repeated rows each
    have their row, equal texts equal scores; other columns have no part in it. Without labels of both
    classes every score is the same; an empty table gives an empty table.
    """
    stats = materialize(document_statistics(docs, id_col, text_col), "statistics")
    model = train(stats, labels.withColumnRenamed(id_col, "doc_id"), "doc_id", label_col)
    found = stats.select("doc_id", scorer_of(docs.sparkSession, model)(F.col("x")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
