"""Overlap of instances in cells: the join that evaluation and merging read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.operators.runs import same
from facetlake.storage import materialize

#: Side of the grid cells in which boxes meet.
GRID = 32


def instance_stats(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Area, box (ends exclusive) and centroid of each instance."""
    n = F.col("x1") - F.col("x0")
    area = F.sum(n)
    return runs.groupBy(*keys).agg(
        area.cast("long").alias("area"), F.min("x0").alias("bx0"), F.min("y").alias("by0"), F.max("x1").alias("bx1"), (F.max("y") + 1).alias("by1"),
        (F.sum((F.col("x0") + F.col("x1") - 1) * n / 2) / area).alias("cx"), (F.sum(F.col("y") * n) / area).alias("cy"),
    )


def instance_overlap(a: DataFrame, b: DataFrame, keys: list[str], id_col: str = "inst", between: Column | None = None, least: float = 0.0) -> DataFrame:
    """Pairs that share cells: ``(keys, a, b, inter, union, iou)``.

    Each instance is one row with its box and its runs. Boxes meet by key and grid cell and reject the
    pairs that are apart; the pairs left get either side's runs by one join each and are intersected
    inside their row. Runs of one instance are disjoint, so the overlaps of a pair add up to its
    intersection. ``between`` is a condition on ``a.{id_col}`` and ``b.{id_col}``. Pairs without a common
    cell do not appear: their IoU is 0. Nor do pairs whose boxes and areas already say that their IoU is
    below ``least``, so only what may reach it gets its runs; other pairs below it do appear.
    """
    box = {"a": _instances(a, keys, id_col)}
    box["b"] = box["a"] if b is a else _instances(b, keys, id_col)
    # Each pair of boxes once, in the grid cell where their common part begins.
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / GRID), F.floor(F.col(high) / GRID)))
    # What Parquet takes for boxes and runs says little about their size in memory, so neither side is broadcast.
    grid = {side: t.drop("runs").withColumn("gx", cells("bx0", "bx1")).withColumn("gy", cells("by0", "by1")).hint("merge") for side, t in box.items()}
    on = same([*keys, "gx", "gy"]) & (F.col("a.bx0") < F.col("b.bx1")) & (F.col("b.bx0") < F.col("a.bx1")) & (F.col("a.by0") <= F.col("b.by1")) & (F.col("b.by0") <= F.col("a.by1"))
    on = on & (F.floor(F.greatest("a.bx0", "b.bx0") / GRID) == F.col("a.gx")) & (F.floor(F.greatest("a.by0", "b.by0") / GRID) == F.col("a.gy"))
    if least > 0:
        side = lambda low, high, more: F.least(f"a.{high}", f"b.{high}") - F.greatest(f"a.{low}", f"b.{low}") + more
        most = F.least("a.area", "b.area", side("bx0", "bx1", 0) * side("by0", "by1", 1))
        on = on & (most / (F.col("a.area") + F.col("b.area") - most) >= least)
    pairs = grid["a"].alias("a").join(grid["b"].alias("b"), on if between is None else on & between)
    pairs = pairs.select(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{id_col}").alias("a"), F.col(f"b.{id_col}").alias("b"), F.col("a.area").alias("area_a"), F.col("b.area").alias("area_b"))
    for side, t in box.items():
        pairs = pairs.join(t.select(*keys, F.col(id_col).alias(side), F.col("runs").alias(f"runs_{side}")).hint("merge"), [*keys, side])
    met = pairs.select(*keys, "a", "b", "area_a", "area_b", common_cells("runs_a", "runs_b").alias("inter")).where("inter > 0")
    union = (F.col("area_a") + F.col("area_b") - F.col("inter")).alias("union")
    return met.select(*keys, "a", "b", "inter", union).withColumn("iou", F.col("inter") / F.col("union"))


def _instances(runs: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """``(keys, id, area, bx0, bx1, by0, by1, runs)``, written down once: boxes are read without the runs."""
    area = F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area")
    box = [F.min("x0").alias("bx0"), F.max("x1").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1")]
    own = F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")]))).alias("runs")
    return materialize(runs.groupBy(*keys, id_col).agg(area, *box, own), "instances")


@F.arrow_udf(T.LongType())
def common_cells(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cells that two sorted arrays of disjoint runs share, for a batch of pairs at once."""
    return pa.array(shared_cells(a, b))


def shared_cells(a: pa.Array, b: pa.Array, dy: int = 0, dx: int = 0) -> np.ndarray:
    """Cells that two sorted arrays of disjoint runs share, for many pairs at once; ``b`` may be moved by ``dy`` and ``dx``.

    Rows of all pairs are put on one line, one after the other. Then the cells of ``b`` before a place
    are a sum over the runs before it and a part of one, and a run of ``a`` holds the difference at its
    two ends.
    """
    own, places = [pc.list_parent_indices(x).to_numpy() for x in (a, b)], [x.flatten() for x in (a, b)]
    y, x0, x1 = ([np.asarray(x.field(c)) for x in places] for c in range(3))
    if not len(own[0]) or not len(own[1]):
        return np.zeros(len(a), np.int64)
    y[1], x0[1], x1[1] = y[1] + dy, x0[1] + dx, x1[1] + dx
    low, high = min(map(np.min, y)), max(map(np.max, y))
    left, right = min(map(np.min, x0)), max(map(np.max, x1))
    line = np.unique(np.concatenate([o * (high - low + 1) + v - low for o, v in zip(own, y, strict=True)]), return_inverse=True)[1] * (right - left + 1) - left
    begin, end = np.split(line + np.concatenate(x0), [len(own[0])]), np.split(line + np.concatenate(x1), [len(own[0])])
    before = np.concatenate(([0], np.cumsum(end[1] - begin[1])))

    def cells(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(begin[1], at, "right") - 1
        return np.where(k < 0, 0, before[k] + np.minimum(at, end[1][k]) - begin[1][k])

    return np.rint(np.bincount(own[0], cells(end[0]) - cells(begin[0]), len(a))).astype(np.int64)


def best_match(overlaps: DataFrame, keys: list[str]) -> DataFrame:
    """For each ``a`` the ``b`` with the largest IoU, the smallest id on ties."""
    best = F.max_by(F.struct("b", "iou"), F.struct(F.col("iou"), -F.col("b")))
    return overlaps.groupBy(*keys, "a").agg(best.alias("m")).select(*keys, "a", F.col("m.b").alias("b"), F.col("m.iou").alias("iou"))
