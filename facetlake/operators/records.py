"""Run records: gates, registries, profiles and training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlake.operators.evaluate import percentiles

#: Default thresholds of promotion, in percent.
THRESHOLDS = {"mIoU": 85.0, "AP50": 90.0, "BFScore": 80.0}


def kpi_gate(records: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Records (with a map ``metrics``) and ``status``: promoted if no metric is below its threshold, a missing one being 0."""
    ok = F.lit(True)
    for key, least in thresholds.items():
        ok = ok & (F.coalesce(F.try_element_at("metrics", F.lit(key)), F.lit(0.0)) >= least)
    return records.withColumn("status", F.when(ok, "promoted").otherwise("rejected"))


def last_promoted(registry: DataFrame, keys: list[str]) -> DataFrame:
    """The latest promoted entry with a checkpoint, by ``seq``."""
    x = registry.where((F.col("status") == "promoted") & (F.length(F.coalesce("checkpoint", F.lit(""))) > 0))
    return x.groupBy(*keys).agg(F.max_by("checkpoint", "seq").alias("checkpoint"))


def profile_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation and the 50th and 95th percentile, interpolated."""
    p = percentiles(rows, keys, value, [0.5, 0.95]).withColumnsRenamed({"p0": "p50", "p1": "p95"})
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).join(p, keys)


def rolling_mean(log: DataFrame, window: int = 10) -> DataFrame:
    """Mean of the last ``window`` records of each run and key."""
    w = Window.partitionBy("run", "key").orderBy("iter").rowsBetween(1 - window, 0)
    return log.withColumn("smooth", F.avg("value").over(w))


def streaks(log: DataFrame, hit, least: int = 3) -> DataFrame:
    """``(run, first, last, length)`` of each longest stretch of consecutive records of a run that ``hit``, of at least ``least``."""
    w = Window.partitionBy("run").orderBy("iter")
    x = log.withColumn("hit", hit).withColumn("n", F.row_number().over(w)).where("hit")
    x = x.withColumn("island", F.col("n") - F.row_number().over(w))
    return x.groupBy("run", "island").agg(F.min("iter").alias("first"), F.max("iter").alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


def stalls(log: DataFrame, seconds: float) -> DataFrame:
    """``(run, since, until, gap)``: gaps between consecutive records of a run of more than so many seconds."""
    w = Window.partitionBy("run").orderBy("ts", "event_id")
    x = log.withColumn("since", F.lag("ts").over(w))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))
    return x.where(gap > seconds * 1e6).select("run", "since", F.col("ts").alias("until"), (gap / 1e6).alias("gap"))


def mark_best(log: DataFrame, keep: int = 3) -> DataFrame:
    """``best`` where a record's value is above all earlier ones of its run, ``kept`` for the last ``keep`` records."""
    w = Window.partitionBy("run").orderBy("iter")
    before = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("iter")))
    return log.withColumns({"best": F.coalesce(F.col("value") > before, F.lit(True)), "kept": back <= keep})


def canary(new: DataFrame, stable: DataFrame, keys: list[str], fall: float = 0.0) -> DataFrame:
    """``(keys, v_new, v_stable, delta, ok)`` of two metric tables, what only one has included."""
    x = new.withColumnRenamed("value", "v_new").join(stable.withColumnRenamed("value", "v_stable"), keys, "full_outer")
    x = x.withColumn("delta", F.col("v_new") - F.col("v_stable"))
    return x.withColumn("ok", F.coalesce(F.col("delta") >= -fall, F.lit(False)))


def canary_counts(new: DataFrame, stable: DataFrame, keys: list[str], change: float = 0.1) -> DataFrame:
    """As ``canary`` for numbers of outputs: rows of either table by key, ``ok`` where they differ by no more than a share of the stable number."""
    n = lambda t, name: t.groupBy(*keys).agg(F.count("*").alias(name))
    x = n(new, "v_new").join(n(stable, "v_stable"), keys, "full_outer").fillna(0, ["v_new", "v_stable"])
    x = x.withColumn("delta", F.col("v_new") - F.col("v_stable"))
    return x.withColumn("ok", F.abs("delta") <= change * F.col("v_stable"))
