"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from facetlake.storage import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected graph with the smallest node it can reach.

    Alternates two star operations until nothing changes: *large-star* hangs the larger neighbours of
    a node below its smallest one, *small-star* does so with the smaller neighbours. Each round is two
    aggregations and two equi-joins, so hubs are pre-aggregated and AQE may split them; the round
    count grows with the logarithm of the longest chain. Each round's edges are written to the shared
    folder, which keeps lineage short and survives lost executors.

    Returns ``(node, component)`` for the nodes that have an edge to another node; null ends and
    self-loops are ignored, an empty table gives an empty table.
    """
    x, y = F.col(a), F.col(b)
    stars, before = _kept(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    for _ in range(max_rounds if before["n"] else 0):
        stars, now = _kept(_small_star(_large_star(stars)))
        if now == before:
            break
        before = now
    else:
        if before["n"]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _kept(stars: DataFrame) -> tuple[DataFrame, dict]:
    """The edges written down, with their number and a sum of their hashes, observed while they are written."""
    seen = Observation()
    marks = stars.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("sum"))
    return materialize(marks, "edges"), seen.get


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    down = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return down.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
