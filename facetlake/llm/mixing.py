"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.storage import materialize

#: Word characters are all but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of a key that make a bucket: 4,096 key ranges for each source.
BUCKET_DIGITS = 3


def source_targets(totals: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), total_factor: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Words to take from each source: ``(source, source_size, target)`` from ``(source, source_size)``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``total_factor`` of all
    words. A target stops at ``max_epochs`` times its source and what is above goes to the others by
    weight. That sharing has a level ``t`` with ``target = min(max_epochs * size, t * weight)``: with
    sources ordered by the level at which they fill up, taking the first ``k`` as full leaves the rest
    of the words to the rest of the weights. Each such level is at most ``t`` and the right ``k``
    gives ``t`` itself, so ``t`` is their maximum. The table has one row for each source, so its
    windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = totals.select("source", "source_size", w.alias("w")).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    x = x.withColumn("wanted", F.lit(total_factor) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    x = x.withColumn("level", F.col("wanted") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    t = F.max("level").over(whole)
    return x.select("source", "source_size", F.least("cap", t * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **targets) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row of ``docs``.

    Every source's rows are ordered by a hash key of their id and size. The key is uniform, so its leading
    digits cut a source into equal ranges: sums of the ranges give each range its offset, and a
    running sum inside the range gives each row its place. ``taken`` is the row's size for each
    epoch that the target holds in full, plus its part of the last epoch's exact budget. No task sees
    more than one key range of a source, however large the source. Rows equal in id, source and size
    are one row with a count until their places are known, so a hot id, or none, is no hot range.

    Null texts have size 0; a null source is a source of its own; repeated rows each have a place; an
    empty table gives an empty table; reruns agree.
    """
    return _placed(docs, id_col, text_col, source_col, seed, [], **targets)


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, more: list[Column], **targets) -> DataFrame:
    """``mix`` with the columns ``more`` of each row beside; they also order rows of one key."""
    names = docs.select(*more).columns
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *more)
    rows = rows.groupBy("doc_id", "source", "size", *names).agg(F.count("*").cast("int").alias("copies"))
    rows = rows.withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))))
    rows = materialize(rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)), "sizes")
    ranges = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("range_size"))
    ranges = materialize(ranges, "ranges")
    goal = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), **targets)
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(so_far), F.lit(0)))
    plan = plan.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.source", "bucket", "range_start", "source_size", "target")
    x = rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")))
    x = x.select("d.doc_id", "d.source", "d.size", "d.key", "d.bucket", "d.copies", "range_start", "source_size", "target", *[f"d.{c}" for c in names])
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size", *names).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("range_start") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    x = x.withColumns({"start": start, "epochs": epochs}).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    x = x.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("epochs") * F.col("source_size") - F.col("start")))
    return x.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *names)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **targets) -> DataFrame:
    """The mixture itself: each row once for every epoch that takes it whole, the columns of ``docs`` kept.

    The one document at which a source's budget ends comes with the words that the budget still holds,
    joined by single spaces. Documents without words are in no mixture. Rows that share an id, or have
    none, each have a share of their own: they are told apart by source and a hash of all columns, and
    rows equal in these share what they take in turn. Null texts are in no mixture; an empty table
    gives an empty table; extra columns may have any name.
    """
    mark = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in docs.columns])
    # a row's columns travel in one struct, so they may have any name
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), mark.alias("mark"), F.struct("*").alias("row"))
    taken = _placed(rows.drop("row"), "id", "text", "source", seed, [F.col("mark")], **targets).where("taken > 0")
    # Equal rows differ in what they take only where the budget ends: epochs in full add up, and one of them is cut.
    taken = taken.groupBy("doc_id", "source", "mark").agg(F.sum(F.floor(F.col("taken") / F.col("size"))).alias("whole"), F.max(F.pmod("taken", "size")).alias("rest"))
    x = rows.dropDuplicates(["id", "source", "mark"]).alias("r").join(taken.alias("t"), F.col("r.id").eqNullSafe(F.col("t.doc_id")) & F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.mark") == F.col("t.mark")))
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("whole").cast("int")), F.when(F.col("rest") > 0, F.array("rest")).otherwise(F.array().cast("array<bigint>")))
    x = x.select("row", "text", F.explode(copies).alias("part"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 0)
    cut = F.when(F.col("part") < 0, F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " "))
    return x.select(*[cut.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


#: DuckDB twin of ``mix`` over ``documents`` with the default parameters.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER full_up, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER full_up, 0)) AS level
      FROM c WINDOW full_up AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(cap, t * w) AS target FROM (SELECT *, max(level) OVER () AS t FROM l)),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM e
"""
