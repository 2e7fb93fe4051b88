"""Segmentation and instance metrics, hard-sample mining and error figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.operators import runs as R
from facetlake.operators.overlap import best_match
from facetlake.storage import materialize


def confusion(pred: DataFrame, gt: DataFrame, frames: DataFrame, keys: list[str], cells: int, classes: int) -> DataFrame:
    """Cells by true and predicted class over all samples: ``(gt, pred, cells)``, zero cells included.

    ``pred`` and ``gt`` are label runs with ``cls`` above 0 and not overlapping within a side; classes
    are clipped to ``classes - 1``. Background needs no runs: what overlaps leave of each side's
    class and of the frames is background on the other side.
    """
    top = lambda c: F.least(c, F.lit(classes - 1)).cast("int")
    n = F.col("x1") - F.col("x0")
    met = gt.alias("a").join(pred.alias("b"), R.same([*keys, "y"]) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")))
    both = met.groupBy(top(F.col("a.cls")).alias("gt"), top(F.col("b.cls")).alias("pred")).agg(F.sum(F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")).alias("cells"))
    left = gt.groupBy(top(F.col("cls")).alias("gt"), F.lit(0).alias("pred")).agg(F.sum(n).alias("cells")).unionByName(both.select("gt", F.lit(0).alias("pred"), (-F.col("cells")).alias("cells")))
    right = pred.groupBy(F.lit(0).alias("gt"), top(F.col("cls")).alias("pred")).agg(F.sum(n).alias("cells")).unionByName(both.select(F.lit(0).alias("gt"), "pred", (-F.col("cells")).alias("cells")))
    frame = frames.select(*keys).distinct().agg((F.count("*") * cells).alias("cells")).select(F.lit(0).alias("gt"), F.lit(0).alias("pred"), "cells")
    parts = both.unionByName(left).unionByName(right)
    rest = parts.select(F.lit(0).alias("gt"), F.lit(0).alias("pred"), (-F.col("cells")).alias("cells"))
    spark = pred.sparkSession
    none = spark.range(classes * classes).select((F.col("id") / classes).cast("int").alias("gt"), (F.col("id") % classes).cast("int").alias("pred"), F.lit(0).cast("long").alias("cells"))
    return parts.unionByName(frame).unionByName(rest).unionByName(none).groupBy("gt", "pred").agg(F.sum("cells").cast("long").alias("cells"))


def class_iou(matrix: DataFrame, classes: int) -> DataFrame:
    """``(cls, iou)`` from a confusion matrix: true positives over everything of the class on either side, 0 where there is none."""
    ids = matrix.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    each = matrix.select(F.explode(F.array_distinct(F.array("gt", "pred"))).alias("cls"), F.when(F.col("gt") == F.col("pred"), F.col("cells")).otherwise(0).alias("tp"), "cells")
    found = each.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("cells").alias("all"))
    return ids.join(found, "cls", "left").select("cls", F.when(F.col("all") > 0, F.col("tp") / F.col("all")).otherwise(0.0).alias("iou"))


def both_sides(pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of both in one table, ``__gt`` telling which, together by their keys: what is made of them needs no further shuffle."""
    own = lambda t, side: t.select(*keys, "y", "x0", "x1", F.lit(side).alias("__gt"))
    return own(pred, False).unionByName(own(gt, True)).repartition(*keys)


def _counted(runs: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Elementary intervals of each row of cells with the sum of each weight over the runs that cover them."""
    end = lambda at, sign: F.struct(F.col(at).cast("long").alias("x0"), *[(sign * w).alias(n) for n, w in sums.items()])
    ends = runs.select(*keys, "y", F.inline(F.array(end("x0", 1), end("x1", -1))))
    order = Window.partitionBy(*keys, "y").orderBy("x0")
    x = ends.withColumns({**{n: F.sum(n).over(order) for n in sums}, "__n": F.lead("x0").over(order) - F.col("x0")})
    return x.where("__n > 0")


def foreground_iou(pred: DataFrame, gt: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, roof_iou)`` of foreground runs, which may overlap, for every sample of ``frames``; 1 where both sides are empty."""
    return foreground_iou_of(both_sides(pred, gt, keys), frames, keys)


def foreground_iou_of(both: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """The same of runs of ``both_sides``: one sweep counts either side's runs over each interval."""
    x = _counted(both, keys, {"p": (~F.col("__gt")).cast("int"), "g": F.col("__gt").cast("int")})
    n = lambda on, name: F.sum(F.when(on, F.col("__n")).otherwise(0)).alias(name)
    p, g = F.col("p") > 0, F.col("g") > 0
    x = frames.select(*keys).join(x.groupBy(*keys).agg(n(p & g, "i"), n(p | g, "union")), keys, "left").fillna(0, ["i", "union"])
    return x.select(*keys, F.when(F.col("union") > 0, F.col("i") / F.col("union")).otherwise(1.0).alias("roof_iou"))


def boundary_f1(pred: DataFrame, gt: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int, tolerance: int = 1) -> DataFrame:
    """``(keys, precision, recall, f1)`` of boundaries: shares that lie within ``tolerance`` of the other side's; 1 where both are empty, 0 where one is."""
    return boundary_f1_of(both_sides(pred, gt, keys), frames, keys, height, width, tolerance)


def boundary_f1_of(both: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int, tolerance: int = 1) -> DataFrame:
    """The same of runs of ``both_sides``: one sweep counts either side's border and the surroundings of it over each interval."""
    edge = R.gradient(both, frames, [*keys, "__gt"], height, width)
    near = edge.withColumn("__d", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance)))).withColumn("y", F.col("y") + F.col("__d"))
    run = lambda x0, x1, own: F.struct(x0.cast("long").alias("x0"), x1.cast("long").alias("x1"), own.alias("__own"))
    near = near.select(*keys, "y", "__gt", F.inline(F.array(run(F.col("x0") - tolerance, F.col("x1") + tolerance, F.lit(False)), run(F.col("x0"), F.when(F.col("__d") == 0, F.col("x1")).otherwise(F.col("x0")), F.lit(True)))))
    of = lambda gt, own: ((F.col("__gt") == gt) & (F.col("__own") == own)).cast("int")
    x = _counted(near.where("x0 < x1"), keys, {"p": of(False, True), "g": of(True, True), "np": of(False, False), "ng": of(True, False)})
    n = lambda name, *on: F.sum(F.when(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in on]), F.col("__n")).otherwise(0)).alias(name)
    x = x.groupBy(*keys).agg(n("p", "p"), n("g", "g"), n("pg", "p", "ng"), n("gp", "g", "np"))
    x = frames.select(*keys).join(x, keys, "left").fillna(0, ["p", "g", "pg", "gp"])
    both = (F.col("p") == 0) & (F.col("g") == 0)
    precision = F.when(both, 1.0).when(F.col("p") > 0, F.col("pg") / F.col("p")).otherwise(0.0)
    recall = F.when(both, 1.0).when(F.col("g") > 0, F.col("gp") / F.col("g")).otherwise(0.0)
    x = x.select(*keys, precision.alias("precision"), recall.alias("recall"))
    total = F.col("precision") + F.col("recall")
    return x.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def hard_score(iou: Column, f1: Column) -> Column:
    return 0.5 * (1 - iou) + 0.5 * (1 - f1)


def instance_precision_recall(overlaps: DataFrame, pred: DataFrame, gt: DataFrame, samples: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """``(keys, n_pred, n_gt, tp, precision, recall)``.

    Every prediction only tries its own best match, so the true positives are the annotations that
    are the best match of some prediction at ``threshold`` or more; the order of scores plays no part.
    """
    tp = best_match(overlaps, keys).where(F.col("iou") >= threshold).groupBy(*keys).agg(F.countDistinct("b").alias("tp"))
    count = lambda t, name: t.groupBy(*keys).agg(F.countDistinct("inst").alias(name))
    x = samples.select(*keys).join(count(pred, "n_pred"), keys, "left").join(count(gt, "n_gt"), keys, "left").join(tp, keys, "left").fillna(0, ["n_pred", "n_gt", "tp"])
    p, g, t = F.col("n_pred"), F.col("n_gt"), F.col("tp")
    none = (p == 0) & (g == 0)
    precision = F.when(none, 1.0).when(p == 0, 0.0).otherwise(t / p)
    recall = F.when(none | (g == 0), 1.0).otherwise(t / g)
    return x.select(*keys, "n_pred", "n_gt", "tp", precision.alias("precision"), recall.alias("recall"))


def over_under(overlaps: DataFrame, pred: DataFrame, gt: DataFrame, samples: DataFrame, keys: list[str], threshold: float = 0.3) -> DataFrame:
    """``(keys, over, under, topology)``: shares of annotations cut by several predictions and of predictions over several annotations."""
    close = overlaps.where(F.col("iou") >= threshold)
    many = lambda side, name: close.groupBy(*keys, side).count().where("count > 1").groupBy(*keys).agg(F.count("*").alias(name))
    count = lambda t, name: t.groupBy(*keys).agg(F.countDistinct("inst").alias(name))
    x = samples.select(*keys)
    for t in (count(pred, "p"), count(gt, "g"), many("b", "o"), many("a", "u")):
        x = x.join(t, keys, "left")
    x = x.fillna(0, ["p", "g", "o", "u"])
    some = (F.col("p") > 0) & (F.col("g") > 0)
    x = x.select(*keys, F.when(some, F.col("o") / F.col("g")).otherwise(0.0).alias("over"), F.when(some, F.col("u") / F.col("p")).otherwise(0.0).alias("under"), some.alias("some"))
    return x.select(*keys, "over", "under", F.when(F.col("some"), F.greatest(F.lit(0.0), 1 - 0.5 * (F.col("over") + F.col("under")))).otherwise(0.0).alias("topology"))


def mine_hard(metrics: DataFrame, k: int, least: float | None = None, id_col: str = "sample_id") -> DataFrame:
    """The ``k`` hardest samples of at least ``least``, ties by id; all of them for ``k`` of 0 or less."""
    rows = metrics if least is None else metrics.where(F.col("hard_score") >= least)
    rows = rows.orderBy(F.desc("hard_score"), id_col)
    return rows.limit(k) if k > 0 else rows


def percentiles(values: DataFrame, keys: list[str], value: str, shares: list[float], ranges: int = 256) -> DataFrame:
    """``(keys, p0, p1, ...)``: exact percentiles, interpolated between neighbours, of one hot key as well as of many.

    Equal values count once, with their number. Approximate quantiles cut each key's values into ranges;
    the counts of the ranges say which of them hold the ranks that are asked for, and only inside those a
    window orders values. Nulls do not count; a key without a value has nulls.
    """
    x = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    cuts = values.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), [i / ranges for i in range(1, ranges)], 10 * ranges)).alias("__cuts"))
    x = materialize(x.join(cuts, keys).select(*keys, "__v", "__n", F.size(F.filter("__cuts", lambda c: c <= F.col("__v"))).alias("__range")), "values")
    size = x.groupBy(*keys, "__range").agg(F.sum("__n").alias("__size"))
    w = Window.partitionBy(*keys)
    up_to = F.sum("__size").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))
    size = size.withColumns({"__start": up_to - F.col("__size"), "__total": F.sum("__size").over(w)})
    at = lambda share: (F.col("__total") - 1) * F.lit(share)
    # A rank that stands between two ranges needs the last value of one and the first of the next.
    asked = [f(at(s)) for s in shares for f in (F.floor, F.ceil)]
    holds = F.exists(F.array(*asked), lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__size")))
    x = x.join(size.where(holds), [*keys, "__range"])
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("__at", F.col("__start") + before)
    pick = lambda rank: F.max(F.when((rank >= F.col("__at")) & (rank < F.col("__at") + F.col("__n")), F.col("__v")))
    found = x.groupBy(*keys, "__total").agg(*[pick(f(at(s))).alias(f"__{name}{i}") for i, s in enumerate(shares) for name, f in (("low", F.floor), ("high", F.ceil))])
    between = [(F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * (at(s) - F.floor(at(s)))).alias(f"p{i}") for i, s in enumerate(shares)]
    return cuts.select(*keys).join(found.select(*keys, *between), keys, "left")


def robust_outliers(values: DataFrame, keys: list[str], value: str, cut: float = 3.5) -> DataFrame:
    """Rows with ``deviation`` = |value - median| / (1.4826 MAD) and ``outlier`` where that is above ``cut``; medians of each key join back."""
    x = values.join(percentiles(values, keys, value, [0.5]).withColumnRenamed("p0", "__m"), keys)
    off = x.select(*keys, F.abs(F.col(value) - F.col("__m")).alias("__off"))
    spread = percentiles(off, keys, "__off", [0.5]).select(*keys, F.greatest("p0", F.lit(1e-6)).alias("__mad"))
    d = F.abs(F.col(value) - F.col("__m")) / (1.4826 * F.col("__mad"))
    return x.join(spread, keys).withColumn("deviation", d).withColumn("outlier", F.col("deviation") > cut).drop("__m", "__mad")


def dice(pairs: DataFrame, keys: list[str], p: str = "p", g: str = "g") -> DataFrame:
    """``(keys, dice)``: 1 less the overlap of two soft masks."""
    top = 2 * F.sum(F.col(p) * F.col(g))
    return pairs.groupBy(*keys).agg((1 - top / (F.sum(F.col(p) * F.col(p)) + F.sum(F.col(g) * F.col(g)) + 1e-6)).alias("dice"))


def bce(logit: Column, target: Column) -> Column:
    """Binary cross-entropy of a logit in its stable form."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def no_object_weights(classes: int, no_object: float = 0.1) -> list[float]:
    """Class weights of query classification: 1 for each class and a small one for the last, which says that there is no object."""
    return [1.0] * classes + [no_object]


def mixed_mask_loss(cells: DataFrame, keys: list[str], logit: str, target: str, order: str, share: float = 0.5) -> DataFrame:
    """``(keys, loss)``: ``share`` of the mean binary cross-entropy of a mask and the rest of its Lovasz hinge."""
    own = cells.groupBy(*keys).agg(weighted_reduce(bce(F.col(logit), F.col(target))).alias("bce"))
    hinge = lovasz_hinge(cells, keys, logit, target, order).withColumnRenamed("loss", "hinge")
    return own.join(hinge, keys).select(*keys, (share * F.col("bce") + (1 - share) * F.col("hinge")).alias("loss"))


def cross_entropy(scores: DataFrame, keys: list[str], cls: str = "cls", logit: str = "logit", target: str = "target", weight: str = "weight", ignore: int = -100) -> DataFrame:
    """One row: class-weighted cross-entropy; ignored rows give 0 but stay in the denominator, which counts rows and not weights."""
    top = scores.groupBy(*keys).agg(F.max(logit).alias("__m"), F.first(target).alias("__t"))
    x = scores.join(top, keys)
    row = x.groupBy(*keys).agg((F.first("__m") + F.log(F.sum(F.exp(F.col(logit) - F.col("__m"))))).alias("lse"), F.first("__t").alias("t"), F.max(F.when(F.col(cls) == F.col("__t"), F.col(logit))).alias("v"), F.max(F.when(F.col(cls) == F.col("__t"), F.col(weight))).alias("w"))
    return row.agg(F.avg(F.when(F.col("t") == ignore, 0.0).otherwise(F.col("w") * (F.col("lse") - F.col("v")))).alias("loss"))


def sigmoid_cross_entropy(scores: DataFrame, keys: list[str], cls: str = "cls", logit: str = "logit", target: str = "target", positive_weight: str | None = None, weight: str | None = None, mode: str = "mean") -> DataFrame:
    """Binary cross-entropy of every class's logit against a row's one true class, meaned over classes: one row, or ``(keys, loss)`` for the mode ``none``.

    ``positive_weight`` is a class's weight where it is the true one, ``weight`` a row's own. A target that
    is no class makes a row of zeros; no row is ignored.
    """
    x, t = F.col(logit), (F.col(cls).eqNullSafe(F.col(target))).cast("double")
    more = F.lit(1.0) if positive_weight is None else 1 + (F.col(positive_weight) - 1) * t
    loss = (1 - t) * x + more * (F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0)))
    row = scores.groupBy(*keys).agg(F.avg(loss).alias("loss"), (F.lit(1.0) if weight is None else F.first(weight)).alias("w"))
    value = weighted_reduce(F.col("loss"), F.col("w"), mode)
    return row.select(*keys, value.alias("loss")) if mode == "none" else row.agg(value.alias("loss"))


def lovasz_hinge(cells: DataFrame, keys: list[str], logit: str, target: str, order: str) -> DataFrame:
    """``(keys, loss)``: errors in falling order weighted by the growth of the Jaccard loss. Ties go by ``order``.

    Cells are cut into ranges of their key, error and order. A mask's counts of cells and of positives up
    to each range are sums over its ranges, and the running sums go on from there inside a range, so one
    mask of any size is many tasks.
    """
    sign = 2 * F.col(target) - 1
    x = cells.select(*keys, (1 - F.col(logit) * sign).alias("err"), F.col(target).cast("double").alias("t"), F.col(order).alias("o"))
    x = materialize(x.repartitionByRange(*[F.col(k) for k in keys], F.desc("err"), F.asc("o")).withColumn("range", F.spark_partition_id()), "errors")
    every, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy(*keys, "range").agg(F.count("*").alias("n"), F.sum("t").alias("p"))
    sums = sums.select(*keys, "range", F.sum("p").over(every).alias("total"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "p")])
    inside = Window.partitionBy(*keys, "range").orderBy(F.desc("err"), "o")
    x = x.join(sums, [*keys, "range"]).withColumns({"rank": F.col("n_before") + F.row_number().over(inside), "seen": F.col("p_before") + F.sum("t").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    jaccard = lambda rank, seen: 1 - (F.col("total") - seen) / (F.col("total") + rank - seen)
    last = F.when(F.col("rank") > 1, jaccard(F.col("rank") - 1, F.col("seen") - F.col("t"))).otherwise(0.0)
    return x.groupBy(*keys).agg(F.sum(F.greatest(F.col("err"), F.lit(0.0)) * (jaccard(F.col("rank"), F.col("seen")) - last)).alias("loss"))


def weighted_reduce(value: Column, weight: Column | None = None, mode: str = "mean", denominator: Column | None = None) -> Column:
    """An aggregate: weighted sum, or mean over a denominator (the number of rows if none), floored; or, for ``none``, the weighted value of each row."""
    x = value if weight is None else value * weight
    if mode == "none":
        return x
    if mode == "sum":
        return F.sum(x)
    if mode == "mean":
        return F.sum(x) / F.greatest(F.count("*").cast("double") if denominator is None else denominator, F.lit(1e-12))
    raise ValueError(f"no such reduction: {mode}")
