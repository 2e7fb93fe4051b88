"""Detected instances: calibration, gating, tiles, merging, fusion and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.operators import groups as J
from facetlake.operators import runs as R
from facetlake.operators.components import connected_components
from facetlake.operators.overlap import instance_overlap
from facetlake.storage import materialize

#: Score thresholds by class; others use the global one.
CLASS_THRESHOLD = {1: 0.35, 2: 0.45}


def calibrate(p: Column, temperature: float) -> Column:
    """Temperature scaling of a probability."""
    t = max(temperature, 1e-6)
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.least(F.greatest(1 / (1 + F.exp(-F.log(q / (1 - q)) / t)), F.lit(0.0)), F.lit(1.0))


def quality_gate(instances: DataFrame, score: Column, least_score: float = 0.35, class_threshold: dict[int, float] = CLASS_THRESHOLD, least_area: int = 100, least_density: float = 0.02, keep_background: bool = False) -> DataFrame:
    """Instances (with ``label``, ``area`` and box) that are foreground, sure, large and dense enough."""
    own = F.lit(least_score)
    for label, t in class_threshold.items():
        own = F.when(F.col("label") == label, F.greatest(F.lit(least_score), F.lit(t))).otherwise(own)
    box = F.greatest((F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")), F.lit(1))
    kept = (score >= own) & (F.col("area") >= least_area) & (F.col("area") / box >= least_density)
    return instances.where(kept if keep_background else kept & (F.col("label") > 0))


def to_scene(items: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Runs in tile coordinates moved by their tile's ``x_off, y_off``."""
    x = items.join(tiles, keys)
    moved = {"y": F.col("y") + F.col("y_off"), "x0": F.col("x0") + F.col("x_off"), "x1": F.col("x1") + F.col("x_off")}
    return x.withColumns(moved).drop("x_off", "y_off")


def assign_tiles(instances: DataFrame, tile: int, stride: int, height: int, width: int) -> DataFrame:
    """One row for each tile ``(ty, tx)`` that a box ``bx0..by1`` meets, found by arithmetic on its corners, not by a range join or by trying all tiles."""
    def met(low: str, high: str, size: int) -> Column:
        last = max(size - tile, 0)
        first = F.greatest(F.floor((F.col(low) - tile) / stride) + 1, F.lit(0)).cast("int")
        final = F.least(F.ceil(F.col(high) / stride) - 1, F.lit(last // stride)).cast("int")
        regular = F.when(first <= final, F.transform(F.sequence(first, final), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))
        flush = F.when((F.col(high) > last) & (F.col(low) < last + tile), F.array(F.lit(last))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.concat(regular, flush))

    return instances.withColumn("ty", F.explode(met("by0", "by1", height))).withColumn("tx", F.explode(met("bx0", "bx1", width)))


def cap(instances: DataFrame, keys: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` of each key; all for ``k`` of 0."""
    if k <= 0:
        return instances
    return instances.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def default_scores(instances: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of a sample are 1 throughout where any of them is missing."""
    w = Window.partitionBy(*keys)
    return instances.withColumn("score", F.when(F.count("score").over(w) < F.count("*").over(w), 1.0).otherwise(F.col("score")))


def clusters(runs: DataFrame, keys: list[str], threshold: float, inclusive: bool) -> DataFrame:
    """``(keys, inst, cluster)``: instances of equal key that overlap beyond a threshold, directly or in a chain, share the smallest id. Ids are unique over all keys."""
    pairs = instance_overlap(runs, runs, keys, between=F.col("a.inst") < F.col("b.inst"), least=threshold)
    near = pairs.where(F.col("iou") >= threshold if inclusive else F.col("iou") > threshold)
    labels = connected_components(near.select("a", "b"))
    return runs.select(*keys, "inst").distinct().join(labels.hint("merge"), F.col("inst") == F.col("node"), "left").select(*keys, "inst", F.coalesce("component", "inst").alias("cluster"))


def semantic_instances(labels: DataFrame, keys: list[str], least_area: int = 64, score: float = 0.05, ignored: int = 255) -> DataFrame:
    """Instances of label runs ``(keys, y, x0, x1, cls)``: ``(keys, component, cls, score, y, x0, x1)``, where a model gives classes alone.

    Every class above 0 falls into its 8-connected components; small ones and the ignored value go, and
    all have the same low score.
    """
    x = R.run_components(labels.where((F.col("cls") > 0) & (F.col("cls") != ignored)), [*keys, "cls"], area=True)
    return x.where(F.col("area") >= least_area).select(*keys, "component", "cls", F.lit(score).alias("score"), "y", "x0", "x1")


def vote_runs(runs: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Merged runs of each key of scored member runs: ``union`` of all, or cells whose members hold half of the key's weight.

    A running sum over the endpoints gives every elementary interval the weight of the members over it.
    Where no cell gets half, the best member (smallest id on ties) stands for the key.
    """
    if method == "union":
        return R.merge_runs(runs, keys)
    if method != "weighted":
        raise ValueError(f"no such vote: {method}")
    weight = runs.select(*keys, "inst", "score").distinct().groupBy(*keys).agg(F.sum(F.col("score").cast("decimal(24,12)")).alias("__all"), F.max_by("inst", F.struct(F.col("score"), -F.col("inst"))).alias("__best"))
    won = materialize(R.sweep(runs, keys, "score").join(weight, keys).where(2 * F.col("w") >= F.col("__all")).select(*keys, "y", "x0", "x1"), "won")
    lost = weight.join(won.select(*keys).distinct(), keys, "left_anti")
    alone = runs.join(lost, keys).where(F.col("inst") == F.col("__best")).select(*keys, "y", "x0", "x1")
    return R.merge_runs(won.unionByName(alone), keys)


def merge_instances(runs: DataFrame, keys: list[str], method: str = "score", threshold: float = 0.5, inclusive: bool = False, members: DataFrame | None = None) -> DataFrame:
    """Runs of merged instances: ``(keys, cluster, members, score, y, x0, x1)``.

    ``score`` keeps the best member of each cluster, ``union`` and ``weighted`` vote; the score is the
    largest of the members. Scene merging links IoU above the threshold, fusion of views at or above it.
    ``members`` are the clusters, if the caller has them already. Instances are linked and voted on in
    the task that their key is dealt to, without a join or another shuffle; keys of too many runs for
    that, and those with scores that are no votes in whole steps, are joined.
    """
    if method not in ("score", "union", "weighted"):
        raise ValueError(f"no such vote: {method}")
    if members is not None:
        return _merged_by_joins(runs, keys, method, members)
    small, large = J.large_keys(runs, keys, ~F.col("score").between(0, J.MOST_SCORE))
    one = J.groups(small, keys, ["score"], J.overlapping(threshold, inclusive), method=method)
    one = one.withColumns({"members": F.size("members").cast("long"), "score": F.col("score").cast(runs.schema["score"].dataType)})
    names = [*keys, "cluster", "y", "x0", "x1", "members", "score"]
    found = J.runs_of(one, [*keys, "cluster", "members", "score"], runs.schema).select(names)
    return found if large is None else found.unionByName(_merged_by_joins(large, keys, method, clusters(large, keys, threshold, inclusive)).select(names))


def _merged_by_joins(runs: DataFrame, keys: list[str], method: str, members: DataFrame) -> DataFrame:
    """The same for clusters of any size. Only ids and scores are written down; runs are read once more and meet the clusters by their instance."""
    ids = runs.select(*keys, "inst", "score").distinct()
    # what Parquet takes for ids says little about their size in memory, so none are broadcast
    own = materialize(ids.join(members.hint("merge"), [*keys, "inst"]), "clustered").hint("merge")
    about = own.groupBy(*keys, "cluster").agg(F.count("*").alias("members"), F.max("score").alias("score"), F.max_by("inst", F.struct(F.col("score"), -F.col("inst"))).alias("best")).hint("merge")
    if method == "score":
        return runs.select(*keys, "inst", "y", "x0", "x1").join(about.withColumnRenamed("best", "inst"), [*keys, "inst"]).select(*keys, "cluster", "y", "x0", "x1", "members", "score")
    shape = vote_runs(runs.join(own.select(*keys, "inst", "cluster"), [*keys, "inst"]), [*keys, "cluster"], method)
    return shape.join(about.drop("best"), [*keys, "cluster"])


def fuse_normals(members: DataFrame, keys: list[str], up_when_zero: bool = True) -> DataFrame:
    """Score-weighted mean normal of each key, of length 1 again: ``(keys, nx, ny, nz)``."""
    w = F.greatest(F.col("score"), F.lit(1e-6))
    x = members.groupBy(*keys).agg(*[F.sum(w * F.col(c)).alias(c) for c in ("nx", "ny", "nz")])
    n = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    rest = {"nx": 0.0, "ny": 0.0, "nz": 1.0}
    return x.withColumn("__n", n).select(*keys, *[F.when(F.col("__n") > 1e-8, F.col(c) / F.col("__n")).otherwise(F.lit(rest[c]) if up_when_zero else F.col(c)).alias(c) for c in rest])


def majority_label(inst_runs: DataFrame, label_runs: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, inst, label)``: the commonest foreground class inside an instance, the smallest on ties; 0 where there is only background."""
    met = inst_runs.alias("a").join(label_runs.alias("b"), R.same([*keys, "y"]) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")))
    n = met.groupBy(*[F.col(f"a.{k}") for k in keys], F.col("a.inst").alias("inst"), F.col("b.cls").alias("cls")).agg(F.sum(F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")).alias("n"))
    best = n.where("cls > 0").groupBy(*keys, "inst").agg(F.max_by("cls", F.struct("n", -F.col("cls"))).alias("label"))
    return inst_runs.select(*keys, "inst").distinct().join(best, [*keys, "inst"], "left").fillna(0, ["label"])


def query_to_instance(scores: DataFrame, keys: list[str], least: float, no_object: int, k: int = 0) -> DataFrame:
    """``(keys, q, cls, prob)``: softmax over classes, the best class that is an object, if sure enough; the ``k`` surest of a sample."""
    top = scores.groupBy(*keys, "q").agg(F.max("logit").alias("__m"))
    x = scores.join(top, [*keys, "q"]).withColumn("e", F.exp(F.col("logit") - F.col("__m")))
    real = F.when((F.col("cls") != no_object) & (F.col("cls") > 0), F.struct(F.col("e"), -F.col("cls")))
    best = x.groupBy(*keys, "q").agg(F.sum("e").alias("all"), F.max_by("cls", real).alias("cls"), F.max(F.when((F.col("cls") != no_object) & (F.col("cls") > 0), F.col("e"))).alias("e"))
    found = best.select(*keys, "q", "cls", (F.col("e") / F.col("all")).alias("prob")).where(F.col("prob") >= least)
    return cap(found, keys, k, [F.desc("prob"), F.col("q")])


def inverse_view(runs: DataFrame, view: str, height: int, width: int) -> DataFrame:
    """Cells seen in a turned or flipped view, in the frame's own coordinates. Quarter turns need new runs, which ``to_runs`` makes of these cells."""
    c = R.to_pixels(runs)
    y, x = F.col("y"), F.col("x")
    back = {
        "id": (y, x),
        "rot90": (x, F.lit(width - 1) - y),
        "rot180": (F.lit(height - 1) - y, F.lit(width - 1) - x),
        "rot270": (F.lit(height - 1) - x, y),
        "hflip": (y, F.lit(width - 1) - x),
    }[view]
    return c.withColumns({"y": back[0], "x": back[1]})


def score_masks(found: DataFrame, masks: DataFrame, keys: list[str], least: float, least_area: int = 1, k: int = 0) -> DataFrame:
    """``(keys, q, cls, score, area)``: class probability times the mean mask probability inside the mask (logit 0 or more), if sure and large enough."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    inside = masks.where("logit >= 0").groupBy(*keys, "q").agg(F.count("*").alias("area"), F.avg(p).alias("__p")).where(F.col("area") >= least_area)
    x = found.join(inside, [*keys, "q"]).withColumn("score", F.col("prob") * F.col("__p")).where(F.col("score") >= least)
    return cap(x.select(*keys, "q", "cls", "score", "area", "prob"), keys, k, [F.desc("prob"), F.col("q")]).drop("prob")


def mean_normal(inst_runs: DataFrame, normals: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, inst, nx, ny, nz)``: mean of the normals of an instance's cells at length 1, up where there is none."""
    on = [F.col(f"r.{k}") == F.col(f"n.{k}") for k in (*keys, "y")] + [(F.col("n.x") >= F.col("r.x0")) & (F.col("n.x") < F.col("r.x1"))]
    met = inst_runs.alias("r").join(normals.alias("n"), on).select(*[F.col(f"r.{k}") for k in keys], F.col("r.inst").alias("inst"), "n.nx", "n.ny", "n.nz", F.lit(1.0).alias("score"))
    fused = fuse_normals(met, [*keys, "inst"])
    x = inst_runs.select(*keys, "inst").distinct().join(fused, [*keys, "inst"], "left")
    return x.select(*keys, "inst", F.coalesce("nx", F.lit(0.0)).alias("nx"), F.coalesce("ny", F.lit(0.0)).alias("ny"), F.coalesce("nz", F.lit(1.0)).alias("nz"))


def teacher_runs(samples: DataFrame, teacher: DataFrame, keys: list[str]) -> DataFrame:
    """Every sample with the runs of its optional teacher raster, any value above 0 counting as set; samples without one have a row of nulls."""
    return samples.join(R.merge_runs(teacher.where("value > 0"), keys), keys, "left")
