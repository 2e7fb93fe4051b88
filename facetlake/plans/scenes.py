"""Queries on instances of scenes: overlap, evaluation, merging, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators import evaluate as E
from facetlake.operators import geometry as G
from facetlake.operators import instances as I
from facetlake.operators import overlap as O
from facetlake.operators import runs as R
from facetlake.plans import fixtures as X
from facetlake.storage import materialize

S = X.FRAME
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    """Register a query under its function's name, with its DuckDB twin over the named derived tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = X.sql(sql, *names)
        return f

    return add


def r6(c, name: str):
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of predictions and of annotations, and the scenes."""
    runs = X.run(spark, d)
    return runs.where("side = 'pred'"), runs.where("side = 'gt'"), X.instance(spark, d).select("scene").distinct()


def pred_gt(spark: SparkSession, d: str) -> DataFrame:
    p, g, _ = sides(spark, d)
    return O.instance_overlap(p, g, ["scene"])


PAIRS = """pair AS MATERIALIZED (SELECT *, inter / (area_a + area_b - inter)::DOUBLE AS iou FROM (
    SELECT a.scene, a.inst AS a, b.inst AS b, sum(least(a.x1, b.x1) - greatest(a.x0, b.x0))::BIGINT AS inter FROM run a JOIN run b
    ON a.scene = b.scene AND a.y = b.y AND a.x0 < b.x1 AND b.x0 < a.x1 AND {on} GROUP BY ALL)
    JOIN (SELECT inst AS a, w * h AS area_a FROM instance) USING (a) JOIN (SELECT inst AS b, w * h AS area_b FROM instance) USING (b))"""
PRED_GT = PAIRS.format(on="a.side = 'pred' AND b.side = 'gt'")
BEST = "best AS MATERIALIZED (SELECT scene, a, arg_max(b, (iou, -b)) AS b, max(iou) AS iou FROM pair GROUP BY ALL)"


def with_more(names: tuple[str, ...], more: str, body: str) -> str:
    return X.sql("", *names).rstrip() + f", {more}\n{body}"


@query("SELECT scene, inst, (w * h)::BIGINT AS area, x1 AS bx0, y1 AS by0, x1 + w AS bx1, y1 + h AS by1, round(x1 + (w - 1) / 2::DOUBLE, 6) AS cx, round(y1 + (h - 1) / 2::DOUBLE, 6) AS cy FROM instance", "instance")
def instance_stats(spark, d):
    s = O.instance_stats(X.run(spark, d), ["scene", "inst"])
    return s.select("scene", "inst", "area", "bx0", "by0", "bx1", "by1", r6("cx", "cx"), r6("cy", "cy"))


@query()
def instance_overlap(spark, d):
    runs = X.run(spark, d)
    o = O.instance_overlap(runs, runs, ["scene"], between=F.col("a.inst") < F.col("b.inst"))
    return o.select("scene", "a", "b", "inter", r6("iou", "iou"))


SQL["instance_overlap"] = with_more(("instance", "run"), PAIRS.format(on="a.inst < b.inst"), "SELECT scene, a, b, inter, round(iou, 6) AS iou FROM pair")


@query()
def best_match(spark, d):
    return O.best_match(pred_gt(spark, d), ["scene"]).select("scene", "a", "b", r6("iou", "iou"))


SQL["best_match"] = with_more(("instance", "run"), f"{PRED_GT}, {BEST}", "SELECT scene, a, b, round(iou, 6) AS iou FROM best")


@query()
def instance_precision_recall(spark, d):
    p, g, scenes = sides(spark, d)
    x = E.instance_precision_recall(O.instance_overlap(p, g, ["scene"], least=0.5), p, g, scenes, ["scene"], 0.5)
    return x.select("scene", "n_pred", "n_gt", "tp", r6("precision", "precision"), r6("recall", "recall"))


SQL["instance_precision_recall"] = with_more(
    ("instance", "run"), f"{PRED_GT}, {BEST}",
    """SELECT scene, n_pred, n_gt, coalesce(tp, 0) AS tp, round(CASE WHEN n_pred = 0 AND n_gt = 0 THEN 1 WHEN n_pred = 0 THEN 0 ELSE coalesce(tp, 0) / n_pred::DOUBLE END, 6) AS precision,
    round(CASE WHEN n_gt = 0 THEN 1 ELSE coalesce(tp, 0) / n_gt::DOUBLE END, 6) AS recall
    FROM (SELECT scene, count(*) FILTER (side = 'pred') AS n_pred, count(*) FILTER (side = 'gt') AS n_gt FROM instance GROUP BY scene)
    LEFT JOIN (SELECT scene, count(DISTINCT b) AS tp FROM best WHERE iou >= 0.5 GROUP BY scene) USING (scene)""",
)


@query()
def over_under_segmentation(spark, d):
    p, g, scenes = sides(spark, d)
    x = E.over_under(O.instance_overlap(p, g, ["scene"], least=0.3), p, g, scenes, ["scene"], 0.3)
    return x.select("scene", r6("over", "over"), r6("under", "under"), r6("topology", "topology"))


SQL["over_under_segmentation"] = with_more(
    ("instance", "run"), PRED_GT,
    """SELECT scene, round(o, 6) AS "over", round(u, 6) AS under, round(greatest(0, 1 - 0.5 * (o + u)), 6) AS topology FROM (
    SELECT scene, coalesce(o, 0) / g::DOUBLE AS o, coalesce(u, 0) / p::DOUBLE AS u
    FROM (SELECT scene, count(*) FILTER (side = 'pred') AS p, count(*) FILTER (side = 'gt') AS g FROM instance GROUP BY scene)
    LEFT JOIN (SELECT scene, count(*) AS o FROM (SELECT scene, b FROM pair WHERE iou >= 0.3 GROUP BY ALL HAVING count(*) > 1) GROUP BY scene) USING (scene)
    LEFT JOIN (SELECT scene, count(*) AS u FROM (SELECT scene, a FROM pair WHERE iou >= 0.3 GROUP BY ALL HAVING count(*) > 1) GROUP BY scene) USING (scene))""",
)


def labels(spark: SparkSession, d: str, side: str | None = None) -> DataFrame:
    """Label runs of both sides, or of one: the instance with the larger id lies on top."""
    runs = X.run(spark, d)
    return R.overlay((runs if side is None else runs.where(F.col("side") == side)).withColumn("cls", (F.col("label") + 1).cast("int")), ["scene", "side"], "cls", ["inst"])


LABELS = ("instance", "run", "cell", "label_cell")
MATRIX = """matrix AS (SELECT gt, pred, count(*) AS n FROM (SELECT coalesce(g.cls, 0) AS gt, coalesce(p.cls, 0) AS pred FROM (SELECT * FROM label_cell WHERE side = 'gt') g
    FULL JOIN (SELECT * FROM label_cell WHERE side = 'pred') p ON g.scene = p.scene AND g.y = p.y AND g.x = p.x) GROUP BY ALL),
    ids AS (SELECT unnest(range(4))::INTEGER AS c),
    whole AS (SELECT a.c AS gt, b.c AS pred, (coalesce(n, 0) + CASE WHEN a.c = 0 AND b.c = 0 THEN (SELECT count(DISTINCT scene) FROM instance) * 128 * 128 - (SELECT sum(n) FROM matrix) ELSE 0 END)::BIGINT AS cells
    FROM ids a CROSS JOIN ids b LEFT JOIN matrix m ON m.gt = a.c AND m.pred = b.c)"""


def matrix(spark: SparkSession, d: str) -> DataFrame:
    x = materialize(labels(spark, d), "labels")
    return E.confusion(x.where("side = 'pred'"), x.where("side = 'gt'"), X.instance(spark, d), ["scene"], S * S, 4)


@query()
def label_confusion(spark, d):
    return matrix(spark, d)


SQL["label_confusion"] = with_more(LABELS, MATRIX, "SELECT gt, pred, cells FROM whole")


@query()
def class_iou(spark, d):
    return E.class_iou(matrix(spark, d), 4).select("cls", r6("iou", "iou"))


SQL["class_iou"] = with_more(
    LABELS, MATRIX,
    """SELECT c AS cls, round(coalesce((SELECT cells FROM whole WHERE gt = c AND pred = c) / nullif((SELECT sum(cells) FROM whole WHERE gt = c OR pred = c), 0)::DOUBLE, 0), 6) AS iou FROM ids""",
)


def two_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Runs of predictions and annotations as ``evaluate.both_sides`` has them, in the task that their scene is dealt to, and the scenes."""
    both = X.run(spark, d, 100).select("scene", "y", "x0", "x1", (F.col("side") == "gt").alias("__gt"))
    return both, X.instance(spark, d).select("scene").distinct()


FG = "fg AS MATERIALIZED (SELECT DISTINCT scene, side, y, x FROM cell)"
ROOF = """roof AS (SELECT scene, coalesce(i, 0) / (p + g - coalesce(i, 0))::DOUBLE AS roof_iou FROM (SELECT scene, count(*) FILTER (side = 'pred') AS p, count(*) FILTER (side = 'gt') AS g FROM fg GROUP BY scene)
    LEFT JOIN (SELECT a.scene, count(*) AS i FROM fg a JOIN fg b USING (scene, y, x) WHERE a.side = 'pred' AND b.side = 'gt' GROUP BY a.scene) USING (scene))"""
NINE = "nine AS (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx))"
EDGE = f"""{NINE}, grown AS MATERIALIZED (SELECT scene, side, y + dy AS y, x + dx AS x, count(*) AS n FROM fg, nine WHERE y + dy BETWEEN 0 AND 127 AND x + dx BETWEEN 0 AND 127 GROUP BY ALL),
    edge AS MATERIALIZED (SELECT scene, side, y, x FROM grown WHERE n < (3 - (y IN (0, 127))::INT) * (3 - (x IN (0, 127))::INT)),
    wide AS MATERIALIZED (SELECT DISTINCT scene, side, y + dy AS y, x + dx AS x FROM edge, nine),
    bf AS (SELECT scene, pg / p::DOUBLE AS precision, gp / g::DOUBLE AS recall, CASE WHEN pg + gp > 0 THEN 2 * (pg / p::DOUBLE) * (gp / g::DOUBLE) / (pg / p::DOUBLE + gp / g::DOUBLE) ELSE 0 END AS f1 FROM
    (SELECT scene, count(*) FILTER (side = 'pred') AS p, count(*) FILTER (side = 'gt') AS g FROM edge GROUP BY scene) JOIN
    (SELECT e.scene, count(*) FILTER (e.side = 'pred') AS pg, count(*) FILTER (e.side = 'gt') AS gp FROM edge e JOIN wide w ON e.scene = w.scene AND e.y = w.y AND e.x = w.x AND e.side <> w.side GROUP BY e.scene) USING (scene))"""
CELLS = ("instance", "run", "cell")


@query()
def roof_iou_per_scene(spark, d):
    return E.foreground_iou_of(*two_sides(spark, d), ["scene"]).select("scene", r6("roof_iou", "roof_iou"))


SQL["roof_iou_per_scene"] = with_more(CELLS, f"{FG}, {ROOF}", "SELECT scene, round(roof_iou, 6) AS roof_iou FROM roof")


@query()
def boundary_f1(spark, d):
    return E.boundary_f1_of(*two_sides(spark, d), ["scene"], S, S, 1).select("scene", r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"))


SQL["boundary_f1"] = with_more(CELLS, f"{FG}, {EDGE}", "SELECT scene, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM bf")


def sample_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each scene's foreground IoU, boundary F1 and hard score."""
    both, scenes = two_sides(spark, d)
    x = E.foreground_iou_of(both, scenes, ["scene"]).join(E.boundary_f1_of(both, scenes, ["scene"], S, S), "scene")
    return x.select(F.col("scene").alias("sample_id"), r6("roof_iou", "roof_iou"), r6("f1", "bfscore"), r6(E.hard_score(F.col("roof_iou"), F.col("f1")), "hard_score"))


HARD = f"{FG}, {ROOF}, {EDGE}, metric AS (SELECT scene AS sample_id, round(roof_iou, 6) AS roof_iou, round(f1, 6) AS bfscore, round(0.5 * (1 - roof_iou) + 0.5 * (1 - f1), 6) AS hard_score FROM roof JOIN bf USING (scene))"


@query()
def hard_samples(spark, d):
    return E.mine_hard(sample_metrics(spark, d), 50)


SQL["hard_samples"] = with_more(CELLS, HARD, "SELECT * FROM metric ORDER BY hard_score DESC, sample_id LIMIT 50")


@query()
def mine_hard(spark, d):
    return E.mine_hard(sample_metrics(spark, d), 0, 0.25).select("sample_id", "hard_score")


SQL["mine_hard"] = with_more(CELLS, HARD, "SELECT sample_id, hard_score FROM metric WHERE hard_score >= 0.25")


@query(
    """SELECT scene, side, cls::INTEGER AS cls, count(*)::BIGINT AS cells, count(DISTINCT y)::BIGINT AS n_rows FROM label_cell GROUP BY ALL""", *LABELS)
def overlay_layers(spark, d):
    return labels(spark, d).groupBy("scene", "side", "cls").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("cells"), F.countDistinct("y").alias("n_rows"))


def both_masks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    keys = ["scene", "side"]
    runs = X.run(spark, d)
    return materialize(R.merge_runs(runs, keys), "mask"), runs.select(*keys).distinct()


def drawn_masks(spark: SparkSession, d: str, times: int = 20) -> tuple[DataFrame, DataFrame]:
    """The same as runs that may overlap, not written down: for what reads them once and merges them itself, in the task that they are dealt to for ``times`` rows an instance."""
    runs = X.run(spark, d, times)
    return runs.select("scene", "side", "y", "x0", "x1"), runs.select("scene", "side").distinct()


def mask_cells(runs: DataFrame) -> DataFrame:
    return runs.groupBy("scene", "side").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("cells"), F.sum(F.col("y") * (F.col("x1") - F.col("x0"))).cast("long").alias("moment"))


MORPH = f"""{FG}, {NINE}, grown AS MATERIALIZED (SELECT scene, side, y + dy AS y, x + dx AS x, count(*) AS n FROM fg, nine WHERE y + dy BETWEEN 0 AND 127 AND x + dx BETWEEN 0 AND 127 GROUP BY ALL),
    core AS MATERIALIZED (SELECT scene, side, y, x FROM grown WHERE n = (3 - (y IN (0, 127))::INT) * (3 - (x IN (0, 127))::INT))"""
AGAIN = """SELECT scene, side, count(*)::BIGINT AS cells, sum(y)::BIGINT AS moment FROM {} GROUP BY ALL"""


@query()
def dilate(spark, d):
    return mask_cells(R.dilate(drawn_masks(spark, d)[0], ["scene", "side"], S, S))


@query()
def erode(spark, d):
    return mask_cells(R.erode(*drawn_masks(spark, d), ["scene", "side"], S, S))


@query()
def mask_gradient(spark, d):
    return mask_cells(R.gradient(*drawn_masks(spark, d), ["scene", "side"], S, S))


@query()
def mask_open(spark, d):
    return mask_cells(R.opened(*drawn_masks(spark, d), ["scene", "side"], S, S))


@query()
def mask_close(spark, d):
    return mask_cells(R.closed(*drawn_masks(spark, d), ["scene", "side"], S, S))


SQL["dilate"] = with_more(CELLS, MORPH, AGAIN.format("grown"))
SQL["erode"] = with_more(CELLS, MORPH, AGAIN.format("core"))
SQL["mask_gradient"] = with_more(CELLS, MORPH, AGAIN.format("(SELECT scene, side, y, x FROM grown EXCEPT SELECT scene, side, y, x FROM core)"))
SQL["mask_open"] = with_more(CELLS, MORPH, AGAIN.format("(SELECT DISTINCT scene, side, y + dy AS y, x + dx AS x FROM core, nine WHERE y + dy BETWEEN 0 AND 127 AND x + dx BETWEEN 0 AND 127)"))
SQL["mask_close"] = with_more(CELLS, MORPH, AGAIN.format("(SELECT scene, side, y, x FROM (SELECT scene, side, y + dy AS y, x + dx AS x, count(*) AS n FROM grown, nine WHERE y + dy BETWEEN 0 AND 127 AND x + dx BETWEEN 0 AND 127 GROUP BY ALL) WHERE n = (3 - (y IN (0, 127))::INT) * (3 - (x IN (0, 127))::INT))"))


@query()
def components_merged(spark, d):
    """All classes of a side as one foreground, its 8-connected components by area."""
    c = R.run_components(both_masks(spark, d)[0], ["scene", "side"])
    return c.groupBy("scene", "side", "component").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area"), F.min("y").alias("top"), F.min("x0").alias("left"), F.max("x1").alias("right")).drop("component")


SPANS = """span AS MATERIALIZED (SELECT scene, side, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY scene, side, y ORDER BY x) AS g FROM fg) GROUP BY scene, side, y, g),
    node AS MATERIALIZED (SELECT *, scene * 10000000 + (side = 'gt')::INT * 1000000 + y * 1000 + x0 AS id FROM span),
    link AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM node a JOIN node b ON a.scene = b.scene AND a.side = b.side AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
    reach AS (SELECT id, id AS root FROM node WHERE id NOT IN (SELECT a FROM link WHERE b < a) UNION SELECT link.b, root FROM reach JOIN link ON link.a = reach.id),
    comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""
SQL["components_merged"] = with_more(CELLS, f"{FG}, {SPANS}", "SELECT scene, side, sum(x1 - x0)::BIGINT AS area, min(y) AS top, min(x0) AS \"left\", max(x1) AS \"right\" FROM node JOIN comp USING (id) GROUP BY scene, side, root").replace("WITH ", "WITH RECURSIVE ", 1)


@query()
def semantic_instances(spark, d):
    """Label maps alone as instances of low score; the third class is the ignored value."""
    x = labels(spark, d).withColumn("cls", F.when(F.col("cls") == 3, 255).otherwise(F.col("cls")))
    c = I.semantic_instances(x, ["scene", "side"])
    return c.groupBy("scene", "side", "cls", "component", "score").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area"), F.min("y").alias("top"), F.min("x0").alias("left"), F.max("x1").alias("right")).drop("component")


CLASS_SPANS = """span AS MATERIALIZED (SELECT scene, side, cls, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY scene, side, cls, y ORDER BY x) AS g FROM label_cell WHERE cls < 3) GROUP BY scene, side, cls, y, g),
    node AS MATERIALIZED (SELECT *, scene * 100000000 + (side = 'gt')::INT * 10000000 + cls * 1000000 + y * 1000 + x0 AS id FROM span),
    link AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM node a JOIN node b ON a.scene = b.scene AND a.side = b.side AND a.cls = b.cls AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
    reach AS (SELECT id, id AS root FROM node WHERE id NOT IN (SELECT a FROM link WHERE b < a) UNION SELECT link.b, root FROM reach JOIN link ON link.a = reach.id),
    comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""
SQL["semantic_instances"] = with_more(LABELS, CLASS_SPANS, "SELECT scene, side, cls, 0.05::DOUBLE AS score, sum(x1 - x0)::BIGINT AS area, min(y) AS top, min(x0) AS \"left\", max(x1) AS \"right\" FROM node JOIN comp USING (id) GROUP BY scene, side, cls, root HAVING sum(x1 - x0) >= 64").replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    """SELECT scene, inst, y, x1 AS x0, x1 + w + 1 AS x1 FROM (SELECT *, unnest(range(y1, y1 + h + 1)) AS y FROM instance)""", "instance")
def rasterize_polygons(spark, d):
    x = R.rasterize(X.vertex(spark, d, 90), ["scene", "inst"], S, S)
    return x.select("scene", "inst", F.col("y").cast("long").alias("y"), "x0", "x1")


def scored_runs(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with scores in whole points, so that sums of votes are exact in any order."""
    return X.run(spark, d).withColumn("score", (5 + (F.col("inst") * 31) % 90).cast("double"))


LINKED = PAIRS.format(on="a.label = b.label AND a.inst < b.inst") + """, near AS MATERIALIZED (SELECT a, b FROM pair WHERE iou {cut} UNION ALL SELECT b, a FROM pair WHERE iou {cut}),
    reach AS (SELECT inst, inst AS root FROM instance UNION SELECT near.b, root FROM reach JOIN near ON near.a = reach.inst),
    member AS MATERIALIZED (SELECT inst, scene, label, (5 + (inst * 31) % 90)::DOUBLE AS score, cluster FROM instance JOIN (SELECT inst, min(root) AS cluster FROM reach GROUP BY inst) USING (inst)),
    about AS MATERIALIZED (SELECT cluster, any_value(scene) AS scene, any_value(label) AS label, count(*) AS members, max(score) AS score, sum(score) AS total, arg_max(inst, (score, -inst)) AS best FROM member GROUP BY cluster)"""
VOTED = """, spot AS (SELECT cluster, y, x, sum(m.score) AS w FROM cell JOIN member m USING (inst) GROUP BY ALL), won AS MATERIALIZED (SELECT cluster, y, x FROM spot JOIN about USING (cluster) WHERE w / total >= 0.5),
    shape AS (SELECT cluster, count(*) AS area FROM won GROUP BY cluster UNION ALL SELECT cluster, w * h FROM about JOIN instance ON inst = best WHERE cluster NOT IN (SELECT cluster FROM won))"""


def merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("scene", "label", "cluster").agg(F.max("members").alias("members"), F.max("score").alias("score"), F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area"))


def merge_sql(cut: str, more: str, body: str, names=CELLS) -> str:
    return with_more(names, LINKED.replace("{cut}", cut) + more, body).replace("WITH ", "WITH RECURSIVE ", 1)


@query()
def merge_tiles_score(spark, d):
    return merged(I.merge_instances(scored_runs(spark, d), ["scene", "label"], "score", 0.5))


@query()
def merge_tiles_union(spark, d):
    return merged(I.merge_instances(scored_runs(spark, d), ["scene", "label"], "union", 0.5))


@query()
def merge_tiles_weighted(spark, d):
    return merged(I.merge_instances(scored_runs(spark, d), ["scene", "label"], "weighted", 0.5))


@query()
def fuse_views(spark, d):
    return merged(I.merge_instances(scored_runs(spark, d), ["scene", "label"], "weighted", 0.6, inclusive=True))


SQL["merge_tiles_score"] = merge_sql("> 0.5", "", "SELECT a.scene, a.label, cluster, members, a.score, (w * h)::BIGINT AS area FROM about a JOIN instance ON inst = best", ("instance", "run"))
SQL["merge_tiles_union"] = merge_sql("> 0.5", "", "SELECT a.scene, a.label, cluster, members, a.score, area FROM about a JOIN (SELECT cluster, count(DISTINCT y * 1000 + x)::BIGINT AS area FROM cell JOIN member USING (inst) GROUP BY cluster) USING (cluster)")
SQL["merge_tiles_weighted"] = merge_sql("> 0.5", VOTED, "SELECT scene, label, cluster, members, score, area FROM about JOIN shape USING (cluster)")
SQL["fuse_views"] = merge_sql(">= 0.6", VOTED, "SELECT scene, label, cluster, members, score, area FROM about JOIN shape USING (cluster)")


CALIBRATED = "1 / (1 + exp(-ln(q / (1 - q)) / 1.5))"
P = "SELECT *, least(greatest(score, 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE) AS q FROM instance"


@query(f"SELECT inst, round({CALIBRATED}, 6) AS p FROM ({P})", "instance")
def calibrated_scores(spark, d):
    return X.instance(spark, d).select("inst", r6(I.calibrate(F.col("score"), 1.5), "p"))


@query(
    f"""SELECT scene, inst, label, (w * h)::BIGINT AS area, round({CALIBRATED}, 6) AS p FROM ({P}) WHERE label > 0 AND w * h >= 200
    AND round({CALIBRATED}, 6) >= CASE label WHEN 1 THEN 0.35 WHEN 2 THEN 0.45 ELSE 0.35 END""", "instance")
def quality_gate(spark, d):
    keys = ["scene", "inst"]
    about = X.instance(spark, d).select(*keys, "label", r6(I.calibrate(F.col("score"), 1.5), "p"))
    x = about.join(O.instance_stats(X.run(spark, d), keys), keys)
    return I.quality_gate(x, F.col("p"), least_area=200).select(*keys, "label", "area", "p")


@query("SELECT scene, inst, (w * h)::BIGINT AS area FROM instance WHERE w * h >= 160 QUALIFY row_number() OVER (PARTITION BY scene ORDER BY w * h DESC, inst) <= 20", "instance")
def cap_instances(spark, d):
    s = O.instance_stats(X.run(spark, d), ["scene", "inst"]).where("area >= 160").select("scene", "inst", "area")
    return I.cap(s, ["scene"], 20, [F.desc("area"), F.col("inst")])


@query("SELECT scene, inst, score FROM instance QUALIFY row_number() OVER (PARTITION BY scene ORDER BY score DESC, inst) <= 10", "instance")
def cap_detections(spark, d):
    return I.cap(X.instance(spark, d).select("scene", "inst", "score"), ["scene"], 10, [F.desc("score"), F.col("inst")])


@query(
    """SELECT scene, inst, CASE WHEN bool_or(inst % 997 = 0) OVER (PARTITION BY scene) THEN 1 ELSE score END AS score FROM instance""", "instance")
def default_scores(spark, d):
    x = X.instance(spark, d).select("scene", "inst", F.when(F.col("inst") % 997 != 0, F.col("score")).alias("score"))
    return I.default_scores(x, ["scene"])


@query(
    """SELECT scene, inst, coalesce(arg_max(cls, (n, -cls)), 0)::INTEGER AS label FROM instance i LEFT JOIN (SELECT p.scene, p.inst, g.cls, count(*) AS n FROM cell p JOIN label_cell g
    ON p.scene = g.scene AND p.y = g.y AND p.x = g.x WHERE p.side = 'pred' AND g.side = 'gt' GROUP BY ALL) n USING (scene, inst) WHERE i.side = 'pred' GROUP BY ALL""", *LABELS)
def majority_label(spark, d):
    return I.majority_label(X.run(spark, d).where("side = 'pred'"), labels(spark, d, "gt"), ["scene"])


FUSED = """SELECT scene, label, x / n AS nx, y / n AS ny, z / n AS nz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM (
    SELECT i.scene, label, sum(score * nx) AS x, sum(score * ny) AS y, sum(score * nz) AS z FROM instance i JOIN normal USING (inst) GROUP BY ALL))"""


@query(f"SELECT scene, label, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz FROM ({FUSED})", "instance", "normal")
def fused_normals(spark, d):
    members = X.instance(spark, d).join(X.normal(spark, d), ["scene", "inst"])
    return I.fuse_normals(members, ["scene", "label"]).select("scene", "label", r6("nx", "nx"), r6("ny", "ny"), r6("nz", "nz"))


@query(
    """SELECT scene, view, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, count(*)::BIGINT AS cells FROM (
    SELECT scene, 'rot90' AS view, x AS y, 127 - y AS x FROM cell UNION ALL SELECT scene, 'rot180', 127 - y, 127 - x FROM cell
    UNION ALL SELECT scene, 'rot270', 127 - x, y FROM cell UNION ALL SELECT scene, 'hflip', y, 127 - x FROM cell) GROUP BY ALL""", *CELLS)
def inverse_views(spark, d):
    runs = X.run(spark, d).select("scene", "y", "x0", "x1")
    out = None
    for view in ("rot90", "rot180", "rot270", "hflip"):
        x = I.inverse_view(runs, view, S, S).groupBy("scene").agg(F.sum("x").cast("long").alias("sx"), F.sum("y").cast("long").alias("sy"), F.count("*").alias("cells")).withColumn("view", F.lit(view))
        out = x if out is None else out.unionByName(x)
    return out


ORIGINS = f"(SELECT DISTINCT unnest(list_concat(range(0, {S} - {X.TILE} + 1, {X.STRIDE}), [{S} - {X.TILE}])) AS o)"


@query(f"SELECT scene, a.o AS ty, b.o AS tx FROM (SELECT DISTINCT scene FROM instance), {ORIGINS} a, {ORIGINS} b", "instance")
def tile_origins(spark, d):
    t = R.tile_origins(F.lit(S), X.TILE, X.STRIDE)
    x = X.instance(spark, d).select("scene").distinct().withColumn("ty", F.explode(t)).withColumn("tx", F.explode(t))
    return x.select("scene", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"))


@query(f"SELECT inst, a.o AS ty, b.o AS tx FROM instance, {ORIGINS} a, {ORIGINS} b WHERE x1 < b.o + {X.TILE} AND x1 + w > b.o AND y1 < a.o + {X.TILE} AND y1 + h > a.o", "instance")
def tile_assignment(spark, d):
    box = X.instance(spark, d).selectExpr("inst", "x1 AS bx0", "y1 AS by0", "x1 + w AS bx1", "y1 + h AS by1")
    x = I.assign_tiles(box, X.TILE, X.STRIDE, S, S)
    return x.select("inst", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"))


@query(
    """SELECT (inst // 2) AS tile, y + (inst % 3) * 48 AS y, x0 + (inst % 2) * 64 AS x0, x1 + (inst % 2) * 64 AS x1, inst FROM run""", "instance", "run")
def scene_coordinates(spark, d):
    runs = X.run(spark, d).selectExpr("inst", "inst div 2 AS tile", "y", "x0", "x1")
    tiles = X.instance(spark, d).selectExpr("inst", "(inst % 3) * 48 AS y_off", "(inst % 2) * 64 AS x_off")
    return I.to_scene(runs, tiles, ["inst"]).select("inst", "tile", "y", "x0", "x1")


MERGED = """facet AS MATERIALIZED (SELECT a.scene, a.label, cluster AS facet, members, a.score, (w * h)::BIGINT AS area, best, x1, y1, w, h FROM about a JOIN instance ON inst = best),
    shown AS (SELECT *, abs(nz) AS z, degrees(acos(least(abs(nz), 1))) AS slope, (degrees(atan2(ny, nx)) + 360) % 360 AS azimuth, sqrt(nx * nx + ny * ny + nz * nz) AS n FROM facet JOIN (SELECT inst AS best, nx, ny, nz FROM normal) USING (best))"""


@query()
def scene_facets(spark, d):
    """Detections of a scene as facets: gate, merge over tiles, slope, azimuth, confidence and quality flags."""
    p = X.run(spark, d).where("label > 0").withColumn("score", (5 + (F.col("inst") * 31) % 90).cast("double"))
    cluster = materialize(I.clusters(p, ["scene", "label"], 0.5, False), "members")
    runs = I.merge_instances(p, ["scene", "label"], "score", members=cluster)
    shape = O.instance_stats(runs.withColumnRenamed("cluster", "facet"), ["scene", "label", "facet", "members", "score"])
    own = p.select("scene", "label", "inst", "score").distinct()
    best = own.join(X.normal(spark, d), ["scene", "inst"])
    normals = best.join(cluster, ["scene", "label", "inst"]).groupBy("scene", "label", F.col("cluster").alias("facet")).agg(F.max_by(F.struct("nx", "ny", "nz"), F.struct(F.col("score"), -F.col("inst"))).alias("v"))
    x = shape.join(normals, ["scene", "label", "facet"]).select("*", "v.nx", "v.ny", "v.nz").drop("v")
    x = x.withColumns({"slope": G.slope(F.col("nz")), "azimuth": G.azimuth(F.col("nx"), F.col("ny")), "n": G.norm(F.col("nx"), F.col("ny"), F.col("nz"))})
    x = x.withColumn("confidence", G.geometry_confidence(F.col("score") / 100, F.col("area"), F.col("n")))
    ring = x.selectExpr("facet", "posexplode(array(named_struct('x', bx0, 'y', by0), named_struct('x', bx1, 'y', by0), named_struct('x', bx1, 'y', by1), named_struct('x', bx0, 'y', by1))) AS (ord, p)").selectExpr("facet", "ord", "double(p.x) AS x", "double(p.y) AS y")
    x = G.qa_flags(x, ring, ["facet"], S, S)
    return x.select("scene", "label", "facet", "members", "score", "area", r6("slope", "slope"), r6("azimuth", "azimuth"), r6("confidence", "confidence"), "qa_ok")


SQL["scene_facets"] = (
    with_more(
        ("instance", "run", "normal"), LINKED.replace("{cut}", "> 0.5") + f", {MERGED}",
        """SELECT scene, label, facet, members, score, area, round(slope, 6) AS slope, round(azimuth, 6) AS azimuth,
    round(least(greatest(0.60 * score / 100 + 0.25 * least(area / 500::DOUBLE, 1) + 0.15 * (1 - abs(n - 1)), 0), 1), 6) AS confidence,
    (x1 >= 0 AND y1 >= 0 AND x1 + w <= 127 AND y1 + h <= 127 AND abs(n - 1) <= 0.05) AS qa_ok FROM shown WHERE label > 0""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
