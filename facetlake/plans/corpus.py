"""Queries on manifests, label corpora and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetlake.operators import audit as A
from facetlake.operators import evaluate as E
from facetlake.operators import manifest as M
from facetlake.operators import records as C
from facetlake.plans import fixtures as X
from facetlake.plans.scenes import LABELS, labels, r6

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = X.sql(sql, *names)
        return f

    return add


def manifest(spark: SparkSession, d: str) -> DataFrame:
    s = X.sample(spark, d)
    sources = s.select("source").distinct().selectExpr("source", "concat('/data/', source, '/') AS root", "'train.txt' AS split", "source <> 'de' AS allow_missing_normal", "if(source = 'fr', '.png', NULL) AS image_suffix")
    return M.sample_manifest(s, sources)


@query(
    """SELECT source, sample_id, '/data/' || source || '/images/' || sample_id || CASE WHEN source = 'fr' THEN '.png' ELSE '.jpg' END AS image_path, '/data/' || source || '/masks/' || sample_id || '.png' AS mask_path,
    '/data/' || source || '/normals/' || sample_id || '.npy' AS normal_path, '/data/' || source || '/sam_masks/' || sample_id || '.png' AS teacher_path, has_normal::INT::DOUBLE AS valid_normal FROM sample
    WHERE has_normal OR source <> 'de'""", "sample")
def manifest_paths(spark, d):
    files = X.sample(spark, d).where("has_normal").selectExpr("concat('/data/', source, '/normals/', sample_id, '.npy') AS path")
    return M.flag_normals(manifest(spark, d), files).select("source", "sample_id", "image_path", "mask_path", "normal_path", "teacher_path", "valid_normal")


BALANCED = """SELECT source, sample_id, unnest(range(n_max // n + (rn <= n_max % n)::INT))::INTEGER AS replica FROM (SELECT *, max(n) OVER () AS n_max FROM (
    SELECT source, sample_id, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5(sample_id || '42'), sample_id) AS rn FROM sample))"""


@query(BALANCED, "sample")
def balance_sources(spark, d):
    return M.balance_sources(X.sample(spark, d).select("source", "sample_id"))


@query(f"SELECT source, sample_id, (n * CASE WHEN sample_id IN (SELECT sample_id FROM hard) THEN 3 ELSE 1 END)::BIGINT AS rows FROM (SELECT source, sample_id, count(*) AS n FROM ({BALANCED}) GROUP BY ALL)", "sample", "hard")
def hard_oversample(spark, d):
    x = M.hard_oversample(M.balance_sources(X.sample(spark, d).select("source", "sample_id")), X.hard(spark, d), 3)
    return x.groupBy("source", "sample_id").agg(F.count("*").alias("rows"))


PARTS = "x AS (SELECT sample_id, doc_id FROM (SELECT lang || '_' || doc_id AS sample_id, doc_id FROM documents)), i AS (SELECT sample_id FROM x WHERE doc_id % 5 <> 0), m AS (SELECT sample_id FROM x WHERE doc_id % 7 <> 0), s AS (SELECT sample_id FROM x WHERE doc_id % 2 = 0)"


@query(
    f"""WITH {PARTS} SELECT 'image_without_mask' AS kind, sample_id FROM (SELECT * FROM i EXCEPT SELECT * FROM m) UNION ALL SELECT 'mask_without_image', sample_id FROM (SELECT * FROM m EXCEPT SELECT * FROM i)
    UNION ALL SELECT 'split_not_on_disk', sample_id FROM (SELECT * FROM s EXCEPT (SELECT * FROM i INTERSECT SELECT * FROM m))""")
def orphans(spark, d):
    x = X.table(spark, d, "documents").selectExpr("concat(lang, '_', doc_id) AS sample_id", "doc_id")
    return M.orphans(x.where("doc_id % 5 <> 0"), x.where("doc_id % 7 <> 0"), x.where("doc_id % 2 = 0"))


@query("SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY sample_id DESC) <= (SELECT count(*) FROM sample) // 10 THEN 'val' ELSE 'train' END AS part FROM sample", "sample")
def holdout_split(spark, d):
    return M.holdout(X.sample(spark, d))


@query("SELECT source AS prefix, count(*) AS samples FROM sample GROUP BY source", "sample")
def source_counts(spark, d):
    return A.source_counts(X.sample(spark, d))


DISTRIBUTION = """dist AS (SELECT c AS cls, coalesce(cells, 0)::BIGINT AS cells, coalesce(samples, 0) AS samples FROM (SELECT unnest(range(5))::INTEGER AS c) LEFT JOIN (
    SELECT cls, sum(n) AS cells, count(*) AS samples FROM (SELECT scene, cls::INTEGER AS cls, count(*) AS n FROM label_cell WHERE side = 'gt' GROUP BY ALL UNION ALL SELECT scene, 0, 128 * 128 - count(*) FROM label_cell WHERE side = 'gt' GROUP BY ALL) GROUP BY cls) ON cls = c)"""


def distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.class_distribution(labels(spark, d, "gt"), X.instance(spark, d), ["scene"], X.FRAME**2)


@query()
def class_distribution(spark, d):
    return distribution(spark, d).select("cls", "cells", "samples", r6("share", "share"))


SQL["class_distribution"] = X.sql("", *LABELS).rstrip() + f", {DISTRIBUTION}\nSELECT cls, cells, samples, round(cells / sum(cells) OVER (), 6) AS share FROM dist"


@query()
def class_weights(spark, d):
    return A.class_weights(distribution(spark, d))


SQL["class_weights"] = X.sql("", *LABELS).rstrip() + f", {DISTRIBUTION}\nSELECT cls, CASE WHEN cls = 0 OR cells = 0 THEN 1 ELSE round(least((max(cells) FILTER (cls > 0) OVER ()) / cells, 100), 1) END::DOUBLE AS weight FROM dist"


@query()
def query_class_weights(spark, d):
    """The same weights for query classification, with a small one for no object."""
    return A.class_weights(distribution(spark, d), no_object=0.1)


SQL["query_class_weights"] = SQL["class_weights"] + " UNION ALL SELECT max(cls) + 1, 0.1::DOUBLE FROM dist"


TITLED = "CASE p_size % 8 WHEN 0 THEN 'panels' WHEN 1 THEN 'chimney' WHEN 2 THEN 'antenna' WHEN 3 THEN 'window' WHEN 4 THEN 'secondary structure' WHEN 5 THEN 'property roof' ELSE 'tree' END"


@query(f"""SELECT p_partkey AS item, t AS title, CASE t WHEN 'panels' THEN 3 WHEN 'property roof' THEN 2 ELSE 4 END AS cls, CASE t WHEN 'panels' THEN 10 WHEN 'chimney' THEN 5 WHEN 'antenna' THEN 5 WHEN 'window' THEN 5 ELSE 0 END AS z_order
    FROM (SELECT p_partkey, {TITLED} AS t FROM part) WHERE t <> 'tree'""")
def mapped_labels(spark, d):
    x = X.table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.expr(TITLED).alias("title"))
    return A.map_labels(x, A.TITLE_CLASS, "title").withColumn("z_order", A.paint_order(F.col("title")))


FILES = """file AS MATERIALIZED (SELECT lang AS dataset, source AS ext, n_chars AS length, doc_id % 6 AS depth,
    lang || '/' || CASE doc_id % 5 WHEN 0 THEN 'Images' WHEN 1 THEN 'train_masks' WHEN 2 THEN 'notes' WHEN 3 THEN 'satellite/tiles' ELSE 'street' END || '/' || CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.ZIP' ELSE '.png' END AS path FROM documents)"""


def file_list(spark: SparkSession, d: str) -> DataFrame:
    """A file for each document."""
    folder = "CASE doc_id % 5 WHEN 0 THEN 'Images' WHEN 1 THEN 'train_masks' WHEN 2 THEN 'notes' WHEN 3 THEN 'satellite/tiles' ELSE 'street' END"
    path = f"concat(lang, '/', {folder}, '/', if(doc_id % 11 = 0, '.', ''), doc_id, if(doc_id % 7 = 0, '.ZIP', '.png')) AS path"
    return X.table(spark, d, "documents").selectExpr("lang AS dataset", "source AS ext", "n_chars AS length", "doc_id % 6 AS depth", path)


@query()
def file_profile(spark, d):
    return A.file_profile(file_list(spark, d))


SQL["file_profile"] = f"""WITH {FILES}, total AS (SELECT dataset, ext, grouping(dataset, ext) AS level, count(*) AS files, sum(length)::BIGINT AS bytes, max(depth) AS depth FROM file GROUP BY ROLLUP (dataset, ext))
    SELECT dataset, ext, files, bytes, depth, (SELECT string_agg(path, ', ' ORDER BY path) FROM (SELECT path FROM file f WHERE (level >= 3 OR f.dataset IS NOT DISTINCT FROM t.dataset) AND (level >= 1 OR f.ext IS NOT DISTINCT FROM t.ext) ORDER BY path LIMIT 5)) AS some FROM total t"""


@query(f"""WITH {FILES} SELECT dataset, regexp_extract(path, '^(.*)/', 1) AS folder, count(*) AS files, sum((path LIKE '%.ZIP')::INT)::BIGINT AS archives FROM file
    WHERE path LIKE '%/Images/%' OR path LIKE '%masks/%' OR path LIKE '%/street/%' GROUP BY ALL HAVING count(*) > 0""".replace("FROM file\n", "FROM (FROM file WHERE path NOT LIKE '%/.%')\n"))
def key_folders(spark, d):
    return A.key_folders(file_list(spark, d))


AUDITED = """mask AS (SELECT DISTINCT o_orderkey // 50 AS scene, CASE WHEN o_orderkey // 50 % 17 = 3 THEN NULL ELSE 128 END AS height, CASE WHEN o_orderkey // 50 % 13 = 5 THEN 64 ELSE 128 END AS width FROM orders),
    image AS (SELECT DISTINCT o_orderkey // 50 AS scene, 128 AS height, 128 AS width FROM orders WHERE o_orderkey // 50 % 19 <> 1),
    held AS (SELECT o_orderkey // 50 AS scene, max(((o_orderkey // 50 % 10 + o_custkey % 3) % 11 > 4)::INT) AS wrong FROM orders WHERE o_orderkey // 50 % 7 <> 2 AND (o_orderkey // 50 % 10 + o_custkey % 3) % 11 <> 0 GROUP BY ALL)"""


@query(
    f"""WITH {AUDITED} SELECT count(*) AS samples, sum((m.height IS NULL)::INT)::BIGINT AS unreadable, sum((m.height IS NOT NULL AND wrong IS NULL)::INT)::BIGINT AS empty,
    sum(coalesce(m.height IS NOT NULL AND (m.height <> i.height OR m.width <> i.width), false)::INT)::BIGINT AS mismatched, sum(coalesce(m.height IS NOT NULL AND wrong = 1, false)::INT)::BIGINT AS invalid
    FROM mask m LEFT JOIN image i USING (scene) LEFT JOIN held USING (scene)""")
def mask_audit(spark, d):
    """Masks of scenes, some of them without a cell, a size or an image of their size."""
    runs = X.run(spark, d).withColumn("cls", F.expr("(scene % 10 + label) % 11"))
    scenes = runs.select("scene").distinct()
    masks = scenes.withColumns({"height": F.expr("if(scene % 17 = 3, null, 128)"), "width": F.expr("if(scene % 13 = 5, 64, 128)")})
    images = scenes.where("scene % 19 <> 1").withColumns({"height": F.lit(128), "width": F.lit(128)})
    return A.mask_audit(masks, runs.where("scene % 7 <> 2"), images, ["scene"])


@query("SELECT count(*) AS samples, max(n) AS most, (SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM instance)) AS labels FROM (SELECT scene, count(*) AS n FROM instance GROUP BY scene)", "instance")
def preflight(spark, d):
    return A.preflight(X.instance(spark, d), "scene")


@query("SELECT l_returnflag AS key, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag")
def profile_stats(spark, d):
    x = C.profile_stats(X.table(spark, d, "lineitem").selectExpr("l_returnflag AS key", "l_extendedprice AS value"), ["key"], "value")
    return x.select("key", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p50", "p95")])


KPI = "SELECT o_orderkey AS seq, o_custkey AS run, 80 + (o_orderkey * 7) % 20 AS miou, 85 + (o_orderkey * 3) % 15 AS ap, 75 + (o_orderkey * 11) % 20 AS bf FROM orders"
STATUS = f"SELECT seq, run, CASE WHEN miou >= 85 AND CASE WHEN seq % 13 = 0 THEN 0 ELSE ap END >= 90 AND bf >= 80 THEN 'promoted' ELSE 'rejected' END AS status FROM ({KPI})"


def registry(spark: SparkSession, d: str) -> DataFrame:
    o = X.table(spark, d, "orders")
    metrics = "map_from_entries(filter(array(struct('mIoU', double(80 + (o_orderkey * 7) % 20)), struct(if(o_orderkey % 13 = 0, NULL, 'AP50'), double(85 + (o_orderkey * 3) % 15)), struct('BFScore', double(75 + (o_orderkey * 11) % 20))), e -> e.col1 IS NOT NULL)) AS metrics"
    return C.kpi_gate(o.selectExpr("o_orderkey AS seq", "o_custkey AS run", "if(o_orderkey % 11 = 0, '', concat('iter_', o_orderkey, '.pth')) AS checkpoint", metrics))


@query(STATUS)
def kpi_gate(spark, d):
    return registry(spark, d).select("seq", "run", "status")


@query(f"SELECT run, arg_max('iter_' || seq || '.pth', seq) AS checkpoint FROM ({STATUS}) WHERE status = 'promoted' AND seq % 11 <> 0 GROUP BY run")
def last_promoted(spark, d):
    return C.last_promoted(registry(spark, d), ["run"])


@query("SELECT run, iter, key, round(avg(value) OVER (PARTITION BY run, key ORDER BY iter ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS smooth FROM log", "log")
def log_rolling_mean(spark, d):
    return C.rolling_mean(X.log(spark, d)).select("run", "iter", "key", r6("smooth", "smooth"))


STREAK = """SELECT run, min(iter) AS "first", max(iter) AS "last", count(*) AS length FROM (SELECT run, iter, iter - row_number() OVER (PARTITION BY run ORDER BY iter) AS island FROM log WHERE key = 'error') GROUP BY run, island HAVING count(*) >= 2"""


@query(STREAK, "log")
def log_zero_streak(spark, d):
    return C.streaks(X.log(spark, d), F.col("key") == "error", 2)


@query("SELECT run, since, ts AS until, round((epoch_us(ts) - epoch_us(since)) / 1e6, 6) AS gap FROM (SELECT *, lag(ts) OVER (PARTITION BY run ORDER BY ts, event_id) AS since FROM log) WHERE epoch_us(ts) - epoch_us(since) > 7200000000", "log")
def log_stalls(spark, d):
    return C.stalls(X.log(spark, d), 7200).select("run", "since", "until", F.round("gap", 6).alias("gap"))


@query("SELECT run, iter, coalesce(value > max(value) OVER (PARTITION BY run ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best, row_number() OVER (PARTITION BY run ORDER BY iter DESC) <= 3 AS kept FROM log", "log")
def mark_best(spark, d):
    return C.mark_best(X.log(spark, d)).select("run", "iter", "best", "kept")


@query(
    """SELECT coalesce(a.key, b.key) AS key, round(a.value, 6) AS v_new, round(b.value, 6) AS v_stable, round(a.value - b.value, 6) AS delta, coalesce(a.value - b.value >= -5, false) AS ok FROM
    (SELECT user_id AS key, avg(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY user_id) a FULL JOIN (SELECT user_id AS key, avg(value) AS value FROM events WHERE event_id % 2 = 1 GROUP BY user_id) b ON a.key = b.key""")
def canary(spark, d):
    e = X.table(spark, d, "events")
    half = lambda k: e.where(f"event_id % 2 = {k}").groupBy(F.col("user_id").alias("key")).agg(F.avg("value").alias("value"))
    x = C.canary(half(0), half(1), ["key"], 5.0)
    return x.select("key", r6("v_new", "v_new"), r6("v_stable", "v_stable"), r6("delta", "delta"), "ok")


@query("SELECT user_id AS key, count(*) FILTER (event_id % 2 = 0) AS v_new, count(*) FILTER (event_id % 2 = 1) AS v_stable, count(*) FILTER (event_id % 2 = 0) - count(*) FILTER (event_id % 2 = 1) AS delta, abs(count(*) FILTER (event_id % 2 = 0) - count(*) FILTER (event_id % 2 = 1)) <= 0.1::DOUBLE * count(*) FILTER (event_id % 2 = 1) AS ok FROM events GROUP BY user_id")
def canary_counts(spark, d):
    e = X.table(spark, d, "events").select("event_id", F.col("user_id").alias("key"))
    return C.canary_counts(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["key"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props_json(spark, d):
    return X.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^([^.?#]*)', 1) AS stem, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS host FROM pages""")
def page_stems(spark, d):
    name = F.regexp_extract("url", r"([^/]*)$", 1)
    return X.table(spark, d, "pages").select("page_id", name.alias("name"), F.regexp_extract(name, r"^([^.?#]*)", 1).alias("stem"), F.split_part(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit(1)).alias("host"))


@query("SELECT label, count(*) AS facets, round(avg(score), 6) AS confidence FROM instance GROUP BY label", "instance")
def count_by_class(spark, d):
    return X.instance(spark, d).groupBy("label").agg(F.count("*").alias("facets"), r6(F.avg("score"), "confidence"))


@query(
    """SELECT inst, ann_no, row_number() OVER (PARTITION BY scene ORDER BY inst) AS number FROM (SELECT *, inst % 50 AS ann_no FROM instance WHERE side = 'gt')""", "instance")
def renumber_instances(spark, d):
    x = X.instance(spark, d).where("side = 'gt'").selectExpr("scene", "inst", "inst % 50 AS ann_no")
    return x.select("inst", "ann_no", F.row_number().over(Window.partitionBy("scene").orderBy("inst")).cast("long").alias("number"))


@query("SELECT h AS height, w AS width, count(*) AS samples FROM instance GROUP BY ALL ORDER BY samples DESC, height, width LIMIT 10", "instance")
def top_shapes(spark, d):
    return A.top_shapes(X.instance(spark, d).selectExpr("h AS height", "w AS width"))


@query("SELECT run, round(sum(value * iter) / greatest(sum(iter), 1e-12), 6) AS loss FROM log GROUP BY run", "log")
def weighted_reduce(spark, d):
    return X.log(spark, d).groupBy("run").agg(r6(E.weighted_reduce(F.col("value"), F.col("iter"), "mean", F.sum("iter").cast("double")), "loss"))
