"""Queries that write what they derive from a table in a file format and read it back with the format's reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators import audit as A
from facetlake.operators import evaluate as E
from facetlake.operators import geometry as G
from facetlake.operators import manifest as M
from facetlake.operators import stencils as T
from facetlake.operators import views as V
from facetlake.plans import fixtures as X
from facetlake.plans.facets import MIRROR, RING, SEGMENTS, VERTS, segments
from facetlake.plans.scenes import r6, with_more
from facetlake.sources import readers, writers
from facetlake.storage import materialize, shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = X.sql(sql, *names)
        return f

    return add


def written(lines: DataFrame) -> tuple[SparkSession, str]:
    """Text lines (``value``) in a folder of the shared storage."""
    path = shared_dir(lines.sparkSession, "files")
    lines.write.text(path)
    return lines.sparkSession, path


@query("SELECT sample_id FROM sample", "sample")
def split_list(spark, d):
    path = shared_dir(spark, "files")
    writers.write_split(X.sample(spark, d), path, legacy=True)
    return readers.read_split(spark, f"{path}/train").select("sample_id")


#: Scenes of an annotation document that is a file: some 12,800 rings in about 1 MB, so that files are few and none is large.
DOCUMENT_SCENES = 256


def annotation_documents(spark: SparkSession, d: str, category: str = "inst", scenes: int = 1) -> DataFrame:
    """``(doc, value)``: every scene, or so many neighbouring ones, as one annotation document, made in the task that it is dealt to; rings alternate between the flat and the nested form."""
    i = X.dealt(X.instance(spark, d).withColumn("doc", F.expr(f"scene div {scenes}")), "doc", 20)
    ring = [F.expr(f"double({c})") for c in ("x1", "y1", "x1 + w", "y1", "x1 + w", "y1 + h", "x1", "y1 + h")]
    flat = F.to_json(F.array(*ring))
    seg = F.when(F.col("inst") % 2 == 0, flat).otherwise(F.concat(F.lit("["), flat, F.lit("]")))
    ann = F.concat(F.lit('{"id":'), F.col("inst"), F.lit(',"image_id":'), F.col("scene"), F.lit(',"category_id":'), F.col(category), F.lit(',"segmentation":'), seg, F.lit("}"))
    image = F.concat(F.lit('{"id":'), F.col("scene"), F.lit(',"file_name":"s'), F.col("scene"), F.lit('.jpg","width":128,"height":128}'))
    joined = lambda c: F.array_join(F.collect_list(c), ",")
    x = i.select("doc", "scene", ann.alias("a")).groupBy("doc", "scene").agg(joined("a").alias("a")).select("doc", image.alias("i"), "a").groupBy("doc").agg(joined("i").alias("i"), joined("a").alias("a"))
    return x.select("doc", F.concat(F.lit('{"images":['), "i", F.lit('],"annotations":['), "a", F.lit("]}")).alias("value"))


@query("SELECT scene AS image_id, inst AS ann_no, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, count(*) AS corners FROM vertex GROUP BY ALL", "instance", "vertex")
def coco_rings(spark, d):
    _, rings = readers.read_coco_lines(*written(annotation_documents(spark, d).select("value")))
    x = readers.ring_vertices(rings.withColumn("ann_no", F.col("category_id").cast("long")))
    return x.groupBy("image_id", "ann_no").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("corners"))


@query("SELECT scene AS id, 's' || scene || '.jpg' AS file_name, 128 * 128 AS cells, count(*) AS rings, sum(label)::BIGINT AS categories, sum(x1 + w)::DOUBLE AS right_sum FROM instance GROUP BY scene", "instance")
def coco_documents(spark, d):
    """Documents of a file each, which hold many images and many lines in general: their images with what their rings say."""
    path = shared_dir(spark, "files")
    annotation_documents(spark, d, "label", DOCUMENT_SCENES).write.partitionBy("doc").text(path)
    images, rings = readers.read_coco(spark, path)
    own = rings.groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("rings"), F.sum("category_id").cast("long").alias("categories"), F.sum(F.array_max(F.transform("verts", lambda p: p["x"]))).alias("right_sum"))
    return images.join(own, "id").select(F.col("id").cast("long").alias("id"), "file_name", (F.col("width") * F.col("height")).cast("int").alias("cells"), "rings", "categories", "right_sum")


@query("""SELECT CASE inst % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 2 END AS cls, CASE WHEN inst % 2 = 1 THEN 'polygon' ELSE 'box' END AS kind, count(DISTINCT inst) AS n, round(sum(CASE WHEN inst % 2 = 1 THEN x END), 4) AS across, round(sum(CASE WHEN inst % 2 = 1 THEN y END), 4) AS down
    FROM skewed_vertex GROUP BY ALL""", "instance", "vertex", "skewed_vertex")
def yolo_polygons(spark, d):
    """Boxes and polygons in turn, blank lines and classes outside the mapping between them."""
    v = X.skewed_vertex(spark, d).groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("r"))
    cls = F.when(F.col("inst") % 3 == 0, 14).when(F.col("inst") % 3 == 1, 12).otherwise(10).cast("string")
    polygon = F.array_join(F.flatten(F.transform("r", lambda p: F.array((p["x"] / 128).cast("string"), (p["y"] / 128).cast("string")))), " ")
    line = F.concat(cls, F.lit("  "), F.when(F.col("inst") % 2 == 1, polygon).otherwise("0.5 0.5 0.25 0.25"), F.lit(" "))
    lines = v.select(line.alias("value")).unionByName(v.select(F.when(F.col("inst") % 4 == 0, "").otherwise("77 0.5 0.5 0.1 0.1").alias("value")))
    x = readers.read_yolo(*written(lines), {14: 3, 12: 4, 10: 2}, 128, 128)
    place = lambda odd: F.aggregate(F.filter("coords", lambda c, i: i % 2 == odd), F.lit(0.0), lambda s, c: s + c)
    polygon = F.col("kind") == "polygon"
    return x.groupBy("cls", "kind").agg(F.count("*").alias("n"), F.round(F.sum(F.when(polygon, place(0))), 4).alias("across"), F.round(F.sum(F.when(polygon, place(1))), 4).alias("down"))


@query(
    """WITH v AS (SELECT p_partkey % 25 AS mesh, p_partkey // 25 AS vid, p_size FROM part), f AS (SELECT mesh, vid - 3 AS a, vid - 2 AS b, vid - 1 AS c FROM v WHERE vid >= 3 AND vid % 2 = 1 UNION ALL SELECT mesh, vid - 3, vid - 1, vid FROM v WHERE vid >= 3 AND vid % 2 = 1
    UNION ALL SELECT mesh, vid - 2, vid - 1, vid FROM v WHERE vid >= 3 AND vid % 2 = 0)
    SELECT mesh, vertices, height, triangles, corners FROM (SELECT mesh, count(*) AS vertices, sum(p_size * vid)::DOUBLE AS height FROM v GROUP BY mesh) JOIN (SELECT mesh, count(*) AS triangles, sum(a + 2 * b + 3 * c)::BIGINT AS corners FROM f GROUP BY mesh) USING (mesh)""")
def obj_faces(spark, d):
    """Parts as corners of 25 meshes, with triangles and quads over neighbouring ones in all the forms a face may have."""
    p = X.table(spark, d, "part").selectExpr("p_partkey % 25 AS mesh", "p_partkey div 25 AS vid", "double(p_size) AS p_size")
    corner = p.select("mesh", F.lit(0).alias("kind"), "vid", F.concat_ws("  ", F.lit("v"), F.lit("0.5"), F.lit("-1"), F.col("p_size")).alias("value"))
    quad = F.concat_ws(" ", F.lit("f"), F.concat(F.col("vid") - 2, F.lit("/1/1")), F.concat(F.col("vid") - 1, F.lit("//2")), F.concat("vid", F.lit("/3")), F.col("vid") + 1)
    face = p.where("vid >= 3").select("mesh", F.lit(1).alias("kind"), "vid", F.when(F.col("vid") % 2 == 1, quad).otherwise(F.concat_ws(" ", F.lit("f"), F.col("vid") - 1, "vid", F.col("vid") + 1)).alias("value"))
    more = p.where("vid = 0").select("mesh", F.lit(2).alias("kind"), "vid", F.lit("f 1 2 3 4 5").alias("value"))
    path = shared_dir(spark, "files")
    corner.unionByName(face).unionByName(more).repartition("mesh").sortWithinPartitions("mesh", "kind", "vid").select("mesh", "value").write.partitionBy("mesh").text(path)
    v, f = readers.read_obj(spark, path)
    v = v.groupBy("mesh").agg(F.count("*").alias("vertices"), F.sum(F.col("z") * F.col("vid")).alias("height"))
    f = f.groupBy("mesh").agg(F.count("*").alias("triangles"), F.sum(F.col("a") + 2 * F.col("b") + 3 * F.col("c")).cast("long").alias("corners"))
    return v.join(f, "mesh").select(F.col("mesh").cast("long").alias("mesh"), "vertices", "height", "triangles", "corners")


@query("SELECT CASE inst % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 2 END AS cls, 'box' AS kind, count(*) AS n, sum(x1)::DOUBLE AS left_sum FROM instance GROUP BY ALL", "instance")
def yolo_boxes(spark, d):
    i = X.instance(spark, d)
    line = F.concat_ws(" ", F.when(F.col("inst") % 3 == 0, 14).when(F.col("inst") % 3 == 1, 12).otherwise(10), (F.col("x1") + F.col("w") / 2 + 0.25) / 128, (F.col("y1") + F.col("h") / 2 + 0.25) / 128, F.col("w") / 128, F.col("h") / 128)
    x = readers.read_yolo(*written(i.select(line.alias("value"))), {14: 3, 12: 4, 10: 2}, 128, 128)
    return x.groupBy("cls", "kind").agg(F.count("*").alias("n"), F.sum(F.col("coords")[0]).alias("left_sum"))


@query("SELECT count(*)::BIGINT AS vertices, round(sum(p_size), 6) AS total FROM part")
def obj_meshes(spark, d):
    p = X.table(spark, d, "part").select(F.concat_ws(" ", F.lit("v"), F.col("p_size").cast("double"), F.lit("0.5"), F.lit("-1")).alias("value"))
    v, _ = readers.read_obj(*written(p))
    return v.agg(F.count("*").alias("vertices"), r6(F.sum("x"), "total"))


@query("SELECT o_orderkey AS sample_id, round(o_totalprice / 1e6, 6) AS hard_score FROM orders WHERE o_orderkey % 7 <> 0")
def metrics_csv(spark, d):
    o = X.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderkey").cast("string")).alias("sample_id"), F.round(F.col("o_totalprice") / 1e6, 6).alias("hard_score"))
    path = shared_dir(spark, "files")
    o.write.option("header", True).csv(path)
    x = readers.read_metrics(spark, path)
    return E.mine_hard(x, 0).select(F.col("sample_id").cast("long").alias("sample_id"), "hard_score")


@query("SELECT inst AS facet, label AS class_id, round(score, 6) AS confidence FROM instance", "instance")
def feature_collection(spark, d):
    """Facets as GeoJSON features, a line each, and back."""
    i = X.instance(spark, d).selectExpr("inst", "inst AS instance_id", "label AS class_id", "score AS confidence")
    path = shared_dir(spark, "files")
    writers.write_features(i, X.vertex(spark, d), "inst", path)
    x = readers.read_feature_lines(spark, path)
    return x.select("facet", F.col("class_id").cast("long").alias("class_id"), r6("confidence", "confidence"))


@query("SELECT event_id AS iter, 'train' AS mode, user_id AS run, round(value, 6) AS value FROM events")
def json_log(spark, d):
    e = X.table(spark, d, "events").select(F.to_json(F.struct(F.col("event_id").alias("iter"), F.round("value", 6).alias("loss"), F.col("user_id").alias("run"))).alias("value"))
    x = readers.read_log(*written(e.unionByName(e.limit(3).select(F.lit("not a record").alias("value")))))
    wide = x.groupBy("iter", "mode").agg(F.max(F.when(F.col("key") == "run", F.col("value"))).cast("long").alias("run"), F.max(F.when(F.col("key") == "loss", F.col("value"))).alias("value"))
    return wide.select("iter", "mode", "run", r6("value", "value"))


@query()
def file_inventory(spark, d):
    """The files of the data set itself, by extension."""
    return readers.list_files(spark, d).groupBy("ext").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("depth").alias("depth"))


CONVENTION = """SELECT '/d' || doc_id % 3 AS dir, 's' || doc_id AS sample_id, '/d' || doc_id % 3 || '/s' || doc_id || '_rgb.jpg' AS image_path, '/d' || doc_id % 3 || '/s' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '_mask.jpg' ELSE '_mask.png' END AS mask_path,
    CASE WHEN doc_id % 5 = 0 THEN '/d' || doc_id % 3 || '/s' || doc_id || '_normal.npy' END AS normal_path FROM documents WHERE doc_id % 6 <> 1"""


@query(CONVENTION)
def indexed_by_convention(spark, d):
    """File names that follow a convention, derived from document ids, as samples."""
    x = X.table(spark, d, "documents").selectExpr("concat('/d', doc_id % 3, '/s', doc_id) AS p", "doc_id")
    names = x.selectExpr("explode(array_compact(array(concat(p, '_rgb.jpg'), if(doc_id % 6 <> 1, concat(p, if(doc_id % 4 = 0, '_mask.jpg', '_mask.png')), NULL), if(doc_id % 5 = 0, concat(p, '_normal.npy'), NULL)))) AS path")
    return M.index_by_convention(names)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '/a/' || doc_id || '.png' WHEN doc_id % 3 = 0 THEN '/b/' || doc_id || '.png' WHEN doc_id % 5 = 0 THEN '/c/' || doc_id || '.jpg' END AS found FROM documents")
def resolved_paths(spark, d):
    x = X.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("sample_id"))
    wanted = x.withColumns({"first": F.concat(F.lit("/a/"), "sample_id", F.lit(".png")), "second": F.concat(F.lit("/b/"), "sample_id", F.lit(".png"))})
    part = lambda where, folder, suffix, rank: x.where(where).select(F.concat(F.lit(folder), "sample_id", F.lit(suffix)).alias("path"), F.col("sample_id").alias("stem"), F.lit(rank).alias("suffix_rank"))
    files = part("doc_id % 2 = 0", "/a/", ".png", 0).unionByName(part("doc_id % 3 = 0", "/b/", ".png", 0)).unionByName(part("doc_id % 5 = 0", "/c/", ".jpg", 1))
    return M.resolve_paths(wanted, files, ["first", "second"]).select("doc_id", "found")


@query("SELECT count(*) AS images, (SELECT count(*) FROM instance) AS annotations, (SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM instance)) AS classes FROM (SELECT DISTINCT scene FROM instance)", "instance")
def annotation_counts(spark, d):
    """Pictures, annotations and classes of annotation documents."""
    images, rings = readers.read_coco_lines(*written(annotation_documents(spark, d, "label").select("value")))
    classes = rings.select("category_id").distinct().agg(F.array_join(F.array_sort(F.collect_list("category_id")), ",").alias("classes"))
    return images.agg(F.countDistinct("id").alias("images")).crossJoin(rings.agg(F.count("*").alias("annotations"))).crossJoin(classes)  # one row each


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 'panels' WHEN 1 THEN 'roof' ELSE 'tree' END AS title, count(*) AS n, sum(p_size)::BIGINT AS left_sum, sum(strlen(p_name))::BIGINT AS bytes FROM part GROUP BY ALL")
def bitmap_objects(spark, d):
    """A document with one encoded bitmap for each part; parts of every eleventh key also have an object without one."""
    p = X.table(spark, d, "part")
    title = F.when(F.col("p_partkey") % 3 == 0, "panels").when(F.col("p_partkey") % 3 == 1, "roof").otherwise("tree")
    bitmap = F.struct(F.array(F.col("p_size").cast("int"), F.lit(7)).alias("origin"), F.base64(F.col("p_name").cast("binary")).alias("data"))
    plain = F.struct(title.alias("classTitle"), bitmap.alias("bitmap"))
    bare = F.struct(title.alias("classTitle"), F.lit(None).cast(p.select(bitmap.alias("b")).schema["b"].dataType).alias("bitmap"))
    objects = F.when(F.col("p_partkey") % 11 == 0, F.array(plain, bare)).otherwise(F.array(plain))
    doc = F.to_json(F.struct(F.struct(F.lit(128).alias("height"), F.lit(128).alias("width")).alias("size"), objects.alias("objects")))
    spark, path = written(p.select(doc.alias("value")))
    x = readers.read_bitmap_lines(spark, path)
    return x.groupBy("title").agg(F.count("*").alias("n"), F.sum("origin_x").alias("left_sum"), F.sum(F.length("data")).alias("bytes"))


@query("SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 9 <> 0")
def candidate_list(spark, d):
    """Candidate pictures as lines of text, some blank."""
    line = F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.concat(F.lit(" /p/"), "doc_id", F.lit(".png ")))
    x = readers.read_candidates(*written(X.table(spark, d, "documents").select(line.alias("value"))))
    return x.agg(F.count("*").alias("n"), F.sum(F.regexp_extract("path", r"^/p/(\d+)[.]png$", 1).cast("long")).alias("ids"))


@query("SELECT s_suppkey AS key, CASE WHEN s_suppkey % 4 = 0 THEN 'rejected' ELSE 'promoted' END AS status, round(abs(s_acctbal) / 100, 6) AS v, (s_suppkey % 2)::BIGINT AS part FROM supplier")
def registry_round_trip(spark, d):
    """Suppliers as runs, appended in two goes and read back; those of the first go come first."""
    p = X.table(spark, d, "supplier")
    entry = p.select("s_suppkey", F.concat(F.lit("run-"), "s_suppkey").alias("checkpoint"), F.create_map(F.lit("mIoU"), F.round(F.abs("s_acctbal") / 100, 6)).cast("map<string,double>").alias("metrics"), F.create_map(F.lit("mIoU"), F.lit(85.0)).alias("thresholds"), F.when(F.col("s_suppkey") % 4 == 0, "rejected").otherwise("promoted").alias("status"))
    path = shared_dir(spark, "registry")
    for part in (0, 1):
        writers.append_registry(entry.where(F.col("s_suppkey") % 2 == part).drop("s_suppkey"), path)
    x = readers.read_registry(spark, path)
    first = p.where("s_suppkey % 2 = 0").count()
    return x.select(F.regexp_extract("checkpoint", r"(\d+)", 1).cast("long").alias("key"), "status", r6(F.col("metrics")["mIoU"], "v"), F.when(F.col("seq") < first, 0).otherwise(1).cast("long").alias("part"))


HEIGHTS = f"{MIRROR}, up AS (SELECT sample_id, count(*) AS cells, round(avg(1 / sqrt(dx * dx + dy * dy + 1)), 6) AS nz FROM (SELECT sample_id, ur - ul + 2 * (r - l) + dr - dl AS dx, dl + 2 * dz + dr - ul - 2 * uz - ur AS dy FROM nine) GROUP BY sample_id)"


@query()
def height_pairs(spark, d):
    """Pairs of pictures and height rasters from a CSV file, with the normals of their heights written and read again."""
    p = X.table(spark, d, "part").selectExpr("CAST(p_partkey AS string) AS sample_id", "concat('/i/', p_partkey, '.png') AS image_path", "concat('/h/', p_partkey, '.tif') AS dsm_path", "if(p_partkey % 3 = 0, concat('/m/', p_partkey, '.png'), NULL) AS mask_path")
    path = shared_dir(spark, "pairs")
    p.write.option("header", True).csv(f"{path}/list")
    heights = X.height(spark, d).where("sample_id % 5 <> 0").select(F.col("sample_id").cast("string").alias("sample_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "z")
    heights.unionByName(heights.where("y = 0 AND x = 0").withColumns({"y": F.lit(99), "z": F.lit(float("nan"))})).write.parquet(f"{path}/heights")
    m = writers.write_height_pairs(readers.read_pairs(spark, f"{path}/list"), readers.scan_height(spark, f"{path}/heights"), path)
    up = spark.read.parquet(f"{path}/normal").groupBy("sample_id").agg(r6(F.avg("nz"), "nz"))
    x = m.join(up, "sample_id", "left")
    return x.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("mask_path").isNotNull().alias("masked"), F.col("normal_path").isNotNull().alias("found"), "cells", "nz")


SQL["height_pairs"] = with_more(("height",), HEIGHTS, "SELECT p_partkey AS sample_id, p_partkey % 3 = 0 AS masked, p_partkey % 5 <> 0 AS found, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE cells END AS cells, CASE WHEN p_partkey % 5 <> 0 THEN nz END AS nz FROM part LEFT JOIN up ON sample_id = p_partkey")


@query("SELECT CASE WHEN scene % 10 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n_rows, sum(x1 - x0)::BIGINT AS cells FROM run GROUP BY ALL", "instance", "run")
def runs_by_split(spark, d):
    """Label runs written in a folder for each split and read back."""
    path = shared_dir(spark, "runs")
    r = X.run(spark, d).select(F.col("scene").alias("sample_id"), "y", "x0", "x1", F.when(F.col("scene") % 10 == 0, "val").otherwise("train").alias("split"))
    writers.write_runs(r, path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n_rows"), F.sum(F.col("x1") - F.col("x0")).alias("cells"))


METRIC = "metric AS (SELECT o_orderkey AS sample_id, round((o_orderkey * 37 % 100) / 100::DOUBLE, 2) AS roof_iou, round((o_orderkey * 53 % 100) / 100::DOUBLE, 2) AS bfscore, round(o_totalprice / 1e6, 6) AS hard_score FROM orders)"


def metric(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "orders").selectExpr("o_orderkey AS sample_id", "round((o_orderkey * 37 % 100) / 100D, 2) AS roof_iou", "round((o_orderkey * 53 % 100) / 100D, 2) AS bfscore", "round(o_totalprice / 1e6, 6) AS hard_score")


@query()
def written_metrics(spark, d):
    """Metrics and the ids of the hundred hardest samples as files; ranks of these by id."""
    path = shared_dir(spark, "metrics")
    writers.write_metrics(metric(spark, d), path, 100)
    hard = spark.read.text(f"{path}/hard_ids").select(F.col("value").alias("sample_id"))
    x = readers.read_metrics(spark, f"{path}/metrics")
    return x.join(hard.withColumn("hard", F.lit(True)), "sample_id", "left").select(F.col("sample_id").cast("long").alias("sample_id"), r6("roof_iou", "roof_iou"), r6("hard_score", "hard_score"), F.coalesce("hard", F.lit(False)).alias("hard"))


SQL["written_metrics"] = f"WITH {METRIC} SELECT sample_id, roof_iou, hard_score, row_number() OVER (ORDER BY hard_score DESC, sample_id) <= 100 AS hard FROM metric"


@query()
def error_report(spark, d):
    """The report of all metrics, with how many of them are outliers."""
    m = metric(spark, d)
    long = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in ("roof_iou", "bfscore", "hard_score")])).alias("e")).select("e.*")
    iou = m.groupBy((F.col("sample_id") % 5).cast("int").alias("cls")).agg(F.avg("roof_iou").alias("iou"))
    return writers.error_report(m, iou, 30, E.robust_outliers(long, ["measure"], "v", 1.2))


SQL["error_report"] = f"""WITH {METRIC}, long AS (SELECT 'roof_iou' AS measure, roof_iou AS v FROM metric UNION ALL SELECT 'bfscore', bfscore FROM metric UNION ALL SELECT 'hard_score', hard_score FROM metric)
    SELECT 'summary' AS section, 'samples' AS key, count(*)::VARCHAR AS value FROM metric UNION ALL SELECT 'summary', 'roof_iou', printf('%.2f', avg(roof_iou) * 100) FROM metric UNION ALL SELECT 'summary', 'bfscore', printf('%.2f', avg(bfscore) * 100) FROM metric
    UNION ALL SELECT 'class_iou', (sample_id % 5)::VARCHAR, printf('%.2f', avg(roof_iou) * 100) FROM metric GROUP BY sample_id % 5
    UNION ALL SELECT 'hardest', sample_id::VARCHAR, printf('%.4f', hard_score) FROM (SELECT * FROM metric ORDER BY hard_score DESC, sample_id LIMIT 30)
    UNION ALL SELECT 'outliers', measure, sum((abs(v - m) / (1.4826 * greatest(mad, 1e-6::DOUBLE)) > 1.2)::INT)::BIGINT::VARCHAR FROM (SELECT *, quantile_cont(abs(v - m), 0.5) OVER (PARTITION BY measure) AS mad FROM (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY measure) AS m FROM long)) GROUP BY measure"""


@query()
def line_graph_files(spark, d):
    """The line graph as three tables, read back: each node's neighbours in both directions."""
    path = shared_dir(spark, "graph")
    seg = materialize(segments(spark, d), "segments")
    node, edge = G.line_graph(seg, "scene", 0.5)
    writers.write_graph(node, edge, seg, path)
    both = writers.adjacency(spark.read.parquet(f"{path}/edge"))
    degree = both.groupBy("scene").agg(F.count("*").alias("ends"), F.sum("a").alias("sum_a"))
    return spark.read.parquet(f"{path}/segment").groupBy("scene").agg(F.count("*").alias("lines")).join(degree, "scene")


# Corners have whole coordinates, so within half a cell only equal corners are one node.
SQL["line_graph_files"] = with_more(VERTS, RING, f"""SELECT scene, "lines", ends, sum_a FROM (SELECT scene, count(*) AS "lines" FROM seg GROUP BY scene) JOIN (SELECT scene, count(*) AS ends, sum(a)::BIGINT AS sum_a FROM (SELECT scene, a, b FROM link UNION SELECT scene, b, a FROM link) GROUP BY scene) USING (scene)""").replace(RING, RING + f""", seg AS (SELECT * FROM ({SEGMENTS})),
    fin AS (SELECT scene, seg, seg * 2 AS e, x1 AS x, y1 AS y FROM seg UNION ALL SELECT scene, seg, seg * 2 + 1, x2, y2 FROM seg), own AS (SELECT *, min(e) OVER (PARTITION BY scene, x, y) AS node FROM fin),
    link AS (SELECT scene, min(node) AS a, max(node) AS b FROM own GROUP BY scene, seg HAVING min(node) <> max(node))""")


@query("SELECT 'sha256' AS kind, doc_id::VARCHAR AS key, sha256(coalesce(text, '')) AS value FROM documents UNION ALL SELECT 'fact', 'rule', 'v1' UNION ALL SELECT 'fact', 'seed', '42'")
def run_manifest(spark, d):
    """Facts of a run and the digest of every input, documents standing for files."""
    files = X.table(spark, d, "documents").select(F.concat(F.lit("/in/"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return writers.run_manifest(files, seed=42, rule="v1")


@query("SELECT user_id AS run, event_type AS key, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL")
def json_line_profiles(spark, d):
    """Profiles of runs as JSON lines, read back."""
    path = shared_dir(spark, "profiles")
    e = X.table(spark, d, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("key")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    writers.write_json_lines(e, path)
    return spark.read.schema("run long, key string, mean double, n long").json(path).select("run", "key", r6("mean", "mean"), "n")


@query("SELECT inst AS facet, round(degrees(acos(least(abs(nz), 1))), 6) AS slope_deg FROM normal WHERE inst % 6 <> 0", "instance", "normal")
def displayed_features(spark, d):
    """Features with a slope; those without one, or with a negative mark, are not shown."""
    n = X.normal(spark, d).select(F.col("inst").alias("facet"), r6(F.when(F.col("inst") % 12 == 0, -1.0).when(F.col("inst") % 6 != 0, G.slope(F.col("nz"))), "slope_deg"))
    return V.displayed(n)


@query("SELECT source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source FROM documents) WHERE doc_id % 5 <> 0 GROUP BY source")
def union_with_files(spark, d):
    """Two parts of the documents as named sources, without the samples whose file is missing."""
    docs = X.table(spark, d, "documents").select("doc_id", F.concat(F.lit("/i/"), "doc_id").alias("image_path"))
    both = M.union_sources({"even": docs.where("doc_id % 2 = 0"), "odd": docs.where("doc_id % 2 = 1")})
    files = docs.where("doc_id % 5 <> 0").select(F.col("image_path").alias("path"))
    return M.require_files(both, files, "image_path").groupBy("source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT sample_id, sum(round(0.299 * z * 10 + 0.587 * y + 0.114 * x))::DOUBLE AS grey, round(sum(floor((z / 17 + 1) * 127.5) / 127.5 - 1), 4) AS normal FROM height GROUP BY sample_id", "height")
def grey_and_decoded(spark, d):
    """Luminance of three bands, and normals as bytes and back."""
    # a little is added because exact halves round by engine
    g = T.grey(F.col("z") * 10 + 1e-7, F.col("y"), F.col("x"))
    n = T.decode_normal(T.encode_normal(F.col("z") / 17))
    return X.height(spark, d).groupBy("sample_id").agg(F.sum(g).alias("grey"), (F.round(F.sum(n), 4) + F.lit(0.0)).alias("normal"))


@query("SELECT label + 7 AS cls, sum(w * h)::BIGINT AS cells, count(DISTINCT scene) AS samples FROM instance WHERE label > 0 GROUP BY label", "instance")
def invalid_ids(spark, d):
    """Cells with an id that is no class."""
    r = X.run(spark, d).select(F.col("scene").alias("sample_id"), F.when(F.col("label") == 0, 1).otherwise(F.col("label") + 7).cast("long").alias("cls"), "y", "x0", "x1")
    return A.invalid_ids(r)
