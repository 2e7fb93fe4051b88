"""Readers: text, JSON, CSV and file listings to the library's tables, with fixed schemas and no inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.storage import materialize

SPACE = r"^\s+|\s+$"
COCO = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,segmentation:variant,area:double,bbox:array<double>,iscrowd:int>>, categories array<struct<id:int,name:string>>"
BITMAP = "size struct<height:int,width:int>, objects array<struct<classTitle:string,bitmap:struct<origin:array<int>,data:string>>>"
FEATURES = "features array<struct<properties:struct<instance_id:bigint,polygon_id:bigint,class_id:int,class_name:string,confidence:double,geometry_confidence:double,slope_deg:double,azimuth_deg:double,normal:array<double>>>>"
METRICS = "sample_id string, roof_iou string, bfscore string, hard_score string"


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern matches anything, asked of the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line_no, value)``: lines of each file, counted from 0.

    A large file is read in blocks by many tasks. A block's lines are counted, the blocks before it make
    its first number, and lines are numbered inside their block.
    """
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"), "value")
    x = materialize(x, "lines")
    sizes = x.groupBy("path", "__block").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    x = x.join(sizes.select("path", "__block", F.coalesce(before, F.lit(0)).alias("__before")), ["path", "__block"])
    number = F.col("__before") + F.row_number().over(Window.partitionBy("path", "__block").orderBy("__at")) - 1
    return x.select("path", number.cast("long").alias("line_no"), "value")


def read_split(spark: SparkSession, path: str, drop_blank: bool = True) -> DataFrame:
    """``(sample_id, line_no)`` with all surrounding white space gone; a missing file is an empty split."""
    if not _exists(spark, path):
        return _empty(spark, "sample_id string, line_no long")
    x = read_lines(spark, path).select(F.regexp_replace("value", SPACE, "").alias("sample_id"), "line_no")
    return x.where("sample_id <> ''") if drop_blank else x


def read_coco(spark: SparkSession, path: str, least_numbers: int = 6) -> tuple[DataFrame, DataFrame]:
    """``images(id, file_name, width, height)`` and ``rings(image_id, ann_no, ring_no, category_id, verts)``.

    A segmentation is a flat list (one ring) or a list of lists; anything else gives no ring, nor do
    rings of fewer than ``least_numbers`` numbers. Annotations without an image id go.
    """
    return _coco(spark.read.schema(COCO).option("multiLine", True).json(path), least_numbers)


def read_coco_lines(spark: SparkSession, path: str, least_numbers: int = 6) -> tuple[DataFrame, DataFrame]:
    """As ``read_coco`` for files that hold one document a line, which many tasks can read."""
    return _coco(spark.read.schema(COCO).json(path), least_numbers)


def _coco(doc: DataFrame, least_numbers: int) -> tuple[DataFrame, DataFrame]:
    images = doc.select(F.explode("images").alias("i")).select("i.*")
    ann = doc.select(F.posexplode("annotations").alias("ann_no", "a")).where("a.image_id is not null")
    many = F.try_variant_get("a.segmentation", "$", "array<array<double>>")
    one = F.try_variant_get("a.segmentation", "$", "array<double>")
    rings = F.when(many.isNotNull() & F.coalesce(F.exists(many, lambda r: r.isNotNull()), F.lit(False)), many).when(one.isNotNull(), F.array(one))
    x = ann.select(F.col("a.image_id").alias("image_id"), "ann_no", F.col("a.category_id").alias("category_id"), F.posexplode(rings).alias("ring_no", "r")).where(F.size("r") >= least_numbers)
    pair = lambda i: F.struct(F.element_at("r", (2 * i + 1).cast("int")).alias("x"), F.element_at("r", (2 * i + 2).cast("int")).alias("y"))
    verts = F.transform(F.sequence(F.lit(0), (F.floor(F.size("r") / 2) - 1).cast("int")), pair)
    return images, x.select("image_id", "ann_no", "ring_no", "category_id", verts.alias("verts"))


def ring_vertices(rings: DataFrame) -> DataFrame:
    """``(image_id, ann_no, ring_no, ord, x, y)``, coordinates as whole numbers as drawing takes them."""
    return rings.select("image_id", "ann_no", "ring_no", F.posexplode("verts").alias("ord", "p")).select("image_id", "ann_no", "ring_no", "ord", F.rint("p.x").alias("x"), F.rint("p.y").alias("y"))


def read_bitmap_json(spark: SparkSession, path: str) -> DataFrame:
    """``(image, title, origin_x, origin_y, data, height, width)`` of objects with an encoded bitmap; others go."""
    return _bitmaps(spark.read.schema(BITMAP).option("multiLine", True).json(path))


def read_bitmap_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_bitmap_json`` for files that hold one document a line, which many tasks can read."""
    return _bitmaps(spark.read.schema(BITMAP).json(path))


def _bitmaps(doc: DataFrame) -> DataFrame:
    x = doc.select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1).alias("image"), "size", F.explode("objects").alias("o")).where("o.bitmap.data is not null and o.bitmap.origin is not null")
    return x.select("image", F.col("o.classTitle").alias("title"), F.col("o.bitmap.origin")[0].alias("origin_x"), F.col("o.bitmap.origin")[1].alias("origin_y"), F.unbase64("o.bitmap.data").alias("data"), "size.height", "size.width")


def read_yolo(spark: SparkSession, path: str, mapping: dict[int, int], height: int, width: int) -> DataFrame:
    """``(image, line_no, cls, kind, coords)`` in cells: more than five numbers are a polygon, five a box by its corners cut to whole numbers. Unmapped classes go."""
    x = read_lines(spark, path).select(F.regexp_extract("path", r"([^/]*)\.txt$", 1).alias("image"), "line_no", F.split(F.regexp_replace("value", SPACE, ""), r"\s+").alias("t")).where(F.size("t") >= 5)
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    x = x.withColumn("cls", F.try_element_at(m, F.expr("try_cast(t[0] AS int)"))).where("cls is not null")
    n = F.transform(F.slice("t", F.lit(2), F.size("t") - 1), lambda v: v.cast("double"))
    scaled = F.transform(n, lambda v, i: v * F.when(i % 2 == 0, width).otherwise(height))
    cx, cy, w, h = (n[i] * (width if i % 2 == 0 else height) for i in range(4))
    corners = F.transform(F.array(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2), lambda v: v.cast("int").cast("double"))
    return x.select("image", "line_no", "cls", F.when(F.size("t") > 5, "polygon").otherwise("box").alias("kind"), F.when(F.size("t") > 5, scaled).otherwise(corners).alias("coords"))


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``vertex(mesh, vid, x, y, z)`` and ``face(mesh, fid, part, a, b, c)``, ids from 0 in file order; quads split in two, other faces go.

    A mesh is named by its ``.obj`` file, or by the folder ``mesh=NAME`` in which its one file lies.
    """
    mesh = F.coalesce(F.nullif(F.regexp_extract("path", r"([^/]*)\.obj$", 1), F.lit("")), F.regexp_extract("path", r"/mesh=([^/]*)/", 1))
    x = read_lines(spark, path).select(mesh.alias("mesh"), "line_no", F.split(F.regexp_replace("value", SPACE, ""), r"\s+").alias("t"))
    order = Window.partitionBy("mesh").orderBy("line_no")
    v = x.where("t[0] = 'v'").select("mesh", (F.row_number().over(order) - 1).alias("vid"), *[F.col("t")[i].cast("double").alias(c) for i, c in enumerate("xyz", 1)])
    ids = F.transform(F.slice("t", F.lit(2), F.size("t") - 1), lambda s: F.split(s, "/")[0].cast("int") - 1)
    f = x.where("t[0] = 'f'").select("mesh", (F.row_number().over(order) - 1).alias("fid"), ids.alias("i"))
    i = F.col("i")
    parts = F.when(F.size("i") == 3, F.array(F.array(i[0], i[1], i[2]))).when(F.size("i") == 4, F.array(F.array(i[0], i[1], i[2]), F.array(i[0], i[2], i[3])))
    return v, f.select("mesh", "fid", F.posexplode(parts).alias("part", "p")).select("mesh", "fid", "part", *[F.col("p")[k].alias(c) for k, c in enumerate("abc")])


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, path)`` of candidate pictures from a JSON list, a JSON object's ``inputs``, or a text file's lines; none at all is an error when it is read."""
    if path.endswith(".json"):
        text = spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "inputs array<string>")["inputs"]).alias("p"))
        x = text.select(F.posexplode_outer("p").alias("idx", "path")).withColumn("idx", F.col("idx").cast("long"))
    else:
        x = read_lines(spark, path).select(F.col("line_no").alias("idx"), F.col("value").alias("path"))
    x = x.withColumn("path", F.regexp_replace("path", SPACE, "")).where("length(path) > 0")
    if x.isEmpty():
        raise ValueError(f"no candidate in {path}")
    return x


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows of a CSV file: a blank id or a hard score that is no number drops the row, a missing number is 0."""
    head = spark.read.option("header", True).csv(path)
    x = head.select(*[(F.col(c) if c in head.columns else F.lit(None).cast("string")).alias(c) for c in ("sample_id", "roof_iou", "bfscore", "hard_score")])
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    x = x.where("length(trim(sample_id)) > 0")
    if "hard_score" in head.columns:
        x = x.where(number("hard_score").isNotNull())
    return x.select("sample_id", *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in ("roof_iou", "bfscore", "hard_score")])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``facet`` rows of feature collections: the id is the instance's, else the polygon's; so with confidences."""
    doc = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.input_file_name().alias("path"), F.explode("features.properties").alias("p"))
    return doc.select("path", F.coalesce("p.instance_id", "p.polygon_id").alias("facet"), "p.class_id", "p.class_name", F.coalesce("p.geometry_confidence", "p.confidence").alias("confidence"), "p.slope_deg", "p.azimuth_deg", "p.normal")


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_features`` for files that hold one feature a line."""
    p = T.StructType.fromDDL(FEATURES)["features"].dataType.elementType["properties"]
    x = spark.read.schema(T.StructType([p])).json(path).select(F.col("properties").alias("p"))
    return x.select(F.coalesce("p.instance_id", "p.polygon_id").alias("facet"), "p.class_id", "p.class_name", F.coalesce("p.geometry_confidence", "p.confidence").alias("confidence"), "p.slope_deg", "p.azimuth_deg", "p.normal")


REGISTRY = "struct<checkpoint:string,metrics:map<string,double>,thresholds:map<string,double>,status:string>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, checkpoint, metrics, thresholds, status)`` of a JSON array; any other file, or none, is an empty registry."""
    if not _exists(spark, path):
        return _empty(spark, f"seq int, {REGISTRY.removeprefix('struct<').removesuffix('>')}")
    x = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<{REGISTRY}>").alias("e"))
    return x.select(F.posexplode("e").alias("seq", "e")).select("seq", "e.*").where("checkpoint is not null or metrics is not null or status is not null")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``(path, iter, mode, key, value)`` of JSON lines; other lines go, the mode defaults to train and the step to 0. Large files are read by many tasks."""
    parsed = F.from_json("value", "map<string,string>")
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), parsed.alias("m")).where("m is not null")
    get = lambda k: F.try_element_at("m", F.lit(k))
    step = F.coalesce(get("iter").cast("long"), get("step").cast("long"), F.lit(0))
    rows = x.select("path", step.alias("iter"), F.coalesce(get("mode"), F.lit("train")).alias("mode"), F.explode("m").alias("key", "text"))
    return rows.withColumn("value", F.expr("try_cast(text AS double)")).where("value is not null and key not in ('iter', 'step')").drop("text")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, image_path, dsm_path, mask_path)`` of a CSV file with a header."""
    return spark.read.schema("sample_id string, image_path string, dsm_path string, mask_path string").option("header", True).option("mode", "FAILFAST").csv(path)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, dir, name, stem, ext, depth, length, mtime)`` below a folder, names that begin with a dot left out; file contents are not read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("mtime"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    base = F.lit(root.rstrip("/").split(":")[-1].lstrip("/"))
    below: Column = F.call_function("substring_index", F.col("path"), F.concat(base, F.lit("/")), F.lit(-1))
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return x.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.when(ext == "", "no_ext").otherwise(ext).alias("ext"), (F.size(F.split(below, "/")) - 1).alias("depth"), "length", "mtime").where("name not like '.%'")


def scan_height(spark: SparkSession, path: str) -> DataFrame:
    """Finite cells of height rasters kept as Parquet."""
    x = spark.read.schema(T.StructType.fromDDL("sample_id string, y int, x int, z double")).parquet(path)
    return x.where(F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") < float("inf")))
