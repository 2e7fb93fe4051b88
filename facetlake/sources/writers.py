"""Writers: split lists, features, metrics, registries, graphs and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlake.operators.manifest import holdout
from facetlake.operators.stencils import sobel_normals
from facetlake.sources.readers import read_registry
from facetlake.storage import materialize


def write_split(ids: DataFrame, path: str, share: int = 10, legacy: bool = False) -> None:
    """``train`` and ``val`` lists, one id a line in order of id; disjoint unless ``legacy``."""
    parts = holdout(ids, share, legacy)
    for part in ("train", "val"):
        parts.where(F.col("part") == part).select("sample_id").orderBy("sample_id").write.mode("overwrite").text(f"{path}/{part}")


def write_runs(runs: DataFrame, path: str, split_col: str = "split") -> None:
    """Label or instance runs, a folder for each split, sorted so that row groups hold few samples."""
    runs.sortWithinPartitions("sample_id", "y", "x0").write.mode("overwrite").partitionBy(split_col).parquet(path)


def feature_lines(facets: DataFrame, vertices: DataFrame, key: str, least_area: float = 1.0) -> DataFrame:
    """``(value)``: one GeoJSON feature a line; facets with fewer than three corners or too small a ring go. Every other facet column is a property."""
    ring = vertices.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("r")).where(F.size("r") >= 3)
    at = F.transform("r", lambda p: F.array(p["x"], p["y"]))
    closed = F.concat(at, F.array(F.element_at(at, 1)))
    twice = F.aggregate(F.zip_with(F.slice(closed, F.lit(1), F.size("r")), F.slice(closed, F.lit(2), F.size("r")), lambda a, b: a[0] * b[1] - b[0] * a[1]), F.lit(0.0), lambda s, v: s + v)
    x = facets.join(ring, key).where(F.abs(twice) / 2 >= least_area)
    properties = F.struct(*[F.col(c) for c in facets.columns])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    return x.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value"))


#: Features that one document may hold.
ONE_DOCUMENT = 100_000


def write_features(facets: DataFrame, vertices: DataFrame, key: str, path: str, one_document: bool = False) -> None:
    """Features line by line in parallel; ``one_document`` makes a single collection of a small result and refuses more than ``ONE_DOCUMENT`` features, which are for lines."""
    lines = feature_lines(facets, vertices, key)
    if one_document:
        if lines.limit(ONE_DOCUMENT + 1).count() > ONE_DOCUMENT:
            raise ValueError(f"more than {ONE_DOCUMENT} features: write them line by line")
        lines = lines.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]}")).alias("value"))
    lines.write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str, k: int) -> None:
    """Metrics by falling hard score as CSV, and the ids of the ``k`` hardest."""
    rows = metrics.orderBy(F.desc("hard_score"), "sample_id")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/metrics")
    rows.limit(max(k, 0)).select(F.col("sample_id").cast("string").alias("sample_id")).write.mode("overwrite").text(f"{path}/hard_ids")


def error_report(metrics: DataFrame, iou: DataFrame, k: int = 30, outliers: DataFrame | None = None) -> DataFrame:
    """``(section, key, value)``: means in percent, IoU by class, the hardest samples, and how many values of each measure are ``outliers(measure, outlier)``."""
    percent = lambda c: F.format_string("%.2f", F.coalesce(c, F.lit(0.0)) * 100)
    mean = metrics.agg(F.count("*").alias("n"), F.avg("roof_iou").alias("i"), F.avg("bfscore").alias("b"))
    summary = mean.select(F.explode(F.array(*[F.struct(F.lit("summary").alias("section"), F.lit(k_).alias("key"), v.alias("value")) for k_, v in (("samples", F.col("n").cast("string")), ("roof_iou", percent(F.col("i"))), ("bfscore", percent(F.col("b"))))])).alias("r")).select("r.*")
    by_class = iou.select(F.lit("class_iou").alias("section"), F.col("cls").cast("string").alias("key"), percent(F.col("iou")).alias("value"))
    hard = metrics.orderBy(F.desc("hard_score"), "sample_id").limit(k).select(F.lit("hardest").alias("section"), F.col("sample_id").cast("string").alias("key"), F.format_string("%.4f", "hard_score").alias("value"))
    report = summary.unionByName(by_class).unionByName(hard)
    if outliers is None:
        return report
    counts = outliers.groupBy("measure").agg(F.sum(F.col("outlier").cast("int")).alias("n"))
    return report.unionByName(counts.select(F.lit("outliers").alias("section"), F.col("measure").alias("key"), F.col("n").cast("string").alias("value")))


def append_registry(entries: DataFrame, path: str) -> None:
    """Entries ``(checkpoint, metrics, thresholds, status)`` after those that are there, by order of checkpoint; the file is one JSON array, as ``read_registry`` takes it. A registry holds runs, so it is small."""
    names = ["checkpoint", "metrics", "thresholds", "status"]
    old = materialize(read_registry(entries.sparkSession, path).select(F.lit(0).alias("part"), "seq", *names), "registry")
    new = entries.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy("checkpoint")).alias("seq"), *names)
    lines = old.unionByName(new).select(F.struct("part", "seq", F.to_json(F.struct(*names)).alias("value")).alias("e"))
    whole = lines.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["value"]), ","), F.lit("]")).alias("value"))
    whole.write.mode("overwrite").text(path)


#: Height cells that one task sorts.
TASK_CELLS = 1 << 20


def write_height_pairs(pairs: DataFrame, heights: DataFrame, path: str) -> DataFrame:
    """Pseudo ground truth of ``pairs(sample_id, image_path, dsm_path, mask_path)``: finite ``heights`` (``sample_id, y, x, z``) of each pair and their normals as Parquet below ``path``.

    Returns the manifest ``(sample_id, image_path, mask_path, depth_path, normal_path, cells)``, one row a pair; pairs without a height have null paths.
    """
    keys = pairs.select("sample_id").distinct()
    # as many tasks as the cells need; whatever follows stays in them
    depth = heights.repartition(max(1, -(-heights.count() // TASK_CELLS)), "sample_id").join(keys.hint("merge"), "sample_id", "left_semi")
    normal = sobel_normals(depth, ["sample_id"])
    for name, t in (("depth", depth), ("normal", normal)):
        t.sortWithinPartitions("sample_id", "y", "x").write.mode("overwrite").parquet(f"{path}/{name}")
    spark = pairs.sparkSession
    done = spark.read.parquet(f"{path}/normal").groupBy("sample_id").agg(F.count("*").alias("cells"))
    x = pairs.join(done, "sample_id", "left")
    there = lambda name: F.when(F.col("cells").isNotNull(), F.concat(F.lit(f"{path}/{name}#"), F.col("sample_id")))
    return x.select("sample_id", "image_path", "mask_path", there("depth").alias("depth_path"), there("normal").alias("normal_path"), F.coalesce("cells", F.lit(0)).alias("cells"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    return edges.unionByName(edges.selectExpr(*[c for c in edges.columns if c not in ("a", "b")], "b AS a", "a AS b")).distinct()


def write_graph(node: DataFrame, edge: DataFrame, segment: DataFrame, path: str) -> None:
    for name, t in (("node", node), ("edge", edge), ("segment", segment)):
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def run_manifest(files: DataFrame, **facts: str) -> DataFrame:
    """``(kind, key, value)``: facts of a run and the SHA-256 of its input files (``path, content``)."""
    hashes = files.select(F.lit("sha256").alias("kind"), F.regexp_extract("path", r"([^/]*)$", 1).alias("key"), F.sha2("content", 256).alias("value"))
    rows = files.sparkSession.createDataFrame([("fact", k, str(v)) for k, v in sorted(facts.items())], "kind string, key string, value string")
    return rows.unionByName(hashes)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Profiles and inventories: each row as one JSON object."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)
