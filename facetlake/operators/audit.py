"""Audits of a label corpus: class shares, weights, sources and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Titles and ids of the source corpora, and the class that each becomes.
TITLE_CLASS = {"panels": 3, "chimney": 4, "antenna": 4, "window": 4, "secondary structure": 4, "property roof": 2}
YOLO_CLASS = {14: 3, 2: 4, 12: 4, 24: 4, 10: 2}
#: Drawing order of titles, later ones on top.
TITLE_ORDER = {"panels": 10, "chimney": 5, "antenna": 5, "window": 5}


def map_labels(items: DataFrame, mapping: dict, column: str, out: str = "cls") -> DataFrame:
    """Items with the class of their label; labels outside the mapping go. The mapping is a literal of fixed size."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return items.withColumn(out, F.try_element_at(m, F.col(column))).where(F.col(out).isNotNull())


def paint_order(title):
    """Drawing order of a title column; titles without one come first."""
    out = F.lit(0)
    for t, z in TITLE_ORDER.items():
        out = F.when(title == t, z).otherwise(out)
    return out


def class_distribution(runs: DataFrame, frames: DataFrame, keys: list[str], cells: int, classes: int = 5) -> DataFrame:
    """``(cls, cells, samples, share)`` for every class; background is what runs leave of the frames. Ids outside the classes do not count."""
    n = F.sum(F.col("x1") - F.col("x0")).cast("long")
    fine = runs.where(F.col("cls").between(1, classes - 1))
    per = fine.groupBy(*keys, F.col("cls").cast("int").alias("cls")).agg(n.alias("n"))
    covered = per.groupBy(*keys).agg(F.sum("n").alias("n"))
    rest = frames.select(*keys).distinct().join(covered, keys, "left").select(*keys, F.lit(0).alias("cls"), (cells - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    found = per.unionByName(rest).groupBy("cls").agg(F.sum("n").alias("cells"), F.count("*").alias("samples"))
    ids = runs.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    x = ids.join(found, "cls", "left").fillna(0, ["cells", "samples"])
    return x.withColumn("share", F.col("cells") / F.sum("cells").over(Window.partitionBy()))


def class_weights(distribution: DataFrame, top: float = 100.0, background: float = 1.0, no_object: float | None = None) -> DataFrame:
    """``(cls, weight)``: cells of the largest foreground class over the class's own, capped, to one decimal; 1 for background and absent classes. One row a class, and one more after the last for ``no_object``, if given."""
    largest = F.max(F.when(F.col("cls") > 0, F.col("cells"))).over(Window.partitionBy())
    w = F.when(F.col("cls") == 0, background).when(F.col("cells") == 0, 1.0).otherwise(F.round(F.least(largest / F.col("cells"), F.lit(top)), 1))
    found = distribution.select("cls", w.alias("weight"))
    return found if no_object is None else found.unionByName(distribution.agg((F.max("cls") + 1).alias("cls"), F.lit(no_object).alias("weight")))


def invalid_ids(runs: DataFrame, classes: int = 5) -> DataFrame:
    """``(cls, cells, samples)`` of ids that are no class."""
    return runs.where(~F.col("cls").between(0, classes - 1)).groupBy("cls").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("cells"), F.countDistinct("sample_id").alias("samples"))


def source_counts(samples: DataFrame) -> DataFrame:
    """Samples by the part of their id before the first underscore."""
    return samples.groupBy(F.split("sample_id", "_")[0].alias("prefix")).agg(F.count("*").alias("samples")).orderBy(F.desc("samples"), "prefix")


def file_profile(files: DataFrame, samples: int = 5) -> DataFrame:
    """``(dataset, ext, files, bytes, depth, some)`` with totals of each data set and of all (null columns) in one rollup.

    ``some`` are the first ``samples`` paths. Each level takes them from those of the level below, and the
    lowest keeps that many a task before it shuffles, so no group's paths come together.
    """
    some = files.select("dataset", "ext", "path").withColumn("level", F.lit(0))
    levels = []
    for level, keys in enumerate((["dataset", "ext"], ["dataset"], [])):
        some = some.select(*[F.col(c) if c in keys else F.lit(None).cast("string").alias(c) for c in ("dataset", "ext")], "path")
        rank = F.row_number().over(Window.partitionBy("dataset", "ext").orderBy("path"))
        some = some.withColumn("rank", rank).where(F.col("rank") <= samples).drop("rank")
        levels.append(some.groupBy("dataset", "ext").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("some")).withColumn("level", F.lit(level)))
    total = files.rollup("dataset", "ext").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("depth").alias("depth"), F.bit_count(F.grouping_id()).alias("level"))
    own = levels[0].unionByName(levels[1]).unionByName(levels[2]).alias("s")
    on = F.col("t.dataset").eqNullSafe(F.col("s.dataset")) & F.col("t.ext").eqNullSafe(F.col("s.ext")) & (F.col("t.level") == F.col("s.level"))
    return total.alias("t").join(own, on, "left").select("t.dataset", "t.ext", "files", "bytes", "depth", "some")


#: Parts of names by which a folder counts as one of a data set's main ones.
KEY_NAMES = ("image", "height", "annotation", "mask", "satellite", "street")


def key_folders(files: DataFrame) -> DataFrame:
    """``(dataset, folder, files, archives)`` of the folders of file paths whose own name says what they hold; ``archives`` are those of their files that still need unpacking. Hidden files do not count."""
    x = files.select("dataset", F.regexp_extract("path", "^(.*)/([^/]*)$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    known = F.lower(F.regexp_extract("folder", "([^/]*)$", 1)).rlike("|".join(KEY_NAMES))
    x = x.where(known & ~F.col("name").startswith("."))
    return x.groupBy("dataset", "folder").agg(F.count("*").alias("files"), F.sum(F.lower("name").endswith(".zip").cast("long")).alias("archives"))


def mask_audit(masks: DataFrame, runs: DataFrame, images: DataFrame, keys: list[str], classes: int = 5) -> DataFrame:
    """One row: ``samples``, how many masks are ``unreadable``, ``empty`` or of another shape than their image (``mismatched``), and how many hold an id that is no class (``invalid``).

    ``masks`` and ``images`` have ``height`` and ``width``, null where a file cannot be read; ``runs`` have
    ``cls``. An unreadable mask counts for nothing else, and a mask without an image has no shape to match.
    """
    held = runs.where("x0 < x1 AND cls <> 0").groupBy(*keys).agg(F.max((~F.col("cls").between(0, classes - 1)).cast("int")).alias("wrong"))
    x = masks.select(*keys, "height", "width").join(held, keys, "left").join(images.select(*keys, F.col("height").alias("h"), F.col("width").alias("w")), keys, "left")
    fine = F.col("height").isNotNull() & F.col("width").isNotNull()
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    other = F.coalesce((F.col("height") != F.col("h")) | (F.col("width") != F.col("w")), F.lit(False))
    return x.agg(F.count("*").alias("samples"), n(~fine).alias("unreadable"), n(fine & F.col("wrong").isNull()).alias("empty"), n(fine & other).alias("mismatched"), n(fine & (F.col("wrong") == 1)).alias("invalid"))


def top_shapes(frames: DataFrame, n: int = 10) -> DataFrame:
    """The commonest frame sizes."""
    return frames.groupBy("height", "width").agg(F.count("*").alias("samples")).orderBy(F.desc("samples"), "height", "width").limit(n)


def preflight(instances: DataFrame, key: str) -> DataFrame:
    """One row: samples, the most instances of any, and the labels that occur."""
    per = instances.groupBy(key).agg(F.count("*").alias("n"))
    labels = instances.select("label").distinct().agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
    return per.agg(F.count("*").alias("samples"), F.max("n").alias("most")).crossJoin(labels)  # one row each
