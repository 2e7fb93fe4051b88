"""Sample manifests: paths, presence of files, balancing, oversampling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.storage import materialize

#: Defaults of a source description.
SOURCE_DEFAULTS = {"image_suffix": ".jpg", "mask_suffix": ".png", "normal_suffix": ".npy", "teacher_suffix": ".png", "image_dir": "images", "mask_dir": "masks", "normal_dir": "normals", "teacher_dir": "sam_masks"}


def describe_sources(sources: DataFrame) -> DataFrame:
    """Source rows (``root`` and ``split`` required) with defaults filled in; the name defaults to the root's last part."""
    have = set(sources.columns)
    for c in ("root", "split"):
        if c not in have:
            raise ValueError(f"a source needs {c}")
    x = sources.where(F.assert_true(F.col("root").isNotNull() & F.col("split").isNotNull(), F.lit("a source needs root and split")).isNull())
    base = F.regexp_extract(F.regexp_replace("root", "/+$", ""), "([^/]*)$", 1)
    x = x.withColumn("source", F.coalesce(F.col("source") if "source" in have else F.lit(None).cast("string"), base))
    x = x.withColumns({c: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d) for c, d in SOURCE_DEFAULTS.items()})
    x = x.withColumn("allow_missing_normal", F.coalesce(F.col("allow_missing_normal"), F.lit(True)) if "allow_missing_normal" in have else F.lit(True))
    return x.withColumn("split", F.when(F.col("split").startswith("/"), F.col("split")).otherwise(F.concat_ws("/", F.regexp_replace("root", "/+$", ""), "split")))


def sample_manifest(ids: DataFrame, sources: DataFrame) -> DataFrame:
    """Paths of each ``(source, sample_id)``: image, mask, normal and teacher below the source's root. The table of sources is small and joins by name."""
    def path(kind: str) -> Column:
        return F.concat(F.concat_ws("/", F.regexp_replace("root", "/+$", ""), f"{kind}_dir", "sample_id"), F.col(f"{kind}_suffix")).alias(f"{kind}_path")

    x = ids.join(describe_sources(sources), "source")
    return x.select("source", "sample_id", *[path(k) for k in ("image", "mask", "normal", "teacher")], "allow_missing_normal")


def flag_normals(samples: DataFrame, files: DataFrame) -> DataFrame:
    """``valid_normal`` 1 or 0 by whether the normal's file exists; samples whose source forbids missing normals go without it."""
    x = samples.join(files.select(F.col("path").alias("normal_path"), F.lit(1.0).alias("__there")).distinct(), "normal_path", "left")
    return x.withColumn("valid_normal", F.coalesce("__there", F.lit(0.0))).where((F.col("valid_normal") > 0) | F.col("allow_missing_normal")).drop("__there", "allow_missing_normal")


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of named parts with their ``source``."""
    if not parts:
        raise ValueError("no source")
    tables = [t.withColumn("source", F.lit(name)) for name, t in parts.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def balance_sources(samples: DataFrame, seed: int = 42, buckets: int = 64) -> DataFrame:
    """Every source repeated to the size of the largest: whole copies, and a hash-chosen remainder once more; ``replica`` counts from 0.

    The remainder is the first rows by the md5 of id and seed. Ranks come from bucket counts and a
    rank inside a bucket of the hash, so that a large source is never ranked in one task.
    """
    key = F.md5(F.concat(F.col("sample_id"), F.lit(str(seed))))
    x = samples.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, 2))
    sizes = x.groupBy("source", "__bucket").agg(F.count("*").alias("__in"))
    before = F.sum("__in").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("__in").over(Window.partitionBy("source"))
    plan = sizes.withColumns({"__before": F.coalesce(before, F.lit(0)), "__n": total})
    top = plan.agg(F.max("__n").alias("__max"))
    x = x.join(plan, ["source", "__bucket"]).crossJoin(F.broadcast(top))  # one row
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("source", "__bucket").orderBy("__key", "sample_id"))
    copies = F.floor(F.col("__max") / F.col("__n")) + (rank <= F.col("__max") % F.col("__n")).cast("long")
    x = x.withColumn("__copies", copies)
    return x.withColumn("replica", F.explode(F.sequence(F.lit(0), (F.col("__copies") - 1).cast("int")))).select(*samples.columns, "replica")


def hard_oversample(samples: DataFrame, hard: DataFrame, repeat: int) -> DataFrame:
    """Rows, and ``repeat - 1`` more of those whose id is hard; copies that balancing made multiply too."""
    if repeat < 1:
        raise ValueError("repeat is at least 1")
    if repeat == 1:
        return samples
    more = samples.join(hard.select("sample_id").distinct(), "sample_id", "left_semi").withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(repeat - 1)))).drop("__n")
    return samples.unionByName(more)


def require_files(samples: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Samples whose file exists."""
    return samples.join(files.select(F.col("path").alias(column)), column, "left_semi")


def orphans(images: DataFrame, masks: DataFrame, split: DataFrame) -> DataFrame:
    """``(kind, sample_id)``: images without a mask, masks without an image, and split entries with neither."""
    a, b, s = (t.select("sample_id").distinct() for t in (images, masks, split))
    left = lambda x, y, kind: x.join(y, "sample_id", "left_anti").select(F.lit(kind).alias("kind"), "sample_id")
    return left(a, b, "image_without_mask").unionByName(left(b, a, "mask_without_image")).unionByName(left(s, a.intersect(b), "split_not_on_disk"))


def holdout(ids: DataFrame, share: int = 10, legacy: bool = False) -> DataFrame:
    """``(sample_id, part)`` with the last 1/share of ids, by order of id, for validation.

    ``legacy`` leaves the validation ids in the training part as well and copies everything below
    ``share`` ids.
    """
    x = ids.select("sample_id").distinct()
    k = x.count() // share
    if k == 0:
        last = x if legacy else x.limit(0)
    else:
        last = first_rows(x, k, F.desc("sample_id"))
    train = x if legacy else x.join(last, "sample_id", "left_anti")
    return train.select("sample_id", F.lit("train").alias("part")).unionByName(last.select("sample_id", F.lit("val").alias("part")))


def first_rows(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows in an order, where ``k`` grows with the table: ranges of the order are counted, and only inside a range rows are ranked, so no task holds more than one."""
    ranged = materialize(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__in"))
    before = F.sum("__in").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    x = ranged.join(F.broadcast(sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))), "__range")
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return x.withColumn("__rank", rank).where(F.col("__rank") <= k).select(*rows.columns)


def resolve_paths(wanted: DataFrame, files: DataFrame, candidates: list[str], key: str = "sample_id") -> DataFrame:
    """First existing path of each row: candidate columns in turn, else the first file (by suffix rank, then path) with the row's stem."""
    there = files.select(F.col("path"))
    x = wanted
    for i, c in enumerate(candidates):
        x = x.join(there.select(F.col("path").alias(c), F.col("path").alias(f"__p{i}")), c, "left")
    index = files.groupBy("stem").agg(F.min_by("path", F.struct("suffix_rank", "path")).alias("__stem_path"))
    x = x.join(index, F.col(key) == F.col("stem"), "left").drop("stem")
    return x.withColumn("found", F.coalesce(*[F.col(f"__p{i}") for i in range(len(candidates))], F.col("__stem_path"))).drop(*[f"__p{i}" for i in range(len(candidates))], "__stem_path")


def index_by_convention(files: DataFrame) -> DataFrame:
    """``(dir, sample_id, image_path, mask_path, normal_path)`` of ``*_rgb.jpg`` files: a ``_mask.png`` or else ``_mask.jpg`` must lie beside, a ``_normal.npy`` may."""
    def kind(suffix: str, name: str) -> DataFrame:
        return files.where(F.col("path").endswith(suffix)).select(F.regexp_extract("path", "^(.*)/", 1).alias("dir"), F.regexp_extract("path", f"([^/]*){suffix}$", 1).alias("sample_id"), F.col("path").alias(name))

    x = kind("_rgb.jpg", "image_path")
    for suffix, name in (("_mask.png", "__png"), ("_mask.jpg", "__jpg"), ("_normal.npy", "normal_path")):
        x = x.join(kind(suffix, name), ["dir", "sample_id"], "left")
    return x.withColumn("mask_path", F.coalesce("__png", "__jpg")).where("mask_path is not null").select("dir", "sample_id", "image_path", "mask_path", "normal_path")


def random_sample(ids: DataFrame, ratio: float, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """``max(1, floor(n * ratio))`` rows in the order of a hash of id and seed, the same on every run."""
    k = max(1, int(ids.count() * ratio))
    x = ids.withColumn("__key", F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))))
    return first_rows(x, k, F.col("__key").asc(), F.col(key).asc()).drop("__key")
