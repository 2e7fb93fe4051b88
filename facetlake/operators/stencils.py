"""Three-by-three filters and resampling on cell tables ``(key, y, x, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))
LAPLACE = ((0, 1, 0), (1, -4, 1), (0, 1, 0))
GAUSS = ((1 / 16, 2 / 16, 1 / 16), (2 / 16, 4 / 16, 2 / 16), (1 / 16, 2 / 16, 1 / 16))


def stencil(cells: DataFrame, keys: list[str], value: str, kernels: dict[str, tuple]) -> DataFrame:
    """``(keys, y, x, value, names...)``: weighted sums over 3 x 3 windows, borders mirrored without repeating the edge.

    Neighbours along x come by lag and lead within a row, then along y within a column; both windows
    are small, and a raster's rows spread over tasks. Cells are taken to fill a rectangle.
    """
    row, col = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    before, after = F.lag(value).over(row), F.lead(value).over(row)
    x = cells.withColumns({"__l": F.coalesce(before, after, value), "__r": F.coalesce(after, before, value)})
    three = F.struct("__l", value, "__r")
    up, down = F.lag(three).over(col), F.lead(three).over(col)
    x = x.withColumn("__c", three).withColumns({"__u": F.coalesce(up, down, three), "__d": F.coalesce(down, up, three)})
    names = ("__l", value, "__r")

    def total(kernel: tuple) -> Column:
        terms = [float(w) * F.col(f"{r}.{n}") for r, line in zip(("__u", "__c", "__d"), kernel, strict=True) for n, w in zip(names, line, strict=True) if w]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    return x.select(*keys, "y", "x", value, *[total(k).alias(n) for n, k in kernels.items()])


def sobel_normals(cells: DataFrame, keys: list[str], value: str = "z", scale: float = 1.0, keep: bool = False) -> DataFrame:
    """``(keys, y, x, nx, ny, nz)``: (-dx, -dy, 1) at length 1; with ``keep`` the value stays beside it."""
    g = stencil(cells, keys, value, {"dx": SOBEL_X, "dy": SOBEL_Y})
    dx, dy = F.col("dx") * scale, F.col("dy") * scale
    n = F.greatest(F.sqrt(dx * dx + dy * dy + 1), F.lit(1e-8))
    return g.select(*keys, "y", "x", *[value] * keep, (-dx / n).alias("nx"), (-dy / n).alias("ny"), (1 / n).alias("nz"))


def image_quality(cells: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """``(keys, sharpness, contrast, noise)``: variance of the Laplacian, standard deviation, median distance to a blurred copy."""
    g = stencil(cells, keys, value, {"lap": LAPLACE, "blur": GAUSS})
    return g.groupBy(*keys).agg(F.var_pop("lap").alias("sharpness"), F.stddev_pop(value).alias("contrast"), F.percentile(F.abs(F.col(value) - F.col("blur")), 0.5).alias("noise"))


def rank_candidates(quality: DataFrame, scene: str, candidate: str) -> DataFrame:
    """Candidates of a scene by 0.50 sharpness + 0.35 contrast + 0.15 (1 - noise), each spread to 0..1 over the scene (1 where all are equal)."""
    w = Window.partitionBy(scene)

    def spread(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(1.0)

    x = quality.withColumn("score", 0.50 * spread("sharpness") + 0.35 * spread("contrast") + 0.15 * (1 - spread("noise")))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(scene).orderBy(F.desc("score"), candidate)))


def fuse_images(cells: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Cell by cell mean of candidates weighted by their score (at least 1e-6), clipped to 0..255 and cut to a whole number."""
    w = F.greatest(F.col(weight), F.lit(1e-6))
    mean = F.sum(w * F.col(value)) / F.sum(w)
    return cells.groupBy(*keys, "y", "x").agg(F.floor(F.least(F.greatest(mean, F.lit(0.0)), F.lit(255.0))).cast("int").alias("v"))


def minmax_grey(cells: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """Values stretched to 0..255 over each raster; 0 for a flat one. Extremes are aggregated and joined back."""
    ends = cells.groupBy(*keys).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    g = F.when(F.col("__b") > F.col("__a"), (F.col(value) - F.col("__a")) / (F.col("__b") - F.col("__a")) * 255).otherwise(0.0)
    return cells.join(ends, keys).select(*keys, "y", "x", F.floor(g).cast("int").alias("grey"))


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.bround(0.299 * r + 0.587 * g + 0.114 * b, 0)


def encode_normal(c: Column) -> Column:
    return F.floor(F.least(F.greatest((c + 1) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("int")


def decode_normal(v: Column) -> Column:
    return v / 127.5 - 1


def standardize(v: Column, mean: float, std: float) -> Column:
    return (v / 255 - mean) / std


def resample_nearest(cells: DataFrame, keys: list[str], height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """Each target cell takes the source cell at ``floor(i * size / new size)``; a source cell knows the stretch of rows and columns that take it, so nothing is joined."""
    def takers(at: str, size: int, to: int) -> Column:
        first = lambda i: F.ceil(i * to / size).cast("int")
        low, high = first(F.col(at)), first(F.col(at) + 1) - 1
        return F.explode(F.when(F.col(at).between(0, size - 1) & (low <= high), F.sequence(low, high)))

    x = cells.withColumn("__y", takers("y", height, to_height)).withColumn("__x", takers("x", width, to_width))
    return x.drop("y", "x").withColumnsRenamed({"__y": "y", "__x": "x"})
