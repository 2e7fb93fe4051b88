"""Turned copies, letterboxes, tiles and soft maps of rasters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.operators import runs as R
from facetlake.operators.evaluate import dice
from facetlake.storage import materialize


def rotate_expand(cells: DataFrame, id_col: str, height: int, width: int) -> DataFrame:
    """Every raster four times, turned clockwise by 0, 90, 180 and 270 degrees, the turn put behind the id."""
    x = cells.withColumn("__turn", F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))))
    t, y, c = F.col("__turn"), F.col("y"), F.col("x")
    ny = F.when(t == 0, y).when(t == 90, c).when(t == 180, height - 1 - y).otherwise(width - 1 - c)
    nx = F.when(t == 0, c).when(t == 90, height - 1 - y).when(t == 180, width - 1 - c).otherwise(y)
    return x.withColumns({"__y": ny, "__x": nx, id_col: F.concat(F.col(id_col), F.lit("_rot"), t)}).drop("y", "x", "__turn").withColumnsRenamed({"__y": "y", "__x": "x"})


def letterbox(frames: DataFrame, height: int, width: int) -> DataFrame:
    """``scale, new_h, new_w, top, bottom, left, right`` that fit a frame into another without changing its shape."""
    x = frames.withColumn("scale", F.least(F.lit(float(width)) / F.col("width"), F.lit(float(height)) / F.col("height")))
    x = x.withColumns({"new_h": F.floor(F.col("height") * F.col("scale")), "new_w": F.floor(F.col("width") * F.col("scale"))})
    x = x.withColumns({"top": F.floor((height - F.col("new_h")) / 2), "left": F.floor((width - F.col("new_w")) / 2)})
    return x.withColumns({"bottom": height - F.col("new_h") - F.col("top"), "right": width - F.col("new_w") - F.col("left")})


def valid_tiles(cells: DataFrame, keys: list[str], tile: int, share: float = 0.1, least_grey: float = 5, least_norm: float = 0.5) -> DataFrame:
    """Tiles in which more than ``share`` of cells are bright enough and have a normal (columns ``grey`` and ``norm``)."""
    x = cells.groupBy(*keys, F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"))
    x = x.agg(F.avg((F.col("grey") > least_grey).cast("double")).alias("bright"), F.avg((F.col("norm") > least_norm).cast("double")).alias("known"))
    return x.where((F.col("bright") > share) & (F.col("known") > share))


def bands_to_rgb(cells: DataFrame) -> DataFrame:
    """``bands`` as exactly three: one is repeated, more than three are cut."""
    b = F.col("bands")
    return cells.withColumn("bands", F.when(F.size(b) == 1, F.array_repeat(b[0], 3)).otherwise(F.slice(b, 1, 3)))


def displayed(features: DataFrame) -> DataFrame:
    """Features with a slope of 0 or more: ``slope_deg``, else the older ``slope``; none where neither column exists."""
    column = next((c for c in ("slope_deg", "slope") if c in features.columns), None)
    return features.limit(0) if column is None else features.where(F.col(column) >= 0)


def tile_centres(meshes: DataFrame, view: float, step: float) -> DataFrame:
    """Centres of square views over each mesh's extent: from half a view inside, by ``step``, the far end left out."""
    def axis(c: str) -> Column:
        n = F.ceil((F.col(f"max_{c}") - (F.col(f"min_{c}") + view / 2)) / step)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.col(f"min_{c}") + view / 2 + i * step)).otherwise(F.array().cast("array<double>"))

    return meshes.withColumn("cx", F.explode(axis("x"))).withColumn("cy", F.explode(axis("y")))


def resample_bilinear(cells: DataFrame, keys: list[str], value: str, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """Each target cell blends the four source cells around its centre; places beyond the border count as the border.

    A source cell goes to the target cells that it touches, and weighted values add up, so one
    aggregation does the four taps.
    """
    def taps(i: Column, n: int, to: int) -> Column:
        at = F.greatest(F.least((i + 0.5) * n / to - 0.5, F.lit(float(n - 1))), F.lit(0.0))
        low = F.floor(at)
        return F.array(F.struct(low.cast("int").alias("at"), (1 - (at - low)).alias("w")), F.struct(F.least(low + 1, F.lit(n - 1)).cast("int").alias("at"), (at - low).alias("w")))

    spark = cells.sparkSession
    rows = spark.range(to_height).select(F.col("id").cast("int").alias("ty"), F.explode(taps(F.col("id"), height, to_height)).alias("a")).select("ty", F.col("a.at").alias("y"), F.col("a.w").alias("wy"))
    cols = spark.range(to_width).select(F.col("id").cast("int").alias("tx"), F.explode(taps(F.col("id"), width, to_width)).alias("a")).select("tx", F.col("a.at").alias("x"), F.col("a.w").alias("wx"))
    x = cells.join(F.broadcast(rows), "y").join(F.broadcast(cols), "x")  # two rows for each target row and column
    return x.groupBy(*keys, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col(value) * F.col("wy") * F.col("wx")).alias(value))


def extremes(cells: DataFrame, keys: list[str], wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """``cells`` and, under each name of ``wanted``, the ``low`` or ``high`` of a column in each cell's 3 x 3 window inside the raster, by windows along x and then along y, one sort each for all names."""
    row = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-1, 1)
    col = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-1, 1)
    take = {"low": F.min, "high": F.max}
    x = cells.withColumns({f"__along_{n}": take[end](value).over(row) for n, (end, value) in wanted.items()})
    return x.withColumns({n: take[end](f"__along_{n}").over(col) for n, (end, _) in wanted.items()}).drop(*[f"__along_{n}" for n in wanted])


def neighbours(cells: DataFrame, keys: list[str], value: str, plus: bool = False) -> DataFrame:
    """``low`` and ``high`` of each cell's 3 x 3 window inside the raster (a plus-shaped one if ``plus``)."""
    if not plus:
        return extremes(cells, keys, {"low": ("low", value), "high": ("high", value)})
    row = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-1, 1)
    col = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-1, 1)
    x = cells.withColumns({"__rl": F.min(value).over(row), "__rh": F.max(value).over(row)})
    return x.withColumns({"low": F.least("__rl", F.min(value).over(col)), "high": F.greatest("__rh", F.max(value).over(col))}).drop("__rl", "__rh")


def boundary_bce(cells: DataFrame, keys: list[str], p: str, t: str) -> DataFrame:
    """``(keys, loss)``: cross-entropy between the 3 x 3 grey gradients of a probability and a target map, both taken in one pass over the cells."""
    x = extremes(cells, keys, {f"__{c}_{end}": (end, v) for c, v in (("p", p), ("t", t)) for end in ("low", "high")})
    gt = F.col("__t_high") - F.col("__t_low")
    q = F.least(F.greatest(F.col("__p_high") - F.col("__p_low"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return x.groupBy(*keys).agg(F.avg(-(gt * F.log(q) + (1 - gt) * F.log(1 - q))).alias("loss"))


def boundary_aware_loss(cells: DataFrame, keys: list[str], p: str, t: str) -> DataFrame:
    """``(keys, loss)``: Dice loss of a probability and a target map, and the cross-entropy of their borders."""
    return dice(cells, keys, p, t).join(boundary_bce(cells, keys, p, t), keys).select(*keys, (F.col("dice") + F.col("loss")).alias("loss"))


def mask_topology(cells: DataFrame, keys: list[str], p: str, least_share: float = 0.02) -> DataFrame:
    """``(keys, holes, fragments, variation, shortfall, loss)`` of soft masks: change under closing and opening, total variation, and what is missing to a least area.

    Each step adds its columns to the cells, so cells never meet each other in a join.
    """
    row, col = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    x = cells.withColumn("dx", F.abs(F.lead(p).over(row) - F.col(p))).withColumn("dy", F.abs(F.lead(p).over(col) - F.col(p)))
    x = extremes(extremes(x, keys, {"__high": ("high", p), "__low": ("low", p)}), keys, {"__c": ("low", "__high"), "__o": ("high", "__low")})
    g = x.groupBy(*keys).agg(F.avg(F.col("__c") - F.col(p)).alias("holes"), F.avg(F.col(p) - F.col("__o")).alias("fragments"), (F.avg("dx") + F.avg("dy")).alias("variation"), F.greatest(F.lit(0.0), least_share - F.avg(p)).alias("shortfall"))
    return g.withColumn("loss", F.col("holes") + F.col("fragments") + 0.2 * F.col("variation") + 0.2 * F.col("shortfall"))


def soft_roof_map(scores: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, y, x, p)``: mask probabilities of all queries weighted by their foreground probability."""
    x = masks.join(scores, [*keys, "q"])
    return x.groupBy(*keys, "y", "x").agg((F.sum(F.col("roof") * F.col("p")) / F.greatest(F.sum("roof"), F.lit(1e-6))).alias("p"))


def every_nth(runs: DataFrame, keys: list[str], points: int) -> DataFrame:
    """``(keys, k, y, x)``: every n-th cell of each mask in raster order, n being its size over ``points``, that many at most. Ranks come from a running sum of run lengths, not from cells."""
    order = Window.partitionBy(*keys).orderBy("y", "x0")
    n = F.col("x1") - F.col("x0")
    x = runs.withColumns({"__before": F.sum(n).over(order) - n, "__all": F.sum(n).over(Window.partitionBy(*keys))})
    x = x.withColumn("__step", F.greatest(F.floor(F.col("__all") / points), F.lit(1)).cast("long"))
    first = F.ceil(F.col("__before") / F.col("__step")).cast("long")
    last = F.floor((F.col("__before") + n - 1) / F.col("__step")).cast("long")
    x = x.where(first <= last).withColumn("k", F.explode(F.sequence(first, last))).where(F.col("k") < points)
    return x.select(*keys, "k", "y", (F.col("x0") + F.col("k") * F.col("__step") - F.col("__before")).alias("x"))


def prompt_points(runs: DataFrame, ring: DataFrame, keys: list[str], inside: int = 8, outside: int = 16) -> DataFrame:
    """``(keys, positive, k, y, x)``: points that prompt a refinement of each mask.

    Positive ones are the mask's centroid (``k`` 0) and ``inside`` of its cells, negative ones ``outside``
    cells of its ``ring`` (see ``prompt_ring``), both spread evenly in raster order. A mask without cells
    has none.
    """
    n = F.col("x1") - F.col("x0")
    middle = runs.groupBy(*keys).agg((F.sum(F.col("y") * n) / F.sum(n)).alias("y"), (F.sum((F.col("x0") + F.col("x1") - 1) * n / 2) / F.sum(n)).alias("x"))
    found = middle.select(*keys, F.lit(True).alias("positive"), F.lit(0).cast("long").alias("k"), "y", "x")
    for cells, positive, points in ((runs, True, inside), (ring, False, outside)):
        some = every_nth(cells, keys, points)
        found = found.unionByName(some.select(*keys, F.lit(positive).alias("positive"), (F.col("k") + int(positive)).alias("k"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")))
    return found


def accept_refinement(old: DataFrame, new: DataFrame, iou: DataFrame, keys: list[str], gain: float = 0.02, least: float = 0.25) -> DataFrame:
    """Runs of the refined mask where it is not empty and close enough to the old one (``iou(keys, iou)``), the old runs otherwise; ``refined`` tells which."""
    fine = iou.where(F.col("iou") + gain >= least).select(*keys).join(new.select(*keys).distinct(), keys, "left_semi")
    take = new.join(fine, keys, "left_semi").select(*keys, "y", "x0", "x1", F.lit(True).alias("refined"))
    keep = old.join(fine, keys, "left_anti").select(*keys, "y", "x0", "x1", F.lit(False).alias("refined"))
    return take.unionByName(keep)


def prompt_ring(runs: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Cells within two of a mask's border on either side."""
    return R.gradient(runs, frames, keys, height, width, 2)


#: Cells of a border whose votes one task counts.
TASK_CELLS = 1 << 17
#: Keeps rounding at exact halves and whole steps the same on every machine.
EPS = 1e-9


def line_segments(cells: DataFrame, key: str, least_votes: int = 30, least_length: int = 12, gap: int = 6, step: int = 1, beside: int = 8) -> DataFrame:
    """``(key, theta, rho, x1, y1, x2, y2)``: stretches of edge cells along lines that enough cells vote for.

    Every cell votes for one offset at each angle. A line stands for all that are within ``beside`` of it in angle
    (around the half circle) and offset, if it has the most votes of them (ties by order); its cells are cut
    where they are farther apart than ``gap``.
    """
    def offset(theta: Column) -> Column:
        a = F.radians(theta)
        return F.floor(F.col("x") * F.cos(a) + F.col("y") * F.sin(a) + 0.5 + EPS).cast("int")

    own = materialize(cells.select(key, "y", "x"), "edges")
    own = own.repartition(max(1, -(-own.count() // TASK_CELLS)), key)
    kind = T.StructType([T.StructField(key, own.schema[key].dataType), *[T.StructField(c, T.IntegerType()) for c in ("theta", "rho", "n")]])
    votes = materialize(own.sortWithinPartitions(key).mapInArrow(lambda batches: _votes(batches, key, range(0, 180, step), least_votes), kind), "votes")
    # Beyond 180 degrees an angle comes again with its offset turned round.
    again = votes.unionByName(votes.select(key, (F.col("theta") - 180).alias("theta"), (-F.col("rho")).alias("rho"), "n")).unionByName(votes.select(key, (F.col("theta") + 180).alias("theta"), (-F.col("rho")).alias("rho"), "n"))
    cell = lambda c: F.floor(F.col(c) / beside)
    placed = votes.withColumns({"ct": cell("theta"), "cr": cell("rho")})
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    other = again.withColumns({"ct": cell("theta"), "cr": cell("rho")}).withColumn("ct", around("ct")).withColumn("cr", around("cr")).hint("merge")
    rank = lambda t: F.struct(-F.col(f"{t}.n"), F.pmod(f"{t}.theta", F.lit(180)), F.when(F.col(f"{t}.theta").between(0, 179), F.col(f"{t}.rho")).otherwise(-F.col(f"{t}.rho")))
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (key, "ct", "cr")]
    beaten = placed.alias("a").join(other.alias("b"), on + [(F.abs(F.col("a.theta") - F.col("b.theta")) <= beside) & (F.abs(F.col("a.rho") - F.col("b.rho")) <= beside) & (rank("b") < rank("a"))], "left_anti")
    peaks = beaten.select(key, "theta", "rho").hint("merge")
    order = Window.partitionBy(key, "theta", "rho").orderBy("along", "y", "x")
    a = F.radians("theta")
    on = own.join(peaks, key).where(offset(F.col("theta")) == F.col("rho")).withColumn("along", F.round(F.col("y") * F.cos(a) - F.col("x") * F.sin(a), 6))
    on = on.withColumn("__new", F.when(F.coalesce(F.col("along") - F.lag("along").over(order) > gap + EPS, F.lit(True)), 1).otherwise(0))
    on = on.withColumn("__n", F.sum("__new").over(order))
    ends = on.groupBy(key, "theta", "rho", "__n").agg(F.min("along").alias("u"), F.max("along").alias("v"), F.min_by(F.struct("x", "y"), F.struct("along", "y", "x")).alias("p"), F.max_by(F.struct("x", "y"), F.struct("along", "y", "x")).alias("q"))
    return ends.where(F.col("v") - F.col("u") >= least_length - EPS).select(key, "theta", "rho", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def _votes(batches: Iterator[pa.RecordBatch], key: str, angles: range, least: int) -> Iterator[pa.RecordBatch]:
    """``(key, theta, rho, n)`` with at least so many votes, of cells sorted by their key. Only the counts of the newest key wait for the next batch."""
    last, waiting = None, {}
    for b in chain(batches, [None]):
        if b is not None and not b.num_rows:
            continue
        out = []
        keys = b.column(key) if b is not None else None
        if last is not None and (b is None or keys[0] != last):  # the waiting key had its last cell
            out += [(pa.repeat(last, len(r)), t, r, n) for t, (r, n) in waiting.items()]
            waiting = {}
        if b is not None:
            y, x = (b.column(c).to_numpy().astype(np.float64) for c in ("y", "x"))
            code = keys.dictionary_encode()
            mask, names = code.indices.to_numpy(), code.dictionary
            for t in angles:
                a = np.radians(t)
                rho = np.floor(x * np.cos(a) + y * np.sin(a) + 0.5 + EPS).astype(np.int64)
                before = waiting.get(t, (np.zeros(0, np.int64),) * 2)
                low = min(rho.min(), before[0].min(initial=rho.min()))
                span = int(max(rho.max(), before[0].max(initial=rho.max())) - low) + 1
                n = np.bincount(mask * span + rho - low, minlength=len(names) * span)
                n[before[0] - low] += before[1]
                at = np.flatnonzero(n)
                whole = at < (len(names) - 1) * span
                some = at[whole & (n[at] >= least)]
                out.append((names.take(pa.array(some // span)), t, some % span + low, n[some]))
                rest = at[~whole]
                waiting[t] = rest % span + low, n[rest]
            last = keys[len(keys) - 1]
        for k, t, r, n in out:
            fine = np.flatnonzero(n >= least)
            if len(fine):
                yield pa.RecordBatch.from_arrays([k.take(pa.array(fine)), *[pa.array(np.asarray(v, np.int32)) for v in (np.full(len(fine), t), r[fine], n[fine])]], [key, "theta", "rho", "n"])


def project_faces(faces: DataFrame, vertices: DataFrame, size: int, scale: float) -> DataFrame:
    """``(mesh, fid, ord, x, y)``: corners of triangles seen from above, centred on the mesh's mean corner, in whole cells."""
    mean = vertices.groupBy("mesh").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    v = vertices.join(mean, "mesh").select("mesh", "vid", ((F.col("x") - F.col("mx")) * scale + size / 2).cast("int").alias("px"), (-(F.col("y") - F.col("my")) * scale + size / 2).cast("int").alias("py"))
    corner = faces.select("mesh", "fid", F.posexplode(F.array("a", "b", "c")).alias("ord", "vid"))
    return corner.join(v, ["mesh", "vid"]).select("mesh", "fid", "ord", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))


def paint_faces(faces: DataFrame, projected: DataFrame, heights: DataFrame, size: int) -> DataFrame:
    """Runs ``(mesh, y, x0, x1, fid)`` of the face on top: the higher mean z covers the lower, the later face on ties."""
    filled = R.rasterize(projected, ["mesh", "fid"], size, size).hint("merge").join(heights.select("mesh", "fid", "mean_z"), ["mesh", "fid"])
    return R.overlay(filled, ["mesh"], "fid", ["mean_z", "fid"])


def classify_by_slope(cells: DataFrame, keys: list[str], value: str = "v", slope: str = "slope", flat: float = 2.0) -> DataFrame:
    """``cls`` of each cell: rasters that only know 0 and 1 become flat (1) and sloped (2) roofs by their slope in degrees; others hold classes already."""
    kind = cells.groupBy(*keys).agg((F.max(value) <= 1).alias("__binary"))
    roof = F.when(F.col(value) == 0, 0).when(F.col(slope) < flat, 1).otherwise(2)
    return cells.join(kind, keys).withColumn("cls", F.when(F.col("__binary"), roof).otherwise(F.col(value)).cast("int")).drop("__binary")
