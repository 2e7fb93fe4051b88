"""Facet geometry: slope, azimuth, polygons, planes, lines and quality flags."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.operators import groups as J
from facetlake.operators.components import connected_components
from facetlake.operators.runs import closed_plus, merge_runs, opened_plus, outline, ring_edges, ring_rows, same, touching
from facetlake.storage import materialize


def clip(c: Column, low: float, high: float) -> Column:
    """Bounded value; null stays null, which least and greatest alone would not keep."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def slope(nz: Column, folded: bool = True) -> Column:
    """Degrees between a unit normal and up; ``folded`` takes a downward normal as its opposite."""
    z = clip(nz, -1.0, 1.0)
    return F.degrees(F.acos(F.abs(z) if folded else z))


def azimuth(nx: Column, ny: Column) -> Column:
    """Degrees from +x toward +y, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(ny, nx)) + 360, F.lit(360.0))


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def unit(nx: Column, ny: Column, nz: Column, eps: float = 1e-8) -> list[Column]:
    """The vector at length 1; up where it is shorter than ``eps``."""
    n = norm(nx, ny, nz)
    return [F.when(n > eps, c / n).otherwise(F.lit(d)) for c, d in ((nx, 0.0), (ny, 0.0), (nz, 1.0))]


def rotate(nx: Column, ny: Column, degrees: float) -> tuple[Column, Column]:
    """Counter-clockwise turn of a normal in the plane; the third part does not change."""
    a = F.radians(F.lit(float(degrees)))
    return nx * F.cos(a) - ny * F.sin(a), nx * F.sin(a) + ny * F.cos(a)


def flip(nx: Column, ny: Column, direction: str) -> tuple[Column, Column]:
    """A normal under a mirrored or transposed raster; the third part does not change."""
    return {"horizontal": (-nx, ny), "vertical": (nx, -ny), "transpose": (ny, nx)}[direction]


def snap_flat(degrees: Column, below: float = 2.0) -> Column:
    """Slopes below a bound count as flat."""
    return F.when(degrees < below, 0.0).otherwise(degrees)


def geometry_confidence(score: Column, area: Column, n: Column, least_area: int = 100) -> Column:
    """0.60 score, 0.25 area against five times the least one, 0.15 how near the normal's length ``n`` is to 1 (half of it without a normal)."""
    straight = F.when(n.isNull(), 0.5).otherwise(clip(1 - F.abs(n - 1), 0.0, 1.0))
    return clip(0.60 * clip(score, 0.0, 1.0) + 0.25 * clip(area / max(5 * least_area, 1), 0.0, 1.0) + 0.15 * straight, 0.0, 1.0)


def apply_affine(vertices: DataFrame, a: float, b: float, c: float, d: float, e: float, f: float) -> DataFrame:
    """Corners from cells to map units."""
    x, y = F.col("x"), F.col("y")
    return vertices.withColumns({"x": a * x + b * y + c, "y": d * x + e * y + f})


def polygon_measures(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, corners, area, perimeter, signed)`` of rings: shoelace area, absolute and signed."""
    e = ring_edges(vertices, keys)
    signed = F.sum(F.col("x") * F.col("yn") - F.col("xn") * F.col("y")) / 2
    length = F.sum(norm(F.col("xn") - F.col("x"), F.col("yn") - F.col("y")))
    return e.groupBy(*keys).agg(F.count("*").alias("corners"), F.abs(signed).alias("area"), length.alias("perimeter"), signed.alias("signed"))


def qa_flags(facets: DataFrame, vertices: DataFrame, keys: list[str], height: int, width: int, least_area: float = 1.0) -> DataFrame:
    """``facets`` (with ``nx, ny, nz, slope, azimuth``, any of them null) and ``qa_polygon, qa_normal, qa_slope, qa_azimuth, qa_ok``; a null part makes its flag false."""
    fine = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    inside = vertices.groupBy(*keys).agg(F.min(F.coalesce(fine, F.lit(False))).alias("__in"))
    ring = polygon_measures(vertices, keys).join(inside, keys).select(*keys, ((F.col("corners") >= 3) & (F.col("area") >= least_area) & F.col("__in")).alias("__ring"))
    n = norm(F.col("nx"), F.col("ny"), F.col("nz"))
    flags = {
        "qa_polygon": F.col("__ring"),
        "qa_normal": ~F.isnan(n) & (F.abs(n - 1) <= 0.05),
        "qa_slope": F.col("slope").between(0, 90),
        "qa_azimuth": (F.col("azimuth") >= 0) & (F.col("azimuth") < 360),
    }
    x = facets.join(ring, keys, "left").withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).drop("__ring")
    return x.withColumn("qa_ok", F.col("qa_polygon") & F.col("qa_normal") & F.col("qa_slope") & F.col("qa_azimuth"))


def vertex_angles(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """``angle`` in degrees at each corner between the sides to its neighbours; 0 for a side of no length."""
    e = ring_edges(vertices, keys)
    ax, ay, bx, by = F.col("xp") - F.col("x"), F.col("yp") - F.col("y"), F.col("xn") - F.col("x"), F.col("yn") - F.col("y")
    length = norm(ax, ay) * norm(bx, by)
    angle = F.when(length > 0, F.degrees(F.acos(clip((ax * bx + ay * by) / length, -1.0, 1.0)))).otherwise(0.0)
    return e.select(*keys, "ord", "x", "y", angle.alias("angle"))


def corner_straightness(vertices: DataFrame, keys: list[str], tolerance: float = 2.0) -> DataFrame:
    """One row: share of corners within ``tolerance`` degrees of a right angle."""
    return vertex_angles(vertices, keys).agg(F.avg(F.when(F.abs(F.col("angle") - 90) <= tolerance, 1.0).otherwise(0.0)).alias("straight"))


def dominant_angle(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, theta)``: mean direction of the sides modulo 90 degrees, weighted by length; sides below 1e-3 do not count."""
    e = ring_edges(vertices, keys)
    dx, dy = F.col("xn") - F.col("x"), F.col("yn") - F.col("y")
    n = norm(dx, dy)
    x = e.select(*keys, F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(90.0)).alias("a"), F.when(n < 1e-3, 0.0).otherwise(n).alias("n"))
    return x.groupBy(*keys).agg(F.when(F.sum("n") > 0, F.sum(F.col("a") * F.col("n")) / F.sum("n")).otherwise(0.0).alias("theta"))


def ring_rows_of(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, r)``: a ring as one row with its corners ``(ord, x, y)`` in order."""
    return vertices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("r"))


def corners_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, ord, x, y)`` of rings that are rows. An outer explosion, as Spark would push a filter on ``r`` below an inner one, with all folds in it."""
    return rows.select(*keys, F.explode_outer("r").alias("p")).where("p IS NOT NULL").select(*keys, "p.ord", "p.x", "p.y")


def dedup_vertices(vertices: DataFrame, keys: list[str], eps: float = 1e-3) -> DataFrame:
    """Corners that lie more than ``eps`` from the last corner kept, a fold over the ring's ordered array."""
    return corners_of(_without_repeats(ring_rows_of(vertices, keys), eps), keys)


def _without_repeats(rows: DataFrame, eps: float = 1e-3) -> DataFrame:
    far = lambda kept, p: (F.size(kept) == 0) | (norm(F.element_at(kept, -1)["x"] - p["x"], F.element_at(kept, -1)["y"] - p["y"]) > eps)
    return rows.withColumn("r", F.aggregate("r", F.slice("r", 1, 0), lambda acc, p: F.when(far(acc, p), F.concat(acc, F.array(p))).otherwise(acc)))


def _with_next(r: Column) -> Column:
    """Each corner ``p`` of a ring with the one after it, ``q``, around the ring."""
    return F.transform(r, lambda p, i: F.struct(p.alias("p"), F.element_at(r, (i + 1) % F.size(r) + 1).alias("q")))


def _signed_area(r: Column) -> Column:
    return F.aggregate(_with_next(r), F.lit(0.0), lambda acc, e: acc + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2


def align_dominant(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Rings with every side turned to the dominant direction or across it.

    Turned back by the angle, each corner in order takes the coordinate of the corner before along the
    shorter part of their side (both as long: along x), so sides become level or upright. The round goes
    over all corners twice, the first one moving against the last. The fold runs over a ring's array
    inside Spark. Rings of fewer than three corners stay.
    """
    return corners_of(_aligned(ring_rows_of(vertices, keys)), keys)


def _aligned(rows: DataFrame) -> DataFrame:
    def side(e: Column) -> Column:
        dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        n = norm(dx, dy)
        return F.struct(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(90.0)).alias("a"), F.when(n < 1e-3, 0.0).otherwise(n).alias("n"))

    zero = F.struct(F.lit(0.0).alias("an"), F.lit(0.0).alias("n"))
    sums = F.aggregate(F.transform(_with_next(F.col("r")), side), zero, lambda t, e: F.struct((t["an"] + e["a"] * e["n"]).alias("an"), (t["n"] + e["n"]).alias("n")))
    ring = rows.withColumn("__s", sums)
    ring = ring.withColumn("theta", F.when(F.col("__s.n") > 0, F.col("__s.an") / F.col("__s.n")).otherwise(0.0)).drop("__s")
    a = F.radians(F.col("theta"))
    ring = ring.withColumns({"__cos": F.cos(a), "__sin": F.sin(a)})
    cos, sin = F.col("__cos"), F.col("__sin")
    ring = ring.withColumn("r", F.transform("r", lambda p: F.struct(p["ord"].alias("ord"), (p["x"] * cos + p["y"] * sin).alias("u"), (p["y"] * cos - p["x"] * sin).alias("v"))))

    def squared(before: Column, p: Column) -> Column:
        level = F.abs(p["u"] - before["u"]) > F.abs(p["v"] - before["v"])
        return F.struct(p["ord"].alias("ord"), F.when(level, p["u"]).otherwise(before["u"]).alias("u"), F.when(level, before["v"]).otherwise(p["v"]).alias("v"))

    for _ in range(2):
        step = lambda done, p: F.concat(done, F.array(squared(F.when(F.size(done) == 0, F.element_at("r", -1)).otherwise(F.try_element_at(done, F.lit(-1))), p)))
        ring = ring.withColumn("r", F.when(F.size("r") < 3, F.col("r")).otherwise(F.aggregate("r", F.slice("r", 1, 0), step)))
    back = lambda p: F.struct(p["ord"].alias("ord"), (p["u"] * cos - p["v"] * sin).alias("x"), (p["u"] * sin + p["v"] * cos).alias("y"))
    return ring.withColumn("r", F.transform("r", back)).drop("theta", "__cos", "__sin")


def simplify(vertices: DataFrame, keys: list[str], factor: float = 0.02) -> DataFrame:
    """Douglas-Peucker on rings: a chain splits at its farthest corner while that lies beyond the tolerance max(1, factor x perimeter).

    A ring starts as two chains between its first corner and the one farthest from it. Each ring is one row
    with its corners in order, and the chains of a batch of rings split level by level; rings of fewer than
    three corners or of no length go.
    """
    return corners_of(_simplified(ring_rows_of(vertices, keys), factor), keys)


def _simplified(rows: DataFrame, factor: float) -> DataFrame:
    at = lambda c: F.transform("r", lambda p: p[c].cast("double"))
    ring = rows.where(F.size("r") >= 3).withColumn("__kept", kept_corners(at("x"), at("y"), F.lit(float(factor))))
    return ring.withColumn("r", F.filter("r", lambda p, i: F.get("__kept", i))).drop("__kept")


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def kept_corners(x: pa.Array, y: pa.Array, factor: pa.Array) -> pa.Array:
    """Which corners of each ring stay. Rings lie one after the other, each with its first corner again at its end."""
    if not len(x):
        return pa.array([], pa.list_(pa.bool_()))
    n = pc.list_value_length(x).to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(n)))
    own = np.repeat(np.arange(len(n)), n + 1)
    begin = at[:-1] + np.arange(len(n))  # of each ring among the corners and the repeated ones
    back = np.arange(len(own)) - own
    back[begin + n] = at[:-1]
    px, py = (np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64)[back] for c in (x, y))
    dx, dy = np.diff(px, append=px[-1:]), np.diff(py, append=py[-1:])
    length = np.sqrt(dx * dx + dy * dy)
    length[begin + n] = 0
    whole = np.add.reduceat(length, begin)
    limit = np.maximum(1.0, factor.to_numpy(zero_copy_only=False)[0] * whole)[own]

    def farthest(off: np.ndarray, chain: np.ndarray) -> np.ndarray:
        """The first place of the largest distance of each chain."""
        starts = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
        most = np.repeat(np.maximum.reduceat(off, starts), np.diff(np.append(starts, len(off))))
        best = np.flatnonzero(off == most)
        return best[np.append(True, chain[best][1:] != chain[best][:-1])]

    dx, dy = px - px[begin][own], py - py[begin][own]
    kept = np.zeros(len(own), bool)
    kept[farthest(np.sqrt(dx * dx + dy * dy), own)] = True
    kept[begin] = kept[begin + n] = True
    live = np.ones(len(own), bool)
    while (open_ := np.flatnonzero(live & ~kept)).size:
        places = np.flatnonzero(kept)
        chain = np.cumsum(kept)[open_] - 1
        p, q = places[chain], places[chain + 1]
        dx, dy = px[q] - px[p], py[q] - py[p]
        n2 = np.sqrt(dx * dx + dy * dy)
        ex, ey = px[p] - px[open_], py[p] - py[open_]
        off = np.where(n2 > 0, np.abs(dx * ey - dy * ex) / np.where(n2 > 0, n2, 1), np.sqrt(ex * ex + ey * ey))
        best = farthest(off, chain)
        best = best[off[best] > limit[open_[best]]]
        kept[open_[best]] = True
        live = np.zeros(len(own), bool)
        live[open_[np.isin(chain, chain[best])]] = True
    kept &= (whole > 0)[own]
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.delete(kept, begin + n)))


def snap_to_lines(vertices: DataFrame, segments: DataFrame, key: str, reach: float = 4.0) -> DataFrame:
    """Corners moved onto the nearest line of their scene within ``reach``; others stay.

    A corner meets the lines that come within the reach of its grid cell: a line is followed column by
    column of the grid, in each over the rows that it crosses there, so its cells grow with its length.
    Cells are sixteen times the reach, so most lines go to one or two; boxes decide before distances do, and a
    corner's nearest line is found in the task where it meets its lines.
    ``segments`` has ``(key, seg, x1, y1, x2, y2)``, a line of no length is its start.
    """
    size = 16 * reach
    cells = lambda low, high: F.explode(F.sequence(F.floor((low - reach) / size), F.floor((high + reach) / size)))
    near = segments.select(key, "seg", "x1", "y1", "x2", "y2").withColumn("gx", cells(F.least("x1", "x2"), F.greatest("x1", "x2")))
    start, end = F.greatest(F.least("x1", "x2"), F.col("gx") * size - reach), F.least(F.greatest("x1", "x2"), (F.col("gx") + 1) * size + reach)
    at = lambda x: F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    upright = F.col("x1") == F.col("x2")
    low = F.when(upright, F.least("y1", "y2")).otherwise(F.least(at(start), at(end)))
    high = F.when(upright, F.greatest("y1", "y2")).otherwise(F.greatest(at(start), at(end)))
    near = near.withColumns({"low": low, "high": high}).withColumn("gy", cells(F.col("low"), F.col("high"))).drop("low", "high")
    own = vertices.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})
    # a hair more than the reach, so that rounding never rules out what the distance lets in
    inside = lambda c, a, b: F.col(f"v.{c}").between(F.least(a, b) - reach * 1.001, F.greatest(a, b) + reach * 1.001)
    on = same([key, "gx", "gy"], "v", "s") & inside("x", "s.x1", "s.x2") & inside("y", "s.y1", "s.y2")
    met = own.alias("v").join(near.hint("merge").alias("s"), on, "left").select("v.*", *[F.col(f"s.{c}").alias(f"__{c}") for c in ("seg", "x1", "y1", "x2", "y2")])
    x1, y1 = F.col("__x1"), F.col("__y1")
    dx, dy = F.col("__x2") - x1, F.col("__y2") - y1
    n2 = dx * dx + dy * dy
    t = F.when(n2 > 0, clip(((F.col("x") - x1) * dx + (F.col("y") - y1) * dy) / n2, 0.0, 1.0)).otherwise(0.0)
    met = met.withColumns({"__px": x1 + t * dx, "__py": y1 + t * dy})
    met = met.withColumn("__d", norm(F.col("x") - F.col("__px"), F.col("y") - F.col("__py")))
    keep = [c for c in vertices.columns if c not in ("x", "y")]
    # with the cell among the keys corners stay where they have met their lines
    to = F.min_by(F.struct(F.col("__px").alias("x"), F.col("__py").alias("y")), F.when(F.col("__d") < reach, F.struct("__d", "__seg")))
    best = met.groupBy(*keep, "gx", "gy").agg(F.first("x").alias("x"), F.first("y").alias("y"), to.alias("to"))
    return best.select(*keep, F.coalesce("to.x", "x").alias("x"), F.coalesce("to.y", "y").alias("y"))


def snap_angles(segments: DataFrame, key: str, modulo: bool = True) -> DataFrame:
    """Lines turned about their middle to the scene's median direction or across it, whichever is nearer; length stays."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    x = segments.withColumns({"angle": F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0)), "n": norm(dx, dy)})
    x = x.join(x.groupBy(key).agg(F.percentile("angle", 0.5).alias("main")), key)
    gap = lambda to: F.least(F.pmod(F.col("angle") - to, F.lit(180.0)), 180 - F.pmod(F.col("angle") - to, F.lit(180.0))) if modulo else F.abs(F.col("angle") - to)
    to = F.when(gap(F.col("main")) <= gap(F.col("main") + 90), F.col("main")).otherwise(F.col("main") + 90)
    x = x.withColumn("to", to)
    a, half = F.radians("to"), F.col("n") / 2
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return x.select(key, "seg", (mx - half * F.cos(a)).alias("x1"), (my - half * F.sin(a)).alias("y1"), (mx + half * F.cos(a)).alias("x2"), (my + half * F.sin(a)).alias("y2"))


def line_graph(segments: DataFrame, key: str, snap: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """``node(key, node, x, y)`` and ``edge(key, a, b)``: line ends within ``snap`` of each other, directly or in a chain, are one node at its first end.

    Ends at one place are one from the start; places meet in a grid whose cells are four times the snapping
    distance, each going to the cells that it may snap into. Ids of ends come from line ids, which are
    unique over all scenes; an edge between a node and itself goes.
    """
    end = lambda k, x, y: F.struct((F.col("seg") * 2 + k).alias("end"), F.col(x).alias("x"), F.col(y).alias("y"))
    ends = segments.select(key, F.inline(F.array(end(0, "x1", "y1"), end(1, "x2", "y2"))))
    ends = materialize(ends.withColumn("place", F.min("end").over(Window.partitionBy(key, "x", "y"))), "ends")
    places = ends.where("end = place").select(key, "end", "x", "y")
    size = 4 * snap
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - snap) / size), F.floor((F.col(c) + snap) / size)))
    placed = places.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})
    around = places.withColumn("gx", cells("x")).withColumn("gy", cells("y")).hint("merge")
    met = placed.alias("a").join(around.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")) & (F.col("a.end") < F.col("b.end")))
    near = met.where(norm(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")) <= snap).select(F.col("a.end").alias("a"), F.col("b.end").alias("b"))
    labels = connected_components(near)
    own = ends.join(labels.hint("merge"), F.col("place") == F.col("node"), "left").select(key, "end", "x", "y", F.coalesce("component", "place").alias("node"))
    node = own.where(F.col("end") == F.col("node")).select(key, "node", "x", "y")
    edge = own.withColumn("seg", F.floor(F.col("end") / 2)).groupBy(key, "seg").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select(key, "a", "b")
    return node, edge


def plane_scatter(points: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and centred second moments of each key's points, all a least-squares plane needs. Two passes keep the moments exact."""
    mean = points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"])
    x = points.join(mean, keys)
    d = {c: F.col(c) - F.col(f"m{c}") for c in "xyz"}
    return x.groupBy(*keys, "n", "mx", "my", "mz").agg(*[F.sum(d[a] * d[b]).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])


def fit_plane(points: DataFrame, key: str, trials: int = 200, distance: float = 1.5, least: int = 50, seed: int = 0) -> DataFrame:
    """``(key, nx, ny, nz, d, inliers)``: the plane of three points that most points are near, then the plane of least orthogonal distance to those.

    Triples are the different points with the smallest hashes of a key, the same on every run: points that
    come many times would fill triples that span no plane. Each task passes on no more than the trials need. A key's trial planes stay together in one row, so every point meets
    one row of its key and counts go up inside the tasks. The refinement takes the direction in which
    the centred second moments of the near points are least; downward normals turn up.
    """
    fine = points.where(F.col("z").isNotNull() & ~F.isnan("z"))
    order = Window.partitionBy(key).orderBy("__h", "x", "y", "z")
    picks = fine.select(key, "x", "y", "z").distinct().withColumn("__h", F.xxhash64("x", "y", "z", F.lit(seed))).withColumn("r", F.row_number().over(order)).where(F.col("r") <= 3 * trials)
    x = picks.groupBy(key, F.floor((F.col("r") - 1) / 3).alias("trial")).agg(F.array_sort(F.collect_list(F.struct("r", "x", "y", "z"))).alias("p")).where(F.size("p") == 3)
    p = [F.col("p")[i] for i in range(3)]
    u, v = ([p[i][c] - p[0][c] for c in "xyz"] for i in (1, 2))
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    x = x.select(key, "trial", *[c.alias(f"c{i}") for i, c in enumerate(cross)], F.col("p")[0].alias("o")).withColumn("n", norm(F.col("c0"), F.col("c1"), F.col("c2"))).where(F.col("n") >= 1e-8)
    planes = x.select(key, "trial", *[(F.col(f"c{i}") / F.col("n")).alias(f"n{c}") for i, c in enumerate("xyz")], "o").withColumn("d", F.col("nx") * F.col("o.x") + F.col("ny") * F.col("o.y") + F.col("nz") * F.col("o.z"))
    planes = materialize(planes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("trial", "nx", "ny", "nz", "d"))).alias("planes")), "planes")
    off = lambda t: F.abs(t["nx"] * F.col("x") + t["ny"] * F.col("y") + t["nz"] * F.col("z") - t["d"])
    near = fine.join(planes, key).select(key, "x", "y", "z", F.posexplode("planes").alias("at", "t"))
    tried = near.groupBy(key, "at").agg(F.sum((off(F.col("t")) <= distance).cast("int")).alias("inliers"))
    best = tried.groupBy(key).agg(F.max_by(F.struct("at", "inliers"), F.struct("inliers", -F.col("at"))).alias("b")).where(F.col("b.inliers") >= max(least, 3))
    best = best.join(planes, key).select(key, F.col("planes")[F.col("b.at")].alias("t"), F.col("b.inliers").alias("inliers"))
    s = plane_scatter(fine.join(best, key).where(off(F.col("t")) <= distance).select(key, "x", "y", "z"), [key])
    x = best.join(least_direction(s).select(key, "mx", "my", "mz", "direction"), key)
    x = x.withColumns({f"e{c}": F.coalesce(F.col("direction")[i], F.col(f"t.n{c}")) for i, c in enumerate("xyz")})
    sign = F.when(F.col("ez") < 0, -1.0).otherwise(1.0)
    x = x.withColumns({f"r{c}": sign * F.col(f"e{c}") for c in "xyz"})
    shift = F.col("rx") * F.col("mx") + F.col("ry") * F.col("my") + F.col("rz") * F.col("mz")
    return x.select(key, F.col("rx").alias("nx"), F.col("ry").alias("ny"), F.col("rz").alias("nz"), shift.alias("d"), "inliers")


def least_direction(moments: DataFrame) -> DataFrame:
    """``direction``: array of the unit vector along which second moments ``sxx..szz`` are least; null where no one direction is.

    Eigenvalues of a symmetric 3 x 3 matrix have a closed form; the vector is the longest cross product of
    two rows of the matrix less its least eigenvalue.
    """
    xx, xy, xz, yy, yz, zz, q, p, low = (F.col(c) for c in ("sxx", "sxy", "sxz", "syy", "syz", "szz", "__q", "__p", "__low"))
    x = moments.withColumn("__q", (xx + yy + zz) / 3)
    x = x.withColumn("__p", F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)).where(p >= 0)
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    x = x.withColumn("__low", F.when(p > 0, q + 2 * p * F.cos(F.acos(clip(det / (2 * p * p * p), -1.0, 1.0)) / 3 + 2 * math.pi / 3)))
    a, b, c = xx - low, yy - low, zz - low
    ways = ((xy * yz - xz * b, xz * xy - a * yz, a * b - xy * xy), (xy * c - xz * yz, xz * xz - a * c, a * yz - xy * xz), (b * c - yz * yz, yz * xz - xy * c, xy * yz - b * xz))
    x = x.withColumn("__ways", F.array(*[F.array(*w) for w in ways]))
    length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    x = x.withColumn("__best", F.array_max(F.transform("__ways", lambda v: F.struct(length(v).alias("n"), v.alias("v")))))
    direction = F.when(F.col("__best.n") > 1e-12 * q * q, F.transform("__best.v", lambda v: v / F.col("__best.n")))
    return x.withColumn("direction", direction).drop("__q", "__p", "__low", "__ways", "__best")


def geometry_override(facets: DataFrame, planes: DataFrame, keys: list[str]) -> DataFrame:
    """Facets with the fitted normal where a plane was found, the predicted one otherwise, and where it came from."""
    p = planes.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("nx", "ny", "nz")], F.col("inliers").alias("plane_inliers"))
    x = facets.join(p, keys, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in ("nx", "ny", "nz")})
    return x.withColumn("geometry_source", F.when(F.col("plane_inliers").isNotNull(), "plane").otherwise("predicted")).drop("__nx", "__ny", "__nz")


#: Corners that one task looks up.
TASK_CORNERS = 1 << 20


def face_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(mesh, fid, nx, ny, nz, mean_z)`` of triangles from three look-ups of their corners.

    Both sides are dealt for every look-up into as many tasks as there are corners for: rows of numbers in
    order shrink so much on their way that Spark, which goes by bytes, would put too many into a task.
    """
    x, tasks = faces, max(1, -(-vertices.count() // TASK_CORNERS))
    for c in "abc":
        v = vertices.select("mesh", F.col("vid").alias(c), F.struct("x", "y", "z").alias(f"p{c}")).repartition(tasks, "mesh", c).hint("merge")
        x = x.repartition(tasks, "mesh", c).join(v, ["mesh", c])
    u, v = ([F.col(f"p{k}.{c}") - F.col(f"pa.{c}") for c in "xyz"] for k in "bc")
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    x = x.withColumns({f"c{i}": c for i, c in enumerate(cross)})
    n = F.greatest(norm(F.col("c0"), F.col("c1"), F.col("c2")), F.lit(1e-8))
    return x.select("mesh", "fid", *[(F.col(f"c{i}") / n).alias(f"n{c}") for i, c in enumerate("xyz")], ((F.col("pa.z") + F.col("pb.z") + F.col("pc.z")) / 3).alias("mean_z"))


def coplanar_groups(facets: DataFrame, touching: DataFrame, degrees: float = 5.0) -> DataFrame:
    """``(inst, grp)``: facets that touch (pairs ``a, b``) and whose normals differ by less than ``degrees`` share the smallest id, in chains too."""
    n = facets.select(F.col("inst"), "nx", "ny", "nz").hint("merge")
    x = touching.join(n.toDF("a", "ax", "ay", "az"), "a").join(n.toDF("b", "bx", "by", "bz"), "b")
    dot = clip(F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz"), -1.0, 1.0)
    labels = connected_components(x.where(F.degrees(F.acos(dot)) < degrees).select("a", "b"))
    return facets.join(labels.hint("merge"), F.col("inst") == F.col("node"), "left").select("inst", F.coalesce("component", "inst").alias("grp"))


def merge_coplanar(runs: DataFrame, key: str, degrees: float = 5.0) -> DataFrame:
    """``(key, grp, members, runs)``: facets of a scene that share a border or cells and lie in one plane, as far as their normals tell, with their ids and their runs as one.

    ``runs`` are rows ``(key, inst, nx, ny, nz, y, x0, x1)``. A group is one row, found in the task that
    its key is dealt to; groups of keys with too many runs for that come from joins in many rows, each with
    a part of the group's members or runs.
    """
    small, large = J.large_keys(runs, [key])
    found = J.groups(small, [key], ["nx", "ny", "nz"], J.beside_and_alike(degrees), reach=1).select(key, F.col("cluster").alias("grp"), "members", "runs")
    if large is None:
        return found
    facets = large.select(key, "inst", "nx", "ny", "nz").distinct()
    grp = materialize(coplanar_groups(facets, touching(large, key), degrees).join(facets.select(key, "inst"), "inst"), "groups").hint("merge")
    cells = merge_runs(large.join(grp, [key, "inst"]), [key, "grp"])
    run = F.struct(*[F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")])
    kinds = {f.name: f.dataType for f in found.schema.fields}
    ids = grp.select(key, "grp", F.array("inst").alias("members"), F.array().cast(kinds["runs"]).alias("runs"))
    return found.unionByName(ids).unionByName(cells.select(key, "grp", F.array().cast(kinds["members"]).alias("members"), F.array(run).alias("runs")))


def normal_error(pairs: DataFrame) -> Column:
    """1 less the cosine of a predicted (``nx..``) and a true (``gx..``) unit normal."""
    return 1 - (F.col("nx") * F.col("gx") + F.col("ny") * F.col("gy") + F.col("nz") * F.col("gz"))


def angle_gap(a: Column, b: Column) -> Column:
    """Difference of two directions in degrees, around the circle."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def square_corners(vertices: DataFrame, keys: list[str], within: float = 10.0) -> DataFrame:
    """Corners within so many degrees of a right angle made right, one after the other around the ring.

    A corner keeps the line of its longer side and moves to where the other neighbour stands above that
    line; corners already moved count. The state of the fold is the ring so far.
    """
    return corners_of(_squared(ring_rows_of(vertices, keys), within), keys)


def _squared(rows: DataFrame, within: float = 10.0) -> DataFrame:
    def moved(r: Column, i: Column) -> Column:
        n = F.size(r)
        at = lambda k: F.element_at(r, (F.pmod(k, n) + 1).cast("int"))
        p, q, s = at(i - 1 + n), at(i), at(i + 1)
        ax, ay, bx, by = p["x"] - q["x"], p["y"] - q["y"], s["x"] - q["x"], s["y"] - q["y"]
        la, lb = norm(ax, ay), norm(bx, by)
        angle = F.degrees(F.acos(clip((ax * bx + ay * by) / (la * lb), -1.0, 1.0)))
        near = (la > 0) & (lb > 0) & (F.abs(angle - 90) < within) & (F.abs(angle - 90) > 1e-9)
        t = F.when(la >= lb, (bx * ax + by * ay) / (la * la)).otherwise((ax * bx + ay * by) / (lb * lb))
        nx, ny = F.when(la >= lb, q["x"] + t * ax).otherwise(q["x"] + t * bx), F.when(la >= lb, q["y"] + t * ay).otherwise(q["y"] + t * by)
        fixed = F.struct(q["ord"].alias("ord"), nx.alias("x"), ny.alias("y"))
        return F.when(near, F.transform(r, lambda v, k: F.when(k == i, fixed).otherwise(v))).otherwise(r)

    done = F.when(F.size("r") >= 3, F.aggregate(F.sequence(F.lit(0), F.size("r") - 1), F.col("r"), moved)).otherwise(F.col("r"))
    return rows.withColumn("r", done)


def regularize(vertices: DataFrame, keys: list[str], factor: float = 0.015, align: bool = True, square: bool = False, lines: DataFrame | None = None, reach: float = 4.0, frame: tuple[int, int] | None = None, least_area: float = 0.0) -> DataFrame:
    """Simplified rings, on wish turned to their dominant direction and with right corners, moved onto near ``lines`` of their first key, without repeated corners, inside a frame of ``(height, width)`` and not below an area."""
    return _regular(ring_rows_of(vertices, keys), keys, factor, align, square, lines, reach, frame, least_area)


def _regular(rows: DataFrame, keys: list[str], factor: float, align: bool, square: bool, lines: DataFrame | None, reach: float, frame: tuple[int, int] | None, least_area: float) -> DataFrame:
    """The same for rings that are rows: corners are dealt only to meet lines and to be rings again, and written down between folds, which Spark would put into one another."""
    x = _simplified(rows, factor)
    if align:
        x = materialize(_aligned(x), "aligned")
    if square:
        x = materialize(_squared(materialize(_squared(x), "squared")), "squared")
    if lines is not None:
        x = ring_rows_of(snap_to_lines(corners_of(x, keys), lines, keys[0], reach), keys)
    x = corners_of(_without_repeats(x), keys)
    if frame:
        x = x.withColumns({"x": clip(F.col("x"), 0.0, frame[1] - 1.0), "y": clip(F.col("y"), 0.0, frame[0] - 1.0)})
    if least_area > 0:
        whole = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        area = F.abs(F.sum(F.col("x") * F.col("yn") - F.col("xn") * F.col("y")).over(whole) / 2)
        x = ring_edges(x, keys).withColumns({"__area": area, "__n": F.count(F.lit(1)).over(whole)}).where((F.col("__n") >= 3) & (F.col("__area") >= least_area)).select(*keys, "ord", "x", "y")
    return x


def polygons_of_masks(runs: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int, factor: float = 0.015, least_area: float = 100.0, align: bool = False, square: bool = False, lines: DataFrame | None = None) -> DataFrame:
    """``(keys, ring, ord, x, y)``: regular polygons of masks, from their outer outlines.

    Masks are smoothed by closing and opening with a plus; corners are those of cells, so a mask of one
    cell has the area 1. Holes do not count; outlines below the area go, before and after the corners move.
    Runs that are dealt by a key are smoothed and traced in their task; a ring is one row from then on.
    """
    smooth = opened_plus(closed_plus(runs, frames, keys, height, width), frames, keys, height, width)
    rows, number = ring_rows(outline(smooth, keys), keys)
    outer = rows.withColumn("__area", _signed_area(F.col("r"))).where((F.size("r") >= 3) & (F.col("__area") > 0) & (F.col("__area") >= least_area)).drop("__area")
    x = _regular(outer, [*keys, "low"], factor, align, square, lines, 4.0, (height + 1, width + 1), least_area)
    return x.join(number, [*keys, "low"]).select(*keys, "ring", "ord", "x", "y")


def dense_normal_error(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, error)`` over cells with a true normal (``gx..`` not all zero): 1 - cosine + half the mean absolute difference."""
    known = (F.col("gx") != 0) | (F.col("gy") != 0) | (F.col("gz") != 0)
    off = (F.abs(F.col("nx") - F.col("gx")) + F.abs(F.col("ny") - F.col("gy")) + F.abs(F.col("nz") - F.col("gz"))) / 3
    each = F.when(known, normal_error(cells) + 0.5 * off)
    return cells.groupBy(*keys).agg((F.coalesce(F.sum(each), F.lit(0.0)) / F.greatest(F.count(each), F.lit(1))).alias("error"))


def slope_weighted_error(weight: float = 1.0) -> Column:
    """Error of a unit normal (``nx..``) against the true one (``gx..``) in which direction counts more on steep facets."""
    flat = lambda a, b: F.greatest(norm(a, b), F.lit(1e-8))
    nx, ny, nz, gx, gy, gz = (F.col(c) for c in ("nx", "ny", "nz", "gx", "gy", "gz"))
    turn = 1 - (nx * gx + ny * gy) / (flat(nx, ny) * flat(gx, gy))
    return (1 - nz * gz) + weight * F.sqrt(F.greatest(1 - gz * gz, F.lit(0.0))) * turn


def planarity(cells: DataFrame, keys: list[str], total: float, least: int = 32) -> DataFrame:
    """``(keys, loss)`` of facets with enough cells: mean 1 - cosine to the facet's mean normal, times its share of all cells."""
    mean = cells.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in ("nx", "ny", "nz")]).where(F.col("n") >= least)
    m = mean.select(*keys, "n", *[u.alias(f"u{c}") for c, u in zip("xyz", unit(F.col("mnx"), F.col("mny"), F.col("mnz")), strict=True)])
    dot = F.col("nx") * F.col("ux") + F.col("ny") * F.col("uy") + F.col("nz") * F.col("uz")
    return cells.join(m, keys).groupBy(*keys).agg((F.avg(1 - dot) * F.first("n") / total).alias("loss"))


def facet_points(heights: DataFrame, runs: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """Finite height cells inside each facet's runs, x and y in map units: cell and run meet by key and row."""
    on = [F.col(f"h.{k}") == F.col(f"r.{k}") for k in (*keys, "y")]
    x = heights.alias("h").join(runs.alias("r"), on + [(F.col("h.x") >= F.col("r.x0")) & (F.col("h.x") < F.col("r.x1"))])
    x = x.where(F.col("h.z").isNotNull() & ~F.isnan("h.z") & (F.abs("h.z") < float("inf")))
    return x.select(*[F.col(f"h.{k}") for k in keys], "r.facet", (F.col("h.x") * scale).alias("x"), (F.col("h.y") * scale).alias("y"), "h.z")
