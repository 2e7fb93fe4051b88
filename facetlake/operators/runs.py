"""Masks as tables of horizontal runs ``(key..., y, x0, x1)`` with ``x1`` exclusive; all set algebra and morphology on them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.operators.components import connected_components
from facetlake.storage import materialize


def same(keys: list[str], a: str = "a", b: str = "b") -> Column:
    """Equality of key columns of two aliased tables."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys))


def to_pixels(runs: DataFrame) -> DataFrame:
    """One row a cell, other columns kept."""
    return runs.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1))).drop("x0", "x1")


def to_runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Longest runs of neighbouring cells that agree in ``keys`` and y. A cell may come more than once.

    Cells are bits of words of 32 places, so none are sorted; stretches of set bits are runs, and those
    of neighbouring words that touch become one.
    """
    shift = lambda name, *of: F.call_function(name, *of)
    bit = shift("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(F.lit(31)).cast("int"))
    words = pixels.groupBy(*keys, "y", F.shiftright("x", 5).alias("__at")).agg(F.bit_or(bit).alias("__w"))
    w = F.col("__w")
    begins = w.bitwiseAND(F.bitwise_not(F.shiftleft(w, 1)))

    def stretch(first: Column) -> Column:
        rest, x0 = shift("shiftright", w, first), F.col("__at") * 32 + first
        return F.struct(x0.alias("x0"), (x0 + F.bit_count(rest.bitwiseXOR(rest + 1)) - 1).alias("x1"))

    one = stretch(F.bit_count(w.bitwiseAND(-w) - 1))  # most words hold one stretch
    each = F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: shift("shiftright", begins, i).bitwiseAND(F.lit(1)) == 1), stretch)
    return merge_runs(words.select(*keys, "y", F.inline(F.when(F.bit_count(begins) == 1, F.array(one)).otherwise(each))), keys)


def merge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Union of runs of equal keys: overlapping and touching ones become one. A running maximum of ends marks where a new one begins."""
    order = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.sum(F.when(F.coalesce(F.col("x0") > reach, F.lit(True)), 1).otherwise(0)).over(order)
    return runs.select(*keys, "y", "x0", "x1").withColumn("__n", begun).groupBy(*keys, "y", "__n").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("__n")


def clip(runs: DataFrame, height: int, width: int) -> DataFrame:
    """The part of the runs inside the frame."""
    x = runs.withColumns({"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.lit(width))})
    return x.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x0") < F.col("x1")))


def sweep(runs: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Elementary intervals of each row of cells between consecutive endpoints of all its runs, with the number ``n`` of runs over each.

    ``weight`` adds the sum ``w`` of that column over them. Both are running sums over the sorted
    endpoints, one sort a row however many runs lie on each other; sums are decimal, so what a run adds
    at its begin goes at its end exactly.
    """
    end = lambda at, sign: F.struct(F.col(at).alias("at"), F.lit(sign).alias("n"), *([(F.lit(sign) * F.col(weight).cast("decimal(24,12)")).alias("w")] if weight else []))
    ends = runs.select(*keys, "y", F.inline(F.array(end("x0", 1), end("x1", -1))))
    sums = ["n", "w"] if weight else ["n"]
    ends = ends.withColumnRenamed("at", "x0")
    order = Window.partitionBy(*keys, "y").orderBy("x0")  # ends at one place are peers: each has the sum of all, and only the last of them an interval
    x = ends.withColumns({**{c: F.sum(c).over(order) for c in sums}, "x1": F.lead("x0").over(order)})
    return x.where("n > 0 AND x1 > x0").select(*keys, "y", "x0", "x1", *sums)


def overlay(layers: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Runs of the value on top: where layers overlap, the largest ``order`` (numbers, null lowest) wins.

    Rows of cells stream through, sorted by where their runs begin. What lies left of the newest begin is
    final; only the runs that are still open there are kept, so neither a scene nor a row is gathered.
    """
    fields = {f.name: f.dataType for f in layers.schema.fields}
    names = [*keys, "y"]
    kinds = T.StructType([T.StructField(c, fields[c]) for c in (*names, "x0", "x1", value)])
    ranks = [f"rank{i}" for i in range(len(order))]

    def skyline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for b in chain(batches, [None]):
            whole = pa.Table.from_batches([x for x in (held, b) if x is not None]).combine_chunks() if held is not None or b is not None else None
            if whole is None or not whole.num_rows:
                continue
            fresh = _changes(whole, names)
            row = np.cumsum(fresh) - 1
            x0, x1 = (whole.column(c).to_numpy().astype(np.int64) for c in ("x0", "x1"))
            cut = x0[-1] if b is not None else None
            until = x1 if b is None else np.where(row == row[-1], np.minimum(x1, cut), x1)
            done = np.flatnonzero(x0 < until)
            if b is not None:
                opened = np.flatnonzero((row == row[-1]) & (x1 > cut))
                held = whole.take(pa.array(opened))
                held = held.set_column(held.column_names.index("x0"), "x0", pa.array(np.maximum(x0[opened], cut)).cast(held.schema.field("x0").type)).combine_chunks()
                held = held.to_batches()[0] if held.num_rows else None
            else:
                held = None
            if len(done):
                sort = [(whole.column(c).take(pa.array(done)), "ascending") for c in ranks]
                rank = np.lexsort([-done, *[pc.rank(c.combine_chunks(), sort_keys=way, null_placement="at_start", tiebreaker="dense").to_numpy() for c, way in reversed(sort)]])
                seen, begin, end, top = _skyline(row[done], x0[done], until[done], np.argsort(rank))
                out = whole.select([*names, value]).take(pa.array(done[top]))
                for k, (c, v) in enumerate((("x0", begin), ("x1", end))):
                    out = out.add_column(len(names) + k, c, pa.array(v).cast(whole.schema.field(c).type))
                out = pa.concat_tables([x for x in (last, out) if x is not None]).combine_chunks()
                fresh = _changes(out, [*names, value])
                begin, end = out.column("x0").to_numpy(), out.column("x1").to_numpy()
                fresh[1:] |= begin[1:] != end[:-1]
                first = np.flatnonzero(fresh)
                ends = out.column("x1").take(pa.array(np.append(first[1:], len(fresh)) - 1))
                out = out.take(pa.array(first)).set_column(len(names) + 1, "x1", ends).combine_chunks()
                last = out.slice(out.num_rows - 1)  # it may still grow
                yield from out.slice(0, out.num_rows - 1).to_batches()
        if last is not None:
            yield from last.to_batches()

    ranked = [F.col(o).alias(r) for o, r in zip(order, ranks, strict=True)]
    rows = layers.select(*names, "x0", "x1", value, *ranked).where("x0 < x1")
    # a window brings a row's runs together as a repartition would, but leaves them where they are dealt by some of the keys already
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*names).orderBy("x0"))).sortWithinPartitions(*names, "x0")
    return rows.mapInArrow(skyline, kinds)


def _skyline(row: np.ndarray, x0: np.ndarray, x1: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(row, x0, x1, which)`` of elementary intervals and the run of the largest rank over each; ranks are 0, 1, 2 ... in some order.

    A run lies over a stretch of intervals, which two stretches of the same power of two cover. Each power
    hands its largest ranks down to both halves, down to single intervals.
    """
    low = x0.min()
    width = int(x1.max() - low) + 1
    begin, end = row * width + x0 - low, row * width + x1 - low
    places = np.unique(np.concatenate((begin, end)))
    a, b = np.searchsorted(places, begin), np.searchsorted(places, end)
    power = np.frexp((b - a).astype(np.float64))[1] - 1
    by = np.argsort(rank)  # later ones overwrite
    above = np.full(len(places), -1, np.int64)
    for k in range(int(power.max()), -1, -1):
        own = by[power[by] == k]
        best = np.full(len(places), -1, np.int64)
        best[a[own]] = rank[own]
        other = np.full(len(places), -1, np.int64)
        other[b[own] - (1 << k)] = rank[own]
        best = np.maximum(best, other)
        if k < int(power.max()):  # what the next larger power hands down, to either half
            best = np.maximum(best, above)
            best[1 << k :] = np.maximum(best[1 << k :], above[: len(places) - (1 << k)])
        above = best
    at = np.flatnonzero(above >= 0)
    return places[at] // width, places[at] % width + low, places[at + 1] % width + low, by[above[at]]


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Overlaps of two tables' runs: ``keys, y, x0, x1``. The key and the row meet by an equi-join, the interval is a residual."""
    met = a.alias("a").join(b.alias("b"), same([*keys, "y"]) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")))
    return met.select(*[F.col(f"a.{k}") for k in (*keys, "y")], F.greatest("a.x0", "b.x0").alias("x0"), F.least("a.x1", "b.x1").alias("x1"))


def complement(runs: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Cells of the frame that no run covers; ``frames`` has each key once, with or without runs."""
    rows = frames.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    edge = rows.select(*keys, "y", F.lit(0).alias("x0"), F.lit(0).alias("x1")).unionByName(rows.select(*keys, "y", F.lit(width).alias("x0"), F.lit(width).alias("x1")))
    order = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    gaps = merge_runs(clip(runs, height, width), keys).unionByName(edge).withColumn("__end", F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return gaps.where(F.col("__end") < F.col("x0")).select(*keys, "y", F.col("__end").alias("x0"), F.col("x0").alias("x1"))


def dilate(runs: DataFrame, keys: list[str], height: int, width: int, radius: int = 1) -> DataFrame:
    """Square dilation; what leaves the frame is cut off."""
    grown = runs.select(*keys, F.explode(F.sequence(F.col("y") - radius, F.col("y") + radius)).alias("y"), (F.col("x0") - radius).alias("x0"), (F.col("x1") + radius).alias("x1"))
    return merge_runs(clip(grown, height, width), keys)


def _covered(parts: DataFrame, keys: list[str], needed: Column, height: int) -> DataFrame:
    """Runs of the cells that ``needed`` of the parts cover, each row's own number; parts of one origin are disjoint."""
    inside = parts.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x0") < F.col("x1")))
    return merge_runs(sweep(inside, keys).where(F.col("n") == needed), keys)


def _narrowed(width: int, radius: int) -> dict[str, Column]:
    """Both ends of a run drawn in, but for those on the frame: what lies outside it counts as set."""
    return {"x0": F.when(F.col("x0") > 0, F.col("x0") + radius).otherwise(F.lit(0)), "x1": F.when(F.col("x1") < width, F.col("x1") - radius).otherwise(F.lit(width))}


def erode(runs: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int, radius: int = 1) -> DataFrame:
    """Cells whose whole window inside the frame is set: those that the narrowed runs of all rows of the window cover, found by one sweep."""
    own = clip(merge_runs(runs, keys), height, width).withColumns(_narrowed(width, radius))
    near = own.withColumn("y", F.explode(F.sequence(F.col("y") - radius, F.col("y") + radius)))
    rows = F.least(F.col("y") + radius, F.lit(height - 1)) - F.greatest(F.col("y") - radius, F.lit(0)) + 1
    return _covered(near, keys, rows, height)


def _border(runs: DataFrame, keys: list[str], height: int, width: int, radius: int, grown: int) -> DataFrame:
    """Cells within ``grown`` (up to ``radius``) of a mask, less its erosion: one sweep counts the grown and the narrowed runs over each interval."""
    own, n = clip(merge_runs(runs, keys), height, width), _narrowed(width, radius)
    near = own.withColumn("__d", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("y", F.col("y") + F.col("__d")).where((F.col("y") >= 0) & (F.col("y") < height))
    inside, outside = (n["x0"] < n["x1"]).cast("int"), (F.abs("__d") <= grown).cast("int")
    end = lambda at, n, m: F.struct(at.cast("long").alias("x0"), n.alias("__n"), m.alias("__m"))
    wide = [F.greatest(F.col("x0") - grown, F.lit(0)), F.least(F.col("x1") + grown, F.lit(width))]
    none = F.lit(0)
    ends = near.select(*keys, "y", F.inline(F.array(end(n["x0"], inside, none), end(n["x1"], -inside, none), end(wide[0], none, outside), end(wide[1], none, -outside))))
    # rows beside each other mostly begin and end alike: what falls on one place is summed before anything is sorted
    ends = ends.groupBy(*keys, "y", "x0").agg(*[F.sum(c).alias(c) for c in ("__n", "__m")])
    order = Window.partitionBy(*keys, "y").orderBy("x0")
    x = ends.withColumns({**{c: F.sum(c).over(order) for c in ("__n", "__m")}, "x1": F.lead("x0").over(order)})
    rows = F.least(F.col("y") + radius, F.lit(height - 1)) - F.greatest(F.col("y") - radius, F.lit(0)) + 1
    return merge_runs(x.where((F.col("x1") > F.col("x0")) & (F.col("__m") > 0) & (F.col("__n") < rows)), keys)


def gradient(runs: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int, radius: int = 1) -> DataFrame:
    """Dilation less erosion."""
    return _border(runs, keys, height, width, radius, radius)


def inner_border(runs: DataFrame, keys: list[str], height: int, width: int, radius: int = 1) -> DataFrame:
    """The mask less its erosion: its cells within ``radius`` of one that is not set."""
    return _border(runs, keys, height, width, radius, 0)


def opened(runs: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int, radius: int = 1) -> DataFrame:
    return dilate(erode(runs, frames, keys, height, width, radius), keys, height, width, radius)


def closed(runs: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int, radius: int = 1) -> DataFrame:
    return erode(dilate(runs, keys, height, width, radius), frames, keys, height, width, radius)


def dilate_plus(runs: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Dilation by a plus: a cell's row neighbours and column neighbours."""
    return merge_runs(clip(_plus(runs, keys, F.col("x0") - 1, F.col("x1") + 1), height, width), keys)


def _plus(runs: DataFrame, keys: list[str], x0: Column, x1: Column) -> DataFrame:
    """Each run with other ends in its own row and as it is in the rows beside it; one explosion, so runs stay in their task."""
    at = lambda y, a, b: F.struct(y.cast("long").alias("y"), a.cast("long").alias("x0"), b.cast("long").alias("x1"))
    y = F.col("y")
    return runs.select(*keys, F.inline(F.array(at(y, x0, x1), *[at(y + d, F.col("x0"), F.col("x1")) for d in (-1, 1)])))


def erode_plus(runs: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Cells whose plus inside the frame is set: covered by the narrowed runs of their row and by the runs of the rows beside it."""
    own = clip(merge_runs(runs, keys), height, width)
    drawn = _narrowed(width, 1)
    rows = 3 - (F.col("y") == 0).cast("int") - (F.col("y") == height - 1).cast("int")
    return _covered(_plus(own, keys, drawn["x0"], drawn["x1"]), keys, rows, height)


def opened_plus(runs: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    return dilate_plus(erode_plus(runs, frames, keys, height, width), keys, height, width)


def closed_plus(runs: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    return erode_plus(dilate_plus(runs, keys, height, width), frames, keys, height, width)


def outline(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Directed unit-free edges around each mask: ``(keys, x1, y1, x2, y2)``, the mask on the right of each edge.

    Run ends are upright edges. Where two neighbouring rows of cells differ, the stretch is a level
    edge: elementary intervals of both rows that only one of them covers. Summed as a shoelace, the
    edges of a mask give its area. Runs that are dealt by some of the keys stay in their task.
    """
    y, at, to = F.col("y"), F.col("__at"), F.col("__to")
    end = lambda y, at, d, side: F.struct(y.alias("y"), F.col(at).alias("__at"), F.lit(d).alias("__d"), F.lit(side).alias("__side"))
    ends = merge_runs(runs, keys).select(*keys, F.inline(F.array(end(y, "x0", 1, -1), end(y, "x1", -1, 1), end(y + 1, "x0", -1, 0), end(y + 1, "x1", 1, 0))))
    order = Window.partitionBy(*keys, "y").orderBy("__at")  # ends at one place are peers: each has the sum of all, and only the last of them a stretch
    x = ends.withColumns({"__in": F.sum("__d").over(order), "__to": F.lead("__at").over(order)})
    edge = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    upright = F.when(F.col("__side") < 0, edge(at, y + 1, at, y)).when(F.col("__side") > 0, edge(at, y, at, y + 1))
    top = F.col("__in") > 0  # the row below the line is in, the one above is not
    level = F.when((F.col("__in") != 0) & (to > at), edge(F.when(top, at).otherwise(to), y, F.when(top, to).otherwise(at), y))
    return x.select(*keys, F.inline(F.array(upright, level))).where("x1 IS NOT NULL")


def rings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, ring, ord, x, y)``: the corners of an ``outline`` in order, one ring an outline or hole, first its topmost and then leftmost corner.

    Edges in line become one, so every edge ends at a turn. At a corner where two edges begin the one
    that turns toward the mask follows, so cells that touch at a corner alone have rings of their own.
    A pass over blocks of neighbouring rows traces what stays inside a block: whole rings, and chains that
    leave it. Only chains go through rounds of pointer doubling, in each of which one knows the first
    corner of twice as many chains ahead and how far off it is, until none learns of another. No mask
    is gathered, however long its outline. Outer rings have a positive ``signed`` area, holes a negative one.
    """
    whole, part = _ring_parts(edges, keys)
    first = whole.select(*keys, "low")
    number = _numbered(first if part is None else first.unionByName(part.where("ord = 0").select(*keys, "low")), keys)
    x = whole.join(number, [*keys, "low"])
    x = x.select(*keys, "ring", F.explode("r").alias("p")).select(*keys, "ring", "p.ord", "p.x", "p.y")
    if part is not None:
        x = x.unionByName(part.join(number, [*keys, "low"]).select(*keys, "ring", "ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    return x


def ring_rows(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(keys, low, r)``: the same rings as one row each with its corners ``(ord, x, y)`` in order, and ``(keys, low, ring)``: the number of each.

    ``low`` is a ring's first corner. Nothing is joined for rings that stay inside a block of rows.
    """
    whole, part = _ring_parts(edges, keys)
    x = whole
    if part is not None:
        x = x.unionByName(part.groupBy(*keys, "low").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("r")))
    return x, _numbered(x.select(*keys, "low"), keys)


def _numbered(first: DataFrame, keys: list[str]) -> DataFrame:
    """Rings of a mask numbered by their first corners."""
    return first.select(*keys, "low", (F.row_number().over(Window.partitionBy(*keys).orderBy("low")) - 1).cast("long").alias("ring")).hint("merge")


def _ring_parts(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rings that stay inside a block as rows ``(keys, low, r)``, and the corners ``(keys, low, ord, x, y)`` of those that leave one, if any do."""
    seen = Observation()
    traced = materialize(_traced(edges, keys).observe(seen, F.count("chain").alias("n")), "corners")
    whole = traced.where("r IS NOT NULL").select(*keys, "low", "r")
    if not seen.get["n"]:
        return whole, None
    ring = _joined_chains(traced.where("xe IS NOT NULL"), keys).hint("merge")
    off = F.pmod(F.col("ahead") - (F.col("n") - 1 - F.col("to_tail")), F.col("ring_size"))
    part = traced.where("chain IS NOT NULL").select(*keys, "x", "y", "chain", "to_tail").join(ring, "chain")
    # every edge now knows its ring's first corner, how many edges ahead that is and how many the ring has
    return whole, part.select(*keys, "low", F.pmod(F.col("ring_size") - off, F.col("ring_size")).cast("int").alias("ord"), "x", "y")


def _traced(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges from turn to turn, traced inside blocks of neighbouring rows: ``(keys, x, y, low, off, chain, to_tail, xe, ye, tail, r)``.

    A ring that stays inside its block is one row with its first corner ``low`` and all its corners ``r``.
    Where a ring leaves its block each edge is a row: ``low`` is the first corner of the rest of the chain,
    ``off`` how many edges ahead it is, ``to_tail`` how many the end of the ``chain`` is, and a chain's
    first edge has its own end ``xe, ye`` and the last edge.
    """
    upright, ahead = F.col("x1") == F.col("x2"), F.col("x1") + F.col("y1") < F.col("x2") + F.col("y2")
    line = edges.select(*keys, upright.alias("upright"), ahead.alias("ahead"), F.when(upright, F.col("x1")).otherwise(F.col("y1")).alias("y"), F.when(upright, F.least("y1", "y2")).otherwise(F.least("x1", "x2")).alias("x0"), F.when(upright, F.greatest("y1", "y2")).otherwise(F.greatest("x1", "x2")).alias("x1"))
    line = merge_runs(line, [*keys, "upright", "ahead"])
    start, end = F.when(F.col("ahead"), F.col("x0")).otherwise(F.col("x1")), F.when(F.col("ahead"), F.col("x1")).otherwise(F.col("x0"))
    at = {"x": F.when(F.col("upright"), F.col("y")).otherwise(start), "y": F.when(F.col("upright"), start).otherwise(F.col("y")), "xe": F.when(F.col("upright"), F.col("y")).otherwise(end), "ye": F.when(F.col("upright"), end).otherwise(F.col("y"))}
    turns = line.select(*keys, *[c.cast("long").alias(n) for n, c in at.items()]).withColumn("block", F.floor(F.col("y") / BLOCK_ROWS))
    names = [*keys, "block"]
    # a window brings a block's edges together as a repartition would, but leaves them where they are dealt by some of the keys already
    dealt = turns.withColumn("__n", F.row_number().over(Window.partitionBy(*names).orderBy("y", "x"))).sortWithinPartitions(*names, "y", "x")
    more = ["x", "y", "low_x", "low_y", "off", "chain", "to_tail", "xe", "ye", "tx", "ty", "txe", "tye"]
    corners = T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in "xy"]]))
    kinds = T.StructType([*[dealt.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in more], T.StructField("r", corners)])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chain's number is the task's and that of its last edge."""
        first = TaskContext.get().partitionId() << 40
        for whole in _whole_blocks(batches, names):
            got = _chains(np.cumsum(_changes(whole, names)), *(whole.column(c).to_numpy() for c in ("block", "x", "y", "xe", "ye")))
            shut = np.flatnonzero(got["shut"])
            by = shut[np.lexsort((got["ord"][shut], got["first"][shut]))]
            begins = np.flatnonzero(got["ord"][by] == 0)
            point = pa.StructArray.from_arrays([pa.array(got["ord"][by].astype(np.int32)), *[pa.array(got[c][0][by].astype(np.float64)) for c in "xy"]], ["ord", "x", "y"])
            places = {"ring": pa.array(by[begins]), "open": pa.array(np.flatnonzero(~got["shut"]))}
            for kind, at in places.items():
                out = whole.select(keys).take(at)
                for c in more:
                    v, there = got[c]
                    there = np.full(len(v), c.startswith("low")) if kind == "ring" else there
                    v = pa.array(v + first if c == "chain" else v, mask=None if there is None else ~there)
                    out = out.append_column(c, v.take(at))
                r = pa.ListArray.from_arrays(pa.array(np.append(begins, len(by)).astype(np.int32)), point) if kind == "ring" else pa.nulls(len(at), pa.list_(point.type))
                yield from out.append_column("r", r).combine_chunks().to_batches()
            first += whole.num_rows

    corner = lambda x, y: F.struct(F.col(y).alias("y"), F.col(x).alias("x"))
    tail = F.struct(*[F.col(c).alias(c[1:]) for c in ("tx", "ty", "txe", "tye")])
    return dealt.mapInArrow(trace, kinds).select(*keys, "x", "y", corner("low_x", "low_y").alias("low"), "off", "chain", "to_tail", "xe", "ye", tail.alias("tail"), "r")


def _chains(own: np.ndarray, block: np.ndarray, x: np.ndarray, y: np.ndarray, xe: np.ndarray, ye: np.ndarray) -> dict:
    """For edges of many blocks, each block's sorted by where they begin: values and where there are any, for the columns of ``_traced``; which edges are of rings that are ``shut``, the ``first`` edge of each and their place ``ord`` behind it."""
    n, every = len(x), np.arange(len(x))
    left, high = min(x.min(), xe.min()), BLOCK_ROWS + 1
    width = int(max(x.max(), xe.max()) - left) + 1
    place = lambda x, y: (own * high + y - block * BLOCK_ROWS) * width + x - left
    inside = ye // BLOCK_ROWS == block
    begin, end = place(x, y), np.where(inside, place(xe, ye), -1)
    low, high = np.searchsorted(begin, end, "left"), np.searchsorted(begin, end, "right")
    one, two = np.minimum(low, n - 1), np.maximum(high - 1, 0)
    # with two ways on, turn toward the mask, which is on the right as seen on the screen
    cross = lambda b: (xe - x) * (ye[b] - y[b]) - (ye - y) * (xe[b] - x[b])
    goes = inside & (low < high)
    after = np.where(goes, np.where(cross(two) > cross(one), two, one), every)  # a chain's last edge stays where it is
    at, far, low, off = after, goes.astype(np.int64), every, np.zeros(n, np.int64)
    for _ in range(int(np.bincount(own).max()).bit_length()):
        closer = low[at] < low
        off = np.where(closer, far + off[at], off)
        low = np.minimum(low, low[at])
        far, at = far + far[at], at[at]
    left_open = ~goes[at]
    size = np.zeros(n, np.int64)
    np.maximum.at(size, low, off + 1)
    head = left_open.copy()
    head[after[goes]] = False
    return {
        "shut": ~left_open, "first": low, "ord": (size[low] - off) % size[low],
        "x": (x, None), "y": (y, None), "low_x": (x[low], None), "low_y": (y[low], None), "off": (off, None), "chain": (at, left_open), "to_tail": (far, left_open),
        "xe": (xe, head), "ye": (ye, head), "tx": (x[at], head), "ty": (y[at], head), "txe": (xe[at], head), "tye": (ye[at], head),
    }


def _joined_chains(chains: DataFrame, keys: list[str]) -> DataFrame:
    """``(chain, low, ahead, n, ring_size)``: the first corner of each chain's ring, how many edges it is ahead of the chain's first one, the edges of the chain and of the ring."""
    own = chains.select("chain", *keys, "x", "y", "xe", "ye", "tail", "low", "off", (F.col("to_tail") + 1).alias("n"))
    met = own.alias("a").join(own.alias("b").hint("merge"), same(keys) & (F.col("a.tail.xe") == F.col("b.x")) & (F.col("a.tail.ye") == F.col("b.y")))
    cross = (F.col("a.tail.xe") - F.col("a.tail.x")) * (F.col("b.ye") - F.col("b.y")) - (F.col("a.tail.ye") - F.col("a.tail.y")) * (F.col("b.xe") - F.col("b.x"))
    x = met.groupBy(*[F.col(f"a.{c}").alias(c) for c in ("chain", *keys, "low", "off", "n")]).agg(F.max_by("b.chain", cross).alias("next"))
    state, changed = materialize(x.withColumn("step", F.col("n")), "chains"), 1
    while changed:
        ahead = state.select(F.col("chain").alias("next"), F.col("next").alias("far"), F.col("low").alias("low_far"), F.col("off").alias("off_far"), F.col("step").alias("step_far")).hint("merge")
        closer = F.col("low_far") < F.col("low")
        x = state.join(ahead, "next").select(
            "chain", *keys, "n", F.col("far").alias("next"), F.when(closer, F.col("low_far")).otherwise(F.col("low")).alias("low"),
            F.when(closer, F.col("off_far") + F.col("step")).otherwise(F.col("off")).alias("off"), (F.col("step") + F.col("step_far")).alias("step"), closer.alias("moved"),
        )
        seen = Observation()
        state = materialize(x.observe(seen, F.sum(F.col("moved").cast("long")).alias("n")).drop("moved"), "chains")
        changed = seen.get["n"] or 0
    size = state.groupBy(*keys, "low").agg(F.sum("n").alias("ring_size"))
    return state.join(size.hint("merge"), [*keys, "low"]).select("chain", "low", F.col("off").alias("ahead"), "n", "ring_size")


def rasterize(vertices: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Runs that a ring ``(keys, ord, x, y)`` of whole-number corners fills: even-odd along each row, outline included.

    Edges that cross a row sort by where they do; odd and even crossings pair up. The outline adds
    each edge's own cells in its rows.
    """
    edges = ring_edges(vertices, keys)
    low, high = F.least("y", "yn"), F.greatest("y", "yn")
    rows = edges.withColumn("row", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    flat = F.col("y") == F.col("yn")
    at = F.when(flat, F.col("x")).otherwise(F.col("x") + (F.col("row") - F.col("y")) * (F.col("xn") - F.col("x")) / (F.col("yn") - F.col("y")))
    rows = rows.withColumns({"at": at, "crosses": ~flat & (F.col("row") < high)})
    # crossings come first in their row, so each odd one has its partner behind it and nothing is joined
    order = Window.partitionBy(*keys, "row").orderBy(F.desc("crosses"), "at", "ord")
    rows = rows.withColumns({"n": F.row_number().over(order), "to": F.lead(F.when(F.col("crosses"), F.col("at"))).over(order)})
    span = lambda x0, x1: F.struct(x0.cast("long").alias("x0"), x1.cast("long").alias("x1"))
    pair = F.when(F.col("crosses") & (F.col("n") % 2 == 1), span(F.ceil("at"), F.floor(F.coalesce("to", "at")) + 1)).otherwise(span(F.lit(0), F.lit(0)))
    outline = span(F.when(flat, F.least("x", "xn")).otherwise(F.round("at")), F.when(flat, F.greatest("x", "xn")).otherwise(F.round("at")) + 1)
    return merge_runs(clip(rows.select(*keys, F.col("row").alias("y"), F.inline(F.array(pair, outline))), height, width), keys)


def ring_edges(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Each corner with the corner before (``xp, yp``) and after (``xn, yn``), around the ring."""
    order = Window.partitionBy(*keys).orderBy("ord")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = {}
    for c in ("x", "y"):
        around[f"{c}n"] = F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
        around[f"{c}p"] = F.coalesce(F.lag(c).over(order), F.last(c).over(whole))
    return vertices.withColumns(around)


def touching(runs: DataFrame, key: str, id_col: str = "inst") -> DataFrame:
    """Pairs ``(a, b)`` of instances of one ``key``, ``a`` below ``b``, that share cells or a stretch of border, corners alone not counted."""
    own = runs.select(key, id_col, "y", "x0", "x1").hint("merge")
    beside = own.withColumn("y", F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)))
    met = own.alias("a").join(beside.alias("b"), same([key, "y"]) & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")))
    side = own.alias("a").join(own.alias("b"), same([key, "y"]) & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}")) & ((F.col("a.x0") == F.col("b.x1")) | (F.col("b.x0") == F.col("a.x1"))))
    pair = [F.col(f"a.{id_col}").alias("a"), F.col(f"b.{id_col}").alias("b")]
    return met.select(*pair).unionByName(side.select(*pair)).distinct()


#: Rows of cells that one pass labels together.
BLOCK_ROWS = 128
#: Runs that one task labels.
TASK_RUNS = 1 << 19


def run_components(runs: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS, area: bool = False) -> DataFrame:
    """8-connected components: runs of neighbouring rows that touch, corners too, share a component number.

    Returns the merged runs with ``component``, and with ``area`` the cells of it. A pass over blocks of neighbouring rows labels what is
    connected inside a block; only the labels of runs that touch across two blocks' border go through
    the rounds of ``connected_components``. Labels are written down, so that they stay what they are when
    a task runs again. Runs are counted while they are written, so tasks grow in number and not in size.
    """
    seen = Observation()
    own = materialize(runs.select(*keys, "y", "x0", "x1").observe(seen, F.count(F.lit(1)).alias("n")), "runs")
    dealt = own.withColumn("block", F.floor(F.col("y") / block_rows)).repartition(max(1, -(-seen.get["n"] // TASK_RUNS)), *keys, "block")
    dealt = merge_runs(dealt, [*keys, "block"]).sortWithinPartitions(*keys, "block", "y", "x0")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole blocks at a time; a label is the task's number and that of the component's first run."""
        first = TaskContext.get().partitionId() << 40
        for whole in _whole_blocks(batches, [*keys, "block"]):
            own = np.cumsum(_changes(whole, [*keys, "block"]))
            y, x0, x1 = (whole.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
            at = _touching_labels(own, y, x0, x1)
            cells = np.zeros(len(at), np.int64)
            np.add.at(cells, at, x1 - x0)
            out = whole.append_column("label", pa.array(at + first)).append_column("cells", pa.array(cells[at])).append_column("begins", pa.array(at == np.arange(len(at))))
            yield from out.combine_chunks().to_batches()
            first += whole.num_rows

    nodes = materialize(dealt.mapInArrow(label, f"{names}, label long, cells long, begins boolean").drop("block"), "nodes")
    low, high = nodes.where(F.pmod(F.col("y") + 1, F.lit(block_rows)) == 0), nodes.where(F.pmod("y", F.lit(block_rows)) == 0)
    met = low.alias("a").join(high.alias("b"), same(keys) & (F.col("a.y") + 1 == F.col("b.y")) & (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")))
    labels = connected_components(met.select(F.col("a.label").alias("a"), F.col("b.label").alias("b")))
    if area:  # cells of labels that are whole components are known; only those of labels that meet are summed
        total = labels.join(nodes.where("begins").select(F.col("label").alias("node"), "cells"), "node").groupBy("component").agg(F.sum("cells").alias("total"))
        labels = labels.join(total, "component")
    x = nodes.join(labels, F.col("label") == F.col("node"), "left").withColumn("component", F.coalesce("component", "label"))
    return (x.withColumn("area", F.coalesce("total", "cells")).drop("total") if area else x).drop("node", "label", "cells", "begins")


def _changes(t: pa.Table, names: list[str]) -> np.ndarray:
    """Whether each row differs from the one before in a column, nulls being equal; the first one does."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for c in names:
        code = t.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        out[1:] |= code[1:] != code[:-1]
    return out


def _whole_blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by their block, of whole blocks at a time. Batches come one after the other, a task's rows are never held together."""
    held = []
    for b in chain(batches, [None]):
        if b is not None:
            if not b.num_rows:
                continue
            held.append(b)
            if not (cut := _block_start(held, names)):
                continue
            whole, held = pa.Table.from_batches(held), [b.slice(cut - sum(x.num_rows for x in held[:-1]))]
            yield whole.slice(0, cut)
        elif held:
            yield pa.Table.from_batches(held)


def _block_start(held: list[pa.RecordBatch], names: list[str]) -> int:
    """Where the last block of some batches begins; 0 if they are of one block. Only the newest batch and the row before it are looked at."""
    before = sum(b.num_rows for b in held[:-1])
    edge = pa.Table.from_batches(([held[-2].slice(held[-2].num_rows - 1)] if len(held) > 1 else []) + held[-1:])
    found = np.flatnonzero(_changes(edge, names)[1:])
    return int(found[-1]) + 1 + before - (len(held) > 1) if len(found) else 0


def _touching_labels(own: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """For sorted runs of many blocks: the number of the first run that each is connected to inside its block.

    All rows are put on one line, one after the other, so a run's neighbours in the next row are a
    stretch found by bisection. Labels then fall to the smallest that touches and to that one's own,
    until none does.
    """
    fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (y[1:] != y[:-1])))
    row, begins = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    width = int(x1.max() - x0.min()) + 2
    begin, end = row * width + x0 - x0.min(), row * width + x1 - x0.min()
    follows = np.concatenate(((own[begins[1:]] == own[begins[:-1]]) & (y[begins[1:]] == y[begins[:-1]] + 1), [False]))[row]
    low, high = np.searchsorted(end, begin + width, "left"), np.searchsorted(begin, end + width, "right")
    n = np.where(follows, np.maximum(high - low, 0), 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(a))
    at = np.arange(len(y))
    while len(a):
        least = np.minimum(at[a], at[b])
        new = at.copy()
        for side in (a, b, at[a], at[b]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == at).all():
            break
        at = new
    return at


def tile_origins(size: Column, tile: int, stride: int) -> Column:
    """Array of origins that cover ``size``: every stride, and the last one flush with the end; a small frame has one."""
    last = F.greatest(size - tile, F.lit(0)).cast("int")
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def reflect_pad(cells: DataFrame, keys: list[str], height: int, width: int, multiple: int) -> DataFrame:
    """Mirror cells beyond the last row and column up to the next multiple, the edge itself not repeated; a cell goes to its own places, so nothing is joined."""

    def places(at: str, n: int) -> Column:
        last, period = -(-n // multiple) * multiple - 1, max(1, 2 * (n - 1))
        every = lambda first: F.when(first <= last, F.sequence(first, F.lit(last), F.lit(period))).otherwise(F.array().cast("array<int>"))
        own = F.col(at).cast("int")
        return F.explode(F.when(own.between(0, n - 1), F.array_distinct(F.concat(every(own), every(period - own)))))

    x = cells.withColumn("__y", places("y", height)).withColumn("__x", places("x", width))
    return x.drop("y", "x").withColumnsRenamed({"__y": "y", "__x": "x"})
