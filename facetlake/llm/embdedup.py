"""Embedding near-duplicates: int8 tile products with error bounds, full precision only where they leave doubt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.llm.simhash import local_roots
from facetlake.operators.components import connected_components
from facetlake.storage import materialize

#: Vectors in a tile at most, and bytes of their components as doubles: a task holds two tiles. Larger tiles mean fewer copies of each vector.
TILE_ROWS, TILE_BYTES = 16384, 64 << 20
#: Rows and columns of one product, and pairs recomputed at a time.
BLOCK_ROWS, BLOCK_COLS, CHUNK = 512, 4096, 1 << 16
#: Covers the rounding of the single-precision products and sums; far above it, far below any useful difference.
SLACK = 1e-5


class Quantised:
    """Unit vectors as int8 codes with a step each, and what that loses.

    ``u = step * code + e``; ``loss`` is ``|e|`` and ``norm`` is ``|step * code|``, both in double
    precision. For two vectors ``u.v = su*sv*(cu.cv) + (su*cu).e_v + e_u.v``, so the product of the
    codes is off by at most ``norm_u * loss_v + loss_u``.
    """

    def __init__(self, rows: np.ndarray):
        rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of the largest and smallest doubles stay within range
        self.unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        step = np.abs(self.unit).max(axis=1, keepdims=True) / 127
        self.code = np.rint(self.unit / step).astype(np.int8)
        near = self.code * step
        self.step = step[:, 0]
        self.norm = np.linalg.norm(near, axis=1)
        self.loss = np.linalg.norm(self.unit - near, axis=1)

    def upper(self, at: slice, other: Quantised, to: slice) -> np.ndarray:
        """An upper bound of every cosine between two blocks. Products of codes are whole numbers, exact in float32 up to 1,040 dimensions."""
        kind = np.float32 if self.code.shape[1] <= 1040 else np.float64
        p = self.code[at].astype(kind) @ other.code[to].astype(kind).T
        p *= self.step[at, None].astype(kind)
        p *= other.step[None, to].astype(kind)
        p += np.outer(self.norm[at], other.loss[to]).astype(kind)
        p += self.loss[at, None].astype(kind)
        return p


def tile_links(a: Quantised, b: Quantised | None, threshold: float):
    """Yield index pairs ``(i, j)`` with cosine >= threshold; ``b`` None compares ``a`` with itself, ``i < j``."""
    other = a if b is None else b
    for r in range(0, len(a.code), BLOCK_ROWS):
        for c in range(r if b is None else 0, len(other.code), BLOCK_COLS):
            doubt = np.argwhere(a.upper(slice(r, r + BLOCK_ROWS), other, slice(c, c + BLOCK_COLS)) >= threshold - SLACK) + (r, c)
            if b is None:
                doubt = doubt[doubt[:, 0] < doubt[:, 1]]
            for at in range(0, len(doubt), CHUNK):
                i, j = doubt[at : at + CHUNK].T
                sure = np.einsum("nd,nd->n", a.unit[i], other.unit[j]) >= threshold
                yield i[sure], j[sure]


def _compare(threshold: float):
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def each(table: pa.Table) -> pa.Table:
        tile = table["tile"].to_numpy()
        rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = flat.reshape(len(rep), -1)
        first, second = (np.flatnonzero(tile == t) for t in (tile.min(), tile.max()))
        if table["i"][0].as_py() == table["j"][0].as_py():
            place, parts = first, (Quantised(rows[first]), None)
        elif tile.min() == tile.max():  # the other tile is empty
            return schema.empty_table()
        else:
            place, parts = np.concatenate((first, second)), (Quantised(rows[first]), Quantised(rows[second]))
        n = len(place)
        links, root = np.zeros(n, np.int64), np.arange(n)
        rep, copies = rep[place], copies[place]
        for i, j in tile_links(*parts, threshold):
            j = j + (0 if parts[1] is None else len(first))
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = local_roots(n, np.concatenate((i, np.arange(n))), np.concatenate((j, root)))
        linked = links > 0
        return pa.table([rep[linked], links[linked], rep[root[linked]]], schema=schema)

    return each


def usable(embedding: Column) -> Column:
    """True for vectors that are not null, not empty, finite throughout and not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile_rows: int = TILE_ROWS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Vectors of equal, non-null label and equal length link when their cosine is at least
    ``threshold``. Equal vectors become one class first, so a hot vector costs one row. Each label's
    classes are dealt to tiles of about ``tile_rows`` or ``tile_bytes`` by hash and every pair of tiles is one group:
    the work within a label is quadratic by nature, but no task holds more than two tiles, links
    leave a task as counts and a spanning star, and a hot label becomes more groups, not larger ones.

    Vectors that are null, empty, zero or not finite, rows with a null label or a null id link with
    nothing: ``n_links`` 0 and themselves as component. Repeated rows count as vectors of their own.
    An empty table gives an empty table.
    """
    ok = usable(F.col(vector_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"), ok.alias("ok"))
    # Equal vectors share a key of 128 bits, which stands for them from here on.
    key = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("h2")]
    good = rows.where("ok").select("vec_id", "label", *key, "embedding")
    classes = materialize(good.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "classes")
    sized = classes.withColumn("dim", F.size("embedding"))
    tiles = sized.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / F.least(F.lit(tile_rows), F.greatest(F.lit(1), F.lit(tile_bytes // 8) / F.col("dim")))).cast("int").alias("tiles"))
    dealt = sized.join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).select("label", "dim", "i", "j", "tile", "rep", "copies", "embedding")
    stars = met.groupBy("label", "dim", "i", "j").applyInArrow(_compare(threshold), "rep long, links long, root long")
    stars = materialize(stars, "stars")
    groups = connected_components(stars.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = stars.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.drop("embedding").join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    known = known.select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    found = good.drop("embedding").join(known, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
