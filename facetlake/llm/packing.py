"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.llm.mixing import WORD
from facetlake.storage import materialize

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: A sequence costs its length, a fixed share for its start, and attention that grows with the square.
START_COST, ATTENTION_LENGTH = 64.0, 16384.0
#: Pieces that one task packs at a time.
SHARD_PIECES = 50_000
#: Shards that rows of one id and size are dealt to at most.
SALTS = 1024


def cost(capacity: int) -> float:
    return capacity + START_COST + capacity * capacity / ATTENTION_LENGTH


class OpenBins:
    """Open bins by the room they have left; the tightest that holds an item is found in one bit scan."""

    def __init__(self):
        self.room: dict[int, list[int]] = {}
        self.mask = 0

    def put(self, bin_no: int, room: int) -> None:
        if room:
            self.room.setdefault(room, []).append(bin_no)
            self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room of at least ``size`` (the latest of equals) and its room."""
        above = self.mask >> size
        if not above:
            return None
        room = size + (above & -above).bit_length() - 1
        bin_no = self.room[room].pop()
        if not self.room[room]:
            self.mask &= ~(1 << room)
        return bin_no, room


class Remaining:
    """How many items of each size are still to come; the largest that fits a room is found in one bit scan."""

    def __init__(self, sizes: Iterable[int]):
        self.count = Counter(sizes)
        self.mask = sum(1 << size for size in self.count)

    def remove(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.mask &= ~(1 << size)

    def fill(self, room: int) -> int:
        """How much of a room the items would take, each time as many as fit of the largest size that does."""
        used, size = 0, room + 1
        while room > 0:
            below = self.mask & ((1 << min(room + 1, size)) - 1)
            if not below:
                break
            size = below.bit_length() - 1
            n = min(self.count[size], room // size)
            used += n * size
            room -= n * size
        return used


def cheapest(used: int, capacities: tuple[int, ...], price) -> int:
    """The permitted length that holds the contents at the least cost."""
    return min((c for c in capacities if c >= used), key=lambda c: (price(c), c))


def best_fit(sizes: list[int], opening) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and what each bin holds. An item goes to the open bin that it fills best; where none has room, ``opening(size, remaining)`` says which size opens."""
    bins, open_bins, remaining = [], OpenBins(), Remaining(sizes)
    places: list[int] = []
    offsets: list[int] = []
    for size in sizes:
        remaining.remove(size)
        found = open_bins.take(size)
        if found is None:
            found = len(bins), opening(size, remaining)
            bins.append(0)
        bin_no, room = found
        places.append(bin_no)
        offsets.append(bins[bin_no])
        bins[bin_no] += size
        open_bins.put(bin_no, room - size)
    return places, offsets, bins


def pack(sizes: Iterable[int], capacities: tuple[int, ...] = CAPACITIES, price=cost) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and each bin's capacity. Items come largest first, none above the largest capacity.

    The permitted lengths are settled jointly. A bin that opens takes the length at which the item and
    what the sizes still to come would add to it cost least for each place filled, the bin shrunk to
    that content. That choice competes with the plans that open one length throughout (longer items:
    the shortest that holds them), and the plan whose bins, all shrunk to their contents, cost least in
    sum is the one taken.
    """
    sizes = list(sizes)

    def least(size: int, remaining: Remaining) -> int:
        def rate(c: int) -> tuple[float, int]:
            used = size + remaining.fill(c - size)
            return price(cheapest(used, capacities, price)) / used, c

        return min((c for c in capacities if c >= size), key=rate)

    found = None
    for opening in (least, *((lambda size, _, c=c: c if size <= c else min(x for x in capacities if x >= size)) for c in capacities)):
        places, offsets, used = best_fit(sizes, opening)
        chosen = [cheapest(u, capacities, price) for u in used]
        total = math.fsum(map(price, chosen))
        if found is None or total < found[0]:
            found = total, (places, offsets, chosen)
    return found[1]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row for each piece of a document: ``(doc_id, size, piece, piece_start, piece_size, bin_id, bin_offset, bin_capacity, bin_used)``.

    ``size`` is ``size_col`` or the number of words. Documents above the largest capacity are cut into
    pieces of that length and a rest; nothing is left out. Rows are dealt by a hash into shards of
    about ``shard_pieces`` pieces, each packed on its own (largest first, ties by id), so a task is
    bounded however large the table, and only ids and sizes cross the network. A salt deals rows of one
    id, or none, to many shards. The loss against one packing of everything is at most a few open bins a shard.

    Rows without words (null texts too) have one piece of size 0 and no bin. Repeated rows are packed
    each; an empty table gives an empty table.
    """
    top = max(capacities)
    size = F.col(size_col).cast("long") if size_col else F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("salt"))
    rows = materialize(rows, "sizes")
    pieces = rows.agg(F.sum(F.greatest(F.ceil(F.col("size") / top), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(pieces) // shard_pieces))
    last = F.greatest(F.ceil(F.col("size") / top) - 1, F.lit(0)).cast("int")
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    cut = cut.withColumns({"piece_start": F.col("piece").cast("long") * top, "shard": F.pmod(F.xxhash64("doc_id", "piece", "size", F.pmod("salt", F.lit(SALTS))), F.lit(shards))})
    cut = cut.withColumn("piece_size", F.least(F.lit(top).cast("long"), F.col("size") - F.col("piece_start")))
    empty = cut.where("piece_size <= 0").select("doc_id", "size", "piece", "piece_start", "piece_size", *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_offset", "bin_capacity", "bin_used")])
    names = ["doc_id", "size", "piece", "piece_start", "piece_size", "bin_id", "bin_offset", "bin_capacity", "bin_used"]

    def each(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["piece_size", "doc_id", "piece", "size"], ascending=[False, True, True, True], kind="stable")
        places, offsets, sizes = pack(frame["piece_size"].tolist(), capacities)
        at = pd.Series(places, index=frame.index, dtype="int64")
        frame["bin_id"] = at + (int(key[0]) << 32)
        frame["bin_offset"] = pd.Series(offsets, index=frame.index, dtype="int64")
        frame["bin_capacity"] = at.map(dict(enumerate(sizes))).astype("int64")
        frame["bin_used"] = frame.groupby("bin_id")["piece_size"].transform("sum")
        return frame[names]

    schema = "doc_id long, size long, piece int, piece_start long, piece_size long, bin_id long, bin_offset long, bin_capacity long, bin_used long"
    packed = cut.where("piece_size > 0").groupBy("shard").applyInPandas(each, schema)
    return packed.unionByName(empty)


def sequences(packed: DataFrame, docs: DataFrame, pad: int, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The training sequences: ``(bin_id, capacity, ids, documents)`` from places of ``pack_documents`` over the lengths of ``ids_col`` (its ``size_col`` must hold these).

    ``ids`` are the pieces' token ids end to end, filled up to the capacity with ``pad``; ``documents``
    numbers the piece that each place belongs to, from 1, and is 0 for padding. A group is one sequence,
    so it is never larger than the largest capacity. Null ids and rows that repeat an id cannot be told
    apart here; ``pack_sequences`` numbers rows first.
    """
    cut = packed.where("bin_id IS NOT NULL").join(docs.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("__ids")), "doc_id")
    part = F.slice("__ids", (F.col("piece_start") + 1).cast("int"), F.col("piece_size").cast("int"))
    parts = cut.groupBy("bin_id", F.col("bin_capacity").cast("int").alias("capacity")).agg(F.array_sort(F.collect_list(F.struct("bin_offset", part.alias("part")))).alias("parts"))
    flat = F.flatten(F.transform("parts", lambda x: x["part"]))
    owner = F.flatten(F.transform("parts", lambda x, i: F.array_repeat(i + 1, F.size(x["part"]))))
    fill = lambda x, with_: F.concat(x, F.array_repeat(with_, F.col("capacity") - F.size(x)))
    parts = parts.select("bin_id", "capacity", flat.alias("ids"), owner.alias("documents"))
    item = docs.schema[ids_col].dataType.elementType
    return parts.select("bin_id", "capacity", fill(F.col("ids"), F.lit(pad).cast(item)).alias("ids"), fill(F.col("documents"), F.lit(0)).alias("documents"))


def pack_sequences(docs: DataFrame, pad: int, id_col: str = "doc_id", ids_col: str = "ids", capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Rows of token ids as training sequences: ``(bin_id, capacity, ids, documents, doc_ids)``.

    Packs by the lengths of ``ids_col`` and puts the ids out as ``sequences`` does; ``doc_ids`` has the
    ``id_col`` of each piece, in the order in which ``documents`` numbers them. Every row is packed as a
    document of its own, whether its id is null or stands in other rows too; null and empty arrays have
    no place. An empty table gives an empty table.
    """
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).where(F.size("ids") > 0).withColumn("row", F.monotonically_increasing_id()), "rows")
    packed = materialize(pack_documents(rows.withColumn("size", F.size("ids")), "row", size_col="size", capacities=capacities, shard_pieces=shard_pieces), "packed")
    order = F.array_sort(F.collect_list(F.struct("bin_offset", "id")))
    owners = packed.join(rows.select(F.col("row").alias("doc_id"), "id"), "doc_id").groupBy("bin_id").agg(F.transform(order, lambda x: x["id"]).alias("doc_ids"))
    return sequences(packed, rows, pad, "row", "ids").join(owners, "bin_id")
