"""Merkle manifest of a table: one 16-ary tree for each source below one root, with proofs from an octopus multiproof of each leaf partition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from facetlake.storage import materialize

#: Children of a node.
FAN = 16
#: Leaves of a partition, and how many partitions there are at most; beyond, partitions grow.
PART_ROWS, MOST_PARTS = 16_384, 32_768
#: The tree over sources; a source's own tree has its number.
TOP = -1

_HEX = 64


def digest(parts: str) -> str:
    """Lowercase hex SHA-256 of a text of digests."""
    return hashlib.sha256(parts.encode()).hexdigest()


def leaf_digest(*columns: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, ``-`` where it is null."""

    def one(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(one, columns)).cast("binary"), 256)


def ordered_leaves(leaves: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``leaves`` with ``part`` and ``at``: cut into ranges of source and doc_id, null first, and numbered inside each.

    Rows of one id go by their digest, and equal rows by a number each has written down, so that a hot
    source, id or row is cut too. A source without order of its own would need its rows in one task.
    """
    seen = Observation()
    rows = materialize(leaves.withColumn("row", F.monotonically_increasing_id()).observe(seen, F.count(F.lit(1)).alias("n")), "leaves")
    parts = max(1, min(MOST_PARTS, -(-int(seen.get["n"]) // part_rows)))
    order = ("source", "doc_id", "leaf", "row")
    cut = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return materialize(cut.select("doc_id", "source", "leaf", "changed", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")), "ordered")


def part_facts(ordered: DataFrame) -> DataFrame:
    """One row a partition: what its rows alone cannot tell of the trees.

    ``(part, n_sources, first, skipped, size_first, size_last)``: number of all sources, number of the
    partition's first source, that one's leaves in partitions before, and all leaves of the first and
    the last source. Sources between these two lie in the partition whole.
    """
    counts = ordered.groupBy("part", "source").agg(F.count("*").alias("n"))
    own = Window.partitionBy("source")
    w = counts.withColumns({
        "size": F.sum("n").over(own), "born": F.min("part").over(own),
        "skipped": F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    key = F.struct(F.col("source").isNotNull(), "source")
    facts = w.groupBy("part").agg(
        F.min_by("skipped", key).alias("skipped"), F.min_by("size", key).alias("size_first"), F.max_by("size", key).alias("size_last"), F.sum(F.when(F.col("born") == F.col("part"), 1).otherwise(0)).alias("fresh"),
    )
    every = Window.orderBy("part")  # at most MOST_PARTS rows
    before = F.coalesce(F.sum("fresh").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("fresh").over(Window.partitionBy())
    return facts.select("part", total.alias("n_sources"), (before - F.when(F.col("skipped") > 0, 1).otherwise(0)).alias("first"), "skipped", "size_first", "size_last")


def levels(size: int) -> list[int]:
    """Nodes of each level of a tree, the leaves first and one root last."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def missing(first: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """``(level, index)`` of the nodes that a holder of leaves ``first..end`` of a tree lacks to reach its root.

    Level by level the known nodes are one range. What is left of the runs at its two ends is missing;
    with it all the runs' parents are known, so no node is asked for that can be derived.
    """
    for level, n in enumerate(levels(size)[:-1]):
        for i in (*range(first // FAN * FAN, first), *range(end, min(-(-end // FAN) * FAN, n))):
            yield level, i
        first, end = first // FAN, -(-end // FAN)


def sources_in(sources: list, first: int, skipped: int, size_first: int, size_last: int) -> list[tuple[int, int, int, int, int]]:
    """``(source number, from, to, first leaf, leaves of the source)`` of the stretches of equal sources of a partition's sorted rows."""
    cuts = [0, *(i for i in range(1, len(sources)) if sources[i] != sources[i - 1]), len(sources)]
    out = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
        size = size_first if k == 0 else size_last if b == len(sources) else b - a
        out.append((first + k, a, b, skipped if k == 0 else 0, size))
    return out


def frontier(first: int, nodes: list[str], size: int) -> Iterator[tuple[int, int, int, str]]:
    """``(level, index, nodes of the level, digest)`` of the highest nodes that leaves ``first...`` of a tree give by themselves."""
    for level, n in enumerate(levels(size)):
        end = first + len(nodes)
        low, high = -(-first // FAN), (-(-n // FAN) if end == n else end // FAN)
        if n == 1 or low >= high:
            yield from ((level, first + k, n, d) for k, d in enumerate(nodes))
            return
        yield from ((level, i, n, nodes[i - first]) for i in (*range(first, low * FAN), *range(high * FAN, end)))
        nodes = [digest("".join(nodes[max(k * FAN - first, 0) : (k + 1) * FAN - first])) for k in range(low, high)]
        first = low


NODE = "tree long, level int, idx long, count long, digest string"


def tree_nodes(ordered: DataFrame, facts: DataFrame) -> tuple[DataFrame, int]:
    """``NODE`` rows that no partition can derive by itself or of which it gives the highest, and the number of top levels.

    Each partition folds its own leaves; what is left is a few nodes a level at its two ends. The runs
    of these are joined level by level, sources first and then the tree over sources.
    """
    spark = ordered.sparkSession

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        facts = {c: t.column(c)[0].as_py() for c in ("n_sources", "first", "skipped", "size_first", "size_last")}
        leaves, rows, roots = [x.hex() for x in t.column("leaf").to_pylist()], [], []
        spans = sources_in(t.column("source").to_pylist(), facts["first"], facts["skipped"], facts["size_first"], facts["size_last"])
        for s, a, b, at, size in spans:
            found = list(frontier(at, leaves[a:b], size))
            if len(found) == 1 and found[0][2] == 1:
                roots.append((s, found[0][3]))
            else:
                rows += [(s, *x) for x in found]
        if roots:  # a source that is whole lies beside others that are
            rows += [(TOP, *x) for x in frontier(roots[0][0], [d for _, d in roots], facts["n_sources"])]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["tree", "level", "idx", "count", "digest"])

    given = materialize(ordered.select("part", "at", "source", "leaf").join(F.broadcast(facts), "part").groupBy("part").applyInArrow(fold, NODE), "frontier")
    sizes = facts.agg(F.max(F.greatest("size_first", "size_last")), F.max("n_sources")).first()
    children = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
    parent = F.floor(F.col("idx") / FAN).alias("idx")

    def climb(nodes: DataFrame, height: int) -> list[DataFrame]:
        """All levels above the given nodes; a level's runs are whole once the level below is joined."""
        out, made = [], None
        for level in range(height):
            here = nodes.where(F.col("level") == level)
            here = (here if made is None else here.unionByName(made)).where("count > 1")
            up = here.groupBy("tree", parent, F.ceil(F.col("count") / FAN).alias("count")).agg(F.sha2(F.concat_ws("", children).cast("binary"), 256).alias("digest"))
            made = materialize(up.select("tree", F.lit(level + 1).alias("level"), "idx", "count", "digest"), "level")
            out.append(made)
        return out

    none = spark.createDataFrame([], NODE)
    own = reduce(DataFrame.unionByName, climb(given.where(F.col("tree") != TOP), len(levels(sizes[0] or 1)) - 1), given.where(F.col("tree") != TOP))
    roots = own.where("count = 1").select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(sizes[1] or 0).cast("long").alias("count"), "digest")
    top = given.where(F.col("tree") == TOP).unionByName(roots)
    top = reduce(DataFrame.unionByName, climb(top, len(levels(sizes[1] or 1)) - 1), top)
    return none.unionByName(own.where("count > 1")).unionByName(top), len(levels(sizes[1] or 1)) - 1


class Tree:
    """Part of a tree that a holder of some leaves and the nodes it lacked can derive."""

    def __init__(self, first: int, leaves: list[str], size: int, fetched: dict[tuple[int, int], str]):
        self.runs: list[dict[int, str]] = []
        nodes = leaves
        for level, n in enumerate(levels(size)[:-1]):
            end = first + len(nodes)
            low, high = first // FAN * FAN, min(-(-end // FAN) * FAN, n)
            nodes = [*(fetched[level, i] for i in range(low, first)), *nodes, *(fetched[level, i] for i in range(end, high))]
            joined = "".join(nodes)
            self.runs.append({low // FAN + k: joined[k * FAN * _HEX : (k + 1) * FAN * _HEX] for k in range(-(-len(nodes) // FAN))})
            first, nodes = low // FAN, [digest(run) for run in self.runs[-1].values()]
        self.root = nodes[0]

    def siblings(self, index: int, above: int = 0) -> Iterator[tuple[str, str]]:
        """Left and right siblings of a node and then of its ancestors."""
        for runs in self.runs[above:]:
            run, place = runs[index // FAN], index % FAN * _HEX
            yield run[:place], run[place + _HEX :]
            index //= FAN


def fold_up(leaf: str, way: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in way:
        leaf = digest(left + leaf + right)
    return leaf


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, n_siblings int"


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", changed: Column | None = None, with_proofs: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """A leaf, its source's root, the manifest's root and a proof for every row of ``docs``, which is checked.

    ``(doc_id, leaf, subroot, root, proof_sha256, folded_root, n_siblings, verified)``: a leaf is the
    digest of ``columns``; leaves of a source ascend by id, sources by their bytes, null first for both.
    While more than one node is left, every ``FAN`` neighbours become the digest of theirs. A row's proof
    is its siblings from the leaf to the root; ``with_proofs`` adds it as ``proof``. ``folded_root`` is what
    the proof gives for the row as it stands, or for ``changed`` (a column in place of the last of
    ``columns``, where it is not null).

    Rows are cut into partitions of neighbours. Each asks for the least set of nodes that it lacks for all
    its proofs together, gets it by one join, derives what its proofs share and writes them out. Rows that
    repeat an id are leaves each, ordered by their digest; null ids come first; nulls in any column have
    their mark; other columns have no part in it. An empty table gives an empty table.
    """
    values = [F.col(c) for c in columns]
    leaf = F.unhex(leaf_digest(*values))
    other = F.when(changed.isNotNull(), F.unhex(leaf_digest(*values[:-1], changed))) if changed is not None else F.lit(None).cast("binary")
    ordered = ordered_leaves(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), leaf.alias("leaf"), other.alias("changed")), part_rows)
    facts = materialize(part_facts(ordered), "facts")
    nodes, _ = tree_nodes(ordered, facts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Coordinates that partitions lack: of their first and last source's tree, and of the tree over sources."""
        for b in batches:
            out = set()
            for r in b.to_pylist():
                last = r["first"] + r["kinds"] - 1
                n = r["rows"] if r["kinds"] == 1 else r["rows_first"]
                out |= {(r["part"], r["first"], *x) for x in missing(r["skipped"], r["skipped"] + n, r["size_first"])}
                if r["kinds"] > 1:
                    out |= {(r["part"], last, *x) for x in missing(0, r["rows_last"], r["size_last"])}
                out |= {(r["part"], TOP, *x) for x in missing(r["first"], last + 1, r["n_sources"])}
            cols = list(zip(*sorted(out), strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "tree", "level", "idx"])

    key = F.struct(F.col("source").isNotNull(), "source")
    held = ordered.groupBy("part", "source").agg(F.count("*").alias("n"))
    held = held.groupBy("part").agg(F.sum("n").alias("rows"), F.count("*").alias("kinds"), F.min_by("n", key).alias("rows_first"), F.max_by("n", key).alias("rows_last"))
    asked = facts.join(held, "part").mapInArrow(ask, "part int, tree long, level int, idx long")
    fetched = asked.join(nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[int, dict[tuple[int, int], str]] = {}
        for r in right.to_pylist():
            known.setdefault(r["tree"], {})[r["level"], r["idx"]] = r["digest"]
        t = left.sort_by("at")
        facts = {c: t.column(c)[0].as_py() for c in ("n_sources", "first", "skipped", "size_first", "size_last")}
        leaves = [x.hex() for x in t.column("leaf").to_pylist()]
        ids, changed = t.column("doc_id").to_pylist(), t.column("changed").to_pylist()
        spans = sources_in(t.column("source").to_pylist(), facts["first"], facts["skipped"], facts["size_first"], facts["size_last"])
        trees = [Tree(at, leaves[a:b], size, known.get(s, {})) for s, a, b, at, size in spans]
        over = Tree(facts["first"], [x.root for x in trees], facts["n_sources"], known.get(TOP, {}))
        rows = []
        for (s, a, b, at, _), tree in zip(spans, trees, strict=True):
            top, run, above = list(over.siblings(s)), None, []
            for k in range(a, b):
                index = at + k - a
                if index // FAN != run:  # what the leaves of a run share
                    run, above = index // FAN, [*tree.siblings(index // FAN, 1), *top]
                way = [*([next(tree.siblings(index))] if tree.runs else []), *above]
                proof = "".join(x + y for x, y in way)
                rows.append((ids[k], leaves[k], tree.root, over.root, digest(proof), fold_up(changed[k].hex() if changed[k] else leaves[k], way), len(proof) // _HEX, proof if with_proofs else None))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), *[pa.string()] * 5, pa.int32(), pa.string())
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "n_siblings", "proof"]
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names)

    own = ordered.join(F.broadcast(facts), "part")
    found = own.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(expand, f"{PROOF}, proof string")
    found = found.withColumn("verified", F.col("folded_root") == F.col("root"))
    return found if with_proofs else found.drop("proof")


def _oracle(depth: int = 6) -> str:
    """The same rows as DuckDB SQL for tables in which no source has over ``FAN ** depth`` rows."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    row = lambda text: f"sha256({part('doc_id')} || {part('source')} || {part('lang')} || {part('n_chars')} || {part(text)})"
    steps = [
        f"""codes AS (SELECT list_transform(range(256), lambda v: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), v::BIGINT)) AS code),
        marked AS (SELECT *, coalesce(xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
          lambda c, b: xor(code[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 5 = 0, false) AS tampered FROM documents, codes),
        t0 AS (SELECT doc_id, source, {row('text')} AS leaf, CASE WHEN tampered THEN {row(lower)} ELSE {row('text')} END AS cur FROM marked),
        s0 AS (SELECT *, leaf AS node, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM t0)"""
    ]
    for tree, keys in (("s", "source"), ("r", "1")):
        if tree == "r":
            steps.append(f"r0 AS (SELECT doc_id, source, leaf, cur, node AS subroot, node, proof, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) AS size FROM s{depth})")
        extra = ", subroot" if tree == "r" else ""
        for k in range(depth):
            now = f"{tree}{k}"
            steps.append(
                f"""{now}n AS (SELECT DISTINCT {keys} AS key, pos, node FROM {now}),
                {now}j AS (SELECT key, pos // {FAN} AS run, string_agg(node, '' ORDER BY pos) AS line FROM {now}n GROUP BY ALL),
                {tree}{k + 1} AS (SELECT doc_id, source, leaf{extra}, CASE WHEN size > 1 THEN sha256(line[:{_HEX} * (pos % {FAN})] || cur || line[{_HEX} * (pos % {FAN}) + {_HEX + 1}:]) ELSE cur END AS cur,
                CASE WHEN size > 1 THEN sha256(line) ELSE node END AS node, CASE WHEN size > 1 THEN proof || line[:{_HEX} * (pos % {FAN})] || line[{_HEX} * (pos % {FAN}) + {_HEX + 1}:] ELSE proof END AS proof,
                CASE WHEN size > 1 THEN pos // {FAN} ELSE pos END AS pos, CASE WHEN size > 1 THEN (size + {FAN - 1}) // {FAN} ELSE size END AS size
                FROM {now} JOIN {now}j ON {'source IS NOT DISTINCT FROM key' if tree == 's' else 'key = 1'} AND pos // {FAN} = run)"""
            )
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = node AS verified FROM r{depth}"


MANIFEST_SQL = _oracle()
