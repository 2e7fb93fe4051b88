"""Periodic runs of words in whole texts: branching squares of an enhanced suffix array, rotated and merged."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run is at least so many words long and holds its period so often.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: ASCII white space parts words; all else belongs to them.
SPACE = r"[\x20\x09-\x0D]+"
#: Words of suffixes that are sorted together, and tests of suffixes that are made at a time.
SLAB, TESTS = 1 << 17, 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

Run = tuple[int, int, int]


def candidates(ids: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int]]:
    """Stretches ``(first, end)`` outside which no word of ``ids`` can be in a run.

    A run of period q has ``length - 2`` triples of neighbouring words, of which those q apart are equal.
    So each of its triples occurs as often as this computes, and so do its words. Triples are told apart
    by a hash: where two share one, a stretch is only kept that could have gone.
    """
    often = min(least_exponent - 1, max(least_length, least_exponent) - 2)
    if len(ids) < max(least_length, 3) or often < 1:
        return [(0, len(ids))] if len(ids) >= least_length else []
    usual = np.bincount(ids)[ids] >= often
    at = np.flatnonzero(usual[:-2] & usual[1:-1] & usual[2:])
    if not len(at):
        return []
    with np.errstate(over="ignore"):
        h = sum((ids[at + k].astype(np.uint64) + np.uint64(1)) * _MIX[k] for k in range(3))
    _, which, n = np.unique(h, return_inverse=True, return_counts=True)
    at = at[n[which] >= often]
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    spans = [(int(x[0]), int(x[-1]) + 3) for x in np.split(at, cuts) if len(x)]
    return [(a, b) for a, b in spans if b - a >= least_length]


def suffix_order(symbols: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a text of stretches and its inverse; ``stop`` is the end of each place's stretch.

    Prefix doubling: only suffixes that are still equal to others are sorted again. A suffix ends with
    its stretch, and a stretch's symbols are its own, so stretches never mix.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    tied = order[np.repeat(size > 1, size)]
    k = 1
    while len(tied):
        after = np.where(tied + k < stop[tied], rank[np.minimum(tied + k, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + after
        way = np.argsort(key, kind="stable")
        tied, key = tied[way], key[way]
        place = np.arange(len(tied))
        group = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(rank[tied]) != 0)), place, 0))
        fresh = np.concatenate(([True], np.diff(key) != 0))
        rank[tied] = rank[tied] + np.maximum.accumulate(np.where(fresh, place, 0)) - group
        alone = fresh & np.concatenate((fresh[1:], [True]))
        tied = tied[~alone]
        k *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, rank


def common_prefixes(symbols: np.ndarray, suffixes: np.ndarray, rank: np.ndarray, stop: np.ndarray) -> list[int]:
    """Words that each suffix of the array shares with the one before, in text order so that a length falls by one at most from place to place."""
    text, before, where, ends = symbols.tolist(), suffixes.tolist(), rank.tolist(), stop.tolist()
    out, h = [0] * len(text), 0
    for i, r in enumerate(where):
        if r:
            j = before[r - 1]
            most = min(ends[i] - i, ends[j] - j)
            h = min(h, most)
            while h < most and text[i + h] == text[j + h]:
                h += 1
            out[r] = h
        h = max(h - 1, 0)
    return out


def smaller_children(lcp: list[int], deepest: int) -> np.ndarray:
    """``(depth, lb, rb, first, last)`` of every child interval but the largest of each interval of the array, as columns.

    Intervals come from one pass over the common prefixes with a stack; no tree is built. Deeper ones
    than ``deepest`` cannot hold a run.
    """
    found: list[tuple[int, int, int, int, int]] = []
    stack: list[tuple[int, int, list[int]]] = []
    for r, depth in enumerate([*lcp[1:], -1], 1):
        lb = r - 1
        while stack and stack[-1][0] > depth:
            own, lb, begins = stack.pop()
            if own <= deepest:
                ends = [*begins[1:], r]
                largest = max(range(len(begins)), key=lambda c: ends[c] - begins[c])
                found += [(own, lb, r - 1, begins[c], ends[c] - 1) for c in range(len(begins)) if c != largest]
        if depth > 0:
            if stack and stack[-1][0] == depth:
                stack[-1][2].append(r)
            else:
                stack.append((depth, lb, [lb, r]))
    return np.array(found, np.int64).reshape(-1, 5).T


def branching_squares(suffixes: np.ndarray, rank: np.ndarray, children: np.ndarray) -> np.ndarray:
    """``(start, period)`` of every square whose period ends with it, as columns.

    A suffix i of a smaller child meets i + depth and i - depth: where the inverse array has that suffix
    in the same interval and in another child, the two share exactly ``depth`` words.
    """
    depth, lb, rb, first, last = children
    size, n, found = last - first + 1, len(rank), []
    cuts = np.searchsorted(np.cumsum(size), np.arange(TESTS, int(size.sum()) + TESTS, TESTS)) + 1
    for a, b in zip(np.concatenate(([0], cuts[:-1])), cuts, strict=True):
        c = np.repeat(np.arange(a, min(b, len(size))), size[a:b])
        if not len(c):
            continue
        offset = np.arange(len(c)) - np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b])
        i, d = suffixes[first[c] + offset], depth[c]
        for j in (i + d, i - d):
            r = rank[np.clip(j, 0, n - 1)]
            hit = (j >= 0) & (j < n) & (r >= lb[c]) & (r <= rb[c]) & ((r < first[c]) | (r > last[c]))
            found.append(np.stack((np.minimum(i, j)[hit], d[hit])))
    return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)


def rotated(symbols: np.ndarray, start: int, period: int, least: int) -> int:
    """How far to the left of ``start``, not below ``least``, words keep equal to those a period on; compared in stretches that double."""
    at, step = start, 16
    while at > least:
        a = max(least, at - step)
        other = np.flatnonzero(symbols[a:at] != symbols[a + period : at + period])
        if len(other):
            return a + int(other[-1]) + 1
        at, step = a, step * 2
    return least


def runs_of(stretches: list[np.ndarray], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[list[Run]]:
    """``(start, length, period)`` of all runs of each stretch of word numbers, by start and then period.

    A run of smallest period q has one square of period q at its right end at which the two halves'
    continuations differ, a branching one. Rotated to the left it grows to the run. A multiple of q has a
    branching square that ends at the same place, so squares go by their end and then their period, and
    one whose period a run there divides falls to that run.
    """
    sizes = np.array([len(x) for x in stretches], np.int64)
    out: list[list[Run]] = [[] for _ in stretches]
    if not sizes.sum():
        return out
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(stretches)), sizes)
    words = np.concatenate(stretches).astype(np.int64)
    symbols = owner * (int(words.max()) + 1) + words
    stop, origin = ends[owner], (ends - sizes)[owner]
    suffixes, rank = suffix_order(symbols, stop)
    children = smaller_children(common_prefixes(symbols, suffixes, rank, stop), int(sizes.max()) // max(2, least_exponent))
    if not children.shape[1]:
        return out
    start, period = branching_squares(suffixes, rank, children)
    # what the left of the square must repeat for a run that is long enough, looked at in a few places before all of it
    need = np.maximum(np.maximum(least_length, least_exponent * period) - 2 * period, 0)
    fits = start - need >= origin[start]
    start, period, need = start[fits], period[fits], need[fits]
    for share in (0.0, 0.5, 1.0):
        at = np.maximum(start - np.minimum(np.maximum((need * share).astype(np.int64), 1), need), 0)
        alike = (need == 0) | (symbols[at] == symbols[at + period])
        start, period, need = start[alike], period[alike], need[alike]
    here: dict[int, list[tuple[int, int]]] = {}
    for k in np.lexsort((period, start + 2 * period)):
        s, q = int(start[k]), int(period[k])
        end = s + 2 * q
        known = here.setdefault(end, [])
        if any(q % p == 0 and begun <= s for begun, p in known):
            continue
        least = int(origin[s])
        begun = rotated(symbols, s, q, least)
        if end - begun >= max(least_length, least_exponent * q):
            known.append((begun, q))
            out[owner[s]].append((begun - least, end - begun, q))
    return [sorted(found, key=lambda run: (run[0], run[2])) for found in out]


def runs_of_texts(texts: list[np.ndarray], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[list[Run]]:
    """All runs of whole texts of word numbers; stretches of many texts are sorted together."""
    out: list[list[Run]] = [[] for _ in texts]
    held: list[tuple[int, int, np.ndarray]] = []

    def settle() -> None:
        for (t, first, _), found in zip(held, runs_of([x[2] for x in held], least_length, least_exponent), strict=True):
            out[t] += [(first + s, n, q) for s, n, q in found]
        held.clear()

    for t, ids in enumerate(texts):
        for a, b in candidates(ids, least_length, least_exponent):
            if held and sum(len(x[2]) for x in held) + b - a > SLAB:
                settle()
            held.append((t, a, ids[a:b]))
    settle()
    return [sorted(found, key=lambda run: (run[0], run[2])) for found in out]


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period alone."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for every row of ``docs``.

    ``runs`` are ``(start, length, period)`` in words, by start and then period: all maximal stretches of
    at least ``least_length`` words that repeat their smallest period ``least_exponent`` times or more.
    ``collapsed`` is the text with each run cut to its first period, words parted by one space.

    Each text is read whole where it lies; nothing is shuffled, so a task that runs again gives the same
    rows. Null and blank texts have no words, no runs and an empty ``collapsed``. Null ids and repeated
    rows each have their row; other columns have no part in it; an empty table gives an empty table.
    """
    if least_exponent < 2:
        raise ValueError("a run repeats its period twice at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = 0, [t.as_buffer() if t.is_valid else b"" for t in b.column(1)]
            for end in _slabs([len(x) for x in texts]):
                words = [bytes(x).split() for x in texts[at:end]]
                numbers = []
                for line in words:
                    known: dict[bytes, int] = {}
                    numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in line), np.int64, len(line)))
                found = runs_of_texts(numbers, least_length, least_exponent)
                text = [b" ".join(compress(line, kept_words(len(line), runs).tolist()) if runs else line).decode() for line, runs in zip(words, found, strict=True)]
                listed = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
                cols = [b.column(0)[at:end], pa.array([len(line) for line in words], pa.int64()), pa.array(listed, kind), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "collapsed"])
                at = end

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _slabs(sizes: list[int], most: int = 1 << 22) -> Iterator[int]:
    """Ends of stretches of rows that hold about ``most`` bytes, a row at least."""
    held = 0
    for k, n in enumerate(sizes):
        held += n
        if held >= most or k + 1 == len(sizes):
            yield k + 1
            held = 0


def repeated_from(text: Column, seed: Column) -> Column:
    """``text`` with its words from the one of number ``seed % n`` on repeating: a known run in natural text.

    The period is 1 + floor((n - a) / (3 + seed % 8)), a being that word. Words stand apart by one space.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    n = F.size(words)
    a = (seed % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + seed % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))), F.lit(1), n), " ")


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and hashes of all runs and of the collapsed text, for each row of ``find_runs``."""
    longest = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"])).when(x["start"] != y["start"], F.sign(x["start"] - y["start"])).otherwise(F.sign(x["period"] - y["period"])).cast("int"))
    x = found.withColumn("top", F.try_element_at(longest, F.lit(1)))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return x.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
