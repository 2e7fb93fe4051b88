"""Token counts of whole texts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.storage import materialize

#: Pre-tokens: letters or digits or symbols with one space before them, or white space.
PRETOKEN = re.compile(r" ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+| ?[^\s]")
#: Python's white space and the same pattern in the words of Spark's own functions: what is a letter, a digit or neither goes by Unicode's
#: categories in both, so the two cut texts alike but for characters that are newer than the tables of either.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPARK_PRETOKEN = rf" ?[\p{{L}}\p{{Nl}}\p{{No}}]+| ?\p{{Nd}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+| ?[^{SPACE}]"
#: What is added to each piece's count.
SHRINK = 0.1
#: Pre-tokens whose counts a task remembers.
REMEMBERED = 1_000_000
#: Characters whose pre-tokens are gathered before their trie is walked.
PART_CHARS = 4 << 20


def load_pieces(path: str) -> dict[bytes, int]:
    """Piece to rank from a rank file (base64 piece and rank a line). All single bytes are pieces, so every pre-token can be cut."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def first_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities to begin with: ranks stand for frequencies by Zipf's law, ``p ~ 1 / (rank + 10)``."""
    total = math.fsum(1 / (r + 10) for r in ranks.values())
    return {piece: -math.log((r + 10) * total) for piece, r in ranks.items()}


def next_scores(counts: dict[bytes, int], pieces: Iterable[bytes], shrink: float = SHRINK) -> dict[bytes, float]:
    """Log-probabilities of pieces that stand so often in the best cuts; ``shrink`` is added to each count, so a piece without one keeps a little."""
    found = {p: counts.get(p, 0) + shrink for p in pieces}
    total = math.log(math.fsum(found.values()))
    return {p: math.log(n) - total for p, n in found.items()}


def train_scores(docs: DataFrame, pieces: dict[bytes, int], text_col: str = "text", rounds: int = 2) -> dict[bytes, float]:
    """A unigram language model of all of ``docs`` over a given vocabulary: log-probability of each piece.

    Spark counts the distinct pre-tokens of all documents, which it cuts as ``count_tokens`` does, and sorts them, so a task's share is a range of
    the trie's leaves. In each round every pre-token is cut once by the scores so far and the pieces of
    its best cut count as often as it stands in the documents; the counts, one row a piece at most, make
    the next scores. The pieces themselves are never changed. Null and empty texts add nothing; without
    any text all pieces are alike after the first round.
    """
    spark = docs.sparkSession

    tokens = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPARK_PRETOKEN), F.lit(0))
    counted = docs.select(F.explode(tokens).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("n"))
    counted = materialize(counted.orderBy("pretoken"), "pretokens")
    scores = first_scores(pieces)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(scores)

        def cut(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie, found = Trie(shared.value), Counter()
            for b in batches:
                trie.cut(dict(zip((w.encode("utf-8", "surrogatepass") for w in b.column(0).to_pylist()), b.column(1).to_pylist(), strict=True)), found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["piece", "n"])

        rows = counted.mapInArrow(cut, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        scores = next_scores({bytes(r.piece): r.n for r in rows}, pieces)
    return scores


class Trie:
    """Counts of pre-tokens by one walk over the trie of those not yet known.

    Sorted pre-tokens are the trie's leaves in order, and a stack along the current path is its nodes: a
    node holds the best score and count of any cut of its prefix. The next pre-token goes on from the
    node where it leaves the last one, so a shared prefix is scored once. Ties in score take fewer
    tokens.
    """

    def __init__(self, vocabulary: dict[bytes, float]):
        self.score, self.longest = vocabulary, max(map(len, vocabulary), default=1)
        self.known: dict[bytes, int] = {}
        self.floor = min(vocabulary.values(), default=0.0) - 10.0

    def _walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
        """Each of the sorted words with its path's token counts and last pieces' starts, by length of prefix; the lists go on to change."""
        best, tokens, cuts, before = [0.0], [0], [0], b""
        score, longest, floor = self.score.get, self.longest, self.floor
        for word in words:
            share = _common(before, word)
            del best[share + 1 :], tokens[share + 1 :], cuts[share + 1 :]
            for end in range(share + 1, len(word) + 1):
                top, n, cut = best[-1] + score(word[end - 1 : end], floor), tokens[-1] + 1, end - 1
                for start in range(max(0, end - longest), end - 1):
                    s = score(word[start:end])
                    if s is not None:
                        s += best[start]
                        if s > top or s == top and tokens[start] < n:
                            top, n, cut = s, tokens[start] + 1, start
                best.append(top)
                tokens.append(n)
                cuts.append(cut)
            yield word, tokens, cuts
            before = word

    def count(self, pretokens: set[bytes]) -> dict[bytes, int]:
        """Counts of the pre-tokens; remembered ones are not walked again."""
        found = {word: tokens[-1] for word, tokens, _ in self._walk(sorted(pretokens - self.known.keys()))}
        if len(self.known) + len(found) <= REMEMBERED:
            self.known |= found
            return self.known
        return {p: self.known[p] if p in self.known else found[p] for p in pretokens}

    def cut(self, pretokens: dict[bytes, int], found: Counter[bytes]) -> None:
        """Adds the pieces of each pre-token's best cut to ``found``, as often as the pre-token stands."""
        for word, _, cuts in self._walk(sorted(pretokens)):
            end, n = len(word), pretokens[word]
            while end:
                found[word[cuts[end] : end]] += n
                end = cuts[end]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def pretokens(text: str) -> list[str]:
    return PRETOKEN.findall(text)


def _token_sums(texts: list[str], trie: Trie) -> list[tuple[int, int]]:
    lists = [pretokens(t) for t in texts]
    words = {w: w.encode("utf-8", "surrogatepass") for w in set().union(*lists)} if lists else {}
    counts = trie.count(set(words.values()))
    by_word = {w: counts[b] for w, b in words.items()}
    return [(len(x), sum(map(by_word.__getitem__, x))) for x in lists]


def count_tokens(docs: DataFrame, vocabulary: dict[bytes, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens)`` for every row of ``docs``, whole texts, without a shuffle.

    A task gathers the distinct pre-tokens of about ``PART_CHARS`` characters, walks the trie of those
    that it does not know yet and sums terminal counts over each document. Its memory is bounded by
    ``REMEMBERED`` pre-tokens and the longest text. Null and empty texts count 0; repeated rows get
    equal counts; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out: list[tuple[int, int]] = []
            for part in _parts(texts):
                out += _token_sums(part, trie)
            sums = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["doc_id", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_pretokens long, n_tokens long")


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > PART_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part
