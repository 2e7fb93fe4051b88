"""Toxicity of whole texts behind a noisy-channel restoration of disguised words.

A disguise is digits or symbols in place of letters, separators or spaces inside a word, or stretched
letters. Such a token spans a lattice: each character may stand for itself, for the letters it
resembles, or for nothing. The best path under a character language model is the restored text. A
token of plain letters has one path, itself, and skips the lattice.
"""

from __future__ import annotations

import array
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.storage import materialize

#: Letters that a digit or symbol may stand for.
RESEMBLES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Costs, in nats, of a letter's substitute, of a separator inside a word and of a word's end at a separator.
SUBSTITUTE, JOIN, BREAK = 0.7, 0.5, 0.5
#: Costs of keeping and of leaving out the second letter in a row, and the third or a later one.
KEEP, SQUEEZE = (0.2, 3.0), (1.2, 0.4)
#: Letters that a character's probability depends on.
ORDER = 4
#: Tokens, decodings and costs that a task remembers.
REMEMBERED = 400_000
#: Log2 of the rows of the character model's tables.
TABLE_BITS = 21
#: Characters of texts that are read together.
SLAB_CHARS = 1 << 21
#: Symbols of a spaced run that are decoded at a time, and how many of them the next stretch sees again: no word is longer.
LETTERS, OVERLAP = 400, 100
#: Sets of letters that are held against the wanted words' at a time.
BLOCK = 1024
#: Tasks that read the labelled sample.
SAMPLE_TASKS = 48
_EDGE = " .,;:?\"'`´()[]{}<>%&*#=/\\~^_-!|+"
#: What stands at a token's edges and resembles no letter.
_OUTER = "".join(c for c in _EDGE if c not in RESEMBLES)
#: Letters of a fragment of a spaced word, and symbols of one without a letter.
FRAGMENT, SYMBOLS = 5, 3
_STRETCHED = re.compile(r"(.)\1")
_LONG = re.compile(r"(.)\1\1")
_RUN = re.compile(r"(.)\1+")
_PAIR = re.compile(r"(.)\1?")
_MASK, _GOLD, _SEED = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0x51ED270B9F3C6A4D
_WORD = re.compile(r"[^\W\d_]+")


def _step(h: int, code: int) -> int:
    """Hash of a string and one more character."""
    h = ((h ^ (code + 1)) * _GOLD) & _MASK
    return h ^ (h >> 29)


def _steps(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """``_step`` over arrays of hashes and of codes that have the 1 added."""
    h = (h ^ codes) * np.uint64(_GOLD)
    return h ^ (h >> np.uint64(29))


def gram_hash(text: str) -> int:
    h = _SEED
    for c in text:
        h = _step(h, ord(c))
    return h


class CharModel:
    """Interpolated character n-grams with absolute discounting, down to a uniform share.

    Three tables of a fixed number of rows hold it: the counts of n-grams by the leading bits of their
    hash, and by the hash of their context the sum and the number of n-grams behind it. Every n-gram
    counts, however many there are; those that share a row blur each other and no more.
    """

    def __init__(self, count: np.ndarray, total: np.ndarray, kinds: np.ndarray, order: int = ORDER, discount: float = 0.5):
        self.count, self.total, self.kinds, self.order, self.discount = count, total, kinds, order, discount
        self.shift = 64 - (len(count).bit_length() - 1)
        self.known: dict[str, float] = {}

    @classmethod
    def of_words(cls, words: Counter[str], bits: int = 16) -> CharModel:
        context, gram, n = count_grams(words)
        at, behind = (x >> np.uint64(64 - bits) for x in (gram, context))
        size = 1 << bits
        return cls(*(np.bincount(x.astype(np.int64), w, size).astype(np.float32) for x, w in ((at, n), (behind, n), (behind, None))))

    def cost(self, context: str, char: str) -> float:
        return self._cost(context + char)

    def _cost(self, gram: str) -> float:
        found = self.known.get(gram)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[gram] = -math.log(self._share(gram))
        return found

    def line_cost(self, line: str, start: int = 1, end: int | None = None) -> float:
        """Cost of the characters of a line from ``start`` to before ``end``."""
        return math.fsum(self._cost(line[max(0, i - self.order + 1) : i + 1]) for i in range(start, min(end or len(line), len(line))))

    def _share(self, gram: str) -> float:
        """Probability of a gram's last character after the others."""
        share, char, d = 1e-3, ord(gram[-1]), self.discount
        for k in range(len(gram)):
            h = gram_hash(gram[len(gram) - 1 - k : -1])
            n = float(self.total[h >> self.shift])
            if n:
                share = max(float(self.count[_step(h, char) >> self.shift]) - d, 0) / n + d * float(self.kinds[h >> self.shift]) / n * share
        return share

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """``cost`` of many characters: rows of ``order`` codes with 1 added, the character last, 0 where the context does not reach."""
        share, d = np.full(len(codes), 1e-3), self.discount
        for k in range(self.order):
            h = np.full(len(codes), _SEED, np.uint64)
            for j in range(self.order - 1 - k, self.order - 1):
                h = _steps(h, codes[:, j])
            row, at = ((x >> np.uint64(self.shift)).astype(np.int64) for x in (h, _steps(h, codes[:, -1])))
            n = self.total[row].astype(float)
            some = n > 0
            if k:
                some &= codes[:, self.order - 1 - k] > 0
            share = np.where(some, (np.maximum(self.count[at] - d, 0) + d * self.kinds[row] * share) / np.where(some, n, 1), share)
        return -np.log(share)

    def apart(self, a: str, b: str) -> float:
        """What a space between two words costs; characters that see no difference are left out."""
        n, keep = len(a) + 1, self.order - 1
        return self.line_cost(f" {a} {b} ", n, n + keep + 1) - self.line_cost(f" {a}{b} ", n, n + keep)

    def all_apart(self, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``apart`` of many pairs: the last ``order - 1`` characters of a space and the first word, and the first of the second word and a space, as codes with 1 added, 0 where there are none."""
        keep, space = self.order - 1, np.full((len(ends), 1), ord(" ") + 1, np.uint64)
        out = np.zeros(len(ends))
        for sign, line in ((1, np.concatenate((ends, space, starts), axis=1)), (-1, np.concatenate((ends, starts), axis=1))):
            for i in range(keep, line.shape[1]):
                some = line[:, i] > 0
                out[some] += sign * self.costs(line[some, i - keep : i + 1])
        return out


def grams_of(word: str, order: int = ORDER) -> Iterator[str]:
    """Every n-gram that ends at a character of the word or at its end, up to ``order`` characters."""
    line = " " + word + " "
    for i in range(1, len(line)):
        for n in range(1, order + 1):
            if i - n + 1 >= 0:
                yield line[i - n + 1 : i + 1]


def count_grams(words: Counter[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the contexts and of the n-grams of ``grams_of`` over weighted words, and their counts: each n-gram once.

    Only the longest n-grams at each place are sorted; shorter ones are their ends.
    """
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    place = np.arange(len(codes), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)

    def hashes(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the contexts and of the n-grams of up to ``length`` characters that end at the places."""
        h = np.full(len(at), _SEED, np.uint64)
        for back in range(length - 1, 0, -1):
            h = np.where(place[at] >= back, _steps(h, codes[at - back]), h)
        return h, _steps(h, codes[at])

    ends = np.flatnonzero(place > 0)
    _, first, slot = np.unique(hashes(ends, ORDER)[1], return_index=True, return_inverse=True)
    n = np.bincount(slot, np.repeat(np.fromiter(words.values(), np.float64, len(words)), sizes)[ends])
    at = ends[first]
    parts = []
    for length in range(1, ORDER + 1):
        there = place[at] >= length - 1
        context, gram = hashes(at[there], length)
        gram, first, slot = np.unique(gram, return_index=True, return_inverse=True)
        parts.append((context[first], gram, np.bincount(slot, n[there]).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def restore(observed: str, model: CharModel) -> str:
    """The likeliest text behind a disguised token: a Viterbi walk whose states are the last characters put out.

    The lattice has an edge for each reading of each character; only the cheapest way into a state
    goes on, which is exact for this order of the model.
    """
    keep = model.order - 1
    best: dict[str, tuple[float, tuple | None]] = {" ": (0.0, None)}
    run = 0
    for i, c in enumerate(observed):
        run = run + 1 if i and observed[i - 1] == c else 1
        now: dict[str, tuple[float, tuple | None]] = {}
        for state, (cost, path) in best.items():
            for out, extra in _readings(c, run):
                if out == " " and state.endswith(" "):
                    new, price = state, cost + extra
                    way = path
                elif out:
                    new = (state + out)[-keep:]
                    price, way = cost + extra + model.cost(state, out), (out, path)
                else:
                    new, price, way = state, cost + extra, path
                if new not in now or price < now[new][0]:
                    now[new] = (price, way)
        best = now
    cost, path = min(((c + (0 if s.endswith(" ") else model.cost(s, " ")), p) for s, (c, p) in best.items()), key=lambda x: x[0])
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).strip()


def _readings(c: str, run: int) -> list[tuple[str, float]]:
    """What a character may stand for, and at what cost; ``run`` counts its repeats so far."""
    late = int(run > 2)
    again = [("", SQUEEZE[late])] if run > 1 else []
    if c.isalpha():
        return [(c, KEEP[late] if run > 1 else 0.0), *again]
    found = [(x, SUBSTITUTE) for x in RESEMBLES.get(c, "")] + again
    return found + ([] if c.isdigit() and found else [("", JOIN)]) + [(" ", BREAK if c != " " else 0.0)]


def disguised(token: str) -> bool:
    """True for a lower-case token whose lattice has more than one path worth a look: letters and something else inside, or a letter twice in a row."""
    if token.isalpha():
        return bool(_STRETCHED.search(token))
    return any(map(str.isalpha, token)) and not token.isspace()


#: What a token is: it has a wanted word; it is a lone letter or symbol, and a letter; it is a fragment, and one of letters, and one of a single character.
HIT, LONE, LONE_LETTER, PIECE, PIECE_LETTERS, PIECE_SINGLE = 1, 2, 4, 8, 16, 32


class _Tokens(dict):
    """Numbers of tokens; a new one is read once."""

    def __init__(self, reader: Reader):
        super().__init__()
        self.reader = reader

    def __missing__(self, token: str) -> int:
        reader = self.reader
        if reader.wanted is not None and len(token) > FRAGMENT and token.isalpha() and token[0] + token[-1] not in reader.edges_wanted:
            self[token] = 1
            return 1
        whole = token.strip(_OUTER)
        number = self[token] = self[whole] if whole != token else self.reader.add(token)
        return number


class Reader:
    """Words of many texts, with restored ones in place of disguised tokens and of runs of single letters, and beside fragments that read as one word.

    A token is read when it first comes up and is a number from then on; runs of single letters and
    fragments are found over the numbers of many texts at once. Digits and symbols that resemble
    letters belong to such runs and fragments, but are no words.

    ``wanted`` names the only words that matter: what cannot hold one of them, because it lacks a
    letter, is not decoded. Everything remembered is bounded by ``REMEMBERED`` and one slab of texts.
    """

    def __init__(self, model: CharModel, wanted: Iterable[str] | None = None):
        self.model = model
        self.wanted = None if wanted is None else frozenset(wanted)
        self.squeezed = None if wanted is None else {_RUN.sub(_once, w) for w in self.wanted}
        self.edges_wanted = None if wanted is None else {w[0] + w[-1] for w in self.wanted}
        self.masks = None if wanted is None else np.array([_mask(w) for w in self.wanted], np.uint64)
        self.clear()

    def clear(self) -> None:
        self.decoded: dict[str, tuple[str, ...]] = {}
        self.joins: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, int] = {}  # what pieces end and begin with
        self.edge_codes = array.array("Q")
        self.ids = _Tokens(self)
        # 0 stands between texts, 1 for every token that is a plain word of no interest.
        self.words: list[tuple[str, ...]] = [(), ()]
        self.text, self.lone = ["", ""], ["", ""]
        self.flags, self.mask = bytearray(2), array.array("Q", [0, 0])
        self.end, self.start = array.array("i", [0, 0]), array.array("i", [0, 0])

    def may_hold(self, masks: np.ndarray) -> np.ndarray:
        """False where no wanted word can be read from characters of these letters: each lacks one."""
        if self.wanted is None:
            return np.ones(len(masks), bool)
        out = np.zeros(len(masks), bool)
        for at in range(0, len(masks), BLOCK):
            out[at : at + BLOCK] = (self.masks & ~masks[at : at + BLOCK, None] == 0).any(axis=1)
        return out

    def add(self, whole: str) -> int:
        if self.wanted is not None and len(whole) > FRAGMENT and whole.isalpha() and whole not in self.wanted and (not _STRETCHED.search(whole) or _RUN.sub(_once, whole) not in self.squeezed):
            return 1
        words = self.token_words(whole)
        lone = len(words) == 1 and (len(words[0]) == 1 or words[0][0] in RESEMBLES)
        piece = 0 < len(whole) <= FRAGMENT and all(c.isalpha() or c in RESEMBLES for c in whole)
        flags = HIT * (self.wanted is not None and not self.wanted.isdisjoint(words)) + PIECE * piece
        if lone:
            flags |= LONE + LONE_LETTER * words[0].isalpha()
        if piece:
            flags |= PIECE_LETTERS * whole.isalpha() + PIECE_SINGLE * (len(whole) == 1)
        if not flags and self.wanted is not None:
            return 1
        self.flags.append(flags)
        self.words.append(tuple(w for w in words if w.isalpha()))
        self.text.append(whole)
        self.lone.append(words[0] if lone else "")
        self.mask.append(_mask(whole) if piece else 0)
        keep = self.model.order - 1
        self.end.append(self._edge((" " + whole)[-keep:].rjust(keep, "\0")) if piece else 0)
        self.start.append(self._edge((whole + " ")[:keep].ljust(keep, "\0")) if piece else 0)
        return len(self.words) - 1

    def _edge(self, chars: str) -> int:
        if chars not in self.edges:
            self.edges[chars] = len(self.edges)
            self.edge_codes.extend([ord(c) + 1 if c != "\0" else 0 for c in chars])
        return self.edges[chars]

    def decode(self, observed: str) -> tuple[str, ...]:
        if len(observed) > 3 and not self.may_hold(np.array([_mask(observed)], np.uint64))[0]:
            return ()
        found = self.decoded.get(observed)
        if found is None:
            found = tuple(_WORD.findall(restore(observed, self.model)))
            if len(self.decoded) < REMEMBERED:
                self.decoded[observed] = found
        return found

    def token_words(self, token: str) -> tuple[str, ...]:
        inner, whole = token.strip(_EDGE), token.strip(_OUTER)
        if whole and len(whole) <= SYMBOLS and all(c in RESEMBLES for c in whole):
            return (whole,)
        plain = tuple(_WORD.findall(inner))
        if plain and whole != inner:  # an edge that may be a letter or none
            return tuple(dict.fromkeys(self.decode(whole) + self.token_words(inner)))
        if not disguised(inner):
            return plain
        if inner.isalpha():
            if self.squeezed is not None and _RUN.sub(_once, inner) not in self.squeezed:
                return plain
            if 0 < len(_STRETCHED.findall(inner)) < 4 and not _LONG.search(inner):  # the lattice's few paths, written out
                parts = [(x,) if len(x) == 1 else (x, x[0]) for x in (m[0] for m in _PAIR.finditer(inner))]
                paths = ["".join(x) for x in itertools.product(*parts)]
                best = min(paths, key=lambda x: self.model.line_cost(f" {x} ") + KEEP[0] * (len(x) - len(parts)) + SQUEEZE[0] * (len(inner) - len(x)))
                return tuple(dict.fromkeys((best, inner)))
        restored = self.decode(inner)
        return restored if restored and (len(plain) != 1 or plain[0] != inner) else tuple(dict.fromkeys(restored + plain))

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, list[str]]]]:
        """Token numbers of the texts end to end, with a 0 before each text and at the end; the places of these; which tokens stand in a run that was decoded; and the words found at a run's end, by place."""
        if len(self.ids) > REMEMBERED:
            self.clear()
        flat, bounds, number = array.array("i"), [], self.ids.__getitem__
        for t in texts:
            bounds.append(len(flat))
            flat.append(0)
            flat.extend(map(number, (t or "").lower().split()))
        bounds.append(len(flat))
        flat.append(0)
        ids = np.frombuffer(flat, np.int32)
        flags = np.frombuffer(bytes(self.flags), np.uint8)[ids]
        found: list[tuple[int, list[str]]] = []
        gone = np.zeros(len(ids), bool)
        starts, ends = _runs(flags & LONE > 0)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            letters = flags[a:b] & LONE_LETTER > 0 if b - a > 2 else None
            if letters is not None and letters.any():
                gone[a:b] = letters.all()
                run = [self.lone[k] for k in ids[a:b].tolist()]
                at = range(0, max(1, len(run) - OVERLAP), LETTERS - OVERLAP)
                found.append((b, [x for k in at for x in self.decode(" ".join(run[k : k + LETTERS]))]))
        closes = self._closing(ids, flags)
        starts, ends = _runs(closes)
        if len(starts):
            piece = flags & PIECE > 0
            low, high = starts - (piece[starts - 1]), ends + 1 + piece[ends + 1]  # a neighbour may belong to the word without being liked beside a part of it
            mask = np.array(self.mask, np.uint64)[ids]
            seen = np.bitwise_or.reduceat(mask, np.stack([starts, ends + 1], axis=1).ravel())[::2] | mask[low] | mask[high - 1]
            kinds, slot = np.unique(seen, return_inverse=True)
            able = self.may_hold(kinds)[slot]
            for a, b, lo, hi in zip(*(x[able].tolist() for x in (starts, ends, low, high)), strict=True):
                there = {w for k in ids[max(0, lo - 8) : hi + 8].tolist() for w in self.words[k]}
                words = [x for x in self._joined([self.text[k] for k in ids[lo:hi].tolist()], a - lo, b + 1 - lo) if x not in there]
                if words:
                    found.append((hi, words))
        return ids, np.array(bounds), gone, found

    def _closing(self, ids: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """For each token but the last, whether it and the next are pieces of which some reading costs less without the space between them."""
        closes = np.zeros(len(ids) - 1, bool)
        piece, letters, lone = (flags & x > 0 for x in (PIECE, PIECE_LETTERS, PIECE_SINGLE))
        both = piece[:-1] & piece[1:] & ~(lone[:-1] & lone[1:])  # the run of single letters has those
        plain = np.flatnonzero(both & letters[:-1] & letters[1:])
        if len(plain):
            end, start = np.array(self.end, np.int64), np.array(self.start, np.int64)
            pairs, slot = np.unique(end[ids[plain]] << 32 | start[ids[plain + 1]], return_inverse=True)
            codes = np.array(self.edge_codes, np.uint64).reshape(-1, self.model.order - 1)
            closes[plain] = (self.model.all_apart(codes[pairs >> 32], codes[pairs & 0xFFFFFFFF]) > JOIN)[slot]
        for i in np.flatnonzero(both & ~(letters[:-1] & letters[1:])).tolist():
            closes[i] = self.closes(self.text[ids[i]], self.text[ids[i + 1]])
        return closes

    def closes(self, a: str, b: str) -> bool:
        """True if some reading of two pieces costs less without the space between them."""
        if (a, b) in self.joins:
            return self.joins[a, b]
        found = False
        if any(map(str.isalpha, a + b)) and not len(a) == len(b) == 1:
            read = [(a, b)] if (a + b).isalpha() else [("".join(x[: len(a)]), "".join(x[len(a) :])) for x in itertools.product(*[RESEMBLES.get(c, c) for c in a + b])]
            found = any(self.model.apart(x, y) > JOIN for x, y in read)
        if len(self.joins) < REMEMBERED:
            self.joins[a, b] = found
        return found

    def _joined(self, stretch: list[str], first: int, last: int) -> list[str]:
        """Words that the neighbouring pieces from ``first`` to before ``last`` make, each of which the model likes better beside the next."""
        inside = stretch[first:last]
        if all(map(str.isalpha, inside)):
            word = "".join(inside)
            if first and self.closes(stretch[0], word):
                word = stretch[0] + word
            if last < len(stretch) and self.closes(word, stretch[last]):
                word += stretch[last]
            return [word]
        out: list[str] = []
        for k in range(0, len(stretch), 32):
            part = stretch[max(0, k - 4) : k + 32]
            out.extend(x for x in self.decode(" ".join(part)) if x not in part)
        return out

    def words_of(self, texts: list[str | None]) -> Iterator[list[str]]:
        """Words of each text in order; those of a run stand at its end."""
        for at, to in slabs(texts):
            ids, bounds, gone, found = self.read(texts[at:to])
            more: dict[int, list[str]] = {}
            for place, words in found:
                more.setdefault(place, []).extend(words)
            for a, b in itertools.pairwise(bounds.tolist()):
                out: list[str] = []
                for k, (number, lost) in enumerate(zip(ids[a + 1 : b + 1].tolist(), gone[a + 1 : b + 1].tolist(), strict=True), a + 1):
                    if k in more:
                        out.extend(more[k])
                    if not lost:
                        out.extend(self.words[number])
                yield out

    def wanted_in(self, texts: list[str | None]) -> list[set[str]]:
        """The wanted words of each text."""
        out: list[set[str]] = []
        for at, to in slabs(texts):
            part: list[set[str]] = [set() for _ in range(at, to)]
            ids, bounds, gone, found = self.read(texts[at:to])
            hits = np.flatnonzero((np.frombuffer(bytes(self.flags), np.uint8)[ids] & HIT > 0) & ~gone)
            for text, k in zip((np.searchsorted(bounds, hits, "right") - 1).tolist(), ids[hits].tolist(), strict=True):
                part[text].update(self.wanted.intersection(self.words[k]))
            for place, words in found:
                part[int(np.searchsorted(bounds, place, "left")) - 1].update(self.wanted.intersection(words))
            out += part
        return out


def slabs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Cuts of a list of texts into stretches of about ``SLAB_CHARS`` characters, one text at least."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t or "") > SLAB_CHARS:
            yield at, k
            at, size = k, 0
        size += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the stretches of true flags."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _once(m: re.Match) -> str:
    return m[0][0]


def _mask(text: str) -> int:
    """A bit for each letter that some character of a text may stand for; letters beyond the 63 lowest bits share."""
    out = 0
    for c in set(text):
        for x in RESEMBLES.get(c, c):
            out |= 1 << (ord(x) & 63)
    return out


def words_in(text: str | None, model: CharModel) -> list[str]:
    return next(Reader(model).words_of([text]))


class Scorer:
    """Language model, weighted words and the line that turns their sum into a probability."""

    def __init__(self, tables: tuple[np.ndarray, np.ndarray, np.ndarray], weights: dict[str, float], slope: float, base: float):
        self.tables, self.weights, self.slope, self.base = tables, weights, slope, base

    def reader(self) -> Reader:
        return Reader(CharModel(*self.tables), self.weights)

    def evidence(self, texts: list[str | None], reader: Reader) -> np.ndarray:
        """Sum of the weights of each text's distinct words."""
        return np.array([math.fsum(self.weights[x] for x in sorted(found)) for found in reader.wanted_in(texts)], float)

    def score(self, texts: list[str | None], reader: Reader) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(texts, reader) + self.base, -40, 40)))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, docs_per_class: int) -> DataFrame:
    """At most ``docs_per_class`` labelled documents of either class, by hash order of their id and text: ``(doc_id, label, text)``; equal rows are one."""
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("key")
    rows = docs.select(F.col(id_col).alias("doc_id"), key, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    clean = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = materialize(rows.select("doc_id", "key").join(clean, "doc_id").select("label", "key").distinct(), "labelled")
    first = [known.where(F.col("label") == c).orderBy("key").limit(docs_per_class) for c in (0, 1)]
    return rows.join(F.broadcast(first[0].unionByName(first[1])), "key").dropDuplicates(["key"]).select("doc_id", "label", "text")


def language_model(docs: DataFrame, text_col: str = "text", bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the character model of all of ``docs``: each word counts once for every document that has it, so no text outweighs the rest.

    Spark counts words over all documents, then the n-grams of the distinct words, and folds these into
    ``2 ** bits`` rows for n-grams and for contexts, which is what comes to the driver at most.
    """
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+"))
    counted = docs.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            context, gram, n = count_grams(dict(zip(*(c.to_pylist() for c in b.columns), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(gram.view(np.int64)), pa.array(n)], ["context", "gram", "n"])

    row = lambda c: F.shiftrightunsigned(c, 64 - bits).cast("int").alias("at")
    single = materialize(counted.mapInArrow(grams, "context long, gram long, n long").groupBy("context", "gram").agg(F.sum("n").alias("n")), "grams")
    count, total, kinds = (np.zeros(1 << bits, np.float32) for _ in range(3))
    by_gram = single.groupBy(row("gram")).agg(F.sum("n").alias("n")).toArrow()
    count[by_gram["at"].to_numpy()] = by_gram["n"].to_numpy()
    by_context = single.groupBy(row("context")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    total[by_context["at"].to_numpy()], kinds[by_context["at"].to_numpy()] = by_context["n"].to_numpy(), by_context["kinds"].to_numpy()
    return count, total, kinds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_per_class: int = 2500, least_contexts: int = 8, least_gain: float = 12.0) -> Scorer:
    """The language model of all of ``docs``, and a classifier of a bounded sample of ``docs_per_class`` labelled documents of either class.

    Spark counts, over restored words of the sample, in how many distinct contexts (neighbouring words)
    each word stands in toxic and in clean documents. Contexts instead of documents make a copied
    passage count once. Words with enough contexts and enough gain (log-likelihood ratio) toward toxic
    keep their log-odds as weight; a one-variable logistic regression, weighted back to the classes'
    shares among all labels, maps the sum of a document's weights to a probability.

    Null texts are empty; labels other than 0 and 1 and labels of null ids teach nothing; of several
    labels of one id the highest holds; rows that repeat an id teach each. Without documents or without
    one of the classes no word has a weight.
    """
    spark = docs.sparkSession
    sample = materialize(_sample(docs, labels, id_col, text_col, label_col, docs_per_class).select("label", "text"), "sample")
    tables = language_model(docs, text_col)
    shared = spark.sparkContext.broadcast(tables)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(CharModel(*shared.value))
        for b in batches:
            seen = set()
            for label, found in zip(b.column(0).to_pylist(), reader.words_of(b.column(1).to_pylist()), strict=True):
                words = ["", *found, ""]
                seen.update((w, f"{x} {y}", label) for x, w, y in zip(words[:-2], words[1:-1], words[2:], strict=True))
            cols = list(zip(*sorted(seen), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["word", "context", "label"])

    seen = sample.repartition(SAMPLE_TASKS).mapInArrow(contexts, "word string, context string, label int")
    # Words with a toxic place are few beside all words; clean words without any cannot gain.
    by_word = seen.groupBy("word", "context").agg(F.max("label").alias("toxic"), F.min("label").alias("all_toxic")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("all_toxic")).alias("c"))
    by_word = materialize(by_word, "words")
    totals = by_word.agg(F.sum("t"), F.sum("c"))
    t_all, c_all = (float(x or 0) for x in totals.first())
    weights: dict[str, float] = {}
    if t_all and c_all:
        t, c = F.col("t").cast("double"), F.col("c").cast("double")
        share = (t + c) / (t_all + c_all)
        gain = 2 * (t * F.log(t / (share * t_all)) + F.when(c > 0, c * F.log(c / (share * c_all))).otherwise(0.0))
        odds = F.log((t + 0.5) / (t_all + 1)) - F.log((c + 0.5) / (c_all + 1))
        scored = by_word.where((t >= least_contexts) & (t / t_all > 3 * c / c_all)).select("word", odds.alias("odds"), gain.alias("gain"))
        weights = {r[0]: r[1] for r in sorted(scored.where(F.col("gain") >= least_gain).select("word", "odds").collect())}
    found = spark.sparkContext.broadcast(Scorer(tables, weights, 1.0, 0.0))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = found.value.reader()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.value.evidence(b.column(1).to_pylist(), reader))], ["label", "x"])

    points = [tuple(r) for r in sample.mapInArrow(evidence, "label int, x double").collect()]
    shares = {r[0]: r[1] for r in labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int")).count().collect()}
    return Scorer(tables, weights, *fit_line(sorted(points), shares))


def fit_line(points: list[tuple[int, float]], shares: dict[int, int], steps: int = 50) -> tuple[float, float]:
    """Slope and base of a logistic regression by Newton steps with a little shrinkage; one class alone gives its own share."""
    if not points:
        return 0.0, -2.0
    y, x = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    w = np.where(y == 1, shares.get(1, 0) / n[1], shares.get(0, 0) / n[0])
    w = w / w.sum() * len(y) if w.sum() else np.ones(len(y))
    beta, design = np.zeros(2), np.stack([x, np.ones(len(x))], axis=1)
    ridge = np.diag([0.1, 0.01])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        g = design.T @ (w * (y - p)) - ridge @ beta
        h = design.T @ (design * (w * p * (1 - p))[:, None]) + ridge
        beta = beta + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(beta[0]), float(beta[1])


def scorer_of(spark: SparkSession, scorer: Scorer) -> Callable[[Column], Column]:
    """A function of a text column: the toxicity of each text, 0 to 1, null and empty texts included. Only the text goes through Python."""
    shared = spark.sparkContext.broadcast(scorer)

    @F.arrow_udf(T.DoubleType())
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = shared.value.reader()
        for texts in batches:
            yield pa.array(shared.value.score(texts.to_pylist(), reader))

    return each


def score(docs: DataFrame, labelled: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs``, learned from ``labels`` of the documents ``labelled``.

    Rows without a usable label teach nothing; without any label every score is the same low one.
    Repeated rows get equal results; an empty table gives an empty table.
    """
    scorer = train(labelled, labels, id_col, text_col, label_col, **options)
    found = docs.select(F.col(id_col).alias("doc_id"), scorer_of(docs.sparkSession, scorer)(F.col(text_col)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
