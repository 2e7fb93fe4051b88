"""Rolling hashes of words in whole texts, as arrays."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x100000001B3)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes between two places at which powers start over.
POWERS = 1 << 20
_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        with np.errstate(over="ignore"):
            _TABLES.append(tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(POWERS, x, np.uint64)))) for x in (_BASE, _BACK)))
    return _TABLES[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _STEP
        h = (h ^ (h >> np.uint64(32))) * _GOLD
        return h ^ (h >> np.uint64(32))


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each run of bytes that ``is_word`` (256 flags) marks."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes that does not depend on where the word stands.

    Prefix sums of byte * base**place give a word by subtraction, and an inverse power moves it to
    place zero; both wrap at 64 bits, which keeps them exact. The sums run in stretches of
    ``POWERS`` bytes, so memory beside the text is bounded.
    """
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    w = 0
    with np.errstate(over="ignore"):
        while w < len(starts):
            origin = int(starts[w])
            to = max(w + 1, int(np.searchsorted(ends, origin + POWERS, "right")))
            if ends[to - 1] - origin > POWERS:  # one word longer than a stretch
                h = np.uint64(0)
                for at in range(origin, int(ends[w]), POWERS):
                    piece = data[at : min(at + POWERS, int(ends[w]))].astype(np.uint64) + np.uint64(1)
                    h = mix(h[None] + np.sum(piece * up[: len(piece)], dtype=np.uint64))[0]
                out[w] = h
            else:
                s, e = starts[w:to] - origin, ends[w:to] - origin
                sums = np.zeros(int(e[-1]) + 1, np.uint64)
                np.cumsum((data[origin : origin + int(e[-1])].astype(np.uint64) + np.uint64(1)) * up[: int(e[-1])], out=sums[1:])
                out[w:to] = (sums[e] - sums[s]) * down[s]
            w = to
    return mix(out)


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words; of all words where they are fewer; none of no words."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _BASE * _GOLD + words[i : i + n]
    return mix(h)
