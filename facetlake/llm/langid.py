"""Language of every word by a linear-chain conditional random field, and of a document by its words.

Words are runs of letters. A word's score for a language sums hashed weights of its character bigrams
and trigrams with word ends, its three-letter affixes and, as the lexicon, the word itself; learned
transitions tie neighbours together. Forward-backward gives each word's posterior, so code-switched
text gets a language for each stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.storage import materialize

#: Log2 of the weight table's rows.
HASH_BITS = 18
#: Characters whose features are computed at a time.
PART_CHARS = 1 << 20
#: Words of a training sequence, and of a stretch in one language within it.
SEQUENCE, STRETCH = 32, 16
UNKNOWN = "und"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _bucket(*parts: np.ndarray | int) -> np.ndarray:
    """Table row of a feature from its parts, mixed as 64-bit words."""
    h = np.uint64(0)
    for p in parts:
        h = (h + np.asarray(p, np.uint64) + np.uint64(1)) * _GOLD
        h = h ^ (h >> np.uint64(29))
    return ((h * _GOLD) >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def word_features(text: str) -> tuple[list[tuple[np.ndarray, np.ndarray | None]], int, np.ndarray]:
    """Feature rows of the words of a lower-cased text, the number of words, and each word's first character.

    Features come as ``(rows, offsets)``, offsets being each word's first row, or None for one row a word.
    """
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    edge = np.diff(letter.view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    n = len(starts)
    if not n:
        return [], 0, starts
    c = np.where(letter, codes, 0).astype(np.uint64)
    at = np.flatnonzero(letter | np.concatenate(([False], letter[:-1])))  # a word's letters and the place behind it
    c0, c1 = c[at], c[at - 1]
    c2 = np.where(c1 > 0, c[np.maximum(at - 2, 0)], 0)
    offsets = np.concatenate(([0], np.cumsum(ends - starts + 1)[:-1]))
    size = ends - starts
    first3 = [np.where(size > k, c[np.minimum(starts + k, len(c) - 1)], 0) for k in range(3)]
    last3 = [np.where(size > k, c[ends - 1 - k], 0) for k in range(3)]
    # A word's hash is a difference of prefix sums of code * base**place, brought back to place 0 by the inverse power.
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(c), _BASE, np.uint64))
        back = np.cumprod(np.full(len(c), np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * power)))
        whole = (sums[ends] - sums[starts]) * back[starts]
        rows = [
            (_bucket(2, c1, c0), offsets),
            (_bucket(3, c2, c1, c0), offsets),
            (_bucket(4, *first3), None),
            (_bucket(5, *last3), None),
            (_bucket(6, whole), None),
        ]
    return rows, n, starts - 1


def forward_backward(scores: np.ndarray, begins: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Posterior of each label at each word of many chains laid end to end.

    ``scores`` is words x labels in log space, ``begins`` marks each chain's first word, ``start`` and
    ``move`` are log weights. The words are cut into equal columns that advance side by side: first
    each column's whole transfer matrix, then the messages at column edges, then all words. A chain's
    first word has a transfer matrix that forgets what came before, so chains may cross columns.
    """
    n, labels = scores.shape
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a, pi = np.exp(move - move.max()), np.exp(start - start.max())
    k = max(1, min(1024, int(n**0.5)))
    t = -(-n // k)
    e = np.concatenate((e, np.ones((k * t - n, labels)))).reshape(k, t, labels)
    fresh = np.concatenate((begins, np.ones(k * t - n, bool))).reshape(k, t)
    whole = np.broadcast_to(np.eye(labels), (k, labels, labels)).copy()
    for s in range(t):
        step = np.where(fresh[:, s, None, None], whole.sum(axis=2, keepdims=True) * pi, whole @ a) * e[:, s, None, :]
        whole = step / step.max(axis=(1, 2), keepdims=True)
    into, back = np.ones((k, labels)), np.ones((k, labels))
    for i in range(1, k):
        v = into[i - 1] @ whole[i - 1]
        into[i] = v / v.sum()
    for i in range(k - 2, -1, -1):
        v = whole[i + 1] @ back[i + 1]
        back[i] = v / v.sum()
    ahead = np.empty((t, k, labels))
    for s in range(t):
        into = np.where(fresh[:, s, None], into.sum(axis=1, keepdims=True) * pi, into @ a) * e[:, s]
        into /= into.sum(axis=1, keepdims=True)
        ahead[s] = into
    for s in range(t - 1, -1, -1):
        ahead[s] *= back
        back = e[:, s] * back
        back = np.where(fresh[:, s, None], (back @ pi)[:, None], back @ a.T)
        back /= back.sum(axis=1, keepdims=True)
    found = ahead.transpose(1, 0, 2).reshape(k * t, labels)[:n]
    return found / found.sum(axis=1, keepdims=True)


class Tagger:
    """Trained weights; ``labels`` empty means that there was nothing to learn from."""

    def __init__(self, labels: list[str], weights: np.ndarray, start: np.ndarray, move: np.ndarray):
        self.labels, self.weights, self.start, self.move = labels, weights, start, move

    def scores(self, features, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.labels)), np.float32)
        for rows, offsets in features:
            w = self.weights[rows]
            out += w if offsets is None else np.add.reduceat(w, offsets, axis=0)
        return out

    def posteriors(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For stretches of about ``PART_CHARS`` characters of texts: the first one's place, the words of each, and the label posteriors of all their words."""
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to] or "") <= PART_CHARS):
                chars += len(texts[to] or "")
                to += 1
            part = [(x or "").lower() for x in texts[at:to]]
            if len(part) > 1:
                features, n, places = word_features(" ".join(part))
                counts = np.bincount(np.searchsorted(np.cumsum([len(x) + 1 for x in part]), places, "right"), minlength=len(part)) if n else np.zeros(len(part), int)
                scores = self.scores(features, n)
            else:
                scores = np.concatenate([self.scores(f, n) for f, n, _ in map(word_features, windows(part[0], PART_CHARS))])
                counts = np.array([len(scores)])
            p = np.empty((0, len(self.labels)))
            if len(scores):
                begins = np.zeros(len(scores), bool)
                begins[(np.cumsum(counts) - counts)[counts > 0]] = True
                p = forward_backward(scores.astype(np.float64), begins, self.start, self.move)
            yield at, counts, p
            at = to

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, its mean posterior over the words, the number of words and of stretches in one language, for each text."""
        found, score, words, stretches = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        if self.labels:
            for at, counts, p in self.posteriors(texts):
                if len(p):
                    some = counts > 0
                    begin = (np.cumsum(counts) - counts)[some]
                    mean = np.add.reduceat(p, begin) / counts[some, None]
                    label = p.argmax(axis=1)
                    turn = np.concatenate(([True], label[1:] != label[:-1]))
                    turn[begin] = True
                    stretches[at + np.flatnonzero(some)] = np.add.reduceat(turn, begin, dtype=np.int64)
                    for i, m in zip(at + np.flatnonzero(some), mean, strict=True):
                        best = int(m.argmax())
                        found[i], score[i] = self.labels[best], min(1.0, float(m[best]))
                words[at : at + len(counts)] = counts
        return found, score, words, stretches

    def stretches(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, str, float]]]:
        """First word, last word, language and mean posterior of each stretch of words in one language, for each text."""
        for _, counts, p in self.posteriors(texts) if self.labels else ():
            for begin, n in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True):
                own = p[begin : begin + n]
                label = own.argmax(axis=1)
                first = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1]))) if n else []
                last = np.concatenate((first[1:], [n])) - 1 if n else []
                yield [(int(a), int(b), self.labels[label[a]], min(1.0, float(own[a : b + 1, label[a]].mean()))) for a, b in zip(first, last, strict=True)]


def windows(text: str, size: int) -> Iterator[str]:
    """Cuts of a long text between words: before its last other character than a letter within ``size``, or its next one beyond."""
    letter = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] if len(text) > size else ()
    at = 0
    while len(text) - at > size:
        back = np.flatnonzero(~letter[at + 1 : at + size + 1])
        ahead = () if len(back) else np.flatnonzero(~letter[at + size + 1 :])
        to = at + 1 + int(back[-1]) if len(back) else at + size + 1 + int(ahead[0]) if len(ahead) else len(text)
        yield text[at:to]
        at = to
    if at < len(text) or not text:
        yield text[at:]


def fit(stretches: list[tuple[str, str]], epochs: int = 12, batch: int = 128, rate: float = 0.25, decay: float = 1e-6, seed: int = 7) -> Tagger:
    """Train on ``(language, stretch of words)``: sequences join stretches of several documents, so switches are seen and their weights learned.

    Maximises the conditional log-likelihood with AdaGrad; the gradient is observed minus expected
    feature counts, the expectation coming from forward-backward over each batch.
    """
    labels = sorted({x for x, _ in stretches})
    if not labels:
        return Tagger([], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    n = len(labels)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(stretches))
    text, gold = [], []
    for k in order:
        features, words, _ = word_features(stretches[k][1].lower())
        if words:
            text.append(stretches[k][1].lower())
            gold.append(np.full(words, labels.index(stretches[k][0])))
    if not gold:
        return Tagger([], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    features, words, _ = word_features(" ".join(text))
    y = np.concatenate(gold)
    size = min(SEQUENCE, words)
    count = words // size
    w, start, move = np.zeros((1 << HASH_BITS, n), np.float32), np.zeros(n), np.zeros((n, n))
    seen = [np.full(x.shape, 1e-2) for x in (start, move)]
    seen_w = np.full(w.shape, 1e-2, np.float32)
    lengths = [None if o is None else np.diff(np.concatenate((o, [len(r)]))) for r, o in features]
    for _ in range(epochs):
        for block in np.array_split(rng.permutation(count), max(1, count // batch)):
            at = (block[:, None] * size + np.arange(size)).ravel()
            rows, owner = [], []
            for (r, o), ln in zip(features, lengths, strict=True):
                if o is None:
                    rows.append(r[at])
                    owner.append(np.arange(len(at)))
                else:
                    own = np.repeat(np.arange(len(at)), ln[at])
                    inside = np.arange(len(own)) - np.repeat(np.cumsum(ln[at]) - ln[at], ln[at])
                    rows.append(r[o[at][own] + inside])
                    owner.append(own)
            rows, owner = np.concatenate(rows), np.concatenate(owner)
            scores = np.stack([np.bincount(owner, w[rows, k], len(at)) for k in range(n)], axis=1)
            p, pairs = _marginals(scores.reshape(len(block), size, n), start, move)
            target = np.eye(n)[y[at]]
            gap = target - p.reshape(-1, n)
            seq = y[at].reshape(len(block), size)
            g_move = -pairs
            np.add.at(g_move, (seq[:, :-1].ravel(), seq[:, 1:].ravel()), 1)
            g_start = gap.reshape(len(block), size, n)[:, 0].sum(axis=0)
            for x, g, s in ((start, g_start, seen[0]), (move, g_move, seen[1])):
                g = g / len(block)
                s += g * g
                x += rate * g / np.sqrt(s)
            touched, slot = np.unique(rows, return_inverse=True)
            g = np.stack([np.bincount(slot, gap[owner, k], len(touched)) for k in range(n)], axis=1).astype(np.float32) / len(block) - decay * w[touched]
            seen_w[touched] += g * g
            w[touched] += rate * g / np.sqrt(seen_w[touched])
    return Tagger(labels, w, start, move)


def _marginals(scores: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of equally long sequences and expected counts of label pairs."""
    b, t, n = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a, pi = np.exp(move - move.max()), np.exp(start - start.max())
    ahead, back = np.empty_like(e), np.ones_like(e)
    v = pi * e[:, 0]
    ahead[:, 0] = v / v.sum(axis=1, keepdims=True)
    for s in range(1, t):
        v = (ahead[:, s - 1] @ a) * e[:, s]
        ahead[:, s] = v / v.sum(axis=1, keepdims=True)
    for s in range(t - 2, -1, -1):
        v = (e[:, s + 1] * back[:, s + 1]) @ a.T
        back[:, s] = v / v.sum(axis=1, keepdims=True)
    p = ahead * back
    p /= p.sum(axis=2, keepdims=True)
    x = ahead[:, :-1, :, None] * a * (e[:, 1:] * back[:, 1:])[:, :, None, :]
    x /= x.sum(axis=(2, 3), keepdims=True)
    return p, x.sum(axis=(0, 1))


def training_stretches(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int = 500, stretches_per_doc: int = 6) -> list[tuple[str, str]]:
    """A bounded sample of ``(language, stretch)``: ``docs_per_lang`` documents of every language by hash order, ``stretches_per_doc`` stretches from all over each.

    Documents rank by a hash of their id and text, so rows that share an id, or have none, are drawn
    each; equal rows are one. A first cut at three times the wanted share keeps the ranking small however
    large the table. What is picked joins the texts by Spark's own check of its size.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), key.alias("key"), F.col(text_col).alias("text"))
    sizes = materialize(known.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")), "languages")
    place = F.pmod("key", F.lit(1 << 40)) / float(1 << 40)
    drawn = known.select("lang", "key").join(sizes, "lang").where(place <= 3.0 * docs_per_lang / F.col("n")).select("lang", "key").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1 << 40)), "key"))
    picked = materialize(drawn.withColumn("rank", rank).where(F.col("rank") <= docs_per_lang).select("lang", "key"), "picked")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, out = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.split()
                seed = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest())
                places = np.random.default_rng(seed).integers(0, max(1, len(words) - STRETCH + 1), stretches_per_doc) if words else []
                for p in sorted(set(map(int, places))):
                    langs.append(lang)
                    out.append(" ".join(words[p : p + STRETCH]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.string())], ["lang", "stretch"])

    rows = known.join(picked, ["lang", "key"], "left_semi").select("lang", "text").mapInArrow(stretches, "lang string, stretch string").distinct()
    return sorted((r[0], r[1]) for r in rows.collect())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sample) -> Tagger:
    """Fit on a bounded sample of labelled rows; see ``training_stretches`` for the bounds."""
    return fit(training_stretches(docs, id_col, text_col, lang_col, **sample))


def tagger_of(spark: SparkSession, tagger: Tagger) -> Callable[[Column], Column]:
    """A function of a text column: ``(lang_pred, score, n_words, n_stretches)`` of each text.

    ``score`` is the language's mean posterior over all words, ``n_stretches`` how often the words' language begins or changes.
    Null texts and texts without a letter get ``und``, score 0 and no stretch. Only the text goes through Python.
    """
    shared = spark.sparkContext.broadcast((tagger.labels, tagger.weights, tagger.start, tagger.move))

    @F.arrow_udf(T.StructType.fromDDL("lang_pred string, score double, n_words long, n_stretches long"))
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Tagger(*shared.value)
        for texts in batches:
            found, score, words, stretches = model.predict(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(score), pa.array(words), pa.array(stretches)], ["lang_pred", "score", "n_words", "n_stretches"])

    return each


def identify(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sample) -> DataFrame:
    """``(doc_id, lang_pred, score, n_words, n_stretches)`` for every row of ``docs``, learned from ``labelled`` (``docs`` if None).

    Without labelled rows every prediction is ``und`` with score 0. Repeated rows get equal results;
    an empty table gives an empty table.
    """
    tagger = train(docs if labelled is None else labelled, id_col, text_col, lang_col, **sample)
    tag = tagger_of(docs.sparkSession, tagger)
    return docs.select(F.col(id_col).alias("doc_id"), tag(F.col(text_col)).alias("found")).select("doc_id", "found.*")


def label_words(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, first_word, last_word, lang, score)``: every stretch of words in one language of every row, words from 0, neighbouring words of one label together.

    ``score`` is the mean posterior over the stretch. Texts without words, null ones too, have no row; an
    empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tagger.labels, tagger.weights, tagger.start, tagger.move))

    @F.arrow_udf(T.ArrayType(T.StructType.fromDDL("first_word long, last_word long, lang string, score double")))
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Tagger(*shared.value)
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))
        names = [f.name for f in kind.value_type]
        for texts in batches:
            found = list(model.stretches(texts.to_pylist())) or [[]] * len(texts)
            yield pa.array([[dict(zip(names, x, strict=True)) for x in rows] for rows in found], kind)

    return docs.select(F.col(id_col).alias("doc_id"), F.inline(each(F.col(text_col))))
