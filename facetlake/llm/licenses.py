"""License scans by diagonal voting: rolling k-gram hashes of whole texts joined to places in templates."""

from __future__ import annotations

import bisect
import difflib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlake.llm import shingles
from facetlake.storage import materialize

#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IS_WORD = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Words of a rolling gram.
GRAM = 2
#: Neighbouring diagonals merge when they are at most so far apart: words that were put in or left out.
DRIFT = 3
#: Least likeness of a verified span to its template.
LIKENESS = 0.8
#: Numbers that documents with a candidate are told by before their texts move: the most rows of that broadcast.
MARKS = 1 << 20

#: Phrases whose every exact place counts.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# The wording of public licences and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in
binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
#: Licence bodies, notices and single sentences, found with changes too.
WORDINGS = (
    (_MIT, "mit"),
    (_APACHE, "apache-2.0"),
    (_BSD, "bsd"),
    (_ISC, "isc"),
    (_GPL, "gpl-3.0"),
    (_MPL, "mpl-2.0"),
    (_UNLICENSE, "unlicense"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work has been dedicated to the public domain", "public-domain"),
    ("mozilla public license version 2 0", "mpl-2.0"),
)
#: Grams of these words alone stand in every text; they give no votes.
_COMMON = frozenset(b"a an and any are as at be by for from in is it of on or that the this to use was with you your not may".split())


def words_of(text: bytes) -> list[bytes]:
    data = _LOWER[np.frombuffer(text, np.uint8)]
    line = data.tobytes()
    return [line[s:e] for s, e in zip(*map(np.ndarray.tolist, shingles.word_spans(data, IS_WORD)), strict=True)]


def gram_hashes(text: bytes) -> np.ndarray:
    """Hash of the gram that begins at each word but the last, as signed longs."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    words = shingles.word_hashes(data, *shingles.word_spans(data, IS_WORD))
    return shingles.rolling(words, GRAM).view(np.int64) if len(words) >= GRAM else np.empty(0, np.int64)


def templates(base=BASE, wordings=WORDINGS) -> list[tuple[list[bytes], str, bool]]:
    """The words of each phrase, its label, and whether it is a base phrase."""
    return [(words_of(p.encode()), label, True) for p, label in base] + [(words_of(p.encode()), label, False) for p, label in wordings]


def places(entries: list[tuple[list[bytes], str, bool]], likeness: float = LIKENESS) -> list[tuple[int, int, int, int, bool, int]]:
    """(hash, template, place, votes needed, base phrase, words) of the grams that vote.

    A base phrase needs all its grams. Of a wording as many words may change as leave it ``likeness``,
    and each changed word takes two votes at most.
    """
    out = []
    for t, (words, label, exact) in enumerate(entries):
        if len(words) < GRAM:
            raise ValueError(f"a phrase needs {GRAM} words: {label}")
        grams = enumerate(gram_hashes(b" ".join(words)).tolist())
        own = [(place, h) for place, h in grams if exact or not _COMMON.issuperset(words[place : place + GRAM])]
        needed = len(words) - GRAM + 1 if exact else max(1, len(own) - GRAM * int(len(words) * (1 - likeness) + 1e-9))
        out += [(h, t, place, needed, exact, len(words)) for place, h in own]
    return out


def diagonals(docs: DataFrame, entries: list[tuple[list[bytes], str, bool]], likeness: float = LIKENESS) -> DataFrame:
    """``(doc_key, template, diagonal, needed, exact, words, votes, first, last)``: votes by document, template and diagonal, which is place in text minus place in template.

    Every rolling gram of every text is a row and joins the template places (a fixed list, so it may be
    broadcast).
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [gram_hashes(x or b"") for x in b.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, values)], ["doc_key", "grams"])

    rows = docs.select("doc_key", F.col("text").cast("binary").alias("text")).mapInArrow(grams, "doc_key struct<doc_id:long,hash:long>, grams array<long>")
    rows = rows.select("doc_key", F.posexplode("grams").alias("place", "gram"))
    known = docs.sparkSession.createDataFrame(places(entries, likeness), "gram long, template int, at int, needed int, exact boolean, words int")
    # Equal documents have each place twice.
    hits = rows.join(F.broadcast(known), "gram").select("doc_key", "template", "place", "at", "needed", "exact", "words").distinct().withColumn("diagonal", F.col("place") - F.col("at"))
    return hits.groupBy("doc_key", "template", "diagonal", "needed", "exact", "words").agg(F.count("*").alias("votes"), F.min("place").alias("first"), (F.max("place") + GRAM - 1).alias("last"))


def merged_spans(lines: DataFrame) -> DataFrame:
    """``(doc_key, template, first, last)``: stretches that enough grams of a wording vote for.

    Neighbouring diagonals whose stretches touch merge, so a word put in or left out does not split the votes.
    """
    order = Window.partitionBy("doc_key", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT) | (F.col("first") - F.lag("last").over(order) > F.col("words"))
    loose = lines.where("not exact").withColumn("run", F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(order))
    merged = loose.groupBy("doc_key", "template", "run", "needed", "words").agg(F.sum("votes").alias("votes"), F.min(F.least("diagonal", "first")).alias("first"), F.max(F.greatest(F.col("diagonal") + F.col("words") - 1, F.col("last"))).alias("last"))
    return merged.where("votes >= needed").select("doc_key", "template", "first", "last")


def verify(words: list[bytes], first: int, last: int, phrase: list[bytes]) -> float:
    """Likeness of a span's words to a phrase: the share of words in common order, of the longer of the phrase and the stretch that they reach over."""
    span = words[max(0, first) : last + 1]
    blocks = [m for m in difflib.SequenceMatcher(None, span, phrase, autojunk=False).get_matching_blocks() if m.size]
    if not blocks:
        return 0.0
    reach = blocks[-1].a + blocks[-1].size - blocks[0].a
    return sum(m.size for m in blocks) / max(reach, len(phrase))


def windows(first: int, last: int, size: int, likeness: float = LIKENESS) -> Iterator[tuple[int, int]]:
    """Parts ``(first, last)`` of a span in which any stretch like a phrase of ``size`` words lies whole.

    Such a stretch reaches over ``size / likeness`` words at most. A span of up to twice as many is one
    part; a longer one, of a wording that comes again and again, is cut into parts of that width which
    overlap by half, so the work on a span grows with its length and not with the square of it.
    """
    reach = math.ceil(size / likeness) + 1
    if last - first + 1 <= 2 * reach:
        yield first, last
        return
    for a in range(first, last - reach + 1, reach):
        yield a, min(a + 2 * reach - 1, last)


def best_apart(found: list[tuple[int, float, int, int, str]]) -> list[tuple[int, float, int, int, str]]:
    """Of ``(words of the phrase, likeness, first, last, label)`` those that overlap none before them: the longest phrase counts, then the likest."""
    kept: list[tuple[int, int]] = []
    out = []
    for x in sorted(found, key=lambda x: (-x[0], -x[1], x[2])):
        k = bisect.bisect(kept, (x[2], x[3]))
        if (k == 0 or kept[k - 1][1] < x[2]) and (k == len(kept) or x[3] < kept[k][0]):
            kept.insert(k, (x[2], x[3]))
            out.append(x)
    return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, wordings=WORDINGS, likeness: float = LIKENESS) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)`` for every row of ``docs``.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are their smallest and
    largest start, ``labels`` also has those of wordings that a span is like, ``score`` is the best
    verified likeness and ``spans`` lists ``label@first-last`` of these. Null texts are empty: no words, no
    labels, score 0. Rows that repeat an id are told apart by their text; equal rows get equal results;
    an empty table gives an empty table.

    The first scan counts votes. All grams of a base phrase on one diagonal are its words, so its places
    need no text. The second scan verifies wordings word by word: a text moves only where its document
    may have a candidate, which a broadcast of at most ``MARKS`` numbers tells.
    """
    entries = templates(base, wordings)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash")).alias("doc_key"), text.alias("text"))
    lines = materialize(diagonals(rows, entries, likeness), "diagonals")
    mark = F.pmod(F.xxhash64("doc_key.hash"), F.lit(MARKS)).cast("int").alias("mark")
    labels = docs.sparkSession.createDataFrame([(t, label) for t, (_, label, _) in enumerate(entries)], "template int, label string")
    exact = lines.where("exact and votes >= needed").join(F.broadcast(labels), "template")
    exact = exact.groupBy("doc_key").agg(F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.array_sort(F.collect_set("label")).alias("basic"))
    spans = materialize(merged_spans(lines).groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("template", "first", "last"))).alias("spans")), "spans")
    marks = spans.select(mark).distinct().withColumn("marked", F.lit(True))

    kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("like", pa.float64())]))

    @F.arrow_udf(T.ArrayType(T.StructType.fromDDL("label string, first long, last long, like double")))
    def verified(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            out = []
            for data, candidates in zip(texts.to_pylist(), found.to_pylist(), strict=True):
                words = words_of(data) if candidates else []
                likes = []
                for c in candidates or ():
                    phrase, label, _ = entries[c["template"]]
                    for first, last in windows(c["first"], c["last"], len(phrase), likeness):
                        like = verify(words, first, last, phrase)
                        if like >= likeness:
                            likes.append((len(phrase), like, first, last, label))
                out.append([{"label": x[4], "first": x[2], "last": x[3], "like": x[1]} for x in best_apart(likes)])
            yield pa.array(out, kind)

    x = rows.select("doc_key", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), "text", mark).join(F.broadcast(marks), "mark", "left")
    x = x.select("doc_key", "n_words", F.when(F.col("marked"), F.col("text")).cast("binary").alias("text"))
    met = x.join(spans, "doc_key", "left").join(exact, "doc_key", "left")
    like = F.when(F.col("spans").isNotNull(), verified("text", "spans"))
    met = met.select("doc_key.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("basic", F.array().cast("array<string>")).alias("basic"), F.coalesce(like, F.array().cast("array<struct<label:string,first:bigint,last:bigint,like:double>>")).alias("like"))
    every = F.array_sort(F.array_distinct(F.concat("basic", F.col("like.label"))))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("like.like"), F.lit(0.0)))
    listed = F.array_join(F.transform("like", lambda s: F.concat(s["label"], F.lit("@"), s["first"], F.lit("-"), s["last"])), ";")
    return met.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("basic", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"), listed.alias("spans"))
