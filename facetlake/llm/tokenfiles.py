"""Token ids in binary shards: each document one zstandard frame under a shared dictionary, with an offset index.

A shard file is, in little-endian order::

    magic     8 bytes  b"FLTOKEN1"
    frames             one zstandard frame a document, in ascending doc_id
    index              doc_id int64[n], then end offset uint64[n], then ids uint32[n]
    trailer   struct   dictionary hash (32 bytes, SHA-256), bytes of an id (uint32), documents n, those without doc_id (they come first),
                       bytes of frames, ids of all documents (uint64 each)

The dictionary is the file ``ids.zdict`` beside the shards; the hash in each trailer names the one
that reads them. One document is read with the trailer, the index and its own frame.
"""

from __future__ import annotations

import array
import hashlib
import io
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAGIC, TRAILER = b"FLTOKEN1", "<32sIQQQQ"
DICTIONARY_FILE, SUFFIX = "ids.zdict", ".tok"
#: Bytes of text that make a shard, about.
SHARD_BYTES = 64 << 20
#: Longest document that a dictionary is trained on.
MOST_CHARS = 50_000
#: Chunks of text that an encoder remembers.
REMEMBERED = 1_000_000
_ENCODERS: dict[str, ChunkEncoder] = {}


class ChunkEncoder(dict):
    """Whole-text encoding that hands each distinct chunk to the tokenizer once.

    The byte-level pattern always begins a new piece at a space that non-space follows, so a text whose
    spaces are all like that is cut at them. This dictionary maps what follows a space to the packed
    ids of space and chunk: a chunk that is not there yet is cut by the tokenizer's pattern and each
    piece goes to the tokenizer's model. Any other text goes to the tokenizer whole, and so does every
    text of a tokenizer that is not of this kind.
    """

    def __init__(self, path: str, dtype: np.dtype):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.by_chunk = _byte_level(json.loads(self.tokenizer.to_str()))
        self.code = "H" if dtype.itemsize == 2 else "I"  # native byte order is little-endian wherever Spark runs its workers
        self.tokenize = self.tokenizer.model.tokenize
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd_space = re.compile(r" (?:\s|$)").search
        # The byte alphabet in which the model's vocabulary is written, as the pre-tokenizer puts it out.
        as_is = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {b: as_is.pre_tokenize_str(bytes([b]).decode())[0][0] for b in range(0x80)}
        spare = [chr(c) for c in (*range(0xA1, 0xAD), *range(0xAE, 0x100))]
        self.alphabet |= {ord(c): c for c in spare}
        others = [b for b in range(0x80, 0x100) if b not in self.alphabet]
        first = 0x100 + sum(ord(self.alphabet[b]) >= 0x100 for b in range(0x80))
        self.alphabet |= {b: chr(first + i) for i, b in enumerate(others)}
        self.letters = {chr(b): c for b, c in self.alphabet.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed integers."""
        get = self.__getitem__
        out: list[bytes] = []
        for text in texts:
            if not self.by_chunk or self.odd_space(text) or any(x in text for x in self.special):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes())
            else:
                head, *rest = text.split(" ")
                out.append(self._ids(head) + b"".join(map(get, rest)))
        return out

    def __missing__(self, chunk: str) -> bytes:
        ids = self._ids(" " + chunk)
        if len(self) < REMEMBERED:
            self[chunk] = ids
        return ids

    def _ids(self, chunk: str) -> bytes:
        found = [t.id for piece in self.pieces(chunk) for t in self.tokenize(self._written(piece))]
        return array.array(self.code, found).tobytes()

    def _written(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():  # of these, only the space is written otherwise
            return piece.replace(" ", self.letters[" "])
        return "".join(map(self.letters.__getitem__, piece.encode().decode("latin-1")))


def _byte_level(parts: dict) -> bool:
    """True for a tokenizer whose text goes unchanged through the byte-level pattern to a BPE model without chance."""
    before, model = parts.get("pre_tokenizer") or {}, parts.get("model") or {}
    return not parts.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")


def _encoder(path: str, dtype: np.dtype) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path, dtype)
    return _ENCODERS[path]


def id_dtype(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def train_dictionary(docs: DataFrame, tokenizer: str, dtype: np.dtype, id_col: str, text_col: str, sample_docs: int, dictionary_bytes: int) -> bytes:
    """A zstandard dictionary from the id arrays of at most ``sample_docs`` documents, chosen by a hash of their id.

    Documents of over ``MOST_CHARS`` characters are not drawn, which bounds the sample. Too few samples
    for the trainer leave the samples themselves as a raw-content dictionary.
    """
    docs = docs.where(F.length(text_col).between(1, MOST_CHARS))
    picked = docs.select(F.md5(F.col(id_col).cast("string")).alias("key"), id_col).orderBy("key", id_col).limit(sample_docs)
    some = docs.join(picked.select(id_col).distinct(), id_col, "left_semi")
    texts = [r[0] for r in some.select(text_col).limit(sample_docs).collect()]
    samples = [x for x in _encoder(tokenizer, dtype).encode(sorted(texts)) if x]
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-dictionary_bytes:] or b"\0" * 8


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def write_shards(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, sample_docs: int = 1000, dictionary_bytes: int = 64 << 10, level: int = 3) -> None:
    """Encode every document and write shard files to ``path``, ascending in doc_id across the sorted shards.

    Shards hold about ``SHARD_BYTES`` of text each, so their number grows with the table, unless
    ``partitions`` says it. Each task writes one file under its partition's number and renames it into
    place, so a task that runs again after a lost executor leaves the same file. Null texts count as
    empty: their frame holds the end id alone. Repeated rows are documents of their own, ties in doc_id
    go by a hash of the text, which also cuts a hot id into shards; null ids come first.
    """
    spark = docs.sparkSession
    dtype = id_dtype(vocabulary)
    raw = train_dictionary(docs, tokenizer, dtype, id_col, text_col, sample_docs, dictionary_bytes)
    digest = hashlib.sha256(raw).digest()
    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{DICTIONARY_FILE}") as f:
        f.write(raw)
    shared = spark.sparkContext.broadcast(raw)
    end = np.array([end_id], dtype).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        dictionary = _dictionary(shared.value)
        dictionary.precompute_compress(level=level)
        press = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=False, write_dict_id=False)
        encoder, at = _encoder(tokenizer, dtype), 0
        ids, ends, counts, nulls = array.array("q"), array.array("Q"), array.array("I"), 0
        name = f"{base}/shard-{part:06d}{SUFFIX}"
        first = next(batches, None)
        if first is None:
            return
        with fs.open_output_stream(f"{name}.{attempt}.tmp") as f:
            f.write(MAGIC)
            for b in itertools.chain([first], batches):
                nulls += b.column(0).null_count
                at = _write_batch(f, b, encoder, press, end, dtype, ids, ends, counts, at)
            for column in (np.array(ids, "<i8"), np.array(ends, "<u8"), np.array(counts, "<u4")):
                f.write(column.tobytes())
            f.write(struct.pack(TRAILER, digest, dtype.itemsize, len(ids), nulls, at, sum(counts)))
        if fs.get_file_info(name).type != pafs.FileType.NotFound:  # an earlier attempt of this task left it
            fs.delete_file(name)
        fs.move(f"{name}.{attempt}.tmp", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)])], ["file", "documents"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions or -(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES) or 1
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    rows.select("doc_id", "text").mapInArrow(write, "file string, documents long").agg(F.sum("documents")).collect()


def _write_batch(f, batch: pa.RecordBatch, encoder: ChunkEncoder, press, end: bytes, dtype: np.dtype, ids: array.array, ends: array.array, counts: array.array, at: int) -> int:
    for doc_id, packed in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
        frame = press.compress(packed + end)
        f.write(frame)
        at += len(frame)
        ids.append(doc_id or 0)
        ends.append(at)
        counts.append(len(packed) // dtype.itemsize + 1)
    return at


class Shard:
    """A shard file in memory or behind a seekable file; checks the dictionary's hash."""

    def __init__(self, f, size: int, dictionary: bytes):
        self.f = f
        f.seek(size - struct.calcsize(TRAILER))
        digest, item, n, self.nulls, frames, self.total = struct.unpack(TRAILER, f.read(struct.calcsize(TRAILER)))
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.start, self.dtype = len(MAGIC), np.dtype(f"<u{item}")
        f.seek(self.start + frames)
        index = f.read(20 * n)
        self.ids = np.frombuffer(index, "<i8", n)
        self.ends = np.frombuffer(index, "<u8", n, 8 * n).astype(np.int64)
        self.counts = np.frombuffer(index, "<u4", n, 16 * n)
        self.open = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def read(self, k: int) -> np.ndarray:
        """Ids of the k-th document: one seek and one frame."""
        begin = int(self.ends[k - 1]) if k else 0
        self.f.seek(self.start + begin)
        return np.frombuffer(self.open.decompress(self.f.read(int(self.ends[k]) - begin)), self.dtype)


def read_document(path: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document, reading only indexes and its own frame; None if no shard has it."""
    fs, base = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{base}/{DICTIONARY_FILE}") as f:
        raw = f.read()
    for info in fs.get_file_info(pafs.FileSelector(base)):
        if info.path.endswith(SUFFIX):
            with fs.open_input_file(info.path) as f:
                shard = Shard(f, info.size, raw)
                k = shard.nulls + int(np.searchsorted(shard.ids[shard.nulls :], doc_id))
                if k < len(shard.ids) and shard.ids[k] == doc_id:
                    return shard.read(k)
    return None


def read_shards(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, frame_bytes)`` for every document of the shards at ``path``, decoded from them.

    ``start`` counts the ids of all documents before it: places inside a shard come from its index,
    the shards' own offsets from a running sum over one row for each shard.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path)
    fs, base = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{base}/{DICTIONARY_FILE}") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_buffer()
                shard = Shard(io.BytesIO(data), data.size, shared.value)
                n = len(shard.ids)
                counts = shard.counts.astype(np.int64)
                crc = np.fromiter((zlib.crc32(shard.read(k).astype("<u4").tobytes()) for k in range(n)), np.int64, n)
                ids = pa.array(shard.ids, mask=np.arange(n) < shard.nulls)
                yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * n), ids, pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(crc), pa.array(np.diff(shard.ends, prepend=0))], ["shard", "doc_id", "inside", "n_tokens", "ids_crc32", "frame_bytes"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, found = [x.rsplit("/", 1)[-1] for x in b.column(0).to_pylist()], []
            for name, size in zip(names, b.column(1).to_pylist(), strict=True):
                with pafs.FileSystem.from_uri(path)[0].open_input_file(f"{base}/{name}") as f:
                    f.seek(size - struct.calcsize(TRAILER))
                    found.append(struct.unpack(TRAILER, f.read(struct.calcsize(TRAILER)))[-1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.int64())], ["shard", "total"])

    docs = files.select("path", "content").mapInArrow(decode, "shard string, doc_id long, inside long, n_tokens long, ids_crc32 long, frame_bytes long")
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = files.select("path", "length").mapInArrow(totals, "shard string, total long").select("shard", F.coalesce(before, F.lit(0)).alias("offset"))
    return docs.join(offsets, "shard").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "frame_bytes")
