"""Token ids in compressed binary files with a shared zstandard dictionary.

A file holds one zstandard frame per document, compressed on its own with a dictionary that
was trained on serialized id arrays, then an offset index. Any document is read by one seek.

Layout, all little-endian: magic ``LLTK0001``; 32 bytes SHA-256 of the dictionary; 1 byte
width of an id (2 or 4); the frames; the index, per document ``<q q I I B`` (doc_id, offset,
compressed bytes, ids, 1 where doc_id is null); ``<q q`` (offset of the index, documents).
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.llm.common import filesystem, fresh_path, resident, slices, small_batches
from loamlog.llm.words import Encoder, batches_of

MAGIC = b"LLTK0001"
ENTRY = struct.Struct("<qqIIB")
TAIL = struct.Struct("<qq")


def encoder(path: str) -> Encoder:
    return resident("token files", path, lambda: load_encoder(path))


def load_encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    by_word = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
    return Encoder(Tokenizer.from_file(path), "\u0120", by_word)


def encode_texts(path: str, texts: list[str], end_id: int) -> list[np.ndarray]:
    """Ids of each text followed by ``end_id``, from whole texts."""
    held = encoder(path)
    end = np.array([end_id], held.dtype)
    return [np.concatenate([ids, end]) for ids in held.encode(texts)]


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, sample_docs: int, sample_chars: int, size: int) -> bytes:
    """A dictionary from at most ``sample_docs`` documents, the ones of smallest id hash, and of
    each one piece of at most ``sample_chars`` characters from a place that the hash gives: a
    bounded sample, as the dictionary only sets how well files compress. Too few samples to
    train on give an empty dictionary."""
    keyed = docs.withColumn("h", F.xxhash64("doc_id"))
    lowest = keyed.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    text = F.coalesce("text", F.lit(""))
    start = F.pmod(F.col("h"), F.greatest(F.length(text) - sample_chars + 1, F.lit(1))) + 1
    rows = keyed.where(F.col("h") <= F.lit(lowest)).select("h", F.substr(text, start.cast("int"), F.lit(sample_chars)).alias("t")).limit(sample_docs).collect()
    rows.sort()
    samples = [x.tobytes() for x in encode_texts(tokenizer_path, [r["t"] for r in rows], end_id)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=True)


def file_blocks(rows, dictionary: bytes, dtype, level: int, index: list, total: list):
    """Bytes of one file for (doc_id or None, ids); fills ``index`` and ``total`` [ids]."""
    press = compressor(dictionary, level)
    head = MAGIC + hashlib.sha256(dictionary).digest() + bytes([dtype.itemsize])
    at = len(head)
    yield head
    entries = bytearray()
    n = 0
    for doc_id, ids in rows:
        frame = press.compress(ids.tobytes())
        entries += ENTRY.pack(doc_id or 0, at, len(frame), len(ids), doc_id is None)
        at += len(frame)
        n += 1
        total[0] += len(ids)
        yield frame
    index.append(n)
    yield bytes(entries)
    yield TAIL.pack(at, n)


class TokenFile:
    """Reads one file; ``document(i)`` fetches a single document by its offset."""

    def __init__(self, source, dictionary: bytes):
        self.source = source
        size = source.size()
        source.seek(0)
        head = source.read(len(MAGIC) + 33)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        if head[len(MAGIC) : len(MAGIC) + 32] != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.dtype = np.dtype(f"<u{head[-1]}")
        source.seek(size - TAIL.size)
        at, n = TAIL.unpack(source.read(TAIL.size))
        source.seek(at)
        self.index = list(ENTRY.iter_unpack(source.read(n * ENTRY.size)))
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.press = zstandard.ZstdDecompressor(dict_data=held)

    def __len__(self) -> int:
        return len(self.index)

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        doc_id, at, length, n, null = self.index[i]
        self.source.seek(at)
        ids = np.frombuffer(self.press.decompress(self.source.read(length)), self.dtype)
        if len(ids) != n:
            raise ValueError("a document's length differs from the index")
        return None if null else doc_id, ids


def write_token_files(
    docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 0, level: int = 3, sample_docs: int = 512,
    sample_chars: int = 4000, dictionary_bytes: int = 32_768,
) -> tuple[list[tuple[str, int, int]], bytes]:
    """Writes ``docs`` (doc_id, text) in ascending doc_id order (ties by text, null ids
    first) under ``out``: (file, documents, ids) per file in order, and the dictionary.

    A null text is empty. Every attempt of a task writes a file of its own name; only the
    names that tasks report are listed, so lost executors leave no wrong file behind. The
    driver holds one row per file.
    """
    small_batches(docs.sparkSession)
    dictionary = train_dictionary(docs, tokenizer_path, end_id, sample_docs, sample_chars, dictionary_bytes)
    dtype = encoder(tokenizer_path).dtype

    def encoded(batches):
        for batch in (part for whole in batches for part in slices(whole, 1, model=True)):
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batches_of(texts):
                yield from zip(ids[a:b], encode_texts(tokenizer_path, texts[a:b], end_id), strict=True)

    def write(batches):
        from pyspark import TaskContext

        from loamlog.llm.common import write_atomically

        part = TaskContext.get().partitionId()
        index, total = [], [0]
        name = f"{out}/ids-{part:06d}-{uuid.uuid4().hex}.bin"
        write_atomically(name, file_blocks(encoded(batches), dictionary, dtype, level, index, total))
        yield pa.record_batch([pa.array([x]) for x in (part, name, index[0], total[0])], names=["part", "file", "docs", "ids"])

    # ranges are laid by sampled keys, which the driver gets: the first characters of a text are
    # enough there, as whole texts sort the rows of a range
    keyed = docs.select(F.col("doc_id").cast("long"), "text")
    ordered = keyed.repartitionByRange("doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(write, "part long, file string, docs long, ids long").collect()
    return [(r["file"], r["docs"], r["ids"]) for r in sorted(rows, key=lambda r: r["part"]) if r["docs"]], dictionary


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]], dictionary: bytes) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is of the ids as
    little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    bases = np.cumsum([0, *(n for _, _, n in files)])
    listed = spark.createDataFrame([(f, int(b)) for (f, _, _), b in zip(files, bases, strict=False)], "file string, base long")

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inner = filesystem(name)
                with system.open_input_file(inner) as source:
                    held, rows = TokenFile(source, dictionary), []
                    for i in range(len(held)):
                        doc_id, ids = held.document(i)
                        rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                        if len(rows) == 10_000 or i + 1 == len(held):
                            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []

    return listed.repartition(len(files)).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Encodes, writes, reads back: see the two functions above."""
    spark = docs.sparkSession
    files, dictionary = write_token_files(docs, fresh_path(spark, "token-files"), tokenizer_path, end_id)
    return read_token_files(spark, files, dictionary)
