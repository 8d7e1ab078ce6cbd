"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed, and normaliser, metaspace marker, unigram scores or merges
and byte fallback are rebuilt as a tokenizer. Batches are encoded by the library's threads.
The ids are compared with those of the SentencePiece library, and decoded again.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import resident, slices, small_batches
from loamlog.llm.words import Encoder, batches_of

#: Fixed values of the model format: the marker of a space, piece types and model types.
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def parse_model(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def merges_of(scores: dict[str, float]) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, best piece first."""
    out = []
    for rank, piece in enumerate(sorted(scores, key=lambda p: -scores[p])):
        for i in range(1, len(piece)):
            if piece[:i] in scores and piece[i:] in scores:
                out.append((rank, i, piece[:i], piece[i:]))
    return [(a, b) for _, _, a, b in sorted(out)]


def build_tokenizer(model):
    """The tokenizer that a SentencePiece model describes."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces, spec, trainer = model.pieces, model.normalizer_spec, model.trainer_spec
    fallback = bool(trainer.byte_fallback)
    unknown = next((i for i, p in enumerate(pieces) if p.type == UNKNOWN), None)
    if trainer.model_type == UNIGRAM:
        inner = models.Unigram([(p.piece, p.score) for p in pieces], unknown, fallback)
    elif trainer.model_type == BPE:
        vocabulary = {p.piece: i for i, p in enumerate(pieces)}
        scores = {p.piece: p.score for p in pieces if p.type in (NORMAL, USER_DEFINED)}
        inner = models.BPE(
            vocabulary, merges_of(scores), fuse_unk=True, byte_fallback=fallback,
            unk_token=None if unknown is None else pieces[unknown].piece,
        )
    else:
        raise ValueError(f"model type {trainer.model_type} is not supported")
    out = Tokenizer(inner)
    steps: list = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if spec.escape_whitespaces else " "))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARKER))
    out.normalizer = normalizers.Sequence(steps)
    if words_apart(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}*[^{MARKER}]+|{MARKER}+"), "isolated")
    user = [p.piece for p in pieces if p.type == USER_DEFINED]
    if user:
        out.add_tokens([AddedToken(p, normalized=False) for p in user])
    parts: list = [decoders.Replace(MARKER, " ")]
    if fallback:
        parts.append(decoders.ByteFallback())
    parts.append(decoders.Fuse())
    if spec.add_dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(parts)
    return out


def words_apart(model) -> bool:
    """Whether no piece holds the marker after another character, so that words never join."""
    return bool(model.normalizer_spec.escape_whitespaces) and not any(
        MARKER in p.piece.lstrip(MARKER) for p in model.pieces if p.type in (NORMAL, USER_DEFINED)
    )


class Backend:
    def __init__(self, path: str, threads: int):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece

        model = parse_model(path)
        spec = model.normalizer_spec
        self.tokenizer = build_tokenizer(model)
        plain = words_apart(model) and bool(spec.add_dummy_prefix) and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads = threads
        self.encoder = Encoder(self.tokenizer, MARKER, plain, first_led=True, reference=self.reference_ids, words=250_000)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        return self.encoder.encode_checked(texts)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def reference_ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=self.threads)


def backend(path: str, threads: int) -> Backend:
    return resident("sentencepiece", (path, threads), lambda: Backend(path, threads))


def encoded(batches, at: int, model_path: str, threads: int):
    """(rows of a batch, ids of each, parity of each, round trip of each)."""
    held = backend(model_path, threads)
    for batch in (part for whole in batches for part in slices(whole, at, model=True)):
        texts = [t or "" for t in batch.column(at).to_pylist()]
        for a, b in batches_of(texts):
            part = texts[a:b]
            found, parity = held.encode(part)
            back = [x == y for x, y in zip(held.decode(found), part, strict=True)]
            yield batch.slice(a, b - a), found, parity, back


def encode_column(docs: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """``docs`` with ``ids`` array<int>, ``parity`` and ``round_trip``.

    ids are those of the whole text (null: empty text, no ids). Parity is verified on all that
    goes through the tokenizer: where no piece joins words, every word once, else every text.
    Where the SentencePiece library disagrees, ``parity`` is false and its ids are given: it
    breaks ties between equal scores by place, the rebuilt tokenizer by rank.
    ``round_trip`` tells whether decoding gives the text back. Extra columns pass through.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    names = [c for c in docs.columns if c not in ("ids", "parity", "round_trip")]
    places = [docs.columns.index(c) for c in names]
    schema = docs.select(*names).withColumns({"ids": F.array(F.lit(0)), "parity": F.lit(True), "round_trip": F.lit(True)}).schema

    def run(batches):
        for rows, found, parity, back in encoded(batches, at, model_path, threads):
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found).astype(np.int32), pa.int32()))
            yield pa.record_batch([*(rows.column(p) for p in places), lists, pa.array(parity), pa.array(back)], names=[*names, "ids", "parity", "round_trip"])

    return docs.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """Per document: doc_id, n_tokens long, ids_crc32 long (ids as little-endian unsigned
    32-bit integers), parity boolean, round_trip boolean. The ids stay in the tasks, and a
    task needs one worker with the model."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean"

    def digest(batches):
        for rows, found, parity, back in encoded(batches, 1, model_path, threads):
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in found]
            yield pa.record_batch(
                [rows.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array(crc, pa.int64()), pa.array(parity), pa.array(back)],
                names=["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, schema)
