"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of a text. The
factors catch pairs that are toxic only together, which additive weights miss.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import ALNUM, BYTE_VALUE, LOWER, bounded_sample, mix64, prefix_sums, runs, slices, small_batches, spans_of, utf8_buffers
from loamlog.llm.language_id import held_out

BUCKET_BITS = 18


#: Besides each word its first bytes are terms, so that inflected forms share a stem.
STEMS = (4, 5, 6)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term buckets of each text end to end, and n + 1 offsets.

    Terms are lower-cased words and, of longer words, their stems of ``STEMS`` bytes.
    """
    raw, offsets = utf8_buffers(column)
    low = LOWER[raw]
    starts, ends = runs(ALNUM[low], offsets)
    sums_to = prefix_sums(BYTE_VALUE[low])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    kinds = [(owner, spans_of(sums_to, starts, ends))]
    for n in STEMS:
        at = np.flatnonzero(ends - starts > n)
        kinds.append((owner[at], mix64(spans_of(sums_to, starts[at], starts[at] + n) + np.uint64(n))))
    bits = np.uint64(BUCKET_BITS)
    key = np.sort(np.concatenate([(o.astype(np.uint64) << bits) | (h >> np.uint64(64 - BUCKET_BITS)) for o, h in kinds]))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    n = np.arange(len(offsets), dtype=np.uint64) << bits
    return (key & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64), np.searchsorted(key, n)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row sums of each segment, 0 where it is empty."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


@dataclass
class FactorizationMachine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, index: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = self.factor[index]
        s = sums(v, offsets)
        pairs = 0.5 * (s * s - sums(v * v, offsets)).sum(axis=1)
        return self.bias + sums(self.weight[index], offsets) + pairs, v, s

    def score(self, index: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, offsets)[0].astype(np.float64), -35, 35)))


def informative(docs: list[np.ndarray], labels: np.ndarray, size: int, least: int, z: float) -> np.ndarray:
    """Terms with enough documents whose share differs between the classes (two-proportion z)."""
    toxic = labels > 0
    n1, n0 = toxic.sum(), (~toxic).sum()
    c1 = np.bincount(np.concatenate([d for d, t in zip(docs, toxic, strict=True) if t]), minlength=size)
    c0 = np.bincount(np.concatenate([d for d, t in zip(docs, toxic, strict=True) if not t]), minlength=size)
    share = (c1 + c0) / (n1 + n0)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    return (c1 + c0 >= least) & (np.abs(c1 / n1 - c0 / n0) >= z * error)


def train(
    docs: list[np.ndarray], labels: np.ndarray, factors: int = 8, epochs: int = 16, batch: int = 64,
    rate: float = 0.1, sparsity: float = 2e-4, least: int = 5, z: float = 3.0, seed: int = 3,
) -> FactorizationMachine:
    """AdaGrad over mini-batches with logistic loss; soft thresholds keep the weights and
    factors of uninformative terms at zero.

    Terms that fewer than ``least`` of the sampled documents hold, or whose share differs by
    less than ``z`` standard errors between the classes, stay at zero: what is learned from
    a term met once or twice says nothing about other texts.
    """
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    fm = FactorizationMachine(0.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    if len(docs) == 0 or labels.min() == labels.max():
        fm.bias = 0.0 if len(docs) == 0 else (2.0 if labels[0] else -2.0)
        return fm
    met = informative(docs, labels, size, least, z)
    docs = [d[met[d]] for d in docs]
    start = rng.normal(0, 0.05, (int(met.sum()), factors)).astype(np.float32)
    fm.factor[met] = start
    share = float(labels.mean())
    fm.bias = float(np.log(share / (1 - share)))
    gw, gv = np.full(size, 1e-4, np.float32), np.full((size, factors), 1e-4, np.float32)

    def shrink(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.sign(x) * np.maximum(np.abs(x) - by, 0)

    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), batch):
            take = order[a : a + batch]
            offsets = np.concatenate([[0], np.cumsum([len(docs[i]) for i in take])])
            index = np.concatenate([docs[i] for i in take])
            z, v, s = fm.raw(index, offsets)
            error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[take]).astype(np.float32)
            fm.bias -= rate * float(error.mean())
            if len(index) == 0:
                continue
            each = np.repeat(error, np.diff(offsets))
            own, inverse = np.unique(index, return_inverse=True)
            step = each[:, None] * (np.repeat(s, np.diff(offsets), axis=0) - v)
            dw = np.bincount(inverse, each, len(own)).astype(np.float32) / len(take)
            dv = np.stack([np.bincount(inverse, step[:, k], len(own)) for k in range(factors)], axis=1).astype(np.float32) / len(take)
            gw[own] += dw * dw
            gv[own] += dv * dv
            rw, rv = rate / np.sqrt(gw[own]), rate / np.sqrt(gv[own])
            fm.weight[own] = shrink(fm.weight[own] - rw * dw, rw * sparsity)
            fm.factor[own] = shrink(fm.factor[own] - rv * dv / 4, rv * sparsity / 4)
    return fm


def sample_labels(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms and labels of at most ``per_class`` documents of each class, the ones of
    smallest id hash. A document with several labels counts as toxic if one says so."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    chosen = bounded_sample(known.select("y", F.xxhash64("doc_id").alias("h")), "y", "h", per_class)
    if not chosen:
        return [], np.zeros(0, np.float32)
    # at most 2 * per_class narrow rows: bounded by a parameter, so they can be broadcast
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "y int, k long"))
    rows = docs.select("doc_id", "text").join(wanted, F.xxhash64(F.col("doc_id").cast(known.schema["doc_id"].dataType)) == F.col("k")).select("y", "text", F.xxhash64("doc_id", "text").alias("h"))

    def extract(batches):
        for batch in batches:
            for part in slices(batch, 1):
                index, at = terms(part.column(1))
                lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(index, pa.int64())).cast(pa.list_(pa.int64()))
                yield pa.record_batch([part.column(0), lists, part.column(2)], names=["y", "terms", "h"])

    got = sorted(rows.mapInArrow(extract, "y int, terms array<long>, h long").collect(), key=lambda r: (r["h"], r["y"]))
    return [np.array(r["terms"], np.int64) for r in got], np.array([r["y"] for r in got], np.float32)


def score_texts(docs: DataFrame, labelled: DataFrame, labels: DataFrame, per_class: int = 3000) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``score`` (0 to 1) from the terms of the whole text; it
    replaces a column of that name, other columns pass through.

    ``labelled`` are the documents from which labels may be learned. Null and empty texts
    have no terms and get the sigmoid of the bias. Without labels the score is 0.5.
    """
    small_batches(docs.sparkSession)
    fm = docs.sparkSession.sparkContext.broadcast(train(*sample_labels(labelled, labels, per_class)))
    docs = docs.drop("score")
    at = docs.columns.index("text")
    names = [*docs.columns, "score"]

    def predict(batches):
        for batch in batches:
            for part in slices(batch, at):
                yield pa.record_batch([*part.columns, pa.array(fm.value.score(*terms(part.column(at))), pa.float64())], names=names)

    return docs.mapInArrow(predict, docs.withColumn("score", F.lit(0.0)).schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) of every document.

    Labels of held-out documents are left out before anything is counted or chosen, so they
    have no part even in which others are learned from.
    """
    out_of = held_out(F.col("doc_id"), 3, 1)
    scored = score_texts(docs.select("doc_id", "text"), docs.where(~out_of), labels.where(~out_of))
    return scored.select("doc_id", out_of.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
