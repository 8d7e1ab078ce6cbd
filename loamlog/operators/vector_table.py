"""A vector table that outlives a query, laid out so that a reader can skip most of it.

Unit vectors lie in cells of their nearest pivot, a folder each, and the snapshot keeps the
pivots and how far a cell's vectors lie from its pivot at least and at most. By the triangle
inequality a query's distance to a pivot bounds its distance to all vectors of the cell from
below. A search first reads the cells nearest to each query until they hold enough vectors,
which bounds the distance of the k-th neighbour from above, and then only those cells that
can hold a nearer one. The result is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlog.operators.components import checkpointed
from loamlog.sources.store import Store

#: Vectors that a cell should hold, pivots at most, and sampled vectors a pivot.
CELL, PIVOTS, SAMPLED = 50_000, 1024, 8
#: Queries of one search; what goes to the tasks is their vectors.
MOST_QUERIES = 4096
#: Distances within this are taken as equal: rounding of doubles.
SLACK = 1e-9
#: Scores are given to six places, so those this close may come out equal.
ROUNDED = 2e-6
SCHEMA = "vec_id long, vector array<double>, model string, digest string, unit binary, cell int"


def vector_digest(vector: Column) -> Column:
    return F.concat(F.lit("sha-256:"), F.sha2(F.to_json(vector), 256))


def records(vectors: DataFrame, model: str) -> DataFrame:
    """(vec_id, embedding) as records of a model: the vector in doubles and its digest."""
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.select("vec_id", "vector", F.lit(model).alias("model"), vector_digest(F.col("vector")).alias("digest"))


def unit_rows(column: pa.Array, size: int) -> np.ndarray:
    """Unit vectors of lists that all have ``size`` entries; zero vectors stay zero."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norms == 0, 1, norms)[:, None]


class VectorTable:
    """Records of one model and size in a store."""

    def __init__(self, store: Store):
        self.store = store

    def usable(self, rows: DataFrame, model: str, size: int) -> DataFrame:
        """Records of another model or size, with a null or infinite entry, or whose vector is
        not what its digest says are ignored."""
        finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        return rows.where((F.col("model") == model) & (F.size("vector") == size) & finite & (F.col("digest") == vector_digest(F.col("vector"))))

    def build(self, rows: DataFrame, model: str, size: int, cells: int | None = None) -> int:
        """Writes the usable records of (vec_id, vector, model, digest). The number of cells
        follows the number of records; pivots come from a bounded sample."""
        good = checkpointed(self.usable(rows, model, size))
        n = good.count()
        cells = cells or min(PIVOTS, max(1, math.ceil(n / CELL)))
        chance = min(1.0, 2 * SAMPLED * cells / max(n, 1))
        drawn = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(chance * (1 << 30))).select("vec_id", "vector").orderBy(F.xxhash64("vec_id")).limit(SAMPLED * cells).collect()
        x = np.array([r["vector"] for r in sorted(drawn)], np.float64).reshape(-1, size)
        x = x / np.where((s := np.sqrt((x * x).sum(axis=1))) == 0, 1, s)[:, None]
        chosen = [0] if len(x) else []
        far = np.sqrt(np.maximum(((x - x[0]) ** 2).sum(axis=1), 0)) if len(x) else x
        while chosen and len(chosen) < min(cells, len(x)) and far.max() > SLACK:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(axis=1)))
        pivots = x[chosen] if chosen else np.zeros((1, size))
        held = self.store.spark.sparkContext.broadcast(pivots)

        def place(batches):
            for batch in batches:
                units = unit_rows(batch.column(1), size)
                away = np.sqrt(np.maximum((units * units).sum(axis=1)[:, None] + (held.value**2).sum(axis=1) - 2 * units @ held.value.T, 0))
                own = away.argmin(axis=1)
                near = np.sqrt(((units - held.value[own]) ** 2).sum(axis=1))
                yield pa.record_batch(
                    [*batch.columns, pa.array([u.tobytes() for u in units], pa.binary()), pa.array(own.astype(np.int32)), pa.array(near)],
                    names=["vec_id", "vector", "model", "digest", "unit", "cell", "away"],
                )

        placed = checkpointed(good.select("vec_id", "vector", "model", "digest").mapInArrow(place, SCHEMA + ", away double"))
        reach = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).collect()
        name = self.store.write(placed.drop("away").repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(4))).sortWithinPartitions("cell", "vec_id"), "vectors", ["cell"])
        state = {"model": model, "size": size, "folder": name, "pivots": pivots.tolist(), "cells": {str(r["cell"]): [r["n"], r["near"], r["far"]] for r in reach}}
        return self.store.update(lambda _: state)

    def _read(self, state: dict, cells: list[int]) -> DataFrame:
        return self.store.read(state["folder"], SCHEMA).where(F.col("cell").isin(cells))

    def nearest(self, queries: DataFrame, k: int) -> tuple[DataFrame, dict]:
        """query_id, vec_id, score, rank: the ``k`` vectors of largest cosine, then smallest id,
        for each (query_id, vector); a vector is not its own neighbour. And what was read.

        Queries of another size are left out, a zero query scores 0 with all. A query set
        of more than MOST_QUERIES is refused: it is to be cut into searches.
        """
        state = self.store.latest()[1]
        size, cells = state["size"], {int(c): v for c, v in state["cells"].items()}
        rows = queries.where(F.size("vector") == size).select(F.col("query_id").cast("long"), "vector").limit(MOST_QUERIES + 1).collect()
        if len(rows) > MOST_QUERIES:
            raise ValueError(f"more than {MOST_QUERIES} queries at once")
        names = np.array([r["query_id"] for r in rows], np.int64)
        asked = unit_rows(pa.array([list(r["vector"]) for r in rows], pa.list_(pa.float64())), size) if rows else np.zeros((0, size))
        pivots, order = np.array(state["pivots"], np.float64), np.array(sorted(cells), np.int64)
        apart = np.sqrt(np.maximum(((asked[:, None, :] - pivots[order][None, :, :]) ** 2).sum(axis=2), 0))
        counts, near, far = (np.array([cells[c][i] for c in order.tolist()], np.float64) for i in range(3))
        least = np.maximum(0, np.maximum(apart - far, near - apart))
        # first the nearest cells that together hold k vectors besides the query itself
        by = np.argsort(apart, axis=1)
        needed = (np.cumsum(counts[by], axis=1) - counts[by]) < k + 1
        first = np.zeros_like(apart, bool)
        np.put_along_axis(first, by, needed, axis=1)
        found = checkpointed(self._scores(state, names, asked, order, first, k))
        worst = {r["query_id"]: r["worst"] for r in found.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
        bound = np.array([math.sqrt(max(0.0, 2 - 2 * (worst[q] - ROUNDED))) if q in worst else math.inf for q in names.tolist()])
        zero = ~asked.any(axis=1) if len(asked) else np.zeros(0, bool)
        rest = ~first & ((least <= bound[:, None] + SLACK) | zero[:, None])
        if rest.any():
            found = found.unionAll(self._scores(state, names, asked, order, rest, k))
        read = order[(first | rest).any(axis=0)].tolist()
        return self._ranked(found, k), {"cells": len(order), "read": len(read), "pairs": int((first | rest).sum()), "of": int(first.size)}

    def _scores(self, state: dict, names: np.ndarray, asked: np.ndarray, order: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
        """For each query the best ``k`` of each task's part of the cells it wants."""
        cells = order[wanted.any(axis=0)].tolist()
        who = {c: np.flatnonzero(wanted[:, i]) for i, c in enumerate(order.tolist()) if wanted[:, i].any()}
        held = self.store.spark.sparkContext.broadcast((names, asked, who))

        def run(batches):
            ids, units, queries = held.value
            for batch in batches:
                own = batch.column(2).to_numpy()
                for c in np.unique(own).tolist():
                    part = batch.filter(pa.array(own == c))
                    x = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float64).reshape(part.num_rows, -1)
                    vec, q = part.column(0).to_numpy(), queries[c]
                    scores = units[q] @ x.T
                    scores[ids[q][:, None] == vec[None, :]] = -np.inf
                    # the k best of the cell, with all that rounding could make equal to the last of them
                    edge = np.partition(scores, -k, axis=1)[:, -k][:, None] if scores.shape[1] > k else np.full((len(q), 1), -np.inf)
                    i, j = np.nonzero((scores >= edge - ROUNDED) & (scores > -np.inf))
                    yield pa.record_batch([pa.array(ids[q[i]]), pa.array(vec[j]), pa.array(scores[i, j])], names=["query_id", "vec_id", "score"])

        rows = self._read(state, cells).select("vec_id", "unit", "cell")
        return self._ranked(rows.mapInArrow(run, "query_id long, vec_id long, score double"), k).select("query_id", "vec_id", "score")

    def _ranked(self, scored: DataFrame, k: int) -> DataFrame:
        rounded = scored.withColumn("score", F.round("score", 6))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return rounded.withColumn("rank", rank).where(F.col("rank") <= k)
