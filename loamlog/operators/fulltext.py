"""A full-text index that outlives a query: posting tables in segments, bucketed by token.

A segment holds the distinct tokens of a set of documents, one folder a bucket of tokens, sorted
by token. Documents that change are written as a later segment, and a tombstone says that
what earlier segments hold of them is void. A search reads the buckets of its own tokens only,
of each segment, and leaves out what a later tombstone voids. Merging writes the live postings
of all segments as one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.functions import text as T
from loamlog.operators.retrieval import asked_matrix, asked_tokens, few, matrix_topk, ranked
from loamlog.sources.store import Store

#: Buckets of tokens: folders that a segment has at most, and that a search chooses among.
BUCKETS = 256
#: Parts of a bucket by documents.
SLOTS = 16
POSTINGS, DEAD = "token string, doc_id long, bucket int", "doc_id long"


class TextIndex:
    """Segments of postings in a store. Each commit is a snapshot: searches see all of it or none."""

    def __init__(self, store: Store, buckets: int = BUCKETS):
        self.store, self.buckets = store, int(store.latest()[1].get("buckets", buckets))

    def bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _segment(self, docs: DataFrame) -> str:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("token"))
        return self._write(rows.withColumn("bucket", self.bucket(F.col("token"))))

    def _write(self, rows: DataFrame) -> str:
        """A bucket is cut by documents, so a token that most of them hold is too, and its files
        are sorted by token. Ranges would be evener, but a sample of them makes all rows twice."""
        dealt = rows.select("token", "doc_id", "bucket").repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)))
        return self.store.write(dealt.sortWithinPartitions("bucket", "token", "doc_id"), "postings", ["bucket"])

    def upsert(self, docs: DataFrame, gone: DataFrame | None = None) -> int:
        """Adds documents (doc_id, text), in place of what is known of their ids; ``gone``
        (doc_id) are taken away. A null text has no tokens; null ids are left out."""
        docs = docs.where("doc_id IS NOT NULL")
        first = not self.store.latest()[1].get("segments")
        name = self._segment(docs)
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        dead = None if first else self.store.write((ids if gone is None else ids.unionAll(gone.select(F.col("doc_id").cast("long")))).distinct(), "dead")

        def change(state: dict) -> dict:
            turn = state.get("turn", 0) + 1
            segments = [*state.get("segments", []), {"folder": name, "turn": turn}]
            marks = [*state.get("dead", []), *([{"folder": dead, "turn": turn}] if dead else [])]
            return {"turn": turn, "buckets": self.buckets, "segments": segments, "dead": marks}

        return self.store.update(change)

    def postings(self, buckets: list[int] | None = None, state: dict | None = None, of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Live (token, doc_id) of the given buckets (None: all), or what ``of`` makes of a
        segment's rows, by doc_id, before the void ones go."""
        state = self.store.latest()[1] if state is None else state
        live = None
        for segment in state.get("segments", []):
            rows = self.store.read(segment["folder"], POSTINGS)
            rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
            rows = rows.select("token", "doc_id", "bucket") if of is None else of(rows)
            later = [d["folder"] for d in state.get("dead", []) if d["turn"] > segment["turn"]]
            if later:
                void = self.store.spark.read.schema(DEAD).parquet(*[f"{self.store.root}/{f}" for f in later]).distinct()
                rows = rows.join(void, "doc_id", "left_anti")
            live = rows if live is None else live.unionByName(rows)  # an anti join puts its key first
        return self.store.spark.createDataFrame([], POSTINGS) if live is None else live

    def merge(self) -> int:
        """All segments as one without what is void; an upsert that comes meanwhile stays."""
        base, state = self.store.latest()
        name = self._write(self.postings(state=state))
        upto, old = state.get("turn", 0), {s["folder"] for s in state.get("segments", [])}

        def change(now: dict) -> dict | None:
            if not old <= {s["folder"] for s in now["segments"]}:
                return None  # another merge was first
            segments = [{"folder": name, "turn": upto}, *[s for s in now["segments"] if s["folder"] not in old]]
            return now | {"segments": segments, "dead": [d for d in now["dead"] if d["turn"] > upto]}

        return self.store.update(change)

    def asked(self, queries: DataFrame) -> tuple[DataFrame, list[int]]:
        """Tokens of each query with their repeats, and the buckets they lie in."""
        rows = asked_tokens(queries)
        rows = rows.withColumn("bucket", self.bucket(F.col("token")))
        return rows, sorted(r[0] for r in rows.select("bucket").distinct().collect())

    def topk(self, queries: DataFrame, k: int) -> DataFrame:
        """item_id, doc_id, score, rank: as ``retrieval.lexical_topk`` over the documents.

        A few queries, counted, are one matrix: postings of their tokens are gathered by
        document, and each task keeps the best; pairs of queries and documents are not exchanged.
        """
        rows, buckets = self.asked(queries)
        state = self.store.latest()[1]
        if not state.get("segments") or not few(rows):
            met = rows.join(self.postings(buckets, state), ["bucket", "token"])
            hits = met.groupBy("item_id", "size", "doc_id").agg(F.sum("times").alias("matched"))
            return ranked(hits.select("item_id", "doc_id", F.round(F.col("matched") / F.col("size"), 6).alias("score")), k)
        token, items, weights, sizes = asked_matrix(rows)
        if not token:
            return ranked(rows.select("item_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score")), k)
        places = F.broadcast(self.store.spark.createDataFrame(list(token.items()), "token string, place int"))
        held = self.postings(buckets, state, lambda p: p.join(places, "token").groupBy("doc_id").agg(F.collect_list("place").alias("text")))

        def features(docs: list[list[int]]) -> np.ndarray:
            out = np.zeros((len(docs), len(token)))
            for i, places in enumerate(docs):
                out[i, places] = 1
            return out

        return matrix_topk(held, features, weights, items, k, sizes)
