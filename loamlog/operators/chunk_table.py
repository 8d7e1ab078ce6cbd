"""The chunk table: chunks of the log, kept up to date slice by slice.

Events are numbered as they are appended, so new events fall into new slices of numbers. A
snapshot keeps, for each slice, order-free sums of all that its chunks depend on, and the folder
that holds them. A rebuild sums the log again, one pass without a shuffle of rows, and makes the
chunks of those slices anew whose sums differ: all of them in one folder, sorted by slice, so the
number of files follows the rows and not the slices. Other folders stay as they are; a folder
of which less than half is still named is written anew with the next rebuild.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.functions import text as T
from loamlog.sources.store import Conflict, Store, sums

#: Events of a slice.
WIDTH = 1 << 20
KINDS = {"Claim": "claim", "AcceptanceDecision": "decision", "Observation": "summary", "EvidenceArtifact": "evidence_excerpt"}
SCHEMA = (
    "chunk_id string, chunk_kind string, event_id string, n long, zone string, lifecycle string, authority string, recorded timestamp, text string, text_digest string, "
    "sources array<string>, status string, slice long"
)


def chunk_rows(log: DataFrame, erasures: DataFrame) -> DataFrame:
    """A chunk per claim, decision, observation and evidence: its content id, text and digest,
    the events it rests on (itself and what it was derived from), and whether it is erased.

    log (event_id, n, event_type, zone, lifecycle, authority, recorded, statement, decision,
    subject, target_id), erasures (target_id). Ids depend on the event alone, so they stay when
    other events come or go. A chunk counts as erased with any of the events it rests on.
    """
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    body = F.coalesce("statement", F.concat(F.lit("Decision: "), F.col("decision")), F.concat(F.lit("Evidence of "), F.col("subject")))
    gone = erasures.select(F.col("target_id").alias("gone")).distinct()
    rows = log.where(F.col("event_type").isin(*KINDS)).withColumns({"text": body, "chunk_kind": kinds[F.col("event_type")]})
    rows = rows.join(gone, F.col("event_id") == F.col("gone"), "left").withColumnRenamed("gone", "own_gone")
    rows = rows.join(gone, F.col("target_id") == F.col("gone"), "left")
    digest = F.concat(F.lit("sha-256:"), F.sha2("text", 256))
    sources = F.array_sort(F.array_distinct(F.array_compact(F.array("event_id", "target_id"))))
    return rows.select(
        T.content_id("chk_", 40, F.array_join(sources, ","), F.col("chunk_kind"), F.lit("0"), digest).alias("chunk_id"), "chunk_kind", "event_id", "n", "zone", "lifecycle", "authority", "recorded", "text",
        digest.alias("text_digest"), sources.alias("sources"), F.when(F.col("own_gone").isNotNull() | F.col("gone").isNotNull(), "projection_deleted").otherwise("active").alias("status"),
    )


class ChunkTable:
    """The chunks of a log in a store, by slices of event numbers."""

    def __init__(self, store: Store, width: int = WIDTH):
        self.store, self.width = store, int(store.latest()[1].get("width", width))

    def slice(self, n: Column) -> Column:
        return F.floor(n / self.width).cast("long")

    def _sums(self, log: DataFrame, erasures: DataFrame) -> dict[int, str]:
        """What each slice's chunks depend on: its events, and the erasures of them and of
        what they were derived from. One text a slice comes to the driver."""
        fields = ["event_id", "event_type", "zone", "lifecycle", "authority", "recorded", "statement", "decision", "subject", "target_id"]
        gone = erasures.select(F.col("target_id").alias("gone")).distinct()
        own = log.join(gone, F.col("event_id") == F.col("gone"), "left").withColumnRenamed("gone", "own_gone").join(gone, F.col("target_id") == F.col("gone"), "left")
        return {r[0]: r[1] for r in own.groupBy(self.slice(F.col("n")).alias("slice")).agg(sums(*fields, "own_gone", "gone")).collect()}

    def rebuild(self, log: DataFrame, erasures: DataFrame) -> dict:
        """Brings the table up to the log; how many slices were written, dropped and kept.

        Chunks whose event is no longer in the log, or has another content, stay as ``stale``.
        Two rebuilds at once: the second to commit starts again.
        """
        now = self._sums(log, erasures)

        def change_of(state: dict) -> tuple[list[int], dict]:
            held, sizes = state.get("slices", {}), state.get("folders", {})
            due = {s for s in now if held.get(str(s), {}).get("sums") != now[s]} | {int(s) for s in held if int(s) not in now and held[s]["sums"] != ""}
            if due:
                left = Counter(v["folder"] for s, v in held.items() if int(s) not in due)
                due |= {int(s) for s, v in held.items() if 2 * left[v["folder"]] < sizes[v["folder"]]}
            return sorted(due), held

        while True:
            base, state = self.store.latest()
            due, held = change_of(state)
            if not due:
                return {"written": 0, "kept": len(held), "snapshot": base}
            asked = log if set(now) <= set(due) else self._among(log, due, self.slice(F.col("n")))
            own = chunk_rows(asked, erasures).withColumn("slice", self.slice(F.col("n")))
            before = self._read({str(s): held[str(s)] for s in due if str(s) in held}, state)
            lost = before.join(own.select("chunk_id"), "chunk_id", "left_anti").withColumn("status", F.lit("stale"))
            rows = own.unionByName(lost).repartition("slice", F.pmod(F.xxhash64("event_id"), F.lit(16))).sortWithinPartitions("slice")
            folder = self.store.write(rows, "chunks")
            slices = held | {str(s): {"sums": now.get(s, ""), "folder": folder} for s in due}
            named = {v["folder"] for v in slices.values()}
            sizes = {f: n for f, n in (state.get("folders", {}) | {folder: len(due)}).items() if f in named}
            try:
                return {"written": len(due), "kept": len(held) - sum(str(s) in held for s in due), "snapshot": self.store.commit(base, {"width": self.width, "slices": slices, "folders": sizes})}
            except Conflict:
                continue

    def _among(self, rows: DataFrame, slices: list[int], column: Column) -> DataFrame:
        """The rows of some slices; many of them are a small table, not a list in the plan."""
        if len(slices) <= 100:
            return rows.where(column.isin(slices))
        wanted = self.store.spark.createDataFrame([(s,) for s in slices], "_slice long")
        return rows.join(F.broadcast(wanted), column == F.col("_slice"), "left_semi")

    def _read(self, slices: dict[str, dict], state: dict) -> DataFrame:
        by: dict[str, list[int]] = {}
        for s, v in slices.items():
            by.setdefault(v["folder"], []).append(int(s))
        out = self.store.spark.createDataFrame([], SCHEMA)
        for folder, own in sorted(by.items()):
            rows = self.store.read(folder, SCHEMA)
            out = out.unionByName(rows if len(own) == state["folders"][folder] else self._among(rows, sorted(own), F.col("slice")))
        return out

    def rows(self, number: int | None = None) -> DataFrame:
        """The chunks of a snapshot (None: the current one)."""
        state = self.store.latest()[1] if number is None else self.store.at(number)
        return self._read(state.get("slices", {}), state)

    def folders(self) -> dict[int, str]:
        return {int(s): v["folder"] for s, v in self.store.latest()[1].get("slices", {}).items()}


def freshness(chunks: DataFrame, scanned: DataFrame, cursors: DataFrame) -> DataFrame:
    """zone, last_indexed, after_sequence, stale: how far a projection is behind what was pulled.

    chunks and scanned (zone, zone_sequence) are what the table was built from, cursors (zone,
    after_sequence) are where pulling stands. Without a cursor a zone is as fresh as itself.
    """
    last = chunks.unionByName(scanned).groupBy("zone").agg(F.max("zone_sequence").alias("last"))
    both = last.join(cursors, "zone", "full").select("zone", F.coalesce("last", F.lit(0)).cast("long").alias("last_indexed"), "after_sequence")
    after = F.coalesce("after_sequence", "last_indexed").cast("long")
    return both.select("zone", "last_indexed", after.alias("after_sequence"), (F.col("last_indexed") < after).alias("stale"))
