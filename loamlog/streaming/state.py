"""Streaming forms of the stateful operators. Their batch forms carry the SQL checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamlog.functions import prose as P
from loamlog.functions import text as T
from loamlog.sources.store import AppendLog, Store

#: Fixed value of the transcript fold.
KEPT = 8


def idempotent_stream(requests: DataFrame) -> DataFrame:
    """key, fingerprint, arrival stream -> status per request; the first fingerprint of a key
    is its state and survives restarts with the query's checkpoint."""

    def accept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        for pdf in frames:
            out = []
            for fingerprint, arrival in sorted(zip(pdf["fingerprint"], pdf["arrival"], strict=True), key=lambda r: r[1]):
                status = "new" if first is None else "replay" if first == fingerprint else "conflict"
                first = fingerprint if first is None else first
                out.append((key[0], fingerprint, arrival, status))
            yield pd.DataFrame(out, columns=["key", "fingerprint", "arrival", "status"])
        if first is not None:
            state.update((first,))

    return requests.groupBy("key").applyInPandasWithState(
        accept, "key string, fingerprint string, arrival long, status string", "first string", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events per zone and window; what comes later than ``late`` is left out."""
    return events.withWatermark("recorded", late).groupBy(F.window("recorded", width), "zone").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "zone", "n")


def append_new(batch: DataFrame, path: str, key: str, writer: str = "batch", number: int | None = None) -> None:
    """foreachBatch sink: appends rows whose key is not there yet to the snapshots under
    ``path``; a replayed batch adds none, and writers may work at once (see AppendLog).

    Without a number a batch is taken for a new one, and its keys alone tell what is there.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
    log = AppendLog(Store(batch.sparkSession, path), schema, key)
    log.append(batch, writer if number is not None else f"{writer}-{uuid.uuid4().hex}", number or 0)


def appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``append_new`` has put under ``path``."""
    folders = Store(spark, path).latest()[1].get("folders", [])
    return spark.read.parquet(*[f"{path.rstrip('/')}/{f}" for f in folders])


def lasting_lines(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, turn, line, key, corrects, terms of what lasts."""
    said = turns.where(F.lower("role").isin("user", "human", "assistant", "ai")).withColumn("line", P.sanitized(F.regexp_replace("text", "(?i)</?user_query\\s*>", " ")))
    lasting = T.computed(said, "line").where(P.is_durable(F.col("line")))
    return lasting.select("conv_id", "turn", "line", P.repeat_key(F.col("line")).alias("key"), P.is_correction(F.col("line")).alias("corrects"), P.obsolete_terms(F.col("line")).alias("terms"))


def fold_transcripts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> what was said that lasts, in order.

    A turn counts if its prose is fit for a candidate and durable. It is kept once; a kept
    correction opens an epoch, in which earlier lines may be said again, and takes away the
    earlier lines that hold a term which it gives up. The last KEPT lines stay.

    Roles, prose and rules are columns, so only the few lines that last reach the fold. The
    fold is sequential by contract: whether a correction opens an epoch depends on what was
    kept before. It holds a conversation's lasting lines in one task.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        seen: set[str] = set()
        epoch = 0
        for turn, line, key, corrects, terms in pdf.sort_values(["turn", "line"])[["turn", "line", "key", "corrects", "terms"]].itertuples(index=False):
            if key in seen:
                continue
            if corrects:
                seen.clear()
                epoch += 1
                kept = [x for x in kept if not any(t in x[2] for t in terms)]
            seen.add(key)
            kept.append((turn, line, key))
        rows = [(pdf["conv_id"].iloc[0], i + 1, t, s, epoch) for i, (t, s, _) in enumerate(kept[-KEPT:])]
        return pd.DataFrame(rows, columns=["conv_id", "place", "turn", "line", "epoch"])

    return lasting_lines(turns).groupBy("conv_id").applyInPandas(fold, "conv_id long, place int, turn long, line string, epoch int")


class TranscriptFold(StatefulProcessor):
    """The fold as a stream: kept lines are a list, keys of the epoch a map, both in the state
    store. A line that is new costs a look into the map; only a correction reads the list."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "turn long, line string, key string")
        self.seen = handle.getMapState("seen", "key string", "turn long")
        self.epoch = handle.getValueState("epoch", "epoch int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [p for p in rows if len(p)]
        if not parts:
            return
        changed = False
        for turn, line, same, corrects, terms in pd.concat(parts).sort_values(["turn", "line"])[["turn", "line", "key", "corrects", "terms"]].itertuples(index=False):
            if self.seen.containsKey((same,)):
                continue
            if corrects:
                self.seen.clear()
                self.epoch.update(((self.epoch.get()[0] if self.epoch.exists() else 0) + 1,))
                left = [x for x in self._kept() if not any(t in x[2] for t in terms)]
                self.kept.clear()
                if left:
                    self.kept.put(left)
            self.seen.updateValue((same,), (int(turn),))
            self.kept.appendValue((int(turn), line, same))
            changed = True
        if changed:
            epoch = self.epoch.get()[0] if self.epoch.exists() else 0
            shown = [(key[0], i + 1, t, s, epoch) for i, (t, s, _) in enumerate(self._kept()[-KEPT:])]
            yield pd.DataFrame(shown, columns=["conv_id", "place", "turn", "line", "epoch"])

    def _kept(self) -> list[tuple]:
        return [tuple(x) for x in self.kept.get()] if self.kept.exists() else []

    def close(self) -> None:
        pass


def fold_stream(turns: DataFrame) -> DataFrame:
    """A stream of turns -> for each conversation that a micro-batch changed, its last lines
    anew (update mode): conv_id, place, turn, line, epoch. Turns of a conversation are to arrive
    in their order; how they fall into micro-batches does not matter. The session's state store
    must be one that keeps lists and maps (RocksDB)."""
    return lasting_lines(turns).groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=TranscriptFold(), outputStructType="conv_id long, place int, turn long, line string, epoch int", outputMode="Update", timeMode="None"
    )


#: Attempts after which a job whose lease runs out is given up.
MOST_ATTEMPTS = 5


class Leases(StatefulProcessor):
    """Jobs of one queue: what waits by rank and age, who holds what until when.

    A claim leases the first jobs that wait or whose lease has run out. A timer at the end of
    a lease gives the job back if nothing was heard of it, also when nobody asks.
    """

    def __init__(self, lease_ms: int, most: int = MOST_ATTEMPTS):
        self.lease_ms, self.most = lease_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id string", "rank int, added long, worker string, until long, attempt int")

    def _lapse(self, now: int) -> list[tuple]:
        """Leases that have run out by ``now`` are given back, or given up."""
        out = []
        for (job,), (rank, added, worker, until, attempt) in list(self.jobs.iterator()):
            if worker and until <= now:
                if attempt >= self.most:
                    self.jobs.removeKey((job,))
                else:
                    self.jobs.updateValue((job,), (rank, added, "", 0, attempt))
                out.append(("dead" if attempt >= self.most else "lapsed", job, worker, until, attempt))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, out = [p for p in rows if len(p)], []
        if not parts:
            return
        frame = pd.concat(parts)
        frame = frame.assign(ms=frame["at"].map(lambda t: int(t.timestamp() * 1000))).sort_values(["ms", "number"])
        for kind, job, worker, rank, most, now in frame[["kind", "job_id", "worker", "rank", "most", "ms"]].itertuples(index=False):
            if kind == "add":
                if not self.jobs.containsKey((job,)):
                    self.jobs.updateValue((job,), (int(rank), now, "", 0, 0))
                continue
            if kind == "ack":  # counts from the holder alone, and only while the lease lasts
                held = self.jobs.getValue((job,)) if self.jobs.containsKey((job,)) else None
                good = held is not None and held[2] == worker and held[3] > now
                if good:
                    self.jobs.removeKey((job,))
                out.append(("done" if good else "refused", job, worker, now, held[4] if held is not None else 0))
                continue
            out += self._lapse(now)
            waiting = sorted((v[0], v[1], k[0], v[4]) for k, v in self.jobs.iterator() if not v[2])
            for r, added, j, attempt in waiting[: int(most)]:
                self.jobs.updateValue((j,), (r, added, worker, now + self.lease_ms, attempt + 1))
                out.append(("leased", j, worker, now, attempt + 1))
            if waiting:
                self.handle.registerTimer(now + self.lease_ms)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._lapse(expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield self._rows(key, out)

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], e, j, w, pd.Timestamp(t, unit="ms"), a) for e, j, w, t, a in out], columns=["queue", "event", "job_id", "worker", "at", "attempt"])

    def close(self) -> None:
        pass


def lease_stream(requests: DataFrame, lease: str = "2 minutes", late: str = "0 seconds") -> DataFrame:
    """A stream of requests -> what became of jobs: leased, done, refused, lapsed or dead.

    requests (queue, number, kind, job_id, worker, rank, most, at): ``add`` puts a job in,
    once; ``claim`` asks for ``most`` jobs of the lowest rank, then age, then id; ``ack`` says that
    one is done. A queue is one key of the state: a busy one is to be cut into lanes. Times
    are those of the requests; a lease ends when the watermark has passed it.
    """
    ms = int(pd.Timedelta(lease).total_seconds() * 1000)
    return requests.withWatermark("at", late).groupBy("queue").transformWithStateInPandas(
        statefulProcessor=Leases(ms), outputStructType="queue string, event string, job_id string, worker string, at timestamp, attempt int", outputMode="Append", timeMode="EventTime"
    )
