"""Intake of captured envelopes: validation, ids, idempotent acceptance, the feed, run ledgers,
and the write calls built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.functions import prose as P
from loamlog.functions import text as T

#: Fixed values of envelopes.
TRACE_MEDIA = "application/vnd.procedure-trace+json"
PLAIN_MEDIA = "application/json"
FEED_HOOKS = ("SessionEnd", "Stop", "PreCompact")


def envelopes(signals: DataFrame) -> DataFrame:
    """Envelopes as a host sends them, one a signal: capture times in three spellings, keys that
    repeat within a conversation's hook, tool turns as procedure traces."""
    minute = F.pmod(F.col("conv_id") * 17 + F.col("turn"), F.lit(60)).cast("string")
    time = F.concat(F.lit("2024-03-0"), (1 + F.col("conv_id") % 7).cast("string"), F.lit("T1"), (F.col("turn") % 10).cast("string"), F.lit(":"), F.lpad(minute, 2, "0"))
    spelling = F.col("turn") % 3
    captured = F.when(spelling == 0, F.concat(time, F.lit(":00Z"))).when(spelling == 1, F.concat(time, F.lit(":00.250+02:00"))).otherwise(F.concat(time, F.lit(":30+00:00")))
    return signals.select(
        "case_id", "conv_id", "turn", "zone", "provider", "hook", F.when(F.col("conv_id") % 11 == 5, "no time").otherwise(captured).alias("captured_at"),
        F.concat(F.lit("ses_"), F.col("conv_id").cast("string")).alias("session_id"), F.col("signal").alias("payload"),
        F.when(F.col("turn") % 4 == 1, F.concat_ws("-", F.lit("key"), F.col("conv_id").cast("string"), T.hook(F.col("hook")))).alias("idempotency_key"),
        F.lit(None).cast("string").alias("media_type"), (F.col("role") == "assistant").alias("trace"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("subject/"), (F.col("conv_id") % 13).cast("string"))).alias("subject"),
    )


def fault(rows: DataFrame) -> Column:
    """Why an envelope is refused, or null."""
    return F.when(F.trim("provider") == "", "provider_required").when(F.trim("hook") == "", "hook_required").when(F.col("valid_start").isNull(), "invalid_timestamp")


def intake(rows: DataFrame) -> DataFrame:
    """One row per envelope: status (accepted, replay, conflict, invalid), its fault, the ids,
    kind, media type and times of its evidence event, and the state of its feed row.

    The first envelope of a key in a zone is accepted; later ones with its fingerprint are
    replays, others conflicts. Ids are digests of zone, key and fingerprint, so a replayed
    batch makes the same ones. Keys meet by partial aggregation, not in a window.
    """
    timed = rows.withColumn("valid_start", P.utc_text(F.col("captured_at")))
    checked = timed.withColumn("fault", fault(timed))
    media = F.coalesce(F.when(F.trim("media_type") != "", F.col("media_type")), F.when(F.col("trace"), TRACE_MEDIA), F.lit(PLAIN_MEDIA))
    kind = F.when(F.col("trace") | (media == TRACE_MEDIA), "procedure_trace").otherwise("message")
    body = P.stable_json(provider=F.col("provider"), hook_event_name=F.col("hook"), captured_at=F.col("valid_start"), session_id=F.col("session_id"), payload=F.sha2("payload", 256))
    keyed = checked.withColumns({"media": media, "kind": kind, "fingerprint": P.digest(F.concat_ws(":", "zone", body))})
    derived = F.concat(F.lit("idem_"), F.substring(F.sha2(F.concat_ws(":", "zone", "session_id", "hook", "valid_start", F.sha2("payload", 256)), 256), 1, 32))
    keyed = keyed.withColumn("key", F.coalesce("idempotency_key", derived))
    seed = F.sha2(F.concat_ws(":", "zone", "key", "fingerprint"), 256)
    keyed = keyed.withColumns({"event_id": F.concat(F.lit("evt_"), F.substring(seed, 1, 32)), "artifact_id": F.concat(F.lit("art_"), F.substring(seed, 33, 32))})
    first = keyed.where("fault IS NULL").groupBy("zone", "key").agg(F.min_by(F.struct("case_id", "fingerprint"), F.struct("conv_id", "turn")).alias("f"))
    first = first.select("zone", "key", F.col("f.case_id").alias("first_case"), F.col("f.fingerprint").alias("first_print"))
    joined = keyed.join(first, ["zone", "key"], "left")
    status = (
        F.when(F.col("fault").isNotNull(), "invalid").when(F.col("first_case") == F.col("case_id"), "accepted")
        .when(F.col("first_print") == F.col("fingerprint"), "replay").otherwise("conflict")
    )
    made = joined.withColumn("status", status)
    stored = F.col("status") == "accepted"
    feed = F.when(stored, F.when(T.hook(F.col("hook")).isin(*FEED_HOOKS), "pending").otherwise("skipped"))
    ids = {c: F.when(stored, F.col(c)) for c in ("event_id", "artifact_id")}
    return made.withColumns(ids | {"feed_state": feed}).select(
        "case_id", "conv_id", "turn", "zone", "session_id", "status", "fault", "event_id", "artifact_id", "fingerprint", "kind", F.col("media").alias("media_type"), "valid_start", "subject", "feed_state",
    )


def feed_list(taken: DataFrame, zone: str, state: str, limit: int) -> DataFrame:
    """The feed rows of a zone in a state, oldest first."""
    rows = taken.where((F.col("zone") == zone) & (F.col("feed_state") == state))
    return rows.orderBy("valid_start", "event_id").limit(limit).select("event_id", "feed_state", "valid_start", "session_id")


def run_ledger(taken: DataFrame) -> DataFrame:
    """A ledger entry per session: run id, status, times, its different events and artifacts.

    The lists of ids stand as their number and ends in sorted order, so that a session with a
    third of all events is no single row; ``run_events`` tells the members.
    """
    rows = taken.where("status IN ('accepted', 'replay')")
    done = rows.groupBy("session_id", "zone").agg(
        F.min("valid_start").alias("started_at"), F.max("valid_start").alias("ended_at"), F.countDistinct("event_id").alias("n_events"),
        F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.max(F.struct("turn", "kind")).alias("last"),
    )
    seed = P.stable_json_nulls(subject_ref=F.col("session_id"), started_at=F.col("started_at"), agent_id=F.lit(None).cast("string"))
    status = F.when(F.col("last.kind") == "procedure_trace", "running").otherwise("completed")
    return done.select(
        F.concat(F.lit("run_"), F.substring(F.sha2(seed, 256), 1, 24)).alias("run_id"), "session_id", "zone", "started_at",
        F.when(status == "completed", F.col("ended_at")).alias("ended_at"), status.alias("status"), "n_events", "first_event", "last_event",
    )


def run_events(taken: DataFrame) -> DataFrame:
    return taken.where("event_id IS NOT NULL").select("session_id", "event_id").distinct()


def capture(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of an intake that are to be appended to ``stored`` (event_id): accepted and not
    there yet. Append them with a table format's own commit, or through a batch sink."""
    return intake(rows).where("status = 'accepted'").join(stored.select("event_id"), "event_id", "left_anti")


def propose_claims(rows: DataFrame, log: DataFrame) -> DataFrame:
    """zone, subject, statement, evidence_id, key -> draft claims to be appended, or why not.

    A draft claim never decides anything; its evidence must be in the log and in its zone.
    """
    evidence = log.select(F.col("event_id").alias("e"), F.col("zone").alias("e_zone"))
    joined = rows.join(evidence, F.col("evidence_id") == F.col("e"), "left")
    fault_ = (
        F.when(F.length(F.trim("statement")) < 8, "statement_too_short").when(T.secret_material(F.col("statement")), "secret_like_material")
        .when(F.col("e").isNull(), "evidence_not_found").when(F.col("e_zone") != F.col("zone"), "evidence_of_another_zone")
    )
    seed = F.sha2(F.concat_ws(":", "zone", "key", F.sha2("statement", 256)), 256)
    return joined.select(
        "key", "zone", "subject", fault_.alias("fault"), F.when(fault_.isNull(), F.concat(F.lit("evt_"), F.substring(seed, 1, 32))).alias("event_id"),
        F.when(fault_.isNull(), "draft").alias("lifecycle"),
    )
