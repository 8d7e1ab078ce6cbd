"""Queues, sync and state as set-based transitions over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlog.sources import log as L

#: Retry policy, spend prices (USD per million tokens), telemetry debits.
BACKOFF_CAP_S, BACKOFF_STEPS = 3600, 10
PRICE_HIT, PRICE_MISS, PRICE_OUT = 0.0028, 0.14, 0.28
NEW_DEBIT, REPEAT_DEBIT = (7, 153, 21504, 25), (3, 1, 256, 0)


def backoff_seconds(attempts: Column) -> Column:
    """2^(attempts - 1) seconds, at most an hour."""
    return F.least(F.lit(BACKOFF_CAP_S), F.pow(F.lit(2.0), F.least(F.lit(BACKOFF_STEPS), attempts - 1))).cast("long")


def jitter_ms(seed: Column) -> Column:
    """Less than a second, from the first digits of the seed's SHA-256."""
    return (F.conv(F.substring(F.sha2(seed, 256), 1, 6), 16, 10).cast("long") % 1000).cast("long")


def next_midnight(at: Column) -> Column:
    """The first midnight, UTC, after a time."""
    return F.date_trunc("day", at) + F.expr("INTERVAL 1 DAY")


def retry_times(jobs: DataFrame) -> DataFrame:
    """job_id, retry_at of failed jobs with attempts left, that failed at ``failed_at``: after
    their backoff and a jitter seeded by job and attempt, or at the next UTC midnight where the
    quota is spent. Blocked jobs are not tried again."""
    kind = error_class(F.col("error"))
    open_ = jobs.where((F.col("state") == "failed") & (F.col("attempt") < F.col("max_attempts"))).withColumn("kind", kind).where("kind <> 'blocked'")
    seed = F.concat_ws(":", F.col("job_id").cast("string"), F.col("attempt").cast("string"))
    ms = backoff_seconds(F.greatest(F.lit(1), F.col("attempt"))) * 1000 + jitter_ms(seed)
    later = F.date_trunc("millisecond", "failed_at") + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))
    return open_.select("job_id", F.when(F.col("kind") == "quota", next_midnight(F.col("failed_at"))).otherwise(later).alias("retry_at"))


def outbox(log: DataFrame) -> DataFrame:
    """The outbox that belongs to the adapted log: one row per event, in every state."""
    n = F.col("n")
    state = F.when(n % 4 == 0, "delivered").when(n % 4 == 1, "leased").otherwise("pending")
    return log.select(
        n.alias("outbox_id"), "event_id", "zone", "event_type", "lifecycle", state.alias("state"), (n % 6).cast("int").alias("attempts"),
        (F.col("recorded") + F.make_dt_interval(mins=(n % 50).cast("int"))).alias("available_at"),
        F.when(state == "leased", F.col("recorded") + F.make_dt_interval(hours=(n % 30).cast("int"))).alias("lease_expires_at"),
        F.when(n % 9 == 0, "timeout").alias("last_error"),
    )


def admission(event_type: Column, lifecycle: Column) -> Column:
    """The thin policy: evidence stays home, active units go, drafts wait."""
    return F.when(event_type == "EvidenceArtifact", "skip_evidence").when(lifecycle == "active", "admit").otherwise("skip_not_promoted")


#: Policies of what may leave the machine, and which stands where none is known.
POLICIES = ("remote_thin_promoted_v1", "full_log", "off")


def sync_admission(rows: DataFrame, policies: tuple[str | None, ...] = POLICIES) -> DataFrame:
    """event_id, policy, decision, reason of each event under each policy.

    rows (event_id, event_type, lifecycle, disposition). An unknown policy counts as the thin
    one, which lets units go that are active, or promoted by their latest disposition.
    """
    life, said = F.lower(F.coalesce("lifecycle", F.lit(""))), F.lower(F.coalesce("disposition", F.lit("")))
    unit = (
        F.when(life.isin("active", "promoted"), "thin_admit_active_unit").when(said.isin("promote", "promoted"), "thin_admit_promoted_unit")
        .when(life.isin("draft", "held", ""), "thin_skip_draft_or_held_unit").otherwise("thin_skip_non_promoted_unit")
    )
    thin = F.when(F.col("event_type") == "EvidenceArtifact", "thin_skip_raw_evidence").when(F.col("event_type").isin("Observation", "Claim"), unit).otherwise("thin_skip_event_type")
    named = F.explode(F.array(*[F.lit(p if p in POLICIES else POLICIES[0]) for p in policies])).alias("policy")
    out = rows.select("event_id", "event_type", "lifecycle", "disposition", named)
    reason = F.when(F.col("policy") == "off", "admission_off").when(F.col("policy") == "full_log", "full_log").otherwise(thin)
    return out.select("event_id", "policy", F.when((reason == "full_log") | reason.startswith("thin_admit"), "admit").otherwise("skip").alias("decision"), reason.alias("reason"))


def lease(queue: DataFrame, now: str, limit: int) -> DataFrame:
    """The next ``limit`` due rows: pending and available, or leased with an expired lease.

    The limit counts admitted rows, not scanned ones.
    """
    at = F.to_timestamp(F.lit(now))
    due = ((F.col("state") == "pending") & (F.col("available_at") <= at)) | ((F.col("state") == "leased") & (F.col("lease_expires_at") <= at))
    rows = queue.where(due & (admission(F.col("event_type"), F.col("lifecycle")) == "admit")).orderBy("available_at", "outbox_id").limit(limit)
    return rows.select("outbox_id", "event_id", "zone", (F.col("attempts") + 1).alias("attempts"), F.col("state").alias("was"))


def retry(queue: DataFrame, most: int = 5) -> DataFrame:
    """Failed rows after a retry decision: dead at ``most`` attempts, else pending again later."""
    failed = queue.where("last_error IS NOT NULL AND state <> 'delivered'")
    dead = F.col("attempts") >= most
    return failed.select("outbox_id", F.when(dead, "dead").otherwise("pending").alias("state"), F.when(~dead, backoff_seconds(F.greatest(F.lit(1), F.col("attempts")))).alias("delay_s"))


def state_counts(queue: DataFrame, states: tuple[str, ...] = ("pending", "leased", "delivered", "dead")) -> DataFrame:
    """Rows per zone and state, states without rows as 0."""
    return queue.groupBy("zone").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])


def skip_reasons(queue: DataFrame) -> DataFrame:
    reason = admission(F.col("event_type"), F.col("lifecycle"))
    return queue.where("state = 'pending'").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def pull_page(log: DataFrame, after: int, limit: int) -> DataFrame:
    """Per zone the next ``limit`` events and erasures after a sequence number, and whether
    more follow: one row beyond the page tells.

    Sequence numbers are dense, so a page is a range of them and no zone is sorted.
    """
    events = L.sequenced(log).select("zone", "zone_sequence", F.col("event_id").alias("record_id"), F.lit("event").alias("record_kind"))
    gone = L.erasures(log).select(F.col("target_id").alias("erased_id"), "erasure_id")
    erased = L.sequenced(log).join(gone, F.col("event_id") == F.col("erased_id")).select("zone", "zone_sequence", F.col("erasure_id").alias("record_id"), F.lit("erasure").alias("record_kind"))
    # an erasure follows its event, so at most 2 * (limit + 1) rows of a zone are in reach
    near = events.unionAll(erased).where(F.col("zone_sequence").between(after + 1, after + limit + 1))
    rank = F.row_number().over(Window.partitionBy("zone").orderBy("zone_sequence", "record_kind", "record_id"))
    rows = near.withColumn("place", rank).withColumn("n", F.count("*").over(Window.partitionBy("zone")))
    return rows.where(F.col("place") <= limit).select("zone", "zone_sequence", "record_id", "record_kind", (F.col("n") > limit).alias("has_more"))


def idempotent(requests: DataFrame) -> DataFrame:
    """key, fingerprint, arrival -> new, replay (same fingerprint as the key's first) or conflict."""
    first = requests.groupBy("key").agg(F.min_by(F.struct("fingerprint", "arrival"), F.struct("arrival", "fingerprint")).alias("f"))
    joined = requests.join(first, "key")
    status = F.when(F.col("arrival") == F.col("f.arrival"), "new").when(F.col("fingerprint") == F.col("f.fingerprint"), "replay").otherwise("conflict")
    return joined.select("key", "fingerprint", "arrival", status.alias("status"))


def requests(log: DataFrame) -> DataFrame:
    """Push requests of the adapted log: keys repeat per user and type, fingerprints differ
    where the payload's number does."""
    return log.select(
        F.concat_ws(":", "user_id", "event_type").alias("key"), F.sha2(F.concat_ws(":", "user_id", "event_type", (F.col("k") % 3).cast("string")), 256).alias("fingerprint"), F.col("n").alias("arrival")
    )


def telemetry(log: DataFrame) -> DataFrame:
    """Admission of the log's requests as telemetry, with the debit of each outcome summed."""
    out = idempotent(requests(log)).groupBy("status").agg(F.count("*").alias("n_requests"))
    new = F.col("status") == "new"
    debit = lambda i: (F.col("n_requests") * F.when(new, NEW_DEBIT[i]).otherwise(REPEAT_DEBIT[i])).cast("long")
    return out.select("status", "n_requests", debit(0).alias("reads"), debit(1).alias("writes"), debit(2).alias("bytes"), debit(3).alias("row_count"))


def freshness(log: DataFrame, upto: dict[str, str] | None = None) -> DataFrame:
    """Per zone: highest event sequence scanned, highest indexed one (active events here), the
    sync cursor (nine tenths of all), and whether the index is behind the cursor.

    ``upto`` says until when a zone was scanned; zones that it does not name were wholly.
    """
    rows = L.sequenced(log)
    until = F.create_map(*[F.lit(x) for kv in upto.items() for x in kv])[F.col("zone")].cast("timestamp") if upto else F.lit(None).cast("timestamp")
    seen = F.when(until.isNull() | (F.col("recorded") < until), F.col("zone_sequence"))
    none = F.lit(0).cast("long")
    out = rows.groupBy("zone").agg(
        F.coalesce(F.max(seen), none).alias("scanned"), F.coalesce(F.max(F.when(F.col("lifecycle") == "active", seen)), none).alias("indexed"), F.max("zone_sequence").alias("all")
    )
    cursor = F.floor(F.col("all") * 9 / 10)
    last = F.greatest(F.lit(0), "indexed", "scanned")
    return out.select("zone", "scanned", "indexed", cursor.alias("cursor"), last.alias("last_indexed"), (last < cursor).alias("stale"))


def dispositions(log: DataFrame) -> DataFrame:
    """Policy dispositions of observations: two versions each, the later one decides."""
    seen = log.where("event_type = 'Observation'")
    word = lambda m: F.element_at(F.array(*map(F.lit, ("promote", "hold", "reject"))), (m % 3 + 1).cast("int"))
    first = seen.select("event_id", "zone", word(F.col("k")).alias("disposition"), F.col("recorded").alias("created"), F.lit("v1").alias("policy"))
    second = seen.where("n % 2 = 0").select("event_id", "zone", word(F.col("k") + 1).alias("disposition"), (F.col("recorded") + F.expr("INTERVAL 1 HOUR")).alias("created"), F.lit("v2").alias("policy"))
    return first.unionAll(second)


def disposition_history(rows: DataFrame) -> DataFrame:
    """All dispositions of each event in the order in which they were made, then by policy:
    event_id, place, policy, disposition, created, and what the one before said."""
    order = Window.partitionBy("event_id").orderBy("created", "policy")
    return rows.select("event_id", F.row_number().over(order).alias("place"), "policy", "disposition", "created", F.lag("disposition").over(order).alias("before"))


def disposition_counts(rows: DataFrame) -> DataFrame:
    """Per zone and policy how many dispositions promote, hold and reject, and of how many events
    the last one of all policies does."""
    n = lambda word: F.count_if(F.col("disposition") == word).alias(word)
    last = rows.groupBy("zone", "event_id").agg(F.max_by("disposition", F.struct("created", "policy")).alias("disposition")).withColumn("policy", F.lit("latest"))
    both = rows.select("zone", "policy", "disposition").unionByName(last.select("zone", "policy", "disposition"))
    return both.groupBy("zone", "policy").agg(n("promote"), n("hold"), n("reject"), F.count("*").alias("total"))


def job_list(queue: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` jobs of each zone and state by when they can be taken, then by id.
    A task keeps the first of its part before anything meets by zone and state."""
    order = Window.partitionBy("zone", "state").orderBy("available_at", "outbox_id")
    return queue.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("zone", "state", "place", "outbox_id", "available_at")


def latest_disposition(log: DataFrame) -> DataFrame:
    """Each claim's disposition: its own target's latest, else unknown."""
    latest = dispositions(log).groupBy("event_id").agg(F.max_by("disposition", F.struct("created", "policy")).alias("disposition"))
    claims = log.where("event_type = 'Claim'").select("event_id", "zone", "target_id")
    return claims.join(latest.withColumnRenamed("event_id", "t"), F.col("target_id") == F.col("t"), "left").select("event_id", "zone", F.coalesce("disposition", F.lit("unknown")).alias("disposition"))


def held_unreviewed(log: DataFrame) -> DataFrame:
    """Held dispositions without a review of the same event, zone and policy, counted."""
    held = dispositions(log).where("disposition = 'hold'")
    reviews = log.where("event_type = 'Observation' AND n % 3 = 0").select("event_id", "zone", F.lit("v1").alias("policy"))
    return held.join(reviews, ["event_id", "zone", "policy"], "left_anti").groupBy("zone", "policy").agg(F.count("*").alias("n_held"), F.min("event_id").alias("first_held"))


def day_spend(log: DataFrame, cap: float) -> DataFrame:
    """Spend and calls per UTC day; negative spend counts as none; whether the cap is passed."""
    out = log.groupBy(F.date_format("recorded", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum(F.greatest(F.lit(0.0), "value")), 4).alias("spend"), F.count("*").alias("calls"))
    return out.withColumn("exceeded", F.col("spend") >= cap)


def token_cost(log: DataFrame) -> DataFrame:
    """Cost of calls by cache hits, misses and output; a split that does not add up costs null."""
    prompt, hit, out = F.col("k") * 100, F.col("k") * 40, F.col("k") * 7
    miss = F.when(F.col("n") % 10 == 0, prompt).otherwise(prompt - hit)
    cost = F.when(hit + miss == prompt, (hit * PRICE_HIT + miss * PRICE_MISS + out * PRICE_OUT) / 1_000_000)
    return log.select("zone", cost.alias("cost")).groupBy("zone").agg(F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost"), F.count_if(F.col("cost").isNull()).alias("n_rejected"))


def reconcile_import(log: DataFrame) -> DataFrame:
    """A pulled page against what is there: every fifth event arrives again, every fifteenth
    with other content; unknown ids are inserted, equal ones skipped, others are conflicts."""
    have = log.where("n % 3 <> 0").select("event_id", F.col("k").alias("have"))
    pulled = log.where("n % 5 = 0").select("event_id", F.when(F.col("n") % 15 == 5, F.col("k") + 1).otherwise(F.col("k")).alias("got"))
    status = F.when(F.col("have").isNull(), "insert").when(F.col("have") == F.col("got"), "skip").otherwise("conflict")
    return pulled.join(have, "event_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def error_class(error: Column) -> Column:
    """retry, blocked or quota: status codes first, then words."""
    code = F.regexp_extract(F.coalesce(error, F.lit("")), "HTTP ([0-9]{3})", 1)
    return (
        F.when(error.isNull(), F.lit(None)).when(code.isin("408", "429") | code.startswith("5"), "retry").when(code.startswith("4"), "blocked")
        .when(F.lower(error).contains("quota"), "quota").otherwise("retry")
    )


def job_step(jobs: DataFrame) -> DataFrame:
    """The next state of each job: leased, pending again (with a delay in seconds, or at the
    next UTC midnight for a spent quota), dead at its last attempt, blocked, or unchanged."""
    kind = error_class(F.col("error"))
    spent = F.col("attempt") >= F.col("max_attempts")
    lost = (F.col("state") == "leased") & F.col("lease_expired")
    failed = F.col("state") == "failed"
    state = (
        F.when(F.col("state") == "pending", "leased").when((lost | failed) & spent, "dead").when(lost, "pending").when(failed & (kind == "blocked"), "blocked")
        .when(failed, "pending").otherwise(F.col("state"))
    )
    rows = jobs.withColumns({"kind": kind, "next": state})
    delay = F.when(failed & (F.col("next") == "pending") & (F.col("kind") == "retry"), backoff_seconds(F.col("attempt")))
    return rows.select("job_id", F.col("next").alias("state"), F.col("kind").alias("error_class"), delay.alias("delay_s"), (failed & (F.col("next") == "pending") & (F.coalesce("kind", F.lit("")) == "quota")).alias("until_midnight"))
