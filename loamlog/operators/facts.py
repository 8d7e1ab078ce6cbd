"""Views of what the log holds to be true: eligibility, acceptance, loops, conflicts, time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.sources import log as L

#: Length of titles taken from statements (fixed value).
TITLE = 160


def visible(rows: DataFrame, zones: list[str]) -> DataFrame:
    """Rows of the zones that the caller may see; an empty list is an error, never all rows."""
    if not zones:
        raise ValueError("name at least one visible trust zone")
    return rows.where(F.col("zone").isin(*zones))


def eligible(log: DataFrame, active: bool = True) -> DataFrame:
    """Events that are verified by anyone, not erased, not superseded and, if asked, active."""
    rows = log.where("authority <> 'unverified'")
    rows = rows.where("lifecycle = 'active'") if active else rows
    gone = L.erasures(log).select(F.col("target_id").alias("event_id")).unionAll(L.superseded(log))
    return rows.join(gone, "event_id", "left_anti")


def first_decisions(decided: DataFrame) -> DataFrame:
    """Per claim and decision the earliest event by (recorded, id)."""
    return decided.groupBy("claim_id", "decision").agg(F.min_by("event_id", F.struct("recorded", "event_id")).alias("decision_id"))


def latest_accepted(decided: DataFrame) -> DataFrame:
    """Per claim the latest accepting decision; of equal times the first in the log."""
    rows = decided.where("decision = 'accepted'")
    return rows.groupBy("claim_id").agg(
        F.max_by("event_id", F.struct("recorded", -F.col("n"))).alias("decision_id"), F.max("recorded").alias("decided_at"), F.count("*").alias("n_decisions")
    )


def accepted_facts(log: DataFrame) -> DataFrame:
    """Eligible claims with an eligible acceptance, no eligible rejection, and support that is
    itself eligible; one row per fact with its decision and support."""
    ok = eligible(log)
    by_claim = first_decisions(ok.join(L.decisions(log).select("event_id", "claim_id"), "event_id").select("event_id", "claim_id", "decision", "recorded"))
    accepted = by_claim.where("decision = 'accepted'").select("claim_id", "decision_id")
    rejected = by_claim.where("decision = 'rejected'").select("claim_id")
    support = ok.where("event_type IN ('EvidenceArtifact', 'Observation', 'Claim')").select(F.col("event_id").alias("support_id"), F.col("event_type").alias("support_type"))
    claims = ok.where("event_type = 'Claim'")
    return (
        claims.withColumnRenamed("event_id", "claim_id")
        .join(accepted, "claim_id")
        .join(rejected, "claim_id", "left_anti")
        .join(support, F.col("target_id") == F.col("support_id"), "left")
        .where("target_id IS NULL OR support_id IS NOT NULL")
        .select("claim_id", "zone", "subject", "statement", "decision_id", "support_id", "support_type")
    )


def decision_flags(log: DataFrame) -> DataFrame:
    """Per claim: accepted, rejected, needs_review booleans over all its decisions."""
    said = lambda d: F.max(F.col("decision") == d)
    return L.decisions(log).groupBy("claim_id").agg(said("accepted").alias("accepted"), said("rejected").alias("rejected"), said("needs_review").alias("review"))


def open_loops(log: DataFrame) -> DataFrame:
    """Undecided drafts, claims under review, conflicts, and supersessions without replacement.

    A claim may open several loops. Here a supersession whose number is odd names no
    replacement.
    """
    flags = decision_flags(log)
    claims = log.where("event_type = 'Claim'").join(flags, F.col("event_id") == F.col("claim_id"), "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kinds = F.filter(
        F.array(
            F.when((F.col("lifecycle") == "draft") & no("accepted") & no("rejected"), F.struct(F.lit("draft_claim").alias("kind"), F.lit("loop_draft_").alias("prefix"))),
            F.when(yes("review"), F.struct(F.lit("needs_review").alias("kind"), F.lit("loop_review_").alias("prefix"))),
            F.when(yes("accepted") & yes("rejected"), F.struct(F.lit("conflict").alias("kind"), F.lit("loop_conflict_").alias("prefix"))),
        ),
        lambda x: x.isNotNull(),
    )
    of_claims = claims.select("event_id", "subject", "statement", F.explode(kinds).alias("x")).select(
        F.concat("x.prefix", "event_id").alias("loop_id"), F.col("x.kind").alias("kind"), "subject", F.substring("statement", 1, TITLE).alias("title")
    )
    loose = log.where("event_type = 'Supersession' AND target_id IS NOT NULL AND n % 2 = 1").select(
        F.concat(F.lit("loop_super_"), "event_id").alias("loop_id"), F.lit("unresolved_supersession").alias("kind"), "subject",
        F.concat(F.lit("replaces "), "target_id").alias("title"),
    )
    return of_claims.unionAll(loose)


def claim_category(log: DataFrame) -> DataFrame:
    """conflict, rejected, accepted or proposed for each claim that is neither erased nor
    superseded; all of its decisions count."""
    rows = eligible(log, active=False).where("event_type = 'Claim'").join(decision_flags(log), F.col("event_id") == F.col("claim_id"), "left")
    category = (
        F.when(F.col("accepted") & F.col("rejected"), "conflict").when(F.col("rejected"), "rejected").when(F.col("accepted"), "accepted").otherwise("proposed")
    )
    return rows.select("event_id", "zone", category.alias("category"))


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Closed intervals meet; a null end is open."""
    return (start <= F.coalesce(hi, F.to_timestamp(F.lit("9999-12-31")))) & (lo <= F.coalesce(end, F.to_timestamp(F.lit("9999-12-31"))))


def bitemporal(log: DataFrame, valid: tuple[str, str], recorded: tuple[str, str]) -> DataFrame:
    """Events valid at some time of ``valid`` and recorded within ``recorded``, ends included,
    and erasures requested within ``recorded``; valid time does not apply to erasures."""
    at = lambda x: F.to_timestamp(F.lit(x))
    events = log.where(overlaps(F.col("valid_start"), F.col("valid_end"), at(valid[0]), at(valid[1])) & F.col("recorded").between(at(recorded[0]), at(recorded[1])))
    erased = L.erasures(log).where(F.col("requested").between(at(recorded[0]), at(recorded[1])))
    return events.select(F.lit("event").alias("record_kind"), F.col("event_id").alias("record_id"), "zone", F.col("recorded").alias("at")).unionAll(
        erased.select(F.lit("erasure").alias("record_kind"), F.col("erasure_id").alias("record_id"), "zone", F.col("requested").alias("at"))
    )


def classify(log: DataFrame) -> DataFrame:
    """The section of a context pack that each event falls into."""
    category = claim_category(log).select(F.col("event_id").alias("c_id"), "category")
    gone = L.erasures(log).select(F.col("target_id").alias("x_id")).distinct()
    old = L.superseded(log).select(F.col("event_id").alias("s_id"))
    rows = log.join(category, F.col("event_id") == F.col("c_id"), "left").join(gone, F.col("event_id") == F.col("x_id"), "left").join(old, F.col("event_id") == F.col("s_id"), "left")
    section = (
        F.when(F.col("x_id").isNotNull(), "erasure")
        .when(F.col("event_type") == "Supersession", "supersession")
        .when(F.col("s_id").isNotNull() | (F.col("authority") == "unverified"), "excluded")
        .when(F.col("event_type") == "EvidenceArtifact", "evidence")
        .when(F.col("event_type") == "Observation", "observation")
        .when(F.col("event_type") == "AcceptanceDecision", "decision")
        .when((F.col("lifecycle") == "draft") & (F.col("category") == "proposed"), "draft")
        .otherwise(F.col("category"))
    )
    return rows.select("event_id", "zone", "event_type", section.alias("section"))


def omissions(log: DataFrame, zone: str) -> DataFrame:
    """Every event that an export of ``zone`` leaves out, with the first reason that holds."""
    flags = decision_flags(log)
    gone = L.erasures(log).select(F.col("target_id").alias("x_id")).distinct()
    rows = log.join(gone, F.col("event_id") == F.col("x_id"), "left").join(flags, F.col("event_id") == F.col("claim_id"), "left")
    claim = F.col("event_type") == "Claim"
    reason = (
        F.when(F.col("zone") != zone, "wrong_zone")
        .when(F.col("x_id").isNotNull(), "erased")
        .when(claim & F.coalesce("rejected", F.lit(False)), "rejected")
        .when(F.col("lifecycle") == "draft", "draft")
        .when(claim & ~F.coalesce("accepted", F.lit(False)), "missing_acceptance")
        .when((F.col("event_type") == "Supersession") & F.col("target_id").isNull(), "missing_supersession_target")
    )
    return rows.select("event_id", "event_type", reason.alias("reason")).where("reason IS NOT NULL")


def timeline(log: DataFrame) -> DataFrame:
    """Events and erasures by time, then id, as one list per subject position."""
    erased = L.erasures(log).join(log.select(F.col("event_id").alias("target_id"), "subject"), "target_id")
    return log.select("subject", F.lit("event").alias("record_kind"), F.col("event_id").alias("record_id"), F.col("recorded").alias("at")).unionAll(
        erased.select("subject", F.lit("erasure").alias("record_kind"), F.col("erasure_id").alias("record_id"), F.col("requested").alias("at"))
    )


def inherited_origin(log: DataFrame) -> DataFrame:
    """Each event's own capture origin, else the one of the event it derives from."""
    known = L.origins(log)
    other = known.select(F.col("event_id").alias("target_id"), F.col("project_id").alias("p2"), F.col("worktree_id").alias("w2"))
    own = F.col("project_id").isNotNull() | F.col("worktree_id").isNotNull()
    return (
        log.select("event_id", "zone", "target_id").join(known, "event_id", "left").join(other, "target_id", "left")
        .select("event_id", "zone", F.when(own, F.col("project_id")).otherwise(F.col("p2")).alias("project_id"), F.when(own, F.col("worktree_id")).otherwise(F.col("w2")).alias("worktree_id"))
    )


def in_scope(value: Column, scope: list[str]) -> Column:
    """Origin filter: an unknown origin passes, and so does everything without a scope."""
    return F.lit(True) if not scope else value.isNull() | value.isin(*scope)


def recheck(log: DataFrame) -> DataFrame:
    """Why each chunk's source may not be shown, first reason that holds; null if it may.

    A chunk stores the type its source had when indexed; here every 13th was indexed under
    another type and every 17th under an id that is gone.
    """
    n = F.col("n")
    chunks = log.select(
        F.concat(F.lit("chunk_"), "event_id").alias("chunk_id"),
        F.when(n % 17 == 0, F.concat("event_id", F.lit("x"))).otherwise(F.col("event_id")).alias("source_id"),
        F.when(n % 13 == 0, F.lit("Other")).otherwise(F.col("event_type")).alias("indexed_type"),
    )
    canon = log.select(F.col("event_id").alias("source_id"), "event_type", "lifecycle", "authority")
    gone = L.erasures(log).select(F.col("target_id").alias("source_id"), F.lit(True).alias("erased")).distinct()
    old = L.superseded(log).select(F.col("event_id").alias("source_id"), F.lit(True).alias("replaced"))
    reason = (
        F.when(F.col("event_type").isNull(), "canonical_source_missing")
        .when(F.col("event_type") != F.col("indexed_type"), "canonical_source_mismatch")
        .when(F.col("erased"), "erased")
        .when(F.col("lifecycle") != "active", "lifecycle_excluded")
        .when(F.col("authority") == "unverified", "authority_excluded")
        .when(F.col("replaced"), "superseded")
    )
    return chunks.join(canon, "source_id", "left").join(gone, "source_id", "left").join(old, "source_id", "left").select("chunk_id", reason.alias("reason"))
