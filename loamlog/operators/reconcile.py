"""Reconciliation of two policies: what each source's old observation becomes under the new one.

A source was judged by an old and a new policy, and each judgement that stood made an
observation. Each source gets a verdict: its old observation is replaced, invalidated, was so
already, or nothing may be written for a stated reason. Verdicts meet in components of sources,
observations, lineage and supersessions; where a safe write shares a component with an unsafe
one, or contradicts another write, the plan as a whole is tainted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.functions import prose as P
from loamlog.operators.components import checkpointed, coded, connected, encoded, reaching

#: Fixed values of the plan.
UNSAFE = (
    "shared_materialization_unsafe", "missing_unsafe", "ambiguous_unsafe", "imported_unsafe", "self_unsafe", "cycle_unsafe", "zone_unsafe", "lineage_unsafe",
    "conflicting_intent_unsafe",
)
WRITES = ("replace", "invalidate")
BUCKETS = {"replace": "eligible_write", "invalidate": "eligible_write", "already_applied": "eligible_noop"}
#: Taints of a component where an unsafe verdict of a reason stands in a tainted component.
CARRIED = {
    "imported_unsafe": "eligible_imported_shared_lineage_global_taint", "cycle_unsafe": "eligible_reachable_cycle_global_taint",
    "zone_unsafe": "eligible_cross_zone_global_taint", "conflicting_intent_unsafe": "conflicting_eligible_intent_global_taint",
}
#: Observations, judgements and reviews of a source beyond which its lineage counts as unproved.
MOST_OBSERVATIONS, MOST_JUDGEMENTS = 9, 3


def judged(judgements: DataFrame, reviews: DataFrame, policy: str, p: str) -> DataFrame:
    """source_id, and under ``policy``: how many judgements and reviews, the judgement, and which
    key an observation must have (``ordinary`` or ``held``; null if none may stand)."""
    said = judgements.where(F.col("policy") == policy).groupBy("source_id").agg(F.count("*").alias("n"), F.min("disposition").alias("said"))
    seen = reviews.where(F.col("policy") == policy).groupBy("source_id").agg(F.count("*").alias("m"), F.min("decision").alias("reviewed"))
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    key = F.when((n == 1) & (m == 0) & (F.col("said") == "promote"), "ordinary").when((n == 1) & (m == 1) & (F.col("said") == "hold") & (F.col("reviewed") == "promote"), "held")
    return said.join(seen, "source_id", "full").select("source_id", n.alias(f"{p}_n"), m.alias(f"{p}_m"), F.col("said").alias(f"{p}_said"), key.alias(f"{p}_key"))


def observed(observations: DataFrame, policy: str, p: str) -> DataFrame:
    """source_id, and under ``policy`` for each key: how many active observations, the first, the
    first imported one; the least and greatest subject."""
    rows = observations.where((F.col("policy") == policy) & (F.col("lifecycle") == "active"))
    of = lambda key, x: F.when(F.col("key") == key, x)
    per_key = [c for k in ("ordinary", "held") for c in (
        F.count(of(k, F.lit(1))).alias(f"{p}_{k}_n"), F.min(of(k, F.col("event_id"))).alias(f"{p}_{k}_id"),
        F.min(F.when(F.col("imported"), of(k, F.col("event_id")))).alias(f"{p}_{k}_imported"),
    )]
    return rows.groupBy("source_id").agg(*per_key, F.min("subject").alias(f"{p}_subject"), F.max("subject").alias(f"{p}_last_subject"))


def verdicts(sources: DataFrame, observations: DataFrame, judgements: DataFrame, reviews: DataFrame, relations: DataFrame, old: str, new: str) -> DataFrame:
    """One row per source: source_id, zone, target_id, replacement_id, verdict, conforms.

    sources (source_id, zone, subject, imported, conforms), observations (source_id, event_id,
    policy, key, subject, lifecycle, imported), judgements (source_id, policy, disposition),
    reviews (source_id, policy, decision), relations (event_id, zone, target, replacement, imported).
    A judged source without a row in ``sources`` has a null zone and is missing.
    """
    asked = judgements.where(F.col("policy").isin(old, new)).select("source_id").distinct()
    known = sources.withColumn("known", F.lit(True))
    counts = observations.where(F.col("policy").isin(old, new)).groupBy("source_id").agg(F.count("*").alias("n_observations"))
    rows = asked.join(known, "source_id", "left").join(counts, "source_id", "left")
    for policy, p in ((old, "old"), (new, "new")):
        rows = rows.join(judged(judgements, reviews, policy, p), "source_id", "left").join(observed(observations, policy, p), "source_id", "left")
        key = F.col(f"{p}_key")
        pick = lambda what: F.when(key == "ordinary", F.col(f"{p}_ordinary_{what}")).when(key == "held", F.col(f"{p}_held_{what}"))  # noqa: E731, B023
        n = lambda k: F.coalesce(F.col(f"{p}_{k}_n"), F.lit(0))  # noqa: E731, B023
        rows = rows.withColumns({
            f"{p}_n": F.coalesce(f"{p}_n", F.lit(0)), f"{p}_m": F.coalesce(f"{p}_m", F.lit(0)),
            f"{p}_targets": F.coalesce(pick("n"), F.lit(0)), f"{p}_id": pick("id"), f"{p}_imported": pick("imported"),
            f"{p}_wrong": ((n("ordinary") > 0) & ~key.eqNullSafe("ordinary")) | ((n("held") > 0) & ~key.eqNullSafe("held")),
            f"{p}_strange": F.coalesce((F.col(f"{p}_subject") != F.col("subject")) | (F.col(f"{p}_last_subject") != F.col("subject")), F.lit(False)),
        })
    rows = checkpointed(rows)
    # what is known of the old observation: its supersessions, and those that name the new one
    of_target = relations.groupBy(F.col("target").alias("t")).agg(
        F.count("*").alias("r_n"), F.min("zone").alias("r_zone"), F.max("zone").alias("r_last_zone"), F.count("replacement").alias("r_replaced"),
        F.count(F.when(F.col("replacement").isNull() & F.col("imported"), 1)).alias("r_dropped_imported"), F.count(F.when(F.col("replacement").isNull() & ~F.col("imported"), 1)).alias("r_dropped"),
    )
    of_pair = relations.where("replacement IS NOT NULL").groupBy(F.col("target").alias("pt"), F.col("replacement").alias("pr")).agg(F.count("*").alias("p_n"), F.max("imported").alias("p_imported"))
    links = relations.where("replacement IS NOT NULL").select(F.col("target").alias("a"), F.col("replacement").alias("b"))
    back = reaching(rows.select(F.col("new_id").alias("start"), F.col("old_id").alias("goal")), links)
    rows = rows.join(of_target, F.col("old_id") == F.col("t"), "left").join(of_pair, (F.col("old_id") == F.col("pt")) & (F.col("new_id") == F.col("pr")), "left")
    rows = rows.join(back.withColumn("cycle", F.lit(True)), (F.col("new_id") == F.col("start")) & (F.col("old_id") == F.col("goal")), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    some = lambda c, none: F.when(n(c) == 0, none)
    unproved = (n("n_observations") >= MOST_OBSERVATIONS) | (F.col("old_n") + F.col("new_n") >= MOST_JUDGEMENTS) | (F.col("old_m") + F.col("new_m") >= MOST_JUDGEMENTS)
    promoted = F.col("new_key").isNotNull()
    rejected = (F.col("new_said") == "reject") & (F.col("new_m") == 0)
    other_zone = (F.col("r_zone") != F.col("zone")) | (F.col("r_last_zone") != F.col("zone"))
    for_reject = (
        F.when(other_zone, "zone_unsafe").when(n("r_replaced") > 0, "conflicting_intent_unsafe").when(n("r_dropped_imported") > 0, "imported_unsafe")
        .when(n("r_dropped") == 1, "already_applied").when(n("r_dropped") > 1, "ambiguous_unsafe").otherwise("invalidate")
    )
    for_promote = (
        some("new_targets", "missing_unsafe").when(F.col("new_targets") > 1, "ambiguous_unsafe").when(other_zone, "zone_unsafe").when(F.col("p_imported"), "imported_unsafe")
        .when(F.col("cycle"), "cycle_unsafe").when(n("r_n") > n("p_n"), "conflicting_intent_unsafe").when(n("p_n") > 1, "ambiguous_unsafe")
        .when(n("p_n") == 1, "already_applied").otherwise("replace")
    )
    imported_ends = F.col("old_imported").isNotNull() | F.col("new_imported").isNotNull()
    self_made = (F.col("old_id") == F.col("source_id")) | (F.col("new_id") == F.col("source_id"))
    early = (
        F.when(F.col("known").isNull(), "missing_unsafe").when(F.col("imported"), "imported_unsafe").when(~F.col("conforms") | unproved, "lineage_unsafe")
        .when(F.col("old_strange") | F.col("new_strange"), "lineage_unsafe").when(F.col("old_wrong") | F.col("new_wrong"), "ambiguous_unsafe").when(imported_ends, "imported_unsafe")
        .when(F.col("new_n") == 0, "missing_unsafe").when(F.col("new_n") > 1, "ambiguous_unsafe")
        .when(~promoted & ~rejected, F.when(F.col("new_m") == 0, "missing_unsafe").otherwise("ambiguous_unsafe"))
        .when(F.col("old_targets") == 0, "missing_unsafe").when(F.col("old_targets") > 1, "ambiguous_unsafe").when(self_made, "self_unsafe")
    )
    verdict = F.coalesce(early, F.when(promoted, for_promote).otherwise(for_reject))
    # which ends a verdict names: imported ones if they stopped it, else those it got as far as
    at_imported = early.eqNullSafe("imported_unsafe") & imported_ends & F.col("known").isNotNull() & ~F.coalesce("imported", F.lit(False))
    named = early.isNull() | (early == "self_unsafe")
    target = F.when(at_imported, F.col("old_imported")).when(named, F.col("old_id"))
    replacement = F.when(at_imported, F.col("new_imported")).when(named & promoted & (F.col("new_targets") == 1), F.col("new_id"))
    proved = F.coalesce(F.col("known").isNull() | F.col("imported") | (F.col("conforms") & ~unproved), F.lit(True))
    return rows.select(
        "source_id", "zone", target.alias("target_id"), replacement.alias("replacement_id"), verdict.alias("verdict"), "subject",
        F.col("old_subject").alias("target_subject"), F.col("new_subject").alias("replacement_subject"), proved.alias("conforms"),
    )


def entries(candidates: DataFrame, lineage: DataFrame, relations: DataFrame) -> DataFrame:
    """Adds bucket, action, reason and component_id to verdicts.

    lineage (source_id, ref_id) and relations (target, replacement) join components as the
    verdicts' own ends do. A component's id is a digest of its number of vertices, the least of
    them and the sum of their hashes, so no list of them is ever made.
    """
    verdict = F.col("verdict")
    self_made = (F.col("target_id") == F.col("source_id")) | (F.col("replacement_id") == F.col("source_id"))
    ends = F.col("target_id").isNotNull() & ~F.coalesce(self_made, F.lit(False))
    holds = (
        F.when(verdict == "replace", ends & F.col("replacement_id").isNotNull() & (F.col("target_id") != F.col("replacement_id")))
        .when(verdict == "invalidate", ends & F.col("replacement_id").isNull()).when(verdict == "already_applied", ends)
    )
    reason = F.when(F.coalesce(holds, F.lit(False)), verdict).when(self_made, "self_unsafe").when(verdict.isin(*UNSAFE), verdict).otherwise("missing_unsafe")
    rows = candidates.withColumn("reason", reason)
    step = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    own = rows.select(F.explode(F.array(step("source_id", "source_id"), step("source_id", "target_id"), step("source_id", "replacement_id"))).alias("e")).select("e.*")
    edges = checkpointed(own.unionAll(lineage.select("source_id", "ref_id")).unionAll(relations.select("target", "replacement")).where("b IS NOT NULL").distinct())
    ids = encoded(edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node"))))
    linked = connected(coded(edges.where("a <> b"), ids))
    homes = checkpointed(ids.join(linked.withColumnRenamed("node", "id"), "id", "left").select("node", F.coalesce("component", "id").alias("least")))
    short = F.conv(F.substring(F.sha2("node", 256), 1, 12), 16, 10).cast("long")
    named = homes.groupBy("least").agg(F.count("*").alias("n"), F.sum(short).alias("total")).join(ids.select(F.col("id").alias("least"), "node"), "least")
    named = named.select("least", F.concat(F.lit("cmp:"), F.sha2(F.concat_ws(":", "n", "node", "total"), 256)).alias("component_id"))
    of = homes.join(named, "least").select(F.col("node").alias("source_id"), "component_id")
    buckets = F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv])
    return rows.join(of, "source_id").select(
        *[c for c in candidates.columns if c != "verdict"], F.coalesce(buckets[F.col("reason")], F.lit("unsafe_unchanged")).alias("bucket"),
        F.when(F.col("reason").isin(*BUCKETS), F.col("reason")).otherwise("none").alias("action"), "reason", "component_id",
    )


def taints(found: DataFrame, relations: DataFrame, given: tuple[str, ...] = (), truncated: bool = False) -> DataFrame:
    """zone, taint, component_id: what forbids the plan of a zone, and in which component.

    Null components stand for taints of the whole plan (``given`` ones, and an enumeration that
    was cut short).
    """
    eligible, unsafe = F.col("bucket") != "unsafe_unchanged", F.col("bucket") == "unsafe_unchanged"
    by = found.groupBy("zone", "component_id").agg(F.max(eligible).alias("some"), F.max(unsafe).alias("other")).where("some AND other")
    out = [by.select("zone", F.lit(t).alias("taint"), "component_id") for t in ("eligible_unsafe_overlap_global_taint", "unsafe_influences_eligible_global_taint")]
    writes = found.where("bucket = 'eligible_write' AND target_id IS NOT NULL")
    doubled = writes.groupBy("zone", "target_id").agg(F.count("*").alias("n")).where("n > 1")
    out.append(writes.join(doubled, ["zone", "target_id"], "left_semi").select("zone", F.lit("conflicting_eligible_intent_global_taint").alias("taint"), "component_id"))
    strange = (F.col("target_subject") != F.col("subject")) | (F.col("replacement_id").isNotNull() & (F.col("replacement_subject") != F.col("subject")))
    out.append(found.where(eligible & strange).select("zone", F.lit("eligible_subject_uncertainty_global_taint").alias("taint"), "component_id"))
    safe = found.where(eligible & F.col("replacement_id").isNotNull() & F.col("target_id").isNotNull())
    links = relations.where("replacement IS NOT NULL").select(F.col("target").alias("a"), F.col("replacement").alias("b"))
    links = links.unionAll(writes.where("replacement_id IS NOT NULL").select("target_id", "replacement_id"))
    back = reaching(safe.select(F.col("replacement_id").alias("start"), F.col("target_id").alias("goal")), links)
    round_ = safe.join(back, (F.col("replacement_id") == F.col("start")) & (F.col("target_id") == F.col("goal")), "left_semi")
    out.append(round_.select("zone", F.lit("eligible_reachable_cycle_global_taint").alias("taint"), "component_id"))
    out.append(found.where("NOT conforms").select("zone", F.lit("unproved_conformance_global_taint").alias("taint"), "component_id"))
    causal = out[0]
    for more in out[1:]:
        causal = causal.unionAll(more)
    causal = checkpointed(causal.distinct())
    carried = F.create_map(*[F.lit(x) for kv in CARRIED.items() for x in kv])[F.col("reason")]
    spread = found.where(unsafe).join(causal.select("zone", "component_id").distinct(), ["zone", "component_id"], "left_semi").select("zone", carried.alias("taint"), "component_id").where("taint IS NOT NULL")
    whole = (*given, *(["incomplete_enumeration_global_taint"] if truncated else []))
    zones = found.select("zone").distinct().select("zone", F.explode(F.array(*map(F.lit, whole))).alias("taint"), F.lit(None).cast("string").alias("component_id")) if whole else None
    out = causal.unionAll(spread)
    return (out if zones is None else out.unionAll(zones)).distinct()


def plan(found: DataFrame, tainted: DataFrame) -> DataFrame:
    """One row per zone: counts of buckets and actions, reason counts, taints with the number of
    components and entries in them, whether the plan may be carried out, whether its counts add
    up, and a digest over all of its entries."""
    n = lambda c, v: F.count(F.when(F.col(c) == v, 1))
    entry = P.stable_json_nulls(**{c: F.col(c) for c in ("source_id", "target_id", "replacement_id", "bucket", "action", "reason", "component_id")})
    hashed = lambda at: F.sum(F.conv(F.substring(F.sha2(entry, 256), at, 12), 16, 10).cast("decimal(20,0)"))
    counts = found.groupBy("zone").agg(
        F.count("*").alias("n_entries"), n("bucket", "eligible_write").alias("n_writes"), n("bucket", "eligible_noop").alias("n_noops"), n("bucket", "unsafe_unchanged").alias("n_unsafe"),
        n("action", "replace").alias("n_replace"), n("action", "invalidate").alias("n_invalidate"), n("action", "already_applied").alias("n_applied"),
        *[n("reason", r).alias(f"r_{r}") for r in UNSAFE], F.concat_ws(":", F.count("*"), hashed(1), hashed(13)).alias("sums"),
    )
    reasons = F.array(*[F.struct(F.lit(r).alias("reason"), F.col(c).alias("n")) for r, c in [*((r, f"r_{r}") for r in UNSAFE), ("replace", "n_replace"), ("invalidate", "n_invalidate"), ("already_applied", "n_applied")]])
    told = F.array_join(F.transform(F.array_sort(F.filter(reasons, lambda r: r["n"] > 0)), lambda r: F.concat(r["reason"], F.lit("="), r["n"].cast("string"))), ",")
    held = found.select("zone", "source_id", "component_id").join(tainted.select("zone", "component_id").distinct(), ["zone", "component_id"], "left_semi").groupBy(F.col("zone").alias("held_zone")).agg(F.count("*").alias("n_tainted"))
    why = tainted.groupBy(F.col("zone").alias("why_zone")).agg(F.array_join(F.sort_array(F.collect_set("taint")), ",").alias("taints"), F.count_distinct("component_id").alias("n_components"))
    rows = counts.join(why, F.col("zone").eqNullSafe(F.col("why_zone")), "left").join(held, F.col("zone").eqNullSafe(F.col("held_zone")), "left")
    sound = (F.col("n_replace") + F.col("n_invalidate") == F.col("n_writes")) & (F.col("n_applied") == F.col("n_noops")) & (F.col("n_writes") + F.col("n_noops") + F.col("n_unsafe") == F.col("n_entries"))
    none = F.lit(0).cast("long")
    return rows.select(
        "zone", "n_entries", "n_writes", "n_noops", "n_unsafe", "n_replace", "n_invalidate", "n_applied", told.alias("reasons"), F.coalesce("taints", F.lit("")).alias("taints"),
        F.coalesce("n_components", none).alias("n_tainted_components"), F.coalesce("n_tainted", none).alias("n_tainted_entries"), F.col("taints").isNull().alias("admissible"),
        sound.alias("sound"), P.digest(F.col("sums"), "sha256:").alias("plan_digest"),
    )
