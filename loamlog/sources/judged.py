"""Judgements of evidence under two policies, and what was observed from them, over the log.

The driver's tables have none of these, so each is derived from the log's own rows and fields:
every evidence event is a source, each policy judges it, a judgement that stood made an
observation, and supersessions link observations of the evidence that they target. The number
``k`` of a source, modulo CASES, says in which way its records are irregular, so that every verdict
occurs. The same rules stand in SQL in ``loamlog.plans.reconcile_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.operators.components import checkpointed

OLD, NEW = "v1", "v2"
CASES = 23


def observation_id(n: Column, policy: Column | str) -> Column:
    return F.concat(F.lit("obs_"), F.lpad(n.cast("string"), 9, "0"), F.lit("_"), F.lit(policy) if isinstance(policy, str) else policy)


def staged(log: DataFrame) -> DataFrame:
    """The log's evidence and supersessions with the fields that are read here, laid down once:
    what is derived below reads them many times."""
    rows = log.where("event_type IN ('EvidenceArtifact', 'Supersession')")
    return checkpointed(rows.select("n", "event_id", "event_type", "zone", "subject", "k", "target_n", "target_id").repartition("n"))


def evidence(log: DataFrame) -> DataFrame:
    rows = log.where("event_type = 'EvidenceArtifact'").withColumn("c", F.col("k") % CASES)
    said = F.when(F.col("n") % 4 < 2, "promote").when(F.col("n") % 4 == 2, "reject").otherwise("hold")
    return rows.withColumn("old_said", F.when(F.col("c") == 0, "hold").otherwise("promote")).withColumn("new_said", said)


def sources(log: DataFrame) -> DataFrame:
    return evidence(log).where("c <> 15").select(F.col("event_id").alias("source_id"), "zone", "subject", (F.col("c") == 13).alias("imported"), (F.col("c") != 14).alias("conforms"))


def judgements(log: DataFrame) -> DataFrame:
    rows = evidence(log)
    times = F.when(F.col("c") == 9, 0).when(F.col("c") == 10, 2).otherwise(1)
    new = rows.select(F.col("event_id").alias("source_id"), F.lit(NEW).alias("policy"), F.col("new_said").alias("disposition"), F.explode(F.array_repeat(F.lit(1), times)).alias("x")).drop("x")
    return rows.select(F.col("event_id").alias("source_id"), F.lit(OLD).alias("policy"), F.col("old_said").alias("disposition")).unionAll(new)


def reviews(log: DataFrame) -> DataFrame:
    rows = evidence(log)
    old = rows.where("old_said = 'hold'").select(F.col("event_id").alias("source_id"), F.lit(OLD).alias("policy"), F.lit("promote").alias("decision"))
    decision = F.when(F.col("c") == 12, "reject").otherwise("promote")
    return old.unionAll(rows.where("new_said = 'hold' AND c <> 11").select(F.col("event_id").alias("source_id"), F.lit(NEW).alias("policy"), decision.alias("decision")))


def observations(log: DataFrame) -> DataFrame:
    """Two sources of one block of fifty numbers that are case 20 share their old observation."""
    rows, c = evidence(log), F.col("c")
    twice = lambda case: F.explode(F.when(c == case, F.array(F.lit(""), F.lit("b"))).otherwise(F.array(F.lit("")))).alias("again")
    own = F.when(c == 20, F.floor(F.col("n") / 50) * 50).otherwise(F.col("n"))
    old = rows.where("c <> 1").select("event_id", "subject", "c", own.alias("m"), F.when(c.isin(0, 3), "held").otherwise("ordinary").alias("key"), twice(2))
    old = old.select(
        F.col("event_id").alias("source_id"), F.concat(observation_id(F.col("m"), "1"), "again").alias("event_id"), F.lit(OLD).alias("policy"), "key", "subject",
        F.when(c == 16, "draft").otherwise("active").alias("lifecycle"), (c == 8).alias("imported"),
    )
    new = rows.where("new_said <> 'reject' AND c <> 4").select("event_id", "subject", "c", F.col("n").alias("m"), F.when(F.col("new_said") == "hold", "held").otherwise("ordinary").alias("key"), twice(5))
    return old.unionAll(new.select(
        F.col("event_id").alias("source_id"), F.concat(observation_id(F.col("m"), "2"), "again").alias("event_id"), F.lit(NEW).alias("policy"), "key",
        F.when(c == 6, "subject_other").otherwise(F.col("subject")).alias("subject"), F.lit("active").alias("lifecycle"), (c == 7).alias("imported"),
    ))


def relations(log: DataFrame) -> DataFrame:
    """Supersessions whose target is evidence, between that evidence's observations."""
    of = log.where("event_type = 'EvidenceArtifact'").select(F.col("event_id").alias("target_id"), F.col("zone").alias("of_zone"))
    rows = log.where("event_type = 'Supersession' AND target_id IS NOT NULL").join(of, "target_id")
    q, first, second = F.col("k") % 6, observation_id(F.col("target_n"), "1"), observation_id(F.col("target_n"), "2")
    return rows.select(
        "event_id", F.when(q == 5, F.col("zone")).otherwise(F.col("of_zone")).alias("zone"), F.when(q == 3, second).otherwise(first).alias("target"),
        F.when(q.isin(1, 2), second).when(q == 3, first).when(q == 4, observation_id(F.col("n"), "2")).alias("replacement"), (F.col("n") % 5 == 0).alias("imported"),
    )


def lineage(log: DataFrame) -> DataFrame:
    """Events that a source's observations name: themselves, and of some the source's own origin."""
    made = observations(log).where("lifecycle = 'active'").select("source_id", F.col("event_id").alias("ref_id"))
    return made.unionAll(evidence(log).where("c IN (17, 18, 19) AND target_id IS NOT NULL").select(F.col("event_id").alias("source_id"), F.col("target_id").alias("ref_id")))
