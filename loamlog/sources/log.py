"""The knowledge log: typed events, erasures, capture origins and cursors.

``adapted`` reads the driver's ``events`` table as such a log. Its rules are fixed here and
written once more in SQL in ``loamlog.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the data model.
EVENT_TYPES = ("EvidenceArtifact", "Observation", "Claim", "AcceptanceDecision", "Supersession")
AUTHORITIES = ("unverified", "verified", "derived", "reported", "inferred", "asserted")
DECISIONS = ("accepted", "rejected", "needs_review")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_name(n: Column) -> Column:
    return F.concat(F.lit("evt_"), F.lpad(n.cast("string"), 9, "0"))


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: ids, type, zone, subject, lifecycle, authority, both time intervals,
    payload fields of every type (null where they do not apply), provenance target.

    Nothing here shuffles; ordered columns are added by the operators that need them.
    """
    kinds = F.create_map(*[F.lit(x) for pair in zip(("signup", "view", "click", "purchase", "error"), EVENT_TYPES, strict=True) for x in pair])
    n, k = F.col("n"), F.col("k")
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("n"), "ts", "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"),
        kinds[F.col("event_type")].alias("event_type"),
    )
    kind = F.col("event_type")
    hours = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(F.col("value") * 3600).cast("decimal(18,6)"))
    target = F.when(n - k - 1 >= 0, n - k - 1)
    return raw.select(
        "n", event_name(n).alias("event_id"), kind,
        F.concat(F.lit("tz_"), (F.col("user_id") % 4).cast("string")).alias("zone"),
        "user_id", F.concat(F.lit("subject_"), F.col("user_id").cast("string")).alias("subject"),
        F.when(n % 5 == 0, "draft").otherwise("active").alias("lifecycle"),
        pick(AUTHORITIES, F.floor(n / 11) % 6).alias("authority"),
        F.col("ts").alias("recorded"), F.col("ts").alias("valid_start"), (F.col("ts") + hours).alias("valid_end"),
        F.when(kind == "AcceptanceDecision", pick(DECISIONS, F.floor(n / 7) % 3)).alias("decision"),
        F.when(kind.isin("Observation", "Claim"), F.concat(F.lit("Statement "), k.cast("string"), F.lit(" about subject_"), F.col("user_id").cast("string"))).alias("statement"),
        target.alias("target_n"), event_name(target).alias("target_id"), "value", "k",
    )


def merged(local: DataFrame, inbox: DataFrame) -> DataFrame:
    """The events that a projection reads: local ones, and of the pulled inbox those that are
    not local. An event that arrived twice stands once, local before pulled, then the earlier."""
    both = local.withColumn("_from", F.lit(0)).unionByName(inbox.withColumn("_from", F.lit(1)))
    names = [c for c in local.columns if c != "event_id"]
    best = both.groupBy("event_id").agg(F.min_by(F.struct(*names, F.col("_from")), F.struct("_from", "recorded")).alias("e"))
    return best.select(*[F.col("event_id") if c == "event_id" else F.col(f"e.{c}").alias(c) for c in local.columns], F.when(F.col("e._from") == 0, "local").otherwise("inbox").alias("origin"))


def erasures(log: DataFrame) -> DataFrame:
    """The erasure ledger: every event whose number is divisible by 97 is erased a day later."""
    return log.where(F.col("n") % 97 == 0).select(
        F.concat(F.lit("ers_"), F.lpad(F.col("n").cast("string"), 9, "0")).alias("erasure_id"), F.col("event_id").alias("target_id"), "zone",
        (F.col("recorded") + F.expr("INTERVAL 1 DAY")).alias("requested"), F.col("n").alias("target_n"),
    )


def superseded(log: DataFrame) -> DataFrame:
    """event_id of all events that an active supersession replaces."""
    return log.where((F.col("event_type") == "Supersession") & F.col("target_id").isNotNull()).select(F.col("target_id").alias("event_id")).distinct()


def decisions(log: DataFrame) -> DataFrame:
    """Decisions with the claim they are about: the subject's latest claim before them.

    A subject's days are looked through on their own, and the last claim of its earlier days,
    one row a day, is carried over, so no subject has to fit into one task.
    """
    seen = log.where(F.col("event_type").isin("Claim", "AcceptanceDecision")).withColumn("_day", F.to_date("recorded"))
    claim = F.when(F.col("event_type") == "Claim", F.col("event_id"))
    days = seen.groupBy(F.col("user_id").alias("_u"), F.col("_day").alias("_d")).agg(F.max_by("event_id", F.when(F.col("event_type") == "Claim", F.struct("recorded", "n"))).alias("_claim"))
    earlier = Window.partitionBy("_u").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_earlier", F.last("_claim", ignorenulls=True).over(earlier)).drop("_claim")
    within = Window.partitionBy("user_id", "_day").orderBy("recorded", "n").rowsBetween(Window.unboundedPreceding, -1)
    rows = seen.withColumn("_within", F.last(claim, ignorenulls=True).over(within)).join(days, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("_day").eqNullSafe(F.col("_d")))
    rows = rows.withColumn("claim_id", F.coalesce("_within", "_earlier")).drop("_day", "_u", "_d", "_within", "_earlier")
    return rows.where((F.col("event_type") == "AcceptanceDecision") & F.col("claim_id").isNotNull())


def sequenced(log: DataFrame, zone: str = "zone", time: str = "recorded", tie: str = "n", into: str = "zone_sequence") -> DataFrame:
    """Gap-free numbers 1, 2, ... per zone in the order of time.

    A window over a whole zone would put a zone into one task. Days are numbered on their
    own, and the counts of a zone's earlier days, few and small, are added.
    """
    rows = log.withColumn("_day", F.to_date(time))
    counts = rows.groupBy(zone, "_day").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(zone).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(zone).alias("_z"), F.col("_day").alias("_d"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(zone, "_day").orderBy(time, tie))
    joined = rows.withColumn("_rank", within).join(offsets, F.col(zone).eqNullSafe(F.col("_z")) & F.col("_day").eqNullSafe(F.col("_d")))
    return joined.withColumn(into, (F.col("_before") + F.col("_rank")).cast("long")).drop("_day", "_z", "_d", "_before", "_rank")


def origins(log: DataFrame) -> DataFrame:
    """Capture origins of evidence: project, worktree and branch; rows without any facet go."""
    facet = lambda prefix, m: F.when(F.col("user_id") % m != 0, F.concat(F.lit(prefix), (F.col("user_id") % m).cast("string")))
    return log.where(F.col("event_type") == "EvidenceArtifact").select(
        "event_id", facet("prj_", 7).alias("project_id"), facet("wt_", 5).alias("worktree_id"),
    ).where("project_id IS NOT NULL OR worktree_id IS NOT NULL")
