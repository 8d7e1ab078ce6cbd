"""Queries over dispositions, admission, jobs and evaluation ledgers of the log, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.operators import metrics, queues
from loamlog.plans.oracle import LOG
from loamlog.sources import log as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def of_log(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(L.adapted(spark, sf_dir))


def admitted(log: DataFrame) -> DataFrame:
    """Events with the latest disposition of what they were derived from, under every policy and
    one that is not known."""
    last = queues.disposition_history(queues.dispositions(log)).groupBy(F.col("event_id").alias("of")).agg(F.max_by("disposition", "place").alias("disposition"))
    rows = log.join(last, F.col("target_id") == F.col("of"), "left")
    return queues.sync_admission(rows, (*queues.POLICIES[1:], "of another time"))


def ledgers(log: DataFrame) -> DataFrame:
    """A ledger a subject: each of its events is a case. What is draft was not attempted."""
    k, n = F.col("k"), F.col("n")
    return log.select(
        F.col("subject").alias("ledger"), (F.col("lifecycle") == "active").alias("attempted"), (F.col("event_type") != "Supersession").alias("eligible"),
        ((F.col("event_type") != "Supersession") | (k > 90)).alias("quality"), (k % 10 < 9).alias("reviewer"), (k % 3 > 0).alias("baseline"), (n % 4 == 1).alias("novel"), (n % 31 != 0).alias("stable"),
        (k * 60).alias("latency"), F.col("value").alias("cost"),
    )


of_log("sync_admission", admitted)
of_log("disposition_history", lambda log: queues.disposition_history(queues.dispositions(log)))
of_log("disposition_counts", lambda log: queues.disposition_counts(queues.dispositions(log)))
of_log("job_list", lambda log: queues.job_list(queues.outbox(log)))
of_log("evaluation_gates", lambda log: metrics.evaluation_gates(ledgers(log)))

B = metrics.BOUNDS
ORACLE_SQL: dict[str, str] = {
    "sync_admission": LOG + """,
        last AS (SELECT event_id AS of, arg_max(disposition, (created, policy)) AS said FROM dispositions GROUP BY 1),
        p AS (SELECT l.event_id, policy, CASE policy WHEN 'off' THEN 'admission_off' WHEN 'full_log' THEN 'full_log' ELSE
            CASE WHEN event_type = 'EvidenceArtifact' THEN 'thin_skip_raw_evidence' WHEN event_type NOT IN ('Observation', 'Claim') THEN 'thin_skip_event_type'
                WHEN lifecycle IN ('active', 'promoted') THEN 'thin_admit_active_unit' WHEN said = 'promote' THEN 'thin_admit_promoted_unit' ELSE 'thin_skip_draft_or_held_unit' END END AS reason
            FROM log l LEFT JOIN last ON last.of = l.target_id, (VALUES ('full_log'), ('off'), ('remote_thin_promoted_v1')) AS v(policy))
        SELECT event_id, policy, CASE WHEN reason = 'full_log' OR reason LIKE 'thin_admit%' THEN 'admit' ELSE 'skip' END AS decision, reason FROM p""",
    "disposition_history": LOG + """
        SELECT event_id, row_number() OVER w AS place, policy, disposition, created, lag(disposition) OVER w AS before FROM dispositions WINDOW w AS (PARTITION BY event_id ORDER BY created, policy)""",
    "disposition_counts": LOG + """,
        b AS (SELECT zone, policy, disposition FROM dispositions UNION ALL SELECT zone, 'latest', d FROM (SELECT zone, event_id, arg_max(disposition, (created, policy)) AS d FROM dispositions GROUP BY 1, 2))
        SELECT zone, policy, count(*) FILTER (disposition = 'promote') AS promote, count(*) FILTER (disposition = 'hold') AS hold, count(*) FILTER (disposition = 'reject') AS reject, count(*) AS total FROM b GROUP BY 1, 2""",
    "job_list": LOG + """
        SELECT * FROM (SELECT zone, state, row_number() OVER (PARTITION BY zone, state ORDER BY available_at, outbox_id) AS place, outbox_id, available_at FROM outbox) WHERE place <= 50""",
    "evaluation_gates": LOG + f""",
        c AS (SELECT subject AS ledger, event_type <> 'Supersession' AS eligible, event_type <> 'Supersession' OR k > 90 AS quality, k % 10 < 9 AS reviewer, k % 3 > 0 AS baseline, n % 4 = 1 AS novel, n % 31 <> 0 AS stable,
            k * 60 AS latency, value AS cost, row_number() OVER (PARTITION BY subject ORDER BY k) - 1 AS place, count(*) OVER (PARTITION BY subject) AS n FROM log WHERE lifecycle = 'active'),
        r AS (SELECT ledger, count(*) AS n, round(avg(quality::INT), 6) AS quality, round(avg(reviewer::INT), 6) AS reviewer, round(avg(baseline::INT), 6) AS baseline, round(avg(novel::INT), 6) AS novel,
            round(avg(1 - stable::INT), 6) AS drift, max(latency) FILTER (place = floor(n * 0.95)) AS p95_ms, round(sum(cost), 6) AS cost, bool_or(NOT eligible AND quality) AS claimed FROM c GROUP BY 1),
        b AS (SELECT *, concat_ws(',', CASE WHEN claimed THEN 'noneligible_claim' END, CASE WHEN quality < {B['quality']} THEN 'quality_below' END, CASE WHEN reviewer < {B['reviewer']} THEN 'reviewer_below' END,
            CASE WHEN baseline < {B['baseline']} THEN 'baseline_below' END, CASE WHEN novel > {B['novel']} THEN 'novel_above' END, CASE WHEN p95_ms > {B['p95_ms']} THEN 'p95_ms_above' END,
            CASE WHEN cost > {B['cost']} THEN 'cost_above' END, CASE WHEN drift > {B['drift']} THEN 'drift_above' END) AS blockers FROM r)
        SELECT ledger, n, quality, reviewer, baseline, novel, drift, p95_ms, cost, blockers, blockers = '' AS passes FROM b""",
}
