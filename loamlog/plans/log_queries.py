"""Queries over the log, its search and its bundles, and a few over documents, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.functions import prose as P
from loamlog.operators import bundles, facts, graph, intake, metrics, policy, queues, reconcile, records, retrieval, search, stages
from loamlog.operators.components import checkpointed
from loamlog.plans import reconcile_sql, signal_queries
from loamlog.plans.oracle import BUNDLE, LOG, LOG_RECURSIVE, TOKENS
from loamlog.plans.oracle import ORACLE_SQL as BASE_SQL
from loamlog.sources import judged as J
from loamlog.sources import log as L
from loamlog.sources import signals as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ZONES = ["tz_0", "tz_1", "tz_2"]
ASKED = search.Query("active claim statement 7 about subject_12 verified summary", ZONES, recorded=("2024-01-02 00:00:00", "2024-01-25 00:00:00"), projects=["prj_1", "prj_2", "prj_3"])
CONFIG = {"algorithm": "chunk_v1", "window": "none"}
ERRORS = ("HTTP 503 unavailable", "HTTP 400 bad input", "quota exceeded today", "HTTP 429 slow down", "timeout")


def of_log(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(L.adapted(spark, sf_dir))


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def seed_expansion(log: DataFrame) -> DataFrame:
    chunks = retrieval.chunks(log)
    top = retrieval.structured_topk(chunks, "active claim summary verified", 2000, 50)
    seeds = chunks.join(top.select("chunk_id"), "chunk_id", "left_semi").select("event_id")
    return search.expand(seeds, graph.edges(log).where(F.col("edge_kind").isin(*search.KNOWLEDGE)), chunks, ZONES, 2)


def bundle_files(log: DataFrame) -> DataFrame:
    """The files of a zone's bundle, and faulty ones where a supersession stands."""
    n = F.col("n")
    path = F.when(n % 4 == 0, F.concat(F.lit("/abs/"), "event_id", F.lit(".md"))).when(n % 4 == 1, "log.md").when(n % 4 == 2, F.concat(F.lit("claims/"), "event_id", F.lit(".txt")))
    odd = log.where("event_type = 'Supersession' AND zone = 'tz_1'").select(
        F.coalesce(path, F.concat(F.lit("claims/"), "event_id", F.lit(".md"))).alias("path"), F.lit("---\ntitle: x\n---\n[out](../../x.md) [there](claims/none.md) [web](https://a.b/c)\n").alias("body")
    )
    return bundles.documents_of(bundles.concepts(log, "tz_1")).unionAll(odd)


def spans(log: DataFrame) -> DataFrame:
    end = lambda p="": F.col(f"{p}k") + F.col(f"{p}user_id") % 20 + 1
    other = log.select(F.col("event_id").alias("target_id"), F.col("zone").alias("t_zone"), F.col("k").alias("t_k"), F.col("user_id").alias("t_user_id"))
    both = log.join(other, "target_id")
    cls = P.span_overlap((F.col("zone"), F.col("t_zone")), (F.col("k"), F.col("t_k")), (end(), end("t_")))
    return both.select("event_id", cls.alias("class"))


def retractions(log: DataFrame) -> DataFrame:
    asked = F.when(F.col("k") % 10 == 0, "").when(F.col("k") % 10 == 1, F.concat("event_id", F.lit("x"))).otherwise(F.col("event_id"))
    return stages.bulk_retract(log, log.select(asked.alias("event_id")), confirmed=True)


def claim_proposals(log: DataFrame) -> DataFrame:
    rows = log.where("event_type = 'Claim'").select("zone", "subject", "statement", F.col("target_id").alias("evidence_id"), F.concat(F.lit("k"), F.col("n").cast("string")).alias("key"))
    return intake.propose_claims(rows, log)


def jobs(log: DataFrame) -> DataFrame:
    state = L.pick(("pending", "leased", "failed", "done"), F.col("n") % 4)
    return log.select(
        F.col("n").alias("job_id"), state.alias("state"), (F.col("n") % 5).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"), (F.col("k") % 2 == 0).alias("lease_expired"),
        F.when(F.col("n") % 4 == 2, L.pick(ERRORS, F.col("k") % 5)).alias("error"),
    )


def links(log: DataFrame) -> DataFrame:
    n, k = F.col("n"), F.col("k")
    later = F.when(n % 4 == 2, n - F.floor(k / 2) - 1).when(n % 4 == 0, F.col("target_n") - k % 7)
    return log.where("event_type = 'Supersession' AND target_n IS NOT NULL").select(F.col("event_id").alias("source"), F.col("target_id").alias("target"), L.event_name(F.when(later >= 0, later)).alias("replacement"))


of_log("seed_expansion", seed_expansion)
of_log("memory_search", lambda log: search.search(log, ASKED))
of_log("record_refs", lambda log: search.record_refs(retrieval.chunks(log), log))
of_log("related_records", lambda log: search.related(log, log.where("event_type = 'Claim'")))
of_log("concept_map", lambda log: bundles.concepts(log, "tz_1"))
of_log("bundle_index", lambda log: bundles.index_lines(bundles.concepts(log, "tz_1")))
of_log("bundle_log", lambda log: bundles.log_line(bundles.concepts(log, "tz_1"), "2024-02-01"))
of_log("bundle_conformance", lambda log: bundles.conformance(bundle_files(log)))
of_log("derivations", lambda log: bundles.derivations(log, CONFIG))
of_log("compactions", bundles.compaction)
of_log("density_uplift", lambda log: metrics.density_uplift(
    metrics.graph_snapshot(graph.nodes(log).where("node_kind = 'evidence'"), graph.edges(log).where("edge_kind IN ('belongs_to', 'observed_in')")),
    metrics.graph_snapshot(graph.nodes(log), graph.edges(log)),
))
of_log("promote_metrics", lambda log: stages.promote_metrics(queues.dispositions(log).join(log.select("event_id", "statement"), "event_id")))
of_log("reconcile_units", stages.units)
of_log("reconcile_receipts", lambda log: stages.receipts(log, stages.reports(log.where("recorded < '2024-01-10 12:00:00'"))))
of_log("bulk_retract", retractions)
of_log("claim_proposals", claim_proposals)
of_log("span_overlaps", spans)
of_log("job_queue", lambda log: queues.job_step(jobs(log)))
of_log("canonical_recheck", lambda log: search.canonical_recheck(retrieval.chunks(log), log, search.Query("", ZONES, projects=["prj_1", "prj_2", "prj_3", "prj_4"]), ["tz_2"]))
of_log("merged_log", lambda log: L.merged(log.where("zone <> 'tz_3' OR k % 2 = 0"), log.where("zone IN ('tz_2', 'tz_3')")).select("event_id", "zone", "origin"))
of_log("graph_neighborhood", lambda log: graph.neighborhood(log.where("event_type = 'Supersession'").select(F.concat(F.lit("evt:"), "event_id").alias("seed")), graph.edges(log).where(F.col("edge_kind").isin(*search.KNOWLEDGE)), 2, 5))
of_log("retry_times", lambda log: queues.retry_times(jobs(log).join(log.select(F.col("n").alias("job_id"), F.col("recorded").alias("failed_at")), "job_id")))
of_log("bundle_rows", lambda log: records.import_rows(log.where("recorded < '2024-01-15'"), records.bundle(log)))
of_log("reconcile_components", lambda log: policy.supersession_components(links(log)))


def reconciled(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries of all sources, and the relations between observations."""
    log = J.staged(log)
    relations = checkpointed(J.relations(log))
    found = reconcile.verdicts(J.sources(log), J.observations(log), J.judgements(log), J.reviews(log), relations, J.OLD, J.NEW)
    return reconcile.entries(checkpointed(found), J.lineage(log), relations), relations


def reconcile_taints(log: DataFrame) -> DataFrame:
    found, relations = reconciled(log)
    return reconcile.taints(checkpointed(found), relations)


def reconcile_plan(log: DataFrame) -> DataFrame:
    found, relations = reconciled(log)
    found = checkpointed(found)
    return reconcile.plan(found, checkpointed(reconcile.taints(found, relations)))


of_log("reconcile_verdicts", lambda log: reconciled(log)[0].select("source_id", "zone", "target_id", "replacement_id", "bucket", "action", "reason", "conforms", "component_id"))
of_log("reconcile_taints", reconcile_taints)
of_log("reconcile_plan", reconcile_plan)


@query
def stable_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = L.adapted(spark, sf_dir)
    fields = {c: F.col(c) for c in ("zone", "event_id", "k", "decision", "statement")}
    return log.select("event_id", P.digest(P.stable_json(**fields)).alias("digest"), P.stable_length(**fields).alias("length"))


@query
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table(spark, sf_dir, "documents").select("doc_id", P.approximate_tokens(F.col("text")).alias("n_words"), F.length("text").alias("n_scalars"))


@query
def dev_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.embedded(L.table(spark, sf_dir, "documents"), "deterministic-local-dev")
    value = lambda i: F.round(F.element_at("vector", i), 6)
    return rows.select("doc_id", F.size("vector").alias("n"), value(1).alias("first"), value(32).alias("last_byte"), value(33).alias("again"), value(768).alias("last"))


@query
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.tree_digest(L.table(spark, sf_dir, "benchmark"), "item_id", F.concat_ws(":", F.col("item_id").cast("string"), "text"))


@query
def metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = L.table(spark, sf_dir, "documents"), L.table(spark, sf_dir, "benchmark")
    ranked = retrieval.lexical_topk(items, docs, 10)
    quality = metrics.retrieval_quality(ranked, metrics.containing(items, docs))
    return metrics.metric_gates(quality, signal_queries.confusion(S.signals(spark, sf_dir)))


@query
def graph_rank_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = L.table(spark, sf_dir, "documents"), L.table(spark, sf_dir, "benchmark")
    ranked = retrieval.lexical_topk(items, docs, 10)
    kind = L.pick(("claim", "summary", "evidence_excerpt", "decision"), F.col("doc_id") % 4)
    rows = ranked.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", F.col("text").alias("query")), "item_id")
    return metrics.rank_hits(rows.select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("chunk_id"), kind.alias("kind"),
        F.when(F.col("doc_id") % 3 == 0, "draft").otherwise("active").alias("lifecycle"), "query", "text", ((F.col("rank") - 1) % 3).alias("hop"),
        (F.col("rank") == 1).alias("expected"), (kind == "evidence_excerpt").alias("forbidden"),
    ))


HOPS = """,
inside AS (SELECT DISTINCT 'evt:' || event_id AS id FROM chunks WHERE zone IN ('tz_0', 'tz_1', 'tz_2')),
near AS (SELECT from_id, to_id FROM edges WHERE edge_kind IN ('derived_from', 'supports', 'supersedes', 'accepted_by') AND from_id IN (SELECT id FROM inside) AND to_id IN (SELECT id FROM inside)),
adj AS (SELECT from_id AS a, to_id AS b FROM near UNION SELECT to_id, from_id FROM near),
h1 AS (SELECT 'evt:' || event_id AS node, 0 AS hop FROM seeds UNION ALL SELECT b, 1 FROM adj JOIN seeds ON a = 'evt:' || event_id),
h2 AS (SELECT node, hop FROM h1 UNION ALL SELECT b, 1 FROM h1 JOIN adj ON a = node)"""
CONCEPTS = """,
units AS (SELECT * FROM eligible WHERE zone = 'tz_1' AND (event_type = 'Observation' OR (event_type = 'Claim' AND event_id IN (SELECT event_id FROM category WHERE category = 'accepted')))),
picked AS (SELECT * FROM units UNION ALL SELECT * FROM eligible WHERE zone = 'tz_1' AND event_type = 'EvidenceArtifact' AND event_id IN (SELECT target_id FROM units)),
folders AS (SELECT * FROM (VALUES ('Claim', 'claims'), ('Observation', 'observations'), ('EvidenceArtifact', 'evidence')) AS v(event_type, folder)),
concepts AS (
    SELECT f.folder || '/' || p.event_id || '.md' AS path, lower(p.event_type) AS type, coalesce(p.statement, 'Evidence of ' || p.subject) AS title,
        CASE WHEN p.event_type <> 'EvidenceArtifact' THEN g.folder || '/' || t.event_id || '.md' END AS source_path, p.event_id
    FROM picked p JOIN folders f USING (event_type) LEFT JOIN log t ON t.event_id = p.target_id LEFT JOIN folders g ON g.event_type = t.event_type)"""
FILES = CONCEPTS + """,
files AS (
    SELECT path, '---' || chr(10) || 'type: ' || type || chr(10) || 'title: ' || title || chr(10) || '---' || chr(10) || '# ' || title || chr(10)
        || coalesce(chr(10) || 'Source: [source](../' || source_path || ')' || chr(10), '') AS body FROM concepts
    UNION ALL
    SELECT CASE n % 4 WHEN 0 THEN '/abs/' || event_id || '.md' WHEN 1 THEN 'log.md' WHEN 2 THEN 'claims/' || event_id || '.txt' ELSE 'claims/' || event_id || '.md' END,
        '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || '[out](../../x.md) [there](claims/none.md) [web](https://a.b/c)' || chr(10)
    FROM log WHERE event_type = 'Supersession' AND zone = 'tz_1'),
safe AS (SELECT *, NOT starts_with(path, '/') AND NOT contains(path, '..') AND path <> '' AS ok FROM files),
raw_links AS (SELECT path, unnest(regexp_extract_all(body, '\\]\\(([^)]+)\\)', 1)) AS link FROM files),
links AS (SELECT path, regexp_replace(link, '^\\.\\./', '') AS target FROM raw_links WHERE NOT regexp_matches(link, '^[a-z]+:'))"""
SNAPSHOT = """(SELECT count(*) AS units, round(coalesce(avg(degree), 0), 6) AS mean_degree, coalesce(bool_and(derived > 0), TRUE) AS all_derived, coalesce(bool_and(about > 0), TRUE) AS all_about FROM (
        SELECT u.node_id, count(e.unit) AS degree, count(e.unit) FILTER (e.own AND e.edge_kind = 'derived_from') AS derived, count(e.unit) FILTER (e.own AND e.edge_kind = 'about') AS about
        FROM (SELECT node_id FROM nodes WHERE node_kind = 'meaning_unit' AND {units}) u LEFT JOIN (
            SELECT edge_kind, from_id AS unit, TRUE AS own FROM edges WHERE {edges} UNION ALL SELECT edge_kind, to_id, FALSE FROM edges WHERE {edges}) e ON e.unit = u.node_id GROUP BY 1)),
    (SELECT count(*) AS edges, count(*) FILTER (edge_kind = 'derived_from') AS derived_from, count(*) FILTER (edge_kind = 'about') AS about FROM edges WHERE {edges})"""
REPORTS = """(SELECT zone, day, 'sha256:' || sha256('{{"day":"' || day || '","n_draft":' || d || ',"n_units":' || n || ',"zone":"' || zone || '"}}') AS output_digest FROM (
        SELECT zone, strftime(recorded, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (lifecycle = 'draft') AS d
        FROM log WHERE event_type IN ('Observation', 'Claim') AND {where} GROUP BY 1, 2))"""

ORACLE_SQL: dict[str, str] = {
    "seed_expansion": LOG + """,
        newest AS (SELECT * FROM chunk_ids WHERE status = 'active' ORDER BY zone_sequence DESC, chunk_id LIMIT 2000),
        scored AS (SELECT event_id, zone_sequence, chunk_id, round(least(1.0, len(list_filter(regexp_split_to_array(lower(chunk_kind || ' ' || lifecycle || ' ' || authority), '[^a-z0-9]+'),
            lambda x: x IN ('active', 'claim', 'summary', 'verified'))) / 4), 6) AS score FROM newest),
        seeds AS (SELECT event_id FROM scored WHERE score > 0 ORDER BY score DESC, zone_sequence DESC, chunk_id LIMIT 50)""" + HOPS + """
        SELECT chunk_id, min(hop) AS hop FROM chunk_ids c JOIN h2 ON node = 'evt:' || c.event_id WHERE zone IN ('tz_0', 'tz_1', 'tz_2') GROUP BY 1""",
    "memory_search": LOG + """,
        asked AS (SELECT ['active', 'claim', 'statement', '7', 'about', 'subject', '12', 'verified', 'summary'] AS q),
        matched AS (SELECT c.*, round(len(list_filter(q, lambda x: list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), x))) / 9, 6) AS fts,
            round(least(1.0, len(list_filter(regexp_split_to_array(lower(chunk_kind || ' ' || lifecycle || ' ' || authority), '[^a-z0-9]+'), lambda x: list_contains(q, x))) / 9), 6) AS structured
            FROM chunk_ids c, asked WHERE zone IN ('tz_0', 'tz_1', 'tz_2')),
        seeds AS (SELECT DISTINCT event_id FROM (SELECT * FROM matched WHERE fts > 0 OR structured > 0 ORDER BY fts + structured DESC, chunk_id LIMIT 80))""" + HOPS + """,
        hops AS (SELECT node, min(hop) AS hop FROM h1 GROUP BY 1),
        kept AS (SELECT m.*, hop, l.event_type, l.target_id, t.event_id IS NOT NULL AS there FROM matched m JOIN hops ON node = 'evt:' || m.event_id JOIN log l ON l.event_id = m.event_id LEFT JOIN log t ON t.event_id = l.target_id
            WHERE l.n % 17 <> 0 AND l.n % 13 <> 0 AND l.event_id NOT IN (SELECT target_id FROM erasures) AND l.lifecycle = 'active' AND l.authority <> 'unverified' AND l.event_id NOT IN (SELECT event_id FROM superseded)
            AND l.recorded BETWEEN '2024-01-02' AND '2024-01-25' AND l.event_id IN (SELECT event_id FROM inherited WHERE project_id IS NULL OR project_id IN ('prj_1', 'prj_2', 'prj_3'))),
        priced AS (SELECT *, CASE chunk_kind WHEN 'claim' THEN 1.0 WHEN 'decision' THEN 0.95 WHEN 'summary' THEN 0.9 ELSE 0.2 END AS p FROM kept),
        totals AS (SELECT *, round(structured + p * 0.4 + CASE WHEN chunk_kind = 'evidence_excerpt' THEN 0 ELSE 0.45 * p END + CASE hop WHEN 0 THEN 0.2 ELSE 0.12 END + fts, 6) AS total FROM priced)
        SELECT chunk_id, event_id AS record_id, 'event' AS record_kind, event_type, zone, lifecycle, authority, CASE WHEN there THEN least(event_id, target_id) || ',' || greatest(event_id, target_id) ELSE event_id END AS source_event_ids,
            CASE WHEN status = 'projection_deleted' THEN 'protected_value' END AS redactions, hop, fts, structured, total FROM totals ORDER BY total DESC, p DESC, fts DESC, chunk_id LIMIT 20""",
    "record_refs": LOG + """
        SELECT chunk_id, c.event_id AS record_id, 'event' AS record_kind, l.event_type, c.zone, c.lifecycle, c.authority,
            CASE WHEN t.event_id IS NOT NULL THEN least(l.event_id, t.event_id) || ',' || greatest(l.event_id, t.event_id) ELSE l.event_id END AS source_event_ids,
            CASE WHEN status = 'projection_deleted' THEN 'protected_value' END AS redactions
        FROM chunk_ids c JOIN log l ON l.event_id = c.event_id LEFT JOIN log t ON t.event_id = l.target_id""",
    "related_records": LOG + """,
        roots AS (SELECT event_id AS root_id, event_id AS node, 0 AS hop FROM log WHERE event_type = 'Claim'),
        r1 AS (SELECT root_id, l.target_id AS node FROM roots JOIN log l ON l.event_id = node WHERE l.target_id IS NOT NULL),
        r2 AS (SELECT root_id, l.target_id AS node FROM r1 JOIN log l ON l.event_id = node WHERE l.target_id IS NOT NULL),
        b AS (SELECT root_id, node, 0 AS how FROM roots UNION ALL SELECT *, 0 FROM r1 UNION ALL SELECT *, 0 FROM r2 UNION ALL SELECT claim_id, event_id, 1 FROM decisions)
        SELECT root_id, node AS record_id, CASE WHEN max(how) = 1 THEN 'decision' ELSE 'trace' END AS via FROM b WHERE node IN (SELECT event_id FROM log) GROUP BY 1, 2""",
    "concept_map": LOG + CONCEPTS + "SELECT * FROM concepts",
    "bundle_index": LOG + CONCEPTS + "SELECT split_part(path, '/', 1) AS section, path, '* [' || title || '](' || path || ') - ' || type AS line FROM concepts",
    "bundle_log": LOG + CONCEPTS + "SELECT '2024-02-01' AS day, '* **Export**: ' || count(*) || ' concepts.' AS line FROM concepts",
    "bundle_conformance": LOG + FILES + """
        SELECT DISTINCT path, code, severity FROM (
            SELECT path, 'invalid_path' AS code, 'error' AS severity FROM safe WHERE NOT ok
            UNION ALL SELECT path, 'reserved_path', 'error' FROM safe WHERE ok AND path IN ('index.md', 'log.md', 'manifest.json')
            UNION ALL SELECT path, 'not_markdown', 'error' FROM safe WHERE ok AND NOT ends_with(path, '.md') AND path NOT IN ('index.md', 'log.md', 'manifest.json')
            UNION ALL SELECT path, 'invalid_front_matter', 'error' FROM safe WHERE NOT regexp_matches(body, '^---\\n(?s:.*?)\\n---\\n')
            UNION ALL SELECT path, 'missing_type', 'error' FROM safe WHERE regexp_matches(body, '^---\\n') AND NOT regexp_matches(body, '\\ntype: \\S')
            UNION ALL SELECT path, 'duplicate_path', 'error' FROM files GROUP BY path HAVING count(*) > 1
            UNION ALL SELECT path, 'link_escapes_bundle', 'error' FROM links WHERE contains(target, '..')
            UNION ALL SELECT path, 'unresolved_link', 'warning' FROM links WHERE NOT contains(target, '..') AND target NOT IN (SELECT path FROM files))""",
    "derivations": LOG + """,
        r AS (SELECT event_id AS of, zone, lpad(CAST(zone_sequence AS VARCHAR), 16, '0') AS q, event_id AS id, recorded FROM seq
            UNION SELECT a.event_id, b.zone, lpad(CAST(b.zone_sequence AS VARCHAR), 16, '0'), b.event_id, b.recorded FROM seq a JOIN seq b ON b.event_id = a.target_id)
        SELECT of AS event_id, 'sha-256:' || sha256('{"algorithm":"chunk_v1","window":"none"}') AS config_digest,
            'sha-256:' || sha256('[' || string_agg('{"id":"' || id || '","sequence":"' || q || '","zone":"' || zone || '"}', ',' ORDER BY zone, q, id) || ']') AS input_digest,
            max(strftime(recorded, '%Y-%m-%d %H:%M:%S.%f')) AS latest_recorded FROM r GROUP BY 1""",
    "compactions": LOG + """,
        j AS (SELECT zone, strftime(recorded, '%Y-%m-%d') AS day, string_agg(trim(statement), chr(10) ORDER BY recorded, n) AS t, count(*) AS n_items FROM log WHERE statement IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT *, CASE WHEN length(t) > 2000 THEN substr(t, 1, 1999) || '…' ELSE t END AS summary FROM j)
        SELECT 'cmp_' || substr(sha256('{"created":"' || day || '","summary":"' || sha256(summary) || '","zone":"' || zone || '"}'), 1, 32) AS compaction_id, zone, day, n_items,
            length(summary) AS used_characters, length(t) > 2000 AS truncated, greatest(0, length(t) - length(summary)) AS omitted_characters FROM s""",
    "density_uplift": LOG + f""",
        b AS (SELECT * FROM {SNAPSHOT.format(units="FALSE", edges="edge_kind IN ('belongs_to', 'observed_in')")}), a AS (SELECT * FROM {SNAPSHOT.format(units="TRUE", edges="TRUE")}),
        d AS (SELECT a.units - b.units AS units_delta, a.edges - b.edges AS edges_delta, a.derived_from - b.derived_from AS derived_from_delta, a.about - b.about AS about_delta, round(a.mean_degree - b.mean_degree, 6) AS mean_degree_delta,
            list_filter([CASE WHEN a.units - b.units < 1 THEN 'insufficient_new_meaning_units' END, CASE WHEN a.derived_from - b.derived_from < 1 AND a.derived_from < 1 THEN 'no_derived_from_uplift' END,
                CASE WHEN a.units > 0 AND NOT a.all_derived THEN 'meaning_units_missing_derived_from' END, CASE WHEN a.units > 0 AND NOT a.all_about THEN 'meaning_units_missing_about' END,
                CASE WHEN a.edges <= b.edges THEN 'no_knowledge_edge_uplift' END], lambda x: x IS NOT NULL) AS r FROM a, b)
        SELECT * EXCLUDE r, len(r) = 0 AS passes, CASE WHEN len(r) = 0 THEN 'graph_density_uplift_ok' ELSE array_to_string(r, ',') END AS reasons FROM d""",
    "promote_metrics": LOG + """,
        m AS (SELECT d.created, (SELECT max(created) FROM dispositions) AS now, regexp_matches(statement, '(?i)hook event is SessionEnd|session id is|The agent type is|agentic\\.evidence|hook_event_name') AS meta
            FROM dispositions d JOIN log l USING (event_id) WHERE disposition = 'promote'),
        c AS (SELECT count(*) AS promote_total, count(*) FILTER (created >= now - INTERVAL 7 DAY) AS in_window, count(*) FILTER (meta) AS metadata FROM m)
        SELECT *, in_window >= 30 AND metadata = 0 AS passes FROM c""",
    "reconcile_units": LOG + """
        SELECT event_id, event_type, statement, lifecycle AS lifecycle_status, subject AS subject_ref, CASE WHEN event_type = 'Claim' THEN CASE WHEN k % 2 = 0 THEN 'factual' ELSE 'decision' END END AS kind_hint
        FROM log WHERE event_type IN ('Observation', 'Claim')""",
    "reconcile_receipts": LOG + f""",
        new AS {REPORTS.format(where="TRUE")}, old AS {REPORTS.format(where="recorded < '2024-01-10 12:00:00'")}
        SELECT zone, day, output_digest, 'rc_' || substr(output_digest, 8, 24) AS receipt_id FROM new WHERE substr(output_digest, 8, 24) NOT IN (SELECT substr(output_digest, 8, 24) FROM old)""",
    "bulk_retract": LOG + """,
        a AS (SELECT CASE k % 10 WHEN 0 THEN '' WHEN 1 THEN event_id || 'x' ELSE event_id END AS event_id FROM log),
        r AS (SELECT a.event_id, CASE WHEN trim(a.event_id) = '' THEN 'invalid_event_id' WHEN l.event_id IS NULL THEN 'not_found' WHEN l.event_type NOT IN ('Observation', 'Claim') THEN 'not_a_unit'
            WHEN e.target_id IS NOT NULL THEN 'erased' END AS reason FROM a LEFT JOIN log l ON l.event_id = a.event_id LEFT JOIN erasures e ON e.target_id = a.event_id)
        SELECT event_id, CASE WHEN reason IS NULL THEN 'applied' ELSE 'refused' END AS status, reason FROM r""",
    "claim_proposals": LOG + """,
        p AS (SELECT 'k' || l.n AS key, l.zone, l.subject, l.statement, CASE WHEN length(trim(l.statement)) < 8 THEN 'statement_too_short' WHEN t.event_id IS NULL THEN 'evidence_not_found'
            WHEN t.zone <> l.zone THEN 'evidence_of_another_zone' END AS fault FROM log l LEFT JOIN log t ON t.event_id = l.target_id WHERE l.event_type = 'Claim')
        SELECT key, zone, subject, fault, CASE WHEN fault IS NULL THEN 'evt_' || substr(sha256(zone || ':' || key || ':' || sha256(statement)), 1, 32) END AS event_id, CASE WHEN fault IS NULL THEN 'draft' END AS lifecycle FROM p""",
    "canonical_recheck": LOG + """,
        r AS (SELECT c.chunk_id, c.chunk_kind, l.zone, l.lifecycle, l.authority, t.zone AS tz, t.lifecycle AS tl, t.authority AS ta, i.project_id, coalesce(f.accepted AND f.rejected, FALSE) AS conflict,
            l.event_id IN (SELECT event_id FROM superseded) OR coalesce(t.event_id IN (SELECT event_id FROM superseded), FALSE) AS replaced,
            l.event_id IN (SELECT target_id FROM erasures) OR coalesce(t.event_id IN (SELECT target_id FROM erasures), FALSE) AS erased
            FROM chunk_ids c JOIN log l ON l.event_id = c.event_id LEFT JOIN log t ON t.event_id = l.target_id LEFT JOIN inherited i ON i.event_id = l.event_id LEFT JOIN flags f ON f.claim_id = l.event_id),
        w AS (SELECT *, CASE WHEN zone = 'tz_2' OR coalesce(tz = 'tz_2', FALSE) THEN 'projection_stale' WHEN zone = 'tz_3' OR coalesce(tz = 'tz_3', FALSE) THEN 'zone_not_visible'
            WHEN lifecycle <> 'active' OR coalesce(tl <> 'active', FALSE) THEN 'lifecycle_excluded' WHEN project_id NOT IN ('prj_1', 'prj_2', 'prj_3', 'prj_4') THEN 'project_scope_excluded'
            WHEN authority = 'unverified' OR coalesce(ta = 'unverified', FALSE) THEN 'authority_excluded' WHEN replaced THEN 'superseded' WHEN erased THEN 'erased' WHEN conflict THEN 'conflicting_decisions'
            WHEN chunk_kind = 'evidence_excerpt' THEN 'protected_value_denied' END AS reason FROM r)
        SELECT chunk_id, CASE WHEN reason IS NULL THEN 'visible' WHEN reason = 'protected_value_denied' THEN 'redacted' ELSE 'excluded' END AS status, reason FROM w""",
    "merged_log": LOG + "SELECT event_id, zone, CASE WHEN zone <> 'tz_3' OR k % 2 = 0 THEN 'local' ELSE 'inbox' END AS origin FROM log",
    "graph_neighborhood": LOG + """,
        adj AS (SELECT DISTINCT * FROM (SELECT from_id AS a, to_id AS b FROM edges WHERE edge_kind IN ('derived_from', 'supports', 'supersedes', 'accepted_by')
            UNION ALL SELECT to_id, from_id FROM edges WHERE edge_kind IN ('derived_from', 'supports', 'supersedes', 'accepted_by'))),
        w0 AS (SELECT 'evt:' || event_id AS seed, 'evt:' || event_id AS node_id, 0 AS hop FROM log WHERE event_type = 'Supersession'),
        w1 AS (SELECT seed, b AS node_id, 1 AS hop FROM w0 JOIN adj ON a = node_id), w2 AS (SELECT seed, b AS node_id, 2 AS hop FROM w1 JOIN adj ON a = node_id),
        n AS (SELECT seed, node_id, min(hop) AS hop FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2) GROUP BY 1, 2)
        SELECT seed, node_id, hop FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, node_id) AS place FROM n) WHERE place <= 5""",
    "retry_times": LOG + """,
        j AS (SELECT n AS job_id, n % 5 AS attempt, recorded AS failed_at, CAST(k % 5 AS INT) AS e FROM log WHERE n % 4 = 2 AND n % 5 < 3)
        SELECT job_id, CASE WHEN e = 2 THEN date_trunc('day', failed_at) + INTERVAL 1 DAY
            ELSE date_trunc('millisecond', failed_at) + to_milliseconds(CAST(pow(2, greatest(1, attempt) - 1) AS BIGINT) * 1000 + ('0x' || substr(sha256(job_id || ':' || attempt), 1, 6))::BIGINT % 1000) END AS retry_at
        FROM j WHERE e <> 1""",
    "bundle_rows": LOG + BUNDLE.replace(" LIMIT 100", "") + """
        SELECT 'evt_' || substr(sha256('import:' || sha256(statement)), 1, 32) AS event_id, event_type, statement, 'draft' AS lifecycle, sha256(statement) AS idempotency_key
        FROM bundle WHERE length(trim(statement)) >= 8 AND statement NOT IN (SELECT statement FROM log WHERE recorded < '2024-01-15' AND statement IS NOT NULL)""",
    "span_overlaps": LOG + """,
        s AS (SELECT a.event_id, a.zone AS z1, b.zone AS z2, a.k AS a1, a.k + a.user_id % 20 + 1 AS b1, b.k AS a2, b.k + b.user_id % 20 + 1 AS b2 FROM log a JOIN log b ON b.event_id = a.target_id)
        SELECT event_id, CASE WHEN z1 <> z2 THEN 'none' WHEN a1 = a2 AND b1 = b2 THEN 'duplicate' WHEN a1 >= b2 OR a2 >= b1 THEN 'none'
            WHEN (a1 <= a2 AND b1 >= b2) OR (a2 <= a1 AND b2 >= b1) THEN 'containment' ELSE 'crossing' END AS class FROM s""",
    "stable_payloads": LOG + """,
        j AS (SELECT event_id, '{' || coalesce('"decision":"' || decision || '",', '') || '"event_id":"' || event_id || '","k":' || k || coalesce(',"statement":"' || statement || '"', '') || ',"zone":"' || zone || '"}' AS j FROM log)
        SELECT event_id, 'sha-256:' || sha256(j) AS digest, length(j) AS length FROM j""",
    "text_scalars": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words, length(text) AS n_scalars FROM documents",
    "dev_embedding": """
        WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents)
        SELECT doc_id, 768 AS n, round(('0x' || substr(h, 1, 2))::INT / 255, 6) AS first, round(('0x' || substr(h, 63, 2))::INT / 255, 6) AS last_byte,
            round(('0x' || substr(h, 1, 2))::INT / 255, 6) AS again, round(('0x' || substr(h, 63, 2))::INT / 255, 6) AS last FROM h""",
    "corpus_digest": """
        WITH a AS (SELECT item_id AS id, sha256(item_id || ':' || text) AS d FROM benchmark),
        b AS (SELECT id // 4096 AS id, sha256(string_agg(d, '' ORDER BY id, d)) AS d FROM a GROUP BY a.id // 4096),
        c AS (SELECT id // 4096 AS id, sha256(string_agg(d, '' ORDER BY id, d)) AS d FROM b GROUP BY b.id // 4096)
        SELECT id // 4096 AS id, sha256(string_agg(d, '' ORDER BY id, d)) AS digest FROM c GROUP BY c.id // 4096""",
    "metric_gates": f"""
        SELECT gate, measured AND coalesce(ok, FALSE) AS passes, CASE WHEN NOT measured THEN 2 WHEN ok THEN 0 ELSE 1 END AS exit_code FROM (
            SELECT 'retrieval' AS gate, n_queries > 0 AS measured, macro_recall >= 1 AND mrr >= 0.9 AS ok FROM ({BASE_SQL['retrieval_metrics']})
            UNION ALL SELECT 'adjudication', coalesce(sum(n), 0) > 0, sum(correct) = sum(n) AND sum(CASE WHEN expected <> 'promote' THEN promote ELSE 0 END) = 0 FROM ({signal_queries.ORACLE_SQL['adjudication_confusion']}))""",
    "graph_rank_hits": TOKENS + """,
        c AS (SELECT l.item_id AS query_id, l.doc_id, l.rank, matched / size AS fts, ['claim', 'summary', 'evidence_excerpt', 'decision'][CAST(l.doc_id % 4 + 1 AS INT)] AS kind, l.doc_id % 3 = 0 AS draft, q
            FROM lexical l JOIN hits h USING (item_id, doc_id) JOIN asked a USING (item_id) WHERE l.rank <= 10),
        s AS (SELECT *, least(1.0, len(list_filter(list_concat(string_split(kind, '_'), [CASE WHEN draft THEN 'draft' ELSE 'active' END, 'derived']), lambda x: list_contains(q, x))) / greatest(1, len(list_distinct(q)))) AS st,
            CASE kind WHEN 'claim' THEN 1.0 WHEN 'decision' THEN 0.95 WHEN 'summary' THEN 0.9 ELSE 0.2 END AS p FROM c),
        t AS (SELECT *, 'doc_' || doc_id AS chunk_id, round(st + p * 0.4 + CASE WHEN kind = 'evidence_excerpt' THEN 0 WHEN draft THEN 0.18 * p ELSE 0.45 * p END + [0.2, 0.12, 0.06][CAST((rank - 1) % 3 + 1 AS INT)] + fts + fts * 0.8 * 0.5, 6) AS total FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, chunk_id) AS place FROM t)
        SELECT query_id, chunk_id AS top_id, total, rank = 1 AND kind <> 'evidence_excerpt' AS hit FROM r WHERE place = 1""",
    "job_queue": LOG + """,
        jobs AS (SELECT n AS job_id, ['pending', 'leased', 'failed', 'done'][CAST(n % 4 + 1 AS INT)] AS state, n % 5 AS attempt, 3 AS max_attempts, k % 2 = 0 AS lease_expired,
            CASE WHEN n % 4 = 2 THEN ['HTTP 503 unavailable', 'HTTP 400 bad input', 'quota exceeded today', 'HTTP 429 slow down', 'timeout'][CAST(k % 5 + 1 AS INT)] END AS error FROM log),
        j AS (SELECT *, regexp_extract(coalesce(error, ''), 'HTTP ([0-9]{3})', 1) AS code FROM jobs),
        k AS (SELECT *, CASE WHEN error IS NULL THEN NULL WHEN code IN ('408', '429') OR code LIKE '5%' THEN 'retry' WHEN code LIKE '4%' THEN 'blocked'
            WHEN contains(lower(error), 'quota') THEN 'quota' ELSE 'retry' END AS kind FROM j),
        n AS (SELECT *, CASE WHEN state = 'pending' THEN 'leased' WHEN (state = 'failed' OR (state = 'leased' AND lease_expired)) AND attempt >= max_attempts THEN 'dead'
            WHEN state = 'leased' AND lease_expired THEN 'pending' WHEN state = 'failed' AND kind = 'blocked' THEN 'blocked' WHEN state = 'failed' THEN 'pending' ELSE state END AS nxt FROM k)
        SELECT job_id, nxt AS state, kind AS error_class,
            CASE WHEN state = 'failed' AND nxt = 'pending' AND kind = 'retry' THEN CAST(least(3600, pow(2, least(10, attempt - 1))) AS BIGINT) END AS delay_s,
            state = 'failed' AND nxt = 'pending' AND coalesce(kind, '') = 'quota' AS until_midnight FROM n""",
    "reconcile_components": LOG_RECURSIVE + """,
        links AS (SELECT event_id AS source, target_id AS target, CASE WHEN later >= 0 THEN 'evt_' || lpad(CAST(later AS VARCHAR), 9, '0') END AS replacement FROM (
            SELECT *, CASE n % 4 WHEN 2 THEN n - k // 2 - 1 WHEN 0 THEN target_n - k % 7 END AS later FROM log WHERE event_type = 'Supersession' AND target_n IS NOT NULL)),
        ends AS (SELECT source AS a, target AS b FROM links UNION SELECT source, replacement FROM links WHERE replacement IS NOT NULL),
        pairs AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
        reach AS (SELECT a, b FROM pairs UNION SELECT r.a, e.b FROM reach r JOIN pairs e ON e.a = r.b),
        parts AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1),
        step AS (SELECT DISTINCT target AS a, replacement AS b FROM links WHERE replacement IS NOT NULL),
        leads AS (SELECT a, b FROM step UNION SELECT l.a, s.b FROM leads l JOIN step s ON s.a = l.b),
        cyclic AS (SELECT DISTINCT a AS node FROM leads WHERE a = b),
        m AS (SELECT component, string_agg(p.node, ',' ORDER BY p.node) AS members, bool_or(c.node IS NOT NULL) AS has_cycle FROM parts p LEFT JOIN cyclic c USING (node) GROUP BY 1)
        SELECT 'rec_' || substr(sha256(members), 1, 16) AS component_id, members, has_cycle FROM m""",
} | reconcile_sql.ORACLE_SQL
