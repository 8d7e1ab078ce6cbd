"""Queries over the driver's tables, one for each operator of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.functions import text as T
from loamlog.operators import facts, graph, metrics, policy, queues, records, retrieval
from loamlog.plans import cases, log_queries, queue_queries, signal_queries, table_queries
from loamlog.plans.oracle import EARLIER
from loamlog.plans.oracle import ORACLE_SQL as BASE_SQL
from loamlog.sources import log as L
from loamlog.sources.signals import signals
from loamlog.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = BASE_SQL | signal_queries.ORACLE_SQL | log_queries.ORACLE_SQL | table_queries.ORACLE_SQL | queue_queries.ORACLE_SQL


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def earlier(log: DataFrame) -> DataFrame:
    """The log as it stood at EARLIER."""
    return log.where(F.col("recorded") < F.lit(EARLIER).cast("timestamp"))


def of_log(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """Registers a query over the adapted log."""
    QUERIES[name] = lambda spark, sf_dir: f(L.adapted(spark, sf_dir))


of_log("accepted_facts", facts.accepted_facts)
of_log("accepted_latest", lambda log: facts.latest_accepted(L.decisions(log)))
of_log("open_loops", facts.open_loops)
of_log("open_loop_counts", lambda log: facts.open_loops(log).groupBy("kind").agg(F.count("*").alias("n")))
of_log("claim_category", facts.claim_category)
of_log("bitemporal_slice", lambda log: facts.bitemporal(log, ("2024-01-03 00:00:00", "2024-01-10 00:00:00"), ("2024-01-02 00:00:00", "2024-01-20 00:00:00")))
of_log("visible_snapshot", lambda log: facts.visible(log, ["tz_0", "tz_2"]).where("event_type IN ('Claim', 'Observation')").select("event_id", "event_type", "zone", "lifecycle"))
of_log("timeline", facts.timeline)
of_log("context_sections", facts.classify)
of_log("omission_report", lambda log: facts.omissions(log, "tz_1"))
of_log("origin_inherit", facts.inherited_origin)
of_log("origin_scope", lambda log: facts.inherited_origin(log).where(facts.in_scope(F.col("project_id"), ["prj_1", "prj_2"])).groupBy("zone").agg(F.count("*").alias("n")))
of_log("recheck_reasons", facts.recheck)
of_log("zone_sequence", lambda log: L.sequenced(log).select("event_id", "zone", "zone_sequence"))
of_log("zone_freshness", lambda log: queues.freshness(log, {"tz_0": EARLIER, "tz_1": EARLIER}))
of_log("pull_page", lambda log: queues.pull_page(log, 100, 50))
of_log("outbox_lease", lambda log: queues.lease(queues.outbox(log), "2024-06-01 00:00:00", 200))
of_log("outbox_retry", lambda log: queues.retry(queues.outbox(log)))
of_log("queue_counts", lambda log: queues.state_counts(queues.outbox(log)))
of_log("skip_reasons", lambda log: queues.skip_reasons(queues.outbox(log)))
of_log("idempotent_accept", lambda log: queues.idempotent(queues.requests(log)))
of_log("telemetry_admit", queues.telemetry)
of_log("latest_disposition", queues.latest_disposition)
of_log("held_unreviewed", queues.held_unreviewed)
of_log("day_spend", lambda log: queues.day_spend(log, 5000.0))
of_log("token_cost", queues.token_cost)
of_log("import_reconcile", queues.reconcile_import)
of_log("chunk_build", lambda log: retrieval.chunks(log).select("chunk_id", "chunk_kind", "chunk_index", "event_id", "text_digest", "status"))
of_log("structured_topk", lambda log: retrieval.structured_topk(retrieval.chunks(log), "active claim summary verified", 2000, 50))
of_log("graph_nodes", graph.nodes)
of_log("graph_edges", graph.edges)
of_log("graph_density", lambda log: graph.density(graph.nodes(log), graph.edges(log)))
of_log("graph_khop", lambda log: graph.walk(log.where("n % 50 = 0").select(F.concat(F.lit("evt:"), "event_id").alias("seed")), graph.edges(log).where("edge_kind IN ('derived_from', 'supports', 'supersedes', 'accepted_by')"), 2))
of_log("graph_threads", lambda log: graph.threads(log, graph.edges(log)))
of_log("lineage_trace", graph.lineage)
of_log("ledger_gates", metrics.ledger_gates)
of_log("alias_lookup", lambda log: records.aliases(log))
of_log("support_resolution", records.resolved_support)
of_log("latest_writers", records.latest_writers)
of_log("bundle_export", lambda log: records.bundle(log, 100))
of_log("bundle_import", lambda log: records.bundle_import(earlier(log), records.bundle(log)))
of_log("index_rebuild", lambda log: records.index_changes(retrieval.chunks(earlier(log)), retrieval.chunks(log)))
of_log("source_records", records.source_records)
of_log("vault_notes", lambda log: records.notes(log, facts.claim_category(log)))
of_log("missing_files", lambda log: records.missing_files(records.notes(log, facts.claim_category(log)), records.notes(earlier(log), facts.claim_category(log))))
of_log("dashboard", lambda log: records.dashboard(facts.open_loops(log)))
of_log("provenance_paths", lambda log: records.neighbourhood_paths(log.where("target_id IS NOT NULL").select(F.col("event_id").alias("from_id"), F.col("target_id").alias("to_id")), log.where("event_type = 'Observation'").select(F.col("event_id").alias("seed")), 3))
of_log("proposal_edges", records.proposal_edges)
of_log("feed_backfill", lambda log: records.backfill(log, 40))
of_log("context_pack", lambda log: records.context_pack(log, 12, 600))


@query
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = L.table(spark, sf_dir, "documents")
    a, c = T.search_tokens(F.col("text")), T.embedding_tokens(F.col("text"))
    return docs.select("doc_id", F.size(a).alias("n_search"), F.size(F.array_distinct(a)).alias("n_distinct"), F.size(c).alias("n_embedding"), F.sha2(F.array_join(a, " "), 256).alias("digest"))


@query
def scrub_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.scrubbed(L.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t")), "t")
    return rows.select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("digest"))


@query
def head_tail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = T.head_tail(F.col("text"), 400)
    return L.table(spark, sf_dir, "documents").select("doc_id", F.length(view).alias("n"), F.sha2(view, 256).alias("digest"))


@query
def line_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.with_residual(L.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "r")
    return lines.select("doc_id", F.size("r.kept").alias("kept"), "r.secret", "r.tool", "r.telemetry")


@query
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical_topk(L.table(spark, sf_dir, "benchmark"), L.table(spark, sf_dir, "documents"), 10).select("item_id", "doc_id", "score", "rank")


@query
def hash_embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hashed_topk(L.table(spark, sf_dir, "benchmark"), L.table(spark, sf_dir, "documents"), 5)


@query
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid_search(L.table(spark, sf_dir, "benchmark"), L.table(spark, sf_dir, "documents"), 10)


@query
def hybrid_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = L.table(spark, sf_dir, "documents")
    return retrieval.diverse(retrieval.hybrid_search(L.table(spark, sf_dir, "benchmark"), docs, 20), docs, 10)


@query
def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_knn(L.table(spark, sf_dir, "embeddings"), 50, 5)


@query
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.near_duplicate_pairs(L.table(spark, sf_dir, "documents"))


@query
def near_dup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.token_classes(L.table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query
def near_dup_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = L.table(spark, sf_dir, "documents")
    return policy.hold_repeats(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("zone"), F.col("text").alias("statement"), F.col("doc_id").alias("position")))


@query
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = L.table(spark, sf_dir, "documents"), L.table(spark, sf_dir, "benchmark")
    ranked = retrieval.lexical_topk(items, docs, 10)
    return metrics.retrieval_quality(ranked, metrics.containing(items, docs))


@query
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = L.table(spark, sf_dir, "labels"), L.table(spark, sf_dir, "documents")
    rows = labels.join(docs, "doc_id").select(F.col("quality").alias("actual"), (F.length("text") > 500).cast("int").alias("predicted"))
    return metrics.binary_quality(rows)


@query
def statement_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = L.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("id"), F.lit("documents").alias("subject"), F.lit("draft").alias("lifecycle"), F.col("text").alias("statement"))
    literal = cases.rows(spark, cases.STATEMENTS, "id int, subject string, lifecycle string, statement string")
    return policy.duplicate_statements(literal.select("id", "subject", "lifecycle", "statement").unionAll(docs))


@query
def unit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = L.table(spark, sf_dir, "documents").withColumn("summary", F.coalesce(policy.best_line(F.col("text")), F.lit("")))
    ref = F.when(F.col("doc_id") % 2 == 0, "ref")
    out = [docs.select("doc_id", F.lit(level).alias("asked"), records.resolve_unit(F.col("text"), F.col("summary"), ref, level, 500).alias("u")) for level in ("R0", "R1", "R2", "R3")]
    rows = out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])
    return rows.select("doc_id", "asked", F.col("u.level").alias("level"), F.sha2("u.text", 256).alias("digest"))


@query
def conversation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = L.table(spark, sf_dir, "conversations")
    return turns.groupBy("role").agg(F.count("*").alias("n_turns"), F.countDistinct("conv_id").alias("n_conversations"), F.sum(F.size(T.search_tokens(F.col("text")))).alias("n_tokens"))


@query
def transcript_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fold_transcripts(signals(spark, sf_dir).withColumn("text", F.col("signal")))


QUERIES |= signal_queries.QUERIES | log_queries.QUERIES | table_queries.QUERIES | queue_queries.QUERIES
