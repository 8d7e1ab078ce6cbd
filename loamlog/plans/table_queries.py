"""Queries over tables that outlive a query: built from the given tables, changed, then read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.operators import facts
from loamlog.operators import records as records_
from loamlog.operators.chunk_table import ChunkTable, freshness
from loamlog.operators.components import shared_folder
from loamlog.operators.fulltext import TextIndex
from loamlog.operators.vector_table import VectorTable, records
from loamlog.plans.oracle import EARLIER, LOG
from loamlog.plans.oracle import ORACLE_SQL as BASE_SQL
from loamlog.sources import log as L
from loamlog.sources import pulled, transcripts
from loamlog.sources.notes import NoteSink
from loamlog.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: When each zone was last pulled; a zone that never was has no cursor.
PULLED = {"tz_0": "2024-01-25 00:00:00", "tz_1": "2024-01-05 00:00:00", "tz_2": "2024-01-30 00:00:00"}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def fulltext_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is built over documents as they were before their English ones were edited; the
    edit comes as an upsert, and the search sees it."""
    docs, items = L.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), L.table(spark, sf_dir, "benchmark")
    index = TextIndex(Store(spark, shared_folder(spark, "fulltext")), buckets=32)
    english = F.col("lang") == "en"
    index.upsert(docs.withColumn("text", F.when(english, F.concat(F.lit("draft of "), "text")).otherwise(F.col("text"))))
    index.upsert(docs.where(english))
    return index.topk(items, 10).select("item_id", "doc_id", "score", "rank")


def grown_chunks(spark: SparkSession, sf_dir: str) -> ChunkTable:
    """A chunk table of the log as it stood at EARLIER, when drafts had another wording, brought
    up to the whole log."""
    log = L.adapted(spark, sf_dir)
    before = log.where(F.col("recorded") < F.lit(EARLIER).cast("timestamp"))
    before = before.withColumn("statement", F.when(F.col("lifecycle") == "draft", F.concat(F.lit("Draft: "), "statement")).otherwise(F.col("statement")))
    table = ChunkTable(Store(spark, shared_folder(spark, "chunks")), width=1000)
    table.rebuild(before, L.erasures(before))
    table.rebuild(log, L.erasures(log))
    return table


@query
def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grown_chunks(spark, sf_dir).rows().select("chunk_id", "chunk_kind", "event_id", F.array_join("sources", ",").alias("sources"), "status", "text_digest")


@query
def index_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index stands at EARLIER; zones were pulled at times of their own since or before."""
    log = L.sequenced(L.adapted(spark, sf_dir))
    old = log.where(F.col("recorded") < F.lit(EARLIER).cast("timestamp"))
    table = ChunkTable(Store(spark, shared_folder(spark, "chunks")), width=1000)
    table.rebuild(old, L.erasures(old))
    indexed = table.rows().join(log.select("event_id", "zone_sequence"), "event_id").select("zone", "zone_sequence")
    pulled = F.create_map(*[F.lit(x) for kv in PULLED.items() for x in kv])[F.col("zone")].cast("timestamp")
    cursors = log.where(F.col("recorded") < pulled).groupBy("zone").agg(F.max("zone_sequence").alias("after_sequence"))
    return freshness(indexed, old.select("zone", "zone_sequence"), cursors)


@query
def vector_table_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the asked model; those of another model, and one whose digest is not that of
    its vector, are in the table's input and must not come out."""
    vectors = L.table(spark, sf_dir, "embeddings")
    good = records(vectors, "loam-64")
    other = good.withColumns({"vec_id": F.col("vec_id") + 1_000_000_000, "model": F.lit("loam-63")})
    broken = good.withColumns({"vec_id": F.col("vec_id") + 2_000_000_000, "digest": F.lit("sha-256:0")})
    table = VectorTable(Store(spark, shared_folder(spark, "vectors")))
    table.build(good.unionAll(other).unionAll(broken), "loam-64", 64, cells=16)
    asked = good.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return table.nearest(asked, 5)[0].select("query_id", "vec_id", "score", "rank")


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as captured payloads of five shapes; one of them lies deeper than is looked."""
    n, text = F.col("conv_id") + F.col("turn"), F.coalesce("text", F.lit(""))
    under = lambda value, *keys: under(F.struct(value.alias(keys[-1])), *keys[:-1]) if keys else value
    part = F.struct(F.lit("text").alias("type"), text.alias("text"))
    shapes = (
        F.struct(F.lit(1).alias("id"), text.alias("text")), under(F.array(part, F.struct(F.lit("tool").alias("type"), F.lit("tail").alias("text"))), "payload", "event", "message", "content"),
        F.struct(F.lit("x").alias("other"), F.struct(F.lit(" ").alias("summary"), F.struct(text.alias("body")).alias("result")).alias("data")), under(text, "session", "data", "payload", "event", "text"),
        F.struct(F.struct(F.lit("user").alias("role"), text.alias("content")).alias("message"), F.when(n % 2 == 0, "later").alias("prompt")),
    )
    payload = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        payload = F.when(n % 5 == i, F.to_json(shape)).otherwise(payload)
    return L.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), payload.alias("payload"))


@query
def payload_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.payload_prose(captured(spark, sf_dir)).select("id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"))


@query
def transcript_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of transcripts in six forms of a record."""
    n, text, role = F.col("conv_id") + F.col("turn"), F.coalesce("text", F.lit("")), F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    of = lambda kind, said: F.struct(F.lit(kind).alias("type"), said.alias("text"))
    lines = (
        F.struct(role.alias("type"), text.alias("text")), F.struct(F.struct(role.alias("role"), text.alias("content")).alias("message")), F.struct(role.alias("role"), text.alias("content")),
        F.struct(role.alias("type"), F.array(text, F.lit("and a part")).alias("content")), F.struct(F.struct(role.alias("role"), F.array(of("input_text", text), of("tool_use", F.lit("no prose")), of("output_text", F.lit("an end"))).alias("content")).alias("message")),
        F.struct(F.lit("system").alias("type"), text.alias("text")),
    )
    line = F.lit(None).cast("string")
    for i, form in enumerate(lines):
        line = F.when(n % 6 == i, F.to_json(form)).otherwise(line)
    rows = L.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("place"), line.alias("line"))
    return transcripts.parse(rows).select("conv_id", "place", "role", F.sha2("text", 256).alias("digest"))


@query
def pulled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and erasures of the log as a remote's records; what lies behind the cursors."""
    log = L.sequenced(L.adapted(spark, sf_dir))
    events = log.select("zone", "zone_sequence", F.col("event_id").alias("record_id"), F.lit("event").alias("record_kind"), F.col("event_type").alias("body"))
    gone = L.erasures(log).join(log.select(F.col("event_id").alias("target_id"), "zone_sequence"), "target_id").select("zone", "zone_sequence", F.col("erasure_id").alias("record_id"), F.lit("erasure").alias("record_kind"), F.col("target_id").alias("body"))
    path = shared_folder(spark, "remote")
    # a remote keeps its zones in their order, so a range of sequences lies in few row groups
    order = ["zone", "zone_sequence"]
    events.unionAll(gone).repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", 8 << 20).parquet(path)
    return pulled.pull(spark, path, CURSORS, limit=50)


@query
def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the log at EARLIER as files, then brought up to the whole log: what the manifest
    names, and what the second run wrote and removed."""
    log = L.adapted(spark, sf_dir)
    folder = shared_folder(spark, "vault")
    sink = NoteSink(Store(spark, f"{folder}/store"), f"{folder}/notes")
    old = log.where(F.col("recorded") < F.lit(EARLIER).cast("timestamp"))
    sink.write(records_.notes(old, facts.claim_category(log)).select("path", "body"))
    done = sink.write(records_.notes(log, facts.claim_category(log)).select("path", "body"))
    return sink.table().select("path", "digest", F.lit(done["written"]).cast("long").alias("n_written"), F.lit(done["removed"]).cast("long").alias("n_removed"))


#: Where pulling stands in each zone.
CURSORS = {"tz_0": 20, "tz_1": 0, "tz_2": 41}
KEYS = ", ".join(f"({i}, '{k}')" for i, k in enumerate((*transcripts.INLINE_KEYS, *transcripts.PATH_KEYS, *transcripts.NEST_KEYS)))
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
CHUNKS = """,
wiped AS (SELECT target_id FROM erasures),
built AS (
    SELECT event_id, chunk_kind, text, CASE WHEN target_id IS NULL OR target_id = event_id THEN event_id ELSE least(event_id, target_id) || ',' || greatest(event_id, target_id) END AS sources,
        CASE WHEN event_id IN (SELECT target_id FROM wiped) OR target_id IN (SELECT target_id FROM wiped) THEN 'projection_deleted' ELSE 'active' END AS status FROM (
        SELECT *, coalesce(statement, 'Decision: ' || decision, 'Evidence of ' || subject) AS text
        FROM log JOIN (VALUES ('Claim', 'claim'), ('AcceptanceDecision', 'decision'), ('Observation', 'summary'), ('EvidenceArtifact', 'evidence_excerpt')) AS v(event_type, chunk_kind) USING (event_type))),
digested AS (SELECT *, 'sha-256:' || sha256(text) AS text_digest FROM built)
SELECT 'chk_' || substr(sha256(sources || ':' || chunk_kind || ':0:' || text_digest), 1, 40) AS chunk_id, chunk_kind, event_id, sources, status, text_digest FROM digested"""
FULL = LOG + CHUNKS
OLD = LOG.replace("FROM events", f"FROM (SELECT * FROM events WHERE ts < '{EARLIER}')").replace("'Statement ' || k", "CASE WHEN n % 5 = 0 THEN 'Draft: ' ELSE '' END || 'Statement ' || k") + CHUNKS

ORACLE_SQL: dict[str, str] = {
    "fulltext_topk": BASE_SQL["lexical_topk"],
    "chunk_table": f"""
        WITH new_rows AS ({FULL}), old_rows AS ({OLD})
        SELECT * FROM new_rows UNION ALL SELECT * REPLACE ('stale' AS status) FROM old_rows WHERE chunk_id NOT IN (SELECT chunk_id FROM new_rows)""",
    "index_freshness": LOG + f""",
        l AS (SELECT zone, max(zone_sequence) FILTER (recorded < TIMESTAMP '{EARLIER}') AS last, max(zone_sequence) FILTER (recorded < CASE zone {' '.join(f"WHEN '{z}' THEN TIMESTAMP '{t}'" for z, t in PULLED.items())} END) AS pulled FROM seq GROUP BY 1)
        SELECT zone, coalesce(last, 0) AS last_indexed, coalesce(pulled, last, 0) AS after_sequence, coalesce(last, 0) < coalesce(pulled, last, 0) AS stale FROM l""",
    "vector_table_topk": """
        WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
            FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "payload_prose": f"""
        WITH RECURSIVE c AS (SELECT conv_id || ':' || turn AS id, (conv_id + turn) % 5 AS shape, (conv_id + turn) % 2 AS odd, coalesce(text, '') AS t FROM conversations),
        p AS (SELECT id, CASE shape WHEN 0 THEN json_object('id', 1, 'text', t)
            WHEN 1 THEN json_object('payload', json_object('event', json_object('message', json_object('content', json_array(json_object('type', 'text', 'text', t), json_object('type', 'tool', 'text', 'tail'))))))
            WHEN 2 THEN json_object('other', 'x', 'data', json_object('summary', ' ', 'result', json_object('body', t)))
            WHEN 3 THEN json_object('session', json_object('data', json_object('payload', json_object('event', json_object('text', t)))))
            ELSE json_object('message', json_object('role', 'user', 'content', t), 'prompt', CASE WHEN odd = 0 THEN 'later' END) END AS value FROM c),
        keys AS (SELECT * FROM (VALUES {KEYS}) AS k(rank, key)),
        walk AS (
            SELECT id, [rank] AS ranks, rank, json_extract(value, '$.' || key) AS v, 0 AS depth FROM p, keys WHERE json_extract(value, '$.' || key) IS NOT NULL
            UNION ALL SELECT w.id, list_append(w.ranks, k.rank), k.rank, json_extract(w.v, '$.' || k.key), depth + 1 FROM walk w, keys k
            WHERE json_type(w.v) = 'OBJECT' AND depth < {transcripts.DEEPEST} AND w.rank NOT IN (16, 17) AND json_extract(w.v, '$.' || k.key) IS NOT NULL),
        hits AS (SELECT id, ranks, CASE WHEN rank < 16 AND json_type(v) = 'VARCHAR' THEN {STRIP.format("json_extract_string(v, '$')")}
            WHEN rank < 16 AND json_type(v) = 'ARRAY' THEN array_to_string(list_filter(list_transform(json_extract_string(v, '$[*].text'), lambda x: {STRIP.format('x')}), lambda x: x <> ''), chr(10)) END AS text FROM walk),
        f AS (SELECT id, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ranks) AS place FROM hits WHERE text <> '') WHERE place = 1)
        SELECT id, sha256(coalesce(f.text, '')) AS digest, length(coalesce(f.text, '')) AS n_chars FROM p LEFT JOIN f USING (id)""",
    "transcript_records": f"""
        WITH c AS (SELECT conv_id, turn AS place, (conv_id + turn) % 6 AS form, role, {STRIP.format("coalesce(text, '')")} AS t FROM conversations),
        s AS (SELECT conv_id, place, CASE WHEN role IN ('user', 'assistant') THEN role END AS role,
            substr(CASE WHEN form < 3 THEN t WHEN form = 3 THEN CASE WHEN t = '' THEN '' ELSE t || ' ' END || 'and a part' WHEN form = 4 THEN CASE WHEN t = '' THEN '' ELSE t || ' ' END || 'an end' END, 1, {transcripts.ITEM_CHARS}) AS text FROM c)
        SELECT conv_id, place, role, sha256(text) AS digest FROM s WHERE role IS NOT NULL AND text <> ''""",
    "pulled_records": LOG + f""",
        r AS (SELECT zone, zone_sequence, event_id AS record_id, 'event' AS record_kind, event_type AS body FROM seq
            UNION ALL SELECT e.zone, s.zone_sequence, erasure_id, 'erasure', e.target_id FROM erasures e JOIN seq s ON s.event_id = e.target_id)
        SELECT * FROM r WHERE zone_sequence > CASE zone {' '.join(f"WHEN '{z}' THEN {n}" for z, n in CURSORS.items())} ELSE 0 END""",
    "note_files": f"""
        WITH now AS ({BASE_SQL["vault_notes"]}),
        counts AS (SELECT (SELECT count(*) FROM ({BASE_SQL["missing_files"]})) AS w)
        SELECT path, digest, w AS n_written, 0 AS n_removed FROM now, counts""",
}
