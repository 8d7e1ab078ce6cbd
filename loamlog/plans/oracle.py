"""The queries once more in SQL, over the same tables."""

from __future__ import annotations

from loamlog.plans import cases

#: The adapted log (see loamlog.sources.log), with what several queries share.
LOG = """
WITH raw AS (
    SELECT event_id AS n, ts, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        CASE event_type WHEN 'signup' THEN 'EvidenceArtifact' WHEN 'view' THEN 'Observation' WHEN 'click' THEN 'Claim'
            WHEN 'purchase' THEN 'AcceptanceDecision' WHEN 'error' THEN 'Supersession' END AS event_type
    FROM events),
log AS (
    SELECT n, 'evt_' || lpad(CAST(n AS VARCHAR), 9, '0') AS event_id, event_type, 'tz_' || (user_id % 4) AS zone, user_id,
        'subject_' || user_id AS subject, CASE WHEN n % 5 = 0 THEN 'draft' ELSE 'active' END AS lifecycle,
        ['unverified', 'verified', 'derived', 'reported', 'inferred', 'asserted'][CAST((n // 11) % 6 + 1 AS INT)] AS authority,
        ts AS recorded, ts AS valid_start, ts + to_seconds(floor(value * 3600)) AS valid_end,
        CASE WHEN event_type = 'AcceptanceDecision' THEN ['accepted', 'rejected', 'needs_review'][CAST((n // 7) % 3 + 1 AS INT)] END AS decision,
        CASE WHEN event_type IN ('Observation', 'Claim') THEN 'Statement ' || k || ' about subject_' || user_id END AS statement,
        CASE WHEN n - k - 1 >= 0 THEN n - k - 1 END AS target_n,
        CASE WHEN n - k - 1 >= 0 THEN 'evt_' || lpad(CAST(n - k - 1 AS VARCHAR), 9, '0') END AS target_id, value, k
    FROM raw),
erasures AS (
    SELECT 'ers_' || lpad(CAST(n AS VARCHAR), 9, '0') AS erasure_id, event_id AS target_id, zone, recorded + INTERVAL 1 DAY AS requested
    FROM log WHERE n % 97 = 0),
superseded AS (SELECT DISTINCT target_id AS event_id FROM log WHERE event_type = 'Supersession' AND target_id IS NOT NULL),
decisions AS (
    SELECT * FROM (
        SELECT *, last_value(CASE WHEN event_type = 'Claim' THEN event_id END IGNORE NULLS) OVER (
            PARTITION BY user_id ORDER BY recorded, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS claim_id
        FROM log WHERE event_type IN ('Claim', 'AcceptanceDecision'))
    WHERE event_type = 'AcceptanceDecision' AND claim_id IS NOT NULL),
flags AS (
    SELECT claim_id, bool_or(decision = 'accepted') AS accepted, bool_or(decision = 'rejected') AS rejected,
        bool_or(decision = 'needs_review') AS review FROM decisions GROUP BY 1),
gone AS (SELECT target_id AS event_id FROM erasures UNION SELECT event_id FROM superseded),
known AS (SELECT * FROM log WHERE authority <> 'unverified' AND event_id NOT IN (SELECT event_id FROM gone)),
eligible AS (SELECT * FROM known WHERE lifecycle = 'active'),
seq AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY recorded, n) AS zone_sequence FROM log),
origins AS (
    SELECT event_id, CASE WHEN user_id % 7 <> 0 THEN 'prj_' || (user_id % 7) END AS project_id,
        CASE WHEN user_id % 5 <> 0 THEN 'wt_' || (user_id % 5) END AS worktree_id
    FROM log WHERE event_type = 'EvidenceArtifact' AND (user_id % 7 <> 0 OR user_id % 5 <> 0)),
inherited AS (
    SELECT l.event_id, l.zone, CASE WHEN a.event_id IS NOT NULL THEN a.project_id ELSE b.project_id END AS project_id,
        CASE WHEN a.event_id IS NOT NULL THEN a.worktree_id ELSE b.worktree_id END AS worktree_id
    FROM log l LEFT JOIN origins a ON a.event_id = l.event_id LEFT JOIN origins b ON b.event_id = l.target_id),
category AS (
    SELECT k.event_id, k.zone, CASE WHEN accepted AND rejected THEN 'conflict' WHEN rejected THEN 'rejected' WHEN accepted THEN 'accepted'
        ELSE 'proposed' END AS category
    FROM known k LEFT JOIN flags f ON f.claim_id = k.event_id WHERE k.event_type = 'Claim'),
loops AS (
    SELECT 'loop_draft_' || event_id AS loop_id, 'draft_claim' AS kind, subject, substr(statement, 1, 160) AS title
    FROM log LEFT JOIN flags ON claim_id = event_id
    WHERE event_type = 'Claim' AND lifecycle = 'draft' AND NOT coalesce(accepted, FALSE) AND NOT coalesce(rejected, FALSE)
    UNION ALL
    SELECT 'loop_review_' || event_id, 'needs_review', subject, substr(statement, 1, 160) FROM log JOIN flags ON claim_id = event_id
    WHERE event_type = 'Claim' AND review
    UNION ALL
    SELECT 'loop_conflict_' || event_id, 'conflict', subject, substr(statement, 1, 160) FROM log JOIN flags ON claim_id = event_id
    WHERE event_type = 'Claim' AND accepted AND rejected
    UNION ALL
    SELECT 'loop_super_' || event_id, 'unresolved_supersession', subject, 'replaces ' || target_id FROM log
    WHERE event_type = 'Supersession' AND target_id IS NOT NULL AND n % 2 = 1),
outbox AS (
    SELECT n AS outbox_id, event_id, zone, event_type, lifecycle,
        CASE n % 4 WHEN 0 THEN 'delivered' WHEN 1 THEN 'leased' ELSE 'pending' END AS state, CAST(n % 6 AS INT) AS attempts,
        recorded + to_minutes(n % 50) AS available_at, CASE WHEN n % 4 = 1 THEN recorded + to_hours(n % 30) END AS lease_expires_at,
        CASE WHEN n % 9 = 0 THEN 'timeout' END AS last_error,
        CASE WHEN event_type = 'EvidenceArtifact' THEN 'skip_evidence' WHEN lifecycle = 'active' THEN 'admit' ELSE 'skip_not_promoted' END AS admission
    FROM log),
requests AS (
    SELECT user_id || ':' || event_type AS key, sha256(user_id || ':' || event_type || ':' || (k % 3)) AS fingerprint, n AS arrival FROM log),
accepts AS (
    SELECT key, fingerprint, arrival, CASE WHEN arrival = min(arrival) OVER w THEN 'new'
        WHEN fingerprint = first_value(fingerprint) OVER w THEN 'replay' ELSE 'conflict' END AS status
    FROM requests WINDOW w AS (PARTITION BY key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
dispositions AS (
    SELECT event_id, zone, ['promote', 'hold', 'reject'][CAST(k % 3 + 1 AS INT)] AS disposition, recorded AS created, 'v1' AS policy
    FROM log WHERE event_type = 'Observation'
    UNION ALL
    SELECT event_id, zone, ['promote', 'hold', 'reject'][CAST((k + 1) % 3 + 1 AS INT)], recorded + INTERVAL 1 HOUR, 'v2'
    FROM log WHERE event_type = 'Observation' AND n % 2 = 0),
chunks AS (
    SELECT *, 'sha-256:' || sha256(text) AS text_digest FROM (
        SELECT s.event_id, chunk_kind, s.zone, zone_sequence, lifecycle, authority, recorded,
            row_number() OVER (ORDER BY kind_rank, zone_sequence // 10000, zone_sequence, s.event_id) - 1 AS chunk_index,
            coalesce(statement, 'Decision: ' || decision, 'Evidence of ' || subject) AS text,
            CASE WHEN e.target_id IS NOT NULL THEN 'projection_deleted' ELSE 'active' END AS status
        FROM seq s JOIN (VALUES ('Claim', 0, 'claim'), ('AcceptanceDecision', 1, 'decision'), ('Observation', 2, 'summary'),
            ('EvidenceArtifact', 3, 'evidence_excerpt')) AS v(event_type, kind_rank, chunk_kind) USING (event_type)
        LEFT JOIN erasures e ON e.target_id = s.event_id)),
chunk_ids AS (
    SELECT 'chk_' || substr(sha256(event_id || ':' || chunk_kind || ':' || chunk_index || ':' || text_digest), 1, 40) AS chunk_id, * FROM chunks),
placed AS (SELECT o.*, l.zone, l.recorded, l.n FROM origins o JOIN log l USING (event_id)),
nodes AS (
    SELECT 'evt:' || event_id AS node_id, CASE event_type WHEN 'EvidenceArtifact' THEN 'evidence' WHEN 'AcceptanceDecision' THEN 'acceptance'
        WHEN 'Supersession' THEN 'supersession' ELSE 'meaning_unit' END AS node_kind, zone FROM log
    UNION ALL
    SELECT 'subj:' || subject, 'subject', arg_max(zone, (recorded, n)) FROM log GROUP BY subject
    UNION ALL
    SELECT 'project:' || project_id, 'project', arg_max(zone, (recorded, n)) FROM placed WHERE project_id IS NOT NULL GROUP BY project_id
    UNION ALL
    SELECT 'worktree:' || worktree_id, 'worktree', arg_max(zone, (recorded, n)) FROM placed WHERE worktree_id IS NOT NULL GROUP BY worktree_id),
edges AS (
    SELECT CASE a.event_type WHEN 'Claim' THEN 'supports' WHEN 'Supersession' THEN 'supersedes' ELSE 'derived_from' END AS edge_kind,
        'evt:' || a.event_id AS from_id, 'evt:' || a.target_id AS to_id, a.zone
    FROM log a JOIN log b ON b.event_id = a.target_id WHERE a.event_type <> 'EvidenceArtifact'
    UNION ALL
    SELECT 'accepted_by', 'evt:' || claim_id, 'evt:' || event_id, zone FROM decisions
    UNION ALL
    SELECT 'about', 'evt:' || event_id, 'subj:' || subject, zone FROM log WHERE event_type IN ('Observation', 'Claim')
    UNION ALL
    SELECT 'belongs_to', 'evt:' || event_id, 'project:' || project_id, zone FROM placed WHERE project_id IS NOT NULL
    UNION ALL
    SELECT 'observed_in', 'evt:' || event_id, 'worktree:' || worktree_id, zone FROM placed WHERE worktree_id IS NOT NULL)
"""
LOG_RECURSIVE = LOG.replace("WITH raw AS", "WITH RECURSIVE raw AS", 1)

TOKENS = """
WITH tokens AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents),
asked AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS q FROM benchmark),
q AS (SELECT item_id, len(q) AS size, unnest(q) AS token FROM asked),
q2 AS (SELECT item_id, size, token, count(*) AS times FROM q GROUP BY ALL),
posts AS (SELECT doc_id, unnest(list_distinct(t)) AS token FROM tokens),
hits AS (SELECT item_id, size, doc_id, sum(times) AS matched FROM q2 JOIN posts USING (token) GROUP BY ALL),
lexical AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT item_id, doc_id, round(matched / size, 6) AS score FROM hits))
"""
HASHED = """,
words AS (
    SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents
    UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) FROM benchmark),
buckets AS (
    SELECT side, id, ('0x' || substr(h, 1, 8))::BIGINT % 768 AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS s
    FROM (SELECT side, id, sha256(token) AS h FROM words) GROUP BY ALL),
norms AS (SELECT side, id, sqrt(sum(s * s)) AS norm FROM buckets WHERE s <> 0 GROUP BY ALL),
weights AS (
    SELECT side, id, bucket, s / norm AS w FROM buckets JOIN norms USING (side, id) WHERE s <> 0
    UNION ALL SELECT 'd', doc_id, 0, 1.0 FROM documents WHERE doc_id NOT IN (SELECT id FROM norms WHERE side = 'd')
    UNION ALL SELECT 'q', item_id, 0, 1.0 FROM benchmark WHERE item_id NOT IN (SELECT id FROM norms WHERE side = 'q')),
semantic AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT b.id AS item_id, a.id AS doc_id, round(sum(a.w * b.w), 6) AS score
        FROM weights a JOIN weights b USING (bucket) WHERE a.side = 'd' AND b.side = 'q' GROUP BY ALL))
"""
DUPLICATES = """
WITH sets AS (
    SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS t FROM documents),
classes AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS class_id FROM sets)
"""

# The patterns of loamlog.functions.text as this engine writes them.
SECRET_LINE = r"(?i)\b(api[_-]?key|secret|password|bearer\s+[a-z0-9._-]+|sk-[a-z0-9]{10,}|hunter2)\b"
TOOL_LINE = r"(?i)^(PostToolUse|git status|npm install|pnpm (install|test|check)|PREFLIGHT PASS|make preflight(-fix|-quick)?)\s*$"
TOOL_INLINE = r"(?i)\b(linter passed|exit 0|vulnerabilit(y|ies)|ran .+ successfully)\b"
TELEMETRY = r"(?i)\b(hook_event_name|session_id|agent_type|cache_evidence|prefix_epoch|model_used|tool_count|mcp_wait_ms|elapsed_since_turn_start)\b"
NOISE = r"(?i)^(ok|okay|done|passed|success|noop|n/a|none|thanks?|thank you|lgtm|wip|test|ping|pong|yes|no|y|n|\.|…|\.\.\.)$"
SCRUB = (
    (r"https?://[^\s\"''`<>]+", "[URI]", "gi"),
    (r"file://[^\s\"''`<>]+", "[URI]", "gi"),
    (r"(?:^|[\s\"''`])/(?:tmp|var|home|Users|etc|opt|private|Volumes|mnt|srv)/[^\s\"''`]+", " [PATH]", "g"),
    (r"(?:^|[\s\"''`])[A-Za-z]:\\[^\s\"''`]+", " [PATH]", "g"),
    (r"(?:^|[\s\"''`])~/[^\s\"''`]+", " [PATH]", "g"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]", "g"),
    (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", "[IP]", "g"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{0,4}\b", "[IP]", "g"),
    (r"\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|org|net|io|dev|app|local|internal|example|edu|gov|co|kr|jp|ai)\b", "[HOST]", "gi"),
)


def scrubbed(column: str) -> str:
    for pattern, by, flags in SCRUB:
        column = f"regexp_replace({column}, '{pattern}', '{by}', '{flags}')"
    return column


def line_kinds(lines: str) -> str:
    return f"""CASE WHEN regexp_matches({lines}, '{SECRET_LINE}') THEN 'secret'
        WHEN regexp_matches({lines}, '{TOOL_LINE}') OR regexp_matches({lines}, '{TOOL_INLINE}') THEN 'tool'
        WHEN regexp_matches({lines}, '{TELEMETRY}') AND length({lines}) < 200 THEN 'telemetry'
        WHEN regexp_matches({lines}, '{NOISE}') THEN 'noise' ELSE 'kept' END"""


def statement_key(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({column}), '[“”\"''`]', '', 'g'), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def hook(column: str) -> str:
    known = " ".join(
        f"WHEN '{k}' THEN '{v}'"
        for k, v in (
            ("sessionend", "SessionEnd"), ("stop", "Stop"), ("precompact", "PreCompact"), ("posttooluse", "PostToolUse"),
            ("sessionstart", "SessionStart"), ("notification", "Notification"), ("userpromptsubmit", "UserPromptSubmit"),
        )
    )
    return f"CASE WHEN trim({column}) = '' THEN 'unknown' ELSE CASE regexp_replace(lower(trim({column})), '[\\s_-]+', '', 'g') {known} ELSE trim({column}) END END"


PAYLOAD = "CASE {0} WHEN 'EvidenceArtifact' THEN 'art_' WHEN 'Observation' THEN 'obs_' WHEN 'Claim' THEN 'clm_' WHEN 'AcceptanceDecision' THEN 'dec_' ELSE 'sup_' END || {1}"
BUNDLE = f""",
    units AS (SELECT *, {statement_key('statement')} AS key FROM log WHERE event_type IN ('Observation', 'Claim') AND lifecycle = 'active'),
    bundle AS (SELECT arg_max(event_id, (recorded, n)) AS event_id, arg_max(event_type, (recorded, n)) AS event_type, arg_max(statement, (recorded, n)) AS statement
        FROM units WHERE length(key) >= 8 GROUP BY key ORDER BY max((recorded, n)) DESC LIMIT 100)
"""
NOTES = """,
    notes AS (SELECT l.recorded, 'claims/' || category || '/' || l.event_id || '.md' AS path, '---' || chr(10) || 'id: "' || l.event_id || '"' || chr(10) || 'zone: "' || l.zone || '"' || chr(10)
        || 'category: ' || category || chr(10) || '---' || chr(10) || '# ' || statement || chr(10) || chr(10) || 'Subject: [[' || subject || ']]' || chr(10) AS body
        FROM log l JOIN category c ON c.event_id = l.event_id)
"""
#: The time as of which the index, manifest and statements of an earlier state stand.
EARLIER = "2024-01-15 00:00:00"
MARKER = "chr(10) || '…[truncated]…' || chr(10)"
PRIORITY = "CASE chunk_kind WHEN 'claim' THEN 1.0 ELSE 0.2 END"

ORACLE_SQL: dict[str, str] = {
    "accepted_facts": LOG + """,
        said AS (SELECT e.event_id, d.claim_id, e.decision, e.recorded FROM eligible e JOIN decisions d USING (event_id)),
        yes AS (SELECT claim_id, arg_min(event_id, (recorded, event_id)) AS decision_id FROM said WHERE decision = 'accepted' GROUP BY 1)
        SELECT c.event_id AS claim_id, c.zone, c.subject, c.statement, decision_id, s.event_id AS support_id, s.event_type AS support_type
        FROM eligible c JOIN yes ON yes.claim_id = c.event_id
        LEFT JOIN eligible s ON s.event_id = c.target_id AND s.event_type IN ('EvidenceArtifact', 'Observation', 'Claim')
        WHERE c.event_type = 'Claim' AND c.event_id NOT IN (SELECT claim_id FROM said WHERE decision = 'rejected')
            AND (c.target_id IS NULL OR s.event_id IS NOT NULL)""",
    "accepted_latest": LOG + """
        SELECT claim_id, arg_max(event_id, (recorded, -n)) AS decision_id, max(recorded) AS decided_at, count(*) AS n_decisions
        FROM decisions WHERE decision = 'accepted' GROUP BY 1""",
    "open_loops": LOG + "SELECT * FROM loops",
    "open_loop_counts": LOG + "SELECT kind, count(*) AS n FROM loops GROUP BY 1",
    "claim_category": LOG + "SELECT event_id, zone, category FROM category",
    "bitemporal_slice": LOG + """
        SELECT 'event' AS record_kind, event_id AS record_id, zone, recorded AS at FROM log
        WHERE valid_start <= TIMESTAMP '2024-01-10' AND valid_end >= TIMESTAMP '2024-01-03'
            AND recorded BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'
        UNION ALL
        SELECT 'erasure', erasure_id, zone, requested FROM erasures WHERE requested BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'""",
    "visible_snapshot": LOG + "SELECT event_id, event_type, zone, lifecycle FROM log WHERE zone IN ('tz_0', 'tz_2') AND event_type IN ('Claim', 'Observation')",
    "timeline": LOG + """
        SELECT subject, 'event' AS record_kind, event_id AS record_id, recorded AS at FROM log
        UNION ALL SELECT l.subject, 'erasure', erasure_id, requested FROM erasures e JOIN log l ON l.event_id = e.target_id""",
    "context_sections": LOG + """
        SELECT l.event_id, l.zone, l.event_type, CASE WHEN e.target_id IS NOT NULL THEN 'erasure' WHEN l.event_type = 'Supersession' THEN 'supersession'
            WHEN s.event_id IS NOT NULL OR l.authority = 'unverified' THEN 'excluded' WHEN l.event_type = 'EvidenceArtifact' THEN 'evidence'
            WHEN l.event_type = 'Observation' THEN 'observation' WHEN l.event_type = 'AcceptanceDecision' THEN 'decision'
            WHEN l.lifecycle = 'draft' AND category = 'proposed' THEN 'draft' ELSE category END AS section
        FROM log l LEFT JOIN erasures e ON e.target_id = l.event_id LEFT JOIN superseded s ON s.event_id = l.event_id
        LEFT JOIN category c ON c.event_id = l.event_id""",
    "omission_report": LOG + """
        SELECT * FROM (
            SELECT l.event_id, l.event_type, CASE WHEN l.zone <> 'tz_1' THEN 'wrong_zone' WHEN e.target_id IS NOT NULL THEN 'erased'
                WHEN l.event_type = 'Claim' AND coalesce(rejected, FALSE) THEN 'rejected' WHEN l.lifecycle = 'draft' THEN 'draft'
                WHEN l.event_type = 'Claim' AND NOT coalesce(accepted, FALSE) THEN 'missing_acceptance'
                WHEN l.event_type = 'Supersession' AND l.target_id IS NULL THEN 'missing_supersession_target' END AS reason
            FROM log l LEFT JOIN erasures e ON e.target_id = l.event_id LEFT JOIN flags f ON f.claim_id = l.event_id)
        WHERE reason IS NOT NULL""",
    "origin_inherit": LOG + "SELECT * FROM inherited",
    "origin_scope": LOG + "SELECT zone, count(*) AS n FROM inherited WHERE project_id IS NULL OR project_id IN ('prj_1', 'prj_2') GROUP BY 1",
    "recheck_reasons": LOG + """
        SELECT 'chunk_' || l.event_id AS chunk_id, CASE WHEN l.n % 17 = 0 THEN 'canonical_source_missing'
            WHEN l.n % 13 = 0 THEN 'canonical_source_mismatch' WHEN e.target_id IS NOT NULL THEN 'erased'
            WHEN l.lifecycle <> 'active' THEN 'lifecycle_excluded' WHEN l.authority = 'unverified' THEN 'authority_excluded'
            WHEN s.event_id IS NOT NULL THEN 'superseded' END AS reason
        FROM log l LEFT JOIN erasures e ON e.target_id = l.event_id LEFT JOIN superseded s ON s.event_id = l.event_id""",
    "zone_sequence": LOG + "SELECT event_id, zone, zone_sequence FROM seq",
    "zone_freshness": LOG + f"""
        SELECT zone, scanned, indexed, cursor, greatest(0, indexed, scanned) AS last_indexed, greatest(0, indexed, scanned) < cursor AS stale
        FROM (SELECT zone, coalesce(max(zone_sequence) FILTER (zone NOT IN ('tz_0', 'tz_1') OR recorded < TIMESTAMP '{EARLIER}'), 0) AS scanned,
            coalesce(max(zone_sequence) FILTER (lifecycle = 'active' AND (zone NOT IN ('tz_0', 'tz_1') OR recorded < TIMESTAMP '{EARLIER}')), 0) AS indexed,
            max(zone_sequence) * 9 // 10 AS cursor FROM seq GROUP BY 1)""",
    "pull_page": LOG + """,
        recs AS (
            SELECT zone, zone_sequence, event_id AS record_id, 'event' AS record_kind FROM seq
            UNION ALL SELECT s.zone, zone_sequence, erasure_id, 'erasure' FROM seq s JOIN erasures e ON e.target_id = s.event_id),
        p AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY zone_sequence, record_kind, record_id) AS place,
            count(*) OVER (PARTITION BY zone) AS n FROM recs WHERE zone_sequence > 100)
        SELECT zone, zone_sequence, record_id, record_kind, n > 50 AS has_more FROM p WHERE place <= 50""",
    "outbox_lease": LOG + """
        SELECT outbox_id, event_id, zone, attempts + 1 AS attempts, state AS was FROM outbox
        WHERE admission = 'admit' AND ((state = 'pending' AND available_at <= TIMESTAMP '2024-06-01') OR (state = 'leased' AND lease_expires_at <= TIMESTAMP '2024-06-01'))
        ORDER BY available_at, outbox_id LIMIT 200""",
    "outbox_retry": LOG + """
        SELECT outbox_id, CASE WHEN attempts >= 5 THEN 'dead' ELSE 'pending' END AS state,
            CASE WHEN attempts < 5 THEN CAST(least(3600, pow(2, least(10, greatest(1, attempts) - 1))) AS BIGINT) END AS delay_s
        FROM outbox WHERE last_error IS NOT NULL AND state <> 'delivered'""",
    "queue_counts": LOG + """
        SELECT zone, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'leased') AS leased,
            count(*) FILTER (state = 'delivered') AS delivered, count(*) FILTER (state = 'dead') AS dead FROM outbox GROUP BY 1""",
    "skip_reasons": LOG + "SELECT admission AS reason, count(*) AS n FROM outbox WHERE state = 'pending' GROUP BY 1",
    "idempotent_accept": LOG + "SELECT key, fingerprint, arrival, status FROM accepts",
    "telemetry_admit": LOG + """
        SELECT status, n AS n_requests, n * CASE status WHEN 'new' THEN 7 ELSE 3 END AS reads, n * CASE status WHEN 'new' THEN 153 ELSE 1 END AS writes,
            n * CASE status WHEN 'new' THEN 21504 ELSE 256 END AS bytes, n * CASE status WHEN 'new' THEN 25 ELSE 0 END AS row_count
        FROM (SELECT status, count(*) AS n FROM accepts GROUP BY 1)""",
    "latest_disposition": LOG + """,
        latest AS (SELECT event_id, arg_max(disposition, (created, policy)) AS disposition FROM dispositions GROUP BY 1)
        SELECT l.event_id, l.zone, coalesce(d.disposition, 'unknown') AS disposition FROM log l LEFT JOIN latest d ON d.event_id = l.target_id
        WHERE l.event_type = 'Claim'""",
    "held_unreviewed": LOG + """
        SELECT zone, policy, count(*) AS n_held, min(event_id) AS first_held FROM dispositions d
        WHERE disposition = 'hold' AND NOT (policy = 'v1' AND event_id IN (SELECT event_id FROM log WHERE event_type = 'Observation' AND n % 3 = 0))
        GROUP BY 1, 2""",
    "day_spend": LOG + """
        SELECT *, spend >= 5000.0 AS exceeded FROM (
            SELECT strftime(recorded, '%Y-%m-%d') AS day, round(sum(greatest(0.0, value)), 4) AS spend, count(*) AS calls FROM log GROUP BY 1)""",
    "token_cost": LOG + """
        SELECT zone, round(sum(CASE WHEN n % 10 = 0 AND k <> 0 THEN 0.0 ELSE (k * 40 * 0.0028 + (CASE WHEN n % 10 = 0 THEN k * 100 ELSE k * 60 END) * 0.14 + k * 7 * 0.28) / 1000000 END), 6) AS cost,
            count(*) FILTER (n % 10 = 0 AND k <> 0) AS n_rejected FROM log GROUP BY 1""",
    "import_reconcile": LOG + """
        SELECT CASE WHEN n % 3 = 0 THEN 'insert' WHEN n % 15 = 5 THEN 'conflict' ELSE 'skip' END AS status, count(*) AS n, min(event_id) AS first_id
        FROM log WHERE n % 5 = 0 GROUP BY 1""",
    "chunk_build": LOG + "SELECT chunk_id, chunk_kind, chunk_index, event_id, text_digest, status FROM chunk_ids",
    "structured_topk": LOG + """,
        newest AS (SELECT * FROM chunk_ids WHERE status = 'active' ORDER BY zone_sequence DESC, chunk_id LIMIT 2000),
        scored AS (SELECT chunk_id, chunk_kind, zone_sequence, round(least(1.0, len(list_filter(
            regexp_split_to_array(lower(chunk_kind || ' ' || lifecycle || ' ' || authority), '[^a-z0-9]+'),
            lambda x: x IN ('active', 'claim', 'summary', 'verified'))) / 4), 6) AS score FROM newest)
        SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, zone_sequence DESC, chunk_id LIMIT 50""",
    "graph_nodes": LOG + "SELECT node_id, node_kind, zone FROM nodes",
    "graph_edges": LOG + "SELECT edge_kind, from_id, to_id, zone FROM edges",
    "graph_density": LOG + """,
        ends AS (SELECT node_id, count(*) AS degree FROM (SELECT from_id AS node_id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY 1)
        SELECT node_kind, count(*) AS n_nodes, round(avg(coalesce(degree, 0)), 6) AS mean_degree, max(coalesce(degree, 0)) AS max_degree,
            count(*) FILTER (coalesce(degree, 0) = 0) AS n_isolated
        FROM nodes LEFT JOIN ends USING (node_id) GROUP BY 1""",
    "graph_khop": LOG + """,
        step AS (
            SELECT from_id AS a, to_id AS b FROM edges WHERE edge_kind IN ('derived_from', 'supports', 'supersedes', 'accepted_by')
            UNION SELECT to_id, from_id FROM edges WHERE edge_kind IN ('derived_from', 'supports', 'supersedes', 'accepted_by')),
        h0 AS (SELECT 'evt:' || event_id AS seed, 'evt:' || event_id AS node_id, 0 AS hop FROM log WHERE n % 50 = 0),
        h1 AS (SELECT DISTINCT seed, b AS node_id, 1 AS hop FROM h0 JOIN step ON a = node_id),
        h2 AS (SELECT DISTINCT seed, b AS node_id, 2 AS hop FROM h1 JOIN step ON a = node_id)
        SELECT seed, node_id, min(hop) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2""",
    "graph_threads": LOG_RECURSIVE + """,
        unit AS (SELECT 'evt:' || event_id AS id, subject, n FROM log WHERE event_type IN ('Observation', 'Claim')),
        link AS (
            SELECT a.n AS a, b.n AS b FROM edges e JOIN unit a ON a.id = e.from_id JOIN unit b ON b.id = e.to_id
            WHERE edge_kind IN ('derived_from', 'supports', 'supersedes') AND a.subject = b.subject),
        both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT n AS x, n AS y FROM unit UNION SELECT r.x, s.b FROM reach r JOIN both_ways s ON s.a = r.y),
        comp AS (SELECT x AS n, min(y) AS component FROM reach GROUP BY 1),
        thread AS (SELECT subject, component, count(*) AS n_members, min(id) AS first_member, sum(('0x' || substr(sha256(id), 1, 12))::BIGINT) AS total FROM unit JOIN comp USING (n) GROUP BY 1, 2)
        SELECT 'thread_' || substr(sha256(n_members || ':' || first_member || ':' || total), 1, 24) AS thread_id, subject, n_members, first_member
        FROM thread WHERE n_members > 1""",
    "lineage_trace": LOG + """,
        step AS (SELECT DISTINCT event_id AS a, target_id AS b FROM log WHERE target_id IS NOT NULL),
        h0 AS (SELECT event_id AS seed, event_id AS node_id FROM log WHERE decision = 'accepted'),
        h1 AS (SELECT seed, b AS node_id, 1 AS hop FROM h0 JOIN step ON a = node_id),
        h2 AS (SELECT seed, b AS node_id, 2 AS hop FROM h1 JOIN step ON a = node_id),
        h3 AS (SELECT seed, b AS node_id, 3 AS hop FROM h2 JOIN step ON a = node_id),
        h4 AS (SELECT seed, b AS node_id, 4 AS hop FROM h3 JOIN step ON a = node_id)
        SELECT seed, node_id, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4) GROUP BY 1, 2""",
    "ledger_gates": LOG + """,
        c AS (SELECT zone, event_type <> 'Supersession' AS q, lifecycle = 'active' AS r, k * 10 + 50 AS latency FROM log),
        r AS (SELECT zone, count(*) AS n, round(avg(q::INT), 6) AS quality_rate, round(avg(r::INT), 6) AS reviewer_rate,
            list_sort(list(latency))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95_ms FROM c GROUP BY 1)
        SELECT *, concat_ws(',', CASE WHEN quality_rate < 0.7 THEN 'quality' END, CASE WHEN reviewer_rate < 0.85 THEN 'reviewer' END,
            CASE WHEN p95_ms > 5000 THEN 'latency' END) AS blockers FROM r""",
    "token_stats": """
        SELECT doc_id, len(t) AS n_search, len(list_distinct(t)) AS n_distinct, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n_embedding,
            sha256(array_to_string(t, ' ')) AS digest
        FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents)""",
    "scrub_text": f"SELECT doc_id, length(t) AS n, sha256(t) AS digest FROM (SELECT doc_id, {scrubbed('text')} AS t FROM documents)",
    "head_tail_view": f"""
        SELECT doc_id, length(v) AS n, sha256(v) AS digest FROM (
            SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, (400 - 15) // 2) || {MARKER} || right(text, 400 - 15 - (400 - 15) // 2) END AS v
            FROM documents)""",
    "line_residual": f"""
        SELECT doc_id, len(list_filter(k, lambda x: x = 'kept')) AS kept, len(list_filter(k, lambda x: x = 'secret')) AS secret, len(list_filter(k, lambda x: x = 'tool')) AS tool,
            len(list_filter(k, lambda x: x = 'telemetry')) AS telemetry
        FROM (SELECT doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> ''), lambda x: {line_kinds('x')}) AS k FROM documents)""",
    "lexical_topk": TOKENS + "SELECT item_id, doc_id, score, rank FROM lexical WHERE rank <= 10",
    "hash_embedding_topk": TOKENS + HASHED + "SELECT item_id, doc_id, score, rank FROM semantic WHERE rank <= 5",
    "hybrid_search": TOKENS + HASHED + f""",
        cand AS (
            SELECT item_id, doc_id, coalesce(l.score, 0.0) AS fts, coalesce(s.score, 0.0) AS semantic
            FROM (SELECT * FROM lexical WHERE rank <= 40) l FULL JOIN (SELECT * FROM semantic WHERE rank <= 40) s USING (item_id, doc_id)),
        kinds AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'claim' ELSE 'evidence_excerpt' END AS chunk_kind FROM cand),
        totals AS (SELECT *, round({PRIORITY} * 0.4 + CASE WHEN chunk_kind = 'evidence_excerpt' THEN 0 WHEN doc_id % 3 = 0 THEN 0.18 ELSE 0.45 END
            + fts + semantic + 0.1 / (1 + ((SELECT max(doc_id) FROM documents) - doc_id) / 100), 6) AS total FROM kinds),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY total DESC, {PRIORITY} DESC, semantic DESC, fts DESC, doc_id) AS rank FROM totals)
        SELECT item_id, doc_id, chunk_kind, fts, semantic, total, rank FROM r WHERE rank <= 10""",
    "vector_knn": """
        WITH s AS (
            SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
            FROM embeddings q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "near_dup_pairs": DUPLICATES + """,
        r AS (SELECT doc_id, t, len(t) AS n FROM classes WHERE doc_id = class_id AND len(t) > 0),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) AS shared, a.n + b.n AS n
            FROM r a JOIN r b ON a.doc_id < b.doc_id AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 9)
        SELECT a, b, round(shared / (n - shared), 6) AS similarity FROM p WHERE shared * 10 >= (n - shared) * 9""",
    "near_dup_classes": DUPLICATES + "SELECT doc_id, class_id FROM classes",
    "retrieval_metrics": TOKENS + """,
        due AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''),
        n AS (SELECT item_id, count(*) AS due FROM due GROUP BY 1),
        h AS (SELECT item_id, count(*) FILTER (l.rank <= 3) AS found, min(l.rank) AS best FROM due JOIN lexical l USING (item_id, doc_id) WHERE l.rank <= 10 GROUP BY 1)
        SELECT count(*) AS n_queries, round(avg(coalesce(found, 0) / least(due, 3)), 6) AS macro_recall, round(avg(coalesce(1 / best, 0.0)), 6) AS mrr
        FROM n LEFT JOIN h USING (item_id)""",
    "quality_metrics": """
        WITH p AS (SELECT quality AS a, (length(text) > 500)::INT AS p FROM labels JOIN documents USING (doc_id))
        SELECT count(*) AS n, round(count(*) FILTER (a = p) / count(*), 6) AS accuracy,
            round(coalesce(count(*) FILTER (a = 1 AND p = 1) / nullif(count(*) FILTER (p = 1), 0), 1.0), 6) AS precision,
            round(coalesce(count(*) FILTER (a = 1 AND p = 1) / nullif(count(*) FILTER (a = 1), 0), 1.0), 6) AS recall FROM p""",
    "statement_dups": f"""
        WITH s AS (SELECT id, subject, lifecycle, statement FROM {cases.values(cases.STATEMENTS, 'id, subject, lifecycle, statement')}
            UNION ALL SELECT doc_id, 'documents', 'draft', text FROM documents),
        k AS (SELECT *, {statement_key('statement')} AS k FROM s)
        SELECT lower(subject) AS subject, sha256(k) AS key, arg_min(id, (CASE lifecycle WHEN 'active' THEN 0 WHEN 'draft' THEN 1 ELSE 2 END, id)) AS keep_id, count(*) AS n_statements
        FROM k WHERE length(k) >= 8 GROUP BY 1, 2 HAVING count(*) > 1""",
    "near_dup_hold": f"""
        WITH RECURSIVE t AS (SELECT doc_id AS id, source AS zone, nullif({statement_key('text')}, '') AS key FROM documents),
        k AS (SELECT id, zone, CASE WHEN key IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY key) END AS kid, row_number() OVER (PARTITION BY zone ORDER BY id) AS n FROM t),
        walk AS (
            SELECT DISTINCT zone, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST([] AS BIGINT[]) AS promoted, FALSE AS held, CAST(NULL AS INTEGER) AS gap FROM k
            UNION ALL SELECT zone, n, id, CASE WHEN gap <= 200 THEN promoted ELSE list_append(promoted, kid) END, coalesce(gap <= 200, FALSE), gap FROM (
                SELECT k.zone, k.n, k.id, k.kid, w.promoted, CASE WHEN kid >= 0 THEN nullif(list_position(list_reverse(promoted), kid), 0) END AS gap
                FROM walk w JOIN k ON k.zone IS NOT DISTINCT FROM w.zone AND k.n = w.n + 1))
        SELECT id, zone, CASE WHEN held THEN 'hold' ELSE 'promote' END AS decision, CAST(gap AS BIGINT) AS gap FROM walk WHERE n > 0""",
    "alias_lookup": LOG + f"""
        SELECT event_id AS alias, event_id FROM log UNION ALL SELECT {PAYLOAD.format('event_type', 'n')}, event_id FROM log""",
    "support_resolution": LOG + f"""
        SELECT c.event_id AS claim_id, coalesce(t.event_id, c.event_id) AS support_id, t.event_id IS NOT NULL AS resolved
        FROM log c LEFT JOIN log t ON t.n = c.target_n WHERE c.event_type = 'Claim'""",
    "latest_writers": LOG + """
        SELECT subject, event_type, arg_min(event_id, (recorded, n)) AS first_id, arg_max(event_id, (recorded, n)) AS last_id, count(*) AS n_events
        FROM log GROUP BY 1, 2""",
    "bundle_export": LOG + BUNDLE + "SELECT event_id, event_type, statement, sha256(statement) AS idempotency_key FROM bundle",
    "bundle_import": LOG + BUNDLE.replace(" LIMIT 100", "") + f"""
        SELECT CASE WHEN length(trim(statement)) < 8 THEN 'too_short' WHEN statement IN (SELECT statement FROM log WHERE recorded < '{EARLIER}' AND statement IS NOT NULL) THEN 'skipped'
            ELSE 'imported' END AS status, count(*) AS n FROM bundle GROUP BY 1""",
    "index_rebuild": f"""
        WITH o AS ({LOG.replace("FROM events", f"FROM (SELECT * FROM events WHERE ts < '{EARLIER}')")} SELECT chunk_id, text_digest FROM chunk_ids), n AS ({LOG} SELECT chunk_id, text_digest FROM chunk_ids)
        SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, CASE WHEN n.chunk_id IS NULL THEN 'stale' WHEN o.chunk_id IS NULL THEN 'added' WHEN o.text_digest <> n.text_digest THEN 'changed' ELSE 'kept' END AS status
        FROM o FULL JOIN n ON o.chunk_id = n.chunk_id""",
    "source_records": LOG + """,
        r AS (SELECT event_id AS of, zone, lpad(CAST(zone_sequence AS VARCHAR), 16, '0') AS q, event_type, event_id, lifecycle, authority FROM seq
            UNION SELECT a.event_id, b.zone, lpad(CAST(b.zone_sequence AS VARCHAR), 16, '0'), b.event_type, b.event_id, b.lifecycle, b.authority FROM seq a JOIN seq b ON b.event_id = a.target_id)
        SELECT of AS event_id, count(*) AS n_records, string_agg(event_id, ',' ORDER BY zone, q, event_type, event_id) AS ids,
            CASE WHEN bool_or(lifecycle = 'draft') THEN 'draft' ELSE 'active' END AS lifecycle,
            CASE WHEN bool_or(authority = 'verified') THEN 'verified' WHEN bool_or(authority = 'derived') THEN 'derived'
                ELSE arg_min(authority, (zone, q, event_type, event_id)) END AS authority FROM r GROUP BY 1""",
    "vault_notes": LOG + NOTES + "SELECT path, body, sha256(body) AS digest FROM notes",
    "missing_files": LOG + NOTES + f"SELECT path FROM notes WHERE recorded >= '{EARLIER}'",
    "dashboard": LOG + "SELECT kind, '- ' || kind || ': ' || count(*) || ' (' || max(loop_id) || ')' AS line FROM loops GROUP BY 1",
    "provenance_paths": LOG + """,
        h1 AS (SELECT l.event_id AS seed, l.target_id AS node, 1 AS hop FROM log l WHERE l.event_type = 'Observation' AND l.target_id IS NOT NULL),
        h2 AS (SELECT seed, l.target_id AS node, 2 AS hop FROM h1 JOIN log l ON l.event_id = h1.node WHERE l.target_id IS NOT NULL),
        h3 AS (SELECT seed, l.target_id AS node, 3 AS hop FROM h2 JOIN log l ON l.event_id = h2.node WHERE l.target_id IS NOT NULL)
        SELECT seed, max(hop) AS longest, count(*) + 1 AS n_reached FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY 1 HAVING max(hop) >= 2""",
    "proposal_edges": LOG + """,
        d AS (SELECT * FROM log WHERE event_type = 'Claim' AND lifecycle = 'draft')
        SELECT 'derived_from' AS kind, event_id AS from_id, target_id AS to_id FROM d WHERE target_id IS NOT NULL
        UNION ALL SELECT 'about', event_id, 'subj:' || subject FROM d
        UNION ALL SELECT 'supports', event_id, target_id FROM d WHERE target_id IS NOT NULL
        UNION ALL SELECT 'supports', event_id, target_id FROM d WHERE target_id IS NOT NULL AND k % 2 = 1""",
    "feed_backfill": LOG + """,
        p AS (SELECT event_id, k % 3 > 0 AS pending, coalesce(sum((k % 3 > 0)::INT) OVER (ORDER BY recorded, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
            FROM log WHERE event_type = 'EvidenceArtifact' AND n % 4 <> 0)
        SELECT event_id, CASE WHEN pending THEN 'pending' ELSE 'skipped' END AS state FROM p WHERE ahead < 40""",
    "unit_resolution": f"""
        WITH l AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: trim(x)), lambda x: length(x) >= 8) AS lines FROM documents),
        b AS (SELECT *, coalesce(list_sort(list_transform(lines, lambda x, i: {{'s': CASE WHEN regexp_matches(x, '(?i)\\b(?:decision|constraint|preference|we will|must never|require|prefer)\\b') THEN 6 ELSE 0 END
            - CASE WHEN length(x) < 16 THEN 3 ELSE 0 END + CASE WHEN length(x) >= 40 THEN 2 ELSE 0 END, 'n': length(x), 'o': -i, 'l': x}}), 'DESC')[1].l, '') AS s FROM l),
        u AS (SELECT doc_id, text, s, asked FROM b, (VALUES ('R0'), ('R1'), ('R2'), ('R3')) AS v(asked)),
        r AS (SELECT *, CASE WHEN asked = 'R3' AND length(text) <= 500 THEN 'R3' WHEN asked >= 'R2' THEN 'R2' WHEN asked = 'R1' AND doc_id % 2 = 0 THEN 'R1' ELSE 'R0' END AS level FROM u)
        SELECT doc_id, asked, level, sha256(CASE level WHEN 'R3' THEN text WHEN 'R2' THEN CASE WHEN length(s) <= 500 THEN s ELSE substr(s, 1, 499) || '…' END END) AS digest FROM r""",
    "conversation_roles": """
        SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations,
            sum(len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS n_tokens FROM conversations GROUP BY 1""",
}
