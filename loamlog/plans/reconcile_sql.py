"""The reconciliation queries in SQL: sources, judgements and relations, then the verdicts."""

from __future__ import annotations

from loamlog.plans.oracle import LOG_RECURSIVE

OBS = "'obs_' || lpad(CAST({} AS VARCHAR), 9, '0') || '_{}'"

INPUTS = f""",
ev AS (SELECT *, k % 23 AS c, CASE WHEN k % 23 = 0 THEN 'hold' ELSE 'promote' END AS old_said,
    CASE WHEN n % 4 < 2 THEN 'promote' WHEN n % 4 = 2 THEN 'reject' ELSE 'hold' END AS new_said FROM log WHERE event_type = 'EvidenceArtifact'),
src AS (SELECT event_id AS source_id, zone, subject, c = 13 AS imported, c <> 14 AS conforms FROM ev WHERE c <> 15),
jud AS (SELECT event_id AS source_id, 'v1' AS policy, old_said AS said FROM ev UNION ALL SELECT event_id, 'v2', new_said FROM ev WHERE c <> 9 UNION ALL SELECT event_id, 'v2', new_said FROM ev WHERE c = 10),
rev AS (SELECT event_id AS source_id, 'v1' AS policy, 'promote' AS decision FROM ev WHERE old_said = 'hold'
    UNION ALL SELECT event_id, 'v2', CASE WHEN c = 12 THEN 'reject' ELSE 'promote' END FROM ev WHERE new_said = 'hold' AND c <> 11),
obs AS (SELECT event_id AS source_id, {OBS.format('CASE WHEN c = 20 THEN n // 50 * 50 ELSE n END', 1)} || again AS event_id, 'v1' AS policy, CASE WHEN c IN (0, 3) THEN 'held' ELSE 'ordinary' END AS key,
        subject, CASE WHEN c = 16 THEN 'draft' ELSE 'active' END AS lifecycle, c = 8 AS imported FROM ev, (VALUES (''), ('b')) AS t(again) WHERE c <> 1 AND (again = '' OR c = 2)
    UNION ALL SELECT event_id, {OBS.format('n', 2)} || again, 'v2', CASE WHEN new_said = 'hold' THEN 'held' ELSE 'ordinary' END, CASE WHEN c = 6 THEN 'subject_other' ELSE subject END, 'active', c = 7
        FROM ev, (VALUES (''), ('b')) AS t(again) WHERE new_said <> 'reject' AND c <> 4 AND (again = '' OR c = 5)),
rel AS (SELECT s.event_id, CASE WHEN s.k % 6 = 5 THEN s.zone ELSE e.zone END AS zone, CASE WHEN s.k % 6 = 3 THEN {OBS.format('e.n', 2)} ELSE {OBS.format('e.n', 1)} END AS target,
        CASE s.k % 6 WHEN 1 THEN {OBS.format('e.n', 2)} WHEN 2 THEN {OBS.format('e.n', 2)} WHEN 3 THEN {OBS.format('e.n', 1)} WHEN 4 THEN {OBS.format('s.n', 2)} END AS replacement, s.n % 5 = 0 AS imported
    FROM log s JOIN ev e ON e.event_id = s.target_id WHERE s.event_type = 'Supersession'),
lin AS (SELECT source_id, event_id AS ref_id FROM obs WHERE lifecycle = 'active' UNION ALL SELECT event_id, target_id FROM ev WHERE c IN (17, 18, 19) AND target_id IS NOT NULL)"""

VERDICTS = """,
auth AS (
    SELECT source_id, policy, nj, nr, said, CASE WHEN nj = 1 AND nr = 0 AND said = 'promote' THEN 'ordinary' WHEN nj = 1 AND nr = 1 AND said = 'hold' AND decision = 'promote' THEN 'held' END AS authority
    FROM (SELECT source_id, policy, count(*) AS nj, min(said) AS said FROM jud GROUP BY 1, 2)
    LEFT JOIN (SELECT source_id, policy, count(*) AS nr_, min(decision) AS decision FROM rev GROUP BY 1, 2) USING (source_id, policy), LATERAL (SELECT coalesce(nr_, 0) AS nr)),
act AS (SELECT o.*, a.authority, s.subject AS own FROM obs o LEFT JOIN auth a USING (source_id, policy) LEFT JOIN src s USING (source_id) WHERE lifecycle = 'active'),
facts AS (
    SELECT source_id, policy, count(*) FILTER (key = authority) AS n_targets, min(event_id) FILTER (key = authority) AS id, min(event_id) FILTER (key = authority AND imported) AS imported_id,
        bool_or(key IS DISTINCT FROM authority) AS wrong, bool_or(subject <> own) AS strange FROM act GROUP BY 1, 2),
asked AS (SELECT DISTINCT source_id FROM jud),
joined AS (
    SELECT q.source_id, s.zone, s.source_id IS NOT NULL AS known, s.imported, s.conforms, coalesce(o.n_targets, 0) AS old_targets, o.id AS old_id, o.imported_id AS old_imported,
        coalesce(n.n_targets, 0) AS new_targets, n.id AS new_id, n.imported_id AS new_imported, coalesce(o.wrong, false) OR coalesce(n.wrong, false) AS wrong, coalesce(o.strange, false) OR coalesce(n.strange, false) AS strange,
        coalesce(b.nj, 0) AS new_n, coalesce(b.nr, 0) AS new_m, b.said AS new_said, b.authority AS new_key, coalesce(a.nj, 0) + coalesce(b.nj, 0) >= 3 AS many
    FROM asked q LEFT JOIN src s USING (source_id) LEFT JOIN (SELECT * FROM facts WHERE policy = 'v1') o USING (source_id) LEFT JOIN (SELECT * FROM facts WHERE policy = 'v2') n USING (source_id)
    LEFT JOIN (SELECT * FROM auth WHERE policy = 'v1') a USING (source_id) LEFT JOIN (SELECT * FROM auth WHERE policy = 'v2') b USING (source_id)),
arcs AS (SELECT DISTINCT target AS a, replacement AS b FROM rel WHERE replacement IS NOT NULL),
walk AS (SELECT new_id AS start, new_id AS node FROM joined WHERE new_id IS NOT NULL UNION SELECT start, b FROM walk JOIN arcs ON a = node),
t AS (SELECT target, count(*) AS r_n, min(zone) AS z0, max(zone) AS z1, count(replacement) AS replaced, count(*) FILTER (replacement IS NULL AND imported) AS dropped_imported,
    count(*) FILTER (replacement IS NULL AND NOT imported) AS dropped FROM rel GROUP BY 1),
p AS (SELECT target, replacement, count(*) AS p_n, bool_or(imported) AS p_imported FROM rel WHERE replacement IS NOT NULL GROUP BY 1, 2),
matched AS (
    SELECT j.*, coalesce(r_n, 0) AS r_n, z0 <> zone OR z1 <> zone AS elsewhere, coalesce(replaced, 0) AS replaced, coalesce(dropped_imported, 0) AS dropped_imported, coalesce(dropped, 0) AS dropped,
        coalesce(p_n, 0) AS p_n, coalesce(p_imported, false) AS p_imported, EXISTS (SELECT 1 FROM walk w WHERE w.start = j.new_id AND w.node = j.old_id) AS round_
    FROM joined j LEFT JOIN t ON t.target = old_id LEFT JOIN p ON p.target = old_id AND p.replacement = new_id),
early AS (
    SELECT *, CASE WHEN NOT known THEN 'missing_unsafe' WHEN imported THEN 'imported_unsafe' WHEN NOT conforms OR many THEN 'lineage_unsafe' WHEN strange THEN 'lineage_unsafe' WHEN wrong THEN 'ambiguous_unsafe'
        WHEN old_imported IS NOT NULL OR new_imported IS NOT NULL THEN 'imported_unsafe' WHEN new_n = 0 THEN 'missing_unsafe'
        WHEN new_key IS NULL AND NOT (new_said = 'reject' AND new_m = 0) THEN CASE WHEN new_m = 0 THEN 'missing_unsafe' ELSE 'ambiguous_unsafe' END
        WHEN old_targets = 0 THEN 'missing_unsafe' WHEN old_targets > 1 THEN 'ambiguous_unsafe' END AS stop FROM matched),
said AS (
    SELECT source_id, zone, CASE WHEN NOT known THEN NULL WHEN stop = 'imported_unsafe' AND NOT imported THEN old_imported WHEN stop IS NULL THEN old_id END AS target_id,
        CASE WHEN NOT known THEN NULL WHEN stop = 'imported_unsafe' AND NOT imported THEN new_imported WHEN stop IS NULL AND new_key IS NOT NULL AND new_targets = 1 THEN new_id END AS replacement_id,
        coalesce(stop, CASE WHEN new_key IS NULL THEN
            CASE WHEN elsewhere THEN 'zone_unsafe' WHEN replaced > 0 THEN 'conflicting_intent_unsafe' WHEN dropped_imported > 0 THEN 'imported_unsafe' WHEN dropped = 1 THEN 'already_applied'
                WHEN dropped > 1 THEN 'ambiguous_unsafe' ELSE 'invalidate' END
            ELSE CASE WHEN new_targets = 0 THEN 'missing_unsafe' WHEN new_targets > 1 THEN 'ambiguous_unsafe' WHEN elsewhere THEN 'zone_unsafe' WHEN p_imported THEN 'imported_unsafe' WHEN round_ THEN 'cycle_unsafe'
                WHEN r_n > p_n THEN 'conflicting_intent_unsafe' WHEN p_n > 1 THEN 'ambiguous_unsafe' WHEN p_n = 1 THEN 'already_applied' ELSE 'replace' END END) AS reason,
        NOT known OR imported OR (conforms AND NOT many) AS conforms FROM early),
pairs AS (SELECT source_id AS a, target_id AS b FROM said UNION SELECT source_id, replacement_id FROM said UNION SELECT source_id, source_id FROM said UNION SELECT source_id, ref_id FROM lin
    UNION SELECT target, coalesce(replacement, target) FROM rel),
ways AS (SELECT a, b FROM pairs WHERE b IS NOT NULL UNION SELECT b, a FROM pairs WHERE b IS NOT NULL),
spread AS (SELECT a, b FROM ways UNION SELECT s.a, w.b FROM spread s JOIN ways w ON w.a = s.b),
homes AS (SELECT a AS node, min(b) AS least FROM spread GROUP BY 1),
parts AS (SELECT least, 'cmp:' || sha256(count(*) || ':' || least || ':' || sum(('0x' || substr(sha256(node), 1, 12))::BIGINT)) AS component_id FROM homes GROUP BY 1),
entries AS (
    SELECT s.source_id, zone, target_id, replacement_id, CASE WHEN reason IN ('replace', 'invalidate') THEN 'eligible_write' WHEN reason = 'already_applied' THEN 'eligible_noop' ELSE 'unsafe_unchanged' END AS bucket,
        CASE WHEN reason IN ('replace', 'invalidate', 'already_applied') THEN reason ELSE 'none' END AS action, reason, conforms, component_id
    FROM said s JOIN homes h ON h.node = s.source_id JOIN parts USING (least))"""

TAINTS = """,
writable AS (SELECT * FROM entries WHERE bucket <> 'unsafe_unchanged'),
arcs2 AS (SELECT a, b FROM arcs UNION SELECT target_id, replacement_id FROM entries WHERE bucket = 'eligible_write' AND replacement_id IS NOT NULL),
walk2 AS (SELECT replacement_id AS start, replacement_id AS node FROM writable WHERE replacement_id IS NOT NULL UNION SELECT start, b FROM walk2 JOIN arcs2 ON a = node),
overlap AS (SELECT zone, component_id FROM entries GROUP BY 1, 2 HAVING bool_or(bucket = 'unsafe_unchanged') AND bool_or(bucket <> 'unsafe_unchanged')),
causal AS (
    SELECT zone, 'eligible_unsafe_overlap_global_taint' AS taint, component_id FROM overlap UNION SELECT zone, 'unsafe_influences_eligible_global_taint', component_id FROM overlap
    UNION SELECT zone, 'conflicting_eligible_intent_global_taint', component_id FROM entries e WHERE bucket = 'eligible_write'
        AND (SELECT count(*) FROM entries o WHERE o.bucket = 'eligible_write' AND o.zone = e.zone AND o.target_id = e.target_id) > 1
    UNION SELECT zone, 'eligible_reachable_cycle_global_taint', component_id FROM writable e WHERE EXISTS (SELECT 1 FROM walk2 w WHERE w.start = e.replacement_id AND w.node = e.target_id)
    UNION SELECT zone, 'unproved_conformance_global_taint', component_id FROM entries WHERE NOT conforms),
tainted AS (
    SELECT * FROM causal UNION SELECT e.zone, CASE reason WHEN 'imported_unsafe' THEN 'eligible_imported_shared_lineage_global_taint' WHEN 'cycle_unsafe' THEN 'eligible_reachable_cycle_global_taint'
        WHEN 'zone_unsafe' THEN 'eligible_cross_zone_global_taint' WHEN 'conflicting_intent_unsafe' THEN 'conflicting_eligible_intent_global_taint' END AS taint, component_id
    FROM entries e WHERE bucket = 'unsafe_unchanged' AND reason IN ('imported_unsafe', 'cycle_unsafe', 'zone_unsafe', 'conflicting_intent_unsafe') AND (zone, component_id) IN (SELECT zone, component_id FROM causal))"""

PLAN = """,
told AS (SELECT zone, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (SELECT zone, reason, count(*) AS n FROM entries GROUP BY 1, 2) GROUP BY 1),
hashed AS (SELECT zone, sha256('{"action":"' || action || '","bucket":"' || bucket || '","component_id":"' || component_id || '","reason":"' || reason || '","replacement_id":' || coalesce('"' || replacement_id || '"', 'null')
    || ',"source_id":"' || source_id || '","target_id":' || coalesce('"' || target_id || '"', 'null') || '}') AS h FROM entries),
sums AS (SELECT zone, 'sha256:' || sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 12))::BIGINT) || ':' || sum(('0x' || substr(h, 13, 12))::BIGINT)) AS plan_digest FROM hashed GROUP BY 1),
why AS (SELECT zone, string_agg(DISTINCT taint, ',' ORDER BY taint) AS taints, count(DISTINCT component_id) AS nc FROM tainted GROUP BY 1),
inside AS (SELECT zone, count(*) AS ne FROM entries WHERE (zone, component_id) IN (SELECT zone, component_id FROM tainted) GROUP BY 1)
SELECT c.*, reasons, coalesce(taints, '') AS taints, coalesce(nc, 0) AS n_tainted_components, coalesce(ne, 0) AS n_tainted_entries, taints IS NULL AS admissible, true AS sound, plan_digest FROM (
    SELECT zone, count(*) AS n_entries, count(*) FILTER (bucket = 'eligible_write') AS n_writes, count(*) FILTER (bucket = 'eligible_noop') AS n_noops, count(*) FILTER (bucket = 'unsafe_unchanged') AS n_unsafe,
        count(*) FILTER (action = 'replace') AS n_replace, count(*) FILTER (action = 'invalidate') AS n_invalidate, count(*) FILTER (action = 'already_applied') AS n_applied FROM entries GROUP BY 1) c
    JOIN told ON told.zone IS NOT DISTINCT FROM c.zone JOIN sums ON sums.zone IS NOT DISTINCT FROM c.zone LEFT JOIN why ON why.zone IS NOT DISTINCT FROM c.zone LEFT JOIN inside ON inside.zone IS NOT DISTINCT FROM c.zone"""

BASE = LOG_RECURSIVE + INPUTS + VERDICTS

ORACLE_SQL = {
    "reconcile_verdicts": BASE + " SELECT source_id, zone, target_id, replacement_id, bucket, action, reason, conforms, component_id FROM entries",
    "reconcile_taints": BASE + TAINTS + " SELECT zone, taint, component_id FROM tainted",
    "reconcile_plan": BASE + TAINTS + PLAN,
}
