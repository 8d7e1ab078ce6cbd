"""Queries over signals, the lines captured at hooks, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.functions import prose as P
from loamlog.functions import text as T
from loamlog.operators import intake, metrics, policy, stages
from loamlog.plans.oracle import NOISE, hook, line_kinds, scrubbed, statement_key
from loamlog.sources import signals as S
from loamlog.sources import transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def of_signals(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(S.signals(spark, sf_dir))


def subject(rows: DataFrame) -> DataFrame:
    return rows.withColumn("subject", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("subject/"), (F.col("conv_id") % 13).cast("string"))))


def prose_rules(rows: DataFrame) -> DataFrame:
    s = F.col("signal")
    return rows.select(
        "case_id", P.is_durable(s).alias("durable"), P.is_future(s).alias("future"), P.is_correction(s).alias("correction"), F.array_join(P.obsolete_terms(s), "|").alias("terms"),
        F.sha2(P.sanitized(s), 256).alias("strict"), F.sha2(P.sanitized(s, strict=False), 256).alias("relaxed"),
    )


def redaction_checks(rows: DataFrame) -> DataFrame:
    text = rows.select("case_id", P.nfc_lf(F.col("signal")).alias("t"))
    return text.select("case_id", F.sha2("t", 256).alias("digest"), F.length("t").alias("scalars"), P.policy_code(F.col("t")).alias("code"))


def packs(rows: DataFrame) -> DataFrame:
    return stages.evidence_pack(rows)


def triaged(rows: DataFrame) -> DataFrame:
    told = F.split(stages.triage(F.col("pack_text")), ":")
    return packs(rows).where("error IS NULL").select("case_id", told[0].alias("decision"), told[1].alias("reason"))


def extracted(rows: DataFrame) -> DataFrame:
    return stages.extract(packs(rows))


def gate_rows(rows: DataFrame) -> DataFrame:
    """Extracted candidates, some with a changed quote or statement, as the gate gets them."""
    quote = F.when(F.col("turn") % 5 == 0, F.concat("quote", F.lit(" x"))).otherwise(F.col("quote"))
    statement = F.when(F.col("turn") % 7 == 3, "The moon is made of basalt and dust").otherwise(F.col("statement"))
    sure = F.when(F.col("conv_id") % 3 == 0, 0.9).when(F.col("conv_id") % 3 == 1, 0.5)
    return extracted(rows).where("quote IS NOT NULL").select("case_id", "kind", statement.alias("statement"), quote.alias("quote"), F.col("pack_text").alias("pack"), F.col("view"), sure.alias("confidence"))


def form_rows(rows: DataFrame) -> DataFrame:
    made = extracted(rows).where("quote IS NOT NULL")
    claim = F.col("kind").isin("decision", "fact_candidate")
    expected = F.when(F.col("zone") == "tz_3", "reject").when(F.col("turn") % 3 == 0, "insufficient").when(claim, "claim_candidate").otherwise("observation")
    return made.select("case_id", "statement", F.when(claim, "claim").otherwise("observation").alias("kind"), (F.col("zone") != "tz_3").alias("visible"), (F.col("turn") % 3).cast("int").alias("evidence"), expected.alias("expected"))


def kinds_and_quotes(rows: DataFrame) -> DataFrame:
    s = F.col("signal")
    return rows.select("case_id", policy.inferred_kind(s).alias("inferred"), T.kind_of(s).alias("candidate"), F.size(policy.sentences(s)).alias("n_sentences"), F.sha2(policy.best_line(s), 256).alias("quote"))


def targets(rows: DataFrame) -> DataFrame:
    made = extracted(rows).where("kind IS NOT NULL")
    return made.select("case_id", "kind", F.explode(stages.targets(F.col("kind"))).alias("target"), stages.claim_type(F.col("kind")).alias("claim_type"))


def adjudicated(rows: DataFrame) -> DataFrame:
    return policy.adjudicate(subject(rows))


def confusion(rows: DataFrame) -> DataFrame:
    rows = rows.where(T.hook(F.col("hook")).isin(*policy.PROMOTE_HOOKS))
    told = adjudicated(rows).select("case_id", F.col("disposition").alias("predicted")).join(rows.select("case_id", "expected"), "case_id")
    return metrics.confusion(told)


def taken(rows: DataFrame) -> DataFrame:
    return intake.intake(intake.envelopes(rows))


def sent_envelopes(rows: DataFrame) -> DataFrame:
    """A pack of a title and the signal for each case; some are damaged on the way."""
    record = lambda ordinal, text: F.to_json(F.struct(ordinal.cast("int").alias("ordinal"), text.alias("text")))
    second = F.when(F.col("turn") % 9 == 5, 2).otherwise(1)
    body = F.base64(F.concat(record(F.lit(0), F.lit("evidence")), F.lit("\n"), record(second, F.col("signal"))).cast("binary"))
    return rows.select(F.col("case_id").alias("pack_id"), F.when(F.col("turn") % 9 == 4, "not base64!").otherwise(body).alias("body"))


of_signals("envelope_redaction", lambda rows: transcripts.redact_envelopes(sent_envelopes(rows)))
of_signals("prose_rules", prose_rules)
of_signals("redaction_checks", redaction_checks)
of_signals("evidence_packs", lambda rows: packs(rows).select("case_id", "error", "pack_digest", F.sha2("view", 256).alias("view")))
of_signals("triage_decisions", triaged)
of_signals("extract_candidates", lambda rows: extracted(rows).select("case_id", "reason", "kind", F.sha2("statement", 256).alias("statement"), "start", "end"))
of_signals("materialize_targets", targets)
of_signals("stage_digests", lambda rows: stages.stage_chain(packs(rows)))
of_signals("proposal_upsert", lambda rows: stages.proposals(extracted(rows)).select("proposal_id", "case_id", "zone", "kind", "gate", "n_writes", "materialized_id"))
of_signals("proposal_lists", lambda rows: stages.proposal_lists(stages.proposals(extracted(rows)), 50))
of_signals("report_redaction", lambda rows: stages.redacted(stages.proposals(extracted(rows))))
of_signals("adjudicate", lambda rows: adjudicated(rows).select("case_id", "disposition", "reasons", "value", "durability", "risk", "noise", "kind", F.sha2("statement", 256).alias("statement"), "lifecycle"))
of_signals("adjudication_confusion", confusion)
of_signals("kind_recall", lambda rows: metrics.kind_recall(rows.select("case_id", "expect_kind").join(extracted(rows).select("case_id", "kind", F.when(F.col("kind").isin(*policy.PROMOTE_KINDS), "promote").otherwise("hold").alias("gate")), "case_id", "left")))
of_signals("observation_plans", lambda rows: policy.observation_plan(subject(rows)))
of_signals("capture_intake", lambda rows: taken(rows).drop("conv_id", "turn"))
of_signals("feed_list", lambda rows: intake.feed_list(taken(rows), "tz_1", "pending", 40))
of_signals("run_ledger", lambda rows: intake.run_ledger(taken(rows)))
of_signals("front_gate", lambda rows: policy.front_gate(rows.select("case_id", "hook", "signal")).withColumn("residual", F.sha2("residual", 256)))
of_signals("gate_verify", lambda rows: policy.gate(gate_rows(rows)))
of_signals("quality_filter", lambda rows: policy.quality_filter(gate_rows(rows)))
of_signals("statement_kinds", kinds_and_quotes)
of_signals("knowledge_form", lambda rows: metrics.form_quality(policy.knowledge_form(form_rows(rows))))
of_signals("contradiction_pairs", lambda rows: policy.contradictions(rows.select(F.col("conv_id").cast("string").alias("subject"), F.col("turn").alias("id"), F.col("signal").alias("statement"))))


def re2(pattern: str) -> str:
    """A pattern as DuckDB writes it: the plain ASCII word boundary, quotes doubled."""
    return pattern.replace(T.B, r"\b").replace("'", "''")


def matches(column: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{re2(p)}')" for p in patterns) + ")"


def literals(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def at(values, index: str) -> str:
    values = list(values)
    return f"{literals(values)}[CAST(({index}) % {len(values)} + 1 AS INT)]"


def flat(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def secret(column: str) -> str:
    return matches(column, *T.SECRET_MATERIAL)


def token(column: str, fallback: str) -> str:
    return f"CASE WHEN coalesce(length(trim({column})), 0) = 0 THEN '{fallback}' ELSE substr(regexp_replace(trim({column}), '[^\\w./+-]+', '_', 'g'), 1, 64) END"


def policy_code(column: str) -> str:
    bare = f"trim({column})"
    braced = f"((starts_with({bare}, '{{') AND ends_with({bare}, '}}')) OR (starts_with({bare}, '[') AND ends_with({bare}, ']')))"
    return "CASE " + " ".join(
        f"WHEN {matches(column, *patterns) if patterns else f'{braced} AND json_valid({bare})'} THEN '{code}'" for code, patterns in P.POLICY
    ) + " END"


def kind_case(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {matches(column, pattern, T.KINDS_KO[kind])} THEN '{kind}'" for kind, pattern in T.KINDS) + " END"


def nfc_lf(column: str) -> str:
    return f"regexp_replace(nfc_normalize({column}), '\\r\\n?', chr(10), 'g')"


SIGNALS = f"""
WITH signals AS (
    SELECT conv_id || ':' || turn AS case_id, conv_id, turn, role, {at(S.HOOK_NAMES, 'conv_id + turn * 3')} AS hook, {at(S.PROVIDERS, 'conv_id')} AS provider,
        'tz_' || (conv_id % 4) AS zone, {at([e for _, e in S.PHRASES], 'conv_id * 7 + turn')} AS expected,
        CASE (conv_id + turn) % 3 WHEN 0 THEN phrase WHEN 1 THEN phrase || chr(10) || t ELSE t END AS signal,
        CASE WHEN turn % 2 = 0 THEN 'subject/' || (conv_id % 13) END AS subject
    FROM (SELECT *, coalesce(text, '') AS t, {at([p for p, _ in S.PHRASES], 'conv_id * 7 + turn')} AS phrase FROM conversations))"""
VIEW = 400
ROOM = VIEW - len(T.MARKER)
PACKS = SIGNALS + f""",
bodies AS (SELECT *, {nfc_lf(f"trim({scrubbed('trim(signal)')})")} AS body FROM signals),
packs AS (
    SELECT *, CASE WHEN error IS NULL THEN 'evidence' || chr(10) || body END AS pack_text FROM (
        SELECT *, CASE WHEN body = '' THEN 'empty_body' ELSE {policy_code('body')} END AS error FROM bodies)),
viewed AS (
    SELECT *, 'sha256:' || sha256(pack_text) AS pack_digest, CASE WHEN length(pack_text) <= {VIEW} THEN pack_text
        ELSE substr(pack_text, 1, {ROOM // 2}) || chr(10) || '…[truncated]…' || chr(10) || right(pack_text, {ROOM - ROOM // 2}) END AS view FROM packs)"""
LINE_SCORE = f"""CASE WHEN {matches('x', stages.DECISION, stages.DECISION_KO)} THEN 12 ELSE 0 END + CASE WHEN {matches('x', stages.STRONG)} THEN 6 ELSE 0 END
    + CASE WHEN {matches('x', stages.DECISION_KO)} THEN 6 ELSE 0 END - CASE WHEN length(x) < 16 THEN 3 ELSE 0 END + CASE WHEN length(x) >= 40 THEN 2 ELSE 0 END"""
QUOTE_KIND = "CASE " + " ".join(f"WHEN {matches('quote', p, ko)} THEN '{kind}'" for kind, p, ko in stages.KINDS) + f" WHEN {matches('quote', '[?？]')} THEN 'open_question' ELSE 'fact_candidate' END"
EXTRACTED = PACKS + f""",
bare AS (SELECT *, trim(pack_text) AS b FROM viewed),
lined AS (
    SELECT *, b IS NULL OR length(b) < 8 OR {matches('b', stages.NOISE, stages.INJECTED)} AS nothing,
        list_filter(list_transform(regexp_split_to_array(b, '\\n+'), lambda x: trim(x)), lambda x: length(x) >= 8 AND NOT {matches('x', stages.META_LINE)}) AS lines FROM bare),
quoted AS (
    SELECT *, CASE WHEN NOT nothing THEN coalesce(
        list_sort(list_transform(lines, lambda x, i: {{'s': {LINE_SCORE}, 'n': length(x), 'o': -i, 'l': x}}), 'DESC')[1].l,
        CASE WHEN length(b) >= 8 AND NOT {matches('b', stages.META_LINE)} THEN b END) END AS quote FROM lined),
extracted AS (
    SELECT *, CASE WHEN nothing THEN 'no_candidate' WHEN quote IS NULL THEN 'no_citable_span' ELSE 'extracted' END AS reason,
        CASE WHEN quote IS NOT NULL THEN {QUOTE_KIND} END AS kind, CASE WHEN length(quote) > 200 THEN substr(quote, 1, 197) || '...' ELSE quote END AS statement,
        instr(pack_text, quote) - 1 AS start_at FROM quoted)"""
PROPOSALS = EXTRACTED + """,
named AS (SELECT *, 'prp_' || substr(sha256(zone || ':' || pack_digest || ':' || kind || ':' || quote), 1, 32) AS proposal_id FROM extracted WHERE reason = 'extracted'),
firsts AS (
    SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY conv_id, turn) AS r, count(*) OVER (PARTITION BY proposal_id) AS n_writes FROM named),
gated AS (SELECT *, CASE WHEN kind IN ('decision', 'constraint', 'preference') THEN 'promote' ELSE 'hold' END AS gate FROM firsts WHERE r = 1),
proposals AS (SELECT *, CASE WHEN gate = 'promote' AND turn % 2 = 0 THEN 'evt_' || case_id END AS materialized_id FROM gated)"""
GATED = EXTRACTED + """,
gate_rows AS (
    SELECT case_id, kind, CASE WHEN turn % 7 = 3 THEN 'The moon is made of basalt and dust' ELSE statement END AS statement,
        CASE WHEN turn % 5 = 0 THEN quote || ' x' ELSE quote END AS quote, pack_text AS pack, view,
        CASE conv_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 END AS confidence FROM extracted WHERE quote IS NOT NULL)"""


def stage_json(stage: str, previous: str) -> str:
    before = f"coalesce('\"' || {previous} || '\"', 'null')" if previous else "'null'"
    return f"""'sha256:' || sha256('{{"extra":null,"model_id":"rules","pack_digest":"' || pack_digest || '","policy_version":"v1","prev_output_digest":' || {before}
        || ',"prompt_version":"{stage}/v1","schema":"stage/v1","schema_version":"stage/v1","source_event_id":"' || case_id || '","stage":"{stage}","trust_zone_id":"' || zone || '"}}')"""


def metadata(hook_column: str) -> str:
    place = "coalesce(subject, 'project')"
    return f"'Captured ' || {token('provider', 'unknown')} || ' ' || {token(hook_column, 'unknown')} || ' evidence (transcript, application/json) for ' || {place} || '.'"


REJECT = policy.REJECTED


def fixed(i: int, otherwise: str) -> str:
    return "round(CASE early " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in REJECT.items()) + f" ELSE {otherwise} END, 6)"


ADJUDICATED = SIGNALS + f""",
cut AS (SELECT *, trim(signal) AS s, {hook('hook')} AS h, substr({flat('signal')}, 1, 1200) AS f FROM signals),
parted AS (SELECT *, list_transform(string_split(regexp_replace(f, '([.!?]+) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)) AS parts,
    f = '' OR {matches('f', T.NOISE_SIGNAL)} OR {secret('f')} OR {matches('f', P.DUMP)} AS refused FROM cut),
spanned AS (SELECT *, CASE WHEN refused THEN [] ELSE list_filter(list_transform(parts, lambda x: {{'k': {kind_case('x')}, 't': trim(substr(x, 1, 240)), 'n': length(x)}}), lambda x: x.k IS NOT NULL AND x.n >= 12) END AS spans FROM parted),
stated AS (SELECT *, len(spans) > 0 AS has, length(s) AS n, spans[1].k AS kind, {metadata('hook')} || CASE WHEN len(spans) > 0 THEN ' Knowledge fragment (' || spans[1].k || '): ' || spans[1].t ELSE '' END AS statement,
    h IN ('Stop', 'SessionEnd', 'PreCompact') AS boundary, h = 'UserPromptSubmit' AS holding FROM spanned),
early AS (SELECT *, {matches('s', T.VALUE_TERMS)} OR {matches('statement', T.VALUE_TERMS)} AS terms, CASE WHEN {secret('statement')} OR {secret('s')} THEN 'secret_like_material'
    WHEN h = 'PostToolUse' THEN 'post_tool_use_noise' WHEN NOT boundary AND NOT holding THEN 'lifecycle_not_eligible'
    WHEN n > 0 AND {matches('s', T.NOISE_SIGNAL)} THEN 'noise_only_signal' END AS early FROM stated),
scored AS (SELECT *, {fixed(0, "least(1, least(CASE WHEN n = 0 THEN 0.45 ELSE 9 END, 0.25 + boundary::INT * 0.35 + holding::INT * 0.15 + terms::INT * 0.3 + (n >= 40)::INT * 0.1))")} AS value,
    {fixed(1, "least(1, 0.3 + boundary::INT * 0.35 + holding::INT * 0.1 + terms::INT * 0.2 + (n >= 40)::INT * 0.1)")} AS durability, {fixed(2, "0.1")} AS risk,
    {fixed(3, "least(1, 0.4 + holding::INT * 0.15 + (n > 0 AND n < 12)::INT * 0.25 + (n = 0)::INT * 0.2)")} AS noise FROM early),
judged AS (SELECT *, CASE WHEN early IS NOT NULL THEN 'reject' WHEN has AND value * 0.5 + durability * 0.4 - noise * 0.35 - risk * 0.5 >= 0.45 - 1e-9 AND value >= 0.5 AND noise < 0.55
    AND boundary AND n >= 20 THEN 'promote' ELSE 'hold' END AS disposition FROM scored)"""
INTAKE = SIGNALS + f""",
env AS (
    SELECT *, CASE WHEN conv_id % 11 = 5 THEN NULL ELSE make_timestamp(2024, 3, 1 + conv_id % 7, 10 + turn % 10, (conv_id * 17 + turn) % 60, 0) - CASE WHEN turn % 3 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END END AS moment,
        CASE turn % 3 WHEN 0 THEN ':00Z' WHEN 1 THEN ':00.250Z' ELSE ':30Z' END AS tail, 'ses_' || conv_id AS session_id,
        CASE WHEN turn % 4 = 1 THEN 'key-' || conv_id || '-' || {hook('hook')} END AS given, role = 'assistant' AS trace FROM signals),
timed AS (SELECT *, strftime(moment, '%Y-%m-%dT%H:%M') || tail AS valid_start FROM env),
faulty AS (SELECT *, CASE WHEN trim(provider) = '' THEN 'provider_required' WHEN trim(hook) = '' THEN 'hook_required' WHEN moment IS NULL THEN 'invalid_timestamp' END AS fault FROM timed),
printed AS (SELECT *, 'sha-256:' || sha256(zone || ':' || '{{' || coalesce('"captured_at":"' || valid_start || '",', '') || '"hook_event_name":"' || hook || '","payload":"' || sha256(signal) || '","provider":"' || provider
    || '","session_id":"' || session_id || '"}}') AS fingerprint FROM faulty),
keyed AS (SELECT *, coalesce(given, 'idem_' || substr(sha256(concat_ws(':', zone, session_id, hook, valid_start, sha256(signal))), 1, 32)) AS key FROM printed),
seeded AS (SELECT *, sha256(zone || ':' || key || ':' || fingerprint) AS seed,
    first_value(case_id) OVER w AS first_case, first_value(fingerprint) OVER w AS first_print FROM keyed
    WINDOW w AS (PARTITION BY zone, key, fault IS NULL ORDER BY conv_id, turn)),
taken AS (SELECT *, CASE WHEN fault IS NOT NULL THEN 'invalid' WHEN first_case = case_id THEN 'accepted' WHEN first_print = fingerprint THEN 'replay' ELSE 'conflict' END AS status FROM seeded),
intake AS (
    SELECT case_id, conv_id, turn, zone, session_id, status, fault, CASE WHEN status = 'accepted' THEN 'evt_' || substr(seed, 1, 32) END AS event_id,
        CASE WHEN status = 'accepted' THEN 'art_' || substr(seed, 33, 32) END AS artifact_id, fingerprint, CASE WHEN trace THEN 'procedure_trace' ELSE 'message' END AS kind,
        CASE WHEN trace THEN 'application/vnd.procedure-trace+json' ELSE 'application/json' END AS media_type, valid_start, subject,
        CASE WHEN status = 'accepted' THEN CASE WHEN {hook('hook')} IN ('SessionEnd', 'Stop', 'PreCompact') THEN 'pending' ELSE 'skipped' END END AS feed_state FROM taken)"""

ORACLE_SQL: dict[str, str] = {
    "prose_rules": SIGNALS + f""",
        f AS (SELECT *, {flat('signal')} AS f, lower({flat('signal')}) AS low FROM signals),
        t AS (SELECT *, list_filter([{', '.join(f"trim(regexp_extract(low, '{re2(p)}', 1))" for p in P.OBSOLETE)}], lambda x: length(x) >= 2) AS terms,
            {matches('signal', P.FUTURE, P.FUTURE_KO)} AS future, length(f) < 4 OR {matches('f', P.SHORT_NOISE)} OR {secret('f')} AS bad FROM f)
        SELECT case_id, NOT {matches('signal', P.SHORT_NOISE)} AND NOT future AND {matches('signal', P.DURABLE, P.DURABLE_KO)} AS durable, future, {matches('signal', P.CORRECTION, P.CORRECTION_KO)} AS correction,
            coalesce(array_to_string(terms, '|'), '') AS terms, CASE WHEN NOT bad AND length(f) >= 8 AND NOT {matches('f', P.DUMP)} THEN sha256(substr(f, 1, 1200)) END AS strict,
            CASE WHEN NOT bad THEN sha256(substr(f, 1, 1200)) END AS relaxed FROM t""",
    "envelope_redaction": SIGNALS + f""",
        t AS (SELECT case_id, turn, {nfc_lf('signal')} AS t FROM signals),
        e AS (SELECT *, CASE turn % 9 WHEN 4 THEN 'invalid_base64' WHEN 5 THEN 'ordinal_mismatch' ELSE {policy_code('t')} END AS error FROM t)
        SELECT case_id AS pack_id, error, CASE WHEN error IS NULL THEN 2 END AS n_records, CASE WHEN error IS NULL THEN sha256('evidence' || chr(10) || t) END AS digest FROM e""",
    "redaction_checks": SIGNALS + f""",
        t AS (SELECT case_id, {nfc_lf('signal')} AS t FROM signals)
        SELECT case_id, sha256(t) AS digest, length(t) AS scalars, {policy_code('t')} AS code FROM t""",
    "evidence_packs": PACKS + "SELECT case_id, error, pack_digest, sha256(view) AS view FROM viewed",
    "triage_decisions": PACKS + f""",
        b AS (SELECT case_id, trim(pack_text) AS b FROM packs WHERE error IS NULL),
        d AS (SELECT *, {matches('b', stages.DECISION, stages.DECISION_KO)} AS decided, {matches('b', stages.FACT)} AS fact FROM b),
        o AS (SELECT case_id, CASE WHEN length(b) < 8 THEN 'drop:empty_or_too_short' WHEN {matches('b', stages.INJECTED)} THEN 'drop:injection_pattern'
            WHEN {matches('b', stages.TOOL_ONLY)} OR ({matches('b', stages.NOISE)} AND NOT decided) THEN 'drop:tool_noise' WHEN decided THEN 'keep:decision_class_signal'
            WHEN {matches('b', stages.AMBIGUOUS)} AND NOT fact THEN 'need_context:ambiguous_language' WHEN fact THEN 'keep:fact_class_signal' ELSE 'drop:no_knowledge_signal' END AS o FROM d)
        SELECT case_id, split_part(o, ':', 1) AS decision, split_part(o, ':', 2) AS reason FROM o""",
    "extract_candidates": EXTRACTED + """
        SELECT case_id, reason, kind, sha256(statement) AS statement, CAST(start_at AS INT) AS start, CAST(start_at + length(quote) AS INT) AS "end" FROM extracted""",
    "materialize_targets": EXTRACTED + """
        SELECT case_id, kind, unnest(CASE kind WHEN 'fact_candidate' THEN ['draft_claim'] WHEN 'decision' THEN ['observation', 'draft_claim'] ELSE ['observation'] END) AS target,
            CASE kind WHEN 'fact_candidate' THEN 'factual' WHEN 'decision' THEN 'decision' END AS claim_type FROM extracted WHERE kind IS NOT NULL""",
    "stage_digests": PACKS + f""",
        a AS (SELECT *, {stage_json('triage', '')} AS triage FROM viewed WHERE error IS NULL), b AS (SELECT *, {stage_json('extract', 'triage')} AS extract FROM a),
        c AS (SELECT *, {stage_json('verify', 'extract')} AS verify FROM b)
        SELECT case_id, triage, extract, verify, 'agj_' || substr(sha256(verify), 1, 40) AS job_id FROM c""",
    "proposal_upsert": PROPOSALS + "SELECT proposal_id, case_id, zone, kind, gate, n_writes, materialized_id FROM proposals",
    "proposal_lists": PROPOSALS + "".join(
        f"{' UNION ALL ' if i else ''}(SELECT '{name}' AS list, proposal_id, zone, kind FROM proposals WHERE {where} ORDER BY conv_id, turn, proposal_id LIMIT 50)"
        for i, (name, where) in enumerate((
            ("unmaterialized", "gate = 'promote' AND materialized_id IS NULL"), ("draft_claims", "materialized_id IS NOT NULL AND kind IN ('fact_candidate', 'decision')"), ("held", "gate = 'hold'"),
        ))
    ),
    "report_redaction": PROPOSALS + """,
        j AS (SELECT *, '{"gate":"' || gate || '","kind":"' || kind || '","proposal_id":"' || proposal_id || '","quote":"[redacted]","statement":"[redacted]"}' AS report FROM proposals)
        SELECT proposal_id, report, contains(report, regexp_replace(to_json(quote)::VARCHAR, '^"|"$', '', 'g')) AS leaks FROM j""",
    "adjudicate": ADJUDICATED + """
        SELECT case_id, disposition, coalesce(early, array_to_string(list_filter([CASE WHEN NOT has THEN 'no_safe_candidate_span' END, CASE WHEN boundary THEN 'lifecycle_boundary_signal' END,
            CASE WHEN holding THEN 'user_prompt_needs_review' END, CASE WHEN terms THEN 'value_terms' END, CASE WHEN n >= 40 THEN 'signal_length' WHEN n > 0 AND n < 12 THEN 'short_signal' END,
            CASE WHEN n = 0 THEN 'metadata_only_weak' END, CASE WHEN disposition = 'promote' THEN 'promote_threshold' ELSE 'hold_for_review' END], lambda x: x IS NOT NULL), ',')) AS reasons,
            value, durability, risk, noise, kind, sha256(statement) AS statement, CASE WHEN disposition = 'promote' THEN 'active' ELSE 'draft' END AS lifecycle FROM judged""",
    "adjudication_confusion": ADJUDICATED + """
        SELECT expected, count(*) FILTER (disposition = 'promote') AS promote, count(*) FILTER (disposition = 'hold') AS hold, count(*) FILTER (disposition = 'reject') AS reject,
            count(*) FILTER (disposition = expected) AS correct, count(*) AS n, round(count(*) FILTER (disposition = expected) / count(*), 6) AS recall FROM judged WHERE boundary GROUP BY 1""",
    "kind_recall": EXTRACTED + f""",
        c AS (SELECT e.kind, CASE WHEN (conv_id + turn) % 3 <> 2 THEN nullif({at(S.PHRASE_KINDS, 'conv_id * 7 + turn')}, '') END AS expect_kind, coalesce(kind IN ('decision', 'constraint', 'preference'), FALSE) AS promoted FROM extracted e),
        d AS (SELECT expect_kind AS kind, count(*) AS expected, count(*) FILTER (promoted) AS promoted, count(*) FILTER (promoted AND kind = expect_kind) AS observed FROM c WHERE expect_kind IS NOT NULL GROUP BY 1),
        m AS (SELECT kind, count(*) AS n_promotes, count(*) FILTER (kind = expect_kind) AS n_right FROM c WHERE promoted GROUP BY 1)
        SELECT kind, coalesce(expected, 0) AS expected, coalesce(promoted, 0) AS promoted, coalesce(observed, 0) AS observed, coalesce(n_promotes, 0) AS n_promotes,
            round(observed / nullif(expected, 0), 6) AS recall, round(n_right / nullif(n_promotes, 0), 6) AS precision FROM d FULL JOIN m USING (kind)""",
    "observation_plans": SIGNALS + f""",
        h AS (SELECT *, {hook('hook')} IN ('Stop', 'SessionEnd', 'PreCompact', 'UserPromptSubmit') AS fits FROM signals)
        SELECT case_id, CASE WHEN fits THEN 'extract' ELSE 'skip' END AS status, CASE WHEN fits THEN 'observation' ELSE 'none' END AS target, CASE WHEN fits THEN {metadata('hook')} END AS statement FROM h""",
    "capture_intake": INTAKE + "SELECT * EXCLUDE (conv_id, turn) FROM intake",
    "feed_list": INTAKE + "SELECT event_id, feed_state, valid_start, session_id FROM intake WHERE zone = 'tz_1' AND feed_state = 'pending' ORDER BY valid_start, event_id LIMIT 40",
    "run_ledger": INTAKE + """,
        r AS (SELECT session_id, zone, min(valid_start) AS started_at, max(valid_start) AS ended, count(DISTINCT event_id) AS n_events, min(event_id) AS first_event, max(event_id) AS last_event, arg_max(kind, (turn, kind)) AS last
            FROM intake WHERE status IN ('accepted', 'replay') GROUP BY 1, 2)
        SELECT 'run_' || substr(sha256('{"agent_id":null,"started_at":"' || started_at || '","subject_ref":"' || session_id || '"}'), 1, 24) AS run_id, session_id, zone, started_at,
            CASE WHEN last <> 'procedure_trace' THEN ended END AS ended_at, CASE WHEN last = 'procedure_trace' THEN 'running' ELSE 'completed' END AS status, n_events, first_event, last_event FROM r""",
    "front_gate": SIGNALS + f""",
        b AS (SELECT case_id, {hook('hook')} AS hook, trim(signal) AS s FROM signals),
        l AS (SELECT *, list_transform(list_filter(list_transform(regexp_split_to_array(s, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> ''), lambda x: {{'k': {line_kinds('x')}, 'l': x}}) AS p FROM b),
        r AS (SELECT case_id, hook, s, len(list_filter(p, lambda x: x.k = 'secret')) AS sec, len(list_filter(p, lambda x: x.k = 'tool')) AS tool,
            len(list_filter(p, lambda x: x.k = 'telemetry')) AS tel, len(list_filter(p, lambda x: x.k = 'kept')) AS kept,
            trim(coalesce(array_to_string(list_transform(list_filter(p, lambda x: x.k = 'kept'), lambda x: x.l), chr(10)), '')) AS t FROM l),
        d AS (SELECT *, CASE WHEN s = '' THEN 'empty_signal' WHEN {matches('s', T.INJECTION)} THEN 'injection_or_exfil_pattern'
            WHEN hook = 'PostToolUse' THEN 'post_tool_use_noise' WHEN regexp_matches(s, '{NOISE}') THEN 'noise_only_signal'
            WHEN hook NOT IN ('SessionEnd', 'Stop', 'PreCompact') THEN 'lifecycle_not_eligible'
            WHEN kept = 0 AND sec > 0 AND tool = 0 AND tel = 0 THEN 'secret_like_material' WHEN kept = 0 AND tel > 0 AND tool = 0 THEN 'telemetry_only_signal'
            WHEN kept = 0 AND tool > 0 THEN 'tool_noise_signal' WHEN kept = 0 THEN 'noise_only_signal'
            WHEN length(t) < 8 THEN 'signal_too_short' WHEN regexp_matches(t, '{NOISE}') THEN 'noise_only_signal' ELSE 'front_v1_pass' END AS reason FROM r)
        SELECT case_id, hook, CASE WHEN reason = 'front_v1_pass' THEN 'pass' ELSE 'drop' END AS decision, reason, CASE WHEN reason = 'front_v1_pass' THEN sha256(t) END AS residual FROM d""",
    "gate_verify": GATED + """,
        b AS (SELECT *, trim(quote) AS q, trim(regexp_replace(regexp_replace(lower(statement), '[“”"''`]', '', 'g'), '\\s+', ' ', 'g')) AS s2,
            trim(regexp_replace(regexp_replace(lower(quote), '[“”"''`]', '', 'g'), '\\s+', ' ', 'g')) AS q2 FROM gate_rows),
        t AS (SELECT *, list_filter(regexp_split_to_array(s2, '[^a-z0-9]+'), lambda x: length(x) > 2) AS a, list_distinct(list_filter(regexp_split_to_array(q2, '[^a-z0-9]+'), lambda x: length(x) > 2)) AS c FROM b),
        i AS (SELECT *, len(list_filter(a, lambda x: list_contains(c, x))) AS n, len(list_distinct(list_concat(a, c))) AS u FROM t),
        g AS (SELECT *, CASE WHEN length(s2) < 8 THEN 'statement_too_short_for_grounding' WHEN q = '' THEN 'no_quote_for_grounding'
            WHEN length(s2) > length(q2) * 3 THEN 'statement_longer_than_cited_span' WHEN contains(q2, s2) OR contains(s2, q2) THEN 'statement_grounded_containment'
            WHEN len(a) = 0 OR len(c) = 0 THEN 'statement_ungrounded_empty_tokens' WHEN n / u >= 0.35 OR n / len(a) >= 0.6 THEN 'statement_grounded_overlap'
            ELSE 'statement_not_grounded_in_citations' END AS grounding FROM i),
        o AS (SELECT *, CASE
            WHEN regexp_matches(statement || ' ' || q, '(?i)\\b(api[_-]?key|secret|password|bearer\\s+[a-z0-9._-]+|sk-[a-z0-9]{10,})\\b') THEN 'reject:secret_like_material'
            WHEN q = '' OR NOT contains(pack, q) OR grounding NOT IN ('statement_grounded_containment', 'statement_grounded_overlap') THEN 'reject:missing_or_failed_citation'
            WHEN length(trim(statement)) < 8 THEN 'reject:statement_too_short' WHEN kind = 'open_question' THEN 'hold:open_question_side_channel'
            WHEN kind = 'procedure' THEN 'hold:procedure_hold_biased_v1' WHEN kind = 'fact_candidate' THEN 'hold:fact_candidate_not_in_v1_allowlist'
            WHEN kind NOT IN ('decision', 'constraint', 'preference') THEN 'hold:kind_not_in_usable_allowlist'
            WHEN confidence IS NULL OR confidence >= 0.55 THEN 'promote:promote_when_verified' ELSE 'hold:hold_confidence_or_features' END AS o FROM g)
        SELECT case_id, grounding, split_part(o, ':', 1) AS decision, split_part(o, ':', 2) AS reason FROM o""",
    "quality_filter": GATED + """,
        c AS (SELECT *, trim(quote) AS q FROM gate_rows),
        r AS (SELECT *, CASE WHEN kind NOT IN ('decision', 'constraint', 'preference', 'procedure') THEN 'quality_non_promote_kind_passthrough' WHEN q = '' THEN 'quality_empty_quote'
            WHEN NOT contains(view, q) THEN 'quality_quote_not_in_extract_view' WHEN len(string_split(view, q)) > 2 THEN 'quality_ambiguous_quote'
            WHEN regexp_matches(statement, '(?i)\\b(hook captured|captured from provider)\\b') THEN 'quality_metadata_restatement' ELSE 'quality_ok' END AS reason FROM c)
        SELECT case_id, reason IN ('quality_ok', 'quality_non_promote_kind_passthrough') AS keep, reason FROM r""",
    "statement_kinds": SIGNALS + f""",
        l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(signal, '\\n+'), lambda x: trim(x)), lambda x: length(x) >= 8) AS lines FROM signals)
        SELECT case_id, CASE WHEN {matches('signal', T.words('constraint', 'must never'))} THEN 'constraint' WHEN {matches('signal', T.words('preference', 'prefer'))} THEN 'preference'
            WHEN {matches('signal', T.words('procedure', 'how to'))} THEN 'procedure' WHEN {matches('signal', T.words('decision', 'we (?:will|decided)'))} THEN 'decision'
            WHEN contains(signal, '?') THEN 'open_question' ELSE 'fact_candidate' END AS inferred, {kind_case('signal')} AS candidate,
            least(3, len(list_filter(list_transform(regexp_extract_all(signal, '[^.!?\\n]+[.!?]?'), lambda x: trim(x)), lambda x: length(x) BETWEEN 12 AND 240))) AS n_sentences,
            sha256(list_sort(list_transform(lines, lambda x, i: {{'s': CASE WHEN {matches('x', T.words('decision', 'constraint', 'preference', 'we will', 'must never', 'require', 'prefer'))} THEN 6 ELSE 0 END
                - CASE WHEN length(x) < 16 THEN 3 ELSE 0 END + CASE WHEN length(x) >= 40 THEN 2 ELSE 0 END, 'n': length(x), 'o': -i, 'l': x}}), 'DESC')[1].l) AS quote FROM l""",
    "knowledge_form": EXTRACTED + f""",
        f AS (SELECT statement, CASE WHEN kind IN ('decision', 'fact_candidate') THEN 'claim' ELSE 'observation' END AS kind, zone <> 'tz_3' AS visible, turn % 3 AS evidence,
            CASE WHEN zone = 'tz_3' THEN 'reject' WHEN turn % 3 = 0 THEN 'insufficient' WHEN kind IN ('decision', 'fact_candidate') THEN 'claim_candidate' ELSE 'observation' END AS expected
            FROM extracted WHERE quote IS NOT NULL),
        c AS (SELECT *, CASE WHEN {secret('statement')} OR length(trim(statement)) < 8 OR NOT visible THEN 'reject' WHEN evidence = 0 THEN 'insufficient' WHEN kind = 'claim' THEN 'claim_candidate' ELSE 'observation' END AS p FROM f)
        SELECT count(*) AS n, round(count(*) FILTER (expected = p) / count(*), 6) AS accuracy,
            round(coalesce(count(*) FILTER (expected = 'claim_candidate' AND p = 'claim_candidate') / nullif(count(*) FILTER (p = 'claim_candidate'), 0), 1), 6) AS claim_precision,
            round(coalesce(count(*) FILTER (expected = 'claim_candidate' AND p = 'claim_candidate') / nullif(count(*) FILTER (expected = 'claim_candidate'), 0), 1), 6) AS claim_recall,
            round(coalesce(count(*) FILTER (expected = 'observation' AND p = 'observation') / nullif(count(*) FILTER (expected = 'observation'), 0), 1), 6) AS preservation FROM c""",
    "contradiction_pairs": SIGNALS + """,
        s AS (SELECT CAST(conv_id AS VARCHAR) AS subject, turn AS id, lower(signal) AS s FROM signals),
        m AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(s, '[^a-z0-9]+'), lambda x: length(x) > 3 AND x NOT IN ('never', 'must', 'always', 'should'))) AS t,
            regexp_matches(s, '\\b(never|must not)\\b') AS nv, regexp_matches(s, '\\b(always|must)\\b') AS al,
            regexp_matches(s, '\\b(forbid|forbidden|prohibit|ban|disallow)\\b') AS fo, regexp_matches(s, '\\b(allow|allowed|permit|permitted)\\b') AS pe FROM s)
        SELECT a.subject, a.id AS left_id, b.id AS right_id, CASE WHEN (a.nv AND b.al) OR (b.nv AND a.al) THEN 'polarity_never_vs_must' ELSE 'allow_vs_forbid' END AS code
        FROM m a JOIN m b ON a.subject = b.subject AND a.id < b.id
        WHERE ((a.nv AND b.al) OR (b.nv AND a.al) OR (a.fo AND b.pe) OR (b.fo AND a.pe)) AND len(list_intersect(a.t, b.t)) >= 2""",
}
