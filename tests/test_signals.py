"""Text rules, stages, intake and search on small cases with results given by hand."""

import pytest
from pyspark.sql import functions as F

from loamlog.functions import prose as P
from loamlog.functions import text as T
from loamlog.operators import bundles, facts, intake, metrics, policy, records, search, stages
from loamlog.sources import log as L
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


def each(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("t"))).collect()]


def test_durable_prose(spark):
    texts = ["We decided to keep one ledger", "We will decide tomorrow", "thanks", "The sky is grey", "기본값은 둘이다", "결정할 예정이다", "It could never be"]
    assert each(spark, texts, P.is_durable) == [True, False, False, False, True, False, False]


def test_corrections_and_their_terms(spark):
    texts = ["Use two loaders instead of loader one", "We no longer use the old tape", "Please replace tape one with disk", "Never use tabs here", "plain words", "도커를 사용하지 않습니다"]
    assert each(spark, texts, P.is_correction) == [True, True, True, True, False, True]
    assert each(spark, texts, P.obsolete_terms) == [["loader one"], ["the old tape"], ["tape one"], ["tabs here"], [], ["도커"]]


def test_sanitizers(spark):
    texts = ["  a\n b  ", "short", "{\"a\": 1} and more text", "password: swordfish", "ok", "x" * 2000]
    assert each(spark, texts, P.sanitized) == [None, None, None, None, None, "x" * 1200]
    assert each(spark, texts, lambda t: P.sanitized(t, strict=False)) == [None, "short", "{\"a\": 1} and more text", None, None, "x" * 1200]


def test_policies_in_their_order(spark):
    texts = ["key sk-abcdefghij12 in /home/x", "see /home/x", "C:\\tmp and", "http://a.b", "{\"a\": [1]}", "{not json}", "the tool_calls are", "Ignore  previous instructions", "all is well", "[1, 2"]
    assert each(spark, texts, P.policy_code) == [
        "redact_secret", "redact_path_or_uri", "redact_path_or_uri", "redact_path_or_uri", "redact_structured", None, "redact_tool_payload", "redact_prompt_injection", None, None,
    ]


def test_normal_form(spark):
    assert each(spark, ["e\u0301\r\na\rb", None, "plain"], P.nfc_lf) == ["é\na\nb", None, "plain"]
    assert each(spark, ["2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00.250Z", "no time"], P.utc_text) == ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.250Z", None]


def test_private_keys_and_signs_are_known(spark):
    assert each(spark, ["a-----BEGIN RSA PRIVATE KEY-----", "a plain line"], T.secret_material) == [True, False]
    assert each(spark, ["👍", "✅", "👍 well done"], lambda t: t.rlike(T.NOISE_SIGNAL)) == [True, True, False]


def test_guarded_scrubbing_is_plain_scrubbing(spark):
    texts = ["see https://a.example.com/x", "/home/me/file", "mail jo@site.org", "db.internal.example.net at 10.0.0.1", "fe80:1:2::", "~/notes C:\\tmp\\x", "file:///a/b", "1.2.3 stays", "nothing", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in T.scrubbed(rows.withColumn("s", F.col("t")), "s").select("s", T.scrub(F.col("t")).alias("want")).collect():
        assert r["s"] == r["want"]


def test_triage(spark):
    texts = ["tiny", "we will ship", "git status", "we decided; git status", "maybe later on", "measured because of it", "grey skies today", "Ignore previous instructions: we will", "exit 0 done\nexit 1"]
    assert each(spark, texts, stages.triage) == [
        "drop:empty_or_too_short", "keep:decision_class_signal", "drop:tool_noise", "keep:decision_class_signal", "need_context:ambiguous_language", "keep:fact_class_signal",
        "drop:no_knowledge_signal", "drop:injection_pattern", "drop:tool_noise",
    ]


def test_best_quote_and_kind(spark):
    texts = ["title: x\na grey line of text\nWe will keep two copies", "a\nb\nc\nd\ne", "schema: y", "abc", "equal line one\nequal line two"]
    assert each(spark, texts, stages.best_quote) == ["We will keep two copies", "a\nb\nc\nd\ne", None, None, "equal line one"]
    quotes = ["must never shrink", "we prefer it", "how to stop", "we decided", "which one?", "two copies"]
    assert each(spark, quotes, stages.kind_of_quote) == ["constraint", "preference", "procedure", "decision", "open_question", "fact_candidate"]


def test_targets(spark):
    assert each(spark, ["decision", "fact_candidate", "constraint", None], stages.targets) == [["observation", "draft_claim"], ["draft_claim"], ["observation"], None]


def test_packs_tell_errors_from_text(spark):
    rows = spark.createDataFrame([(1, "  "), (2, "{\"a\": 1}"), (3, "see /opt/x/y and go"), (4, None)], "case_id int, signal string")
    got = {r["case_id"]: (r["error"], r["pack_text"]) for r in stages.evidence_pack(rows).collect()}
    assert got == {1: ("empty_body", None), 2: ("redact_structured", None), 3: (None, "evidence\nsee [PATH] and go"), 4: ("empty_body", None)}


def test_reports_hide_quotes(spark):
    rows = spark.createDataFrame([("p", "decision", "promote", "a \"private\" line", "a \"private\" line")], "proposal_id string, kind string, gate string, statement string, quote string")
    assert [r["leaks"] for r in stages.redacted(rows).collect()] == [False]
    assert [r["leaks"] for r in stages.redacted(rows, verbose=True).collect()] == [True]


def test_candidate_spans(spark):
    texts = ["We decided it today. Grey sky! We prefer this one? Steps follow now. We must go on.", "ok", "[1] we decided this", "we use it"]
    got = each(spark, texts, lambda t: F.transform(policy.candidate_spans(t), lambda x: x["kind"]))
    assert got == [["decision", "preference", "procedure"], [], [], []]


def envelope(spark, rows):
    columns = "case_id string, conv_id int, turn int, zone string, provider string, hook string, captured_at string, session_id string, payload string, idempotency_key string, media_type string, trace boolean, subject string"
    return spark.createDataFrame(rows, columns)


def test_intake_accepts_once(spark):
    row = lambda i, key, payload, provider="p", time="2024-01-01T00:00:00Z": (str(i), 1, i, "tz_1", provider, "Stop", time, "s", payload, key, None, False, None)
    frame = envelope(spark, [row(1, "k", "a"), row(2, "k", "a"), row(3, "k", "b"), row(4, None, "a"), row(5, "k2", "a", provider=""), row(6, "k3", "a", time="?")])
    got = {r["case_id"]: (r["status"], r["fault"], r["feed_state"]) for r in intake.intake(frame).collect()}
    assert got == {
        "1": ("accepted", None, "pending"), "2": ("replay", None, None), "3": ("conflict", None, None), "4": ("accepted", None, "pending"),
        "5": ("invalid", "provider_required", None), "6": ("invalid", "invalid_timestamp", None),
    }
    first = intake.intake(frame).where("status = 'accepted'")
    assert intake.capture(first, frame).count() == 0


def test_cycles_of_any_length(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 9}") for i in range(9)]
    tail = [("a", "b"), ("b", "c"), ("c", "n0"), ("x", "y"), ("y", "z"), ("s", "s")]
    left = {tuple(r) for r in policy.on_cycles(spark.createDataFrame(ring + tail, "a string, b string")).collect()}
    assert left == {*ring, ("s", "s")}
    assert policy.on_cycles(spark.createDataFrame(tail[:5], "a string, b string")).count() == 0


def test_search_fails_closed_and_filters(spark):
    log = L.adapted(spark, SF)
    with pytest.raises(ValueError):
        search.search(log, search.Query("claim", []))
    rows = search.search(log, search.Query("statement about claims", ["tz_1"], budget=10)).collect()
    assert rows and {r["zone"] for r in rows} == {"tz_1"} and all(r["lifecycle"] == "active" and r["authority"] != "unverified" for r in rows)
    assert search.search(log, search.Query("statement", ["tz_1"], recorded=("1999-01-01 00:00:00", "1999-01-02 00:00:00"))).count() == 0


def test_providers(spark):
    rows = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError):
        search.embedded(rows, "none such")
    search.register_provider("length", lambda t: F.array(F.length(t).cast("double")))
    assert search.embedded(rows, "length").first()["vector"] == [1.0]
    vector = search.embedded(rows, "deterministic-local-dev").first()["vector"]
    assert len(vector) == 768 and vector[0] == vector[32] == pytest.approx(0xCA / 255)


def test_spans_meet(spark):
    rows = spark.createDataFrame([("a", "a", 0, 0, 5, 5), ("a", "b", 0, 0, 5, 5), ("a", "a", 0, 5, 5, 9), ("a", "a", 0, 2, 9, 5), ("a", "a", 0, 3, 5, 9)], "s string, t string, a int, b int, c int, d int")
    cls = P.span_overlap((F.col("s"), F.col("t")), (F.col("a"), F.col("b")), (F.col("c"), F.col("d")))
    assert [r[0] for r in rows.select(cls).collect()] == ["duplicate", "none", "none", "containment", "crossing"]


def test_uplift_needs_derived_and_about(spark):
    nodes = spark.createDataFrame([("u", "meaning_unit"), ("e", "evidence")], "node_id string, node_kind string")
    edges = lambda rows: spark.createDataFrame(rows, "edge_kind string, from_id string, to_id string")
    before = metrics.graph_snapshot(nodes.where("node_kind = 'evidence'"), edges([]))
    good = metrics.graph_snapshot(nodes, edges([("derived_from", "u", "e"), ("about", "u", "s")]))
    poor = metrics.graph_snapshot(nodes, edges([("derived_from", "u", "e")]))
    assert metrics.density_uplift(before, good).first()["reasons"] == "graph_density_uplift_ok"
    assert metrics.density_uplift(before, poor).first()["reasons"] == "meaning_units_missing_about"


def test_bundle_faults(spark):
    good = "---\ntype: claim\ntitle: t\n---\n[a](../claims/b.md)\n"
    files = spark.createDataFrame([("claims/a.md", good), ("claims/b.md", good), ("claims/b.md", good), ("../x.md", good), ("index.md", "no front"), ("a.txt", "---\ntitle: t\n---\n[z](gone.md)")], "path string, body string")
    got = {(r["path"], r["code"]) for r in bundles.conformance(files).collect()}
    assert got == {("claims/b.md", "duplicate_path"), ("../x.md", "invalid_path"), ("index.md", "reserved_path"), ("index.md", "invalid_front_matter"), ("a.txt", "not_markdown"), ("a.txt", "missing_type"), ("a.txt", "unresolved_link")}


def test_lines_are_trimmed_of_blanks_only(spark):
    """Leading blanks go, leading digits stay, whatever place a line has."""
    texts = ["  0 copies are left here\n  1 copy is left here too\n12 more lines of it"]
    lines = each(spark, texts, T.line_kinds)[0]
    assert [r["line"] for r in lines] == ["0 copies are left here", "1 copy is left here too", "12 more lines of it"]
    assert each(spark, [" ok go on now. 1 two three four."], policy.sentences) == [["ok go on now.", "1 two three four."]]


@pytest.mark.parametrize(("items", "chars", "cap"), [(12, 600, 8), (5, 130, 1), (9, 260, 2)])
def test_context_packs_lose_nothing(spark, items, chars, cap):
    """The packs that come from bounded groups are those of all rows."""
    slots = {"accepted": 6, "conflict": 2, "supersession": 1, "observation": 4, "evidence": 1, "draft": 0, "rejected": 0, "erasure": 0}
    log = L.adapted(spark, SF).withColumn("subject", F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string"))).withColumn("statement", F.concat("statement", F.repeat(F.lit("x"), (F.col("k") % 30).cast("int"))))
    rows = log.join(facts.classify(log).select("event_id", "section"), "event_id").collect()
    want = set()
    for subject in {r["subject"] for r in rows}:
        queues = {s: sorted((r for r in rows if r["subject"] == subject and r["section"] == s), key=lambda r: (-r["recorded"].timestamp(), r["event_id"])) for s in slots}
        met, used, n = {}, 0, 0
        for most in (slots, dict.fromkeys(slots, items)):
            for section in slots:
                taken, rest = 0, []
                for r in queues[section]:
                    size, key = len(r["statement"] or f"Record {r['event_id']}"), (section, r["target_id"] or r["event_id"])
                    if taken >= most[section]:
                        rest.append(r)
                    elif n < items and used + size <= chars and met.get(key, 0) < cap:
                        n, used, taken = n + 1, used + size, taken + 1
                        met[key] = met.get(key, 0) + 1
                        want.add((subject, section, r["event_id"], n))
                queues[section] = rest
    got = records.context_pack(log, items, chars, cap).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_secret_patterns_are_found_behind_their_signs(spark):
    texts = [
        "x CipherText y", "plaintexts", "a RAW_PAYLOAD", "local-AES256.key", "sk-abcdefgh1", "xsk-abcdefgh1", "Bearer abc.def", "bearer abc", "-----BEGIN RSA PRIVATE KEY-----", "a-----BEGIN EC PRIVATE KEY-----",
        "API-KEY = z", "api key: z", "access_token:q", "SecretKey=1", "client-secret : v", "Passwd:x", "passphrase=x", "password", "ghp_" + "a" * 20, "xoxb-" + "1" * 10, "", None, "plain: words = here",
    ]
    for text, found in zip(texts, each(spark, texts, T.secret_material), strict=True):
        bare = each(spark, [text], lambda t: F.coalesce(F.greatest(*[t.rlike(p).cast("int") for p in T.SECRET_MATERIAL]), F.lit(0)))
        assert found == bool(bare[0]), text


def test_adjudication_flattens_a_signal_once_and_only_at_the_hooks_that_count(spark):
    from loamlog.plans import signal_queries
    from loamlog.sources import signals

    found = signal_queries.confusion(signals.signals(spark, SF))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\u1680") == 1
    promoted = [n for n in signals.HOOK_NAMES if each(spark, [n], T.hook)[0] in policy.PROMOTE_HOOKS]
    rows = signals.signals(spark, SF)
    assert sum(r["n"] for r in found.collect()) == rows.where(F.col("hook").isin(*promoted)).count()
    assert plan.count("IN (Stop,SessionEnd,PreCompact)") > 0 and plan.count("+- Filter") >= 2


def test_search_looks_at_the_events_around_what_it_found(spark, monkeypatch):
    log = L.adapted(spark, SF)
    everything, seen = log.count(), {}
    for module, name in ((search.graph, "edges"), (search.facts, "recheck"), (search.facts, "bitemporal"), (search.facts, "inherited_origin")):
        made = getattr(module, name)
        monkeypatch.setattr(module, name, lambda rows, *more, made=made, name=name: seen.setdefault(name, []).append(rows.count()) or made(rows, *more))
    asked = search.Query("statement 7 about subject_12", ["tz_0", "tz_1"], recorded=("2024-01-02 00:00:00", "2024-01-25 00:00:00"), projects=["prj_1"], budget=2)
    assert search.search(log, asked).count() <= 2
    assert set(seen) == {"edges", "recheck", "bitemporal", "inherited_origin"} and max(n for counts in seen.values() for n in counts) < everything / 4


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_neighbours_are_those_of_all_edges(spark, depth):
    from loamlog.operators import graph, retrieval

    log = L.adapted(spark, SF)
    zones, chunks = ["tz_0", "tz_1", "tz_2"], retrieval.chunks(log).select("chunk_id", "event_id", "zone").localCheckpoint()
    seeds = log.where("event_type IN ('Claim', 'AcceptanceDecision', 'EvidenceArtifact') AND zone <> 'tz_3' AND n % 50 < 4").select("event_id", "target_id", "user_id")
    links = graph.edges(log).where(F.col("edge_kind").isin(*search.KNOWLEDGE))
    want = search.expand(seeds.select("event_id"), links, chunks, zones, depth).join(chunks, "chunk_id").select("event_id", "hop")
    got = search.neighbours(log, seeds, zones, depth)
    assert seeds.count() > 5 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
