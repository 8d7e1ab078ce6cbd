"""Rules that SQL over the driver's tables does not show: literal cases, streams, state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loamlog.functions import text as T
from loamlog.operators import facts, graph, metrics, policy, queues, retrieval
from loamlog.operators.components import connected
from loamlog.plans import cases
from loamlog.sources import log as L
from loamlog.streaming import state
from tests.conftest import DATA


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("see https://a.example.com/x?y and /home/me/file", "see [URI] and [PATH]"),
        ("mail jo@site.org now", "mail [EMAIL] now"),
        ("host db.internal.example.net at 10.0.0.1", "host [HOST] at [IP]"),
        ("ratio 1.2.3 stays", "ratio 1.2.3 stays"),
        ("~/notes and C:\\tmp\\x", " [PATH] and [PATH]"),  # the blank belongs to the replacement
    ],
)
def test_scrub(spark, text, wanted):
    assert one(spark, T.scrub(F.col("t")), t=text) == wanted


def test_head_tail_keeps_both_ends(spark):
    view = one(spark, T.head_tail(F.col("t"), 100), t="a" * 300 + "z" * 300)
    assert len(view) == 100 and view.startswith("a" * 42) and view.endswith("z" * 43) and "truncated" in view
    assert one(spark, T.head_tail(F.col("t"), 100), t="short") == "short"


def test_tokenizers_differ(spark):
    assert one(spark, T.search_tokens(F.col("t")), t="Foo_bar foo Été") == ["foo", "bar", "foo", "t"]
    assert one(spark, T.embedding_tokens(F.col("t")), t="Foo_bar foo") == ["foo_bar", "foo"]
    assert one(spark, T.grounding_tokens(F.col("t")), t="an 결정한다 ok index") == ["index", "결정", "정한", "한다"]


def test_hooks(spark):
    rows = spark.createDataFrame([("session_end",), ("Pre-Compact",), (" stop ",), ("",), ("Other",)], "h string")
    assert [r[0] for r in rows.select(T.hook(F.col("h"))).collect()] == ["SessionEnd", "PreCompact", "Stop", "unknown", "Other"]


def test_jaccard_of_empty_sets_is_one(spark):
    frame = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in frame.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, pytest.approx(1 / 3)]


def test_adjudication(spark):
    frame = cases.rows(spark, cases.ADJUDICATE, "case_id int, hook string, signal string").withColumns({"provider": F.lit("a host"), "subject": F.lit(None).cast("string")})
    got = {r["case_id"]: r for r in policy.adjudicate(frame).collect()}
    said = {k: (r["disposition"], r["reasons"].split(",")[-1]) for k, r in got.items()}
    assert said[1] == ("promote", "promote_threshold") and said[2][0] == "promote"
    assert said[3][0] == "hold" and said[4][0] == "hold" and "no_safe_candidate_span" in got[3]["reasons"]
    assert said[5] == ("reject", "post_tool_use_noise") and said[6] == ("reject", "lifecycle_not_eligible")
    assert said[7] == ("reject", "noise_only_signal") and said[8] == ("reject", "secret_like_material")
    assert [got[8][c] for c in ("value", "durability", "risk", "noise")] == [0, 0, 1, 0.5]
    assert got[2]["statement"] == "Captured a_host Stop evidence (transcript, application/json) for project. Knowledge fragment (preference): We prefer narrow tables for the hot path of the loader."


def test_visibility_fails_closed(spark):
    with pytest.raises(ValueError):
        facts.visible(L.adapted(spark, f"{DATA}/sf0.001"), [])


def test_interval_ends_are_inclusive(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    frame = spark.createDataFrame([(day(1), day(2)), (day(3), None), (day(5), day(6))], "a timestamp, b timestamp")
    met = frame.where(facts.overlaps(F.col("a"), F.col("b"), F.lit(day(2)), F.lit(day(4))))
    assert met.count() == 2


def test_components_with_cycles_and_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and got[101] == got[102] == 100 and 7 in got


def test_components_of_nothing(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_walk_takes_the_least_hop(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "from_id string, to_id string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert {(r["node_id"], r["hop"]) for r in graph.walk(seeds, links, 3).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    with pytest.raises(ValueError):
        graph.walk(seeds, links, 9)


def test_sequences_are_gap_free(spark):
    rows = L.sequenced(L.adapted(spark, f"{DATA}/sf0.001")).select("zone", "zone_sequence").collect()
    for zone in {r["zone"] for r in rows}:
        own = sorted(r["zone_sequence"] for r in rows if r["zone"] == zone)
        assert own == list(range(1, len(own) + 1))


def test_idempotent_accept(spark):
    data = [("k", "f1", 1), ("k", "f1", 2), ("k", "f2", 3), ("j", "f2", 4)]
    got = {r["arrival"]: r["status"] for r in queues.idempotent(spark.createDataFrame(data, "key string, fingerprint string, arrival long")).collect()}
    assert got == {1: "new", 2: "replay", 3: "conflict", 4: "new"}


def test_idempotent_stream_agrees_with_batch(spark, tmp_path):
    schema = "key string, fingerprint string, arrival long"
    data = [("k", "f1", 1), ("k", "f1", 2), ("k", "f2", 3), ("j", "f2", 4), ("j", "f2", 5)]
    for i in range(0, len(data), 2):
        spark.createDataFrame(data[i : i + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = state.idempotent_stream(stream).writeStream.format("memory").queryName("accepts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r["arrival"]: r["status"] for r in spark.table("accepts").collect()}
    assert got == {1: "new", 2: "replay", 3: "conflict", 4: "new", 5: "replay"}


def test_append_new_is_idempotent(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    for _ in range(2):
        state.append_new(batch, str(tmp_path / "t"), "id")
    assert state.appended(spark, str(tmp_path / "t")).count() == 2


def test_windowed_counts_run_on_a_batch(spark):
    counts = state.windowed_counts(L.adapted(spark, f"{DATA}/sf0.001"), width="1 day")
    assert counts.agg(F.sum("n")).first()[0] == 1000


def test_transcripts(spark):
    small, large, no = "we must keep the archive small", "correction: we should keep it large", "we should use two copies instead of the old tape"
    turns = [
        (1, 1, "user", small), (1, 2, "assistant", "the sky is grey today"), (1, 3, "Human", f"  {small}\n"), (1, 4, "user", large), (1, 5, "user", small),
        (1, 6, "user", large), (1, 7, "user", "always keep the old tape"), (1, 8, "tool", "always keep tools"), (1, 9, "user", no), (2, 1, "user", None), (2, 2, "user", "ok"),
    ]
    got = state.fold_transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("place").collect()
    # the first correction lets the assertion be said again; the last one takes the old tape away
    assert [(r["line"], r["turn"], r["epoch"]) for r in got] == [(small, 1, 2), (large, 4, 2), (small, 5, 2), (no, 9, 2)]
    many = spark.createDataFrame([(1, i, "user", f"we always keep copy {i}") for i in range(30)], "conv_id long, turn long, role string, text string")
    assert [r["turn"] for r in state.fold_transcripts(many).orderBy("place").collect()] == list(range(22, 30))


def test_cosine_edges(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in frame.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_diversity_defers_near_duplicates(spark):
    ranked = spark.createDataFrame([(1, d, "claim" if d < 4 else "evidence_excerpt", d) for d in range(1, 7)], "item_id long, doc_id long, chunk_kind string, rank int")
    texts = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d e f"), (4, "g h"), (5, "i j"), (6, "k l")], "doc_id long, text string")
    got = [r["doc_id"] for r in retrieval.diverse(ranked, texts, 4).orderBy("place").collect()]
    assert got == [1, 3, 4, 5]


def test_near_duplicates_against_all_pairs(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i j j", "a b c d e f g h i k", "b c d e f g h i j a x", "", None, "zz", "z z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["a"], r["b"]) for r in retrieval.near_duplicate_pairs(docs).collect()}
    sets = {i: frozenset((t or "").split()) for i, t in enumerate(texts) if t}
    reps = [i for i in sets if not any(j < i and sets[j] == sets[i] for j in sets)]
    want = {(a, b) for a in reps for b in reps if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])}
    assert got == want


def test_confusion_and_quality(spark):
    rows = spark.createDataFrame([("promote", "promote"), ("promote", "hold"), ("hold", "hold")], "expected string, predicted string")
    got = {r["expected"]: (r["promote"], r["hold"], r["recall"]) for r in metrics.confusion(rows).collect()}
    assert got == {"promote": (1, 1, 0.5), "hold": (0, 1, 1.0)}
    none = metrics.binary_quality(spark.createDataFrame([(0, 0)], "actual int, predicted int")).first()
    assert (none["precision"], none["recall"]) == (1.0, 1.0)


def test_backoff_is_bounded(spark):
    frame = spark.createDataFrame([(1,), (5,), (50,)], "n int")
    assert [r[0] for r in frame.select(queues.backoff_seconds(F.col("n"))).collect()] == [1, 16, 1024]


def test_statement_kinds_and_quotes(spark):
    rows = cases.rows(spark, cases.KINDS, "case_id int, text string")
    t = F.col("text")
    told = rows.select("case_id", policy.inferred_kind(t).alias("inferred"), F.size(policy.sentences(t)).alias("n_sentences"), policy.best_line(t).alias("quote"))
    got = {r["case_id"]: r for r in told.collect()}
    assert [got[i]["inferred"] for i in range(1, 9)] == ["decision", "constraint", "preference", "procedure", "open_question", "fact_candidate", "fact_candidate", "decision"]
    assert got[1]["n_sentences"] == 2 and got[7]["n_sentences"] == 0 and got[7]["quote"] is None
    assert got[8]["quote"] == "We will keep the first answer and drop the rest of them"
    assert got[2]["quote"] == "Constraint: archives must never shrink!"


def test_supersession_components_and_cycles(spark):
    rows = policy.supersession_components(cases.rows(spark, cases.LINKS, "source string, target string, replacement string")).collect()
    assert {(r["members"], r["has_cycle"]) for r in rows} == {("a,b,c,d", False), ("e,f", False), ("g,h,i,j", True), ("k,l", False)}
    assert len({r["component_id"] for r in rows}) == 4


def test_offline_rank(spark):
    schema = "query_id int, chunk_id string, kind string, lifecycle string, query string, text string, hop int, expected boolean, forbidden boolean"
    got = {r["query_id"]: (r["top_id"], r["hit"]) for r in metrics.rank_hits(cases.rows(spark, cases.RANKED, schema)).collect()}
    assert got == {1: ("c1", True), 2: ("c5", True), 3: ("c7", False)}


def test_index_rebuild_marks_stale_and_added(spark):
    from loamlog.operators import records

    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "chunk_id string, text_digest string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "chunk_id string, text_digest string")
    assert {tuple(r) for r in records.index_changes(old, new).collect()} == {("a", "kept"), ("b", "changed"), ("c", "stale"), ("d", "added")}


def test_context_pack_skips_what_does_not_fit_and_goes_on(spark):
    from loamlog.operators import records

    rows = records.context_pack(L.adapted(spark, f"{DATA}/sf0.001"), 5, 150).collect()
    by = {}
    for r in rows:
        by.setdefault(r["subject"], []).append(r)
    assert by and all(len(v) <= 5 and sorted(r["place"] for r in v) == list(range(1, len(v) + 1)) for v in by.values())


def test_tails_drop_the_cut_line(spark, tmp_path):
    from loamlog.sources import transcripts

    path = tmp_path / "t.jsonl"
    path.write_text("".join(f'{{"type": "user", "text": "line number {i:03d}"}}\n' for i in range(100)))
    lines = transcripts.read_tails(spark, [str(path)], most=200)
    got = [r["text"] for r in transcripts.parse(lines).orderBy("place").collect()]
    assert got == [f"line number {i:03d}" for i in range(100 - len(got), 100)] and 3 <= len(got) <= 5
    assert transcripts.parse(transcripts.read_tails(spark, [str(path)])).count() == 100


def test_transcript_lines(spark):
    from loamlog.sources import transcripts

    lines = [
        '{"type": "user", "text": "plain"}', '{"message": {"role": "assistant", "content": "said"}}', "not json", '{"role": "user", "prompt": "asked"}',
        '{"type": "tool", "message": {"role": "user", "content": [{"type": "text", "text": "one"}, {"type": "tool_use", "text": "x"}, {"type": "text", "text": "two"}]}}', '{"type": "user"}',
    ]
    rows = transcripts.parse(spark.createDataFrame(list(enumerate(lines)), "place int, line string")).orderBy("place").collect()
    assert [(r["role"], r["text"]) for r in rows] == [("user", "plain"), ("assistant", "said"), ("user", "asked"), ("user", "one two")]


def test_envelopes(spark):
    import base64

    from loamlog.sources import transcripts

    pack = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
    data = [
        (1, pack('{"ordinal": 0, "text": "a"}\n{"ordinal": 1, "text": "b"}\n')), (2, "!!"), (3, pack(b"\xff\xfe")), (4, pack('{"ordinal": 1, "text": "a"}')), (5, pack("nonsense")),
    ]
    rows = transcripts.envelope_records(spark.createDataFrame(data, "pack_id int, body string")).collect()
    assert [(r["ordinal"], r["text"]) for r in rows if r["pack_id"] == 1] == [(0, "a"), (1, "b")]
    assert {r["pack_id"]: r["error"] for r in rows if r["error"]} == {2: "invalid_base64", 3: "invalid_encoding", 4: "ordinal_mismatch", 5: "invalid_json"}


def test_lenient_json(spark):
    from loamlog.sources import transcripts

    texts = ['{"decision": "keep"}', 'Sure: {"decision": "drop"} as asked', "nothing", "{broken"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(transcripts.lenient_json(F.col("t"), "decision string")["decision"]).collect()]
    assert got == ["keep", "drop", None, None]


def test_holds_count_the_promotes_of_their_zone(spark):
    """Against one pass in order; positions are global and zones take turns unevenly."""
    import random

    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([f"Say {rng.randrange(25)}!", f"say '{rng.randrange(8)}'", "", None, f"only {i}"]), 3 * i) for i in range(900)]
    want, promoted = {}, {}
    for i, zone, text, _ in rows:
        key = "".join(c for c in (text or "").lower() if c.isalnum() or c == " ")
        done = promoted.setdefault(zone, [])
        gap = next((n for n, k in enumerate(reversed(done), 1) if k == key), None) if key else None
        held = gap is not None and gap <= 20
        want[i] = ("hold" if held else "promote", gap)
        if not held:
            done.append(key)
    frame = spark.createDataFrame(rows, "id long, zone string, statement string, position long").repartition(5)
    got = {r["id"]: (r["decision"], r["gap"]) for r in policy.hold_repeats(frame, 20).collect()}
    assert got == want and {d for d, _ in got.values()} == {"hold", "promote"}


def test_holds_take_few_rounds_over_slices(spark, monkeypatch):
    """Slices of 60 rows, so what one leaves behind reaches the next; each decision hangs on many
    before it, which took a round each."""
    import random

    rng, rounds = random.Random(3), []
    rows = [(i, "z", f"say {rng.randrange(40)}", i) for i in range(600)]
    want, done = {}, []
    for i, _, text, _ in rows:
        gap = next((n for n, k in enumerate(reversed(done), 1) if k == text), None)
        want[i] = ("hold" if gap and gap <= 20 else "promote", gap)
        done += [text] if want[i][0] == "promote" else []
    cut = policy.checkpointed
    monkeypatch.setattr(policy, "checkpointed", lambda df: rounds.append(1) or cut(df))
    frame = spark.createDataFrame(rows, "id long, zone string, statement string, position long").repartition(3)
    for size in (60, policy.HOLD_SLICE):
        rounds.clear()
        assert {r["id"]: (r["decision"], r["gap"]) for r in policy.hold_repeats(frame, 20, size).collect()} == want
        assert len(rounds) <= 5 + 2 * 10
    assert len(rounds) <= 5 + 2  # one slice is walked once


def test_statement_keys_join_runs_of_all_that_is_no_letter_or_digit(spark):
    rows = spark.createDataFrame([("Don't  say\t“No” -- ever!\x0b",), ("\u00e9 a\u00a0_b",), ("``",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.statement_key(F.col("t"))).collect()] == ["dont say no ever", "a b", "", None]


def test_signatures_meet_where_sets_are_alike_and_hardly_elsewhere(spark):
    """Texts of 300 common words: nearly all have a frequent one in front, few are alike."""
    import random
    from itertools import combinations

    rng = random.Random(4)
    sets = [rng.sample(range(300), n) for n in rng.choices(range(1, 90), k=250)]
    sets += [s[: len(s) - rng.randrange(0, 1 + len(s) // 9)] + [300 + i] for i, s in enumerate(sets[:120])]
    rows = spark.createDataFrame([(i, [f"w{w}" for w in s]) for i, s in enumerate(sets)], "id long, tokens array<string>")
    for num, den in ((9, 10), (7, 10)):
        held = retrieval.signatures(rows.select("id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes")), num, den).collect()
        by = {}
        for r in held:
            by.setdefault(r["signature"], []).append(r)
        met = {tuple(sorted((x["id"], y["id"]))) for g in by.values() for x, y in combinations(g, 2) if x["low"] or y["low"]}
        like = lambda a, b: len(a & b) * den >= len(a | b) * num
        due = {(i, j) for i, j in combinations(range(len(sets)), 2) if like(set(sets[i]), set(sets[j]))}
        assert due and due <= met and len(met) < 17_000  # of 68,265 pairs
        docs = rows.select(F.col("id").alias("doc_id"), F.array_join("tokens", " ").alias("text"))
        assert {(r["a"], r["b"]) for r in retrieval.near_duplicate_pairs(docs, num, den).collect()} == due


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_containing_hashes_a_text_once_whatever_the_number_of_items(spark):
    words = "the cat of Ñandú sat on a mat and 猫はマット の上に座った while K ran".split()
    texts = [" ".join(words[(i * j) % len(words)] for j in range(i % 23)) for i in range(150)] + [None, "", "a", "x" * 300_000 + "needle in a haystack" + "y" * 10, "needle in a hay", "stack of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = ["the cat of", "Ñandú sat", "猫はマット", "の", "K ran", "a", "", None, "needle in a haystack", "sat on a mat and 猫はマット の上に座った", "xx", "absent from all of them", "x" * 17, "a"]
    items = spark.createDataFrame(list(enumerate(asked)), "item_id int, text string")
    found = metrics.containing(items, docs)
    want = sorted((i, d) for i, a in enumerate(asked) for d, t in enumerate(texts) if a and t is not None and a in t)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "NestedLoop" not in plan_of(found)


def test_retrieval_quality_reads_what_is_relevant_once(spark, tmp_path):
    spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 13), (2, 20), (3, 30), (None, 40)], "item_id int, doc_id int").write.parquet(str(tmp_path / "relevant"))
    relevant = spark.read.parquet(str(tmp_path / "relevant"))
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 4), (2, 21, 1), (2, 20, 2), (9, 1, 1)], "item_id int, doc_id int, rank int")
    quality = metrics.retrieval_quality(ranked, relevant)
    assert tuple(quality.first()) == (4, round((1 / 3 + 1 + 0 + 0) / 4, 6), round((1 + 0.5) / 4, 6))
    assert plan_of(quality).split("== Initial Plan ==")[0].count("FileScan parquet") == 1
