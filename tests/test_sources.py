"""Tails of files, transcripts, captured payloads, pulled records; the fold and leases as streams."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loamlog.sources import pulled, transcripts
from loamlog.streaming import state

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tail(spark, path, most):
    return [r["line"] for r in transcripts.read_tails(spark, [str(path)], most).orderBy("place").collect()]


def test_tail_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    """Three gigabytes of nothing, then lines: only the end is read."""
    path = tmp_path / "big.jsonl"
    with open(path, "wb") as f:
        f.truncate(3 << 30)
        f.seek(0, os.SEEK_END)
        f.write(b"".join(f"\nline {i} \xc3\xa9".encode("latin-1") if False else f"\nline {i} é".encode() for i in range(1000)))
    got = tail(spark, path, 100)
    assert got[-1] == "line 999 é" and got == [f"line {i} é" for i in range(1000 - len(got), 1000)] and 5 <= len(got) <= 9


def test_what_a_tail_cuts(spark, tmp_path):
    path = tmp_path / "t"
    path.write_bytes("é1\r\né2\n\né3".encode())
    assert tail(spark, path, 1000) == ["é1", "é2", "é3"]
    assert tail(spark, path, 9) == ["é2", "é3"] and tail(spark, path, 8) == ["é3"]  # a cut line goes
    path.write_bytes(("é" * 100).encode())
    assert tail(spark, path, 51) == ["é" * 25]  # one line alone: only the cut character goes
    path.write_bytes(b"")
    assert tail(spark, path, 10) == []


PARSED = {
    '{"type": "user", "text": "plain text here"}': ("user", "plain text here"),
    '{"type": "human", "text": "of a human being"}': ("user", "of a human being"),
    '{"type": "AI", "prompt": "of a machine"}': ("assistant", "of a machine"),
    '{"message": {"role": "assistant", "content": "said so here"}}': ("assistant", "said so here"),
    '{"role": "human", "content": "top level content"}': ("user", "top level content"),
    '{"type": "user", "content": ["one string", "and another"]}': ("user", "one string and another"),
    '{"type": "tool", "message": {"role": "user", "content": [{"type": "text", "text": "first part"}, {"type": "tool_use", "text": "no prose"}, {"type": "thinking", "text": "no"}, {"type": "input_text", "text": "second part"}, {"type": "output_text", "text": "third part"}, 7, null]}}': ("user", "first part second part third part"),
    '{"type": "user", "message": {"content": []}, "text": "falls back to text"}': ("user", "falls back to text"),
    '{"type": "user", "message": "no object", "last_prompt": "falls further back"}': ("user", "falls further back"),
    '{"type": "user", "text": "<user_query>asked within</user_query>"}': ("user", "asked within"),
    '{"type": "user", "text": ["in a list of strings"]}': ("user", "in a list of strings"),
    '{"type": "system", "text": "nobody says this"}': None, '{"text": "without a role"}': None, "not json at all": None, "[1, 2]": None, '"a string"': None, '{"type": "user"}': None, '{"type": "user", "text": 17}': None,
    '{"type": "user", "text": "   "}': None,
}


def test_records_of_a_transcript(spark):
    lines = spark.createDataFrame(list(enumerate(PARSED)), "place int, line string")
    got = {r["place"]: (r["role"], r["text"]) for r in transcripts.parse(lines).collect()}
    assert got == {i: v for i, v in enumerate(PARSED.values()) if v is not None}
    strict = {r["place"]: r["text"] for r in transcripts.parse(lines.unionAll(spark.createDataFrame([(50, '{"type": "user", "text": "short"}'), (51, '{"type": "user", "text": "password: hunter2 is it"}'), (52, '{"type":"user","text":"wide 　space  here"}')], lines.schema)), True).collect()}
    assert strict.keys() == got.keys() | {52} and strict[52] == "wide space here"


def test_relaxed_prose_of_lines(spark):
    rows = [(1, i, x) for i, x in enumerate(["a plain line", '{"type": "user", "output_text": "we will do it"}', "ok", '{"type": "x", "text": "not of a speaker"}', '{"type": "ai", "text": "abcd"}', "   "])]
    rows += [(2, i, json.dumps({"type": "user", "text": f"item number {i}"})) for i in range(100)]
    rows += [(3, i, f"plain {i:03d}") for i in range(70)] + [(3, 70, '{"type":"user","text":"the last one"}'), (3, 71, "never read")]
    got = {r["id"]: r["text"].split("\n") for r in transcripts.joined_prose(spark.createDataFrame(rows, "id int, place int, line string"), ["id"]).collect()}
    assert got[1] == ["a plain line", "we will do it", "abcd"] and got[2] == [f"item number {i}" for i in range(64)]
    assert got[3] == [f"plain {i:03d}" for i in range(70)] + ["the last one"]


def dig(obj, depth=0):
    """The walk of one payload, for comparison."""
    if depth > 3:
        return ""
    for key in transcripts.INLINE_KEYS:
        v = obj.get(key)
        if isinstance(v, str) and v.strip():
            return v.strip()
        if isinstance(v, dict) and (found := dig(v, depth + 1)):
            return found
        if isinstance(v, list):
            parts = []
            for i in v:
                if isinstance(i, str) and i.strip():
                    parts.append(i.strip())
                elif isinstance(i, dict):
                    for k in ("text", "content"):
                        if isinstance(i.get(k), str) and i[k].strip():
                            parts.append(i[k].strip())
                            break
            if parts:
                return "\n".join(parts)
    for key in transcripts.NEST_KEYS:
        if isinstance(obj.get(key), dict) and (found := dig(obj[key], depth + 1)):
            return found
    return ""


def random_payload(rng, depth=0):
    out = {}
    for _ in range(rng.randrange(1, 4)):
        key = rng.choice([*transcripts.INLINE_KEYS, *transcripts.NEST_KEYS, "other", "id"])
        kind = rng.randrange(7)
        word = f"text {rng.randrange(100)}"
        out[key] = (
            [word, "  ", 5, {"a": word}][rng.randrange(4)] if kind < 2 else random_payload(rng, depth + 1) if kind < 5 and depth < 5
            else [rng.choice([word, " ", 3, None, {"text": word}, {"content": word, "text": 5}, {"text": " "}]) for _ in range(rng.randrange(3))]
        )
    return out


def test_payloads_of_any_nesting(spark):
    rng = random.Random(8)
    payloads = [random_payload(rng) for _ in range(300)]
    rows = [(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(1000, '" a text "'), (1001, "no json "), (1002, None), (1003, "[1]"), (1004, "{}"), (1005, "3")]
    got = {r["id"]: r["text"] for r in transcripts.payload_prose(spark.createDataFrame(rows, "id int, payload string")).collect()}
    assert got == {i: dig(p) for i, p in enumerate(payloads)} | {1000: "a text", 1001: "no json", 1002: "", 1003: "", 1004: "", 1005: ""}


def test_payloads_with_transcripts(spark):
    lines = '{"type": "user", "text": "we will go on"}\n{"type": "assistant", "content": ["and so on", {"type": "text", "text": "further"}]}\nplain line'
    rows = [(1, json.dumps({"data": {"text": lines}})), (2, json.dumps({"transcript_path": " a/b ", "session": {"text": "later"}})), (3, json.dumps({"transcriptPath": "none", "session": {"text": "later"}})), (4, json.dumps({"text": 'x\n{"type": "tool"}'}))]
    known = spark.createDataFrame([("a/b", "from the file")], "path string, text string")
    got = {r["id"]: r["text"] for r in transcripts.payload_prose(spark.createDataFrame(rows, "id int, payload string"), known).collect()}
    assert got == {1: "we will go on\nand so on further\nplain line", 2: "from the file", 3: "later", 4: 'x\n{"type": "tool"}'}


# ---- pulled records ----

def remote(spark, path, rows, mode="overwrite"):
    spark.createDataFrame(rows, pulled.SCHEMA).repartition(3).write.mode(mode).parquet(path)


def records(zone, numbers):
    return [(zone, n, f"{zone}{n}{k}", k, f"body {n}") for n in numbers for k in (("event", "erasure") if n % 5 == 0 else ("event",))]


def test_pages_give_each_record_once(spark, tmp_path):
    path = str(tmp_path / "remote")
    rows = records("a", range(1, 60)) + records("b", [3, 900, 901, 5000]) + [("c", 7, f"c{i}", "event", "") for i in range(9)]
    remote(spark, path, rows)
    for limit in (1, 4, 1000):
        assert sorted(tuple(r) for r in pulled.pull(spark, path, limit=limit).collect()) == sorted(rows)
    behind = pulled.pull(spark, path, {"a": 50, "b": 900}, limit=3).collect()
    assert sorted(tuple(r) for r in behind) == sorted(r for r in rows if r[1] > {"a": 50, "b": 900, "c": 0}[r[0]])
    page, more = pulled.Remote(path).page("a", 0, 6)
    assert len(page) == 6 and more and not pulled.Remote(path).page("c", 0, 9)[1]


def test_pages_are_cut_from_blocks_and_long_zones_from_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "remote")
    rows = records("a", range(1, 3000)) + records("b", range(1, 40)) + [(None, n, f"x{n}", "event", "") for n in range(1, 30)]
    remote(spark, path, rows)
    reads = []
    real = pulled.dataset_of
    monkeypatch.setattr(pulled, "dataset_of", lambda source: reads.append(source) or real(source))
    part = pulled.ZoneRange("a", 0, 2999)
    got = list(pulled.read_range(pulled.Remote(path), part, 10))
    assert sorted(got) == sorted(r for r in rows if r[0] == "a") and len(reads) == 1
    monkeypatch.setattr(pulled, "SPAN", 500)
    parts = pulled.PulledReader({"path": path, "cursors": '{"a": 700}'}).partitions()
    assert [(p.zone, p.after, p.upto) for p in parts] == [(None, 0, 29), ("a", 700, 1200), ("a", 1200, 1700), ("a", 1700, 2200), ("a", 2200, 2700), ("a", 2700, 2999), ("b", 0, 39)]
    got = [r for p in parts for r in pulled.read_range(pulled.remote_of(path, p), p, 7)]
    key = lambda r: (r[0] or "", *r[1:])
    assert sorted(got, key=key) == sorted((r for r in rows if r[0] != "a" or r[1] > 700), key=key)
    assert pulled.pull(spark, path).where("zone IS NULL").count() == 29


def test_a_stream_goes_on_behind_its_cursors(spark, tmp_path):
    path, out = str(tmp_path / "remote"), str(tmp_path / "out")

    def run():
        stream = pulled.pull_stream(spark, path, limit=4)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    first, second = records("a", range(1, 12)), records("a", range(12, 30)) + records("b", range(1, 4))
    remote(spark, path, first)
    run()
    assert spark.read.parquet(out).count() == len(first)
    run()
    remote(spark, path, second, "append")
    run()
    got = sorted(tuple(r) for r in spark.read.schema(pulled.SCHEMA).parquet(out).collect())
    assert got == sorted(first + second)


# ---- streams with state ----

@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def run_batches(spark, tmp_path, schema, batches, build, mode, name):
    """Feeds batches one by one, each by a new query on the same checkpoint; rows in order."""
    got, source = [], tmp_path / f"{name}-in"

    def keep(df, number):
        got.append((number, [tuple(r) for r in df.collect()]))

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = build(spark.readStream.schema(schema).parquet(str(source)))
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination()
    return got


SAID = [
    "We must always keep the ledger append only.", "We prefer small batches of rows.", "we PREFER small  batches of rows.", "We prefer ｓmall batches of rows.", "ok", "Correction: do not use small batches. Always use large ones.",
    "We prefer small batches of rows.", "The policy is to replace nothing.", "Never use the old loader.", "We must always keep the ledger append only.", "The default workflow stays.", "We decided on nine parts.",
    "The procedure has four steps.", "Constraint: archives never shrink.", "We adopted the new schema.", "We chose the wide layout.", "The policy is short.", "We should keep two copies.",
]


def test_the_fold_as_a_stream(rocks, tmp_path):
    spark, schema = rocks, "conv_id long, turn long, role string, text string"
    turns = [(c, t, "user" if t % 4 else "assistant", SAID[(t * (c + 1)) % len(SAID)]) for c in range(3) for t in range(40)]
    want = {}
    for r in state.fold_transcripts(spark.createDataFrame(turns, schema)).collect():
        want.setdefault(r["conv_id"], []).append(tuple(r))
    by_turn = sorted(turns, key=lambda r: (r[1], r[0]))
    for name, cuts in (("one", []), ("four", [17, 18, 70]), ("many", [9, 31, 60, 90, 111])):
        edges = [0, *cuts, len(by_turn)]
        batches = [by_turn[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        last = {}
        for _, rows in run_batches(spark, tmp_path, schema, batches, state.fold_stream, "update", name):
            fresh = {}
            for r in rows:
                fresh.setdefault(r[0], []).append(r)
            last |= fresh
        assert {c: sorted(v) for c, v in last.items()} == {c: sorted(v) for c, v in want.items()}


def test_a_dead_worker_loses_its_lease(rocks, tmp_path):
    """Two workers, one dies with jobs in hand; each job is done once, by rank and age."""
    spark, schema = rocks, "queue string, number long, kind string, job_id string, worker string, rank int, most int, at timestamp"
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [("q", i, "add", f"j{i}", None, i % 3, None, at(i)) for i in range(6)] + [("q", 6, "add", "j0", None, 0, None, at(6))]
    rows += [("q", 10, "claim", None, "dies", None, 2, at(10)), ("q", 11, "claim", None, "lives", None, 2, at(11)), ("q", 12, "ack", "j1", "lives", None, None, at(20)), ("q", 13, "ack", "j0", "lives", None, None, at(21))]
    first = rows
    second = [("q", 20, "claim", None, "lives", None, 9, at(50)), ("q", 21, "ack", "j2", "lives", None, None, at(60)), ("q", 22, "ack", "j5", "lives", None, None, at(61))]
    third = [("q", 30, "claim", None, "lives", None, 9, at(200)), *[("q", 31 + i, "ack", f"j{i}", "lives", None, None, at(210)) for i in (0, 3, 4)], ("q", 50, "ack", "j3", "dies", None, None, at(220))]
    fourth = [("other", 60, "add", "x", None, 0, None, at(600))]
    cast = lambda batch: [(*r[:7], __import__("datetime").datetime.fromisoformat(r[7])) for r in batch]
    got = run_batches(spark, tmp_path, schema, [cast(b) for b in (first, second, third, fourth)], lambda s: state.lease_stream(s, "2 minutes"), "append", "leases")
    events = [(r[1], r[2], r[3], r[5]) for _, batch in got for r in batch]
    leased = [(j, w) for e, j, w, _ in events if e == "leased"]
    assert leased[:4] == [("j0", "dies"), ("j3", "dies"), ("j1", "lives"), ("j4", "lives")]  # rank, then age
    done = [j for e, j, _, _ in events if e == "done"]
    assert sorted(done) == ["j0", "j1", "j2", "j3", "j4", "j5"] and len(done) == 6
    assert {(j, w) for e, j, w, _ in events if e == "lapsed"} == {("j0", "dies"), ("j3", "dies"), ("j4", "lives")}
    assert ("refused", "j0", "lives", 1) in events and ("refused", "j3", "dies", 0) in events
