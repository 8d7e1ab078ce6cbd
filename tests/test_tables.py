"""Tables that outlive a query: snapshots, appends, the text index, chunks, vectors."""

import pathlib
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamlog.operators import chunk_table, fulltext, retrieval, vector_table
from loamlog.sources import notes as N
from loamlog.sources import store as S


@pytest.fixture
def store(spark, tmp_path):
    return S.Store(spark, f"file://{tmp_path}/t")


def test_a_number_is_claimed_once(store):
    assert store.latest() == (0, {})
    assert store.commit(0, {"a": 1}) == 1
    with pytest.raises(S.Conflict):
        store.commit(0, {"a": 2})
    assert store.latest() == (1, {"a": 1})
    store.update(lambda s: s | {"b": 2})
    assert store.latest() == (2, {"a": 1, "b": 2}) and store.at(1) == {"a": 1}


def test_writers_at_once_lose_and_double_nothing(spark, store):
    """Four writers whose batches share keys; each batch is sent twice, as after a restart."""
    log = S.AppendLog(store, "id long, by string", "id")
    failed = []

    def write(name, start):
        try:
            for number in range(3):
                batch = spark.range(start + 20 * number, start + 20 * number + 30).select("id", F.lit(name).alias("by"))
                log.append(batch, name, number)
                assert log.append(batch, name, number) == 0
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(f"w{i}", 40 * i)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    rows = [r["id"] for r in log.rows().collect()]
    assert sorted(rows) == list(range(190))
    log.compact()
    assert sorted(r["id"] for r in log.rows().collect()) == list(range(190)) and len(store.latest()[1]["folders"]) == 1
    store.KEEP = 1
    assert store.clean() >= 12 and log.rows().count() == 190


def test_an_append_stream_goes_on_after_a_restart(spark, store, tmp_path):
    log, source = S.AppendLog(store, "id long, by string", "id"), str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema("id long, by string").parquet(source)
        stream.writeStream.foreachBatch(lambda df, n: log.append(df, "stream", n)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    for part in ([(1, "a"), (2, "a"), (2, "a")], [(2, "b"), (3, "b")], [(3, "c")]):
        spark.createDataFrame(part, "id long, by string").coalesce(1).write.mode("append").parquet(source)
        run()
    run()
    assert sorted(tuple(r) for r in log.rows().collect()) == [(1, "a"), (2, "a"), (3, "b")]


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa the".split()) + (str(rng.randrange(30)) if rng.random() < 0.5 else "") for _ in range(n))


def same_topk(index, docs, queries, k=7):
    want = retrieval.lexical_topk(queries, docs, k).select("item_id", "doc_id", "score", "rank")
    return sorted(map(tuple, index.topk(queries, k).select("item_id", "doc_id", "score", "rank").collect())) == sorted(map(tuple, want.collect()))


def test_text_index_through_upserts_and_merge(spark, store):
    rng = random.Random(4)
    docs = {i: words(rng, rng.randrange(1, 60)) for i in range(300)} | {300: None, 301: "", 302: "the " * 4000}
    queries = spark.createDataFrame([(i, words(rng, 5)) for i in range(12)] + [(12, "nothing of this kind"), (13, "the the alpha"), (14, ""), (15, None)], "item_id long, text string")
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    index = fulltext.TextIndex(store, buckets=16)
    index.upsert(frame(docs))
    assert same_topk(index, frame(docs), queries)
    changed = {i: words(rng, 20) for i in range(0, 300, 7)} | {400: "alpha beta", 401: "new words"}
    gone = [5, 6, 302]
    index.upsert(frame(changed), spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    docs = {i: t for i, t in (docs | changed).items() if i not in gone}
    assert same_topk(index, frame(docs), queries)
    index.upsert(frame({5: "alpha back again"}))
    docs |= {5: "alpha back again"}
    before = store.latest()[1]
    assert len(before["segments"]) == 3 and same_topk(index, frame(docs), queries)
    index.merge()
    after = store.latest()[1]
    assert len(after["segments"]) == 1 and after["dead"] == [] and same_topk(index, frame(docs), queries)
    assert index.postings().groupBy("token", "doc_id").count().where("count > 1").isEmpty()
    assert sorted(map(tuple, index.postings(state=before).select("token", "doc_id").collect())) == sorted(map(tuple, index.postings().select("token", "doc_id").collect()))


def test_a_search_reads_the_buckets_of_its_tokens(spark, store):
    index = fulltext.TextIndex(store, buckets=64)
    index.upsert(spark.createDataFrame([(i, f"word{i} common") for i in range(500)], "doc_id long, text string"))
    query = spark.createDataFrame([(1, "word7 word8")], "item_id long, text string")
    _, buckets = index.asked(query)
    rows = index.postings(buckets)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(buckets) <= 2 and "PartitionFilters: [bucket" in plan
    folders = {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}
    assert len(rows.inputFiles()) == len(index.postings().inputFiles())  # the same table ...
    read = {r[0].split("bucket=")[1].split("/")[0] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert read == {str(b) for b in buckets} and len(folders) > 20  # ... of which only these are read


def test_a_segment_reads_each_text_once_and_a_search_exchanges_no_pairs(spark, store):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(i, f"common word{i % 7} x{i}") for i in range(300)], "doc_id long, text string")
    index = fulltext.TextIndex(store, buckets=4)
    index.upsert(docs.select("doc_id", counted("text").alias("text")))
    assert seen.value == 300
    queries = spark.createDataFrame([(i, f"common word{i % 7}") for i in range(40)] + [(99, None), (98, "absent")], "item_id long, text string")
    assert same_topk(index, docs, queries, 3)
    plan = index.topk(queries, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(times" not in plan  # a row for each query and document that share a token
    assert index.topk(queries.where("item_id = 99"), 3).isEmpty()


def log_rows(spark, n, skip=(), draft=""):
    kinds = ["EvidenceArtifact", "Observation", "Claim", "AcceptanceDecision", "Supersession"]
    rows = []
    for i in range(n):
        if i in skip:
            continue
        kind = kinds[i % 5]
        rows.append((i, f"evt_{i}", kind, f"tz_{i % 2}", "draft" if i % 3 == 0 else "active", "verified", f"{draft if i % 3 == 0 else ''}statement {i}" if kind in ("Observation", "Claim") else None, "accepted" if i % 5 == 3 else None, f"s{i % 4}", f"evt_{i - 4}" if i >= 4 else None))
    out = spark.createDataFrame(rows, "n long, event_id string, event_type string, zone string, lifecycle string, authority string, statement string, decision string, subject string, target_id string")
    return out.withColumn("recorded", F.timestamp_seconds(F.col("n")))


def test_chunks_follow_the_log_and_leave_other_slices_alone(spark, store):
    table = chunk_table.ChunkTable(store, width=20)
    erased = lambda *names: spark.createDataFrame([(x,) for x in names], "target_id string")
    assert table.rebuild(log_rows(spark, 100), erased())["written"] == 5
    first = table.folders()
    assert table.rebuild(log_rows(spark, 100), erased())["written"] == 0 and store.latest()[0] == 1
    # events 100 to 129 are new, 41 is gone, 62 is erased
    log, gone = log_rows(spark, 130, skip=(41,)), erased("evt_62")
    done = table.rebuild(log, gone)
    assert done["written"] == 4 and done["kept"] == 3
    now = table.folders()
    assert {s for s in first if now[s] == first[s]} == {0, 1, 4}
    rows = {r["chunk_id"]: r["status"] for r in table.rows().collect()}
    full = {r["chunk_id"]: r["status"] for r in chunk_table.chunk_rows(log, gone).collect()}
    assert {c: s for c, s in rows.items() if s != "stale"} == full
    stale = {r["event_id"] for r in table.rows().where("status = 'stale'").collect()}
    assert stale == {"evt_41"}
    hit = {r["event_id"] for r in table.rows().where("status = 'projection_deleted'").collect()}
    assert hit == {"evt_62", "evt_66"}  # the erased one and what was derived from it
    assert table.rows(1).count() == 80  # the first snapshot is still what it was
    # what comes back is no longer stale
    table.rebuild(log_rows(spark, 130), gone)
    assert table.rows().where("status = 'stale'").isEmpty()


def test_files_of_chunks_follow_rows_and_not_slices(spark, store):
    table = chunk_table.ChunkTable(store, width=2)
    none = spark.createDataFrame([], "target_id string")
    assert table.rebuild(log_rows(spark, 600), none)["written"] == 300
    first = set(table.folders().values())
    files = list((pathlib.Path(store.root.removeprefix("file://")) / "data").rglob("*.parquet"))
    assert len(first) == 1 and len(files) <= 8  # not one and more a slice
    new = log_rows(spark, 600, draft="new ")
    assert table.rebuild(new, none)["written"] == 80 and first < set(table.folders().values())
    rows = [(r["chunk_id"], r["status"]) for r in table.rows().collect()]
    full = {r["chunk_id"] for r in chunk_table.chunk_rows(new, none).collect()}
    assert {c for c, status in rows if status != "stale"} == full and len(rows) == len(set(rows)) == 480 + 80
    # 202 slices change; of both folders less than half is left, which is written anew
    erased = spark.createDataFrame([(f"evt_{i}",) for i in range(400)], "target_id string")
    assert table.rebuild(new, erased)["written"] == 300 and len(set(table.folders().values())) == 1
    rows = [(r["chunk_id"], r["status"]) for r in table.rows().collect()]
    assert {c for c, status in rows if status != "stale"} == full and len(rows) == len(set(rows)) == 480 + 80
    assert table.rows(1).count() == 480


def test_an_empty_log(spark, store):
    table = chunk_table.ChunkTable(store)
    table.rebuild(log_rows(spark, 10).limit(0), spark.createDataFrame([], "target_id string"))
    assert table.rows().count() == 0


def test_vector_table_skips_cells_and_is_exact(spark, store):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(80, 16)) for c in centres] + [np.zeros((2, 16)), np.repeat(centres[:1], 5, axis=0)])
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    good = vector_table.records(rows, "m1")
    odd = spark.createDataFrame([(5000, [1.0] * 15, "m1", "x"), (5001, [float("nan")] * 16, "m1", "x"), (5002, None, "m1", "x")], "vec_id long, vector array<double>, model string, digest string")
    odd = odd.withColumn("digest", F.coalesce(vector_table.vector_digest(F.col("vector")), F.lit("x")))
    other = good.withColumns({"vec_id": F.col("vec_id") + 6000, "model": F.lit("m2")})
    broken = good.withColumns({"vec_id": F.col("vec_id") + 9000, "digest": F.lit("sha-256:0")})
    table = vector_table.VectorTable(store)
    table.build(good.unionAll(odd).unionAll(other).unionAll(broken), "m1", 16, cells=12)
    asked = good.where("vec_id % 101 = 0 OR vec_id = 961").select(F.col("vec_id").alias("query_id"), "vector")
    found, read = table.nearest(asked, 6)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()}
    units = x / np.where((s := np.sqrt((x * x).sum(axis=1))) == 0, 1, s)[:, None]
    for q in {k[0] for k in got}:
        scores = np.round(units @ units[q], 6)
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:6]
        assert [got[q, r + 1][0] for r in range(6)] == order
        assert all(abs(got[q, r + 1][1] - scores[i]) < 1e-5 for r, i in enumerate(order))
    assert read["pairs"] < read["of"] / 2
    # one query reads few cells, and the files of no other
    found, read = table.nearest(asked.where("query_id = 0"), 3)
    assert read["read"] < read["cells"] / 2 and found.count() == 3


def test_freshness_can_be_behind(spark):
    z = "zone string, {} long"
    out = chunk_table.freshness(
        spark.createDataFrame([("a", 3), ("a", 5)], z.format("zone_sequence")), spark.createDataFrame([("a", 7), ("b", 2)], z.format("zone_sequence")),
        spark.createDataFrame([("a", 7), ("b", 4), ("c", 1)], z.format("after_sequence")),
    )
    assert sorted(map(tuple, out.collect())) == [("a", 7, 7, False), ("b", 2, 4, True), ("c", 0, 1, True)]


def files(folder):
    return {str(p.relative_to(folder)): (p.read_text(), p.stat().st_mtime_ns) for p in folder.rglob("*") if p.is_file() and ".drafts" not in p.parts}


def test_notes_are_written_once(spark, store, tmp_path):
    folder = tmp_path / "vault"
    sink = N.NoteSink(store, f"file://{folder}")
    rows = {f"claims/n{i}.md": f"body {i}\n" for i in range(40)} | {"index.md": None, "log.md": "x"}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, body string")
    assert sink.write(frame(rows)) == {"written": 42, "removed": 0}
    first = files(folder)
    assert {p: b for p, (b, _) in first.items()} == {p: b or "" for p, b in rows.items()}
    assert sink.write(frame(rows)) == {"written": 0, "removed": 0} and files(folder) == first
    rows = rows | {"claims/n3.md": "other", "evidence/new.md": "new"}
    del rows["log.md"]
    assert sink.write(frame(rows)) == {"written": 2, "removed": 1}
    now = files(folder)
    assert {p: b for p, (b, _) in now.items()} == {p: b or "" for p, b in rows.items()}
    assert {p for p in first if p in now and first[p] == now[p]} == set(first) - {"claims/n3.md", "log.md"}
    for path in ("../out.md", "/abs.md", ".hidden", "a//b", None):
        with pytest.raises(ValueError):
            sink.write(frame({path: "x"}))


def test_notes_of_a_run_that_was_lost(spark, store, tmp_path, monkeypatch):
    """The commit stands, the moves were not made: the next run makes them."""
    folder = tmp_path / "vault"
    sink = N.NoteSink(store, f"file://{folder}")
    rows = spark.createDataFrame([("a.md", "one"), ("b.md", "two")], "path string, body string")
    real = N.NoteSink.finish
    calls = []
    monkeypatch.setattr(N.NoteSink, "finish", lambda self: calls.append(1) or (real(self) if len(calls) == 1 else (_ for _ in ()).throw(RuntimeError("lost"))))
    with pytest.raises(RuntimeError):
        sink.write(rows)
    assert files(folder) == {} or all(".drafts" in p for p in files(folder))
    monkeypatch.setattr(N.NoteSink, "finish", real)
    assert sink.write(rows) == {"written": 0, "removed": 0}
    assert {p: b for p, (b, _) in files(folder).items()} == {"a.md": "one", "b.md": "two"}
