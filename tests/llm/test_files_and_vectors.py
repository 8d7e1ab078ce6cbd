"""Token files, WARC archives, SentencePiece and the vector join, against brute force."""

import gzip
import hashlib
import io
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamlog.llm import embedding_dedup, sentencepiece_backend, token_files, warc
from loamlog.llm.queries import tokenizer_file
from tests.conftest import DATA
from tests.llm.conftest import prose

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["", " ", "a", " a", "a ", "a  b", "\n", "a\n b", "a \n", "x<|endoftext|> y", "a b c", "é è", "don't it's 's", "a\tb c\t d", "  lead", "　x y", "12 34 a1", ".. ..", "😀 ok", "ends\n\n"]


def test_token_files_on_odd_rows(edges, edge_rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file(BPE))
    got = token_files.token_files(edges, tokenizer_file(BPE)).collect()
    rows = sorted(((d, t) for d, t in (r[:2] for r in edge_rows)), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for d, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_token_files_of_nothing(nothing):
    assert token_files.token_files(nothing, tokenizer_file(BPE)).count() == 0


def test_documents_are_read_one_by_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(random.Random(i), 50)) for i in range(300)], "doc_id long, text string")
    files, dictionary = token_files.write_token_files(docs, f"file://{tmp_path}", tokenizer_file(BPE))
    assert len(dictionary) > 0 and sum(n for _, n, _ in files) == 300
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(files[0][0])
    with system.open_input_file(inner) as source:
        held = token_files.TokenFile(source, dictionary)
        doc_id, ids = held.document(len(held) - 1)
        text = dict(docs.collect())[doc_id]
        assert ids.tolist() == [*token_files.encoder(tokenizer_file(BPE)).encode([text])[0].tolist(), 0]
        with pytest.raises(ValueError):
            token_files.TokenFile(source, b"another dictionary")


def test_words_are_encoded_as_in_whole_texts():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file(BPE))
    rng = random.Random(1)
    texts = [*ODD, *(prose(rng, rng.randrange(1, 60)) for _ in range(200)), *("".join(rng.choice("ab \n\t.1é'") for _ in range(40)) for _ in range(400))]
    held = token_files.encoder(tokenizer_file(BPE))
    for _ in range(2):
        for t, ids in zip(texts, held.encode(texts), strict=True):
            assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids


def test_a_full_word_collection_changes_nothing(monkeypatch):
    from loamlog.llm.words import Encoder

    monkeypatch.setattr(Encoder, "WORDS", 5)
    known = token_files.encoder(tokenizer_file(BPE))
    fresh = Encoder(known.tokenizer, "Ġ", True)
    rng = random.Random(2)
    for _ in range(5):
        texts = [prose(rng, 30, [f"w{rng.randrange(40)}" for _ in range(30)]) for _ in range(4)]
        assert [x.tolist() for x in fresh.encode(texts)] == [x.ids for x in known.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(fresh.index) <= 5 + 40


def test_sentencepiece_parity_on_odd_rows(edges, edge_rows, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECES))
    want = Counter()
    for d, t in (r[:2] for r in edge_rows):
        ids = library.encode(t or "")
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    rows = sentencepiece_backend.encode_documents(edges, tokenizer_file(PIECES)).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    assert all(r["parity"] for r in rows)
    odd = {r["doc_id"] for r in rows if not r["round_trip"]}
    assert odd == {d for d, t in (r[:2] for r in edge_rows) if "▁" in (t or "")}  # the marker reads as a space
    assert sentencepiece_backend.encode_documents(nothing, tokenizer_file(PIECES)).count() == 0


def test_sentencepiece_columns_pass_through(edges):
    out = sentencepiece_backend.encode_column(edges, tokenizer_file(PIECES))
    assert out.columns == [*edges.columns, "ids", "parity", "round_trip"]


def test_sentencepiece_random_strings():
    held = sentencepiece_backend.backend(tokenizer_file(PIECES), 2)
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice("abc  \n.1é日\U0001f600'") for _ in range(30)) for _ in range(500))]
    ids, agreed = held.encode(texts)
    assert [x.tolist() for x in ids] == held.reference_ids(texts)
    assert sum(agreed) > 0.95 * len(texts)
    assert held.decode(ids) == texts


def unigram_model(tmp_path, **normalizer):
    """A small unigram model with byte fallback, written out by hand."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    for i in range(256):
        model.pieces.add(piece=f"<0x{i:02X}>", score=0, type=6)
    for piece, score in {"▁": -3.0, "a": -4.0, "b": -4.1, "n": -4.2, "▁ban": -5.0, "ana": -5.2, "an": -4.9, "▁b": -4.5, "na": -5.1, "nana": -7.0}.items():
        model.pieces.add(piece=piece, score=score, type=1)
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = True
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = normalizer.get("prefix", True)
    model.normalizer_spec.remove_extra_whitespaces = normalizer.get("squeeze", False)
    model.normalizer_spec.escape_whitespaces = True
    path = tmp_path / f"unigram{len(normalizer)}.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("normalizer", [{}, {"squeeze": True}, {"prefix": False}])
def test_unigram_models(tmp_path, normalizer):
    held = sentencepiece_backend.Backend(unigram_model(tmp_path, **normalizer), 1)
    texts = ["banana", "banana ban", "nab é", "ananas an", "a", "b  nana"]
    ids, agreed = held.encode(texts)
    assert [x.tolist() for x in ids] == held.reference_ids(texts)
    assert sum(agreed) >= len(texts) - 1


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, record_type string").repartition(3)


@pytest.fixture(scope="module")
def page_rows():
    body = "<p>" + "y" * 200 + "</p>"
    rows = [(5, "http://a", body), (3, "http://b\r\nX: y", body), (9, None, body), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "é" * 60), (8, "u", "é" * 60), (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "u", "q" * 300_000), (None, "u", "n" * 150), (13, "u", "n" * 150), (3, "u", body), (14, "u", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    return [(*r, "p", "t") for r in rows]


def resolved_by_force(rows):
    first = defaultdict(list)
    for p, _, h, *_ in rows:
        if p is not None:
            first[h or ""].append(p)
    out = []
    for p, _, h, *_ in rows:
        data = (h or "").encode()
        target = min(first[h or ""], default=None) if len(data) >= 100 else None
        again = target is not None and p != target and sum((r[2] or "") == (h or "") for r in rows) > 1
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", target if again else None))
    return sorted(out, key=str)


def test_warc_round_trip_on_odd_rows(spark, page_rows):
    got = warc.warc_round_trip(pages(spark, page_rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == resolved_by_force(page_rows)
    assert warc.warc_round_trip(pages(spark, [])).count() == 0


def test_archives_have_fresh_headers_and_each_payload_once(spark, page_rows, tmp_path):
    files = warc.write_archives(pages(spark, page_rows), f"file://{tmp_path}")
    assert sum(n for _, n in files) == len(page_rows)
    ids, payloads = [], Counter()
    for name, _ in files:
        data = gzip.decompress(open(name.removeprefix("file://"), "rb").read())
        for head, block in warc.records(io.BytesIO(data)):
            ids.append(head["warc-record-id"])
            body = block.partition(b"\r\n\r\n")[2]
            if head["warc-type"] == "response":
                payloads[body] += len(body) >= 100
            else:
                assert body == b"" and ("warc-refers-to" in head) == (head["x-refers-to-page-id"] != "3") and head["warc-refers-to-target-uri"]
    twice = [b for b, n in payloads.items() if n > 1]
    assert all(b == page_rows[0][2].encode() for b in twice)  # only the repeated page id
    assert len(set(ids)) == len(page_rows)


def test_damaged_archives_are_refused():
    good = gzip.decompress(warc.record(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), "response", None, "2024-01-01T00:00:00Z"))
    assert [warc.parse(*r)[0] for r in warc.records(io.BytesIO(good))] == [1]
    with pytest.raises(ValueError):
        [warc.parse(*r) for r in warc.records(io.BytesIO(good.replace(b"xxx", b"xyx", 1)))]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-9])))


def vectors_by_force(rows, least=0.98):
    unit = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if ok else None)
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    out = []
    for i, (d, *_) in enumerate(rows):
        least_id = min((rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None), default=None)
        out.append((d, links[i], least_id, d == least_id))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell", [4096, 25, 7])
def test_vector_join_against_all_pairs(spark, monkeypatch, cell):
    """One cell, Voronoi cells, and cells that are cut into blocks."""
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", cell)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(150):
        rows.append((i, rng.normal(size=6).tolist(), i % 2))
    for i in range(80):  # a dense cluster, and a chain of near vectors
        rows.append((1000 - i, (np.ones(6) + rng.normal(size=6) * 0.08).tolist(), 1))
        rows.append((2000 + i, [float(np.cos(i / 8)), float(np.sin(i / 8)), 0.0, 0.0, 0.0, 0.0], 0))
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 6, 1), (3003, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (3004, [float("nan")] * 6, 1), (3005, [float("inf")] * 6, 1)]
    rows += [(3006, [1.0] * 6, None), (3007, [1e-30] * 6, 1), (3008, [1.0] * 5, 1), (3009, [1.0] * 5, 1), (3010, [1e30] * 6, 1), (None, [1.0] * 6, 1), (3007, [1.0] * 6, 1), (3011, [-1.0] * 6, 1)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, uid int, grp string").repartition(4)
    got = embedding_dedup.link_vectors(frame).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == vectors_by_force(rows)


def test_vector_join_of_nothing(spark):
    assert embedding_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_are_laid_down_once(spark, monkeypatch):
    """Vectors at right angles, which pivots cannot part: they are written once, and go to a task once."""
    n, held = 3000, []

    def weighed(*args, **more):
        out = staged(*args, **more)
        held.append(sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles()))
        return out

    staged = embedding_dedup.staged
    monkeypatch.setattr(embedding_dedup, "staged", weighed)
    monkeypatch.setattr(embedding_dedup, "CELL", 100)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.link_vectors(frame).collect()
    assert sum(held) < 2 * x.nbytes
    assert len(got) == n and all(r["n_links"] == 0 and r["kept"] for r in got)
    cells = embedding_dedup.split(embedding_dedup.prepared(frame), math.sqrt(0.04) + embedding_dedup.SLACK)
    assert n < cells.count() < 2.5 * n and cells.where("home").count() == n
    assert embedding_dedup.packed(cells).count() < 1.1 * n
    monkeypatch.setattr(embedding_dedup, "BLOCK", 600)
    dealt = embedding_dedup.packed(embedding_dedup.split(embedding_dedup.prepared(frame), math.sqrt(0.04) + embedding_dedup.SLACK))
    assert {r["blocks"] for r in dealt.select("blocks").distinct().collect()} == {2} and dealt.count() < 1.1 * n


@pytest.mark.parametrize(("block", "size"), [(10**6, 1 << 25), (60, 1 << 25), (10**6, 60 * 48)])
def test_vector_join_in_small_tiles(spark, monkeypatch, block, size):
    """Components that grow together over tiles, cells and blocks; labels that hold the mark of cells."""
    for name, value in (("CELL", 30), ("BLOCK", block), ("BLOCK_BYTES", size), ("TILE", (7, 16))):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(9)
    rows = [(i, (c + rng.normal(size=6) * 0.05).tolist(), "a") for c in rng.normal(size=(5, 6)) for i in rng.integers(0, 10**6, 40).tolist()]
    rows += [(2_000_000 - i, [float(np.cos(i / 8)), float(np.sin(i / 8)), 0.0, 0.0, 0.0, 0.0], "a") for i in range(50)]
    rows += [(3_000_000 + i, v, f"a/6/{i % 4}"[: [1, 3, 5][i % 3]]) for i, (_, v, _) in enumerate(rows[:60])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    got = embedding_dedup.link_vectors(frame).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == vectors_by_force(rows)


def test_labels_like_names_of_cells(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(rng.normal(size=(40, 2)))]
    rows += [(100 + i, rows[i][1], "a/2") for i in range(10)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = embedding_dedup.link_vectors(frame).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == vectors_by_force(rows)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").withColumn("score", F.lit(0.25))
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{DATA}/sf0.001").cache()
        if name != "sentencepiece":
            assert out.columns == columns and 0 < out.count() <= n
            assert out.where("score <> 0.25").count() == 0
            n = out.count()
        else:
            assert out.count() == n and {"doc_id", "n_tokens"} <= set(out.columns)
        docs = out
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "suffix_dedup", "decontamination", "sentencepiece"]
    assert corpus_pipeline.run(spark, f"{DATA}/sf0.001").count() == n


def test_language_stage_rejects_what_no_language_accounts_for(spark):
    import random

    import corpus_pipeline

    rng = random.Random(12)
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxzBCDFGHJKLM0123456789+/") for _ in range(n)) for n in (60, 400, 5000)]
    junk += [" ".join("".join(rng.choice("qwxzkvjpg") for _ in range(5)) for _ in range(80)), "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059 " * 30]
    planted = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate([*junk, "12 34 !!", None])], "doc_id long, text string")
    rows = docs.unionByName(planted, allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, rows, "").select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}
    unlabelled = rows.withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, unlabelled, "").select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in rows.collect()} - {10**9 + len(junk), 10**9 + len(junk) + 1}
