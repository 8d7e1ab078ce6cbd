"""Whole results against plain versions, name clashes, and the pipeline over odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamlog.llm import common, decontamination, jaccard_join, language_id, sentencepiece_backend, sharding, suffix_dedup, toxicity
from loamlog.llm.queries import tokenizer_file
from tests.conftest import DATA
from tests.llm.conftest import prose

SF = f"{DATA}/sf0.001"
CLASHES = ("_doc", "_key", "_spans", "_row", "_leaked", "_salt", "score", "ids", "parity", "root", "counts", "lang_pred", "key", "sid", "shares")


@pytest.fixture(scope="module")
def clashing(edges):
    """The odd rows with a column of each name that operators use inside."""
    taken = {c.lower() for c in edges.columns}
    return edges.withColumns({c: F.lit("mine") for c in CLASHES if c.lower() not in taken})


def test_no_column_name_is_in_the_way(spark, clashing, edge_rows):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    own = [c for c in clashing.columns if c not in ("score", "lang_pred", "ids", "parity", "round_trip")]
    frames = {
        "keep_one": jaccard_join.keep_one(clashing), "drop_repeats": suffix_dedup.drop_repeats(clashing), "drop_leaks": decontamination.drop_leaks(clashing, bench),
        "identify": language_id.identify(clashing, clashing), "score": toxicity.score_texts(clashing, clashing, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")),
        "encode": sentencepiece_backend.encode_column(clashing, tokenizer_file("piece_bpe_32k.model")),
    }
    for name, frame in frames.items():
        rows = frame.collect()
        assert rows and set(own) <= set(frame.columns), name
        assert {r["_doc"] for r in rows} == {"mine"} == {r["_spans"] for r in rows}, name
    assert len(frames["score"].collect()) == len(edge_rows)


def test_shards_by_a_plain_permutation(spark, edges):
    """The same blocks, matrix and hashes, dealt out row by row."""
    seed, shards, blocks, cells = 5, 4, 6, 2
    rows = edges.select("doc_id", F.length("text").alias("n"))
    hashed = rows.select("doc_id", "n", *[F.xxhash64("doc_id", "n", F.lit(seed + i)).alias(f"h{i}") for i in range(3)]).collect()
    order = lambda h: lambda r: (r[h], r["doc_id"] is not None, r["doc_id"] or 0, r["n"] is not None, r["n"] or 0)
    own = [[r for r in hashed if r["h0"] % blocks == b] for b in range(blocks)]
    sizes = sharding.cell_sizes(len(hashed), shards, cells)
    matrix = sharding.communication_matrix(np.array([len(x) for x in own]), sizes.ravel(), seed)
    dealt = [[] for _ in range(shards * cells)]
    for b, block in enumerate(own):
        rest = sorted(block, key=order("h1"))
        for c, n in enumerate(matrix[b]):
            dealt[c] += rest[:n]
            rest = rest[n:]
        assert not rest
    want, slot = Counter(), [0] * shards
    for c, cell in enumerate(dealt):
        for r in sorted(cell, key=order("h2")):
            want[r["doc_id"], r["n"], c // cells, slot[c // cells]] += 1
            slot[c // cells] += 1
    got = sharding.shuffle_into_shards(rows, ["doc_id", "n"], shards=shards, seed=seed, blocks=blocks, cells_per_shard=cells).collect()
    # rows that agree in all keys are interchangeable
    assert Counter((r["doc_id"], r["n"], r["shard"], r["slot"]) for r in got) == want


def test_blocks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS", 3)
    monkeypatch.setattr(sharding, "FEWEST", 2)
    rows = spark.range(100).select(F.col("id").alias("doc_id"))
    got = sharding.shuffle_into_shards(rows, ["doc_id"], shards=3).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [33, 33, 34] and len({(r["shard"], r["slot"]) for r in got}) == 100


def test_scores_by_all_pairs():
    """The machine's score is the plain sum over all pairs of different terms."""
    import pyarrow as pa

    texts = ["you are a bad bad group", "", "nice words only here", "bad group"]
    docs = [toxicity.terms(pa.array([t]))[0] for t in texts for _ in range(10)]
    fm = toxicity.train(docs, np.array([1, 0, 0, 1], np.float32).repeat(10), factors=4, epochs=4, least=2, z=0.0)
    index, offsets = toxicity.terms(pa.array(texts))
    for i, got in enumerate(fm.score(index, offsets)):
        own = index[offsets[i] : offsets[i + 1]].tolist()
        total = fm.bias + sum(float(fm.weight[t]) for t in own)
        total += sum(float(fm.factor[a] @ fm.factor[b]) for k, a in enumerate(own) for b in own[:k])
        assert got == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-4)


def plain_language(text, training):
    """Language and score by greedy parses with substring tests."""
    def symbols(t):
        out = []
        for ch in t.lower():
            if ch.isalpha():
                out.append(ch)
            elif not out or out[-1] != " ":
                out.append(" ")
        return "".join(out)

    s = symbols(text or "")
    if not any(ch.isalpha() for ch in s):
        return "und", 0.0
    costs = []
    for name, parts in training:
        source = "\0".join([*map(symbols, parts), ""])
        phrases, at = 0, 0
        while at < len(s):
            n = 1
            while at + n < len(s) and s[at : at + n + 1] in source:
                n += 1
            at += n
            phrases += 1
        costs.append((phrases * math.log2(len(source) + 1), name))
    best, second = sorted(c for c, _ in costs)[:2]
    return min(costs, key=lambda c: c[0])[1], min(1.0, max(0.0, 1 - best / second))


def test_predictions_by_plain_parses(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["text"][:1500], r["lang"]) for r in docs.orderBy("doc_id").limit(60).collect() if r["text"]]
    training = {}
    for text, lang in rows[:24]:
        training.setdefault(lang, []).append(text[:120])
    training = tuple((k, tuple(v)) for k, v in sorted(training.items()) if k)
    parser = language_id.Parser(training)
    tests = [t for t, _ in rows] + [None, "", "12 !?", "é", "ß ß", "日本 語", "a" * 700, " - b - ", "word" * 300]
    for t, lang, score in zip(tests, *parser.classify(tests), strict=True):
        want, measure = plain_language(t, training)
        assert score == pytest.approx(measure), t
        assert lang == want or measure == 0, t


def test_training_pieces_are_spread_over_the_text(spark):
    text = "".join(f"{i:04d}" for i in range(1000))
    got = spark.createDataFrame([(text,), ("short",)], "t string").select(language_id.spans(F.col("t"), 40)).collect()
    assert got[0][0] == [text[:10], text[1330:1340], text[2660:2670], text[3990:]] and got[1][0] == ["short"]


def test_bounded_sample_keeps_the_smallest(spark):
    rows = spark.range(5000).select((F.col("id") % 7 > 0).cast("int").alias("y"), F.xxhash64("id").alias("h"))
    rows = rows.unionAll(rows.where("y = 1"))
    got = common.bounded_sample(rows, "y", "h", 50)
    for y in (0, 1):
        assert sorted(h for k, h in got if k == y) == sorted({r["h"] for r in rows.where(F.col("y") == y).collect()})[:50]
    assert common.bounded_sample(rows.where("y = 0").limit(9), "y", "h", 50).__len__() == 9
    assert common.bounded_sample(rows.limit(0), "y", "h", 5) == []


def test_skew_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST", 10)
    left = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(900)] + [(901, None)], "i int, k int")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(0, 900, 2)], "k int, v string")
    assert common.hot_keys(left, "k") == [0]
    for how in ("inner", "left"):
        want = Counter(tuple(r) for r in left.join(right, "k", how).collect())
        assert Counter(tuple(r) for r in common.skew_join(left, right, "k", how).collect()) == want


def test_pipeline_over_odd_rows(spark, edges, nothing):
    """Every stage takes nulls, empty texts, repeated rows and ids, and an empty table."""
    import corpus_pipeline

    for docs in (edges, nothing):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = common.staged(stage(spark, docs, SF), f"odd-{name}")
            assert out.count() <= n, name
            if name != "sentencepiece":
                assert out.columns == edges.columns, name
            docs, n = out, out.count()
        if n:
            assert {r["parity"] for r in docs.collect()} <= {True, False}


def test_pipeline_keeps_one_copy_of_a_repeated_text(spark):
    """A text that is held five times, two of them as one repeated row, is there once at the
    end, whole; passages of clean texts that share nothing stay as they are."""
    import corpus_pipeline

    rng = random.Random(41)
    base = spark.read.parquet(f"{SF}/documents.parquet")
    words = [w for r in base.where("lang IS NOT NULL AND length(text) > 500").limit(40).collect() for w in r["text"].split()]
    text = " ".join(rng.choice(words) for _ in range(150))
    clean = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(6)]
    rows = [(10**6, text), (10**6, text), (10**6 + 1, text), (10**6 + 2, text), (10**6 + 3, "".join(ch.upper() if ch.isascii() else ch for ch in text)), *((10**6 + 10 + i, t) for i, t in enumerate(clean))]
    docs = base.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = common.staged(stage(spark, docs, SF), f"copies-{name}")
    got = {r["doc_id"]: r["text"] for r in docs.where("doc_id >= 1000000").collect()}
    assert got == {10**6: text} | {10**6 + 10 + i: t for i, t in enumerate(clean)}
    assert docs.where("doc_id = 1000000").count() == 1


def sharing_by_force(rows, n):
    """Places of the rows that hold n words in a row which another row holds as well."""
    words = [(t or "").split() for _, t in rows]
    met = {}
    for i, w in enumerate(words):
        for a in range(len(w) - n + 1):
            met.setdefault(tuple(w[a : a + n]), set()).add(i)
    return {i for held in met.values() if len(held) > 1 for i in held}


def test_shared_passages_against_all_windows(spark):
    """Every passage of 50 words is reported, none of fewer than 40, copies among them."""
    rng = random.Random(19)
    rows = [(i, prose(rng, rng.randrange(10, 260))) for i in range(60)]
    for n in (20, 39, 41, 50, 51, 75, 140):
        passage = prose(rng, n)
        for _ in range(2):
            i = rng.randrange(60)
            w = rows[i][1].split()
            at = rng.randrange(len(w))
            rows[i] = (i, " ".join([*w[:at], passage, *w[at:]]))
    rows += [(100, prose(rng, 60)), (101, prose(rng, 30)), (102, None), (103, "")]
    rows += [(200, rows[-4][1]), (201, rows[-3][1]), (202, None), (None, rows[0][1])]
    got = suffix_dedup.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    told = {(r["doc_id"], r["shares_passage"]) for r in got}
    must, may = ({rows[i][0] for i in sharing_by_force(rows, n)} for n in (50, 40))
    said = {d for d, shares in told if shares}
    assert must <= said <= may and len(got) == len(rows)
    assert {100, 200} <= said and not {101, 201, 102, 202, 103} & said
