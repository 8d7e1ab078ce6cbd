"""Whitening, spelling variants and exact copies against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamlog.llm import common, decontamination, embedding_dedup, exact_dedup, jaccard_join, queries, spelling, suffix_dedup, toxicity, whitening
from tests.conftest import DATA


# ---- exact copies ----

def plain_copies(rows):
    """(doc_id, text) pairs -> sorted contract rows, kept once a class."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, least, len(ids), i == least and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and i != least
    return sorted(out, key=str)


def test_copies_of_odd_rows(edges, edge_rows):
    got = sorted((tuple(r) for r in exact_dedup.exact_copies(edges).collect()), key=str)
    assert got == plain_copies([(r[0], r[1]) for r in edge_rows])


def test_copies_over_many_runs(spark):
    """Five rounds of two runs each, a text that is a third of the rows, copies in all runs."""
    rng = random.Random(3)
    rows = [(i, "hot  text" if i % 3 == 0 else f"t {rng.randrange(400)}\t\n{'x' * rng.randrange(3)}" if i % 3 == 1 else f"own {i}") for i in range(3000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(37)
    for bits in (1, 2, 4):
        exact_dedup.BITS, before = bits, exact_dedup.BITS
        try:
            got = sorted((tuple(r) for r in exact_dedup.exact_copies(frame).collect()), key=str)
        finally:
            exact_dedup.BITS = before
        assert got == plain_copies(rows)


def test_entries_that_share_a_digest_stay_apart(spark):
    rows = [(r, 7, bytes([sha]), 1, (False, i, i), n) for r, sha, i, n in [(0, 1, 5, 2), (1, 1, 3, 1), (0, 2, 4, 1), (2, 1, 9, 4), (17, 1, 1, 1)]]
    entries = spark.createDataFrame(rows, "run int, digest long, sha binary, n_bytes long, first struct<none:boolean,id:long,uid:long>, size long")
    got = {(r["run"], bytes(r["sha"])): (r["first"]["id"], r["size"]) for r in exact_dedup.merge_round(entries, 1).collect()}
    assert got == {(0, b"\x01"): (3, 7), (0, b"\x02"): (4, 1), (1, b"\x01"): (1, 1)}


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact_dedup.merge_round(
        exact_dedup.digest_rows(docs, "doc_id", "text").groupBy("run", *exact_dedup.ENTRY).agg(F.min(F.struct(F.lit(False).alias("none"), "id", "uid")).alias("first"), F.count("*").alias("size")), 1
    )._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_drop_copies_keeps_all_columns_and_one_row(edges, edge_rows):
    rest = exact_dedup.drop_copies(edges)
    assert rest.columns == edges.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in rest.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in edge_rows})


def test_no_rows(nothing, spark):
    assert exact_dedup.exact_copies(nothing).count() == 0
    assert spelling.document_variants(nothing).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert whitening.whitened_components(empty).count() == 0


# ---- spelling variants ----

def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = plain_words(rows)
    words = sorted(counts)
    near = defaultdict(list)
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for w in words:
        near[w] = [v for n in (len(w) - 1, len(w), len(w) + 1) for v in by_length[n] if one_edit(w, v)]
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def variants(frame):
    return sorted((tuple(r) for r in spelling.document_variants(frame).collect()), key=lambda r: r[0])


def dense_texts(seed, n, alphabet="abé", longest=8):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(4, longest))) for _ in range(200))) for i in range(n)]


@pytest.mark.parametrize("crowded", [8, 512])
def test_variants_of_dense_words(spark, monkeypatch, crowded):
    """Words over three letters: nearly all have neighbours; segments of all depths are crowded."""
    monkeypatch.setattr(spelling, "CROWDED", crowded)
    rows = dense_texts(1, 12)
    assert variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == plain_variants(rows)


def test_variants_of_odd_rows(edges, edge_rows):
    assert variants(edges) == plain_variants([(r[0], r[1]) for r in edge_rows])


def test_variants_of_the_given_documents(spark):
    docs = common.table(spark, f"{DATA}/sf0.001", "documents")
    got = sorted((tuple(r) for r in queries.op12_spelling_variants(spark, f"{DATA}/sf0.001").collect()), key=lambda r: r[0])
    assert got == plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_letters_of_a_run(spark):
    rows = [(1, "ÀÉcole×÷ÿ ĀbcdefĀ naïveté\x85naïveté\xa0naïveté STRASSE straße strasse Straße STRASSE"), (2, "x" * 50_000 + " " + "x" * 50_001), (2, "x" * 50_000), (3, "x" * 50_000 + " " + "x" * 50_001), (4, "x" * 50_001)]
    assert variants(spark.createDataFrame(rows, "doc_id long, text string")) == plain_variants(rows)


def test_long_chains_reach_their_root(spark):
    """Counts double along a chain of words, each one letter longer than the last."""
    words = [("abcdefghijklmnop"[: 5 + k], 3 * 2**k) for k in range(9)]
    frame = spark.createDataFrame(words, "word string, n long")
    got = {r["word"]: r["root"] for r in spelling.with_roots(spelling.forms(frame, spelling.one_edit_pairs(frame))).collect()}
    assert set(got.values()) == {words[-1][0]} and len(got) == 9


# ---- whitening ----

def plain_fit(vectors):
    usable = [(i, v) for i, v in vectors if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in usable]
    listed = sorted(set(v for _, v in x))
    a = np.array(listed, np.int64)
    n, sums = len(a), a.sum(axis=0)
    centred = (n * a - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], axes[:, ::-1]


def random_vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.linspace(3, 0.2, d)
    return [(i, [float(c) for c in v]) for i, v in enumerate(base.astype(np.float32))]


def check_against_plain(frame, rows):
    x, n, sums, values, axes = plain_fit(rows)
    k = min(16, len(sums))
    got = whitening.whitened_components(frame).collect()
    assert len(got) == k * len(x)
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"], r["component"]].append(r)
    signs = {}
    for i, v in x:
        z = (n * np.array(v) - sums) / n
        deviation = sum((n * c - int(s)) ** 2 for c, s in zip(v, sums, strict=True))
        for c in range(1, k + 1):
            r = by[i, c][0]
            assert (r["n"], r["deviation"]) == (n, deviation)
            want = float(z @ axes[:, c - 1]) / math.sqrt(values[c - 1])
            signs.setdefault(c, math.copysign(1, want * r["whitened"]))
            assert abs(r["whitened"] * signs[c] - want) < 1e-6
            assert abs(r["explained"] - values[c - 1] / values.sum()) < 1e-9
            assert r["identity_error"] < 1e-10


def test_whitening_of_random_vectors(spark):
    rows = random_vectors(400, 20, 1) + [(1000 + i, v) for i, v in random_vectors(60, 20, 1)]
    odd = [(2000, None), (2001, [float("nan")] + [0.0] * 19), (2002, [float("inf")] + [0.0] * 19), (2003, [None] + [0.0] * 19), (2004, [])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(40)
    check_against_plain(frame, rows + odd)


def test_whitening_of_the_given_embeddings(spark):
    frame = common.table(spark, f"{DATA}/sf0.001", "embeddings")
    check_against_plain(frame, [(r["vec_id"], r["embedding"]) for r in frame.collect()])


def test_moments_merge_as_one_walk():
    x = np.random.default_rng(2).normal(size=(300, 6)) + 1e3
    whole = whitening.Moments.none(6)
    whole.update(x)
    parts = whitening.Moments.none(6)
    for piece in np.split(x, [1, 40, 41, 200]):
        m = whitening.Moments.none(6)
        m.update(piece)
        parts = parts.merge(m)
    assert parts.n == whole.n == 300
    assert np.allclose(parts.covariance(), np.cov(x.T, bias=True), atol=1e-9) and np.allclose(whole.covariance(), parts.covariance(), atol=1e-9)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_eigen_solve(d):
    rng = np.random.default_rng(d)
    for a in (rng.normal(size=(d, d)), np.diag(rng.integers(0, 3, d)).astype(float), np.ones((d, d)), np.zeros((d, d))):
        a = (a + a.T) / 2
        values, axes = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-11 * max(1, d))
        assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-12 * max(8, d)) and np.allclose(a @ axes, axes * values, atol=1e-11 * max(1, d))


def test_flat_directions_and_lengths(spark):
    """Fewer vectors than dimensions, one vector alone, another length, repeats, clashing columns."""
    rows = [(1, [1.0, 2.0, 3.0], "a"), (1, [1.0, 2.0, 3.0], "a"), (None, [1.5, 2.0, 3.0], None), (3, [1.0, 2.0], "b"), (4, [1e30, 0.0, 0.0], "b"), (5, [2.0**40, 0.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    got = whitening.whitened_components(frame).collect()
    assert len(got) == 3 * 3 + 2 * 2
    three = [r for r in got if r["n"] == 2 and r["component"] == 1 and r["vec_id"] != 3 and r["vec_id"] != 5]
    assert sorted(abs(round(r["whitened"], 9)) for r in three) == [1.0, 1.0, 1.0] and all(r["explained"] == 1.0 for r in three)
    assert all(r["whitened"] is None for r in got if r["component"] > 1)
    wide = [r for r in got if r["vec_id"] == 5]
    assert {r["deviation"] for r in wide} == {None}  # more than a long holds
    kept = whitening.whiten(frame).collect()
    assert len(kept) == 5 and all(len(r["whitened"]) in (2, 3) for r in kept)


# ---- mended: what is held out, and salts ----

def test_labels_held_out_change_no_score(spark):
    """All held-out labels flipped, or gone: every score of the given documents stays."""
    docs, labels = common.table(spark, f"{DATA}/sf0.01", "documents"), common.table(spark, f"{DATA}/sf0.01", "labels")
    out = toxicity.held_out(F.col("doc_id"), 3, 1)
    first = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score_documents(docs, labels).collect()}
    for other in (labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic"))), labels.where(~out)):
        assert {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score_documents(docs, other).collect()} == first


def test_salts_follow_from_the_row(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(3000)]
    left, right = spark.createDataFrame(rows, "i long, k string"), spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    joined = common.skew_join(left, right, "k", "left", ["hot"])
    assert "monotonically" not in joined._jdf.queryExecution().analyzed().toString()
    assert sorted((r["i"], r["v"]) for r in joined.collect()) == sorted((i, 1 if k == "hot" else 2 if k == "k3" else None) for i, k in rows)


def test_every_allowed_replacement_is_found(spark):
    """All sets of tokens that may be replaced, in items of 1 to 13 tokens."""
    items, docs = [], []
    for n in range(1, 14):
        words = [f"item{n}word{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for gone in itertools.combinations(range(n), n - math.ceil(n * 0.8)):
            docs.append((1000 * n + len(docs), n, "before it " + " ".join("other" if k in gone else w for k, w in enumerate(words)) + " after it"))
    frame = spark.createDataFrame([(d, t) for d, _, t in docs], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, n) for d, n, _ in docs}
    over = [(9000 + n, f"{' '.join(w for k, w in enumerate(t.split()) if k >= n - math.ceil(n * 0.8) + 1)}") for n, t in items if n > 1]
    assert decontamination.find_leaks(spark.createDataFrame(over, "doc_id long, text string"), spark.createDataFrame(items[1:], "item_id long, text string")).where("doc_id % 1000 = item_id").count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", [256, 512, 1024, 2048, 65536])
def test_words_that_polynomials_mix_up(spark, size):
    word = thue_morse(size)
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " and some more words here"
    docs = spark.createDataFrame([(1, word), (2, other), (3, word + tail), (4, other + tail), (5, word)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_documents(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_pivots_part_every_label(spark):
    """The given vectors have several cells a label and vectors that stand in more than one."""
    frame = common.table(spark, f"{DATA}/sf0.1", "embeddings")
    rows = embedding_dedup.prepared(frame).where("grp IS NOT NULL")
    cells = common.staged(embedding_dedup.into_cells(rows.withColumn("home", F.lit(True)), embedding_dedup.choose_pivots(rows), math.sqrt(0.04) + 1e-7), "cells")
    per = cells.groupBy(F.substring_index("cell", "/", 2).alias("grp")).agg(F.count_distinct("cell").alias("n"), F.count_if(~F.col("home")).alias("copies"), F.count_if("home").alias("own")).collect()
    assert len(per) == 10 and all(r["n"] >= 4 and r["copies"] > 0 for r in per) and sum(r["own"] for r in per) == 2000


def test_large_cells_are_parted_again(spark, monkeypatch):
    """Clusters in clusters; cells beyond the limit get pivots of their own, results stay exact."""
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.02 * rng.normal(size=(30, 12)) + 0.1 * rng.normal(size=(1, 12)) for c in np.repeat(rng.normal(size=(6, 12)), 6, axis=0)])
    frame = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.98
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link_vectors(frame).collect()}
    root = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(x))]
        if new == root:
            break
        root = new
    assert got == {i: (int(linked[i].sum()), root[i]) for i in range(len(x))}
    deep = embedding_dedup.split(embedding_dedup.prepared(frame), math.sqrt(0.04) + 1e-7)
    assert deep.where(F.size(F.split("cell", "/")) > 3).count() > 0


# ---- repeated passages of which one copy stays ----

def first_copies_by_force(rows, window):
    """Window starts, per (doc_id, text), whose window stands at an earlier place."""
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, out = set(), {}
    for i, t in order:
        data, gone = t.encode(), []
        for at in range(len(data) - window + 1):
            w = data[at : at + window]
            if w in seen:
                gone.append(at)
            seen.add(w)
        out[i, t] = gone
    return out


def cut_by_force(text, gone, window):
    data = text.encode()
    dead = [False] * len(data)
    for at in gone:
        dead[at : at + window] = [True] * window
    blank = [c in b" \t\n\v\f\r" for c in data]
    i = 0
    while i < len(data):  # words that are cut in part stay whole
        if blank[i]:
            i += 1
            continue
        j = i
        while j < len(data) and not blank[j]:
            j += 1
        if not all(dead[i:j]):
            dead[i:j] = [False] * (j - i)
        i = j
    return bytes(32 if d else c for c, d in zip(data, dead, strict=True)).decode()


@pytest.mark.parametrize("kinds", [4096, 1])
def test_one_copy_of_a_passage_stays(spark, monkeypatch, kinds):
    monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
    rng = random.Random(11)
    words = [a + b for a in ("ba", "ké", "lo", "mu", "nä") for b in ("da", "fe", "gi", "lo", "st")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [say(40), say(60), say(30) + "\n" + say(20)]
    rows = [(i, f"{say(rng.randrange(5, 30))} {rng.choice(passages)}{rng.choice(['', 'tail'])} {say(rng.randrange(3, 20))}") for i in range(24)]
    rows += [(50, passages[0]), (51, passages[0]), (52, "x" * 300), (53, "x" * 301), (54, None), (55, ""), (56, "ab " * 200), (57, f"{passages[1]} {passages[1]}")]
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 104, keep_first=True).collect()}
    gone = first_copies_by_force(rows, 104)
    for i, t in rows:
        want = cut_by_force(t or "", gone[i, t or ""], 104)
        if not gone[i, t or ""]:
            assert got[i] == t
        elif not want.strip():
            assert i not in got
        else:
            assert got[i].split() == want.split()
    text = "\n".join(t for t in got.values() if t)
    for p in passages:  # of a passage one copy is left, but for words at the ends of its copies
        assert sum(" ".join(p.split()[2:-2]) in " ".join(t.split()) for t in got.values() if t) == 1
    assert set(text.split()) <= {w for _, t in rows for w in (t or "").split()}


def test_transforms_of_several_shards_are_merged(spark, monkeypatch):
    calls = []
    real = suffix_dedup.merge_transforms
    monkeypatch.setattr(suffix_dedup, "merge_transforms", lambda t, c, d: calls.append(len(t)) or real(t, c, d))
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(90))
    data = [(" ".join(word() for _ in range(20)) + passage + " ".join(word() for _ in range(20))).encode() for _ in range(40)]
    parts = suffix_dedup.extents(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 400)
    owner, start, count, anchor, extent = parts
    for a in np.unique(anchor):
        at = np.flatnonzero(anchor == a)
        if len(at) > 8:
            blobs = [b"".join(data)[s : s + n + 399] for s, n in zip(start[at].tolist(), count[at].tolist(), strict=True)]
            suffix_dedup.repeated_starts(blobs, count[at].astype(np.int64), anchor[at].view(np.int64), np.ones(len(at), np.int64))
    assert calls and min(calls) >= 4
