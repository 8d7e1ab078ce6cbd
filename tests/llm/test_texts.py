"""Operators over documents against brute force, on rows of every odd kind."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamlog.llm import common, decontamination, jaccard_join, language_id, sharding, suffix_dedup, toxicity
from tests.conftest import DATA
from tests.llm.conftest import SCHEMA, prose

SF = f"{DATA}/sf0.001"


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def linked_by_force(rows):
    """Sorted (doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    union = Union()
    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                union.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        root = union.find(i)
        if d is not None:
            least[root] = min(d, least.get(root, d))
    return sorted(((d, len(sets[i]), least.get(union.find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def link(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_documents(df).collect()), key=str)


def test_jaccard_join_on_odd_rows(edges, edge_rows):
    assert link(edges) == linked_by_force([r[:2] for r in edge_rows])


def test_jaccard_join_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert link(docs) == linked_by_force([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_jaccard_join_of_a_chain_and_a_cluster(spark):
    """Variants at all distances, in one large group that shares most shingles."""
    rng = random.Random(2)
    base = prose(rng, 120).split()
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"w{i}{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    walk = list(base)
    for i in range(40):
        walk[(3 * i) % len(walk)] = f"v{i}"
        rows.append((1000 + i, " ".join(walk)))
    assert link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == linked_by_force(rows)


def test_jaccard_join_of_large_regions(spark, edges, edge_rows, monkeypatch):
    """Regions of more than a few sets, as if they were too large for a task."""
    rng = random.Random(21)
    rows = [r[:2] for r in edge_rows]
    for g, size in enumerate((60, 25, 6)):
        base = prose(rng, 80 + 30 * g).split()
        for i in range(size):
            words = list(base)
            for at in rng.sample(range(len(words)), i % 5):
                words[at] = f"w{rng.randrange(9)}"
            rows.append((1000 * (g + 1) + i, " ".join(words[: len(words) - i % 7])))
    for members, block in ((1, 7), (10, 4096)):
        monkeypatch.setattr(jaccard_join, "MEMBERS", members)
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        assert link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == linked_by_force(rows)


def test_jaccard_threshold_is_exact(spark):
    """Sets that share exactly four fifths link; one shingle less and they do not."""
    shared = [f"s{i}" for i in range(12)]  # 8 shingles
    rows = [(1, " ".join([*shared, "a"])), (2, " ".join([*shared, "b"])), (3, " ".join([*shared, "c", "d"]))]
    assert link(spark.createDataFrame(rows, "doc_id long, text string")) == linked_by_force(rows) == [(1, 9, 1), (2, 9, 1), (3, 10, 3)]


def test_jaccard_join_of_nothing(nothing):
    assert link(nothing) == []


def test_keep_one_keeps_columns(edges, edge_rows):
    kept = jaccard_join.keep_one(edges)
    assert kept.columns == edges.columns
    want = {d for d, _, c in linked_by_force([r[:2] for r in edge_rows]) if d == c}
    assert {r["doc_id"] for r in kept.collect()} == want


def removed_by_force(rows):
    data = [(t or "").encode() for _, t in rows]
    counts = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if counts[b[i : i + 400]] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        mask = np.cumsum(gone[:-1]) > 0 if b else np.zeros(0, bool)
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((d, len(b), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted((tuple(r) for r in suffix_dedup.dedup_digests(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_suffix_dedup_on_odd_rows(edges, edge_rows):
    assert digests(edges) == removed_by_force([r[:2] for r in edge_rows])


def test_suffix_dedup_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert digests(docs) == removed_by_force([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_suffix_dedup_with_anchors_of_many_extents(spark, edges, edge_rows, monkeypatch):
    """All anchors, and only some, as if they were too large for a task."""
    rng = random.Random(8)
    line = prose(rng, 50)[:200]
    rows = [(i, prose(rng, 70) + " " + line + " " + prose(rng, 60 + i % 3)) for i in range(40)]
    rows += [(100 + i, t[i * 3 : i * 3 + 500]) for i, (_, t) in enumerate(rows[:12])] + [r[:2] for r in edge_rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for kinds in (1, 8):
        monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
        assert digests(docs) == removed_by_force(rows)


def test_suffix_dedup_of_nothing(nothing):
    assert digests(nothing) == []


@pytest.mark.parametrize("shard", [60, 500, 200_000])
def test_merged_transforms_find_repeated_windows(shard):
    """Extents that share parts of their windows, split over one shard or many."""
    rng = random.Random(shard)
    common = bytes(rng.randrange(97, 101) for _ in range(900))
    texts = [common[a : a + 700] + bytes(rng.randrange(97, 123) for _ in range(300)) for a in range(0, 200, 7)]
    texts += [bytes(rng.randrange(97, 123) for _ in range(150)) + common[b : b + 500] for b in range(0, 300, 11)]
    found, kept = [], []
    for t in texts:
        raw = np.frombuffer(t, np.uint8)
        owner, start, count, anchor, _ = suffix_dedup.extents(raw, np.array([0, len(raw)]))
        for s, n, a in zip(start.tolist(), count.tolist(), anchor.view(np.int64).tolist(), strict=True):
            found.append((t[s : s + n + 399], n, a))
            kept.append(t)
    unique = sorted(set(found))
    copies = Counter(found)
    flags = suffix_dedup.repeated_starts([x[0] for x in unique], np.array([x[1] for x in unique]), np.array([x[2] for x in unique]), np.array([copies[x] for x in unique]), shard)
    counts = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for (data, n, _), f in zip(unique, flags, strict=True):
        assert f.tolist() == [i for i in range(n) if counts[data[i : i + 400]] > 1]


def test_merging_sorts_all_suffixes():
    """The interleaving of shard transforms equals a sort of all suffixes, and so do prefixes."""
    rng = np.random.default_rng(1)
    strings = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(24)]
    shards = [strings[:9], strings[9:16], strings[16:]]
    transforms, closings, sorted_suffixes = [], [], []
    for shard in shards:
        symbols = np.concatenate([np.append(s, 0) for s in shard])
        string = np.repeat(np.arange(len(shard)), [len(s) + 1 for s in shard])
        order, before = suffix_dedup.shard_transform(symbols, string)
        transforms.append(before)
        closings.append(len(shard))
        suffixes = []
        for i in order:
            stop = i + int(np.argmax(symbols[i:] == 0))
            suffixes.append(symbols[i:stop].tolist())
        sorted_suffixes.append(suffixes)
    source, prefix = suffix_dedup.merge_transforms(transforms, closings, 40)
    at = [0] * len(shards)
    merged = []
    for s in source:
        merged.append(sorted_suffixes[s][at[s]])
        at[s] += 1
    assert merged == sorted(merged)
    for a, b, k in zip(merged, merged[1:], prefix[1:], strict=False):
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert k == same


def test_drop_repeats_keeps_columns_and_clean_texts(edges, edge_rows):
    out = suffix_dedup.drop_repeats(edges)
    assert out.columns == edges.columns
    left = Counter((r["doc_id"], r["text"]) for r in out.collect())
    clean = {(d, t) for d, t in (r[:2] for r in edge_rows) if not t or len(t.encode()) < 400}
    assert all(left[x] for x in clean)
    assert all(left[d, t] for d, t in (r[:2] for r in edge_rows) if t and len(t) > 20_000)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(9)
    shared = prose(rng, 200)
    rows = [(1, prose(rng, 3000) + shared + prose(rng, 2000)), (2, prose(rng, 500) + shared), (3, shared[:700] + prose(rng, 10))]
    raw = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    import pyarrow as pa

    for row, at, piece in suffix_dedup.pieces(pa.array([t for _, t in rows])):
        assert piece.tobytes() == raw[row][at : at + 1399].tobytes()
    assert digests(spark.createDataFrame(rows, "doc_id long, text string")) == removed_by_force(rows)


def test_shards_are_exact_and_gapless(edges, edge_rows):
    rows = sharding.shard_documents(edges).collect()
    assert len(rows) == len(edge_rows)
    sizes = Counter(r["shard"] for r in rows)
    assert all(len(edge_rows) // 24 <= sizes[s] <= -(-len(edge_rows) // 24) for s in range(24))
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in (r[:2] for r in edge_rows))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def test_shards_of_nothing(nothing):
    assert sharding.shard_documents(nothing).count() == 0


def test_communication_matrix_has_exact_margins_and_the_right_law():
    blocks, cells = np.array([5, 0, 17, 100]), sharding.cell_sizes(122, 4, 3).ravel()
    assert cells.sum() == 122 and cells.reshape(4, 3).sum(axis=1).ptp() <= 1 if hasattr(cells, "ptp") else True
    total = np.zeros((4, 12))
    for seed in range(400):
        m = sharding.communication_matrix(blocks, cells, seed)
        assert (m.sum(axis=1) == blocks).all() and (m.sum(axis=0) == cells).all()
        total += m
    assert np.abs(total / 400 - np.outer(blocks, cells) / 122).max() < 1


def test_shuffle_is_uniform(spark):
    """Over seeds each row meets each shard equally often."""
    rows = spark.range(96).select(F.col("id").alias("doc_id"))
    met = Counter()
    for seed in range(12):
        for r in sharding.shuffle_into_shards(rows, ["doc_id"], shards=4, seed=seed, blocks=8, cells_per_shard=2).collect():
            met[r["doc_id"] % 4, r["shard"]] += 1
    assert all(40 <= met[a, s] <= 104 for a in range(4) for s in range(4))


def test_planted_passages_are_found_and_clean_documents_stay(spark, edges):
    rng = random.Random(3)
    items = [(i, prose(rng, n, [f"q{k}x" for k in range(300)])) for i, n in enumerate((14, 20, 40, 60, 6, 3))] + [(6, None), (7, ""), (None, prose(rng, 20))]
    clean = [(100 + i, prose(rng, 400)) for i in range(20)]
    dirty = []
    for i in range(4):
        words = items[i][1].split()
        dirty.append((200 + i, prose(rng, 50) + " " + " ".join(words) + " " + prose(rng, 50)))
        for k in range(5, len(words), 8):  # every eighth word replaced
            words[k] = "other"
        dirty.append((300 + i, prose(rng, 50) + "\n" + " ".join(words).upper()))
    dirty.append((204, "start " + items[4][1] + " end"))
    docs = spark.createDataFrame([*clean, *dirty, (400, None), (401, ""), (None, items[2][1])], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontamination.flag_documents(docs, bench).collect()}
    assert {d for d, r in rows.items() if r["leaked"]} == {d for d, _ in dirty} | {None}
    assert {r["doc_id"] for r in decontamination.drop_leaks(docs, bench).collect()} == {d for d, _ in clean} | {400, 401}
    assert decontamination.flag_documents(edges, bench).where("leaked").count() == 0
    assert decontamination.drop_leaks(edges, bench).columns == edges.columns


def test_leaks_of_null_and_repeated_ids_are_found(spark):
    rng = random.Random(31)
    a, b, c, d = (prose(rng, 20, [f"{x}{k}x" for k in range(300)]) for x in "qrst")
    bench = spark.createDataFrame([(None, a), (1, b), (1, c), (2, d), (2, d)], "item_id long, text string")
    rows = [(10, f"see {a} end"), (11, f"see {b} end"), (12, f"see {c} end"), (13, f"{b} {c}"), (None, d), (None, prose(rng, 80)), (None, None), (14, prose(rng, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["leaked"], r["n_items"]) for r in decontamination.flag_documents(docs, bench).collect())
    assert got == Counter([(10, True, 1), (11, True, 1), (12, True, 1), (13, True, 1), (None, True, 1), (None, False, 0), (None, False, 0), (14, False, 0)])
    assert Counter(tuple(r) for r in decontamination.drop_leaks(docs, bench).collect()) == Counter(rows[5:])


def leaked_by_force(text, items):
    """Items of which some window of 13 tokens (all of a shorter item) agrees in 80 of 100 places
    with a window of the text."""
    words = lambda t: [w.lower() for w in re.findall(r"[A-Za-z0-9\x80-\uffff]+", t or "")]
    a, out = words(text), set()
    for i, t in items:
        b = words(t)
        width = min(13, len(b))
        for x in range(len(a) - width + 1):
            for y in range(len(b) - width + 1):
                same = [a[x + k] == b[y + k] for k in range(width)]
                if width and sum(same) >= -(-width * 4 // 5):
                    out.add(i)
    return out


def test_leaks_against_all_windows(spark):
    """Random texts over few words, items of all lengths: every window pair is compared."""
    rng = random.Random(77)
    few = [f"w{k}" for k in range(40)]
    items = [(i, prose(rng, n, few)) for i, n in enumerate((1, 2, 3, 4, 5, 7, 12, 13, 14, 25, 40))] + [(50, None), (51, "!?")]
    docs = []
    for d in range(60):
        words = prose(rng, 60, few).split()
        if d % 2:
            source = items[rng.randrange(3, 11)][1].split()
            for k in range(len(source)):
                if rng.random() < 0.15:
                    source[k] = rng.choice(few)
            words[20:20] = source
        docs.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = defaultdict(set)
    for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect():
        got[r["doc_id"]].add(r["item_id"])
    assert {d: got.get(d, set()) for d, _ in docs} == {d: leaked_by_force(t, items) for d, t in docs}


def test_decontamination_of_nothing(spark, nothing, edges):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.flag_documents(nothing, none).count() == 0
    assert decontamination.flag_documents(edges, none).where("leaked").count() == 0


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = language_id.identify_documents(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"]))
    own = [r for r in rows if r["held_out"] and r["lang_pred"] != "und" and len(r["text"]) > 100]
    assert sum(r["lang"] == r["lang_pred"] for r in own) / len(own) > 0.98


def test_automaton_counts_longest_phrases():
    parser = language_id.Parser((("a", ("abracadabra",)),))

    def greedy(text, source="abracadabra"):
        phrases, at = 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and text[at : at + n + 1] in source:
                n += 1
            at += n
            phrases += 1
        return phrases

    texts = ["abra", "cadcad", "zzz", "dabarac", "b", "racabra" * 20]
    ends, sizes, letters, _ = parser.count(texts)
    assert (ends[:, 0] + 1).tolist() == [greedy(t) for t in texts] and sizes.tolist() == [len(t) for t in texts]


def test_phrases_go_on_over_lanes_and_parts(monkeypatch):
    """Whole texts of many lanes and parts have the phrases of one greedy pass."""
    rng = random.Random(8)
    source = re.sub(" +", " ", "".join(rng.choice("abc ") for _ in range(900)))
    parser = language_id.Parser((("a", (source,)),))
    texts = ["".join(rng.choice("abcc ") for _ in range(n)).replace("  ", " ") for n in (1, 255, 256, 257, 3000, 9000)] + [source, source[100:] * 3, "abc " * 500]

    def greedy(text):
        phrases, at = 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and text[at : at + n + 1] in source:
                n += 1
            at += n
            phrases += 1
        return phrases

    texts = [re.sub(" +", " ", t) for t in texts]
    want = [greedy(t) - 1 for t in texts]
    assert parser.count(texts)[0][:, 0].tolist() == want
    for piece in (10, 700):
        monkeypatch.setattr(language_id, "PIECE", piece)
        broken = [(b or 0) * s for b, s in zip(parser.parse(texts)[2], map(len, texts), strict=True)]
        assert np.allclose(broken, want)


def test_languages_of_many_letters():
    """Two scripts of some 900 letters that share their 100 commonest are told apart."""
    rng = random.Random(12)
    common, rest = [chr(0x4E00 + i) for i in range(100)], [[chr(0x5000 + 800 * k + i) for i in range(800)] for k in range(2)]
    text = lambda k, n: "".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rest[k]) for _ in range(n))
    parser = language_id.Parser(tuple((f"l{k}", tuple(text(k, 800) for _ in range(30))) for k in range(2)))
    tests = [(k, text(k, 120)) for k in (0, 1) for _ in range(50)]
    found = parser.classify([t for _, t in tests])[0]
    assert sum(f == f"l{k}" for f, (k, _) in zip(found, tests, strict=True)) > 90


def test_languages_of_odd_rows(edges, edge_rows, nothing):
    out = language_id.identify(edges, edges)
    assert set(out.columns) == {*edges.columns, "lang_pred"} and out.count() == len(edge_rows)
    und = {r["text"] for r in out.collect() if r["lang_pred"] == "und"}
    assert und == {t for t in (r[1] for r in edge_rows) if not any(c.isalpha() for c in t or "")}
    assert language_id.identify(nothing, nothing).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(edges, nothing).collect()} == {"und"}


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(8)
    bad = ["vileword", "nastyterm", "foulname"]
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, 60).split()
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(60)] = rng.choice(bad)
            words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, spark.createDataFrame([*labels, (None, 1), (7000, None)], "doc_id long, toxic int")).collect()}
    assert len(out) == 902 and all(0 <= r["score"] <= 1 for r in out.values())
    own = [out[i] for i in range(900) if out[i]["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in own) / len(own) > 0.97
    assert out[5000]["predicted"] == out[5001]["predicted"] == 0


def test_pairs_are_learned_that_single_terms_do_not_show():
    """Toxic if and only if both terms of a pair occur."""
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        docs.append(np.array(sorted({*(10 + rng.integers(0, 50, 4)).tolist(), *([1] if a else []), *([2] if b else [])})))
        labels.append(float(a and b))
    fm = toxicity.train(docs[:2000], np.array(labels[:2000], np.float32))
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs[2000:]])])
    guess = fm.score(np.concatenate(docs[2000:]), offsets) > 0.5
    assert (guess == np.array(labels[2000:], bool)).mean() > 0.97
    assert float(fm.factor[1] @ fm.factor[2]) > 0


def test_toxicity_without_labels(spark, edges, edge_rows, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_documents(edges, none).collect()
    assert len(rows) == len(edge_rows) and {r["score"] for r in rows} == {0.5}
    assert toxicity.score_documents(nothing, none).count() == 0


def test_components_of_stars_and_chains(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in range(1, 400)) and all(got[1001 + i] == 1000 for i in range(60))
    assert SCHEMA


def test_large_regions_are_counted_exactly_among_frequent_shingles(spark):
    """Shingle 1 stands in all of 6,000 prefixes, 2 in 4,097, 3 in 4,096, the others in one."""
    rows = [(i, i * 7, [1, *([2] if i < 4097 else []), *([3] if i >= 6000 - 4096 else []), 10_000 + i]) for i in range(6000)]
    held = spark.createDataFrame(rows, "doc_id long, text_key long, prefix array<long>")
    shingles = held.select(F.explode("prefix").alias("shingle"), F.col("doc_id").alias("sid"))
    assert sorted(r[0] for r in jaccard_join.large_shingles(held, shingles).collect()) == [1, 2]
