"""Retrieval over chunks and documents: candidates, scores, ranking, diversity, kNN."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlog.functions import text as T
from loamlog.operators.components import checkpointed
from loamlog.sources import log as L

#: Fixed values of the ranking.
KIND_PRIORITY = {"claim": 1.0, "decision": 0.95, "summary": 0.9, "open_loop": 0.55, "evidence_excerpt": 0.2}
OTHER_PRIORITY = 0.5
KIND_FACTOR, WORKTREE_FACTOR = 0.4, 0.25
HOP_BOOST = (0.2, 0.12, 0.06)
TYPED_ACTIVE, TYPED_DRAFT = 0.45, 0.18
MEANINGFUL = ("claim", "decision", "summary", "open_loop")
DIMENSIONS = 768
#: Queries and different query tokens that are broadcast as one matrix at most (some 100 MB);
#: beyond, queries meet documents by joins. Rows of documents that are scored together.
MATRIX_QUERIES, MATRIX_TOKENS, MATRIX_ROWS = 1024, 16_384, 500


def kind_priority(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in KIND_PRIORITY.items() for x in pair])
    return F.coalesce(known[kind], F.lit(OTHER_PRIORITY))


#: Types of events that are chunks: rank and kind.
CHUNK_KINDS = {"Claim": (0, "claim"), "AcceptanceDecision": (1, "decision"), "Observation": (2, "summary"), "EvidenceArtifact": (3, "evidence_excerpt")}


def numbered(log: DataFrame) -> DataFrame:
    """The events that are chunks, with chunk_kind, text, zone_sequence and chunk_index. Chunks
    are numbered globally by kind, zone sequence and event id.

    The number comes from counts per kind and zone and day, not from a window over all rows.
    """
    rank = F.create_map(*[F.lit(x) for k, (r, _) in CHUNK_KINDS.items() for x in (k, r)])
    name = F.create_map(*[F.lit(x) for k, (_, c) in CHUNK_KINDS.items() for x in (k, c)])
    rows = L.sequenced(log).where(F.col("event_type").isin(*CHUNK_KINDS))
    body = F.coalesce("statement", F.concat(F.lit("Decision: "), F.col("decision")), F.concat(F.lit("Evidence of "), F.col("subject")))
    rows = rows.withColumns({"kind_rank": rank[F.col("event_type")], "chunk_kind": name[F.col("event_type")], "text": body})
    # sequence numbers of a zone are dense, so slices of them are even and need no sampling
    rows = rows.withColumn("_slice", F.floor(F.col("zone_sequence") / 10_000))
    counts = rows.groupBy("kind_rank", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("kind_rank").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    kinds_before = Window.orderBy("kind_rank").rowsBetween(Window.unboundedPreceding, -1)  # four rows
    totals = counts.groupBy("kind_rank").agg(F.sum("_n").alias("_all")).select("kind_rank", F.coalesce(F.sum("_all").over(kinds_before), F.lit(0)).alias("_lower"))
    offsets = counts.join(F.broadcast(totals), "kind_rank").select("kind_rank", "_slice", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.col("_lower")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("kind_rank", "_slice").orderBy("zone_sequence", "event_id"))
    rows = rows.withColumn("_own", own).join(offsets, ["kind_rank", "_slice"]).withColumn("chunk_index", (F.col("_before") + F.col("_own") - 1).cast("long"))
    return rows.drop("kind_rank", "_slice", "_own", "_before")


def text_digest() -> Column:
    return F.concat(F.lit("sha-256:"), F.sha2("text", 256))


def chunk_id() -> Column:
    """The content id of a numbered chunk."""
    return T.content_id("chk_", 40, F.col("event_id"), F.col("chunk_kind"), F.col("chunk_index").cast("string"), text_digest())


def with_status(rows: DataFrame, log: DataFrame) -> DataFrame:
    gone = L.erasures(log).select(F.col("target_id").alias("event_id")).distinct()
    status = F.when(F.col("_erased"), "projection_deleted").otherwise("active")
    return rows.join(gone.withColumn("_erased", F.lit(True)), "event_id", "left").withColumn("status", status).drop("_erased")


def chunks(log: DataFrame) -> DataFrame:
    """One chunk per claim, decision, observation and evidence, with its text, digests and
    content id."""
    return with_status(numbered(log), log).select(
        chunk_id().alias("chunk_id"), "chunk_kind", "chunk_index", "event_id", "zone", "zone_sequence", "lifecycle", "authority", "recorded", "text", text_digest().alias("text_digest"), "status",
    )


def lexical_score(query: Column, doc: Column) -> Column:
    """Share of the query's tokens, repeats counted, that the document holds."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.filter(query, lambda t: F.array_contains(doc, t))) / F.size(query))


def structured_score(query: Column, kind: Column, lifecycle: Column, authority: Column) -> Column:
    """Tokens of kind, status and authority in the query, over its distinct tokens, at most 1."""
    own = T.search_tokens(F.concat_ws(" ", kind, lifecycle, authority))
    asked = F.array_distinct(query)
    return F.least(F.lit(1.0), F.size(F.filter(own, lambda t: F.array_contains(asked, t))) / F.greatest(F.lit(1), F.size(asked)))


def typed_boost(kind: Column, lifecycle: Column) -> Column:
    meaningful = kind.isin(*MEANINGFUL)
    return (
        F.when(kind == "evidence_excerpt", 0.0).when(meaningful & (lifecycle == "active"), TYPED_ACTIVE * kind_priority(kind))
        .when(meaningful & (lifecycle == "draft"), TYPED_DRAFT * kind_priority(kind)).when(meaningful, TYPED_DRAFT * kind_priority(kind) * 0.5).otherwise(0.0)
    )


def hybrid_total(structured: Column, fts: Column, semantic: Column, recency: Column, kind: Column, boost: Column, w=(1.0, 1.0, 1.0, 0.1)) -> Column:
    """Weighted sum; kind priority and boosts count under the structured weight."""
    return structured * w[0] + kind_priority(kind) * max(w[0], 0) * KIND_FACTOR + F.greatest(F.lit(0.0), boost) * max(w[0], 0) + fts * w[1] + semantic * w[2] + recency * w[3]


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index: one row per distinct token of each row."""
    return docs.select(key, F.explode(F.array_distinct(T.search_tokens(F.col(text)))).alias("token"))


def rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def matrix_topk(docs: DataFrame, features: Callable, weights: np.ndarray, items: np.ndarray, k: int, divide: np.ndarray | None = None) -> DataFrame:
    """item_id, doc_id, score: for each query its ``k`` best documents of each task's part.

    ``features`` makes a matrix of a list of texts, which is multiplied with the queries'
    ``weights``. A task keeps the best of what it has seen, so what is exchanged afterwards is
    ``k`` rows a query and task, whatever a document shares with whom.
    """
    held = docs.sparkSession.sparkContext.broadcast((weights, items, divide))

    def keep(item: np.ndarray, doc: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((doc, -rounded(raw), item))
        item, doc, raw = item[order], doc[order], raw[order]
        first = np.searchsorted(item, item)
        near = np.arange(len(item)) - first < k
        return item[near], doc[near], raw[near]

    def run(batches):
        w, names, over = held.value
        shares = (w != 0).astype(np.float32)
        item, doc, raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(len(names), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, MATRIX_ROWS):
                part = batch.slice(at, MATRIX_ROWS)
                ids, x = part.column(0).to_numpy(), features([t or "" for t in part.column(1).to_pylist()])
                scores = x @ w if over is None else (x @ w) / over
                i, j = np.nonzero(rounded(scores) >= floor)
                low = np.flatnonzero(scores[i, j] <= 0)
                if len(low):  # only what shares a feature is a candidate
                    rows, place = np.unique(i[low], return_inverse=True)
                    shared = (x[rows] != 0).astype(np.float32) @ shares
                    drop = shared[place, j[low]] == 0
                    i, j = np.delete(i, low[drop]), np.delete(j, low[drop])
                item, doc, raw = keep(np.concatenate([item, j]), np.concatenate([doc, ids[i]]), np.concatenate([raw, scores[i, j]]))
                full = np.bincount(item, minlength=len(names)) == k
                last = np.searchsorted(item, np.arange(len(names)), side="right") - 1
                floor[full] = rounded(raw[last[full]])
        yield pa.record_batch([pa.array(names[item]), pa.array(doc), pa.array(raw)], names=["item_id", "doc_id", "raw"])

    best = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "item_id long, doc_id long, raw double")
    return ranked(best.select("item_id", "doc_id", F.round("raw", 6).alias("score")), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def asked_tokens(queries: DataFrame) -> DataFrame:
    """item_id, size, token, times: each query's tokens with their repeats."""
    tokens = T.search_tokens(F.col("text"))
    return queries.select("item_id", F.explode(tokens).alias("token"), F.size(tokens).alias("size")).groupBy("item_id", "size", "token").agg(F.count("*").alias("times"))


def few(asked: DataFrame) -> bool:
    """Whether the queries, of which none lacks an id, make one matrix."""
    size = asked.agg(F.count_distinct("item_id"), F.count_distinct("token"), F.count_if(F.col("item_id").isNull())).first()
    return size[0] <= MATRIX_QUERIES and size[1] <= MATRIX_TOKENS and not size[2]


def asked_matrix(asked: DataFrame) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens, ids of the queries, repeats (tokens by queries), sizes."""
    rows = asked.collect()
    items = np.array(sorted({r["item_id"] for r in rows}), np.int64)
    place = {x: i for i, x in enumerate(items.tolist())}
    token = {t: i for i, t in enumerate(sorted({r["token"] for r in rows}))}
    weights, sizes = np.zeros((len(token), len(items))), np.ones(len(items))
    for r in rows:
        weights[token[r["token"]], place[r["item_id"]]] = r["times"]
        sizes[place[r["item_id"]]] = r["size"]
    return token, items, weights, sizes


def lexical_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """For each query the ``k`` documents of highest lexical score, then smallest id.

    Queries are the small side. Their tokens are collected if there are few, which is counted,
    and scored as a matrix of the repeats of each token; more meet the inverted index by a join.
    """
    asked = asked_tokens(queries)
    if not few(asked):
        hits = asked.join(postings(docs, "doc_id", "text"), "token").groupBy("item_id", "size", "doc_id").agg(F.sum("times").alias("matched"))
        return ranked(hits.select("item_id", "doc_id", F.round(F.col("matched") / F.col("size"), 6).alias("score")), k)
    token, items, weights, sizes = asked_matrix(asked)
    place = {t.encode(): i for t, i in token.items()}
    blank = bytes(c if c in b"abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))

    def features(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(place)))
        for i, t in enumerate(texts):
            words = t.lower().encode("ascii", "replace").translate(blank).split()
            out[i, [place[x] for x in place.keys() & words]] = 1
        return out

    return matrix_topk(docs, features, weights, items, k, sizes)


def structured_topk(chunk_rows: DataFrame, query: str, scan: int, k: int) -> DataFrame:
    """The newest ``scan`` active chunks, of these the ones that match the query by structure;
    the scan limit comes before the match by contract."""
    asked = F.array(*[F.lit(t) for t in query.lower().split()])
    newest = chunk_rows.where("status = 'active'").orderBy(F.desc("zone_sequence"), "chunk_id").limit(scan)
    scored = newest.withColumn("score", F.round(structured_score(asked, F.col("chunk_kind"), F.col("lifecycle"), F.col("authority")), 6)).where("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("zone_sequence"), "chunk_id").limit(k).select("chunk_id", "chunk_kind", "zone_sequence", "score")


def hashed_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sparse signed hashing of embedding tokens: (key, bucket, weight), unit length.

    Bucket and sign come from each token's SHA-256. Texts without tokens, or whose signs
    cancel, are bucket 0 with weight 1.
    """
    tokens = docs.select(key, F.explode(T.embedding_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("times"))
    digest = F.sha2("token", 256)
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % DIMENSIONS).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    sums = tokens.groupBy(key, bucket.alias("bucket")).agg(F.sum(sign * F.col("times")).alias("s")).where("s <> 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("s") * F.col("s")).cast("double")).alias("norm"))
    weights = sums.join(norms, key).select(key, "bucket", (F.col("s") / F.col("norm")).alias("weight"))
    empty = docs.select(key).join(norms, key, "left_anti").select(key, F.lit(0).alias("bucket"), F.lit(1.0).alias("weight"))
    return weights.unionAll(empty)


def hashed_rows(texts: list[str], seen: dict) -> np.ndarray:
    """The vectors of ``hashed_vectors`` as rows of a matrix; ``seen`` keeps tokens' buckets."""
    out = np.zeros((len(texts), DIMENSIONS))
    for i, t in enumerate(texts):
        for word, n in Counter(re.findall("[a-z0-9_]+", t.lower())).items():
            if word not in seen:
                if len(seen) > 500_000:
                    seen.clear()
                digest = hashlib.sha256(word.encode()).digest()
                seen[word] = int.from_bytes(digest[:4]) % DIMENSIONS, 1 if digest[4] % 2 else -1
            bucket, sign = seen[word]
            out[i, bucket] += sign * n
    norms = np.sqrt((out * out).sum(axis=1))
    out[norms == 0, 0] = 1
    return out / np.where(norms == 0, 1, norms)[:, None]


def hashed_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Cosine top-k between hashed query and document texts.

    A few queries, counted, are one matrix that goes to the documents; more meet them by a
    sparse join on buckets, in which long texts meet every query.
    """
    few = queries.select("item_id", "text").limit(MATRIX_QUERIES + 1).collect()
    if len(few) > MATRIX_QUERIES or len({r["item_id"] for r in few} - {None}) < len(few):
        q = hashed_vectors(queries, "item_id").withColumnRenamed("weight", "w2")
        dot = hashed_vectors(docs).join(q, "bucket").groupBy("item_id", "doc_id").agg(F.sum(F.col("weight") * F.col("w2")).alias("dot"))
        return ranked(dot.select("item_id", "doc_id", F.round("dot", 6).alias("score")), k)
    few.sort(key=lambda r: r["item_id"])
    weights = hashed_rows([r["text"] or "" for r in few], {}).T
    seen: dict = {}
    return matrix_topk(docs, lambda texts: hashed_rows(texts, seen), weights, np.array([r["item_id"] for r in few], np.int64), k)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


#: Query vectors and others that one task multiplies with one another.
KNN_QUERIES, KNN_ROWS = 512, 8192


def vector_knn(vectors: DataFrame, query_every: int, k: int) -> DataFrame:
    """Exact nearest neighbours: every vector whose id is divisible by ``query_every`` against
    all vectors of its label.

    Labels with many vectors are cut into blocks of queries and of others; a block pair is one
    product of matrices, of which ``k`` neighbours a query go on. Vectors of another length,
    zero ones and null ones score 0.
    """
    rows = vectors.where("label IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "label", "embedding", (F.col("vec_id") % query_every == 0).alias("asks"))
    shape = rows.groupBy("label").agg(F.ceil(F.count_if("asks") / KNN_QUERIES).cast("int").alias("xs"), F.ceil(F.count("*") / KNN_ROWS).cast("int").alias("ys")).where("xs > 0")
    dealt = rows.join(shape, "label")
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = dealt.where("asks").select("label", own("xs").alias("x"), every("ys").alias("y"), F.lit(True).alias("query"), "vec_id", "embedding")
    others = dealt.select("label", every("xs").alias("x"), own("ys").alias("y"), F.lit(False).alias("query"), "vec_id", "embedding")

    def units(table: pa.Table, size: int) -> np.ndarray:
        out = np.zeros((table.num_rows, size))
        for i, v in enumerate(table.column("embedding").to_pylist()):
            if v is not None and len(v) == size:
                row = np.array([np.nan if c is None else c for c in v], np.float64)
                norm = np.sqrt(row @ row)
                out[i] = row / norm if norm > 0 else 0
        return out

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("query").to_numpy()
        left, right = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        a, b = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        sizes = sorted({len(v) for v in left.column("embedding").to_pylist() if v is not None})
        scores = np.zeros((len(a), len(b)))
        for size in sizes:
            scores += units(left, size) @ units(right, size).T
        out_a, out_b, out_s = [], [], []
        for i in range(len(a)):
            other = np.flatnonzero(b != a[i])
            best = other[np.lexsort((b[other], -rounded(scores[i, other])))[:k]]
            out_a.append(np.full(len(best), a[i]))
            out_b.append(b[best])
            out_s.append(scores[i, best])
        flat = lambda x, t: np.concatenate([np.zeros(0, t), *x])
        return pa.table({"query_id": flat(out_a, np.int64), "vec_id": flat(out_b, np.int64), "raw": flat(out_s, np.float64)})

    found = asking.unionAll(others).groupBy("label", "x", "y").applyInArrow(run, "query_id long, vec_id long, raw double")
    scored = found.select("query_id", "vec_id", F.round("raw", 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def hybrid_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Lexical and hashed-vector candidates of each query, ranked by the hybrid total.

    Documents stand as chunks here: even ids are claims, odd ones evidence; every third is a
    draft. Recency falls with the distance from the newest id.
    """
    depth = max(4 * k, 32)
    lexical = lexical_topk(queries, docs, depth).select("item_id", "doc_id", F.col("score").alias("fts"))
    semantic = hashed_topk(queries, docs, depth).select("item_id", "doc_id", F.col("score").alias("semantic"))
    both = lexical.join(semantic, ["item_id", "doc_id"], "full").select("item_id", "doc_id", F.coalesce("fts", F.lit(0.0)).alias("fts"), F.coalesce("semantic", F.lit(0.0)).alias("semantic"))
    newest = docs.agg(F.max("doc_id").alias("newest"))
    kind = F.when(F.col("doc_id") % 2 == 0, "claim").otherwise("evidence_excerpt")
    life = F.when(F.col("doc_id") % 3 == 0, "draft").otherwise("active")
    rows = both.join(F.broadcast(newest)).withColumns({"chunk_kind": kind, "lifecycle": life})  # one row is broadcast
    recency = 1 / (1 + (F.col("newest") - F.col("doc_id")) / 100)
    total = hybrid_total(F.lit(0.0), F.col("fts"), F.col("semantic"), recency, F.col("chunk_kind"), typed_boost(F.col("chunk_kind"), F.col("lifecycle")))
    rows = rows.withColumn("total", F.round(total, 6))
    order = Window.partitionBy("item_id").orderBy(F.desc("total"), F.desc(kind_priority(F.col("chunk_kind"))), F.desc("semantic"), F.desc("fts"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "doc_id", "chunk_kind", "fts", "semantic", "total", "rank")


def diverse(ranked: DataFrame, texts: DataFrame, limit: int, threshold: float = 0.9) -> DataFrame:
    """Greedy selection per query from its ranked list: meaningful kinds first, at most half
    of one kind, near-duplicates of selected texts last; what was put off fills the rest.

    The lists are bounded (top-k), so one group holds few rows.
    """
    rows = ranked.join(texts.select("doc_id", F.array_distinct(T.search_tokens(F.col("text"))).alias("tokens")), "doc_id")

    def near(a: set, b: set) -> bool:
        return not (a or b) or len(a & b) / max(1, len(a | b)) >= threshold

    def pick(candidates: list, most: int) -> list:
        chosen, later, kinds = [], [], {}
        for c in candidates:
            if len(chosen) == most:
                break
            alike = any(near(c[2], s[2]) for s in chosen)
            if kinds.get(c[1], 0) >= max(1, -(-most // 2)) or alike:
                later.append(c)
                continue
            chosen.append(c)
            kinds[c[1]] = kinds.get(c[1], 0) + 1
        for c in later:
            if len(chosen) == most:
                break
            if not any(near(c[2], s[2]) for s in chosen):
                chosen.append(c)
        return chosen

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        all_rows = [(d, k, set(t)) for d, k, t in zip(pdf["doc_id"], pdf["chunk_kind"], pdf["tokens"], strict=True)]
        first = pick([c for c in all_rows if c[1] in MEANINGFUL], limit)
        rest = pick([c for c in all_rows if c[1] not in MEANINGFUL], limit - len(first)) if len(first) < limit else []
        chosen = [c[0] for c in first + rest]
        return pd.DataFrame({"item_id": pdf["item_id"].iloc[0], "doc_id": chosen, "place": range(1, len(chosen) + 1)})

    return rows.groupBy("item_id").applyInPandas(select, "item_id long, doc_id long, place int")


def token_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id with the same token set), tokens."""
    sets = docs.select("doc_id", F.sort_array(F.array_distinct(T.search_tokens(F.col("text")))).alias("tokens"))
    keyed = sets.withColumn("key", F.sha2(F.array_join("tokens", " "), 256))
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    return keyed.join(least, "key").select("doc_id", "class_id", "tokens")


#: Sets of a signature that are compared with as many others in one group.
SIGNATURE_BLOCK = 1024


def signatures(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(signature, low, id, n, s0, s1) of sets (id, hashes): two sets with a Jaccard similarity
    of at least num / den have a signature in common, of which one says ``low``.

    Sizes fall into levels such that two such sets are of one level or of neighbouring ones. In
    the group of a level and the next, no two of them differ in more than (den - num) / num
    of the smaller one's tokens. Tokens are dealt by hash over one part more than that, so at least
    one part is the same in both. ``s0`` and ``s1`` are 128 parities of the tokens: of them at most
    as many differ as tokens do.
    """
    ratio = den / num * (1 + 1e-9)  # above den / num, so that rounding sets no pair two levels apart
    mixed = lambda x: (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            n, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            odd, bit = np.zeros((len(n), 2), np.uint64), flat >> np.uint64(57)
            np.bitwise_xor.at(odd, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
            level = np.floor(np.log(n) / np.log(ratio)).astype(np.int64)
            for group in (level, level - 1):
                parts = np.floor(ratio ** (group + 1) * (den - num) / num + 1e-6).astype(np.int64) + 1
                first, own = np.cumsum(parts) - parts, np.repeat(np.arange(len(n)), parts)
                part = (mixed(flat) >> np.uint64(32)) % parts[row].astype(np.uint64)
                sums = np.zeros(parts.sum(), np.uint64)
                np.add.at(sums, first[row] + part.astype(np.int64), flat)
                place = (group[own] << 32) + np.arange(len(own)) - first[own]
                sums = mixed(mixed(sums) + mixed(place.astype(np.uint64)))
                columns = [pa.array(sums.view(np.int64)), pa.array((group == level)[own]), batch.column(0).take(pa.array(own)), pa.array(n[own]), *(pa.array(odd[own, i].view(np.int64)) for i in (0, 1))]
                yield pa.record_batch(columns, names=["signature", "low", "id", "n", "s0", "s1"])

    kind = reps.schema["id"].dataType.simpleString()
    return reps.select("id", "hashes").mapInArrow(run, f"signature long, low boolean, id {kind}, n long, s0 long, s1 long")


def near_duplicate_pairs(docs: DataFrame, num: int = 9, den: int = 10) -> DataFrame:
    """Pairs of different token sets with Jaccard similarity of at least num / den.

    Sets are taken once (token_classes tells their members) and meet by ``signatures``; what
    their sizes and parities leave open is compared token by token.
    """
    sets = docs.select("doc_id", F.sort_array(F.array_distinct(T.search_tokens(F.col("text")))).alias("tokens"))
    sets = T.computed(sets, "tokens").where(F.size("tokens") > 0)
    one = sets.groupBy(F.sha2(F.array_join("tokens", " "), 256).alias("key")).agg(F.min("doc_id").alias("id"), F.any_value("tokens").alias("tokens"))
    reps = checkpointed(one.where("id IS NOT NULL").select("id", "tokens"))  # read three times below
    marked = signatures(reps.select("id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes")), num, den)
    met = marked.withColumn("c", F.count("*").over(Window.partitionBy("signature"))).where("c > 1")
    # a signature that many sets have is dealt in pairs of blocks
    blocks = F.ceil(F.col("c") / SIGNATURE_BLOCK).cast("int")
    dealt = checkpointed(met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("c"))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "low", "s0", "s1")]
    a = dealt.select("signature", F.col("own").alias("lo"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("hi"), *side("a"))
    b = dealt.select("signature", F.explode(F.sequence(F.lit(0), "own")).alias("lo"), F.col("own").alias("hi"), *side("b"))
    once = (F.col("lo") < F.col("hi")) | (F.col("id_a") < F.col("id_b"))
    fits = (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (F.col("low_a") | F.col("low_b"))
    differ = F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b")))
    alike = differ * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)
    pairs = a.join(b, ["signature", "lo", "hi"]).where(once & fits & alike).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    full = pairs.join(reps.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(reps.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    total = F.size("ta") + F.size("tb") - shared
    return full.withColumns({"shared": shared, "total": total}).where(F.col("shared") * den >= F.col("total") * num).select("a", "b", F.round(F.col("shared") / F.col("total"), 6).alias("similarity"))
