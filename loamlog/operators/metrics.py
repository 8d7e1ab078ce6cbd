"""Quality metrics over labelled results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamlog.operators.components import checkpointed


def confusion(rows: DataFrame) -> DataFrame:
    """expected, predicted -> counts per expected class, with recall."""
    out = rows.groupBy("expected").agg(*[F.count_if(F.col("predicted") == p).alias(p) for p in ("promote", "hold", "reject")], F.count_if(F.col("expected") == F.col("predicted")).alias("correct"), F.count("*").alias("n"))
    return out.withColumn("recall", F.round(F.col("correct") / F.col("n"), 6))


def binary_quality(rows: DataFrame) -> DataFrame:
    """actual, predicted (0 or 1) -> accuracy, precision, recall; 1 where nothing was due."""
    sums = rows.agg(
        F.count("*").alias("n"), F.count_if((F.col("actual") == 1) & (F.col("predicted") == 1)).alias("tp"),
        F.count_if((F.col("actual") == 0) & (F.col("predicted") == 1)).alias("fp"), F.count_if((F.col("actual") == 1) & (F.col("predicted") == 0)).alias("fn"),
        F.count_if(F.col("actual") == F.col("predicted")).alias("right"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), b), F.lit(1.0)), 6)
    return sums.select("n", ratio("right", F.col("n")).alias("accuracy"), ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", F.col("tp") + F.col("fn")).alias("recall"))


def retrieval_quality(ranked: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """Per query recall at ``k`` and reciprocal rank of the first relevant result, averaged.

    ranked: item_id, doc_id, rank; relevant: item_id, doc_id. Queries without a relevant
    document do not count.
    """
    places = ranked.groupBy("item_id", "doc_id").agg(F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("best"))
    hits = relevant.join(places, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.count("*").alias("due"), F.sum("found").alias("found"), F.min("best").alias("best"))
    per = hits.select(F.coalesce("found", F.lit(0)) / F.least("due", F.lit(k)), F.coalesce(1 / F.col("best"), F.lit(0.0)))
    return per.toDF("recall", "rr").agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.avg("rr"), 6).alias("mrr"))


#: Bytes of the longest strings that texts are searched for, a power of two; bytes of texts that
#: are looked through at once.
ANCHOR, SEARCHED = 16, 1 << 18
#: Different strings whose items are broadcast at most.
ANCHORED = 10_000


def window_hashes(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes of all strings of that length) for 1, 2, 4 to ANCHOR bytes."""
    length, hashes = 1, data.astype(np.uint64) + np.uint64(1)
    while True:
        yield length, hashes * np.uint64(0x9E3779B97F4A7C15)
        if length == ANCHOR or len(hashes) <= length:
            return
        hashes = hashes[:-length] * np.uint64(0xD6E8FEB86659FD93 + 2 * length) + hashes[length:]
        hashes ^= hashes >> np.uint64(32)
        length *= 2


def anchored(items: DataFrame) -> DataFrame:
    """item_id, asked, length, anchor: a string out of the middle of each text, as a hash."""

    def run(batches):
        for batch in batches:
            lengths, anchors = [], []
            for text in batch.column(1).to_pylist():
                data = np.frombuffer(text.encode(), np.uint8)
                length, hashes = list(window_hashes(data))[-1]
                lengths.append(length)
                anchors.append(hashes[len(hashes) // 2])
            yield pa.record_batch([*batch.columns, pa.array(lengths, pa.int64()), pa.array(np.array(anchors, np.uint64).view(np.int64))], names=["item_id", "asked", "length", "anchor"])

    asked = items.where("text <> ''").select("item_id", F.col("text").alias("asked"))
    return asked.mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, asked string, length long, anchor long")


def containing(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id: the documents that hold an item's text as it stands, which is what makes
    them relevant to it whatever a ranking says. Empty and null texts are held by none.

    Items are a stated set of queries. One string of each, 16 bytes if it has as many, goes as a
    hash to the documents, whose own strings of that length are hashed once whatever the number
    of items. Where one is met, the whole text is looked for.
    """
    asked = checkpointed(anchored(items))  # read twice below
    wanted: dict[int, np.ndarray] = {}
    for r in asked.select("length", "anchor").distinct().groupBy("length").agg(F.collect_list("anchor").alias("anchors")).collect():
        wanted[r["length"]] = np.sort(np.array(r["anchors"], np.int64).view(np.uint64))
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        signs = {}  # for each length the first bits of its anchors, most other strings have none of them
        for length, anchors in held.value.items():
            shift = np.uint64(64 - min(24, max(16, 6 + len(anchors).bit_length())))
            sign = np.zeros(1 << (64 - int(shift)), bool)
            sign[anchors >> shift] = True
            signs[length] = shift, sign, anchors
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            rows, met, at = [], [], 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + SEARCHED, side="right")) - 1)
                part = data[ends[at]:ends[upto]]
                for length, hashes in window_hashes(part) if len(part) else ():
                    if length not in signs:
                        continue
                    shift, sign, anchors = signs[length]
                    places = np.flatnonzero(sign[hashes >> shift])
                    there = np.minimum(np.searchsorted(anchors, hashes[places]), len(anchors) - 1)
                    same = anchors[there] == hashes[places]
                    places, there = places[same] + ends[at], there[same]
                    row = np.searchsorted(ends, places, side="right") - 1
                    inside = places + length <= ends[row + 1]
                    rows.append(row[inside])
                    met.append(anchors[there[inside]].view(np.int64))
                at = upto
            pairs = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *met])]), axis=1)
            row, first = np.unique(pairs[0], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, pairs.shape[1]), pa.int32()), pa.array(pairs[1]))
            yield pa.record_batch([*(c.take(pa.array(row)) for c in batch.columns), lists], names=["doc_id", "text", "anchors"])

    met = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, anchors array<long>")
    few = sum(map(len, wanted.values())) <= ANCHORED
    found = met.select("doc_id", "text", F.explode("anchors").alias("anchor")).join(F.broadcast(asked) if few else asked, "anchor")
    return found.where(F.contains("text", "asked")).select("item_id", "doc_id")


def ledger_gates(log: DataFrame) -> DataFrame:
    """Rates over attempted cases per zone, and the 95th latency: the value at place
    floor(0.95 n) from 0 in ascending order, found by rank rather than by gathering a list.

    Latency classes are counted first, so the window runs over classes, not cases.
    """
    cases = log.select("zone", (F.col("event_type") != "Supersession").alias("quality"), (F.col("lifecycle") == "active").alias("reviewer"), (F.col("k") * 10 + 50).alias("latency"))
    rates = cases.groupBy("zone").agg(F.count("*").alias("n"), F.round(F.avg(F.col("quality").cast("int")), 6).alias("quality_rate"), F.round(F.avg(F.col("reviewer").cast("int")), 6).alias("reviewer_rate"))
    classes = cases.groupBy("zone", "latency").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("zone").orderBy("latency"))
    place = classes.withColumn("upto", upto).join(rates.select("zone", "n"), "zone").where(F.col("upto") > F.floor(F.col("n") * 0.95)).groupBy("zone").agg(F.min("latency").alias("p95_ms"))
    blocked = F.filter(F.array(F.when(F.col("quality_rate") < 0.7, "quality"), F.when(F.col("reviewer_rate") < 0.85, "reviewer"), F.when(F.col("p95_ms") > 5000, "latency")), lambda x: x.isNotNull())
    return rates.join(place, "zone").withColumn("blockers", F.array_join(blocked, ","))


def form_quality(rows: DataFrame) -> DataFrame:
    """Accuracy, precision and recall of claim candidates, and how many observations stay."""
    claim = lambda c: F.col(c) == "claim_candidate"
    sums = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("expected") == F.col("predicted")).alias("right"), F.count_if(claim("expected") & claim("predicted")).alias("tp"),
        F.count_if(claim("predicted")).alias("said"), F.count_if(claim("expected")).alias("due"),
        F.count_if((F.col("expected") == "observation") & (F.col("predicted") == "observation")).alias("kept"), F.count_if(F.col("expected") == "observation").alias("seen"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(1.0)), 6)
    return sums.select("n", ratio("right", "n").alias("accuracy"), ratio("tp", "said").alias("claim_precision"), ratio("tp", "due").alias("claim_recall"), ratio("kept", "seen").alias("preservation"))


def rank_hits(rows: DataFrame) -> DataFrame:
    """Per query the top chunk of the offline hybrid rank, and whether it is what was expected
    and nothing forbidden. Semantic score is 0.8 of the lexical one; weights 1, 1, 0.5."""
    from loamlog.functions import text as T
    from loamlog.operators import retrieval as R

    tokens = rows.withColumns({"_query": T.search_tokens(F.col("query")), "_text": F.array_distinct(T.search_tokens(F.col("text")))})
    rows = T.computed(T.computed(tokens, "_query"), "_text")  # or each token would make them anew
    q = F.col("_query")
    rows = rows.withColumn("_fts", R.lexical_score(q, F.col("_text")))
    fts = F.col("_fts")
    structured = R.structured_score(q, F.col("kind"), F.col("lifecycle"), F.lit("derived"))
    hop = F.when(F.col("hop") == 0, R.HOP_BOOST[0]).when(F.col("hop") == 1, R.HOP_BOOST[1]).when(F.col("hop") == 2, R.HOP_BOOST[2]).otherwise(0.0)
    total = F.round(R.hybrid_total(structured, fts, fts * 0.8, F.lit(0.0), F.col("kind"), R.typed_boost(F.col("kind"), F.col("lifecycle")) + hop, (1.0, 1.0, 0.5, 0.1)), 6)
    top = rows.withColumn("total", total).groupBy("query_id").agg(F.min_by(F.struct("chunk_id", "total", "expected", "forbidden"), F.struct(-F.col("total"), "chunk_id")).alias("t"))
    return top.select("query_id", F.col("t.chunk_id").alias("top_id"), F.col("t.total").alias("total"), (F.col("t.expected") & ~F.col("t.forbidden")).alias("hit"))


def graph_snapshot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: meaning units, knowledge edges, derived_from and about edges, whether every unit
    has one of each, and the units' mean degree over such edges."""
    units = nodes.where("node_kind = 'meaning_unit'").select(F.col("node_id").alias("unit"))
    ends = edges.select("edge_kind", F.explode(F.array("from_id", "to_id")).alias("unit"))
    out = lambda kind: F.coalesce(F.sum(F.when(F.col("edge_kind") == kind, 1)), F.lit(0))
    per = units.join(ends, "unit", "left").groupBy("unit").agg(F.count("edge_kind").alias("degree"))
    kinds = edges.select("edge_kind", F.col("from_id").alias("unit")).where("edge_kind IN ('derived_from', 'about')").groupBy("unit").agg(out("derived_from").alias("derived"), out("about").alias("about"))
    joined = per.join(kinds, "unit", "left")
    a = joined.agg(
        F.count("*").alias("units"), F.round(F.coalesce(F.avg("degree"), F.lit(0.0)), 6).alias("mean_degree"),
        F.coalesce(F.min(F.coalesce("derived", F.lit(0)) > 0), F.lit(True)).alias("all_derived"), F.coalesce(F.min(F.coalesce("about", F.lit(0)) > 0), F.lit(True)).alias("all_about"),
    )
    b = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("edge_kind") == "derived_from").alias("derived_from"), F.count_if(F.col("edge_kind") == "about").alias("about"))
    return a.join(F.broadcast(b))  # one row each


def density_uplift(before: DataFrame, after: DataFrame, least_new: int = 1) -> DataFrame:
    """Deltas of two snapshots, whether the graph grew as it should, and why not."""
    names = ("units", "edges", "derived_from", "about", "mean_degree")
    both = after.join(F.broadcast(before.select(*[F.col(c).alias(f"{c}_before") for c in names])))
    delta = {f"{c}_delta": F.round(F.col(c) - F.col(f"{c}_before"), 6) for c in names}
    some = F.col("units") > 0
    reasons = F.array_compact(F.array(
        F.when(F.col("units") - F.col("units_before") < least_new, "insufficient_new_meaning_units"),
        F.when((F.col("derived_from") - F.col("derived_from_before") < 1) & (F.col("derived_from") < 1), "no_derived_from_uplift"),
        F.when(some & ~F.col("all_derived"), "meaning_units_missing_derived_from"), F.when(some & ~F.col("all_about"), "meaning_units_missing_about"),
        F.when(F.col("edges") <= F.col("edges_before"), "no_knowledge_edge_uplift"),
    ))
    out = both.select(*[x.alias(c) for c, x in delta.items()], reasons.alias("r"))
    return out.select(*delta, (F.size("r") == 0).alias("passes"), F.when(F.size("r") == 0, "graph_density_uplift_ok").otherwise(F.array_join("r", ",")).alias("reasons"))


def kind_recall(cases: DataFrame) -> DataFrame:
    """Per expected kind: how many cases expect it, how many were promoted and as that kind, and
    the share of these. And per kind that came out: how many of its promotes were expected.

    cases (expect_kind, kind, gate); a null kind is a case of which nothing was extracted.
    """
    promoted = F.coalesce(F.col("gate") == "promote", F.lit(False))
    right = promoted & F.coalesce(F.col("kind") == F.col("expect_kind"), F.lit(False))
    due = cases.where("expect_kind IS NOT NULL").groupBy(F.col("expect_kind").alias("name")).agg(F.count("*").alias("expected"), F.count_if(promoted).alias("promoted"), F.count_if(right).alias("observed"))
    made = cases.where(promoted).groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n_promotes"), F.count_if(right).alias("n_right"))
    none = F.lit(0).cast("long")
    rows = due.join(made, "name", "full")
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return rows.select(
        F.col("name").alias("kind"), *[F.coalesce(c, none).alias(c) for c in ("expected", "promoted", "observed", "n_promotes")], share("observed", "expected").alias("recall"), share("n_right", "n_promotes").alias("precision")
    )


#: Bounds of the evaluation gates: least rates of quality, review and baseline, most of what is
#: new and of drifted identities, the latest 95th latency and the highest cost.
BOUNDS = {"quality": 0.7, "reviewer": 0.85, "baseline": 0.6, "novel": 0.3, "p95_ms": 5000, "cost": 100_000.0, "drift": 0.05}


def evaluation_gates(cases: DataFrame, bounds: dict[str, float] = BOUNDS) -> DataFrame:
    """Per ledger: rates over its attempted cases, and the gates that they do not pass.

    cases (ledger, attempted, eligible, quality, reviewer, baseline, novel, stable, latency, cost).
    A case that is not eligible may not claim quality. The 95th latency is the value at place
    floor(0.95 n) from 0 in ascending order, found by counts of latencies. A ledger without
    attempted cases is blocked for that alone.
    """
    tried = F.col("attempted")
    rate = lambda c: F.round(F.coalesce(F.avg(F.when(tried, F.col(c).cast("int"))), F.lit(0.0)), 6)
    sums = cases.groupBy("ledger").agg(
        F.count_if(tried).alias("n"), rate("quality").alias("quality"), rate("reviewer").alias("reviewer"), rate("baseline").alias("baseline"), rate("novel").alias("novel"),
        F.round(F.coalesce(F.avg(F.when(tried, 1 - F.col("stable").cast("int"))), F.lit(0.0)), 6).alias("drift"), F.round(F.coalesce(F.sum(F.when(tried, F.col("cost"))), F.lit(0.0)), 6).alias("cost"),
        F.coalesce(F.max(tried & ~F.col("eligible") & F.col("quality")), F.lit(False)).alias("claimed"),
    )
    counts = cases.where(tried).groupBy("ledger", "latency").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("ledger").orderBy("latency"))).join(sums.select("ledger", "n"), "ledger")
    p95 = upto.where(F.col("upto") > F.floor(F.col("n") * 0.95)).groupBy("ledger").agg(F.min("latency").alias("p95_ms"))
    rows = sums.join(p95, "ledger", "left").withColumn("p95_ms", F.coalesce("p95_ms", F.lit(0)).cast("long"))
    below = lambda c: F.when(F.col(c) < bounds[c], f"{c}_below")
    above = lambda c: F.when(F.col(c) > bounds[c], f"{c}_above")
    each = F.array_compact(F.array(F.when(F.col("claimed"), "noneligible_claim"), below("quality"), below("reviewer"), below("baseline"), above("novel"), above("p95_ms"), above("cost"), above("drift")))
    blockers = F.when(F.col("n") == 0, "no_attempts").otherwise(F.array_join(each, ","))
    return rows.select("ledger", "n", "quality", "reviewer", "baseline", "novel", "drift", "p95_ms", "cost", blockers.alias("blockers"), (blockers == "").alias("passes"))


def metric_gates(quality: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """gate, passes, exit_code: retrieval passes at recall 1 and a mean reciprocal rank of 0.9,
    adjudication at full accuracy without a false promotion; 2 stands for nothing measured."""
    found = quality.select(F.lit("retrieval").alias("gate"), (F.col("n_queries") > 0).alias("measured"), ((F.col("macro_recall") >= 1) & (F.col("mrr") >= 0.9)).alias("passes"))
    judged = adjudicated.agg(F.sum("n").alias("n"), F.sum("correct").alias("right"), F.sum(F.when(F.col("expected") != "promote", F.col("promote")).otherwise(0)).alias("wrong"))
    told = judged.select(F.lit("adjudication").alias("gate"), (F.coalesce("n", F.lit(0)) > 0).alias("measured"), ((F.col("right") == F.col("n")) & (F.col("wrong") == 0)).alias("passes"))
    rows = found.unionAll(told)
    ok = F.col("measured") & F.coalesce("passes", F.lit(False))
    return rows.select("gate", ok.alias("passes"), F.when(~F.col("measured"), 2).when(ok, 0).otherwise(1).alias("exit_code"))
