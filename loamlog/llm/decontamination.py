"""Benchmark decontamination with spaced seeds.

A mask is a short pattern of token places that count and places that are ignored. The tokens
at the places that count are hashed at every position of test items and training texts, and
equal hashes are joined. A replaced word that falls on an ignored place does not prevent a
hit, and several masks cover for each other. Around each hit the aligned tokens are compared.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import ALNUM, free_name, mix64, scratch, skew_join, slices, staged, utf8_buffers, word_hashes

#: 1 counts, 0 is ignored. Each mask has five places that count. They find all that may be
#: replaced in WINDOW tokens; shorter items have further masks of their own length.
MASKS = ("11111", "1101011", "110010011", "1010110001")
#: log2 of the bits of the filter that hashes of training texts pass before they are joined:
#: 2 MB whatever the benchmark's size; a fuller filter lets more through, never less.
FILTER_BITS = 24
#: Aligned tokens compared at once, and the least share of them that agrees.
WINDOW, SHARE = 13, 0.8
#: Tokens kept on either side of a group of hits; a window that holds a hit lies within.
MARGIN = WINDOW


@functools.cache
def short_masks(share: float) -> dict[int, tuple[str, ...]]:
    """For each length of item below WINDOW the masks of that length that it needs besides MASKS.

    Any set of tokens that may be replaced must leave some mask whole. Sets that MASKS do not
    leave whole anywhere are covered by masks that, one by one, leave most of them whole. Items
    of fewer than five tokens have the whole item as their mask.
    """
    out = {}
    for n in range(1, WINDOW):
        replaced = n - math.ceil(n * share)
        placed = [{p + i for i, x in enumerate(m) if x == "1"} for m in MASKS for p in range(n - len(m) + 1)]
        left = [set(c) for c in itertools.combinations(range(n), replaced) if not any(m.isdisjoint(c) for m in placed)]
        weight = min(n - replaced, 4 if n < 8 else 5)
        own = []
        while left and weight:
            best = max(itertools.combinations(range(n), weight), key=lambda c: sum(x.isdisjoint(c) for x in left))
            own.append("".join("1" if i in best else "0" for i in range(n)))
            left = [x for x in left if not x.isdisjoint(best)]
        out[n] = tuple(own)
    return out


def seeds(tokens: np.ndarray, offsets: np.ndarray, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of every mask at every place where it fits into one text."""
    n = len(tokens)
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n)
    hashes, places = [], []
    for mask in masks:
        if n < len(mask):
            continue
        total = np.zeros(n - len(mask) + 1, np.uint64)
        for i, x in enumerate(mask):
            if x == "1":
                total = total * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + len(total)]
        fits = at[: len(total)] + len(mask) <= end[: len(total)]
        hashes.append(mix64(total[fits] + np.uint64(int("1" + mask, 2))))
        places.append(at[: len(total)][fits])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def filter_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that belong to a hash."""
    low = np.uint64((1 << FILTER_BITS) - 1)
    return (hashes & low).astype(np.int64), ((hashes >> np.uint64(FILTER_BITS)) & low).astype(np.int64)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = filter_places(hashes)
    return ((bits[a >> 6] >> (a & 63).astype(np.uint64)) & (bits[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def item_seeds(items: DataFrame, share: float) -> DataFrame:
    """Row key of the item, position and hash of each seed, and the item's length if the mask is
    for items of that length alone (else 0)."""
    short = {mask for masks in short_masks(share).values() for mask in masks}

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                tokens, offsets = word_hashes(*utf8_buffers(part.column(1)), ALNUM)
                for mask in (*MASKS, *sorted(short)):
                    hashes, places = seeds(tokens, offsets, (mask,))
                    owner = np.searchsorted(offsets, places, side="right") - 1
                    if mask in short:
                        whole = np.diff(offsets)[owner] == len(mask)
                        hashes, places, owner = hashes[whole], places[whole], owner[whole]
                    length = np.full(len(owner), len(mask) if mask in short else 0, np.int32)
                    yield pa.record_batch(
                        [part.column(0).take(pa.array(owner)), pa.array(places - offsets[owner], pa.int64()), pa.array(hashes.view(np.int64)), pa.array(length)],
                        names=["item", "item_at", "seed", "short"],
                    )

    return items.select("item", "text").mapInArrow(run, "item long, item_at long, seed long, short int").distinct()


def item_tokens(items: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                tokens, offsets = word_hashes(*utf8_buffers(part.column(1)), ALNUM)
                yield pa.record_batch([part.column(0), arrays(tokens.view(np.int64), offsets)], names=["item", "item_tokens"])

    return items.select("item", "text").mapInArrow(run, "item long, item_tokens array<long>")


def arrays(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int64()))


def filter_of(found: DataFrame) -> np.ndarray:
    """The filter's words: at most 2^FILTER_BITS / 64 rows come to the driver."""
    low = (1 << FILTER_BITS) - 1
    places = F.array(F.col("seed").bitwiseAND(low), F.shiftrightunsigned("seed", FILTER_BITS).bitwiseAND(low))
    one = F.expr("shiftleft(1L, cast(place % 64 as int))")
    rows = found.select(F.explode(places).alias("place")).groupBy(F.floor(F.col("place") / 64).alias("w")).agg(F.bit_or(one).alias("bits")).collect()
    out = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    for r in rows:
        out[r["w"]] = r["bits"]
    return out.view(np.uint64)


def doc_key() -> Column:
    """Rows of one doc_id share a key; rows of null doc_id share one only if their texts agree."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text:"), F.sha2("text", 256)))


def regions(docs: DataFrame, bits, masks: tuple[str, ...]) -> DataFrame:
    """Groups of nearby seeds that pass the filter: doc_key, tokens around them, where these
    begin in the text, and the seeds with their positions."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                tokens, offsets = word_hashes(*utf8_buffers(part.column(1)), ALNUM)
                hashes, places = seeds(tokens, offsets, masks)
                keep = passes(bits.value, hashes)
                hashes, places = hashes[keep], places[keep]
                order = np.argsort(places, kind="stable")
                hashes, places = hashes[order], places[order]
                owner = np.searchsorted(offsets, places, side="right") - 1
                if not len(places):
                    continue
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (places[1:] - places[:-1] > MARGIN)])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(places)) - 1
                own = owner[first]
                start = np.maximum(places[first] - MARGIN, offsets[own])
                stop = np.minimum(places[last] + max(map(len, MASKS)) + MARGIN, offsets[own + 1])
                size = stop - start
                begin = np.concatenate([[0], np.cumsum(size)])
                inner = np.arange(begin[-1]) + np.repeat(start - begin[:-1], size)
                cuts = np.append(first, len(places))
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(own)), pa.array(start - offsets[own], pa.int64()), arrays(tokens[inner].view(np.int64), begin),
                        arrays(hashes.view(np.int64), cuts), arrays(places - offsets[owner], cuts),
                    ],
                    names=["doc_key", "start", "tokens", "seeds", "places"],
                )

    schema = "doc_key string, start long, tokens array<long>, seeds array<long>, places array<long>"
    return docs.select(doc_key().alias("doc_key"), "text").mapInArrow(run, schema)


def best_window(same: np.ndarray, width: int) -> int:
    """Most agreeing places among ``width`` in a row."""
    total = np.concatenate([[0], np.cumsum(same)])
    return int((total[width:] - total[:-width]).max()) if len(same) >= width else 0


def verify(batches):
    """region, item, matched, width: the best window on the diagonal of a hit."""
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4)]
        tokens, wanted = batch.column(3), batch.column(5)
        for i, (region, item, start, shift) in enumerate(zip(*columns, strict=True)):
            a, b = tokens[i].values.to_numpy(), wanted[i].values.to_numpy()
            width = min(WINDOW, len(b))
            # place j of the item lies at shift + j in the text, at shift + j - start in a
            lo, hi = max(0, start - shift), min(len(b), start - shift + len(a))
            matched = best_window(a[lo + shift - start : hi + shift - start] == b[lo:hi], width) if hi - lo >= width else 0
            out.append((region, item, matched, width))
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["region", "item", "matched", "width"])


def find_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_key, doc_id, item_id, matched, width): test items of which a document holds a passage.

    A passage is ``WINDOW`` aligned tokens (all of a shorter item) of which at least
    ``share`` agree; tokens are runs of letters and digits with ASCII letters in lower case.
    Items without tokens are never found; so are documents without text. Every row of ``items`` is compared with its own text, whatever its id: rows
    of one item_id count together, and those of null item_id under null. Rows of one doc_id
    count together too; documents of null doc_id are told apart by their texts.
    """
    texts = items.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    texts = staged(texts.withColumn("item", F.monotonically_increasing_id()), "items")
    found = staged(item_seeds(texts, share), "item-seeds")
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(found))
    short = sorted(r[0] for r in found.where("short > 0").select("short").distinct().collect())  # fewer than WINDOW values
    masks = (*MASKS, *(m for n in short for m in short_masks(share)[n]))
    near = staged(regions(docs.where("text IS NOT NULL"), bits, masks).withColumn("region", F.monotonically_increasing_id()), "leak-regions")
    hits = near.select("region", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("region", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"))
    # a passage may be in a third of all texts: its seeds and its item are dealt over several tasks
    lines = staged(skew_join(hits, found.drop("short"), "seed").select("region", "item", (F.col("place") - F.col("item_at")).alias("shift")).distinct(), "leak-lines")
    pairs = skew_join(lines, item_tokens(texts), "item").join(near.select("region", "start", "tokens"), "region").select("region", "item", "start", "tokens", "shift", "item_tokens")
    checked = pairs.mapInArrow(verify, "region long, item long, matched long, width long")
    kept = checked.where((F.col("matched") >= F.ceil(F.col("width") * share)) & (F.col("width") > 0))
    named = kept.join(near.select("region", "doc_key"), "region").join(texts.select("item", "item_id"), "item")
    return named.groupBy("doc_key", F.expr("try_cast(doc_key AS long)").alias("doc_id"), "item_id").agg(
        F.max("matched").alias("matched"), F.max("width").alias("width")
    )


def flag_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaked boolean, n_items long (test items found in it),
    matched long (most agreeing tokens of a window; 0 if none)."""
    with scratch():
        leaks = staged(find_leaks(docs, items).groupBy("doc_key").agg(F.count("*").alias("n"), F.max("matched").alias("m")), "leaks", keep=True)
    return docs.select("doc_id", doc_key().alias("doc_key")).join(leaks, "doc_key", "left").select(
        "doc_id", F.col("n").isNotNull().alias("leaked"), F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("m", F.lit(0)).alias("matched")
    )


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a passage of a test item; all columns stay."""
    name = free_name("leaked", docs.columns)
    with scratch():
        leaked = staged(find_leaks(docs, items).select(F.col("doc_key").alias(name)).distinct(), "leaked", keep=True)
    return docs.join(leaked, doc_key() == F.col(name), "left_anti").select(*docs.columns)
