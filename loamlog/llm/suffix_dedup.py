"""Removal of byte passages that occur more than once, by merging Burrows-Wheeler transforms.

Every window of ``WINDOW`` bytes has an anchor, its leftmost 32-gram of least hash, so equal
windows have equal anchors at equal places. The windows of one anchor are one extent of the
text. Extents that are equal as a whole are repeats. Where an anchor has different extents,
their bytes meet in one task: the extents are cut into 8-byte symbols counted from the anchor
and split over shards, each shard gets its Burrows-Wheeler transform, and the transforms are
merged by refining their interleaving symbol by symbol. The merge yields common prefix
lengths, and its intervals of common prefix WINDOW - 8 and more, with the 8 bytes at a
window's ends, say exactly which windows occur again.

An anchor with very many different extents, such as that of a line which a third of all
documents hold, would fill a task. Its windows are told apart by aggregation instead: first
blocks of eight windows by the bytes that they share, then the windows of repeated blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamlog.llm.common import BYTE_VALUE, HOT, LEAST, SLICE_BYTES, SPACE, free_name, prefix_sums, release, runs, scratch, skew_join, slices, span_hashes, spans_of, staged, trim, utf8_buffers

#: Bytes of a repeat; other lengths are a parameter of the functions.
WINDOW = 400
GRAM = 32
#: Bytes of a symbol; the part that all eight windows around a symbol share has ``window // SYMBOL - 1``.
SYMBOL = 8
#: Window starts looked at together: a longer text is worked through in overlapping pieces.
PIECE = 500_000
#: Symbols of a shard whose transform is built by sorting, at most, and shards that a task's
#: symbols are cut into at least; transforms are merged whatever there is to merge.
SHARD, SHARDS = 16_000, 8
#: Bytes of extents whose 32-grams are hashed together.
AT_ONCE = 200_000
#: Different extents of an anchor, of under two windows each, that one task merges at most.
KINDS = 4096
#: White space bytes.
BLANKS = frozenset(b" \t\n\v\f\r")
#: Words of a passage that is always reported as shared, and words below which none is.
PASSAGE, PART = 50, 40


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def gram_hashes(sums: np.ndarray) -> np.ndarray:
    at = np.arange(max(0, len(sums) - GRAM))
    return spans_of(sums, at, at + GRAM)


def extents(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Owner, first start, number of starts, anchor hash, content hash of all extents."""
    if len(raw) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = prefix_sums(BYTE_VALUE[raw])
    grams = gram_hashes(sums)
    least = sliding_minimum(grams, window - GRAM + 1)
    last = np.maximum(offsets[1:] - window, offsets[:-1] - 1)  # last start in each text
    edge = np.zeros(len(least) + 1, np.int32)
    some = last >= offsets[:-1]
    np.add.at(edge, offsets[:-1][some], 1)
    np.add.at(edge, last[some] + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    new[offsets[:-1][some]] = True
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(least))
    keep = valid[first]
    first, stop = first[keep], stop[keep]
    # a run that begins in a text ends with that text's last start at the latest
    owner = np.searchsorted(offsets, first, side="right") - 1
    stop = np.minimum(stop, last[owner] + 1)
    return owner, first, stop - first, least[first], spans_of(sums, first, stop - 1 + window)


def pieces(text: pa.Array, window: int = WINDOW):
    """(row, place of the piece in its text, bytes) with overlaps for windows across cuts."""
    raw, offsets = utf8_buffers(text)
    for i in range(len(offsets) - 1):
        own = raw[offsets[i] : offsets[i + 1]]
        for a in range(0, max(1, len(own) - window + 1), PIECE):
            yield i, a, own[a : a + PIECE + window - 1]


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, start, starts, anchor, extent: one row per extent of every text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                if pa.compute.max(pa.compute.binary_length(part.column(2))).as_py() or 0:
                    raw, offsets = utf8_buffers(part.column(2))
                    if len(raw) <= 2 * PIECE:
                        groups = [(np.arange(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64), raw, offsets)]
                    else:
                        groups = ((np.array([i]), np.array([a]), p, np.array([0, len(p)])) for i, a, p in pieces(part.column(2), window))
                    for rows, shift, data, off in groups:
                        owner, start, count, anchor, extent = extents(data, off, window)
                        take = pa.array(rows[owner])
                        yield pa.record_batch(
                            [
                                part.column(0).take(take), part.column(1).take(take), pa.array(start - off[owner] + shift[owner], pa.int64()),
                                pa.array(count, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(extent.view(np.int64)),
                            ],
                            names=["doc_id", "text_key", "start", "starts", "anchor", "extent"],
                        )

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, start long, starts int, anchor long, extent long")


def extent_bytes(docs: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """anchor, extent, n, starts, bytes, doc_id, text_key, start of the wanted extents, cut out of
    their texts."""
    lists = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "starts", "anchor", "extent", "n")).alias("cuts"))
    found = docs.join(lists, (docs.doc_id.eqNullSafe(lists.doc_id)) & (docs.text_key == lists.text_key)).select("text", "cuts", docs.doc_id, docs.text_key)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                raw, offsets = utf8_buffers(part.column(0))
                cuts = part.column(1)
                flat = cuts.flatten()
                starts, counts = flat.field("start").to_numpy(), flat.field("starts").to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(part)), np.diff(cuts.offsets.to_numpy()))
                a = offsets[owner] + starts
                data = raw.tobytes()
                rows = [data[i : i + n + window - 1] for i, n in zip(a.tolist(), counts.tolist(), strict=True)]
                of = pa.array(owner)
                yield pa.record_batch(
                    [flat.field("anchor"), flat.field("extent"), flat.field("n"), flat.field("starts"), pa.array(rows, pa.binary()), part.column(2).take(of), part.column(3).take(of), flat.field("start")],
                    names=["anchor", "extent", "n", "starts", "bytes", "doc_id", "text_key", "start"],
                )

    return found.mapInArrow(run, "anchor long, extent long, n long, starts int, bytes binary, doc_id long, text_key long, start long")


def shard_transform(symbols: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and Burrows-Wheeler transform of strings end to end, each closed by 0.

    Closing symbols sort by their string's number. The symbol before a string's first is 0.
    """
    n = len(symbols)
    rank = symbols.astype(np.int64)
    closing = symbols == 0
    rank[~closing] += int(string[-1]) + 1
    rank[closing] = string[closing]
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:] + 1
        # beyond the string's end nothing is compared: its closing symbol differs from all others
        order = np.lexsort((ahead, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])
        rank[order] = np.cumsum(new) - 1
        if new.all() or step >= n:
            break
        step *= 2
    before = np.zeros(n, symbols.dtype)
    before[1:] = symbols[:-1]
    return order, before[order]


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of keys under 2^32, by two passes over 16 bits each."""
    low = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    high = (keys >> 16).astype(np.uint16)
    return low if not high.any() else low[np.argsort(high[low], kind="stable")]


def merge_transforms(transforms: list[np.ndarray], closings: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaving of sorted shards, and common prefix lengths with the suffix before.

    The interleaving starts as shard after shard. Each round reads the transforms in its
    order and deals the suffixes to the symbols before them, which sorts by one symbol more.
    A border between suffixes that appears in round k has a common prefix of k - 1 symbols;
    borders that have not appeared after ``depth`` rounds get ``depth``.
    """
    n = sum(map(len, transforms))
    source = np.concatenate([np.full(len(t), i, np.uint16) for i, t in enumerate(transforms)])
    joined = np.concatenate(transforms)
    ends = int(sum(closings))
    closed = np.concatenate([np.full(c, i, np.uint16) for i, c in enumerate(closings)])
    border = np.zeros(n, bool)
    border[0] = True
    common = np.full(n, depth, np.int32)
    for k in range(1, depth + 1):
        at = np.empty(n, np.int64)
        at[np.argsort(source, kind="stable")] = np.arange(n)
        symbol = joined[at]
        group = np.cumsum(border)
        real = np.flatnonzero(symbol)
        order = real[stable_order(symbol[real])]
        now = np.ones(n, bool)
        s, g = symbol[order], group[order]
        now[ends + 1 :] = (s[1:] != s[:-1]) | (g[1:] != g[:-1])
        changed = np.concatenate([closed, source[order]])
        common[now & (common == depth)] = k - 1
        if np.array_equal(changed, source) and np.array_equal(now, border):
            break
        source, border = changed, now
    return source, common


def load(data: bytes | np.ndarray, at: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit numbers of the 8 bytes from each place."""
    raw = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))[at].copy().view("<u8").ravel()


def places_of(raw: np.ndarray, base: np.ndarray, sizes: np.ndarray, counts: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Place of the anchor in each extent, some AT_ONCE bytes of extents after the others: an anchor of
    thousands of extents is one group, and hashes of all its 32-grams are not held at a time."""
    out = [np.zeros(0, np.int64)]
    a = 0
    while a < len(base):
        b = max(a + 1, int(np.searchsorted(base, base[a] + AT_ONCE)))
        own = slice(a, b)
        sums = prefix_sums(BYTE_VALUE[raw[base[a] : base[b - 1] + sizes[b - 1]]])
        out.append(anchor_places(gram_hashes(sums), base[own] - base[a], sizes[own], counts[own], anchor[own]))
        a = b
    return np.concatenate(out)


def anchor_places(grams: np.ndarray, base: np.ndarray, sizes: np.ndarray, counts: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Place of the anchor in each extent: the first 32-gram with its hash from the last start on."""
    tail = base + counts - 1
    span = sizes - counts - GRAM + 2
    inner = np.concatenate([[0], np.cumsum(span)])
    at = np.arange(inner[-1]) + np.repeat(tail - inner[:-1], span)
    hit = np.flatnonzero(grams[at] == np.repeat(anchor.view(np.uint64), span))
    return at[hit[np.searchsorted(hit, inner[:-1])]] - base


def repeated_starts(
    data: list[bytes], counts: np.ndarray, anchor: np.ndarray, copies: np.ndarray, shard: int = SHARD, window: int = WINDOW, rank: np.ndarray | None = None
) -> list[np.ndarray]:
    """Of each extent the window starts whose window occurs again in any of the extents.

    ``counts`` are the extents' window starts, ``copies`` how often an extent occurs. With
    ``rank``, the order of the extents' first places, only windows that occurred before are
    given, as they stand in an extent's first copy.
    """
    shard = max(1, min(shard, -(-sum(len(x) // SYMBOL + 1 for x in data) // SHARDS)))
    depth = window // SYMBOL - 1
    sizes = np.array([len(x) for x in data], np.int64)
    base = np.cumsum(sizes) - sizes
    joined = b"".join(data)
    place = places_of(np.frombuffer(joined, np.uint8), base, sizes, counts, anchor)
    first = place % SYMBOL
    blocks = (sizes - first) // SYMBOL
    cut = np.concatenate([[0], np.cumsum(blocks + 1)])  # with a closing symbol each
    string = np.repeat(np.arange(len(data)), blocks + 1)
    block = np.arange(cut[-1]) - cut[string]
    closing = block == blocks[string]
    where = base[string] + first[string] + block * SYMBOL  # place in ``joined`` of each symbol
    symbols = np.zeros(cut[-1], np.int64)
    symbols[~closing] = np.unique(load(joined, where[~closing]), return_inverse=True)[1] + 1
    # shards of whole strings
    edges = [0]
    for i in range(1, len(data) + 1):
        if i == len(data) or cut[i] - cut[edges[-1]] >= shard:
            edges.append(i)
    suffixes, transforms, closings = [], [], []
    for a, b in zip(edges, edges[1:], strict=False):
        order, before = shard_transform(symbols[cut[a] : cut[b]], string[cut[a] : cut[b]] - a)
        suffixes.append(order + cut[a])
        transforms.append(before)
        closings.append(b - a)
    source, common = merge_transforms(transforms, closings, depth)
    at = np.empty(len(source), np.int64)
    at[np.argsort(source, kind="stable")] = np.arange(len(source))
    suffix = np.concatenate(suffixes)[at]
    group = np.cumsum(common < depth)  # suffixes with a common prefix of depth symbols
    shared = (common >= depth) | np.append(common[1:] >= depth, False)
    suffix, group = suffix[shared], group[shared]
    flags = [np.zeros(0, np.int64)] * len(data)
    owners, found = [], []
    for t in range(SYMBOL):
        start = block[suffix] * SYMBOL + first[string[suffix]] - t
        fits = (start >= 0) & (start < counts[string[suffix]])
        own, begin, g = string[suffix][fits], start[fits], group[fits]
        if not len(own):
            continue
        mask = np.uint64((1 << (8 * t)) - 1)
        edge = (load(joined, base[own] + begin) & mask) | (load(joined, base[own] + begin + window - SYMBOL) & ~mask)
        order = np.lexsort((edge, g) if rank is None else (begin, rank[own], edge, g))
        g, edge = g[order], edge[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (edge[1:] != edge[:-1])
        heads = np.flatnonzero(new)
        total = np.add.reduceat(copies[own[order]], heads)
        again = np.repeat(total >= 2, np.diff(np.append(heads, len(order)))) & (~new if rank is not None else True)
        owners.append(own[order][again])
        found.append(begin[order][again])
    if owners:
        own, begin = np.concatenate(owners), np.concatenate(found)
        order = np.lexsort((begin, own))
        own, begin = own[order], begin[order]
        cuts = np.searchsorted(own, np.arange(len(data) + 1))
        flags = [begin[cuts[i] : cuts[i + 1]] for i in range(len(data))]
    return flags if rank is not None else [np.arange(counts[i]) if copies[i] > 1 else f for i, f in enumerate(flags)]


def first_places(table: pa.Table) -> np.ndarray:
    """Ranks of extents by document, text and place; a null document comes first."""
    doc = table.column("doc_id")
    known = doc.is_valid().to_numpy()
    order = np.lexsort((table.column("start").to_numpy(), table.column("text_key").to_numpy(), doc.fill_null(0).to_numpy(), known))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def merged(cut_out: DataFrame, window: int = WINDOW, keep_first: bool = False) -> DataFrame:
    """anchor, extent, lo, hi: runs [lo, hi] of repeated starts in extents that occur once. With
    ``keep_first`` runs of starts whose windows occurred before, in the first copy of any extent."""

    def run(batches):
        for table in by_anchor(batches):
            trim()
            data = [bytes(x) for x in table.column("bytes").to_pylist()]
            counts = table.column("starts").to_numpy().astype(np.int64)
            copies = table.column("n").to_numpy()
            anchor = table.column("anchor").to_numpy()
            flags = repeated_starts(data, counts, anchor, copies, window=window, rank=first_places(table) if keep_first else None)
            rows, lo, hi = [], [], []
            for i, f in enumerate(flags):
                if len(f) and (keep_first or copies[i] == 1):
                    gap = np.flatnonzero(np.diff(f) > 1)
                    lo += f[np.concatenate([[0], gap + 1])].tolist()
                    hi += f[np.append(gap, len(f) - 1)].tolist()
                    rows += [i] * (len(gap) + 1)
            take = pa.array(rows, pa.int64())
            yield pa.record_batch(
                [pa.array(anchor).take(take), table.column("extent").combine_chunks().take(take), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
                names=["anchor", "extent", "lo", "hi"],
            )
            del table, data, flags
        release()

    return cut_out.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, extent long, lo long, hi long")


def hashed_windows(batches, blocks_only: bool, window: int = WINDOW):
    """Of each extent (anchor, extent, n, starts, bytes) its blocks or, of the blocks listed in
    a sixth column, its windows: anchor, extent, n, at (block or start), hash.

    Block j has the windows whose start lies 8 j to 8 j + 7 bytes before the anchor; its hash
    is of the bytes that all eight hold, so equal windows are in equal blocks.
    """
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            counts, anchor = part.column(3).to_numpy().astype(np.int64), part.column(0).to_numpy()
            raw, offsets = utf8_buffers(part.column(4).cast(pa.large_binary()).view(pa.large_string()))
            base, sizes = offsets[:-1], np.diff(offsets)
            sums = prefix_sums(BYTE_VALUE[raw])
            place = anchor_places(gram_hashes(sums), base, sizes, counts, anchor)
            if blocks_only:
                first, last = (place - counts + 1) // SYMBOL, place // SYMBOL
                first = np.maximum(first, 0)
                many = last - first + 1
                row = np.repeat(np.arange(len(counts)), many)
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[row]
                begin, length = place[row] - at * SYMBOL, window - SYMBOL + 1
            else:
                lists = part.column(5)
                row = np.repeat(np.arange(len(counts)), np.diff(lists.offsets.to_numpy()) * SYMBOL)
                block = np.repeat(lists.flatten().to_numpy(), SYMBOL)
                at = place[row] - block * SYMBOL - np.tile(np.arange(SYMBOL), len(block) // SYMBOL)
                inside = (at >= 0) & (at < counts[row])
                row, at = row[inside], at[inside]
                begin, length = at, window
            hashes = spans_of(sums, base[row] + begin, base[row] + begin + length)
            take = pa.array(row)
            yield pa.record_batch(
                [part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(at, pa.int64()), pa.array(hashes.view(np.int64))],
                names=["anchor", "extent", "n", "at", "hash"],
            )


def aggregated(cut_out: DataFrame, window: int = WINDOW, keep_first: bool = False) -> DataFrame:
    """As ``merged``, for anchors of very many extents: counts by partial aggregation only."""
    schema = "anchor long, extent long, n long, at long, hash long"
    held = staged(cut_out, "hot-extents")
    blocks = held.mapInArrow(lambda batches: hashed_windows(batches, True, window), schema)
    twice = lambda rows, *keys: rows.groupBy(*keys).agg(F.sum("n").alias("total")).where("total > 1").drop("total")
    open_blocks = blocks.join(twice(blocks, "anchor", "at", "hash"), ["anchor", "at", "hash"]).groupBy("anchor", "extent").agg(F.collect_set("at").alias("blocks"))
    windows = held.join(open_blocks, ["anchor", "extent"]).select("anchor", "extent", "n", "starts", "bytes", "blocks")
    windows = staged(windows.mapInArrow(lambda batches: hashed_windows(batches, False, window), schema), "hot-windows")
    if keep_first:
        placed = windows.join(held.select("anchor", "extent", F.struct("doc_id", "text_key", "start").alias("place")), ["anchor", "extent"]).withColumn("own", F.struct("place", "at"))
        first = placed.groupBy("anchor", "hash").agg(F.sum("n").alias("total"), F.min("own").alias("first")).where("total > 1")
        again = placed.join(first, ["anchor", "hash"]).where(~F.col("own").eqNullSafe(F.col("first"))).select("anchor", "extent", "at")
    else:
        again = windows.where("n = 1").join(twice(windows, "anchor", "hash"), ["anchor", "hash"]).select("anchor", "extent", "at")
    # an extent has fewer windows than a window has bytes
    island = F.col("at") - F.row_number().over(Window.partitionBy("anchor", "extent").orderBy("at"))
    return again.withColumn("island", island).groupBy("anchor", "extent", "island").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).select("anchor", "extent", "lo", "hi")


def by_anchor(batches, most: int = SLICE_BYTES):
    """Tables of whole anchors with about ``most`` bytes each, from batches sorted by anchor."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        while batch is not None:
            full = size >= most
            if full:
                last = held[-1].column(0)[-1].as_py()
                keys = batch.column(0).to_numpy()
                n = int(np.searchsorted(keys != last, True)) if (keys == last).any() else 0
                n = n if keys[0] == last else 0
                if n == len(keys):
                    held.append(batch)
                    batch = None
                    continue
                if n:
                    held.append(batch.slice(0, n))
                yield pa.Table.from_batches(held)
                held, size, batch = [], 0, batch.slice(n)
            else:
                piece = batch.slice(0, 2000)
                held.append(piece)
                size += pa.compute.sum(pa.compute.binary_length(piece.column(4))).as_py() or 0
                batch = batch.slice(2000) if batch.num_rows > 2000 else None
    if held:
        yield pa.Table.from_batches(held)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key: rows of one id are told apart by their texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, keep_first: bool = False) -> DataFrame:
    """doc_id, text_key, spans: for texts with repeats, the runs [lo, hi] of repeated starts.

    With ``keep_first`` the first of all equal windows, by document, text and place, is no
    repeat. Rows that share id and text are one text then. ``window`` is a multiple of SYMBOL.
    """
    if window % SYMBOL or window < 2 * GRAM:
        raise ValueError(f"a window has a multiple of {SYMBOL} bytes, {2 * GRAM} at least")
    text = keyed(docs)
    rows = staged(anchors(text, window), "extents")
    each = rows.groupBy("anchor", "extent").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "start", "starts")).alias("one"))
    each = staged(each, "extent-counts")
    many = each.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = each.join(many, "anchor").select("anchor", "extent", "n", "one.*", "kinds")
    part = merged(extent_bytes(text, wanted.where(F.col("kinds") <= KINDS), window), window, keep_first)
    hot = staged(wanted.where(F.col("kinds") > KINDS), "hot-wanted")
    if not hot.isEmpty():
        part = part.unionAll(aggregated(extent_bytes(text, hot, window), window, keep_first))
    place = F.struct("doc_id", "text_key", "start")
    spared = F.col("one").dropFields("starts") if keep_first else F.lit(None).cast("struct<doc_id:bigint,text_key:bigint,start:bigint>")
    whole = each.where("n > 1").select("anchor", "extent", F.lit(0).cast("long").alias("lo"), (F.col("one.starts") - 1).cast("long").alias("hi"), spared.alias("spared"))
    again = staged(whole.unionByName(part.withColumn("spared", F.lit(None).cast("struct<doc_id:bigint,text_key:bigint,start:bigint>"))), "repeats")
    # one extent may be in a third of all texts, so its rows are dealt over several tasks
    key = F.xxhash64("anchor", "extent")
    spans = skew_join(rows.withColumn("key", key), again.withColumn("key", key).drop("anchor", "extent"), "key", hot=hot_extents(each)).where(~F.coalesce(place.eqNullSafe(F.col("spared")), F.lit(False)) | F.col("spared").isNull()).select("doc_id", "text_key", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    return spans.distinct().groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def hot_extents(each: DataFrame) -> list:
    """Keys of the extents with more than 1 / HOT of all places, fewer than HOT of them."""
    total = each.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in each.where(F.col("n") > max(total // HOT, LEAST)).select(F.xxhash64("anchor", "extent")).collect()]


def remaining(data: bytes, spans: list[tuple[int, int]], window: int = WINDOW) -> tuple[bytes, int]:
    """The bytes outside all windows with starts in the runs, and the number of removed runs."""
    out, at, runs = [], 0, 0
    end = None
    for lo, hi in sorted(spans):
        if end is None or lo > end:
            out.append(data[at:lo])
            runs += 1
        end = hi + window if end is None else max(end, hi + window)
        at = end
    out.append(data[at:])
    return b"".join(out), runs


def at_words(data: bytes, spans: list[tuple[int, int]], window: int) -> bytes:
    """The bytes outside the windows with starts in the runs, but for words that a run's end
    would cut: these stay whole. What goes ends before a blank or at the end of the text."""
    out, at = [], 0
    for lo, hi in merged_runs(spans, window):
        if lo and data[lo - 1] not in BLANKS:  # within a word: it stays
            while lo < hi and data[lo] not in BLANKS:
                lo += 1
        while hi > lo and hi < len(data) and data[hi] not in BLANKS:
            hi -= 1
        out.append(data[at:lo])
        at = max(at, hi, lo)
    out.append(data[at:])
    return b"".join(out)


def merged_runs(spans: list[tuple[int, int]], window: int) -> list[list[int]]:
    """Byte ranges that the windows with starts in the runs cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + window)
        else:
            out.append([lo, hi + window])
    return out


def with_spans(docs: DataFrame, window: int, into: str, keep_first: bool = False) -> DataFrame:
    """``docs`` plus ``into``, the runs of repeated starts (null where nothing repeats)."""
    doc, key = free_name("doc", [*docs.columns, into]), free_name("key", [*docs.columns, into])
    with scratch():
        spans = staged(repeated_spans(docs, window, keep_first), "spans", keep=True)
    spans = spans.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("spans").alias(into))
    text_key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(spans, (F.col("doc_id").cast("long").eqNullSafe(F.col(doc))) & (text_key == F.col(key)), "left").drop(doc, key)


def chosen_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the PART-word strings chosen in each text of PASSAGE words and more: in
    every PASSAGE words in a row the one of least hash, so equal passages choose equal ones."""
    raw, offsets = utf8_buffers(column)
    starts, ends = runs(~SPACE[raw], offsets)
    at = np.searchsorted(starts, offsets)
    sums = prefix_sums(span_hashes(raw, starts, ends))
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(starts) < PASSAGE:
        return none
    place = np.arange(len(starts) - PART + 1)
    grams = spans_of(sums, place, place + PART)
    width = PASSAGE - PART + 1
    least = sliding_minimum(grams, width)
    text = np.searchsorted(at, place, side="right") - 1
    least[place[: len(least)] + PASSAGE > at[text[: len(least)] + 1]] = 0  # windows that leave their text
    most = ~sliding_minimum(~np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width)
    take = (most == grams) & (most > 0)
    return text[take], grams[take]


def sharing_texts(docs: DataFrame) -> DataFrame:
    """text_key of the texts that share a passage with another text or are held more than once.

    All passages of PASSAGE words and more are found, none of fewer than PART words; words are
    runs of bytes other than white space. Repeats within one text do not count.
    """
    text = keyed(docs)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                row, gram = chosen_grams(part.column(1))
                yield pa.record_batch([part.column(0).take(pa.array(row)), pa.array(gram.view(np.int64))], names=["text_key", "gram"])

    rows = staged(text.select("text_key", "text").mapInArrow(run, "text_key long, gram long"), "grams")
    by_gram = rows.groupBy("gram").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi"), F.count("*").alias("n"))
    shared = staged(by_gram.where("lo < hi").select("gram", "n"), "shared-grams")
    hot = [r[0] for r in shared.where(F.col("n") > max(rows.count() // HOT, LEAST)).select("gram").collect()]  # fewer than HOT
    found = skew_join(rows, shared.select("gram"), "gram", hot=hot).select("text_key").distinct()
    long = F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))) >= PASSAGE
    copies = text.groupBy("text_key").agg(F.count("*").alias("n"), F.any_value(long).alias("long")).where("n > 1 AND long").select("text_key")
    return found.unionAll(copies).distinct()


def dedup_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage.

    Texts are UTF-8 bytes (null: empty). Removed is every byte covered by a string of WINDOW
    bytes that also starts anywhere else in the input. Texts shorter than that lose nothing;
    copies of a longer text lose everything, repeated rows included. ``shares_passage`` tells
    whether another document has a passage of PASSAGE words of this one, which may be shorter
    than WINDOW bytes and then stays.
    """

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, spans, shares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                kept, n = remaining(data, [(s["lo"], s["hi"]) for s in spans or ()])
                out.append((doc_id, len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), shares))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.string(), pa.bool_()], strict=True)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean"
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    text = keyed(docs)
    with scratch():
        sharing = staged(sharing_texts(docs), "sharing")
        marks = staged(skew_join(staged(text.select("doc_id", "text_key"), "text-keys"), sharing, "text_key").distinct(), "marks")
        spans = staged(repeated_spans(docs), "spans")
        spans = spans.join(marks.withColumnsRenamed({"doc_id": "d", "text_key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "full")
        spans = staged(spans.select(F.coalesce("doc_id", "d").alias("_doc"), F.coalesce("text_key", "k").alias("_key"), "spans", F.col("k").isNotNull().alias("shares")), "spans-and-marks", keep=True)
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_key"))
    return rows.join(spans, same, "left").select("doc_id", "text", "spans", F.coalesce("shares", F.lit(False)).alias("shares")).mapInArrow(run, schema)


def drop_repeats(docs: DataFrame, window: int = WINDOW, keep_first: bool = False) -> DataFrame:
    """``docs`` with repeated bytes, of strings of ``window`` bytes, cut out of ``text``; all
    columns stay.

    With ``keep_first`` the first copy of what repeats stays, and no word is cut: one that a
    repeat's end falls into stays whole. Otherwise all copies go, and cuts that fall inside a
    character leave its other bytes out as well. A text that was not empty and of which nothing
    but blanks is left goes.
    """
    names = docs.columns
    at, text_at = len(names), names.index("text")

    def cut(text: str, spans: list[dict]) -> str | None:
        data, runs_ = text.encode(), [(s["lo"], s["hi"]) for s in spans]
        left = at_words(data, runs_, window) if keep_first else remaining(data, runs_, window)[0]
        out = left.decode("utf-8", "ignore")
        return out if out.strip(" \t\n\v\f\r") else None

    def run(batches):
        for batch in batches:
            texts = [cut(t, s) if s else t for t, s in zip(batch.column(text_at).to_pylist(), batch.column(at).to_pylist(), strict=True)]
            gone = [bool(s) and t is None for s, t in zip(batch.column(at).to_pylist(), texts, strict=True)]
            columns = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(at)]
            yield pa.record_batch(columns, names=names).filter(pa.array([not g for g in gone], pa.bool_()))

    into = free_name("spans", names)
    return with_spans(docs, window, into, keep_first).select(*names, into).mapInArrow(run, docs.schema)
