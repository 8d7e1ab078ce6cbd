"""Exact Jaccard join of word-shingle sets in the metric space of Jaccard distance.

Pivots and the triangle inequality alone cannot part a corpus: most documents are at distance
1 from each other and from every pivot, so every window would hold all of them. Regions are
therefore laid around shared shingles first. Under one order of all shingles, two sets with
similarity t share a shingle among the first floor((1 - t) n) + 1 of each; the documents that
have a shingle there form a region. In a region distances tell documents apart: its first
document of each size band is a pivot, every member's distance to it is computed, and members
within the radius join its Voronoi cell. Regions with members outside one component are open.
They choose further pivots, those with most possible partners in other components, are joined
again, and so on until no open pair is left. Of two members with the same first pivot only those
whose distances to it differ by no more than the radius (the triangle window) are compared. No
pair at or above the threshold is lost.

Before texts are compared, a second bound is tried: counts of a set's shingles in 512 hash
classes map sets to vectors so that their difference never exceeds the sets' symmetric
difference. Pairs whose vectors are too far apart cannot link, and their texts stay at rest.

A region of more than ``MEMBERS`` sets, such as that of a third of all documents that are near
copies, is never held by one task. Its members stay rows: they are measured against pivots of
their size band, which joins the near copies to one component, then against ``MORE`` pivots of
those outside it, and what is left, members of other components against all, is compared in
blocks of ``BLOCK``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import LOWER, SPACE, components, free_name, hot_keys, mix64, runs, scratch, skew_join, slices, span_hashes, staged, utf8_buffers

WORDS = 5
#: Similarity as a fraction: sets link when DEN * intersection >= NUM * union.
NUM, DEN = 4, 5
#: Counters of shingle hashes by which frequent shingles are put last in the order. Their
#: number is fixed and they only set how much work is saved.
COUNTERS = 1 << 20
CLASS_BITS = 6
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Hash classes of the count vectors.
CLASSES = 512
#: Classes of the short vectors that regions hold for their members.
BRIEF = 128
#: Rows of (set, document) names that may be broadcast; some 10 MB.
FEW = 200_000
#: Sets of a region that one task holds at most, and sets of a block of a larger region.
MEMBERS, BLOCK = 4096, 4096
#: One document in so many is counted first for the shingles of large regions.
ONE_IN = 16
#: Pivots that an open region chooses before all its members take that part, and members
#: among which it chooses.
MORE, TRIED = 8, 64


def shingle_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text end to end, and n + 1 offsets.

    Words are runs of bytes other than 09-0D and 20, with A-Z in lower case. A text of fewer
    than WORDS words has its whole sequence as the only shingle; without words it has none.
    """
    raw, offsets = utf8_buffers(text)
    low = LOWER[raw]
    starts, ends = runs(~SPACE[low], offsets)
    words = span_hashes(low, starts, ends)
    at = np.searchsorted(starts, offsets)
    n = np.diff(at)
    counts = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    cuts = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(cuts[-1]) + np.repeat(at[:-1] - cuts[:-1], counts)
    length = np.repeat(np.minimum(n, WORDS), counts)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    total = length.astype(np.uint64)
    for k in range(WORDS):
        total = np.where(k < length, mix64(total * STEP + padded[first + k]), total)
    return total, cuts


def frequent_counters(docs: DataFrame) -> np.ndarray:
    """Class of each counter: 0 for usual ones, else the bits of its share over the mean.

    Every text is counted. A task reports the counters that stand out in its part, and of the
    summed reports the largest 65,536 at most come to the driver.
    """

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                hashes, _ = shingle_hashes(part.column(0))
                total += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        mean = total.mean()
        out = np.flatnonzero(total > 4 * mean + 8)
        yield pa.record_batch([pa.array(np.append(out, -1)), pa.array(np.append(total[out], total.sum()))], names=["counter", "n"])

    rows = docs.select("text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).orderBy(F.col("counter") >= 0, F.desc("n"), "counter").limit(1 << 16).collect()
    out = np.zeros(COUNTERS, np.uint8)
    mean = max(1.0, rows[0]["n"] / COUNTERS) if rows else 1.0
    for r in rows[1:]:
        if r["n"] > 4 * mean + 8:
            out[r["counter"]] = min(r["n"] / mean, 2.0**60).__int__().bit_length()
    return out


def vector_bytes(counts: np.ndarray) -> list[bytes]:
    """Rows as bytes, one a class; counts over 255 are cut, which only brings rows closer."""
    data = np.minimum(counts, 255).astype(np.uint8).tobytes()
    width = counts.shape[1]
    return [data[i : i + width] for i in range(0, len(data), width)]


def sets(docs: DataFrame, frequent) -> DataFrame:
    """doc_id, text_key, n (set size), sid (hash of the set), prefix, index (how many of the
    prefix suffice for the smaller set of a pair), counts (shingles by hash class), brief (the same by BRIEF classes).

    Of equal sets in a task's part only the first carries its prefix.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, 2):
                hashes, cuts = shingle_hashes(part.column(2))
                classes = frequent.value[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
                keys = (classes << np.uint64(64 - CLASS_BITS)) | (mix64(hashes) >> np.uint64(CLASS_BITS))
                own = [np.unique(keys[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                n = np.array([len(x) for x in own], np.int64)
                flat = np.concatenate(own) if own else keys
                begin = np.cumsum(n) - n
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(flat << np.uint64(CLASS_BITS)))])
                sid = mix64(sums[begin + n] - sums[begin] + n.astype(np.uint64)).view(np.int64)
                size = np.where(n > 0, n - (NUM * n + DEN - 1) // DEN + 1, 0)
                # two sets of sizes n <= m overlap in NUM (n + m) / (NUM + DEN) at least
                index = np.where(n > 0, n - (2 * NUM * n + NUM + DEN - 1) // (NUM + DEN) + 1, 0)
                for i, s in enumerate(sid.tolist()):
                    if s in seen:
                        size[i] = 0
                    elif len(seen) < 200_000:
                        seen.add(s)
                edge = np.concatenate([[0], np.cumsum(size)])
                take = np.arange(edge[-1]) + np.repeat(begin - edge[:-1], size)
                owner = np.repeat(np.arange(len(n)), n) * CLASSES + (flat & np.uint64(CLASSES - 1)).astype(np.int64)
                exact = np.bincount(owner, minlength=len(n) * CLASSES).reshape(-1, CLASSES)
                counts, brief = vector_bytes(exact), vector_bytes(exact.reshape(len(n), -1, BRIEF).sum(axis=1))
                prefix = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(flat[take].view(np.int64)))
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(n), pa.array(sid), prefix, pa.array(index.astype(np.int32)), pa.array(counts, pa.binary()), pa.array(brief, pa.binary())],
                    names=["doc_id", "text_key", "n", "sid", "prefix", "index", "counts", "brief"],
                )

    schema = "doc_id long, text_key long, n long, sid long, prefix array<long>, index int, counts binary, brief binary"
    return docs.select("doc_id", "text_key", "text").mapInArrow(run, schema)


def large_shingles(held: DataFrame, rows: DataFrame) -> DataFrame:
    """The shingles of more than MEMBERS of ``rows``, one row each.

    Most shingles stand in one prefix, and to count all of them would exchange all prefixes once
    more. So one document in ONE_IN, by hash, is counted first, and what stands in half as many of
    these as a large region has on average is counted in all rows, each task its own part first. A
    large region that is missed by that (fewer than one in 10^12) is joined as a small one; its
    pairs are the same.
    """
    one_in = max(1, min(ONE_IN, MEMBERS // 256))
    some = held.where((F.size("prefix") > 0) & (F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(one_in)) == 0))
    often = some.select(F.explode("prefix").alias("shingle")).groupBy("shingle").count().where(F.col("count") > MEMBERS // one_in // 2)
    often = staged(often.select("shingle"), "frequent-shingles")
    exact = rows.join(often, "shingle", "left_semi").groupBy("shingle").count().where(F.col("count") > MEMBERS)
    return staged(exact.select("shingle"), "large-regions")


def regions(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions of two sets and more: region, sids, sizes, indexed; ordered by (size, sid).
    Regions with the same members are one. And the members of large regions as rows: region,
    n, sid, indexed, band.
    """
    rows = held.where(F.size("prefix") > 0).select("n", "sid", "index", F.posexplode("prefix").alias("at", "shingle"))
    rows = rows.select("shingle", "n", "sid", (F.col("at") < F.col("index")).alias("indexed"))

    large = large_shingles(held, rows)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)))
    big = rows.join(large, "shingle", "left_semi").dropDuplicates(["shingle", "sid"]).select(F.col("shingle").alias("region"), "n", "sid", "indexed", band.alias("band"))
    rows = rows.join(large, "shingle", "left_anti").select("shingle", "n", "sid", "indexed")

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.table([batch.column(i) for i in range(4)], names=["shingle", "n", "sid", "indexed"])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            if table.num_rows == 0:
                continue
            key = table.column("shingle").to_numpy()
            last = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
            rest = table.slice(last)
            if last:
                yield grouped(table.slice(0, last))
        if rest is not None and rest.num_rows:
            yield grouped(rest)

    found = (
        rows.repartition("shingle").sortWithinPartitions("shingle", "n", "sid")
        .mapInArrow(run, "region long, sids array<long>, sizes array<long>, indexed array<boolean>")
    )
    return found.dropDuplicates(["region"]), big


def grouped(table: pa.Table) -> pa.RecordBatch:
    key, n, sid, indexed = (table.column(i).to_numpy() for i in range(4))
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (sid[1:] == sid[:-1])
    key, n, sid, indexed = key[~same], n[~same], sid[~same], indexed[~same]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(sid.view(np.uint64) + indexed.astype(np.uint64)))])
    marks = np.concatenate([[0], np.cumsum(indexed)])
    # a region counts if a set other than its last may be the smaller one of a pair
    keep = np.flatnonzero((count > 1) & (marks[first + count - 1] - marks[first] > 0))
    first, count = first[keep], count[keep]
    name = mix64(sums[first + count] - sums[first] + count.astype(np.uint64)).view(np.int64)
    cuts = np.concatenate([[0], np.cumsum(count)])
    take = np.arange(cuts[-1]) + np.repeat(first - cuts[:-1], count)
    off = pa.array(cuts.astype(np.int32))
    return pa.record_batch(
        [pa.array(name), *(pa.ListArray.from_arrays(off, pa.array(x[take])) for x in (sid, n, indexed))],
        names=["region", "sids", "sizes", "indexed"],
    )


def cells(sizes: np.ndarray, indexed: np.ndarray) -> np.ndarray:
    """The pivot's place for each member of a region (-1: none): the first indexed member,
    for all later ones that its size allows to link with it; then the next beyond."""
    out = np.full(len(sizes), -1, np.int64)
    marked = np.flatnonzero(indexed)
    i = 0
    while len(marked) and i < len(sizes):
        at = int(np.searchsorted(marked, i))
        if at == len(marked):
            break
        pivot = marked[at]
        stop = int(np.searchsorted(sizes, sizes[pivot] * DEN // NUM, side="right"))
        out[pivot:stop] = pivot
        i = max(stop, pivot + 1)
    return out


def pivot_pairs(held: DataFrame) -> DataFrame:
    """(a, b) of every member with its pivot."""

    def run(batches):
        for batch in batches:
            left, right = [], []
            for sids, sizes, indexed in lists(batch, ("sids", "sizes", "indexed")):
                pivot = cells(sizes, indexed)
                at = np.flatnonzero((pivot >= 0) & (pivot != np.arange(len(pivot))))
                left.append(sids[pivot[at]])
                right.append(sids[at])
            yield pairs_of(left, right)

    return held.select("sids", "sizes", "indexed").mapInArrow(run, "a long, b long").distinct()


def lists(batch: pa.RecordBatch, names: tuple[str, ...]):
    columns = [batch.column(batch.schema.names.index(c)) for c in names]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    off = [(c.offsets.to_numpy() - c.offsets[0].as_py()).tolist() for c in columns]
    for i in range(batch.num_rows):
        yield tuple(f[o[i] : o[i + 1]] for f, o in zip(flat, off, strict=True))


def pairs_of(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate([none, *left]), np.concatenate([none, *right])], axis=1), axis=0)
    return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def member_rows(held: DataFrame) -> DataFrame:
    """Members of the regions of three sets and more as rows, with their first pivots."""
    return held.where(F.size("sids") > 2).mapInArrow(with_pivots, "region long, at int, sid long, n long, indexed boolean, pivot long")


def open_regions(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of regions that lie in more than one component, with ``part``."""
    rows = rows.join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("part", F.coalesce("component", "sid")).drop("component")
    several = rows.groupBy("region").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    return rows.join(several.select("region"), "region", "left_semi")


def window_pairs(rows: DataFrame, measured: DataFrame, chosen: DataFrame, pivots: int | None) -> tuple[DataFrame, DataFrame]:
    """(a, b) to be compared next in the open regions ``rows``, and the regions that have more:
    at most ``pivots`` members, or all, against the members of other components whose sizes and
    count vectors allow a link and that lie in the triangle window where both have the same
    first pivot. Regions with few such pairs give them all at once."""
    known = F.when(F.col("pivot") == F.col("sid"), 0.0).otherwise(F.coalesce("distance", F.lit(-1.0)))
    joined = rows.join(chosen.select("sid", "counts"), "sid").join(measured.select(F.col("a").alias("pivot"), F.col("b").alias("sid"), "distance"), ["pivot", "sid"], "left")
    member = F.struct("at", "sid", "n", "indexed", "pivot", "part", known.alias("distance"), "counts")
    again = joined.groupBy("region").agg(F.sort_array(F.collect_list(member)).alias("m"))
    fields = [F.col(f"m.{c}").alias(c) for c in ("sid", "n", "indexed", "pivot", "part", "distance", "counts")]

    def run(batches):
        for batch in batches:
            left, right, more = [], [], []
            vectors = batch.column(6)
            for row, members in enumerate(lists(batch, ("sid", "n", "indexed", "pivot", "part", "distance"))):
                x = np.frombuffer(b"".join(vectors[row].as_py()), np.uint8).reshape(-1, CLASSES).astype(np.int16)
                a, b, whole = near_members(*members, x, pivots)
                left.append(a)
                right.append(b)
                if not whole:
                    more.append(batch.column(7)[row].as_py())
            pairs = pairs_of(left, right)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.record_batch([pairs.column(0), pairs.column(1), none], names=["a", "b", "region"])
            none = pa.nulls(len(more), pa.int64())
            yield pa.record_batch([none, none, pa.array(more, pa.int64())], names=["a", "b", "region"])

    found = staged(again.select(*fields, "region").mapInArrow(run, "a long, b long, region long"), "windows")
    return found.where("region IS NULL").select("a", "b").distinct(), found.where("region IS NOT NULL").select("region")


def near_members(sid, n, indexed, pivot, part, distance, x, pivots: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (smaller set, larger set) of the pivots and the members near them, and whether
    these are all pairs of the region.

    Members are ordered by size. If ``pivots`` is None all are pivots, also if there are few
    pairs in all. Otherwise those are chosen, one after the other, that have most near members
    not yet near a chosen one.
    """

    def partners(i: int) -> np.ndarray:
        j = np.arange(np.searchsorted(n, -(-n[i] * NUM // DEN)), np.searchsorted(n, n[i] * DEN // NUM, side="right"))
        far = (pivot[j] == pivot[i]) & (distance[i] >= 0) & (distance[j] >= 0) & (np.abs(distance[j] - distance[i]) > 1 - NUM / DEN + 1e-9)
        marked = np.where(j < i, indexed[j], indexed[i])
        j = j[marked & (part[j] != part[i]) & ~far & (pivot[j] != sid[i]) & (pivot[i] != sid[j])]
        return j[may_link(x[j], x[i], n[j] + n[i])]

    whole = pivots is None or len(sid) <= TRIED
    if whole:
        found = [(i, (j := partners(i))[j > i]) for i in np.flatnonzero(indexed).tolist()]
        whole = pivots is None or sum(len(j) for _, j in found) <= pivots * len(sid)
    if not whole:
        tried = np.argsort(mix64(sid.view(np.uint64)))[:TRIED].tolist()
        near = {i: partners(i) for i in tried}
        covered, found = np.zeros(len(sid), bool), []
        while len(found) < pivots and near:
            best = max(near, key=lambda i: (~covered[near[i]]).sum())
            j = near.pop(best)
            if covered[j].all():
                break
            covered[j] = True
            found.append((best, j))
    none = np.zeros(0, np.int64)
    i = np.concatenate([none, *(np.full(len(j), i) for i, j in found)])
    j = np.concatenate([none, *(j for _, j in found)])
    return sid[np.minimum(i, j)], sid[np.maximum(i, j)], whole


def band_pivots(big: DataFrame) -> DataFrame:
    """key (of region and band), pivot: the first set of each band that may be a pair's smaller one."""
    return big.where("indexed").groupBy("key").agg(F.min(F.struct("n", "sid")).alias("p")).select("key", F.col("p.sid").alias("pivot"))


def labelled(big: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of large regions with ``part`` and ``main``, the component of most members of the region."""
    rows = staged(big.join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("part", F.coalesce("component", "sid")).drop("component"), "large-parts")
    by_part = rows.groupBy("region", "part").count().groupBy("region").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.sum("count").alias("total"), F.max("count").alias("most"))
    return staged(skew_join(rows, staged(by_part.where("total > most"), "large-shapes"), "region"), "large-open")


def further_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of at most ``MORE`` pivots of each region and size band, from members outside the
    main component, with the members of other components whose sizes allow a link."""
    outside = rows.where("part <> main").groupBy("region", "band", F.pmod(F.xxhash64("sid"), F.lit(MORE)).alias("of")).agg(F.min(F.struct("n", "sid", "indexed", "part")).alias("p"))
    pivots = outside.select("region", F.col("p.sid").alias("p_sid"), F.col("p.n").alias("p_n"), F.col("p.indexed").alias("p_indexed"), F.col("p.part").alias("p_part"))
    first = (F.col("n") < F.col("p_n")) | ((F.col("n") == F.col("p_n")) & (F.col("sid") < F.col("p_sid")))  # whether the member is the smaller set
    met = skew_join(rows.select("region", "sid", "n", "indexed", "part"), staged(pivots, "further-pivots"), "region").where(
        (F.col("part") != F.col("p_part")) & (DEN * F.least("n", "p_n") >= NUM * F.greatest("n", "p_n")) & F.when(first, F.col("indexed")).otherwise(F.col("p_indexed"))
    )
    return met.select(F.when(first, F.col("sid")).otherwise(F.col("p_sid")).alias("a"), F.when(first, F.col("p_sid")).otherwise(F.col("sid")).alias("b")).distinct()


def block_pairs(rows: DataFrame, measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """As ``window_pairs`` with all members, for large regions: members outside a region's main
    component against all, in blocks. The main component's own pairs need no comparison."""
    members = rows.join(chosen.select("sid", "brief"), "sid").join(measured.select(F.col("a").alias("pivot"), F.col("b").alias("sid"), "distance"), ["pivot", "sid"], "left")
    known = F.when(F.col("pivot") == F.col("sid"), 0.0).otherwise(F.coalesce("distance", F.lit(-1.0)))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    dealt = members.select(
        "region", "sid", "n", "indexed", F.coalesce("pivot", F.lit(0)).alias("pivot"), "part", "main", known.alias("distance"), "brief",
        blocks(F.col("total") - F.col("most")).alias("outer"), blocks(F.col("total")).alias("all"),
    )
    own = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ["sid", "n", "indexed", "pivot", "part", "distance", "brief"]
    outside = dealt.where(F.col("part") != F.col("main")).select("region", own("outer").alias("x"), every("all").alias("y"), F.lit(True).alias("outside"), *fields)
    inside = dealt.select("region", every("outer").alias("x"), own("all").alias("y"), F.lit(False).alias("outside"), *fields)

    def run(table: pa.Table) -> pa.Table:
        side = table.column("outside").to_numpy()
        sid, n, indexed, pivot, part, distance = (table.column(c).to_numpy() for c in fields[:-1])
        brief = np.frombuffer(b"".join(table.column("brief").to_pylist()), np.uint8).reshape(-1, BRIEF).astype(np.int16)
        right = np.flatnonzero(~side)
        left_sids, right_sids = [], []
        for i in np.flatnonzero(side).tolist():
            first = (n[right] < n[i]) | ((n[right] == n[i]) & (sid[right] < sid[i]))  # whether the other one is the smaller
            marked = np.where(first, indexed[right], indexed[i])
            fits = DEN * np.minimum(n[right], n[i]) >= NUM * np.maximum(n[right], n[i])
            far = (pivot[right] == pivot[i]) & (distance[right] >= 0) & (distance[i] >= 0) & (np.abs(distance[right] - distance[i]) > 1 - NUM / DEN + 1e-9)
            keep = marked & fits & ~far & (part[right] != part[i])
            j, first = right[keep], first[keep]
            near = may_link(brief[j], brief[i], n[j] + n[i])
            j, first = j[near], first[near]
            left_sids.append(np.where(first, sid[j], sid[i]))
            right_sids.append(np.where(first, sid[i], sid[j]))
        return pa.Table.from_batches([pairs_of(left_sids, right_sids)])

    return outside.unionAll(inside).groupBy("region", "x", "y").applyInArrow(run, "a long, b long").distinct()


def with_pivots(batches):
    for batch in batches:
        out: list[tuple[np.ndarray, ...]] = []
        names = batch.column(0).to_numpy()
        for name, (sids, sizes, indexed) in zip(names.tolist(), lists(batch, ("sids", "sizes", "indexed")), strict=True):
            pivot = cells(sizes, indexed)
            out.append((np.full(len(sids), name), np.arange(len(sids), dtype=np.int32), sids, sizes, indexed, np.where(pivot >= 0, sids[pivot], 0)))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["region", "at", "sid", "n", "indexed", "pivot"])


def may_link(x: np.ndarray, y: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether count vectors leave room for a link of sets with ``total`` shingles together:
    linked sets differ in (DEN - NUM) / (NUM + DEN) of them at most."""
    return (NUM + DEN) * np.abs(x - y).sum(axis=-1, dtype=np.int64) <= (DEN - NUM) * total


def near_pairs(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The pairs whose count vectors are close enough for a link."""
    side = lambda c: chosen.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"counts_{c}"))

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16) for i in (4, 5))
            keep = pa.array(may_link(x, y, batch.column(2).to_numpy() + batch.column(3).to_numpy()))
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    pairs = staged(pairs, "pairs")
    joined = skew_join(skew_join(pairs, side("a"), "a"), side("b"), "b", hot=hot_keys(pairs, "b")).select("a", "b", "n_a", "n_b", "counts_a", "counts_b")
    return staged(joined.mapInArrow(run, "a long, b long"), "near-pairs")


def fetched(text: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and text of the wanted sets (sid, doc_id, text_key), each once.

    Up to FEW wanted rows are broadcast, counted first, so that the texts stay where they
    are; more of them are joined by shuffle.
    """
    wanted = staged(wanted.select("sid", F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")), "wanted")
    small = wanted.count() <= FEW
    same = text.doc_id.eqNullSafe(F.col("_doc")) & (text.text_key == F.col("_key"))
    return text.join(F.broadcast(wanted) if small else wanted, same).select("sid", "text").dropDuplicates(["sid"])


def compare(pairs: DataFrame, chosen: DataFrame, text: DataFrame) -> DataFrame:
    """(a, b, distance, linked): exact Jaccard distances from the shingles of both texts."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    texts = staged(fetched(text, chosen.join(needed, "sid")), "near-texts")
    one = texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                x, cx = shingle_hashes(part.column(2))
                y, cy = shingle_hashes(part.column(3))
                shared, total = [], []
                for i in range(part.num_rows):
                    u, v = np.unique(x[cx[i] : cx[i + 1]]), np.unique(y[cy[i] : cy[i + 1]])
                    m = np.sort(np.concatenate([u, v]))
                    k = int((m[1:] == m[:-1]).sum())
                    shared.append(k)
                    total.append(len(m) - k)
                k, n = np.array(shared, np.int64), np.array(total, np.int64)
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(1 - k / np.maximum(n, 1)), pa.array((DEN * k >= NUM * n) & (n > 0))],
                    names=["a", "b", "distance", "linked"],
                )

    joined = skew_join(skew_join(pairs, one, "a"), two, "b", hot=hot_keys(pairs, "b")).select("a", "b", "text_a", "text_b")
    return staged(joined.mapInArrow(run, "a long, b long, distance double, linked boolean"), "distances")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))


def document_roots(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n, root per document (the same root: linked; null: no shingles), written."""
    with scratch():
        text = keyed(docs)
        frequent = docs.sparkSession.sparkContext.broadcast(frequent_counters(text))
        with scratch():  # prefixes and vectors of all sets go when regions and their sets are laid down
            held = staged(sets(text, frequent), "shingle-sets")
            named = staged(held.select("doc_id", "text_key", "n", "sid"), "set-names", keep=True)
            found, big = regions(held)
            found, big = staged(found, "regions", keep=True), staged(big, "large-regions-rows", keep=True)
            needed = found.select(F.explode("sids").alias("sid")).unionAll(big.select("sid")).distinct()
            carriers = held.where(F.size("prefix") > 0).select("doc_id", "text_key", "sid", "n", "counts", "brief")
            chosen = carriers.join(needed, "sid").groupBy("sid").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.any_value("n").alias("n"), F.any_value("counts").alias("counts"), F.any_value("brief").alias("brief"))
            chosen = staged(chosen.select("sid", "n", "counts", "brief", "one.doc_id", "one.text_key"), "region-sets", keep=True)
        any_big = not big.isEmpty()
        pairs = pivot_pairs(found)
        if any_big:
            banded = staged(big.withColumn("key", F.xxhash64("region", "band")), "large-bands")
            pivots = staged(band_pivots(banded), "band-pivots")
            big = staged(skew_join(banded, pivots, "key", "left").drop("key"), "large-pivots")
            pairs = pairs.unionAll(big.where("sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b"))).distinct()
        measured = compare(near_pairs(pairs, chosen), chosen, text)
        parts = components(measured.where("linked").select("a", "b"))
        rows = staged(open_regions(member_rows(found), parts), "open-regions")
        for pivots in (MORE, None):
            pairs, more = window_pairs(rows, measured, chosen, pivots)
            if any_big:
                wide = labelled(big, parts)
                beyond = block_pairs(wide, measured, chosen) if pivots is None else further_pairs(wide)
                pairs = pairs.unionAll(near_pairs(beyond, chosen)).distinct()
            pairs = staged(pairs, "open-pairs")
            if not pairs.isEmpty():
                new = compare(pairs.join(measured.select("a", "b"), ["a", "b"], "left_anti"), chosen, text)
                measured = measured.unionAll(new)
                parts = components(measured.where("linked").select("a", "b"))
            if pivots is not None:
                rows = staged(open_regions(rows.drop("part").join(more, "region", "left_semi"), parts), "open-regions")
        linked = skew_join(named.where("n > 0"), staged(parts, "parts").withColumnRenamed("node", "sid"), "sid", "left")
        linked = linked.select("doc_id", "text_key", "n", F.coalesce("component", "sid").alias("root"))
        return staged(linked.unionAll(named.where("n = 0").select("doc_id", "text_key", "n", F.lit(None).cast("long").alias("root"))), "roots", keep=True)


def link_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reached by links).

    Null and blank texts have empty sets and link with nothing, not even each other. Texts
    with equal sets link. Rows that repeat a doc_id are documents of their own and share the
    id; a null doc_id takes part, and a component of null ids only gets null.
    """
    roots = document_roots(docs)
    least = staged(roots.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    linked = skew_join(roots.where("root IS NOT NULL"), least, "root").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return linked.unionAll(roots.where("root IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, one of smallest id; all columns stay.

    Null ids come last, ties go by the text's hash. Texts without words are all kept, but of
    rows that repeat both id and text one is kept, whatever its other columns are.
    """
    roots = document_roots(docs)
    least = roots.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("one"))
    kept = least.select("one.doc_id", "one.text_key").unionAll(roots.where("root IS NULL").select("doc_id", "text_key").distinct())
    row = F.xxhash64("doc_id", "text_key")
    again = staged(roots.groupBy("doc_id", "text_key").count().where("count > 1").select(row.alias("row")).distinct(), "again")
    doc, key, at = (free_name(x, docs.columns) for x in ("doc", "key", "row"))
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    ours = docs.withColumns({key: text_key, at: F.xxhash64(F.col("doc_id").cast("long"), text_key)})
    kept = staged(kept.select(F.col("doc_id").alias(doc), F.col("text_key").alias(f"{key}2"), row.alias(at)), "kept")
    found = skew_join(ours, kept, at, hot=hot_keys(roots.select(row.alias(at)), at)).where(F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(f"{key}2")))
    if again.isEmpty():
        return found.select(*docs.columns)
    found = staged(found.drop(doc, f"{key}2"), "found")
    again = again.withColumnRenamed("row", at)
    once = skew_join(found, again.withColumn(doc, F.lit(True)), at, "left")
    return once.where(F.col(doc).isNull()).select(*docs.columns).unionAll(once.where(F.col(doc)).dropDuplicates(["doc_id", key]).select(*docs.columns))
