"""Near-duplicate vectors by an exact metric range join.

Unit vectors lie on a sphere where cosine >= c means distance <= sqrt(2 - 2c). Pivots cut each
label's vectors into Voronoi cells. The triangle inequality, and its sharper form for two
pivots in a Euclidean space (the distance to the plane between them), tell which vectors can
have a partner beyond the border. Of each two cells one takes the other's, and each cell then
joins on its own. Cells of one label that fit in a task are joined in the same one, which gets
each vector once, with the cells that it stands in.
"""

from __future__ import annotations

import math
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from loamlog.llm.common import components, scratch, skew_join, staged

#: Vectors of a cell from which on it may get pivots of its own, vectors that a task compares
#: with as many others, their bytes at most, and pivots of a round over all cells: 2048 vectors
#: are what is broadcast at most.
CELL, BLOCK, BLOCK_BYTES, PIVOTS = 4096, 131_072, 1 << 25, 2048
#: Every label is parted, by this many pivots; below as many vectors a cell there is nothing to
#: part. Rounds in which large cells may get pivots of their own, and in how many of the new
#: cells a vector may stand on average, by a sample of SAMPLE vectors at least.
FEWEST, ROUNDS, COPIES, SAMPLE = 4, 4, 1.25, 32
#: Rounding of distances: pairs this much further apart are compared as well.
SLACK = 1e-7
#: Vectors by vectors that are multiplied at a time.
TILE = 256, 4096


def dimension(group: str) -> int:
    """Of the vectors of a group, cell or task: their names begin with label and dimension."""
    return int(group.split("/")[1])


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """The vectors of n components, in the type that they have in their table."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        if len(c):
            _, offsets, data = c.cast(pa.large_binary()).buffers()
            at = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]])
    raw = np.concatenate(parts)
    return raw.view(f"f{len(raw) // (len(column) * n)}").reshape(len(column), n)


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def usable_vectors(column: pa.Array, kind: type) -> tuple[list[bytes | None], list[int]]:
    """Components as bytes, and dimensions; None where a vector is null, zero, empty, or holds
    null or non-finite components."""
    sizes = pa.compute.list_value_length(column)
    flat = column.flatten()
    if len(column) and not column.null_count and not flat.null_count and pa.compute.min(sizes).as_py() == pa.compute.max(sizes).as_py() != 0:
        x = flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        return [row.tobytes() if ok else None for row, ok in zip(x, good.tolist(), strict=True)], np.where(good, x.shape[1], 0).tolist()
    out, sizes = [], []
    for v in column:
        x = np.zeros(0) if not v.is_valid else np.array([np.nan if c is None else c for c in v.as_py()], kind)
        good = np.isfinite(x).all() and x.any()
        out.append(x.tobytes() if good else None)
        sizes.append(len(x) if good else 0)
    return out, sizes


def prepared(vectors: DataFrame) -> DataFrame:
    """uid, vec_id, grp (label and dimension; null: links with nothing), vec (bytes of the
    components), and away, task and blocks as ``into_cells`` takes them."""
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else np.float64

    def run(batches):
        for batch in batches:
            labels = batch.column(1).to_pylist()
            held, sizes = usable_vectors(batch.column(2), kind)
            groups = [None if v is None or k is None else f"{quote(k, safe='')}/{n}" for v, k, n in zip(held, labels, sizes, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(groups, pa.string()), pa.array(held, pa.binary())], names=["vec_id", "grp", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding").mapInArrow(run, "vec_id long, grp string, vec binary")
    rows = staged(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    return rows.withColumns({"away": F.lit(0), "task": F.lit(None).cast("string"), "blocks": F.lit(None).cast("int")})


def reached(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of each unit vector, and in which cells it stands: its own, and those that
    take vectors of that one and may hold a partner of it. Of two cells one takes the other's,
    so partners meet in one of them."""
    n, every = np.arange(len(pivots)), np.arange(len(x))
    square = np.maximum(2 - 2 * (x @ pivots.T), 0)
    own = square.argmin(axis=1)
    best = square[every, own]
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 1e-12))[own]
    near = (np.sqrt(square) - np.sqrt(best)[:, None] <= 2 * reach) & ((square - best[:, None]) / (2 * apart) <= reach)
    ahead = 2 * ((n[None, :] - n[:, None]) % len(pivots))
    near &= ((ahead < len(pivots)) | (ahead == len(pivots)) & (n[:, None] < n[None, :]))[own]
    near[every, own] = True
    return own, near


def choose_pivots(rows: DataFrame, reach: float | None = None) -> dict[str, np.ndarray]:
    """Pivots of groups, spread out greedily over a bounded sample.

    At first (no ``reach``) every group gets FEWEST, except that the smallest of very many groups
    stay whole. Later a group of more than CELL vectors gets pivots by its size, or fewer, as
    long as vectors then stand in COPIES cells on average; else none, since parting it would
    copy its vectors and save few comparisons. What stays large is cut into blocks.
    """
    least = FEWEST * FEWEST if reach is None else CELL + 1
    sizes = rows.groupBy("grp").count().where(F.col("count") >= least).orderBy(F.desc("count"), "grp").limit(PIVOTS // (2 * FEWEST)).collect()
    if not sizes:
        return {}
    total = sum(math.ceil(r["count"] / CELL) for r in sizes)
    by_size = {r["grp"]: math.floor(math.ceil(r["count"] / CELL) * min(1.0, PIVOTS / 2 / total)) for r in sizes}
    wanted = {g: FEWEST if reach is None else max(FEWEST, n) for g, n in by_size.items()}
    chance = F.create_map(*[x for r in sizes for x in (F.lit(r["grp"]), F.lit(min(1.0, max(4 * wanted[r["grp"]], SAMPLE) / r["count"])))])
    drawn = F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) / float(1 << 30)
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in rows.where(drawn < chance[F.col("grp")]).select("grp", "uid", "vec").collect():
        found.setdefault(r["grp"], []).append((r["uid"], bytes(r["vec"])))
    out = {}
    for group, held in found.items():
        x = unit(matrix(pa.array([v for _, v in sorted(held)], pa.binary()), dimension(group)))
        chosen, far = [0], 2 - 2 * (x @ x[0])
        while len(chosen) < min(wanted[group], len(x)) and far.max() > SLACK:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, 2 - 2 * (x @ x[chosen[-1]]))
        while reach is not None and len(chosen) > 1 and reached(x, x[chosen], reach)[1].sum() > COPIES * len(x):
            chosen = chosen[: len(chosen) // 2]
        if reach is None or len(chosen) > 1:
            out[group] = x[chosen]
    return out


def into_cells(rows: DataFrame, pivots: dict[str, np.ndarray], reach: float) -> DataFrame:
    """cell, home, away, task, blocks, uid, vec: each vector in its own cell, and in those that take it.

    ``away`` has a bit for each round in which the vector came to a cell that is not its own.
    Two vectors that both came so in one round stood together before it, in the cell where
    they met; all others of a cell meet there. ``home``: no such bit.
    """
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            groups, before = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
            cells, away, take = [], [], []
            for group in sorted(set(groups.tolist())):
                at = np.flatnonzero(groups == group)
                p = held.value.get(group)
                if p is None:
                    cells += [group] * len(at)
                    away += before[at].tolist()
                    take += at.tolist()
                    continue
                own, near = reached(unit(matrix(batch.column(5).take(pa.array(at)), dimension(group))), p, reach)
                i, j = np.nonzero(near)
                cells += [f"{group}/{c}" for c in j.tolist()]
                away += (before[at[i]] | (own[i] != j) * (1 << (group.count("/") - 1))).tolist()
                take += at[i].tolist()
            index = pa.array(take, pa.int64())
            yield pa.record_batch(
                [pa.array(cells, pa.string()), pa.array(away, pa.int32()), *[batch.column(k).take(index) for k in (2, 3, 4, 5)]],
                names=["cell", "away", "task", "blocks", "uid", "vec"],
            )

    cells = rows.select("grp", "away", "task", "blocks", "uid", "vec").mapInArrow(run, "cell string, away int, task string, blocks int, uid long, vec binary")
    return cells.withColumn("home", F.col("away") == 0)


def too_large(rows: DataFrame) -> dict[str, int]:
    """Groups without a task that no single task can take, and the blocks that they need: one
    entry for each BLOCK vectors at most."""
    most = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / F.first(F.octet_length("vec")))))
    sizes = rows.where("task IS NULL").groupBy("grp").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    return {r["grp"]: r["blocks"] for r in sizes.where("blocks > 1").collect()}


def split(rows: DataFrame, reach: float) -> DataFrame:
    """cell, home, away, task, blocks, uid, vec of all rows that ``prepared`` made: labels in cells,
    and large cells in cells of their own, as long as few vectors stand in several of them.

    ``task`` is the label, or where it is too large for one task and cells part it well, the first
    cell on the way down that is not; what is too large and not parted well is a task of several
    ``blocks``. No vector is written here: cells follow from the pivots whenever they are read.
    """
    left, waiting = rows.where("grp IS NOT NULL").withColumn("home", F.lit(True)), []
    for turn in range(ROUNDS + 1):
        large = too_large(left) if waiting or not turn else {}
        pivots = choose_pivots(left, reach if turn else None) if turn < ROUNDS else {}
        well = choose_pivots(left.where(F.col("grp").isin(list(large))), reach) if large and not turn else pivots
        waiting = [g for g in large if g in well and g in pivots]
        cut = F.create_map(*[F.lit(x) for e in large.items() for x in e])[F.col("grp")] if large else F.lit(None).cast("int")
        here = F.col("task").isNull() & ~F.col("grp").isin(waiting)
        left = left.withColumns({"blocks": F.when(here, F.coalesce(cut, F.lit(1))).otherwise(F.col("blocks")), "task": F.when(here, F.col("grp")).otherwise(F.col("task"))})
        if not pivots:
            break
        left = into_cells(left, pivots, reach).withColumnRenamed("cell", "grp")
    return left.withColumnRenamed("grp", "cell")


def packed(cells: DataFrame) -> DataFrame:
    """task, blocks, uid, vec, cells (names within the task), away: a vector's rows of one task in
    one row, as far as they stand in one batch; else its vector goes there more than once."""

    def run(batches):
        for batch in batches:
            task, uid = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(2).to_numpy()
            order = np.lexsort((uid, task))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(task[order]) != 0) | (np.diff(uid[order]) != 0)
            first, all_ = pa.array(order[new]), pa.array(order)
            offsets = pa.array(np.append(np.flatnonzero(new), len(order)), pa.int32())
            yield pa.record_batch(
                [*[batch.column(k).take(first) for k in range(4)], *[pa.ListArray.from_arrays(offsets, batch.column(k).take(all_)) for k in (4, 5)]],
                names=["task", "blocks", "uid", "vec", "cells", "away"],
            )

    rows = cells.select("task", "blocks", "uid", "vec", F.expr("substring(cell, length(task) + 1)").alias("cell"), "away")
    return rows.mapInArrow(run, "task string, blocks int, uid long, vec binary, cells array<string>, away array<int>")


def meetings(cell: np.ndarray, side: np.ndarray, away: np.ndarray):
    """Pairs of slices that are to be compared, and whether the two are one, of rows in this order.

    Rows of side 0 meet all of their cell, those of side 1 only those of side 2.
    """
    new = np.ones(len(cell), bool)
    new[1:] = (np.diff(cell) != 0) | (np.diff(side) != 0) | (np.diff(away) != 0)
    starts = np.flatnonzero(new)
    kinds = list(zip(cell[starts].tolist(), side[starts].tolist(), away[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True))
    for k, (c, s, a, start, end) in enumerate(kinds):
        for c2, s2, a2, start2, end2 in kinds[k:]:
            if c2 != c:
                break
            if not a & a2 and (s == 0 or s != s2):
                yield slice(start, end), slice(start2, end2), start == start2


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots of all after the roots a and b were joined pair by pair; the smaller one stays."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for pair in np.unique(np.minimum(a, b) * len(root) + np.maximum(a, b)).tolist():
        lo, hi = sorted(map(find, divmod(pair, len(root))))
        up[hi] = lo
    to = np.arange(len(root))
    to[list(up)] = [find(x) for x in list(up)]
    return to[root]


def join_block(least: float):
    """Compares the vectors of a task, cell by cell: how many partners each has there, and edges
    to each vector from the smallest one of its component within the task.

    Products in single precision, with room for their rounding, tell what may link; that is
    decided in double precision.
    """

    def run(table: pa.Table) -> pa.Table:
        n = dimension(table.column("task")[0].as_py())
        vectors = matrix(table.column("vec"), n)
        x = np.empty(vectors.shape, np.float32)
        for i in range(0, len(x), TILE[1]):
            x[i : i + TILE[1]] = unit(vectors[i : i + TILE[1]])
        below = np.float32(least - (n + 4) * 2.0**-23)
        known, who = np.unique(table.column("uid").to_numpy(), return_inverse=True)
        cells, away = table.column("cells").combine_chunks(), table.column("away").combine_chunks().flatten().to_numpy()
        row = np.repeat(np.arange(len(cells)), pa.compute.list_value_length(cells).to_numpy())
        cell, side = cells.flatten().dictionary_encode().indices.to_numpy(), table.column("side").to_numpy()[row]
        order = np.lexsort((row, away, side, cell))
        row = row[order]
        links, root = np.zeros(len(known), np.int64), np.arange(len(known))
        for a, b, one in meetings(cell[order], side[order], away[order]):
            ra, rb = row[a], row[b]
            xa, xb = x[ra], x[rb]
            for i in range(0, len(ra), TILE[0]):
                for j in range(i if one else 0, len(rb), TILE[1]):
                    near = xa[i : i + TILE[0]] @ xb[j : j + TILE[1]].T >= below
                    if not near.any():
                        continue
                    p, q = i + np.flatnonzero(near.any(axis=1)), j + np.flatnonzero(near.any(axis=0))
                    linked = unit(vectors[ra[p]]) @ unit(vectors[rb[q]]).T >= least
                    if one:
                        linked &= p[:, None] < q[None, :]
                    wp, wq = who[ra[p]], who[rb[q]]
                    links[wp] += linked.sum(axis=1)
                    links[wq] += linked.sum(axis=0)
                    k, m = np.nonzero(linked & (root[wp][:, None] != root[wq][None, :]))
                    if len(k):
                        root = merged(root, root[wp[k]], root[wq[m]])
        counted, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        return pa.table(
            {
                "kind": pa.array(np.repeat(np.array([0, 1], np.int32), [len(counted), len(moved)])),
                "a": pa.array(np.concatenate([known[counted], known[root[moved]]])),
                "b": pa.array(np.concatenate([links[counted], known[moved]])),
            }
        )

    return run


def link_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine, in doubles, is at
    least ``least``. Rows that repeat a vec_id are vectors of their own. A null vec_id takes
    part; a component's id is its smallest id that is not null. Only vectors of one
    dimension are compared. An empty table gives an empty result.
    """
    with scratch():
        rows = prepared(vectors)
        dealt = packed(split(rows, math.sqrt(2 - 2 * least) + SLACK))
        own = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
        keys = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda j: F.struct(
                F.least(j, F.col("own")).alias("lo"), F.greatest(j, F.col("own")).alias("hi"),
                F.when(j == F.col("own"), 0).when(F.col("own") < j, 1).otherwise(2).alias("side"),
            ),
        )
        pairs = dealt.withColumn("own", own).select("task", "uid", "vec", "cells", "away", F.explode(keys).alias("k"))
        pairs = pairs.select("task", "k.lo", "k.hi", "k.side", "uid", "vec", "cells", "away")
        found = staged(pairs.groupBy("task", "lo", "hi").applyInArrow(join_block(least), "kind int, a long, b long"), "vector-links")
        counts = found.where("kind = 0").groupBy(F.col("a").alias("uid")).agg(F.sum("b").alias("n_links"))
        linked = components(found.where("kind = 1").select("a", "b")).select(F.col("node").alias("uid"), F.col("component").alias("root"))
        named = rows.select("uid", "vec_id").join(counts, "uid", "left").join(linked, "uid", "left")
        named = staged(named.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "uid").alias("root")), "vector-roots", keep=True)
        least_id = staged(named.groupBy("root").agg(F.min("vec_id").alias("component_id")), "vector-least", keep=True)
    return skew_join(named, least_id, "root").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
