"""Helpers shared by the training-data operators: table reading, staging, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch between Spark and Python at most, and bytes of text that a worker
#: looks at together: its arrays take some hundred times as much.
BATCH_BYTES, SLICE_BYTES = 1 << 20, 450_000


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes: ten thousand rows of long texts would fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (tests in local mode, where driver and executors are one
    machine) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not base:
        base = getattr(sc, "_loamlog_tmp", None)
        if base is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="loamlog-")
            sc._loamlog_tmp = base
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch():
    """Deletes at its end what is staged within it, but for what is staged with ``keep``.

    To be used where all that follows reads kept folders only. A kept folder belongs to the
    scratch around this one, if there is any.
    """
    held: list[str] = []
    _scratch.append(held)
    try:
        yield
    finally:
        _scratch.remove(held)
        for path in held:
            with contextlib.suppress(OSError, ValueError):  # a file system that pyarrow cannot open keeps the folder
                system, inner = filesystem(path)
                system.delete_dir(inner)


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back: lineage is cut there."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, label)
    owners = _scratch[:-1] if keep else _scratch
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filesystem(path: str):
    """pyarrow file system and the path in it, for a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def write_atomically(path: str, blocks) -> int:
    """Writes bytes blocks to a name of this attempt and returns the length; the name is
    used only when the attempt's row arrives, so a lost or repeated attempt leaves a file
    that nothing reads."""
    system, inner = filesystem(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    n = 0
    with system.open_output_stream(inner, compression=None) as out:
        for b in blocks:
            out.write(b)
            n += len(b)
    return n


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: Odd multipliers of the mixing functions (fixed values of splitmix64).
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


#: Odd base of the polynomial hashes, its inverse modulo 2^64, and a value for each byte.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n, kept between calls."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((BASE, INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of value_i * BASE^i, from which any span's hash follows."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def spans_of(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): equal content gives equal values anywhere."""
    inverse = powers(len(sums))[1]
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * GOLDEN)


#: Words of more bytes are hashed each on its own: polynomials modulo 2^64, whatever their base,
#: give some pairs of words of 1,024 bytes and more one value.
LONG_WORD = 255


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, which are spans of ``raw`` that do not overlap."""
    out = spans_of(prefix_sums(BYTE_VALUE[raw]), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


#: ASCII lower case of each byte (A-Z alone change), and the white space bytes 09-0D and 20.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words made of letters and digits; those over 7F belong to other scripts' letters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross the offsets."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts end to end, and the word counts' offsets.

    ``inside`` tells which byte values are part of a word.
    """
    low = LOWER[raw]
    starts, ends = runs(inside[low], offsets)
    return span_hashes(low, starts, ends), np.searchsorted(starts, offsets)


_resident: dict = {}


def resident(kind: str, key, build):
    """What ``build`` makes, kept in this worker until it needs a model of another kind or key:
    a worker serves all stages, and their models would add up."""
    if (kind, key) not in _resident:
        release()
        _resident[kind, key] = build()
    return _resident[kind, key]


def release() -> None:
    """Forgets the model and the scratch arrays that earlier tasks left in this worker."""
    if _resident or len(_powers[0]) > 1:
        _resident.clear()
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        gc.collect()
        trim()


def trim() -> None:
    """Gives freed memory back to the system; workers live on after their largest task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES, model: bool = False, rows: int = 4000):
    """Zero-copy slices of a batch with about ``most`` bytes of text and ``rows`` rows at most each.

    Unless the caller works with a resident ``model``, one left by another stage is freed.
    """
    if not model and _resident:
        release()
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= most or i + 1 - start == rows:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)
    trim()


def bounded_sample(rows: DataFrame, kind: str, hash_: str, most: int) -> list[tuple]:
    """Of each kind (few values, none null) the ``most`` smallest hashes, each once.

    The number of different hashes of a kind is estimated first, which gives a threshold that
    some more than ``most`` pass, so tasks cut their rows before anything is exchanged and no
    kind meets in one task. What the driver gets is bounded by ``most`` a kind.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(kind).agg(F.approx_count_distinct(hash_)).collect()}
    found: dict = {k: [] for k in counts}
    share = {k: 2.0 * most / max(n, 1) for k, n in counts.items()}
    while share:
        limits = {k: min((1 << 63) - 1, int(-(1 << 63) + s * 2.0**64)) if s < 1 else (1 << 63) - 1 for k, s in share.items()}
        cut = F.lit(False)
        for k, limit in limits.items():
            cut = cut | ((F.col(kind) == F.lit(k)) & (F.col(hash_) <= F.lit(limit)))
        for r in rows.where(cut).select(kind, hash_).distinct().collect():
            found[r[0]].append(r[1])
        # a kind of which the estimate let too few pass is asked again
        share = {k: 4 * s for k, s in share.items() if s < 1 and len(found[k]) < most}
        for k in share:
            found[k] = []
    return [(k, h) for k in sorted(found) for h in sorted(found[k])[:most]]


#: A key with more than 1 / HOT of all rows is hot, so there are fewer than HOT of them; their
#: rows are dealt over SALT parts. Below LEAST rows a key is never hot.
HOT, SALT, LEAST = 512, 64, 500


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys of more than 1 / HOT of the rows: fewer than HOT values."""
    counts = rows.groupBy(key).count()
    total = rows.count()
    return [r[0] for r in counts.where(F.col("count") > max(total // HOT, LEAST)).select(key).collect() if r[0] is not None]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``left`` joined to ``right`` by ``key`` ("inner" or "left"), rows of hot keys spread.

    ``left`` may hold a third of its rows under one key; it is counted first, unless ``hot``
    names the keys. ``right`` has few rows a key, which go to all parts of a hot one. A row's
    part follows from the row itself, so a task that runs again deals its rows alike.
    """
    if hot is None:
        hot = hot_keys(left, key)
    if not hot:
        return left.join(right, key, how)
    parted = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*left.columns), F.lit(SALT)).cast("int")).otherwise(0)
    every = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    salt = free_name("salt", [*left.columns, *right.columns])
    return left.withColumn(salt, parted).join(right.withColumn(salt, F.explode(every)), [key, salt], how).drop(salt)


def free_name(stem: str, taken: list[str]) -> str:
    """A column name that no input column has, whatever its case."""
    name, used = f"_{stem}", {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge list (a long, b long), component = smallest node reached.

    Each partition first reduces its own edges to a forest, so what is shuffled is at most
    one row per node and partition. Then large-star and small-star steps alternate until
    the edges no longer change. Only edge counts reach the driver.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    pairs = checkpointed(pairs.mapInArrow(_local_forest, "a long, b long").distinct())
    before = None
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
        large = large.distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(least, "b")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a < b")
            .distinct()
        )
        pairs = checkpointed(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = now


def _local_forest(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 2_000_000:
            yield _forest_rows(parent, find)
            parent.clear()
    yield _forest_rows(parent, find)


def _forest_rows(parent, find):
    nodes = [x for x in list(parent) if find(x) != x]
    return pa.record_batch([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])
