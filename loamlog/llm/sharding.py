"""Uniform global shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows lie in source blocks. How many rows of each block go to each target cell of an exactly
uniform permutation follows a multivariate hypergeometric law, so the matrix of counts is
drawn first, from the block counts alone. Each block then permutes its rows and cuts them by
its matrix row, the rows are exchanged, and each cell permutes what it received. The result
is a uniform permutation, and every cell has exactly the size that was laid down.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlog.llm.common import staged


def cell_sizes(rows: int, shards: int, cells_per_shard: int) -> np.ndarray:
    """Sizes of shards x cells: shards differ by one row at most, and so do a shard's cells."""
    out = np.empty((shards, cells_per_shard), np.int64)
    for s in range(shards):
        own = rows // shards + (s < rows % shards)
        out[s] = own // cells_per_shard + (np.arange(cells_per_shard) < own % cells_per_shard)
    return out


def communication_matrix(block_rows: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """How many rows of each block go to each cell; rows sum to the blocks, columns to the cells."""
    rng = np.random.default_rng(seed)
    left = cells.astype(np.int64).copy()
    out = np.zeros((len(block_rows), len(cells)), np.int64)
    for b, n in enumerate(block_rows):
        if n:
            out[b] = rng.multivariate_hypergeometric(left, int(n), method="marginals")
            left -= out[b]
    return out


#: Rows that a block or a cell should hold, and the least and most blocks (and cells): the matrix
#: has 2048 x 2048 counts at most, 32 MB. Beyond 8.6 billion rows blocks grow instead.
ROWS, FEWEST, MOST = 1 << 22, 256, 2048


def shuffle_into_shards(
    rows: DataFrame, keys: list[str], shards: int = 24, seed: int = 7, blocks: int | None = None, cells_per_shard: int | None = None
) -> DataFrame:
    """``rows`` with ``shard`` int and ``slot`` long, a uniform permutation for ``seed``.

    Shard counts differ by one row at most; slots of a shard are 0, 1, 2, ... without gaps.
    ``keys`` identify rows (nulls allowed); rows that agree in all keys are interchangeable.
    The number of blocks and cells follows the number of rows, which is counted, unless it is
    given. Only the block counts (``blocks`` numbers) come to the driver. An empty table gives
    an empty result. The input should be narrow: texts need not travel to be dealt out.
    """
    key = F.xxhash64(*keys, F.lit(seed)) if keys else F.lit(seed)
    held = staged(rows, "shard-rows")
    wanted = min(MOST, max(FEWEST, -(-held.count() // ROWS)))
    blocks = blocks or wanted
    cells_per_shard = cells_per_shard or max(1, -(-max(wanted, 384) // shards))
    held = held.withColumn("_block", F.pmod(key, F.lit(blocks)).cast("int"))
    counts = np.zeros(blocks, np.int64)
    for r in held.groupBy("_block").count().collect():
        counts[r["_block"]] = r["count"]
    sizes = cell_sizes(int(counts.sum()), shards, cells_per_shard)
    matrix = communication_matrix(counts, sizes.ravel(), seed)
    # One sorted line of numbers holds the cuts of all blocks: block b's start at b * wide.
    wide = int(counts.max(initial=0)) + 1
    cuts = (np.cumsum(matrix, axis=1) + np.arange(blocks)[:, None] * wide).ravel()
    base = (np.cumsum(sizes, axis=1) - sizes).ravel()
    n_cells = sizes.size
    cuts = rows.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def cell_of(block: pd.Series, rank: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts.value, block.to_numpy() * wide + rank.to_numpy(), side="right")
        return pd.Series((at - block.to_numpy().astype(np.int64) * n_cells).astype(np.int32))

    def order(salt: int) -> list[Column]:
        return [F.xxhash64(*keys, F.lit(seed + salt)), *(F.col(k) for k in keys)]

    dealt = held.withColumn("_rank", F.row_number().over(Window.partitionBy("_block").orderBy(*order(1))) - 1)
    dealt = dealt.withColumn("_cell", cell_of("_block", "_rank")).drop("_block", "_rank")
    out = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy(*order(2))) - 1)

    @F.pandas_udf("long")
    def start_of(cell: pd.Series) -> pd.Series:
        return pd.Series(base[cell.to_numpy()])

    return out.select(
        *rows.columns,
        F.floor(F.col("_cell") / cells_per_shard).cast("int").alias("shard"),
        (start_of("_cell") + F.col("_rank")).cast("long").alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 length of the text plus 8; a null text has length 0 and the checksum
    of no bytes. The law is ``rows``: shard counts are at most one apart. Copies, ties and
    null ids are rows like others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    return shuffle_into_shards(rows, ["doc_id", "text_crc32", "size"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
