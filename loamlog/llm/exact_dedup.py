"""Exact duplicates by a tree merge of sorted digest runs, with DataFrame operations alone.

Each input partition makes a run: one entry per different text, sorted by a 64-bit digest, with
the smallest identifier and the number of rows. In a binomial round the runs of 2^BITS
neighbouring numbers are merged: they exchange slices of the digest range, as many slices as
runs take part, so every task holds one slice of one merged run and no task ever holds a whole
one. A round keeps, of entries with equal digest, SHA-256 and length, the smallest identifier
and the sum of the counts; entries that share only the digest stay apart. After the last round
there is one run, and its entries go back down to the rows.

A text that fills a third of the table is one entry a run from the first step on, so no join
or merge meets more than a partition's rows, or one row a run, under one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import free_name, scratch, staged

#: Binomial rounds that are merged at once: 2^4 runs meet.
BITS = 4
#: What an entry is known by: the digest that runs are sorted by, and what verifies it.
ENTRY = ["digest", "sha", "n_bytes"]


def one_spaced(text: Column) -> Column:
    """The text with each run of blanks (20, 09-0D) as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_rows(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """id, uid, run, digest, sha, n_bytes of each row: the runs, written sorted.

    The number of a row (``uid``) and of its run come from the partition that wrote it; they
    are read from what was written ever after, so a lost task cannot change them.
    """
    normal = rows.select(F.col(id_).alias("id"), one_spaced(F.col(text)).alias("normal"))
    out = normal.select(
        "id",
        F.monotonically_increasing_id().alias("uid"),
        F.spark_partition_id().alias("run"),
        F.xxhash64("normal").alias("digest"),
        F.unhex(F.sha2(F.col("normal").cast("binary"), 256)).alias("sha"),
        F.octet_length("normal").cast("long").alias("n_bytes"),
    )
    return staged(out.sortWithinPartitions(*ENTRY), "digest-rows")


def merge_round(entries: DataFrame, level: int) -> DataFrame:
    """Merges the runs of 2^BITS neighbours, slice by slice of the digest range."""
    slice_ = F.shiftrightunsigned("digest", max(0, 64 - BITS * level)).cast("long")
    dealt = entries.withColumn("run", F.shiftright("run", BITS)).withColumn("slice", slice_)
    keys = ["run", "slice", *ENTRY]
    met = dealt.repartition("run", "slice").sortWithinPartitions(*keys)
    return met.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("size").alias("size")).drop("slice")


def duplicate_classes(rows: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: the id, keep_id, group_size, kept, sha (binary), n_bytes.

    Texts are equal when they are identical with each run of blanks as one space; a null text
    is an empty one. Of equal texts the row with the smallest id stays: an id that is not null
    before a null one, and of rows that share id and text the one read first. ``keep_id`` is
    null where all ids of the class are. An empty table gives an empty result; other columns
    are not touched.
    """
    with scratch():
        own = digest_rows(rows, id_, text)
        last = own.agg(F.max("run")).first()[0] or 0
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")
        runs = staged(own.groupBy("run", *ENTRY).agg(first, F.count("*").alias("size")), "digest-runs")
        merged, level = runs, 0
        while last >> (BITS * level):
            level += 1
            merged = merge_round(merged, level)
        whole = merged.where("size > 1").select(*ENTRY, "first", "size")
        # down again: an entry of a run is met by one row of the merged run, a row by one entry
        down = runs.select("run", *ENTRY).join(whole, ENTRY)
        out = own.join(down, ["run", *ENTRY], "left")
        kept = F.coalesce(F.col("first.uid") == F.col("uid"), F.lit(True))
        result = staged(
            out.select(
                F.col("id").alias(id_),
                F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
                F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "sha", "n_bytes",
            ),
            "exact-classes", keep=True,
        )
    return result


def drop_copies(rows: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that share id and text one stays."""
    key, sha = free_name("id", rows.columns), free_name("sha", rows.columns)
    classes = duplicate_classes(rows, id_, text).where("NOT kept")
    same = F.col(id_).eqNullSafe(F.col("keep_id"))
    named = classes.select(F.col(id_).alias(key), F.col("sha").alias(sha), same.alias("same")).distinct()
    held = rows.withColumn(sha, F.unhex(F.sha2(one_spaced(F.col(text)).cast("binary"), 256)))

    def meets(other: DataFrame) -> Column:
        return held[id_].eqNullSafe(other[key]) & (held[sha] == other[sha])

    again, copies = named.where("same"), named.where("NOT same")
    once = held.join(again, meets(again), "left_semi").dropDuplicates([id_, sha])
    return held.join(named, meets(named), "left_anti").unionByName(once.join(copies, once[sha].eqNullSafe(copies[sha]) & once[id_].eqNullSafe(copies[key]), "left_anti")).drop(sha)


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (lower-case hex of the normalised text)."""
    out = duplicate_classes(docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
