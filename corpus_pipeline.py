"""A training-data pipeline over ``documents``: five stages, each one of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.llm import decontamination, jaccard_join, language_id, sentencepiece_backend, suffix_dedup
from loamlog.llm.common import scratch, staged, table
from loamlog.llm.queries import tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some learned language accounts for.

    A text goes if it has no letter, or if even the best language's parse breaks more often
    than at every second symbol. If no language was learned only texts without a letter go.
    """
    labelled = docs.where(~language_id.held_out(F.col("doc_id"), 4, 2))
    known = language_id.identify(docs, labelled, into=("_language", "_language_score", "_language_breaks"))
    return known.where(F.col("_language_breaks") <= language_id.MOST_BREAKS).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id; a row that repeats
    another's id and text goes too. Texts without words are no near-duplicates."""
    return jaccard_join.keep_one(docs)


#: Bytes of a passage that goes where it occurs again: some 50 short words.
REPEAT = 256


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occurred before in what the stage gets, by document and
    place: the first copy of a passage stays, and no word is cut. What becomes blank goes. Null
    and empty texts stay."""
    cut = suffix_dedup.drop_repeats(docs, REPEAT, keep_first=True)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))) if "n_chars" in cut.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; null texts hold none."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of each whole text (null: none), whether both libraries agree on
    them and whether they decode to the text again."""
    out = sentencepiece_backend.encode_column(docs, tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "parity", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: Language models, similarity joins and tokens are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage staged for itself goes once it is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch():
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs
