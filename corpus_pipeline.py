"""Corpus pipeline: five stages over ``documents``, each one an operator of ``potluck.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its
result is written as Parquet in the shared folder and read again as the next one's docs.
All stages but the last return the columns of ``documents``. Extra columns of ``docs`` are
left out. Every stage keeps rows without an id, except that language identification
rejects texts whatever their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potluck.llm import lang_id
from potluck.llm.common import DOC_COLUMNS, checkpointed, documents, release
from potluck.llm.jaccard_join import one_per_group
from potluck.llm.piece_bpe import piece_encode
from potluck.llm.poisson_mix import poisson_mix
from potluck.llm.queries import piece_model
from potluck.llm.substring_dedup import substring_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the texts that language identification rejects; fills in missing languages."""
    model = lang_id.train(docs, lang_id.fold("doc_id", 4) != 2)
    found = lang_id.identify(docs, model, carry=["lang", "source", "n_chars"], keep_text=True)
    return found.where("not rejected").select(
        "doc_id", "text", F.coalesce("carry.lang", "lang_pred").alias("lang"), "carry.source", "carry.n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, of its smallest id.

    Rows that share an id but not a text are documents of their own, each in its own group. Of
    rows with the same id and the same shingles one stays, of rows with the same id and no
    words one; rows without an id all stay."""
    found = one_per_group(docs, carry=["lang", "source", "n_chars"])
    return found.select("doc_id", "text", "carry.lang", "carry.source", "carry.n_chars")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the passages that an earlier document holds; other texts stay as they are."""
    found = substring_dedup(docs, carry=["lang", "source", "n_chars"], with_text=True)
    return found.select(
        "doc_id", F.col("kept_text").alias("text"), "carry.lang", "carry.source",
        F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("carry.n_chars")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that the sources reach their target weights, in shuffled order."""
    return poisson_mix(docs, columns=DOC_COLUMNS).select(*[F.col(f"row.{c}").alias(c) for c in DOC_COLUMNS])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the end id."""
    return piece_encode(docs, piece_model(), carry=["lang", "source"], outputs=("ids",)).select(
        "doc_id", "carry.lang", "carry.source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("lang_id", language), ("jaccard_join", near_duplicates), ("substring_dedup", substrings),
          ("poisson_mix", mix), ("piece_bpe", tokens)]

# SQL cannot express the language model, the tokenizer or connected components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, checkpointed(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)                                  # only the last table is read from now on
    return STAGES[-1][1](spark, docs, sf_dir)
