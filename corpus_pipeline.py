"""Documents made ready for training: toxic ones go, near-duplicates go, repeated passages go, sources are mixed, tokens are counted."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, common, mixing, neardup, substrings, toxicity

#: Vocabulary of the last stage.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a model of the labelled rows among these."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    score = "_" * (1 + max(map(len, docs.columns)))  # longer than any name of theirs
    return toxicity.add_scores(docs, model, column=score).where(F.col(score) < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that occur more than once."""
    out = substrings.remove(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight, a document once for each time that it is taken."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and offsets."""
    return bpe.encode(docs, RANKS, keep=["doc_id", "lang", "source"], ids=True)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("substring_dedup", repeated_passages), ("mixing", mixed), ("byte_bpe", encoded)]

#: A trained model isn't SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.work_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
