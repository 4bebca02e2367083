"""A training-data pipeline: toxicity, near duplicates, exact repeats, benchmark passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, packing, simhash, suffixes, toxicity
from quillon.llm.common import written
from quillon.llm.queries import table, training_labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.7; null and empty texts stay."""
    scorer = toxicity.fit(training_labels(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep(docs, scorer)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five-word shingles); texts without words are one group."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur elsewhere too; what is left, even nothing, stays, and null texts stay null."""
    return suffixes.cut(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words running of a benchmark item, or no whole shorter item; null texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces dealt to sequences of at most 2,048 tokens; a null or empty text is one piece, the closing id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", keep_one_of_near),
    ("exact repeats", cut_repeats),
    ("benchmark passages", drop_contaminated),
    ("packing", pack),
]

#: Fitted weights, components and packing are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
