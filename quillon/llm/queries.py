"""The training-data queries: each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licences, media, packing, sharding, simhash, suffix_tree, suffixes, toxicity
from .common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit_profiles(docs.filter(~language.held_out(F.col("doc_id"))))
    return language.identify(docs, profiles).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def training_labels(docs: DataFrame, labels: DataFrame, rows_for_each: int = 10_000) -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fold, of each label at most ``rows_for_each`` rows of ``labels``.

    The rows are those of the smallest hashes of their ids.  That bound of the fit bounds what is broadcast, so no text is
    shuffled to its label.
    """
    labels = labels.filter(fold(F.col("doc_id"), 3) != 1).select("doc_id", "toxic")
    some = [labels.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_for_each) for y in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("text", "toxic")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.fit(training_labels(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, scorer).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "offending")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.stored(sharding.shard_documents(table(spark, sf_dir, "documents"), 40))
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    return rows.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.lm_scores(table(spark, sf_dir, "documents"), suffix_tree.trains(F.col("doc_id")))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language, op2_toxicity, op3_simhash, op4_suffixes, op5_licences, op6_packing, op7_sharding, op8_decontaminate, op9_suffix_tree, op10_media, pipeline)
}

#: Equal SQL, where it can express the operator; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {}
