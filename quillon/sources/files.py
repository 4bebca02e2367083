"""Repositories as DataFrames of (path, content, sha256, size, mtime)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``; content is UTF-8 with replacement signs for malformed bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return raw.select(
        F.substring(full, len(base) + 1, 1 << 30).alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
    )


def discover(files: DataFrame) -> DataFrame:
    """Files that are not ignored and whose language is known."""
    return files.filter(~paths.ignored(F.col("path"))).withColumn("language", paths.language_for(F.col("path"))).filter("language is not null")


def change_ranks(log: DataFrame, key: str = "path", position: str = "position", blocks: int = 4096) -> DataFrame:
    """(key, recency): 1 / (1 + rank / 25), rank by first appearance in a newest-first change log; ties by key.

    Keys are ranked inside blocks of positions, and each block starts where the ones before end: one task orders ``blocks`` rows at most.
    """
    first = log.groupBy(key).agg(F.min(position).cast("long").alias("first"))
    edge = first.agg(F.min("first").alias("least"), (F.floor((F.max("first") - F.min("first")) / blocks) + 1).alias("width"))
    parts = first.join(F.broadcast(edge)).withColumn("block", F.floor((F.col("first") - F.col("least")) / F.col("width"))).select(key, "first", "block")
    before = parts.groupBy("block").agg(F.count("*").alias("n"))
    base = before.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "base")
    rank = F.row_number().over(Window.partitionBy("block").orderBy("first", key)) - 1
    return parts.join(F.broadcast(base), "block").withColumn("rank", F.col("base") + rank).select(key, (1 / (1 + F.col("rank") / 25)).alias("recency"))
