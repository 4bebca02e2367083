"""Two-pass external shuffle into shards.

Pass one scatters whole rows uniformly over buckets of a bounded number of rows and bytes, by a seeded hash of the row.  Pass two shuffles
each bucket with Fisher-Yates, seeded by bucket.  The buckets in order are one random order of all rows; shard s takes
the s-th run of it, so counts differ by one at most (law ``rows``).  Its rows are written to its files from there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import leave_on_exit, shared_path, written


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A random order of 0..n-1: from the last place down, swap with a place not above it."""
    rng = np.random.default_rng(seed)
    order = np.arange(n)
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else ()):
        order[i], order[j] = order[j], order[i]
    return order


def shuffled(rows: DataFrame, by: list[str], seed: int, bucket_rows: int, bucket_bytes: int = 0, size_col: str = "") -> DataFrame:
    """rows with a long column ``position``: 0..n-1 in random order, as whole buckets of running positions.

    ``by`` names columns that tell rows apart; rows alike in all of them are told apart by their count before the scatter.
    Buckets hold about ``bucket_rows`` rows and, by the bytes that ``size_col`` gives for each row, ``bucket_bytes``.  One row
    for each bucket is broadcast.
    """
    rows = written(rows, "rows")
    total, size = rows.agg(F.count("*"), F.sum(size_col) if size_col else F.lit(None)).first()
    n = max(1, -(-total // bucket_rows), -(-(size or 0) // bucket_bytes) if bucket_bytes else 0)
    alike = Window.partitionBy(*by).orderBy(F.lit(0))
    again = rows.groupBy(*by).agg(F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    if again.isEmpty():
        rows = rows.withColumn("_nth", F.lit(1))
    else:
        rows = rows.withColumn("_nth", F.row_number().over(alike))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), *by, "_nth"), F.lit(n)))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_block", F.floor(F.col("bucket") / 4096))
    blocks = before.groupBy("_block").agg(F.sum("_size").alias("_all"))
    within = Window.partitionBy("_block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_all").over(over), F.lit(0)).alias("_base"))
    starts = before.join(blocks, "_block").select("bucket", (F.col("_base") + F.coalesce(F.sum("_size").over(within), F.lit(0))).alias("_start"))
    starts = written(starts, "starts")
    kept = [c for c in rows.columns if c not in ("bucket", "_nth")]
    keys = [(k, "ascending") for k in (*by, "_nth")]

    def shuffle(bucket: pa.Table) -> pa.Table:
        bucket = bucket.take(pc.sort_indices(bucket, sort_keys=keys, null_placement="at_start"))
        bucket = bucket.take(pa.array(fisher_yates(len(bucket), [seed, bucket["bucket"][0].as_py()])))
        return bucket.select([*kept, "bucket"]).append_column("_place", pa.array(np.arange(len(bucket))))

    schema = rows.select(*kept, "bucket").schema.add("_place", "long")
    mixed = rows.groupBy("bucket").applyInArrow(shuffle, schema)
    # texts stay with their bucket: the join must not deal them out again
    return mixed.join(F.broadcast(starts), "bucket").withColumn("position", F.col("_start") + F.col("_place")).drop("bucket", "_start", "_place")


def shard_rows(rows: DataFrame, shards: int, by: list[str], seed: int = 42, bucket_rows: int = 50_000, bucket_bytes: int = 0, size_col: str = "") -> DataFrame:
    """rows with ``shard`` (0 to shards - 1, counts at most one apart) and ``slot`` (gapless from 0 in each shard).

    Null values are values like others; repeated rows each get a place; an empty table gives no rows.  Columns that
    begin with an underscore, bucket and position are the operator's own.
    """
    mixed = shuffled(rows, by, seed, bucket_rows, bucket_bytes, size_col)
    total = rows.count()
    size, more = divmod(total, shards)
    p, edge = F.col("position"), more * (size + 1)
    shard = F.when(p < edge, F.floor(p / (size + 1))).otherwise(more + F.floor((p - edge) / max(size, 1))).cast("int")
    first = F.col("shard") * size + F.least(F.col("shard"), F.lit(more))
    return mixed.withColumn("shard", shard).withColumn("slot", (p - first).cast("long")).drop("position")


#: Bytes of text that pass two holds together, about; a longer text is a bucket of its own size.
BUCKET_BYTES = 16 << 20


def shard_documents(docs: DataFrame, shards: int, seed: int = 42, bucket_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, shard, slot): whole documents in the random order of their shards; null texts stay null.

    The texts go through both passes.  Documents are told apart by id, length and checksum.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", "text", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    placed = shard_rows(rows, shards, ["id", "size", "crc"], seed, bucket_rows, BUCKET_BYTES, "size")
    return placed.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "shard", "slot")


def write_shards(rows: DataFrame, path: str, slots: int = 50_000, dealt: bool = False) -> None:
    """Write rows that have ``shard`` and ``slot`` as one folder for each shard, of files of ``slots`` rows in slot order each.

    A shard is dealt to several tasks by runs of slots, so none holds a whole one.  Null values are written as they are, an empty table writes nothing
    to read; the files' names follow the slots.  ``dealt`` tells that the tasks hold runs of slots already, as ``shard_rows`` leaves them: rows are
    then written where they are, and a part has a file for each bucket that reaches into it.
    """
    parts = rows.withColumn("part", F.floor(F.col("slot") / slots).cast("int"))
    if not dealt:
        parts = parts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "part")
    parts.sortWithinPartitions("shard", "part", "slot").write.option("compression", "zstd").partitionBy("shard", "part").parquet(path)


def stored(rows: DataFrame) -> DataFrame:
    """What ``shard_rows`` or ``shard_documents`` returned, written as shards into the shared folder and read back from their files."""
    spark = rows.sparkSession
    path = shared_path(spark, "shards")
    write_shards(rows, path, dealt=True)
    leave_on_exit(spark, path)
    out = spark.read.schema(rows.schema).parquet(path)
    out.table_path = path
    return out


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """One shard's rows in slot order, as they were written."""
    return spark.read.parquet(path).filter((F.col("shard") == shard)).drop("part").orderBy("slot")
