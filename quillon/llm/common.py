"""What the training-data operators share: shared-folder tables, hash folds, Arrow mapping, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators become blanks and A-Z becomes a-z; bytes from 0x80 up belong to words.
WORD_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)

#: Bytes of an Arrow batch, where nothing is summed over it.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Only a local master, whose tasks run in the driver's own process, gets a temporary folder where the session names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/quillon-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def leave_on_exit(spark: SparkSession, path: str) -> None:
    """Delete what lies there by now when the application ends."""
    files, target = _filesystem(spark, path)
    files.deleteOnExit(target)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    Losing an executor afterwards costs no recomputation.  ``discard`` removes the table once its readers are done; what is
    left goes when the application ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    leave_on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned; nothing may read them, or a plan over them, afterwards."""
    for t in tables:
        files, target = _filesystem(t.sparkSession, t.table_path)
        files.delete(target, True)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files behind tables that are written by now: it does so as the driver's garbage goes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores in front as keep it apart from those ``taken``, whatever their case."""
    low, out = {x.lower() for x in taken}, []
    for name in wanted:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def trimmed() -> None:
    """Give a Python worker's free memory back: Spark keeps it for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 1000, gather_bytes: int = 0) -> DataFrame:
    """mapInArrow with a function from one record batch, of ``rows`` at most, to one record batch.

    With ``gather_bytes`` the function gets several batches as one, up to that size: what it sums over its rows then
    shuffles less.  Arrow batches between JVM and Python are of BATCH_BYTES at most, as both hold a few of them a task at once.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not gather_bytes:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows)
            return
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= gather_bytes:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for part in parts(batches):
                if part.num_rows and (out := function(part)) is not None and out.num_rows:
                    yield out
        finally:
            trimmed()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one task's edges; at most one edge for each node comes out, to the smallest node it reaches."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while (up := parent.get(x, x)) != root:
                parent[x], x = root, up
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
        if pairs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"]
            )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of one task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["node", "component"])


#: Edges, after thinning, that one task joins; more of them take rounds of shuffles, to the same result.
ONE_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of long pairs (u, v): rows (node, component), the smallest node reachable; linked nodes only.

    Batches of edges are first thinned to spanning forests; then the alternating large-star and small-star rounds
    of Kiveris et al. run on shuffles alone, each round written to the shared folder, until no edge changes; few edges are
    joined by one task instead, as every round costs the driver a dozen stages.  The only
    figures that reach the driver are two sums for each round: the joins are merged, as a broadcast one would gather its
    table there.  No edges give no rows.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")
    edges = written(edges.mapInArrow(_forest, "u long, v long").distinct(), "edges")
    if edges.count() <= ONE_TASK:
        read, joined = edges, written(edges.coalesce(1).mapInArrow(_joined, "node long, component long"), "joined")
        discard(read)
        return joined
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        read, edges = edges, written(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges")
        discard(read)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
