"""Keeps an index up to date from a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import corpus
from ..plans.index import Index
from ..sources.store import Store

#: A change: the file's whole content, or null where the file is gone; ``seq`` tells the newest of several in a batch.
CHANGE = "path string, content string, seq long"


def follow(index: Index, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Read changes (CHANGE, Parquet) that arrive in ``folder``; each micro-batch updates the kept tree, then the index.

    Only changed files are parsed.  A batch that is run again after a loss changes nothing, as files are told by their content.
    """
    spark = index.spark
    kept = Store(spark, f"{index.store.root}/tree")

    def batch(changes: DataFrame, _: int) -> None:
        newest = changes.groupBy("path").agg(F.max_by("content", "seq").alias("content"))
        old = kept.read("files") if kept.current() else newest.limit(0)
        fresh = corpus.delete(old, newest).unionByName(newest.filter("content is not null"))
        kept.commit({"files": fresh})
        index.update(kept.read("files"))

    writer = spark.readStream.schema(CHANGE).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
