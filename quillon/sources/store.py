"""Tables that the engine writes: a folder for each snapshot, and a pointer that names the current one."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master gets a temporary one where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def new_dir(spark: SparkSession, tag: str) -> str:
    """A folder's path of our own below the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/quillon-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    files, target = _files(spark, path)
    files.deleteOnExit(target)
    return path


class Store:
    """Named tables below ``root``.  A commit writes the tables it is given to a new snapshot and then swaps the pointer, which names
    every table's snapshot, so that readers see either all of the old tables or all of the new ones, and a commit that fails leaves the
    old ones.  Tables that a commit does not name stay where they are."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> dict[str, str]:
        """The snapshot of each table; none before the first commit."""
        files, pointer = _files(self.spark, f"{self.root}/current")
        if not files.exists(pointer):
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/current").first()[0])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.current()[name]}/{name}")

    def has(self, name: str) -> bool:
        return name in self.current()

    def commit(self, tables: dict[str, DataFrame], by: dict[str, str] | None = None) -> str:
        """Write a snapshot of the given tables.  ``by`` names the column that each of a table's files is sorted by where it is written,
        without a shuffle, so that filters on it skip most of a file's pages."""
        snapshot, before = uuid.uuid4().hex, self.current()
        for name, df in tables.items():
            key = (by or {}).get(name)
            out = df.sortWithinPartitions(key) if key else df
            out.write.parquet(f"{self.root}/{snapshot}/{name}")
        fresh, now = f"{self.root}/pointer-{snapshot}", json.dumps(before | dict.fromkeys(tables, snapshot))
        self.spark.createDataFrame([(now,)], "value string").coalesce(1).write.text(fresh)
        files, pointer = _files(self.spark, f"{self.root}/current")
        files.delete(pointer, True)
        files.rename(_files(self.spark, fresh)[1], pointer)
        return snapshot
