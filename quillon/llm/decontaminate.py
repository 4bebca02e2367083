"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the items' windows of ``window`` consecutive words; a shorter item is one pattern.  Patterns of one length
share a shift table over blocks of three words: an unknown block lets the search skip most of a window.  Blocks at a
window's end have shift zero and name, as suffix-hash buckets, the patterns that are then compared directly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_TABLE, column, map_batches, texts, written

BLOCK = 3


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class WuManber:
    """Patterns of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, set[int]]] = defaultdict(dict)

    def add(self, pattern: tuple, item: int) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            block = pattern[end - b : end]
            self.shift[block] = min(self.shift.get(block, self.default), m - end)
        self.bucket[pattern[m - b :]].setdefault(pattern, set()).add(item)

    def search(self, words: list[bytes]) -> Iterable[tuple[int, set[int]]]:
        """(first word, items) of each occurrence, in order."""
        m, b, default, shift = self.length, self.block, self.default, self.shift
        end, n = m, len(words)
        while end <= n:
            block = tuple(words[end - b : end])
            skip = shift.get(block, default)
            if skip:
                end += skip
                continue
            found = self.bucket[block].get(tuple(words[end - m : end]))
            if found:
                yield end - m, found
            end += 1


def searchers(items: Iterable[tuple[int, str]], window: int) -> list[WuManber]:
    by_length: dict[int, WuManber] = {}
    for item, text in items:
        words = tuple(words_of(text.encode()))
        m = min(window, len(words))
        if m:
            s = by_length.setdefault(m, WuManber(m))
            for at in range(len(words) - m + 1):
                s.add(words[at : at + m], item)
    return list(by_length.values())


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterable[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about ``block_bytes`` of text; null texts and ids are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        yield [(r.item, r.text) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


class _Scan:
    """What a task needs to search texts for one block: tables are built once a task."""

    def __init__(self, spark: SparkSession, items: list[tuple[int, str]], window: int):
        self.held, self.window, self.tables = spark.sparkContext.broadcast(items), window, None

    def __getstate__(self):
        return {"held": self.held, "window": self.window, "tables": None}

    def __call__(self, words: list[bytes]) -> Iterable[tuple[int, int, set[int]]]:
        """(first word, last word, items) of each occurrence."""
        if self.tables is None:
            self.tables = searchers(self.held.value, self.window)
        for s in self.tables:
            for at, those in s.search(words):
                yield at, at + s.length - 1, those


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_words, spans array<struct<first, last>>, items array<long>) of every document.

    spans: maximal runs of words inside occurrences.  A null text has no words; items that are null, have no word or no
    id are left out.  Repeated rows are searched each; no items find nothing; an empty table gives no rows.  The benchmark is read in
    blocks of about ``block_bytes`` of text (its tables take some 70 times that); each block is a pass of its own over written rows,
    so a larger benchmark takes longer and no more memory.
    """
    spark = docs.sparkSession
    out = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<first: long, last: long>>)").alias("spans"), F.expr("cast(array() as array<long>)").alias("items"),
    )
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    passes = 0
    for items in _blocks(benchmark, block_bytes):
        scan = _Scan(spark, items, window)
        if passes:
            out = written(out, "searched")
        passes += 1

        def run(batch: pa.RecordBatch, scan=scan) -> pa.RecordBatch:
            counts, spans, found = [], [], []
            for t, old, had in zip(texts(batch), column(batch, "spans").to_pylist(), column(batch, "items").to_pylist()):
                words, hits, ids = words_of(t), [(s["first"], s["last"]) for s in old], set(had)
                for first, last, those in scan(words):
                    hits.append((first, last))
                    ids |= those
                runs: list[list[int]] = []
                for a, b in sorted(hits):
                    if runs and a <= runs[-1][1] + 1:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in runs])
                found.append(sorted(ids))
            made = [pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "text"), *made], ["id", "text", "n_words", "spans", "items"])

        out = map_batches(out, run, out.schema)
    return out.drop("text").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """The documents in which no item's window occurs, with their columns, whatever their names, as they are.

    Null and wordless texts hold no window and stay, repeated rows stay each, an empty table stays one; see contamination for items and blocks.
    """
    passes = 0
    for items in _blocks(benchmark, block_bytes):
        if passes:
            docs = written(docs, "searched")
        passes += 1
        scan = _Scan(docs.sparkSession, items, window)

        def run(batch: pa.RecordBatch, scan=scan) -> pa.RecordBatch:
            return batch.filter(pa.array([next(iter(scan(words_of(t))), None) is None for t in texts(batch, text_col)], pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
    return docs
