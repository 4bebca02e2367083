"""Best-fit packing by minimum bin slack.

Pieces are told apart by their length alone, so the packer works on how many pieces have each length: never more than
``capacity`` figures, however large the corpus.  Per bin it takes the longest piece left and fills the rest with the
fullest feasible combination of the lengths left, found by a bitset subset-sum dynamic programme; the combination is
removed as often as it stays available.  Pieces are then numbered within their length and look their bin up.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_batches, written
from .wordpieces import encoder

_RANK = 44
#: Parts that pieces of one length are numbered in; with the capacity it bounds the table of their counts.
SALTS = 128


def fullest(left: dict[int, int], room: int) -> Counter:
    """Lengths, with their multiplicity, whose sum comes closest to ``room`` from below; longer pieces first."""
    reach, steps = 1, []
    mask = (1 << room + 1) - 1
    for length in sorted((x for x, c in left.items() if c and x <= room), reverse=True):
        copies, size = min(left[length], room // length), 1
        while copies > 0:
            m = min(size, copies)
            steps.append((reach, length, m))
            reach |= reach << length * m & mask
            copies -= m
            size *= 2
        if reach >> room & 1:
            break
    target, taken = reach.bit_length() - 1, Counter()
    for before, length, m in reversed(steps):
        if not before >> target & 1:
            taken[length] += m
            target -= length * m
    return taken


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """(combination, how often) until no piece is left."""
    left = {k: v for k, v in counts.items() if v}
    plan = []
    while left:
        seed = max(left)
        left[seed] -= 1
        combination = fullest(left, capacity - seed)
        left[seed] += 1
        combination[seed] += 1
        times = min(left[k] // c for k, c in combination.items())
        for k, c in combination.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
        plan.append((combination, times))
    return plan


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and a closing id 0, cut only where over capacity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(vocabulary)
        out: list[tuple] = []
        texts = [t or "" for t in column(batch, "text").to_pylist()]
        for i, ids in zip(column(batch, "id").to_pylist(), encode.many(texts)):
            ids += b"\0\0\0\0"
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                piece = ids[at : at + 4 * capacity]
                out.append((i, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(src, run, "id long, piece int, start long, length long, ids_crc32 long")


def bins(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """pieces with sequence_id and offset.  ``length`` is 1 to capacity; ``order`` tells rows of one length apart."""
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    groups = pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    groups = written(groups, "lengths")
    counts = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("_n")).collect()}  # capacity rows at most
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError("a piece is empty or longer than a bin")
    starts, bases, every, offsets, number, used = [], [], [], [], 0, Counter()
    for combination, times in minimum_bin_slack(counts, capacity):
        offset = 0
        for length, c in sorted(combination.items(), reverse=True):
            starts.append(length << _RANK | used[length])
            bases.append(number)
            every.append(c)
            offsets.append(offset)
            used[length] += c * times
            offset += c * length
        number += times
    at = np.argsort(np.array(starts, np.int64))
    plan = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[at] for x in (starts, bases, every, offsets)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    ranked = pieces.withColumn("_rank", rank).join(groups, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")
    schema = pieces.drop("_salt").schema.add("sequence_id", "long").add("offset", "long")
    names = schema.names

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, bases, every, offsets = plan.value
        length, rank = (column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
        place = length << _RANK | rank
        k = np.searchsorted(starts, place, side="right") - 1
        nth = place - starts[k]
        made = [pa.array(bases[k] + nth // every[k]), pa.array(offsets[k] + nth % every[k] * length)]
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in names[:-2]), *made], names)

    return map_batches(ranked, run, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece: the closing id.  Repeated rows are packed as often as they occur; an empty table
    gives no rows.  ``vocabulary``: a tokenizer file whose split pattern and normalizer are those of wordpieces.py.
    """
    pieces = written(token_pieces(docs, vocabulary, capacity, id_col, text_col), "pieces")
    return bins(pieces, capacity, ["id", "piece", "start", "ids_crc32"]).withColumnRenamed("id", id_col)
