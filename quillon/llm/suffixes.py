"""Exact repeats by a sparse suffix sort over range-partitioned buckets.

A byte is repeated if a string of ``length`` bytes (a window) that covers it starts anywhere else as well.  Sorting every
suffix is not needed: each window has one anchor (its least gram of GRAM bytes), chosen by its bytes alone, so windows can
only be equal if they share the anchor's gram and their distance from it.  A run is the windows of a text that have one anchor.

1. ``anchors``: the runs of each different text.  Those whose gram stands nowhere else leave.
2. An item is a run's windows whose distances lie in one cell: first all distances, then cells that are CUT times narrower from level to
   level, down to one distance.  Its suffix begins where the cell's core does, the bytes that all of its windows hold, so
   items with equal windows have suffixes that begin with the same core.
3. Sampled splitters range-partition the items by their suffixes' leading bytes, then what stands before, then their place, so that
   a string that a third of all texts share is dealt to many buckets.  Each bucket is sorted by multikey quicksort.
4. Neighbours are compared byte by byte, and each bucket's last item with the first of the next bucket.  An item
   that equals a neighbour is repeated whole.  One that shares the core with a neighbour that differs is cut at the next level's cells,
   so of equal items only the first and last go on, for what differs from them.  Any other leaves.

What comes out are intervals, one for each item at most, so the rows grow with the input, whatever the size of a group.
Copies of one text are one text throughout.  Texts are told apart by MD5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, anchor_runs, blocks
from .common import column, discard, free_names, map_batches, release, texts, trimmed, written

#: A cell holds so many of the next level's.
CUT = 4
#: Bytes of suffixes that a bucket is meant to sort.
BUCKET_BYTES = 24 << 20
ITEM = "t long, at int, cell int, suffix binary, back binary"
REPEATED, TO_CUT, EDGE = range(3)
#: State of an edge: told as repeated, told as to be cut, by its own bucket.
TOLD, CUTTING = 1, 2


def packed(base: DataFrame) -> DataFrame:
    """base (.., text) with its text compressed, as ``z``, for shuffles."""
    names = [c for c in base.columns if c != "text"]
    schema = base.select(*names, F.lit(b"").alias("z")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=1)
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array([z.compress(t) for t in texts(batch)], pa.binary())], [*names, "z"])

    return map_batches(base.select(*names, "text"), run, schema)


def digest(text: F.Column) -> F.Column:
    return F.unhex(F.md5(text.cast("binary")))


def different(docs: DataFrame, length: int, text_col: str) -> DataFrame:
    """(t, digest, copies, z): each different text of at least ``length`` bytes, numbered."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    long = docs.select(digest(text).alias("digest"), text.alias("text")).filter(F.octet_length("text") >= length)
    return packed(long).groupBy("digest").agg(F.count("*").alias("copies"), F.first("z").alias("z")).withColumn("t", F.monotonically_increasing_id())


def anchors(different: DataFrame, length: int) -> DataFrame:
    """(key, t, lo, n, a): runs of n windows from byte lo of text t, anchor at lo + a; key is a hash of the anchor's gram."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        z = zstandard.ZstdDecompressor()
        t = column(batch, "t").to_numpy(zero_copy_only=False)
        for data, ends, owners in blocks([z.decompress(x) for x in column(batch, "z").to_pylist()], length):
            lo, hi, at, key = anchor_runs(np.frombuffer(data, np.uint8), ends, length)
            piece = np.searchsorted(ends, lo, side="right")
            start = np.array([s for _, s in owners])[piece] - np.concatenate([[0], ends[:-1]])[piece]
            out.append((key.view(np.int64), t[np.array([o for o, _ in owners])[piece]], lo + start, hi - lo + 1, at - lo))
        if not out:
            return None
        kinds = [np.int64, np.int64, np.int32, np.int16, np.int16]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(zip(*out), kinds)], ["key", "t", "lo", "n", "a"])

    return map_batches(different.select("t", "z"), run, "key long, t long, lo int, n short, a short")


class Cells:
    """The cells of distances of one level: ``width`` distances each, the last one perhaps fewer."""

    def __init__(self, length: int, width: int):
        self.length, self.width, self.distances = length, width, length - GRAM + 1

    @classmethod
    def levels(cls, length: int) -> list[Cells]:
        widths = [1]
        while widths[-1] < length - GRAM + 1:
            widths.append(widths[-1] * CUT)
        return [cls(length, w) for w in reversed(widths)]

    def core(self, cell: np.ndarray) -> np.ndarray:
        """Bytes that all windows of a cell hold."""
        return self.length - (np.minimum((cell + 1) * self.width, self.distances) - 1 - cell * self.width)

    def span(self, cell, suffix, back):
        """Least and greatest distance of an item, from the lengths of its strings."""
        return self.length + cell * self.width - suffix, cell * self.width + back

    def cut(self, t: int, at: int, cell: int, suffix: bytes, back: bytes, finer: Cells) -> Iterator[tuple]:
        """An item's parts in the next level's cells."""
        least, most = self.span(cell, len(suffix), len(back))
        text = back[::-1] + suffix
        for c in range(least // finer.width, most // finer.width + 1):
            d, y1, y2 = c * finer.width, max(least, c * finer.width), min(most, (c + 1) * finer.width - 1)
            yield t, at, c, text[most - d : most + self.length - y1], text[most - y2 : most - d][::-1]


def _symbols(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(8 bytes a symbol, in the strings' order, zeros behind the end; lengths) of binary strings."""
    n = len(strings)
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + n + 1]
    lengths = np.diff(ends)
    width = -(-int(lengths.max(initial=1)) // 8) * 8
    out = np.zeros((n, width), np.uint8)
    if ends[-1] > ends[0]:
        out[np.arange(width) < lengths[:, None]] = np.frombuffer(strings.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return out.view(">u8").astype(np.uint64), lengths


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Rows in the order of ``keys``, one column of symbols after the other, by multikey quicksort.

    At each depth the rows of a part are sorted and parted by their next symbol; parts of one row, and those whose rows all
    have the same symbol, are left alone.
    """
    order = np.arange(len(keys[0]))
    where, part = order.copy(), np.zeros(len(order), np.int64)
    for key in keys:
        if not len(where):
            break
        k = key[order[where]]
        together = part[1:] == part[:-1]
        differs = together & (k[1:] != k[:-1])
        if not differs.any():
            continue
        mixed = np.zeros(part[-1] + 1, bool)
        mixed[part[1:][differs]] = True
        some = np.flatnonzero(mixed[part])
        by = some[np.lexsort((k[some], part[some]))]
        order[where[some]] = order[where[by]]
        k[some] = k[by]
        new = np.append(True, ~together | (k[1:] != k[:-1]))
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1
        where, part = where[keep], np.unique(number[keep], return_inverse=True)[1]
    return order


def _neighbours(cells: Cells, cell: np.ndarray, suffix: tuple, back: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each sorted item but the last: whether it equals the next one; whether it shares its cell's core with it."""
    (s, sn), (b, bn) = suffix, back
    near = cell[1:] == cell[:-1]
    alike = (s[1:] == s[:-1]).all(1) & (b[1:] == b[:-1]).all(1) & (sn[1:] == sn[:-1]) & (bn[1:] == bn[:-1])
    letters = s.byteswap().view(np.uint8).reshape(len(s), -1)
    other = letters[1:] != letters[:-1]
    common = np.where(other.any(1), other.argmax(1), letters.shape[1])
    return near & alike, near & (common >= cells.core(cell[1:]))


def _rows(kind: int, items: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*items)) or [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    flag = [pa.array([kind] * len(items), pa.int8()), pa.array([None] * len(items), pa.int32()), pa.array([None] * len(items), pa.int8())]
    return pa.RecordBatch.from_arrays([*flag, *(pa.array(list(c), k) for c, k in zip(cols, kinds))], OUT_NAMES)


OUT = "kind byte, bucket int, state byte, " + ITEM
OUT_NAMES = ["kind", "bucket", "state", "t", "at", "cell", "suffix", "back"]


def sort_bucket(cells: Cells, finer: Cells | None):
    """A function from one bucket's items to what becomes of them; the first and last item go along for the next buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        items = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        del held
        cell, t, at = (column(items, c).to_numpy(zero_copy_only=False) for c in ("cell", "t", "at"))
        (s, sn), (b, bn) = _symbols(column(items, "suffix")), _symbols(column(items, "back"))
        order = multikey_order([cell, *s.T, sn, *b.T, bn, t, at])
        equal, core = _neighbours(cells, cell[order], (s[order], sn[order]), (b[order], bn[order]))
        same = np.append(False, equal) | np.append(equal, False)
        apart = core & ~equal
        to_cut = (np.append(False, apart) | np.append(apart, False)) & (finer is not None)
        # repeated whole: only lengths are needed from here on
        done = order[same]
        least, most = cells.span(cell[done], sn[done], bn[done])
        for first in range(0, len(done), 100_000):
            r = slice(first, first + 100_000)
            some, n = done[r], len(done[r])
            nothing = pa.array([None] * n, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, REPEATED, np.int8)), pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.int8()), pa.array(t[some]),
                 pa.array((at[some] - most[r]).astype(np.int32)), pa.array((most[r] - least[r] + 1).astype(np.int32)), nothing, nothing],
                OUT_NAMES,
            )

        def rows(numbers: np.ndarray) -> list[tuple]:
            part = items.take(pa.array(numbers))
            return list(zip(*(column(part, c).to_pylist() for c in ("t", "at", "cell", "suffix", "back"))))

        cutting = order[to_cut]
        for first in range(0, len(cutting), 20_000):
            yield _rows(TO_CUT, [x for r in rows(cutting[first : first + 20_000]) for x in cells.cut(*r, finer)])
        ends = np.unique([0, len(order) - 1])
        bucket = pa.array([TaskContext.get().partitionId()] * len(ends), pa.int32())
        state = pa.array((same[ends] * TOLD + to_cut[ends] * CUTTING).astype(np.int8))
        yield _rows(EDGE, rows(order[ends])).set_column(1, "bucket", bucket).set_column(2, "state", state)
        del items, s, b
        trimmed()

    return run


def across(edges: list, cells: Cells, finer: Cells | None) -> tuple[list[tuple], list[tuple]]:
    """(intervals, items to cut) that follow where a bucket's last item meets the first of the next; each item once."""
    rows = sorted(edges, key=lambda r: (r.bucket, r.cell, bytes(r.suffix), bytes(r.back), r.t, r.at))
    equal, apart = set(), set()
    for k, (x, y) in enumerate(zip(rows, rows[1:])):
        if x.bucket != y.bucket and x.cell == y.cell:
            core = int(cells.core(np.int64(x.cell)))
            if x.suffix == y.suffix and x.back == y.back:
                equal |= {k, k + 1}
            elif x.suffix[:core] == y.suffix[:core]:
                apart |= {k, k + 1}
    spans, items = [], []
    for k, r in enumerate(rows):
        if k in equal and not r.state & TOLD:
            least, most = cells.span(r.cell, len(r.suffix), len(r.back))
            spans.append((r.t, r.at - most, most - least + 1))
        if k in apart and not r.state & CUTTING and finer is not None:
            items += cells.cut(r.t, r.at, r.cell, bytes(r.suffix), bytes(r.back), finer)
    return spans, items


def repeats(different: DataFrame, length: int) -> DataFrame:
    """(t, starts array<struct<lo, n>>): runs of repeated windows of each text that has any.  different: a written table."""
    spark = different.sparkSession
    runs = written(anchors(different, length), "anchors")
    live = runs.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    per_text = runs.join(live, "key", "left_semi").groupBy("t").agg(F.collect_list(F.struct("lo", "n", "a")).alias("cuts"))

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = zstandard.ZstdDecompressor()
        t_, at_, suffix, back = [], [], [], []
        for t, data, cuts in zip(column(batch, "t").to_pylist(), column(batch, "z").to_pylist(), column(batch, "cuts")):
            text = z.decompress(data)
            lo, n, a = (cuts.values.field(k).to_numpy(zero_copy_only=False).tolist() for k in range(3))
            for x, m, y in zip(lo, n, a):
                suffix.append(text[x + y : x + m - 1 + length])
                back.append(text[x : x + y][::-1])
            t_ += [t] * len(lo)
            at_ += [x + y for x, y in zip(lo, a)]
        return pa.RecordBatch.from_arrays([pa.array(t_, pa.int64()), pa.array(at_, pa.int32()), pa.array([0] * len(t_), pa.int32()), pa.array(suffix, pa.binary()), pa.array(back, pa.binary())], ["t", "at", "cell", "suffix", "back"])

    joined = different.select("t", "z").join(per_text.hint("shuffle_hash"), "t")
    items = written(map_batches(joined, first, ITEM, 200), "suffixes")
    discard(runs)
    intervals = []
    levels = Cells.levels(length)
    names = ["t", "at", "cell", "suffix", "back"]
    for cells, finer in zip(levels, [*levels[1:], None]):
        size = items.agg(F.sum(F.octet_length("suffix") + F.octet_length("back"))).first()[0]
        if not size:
            break
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
        dealt = items.repartitionByRange(n, "cell", "suffix", "back", "t", "at")
        out = written(dealt.mapInArrow(sort_bucket(cells, finer), OUT), "sorted")
        discard(items)
        edges = out.filter(F.col("kind") == EDGE).select("bucket", "state", *names).collect()  # two rows for each bucket at most
        spans, more = across(edges, cells, finer)
        found = out.filter(F.col("kind") == REPEATED).select("t", F.col("at").alias("lo"), F.col("cell").alias("n"))
        found = found.unionByName(spark.createDataFrame(spans, "t long, lo int, n int"))
        intervals.append(written(found, "intervals"))
        items = out.filter(F.col("kind") == TO_CUT).select(*names).unionByName(spark.createDataFrame(more, ITEM))
        items = written(items, "cut")
        discard(out)
    if not intervals:
        return spark.createDataFrame([], "t long, starts array<struct<lo: int, n: int>>")
    every = intervals[0]
    for x in intervals[1:]:
        every = every.unionByName(x)
    spans = written(every.groupBy("t").agg(F.collect_list(F.struct("lo", "n")).alias("starts")), "spans")
    discard(items, *intervals)
    return spans


def kept_text(text: bytes, starts: list[tuple[int, int]], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What remains of a text, and its removed runs (begin, end)."""
    removed: list[list[int]] = []
    for lo, n in sorted(starts):
        if removed and lo <= removed[-1][1]:
            removed[-1][1] = max(removed[-1][1], lo + n - 1 + length)
        else:
            removed.append([lo, lo + n - 1 + length])
    kept, at = [], 0
    for a, b in removed:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), [(a, b) for a, b in removed]


def _known(docs: DataFrame, length: int, text_col: str) -> DataFrame:
    """(digest, copies, starts) of the texts that lose bytes: copies, and texts with repeated windows."""
    once = written(different(docs, length, text_col), "texts")
    found = repeats(once, length)
    known = once.select("t", "digest", "copies").join(found, "t", "left").filter("copies > 1 or starts is not null").select("digest", "copies", "starts")
    known = written(known, "known")
    discard(once)
    return known


def _kept(t: bytes, copies: int | None, starts: list[dict] | None, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    return kept_text(t, [(0, len(t) - length + 1)] if (copies or 1) > 1 else [(s["lo"], s["n"]) for s in starts or ()], length)


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): each document without its repeated bytes.

    Null texts count as empty; texts under ``length`` bytes have no repeats; every copy of a text of ``length`` bytes or
    more is removed whole, repeated rows too.  An empty table gives no rows.  ``length``: 200 to 600 bytes.
    """
    if not 200 <= length <= 600:
        raise ValueError("length: 200 to 600 bytes")
    known = _known(docs, length, text_col)
    release(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), digest(text).alias("digest"), text.alias("text"))
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        z = zstandard.ZstdDecompressor()
        for i, data, copies, starts in zip(*(column(batch, c).to_pylist() for c in ("id", "z", "copies", "starts"))):
            t = z.decompress(data)
            kept, removed = _kept(t, copies, starts, length)
            out.append((i, len(t), len(t) - len(kept), len(removed), hashlib.sha256(kept).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), fields)], [f for f, _ in fields])

    # a text that a third of all rows share is split by the adaptive skew join
    joined = packed(base).join(known.hint("shuffle_hash"), "digest", "left").select("id", "z", "copies", "starts")
    return map_batches(joined, run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def cut(docs: DataFrame, length: int = 200, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with their repeated bytes cut out of ``text_col``, and ``chars_col``, if there is one, counted anew.

    Characters that a cut splits go whole.  Null texts stay null; documents that lose everything stay, with an empty text.
    Repeated rows are copies of each other.  All other columns, whatever their names, stay as they are; an empty table stays one.
    """
    names, schema = docs.columns, docs.schema
    marks = free_names(names, "digest", "copies", "starts")
    known = _known(docs.select(F.col(text_col).alias("text")), length, "text").toDF(*marks)
    release(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = column(batch, text_col).cast(pa.binary()).to_pylist()
        both = zip(raw, column(batch, marks[1]).to_pylist(), column(batch, marks[2]).to_pylist())
        texts = [None if t is None else _kept(t, c, s, length)[0].decode("utf-8", "ignore") for t, c, s in both]
        made = {text_col: texts} | ({chars_col: [None if t is None else len(t) for t in texts]} if chars_col in names else {})
        cols = [pa.array(made[c], batch.schema.field(c).type) if c in made else column(batch, c) for c in names]
        return pa.RecordBatch.from_arrays(cols, names)

    marked = docs.withColumn(marks[0], digest(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    joined = marked.join(known.hint("shuffle_hash"), marks[0], "left").select(*names, *marks[1:])
    return map_batches(joined, run, schema)
