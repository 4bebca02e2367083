"""Language identification by rank-order profiles (Cavnar and Trenkle).

A language's profile is its most frequent letter n-grams (1 to 3 letters, word ends marked), in order.  A document's own
most frequent n-grams are compared to each profile by out-of-place distance: the sum of how far each n-gram's rank is from its
rank in the profile, or the profile's size where it has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fold, map_batches, texts

#: n-grams in a profile.
PROFILE = 400
_BITS = np.int64(21)
_BREAK = 1
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Code point of each letter's place; anything else is a break between words."""
    global _letters
    if _letters is None:
        _letters = np.array([c if chr(c).isalpha() else _BREAK for c in range(0x110000)], np.int32)
    return _letters


def ngrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the 1- to 3-grams of a whole text, lower-cased, with word ends as one sign."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    x = np.concatenate([[_BREAK], _letter_table()[points], [_BREAK]]).astype(np.int64)
    x = x[np.append(True, (x[1:] != _BREAK) | (x[:-1] != _BREAK))]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = x[:-1] << _BITS | x[1:]
    three = two[:-1] << _BITS | x[2:]
    return np.unique(np.concatenate([x[x != _BREAK], two, three]), return_counts=True)


def most_frequent(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent codes in order; ties by code."""
    if len(codes) > 4 * n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:n]]


class Profiles:
    """Ranks of each language's profile."""

    def __init__(self, by_language: dict[str, list[int]], size: int):
        self.names, self.size = sorted(by_language), size
        self.codes = [np.sort(np.array(by_language[x], np.int64)) for x in self.names]
        self.ranks = [np.argsort(np.array(by_language[x], np.int64)) for x in self.names]

    def distances(self, text: bytes) -> np.ndarray | None:
        """Mean out-of-place distance to each language, 0 to 1; None for a text without letters."""
        codes, counts = ngrams(text)
        if not len(codes):
            return None
        mine = most_frequent(codes, counts, self.size)
        out = []
        for codes, ranks in zip(self.codes, self.ranks):
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            d = np.where(codes[at] == mine, np.minimum(np.abs(ranks[at] - np.arange(len(mine))), self.size), self.size)
            out.append(d.mean() / self.size)
        return np.array(out)

    def predict(self, text: bytes) -> tuple[str, float]:
        """(language, score): the nearest profile, and the second distance's share of both, 0 for ``und``."""
        d = self.distances(text)
        if d is None or not self.names:
            return "und", 0.0
        order = np.argsort(d, kind="stable")
        if len(order) == 1:
            return self.names[order[0]], float(1 - d[order[0]])
        a, b = d[order[0]], d[order[1]]
        return self.names[order[0]], float(b / (a + b)) if a + b else 0.5


def fit_profiles(labelled: DataFrame, size: int = PROFILE, rows_for_each: int = 8_000, max_labels: int = 1_000, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the labels in ``labelled``; for each about ``rows_for_each`` rows at most, taken by a hash of the text and its row's
    number, so that copies of one text are not all taken or all left.

    Null labels and null texts teach nothing; an empty table gives no profile.  The sample is the documented bound of this fit; n-grams are
    summed on the executors and ``size`` of them for each label come to the driver.  More than ``max_labels`` different labels are
    an error, as they are no languages; none is left out silently.
    """
    src = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    counts = src.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    if not counts:
        return Profiles({}, size)
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, rows_for_each / r["count"]))])
    chance = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1_000_000)) / 1e6
    src = src.filter(chance < share[F.col("lang")])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts: dict[str, list] = {}
        for lang, t in zip(column(batch, "lang").to_pylist(), texts(batch)):
            parts.setdefault(lang, []).append(ngrams(t))
        out = []
        for lang, found in parts.items():
            codes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([f[1] for f in found]), len(codes)).astype(np.int64)
            out.append((pa.array([lang] * len(codes)), pa.array(codes), pa.array(sums)))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out)], ["lang", "code", "n"])

    sums = map_batches(src, run, "lang string, code long, n long", gather_bytes=16 << 20).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    by: dict[str, list[int]] = {}
    for r in sums.withColumn("rank", rank).filter(F.col("rank") <= size).orderBy("lang", "rank").collect():
        by.setdefault(r["lang"], []).append(r["code"])
    return Profiles(by, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row.  Null texts and texts without a letter are ``und`` with score 0."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [held.value.predict(t) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], ["id", "lang_pred", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(src, run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2
