"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability, logistic in its words; the document's is their noisy-or:
one toxic sentence is enough.  A leak, one more cause of each document, takes up labels that no sentence explains.  Weights
are learned from document labels alone, by following the noisy-or's gradient down to the sentences, and afterwards locate
the offending ones.  Sentences without a word that the model knows are no cause.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, map_batches, texts, written

#: Sentence ends become line ends; other separators blanks; A-Z a-z; bytes from 0x80 up belong to words.
SENTENCES = bytes(
    10 if b in b".!?\n" else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def sentences(text: bytes) -> list[bytes]:
    return text.translate(SENTENCES).split(b"\n")


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings of 4 to 6 bytes behind a sign that no word holds: inflected forms share these."""
    return [word, *[b"^" + word[:n] for n in range(4, min(7, len(word)))]]


class Known(dict):
    """word -> those of its features that ``wanted`` has; remembers the words it has met, within a bound."""

    def __init__(self, wanted):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        if len(self) >= 200_000:
            self.clear()
        self[word] = found = tuple(f for f in features(word) if f in self.wanted)
        return found

    def __reduce__(self):
        return Known, (self.wanted,)

    def of(self, sentence: bytes) -> set[bytes]:
        return {f for fs in map(self.__getitem__, sentence.split()) if fs for f in fs}


class Scorer:
    """Weights of words, the bias of a sentence, and the leak of a document as a logit."""

    def __init__(self, weights: dict[bytes, float], bias: float, leak: float):
        self.weights, self.bias = weights, bias
        self.leak = math.log1p(math.exp(leak))
        self.known = Known(weights)

    def score(self, text: bytes) -> tuple[float, list[tuple[int, float]]]:
        """(noisy-or over all sentences, scores of sentences with known words)."""
        w = self.weights
        spared, found = 0.0, []
        for k, s in enumerate(sentences(text)):
            if hit := self.known.of(s):
                z = self.bias + sum(w[x] for x in sorted(hit))
                spared += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
                found.append((k, 1 / (1 + math.exp(-z)) if z > -500 else 0.0))
        return -math.expm1(-spared - self.leak), found


def learn(bags: list[tuple[int, list[list[int]]]], words: int, rounds: int = 500, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """(weights, bias, leak) from bags (label, sentences of word numbers): Adam on the noisy-or's log loss."""
    label = np.array([b[0] for b in bags], float)
    owner = np.array([k for k, b in enumerate(bags) for _ in b[1]], np.int64)
    rows = [s for b in bags for s in b[1]]
    flat = np.array([x for s in rows for x in s], np.int64)
    at = np.repeat(np.arange(len(rows)), np.array([len(s) for s in rows], np.int64))
    n = len(bags)
    theta = np.concatenate([np.zeros(words), [-2.0, -4.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        bias, leak = theta[-2:]
        z = bias + np.bincount(at, theta[flat], len(rows)) if len(rows) else np.zeros(0)
        p, q = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-leak))
        spared = np.bincount(owner, np.logaddexp(0, z), n) + np.logaddexp(0, leak)
        doc = np.clip(-np.expm1(-spared), 1e-9, 1.0)
        slope = np.where(label == 1, -(1 - doc) / doc, 1.0) / n
        down = slope[owner] * p
        g = np.concatenate([np.bincount(flat, down[at], words) + ridge * theta[:-2], [down.sum(), slope.sum() * q]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-2], float(theta[-2]), float(theta[-1])


def fit(labelled: DataFrame, fit_rows: int = 20_000, max_words: int = 4_000, min_docs: int = 4, min_gain: float = 9.0, text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Learn from ``labelled`` (text, 0/1 label): a sample of about ``fit_rows`` rows by a hash of the text, each text once.

    ``max_words`` features (words and their beginnings) take part: those in at least ``min_docs`` sampled texts that are likelier in label 1 and tell the labels
    apart best, by a log-likelihood ratio of ``min_gain`` at least.  These bounds are the fit's.  Without both labels every score is 0.
    """
    src = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("y")).dropna().filter("y in (0, 1)")
    per = {r["y"]: r["count"] for r in src.groupBy("y").count().collect()}
    if len(per) < 2:
        return Scorer({}, -60.0, -60.0)
    share = F.create_map(*[F.lit(v) for y, c in per.items() for v in (y, min(1.0, fit_rows / 2 / c))])
    src = src.filter(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_000)) / 1e6 < share[F.col("y")])

    def words_of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        counts: dict[tuple[bytes, int], int] = {}
        for t, y in zip(texts(batch), column(batch, "y").to_pylist()):
            for w in {f for w in set(t.translate(SENTENCES).split()) for f in features(w)}:
                counts[w, y] = counts.get((w, y), 0) + 1
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.binary()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["w", "y", "n"])

    # hot copies would make any of their words look telling: each text counts once
    once = src.withColumn("h", F.xxhash64("text")).groupBy("h", F.octet_length("text").alias("nb")).agg(F.max("y").alias("y"), F.first("text").alias("text")).select("text", "y")
    once = written(once, "labelled")
    try:
        n = {r["y"]: r["count"] for r in once.groupBy("y").count().collect()}
        n0, n1 = max(1, n.get(0, 0)), max(1, n.get(1, 0))
        seen = map_batches(once, words_of, "w binary, y int, n long", gather_bytes=16 << 20).groupBy("w").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
        p = (F.col("a") + F.col("b")) / (n0 + n1)

        def term(count: str, total: int) -> F.Column:
            x = F.col(count).cast("double")
            return F.when(x > 0, x * F.log(x / (total * p))).otherwise(0.0) + F.when(total - x > 0, (total - x) * F.log((total - x) / (total * (1 - p)))).otherwise(0.0)

        gain = F.when(p < 1, term("a", n1) + term("b", n0)).otherwise(0.0)
        telling = seen.filter((F.col("a") + F.col("b") >= min_docs) & (F.col("a") * n0 > F.col("b") * n1)).withColumn("gain", gain)
        best = telling.filter(F.col("gain") >= min_gain).orderBy(F.desc("gain"), "w").limit(max_words).collect()
        number = {bytes(r["w"]): k for k, r in enumerate(best)}
        spark = labelled.sparkSession
        held = spark.sparkContext.broadcast(number)

        def bag(batch: pa.RecordBatch) -> pa.RecordBatch:
            number, known = held.value, Known(held.value)
            bags = [[sorted(number[f] for f in hit) for s in sentences(t) if (hit := known.of(s))] for t in texts(batch)]
            return pa.RecordBatch.from_arrays([column(batch, "y"), pa.array(bags, pa.list_(pa.list_(pa.int32())))], ["y", "bag"])

        rows = map_batches(once, bag, "y int, bag array<array<int>>").orderBy(F.xxhash64("bag"), "y")
        bags = [(r["y"], r["bag"]) for r in rows.toLocalIterator()]
        held.unpersist()
    finally:
        discard(once)
    weights, bias, leak = learn(bags, len(number))
    return Scorer({w: float(weights[k]) for w, k in number.items() if abs(weights[k]) > 1e-3}, bias, leak)


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, offending): offending numbers the sentences whose own probability is 0.5 or more.

    Null and empty texts have no sentence and score 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [held.value.score(t) for t in texts(batch)]
        made = [
            pa.array([f[0] for f in found], pa.float64()),
            pa.array([int(f[0] >= threshold) for f in found], pa.int32()),
            pa.array([[k for k, p in f[1] if p >= 0.5] for f in found], pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays([column(batch, "id"), *made], ["id", "score", "predicted", "offending"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(src, run, "id long, score double, predicted int, offending array<int>").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, scorer: Scorer, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents whose score is below ``threshold``, with their columns, whatever their names, as they are.

    Null and empty texts have no sentence and stay; repeated rows score alike; an empty table stays one.
    """
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([held.value.score(t)[0] < threshold for t in texts(batch, text_col)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
