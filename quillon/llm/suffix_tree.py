"""Language-model scoring with a probabilistic suffix tree.

Symbols are the bytes of lower-cased words, a sign after each word and one at the end of the text; a text begins after DEPTH start
signs.  Contexts of every length up to DEPTH symbols are counted over all training texts.  As in Ron, Singer and Tishby's
algorithm an entry takes part only from a least count up, and a context is retained only if its next-symbol distribution
diverges from its parent's; the count is fixed, so the tree grows with the corpus.  It stays a table in the shared folder.
Distributions are smoothed by their parent's, down to a root that gives each of 256 symbols some mass, so the
probabilities of all texts sum to one.  Each symbol is scored by the longest retained suffix of what stands before it.  A
token's probability is the mean of what the tree's symbols give it and of what the base, its own count, does.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, discard, fold, map_batches, texts, trimmed, written

DEPTH = 5
#: Signs that no UTF-8 text holds: before a text, after a word, end of text.
START, STOP, END = 0xFF, 0xFE, 0xFD
#: Bytes of text whose symbols are counted or scored together.
RUN_BYTES = 1 << 20
#: The tree's share of a token's probability; the base has the rest.
MIX = 0.5


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def symbols(words: list[bytes]) -> bytes:
    """A text's symbols behind its start signs."""
    return bytes([START]) * DEPTH + b"\xfe".join([*words, b""]) + bytes([END])


def keys_of(parts: list[bytes]) -> np.ndarray:
    """Keys of all symbols: DEPTH bytes before, and the symbol, read as one number from eight bytes that begin there."""
    raw = b"".join([*parts, bytes(8)])
    n = len(raw) - 8 - DEPTH
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (np.ndarray((n,), ">u8", raw, strides=(1,)).astype(np.uint64) >> np.uint64(8 * (7 - DEPTH))).view(np.int64)
    ends = np.cumsum([len(p) for p in parts])[:-1]
    real = np.ones(n, bool)
    if len(ends):  # the start signs of a text are no symbols
        real[(ends[:, None] + np.arange(-DEPTH, 0)).ravel()] = False
    return key[real]


def counted_once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, count of each).  Sorting whole integers is several times faster than np.unique."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1]))
    return keys[first], np.diff(np.append(first, len(keys)))


def runs(parts):
    """Lists of parts of about RUN_BYTES, with the number of the first."""
    held, size, first = [], 0, 0
    for k, p in enumerate(parts):
        held.append(p)
        size += len(p)
        if size >= RUN_BYTES:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


class SuffixTree:
    """Smoothed distributions of the retained contexts.  A context of d symbols is known by d and its bytes."""

    def __init__(self, depth: np.ndarray, keys: np.ndarray, counts: np.ndarray, totals: np.ndarray, min_gain: float = 20.0, trust: float = 4.0):
        """keys: context bytes << 8 | symbol; totals: all symbols counted after the entry's context."""
        self.keys, self.value, self.nodes, self.escape = [], [], [], []
        for d in range(DEPTH + 1):
            at = np.flatnonzero(depth == d)
            at = at[np.argsort(keys[at])]
            k, n = keys[at], counts[at].astype(float)
            nodes, first, own = np.unique(k >> 8, return_index=True, return_inverse=True)
            total = totals[at][first].astype(float)
            kept_sum = np.bincount(own, n, len(nodes))
            parent = self.probability(k, d - 1)
            # log-likelihood that the context gains over its parent
            gain = np.bincount(own, n * np.log(n / total[own] / parent), len(nodes))
            keep = gain >= min_gain if d else np.ones(len(nodes), bool)
            rest = total - kept_sum + trust
            use = keep[own]
            self.keys.append(k[use])
            self.value.append(((n + rest[own] * parent) / (total[own] + trust))[use])
            self.nodes.append(nodes[keep])
            self.escape.append((rest / (total + trust))[keep])

    @staticmethod
    def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(where):
            return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
        at = np.minimum(np.searchsorted(where, what), len(where) - 1)
        return at, where[at] == what

    def probability(self, keys: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Of each key's symbol after its context, of which the last ``depth`` symbols count."""
        out, left = np.ones(len(keys)), np.arange(len(keys))
        for d in range(depth, -1, -1):
            k = keys[left] & ((1 << 8 * (d + 1)) - 1)
            at, hit = self._find(self.keys[d], k)
            out[left[hit]] *= self.value[d][at[hit]]
            left, k = left[~hit], k[~hit]
            at, kept = self._find(self.nodes[d], k >> 8)
            out[left[kept]] *= self.escape[d][at[kept]]
        out[left] /= 256
        return out

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each token of a text, its end included."""
        keys = keys_of([symbols(words)])
        return token_sums(keys, np.log10(self.probability(keys)))


def vocabulary(docs: DataFrame, training: Column, text_col: str) -> DataFrame:
    """(word binary, c): each token's count in training rows, 0 for tokens of other rows; the end of a text is empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        others: set[bytes] = {b""}
        for t, trains in zip(texts(batch), column(batch, "trains").to_pylist()):
            if trains:
                seen.update(tokens(t))
                seen[b""] += 1
            else:
                others.update(tokens(t))
        for w in others - seen.keys():
            seen[w] = 0
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    src = docs.select(F.col(text_col).cast("string").alias("text"), training.alias("trains"))
    return map_batches(src, run, "word binary, c long", gather_bytes=32 << 20).groupBy("word").agg(F.sum("c").alias("c"))


#: Occurrences from which an entry takes part, whatever the corpus.
LEAST = 4


def contexts(docs: DataFrame, training: Column, text_col: str = "text") -> DataFrame:
    """(key, n): each symbol of any row with DEPTH symbols before it, and its count in training rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts = [], []
        trains = column(batch, "trains").to_pylist()
        for counted in (True, False):
            for _, parts in runs(symbols(tokens(t)) for t, x in zip(texts(batch), trains) if x is counted):
                k, n = counted_once(keys_of(parts))
                keys.append(k)
                counts.append(n if counted else np.zeros_like(n))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(np.add.reduceat(counts[order], first).astype(np.int64))], ["key", "n"])

    src = docs.select(F.col(text_col).cast("string").alias("text"), training.alias("trains"))
    return map_batches(src, run, "key long, n long", gather_bytes=16 << 20).groupBy("key").agg(F.sum("n").alias("n"))


def _levels(counted: DataFrame) -> list[DataFrame]:
    """Keys of each depth; shorter contexts' counts are sums over what stands before them."""
    out = [counted]
    for d in range(DEPTH - 1, -1, -1):
        out.append(written(out[-1].groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")), "level"))
    return out[::-1]


def fit_tree(training: DataFrame, least: int = LEAST, text_col: str = "text") -> SuffixTree:
    """The tree of all rows of ``training`` in memory, for small corpora; ``key_scores`` gives the same figures from tables."""
    rows = []
    for d, keys in enumerate(_levels(written(contexts(training, F.lit(True), text_col), "contexts"))):
        totals = keys.groupBy(F.shiftright("key", 8).alias("node")).agg(F.sum("n").alias("total"))
        rows.append(keys.filter(F.col("n") >= least).join(totals, F.shiftright("key", 8) == F.col("node")).select("key", "n", "total").toPandas().assign(depth=d))
    depth, keys, n, total = (np.concatenate([r[c].to_numpy(np.int64) for r in rows]) for c in ("depth", "key", "n", "total"))
    return SuffixTree(depth, keys, n, total)


def key_scores(counted: DataFrame, least: int = LEAST, min_gain: float = 20.0, trust: float = 4.0) -> DataFrame:
    """(key, p): the probability of each key's symbol after its context, depth by depth as in ``SuffixTree``."""
    scores = None
    for d, keys in enumerate(_levels(counted)):
        if scores is None:
            rows = keys.withColumn("parent", F.lit(1 / 256))
        else:
            parents = scores.select(F.col("key").alias("suffix"), F.col("p").alias("parent"))
            rows = keys.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * d) - 1))).join(parents, "suffix").drop("suffix")
        rows = rows.withColumn("node", F.shiftright("key", 8))
        part = F.col("n") >= least
        nodes = rows.groupBy("node").agg(
            F.sum("n").alias("total"), F.sum(F.when(part, F.col("n"))).alias("kept"), F.sum(F.when(part, F.col("n") * F.log(F.col("n") / F.col("parent")))).alias("gain"),
        ).filter("kept > 0")
        if d:
            nodes = nodes.filter(F.col("gain") - F.col("kept") * F.log("total") >= min_gain)
        nodes = nodes.select("node", "total", (F.col("total") - F.col("kept") + trust).alias("rest"))
        p = (F.when(part, F.col("n")).otherwise(0) + F.col("rest") * F.col("parent")) / (F.col("total") + trust)
        shorter, scores = scores, written(rows.join(nodes, "node", "left").select("key", F.coalesce(p, "parent").alias("p")), "scores")
        if d:
            discard(shorter)
        if d < DEPTH:
            discard(keys)
    return scores


def mixed(tree: np.ndarray, base: np.ndarray, known: np.ndarray, share: float = MIX) -> np.ndarray:
    """log10 probability of tokens: ``share`` of the tree's (given as log10) and the rest of the base's (given as it is); a token that the
    base does not know is spelled by the tree in either part, so that all tokens' probabilities sum to one."""
    both = np.log(share * np.exp(tree * np.log(10)) + (1 - share) * base) / np.log(10)
    return np.where(known, both, tree + _unknown(base, known, share))


def _unknown(base: np.ndarray, known: np.ndarray, share: float) -> float:
    """What log10 of the tree's figure gains for a token that the base does not know: all of those have one base probability."""
    some = base[~known]
    return float(np.log10(share + (1 - share) * some[0])) if len(some) else 0.0


def token_sums(keys: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """log10 probabilities of the tokens whose symbols have these keys and figures: a token ends with STOP or END."""
    ends = np.flatnonzero(((keys & 0xFF) == STOP) | ((keys & 0xFF) == END))
    return np.add.reduceat(log_p, np.append(0, ends[:-1] + 1)) if len(ends) else np.zeros(0)


def lm_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 32 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Null texts are empty: their only token is the end.  If no row trains, N and V are 0.  Repeated rows are scored each; an
    empty table gives no rows.  Documents are dealt to chunks of about ``chunk_bytes``; each chunk fetches the counts of its own distinct
    words and the scores of its own distinct keys, so neither vocabulary nor tree need fit anywhere whole, and a frequent
    word is asked for once a chunk.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("trains"))
    words = written(vocabulary(docs, F.col("trains"), "text"), "vocabulary")
    total, distinct = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    counted = written(contexts(docs, F.col("trains")), "contexts")
    scores = key_scores(counted)
    discard(counted)
    base_of = float(np.log10(total + distinct + 1))
    size = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-size // chunk_bytes))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
    dealt = written(dealt.repartitionById(n, "chunk").sortWithinPartitions("chunk"), "dealt")

    def asked(batches):
        block, seen, size = None, set(), 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([block] * len(seen), pa.int32()), pa.array(list(seen), pa.binary())], ["chunk", "word"])

        for batch in batches:
            for k, t in zip(column(batch, "chunk").to_pylist(), texts(batch)):
                if k != block or len(seen) > 400_000:
                    if seen:
                        yield out()
                    block, seen = k, {b""}
                seen.update(tokens(t))
        if seen:
            yield out()
        trimmed()

    def asked_keys(batches):
        block, held = None, []

        def out():
            keys = counted_once(np.concatenate(held))[0]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block, np.int32)), pa.array(keys)], ["chunk", "key"])

        for batch in batches:
            chunk = column(batch, "chunk").to_numpy(zero_copy_only=False)
            those = [symbols(tokens(t)) for t in texts(batch)]
            edges = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(chunk)]):
                if chunk[a] != block:
                    if held:
                        yield out()
                    block, held = int(chunk[a]), []
                held += [counted_once(keys_of(parts))[0] for _, parts in runs(those[a:b])]
                if sum(map(len, held)) > 4_000_000:
                    held = [counted_once(np.concatenate(held))[0]]
                if len(held[0]) > 2_000_000:  # asked in several parts
                    yield out()
                    held = []
        if held:
            yield out()
        trimmed()

    wanted = dealt.select("chunk", "text").mapInArrow(asked, "chunk int, word binary")
    needed = dealt.select("chunk", "text").mapInArrow(asked_keys, "chunk int, key long")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    # of kind 0: a word and its count; 1: a key and the logarithm of its probability; 2: a document, its id as key
    word_rows = wanted.join(words, "word").select("chunk", F.lit(0).alias("kind"), F.col("c").alias("key"), none("float", "p"), F.col("word").cast("string").alias("text"), none("boolean", "trains"))
    key_rows = needed.join(scores, "key").select("chunk", F.lit(1).alias("kind"), "key", F.log10("p").cast("float").alias("p"), none("string", "text"), none("boolean", "trains"))
    own = dealt.select("chunk", F.lit(2).alias("kind"), F.col("id").alias("key"), none("float", "p"), "text", "trains")
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(batches):
        number, c, keys, p, index, log_p, chance, ready = {}, [], [], [], None, None, None, False
        for batch in batches:
            kind = column(batch, "kind").to_numpy(zero_copy_only=False)
            edges = np.searchsorted(kind, [1, 2])
            own, asked_for, documents = batch.slice(0, edges[0]), batch.slice(edges[0], edges[1] - edges[0]), batch.slice(edges[1])
            if own.num_rows:
                c.append((np.array([number.setdefault(w, len(number)) for w in texts(own)]), column(own, "key").to_numpy(zero_copy_only=False)))
            if asked_for.num_rows:
                keys.append(column(asked_for, "key").to_numpy(zero_copy_only=False))
                p.append(column(asked_for, "p").to_numpy(zero_copy_only=False))
            if not documents.num_rows:
                continue
            if not ready:
                count = np.zeros(len(number), np.int64)
                for at, those in c:
                    count[at] = those
                base, known = np.log10(count + 1) - base_of, count > 0
                chance = 10.0**base
                keys, p = np.concatenate(keys), np.concatenate(p)
                once = ~pd.Index(keys).duplicated()  # a key that was asked in several parts
                index, log_p, ready = pd.Index(keys[once]), p[once].astype(float), True
                c, keys, p = [], [], []
            rows = list(zip(column(documents, "key").to_pylist(), texts(documents), column(documents, "trains").to_pylist()))
            for at in range(0, len(rows), 256):
                part = [(i, tokens(t), trains) for i, t, trains in rows[at : at + 256]]
                out = []
                for first, those in runs(symbols(x[1]) for x in part):
                    key = keys_of(those)
                    tree = token_sums(key, log_p[index.get_indexer(key)])
                    ids = np.array([number[w] for x in part[first : first + len(those)] for w in (*x[1], b"")])
                    score = mixed(tree, chance[ids], known[ids])
                    lengths = np.array([len(x[1]) + 1 for x in part[first : first + len(those)]])
                    starts = np.cumsum(lengths) - lengths
                    sums = [np.add.reduceat(v, starts).tolist() for v in (known[ids].astype(np.int64), base[ids], score)]
                    out += [(x[0], not x[2], n, k, total, b, s) for x, n, k, b, s in zip(part[first : first + len(those)], lengths.tolist(), *sums)]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out), kinds)], names)
        trimmed()

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = word_rows.unionByName(key_rows).unionByName(own).repartitionById(n, "chunk").sortWithinPartitions("kind")
    return rows.mapInArrow(scored, schema).withColumnRenamed("id", id_col)


def trains(doc_id: Column) -> Column:
    return fold(doc_id, 7) != 2
