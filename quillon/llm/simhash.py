"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The perfect binary Golay code (23, 12, 7) decodes
any 23-bit segment to one codeword, known by a 12-bit index; decoding also the segment's one-bit neighbours gives
the index of every segment at distance one.  Three errors over three segments leave, by the pigeonhole principle,
either an exact segment beside one with at most one error, or exactly one error in each:

* six ordered pairs (P exact, Q within one): key = 23 bits of P and the Golay index of Q;
* one error everywhere: key = Golay indices of the first two segments, their parities, and the exact half of the last
  segment with the parity of its other half.

Each distinct fingerprint is stored under its own index and looked up under its neighbours' indices; matches are
verified by the count of differing bits.  Keys hold 35 bits or more, so chance collisions stay rare at any size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, components, discard, free_names, map_batches, release, texts, trimmed, written

#: Generator polynomial of the (23, 12, 7) code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Lowest bit and width of each segment.
SEGMENTS = ((41, 23), (18, 23), (0, 18))


def _remainders(values: np.ndarray) -> np.ndarray:
    r = values.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= ((r >> bit) & 1) * (GENERATOR << (bit - 11))
    return r


def _leaders() -> np.ndarray:
    """Error pattern of weight 3 at most for each of the 2,048 syndromes."""
    ones = [1 << i for i in range(23)]
    errors = [0, *ones]
    errors += [a | b for i, a in enumerate(ones) for b in ones[:i]]
    errors += [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]
    out = np.zeros(2048, np.int64)
    out[_remainders(np.array(errors))] = errors
    return out


LEADERS = _leaders()


def golay_index(values: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit value."""
    return (values ^ LEADERS[_remainders(values)]) >> 11


def near_indices(values: np.ndarray, width: int) -> np.ndarray:
    """Indices that the values and their one-bit neighbours decode to; one row each, sorted."""
    flips = np.array([0] + [1 << i for i in range(width)], np.int64)
    return np.sort(golay_index(values[:, None] ^ flips[None, :]), axis=1)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """True where a sorted row's entry differs from the one before."""
    return np.concatenate([np.ones((len(rows), 1), bool), rows[:, 1:] != rows[:, :-1]], axis=1)


def _parity(v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(v.astype(np.uint64)).astype(np.int64) & 1


def golay_keys(fingerprints: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys) of each uint64 fingerprint: as stored, or as looked up (probe)."""
    seg = [((fingerprints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    rows, keys = [], []
    n = np.arange(len(fingerprints))
    near = [near_indices(s, w) if probe else golay_index(s)[:, None] for s, (_, w) in zip(seg, SEGMENTS)]
    use = [_distinct(x) for x in near]
    for kind, (p, q) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))):
        r, c = np.nonzero(use[q])
        rows.append(n[r])
        keys.append(kind << 40 | seg[p][r] << 12 | near[q][r, c])
    ra, ca = np.nonzero(use[0])
    counts = use[1].sum(1)
    starts = np.concatenate([[0], np.cumsum(counts)])
    cb = np.nonzero(use[1])[1]
    rep = counts[ra]
    r = np.repeat(ra, rep)
    a = np.repeat(near[0][ra, ca], rep)
    within = np.arange(len(r)) - np.repeat(np.cumsum(rep) - rep, rep)
    b = near[1][r, cb[starts[r] + within]]
    flip = 1 if probe else 0
    low, high = seg[2] & 511, seg[2] >> 9
    sides = (_parity(seg[0]) ^ flip) << 1 | _parity(seg[1]) ^ flip
    for kind, (exact, other) in enumerate(((low, high), (high, low)), 6):
        rows.append(r)
        keys.append(kind << 40 | a << 24 | b << 12 | sides[r] << 10 | exact[r] << 1 | (_parity(other)[r] ^ flip))
    return np.concatenate(rows), np.concatenate(keys)


def _hashes(text: bytes, shingle: int, digest) -> bytes:
    """Digests of a text's word shingles, in order, repeats included; of the whole sequence where it is shorter."""
    words = text.lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= shingle:
        return digest(joined)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    return b"".join([digest(joined[a:b]) for a, b in zip(starts, ends[shingle - 1 :].tolist())])


def _majority(digests: bytes, size: int) -> bytes:
    """Bits set in over half of the digests of ``size`` bytes."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, size)
    total = np.zeros(8 * size, np.int64)
    for at in range(0, len(rows), 32768):
        total += np.unpackbits(rows[at : at + 32768], axis=1).sum(0, dtype=np.int32)
    return np.packbits(total * 2 > len(rows)).tobytes()


def simhash(text: bytes, shingle: int = 3) -> int:
    """64-bit fingerprint of a text's word shingles: a bit is set if it is set in over half the XXH64 values."""
    return int.from_bytes(_majority(_hashes(text, shingle, lambda x: xxhash.xxh64_digest(x, 42)), 8), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; whole texts, words split at ASCII white space, A-Z lower-cased.  Null text: no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([simhash(t, shingle) for t in texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(fps)], ["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(src, run, "id long, fp long")


def _key_rows(probe: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = column(batch, "fp").to_numpy(zero_copy_only=False)
        parts = []
        for at in range(0, len(fps), 2048):
            rows, keys = golay_keys(fps[at : at + 2048].view(np.uint64), probe)
            parts.append((fps[at + rows], keys))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[1] for p in parts])), pa.array(np.concatenate([p[0] for p in parts]))], ["key", "fp"])

    return run


def near_links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b), a < b, between distinct ``fp`` values that differ in at most ``distance`` (3 or fewer) bits."""
    if not 0 <= distance <= 3:
        raise ValueError("the segments' pigeonhole covers 0 to 3 differing bits")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = distinct.select("fp").repartition(n, "fp")
    stored = map_batches(fps, _key_rows(False), "key long, fp long").withColumnRenamed("fp", "a")
    looked = map_batches(fps, _key_rows(True), "key long, fp long").withColumnRenamed("fp", "b")
    pairs = stored.join(looked.hint("merge"), "key").filter("a < b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return pairs.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint hex, component_id): documents linked through fingerprints that differ in few bits.

    Equal fingerprints form one class that is stored and looked up once, so copies cost no pairs.  Null or empty texts
    have fingerprint zero and are linked like any other.  component_id is the smallest id of the component, null only if it
    has none; repeated rows stay.  No join is broadcast, as that would gather a table as large as the corpus has links on the driver.
    """
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fps")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    found = components(near_links(classes, distance).select(F.col("a").alias("u"), F.col("b").alias("v")))
    grouped = written(classes.join(found.hint("merge"), classes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "grouped")
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    # a fingerprint that a third of all rows share is split by the adaptive skew join
    ids = grouped.join(least.hint("merge"), "component").select("fp", "component_id")
    out = fps.join(ids.hint("merge"), "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    return np.unique(np.frombuffer(_hashes(text, shingle, lambda x: xxhash.xxh64_digest(x, 42)), ">u8").astype(np.uint64).view(np.int64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


#: Bits of a parity print: bit k tells whether an odd number of a set's shingles fall on k.
PARITY = 192


def parity_print(shingles: np.ndarray) -> bytes:
    """24 bytes; two sets differ in at least as many shingles as their prints differ in bits."""
    return np.packbits(np.bincount(shingles.view(np.uint64) % np.uint64(PARITY), minlength=PARITY).astype(np.uint8) & 1).tobytes()


def wide_print(shingles: np.ndarray) -> np.ndarray:
    """A set's size, and a parity print of a power of two of bits, at least one for each shingle and 64 in all, in words of 64."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount(shingles & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.append(np.int64(len(shingles)), np.packbits(odd, bitorder="little").view("<i8").astype(np.int64))


def may_be_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """False only if two sets, known by their wide prints, cannot have that similarity: they differ in at least as many shingles as
    their prints in bits.  The longer print is folded, as an odd count of two halves is that of the whole."""
    both = int(a[0] + b[0])
    a, b = (a[1:], b[1:]) if len(a) >= len(b) else (b[1:], a[1:])
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    need = int(np.ceil(similarity / (1 + similarity) * both - 1e-9))
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum(dtype=np.int64)) <= both - 2 * need


def prefix(shingles: np.ndarray, common: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in one order of all shingles, so many that similar sets share one of them.

    The order: shingles that are not ``common`` (sorted; ``ranks`` of at least 1 beside them), then by rank; by value in each.
    Any order finds every pair; rare shingles first keep the groups small.
    """
    rank = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        hit = common[at] == shingles
        rank[hit] = ranks[at[hit]]
    least = int(np.ceil(similarity * len(shingles) - 1e-9))
    return shingles[np.lexsort((shingles, rank))][: len(shingles) - least + 1]


def common_shingles(src: DataFrame, shingle: int, sampled: int = 20_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) that three or more of about ``sampled`` texts hold.  They only order the shingles of a prefix."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate([shingle_set(t, shingle) for t in texts(batch)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    share = max(1, src.count() // sampled)
    some = map_batches(src.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0), run, "key long, n long")
    found = some.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 2").orderBy(F.desc("n"), "key").limit(most).toPandas().sort_values("key")
    return found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def close_rows(keys: np.ndarray, sizes: np.ndarray, places: np.ndarray, prints: list[np.ndarray], similarity: float, groups: np.ndarray, whole: bool = False) -> np.ndarray:
    """Two rows of numbers: pairs of rows, sorted by key, of two ``groups`` that can be similar.

    A spanning forest of each key's groups, closest prints first; or, if ``whole``, every such pair.

    A pair cannot be if the sets' sizes, the shingles left behind the key's ``places`` in their orders, or the bits in which
    the parity prints differ leave too few in common; no similar pair is dropped at the first shingle that it shares.
    """
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(keys))  # rows of the key from here on
    run = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    order = np.lexsort((groups, run))
    label = np.empty(len(keys), np.int64)  # of a group under one key
    label[order] = np.cumsum(np.append(False, (run[order][1:] != run[order][:-1]) | (groups[order][1:] != groups[order][:-1])))
    after = sizes - places
    parent: dict[int, int] = {}
    out, held, count = [], [], 0

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def settle() -> None:
        if held:
            i, o, d = (np.concatenate(c) for c in zip(*held))
            at = np.argsort(d, kind="stable")
            for x, y in zip(i[at].tolist(), (i + o)[at].tolist()):
                a, b = find(int(label[x])), find(int(label[y]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((x, y))
            held.clear()

    def every() -> np.ndarray:
        return np.concatenate([np.stack([i, i + o]) for i, o, _ in held], axis=1) if held else np.zeros((2, 0), np.int64)

    at, offset = np.flatnonzero(left > 1), 1
    while len(at):
        to = at + offset
        both = sizes[at] + sizes[to]
        need = np.ceil(similarity / (1 + similarity) * both - 1e-9).astype(np.int64)
        d = sum(np.bitwise_count(p[at] ^ p[to]).astype(np.int64) for p in prints)
        ok = (d <= both - 2 * need) & (np.minimum(after[at], after[to]) >= need) & (groups[at] != groups[to])
        if ok.any():
            held.append((at[ok], np.full(int(ok.sum()), offset), d[ok]))
            count += int(ok.sum())
        if count >= 500_000 and not whole:
            settle()
            count = 0
        offset += 1
        at = at[left[at] > offset]
    if whole:
        return every()
    settle()
    return np.array(out, np.int64).reshape(-1, 2).T


#: Bits of a bitmap of keys, whatever their number: 8 MB.
BITMAP = 1 << 26


def bitmap(keys: DataFrame, name: str) -> np.ndarray:
    """BITMAP bits in words of 64, set where a key of the column falls by its lowest bits.  Rows for the driver: BITMAP / 64 at most."""
    place = F.col(name).bitwiseAND(F.lit(BITMAP - 1))
    words = keys.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, int({name} & 63))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BITMAP // 64, np.int64)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that were not among the bitmap's; true for all that were, and for others by chance."""
    return (bits[(keys & (BITMAP - 1)) >> 6] >> (keys & 63) & 1).astype(bool)


def as_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("d").alias("u"), F.col("d_").alias("v"))


#: Texts whose sets meet in one block, about.
BLOCK_TEXTS = 512


def passing(pairs: DataFrame, sets: DataFrame, test: Callable[[np.ndarray, np.ndarray], bool], tag: str) -> DataFrame:
    """The pairs (d, d_) whose rows ``s`` in ``sets`` (d, s array<long>) pass the test.

    Pairs meet in blocks: a component of all pairs, or, if that has many texts, a part of it for the pairs between two parts of
    its texts.  So a row travels once for each block that asks for it, not once for each pair, and no block grows with its group.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(components(as_edges(pairs)), "candidates")
    parts = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_TEXTS).alias("parts"))
    dealt = pairs.join(found.join(parts, "component"), F.col("d") == F.col("node"))
    part = lambda d: F.pmod(F.xxhash64(d, F.lit(1)), F.col("parts"))
    dealt = written(dealt.select(F.xxhash64("component", part("d"), part("d_")).alias("block"), "d", "d_"), "dealt")
    asked = dealt.select("block", F.explode(F.array("d", "d_")).alias("d")).distinct()
    held = pairs.sparkSession.sparkContext.broadcast(bitmap(dealt.select(F.explode(F.array("d", "d_")).alias("d")), "d"))

    def wanted(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(in_bitmap(held.value, column(batch, "d").to_numpy(zero_copy_only=False)), pa.bool_()))

    rows = map_batches(sets, wanted, sets.schema).join(asked, "d").select("block", "d", F.lit(None).cast("long").alias("d_"), "s")
    rows = rows.unionByName(dealt.select("block", "d", "d_", F.lit(None).cast("array<long>").alias("s")))

    def compare(batches):
        block, known = None, {}
        for batch in batches:
            links = []
            keys, ds, others, s = (column(batch, c) for c in ("block", "d", "d_", "s"))
            values, offsets = s.values.to_numpy(zero_copy_only=False), s.offsets.to_numpy()
            for k, (key, d, other) in enumerate(zip(keys.to_pylist(), ds.to_pylist(), others.to_pylist())):
                if key != block:
                    block, known = key, {}
                if other is None:
                    known[d] = values[offsets[k] : offsets[k + 1]]
                elif test(known[d], known[other]):
                    links.append((d, other))
            known = {d: x.copy() if x.base is not None else x for d, x in known.items()}  # not the whole batch
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["d", "d_"])
        trimmed()

    # a block's rows of ``sets`` come before its pairs
    out = written(rows.repartition(n, "block").sortWithinPartitions("block", F.col("d_").asc_nulls_first()).mapInArrow(compare, "d long, d_ long"), tag)
    discard(found, dealt)
    held.unpersist()
    return out


def fingerprint_pairs(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (d, d_), d < d_, of texts (d, fp) whose fingerprints the Golay keys link.

    A link of two fingerprints is that of their first texts, and texts of one fingerprint are each paired with its first: chains of
    pairs connect what near_duplicates does, whatever the number of texts under a fingerprint.
    """
    classes = written(prints.groupBy("fp").agg(F.min("d").alias("first")), "classes")
    same = prints.join(classes.hint("merge"), "fp").select(F.col("first").alias("x"), F.col("d").alias("y"))
    ends = [classes.select(F.col("fp").alias(k), F.col("first").alias(name)).hint("merge") for k, name in (("a", "x"), ("b", "y"))]
    near = near_links(classes, distance).join(ends[0], "a").join(ends[1], "b").select("x", "y")
    return same.unionByName(near).filter("x <> y").select(F.least("x", "y").alias("d"), F.greatest("x", "y").alias("d_"))


def similar_texts(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, text_col: str = "text") -> DataFrame:
    """(d, component): texts (by XXH64 of their lower-cased words) that chains of similar texts connect.

    A link is a pair whose sets of ``shingle`` words have a Jaccard similarity of ``similarity`` or more, verified exactly.
    The first candidates are the pairs whose fingerprints, as those of near_duplicates, the Golay keys link; those verified make groups.
    As similar sets may have fingerprints farther apart, an exact search between the groups follows.  Its candidates share a shingle of their prefixes, which every such pair does; pairs whose wide prints differ in too many bits leave
    before their sets are made.  Of the candidates of one key a
    spanning forest, closest pairs first, is verified: a group of m near copies costs m - 1 verifications a key.  Then every
    other candidate pair is verified whose texts are still apart, so no link between two components is left.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(text_col).cast("string").alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(src, shingle))

    def listed(sets: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(s) for s in sets]), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))

    def prefixes(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = texts(batch)
        sets = [shingle_set(x, shingle) for x in t]
        v = np.frombuffer(b"".join(map(parity_print, sets)), ">i8").astype(np.int64).reshape(-1, 3)
        first = listed([prefix(s, *common.value, similarity) for s in sets])
        wide = listed([wide_print(s) for s in sets])
        fps = pa.array(np.array([simhash(x) for x in t], np.uint64).view(np.int64))
        cols = [pa.array([same_words(x) for x in t], pa.int64()), fps, pa.array([len(s) for s in sets], pa.int64()), *(pa.array(v[:, k]) for k in range(3)), wide, first]
        return pa.RecordBatch.from_arrays(cols, ["d", "fp", "n", "v0", "v1", "v2", "w", "s"])

    def links(pairs: DataFrame) -> DataFrame:
        """The similar ones of the pairs.  Whole sets are made for the texts of pairs whose wide prints are alike, alone."""
        alike = passing(pairs, every.select("d", F.col("w").alias("s")), lambda a, b: may_be_similar(a, b, similarity), "alike")
        ends = alike.select(F.explode(F.array("d", "d_")).alias("d")).distinct()
        asked = spark.sparkContext.broadcast(bitmap(ends, "d"))

        def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
            t = texts(batch)
            d = np.array([same_words(x) for x in t], np.int64)
            some = np.flatnonzero(in_bitmap(asked.value, d))
            return pa.RecordBatch.from_arrays([pa.array(d[some]), listed([shingle_set(t[k], shingle) for k in some.tolist()])], ["d", "s"])

        sets = written(map_batches(src, shingles, "d long, s array<long>", 200).dropDuplicates(["d"]).join(ends, "d", "left_semi"), "shingles")
        release(spark)
        near = passing(alike, sets, lambda a, b: jaccard(a, b) >= similarity, "links")
        asked.unpersist()
        discard(alike, sets)
        return near

    # copies of a text leave here; the rest is one row for each different text
    every = written(map_batches(src, prefixes, "d long, fp long, n long, v0 long, v1 long, v2 long, w array<long>, s array<long>").dropDuplicates(["d"]), "prefixes")

    def linked(batches, whole: bool):
        held: list[pa.RecordBatch] = []

        def pairs(rows: pa.Table):
            key, d, groups, sizes, places, *v = (rows.column(c).to_numpy() for c in ("key", "d", "c", "n", "i", "v0", "v1", "v2"))
            x, y = close_rows(key, sizes, places, [x.view(np.uint64) for x in v], similarity, groups, whole)
            if len(x):
                both = np.stack([np.minimum(d[x], d[y]), np.maximum(d[x], d[y])])[:, np.lexsort((np.maximum(d[x], d[y]), np.minimum(d[x], d[y])))]
                both = both[:, np.append(True, (both[:, 1:] != both[:, :-1]).any(0))]
                for at in range(0, both.shape[1], 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(b[at : at + 100_000]) for b in both], ["d", "d_"])

        for batch in batches:
            held.append(batch)
            key = column(batch, "key").to_numpy(zero_copy_only=False)
            if sum(b.num_rows for b in held) >= 100_000 and (cut := int(np.searchsorted(key, key[-1]))):
                yield from pairs(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield from pairs(pa.Table.from_batches(held))

    def candidates(groups: DataFrame, how: str, whole: bool = False) -> DataFrame:
        """Pairs between the groups (d, c); by a left join texts in none are groups of their own."""
        rows = every.drop("fp", "w").join(groups.hint("merge"), "d", how).withColumn("c", F.coalesce("c", "d"))
        rows = rows.select(*(c for c in rows.columns if c != "s"), F.posexplode("s").alias("i", "key"))
        return rows.repartition(n, "key").sortWithinPartitions("key", "d").mapInArrow(lambda batches: linked(batches, whole), "d long, d_ long").distinct()

    prints = written(fingerprint_pairs(every.select("d", "fp")), "prints")
    release(spark)
    sure = links(prints)
    first = components(as_edges(sure)).select(F.col("node").alias("d"), F.col("component").alias("c"))
    first = written(first, "first")
    pairs = written(candidates(first, "left"), "pairs")
    release(spark)
    ends = pairs.select(F.explode(F.array("d", "d_")).alias("d")).unionByName(first.select("d")).distinct()
    near = links(pairs)
    found = components(as_edges(sure.unionByName(near)))
    group = written(ends.join(found, F.col("d") == F.col("node"), "left").select("d", F.coalesce("component", "d").alias("c")), "groups")
    release(spark)
    apart = pairs.join(group, "d").join(group.select(F.col("d").alias("d_"), F.col("c").alias("c_")), "d_").filter("c <> c_")
    if not apart.isEmpty():
        # where all pairs of a key's forest are linked, so are all its texts: the others' texts are among ``ends``
        rest = written(candidates(group, "inner", True).join(pairs.unionByName(prints), ["d", "d_"], "left_anti"), "rest")
        release(spark)
        more = links(rest)
        found = components(as_edges(sure.unionByName(near).unionByName(more)))
        discard(rest, more)
    out = written(every.select("d").join(found, F.col("d") == F.col("node"), "left").select("d", F.coalesce("component", "d").alias("component")), "similar")
    discard(every, prints, sure, first, pairs, near, group)
    common.unpersist()
    return out


def same_words(text: bytes) -> int:
    """Signed XXH64 of a text's lower-cased words: equal for texts that differ in case or white space only."""
    h = xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 7)
    return h - (1 << 64) if h >> 63 else h


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row, that of the smallest id (null last), of each group of similar texts; see similar_texts.

    Null, empty and blank texts have no words and are one group.  Rows alike in id and words count as one.  All columns, whatever
    their names, stay as they are; an empty table stays one.
    """
    names = docs.columns
    mark, number, none, best_id, best_none, best_words = free_names(names, "words", "number", "none", "best_id", "best_none", "best_words")
    schema = docs.select(F.lit(0).cast("long").alias(mark), "*").schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([same_words(t) for t in texts(batch, text_col)], pa.int64()), *batch.columns], [mark, *names])

    own_id = F.col(id_col).cast("long")
    marked = map_batches(docs, run, schema).select("*", F.coalesce(own_id, F.lit(0)).alias(number), own_id.isNull().alias(none))
    groups = similar_texts(docs, similarity, shingle, text_col=text_col)

    def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([same_words(t) for t in texts(batch)], pa.int64())], ["id", "d"])

    ids = map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), narrow, "id long, d long")
    first = ids.groupBy("d").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("i"))
    best = first.join(groups, "d").groupBy("component").agg(F.min(F.struct("i", "d")).alias("b"))
    best = best.select(F.coalesce("b.i.id", F.lit(0)).alias(best_id), F.col("b.i.none").alias(best_none), F.col("b.d").alias(best_words))
    alike = (F.col(mark) == F.col(best_words)) & (F.col(number) == F.col(best_id)) & (F.col(none) == F.col(best_none))
    # the join's keys are those of the repeats, so texts are shuffled once
    return marked.join(best.hint("shuffle_hash"), alike, "left_semi").dropDuplicates([mark, number, none]).select(*names)
