import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillon.llm import anchors, common, decontaminate, language, licences, media, packing, sharding, simhash, suffix_tree, suffixes, toxicity
from quillon.llm.common import components

EXTRA = "doc_id long, text string, lang string, score double, n_words long, key long, starts string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns whose names the operators use themselves."""
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [None, "", "  \n", "a", "the mit license here", passage, f"x {passage} y", passage, "word " * 30_000, "é" * 300, "under the GNU General Public License"]
    rows = [(i, t, "en", 0.5, 1, 2, "s") for i, t in enumerate(texts)] + [(3, "a", None, None, None, None, None), (None, "b b", None, None, None, None, None)]
    return spark.createDataFrame(rows, EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, one_task):
    monkeypatch.setattr(common, "ONE_TASK", one_task)
    rng = np.random.default_rng(2)
    pairs = [tuple(p) for p in rng.integers(-400, 400, (500, 2)).tolist()] + [(-(1 << 63), (1 << 63) - 1)]
    group = {x: x for p in pairs for x in p if p[0] != p[1]}
    for a, b in (p for p in pairs if p[0] != p[1]):
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = {k: new if g == old else g for k, g in group.items()}
    assert {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()} == group


def test_golay_keys_find_every_close_pair():
    rng = np.random.default_rng(3)
    u = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    v = u.copy()
    for i in range(len(v)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            v[i] ^= np.uint64(1) << np.uint64(b)
    stored = set(zip(*(x.tolist() for x in simhash.golay_keys(u, False))))
    hit = {r for r, k in zip(*(x.tolist() for x in simhash.golay_keys(v, True))) if (r, k) in stored}
    assert len(hit) == len(u)


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, awkward):
    rows = awkward.collect()
    got = simhash.near_duplicates(awkward).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, f"{brute_simhash(r.text):016x}") for r in rows)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {0}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5, 8, 9, 10]


def test_near_duplicates_gather_no_table_on_the_driver(spark, monkeypatch):
    """Tables this small are broadcast wherever Spark is free to."""
    plans = []

    def noted(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.written(df, tag)

    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(common, "ONE_TASK", 0)
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t {'x' if i % 3 else 'y'}") for i in range(60)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    links = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"))
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (found, links)]
    assert len(plans) == 5 and not [x for x in plans if "Broadcast" in x]


def made_words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1_000_000, n)]


def test_near_copies_with_repeated_lines(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        words, line = made_words(rng, 200), made_words(rng, 8)
        rows += [(2 * k, " ".join(words + line)), (2 * k + 1, " ".join(words + line * (8 if k % 2 else 50)))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [2 * k for k in range(12)]


def brute_groups(texts):
    """The texts' numbers by group, every pair compared."""
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in texts]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def kept_of(spark, texts):
    return sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect())


def test_pairs_close_to_the_threshold_are_linked(spark):
    rng = np.random.default_rng(4)
    texts = []
    for size in (8, 9, 12, 40, 200):
        for k in range(8):
            words = made_words(rng, size)
            more = max(1, (size - 4) // 4 - k % 2)
            texts += [" ".join(words), " ".join(words + made_words(rng, more))]
            at = int(rng.integers(0, size))
            words[at : at + size // 12 + k % 2] = made_words(rng, size // 12 + k % 2)
            texts.append(" ".join(words))
    group = brute_groups(texts)
    assert 40 < len(set(group)) < 120
    assert kept_of(spark, texts) == sorted(group.index(g) for g in set(group))


def test_wide_prints_drop_no_similar_pair():
    rng = np.random.default_rng(6)
    assert simhash.may_be_similar(simhash.wide_print(np.zeros(0, np.int64)), simhash.wide_print(np.zeros(0, np.int64)), 0.8)
    dropped = 0
    for n in (1, 2, 60, 64, 65, 120, 130, 1000, 1025, 5000):
        for _ in range(30):
            a = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
            for share in (0.0, 0.5, 0.8, 0.9, 1.0):
                more = rng.integers(-(1 << 63), (1 << 63) - 1, int(rng.integers(0, n // 4 + 1)))
                b = np.unique(np.append(a[: int(share * n + 0.5)], more if share else rng.integers(-(1 << 63), (1 << 63) - 1, n)))
                x, y = simhash.wide_print(a), simhash.wide_print(b)
                may = simhash.may_be_similar(x, y, 0.8)
                assert may == simhash.may_be_similar(y, x, 0.8)
                assert may or simhash.jaccard(a, b) < 0.8
                dropped += not share and n >= 120 and not may
    assert dropped == 150


def test_links_behind_a_failed_pair_are_found(spark, monkeypatch):
    """Of windows over one text a-b and b-c are linked (19 of 21 and 18 of 22 shingles); a-c (17 of 23) can be a closer candidate than b-c."""
    # as in a corpus far larger than the sample that orders shingles
    monkeypatch.setattr(simhash, "common_shingles", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(1000):
        w = made_words(rng, 27)
        texts += [" ".join(w[at : at + 24]) for at in (0, 1, 3)]
    assert len(set(brute_groups(texts[:3]))) == 1
    assert kept_of(spark, texts) == list(range(0, 3000, 3))


def test_fingerprints_link_near_copies_first(spark, monkeypatch):
    """Near copies whose fingerprints differ in few bits are linked by these, and only the others by a search for shared shingles."""
    tables = {}

    def noted(df, tag):
        out = common.written(df, tag)
        tables.setdefault(tag, []).extend(tuple(r) for r in out.collect() if tag in ("prints", "pairs"))
        return out

    monkeypatch.setattr(simhash, "written", noted)
    rng = np.random.default_rng(8)
    texts = []
    for size in (3000, 24):
        for _ in range(10):
            words = made_words(rng, size)
            texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    assert kept_of(spark, texts) == list(range(0, 40, 2))
    keys = [simhash.same_words(t.encode()) for t in texts]
    copies = {tuple(sorted(keys[i : i + 2])): (brute_simhash(texts[i]) ^ brute_simhash(texts[i + 1])).bit_count() <= 3 for i in range(0, 40, 2)}
    assert 8 <= sum(copies.values()) < 20
    assert set(tables["prints"]) == {p for p, close in copies.items() if close}
    assert set(tables["pairs"]) == {p for p, close in copies.items() if not close}


def test_repeats_equal_brute_force(spark, awkward):
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    flat = [t for ts in texts.values() for t in ts if len(t) < 20_000]
    seen = Counter(t[i : i + 200] for t in flat for i in range(len(t) - 199))
    for r in suffixes.without_repeats(awkward).collect():
        t = next(x for x in texts[r.doc_id] if len(x) == r.n_bytes)
        if len(t) < 20_000:
            gone = {i + j for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1 for j in range(200)}
            kept = bytes(b for i, b in enumerate(t) if i not in gone)
            assert (r.n_removed, r.kept_sha256) == (len(gone), hashlib.sha256(kept).hexdigest())
        else:
            assert r.n_removed == r.n_bytes and r.n_spans == 1
    assert suffixes.without_repeats(empty(spark)).count() == 0
    assert suffixes.cut(awkward).columns == awkward.columns


def check_repeats(spark, texts):
    """without_repeats of the texts, against every window of every text."""
    raw = [t.encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    got = {r.doc_id: r for r in suffixes.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, t in enumerate(raw):
        gone = {k + j for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1 for j in range(200)}
        kept = bytes(b for k, b in enumerate(t) if k not in gone)
        assert (got[i].n_removed, got[i].kept_sha256) == (len(gone), hashlib.sha256(kept).hexdigest()), i


def letters(rng, n):
    return bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()


def test_a_passage_that_many_texts_share(spark, monkeypatch):
    rng = np.random.default_rng(5)
    shared = letters(rng, 400)
    texts = [letters(rng, int(rng.integers(0, 300))) + shared[int(rng.integers(0, 150)) :] + letters(rng, int(rng.integers(0, 60))) for _ in range(1500)]
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 20_000)  # the shared strings are dealt to many buckets
    check_repeats(spark, texts)


def test_passages_that_overlap_and_differ_by_a_byte(spark):
    rng = np.random.default_rng(6)
    base = letters(rng, 900)
    texts = [base[a : a + n] for a, n in ((0, 250), (30, 400), (31, 199), (200, 200), (201, 200), (500, 330), (650, 250))]
    texts += [base[:k] + "#" + base[k + 1 :] for k in (100, 333, 334, 700)]
    texts += ["word " * 100, "word " * 99 + "wor", "ab" * 150, "a" * 450, "é" * 300, "\0" * 230, "\0" * 231 + "x", base[::-1][:260] * 3]
    check_repeats(spark, texts)


def test_anchor_runs_cover_every_window():
    data = np.frombuffer(b"abcdefghij" * 100 + bytes(range(256)) * 3, np.uint8)
    lo, hi, at, _ = anchors.anchor_runs(data, np.array([len(data)]), 200)
    assert sum((hi - lo + 1).tolist()) == len(data) - 199 and (at >= hi).all() and (at - lo < 200).all()


def test_language(spark, awkward):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog are in the house", "en"), ("der hund und die katze sind im haus", "de")] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.fit_profiles(docs)
    assert {(r.doc_id % 2, r.lang_pred) for r in language.identify(docs, profiles).collect()} == {(0, "en"), (1, "de")}
    got = {r.doc_id: r for r in language.identify(awkward, profiles).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[1].score == 0.0
    assert language.fit_profiles(empty(spark)).names == [] and language.identify(empty(spark), profiles).count() == 0


def test_toxicity(spark, awkward):
    good, bad = "This is a calm sentence about item {}. Another one follows.", "This is a calm sentence about item {}. You are a moron {}."
    rows = [(bad if i % 4 == 0 else good).format(i, i) for i in range(120)]
    scorer = toxicity.fit(spark.createDataFrame([(t, int("moron" in t)) for t in rows], "text string, toxic int"))
    score, found = scorer.score(b"All is well. You moron.")
    assert score > 0.7 and found[0][0] == 1 and scorer.score(b"All is well.")[0] < 0.5
    got = toxicity.score(awkward, scorer)
    assert got.count() == awkward.count() and got.filter("predicted = 1").count() == 0
    assert toxicity.fit(spark.createDataFrame([], "text string, toxic int")).score(b"x")[0] < 0.01


def test_licences(spark, awkward):
    got = {r.doc_id: r for r in licences.scan(awkward).collect()}
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].base_labels) == (4, 1, 1, "mit")
    assert got[10].base_labels == "gpl" and got[0].n_words == 0 and got[0].labels == "" and got[8].n_words == 30_000
    assert licences.scan(empty(spark)).count() == 0
    text = licences.TEMPLATES[0][1]
    r = licences.scan(spark.createDataFrame([(1, f"Copyright. {text.upper()}!")], "doc_id long, text string")).first()
    assert r.labels == "mit" and r.base_labels == "" and r.score == 1.0


def test_licences_of_files_with_several_notices(spark):
    notices = {label: text for label, text, _ in licences.TEMPLATES[::-1]}
    rows = [(k, notices["mit"]) for k in range(50)] + [(50, ". ".join([notices["mit"], licences.TEMPLATES[4][1], notices["bsd"]])), (51, ". ".join(t for _, t, _ in licences.TEMPLATES))]
    got = {r.doc_id: r.labels.split(",") for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {"mit", "gpl", "bsd"} <= set(got[50])
    assert set(got[51]) >= set(notices)


def test_packing(spark, awkward):
    public = pytest.importorskip("public_tokenizers")
    rows = packing.pack(awkward, public.path("word_bpe_49k.json"), 2048).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert sum(r.piece == 0 for r in rows) == awkward.count()
    assert packing.pack(empty(spark), public.path("word_bpe_49k.json")).count() == 0
    assert packing.minimum_bin_slack({6: 2, 4: 2, 3: 1}, 10) == [(Counter({6: 1, 4: 1}), 2), (Counter({3: 1}), 1)]


def test_word_ids_equal_the_library():
    public = pytest.importorskip("public_tokenizers")
    from quillon.llm.wordpieces import encoder

    e = encoder(public.path("word_bpe_49k.json"))
    texts = ["don't I'VE it's 3²½", "a<|endoftext|>b", "é́ ΣΑΣ 日本 x\x85y a\xa0b İ", "", "Straße, naïve (über) co-op 12,345!", "nterti\n\tthreou"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.many(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_sharding(spark, awkward):
    rows = sharding.shard_documents(awkward, 4, bucket_rows=3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(x) for x in by.values()]
    assert len(rows) == awkward.count() and max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.shard_documents(empty(spark), 4).count() == 0


def test_shards_hold_whole_texts_in_slot_order(spark, awkward):
    """Repeated rows, null and long texts, an id beyond a double's digits beside a null one."""
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([((1 << 60) + 1, "far"), (3, "a")], "doc_id long, text string"))
    shards = sharding.stored(sharding.shard_documents(docs, 4, bucket_rows=3))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
    assert sorted(map(key, shards.collect())) == sorted(map(key, docs.collect()))
    for k in range(4):
        assert [r.slot for r in sharding.read_shard(spark, shards.table_path, k).collect()] == list(range(3 + (k < 3)))
    assert sharding.stored(sharding.shard_documents(empty(spark), 4)).count() == 0


def test_buckets_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 4000)
    docs = spark.createDataFrame([(i, "é" * 484) for i in range(40)], "doc_id long, text string")  # 984 bytes each
    seen = []
    monkeypatch.setattr(sharding, "written", lambda df, tag: seen.append((tag, out := common.written(df, tag))) or out)
    rows = sharding.shard_documents(docs, 3).collect()
    assert sorted(r.doc_id for r in rows) == list(range(40))
    assert 5 <= dict(seen)["starts"].count() <= 10


def test_decontamination(spark, awkward):
    items = spark.createDataFrame([(1, " ".join(f"Shared{i}" for i in range(5, 20))), (2, "mit license"), (3, None), (4, "!")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(awkward, items).collect()}
    assert got[6].items == [1] and [tuple(s) for s in got[6].spans] == [(6, 20)] and got[4].items == [2] and got[0].n_words == 0
    several = {r.doc_id: r for r in decontaminate.contamination(awkward, items, block_bytes=16).collect()}
    assert several == got
    assert sorted(r.doc_id for r in decontaminate.clean(awkward, items).collect() if r.doc_id is not None) == [0, 1, 2, 3, 3, 8, 9, 10]
    assert decontaminate.contamination(empty(spark), items).count() == 0


def test_suffix_tree(spark, awkward):
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in suffix_tree.lm_scores(awkward, F.col("doc_id") % 7 != 2).collect()}
    count = Counter(w for r in awkward.collect() if r.doc_id is not None and r.doc_id % 7 != 2 for w in [*suffix_tree.tokens((r.text or "").encode()), b""])
    n, v = sum(count.values()), len(count)
    for r in awkward.filter("doc_id is not null").collect():
        words = [*suffix_tree.tokens((r.text or "").encode()), b""]
        assert got[r.doc_id].base_score == pytest.approx(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in words))
        assert got[r.doc_id].train_tokens == n and np.isfinite(got[r.doc_id].score)
    tree = suffix_tree.fit_tree(awkward.select("text"))
    keys = np.int64(int.from_bytes(b"share", "big")) << 8 | np.arange(256)
    assert tree.probability(keys).sum() == pytest.approx(1.0)
    assert suffix_tree.lm_scores(empty(spark), F.lit(True)).count() == 0


def test_suffix_tree_grows_with_the_corpus(spark):
    """What some rows teach is not forgotten because the rest of the corpus is larger."""
    from pyspark.sql import functions as F

    rows = [(k, "quartz jumps") for k in range(8)] + [(8 + k, "la le li lo lu " * 60_000) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree.lm_scores(docs, F.lit(True)).collect()}
    tree = suffix_tree.fit_tree(docs)
    count = Counter(w for _, t in rows for w in [*t.encode().split(), b""])
    base = sum(count.values()) + len(count) + 1
    for k in (0, 8):
        words = [*rows[k][1].encode().split(), b""]
        spelled = tree.log10(words[:-1])
        mixture = np.log10(0.5 * 10**spelled + 0.5 * np.array([(count[w] + 1) / base for w in words]))
        assert got[k] == pytest.approx(mixture.sum())
    assert got[0] > -9


def test_media(spark, awkward):
    for t in (b"", b"a" * 64, bytes(range(256)) * 7 + b"x"):
        data = media.payload(t)
        assert len(data) % 64 == 0 and media.from_png(media.to_png(data)) == data and data.startswith(t)
    for r in media.document_media(awkward).collect():
        assert r.payload_bytes % 64 == 0 and r.caption == f"{r.n_bytes} bytes"
    assert media.document_media(empty(spark)).count() == 0
    page = '<p>One</p><figure><img src="a.png" alt="x"><figcaption>Cap <b>A</b></figcaption></figure><p>Two<img src=b.png>three</p><script>no</script>'
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.parse(page)] == [("text", "One", None), ("media", "a.png", "Cap A"), ("text", "Two", None), ("media", "b.png", None), ("text", "three", None)]
    assert zlib.crc32(media.payload(b"")) == zlib.crc32(bytes(64))
