"""The registered queries and the pipeline's stages, whole, against plain Python over the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import common, decontaminate, queries, sharding, simhash

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in queries.table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r.item_id: r.text for r in queries.table(spark, SF, "benchmark").collect()}


def got(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_op1(spark, docs):
    rows = got(spark, "op1_language")
    assert set(rows) == set(docs) and all(r.held_out == (fold(i, 4) == 2) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [(r.lang_pred, docs[i].lang) for i, r in rows.items() if r.held_out and docs[i].lang and any(c.isalpha() for c in docs[i].text or "")]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_op2(spark, docs):
    rows = got(spark, "op2_toxicity")
    toxic = {r.doc_id: r.toxic for r in queries.table(spark, SF, "labels").collect()}
    assert set(rows) == set(docs)
    assert all(r.held_out == (fold(i, 3) == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in rows.items())
    clean = [rows[i].predicted for i, y in toxic.items() if rows[i].held_out and y == 0]
    assert sum(clean) <= 0.05 * len(clean)


def test_op3(spark, docs):
    from .test_llm import brute_simhash

    rows = got(spark, "op3_simhash")
    prints = {i: brute_simhash(d.text) for i, d in docs.items()}
    group = {i: i for i in docs}
    for i, a in prints.items():
        for j, b in prints.items():
            if j < i and (a ^ b).bit_count() <= 3 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{prints[i]:016x}", group[i]) for i in docs}


def repeated(texts):
    """Each text's repeated bytes, by every window of every text."""
    seen = Counter(t[k : k + 200] for t in texts.values() for k in range(len(t) - 199))
    return {i: {k + j for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1 for j in range(200)} for i, t in texts.items()}


def test_op4(spark, docs):
    texts = {i: (d.text or "").encode() for i, d in docs.items()}
    gone = repeated(texts)
    for i, r in got(spark, "op4_suffixes").items():
        kept = bytes(b for k, b in enumerate(texts[i]) if k not in gone[i])
        spans = sum(k - 1 not in gone[i] for k in gone[i])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(texts[i]), len(gone[i]), spans, hashlib.sha256(kept).hexdigest())


def test_op5(spark, docs):
    for i, r in got(spark, "op5_licences").items():
        words = WORDS.findall(lower(docs[i].text))
        found = [(k, label) for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")) for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        base = sorted({x for _, x in found})
        want = (len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(base))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(base) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_op6(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    check_packed(queries.QUERIES["op6_packing"](spark, SF).collect(), {i: d.text for i, d in docs.items()}, Tokenizer.from_file(public.path("word_bpe_49k.json")))


def check_packed(rows, texts, tokenizer):
    bins, pieces = defaultdict(list), defaultdict(dict)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id][r.piece] = r
    for those in bins.values():
        end = 0
        for offset, length in sorted(those):
            assert offset == end
            end += length
        assert end <= 2048
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for _, r in sorted(pieces[i].items())] == [(k, 2048 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(parts)]
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 2048) + 1


def test_op7(spark, docs, tmp_path):
    rows = got(spark, "op7_sharding")
    by = defaultdict(list)
    for i, r in rows.items():
        raw = (docs[i].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by[r.shard].append(r.slot)
    assert set(rows) == set(docs) and set(by) == set(range(40)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    whole = sharding.shard_rows(queries.table(spark, SF, "documents"), 3, ["doc_id"])
    sharding.write_shards(whole, str(tmp_path / "shards"), slots=20)
    back = [sharding.read_shard(spark, str(tmp_path / "shards"), k).collect() for k in range(3)]
    assert sorted((r.doc_id, r.text) for part in back for r in part) == sorted((i, d.text) for i, d in docs.items())
    assert all([r.slot for r in part] == list(range(len(part))) for part in back)


def hits_of(text, items):
    words, hit, found = WORDS.findall(lower(text)), set(), set()
    for i, t in items.items():
        own = WORDS.findall(lower(t))
        m = min(10, len(own))
        windows = {tuple(own[k : k + m]) for k in range(len(own) - m + 1)} if m else set()
        for k in range(len(words) - m + 1):
            if windows and tuple(words[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                found.add(i)
    return words, hit, found


def test_op8(spark, docs, items):
    for i, r in got(spark, "op8_decontaminate").items():
        words, hit, found = hits_of(docs[i].text, items)
        ids = ",".join(sorted(map(str, found)))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))


def test_op9(spark, docs):
    tokens = {i: [*re.findall("[^\\x20\\x09-\\x0D]+", lower(d.text)), ""] for i, d in docs.items()}
    count = Counter(w for i, t in tokens.items() if fold(i, 7) != 2 for w in t)
    n, v = sum(count.values()), len(count)
    for i, r in got(spark, "op9_suffix_tree").items():
        base = sum(np.log10((count[w] + 1) / (n + v + 1)) for w in tokens[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 7) == 2, len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n)
        assert r.base_score == pytest.approx(base) and np.isfinite(r.score) and r.score < 0


def test_op10(spark, docs):
    for i, r in got(spark, "op10_media").items():
        raw = (docs[i].text or "").encode()
        data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature.startswith("64x")


def test_pipeline(spark, items):
    """Each stage on what the one before kept."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from .test_llm import brute_groups

    at = queries.table(spark, SF, "documents")
    names, stages = at.columns, dict(corpus_pipeline.STAGES)
    step = lambda name, before: common.written(stages[name](spark, before, SF), "test")
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, SF).filter("predicted = 1").select("doc_id").collect()}
    mild = step("toxicity", at)
    assert mild.columns == names and set(text(mild)) == set(text(at)) - toxic
    before, single = text(mild), step("near duplicates", mild)
    ids = sorted(before)
    group = brute_groups([before[i] or "" for i in ids])
    assert single.columns == names and text(single) == {ids[k]: before[ids[k]] for k in range(len(ids)) if group.index(group[k]) == k}
    raw = {i: (t or "").encode() for i, t in text(single).items()}
    gone, cut = repeated(raw), step("exact repeats", single)
    assert cut.columns == names
    assert text(cut) == {i: None if text(single)[i] is None else bytes(b for k, b in enumerate(t) if k not in gone[i]).decode("utf-8", "ignore") for i, t in raw.items()}
    before, pure = text(cut), step("benchmark passages", cut)
    assert pure.columns == names and text(pure) == {i: t for i, t in before.items() if not hits_of(t, items)[1]}
    packed = step("packing", pure).collect()
    check_packed(packed, text(pure), Tokenizer.from_file(public.path("word_bpe_49k.json")))
    key = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(packed)


def test_clashing_columns_stay(spark):
    names = ["_id", "_d", "_words", "words", "digest", "copies", "starts", "best_id"]
    rows = [(k, " ".join(f"w{j}" for j in range(k % 2, 60)), *range(8)) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for made in (simhash.keep_one(docs), queries.suffixes.cut(docs), decontaminate.clean(docs, spark.createDataFrame([(1, "x")], "item_id long, text string"))):
        assert made.columns == docs.columns and all(tuple(r[2:]) == tuple(range(8)) for r in made.collect())


def test_a_cluster_needs_a_shared_folder(spark):
    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Far)
