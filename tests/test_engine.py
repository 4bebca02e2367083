import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillon.functions import paths
from quillon.functions import text as T
from quillon.operators import corpus, graph, packing, parsers, ranking

SF = "/root/testdata/sf0.001"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("name", "parts"), [("PaymentService", ["payment", "service"]), ("get_user_id", ["get", "user", "id"]), ("HTTPServer2", ["http", "server2"]), ("", [])])
def test_split_identifier(spark, name, parts):
    assert one(spark, T.split_identifier, name) == parts


def test_text_functions(spark):
    assert one(spark, T.tokenize, "Fix the PaymentService for users") == ["payment", "service", "paymentservice", "users"]
    assert one(spark, T.loc, "a\nb") == 2 and one(spark, T.loc, "a\n") == 1 and one(spark, T.loc, "") == 0
    assert one(spark, T.normalize_path, "a/./b/../c") == "a/c"
    assert one(spark, T.slugify, "  Fix: the Cart!  ") == "fix-the-cart" and one(spark, T.slugify, "?!") == "task"
    assert one(spark, T.test_subject, "FooTests") == "Foo"
    assert one(spark, T.strip_json_comments, '{"a": "http://x", // c\n "b": [1,],}') == '{"a": "http://x", \n "b": [1]}'
    hidden = one(spark, T.redact, "api_key = \"abcdefgh123\" and Password=hunter22; x = 'plain'")
    assert "abcdefgh123" not in hidden and "hunter22" not in hidden and "'plain'" in hidden
    assert one(spark, T.redact, hidden) == hidden


def test_paths(spark):
    assert one(spark, paths.language_for, "a/x.d.ts") == "typescript" and one(spark, paths.language_for, "a/x.unknown") is None
    assert one(spark, paths.module_of, "a/b/c.py") == "a/b" and one(spark, paths.module_of, "x") == "(root)"
    assert one(spark, paths.is_test_path, "src/test_a.py") and not one(spark, paths.is_test_path, "src/latest.py")
    for p in ("node_modules/a.js", "a/LICENSE", ".env", "public/build/a.js"):
        assert one(spark, paths.ignored, p)
    assert not one(spark, paths.ignored, ".envrc.py")


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1", "s"), ("b", "1", "t")], "path string, sha256 string, summary string")
    new = spark.createDataFrame([("b", "2", None), ("c", "1", None)], "path string, sha256 string, summary string")
    assert {tuple(r) for r in corpus.snapshot_diff(old, new).collect()} == {("a", "removed"), ("b", "updated"), ("c", "added")}
    assert {tuple(r) for r in corpus.upsert(old, new, keep=("summary",)).collect()} == {("a", "1", "s"), ("b", "2", "t"), ("c", "1", None)}


def test_probe_takes_the_first_match(spark):
    files = spark.createDataFrame([("a/x.js",), ("a/x.ts",), ("b/index.ts",)], "path string")
    wanted = spark.createDataFrame([("m", "a/x"), ("m", "b"), ("m", "none")], "src string, base string")
    assert {tuple(r) for r in graph.probe(wanted, files).collect()} == {("m", "a/x", "a/x.ts"), ("m", "b", "b/index.ts")}


def test_first_fit_passes_over(spark):
    rows = spark.createDataFrame([("g", i, c) for i, c in enumerate([50, 40, 30, 15, 5, 1])], "g string, k long, c long")
    kept = packing.first_fit(rows, "g", [F.col("k")], "k", "c", 71)
    assert [r.c for r in kept.orderBy("ord").collect()] == [50, 15, 5, 1]


def test_parsers(spark):
    got = {(r.path, r.name, r.kind, r.parent) for r in parsers.symbols(parsers.samples(spark)).collect()}
    for want in [("app/cart.py", "Cart", "class", None), ("app/cart.py", "add", "method", "Cart"), ("app/cart.py", "LIMIT", "const", None), ("app/Cart.php", "add", "method", "Cart"), ("app/Cart.php", "n", "property", "Cart"), ("src/cart.ts", "total", "function", None), ("src/cart.ts", "add", "method", "Cart"), ("Api/Cart.cs", "Cart", "constructor", "Cart"), ("Api/Cart.cs", "Size", "property", "Cart"), ("Api/Cart.cs", "Total", "method", "Cart")]:
        assert want in got, want
    raw = {(r.path, r.raw) for r in parsers.imports(parsers.samples(spark)).collect()}
    assert {("app/cart.py", ".store"), ("app/cart.py", ".store.Store"), ("app/Cart.php", "App\\Models\\Item"), ("src/cart.ts", "./a"), ("Api/Cart.cs", "System")} <= raw
    assert parsers.parse("python", "def (").symbols == [] and parsers.parse("cobol", "x").symbols == []


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(__spark_entry__.catalog.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF).toPandas()
    cols = sorted(df.columns)
    norm = lambda x: sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in x[cols].itertuples(index=False))
    assert norm(df) == norm(con.execute(__spark_entry__.oracle_sql()[name]).df())


def test_token_counts_hold_a_bounded_piece(spark, monkeypatch):
    texts = [None, "", "ab cd", "x" * 50, "12 34\n\n", "é!", " "] * 40
    seen = []
    monkeypatch.setattr(T, "PIECE_BYTES", 64)
    monkeypatch.setattr(T, "count_tokens", lambda data, offsets, f=T.count_tokens: seen.append(len(data)) or f(data, offsets))
    got = T._token_count.func(pa.array(texts)).to_pylist()
    whole = T.count_tokens.__defaults__[0]
    one = lambda t: None if t is None else int(whole(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]) if t else 0
    assert got == [one(t) for t in texts] and max(seen) <= 64 and len(seen) > 40


@pytest.mark.parametrize("name", ["token_count", "corpus_totals", "module_rollup", "loc_and_size_gate", "savings", "pack_first_fit", "pack_take_while", "signature_share_cap", "summary_estimate"])
def test_counts_of_texts_without_pieces_equal_sql(spark, tmp_path, name):
    texts = ["", None, " ", "a b", "x" * 5000, "\n", "one\x0btwo", "12\x1c", "é" * 3]
    rows = [(k, t, "en" if k % 2 else None, "s", len(t or "")) for k, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(tmp_path)).toPandas()
    cols = sorted(df.columns)
    norm = lambda x: sorted(tuple("None" if v != v else str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in x[cols].itertuples(index=False))
    assert norm(df) == norm(con.execute(__spark_entry__.oracle_sql()[name]).df())


def test_postings_are_summed_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "a/cart", "cart cart basket"), (2, None, None), (3, "", "cart the")], "doc_id long, path string, text string")
    made = ranking.postings(rows, "doc_id", F.col("path"), F.col("text"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.term, r.tf, r.len) for r in made.collect()} == {(1, "cart", 5, 6), (1, "basket", 1, 6), (3, "cart", 1, 1)} and made.filter("first").count() == 2
    tasks = spark.createDataFrame([(0, "cart basket")], "task_id long, text string")
    plain = ranking.bm25(made.select("doc_id", "term", "tf"), tasks, "doc_id").collect()
    assert sorted(plain) == sorted(ranking.bm25(made, tasks, "doc_id", size=made.filter("first").select("doc_id", "len")).collect())
