"""Parsers, import resolution, the index and packages over a small repository of our own."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import corpus, graph, parsers
from quillon.plans import context
from quillon.plans.index import Index
from quillon.sources import manifests
from quillon.sources.store import Store
from quillon.streaming.refresh import CHANGE, follow

PHP = '''<?php
declare(strict_types=1);

namespace App\\Services;

use App\\Models\\{Item, User as U};
use App\\Contracts\\Pays;
use function strlen;

// class Fake { }
final class Cart extends Base implements Pays
{
    use Loggable;
    private ?int $n = 3;
    protected static array $all = ['a' => 'class X {'];

    public function __construct(private Item $item) { $this->n = 1; }

    abstract protected function total(int $x = 3): int;
    public static function make(): self
    {
        $f = function ($x) use ($y) { return "}"; };
        return new static();
    }
}

interface Pays { public function pay(); }
function helper($a) { return 1; }
'''
TS = '''import { a, b } from './a'
import React from "react"
import './side.css'
const fs = require('fs')
export { x } from '@/x'
export const total = (x: number): number => x + 1
export const load = async (id) => {
  const m = await import('./lazy')
  return m
}
export default async function run<T>(x: T): Promise<void> {
  if (x) { return }
}
export interface Item { id: number }
export type Id<T> = string | T
export abstract class Cart extends Base {
  private count = 0
  constructor(private x: number) { super() }
  async add(x: number): Promise<void> {
    for (const y of x) { f(y) }
  }
  get size(): number { return 1 }
  handler = () => { return 1 }
}
enum Kind { A, B }
'''
VUE = '''<template>
  <div>class X {}</div>
</template>
<script setup lang="ts">
import X from './X.vue'
const go = () => { 1 }
</script>
'''
CS = '''using System;
using static System.Math;
using var x = 1;
namespace Shop.Api;

[ApiController]
public sealed class CartController : ControllerBase
{
    private readonly IStore _s = new Store();
    public CartController(IStore s) { _s = s; }
    [HttpGet]
    public async Task<List<int>> Get(int id = 3)
    {
        using var c = new X();
        if (id > 1) { return null; }
        return await _s.Get<int>(id);
    }
    public int Size { get; set; }
    public string Name => "x;{";
    public int Twice(int x) => x * 2;
    static CartController() { }
    public record Inner(int A, string B);
    public class Deep { public void Go() { } }
}
public record struct Money(decimal A);
public enum Kind { A, B }
'''


def found(language, source):
    return {(x.kind, x.name, x.parent, x.line_start, x.line_end) for x in parsers.parse(language, source).symbols}


def test_php():
    assert found("php", PHP) == {
        ("class", "Cart", None, 11, 25), ("property", "n", "Cart", 14, 14), ("property", "all", "Cart", 15, 15), ("method", "__construct", "Cart", 17, 17),
        ("method", "total", "Cart", 19, 19), ("method", "make", "Cart", 20, 24), ("interface", "Pays", None, 27, 27), ("method", "pay", "Pays", 27, 27), ("function", "helper", None, 28, 28),
    }
    p = parsers.parse("php", PHP)
    assert p.namespace == "App\\Services" and [r for r, _ in p.imports][:3] == ["App\\Models\\Item", "App\\Models\\User", "App\\Contracts\\Pays"]


def test_javascript():
    assert found("typescript", TS) == {
        ("function", "total", None, 6, 6), ("function", "load", None, 7, 10), ("function", "run", None, 11, 13), ("interface", "Item", None, 14, 14), ("type", "Id", None, 15, 15),
        ("class", "Cart", None, 16, 24), ("method", "add", "Cart", 19, 21), ("method", "size", "Cart", 22, 22), ("enum", "Kind", None, 25, 25),
    }
    assert parsers.parse("typescript", TS).imports == [("./a", "relative"), ("react", "module"), ("./side.css", "relative"), ("fs", "module"), ("@/x", "relative"), ("./lazy", "relative")]
    assert found("vue", VUE) == {("function", "go", None, 6, 6)}


def test_csharp():
    p = parsers.parse("csharp", CS)
    assert p.namespace == "Shop.Api" and p.imports == [("System", "namespace"), ("System.Math", "namespace")]
    assert found("csharp", CS) == {
        ("class", "CartController", None, 6, 24), ("constructor", "CartController", "CartController", 10, 10), ("method", "Get", "CartController", 11, 17), ("property", "Size", "CartController", 18, 18),
        ("method", "Twice", "CartController", 20, 20), ("constructor", "CartController", "CartController", 21, 21), ("record", "Inner", None, 22, 22), ("class", "Deep", None, 23, 23),
        ("method", "Go", "Deep", 23, 23), ("record", "Money", None, 25, 25), ("enum", "Kind", None, 26, 26),
    }


@pytest.mark.parametrize("language", ["php", "typescript", "csharp", "python"])
def test_broken_sources_end(language):
    for text in ("", "{{{", ")))", "class", "class X {", "function (", "'", "use", "namespace", "export const x = (", "public class", "/* x"):
        parsers.parse(language, text)


REPO = {
    "composer.json": '{"autoload": {"psr-4": {"App\\\\": "app/"}}, "require": {"laravel/framework": "11"}} // x',
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/deep/*": ["lib/deep/*"]}}}',
    "package.json": '{"dependencies": {"vue": "3"}}',
    "app/Services/Cart.php": "<?php\nnamespace App\\Services;\nuse App\\Models\\Item;\nuse Other\\Ledger;\nclass Cart { public function pay() { $key = \"x\"; } }\n",
    "app/Models/Item.php": "<?php\nnamespace App\\Models;\nclass Item { }\n",
    "app/Money/Ledger.php": "<?php\nnamespace App\\Money;\nclass Ledger { }\n",
    "src/main.ts": "import a from './util'\nimport b from '@/deep/x'\nimport c from '@/other'\nimport d from 'vue'\nexport class MainPage { run() { return 1 } }\n",
    "src/util.ts": "export function helper(x) {\n  return 'token'\n}\n",
    "src/other.vue": "<script>\nimport { helper } from './util'\n</script>\n",
    "lib/deep/x/index.js": "export const secret = () => 1\n",
    "pkg/a.py": "from .b import B\nfrom pkg.sub import thing\nimport os\nclass Alpha:\n    def go(self):\n        return B\n",
    "pkg/b.py": "class B:\n    pass\n\n\ndef Payments():\n    password = 'hunter2hunter2'\n    return password\n",
    "pkg/sub/__init__.py": "from ..a import Alpha\n",
    "tests/test_alpha.py": "def test_it():\n    assert Alpha and Payments\n",
    "Api/One.cs": "using Shop.Two;\nnamespace Shop.One;\npublic class One { public int Get() { return 1; } }\n",
    "Api/Two.cs": "namespace Shop.Two;\npublic class Two { }\n",
    "Api/Three.cs": "namespace Shop.Two;\npublic class Three { }\n",
    "node_modules/x.js": "export const x = () => 1\n",
    "notes.unknown": "x",
}


def tree(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, content string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    out = Index(spark, str(tmp_path_factory.mktemp("index")))
    out.stats = out.update(tree(spark, REPO))
    return out


EDGES = {
    ("app/Services/Cart.php", "app/Models/Item.php"), ("app/Services/Cart.php", "app/Money/Ledger.php"), ("src/main.ts", "src/util.ts"), ("src/main.ts", "lib/deep/x/index.js"), ("src/main.ts", "src/other.vue"),
    ("src/other.vue", "src/util.ts"), ("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/sub/__init__.py"), ("pkg/sub/__init__.py", "pkg/a.py"), ("Api/One.cs", "Api/Two.cs"), ("Api/One.cs", "Api/Three.cs"),
}


def test_index(spark, index):
    s = index.stats
    assert (s.discovered, s.added, s.updated, s.removed, s.frameworks) == (17, 17, 0, 0, ["Laravel", "Vue"])
    deps = index.table("deps").collect()
    assert {(r.src, r.dst) for r in deps if r.kind == "import"} == EDGES
    assert {(r.src, r.dst) for r in deps if r.kind == "reference"} == {("tests/test_alpha.py", "pkg/a.py"), ("tests/test_alpha.py", "pkg/b.py")}
    assert {r.weight for r in deps if r.src == "Api/One.cs"} == {0.6}
    assert [r.name for r in index.symbols_for("pkg/a.py").collect()] == ["Alpha", "go"] and index.imports_for("pkg/a.py").count() == 5
    assert index.get_meta("none", "x") == "x" and index.file("pkg/b.py").first().tokens > 5


def test_incremental_equals_full(spark, tmp_path):
    files = dict(REPO)
    step = Index(spark, str(tmp_path / "step"))
    step.update(tree(spark, files))
    assert step.update(tree(spark, files)).unchanged == 17
    step.set_summaries(spark.createDataFrame([("pkg/b.py", "  What  it does ")], "path string, summary string"))
    files["pkg/b.py"] += "def more():\n    pass\n"
    files["pkg/c.py"] = "class Gamma:\n    pass\n"
    del files["src/util.ts"]
    s = step.update(tree(spark, files))
    assert (s.added, s.updated, s.removed, s.unchanged) == (1, 1, 1, 15)
    whole = Index(spark, str(tmp_path / "whole"))
    whole.update(tree(spark, files))
    for name in ("symbols", "imports", "terms", "postings", "names", "deps", "sizes"):
        rows = [sorted(map(str, i.table(name).select(*sorted(i.table(name).columns)).collect())) for i in (step, whole)]
        assert rows[0] == rows[1], name
    kept = step.file("pkg/b.py").first()
    assert kept.summary == "What it does" and kept.summary_sha != kept.sha256  # kept, and known to be stale
    assert step.table("deps").filter("dst = 'src/util.ts'").count() == 0


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit({"a": spark.range(3)})
    with pytest.raises(Exception):
        store.commit({"a": spark.range(5), "b": spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))})
    assert store.read("a").count() == 3 and not store.has("b")


def test_lookup_and_neighbours(index):
    files, symbols = index.table("files"), index.table("symbols")
    look = lambda t: [(r.path, r.level) for r in graph.lookup(files, symbols, t).collect()]
    assert look("pkg/a.py") == [("pkg/a.py", 0)] and look("Ledger") == [("app/Money/Ledger.php", 1)] and look("util") == [("src/util.ts", 2)]
    assert len(look("api/")) == 3 and look("nothing") == []
    near = graph.neighbour_report(index.table("deps"), "src/util.ts").collect()
    assert [(r.direction, r.path) for r in near] == [("in", "src/main.ts"), ("in", "src/other.vue")]
    assert [r.path for r in corpus.search(symbols, files, "ledge").collect()] == ["app/Money/Ledger.php"]
    assert [(r.name, r.path) for r in corpus.search(symbols, files, "deep").collect()] == [(None, "lib/deep/x/index.js")]


def test_ranking(spark, index):
    rows = {r.path: r for r in context.rank(index, "Speed up Payments in pkg/b.py").collect()}
    best = max(rows.values(), key=lambda r: r.score)
    assert best.path == "pkg/b.py" and best.explicit_reference == 3.0 and best.matched == ["Payments"]
    assert rows["pkg/a.py"].dependency > 0 and rows["pkg/a.py"].module_match > 0
    assert rows["tests/test_alpha.py"].score < 0.7 and "tests/test_alpha.py" not in {r.path for r in context.rank(index, "Payments", include_tests=False).collect()}
    log = spark.createDataFrame([("pkg/b.py", 1.0)], "path string, recency double")
    named = {r.path: r for r in context.rank(index, "Payments", named=["util.ts"], memory="pkg/b.py is slow", recency=log).collect()}
    assert named["src/util.ts"].explicit_reference == 4.5 and named["pkg/b.py"].memory == 0.5 and named["pkg/b.py"].git_recency == pytest.approx(0.3)
    assert {r.path: r.test_relevance for r in context.rank(index, "Alphas in pkg/a.py and alpha").collect() if r.test_relevance} == {}


@pytest.mark.parametrize("budget", [1500, 3000, 12_000])
def test_packages(spark, index, budget):
    files = tree(spark, REPO)
    p = context.build(index, files, "Speed up Payments in pkg/b.py", budget=budget, rules="# Rules\n- keep tests green\nplain")
    assert sum(s.tokens for s in p.selections) + p.reserve <= budget and p.baseline_tokens > 0 and not p.low_confidence
    assert p.selections[0].path == "pkg/b.py" and p.selections[0].representation == "full"
    assert "hunter2" not in p.markdown and T.HIDDEN in p.markdown and "- keep tests green" in p.markdown and "plain" not in p.markdown
    assert p.report()["full"] >= 1 and p.explain()[0].path == "pkg/b.py" and '"savings_pct"' in p.to_json()
    row = context.run_row(index, p).first()
    assert row.considered == p.considered and row.selected <= len(p.selections)


def test_packages_without_sources(spark, index):
    files = tree(spark, REPO)
    p = context.build(index, files, "Payments in pkg/b.py", no_full=True)
    assert {s.representation for s in p.selections} <= {"signatures", "map"} and "def Payments()" in p.markdown
    vague = context.build(index, files, "make this better somehow")
    assert vague.low_confidence and all(s.representation != "full" for s in vague.selections)


def test_large_files_show_regions(spark, tmp_path):
    body = "".join(f"def step{k}(value):\n    total = value + {k}\n    return total\n\n\n" for k in range(300))
    files = {"pkg/large.py": body + "def payments(x):\n    return x\n", "pkg/other.py": "x = 1\n"}
    index = Index(spark, str(tmp_path))
    index.update(tree(spark, files))
    p = context.build(index, tree(spark, files), "fix payments in pkg/large.py")
    assert [(s.path, s.representation) for s in p.selections][0] == ("pkg/large.py", "regions") and "# --- L1501-1502 ---" in p.markdown


def test_memories_usage_and_agents(spark):
    memories = spark.createDataFrame([(1, "note", "old", None)], "id long, kind string, body string, created_at timestamp")
    fresh = memories.limit(0).unionByName(spark.createDataFrame([(2, "bug", "  new ", None)], memories.schema))
    both = corpus.remember(memories, fresh)
    assert [r.line for r in corpus.memory_lines(both, "- rule\nx").collect()] == ["- rule", "- (note) old", "- (bug) new"]
    assert corpus.forget(both, [1]).count() == 1
    with pytest.raises(Exception, match="unknown kind"):
        corpus.remember(memories, spark.createDataFrame([(3, "guess", "x", None)], memories.schema)).collect()
    said = "Intro\n```diff\ndiff --git a/x b/x\n+1\n```\n\n\n\nFILE: a/b.py\n```python\nx = 1\n```\nFILE: a/b.py\n```\nx = 2\n```\nEnd"
    r = spark.createDataFrame([(said,), ("plain",)], "t string").select(corpus.agent_output(F.col("t")).alias("o")).collect()
    assert (r[0].o.diff, r[0].o.files, r[1].o.diff, r[1].o.files, r[1].o.summary) == ("diff --git a/x b/x\n+1\n", {"a/b.py": "x = 2\n"}, "", {}, "plain")
    assert r[0].o.summary.startswith("Intro") and r[0].o.summary.endswith("End")
    prices = spark.createDataFrame([("gpt-4o-mini-x",)], "m string").select(corpus.cost(F.col("m"), F.lit(10**6), F.lit(0)).alias("a"), corpus.cost(F.col("m"), F.lit(10**6), F.lit(0), longest=False).alias("b")).first()
    assert (prices.a, prices.b) == (0.15, 2.5)


def test_manifests(spark):
    m = manifests.read_manifests(tree(spark, {"src/a.ts": "", "tsconfig.json": "{broken"}))
    assert m.aliases == [("@/", "src")] and m.psr4 == []
    got = manifests.frameworks(tree(spark, {"package.json": "{", "requirements.txt": "Django", "a/b/C.csproj": "Blazor", "go.mod": ""})).first()[0]
    assert got == ["Node", ".NET", "Blazor", "Django", "Go"]
    assert manifests.frameworks(tree(spark, {"x.py": ""})).first()[0] == []


def test_an_index_follows_a_stream(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    folder = str(tmp_path / "in")
    for batch in ([("a.py", "class Alpha:\n    pass\n", 1), ("b.py", "x = 1\n", 1)], [("a.py", "class Beta:\n    pass\n", 2), ("b.py", None, 2)]):
        spark.createDataFrame(batch, CHANGE).coalesce(1).write.mode("append").parquet(folder)
        follow(index, folder, str(tmp_path / "checkpoint")).awaitTermination()
    assert [r.name for r in index.table("symbols").collect()] == ["Beta"] and index.table("files").count() == 1


def test_imports_alone_are_those_of_a_whole_parse():
    for language, source in (("php", PHP), ("typescript", TS), ("vue", VUE), ("csharp", CS), ("python", REPO["pkg/a.py"])):
        whole, some = parsers.parse(language, source), parsers.parse(language, source, symbols=False)
        assert (some.imports, some.namespace, some.symbols) == (whole.imports, whole.namespace, []) and whole.symbols


def test_parsing_holds_a_bounded_piece(spark):
    made = [pa.RecordBatch.from_pydict({"x": [None, "a" * 900, "", "b" * 200, "c" * 5000, "d"]})]
    assert [p.num_rows for p in T.pieces(made[0], 0, 1000)] == [3, 1, 1, 1] and pa.Table.from_batches(T.pieces(made[0], 0, 1000)).to_batches()
    rows = spark.createDataFrame([("a.py", "python", "class Alpha:\n    def go(self):\n        pass\n")] * 3, "path string, language string, content string").coalesce(1)
    assert [(r.fact, r.name) for r in parsers.facts(rows, "definition", "import").collect()] == [("symbol", "Alpha")] * 3
    assert parsers.symbols(rows).columns == ["path", "pos", "name", "kind", "signature", "parent", "line_start", "line_end"]
