"""Dependency edges and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .parsers import DEFINING

#: Names too common to stand for one file (fixed values).
COMMON_NAMES = [
    "String", "Array", "Object", "Number", "Boolean", "Promise", "Record", "Partial", "Task", "List", "Dictionary", "Exception", "Error", "Date",
    "DateTime", "Guid", "Model", "Request", "Response", "Controller", "Service", "Repository", "Collection", "Builder", "Command", "Console", "Event",
    "Listener", "Provider", "Factory", "Middleware", "Route", "Schema", "Blueprint", "None", "True", "False", "Optional", "Union", "Any", "Dict",
    "Tuple", "Callable", "Iterable", "Enum", "Interface", "Type", "Props", "State", "Config", "Options", "Result", "Status", "Test", "Base",
    "Abstract", "Main", "Program", "Startup", "Index", "Home", "Item", "Items", "Value", "Component", "Module", "Client", "Server", "Handler",
    "Context", "Manager", "Helper", "Utils",
]
#: What an import without suffix may stand for, in order (fixed values).
PROBES = ("", ".ts", ".tsx", ".js", ".jsx", ".vue", ".mjs", ".cjs", ".d.ts", ".json", ".py", ".php", ".cs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.vue", "/__init__.py")
#: Folders below which an absolute Python import may start, in order (fixed values).
PYTHON_ROOTS = ("", "src/", "app/", "lib/")
TYPE_LIKE = "[A-Z][A-Za-z0-9_]{3,}"
IDENT = f"(?<![A-Za-z0-9_]){TYPE_LIKE}(?![A-Za-z0-9_])"


def pascal_names(text: Column) -> Column:
    """Distinct type-like names; ASCII word boundaries."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(IDENT), F.lit(0)))


def unique_definitions(names: DataFrame, key: str, name: str = "name") -> DataFrame:
    """(name, key) of names that exactly one file defines; common names stand for none."""
    rows = names.filter((F.length(name) >= 4) & ~F.col(name).isin(*COMMON_NAMES))
    return rows.groupBy(name).agg(F.min(key).alias(key), F.max(key).alias("_last")).filter(F.col(key) == F.col("_last")).drop("_last")


def reference_edges(uses: DataFrame, defined: DataFrame, key: str, name: str = "name", imports: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight 0.5): a file uses a name that one other file defines, and does not import that file."""
    edges = uses.select(F.col(key).alias("src"), name).join(defined.select(F.col(key).alias("dst"), name), name).filter("src <> dst").select("src", "dst").distinct()
    if imports is not None:
        edges = edges.join(imports.select("src", "dst"), ["src", "dst"], "left_anti")
    return edges.withColumn("weight", F.lit(0.5))


def probe(wanted: DataFrame, files: DataFrame, base: str = "base", path: str = "path") -> DataFrame:
    """wanted with the first path that its base may stand for; rows without one leave."""
    tries = F.array(*[F.struct(F.lit(k).alias("rank"), F.concat(F.col(base), F.lit(p)).alias(path)) for k, p in enumerate(PROBES)])
    keys = wanted.columns
    found = wanted.select(*keys, F.explode(tries).alias("t")).select(*keys, "t.rank", F.col(f"t.{path}").alias(path)).join(files.select(path), path)
    return found.groupBy(*keys).agg(F.min_by(path, "rank").alias(path))


def relative_base(source: Column, raw: Column) -> Column:
    """Where a relative import points, from its file's folder."""
    return T.normalize_path(F.concat(F.regexp_replace(source, r"[^/]*$", ""), raw))


def _folder(path: Column, up: Column | int = 0) -> Column:
    """The folder of a path, ``up`` levels higher, with a slash behind it if it is not the root."""
    parts = F.split(path, "/")
    kept = F.slice(parts, 1, F.greatest(F.size(parts) - 1 - up, F.lit(0)))
    return F.concat_ws("", F.transform(kept, lambda p: F.concat(p, F.lit("/"))))


def import_bases(source: Column, raw: Column, kind: Column, language: Column, psr4: list[tuple[str, str]], aliases: list[tuple[str, str]], base_url: str = "") -> Column:
    """What an import may stand for, best first: paths to probe.  Whole paths, of PHP classes, end in .php."""
    none = F.array().cast("array<string>")
    name = F.regexp_replace(raw, r"^\\+|\\+$", "")

    def mapped(prefix: str, folder: str) -> Column:
        rest = F.replace(F.substring(name, len(prefix) + (2 if prefix else 1), 1 << 20), F.lit("\\"), F.lit("/"))
        return F.when(name.startswith(prefix + "\\") | F.lit(not prefix), F.concat(F.lit(folder + "/" if folder else ""), rest, F.lit(".php")))

    php = F.array_compact(F.array(*[mapped(p, d) for p, d in sorted(psr4, key=lambda x: -len(x[0]))])) if psr4 else none
    tried = [F.when(raw.startswith(a), F.concat(F.lit(b + "/" if b else ""), F.substring(raw, len(a) + 1, 1 << 20))) for a, b in sorted(aliases, key=lambda x: -len(x[0]))]
    known = F.array_compact(F.array(*tried)) if tried else none
    based = F.when(F.lit(bool(base_url)) & ~raw.startswith("@") & raw.contains("/"), F.array(F.concat(F.lit(base_url + "/"), raw))).otherwise(none)
    script = F.when(raw.startswith("."), F.array(relative_base(source, raw))).when(F.size(known) > 0, known).otherwise(based)
    level = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(raw, r"^\.+", ""), F.lit("."), F.lit("/"))
    near = F.regexp_replace(F.concat(_folder(source, level - 1), rest), "/$", "")
    module = F.replace(raw, F.lit("."), F.lit("/"))
    python = F.when(kind == "relative", F.array(near)).otherwise(F.array(*[F.concat(F.lit(p), module) for p in PYTHON_ROOTS]))
    out = F.when(language == "php", php).when(language.isin("javascript", "typescript", "vue"), script).when(language == "python", python).otherwise(none)
    return F.transform(out, lambda x: F.regexp_replace(x, "^/+|/+$", ""))


def resolve_imports(imported: DataFrame, files: DataFrame, classes: DataFrame, psr4: list[tuple[str, str]] = (), aliases: list[tuple[str, str]] = (), base_url: str = "") -> DataFrame:
    """(src, dst, weight) of imports (path, raw, kind) that stand for files (path, language, namespace).

    PHP by namespace prefixes, else by a class name that one file alone defines (``classes``: name, path); JavaScript and its
    kin by relative path, alias or base folder; Python by level or root folder; C# to all files of the namespace, at 0.6.
    Every longest alias is tried first.  psr4, aliases and base_url come from the repository's manifests.
    """
    rows = imported.select(F.col("path").alias("src"), "raw", "kind").distinct().join(files.select(F.col("path").alias("src"), "language"), "src")
    rows = rows.withColumn("bases", import_bases(F.col("src"), F.col("raw"), F.col("kind"), F.col("language"), list(psr4), list(aliases), base_url))
    probes = F.when(F.col("language") == "php", F.array(F.lit(""))).otherwise(F.array(*map(F.lit, PROBES)))
    tries = F.flatten(F.transform("bases", lambda b, i: F.transform(probes, lambda p, j: F.struct((i * len(PROBES) + j).alias("rank"), F.concat(b, p).alias("path")))))
    tried = rows.select("src", "raw", "language", F.explode(tries).alias("t")).select("src", "raw", "language", "t.rank", F.col("t.path").alias("dst"))
    found = tried.join(files.select(F.col("path").alias("dst")), "dst").groupBy("src", "raw").agg(F.min_by("dst", "rank").alias("dst"))
    short = rows.filter("language = 'php'").join(found, ["src", "raw"], "left_anti").withColumn("name", F.regexp_extract("raw", r"([^\\\\]*)$", 1))
    short = short.join(classes.select("name", F.col("path").alias("dst")), "name").select("src", "dst")
    spaces = rows.filter("language = 'csharp'").join(files.select(F.col("namespace").alias("raw"), F.col("path").alias("dst")), "raw")
    every = found.select("src", "dst", F.lit(1.0).alias("weight")).unionByName(short.withColumn("weight", F.lit(1.0))).unionByName(spaces.select("src", "dst", F.lit(0.6).alias("weight")))
    return merged(every)


def defining(symbols: DataFrame) -> DataFrame:
    """(name, path) of names that exactly one file defines."""
    return unique_definitions(symbols.filter(F.col("kind").isin(*DEFINING)).select("name", "path"), "path")


def dependencies(files: DataFrame, symbols: DataFrame, imported: DataFrame, used: DataFrame, psr4=(), aliases=(), base_url: str = "") -> DataFrame:
    """(src, dst, kind, weight): import edges, and reference edges where a file uses (path, name) a name that one other file defines,
    is not among its own symbols, and whose file it does not import.  Used names are type-like, so symbols of other names are no file's
    own and leave before the shuffle."""
    unique = defining(symbols)
    edges = resolve_imports(imported, files, unique, psr4, aliases, base_url)
    foreign = used.join(symbols.filter(F.col("name").rlike(f"^{TYPE_LIKE}$")).select("path", "name").distinct(), ["path", "name"], "left_anti")
    refs = reference_edges(foreign, unique, "path", imports=edges)
    return edges.withColumn("kind", F.lit("import")).unionByName(refs.withColumn("kind", F.lit("reference"))).select("src", "dst", "kind", "weight")


def lookup(files: DataFrame, symbols: DataFrame, target: str, limit: int = 5) -> DataFrame:
    """(path, level): files that a target may mean.  The first level with any counts: 0 the path, 1 a symbol's exact name, 2 a file's
    name without its suffix, 3 a part of a path.  More than one row is ambiguous; by path, ``limit`` at most."""
    at = lambda rows, level: rows.select("path", F.lit(level).alias("level"))
    some = at(files.filter(F.col("path") == target), 0)
    some = some.unionByName(at(symbols.filter((F.col("name") == target) & F.col("kind").isin(*DEFINING)).select("path").distinct(), 1))
    some = some.unionByName(at(files.filter(F.col("path").ilike(f"%/{target}.%")), 2)).unionByName(at(files.filter(F.col("path").ilike(f"%{target}%")), 3))
    best = some.agg(F.min("level").alias("level"))
    return some.join(F.broadcast(best), "level").select("path", "level").orderBy("path").limit(limit)


def neighbour_report(edges: DataFrame, path: str, limit: int = 20) -> DataFrame:
    """(direction, path, weight): what a file depends on and what depends on it, strongest first, ``limit`` of each."""
    both = merged(edges)
    out = both.filter(F.col("src") == path).select(F.lit("out").alias("direction"), F.col("dst").alias("path"), "weight")
    into = both.filter(F.col("dst") == path).select(F.lit("in").alias("direction"), F.col("src").alias("path"), "weight")
    return out.orderBy(F.desc("weight"), "path").limit(limit).unionByName(into.orderBy(F.desc("weight"), "path").limit(limit))


def merged(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def neighbours(edges: DataFrame, back: float = 0.8) -> DataFrame:
    """(node, other, weight): outgoing edges in full, incoming ones at ``back``, the larger of both."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight")
    into = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), (F.col("weight") * back).alias("weight"))
    return out.unionByName(into).groupBy("node", "other").agg(F.max("weight").alias("weight"))


def hub_penalty(edges: DataFrame) -> DataFrame:
    """(node, degree, hub): in and out neighbours, and 1 / (1 + ln(1 + degree over three))."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return degree.withColumn("hub", 1 / (1 + F.log1p(F.greatest(F.col("degree") - 3, F.lit(0)).cast("double"))))


def dependency_signal(edges: DataFrame, chosen: DataFrame, key: str, weight: float = 0.6) -> DataFrame:
    """(node, dependency): score that at most a few seeds (key, score) lend over one and two hops, capped at the best seed's share."""
    near, hub = neighbours(merged(edges)), hub_penalty(merged(edges))
    start = F.broadcast(chosen.select(F.col(key).alias("seed"), "score"))
    one = near.join(start, F.col("node") == F.col("seed")).select("seed", "score", F.col("other").alias("n1"), F.col("weight").alias("w1"))
    one = one.join(hub.select(F.col("node").alias("n1"), F.col("hub").alias("h1")), "n1")
    two = one.join(near.select(F.col("node").alias("n1"), F.col("other").alias("n2"), F.col("weight").alias("w2")), "n1").filter("n2 <> seed")
    two = two.join(hub.select(F.col("node").alias("n2"), F.col("hub").alias("h2")), "n2")
    lent = one.select(F.col("n1").alias("node"), (weight * F.col("score") * F.col("w1") * 0.5 * F.col("h1")).alias("x")).unionByName(
        two.select(F.col("n2").alias("node"), (weight * F.col("score") * F.col("w1") * F.col("w2") * 0.15 * F.col("h1") * F.col("h2")).alias("x"))
    )
    cap = chosen.agg((weight * F.max("score")).alias("cap"))
    return lent.groupBy("node").agg(F.sum("x").alias("x")).join(F.broadcast(cap)).select("node", F.least("x", "cap").alias("dependency"))
