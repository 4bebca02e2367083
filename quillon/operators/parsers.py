"""Structural parsers: source text to symbols and imports, batched through Arrow.

Python uses the standard library's syntax tree.  The other languages share one scanner, which cuts a text into tokens and these into statements
by their brackets; each language tells from a statement's head what it declares.
"""

from __future__ import annotations

import ast
import bisect
import gc
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Kinds of symbols that define a name (fixed values).
DEFINING = ("class", "interface", "trait", "enum", "record", "struct", "type", "function")


@dataclass(slots=True)
class Symbol:
    name: str
    kind: str
    signature: str
    parent: str | None
    line_start: int
    line_end: int


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[tuple[str, str]] = field(default_factory=list)
    namespace: str | None = None


_NOISE = re.compile(r"//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)", re.S)


def blank_noise(source: str) -> str:
    """source with comments and the insides of strings as blanks; length and lines stay."""

    def blank(m: re.Match) -> str:
        s = m[0]
        quoted = s[0] in "'\"`"
        inner = re.sub(r"[^\n]", " ", s[1:-1] if quoted and len(s) > 1 else s)
        return s[0] + inner + s[-1] if quoted and len(s) > 1 else inner

    return _NOISE.sub(blank, source)


@dataclass(frozen=True)
class Scope:
    """What a block stands in: whether it is a type's own body, and the names of the outermost and innermost type around it."""

    members: bool = False
    outer: str | None = None
    inner: str | None = None

    def type(self, name: str) -> Scope:
        return Scope(True, self.outer or name, name)

    def body(self) -> Scope:
        return Scope(False, self.outer, self.inner) if self.members else self


#: What stands in front of a token, white space and comments, and the token: a string, a word or a sign.
_TOKEN = re.compile(
    r"((?:\s+|//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z))*)('(?:\\.|[^'\\])*(?:'|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)"
    r"|[\w$\\]+|=>|::|->|[^\s\w]|\Z)",
    re.S,
)
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_BRACKETS = frozenset("()[]{}")
_QUOTES = frozenset("'\"`")
_CUT = re.compile("[{;]")


class Scanner:
    """A text as tokens, cut into statements: a head, and the block that it opens or nothing.

    A language gives ``declare(head, opener, scope)``: token numbers, the opening brace's number or None, and the scope; it adds
    symbols and returns the scope of the block.  ``breaks`` are words that begin a statement at the beginning of a line; outside a
    type's own body only statements with one of the words ``counted`` declare anything, so blocks without them, and without blocks,
    are passed over.  Without ``symbols`` only imports and the namespace are kept, which take a word of ``importing``.  A string token
    begins with its quote, so no text equals a word or a sign.
    """

    breaks: frozenset[str] = frozenset()
    counted: frozenset[str] = frozenset()
    importing: frozenset[str] = frozenset()
    modifiers: frozenset[str] = frozenset()

    def __init__(self, raw: str, symbols: bool = True):
        self.raw, self.out, self.symbols = raw, Parsed(), symbols
        pairs = _TOKEN.findall(raw)
        while pairs and not pairs[-1][1]:
            pairs.pop()
        self.gaps, self.texts = [g for g, _ in pairs], [t for _, t in pairs]
        self.ends = list(accumulate([len(g) + len(t) for g, t in pairs]))
        self.lines = [m.end() for m in re.finditer("\n", raw)]
        self.match: dict[int, int] = {}
        opened: list[int] = []
        texts = self.texts
        for k in [k for k, t in enumerate(texts) if t in _BRACKETS]:
            t = texts[k]
            if t in _CLOSES:
                opened.append(k)
            else:
                while opened and _CLOSES[texts[opened[-1]]] != t:
                    opened.pop()
                if opened:
                    self.match[opened.pop()] = k
        # what a block must hold to count: a block, or a bracket that nothing closes, which reaches to the text's end
        counted, known = (self.counted | _CLOSES.keys(), "([") if symbols else (self.importing | _CLOSES.keys(), "([{")
        self.marks = [k for k, t in enumerate(texts) if t in counted and (t not in known or k not in self.match)]
        self.braces = [k for k in self.marks if texts[k] in _CLOSES] if symbols else self.marks

    def is_(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.texts) and self.texts[k] in texts

    def word(self, k: int) -> str | None:
        if not 0 <= k < len(self.texts):
            return None
        t = self.texts[k]
        return t if t[0].isalnum() or t[0] in "_$\\" else None

    def start(self, k: int) -> int:
        return self.ends[k] - len(self.texts[k])

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at) + 1

    def begins_line(self, k: int) -> bool:
        return k == 0 or "\n" in self.gaps[k]

    def closing(self, k: int) -> int:
        """Number of the token that closes the bracket at k; the last one where none does."""
        return self.match.get(k, len(self.texts) - 1)

    def walk(self) -> Parsed:
        texts, match, breaks, final = self.texts, self.match, self.breaks, len(self.texts) - 1
        holds = lambda marks, k, close: (at := bisect.bisect_right(marks, k)) < len(marks) and marks[at] < close
        todo = [(0, len(texts), Scope(), True)]
        while todo:
            k, end, scope, counts = todo.pop()
            head: list[int] = []
            while k < end:
                t = texts[k]
                if t == "{":
                    # a block inside round or square brackets is no declaration's, but may hold some
                    inner, close = self.declare(head, k, scope) if counts else scope.body(), match.get(k, final)
                    if close > k + 1 if inner.members and self.symbols else holds(self.marks, k, close):
                        todo.append((k + 1, close, inner, True))
                    k, head = close + 1, []
                elif t == ";":
                    if counts:
                        self.declare(head, None, scope)
                    k, head = k + 1, []
                elif t == "(" or t == "[":
                    close = match.get(k, final)
                    if holds(self.braces, k, close):  # nothing but a block counts in there
                        todo.append((k + 1, close, scope, False))
                    head.append(k)
                    k = close + 1
                else:
                    if t in breaks and head and counts and self.begins_line(k) and not self.is_(head[-1], "=", ",", "=>", *self.modifiers):
                        self.declare(head, None, scope)
                        head = []
                    head.append(k)
                    k += 1
            if head and counts:
                self.declare(head, None, scope)
        return self.out

    def declare(self, head: list[int], opener: int | None, scope: Scope) -> Scope:
        raise NotImplementedError

    def add(self, name: str, kind: str, head: list[int], last: int | None, parent: str | None = None, limit: int = 300) -> None:
        """A symbol from a head's first token to token ``last``, or on its first line only; its signature is the head's text."""
        if not self.symbols:
            return
        at = self.start(head[0])
        signature = " ".join(_CUT.split(self.raw[at : min(at + limit, self.ends[self.end(head, None)])], maxsplit=1)[0].split())
        begin = self.line(at)
        self.out.symbols.append(Symbol(name, kind, signature, parent, begin, begin if last is None else self.line(self.start(last))))

    def end(self, head: list[int], opener: int | None) -> int:
        """The token that ends a declaration: its block's brace, or the last of its head."""
        return self.closing(opener) if opener is not None else self.closing(head[-1]) if self.is_(head[-1], "(", "[") else head[-1]

    def leading(self, head: list[int]) -> int:
        """How many of a head's tokens are attributes and modifiers."""
        texts, modifiers = self.texts, self.modifiers
        for n, k in enumerate(head):
            t = texts[k]
            if t not in modifiers and t != "[" and t != "#":
                return n
        return len(head)

    def named(self, head: list[int], keywords: frozenset[str]) -> tuple[str, str] | None:
        """(keyword, name) if a head is a keyword and a name behind modifiers alone."""
        n = self.leading(head)
        if n < len(head) and self.texts[head[n]] in keywords:
            name = next((self.word(k) for k in head[n + 1 : n + 3] if self.word(k) and not self.is_(k, *keywords)), None)
            if name:
                return self.texts[head[n]], name
        return None

    def called(self, head: list[int]) -> int | None:
        """The place in a head of the name before its first round brackets; type parameters may stand between."""
        texts = self.texts
        for at, k in enumerate(head):
            if texts[k] == "(":
                break
        else:
            return None
        if not at:
            return None
        n, depth = at - 1, 0
        while n >= 0 and (depth or texts[head[n]] == ">"):
            depth += (texts[head[n]] == ">") - (texts[head[n]] == "<")
            n -= 1
        return n if n >= 0 and self.word(head[n]) else None

    def before(self, head: list[int], *signs: str) -> list[int]:
        texts = self.texts
        for n, k in enumerate(head):
            if texts[k] in signs:
                return head[:n]
        return head


#: Parts of a syntax tree's nodes that hold statements, in the order of their fields.
_STATEMENTS = ("body", "handlers", "cases", "orelse", "finalbody")


def parse_python(source: str, symbols: bool = True) -> Parsed:
    out = Parsed()
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return out
    lines = source.splitlines() if symbols else []

    def add(node: ast.stmt, name: str, kind: str, parent: str | None) -> None:
        if symbols:
            out.symbols.append(Symbol(name, kind, lines[node.lineno - 1].strip().rstrip(":").strip(), parent, node.lineno, node.end_lineno or node.lineno))

    todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while todo:
        node, parent = todo.pop()
        inner: list[tuple[ast.AST, str | None]] = []
        for part in _STATEMENTS:  # statements stand below statements alone, never inside expressions
            children = getattr(node, part, None)
            for child in children if isinstance(children, list) else ():
                kind = type(child)
                if kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
                    add(child, child.name, "method" if parent else "function", parent)
                    if len(child.body) > 1 or hasattr(child.body[0], "body") or isinstance(child.body[0], (ast.Import, ast.ImportFrom, ast.Match)):
                        inner.append((child, parent or child.name))
                elif kind is ast.ClassDef:
                    add(child, child.name, "class", parent)
                    inner.append((child, child.name))
                elif kind is ast.Import:
                    out.imports += [(a.name, "module") for a in child.names]
                elif kind is ast.ImportFrom:
                    level, module = "relative" if child.level else "module", "." * child.level + (child.module or "")
                    joint = "" if module.endswith(".") or not module else "."
                    out.imports += [(module, level), *((module + joint + a.name, level) for a in child.names if a.name != "*")]
                elif kind is ast.Assign:
                    if parent is None:
                        for t in child.targets:
                            if isinstance(t, ast.Name) and t.id.isupper():
                                add(child, t.id, "const", None)
                elif hasattr(child, "body") or kind is ast.Match:
                    inner.append((child, parent))
        todo += reversed(inner)
    return out


class Php(Scanner):
    modifiers = frozenset("abstract final readonly public protected private static var".split())
    types = frozenset(("class", "interface", "trait", "enum"))
    importing = frozenset(("namespace", "use"))
    counted = types | importing | {"function"}

    def declare(self, head: list[int], opener: int | None, scope: Scope) -> Scope:
        if head and self.is_(head[0], "<"):  # the opening tag
            head = head[3:]
        if not head:
            return scope.body()
        if self.is_(head[0], "namespace") and len(head) > 1:
            self.out.namespace = self.out.namespace or self.word(head[1])
            return scope
        if self.is_(head[0], "use") and not self.is_(head[1] if len(head) > 1 else -1, "function", "const", "("):
            self.uses(head, opener)
            return scope
        if found := self.named(head, self.types):
            self.add(found[1], found[0], head, self.end(head, opener))
            return scope.type(found[1])
        n = self.leading(head)
        if n < len(head) and self.is_(head[n], "function"):
            at = self.called(head)
            if at is not None and n < at <= n + 2:
                self.add(self.word(head[at]), "method" if scope.outer else "function", head, self.end(head, opener), scope.outer)
        elif n and scope.members:
            name = next((self.word(k) for k in self.before(head, "=") if (self.word(k) or "").startswith("$")), None)
            if name:
                self.add(name[1:], "property", head, None, scope.outer, 160)
        return scope.body()

    def uses(self, head: list[int], opener: int | None) -> None:
        stem, parts = "", [head[1:]]
        if opener is not None:
            stem, parts = (self.word(head[-1]) or "").rstrip("\\") + "\\", [list(range(opener + 1, self.closing(opener)))]
        for name in (x for part in parts for x in self.listed(part)):
            self.out.imports.append((stem + name, "use"))

    def listed(self, part: list[int]) -> list[str]:
        """First word of each of the parts between commas."""
        return [self.word(k) for n, k in enumerate(part) if self.word(k) and (n == 0 or self.is_(part[n - 1], ","))]


class JavaScript(Scanner):
    modifiers = frozenset("export default declare abstract public private protected static readonly async override get set".split())
    breaks = frozenset("export import const let var function class interface enum type async abstract declare".split())
    types = frozenset(("class", "interface", "enum"))
    counted = types | {"type", "function", "const", "let", "var"}
    keywords = frozenset("if for while switch catch return function constructor else do try with".split())

    def walk(self) -> Parsed:
        for k, t in enumerate(self.texts):
            if t[0] in _QUOTES and (self.is_(k - 1, "from", "import") or self.is_(k - 1, "(") and self.is_(k - 2, "require", "import")):
                self.out.imports.append((t[1:-1], "relative" if t[1:].startswith((".", "/", "@/", "~/")) else "module"))
        return super().walk() if self.symbols else self.out

    def declare(self, head: list[int], opener: int | None, scope: Scope) -> Scope:
        n = self.leading(head)
        if n >= len(head):
            return scope.body()
        if found := self.named(head, self.types):
            if opener is not None:
                self.add(found[1], found[0], head, self.end(head, opener))
            return scope.type(found[1]) if found[0] == "class" else scope.body()
        name = self.word(head[n + 1]) if n + 1 < len(head) else None
        if self.is_(head[n], "type") and name and any(self.is_(k, "=") for k in head):
            self.add(name, "type", head, None, None, 160)
        elif self.is_(head[n], "function"):
            at = self.called(head)
            if at is not None and n < at <= n + 2:
                self.add(self.word(head[at]), "function", head, self.end(head, opener), scope.outer)
        elif self.is_(head[n], "const", "let", "var") and name and not scope.outer and any(self.is_(k, "=>") for k in head):
            last = opener if opener is not None and self.is_(head[-1], "=>") else None
            self.add(name, "function", head, self.end(head, last))
        elif scope.members and opener is not None:
            self.member(head, opener, scope)
        return scope.body()

    def member(self, head: list[int], opener: int, scope: Scope) -> None:
        """A method: a name that modifiers alone precede on its line, brackets, perhaps a type, and the block."""
        first = max((n for n, k in enumerate(head) if self.begins_line(k)), default=0)
        rest = head[first:]
        at = self.called(rest)
        if at is not None and self.leading(rest) in (at, at + 1) and not self.is_(rest[at], *self.keywords) and not any(self.is_(k, "=>", "=") for k in rest):
            self.add(self.word(rest[at]), "method", rest, self.closing(opener), scope.outer)


class CSharp(Scanner):
    modifiers = frozenset("public internal private protected static abstract sealed partial readonly file virtual override async extern new required".split())
    types = frozenset(("class", "interface", "record", "struct", "enum"))
    importing = frozenset(("namespace", "using"))
    counted = types | importing
    keywords = frozenset("if for foreach while switch catch return using lock else new".split())

    def declare(self, head: list[int], opener: int | None, scope: Scope) -> Scope:
        if not head:
            return scope.body()
        words = [self.texts[k] for k in head]
        if words[0] == "namespace":
            self.out.namespace = self.out.namespace or "".join(words[1:])
            return scope
        start = next((n + 1 for n, w in enumerate(words[:2]) if w == "using"), None)
        if start and opener is None and words[:start] in (["using"], ["global", "using"]):
            name = words[start + (words[start : start + 1] == ["static"]) :]
            if name and all(w == "." or self.word(k) for w, k in zip(name, head[-len(name) :])) and name[1::2] == ["."] * (len(name) // 2):
                self.out.imports.append(("".join(name), "namespace"))
            return scope
        if found := self.named(head, self.types):
            self.add(found[1], found[0], head, self.end(head, opener))
            return scope.type(found[1])
        plain = self.before(head, "=>", "=")
        if scope.members and any(self.texts[k] in self.modifiers for k in head[: self.leading(head)]):
            at = self.called(plain)
            if at is not None and not self.is_(plain[at], *self.keywords):
                name = self.word(plain[at])
                self.add(name, "constructor" if name == scope.inner else "method", head, self.end(head, opener), scope.inner)
            elif opener is not None and plain == head and self.word(head[-1]) and self.is_(opener + 1, "get", "set", "init"):
                self.add(self.word(head[-1]), "property", head, None, scope.inner, 160)
        return scope.body()


def scripts_only(source: str) -> str:
    """A component's scripts on their own lines; a text without any as it is."""
    found = list(re.finditer(r"<script[^>]*>(.*?)</script>", source, re.S)) if "<script" in source or "<template" in source else []
    if not found:
        return source
    edges = [0, *(at for m in found for at in m.span(1)), len(source)]
    return "".join(part if k % 2 else re.sub(r"[^\n]", " ", part) for k, part in enumerate(source[a:b] for a, b in zip(edges, edges[1:])))


PARSERS = {
    "python": parse_python, "php": lambda s, symbols=True: Php(s, symbols).walk(), "csharp": lambda s, symbols=True: CSharp(s, symbols).walk(),
    **dict.fromkeys(("javascript", "typescript", "vue"), lambda s, symbols=True: JavaScript(scripts_only(s), symbols).walk()),
}


def parse(language: str, source: str | None, symbols: bool = True) -> Parsed:
    """Symbols by line.  Unknown languages and null sources have none."""
    out = PARSERS[language](source, symbols) if source and language in PARSERS else Parsed()
    out.symbols.sort(key=lambda x: x.line_start)
    return out


_TYPE_LIKE = re.compile("[A-Z][A-Za-z0-9_]{3,}")
#: Rows of parsed files: what they are of (a symbol, an import or a file's namespace), and a symbol's columns; an import's raw is its name.
FACT = "path string, fact string, pos int, name string, kind string, signature string, parent string, line_start int, line_end int"
_FACT = pa.schema([(x.split()[0], pa.int32() if x.endswith(" int") else pa.string()) for x in FACT.split(", ")])


def facts(files: DataFrame, *wanted: str, also: Callable[[str, str | None, Parsed], list[tuple[str, str, int, str]]] | None = None) -> DataFrame:
    """Rows of FACT of files (path, language, content): ``wanted`` of symbol, definition (symbols that define a name, or whose own
    name is type-like), import, namespace.

    Flat rows leave Python as Arrow columns, a megabyte of text at a time; signatures are made only where symbols are asked for.
    ``also`` gives more rows (path, fact, pos, name) of each file, here of those without a parser too.
    """
    whole, some = "symbol" in wanted, "definition" in wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, 2):
                rows: list[tuple] = []
                # syntax trees hold no cycles: searching for some while they are made costs a third of the time
                gc.disable()
                try:
                    for path, language, text in zip(*(c.to_pylist() for c in part.columns)):
                        p = parse(language, text, whole or some)
                        if whole or some:
                            rows += [(path, "symbol", n, x.name, x.kind, x.signature, x.parent, x.line_start, x.line_end) for n, x in enumerate(p.symbols) if whole or x.kind in DEFINING or _TYPE_LIKE.fullmatch(x.name)]
                        if "import" in wanted:
                            rows += [(path, "import", n, raw, kind, None, None, None, None) for n, (raw, kind) in enumerate(p.imports)]
                        if "namespace" in wanted and p.namespace is not None:
                            rows.append((path, "namespace", 0, p.namespace, None, None, None, None, None))
                        if also:
                            rows += [(*x, None, None, None, None, None) for x in also(path, text, p)]
                finally:
                    gc.enable()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FACT)], schema=_FACT)

    rows = (files if also else files.filter(F.col("language").isin(*PARSERS))).select("path", "language", "content")
    cores = files.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # few input files: parsing is dear beside a shuffle of what there is
        rows = rows.repartition(cores)
    return rows.mapInArrow(run, FACT)


def symbols(files: DataFrame) -> DataFrame:
    return symbols_of(facts(files, "symbol"))


def imports(files: DataFrame) -> DataFrame:
    return imports_of(facts(files, "import"))


def symbols_of(facts: DataFrame) -> DataFrame:
    """(path, pos, symbol) of parsed files; pos is the symbol's place in its file."""
    return facts.filter("fact = 'symbol'").drop("fact")


def imports_of(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'import'").select("path", "pos", F.col("name").alias("raw"), "kind")


def namespaces_of(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'namespace'").select("path", F.col("name").alias("namespace"))


def structural_summary(symbol: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """(key, summary) of each file with symbols or imports: first four types, up to six operations (public ones first), what it uses.

    symbol and imported carry ``pos``, their place in the file.
    """
    kind, shown = F.col("kind"), F.col("signature")
    public = shown.contains("public") | (kind == "function") | ~shown.rlike("private|protected")
    # types, public operations, others; no signature is shuffled
    group = F.when(kind.isin("class", "interface", "trait", "enum", "record", "struct"), 0).when(kind.isin("method", "function", "constructor"), F.when(public, 1).otherwise(2))
    rows = symbol.select(key, "pos", "name", group.cast("byte").alias("g"))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("g").isNotNull(), F.struct("pos", "name", "g")))).alias("s"))
    of = lambda *groups: F.filter("s", lambda x: x["g"].isin(*groups))
    last = F.regexp_extract("raw", r"([^/\\\\]*)$", 1)
    used = imported.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", last.alias("x")))).alias("i"))
    types, ops, open_ = of(0), of(1, 2), of(1)
    names = lambda xs, n: F.array_join(F.transform(F.slice(xs, 1, n), lambda x: x["name"]), ", ")
    more = F.when(F.size(types) > 4, F.concat(F.lit(" (+"), (F.size(types) - 4).cast("string"), F.lit(" more)"))).otherwise("")
    parts = F.array(
        F.when(F.size(types) > 0, F.concat(F.lit("Defines "), names(types, 4), more)),
        F.when(F.size(ops) > 0, F.concat(F.size(ops).cast("string"), F.lit(" operations incl. "), F.when(F.size(open_) > 0, names(open_, 6)).otherwise(names(ops, 6)))),
        F.when(F.size("i") > 0, F.concat(F.lit("uses "), F.array_join(F.array_distinct(F.transform(F.slice("i", 1, 6), lambda x: x["x"])), ", "))),
    )
    both = lists.join(used, key, "full")
    return both.select(key, F.concat(F.array_join(F.array_compact(parts), "; "), F.lit(".")).alias("summary"))


def samples(spark: SparkSession) -> DataFrame:
    rows = [
        ("app/cart.py", "python", "import os\nfrom .store import Store\nLIMIT = 3\n\nclass Cart:\n    def add(self, x):\n        return x\n\ndef total():\n    pass\n"),
        ("app/Cart.php", "php", "<?php\nnamespace App;\nuse App\\Models\\{Item, User};\nclass Cart {\n    private int $n;\n    public function add($x) { return '}'; }\n}\n"),
        ("src/cart.ts", "typescript", "import { a } from './a'\nexport class Cart {\n  add(x: number): void {\n  }\n}\nexport const total = (x) => x\nexport interface Item { id: number }\n"),
        ("Api/Cart.cs", "csharp", "using System;\nnamespace Api;\npublic class Cart\n{\n    public Cart(int n) { }\n    public int Size { get; set; }\n    public async Task<int> Total() { return 1; }\n}\n"),
    ]
    return spark.createDataFrame(rows, "path string, language string, content string")
