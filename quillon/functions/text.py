"""Scalar text functions as Column expressions.  All but the token count, which is an Arrow function, stay inside the JVM."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Words that a task's terms leave out (fixed values).
STOPWORDS = [
    "the", "a", "an", "to", "for", "of", "in", "on", "and", "or", "with", "add", "create", "make", "new", "update", "fix", "change", "implement",
    "support", "should", "when", "that", "this", "is", "are", "be", "it", "into", "from", "by", "as", "at", "so", "we", "i", "use", "using", "via",
    "our", "my", "file", "files", "code", "please", "need", "want", "can", "feature", "bug", "issue", "error", "where", "does", "doesn", "do", "not",
    "no", "if", "then", "than", "but", "also", "only", "all", "any", "some", "how", "what", "which", "who", "why", "will", "would", "could", "have",
    "has", "had", "been", "was", "were", "get", "set", "run", "runs", "work", "works", "working", "correctly", "properly", "currently", "still",
    "after", "before", "instead", "like", "just", "very", "more", "less", "same",
]
#: Words that a file's terms leave out (fixed values).
TERM_STOP = [
    "the", "and", "for", "this", "that", "with", "from", "return", "function", "public", "private", "protected", "static", "class", "const", "let",
    "var", "new", "null", "true", "false", "void", "int", "string", "bool", "array", "self", "import", "export", "default", "async", "await", "def",
    "not", "none", "else", "elif", "use", "namespace", "using", "get", "set", "value", "type", "name", "data", "key", "item", "list", "dict",
    "object", "result", "response", "request", "error", "exception", "throw", "try", "catch", "finally", "foreach", "while", "break", "continue",
    "case", "switch", "extends", "implements", "interface", "abstract", "final", "override", "virtual", "readonly", "param", "params", "args",
    "kwargs", "http", "https", "com", "org", "www", "html", "div", "span", "props", "state", "console", "log",
]
WORD = r"[A-Za-z_][A-Za-z0-9_]*"
HIDDEN = "***REDACTED***"
#: Quoted value after a key that sounds secret; connection parts; well-known key literals (fixed patterns).
_SECRET_KEY = r"""(?i)((?:api[_-]?key|secret[_-]?key|client[_-]?secret|access[_-]?token|auth[_-]?token|refresh[_-]?token|password|passwd|pwd|private[_-]?key|connection[_-]?string|dsn|secret|token|bearer)\b[\w\-\.\[\]"']{0,32}?\s*[:=]\s*)"""
SECRETS = (
    (_SECRET_KEY + r'"[^"\'\n]{8,}"', r'$1"' + HIDDEN + '"'),
    (_SECRET_KEY + r"'[^\"'\n]{8,}'", r"$1'" + HIDDEN + "'"),
    (r"""(?i)((?:password|pwd|secret|token|api[_-]?key)=)([^;&\s"']{3,})""", "$1" + HIDDEN),
    (r"\b(?:sk-[A-Za-z0-9_\-]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{30,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9\-]{10,}|eyJ[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{10,})\b", HIDDEN),
)


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def split_identifier(name: Column) -> Column:
    """Lower-case parts of a camel-case, acronym or separated name."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.lower), lambda p: p != "")


def _within(word: Column, those: list[str]) -> Column:
    return F.array_contains(F.array(*map(F.lit, those)), word)


def tokenize(text: Column) -> Column:
    """Terms of a task, in order, with repeats: parts of identifiers, and compound identifiers whole."""

    def of(w: Column) -> Column:
        parts = split_identifier(w)
        short = F.filter(parts, lambda p: (F.length(p) > 1) & ~_within(p, STOPWORDS))
        whole = F.when((F.size(parts) > 1) & ~_within(F.lower(w), STOPWORDS), F.array(F.lower(w))).otherwise(F.array().cast("array<string>"))
        return F.concat(short, whole)

    return F.flatten(F.transform(words(text), of))


def content_terms(text: Column) -> Column:
    """Terms of a file in order, with repeats."""

    def of(w: Column) -> Column:
        parts = F.filter(split_identifier(w), lambda p: (F.length(p) >= 3) & ~_within(p, TERM_STOP) & ~p.rlike("^[0-9]+$"))
        compound = w.contains("_") | w.rlike("^.+[A-Z]")
        whole = F.when(compound & ~_within(F.lower(w), TERM_STOP), F.array(F.lower(w))).otherwise(F.array().cast("array<string>"))
        return F.concat(parts, whole)

    return F.flatten(F.transform(words(text, r"[A-Za-z_][A-Za-z0-9_]{2,}"), of))


#: Bytes of text that Python works on at once: what a task holds does not grow with its input, nor with Arrow's batches.
PIECE_BYTES = 1 << 20
#: What a byte is to the token count: 0 inside a character, 1 letter or underscore, 2 digit, 3 white space (as in SQL, without the vertical tab), 4 anything else.
_CLASS = np.array(
    [1 if chr(b).isascii() and (chr(b).isalpha() or b == 95) else 2 if 48 <= b <= 57 else 3 if b in b" \t\n\f\r" else 0 if 0x80 <= b <= 0xBF else 4 for b in range(256)], np.uint8
)


def _runs(mask: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of runs of true; ``edge`` marks the first byte of each text, where a run ends."""
    first = mask & (edge | ~np.append(False, mask[:-1]))
    begin = np.flatnonzero(first)
    last = mask & np.append(edge[1:] | ~mask[1:], True)
    return begin, np.flatnonzero(last) + 1


def count_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Estimated tokens of each text; text i is the UTF-8 bytes offsets[i] to offsets[i + 1]."""
    n = len(offsets) - 1
    kind = _CLASS[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    total = np.zeros(n, np.int64)
    owner = lambda at: np.searchsorted(offsets, at, side="right") - 1
    begin, end = _runs((kind == 1) | (kind == 2), edge)
    if len(begin):  # digits in front, then an identifier
        letter = np.minimum.reduceat(np.where(kind == 1, np.arange(len(data)), len(data)), begin)
        digits = np.minimum(letter, end) - begin
        rest = end - begin - digits
        total += np.bincount(owner(begin), (digits + 2) // 3 + (rest + 4) // 5, n).astype(np.int64)
    begin, end = _runs(kind == 3, edge)
    if len(begin):
        broken = np.add.reduceat((data == 10).astype(np.int64), begin) > 0
        # reduceat reads on to the next run, in which nothing but white space counts: line ends between two runs belong to the first
        total += np.bincount(owner(begin), broken | (end - begin > 3), n).astype(np.int64)
    total += np.bincount(owner(np.flatnonzero(kind == 4)), minlength=n)
    return total * 105 // 100


@F.arrow_udf(LongType())
def _token_count(text: pa.Array) -> pa.Array:
    raw = pa.array(text.cast(pa.large_binary()).fill_null(b""))
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    out, at = np.zeros(len(raw), np.int64), 0
    while at < len(raw):  # the count takes dozens of bytes for each byte of text
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1)
        out[at:end] = count_tokens(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end
    return pa.array(out, mask=text.is_null().to_numpy(zero_copy_only=False))


def token_count(text: Column) -> Column:
    """Estimated model tokens: identifiers by fives, digits by threes, signs one each, plus five per cent.  Null stays null.

    One pass over a batch's bytes: about twenty times faster than a fold over extracted pieces inside the JVM.
    """
    return _token_count(text)


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts take ``most`` bytes, or one longer text each."""
    at = held = 0
    for n, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if n > at and held + (size or 0) > most:
            yield batch.slice(at, n - at)
            at, held = n, 0
        held += size or 0
    if at < batch.num_rows:
        yield batch.slice(at)


def term_list(text: str, split: dict[str, list[str]]) -> dict[str, int]:
    """Count of each term of a file, in the order in which they are first seen.  ``split`` remembers words' terms."""
    counts: dict[str, int] = {}
    for word, n in Counter(_TERM_WORD.findall(text)).items():
        if (terms := split.get(word)) is None:
            parts = [p for p in _PARTS.sub(r"\1\3 \2\4", word).replace("_", " ").lower().split() if len(p) >= 3 and p not in _TERM_STOP and not p.isdigit()]
            low = word.lower()
            terms = [*parts, low] if ("_" in word or low[1:] != word[1:]) and low not in _TERM_STOP else parts
            if len(split) >= 200_000:
                split.clear()
            split[word] = terms
        for t in terms:
            counts[t] = counts.get(t, 0) + n
    return counts


def token_list(text: str, split: dict[str, list[str]]) -> list[str]:
    """tokenize of one text, outside a plan.  ``split`` remembers words' terms."""
    out: list[str] = []
    for word in _WORD.findall(text):
        if (terms := split.get(word)) is None:
            parts, low = identifier_parts(word), word.lower()
            terms = [p for p in parts if len(p) > 1 and p not in _STOP] + ([low] if len(parts) > 1 and low not in _STOP else [])
            if len(split) >= 200_000:
                split.clear()
            split[word] = terms
        out += terms
    return out


def identifier_parts(name: str) -> list[str]:
    """split_identifier of one name, outside a plan."""
    return re.sub("[^A-Za-z0-9]+", " ", _PARTS.sub(r"\1\3 \2\4", name)).lower().split()


_TERM_WORD = re.compile("[A-Za-z_][A-Za-z0-9_]{2,}")
_PARTS = re.compile("([a-z0-9])(?=[A-Z])()|([A-Z])(?=[A-Z][a-z])()")
_TERM_STOP, _STOP = frozenset(TERM_STOP), frozenset(STOPWORDS)
_WORD = re.compile(WORD)


def loc(text: Column) -> Column:
    """Lines, an unfinished last one included."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return (breaks + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def redact(text: Column) -> Column:
    for pattern, by in SECRETS:
        text = F.regexp_replace(text, pattern, by)
    return text


def looks_like_identifier(word: Column) -> Column:
    return (word.rlike("^.+[A-Z]") | word.contains("_") | word.rlike("[0-9]")) & (F.length(word) >= 5)


def normalize_path(path: Column) -> Column:
    """``.`` and ``..`` resolved by name alone."""
    none = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(none)
        return F.when((p == "") | (p == "."), acc).when(p == "..", up).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def strip_json_comments(text: Column) -> Column:
    """JSON without comments and trailing commas; strings stay as they are."""
    kept = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*(?s:.*?)\*/', "$1")
    return F.regexp_replace(kept, r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', "$1$2")


def slugify(text: Column, limit: int = 40) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, limit), "-+$", "")
    return F.when(slug == "", "task").otherwise(slug)


def summary_line(text: Column, limit: int = 600) -> Column:
    return F.substring(F.regexp_replace(F.trim(text), r"\s+", " "), 1, limit)


def test_subject(stem: Column) -> Column:
    """What a test's file name is about; plural forms leave no rest."""
    return F.regexp_replace(stem, r"Tests?|Spec|_tests?|tests?_|\.test|\.spec", "")


def as_json(values: list[str]) -> str:
    return json.dumps(values)


def from_json(text: str) -> list[str]:
    return json.loads(text)


def rules_bullets(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[-*1-9]"))


def diff_paths(diff: Column) -> Column:
    return F.regexp_extract_all(diff, F.lit(r"(?m)^diff --git a/(.+?) b/(.+)$"), F.lit(2))
