"""A source repository made from a table of documents: what the engine indexes where a corpus has prose only.

Each document becomes one file, by its id's remainder of 5: a Python module, a PHP class, a TypeScript class, a C# class, or a
Python test of the module four ids before.  A file's members are the document's different words of four letters or more, over its
whole text; it imports the file ten ids on (a test its subject, C# the next namespace), and names the class one id on in a comment.
Fifty ids share a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def source_files(docs: DataFrame) -> DataFrame:
    """(doc_id, path, language, content) of documents (doc_id, text)."""
    i, kind = F.col("doc_id"), F.col("doc_id") % 5
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("[a-z]{4,}"), F.lit(0))))
    rows = docs.select("doc_id", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    folder = lambda x: F.floor(x / 50)
    here, on = folder(i), i + 10
    near = F.when(folder(on) == here, _text(".doc_", on)).otherwise(_text("..m", folder(on), ".doc_", on))
    path = (
        F.when(kind == 0, _text("pkg/m", here, "/doc_", i, ".py")).when(kind == 1, _text("app/M", here, "/Doc", i, ".php")).when(kind == 2, _text("src/m", here, "/doc", i, ".ts"))
        .when(kind == 3, _text("Api/N", here, "/Doc", i, ".cs")).otherwise(_text("tests/m", here, "/test_doc_", i - 4, ".py"))
    )
    language = F.when(kind == 1, "php").when(kind == 2, "typescript").when(kind == 3, "csharp").otherwise("python")
    see, members = _text("see Doc", i + 1, "\n"), lambda a, b: F.array_join(F.transform("words", lambda w: _text(a, w, b)), "")
    python = _text("    size = 1\n", members("    def do_", "(self):\n        return 0\n"))
    content = (
        F.when(kind == 0, _text("from ", near, " import Doc", on, "\n# ", see, "class Doc", i, ":\n", python))
        .when(kind == 1, _text("<?php\nnamespace App\\M", here, ";\nuse App\\M", folder(on), "\\Doc", on, ";\n// ", see, "class Doc", i, " {\n", members("    public function do_", "() { return 0; }\n"), "}\n"))
        .when(kind == 2, _text("import { Doc", on, " } from '@/m", folder(on), "/doc", on, "'\n// ", see, "export class Doc", i, " {\n", members("  do_", "(x: number): void { return }\n"), "}\n"))
        .when(kind == 3, _text("using Api.N", here + 1, ";\nnamespace Api.N", here, ";\n// ", see, "public class Doc", i, "\n{\n", members("    public int do_", "() { return 0; }\n"), "}\n"))
        .otherwise(_text("from pkg.m", folder(i - 4), ".doc_", i - 4, " import Doc", i - 4, "\n# ", see, "class TestDoc", i, ":\n", python))
    )
    return rows.select("doc_id", path.alias("path"), language.alias("language"), content.alias("content"))


#: The same rows in SQL: src (doc_id, k, here, there, words, path, language, content).
SQL = """words AS (SELECT doc_id, doc_id % 5 AS k, doc_id // 50 AS here, (doc_id + 10) // 50 AS there, coalesce(list_sort(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{4,}'))), []) AS words FROM documents),
src AS (SELECT *, CASE k WHEN 0 THEN 'pkg/m' || here || '/doc_' || doc_id || '.py' WHEN 1 THEN 'app/M' || here || '/Doc' || doc_id || '.php' WHEN 2 THEN 'src/m' || here || '/doc' || doc_id || '.ts' WHEN 3 THEN 'Api/N' || here || '/Doc' || doc_id || '.cs' ELSE 'tests/m' || here || '/test_doc_' || (doc_id - 4) || '.py' END AS path,
CASE k WHEN 1 THEN 'php' WHEN 2 THEN 'typescript' WHEN 3 THEN 'csharp' ELSE 'python' END AS language,
CASE WHEN there = here THEN '.doc_' || (doc_id + 10) ELSE '..m' || there || '.doc_' || (doc_id + 10) END AS near,
CASE k
WHEN 0 THEN 'from ' || CASE WHEN there = here THEN '.doc_' || (doc_id + 10) ELSE '..m' || there || '.doc_' || (doc_id + 10) END || ' import Doc' || (doc_id + 10) || chr(10) || '# see Doc' || (doc_id + 1) || chr(10) || 'class Doc' || doc_id || ':' || chr(10) || '    size = 1' || chr(10) || array_to_string(list_transform(words, lambda w : '    def do_' || w || '(self):' || chr(10) || '        return 0' || chr(10)), '')
WHEN 1 THEN '<?php' || chr(10) || 'namespace App\\M' || here || ';' || chr(10) || 'use App\\M' || there || '\\Doc' || (doc_id + 10) || ';' || chr(10) || '// see Doc' || (doc_id + 1) || chr(10) || 'class Doc' || doc_id || ' {' || chr(10) || array_to_string(list_transform(words, lambda w : '    public function do_' || w || '() { return 0; }' || chr(10)), '') || '}' || chr(10)
WHEN 2 THEN 'import { Doc' || (doc_id + 10) || ' } from ''@/m' || there || '/doc' || (doc_id + 10) || '''' || chr(10) || '// see Doc' || (doc_id + 1) || chr(10) || 'export class Doc' || doc_id || ' {' || chr(10) || array_to_string(list_transform(words, lambda w : '  do_' || w || '(x: number): void { return }' || chr(10)), '') || '}' || chr(10)
WHEN 3 THEN 'using Api.N' || (here + 1) || ';' || chr(10) || 'namespace Api.N' || here || ';' || chr(10) || '// see Doc' || (doc_id + 1) || chr(10) || 'public class Doc' || doc_id || chr(10) || '{' || chr(10) || array_to_string(list_transform(words, lambda w : '    public int do_' || w || '() { return 0; }' || chr(10)), '') || '}' || chr(10)
ELSE 'from pkg.m' || ((doc_id - 4) // 50) || '.doc_' || (doc_id - 4) || ' import Doc' || (doc_id - 4) || chr(10) || '# see Doc' || (doc_id + 1) || chr(10) || 'class TestDoc' || doc_id || ':' || chr(10) || '    size = 1' || chr(10) || array_to_string(list_transform(words, lambda w : '    def do_' || w || '(self):' || chr(10) || '        return 0' || chr(10)), '') END AS content FROM words)"""
