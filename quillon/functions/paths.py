"""Classifiers of file paths as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of each file suffix, of whole names, and of double suffixes (fixed values).
SUFFIXES = {
    "py": "python", "pyi": "python", "php": "php", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "vue": "vue", "cs": "csharp", "cshtml": "razor", "razor": "razor",
    "sql": "sql", "prisma": "prisma", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "csproj": "xml",
    "sln": "text", "ini": "ini", "md": "markdown", "mdx": "markdown", "txt": "text", "rst": "text", "html": "html", "htm": "html",
    "css": "css", "scss": "css", "sass": "css", "less": "css", "sh": "shell", "bash": "shell", "zsh": "shell", "go": "go", "rs": "rust",
    "java": "java", "kt": "kotlin", "rb": "ruby", "dockerfile": "docker", "graphql": "graphql", "gql": "graphql",
}
NAMES = {"Dockerfile": "docker", "Makefile": "make", "composer.json": "json", "package.json": "json", ".env.example": "env"}
#: Paths of tests and of configuration (fixed patterns).
TESTS = (r"(^|/)(tests?|__tests__|spec|specs)/", r"\.(test|spec)\.[jt]sx?$", r"(^|/)test_[^/]+\.py$", r"_test\.py$", r"Tests?\.php$", r"Tests?\.cs$", r"\.Tests?/", r"(^|/)e2e/", r"(^|/)cypress/")
CONFIGS = (
    r"(^|/)(config|configs|settings)/", r"(^|/)appsettings.*\.json$", r"(^|/)(\.env.*|composer\.json|package\.json)$",
    r"(^|/)(tsconfig|jsconfig|vite\.config|next\.config|tailwind\.config|webpack\.config|phpunit\.xml|pytest\.ini|pyproject\.toml)",
    r"\.csproj$", r"(^|/)docker-compose.*\.ya?ml$", r"(^|/)Dockerfile$",
)
#: Folders and files that no index holds; ``*`` stands for anything (fixed values).
IGNORED_DIRS = [
    ".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", "vendor", "dist", "build", "out", "coverage", ".next", ".nuxt", "__pycache__", ".venv",
    "venv", "env", ".mypy_cache", ".pytest_cache", ".ruff_cache", "bin", "obj", "storage", "bootstrap/cache", "public/build", "target", ".turbo",
    ".cache",
]
IGNORED_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "poetry.lock", "Pipfile.lock", "Cargo.lock", "*.min.js", "*.min.css",
    "*.map", "*.lock", "*.log", "*.sqlite", "*.db", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.svg", "*.ico", "*.webp", "*.pdf", "*.zip", "*.gz",
    "*.tar", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.mp4", "*.mp3", "*.pyc", "*.dll", "*.exe", "*.so", "*.class", "*.jar", ".env", ".env.*",
    "*.env", "*.pem", "*.key", "*.p12", "*.pfx", "*.jks", "id_rsa*", "*.secret", "secrets.json", "secrets.yaml", "secrets.yml", "*credentials*.json",
    ".npmrc", ".pypirc", ".netrc", "LICENSE", "LICENSE.*", "LICENCE", "LICENCE.*", "COPYING", "COPYING.*", "NOTICE", "NOTICE.*", "OFL.txt",
    "OFL-FAQ.txt", "AUTHORS", "PATENTS", "CODE_OF_CONDUCT.md", "*.LICENSE.txt",
]
#: What a language is called in front of a fenced block (fixed values).
FENCES = {
    "python": "python", "php": "php", "javascript": "javascript", "typescript": "typescript", "vue": "vue", "csharp": "csharp", "json": "json", "yaml": "yaml",
    "sql": "sql", "markdown": "markdown", "blade": "blade", "razor": "razor", "html": "html", "css": "css", "toml": "toml", "xml": "xml", "shell": "bash",
}
#: Languages that have a parser.
STRUCTURAL = ("python", "php", "javascript", "typescript", "vue", "csharp")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def language_for(path: Column) -> Column:
    name = basename(path)
    low = F.lower(name)
    suffix = F.regexp_extract(low, r"^.+\.([^.]+)$", 1)
    return (
        F.when(name.isin(*NAMES), F.element_at(_map(NAMES), name))
        .when(low.endswith(".blade.php"), "blade")
        .when(low.endswith(".d.ts"), "typescript")
        .when(suffix != "", F.element_at(_map(SUFFIXES), suffix))
    )


def _any(path: Column, patterns: tuple[str, ...]) -> Column:
    return path.rlike("|".join(f"(?:{p})" for p in patterns))


def is_test_path(path: Column) -> Column:
    return _any(path, TESTS)


def is_config_path(path: Column) -> Column:
    return _any(path, CONFIGS)


def module_of(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) <= 1, "(root)").when(F.size(parts) == 2, parts[0]).otherwise(F.array_join(F.slice(parts, 1, 2), "/"))


def glob_pattern(glob: str) -> str:
    return re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".")


def ignored(path: Column, dirs: list[str] | None = None, files: list[str] | None = None) -> Column:
    """A directory of the path, or what leads up to it, is ignored; or its name or whole path matches a pattern."""
    dirs, files = dirs or IGNORED_DIRS, files or IGNORED_FILES
    segment = "|".join(glob_pattern(d) for d in dirs if "/" not in d)
    prefix = "|".join(glob_pattern(d) for d in dirs if "/" in d)
    names = "|".join(glob_pattern(f) for f in files)
    out = path.rlike(f"(?:^|/)(?:{segment})/") | basename(path).rlike(f"^(?:{names})$") | path.rlike(f"^(?:{names})$")
    return out | path.rlike(f"^(?:{prefix})/") if prefix else out


def fence(language: Column) -> Column:
    return F.coalesce(F.element_at(_map(FENCES), language), F.lit(""))
