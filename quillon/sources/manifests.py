"""What a repository's manifests say: namespace prefixes, path aliases, frameworks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Manifests at a repository's root that are read for import resolution (fixed values).
CONFIGS = ("composer.json", "tsconfig.json", "jsconfig.json")
#: Folders that "@/" may stand for where no configuration names aliases, in order (fixed values).
USUAL_ROOTS = ("src", "resources/js", "app")


@dataclass
class Manifests:
    psr4: list[tuple[str, str]] = field(default_factory=list)
    aliases: list[tuple[str, str]] = field(default_factory=list)
    base_url: str = ""


def _object(text: str | None) -> dict:
    try:
        found = json.loads(text or "{}")
    except json.JSONDecodeError:
        return {}
    return found if isinstance(found, dict) else {}


def read_manifests(files: DataFrame) -> Manifests:
    """Namespace prefixes and aliases of files (path, content).  At most three rows come to the driver: the manifests at the root.

    Comments and trailing commas are allowed, strings stay as they are; a manifest that is no JSON object says nothing.
    """
    rows = files.filter(F.col("path").isin(*CONFIGS)).select("path", T.strip_json_comments(F.col("content")).alias("content")).collect()
    by = {r.path: _object(r.content) for r in rows}
    out = Manifests()
    for section in ("autoload", "autoload-dev"):
        for prefix, folders in by.get("composer.json", {}).get(section, {}).get("psr-4", {}).items():
            out.psr4 += [(prefix.rstrip("\\"), d.strip("/")) for d in ([folders] if isinstance(folders, str) else folders)]
    options = (by.get("tsconfig.json") or by.get("jsconfig.json") or {}).get("compilerOptions", {})
    out.base_url = options.get("baseUrl", ".").strip("./")
    out.aliases = [(alias.rstrip("*"), t.rstrip("*").strip("./")) for alias, targets in options.get("paths", {}).items() for t in targets]
    if not out.aliases:
        row = files.agg(*[F.max(F.col("path").startswith(r + "/")) for r in USUAL_ROOTS]).first()
        out.aliases = [("@/", next((r for k, r in enumerate(USUAL_ROOTS) if row[k]), ""))]
    return out


#: Frameworks by what names them in a manifest, in order (fixed values).
COMPOSER = (("laravel/framework", "Laravel"), ("symfony/", "Symfony"), ("livewire/livewire", "Livewire"), ("filament/filament", "Filament"), ("phpunit/phpunit", "PHPUnit"), ("pestphp/pest", "Pest"))
PACKAGE = (
    ("next", "Next.js"), ("react", "React"), ("vue", "Vue"), ("nuxt", "Nuxt"), ("@nestjs/core", "NestJS"), ("express", "Express"), ("fastify", "Fastify"),
    ("@angular/core", "Angular"), ("svelte", "Svelte"), ("vite", "Vite"), ("typescript", "TypeScript"), ("jest", "Jest"), ("vitest", "Vitest"),
    ("@playwright/test", "Playwright"), ("cypress", "Cypress"), ("tailwindcss", "Tailwind"), ("prisma", "Prisma"), ("@inertiajs/vue3", "Inertia"),
)
PYTHON = (("fastapi", "FastAPI"), ("django", "Django"), ("flask", "Flask"), ("sqlalchemy", "SQLAlchemy"), ("pytest", "pytest"), ("celery", "Celery"), ("langchain", "LangChain"), ("pydantic", "Pydantic"))
MARKERS = ((("go.mod",), "Go"), (("Cargo.toml",), "Rust"), (("Dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yaml"), "Docker"))


def frameworks(files: DataFrame, repo: str | None = None) -> DataFrame:
    """([repo,] frameworks array) of files (path, content): one row, or one for each value of a column ``repo``.

    Manifests at the root, project files down to the third level; a manifest that is no JSON names its kind of project alone.
    """
    path, content = F.col("path"), F.col("content")
    root = lambda *names: F.max(F.when(path.isin(*names), content))
    # files that no rule reads leave before the shuffle
    projects = path.rlike(r"^([^/]+/){0,2}[^/]+\.csproj$")
    asked = files.filter(path.isin("composer.json", "package.json", "pyproject.toml", "requirements.txt", *[n for names, _ in MARKERS for n in names]) | projects | path.endswith(".razor"))
    first = F.slice(F.array_sort(F.collect_list(F.when(projects, F.struct("path", "content")))), 1, 20)
    figures = [
        root("composer.json").alias("composer"), root("package.json").alias("package"), F.lower(F.concat_ws("", root("pyproject.toml"), root("requirements.txt"))).alias("python"),
        F.array_join(F.transform(first, lambda x: x["content"]), "\n").alias("project"), F.coalesce(F.max(path.endswith(".razor")), F.lit(False)).alias("razor"),
        F.count(F.when(projects, 1)).alias("projects"), *[F.coalesce(F.max(path.isin(*names)), F.lit(False)).alias(label) for names, label in MARKERS],
    ]
    one = asked.groupBy(repo).agg(*figures) if repo else asked.agg(*figures)

    def keys(of: str, *sections: str) -> Column:
        found = [F.coalesce(F.json_object_keys(F.get_json_object(of, f"$.{s}")), F.array().cast("array<string>")) for s in sections]
        return F.concat(*found)

    def broken(of: str) -> Column:
        return F.col(of).isNotNull() & F.get_json_object(of, "$").isNull()

    php, node = keys("composer", "require", "require-dev"), keys("package", "dependencies", "devDependencies")
    has = F.array_contains
    laravel = has(php, "laravel/framework")
    symfony = F.exists(php, lambda k: k.startswith("symfony/")) & ~laravel
    project = F.col("project")
    net = F.col("projects") > 0
    labels = [
        *[F.when(symfony if label == "Symfony" else has(php, key), label) for key, label in COMPOSER], F.when(broken("composer"), "PHP/Composer"),
        *[F.when(has(node, key), label) for key, label in PACKAGE], F.when(broken("package"), "Node"),
        F.when(net, F.when(project.contains("Microsoft.AspNetCore") | project.contains("Microsoft.NET.Sdk.Web"), "ASP.NET Core").otherwise(".NET")),
        F.when(net & project.contains("EntityFrameworkCore"), "EF Core"), F.when(net & F.lower(project).contains("xunit"), "xUnit"),
        F.when(net & (project.contains("Blazor") | F.col("razor")), "Blazor"),
        *[F.when(F.col("python").contains(key), label) for key, label in PYTHON], *[F.when(F.col(label), label) for _, label in MARKERS],
    ]
    return one.select(*([repo] if repo else []), F.array_compact(F.array(*labels)).alias("frameworks"))
