"""Path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that paths are classified by, in order; the first that matches counts.
PURPOSES = (
    ("test_or_fixture", r"(?i)(^|/)(tests?|__tests__|fixtures|__fixtures__|mocks|__mocks__|codefixes|testdata)(/|$)|\.(test|spec|stories)\."),
    ("example_or_tooling", r"(?i)(^|/)(examples|docker-examples|tools|scripts)(/|$)|(^|/)(cypress|playwright|vitest|jest|eslint|webpack|vite)\.config\."),
    ("vendor", r"(?i)(^|/)(vendor|vendors|third_party|third-party)(/|$)|\.min\.[cm]?js$"),
    ("initialization", r"(?i)(^|/)(seeds?|migrations|startup|initialization)(/|$)"),
)
PURPOSE_DEFAULT = "application_candidate"
LANGUAGES = (
    ("tsjs", r"(?i)\.[cm]?[jt]sx?$"),
    ("csharp", r"(?i)\.cs$"),
    ("template", r"(?i)\.(?:html?|ejs|hbs|handlebars|pug|cshtml|razor|vue|svelte)$"),
    ("documentation", r"(?i)\.md$"),
)
LANGUAGE_DEFAULT = "configuration"
SOURCE, DECLARATION = r"(?i)\.[cm]?[jt]sx?$", r"(?i)\.d\.[cm]?ts$"
EXCLUDED_DIRECTORIES = (".git", "node_modules", "dist", "build", "coverage", ".angular", ".cache", "bin", "obj")
PRIVATE = r"(?i)(^|/)(?:\.env(?:\..*)?|credentials(?:\.[^/]*)?|secrets?(?:\.[^/]*)?|[^/]+\.(?:pem|key|p12|pfx|kdbx|keystore))$"
PUBLIC = r"(?i)(^|/)(public|wwwroot|static|assets|ftp)(/|$)"
CONTEXT = r"(?i)\.(?:jsonc?|ya?ml|toml|ini|cfg|conf|properties|xml)$"
CONFIG = r"(?i)(^|/)(?:tsconfig[^/]*\.json|package(?:-lock)?\.json|pnpm-lock\.yaml|yarn\.lock|host\.json|function\.json|global\.json|appsettings(?:\.[^/]+)?\.json|azuredeploy(?:\.[^/]+)?\.json|Directory\.[^.]+\.(?:props|targets)|[^/]+\.(?:csproj|sln|slnx|bicep|tf))$"
DOCUMENT = r"(?i)(^|/)(?:README|SECURITY|CONTRIBUTING)\.md$"


def first_match(value: Column, cases: tuple[tuple[str, str], ...], default: str) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(cases):
        out = F.when(value.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def purpose(path: Column) -> Column:
    """What a path is for; null paths have the default."""
    return first_match(F.coalesce(path, F.lit("")), PURPOSES, PURPOSE_DEFAULT)


def language(path: Column) -> Column:
    return first_match(F.coalesce(path, F.lit("")), LANGUAGES, LANGUAGE_DEFAULT)


def is_source(path: Column) -> Column:
    return path.rlike(SOURCE) & ~path.rlike(DECLARATION)


def in_excluded_directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in EXCLUDED_DIRECTORIES]))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last suffix of the name with its dot; a name that begins with its only dot has none."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def normalized(path: Column) -> Column:
    """path without empty and . parts, and with .. parts taking the one before away; .. at the root stays out."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)))
    return F.array_join(kept, "/")


def ancestors(path: Column) -> Column:
    """array<string>: the folders above a path, from the root's, which is empty."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def relative(path: Column, folder: Column) -> Column:
    """The way from a folder to a path, both normalized: .. for each part of the folder that isn't above the path."""
    a, b = F.filter(F.split(folder, "/"), lambda x: x != ""), F.filter(F.split(path, "/"), lambda x: x != "")
    shared = F.size(F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda n: F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))) - 1
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - shared), F.slice(b, shared + 1, F.size(b))), "/")


def safe_relative(path: Column) -> Column:
    """Whether a path is relative, without backslashes, empty, . or .. parts, or NUL."""
    return (path != "") & ~path.rlike(r"(^|/)(\.{1,2})?(/|$)") & ~path.contains("\\") & ~path.contains("\x00")


def glob(pattern: str) -> str:
    """A regular expression for a path glob: * within a part, ** across parts; a bare path stands for all below it, too."""
    out = "".join(".*" if x == "**" else "[^/]*" if x == "*" else "[^/]" if x == "?" else "".join("\\" + c if not c.isalnum() else c for c in x) for x in _glob_parts(pattern))
    return f"^{out}(/.*)?$"


def _glob_parts(pattern: str) -> list[str]:
    import re

    return re.findall(r"\*\*|\*|\?|[^*?]+", pattern)
