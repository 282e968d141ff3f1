"""What a file's path tells: name, suffix, kind, test or configuration, language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and markers of the file classes.
CODE = [".py", ".go", ".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp", ".rs"]
CONFIG = [".json", ".yml", ".yaml", ".toml", ".xml"]
DOC = [".md", ".rst", ".txt"]
WIDE_CONFIG = [".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".xml", ".lock"]
WIDE_DOC = [".md", ".rst", ".txt", ".doc", ".pdf"]
TEST_MARKERS = ["test_", "_test", "test.", "spec.", ".spec."]
TEST_FOLDERS = ["test", "tests", "spec", "__tests__", "testing"]
CONFIG_PARTS = [
    ".json", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".lock", "dockerfile", "makefile", ".env", "requirements", "package.json",
    "cargo.toml", "setup.py", "setup.cfg", "pyproject.toml", ".github/", "jenkins", "travis", "circle", "gitlab-ci",
]
TEST_PATTERN = r"(?i)test_|_test\.|tests?/|__tests__/|spec\.|\.test\.|\.spec\.|/test/|/tests/"
CONFIG_PATTERN = (
    r"(?i)\.json$|\.ya?ml$|\.toml$|\.ini$|\.cfg$|\.env|Dockerfile|docker-compose|requirements.*\.txt$|package\.json$|Cargo\.toml$"
    r"|go\.mod$|go\.sum$|Gemfile$|pom\.xml$|build\.gradle|CMakeLists\.txt$|Makefile$|\.eslintrc|\.prettierrc|tsconfig\.json$"
)


def name(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path) -> Column:
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def kind(path) -> Column:
    s = suffix(path)
    return F.when(s.isin(CODE), "code").when(s.isin(CONFIG), "config").when(s.isin(DOC), "doc").otherwise("other")


def exclusive_kind(path) -> Column:
    """Tests first, then documents and configuration; any other suffix is code."""
    s = suffix(path)
    return F.when(F.lower(path).rlike("test|spec"), "test").when(s.isin(WIDE_DOC), "doc").when(s.isin(WIDE_CONFIG), "config").when(s != "", "code").otherwise("other")


def is_test(path) -> Column:
    base = F.lower(name(path))
    marked = F.exists(F.array(*map(F.lit, TEST_MARKERS)), lambda m: base.contains(m))
    return marked | F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, TEST_FOLDERS)))


def is_test_part(path) -> Column:
    return F.lower(path).rlike("test|spec")


def is_test_pattern(path) -> Column:
    return path.rlike(TEST_PATTERN)


def is_config_part(path) -> Column:
    import re

    return F.lower(path).rlike("|".join(map(re.escape, CONFIG_PARTS)))


def is_config_pattern(path) -> Column:
    return path.rlike(CONFIG_PATTERN)


#: Language by extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript",
    ".jsx": "javascript", ".tsx": "typescript", ".go": "go",
    ".rs": "rust", ".java": "java", ".c": "c", ".cpp": "cpp",
    ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby",
    ".php": "php", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".sql": "sql", ".sh": "shell",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json",
    ".xml": "xml", ".toml": "toml", ".md": "markdown",
    ".css": "css", ".html": "html", ".vue": "vue",
}


def language(path, names: dict[str, str] | None = None) -> Column:
    """The language by extension; null for others."""
    pairs = [F.lit(x) for item in (names or LANGUAGES).items() for x in item]
    return F.create_map(*pairs)[suffix(path)]
