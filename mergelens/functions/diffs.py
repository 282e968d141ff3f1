"""Table functions over unified diffs, as expressions on the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a line of diff metadata begins with.
META = r"^(---|\+\+\+|@@|diff |index |new file|deleted file|rename |similarity|Binary files|\\ No newline)"


def lines(diff) -> Column:
    return F.split(F.coalesce(diff, F.lit("")), "\n")


def added_lines(diff, drop_meta: bool = True) -> Column:
    found = F.transform(F.filter(lines(diff), lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substring(x, 2, 1 << 30))
    return F.filter(found, lambda x: ~x.rlike(META)) if drop_meta else found


def additions(diff) -> Column:
    return F.size(F.filter(lines(diff), lambda x: x.startswith("+") & ~x.startswith("+++"))).cast("long")


def deletions(diff) -> Column:
    return F.size(F.filter(lines(diff), lambda x: x.startswith("-") & ~x.startswith("---"))).cast("long")


def paths(diff) -> Column:
    return F.filter(F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+ b/(.+)$"), F.lit(1)), lambda p: p != "/dev/null")


def hunk_starts(diff) -> Column:
    return F.transform(F.regexp_extract_all(diff, F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def modified_functions(diff) -> Column:
    """Names before a bracket in hunk contexts and names defined in added lines, sorted and distinct."""
    context = F.regexp_extract_all(diff, F.lit(r"(?m)^@@ [^@]*@@.*?(\w+)\s*\("), F.lit(1))
    defined = F.regexp_extract_all(diff, F.lit(r"(?m)^\+\s*(?:async def|def|class|function|func|fn|pub fn|const|let|var)\s+(\w+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.concat(context, defined), lambda x: F.length(x) > 1)))


def added_simple(diff, most_lines: int = 200, most_chars: int = 6000) -> Column:
    """Added lines as they are, the first `most_lines`, cut to `most_chars` characters."""
    return F.substring(F.array_join(F.slice(added_lines(diff, False), 1, most_lines), "\n"), 1, most_chars)


def new_lines(diff, target) -> Column:
    """Where the hunks of one file begin in its new version; of several sections of that file those of the first."""
    sections = F.split(F.coalesce(diff, F.lit("")), r"(?m)^diff --git ")
    own = F.filter(sections, lambda s: F.regexp_extract(s, r"(?m)^\+\+\+ b/(.+)$", 1) == target)
    return F.when(F.size(own) > 0, hunk_starts(F.element_at(own, 1))).otherwise(F.array().cast("array<bigint>"))
