"""Scalar functions over texts, numbers and flags; every one is a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLE = "double"


def safe(c) -> Column:
    return F.coalesce(c, F.lit(""))


def escape_newlines(c, most: int) -> Column:
    """Line ends as the two characters backslash and n; longer texts cut, with three dots."""
    flat = F.regexp_replace(safe(c), "\r\n|\n|\r", "\\\\n")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def strip_controls(c, most: int) -> Column:
    """No control characters but tab and line ends, at most two line feeds in a row, trimmed, cut."""
    clean = F.regexp_replace(safe(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    few = F.regexp_replace(clean, r"\n{3,}", "\n\n")
    return F.substring(F.regexp_replace(few, r"^\s+|\s+$", ""), 1, most)


def truncate(c, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n... [truncated]"))).otherwise(c)


def words(c) -> Column:
    return F.filter(F.split(safe(c), r"\s+"), lambda t: t != "")


def word_count(c) -> Column:
    return F.size(words(c)).cast("long")


def lower_tokens(c) -> Column:
    return words(F.lower(c))


def has_issue_link(c) -> Column:
    return F.coalesce(c.rlike(r"(?i)(#\d+|issues?/\d+|pull/\d+|bugs?/\d+)"), F.lit(False)).cast("int")


def has_release_note(c) -> Column:
    return F.coalesce(c.rlike(r"(?i)release.?note|changelog|breaking.?change"), F.lit(False)).cast("int")


def is_blank(c) -> Column:
    return (F.trim(safe(c)) == "").cast("int")


def to_flag(c) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def to_count(c) -> Column:
    return F.greatest(F.coalesce(c.try_cast(DOUBLE), F.lit(0.0)), F.lit(0.0))


def id_text(c) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def tokens_estimate(c) -> Column:
    """Han characters, 1.3 for each Latin word, half of the other characters."""
    han = F.regexp_count(c, F.lit("[一-鿿]"))
    latin = F.regexp_count(c, F.lit("[a-zA-Z]+"))
    rest = F.length(c) - han - F.regexp_count(c, F.lit(r"[a-zA-Z\s]"))
    return (han + F.floor(latin * F.lit(1.3)) + F.floor(rest / 2)).cast("long")


def contains_any(c, needles: list[str], whole_word: bool = False) -> Column:
    """Case-insensitive test for any of the needles, as substrings or as words."""
    import re

    body = "|".join(re.escape(n) for n in needles)
    return F.coalesce(F.lower(c).rlike(rf"\b(?:{body})\b" if whole_word else body), F.lit(False))


def rule_band(score) -> Column:
    return F.when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low")


def probability_band(p) -> Column:
    return F.when(p < 0.3, "high").when(p < 0.6, "medium").otherwise("low")


def clamp(p) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def lenient_merged(c) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin("merged", "1", "true"), F.lit(False)).cast("int")


def strict_merged(c) -> Column:
    return F.coalesce(F.lower(c.cast("string")) == "merged", F.lit(False)).cast("int")


def ngrams(tokens, n: int) -> Column:
    size = F.size(tokens)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def link_relations(header) -> Column:
    """Addresses by relation of a Link header; of two with one relation the last. No header has none."""
    form = F.lit(r'<([^>]+)>;\s*rel="([^"]+)"')
    urls, names = (F.regexp_extract_all(F.coalesce(header, F.lit("")), form, F.lit(i)) for i in (1, 2))
    last = F.filter(F.arrays_zip(names.alias("k"), urls.alias("v")), lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names) + 1), x["k"]))
    return F.map_from_entries(last)
