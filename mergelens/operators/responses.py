"""Model responses that should be JSON: a ladder of repairs, then fields with defaults."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text) -> Column:
    """Direct, then a fenced block, the outermost braces, those without trailing commas, and all from the first brace on with what is open closed; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    repaired = F.regexp_replace(braces, r",\s*([}\]])", "$1")
    whole = F.coalesce(*(F.try_parse_json(F.nullif(t, F.lit(""))) for t in (text, fenced, braces, repaired)))
    rest = F.nullif(F.regexp_extract(text, r"(?s)(\{.*)", 1), F.lit(""))
    closed = F.pandas_udf(_close_all, "string")(F.when(whole.isNull(), rest))
    return F.coalesce(whole, F.try_parse_json(closed), F.try_parse_json(F.regexp_replace(closed, r",\s*([}\]])", "$1")))


def close_truncated(text: str) -> str:
    """A cut-off JSON text with its open string and brackets closed."""
    stack, inside, escaped = [], False, False
    for c in text:
        if inside:
            escaped, inside = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    return text + '"' * inside + "".join(reversed(stack))


def _close_all(texts: pd.Series) -> pd.Series:
    return texts.map(close_truncated, na_action="ignore")
