"""Signs of generated code and of automatic reviewers, by key words in the texts of a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key words.
REVIEWER = [
    "ai", "copilot", "claude", "chatgpt", "codex", "gpt", "llm",
    "artificial intelligence", "copilot:summary", "ai-reviewed",
    "ai review", "automated review", "bot review", "ai-assisted",
]
GENERATED = [
    "ai-generated", "generated by ai", "copilot", "codex",
    "chatgpt", "gpt-", "llm-generated", "ai generated",
    "generated by copilot", "generated by chatgpt",
    "ai-assisted code", "generated by llm",
]
STRONG = [
    "copilot", "github copilot", "chatgpt", "gpt", "claude", "cursor", "codex", "code agent", "ai-generated", "generated by ai",
    "generated with", "co-authored-by: copilot", "openai", "deepseek", "qwen",
]
BESIDE_AI = ["generated", "agent", "copilot", "llm", "assisted", "powered"]
QUICK = ["copilot", "chatgpt", "gpt", "claude", "cursor", "codex", "ai-generated", "ai generated", "generated by", "openai", "deepseek", "qwen", "code agent", "co-authored-by"]
FIELDS = ["title", "body", "commit_messages", "label_names", "author", "review_comments_text"]


def words(some: list[str]) -> Column:
    return F.array(*map(F.lit, some))


def holds_any(text, some: list[str]) -> Column:
    """Whether any of the words is in the text, upper or lower case; not in a null text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(words(some), lambda w: low.contains(w))


def reviewer(bodies, labels) -> Column:
    """Of arrays of comments and labels."""
    either = F.concat(F.coalesce(bodies, F.array().cast("array<string>")), F.coalesce(labels, F.array().cast("array<string>")))
    return F.exists(either, lambda x: holds_any(x, REVIEWER))


def generated(body, labels) -> Column:
    return holds_any(body, GENERATED) | F.exists(F.coalesce(labels, F.array().cast("array<string>")), lambda x: holds_any(x, GENERATED))


def quick(title, body, labels) -> Column:
    """A cheap filter for lists: one search over title, body and labels together."""
    whole = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")), F.array_join(labels, " "))
    return holds_any(whole, QUICK) | (holds_any(whole, ["ai"]) & holds_any(whole, BESIDE_AI))


def detection(fields: dict[str, Column]) -> Column:
    """struct of found and reason: each strong word in each field; only without any, fields with "ai" and a word that goes with it."""
    some = {k: F.lower(F.trim(F.coalesce(c, F.lit("")))) for k, c in fields.items()}

    def hits(name, x):
        return F.transform(F.filter(words(STRONG), lambda w: x.contains(w)), lambda w: F.concat(F.lit(f'{name} contains "'), w, F.lit('"')))

    def hint(name, x):
        return F.when(x.contains("ai") & F.exists(words(BESIDE_AI), lambda w: x.contains(w)), f'{name} contains "ai" with context words')

    strong = F.concat(*[hits(k, x) for k, x in some.items()])
    weak = F.array_compact(F.array(*[hint(k, x) for k, x in some.items()]))
    reasons = F.when(F.size(strong) > 0, strong).otherwise(weak)
    return F.struct((F.size(reasons) > 0).alias("found"), F.array_join(reasons, "; ").alias("reason"))


def detection_stats(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """Hits by kind (field or keyword) and name over all reasons."""
    parts = rows.select(F.explode(F.filter(F.split(reason, "; "), lambda x: x != "")).alias("x")).select(F.regexp_extract("x", r"^(\S+) contains", 1).alias("field"), F.regexp_extract("x", '"([^"]*)"', 1).alias("keyword"))
    return parts.select(F.explode(F.array(F.struct(F.lit("field").alias("kind"), F.col("field").alias("name")), F.struct(F.lit("keyword").alias("kind"), F.col("keyword").alias("name")))).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
