"""A corpus from documents to packed sequences: five stages, each over all that the one before kept.

Every stage but the last returns rows with the columns of documents. A null or empty text has no letters and ends in
the first stage. Columns beside those of documents are dropped. Each row is judged by its own text: of rows that share a doc_id, or have none, a
stage rejects only those that it finds wanting, as they are numbered for it. Equal rows are near-duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.llm import language as language_id
from mergelens.llm import near, packing, quality, repeats
from mergelens.llm.common import read, table
from mergelens.llm.encoder import read_spec
from mergelens.operators import ranks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(docs: DataFrame) -> DataFrame:
    """docs with doc_ids that no two rows share, and the ones they had as _own: rows whose id is missing or not theirs alone get the next free numbers, in the
    order of their ids and texts."""
    rows = docs.select(*COLUMNS, F.col("doc_id").alias("_own"))
    again = table(rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_again")), "repeated")
    if again.isEmpty():
        return rows
    shared = F.col("doc_id").eqNullSafe(F.col("_again"))
    free = rows.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("_free"))
    placed = ranks.positions(rows.join(again, shared, "left_semi"), [F.asc_nulls_last("doc_id"), F.xxhash64("text"), "text"], "_place")
    new = placed.crossJoin(F.broadcast(free)).withColumn("doc_id", F.col("_free") + 1 + F.col("_place")).select(rows.columns)
    return rows.join(again, shared, "left_anti").unionByName(new)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """numbered docs but for those ids, under their own ids again."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("doc_id", F.col("_own")).select(*COLUMNS)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told."""
    rows = numbered(docs)
    found = language_id.identify_documents(rows)
    return without(rows, found.where(~F.col("accepted"))).where(F.col("text") != "")


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sufficient quality."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest number."""
    rows = numbered(docs)
    return without(rows, near.classes(rows).where(F.col("doc_id") != F.col("class_id")))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    left = repeats.remove(docs, keep=("lang", "source"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, read_spec(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", identify),
    ("quality", grade),
    ("near_duplicates", deduplicate),
    ("repeats", cut_repeats),
    ("packing", pack),
]
#: SQL can express none of compression, tokens or suffix order; tests/llm/test_pipeline.py holds the rows and texts of every stage, and the
#: packed pieces of run(), against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
