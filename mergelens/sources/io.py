"""Readers and sinks: JSON bundles, CSV with quoted line ends, JSON lines with bad lines aside, guarded text files, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Header, quoted fields with line ends; a byte order mark before the header belongs to no name. Columns are taken by the header's
    names, in any order; one that is missing is null. Without a schema the types are inferred."""
    read = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    if schema is None:
        return read.option("inferSchema", True).csv(path)
    found = read.csv(path)
    names = {c.lstrip("﻿"): c for c in found.columns}
    return found.select(*[(F.col(f"`{names[f.name]}`").try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def csv_text(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """All columns as text; no rows where the file is missing."""
    schema = StructType([StructField(n, StringType()) for n in names])
    return csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, path: str, schema: StructType, bad: bool = False) -> DataFrame:
    """The lines that parse, or with bad the text of the others."""
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", StructType([*schema.fields]).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return rows.where("x._bad is not null").select("value") if bad else rows.where("x._bad is null").select(*[F.col("x")[f.name].alias(f.name) for f in schema.fields])


def text_files(spark: SparkSession, path: str, most: int = 100_000) -> DataFrame:
    """path, text cut to most characters, and an error where the file is too large, binary, not UTF-8 or blank. Spark lists no empty files."""
    rows = spark.read.format("binaryFile").load(path)
    body = F.try_validate_utf8(F.col("content").cast("string"))
    binary = F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, 1024)), "(..)", "$1 ")) > 0
    error = F.when(F.col("length") > 2 * most, "too large").when(binary, "binary").when(body.isNull(), "not UTF-8").when(F.trim(body) == "", "blank")
    return rows.select("path", error.alias("error"), F.when(error.isNull(), F.substring(body, 1, most)).alias("text"))


def append_history(rows: DataFrame, path: str) -> None:
    """A batch of records as new files, which Spark commits whole or not at all, so writers need no lock."""
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Header, text quoted where it must be, and a byte order mark at the start of each file's header."""
    first, *rest = rows.columns
    rows.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str, indent: int | None = None) -> None:
    """Compact lines in many files; with an indent each row is one indented text, for small results."""
    if indent is None:
        rows.write.mode("overwrite").json(path)
        return
    shaped = F.pandas_udf(lambda s: s.map(lambda x: json.dumps(json.loads(x), ensure_ascii=False, indent=indent)), "string")
    rows.select(shaped(F.to_json(F.struct(*rows.columns))).alias("value")).write.mode("overwrite").text(path)


def report(title: str, tables: dict[str, DataFrame], most: int = 200, markdown: bool = True) -> str:
    """A text of small tables, at most `most` rows of each, as Markdown or in columns."""
    out = [f"# {title}" if markdown else title, ""]
    for name, table in tables.items():
        rows = [tuple("" if v is None else str(v) for v in r) for r in table.limit(most).collect()]
        out.append(f"## {name}" if markdown else f"{name}\n" + "-" * len(name))
        if markdown:
            out += ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns), *("| " + " | ".join(r) + " |" for r in rows)]
        else:
            wide = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(table.columns)]
            out += ["  ".join(v.ljust(w) for v, w in zip(line, wide, strict=True)).rstrip() for line in (table.columns, *rows)]
        out.append("")
    return "\n".join(out)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where a few files would keep most of them idle, as a file is split by its row groups at best; many files are left as they lie, so
    nothing large is shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
