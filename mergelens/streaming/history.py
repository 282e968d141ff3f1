"""The review log as a stream: unseen keys only, in micro-batches that a checkpoint remembers, and the newest of it as a view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def unseen(events: DataFrame, key: str, time: str, wait: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, wait).dropDuplicatesWithinWatermark([key])


def run_once(spark: SparkSession, schema: StructType, source: str, sink: str, checkpoint: str, key: str, time: str, files: int = 10) -> None:
    """All that is new in source goes to sink, some files to a batch; a second call finds nothing to do."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    unseen(events, key, time).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def merge(batch: DataFrame, number: int, path: str, key: str, time: str) -> None:
    """One micro-batch into the history: of rows with one key the earliest, and only keys that no earlier batch has.

    A batch has a folder of its own that it overwrites, and looks at earlier batches only, so a batch that was stopped half-way and comes again
    leaves the same rows once. Keys that are null are left out."""
    spark = batch.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    rest = [c for c in batch.columns if c not in (key, time)]
    new = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(time, *rest)).alias("_x")).select(key, "_x.*").select(batch.columns)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        known = spark.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType())])).parquet(path).where(F.col("batch") < number)
        new = new.join(known.select(key), key, "left_anti")
    new.write.mode("overwrite").parquet(f"{path}/batch={number}")


def follow(events: DataFrame, path: str, checkpoint: str, key: str, time: str) -> StreamingQuery:
    """A stream into the history, each key once however often it comes and whenever the query is stopped; ends with what is there."""
    return events.writeStream.foreachBatch(lambda batch, number: merge(batch, number, path, key, time)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of the history."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path).drop("batch")


def newest(rows: DataFrame, time: str, key: str, n: int) -> DataFrame:
    """The view that is served: the n newest, ties by key, last first."""
    return rows.orderBy(F.desc(time), F.desc(key)).limit(n)
