"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, as in tests, a local folder, but never on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="mergelens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps no longer depend on how it was made."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def release(*tables: DataFrame) -> None:
    """Deletes what `table` wrote for these frames, once nothing reads them any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_written", None)
        if path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
