"""What the operators share: tables in the shared folder, Arrow slices, hashes and memos."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mergelens import storage

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def table(df: DataFrame, name: str, large: bool = False, narrow: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps no longer depend on how it was made. After a large one the driver
    collects its garbage, with which Spark deletes the shuffle files of what is done. Narrow rows, few bytes from many tasks,
    are gathered into files of a fair size."""
    spark = df.sparkSession
    if narrow:
        df = df.hint("rebalance")
    found = storage.table(df, name)
    for pause in (0.3, 0.2) if large else ():  # the first collection leaves what the last events still held
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
    return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that a string column holds about `most` bytes in each (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = string_sizes(batch.column(column))
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            to = max(at + 1, min(n, to))
            yield batch.slice(at, to - at)
            at = to


def string_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each text begins, with the end as last."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), np.uint8), starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Memo(dict):
    """What a pure function gave for short keys. Of two halves the older is dropped when the younger is full, so memory is
    bounded and what is asked for often stays."""

    def __init__(self, fn: Callable, cap: int = 400_000, longest: int = 48):
        super().__init__()
        self.fn, self.half, self.longest, self.older = fn, cap // 2, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_KEPT: dict = {}


def kept(key, make: Callable):
    """One object for each key in a Python worker, so tasks that share the worker share it; only the last few are held."""
    if key not in _KEPT:
        while len(_KEPT) >= 2:
            del _KEPT[next(iter(_KEPT))]
        _KEPT[key] = make()
    return _KEPT[key]


ROWS = 1024


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow with batches of at most ROWS rows, so that neither side holds ten thousand long texts at once; a reused worker
    hands free memory back to the system before and after."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, str(ROWS))

    def tidy(batches):
        release()
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def widen(df: DataFrame, **columns: str):
    """df's schema with more columns; the names of df must be unique, and the new ones new."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    return StructType([*df.schema.fields, *(StructField(k, _parse_datatype_string(v)) for k, v in columns.items())])
