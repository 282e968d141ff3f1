"""Correlations of all pairs of columns in one pass: joint moments by task, merged as a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial results that one task merges.
FAN = 64


class Moments:
    """For each pair (i, j) over the rows in which both have a value: n, the mean of i and the sum of products of deviations.

    Partial results are merged by the pairwise update of means and co-moments, so no large sum is ever subtracted from another."""

    def __init__(self, m: int):
        self.n, self.mean, self.co, self.square = (np.zeros((m, m)) for _ in range(4))

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        """Of rows and columns; NaN stands for no value."""
        out = Moments(x.shape[1])
        there = ~np.isnan(x)
        mask = there.astype(float)
        shift = np.where(there, x, 0.0).sum(axis=0) / np.maximum(mask.sum(axis=0), 1)
        y = np.where(there, x - shift, 0.0)
        out.n = mask.T @ mask
        n = np.maximum(out.n, 1)
        sums = y.T @ mask  # of i where j is there
        out.mean = np.where(out.n > 0, sums / n + shift[:, None], 0.0)
        out.co = y.T @ y - sums * sums.T / n
        out.square = (y * y).T @ mask - sums * sums / n
        return out

    def add(self, other: Moments) -> Moments:
        n = self.n + other.n
        safe = np.maximum(n, 1)
        gap = other.mean - self.mean
        both = self.n * other.n / safe
        self.co += other.co + gap * gap.T * both
        self.square += other.square + gap * gap * both
        self.mean += gap * other.n / safe
        self.n = n
        return self

    def pack(self) -> bytes:
        return np.stack([self.n, self.mean, self.co, self.square]).tobytes()

    @staticmethod
    def unpack(data: bytes, m: int) -> Moments:
        out = Moments(m)
        out.n, out.mean, out.co, out.square = np.frombuffer(data).reshape(4, m, m).copy()
        return out

    def correlation(self) -> np.ndarray:
        """NaN where fewer than two rows have both or one of them is constant."""
        with np.errstate(divide="ignore", invalid="ignore"):
            found = self.co / np.sqrt(self.square * self.square.T)
        return np.where((self.n > 1) & (self.square > 0) & (self.square.T > 0), np.clip(found, -1, 1), np.nan)


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """first, second, n, correlation (Pearson) of each pair of columns, in the order given, over the rows that have both; nulls and NaN are no values.

    The correlation is null with fewer than two rows or a constant column. A task gives out one matrix, `FAN` of them are merged by a task, and so on."""
    m, empty = len(columns), pa.schema([("slot", pa.int64()), ("moments", pa.binary())])

    def partial(batches):
        from pyspark import TaskContext

        total = Moments(m)
        for batch in batches:
            if batch.num_rows:
                total.add(Moments.of(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.pack()], pa.binary())], schema=empty)

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments(m)
        for batch in batches:
            for data in batch.column("moments"):
                total.add(Moments.unpack(data.as_py(), m))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.pack()], pa.binary())], schema=empty)

    found = rows.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(partial, "slot long, moments binary")
    found = found.unionByName(rows.sparkSession.createDataFrame([(0, Moments(m).pack())], "slot long, moments binary"))  # an empty table has pairs too
    tasks = rows.rdd.getNumPartitions() + 1
    while tasks > 1:
        found = found.withColumn("slot", F.floor(F.col("slot") / FAN).cast("long")).groupBy("slot").applyInArrow(merged, "slot long, moments binary")
        tasks = -(-tasks // FAN)

    def pairs(batches):
        for batch in batches:
            for data in batch.column("moments"):
                total = Moments.unpack(data.as_py(), m)
                value = total.correlation()
                at = [(i, j) for i in range(m) for j in range(i + 1, m)]
                yield pa.RecordBatch.from_pydict({"first": pa.array([columns[i] for i, _ in at], pa.string()), "second": pa.array([columns[j] for _, j in at], pa.string()), "n": pa.array([int(total.n[p]) for p in at], pa.int64()), "correlation": pa.array([None if np.isnan(value[p]) else float(value[p]) for p in at], pa.float64())})

    return found.mapInArrow(pairs, "first string, second string, n long, correlation double")
