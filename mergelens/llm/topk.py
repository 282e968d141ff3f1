"""Exact top-k by integer inner product with multi-resolution segment statistics.

Of each vector, cut into 1, 2, 4, ... segments down to pairs of components, the means and deviations are kept. For one segment of length m,
|q - c|^2 >= m ((mean_q - mean_c)^2 + (dev_q - dev_c)^2), and since <q, c> = (|q|^2 + |c|^2 - |q - c|^2) / 2, the sum over
segments bounds every score from above, finer segments more closely. Queries come in blocks of a fixed size, each broadcast (its
size is bounded: `block` vectors) and held against all rows where they lie. In a task, a query's threshold is its k-th best
score so far; in the first batch the candidates with the best coarse bounds set it, later batches go on from it. Others survive
a level only if their bound reaches it, coarse to fine; survivors get exact scores.
A task sends on its k best of each query, and these meet in two steps, first by a salt, then by query.

Rows with null ids or vectors, or null or non-finite components, take no part. Only vectors of equal length are compared. A
query is a distinct (id, vector); candidates are the rows with another id, a repeated row counts as often as it is there.
Scores beyond 64 bits are cut to the range of long. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, read, table

FOUND = "query_id long, vec_id long, score long, vector_key int"


def statistics(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """At each level: segment lengths, means times root length, deviations times root length."""
    out, d, parts = [], x.shape[1], 1
    while parts <= max(1, d // 2):
        cut = np.linspace(0, d, parts + 1).astype(int)[:-1]
        m = np.diff(np.append(cut, d)).astype(float)
        mean = np.add.reduceat(x, cut, axis=1) / m
        var = np.maximum(np.add.reduceat(x * x, cut, axis=1) / m - mean * mean, 0)
        out.append((m, mean * np.sqrt(m), np.sqrt(var * m)))
        parts *= 2
    return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole-number doubles as 64-bit integers."""
    top = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[-1], 1)
    if top < 2**53:
        return (c @ q).astype(np.int64)
    a, b = [int(v) for v in q], [[int(v) for v in row] for row in c]
    low, high = -(2**63), 2**63 - 1
    return np.array([min(high, max(low, sum(i * j for i, j in zip(a, row, strict=True)))) for row in b], np.int64)


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, floors: np.ndarray | None = None, seen: np.ndarray | None = None):
    """(query's place, row's place, score) of the k best rows for each query among these rows, but for those known to be below a query's
    floor. seen: gets the number of rows that each level looked at, and last that of exact scores."""
    if not rows.shape[1]:
        rows, queries = np.zeros((len(rows), 1)), np.zeros((len(queries), 1))
    q_levels, c_levels = statistics(queries), statistics(rows)
    q_norm, c_norm = (queries * queries).sum(axis=1), (rows * rows).sum(axis=1)
    slack = 1e-9 * (1 + np.abs(q_norm).max() + np.abs(c_norm).max())
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    for i in range(len(queries)):
        may = np.flatnonzero(row_ids != query_ids[i])
        best = float(floors[i])
        for level, ((_, qm, qd), (_, cm, cd)) in enumerate(zip(q_levels, c_levels, strict=True)):
            if not len(may):
                break
            if seen is not None:
                seen[level] += len(may)
            bound = cm[may] @ qm[i] + cd[may] @ qd[i]
            if not level and len(may) > 4 * k and best == -np.inf:
                take = may[np.argpartition(-bound, 4 * k)[: 4 * k]]
                best = float(np.sort(exact(queries[i], rows[take]))[::-1][k - 1])
            may = may[bound >= best - slack]
        if not len(may):
            continue
        if seen is not None:
            seen[-1] += len(may)
        scores = exact(queries[i], rows[may])
        order = np.lexsort((row_ids[may], ~scores))[:k]
        for j in order:
            yield i, may[j], int(scores[j])


def top_k(vectors: DataFrame, is_query, k: int = 10, block: int = 4096) -> DataFrame:
    """vectors: vec_id, v (array<double>, finite whole numbers). query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    asked = table(vectors.where(is_query).distinct(), "queries")
    sizes = asked.groupBy(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)).alias("slot")).count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    blocks = max(1, -(-total // max(1, block // 2)))
    found = None
    for b in range(blocks):
        here = [(r["vec_id"], r["v"]) for r in asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).orderBy("vec_id", "v").collect()]
        by_length: dict[int, list] = {}
        for key, (i, v) in enumerate(here):
            by_length.setdefault(len(v), []).append((key, i, v))
        packed = {d: (np.array([x[0] for x in q]), np.array([x[1] for x in q], np.int64), np.array([x[2] for x in q], float).reshape(len(q), d)) for d, q in by_length.items()}
        sent = spark.sparkContext.broadcast(packed)

        def run(batches, sent=sent):
            from pyspark import TaskContext

            keep: dict[int, list] = {}
            floors = {d: np.full(len(q[0]), -np.inf) for d, q in sent.value.items()}
            task = TaskContext.get().partitionId()
            for batch in batches:
                ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                lengths = np.asarray(lists.value_lengths())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                starts = np.append(0, np.cumsum(lengths))
                for d, (keys, query_ids, queries) in sent.value.items():
                    mine = np.flatnonzero(lengths == d)
                    if not len(mine):
                        continue
                    rows = flat[(starts[mine][:, None] + np.arange(d)[None, :])].astype(float)
                    for i, j, score in search(queries, query_ids, rows, ids[mine], k, floors[d]):
                        keep.setdefault(int(keys[i]), []).append((-score, int(ids[mine][j]), int(query_ids[i])))
                for some in keep.values():
                    some.sort()
                    del some[k:]
                for d, (keys, *_) in sent.value.items():
                    floors[d] = np.array([-keep[key][-1][0] if len(keep.get(key, ())) == k else -np.inf for key in keys.tolist()], float)
            rows = [(q, v, -s, key, task) for key, some in keep.items() for s, v, q in some]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["query_id", "vec_id", "score", "vector_key", "task"])

        part = vectors.transform(mapped, run, FOUND + ", task int").withColumn("block", F.lit(b))
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc("vec_id")]
    query = ["query_id", "vector_key", "block"]
    salted = found.withColumn("salt", F.col("task") % 16).withColumn("r", F.row_number().over(Window.partitionBy(*query, "salt").orderBy(*order))).where(F.col("r") <= k)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def whole_numbers(vectors: DataFrame, factor: int = 1024) -> DataFrame:
    """vec_id, v: each component x as floor(factor * x); rows that cannot take part are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf")))
    return vectors.where(fine).select(F.col("vec_id").cast("long"), F.transform(x, lambda a: F.floor(a * float(factor)).cast("double")).alias("v"))


def op2_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(whole_numbers(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
