"""Places, running sums and quantiles over one order of all rows, without a task that sees a whole group.

Rows are dealt by ranges of the order and sorted where they lie; a table keeps them with their place in their partition. What each
partition holds in all, one row for each, is summed up in order and carried into the next. A group that lies in many partitions is
ranked by all of their tasks, and where a group begins is the least that its rows carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergelens.storage import table

_INSIDE = (1 << 33) - 1


def _dealt(rows: DataFrame, order: list) -> DataFrame:
    """rows in the order, with the partition _part and the place in it _i."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = table(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    return kept.withColumns({"_part": F.shiftrightunsigned("_at", 33).cast("int"), "_i": F.col("_at").bitwiseAND(F.lit(_INSIDE))}).drop("_at")


def _carried(dealt: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """For each partition what all before it hold; as many rows as there are partitions."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return totals.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias(f"_c_{n}") for n in sums])


def positions(rows: DataFrame, order: list, name: str = "position") -> DataFrame:
    """rows with their place from 0 in an order that has no ties (of tied rows any may come first)."""
    dealt = _dealt(rows.drop(name), order)
    carried = _carried(dealt, {"n": F.lit(1)})
    return dealt.join(F.broadcast(carried), "_part").withColumn(name, F.col("_c_n") + F.col("_i")).drop("_part", "_i", "_c_n")


def running(rows: DataFrame, by: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """rows with, for each of sums (never negative whole numbers), before_<name>: the sum over the group's earlier rows, and all_<name>: over the
    group. Nulls in `by` are a group of their own."""
    values = {n: c.cast("long") for n, c in sums.items()}
    dealt = _dealt(rows.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in values.items()}), [*by, *order])
    inside = Window.partitionBy("_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(dealt, {n: F.col(f"_v_{n}") for n in sums})
    upto = dealt.join(F.broadcast(carried), "_part").withColumns({f"before_{n}": F.col(f"_c_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    upto = upto.drop("_part", "_i", *[f"_c_{n}" for n in sums])
    wholes = upto.groupBy(*by).agg(*[F.min(f"before_{n}").alias(f"_b_{n}") for n in sums], *[F.sum(f"_v_{n}").alias(f"all_{n}") for n in sums])
    wholes = wholes.withColumnsRenamed({c: f"_g_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    both = upto.join(wholes, same) if by else upto.crossJoin(F.broadcast(wholes))
    return both.withColumns({f"before_{n}": F.col(f"before_{n}") - F.col(f"_b_{n}") for n in sums}).drop(*[f"_g_{c}" for c in by], *[f"_{k}_{n}" for n in sums for k in "bv"])


def counted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, v, n of each distinct value that is no null, with before_n and all_n in ascending order: equal values are counted before anything is dealt out."""
    some = rows.select(*by, F.col(value).alias("v")).where("v is not null")
    return running(some.groupBy(*by, "v").agg(F.count("*").alias("n")), by, ["v"], {"n": F.col("n")})


def standing(place: Column) -> Column:
    """Aggregate over `counted`: the value at a place from 0."""
    return F.max(F.when((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n")), F.col("v")))


def quantiles(rows: DataFrame, columns: list[str], at: list[float], by: list[str] | None = None) -> DataFrame:
    """For each group, and each of columns as `feature`, an array `q` of exact quantiles with linear interpolation; nulls take no part.

    The running sums of the distinct values' counts tell which values stand at the two places around each quantile. A feature without values has no row."""
    by = by or []
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_x")).select(*by, "_x.*")

    def one(p):
        place = F.lit(p) * (F.col("all_n") - 1)
        return F.struct(standing(F.floor(place)).alias("a"), standing(F.ceil(place)).alias("b"), F.max(place - F.floor(place)).alias("share"))

    found = counted(long, [*by, "feature"], "v").groupBy(*by, "feature").agg(*[one(p).alias(f"_q{i}") for i, p in enumerate(at)])
    value = lambda i: F.col(f"_q{i}.a") + (F.col(f"_q{i}.b") - F.col(f"_q{i}.a")) * F.col(f"_q{i}.share")
    return found.select(*by, "feature", F.array(*[value(i) for i in range(len(at))]).alias("q"))


def bounds(rows: DataFrame, columns: list[str], at: float) -> DataFrame:
    """One row with the quantile of each column under its name; null for a column without values."""
    return quantiles(rows, columns, [at]).agg(*[F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(c) for c in columns])
