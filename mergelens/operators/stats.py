"""Descriptive statistics, top lists and leave-one-out shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergelens.operators import ranks
from mergelens.storage import table


def share(flag) -> F.Column:
    return F.round(100 * F.avg(flag.cast("double")), 4)


def distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: mean, quartiles (linear interpolation), sample deviation, extremes. Quartiles are selected by running counts, so no
    task holds all values of a column; a column without values has null quartiles."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    found = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    found = found.join(F.broadcast(ranks.quantiles(rows, columns, [0.25, 0.5, 0.75])), "feature", "left")  # a row for each column
    r = lambda c: F.round(c, 4)
    return found.select("feature", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), "min", "max", r(F.col("q")[0]).alias("q25"), r(F.col("q")[1]).alias("median"), r(F.col("q")[2]).alias("q75"))


def top_with_rest(rows: DataFrame, column: str, n: int, other: str = "Other") -> DataFrame:
    """The n commonest values, and the sum of all others."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), column).limit(n)
    total, kept = counts.agg(F.sum("n").alias("total")), top.agg(F.sum("n").alias("kept"))
    rest = total.crossJoin(kept).select(F.lit(other).alias(column), (F.col("total") - F.col("kept")).alias("n"))
    return top.unionByName(rest)


def leave_one_out(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Each row's group without the row itself: how many, and their mean. One window over the grouped sums, no self-join."""
    sums = rows.groupBy(group).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    n = F.col("_n") - 1
    return rows.join(sums, group).select(*rows.columns, n.alias("others"), F.round(F.try_divide((F.col("_s") - F.col(value)).cast("double"), n.cast("double")), 6).alias("others_mean"))


def per_group_cap(rows: DataFrame, group: str, cap: int, *order) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")


def quota_picks(rows: DataFrame, label: str, group: str, key: str, size: int, cap: int = 15) -> DataFrame:
    """`size` rows of each label, dealt over its groups: an equal quota each (1 at least, `cap` at most), and what is still missing
    from the groups with most rows left. Quotas come from one row per label and group; rows without either are not drawn."""
    known = rows.where(F.col(label).isNotNull() & F.col(group).isNotNull())
    of, before = Window.partitionBy(label), Window.partitionBy(label).orderBy(F.desc("_left"), group).rowsBetween(Window.unboundedPreceding, -1)
    quotas = known.groupBy(label, group).agg(F.count("*").alias("_n"))
    quotas = quotas.withColumn("_q", F.greatest(F.lit(1), F.least(F.floor(F.lit(size) / F.count("*").over(of)), F.col("_n"), F.lit(cap)))).withColumn("_left", F.col("_n") - F.col("_q"))
    missing = F.greatest(F.lit(size) - F.sum("_q").over(of), F.lit(0)) - F.coalesce(F.sum("_left").over(before), F.lit(0))
    quotas = quotas.select(label, group, (F.col("_q") + F.greatest(F.lit(0), F.least("_left", missing))).alias("_take"))
    ranked = known.withColumn("_r", F.row_number().over(Window.partitionBy(label, group).orderBy(draw(key), key))).where(F.col("_r") <= size)
    picked = ranked.join(quotas, [label, group]).where("_r <= _take")
    return per_group_cap(picked, label, size, draw(key), key).select(*rows.columns)


def preferred_picks(rows: DataFrame, label: str, group: str, key: str, prefer: F.Column, size: int) -> DataFrame:
    """`size` rows of each label: an equal quota of each group, up to two thirds of it preferred rows, topped up from all other rows.

    Keys must be unique. The top-up needs no more than the label's first 2 * size rows in drawn order, so no window holds a whole label."""
    known = rows.where(F.col(label).isNotNull() & F.col(group).isNotNull()).withColumn("_p", F.coalesce(prefer, F.lit(False)))
    of = Window.partitionBy(label)
    quotas = known.groupBy(label, group).agg(F.count("*").alias("_n"), F.count_if("_p").alias("_w"))
    quotas = quotas.withColumns({"_groups": F.count("*").over(of), "_at": F.row_number().over(of.orderBy(group))}).where(F.col("_at") <= size)
    quotas = quotas.withColumn("_take", F.least(F.greatest(F.lit(1), F.floor(F.lit(size) / F.col("_groups"))), F.col("_n")))
    quotas = quotas.withColumn("_with", F.least(F.col("_w"), F.greatest(F.lit(1), F.floor(F.col("_take") * 2 / 3)))).select(label, group, "_take", "_with")
    ranked = known.withColumn("_r", F.row_number().over(Window.partitionBy(label, group, "_p").orderBy(draw(key), key))).where(F.col("_r") <= size)
    first = ranked.join(quotas, [label, group]).where(F.col("_r") <= F.when(F.col("_p"), F.col("_with")).otherwise(F.col("_take") - F.col("_with"))).select(*rows.columns)
    others = per_group_cap(known, label, 2 * size, draw(key), key).select(*rows.columns).join(first.select(key), key, "left_anti")
    both = first.withColumn("_tier", F.lit(0)).unionByName(others.withColumn("_tier", F.lit(1)))
    return per_group_cap(both, label, size, "_tier", draw(key), key).select(*rows.columns)


def draw(key: str, seed: int = 42) -> F.Column:
    """A row's place in a seeded shuffle that every engine computes alike."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def uniform_sample(rows: DataFrame, key: str, n: int | Column, seed: int = 42) -> DataFrame:
    """The first n rows in drawn order, of any number: all tasks rank their range of the draws. Keys must be unique."""
    return ranks.positions(rows, [draw(key, seed), key], "_place").where(F.col("_place") < n).drop("_place")


def apportion(strata: DataFrame, names: list[str], count: str, total: Column) -> DataFrame:
    """strata with `take`, their shares of total (a column that is the same in all rows) in proportion to count: whole parts first, what is left by the largest remainders, ties by names."""
    whole = strata.crossJoin(F.broadcast(strata.agg(F.sum(count).alias("_all")))).withColumn("_exact", total * F.col(count) / F.col("_all").cast("double"))
    whole = whole.withColumns({"_low": F.floor("_exact").cast("long")}).withColumn("_part", F.round(F.col("_exact") - F.col("_low"), 9))
    missing = whole.agg((F.max(total) - F.sum("_low")).alias("_missing"))
    placed = ranks.positions(whole, [F.desc("_part"), *names], "_place")
    return placed.crossJoin(F.broadcast(missing)).withColumn("take", F.col("_low") + (F.col("_place") < F.col("_missing")).cast("long")).drop("_all", "_exact", "_low", "_part", "_place", "_missing")


def _cut(rows: DataFrame, key: str, fine: list[str], coarse: list[str], share: float) -> DataFrame:
    """rows with _first, true for all but ceil(share of them), dealt over the strata of `fine`, or of `coarse` if one of those has fewer than 3 rows."""
    few = rows.groupBy(*fine).agg(F.count("*").alias("n")).agg((F.min("n") < 3).alias("_few"))
    label = lambda names: F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    keyed = rows.crossJoin(F.broadcast(few)).withColumn("_s", F.when(F.col("_few"), label(coarse)).otherwise(label(fine))).drop("_few")
    strata = keyed.groupBy("_s").agg(F.count("*").alias("_n"))
    total = strata.agg(F.sum("_n").alias("_of"))
    kept = apportion(strata.crossJoin(F.broadcast(total)), ["_s"], "_n", F.col("_of") - F.ceil(F.lit(share) * F.col("_of"))).select(F.col("_s").alias("_t"), "take")
    ranked = ranks.running(keyed, ["_s"], [draw(key), key], {"one": F.lit(1)})
    return ranked.join(kept, F.col("_s") == F.col("_t")).withColumn("_first", F.col("before_one") < F.col("take")).drop("_s", "_t", "take", "before_one", "all_one", "_of")


def stratified_split(rows: DataFrame, key: str, strata: list[str], coarse: list[str], train: float = 0.7, val: float = 0.15) -> DataFrame:
    """rows with `split`, in two stages: train against the rest, then val against test. Each stage is stratified by `strata`, or by `coarse` alone if a stratum has
    fewer than 3 rows; each stratum gets its share by the largest remainder, and its first rows in drawn order. No task ranks a whole stratum. Keys must be unique."""
    staged = table(_cut(rows, key, strata, coarse, 1 - train).withColumnRenamed("_first", "_train"), "staged")
    rest = _cut(staged.where(~F.col("_train")), key, strata, coarse, (1 - train - val) / (1 - train))
    return staged.where("_train").withColumn("split", F.lit("train")).unionByName(rest.withColumn("split", F.when(F.col("_first"), "val").otherwise("test")).drop("_first")).drop("_train")


def split_summary(rows: DataFrame, group: str, label: str, split: str = "split") -> DataFrame:
    """Each split, and each group in it (null: the whole split): rows, merged, unmerged, merge rate to 4 digits."""
    found = rows.groupBy(split, group).agg(F.count("*").alias("n"), F.sum(label).alias("merged"))
    both = found.unionByName(found.groupBy(split).agg(F.sum("n").alias("n"), F.sum("merged").alias("merged")).withColumn(group, F.lit(None).cast("string")))
    return both.select(split, group, "n", "merged", (F.col("n") - F.col("merged")).alias("unmerged"), F.round(F.try_divide(F.col("merged").cast("double"), F.col("n").cast("double")), 4).alias("rate"))


def sample_summary(rows: DataFrame, group: str, label: str, reviewed: Column, size: str) -> DataFrame:
    """A sample as a whole (null group) and by group: rows, merged, with a review, mean size to 4 digits."""
    found = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(label).alias("merged"), F.count_if(reviewed).alias("reviewed"), F.sum(size).alias("_size"), F.count(size).alias("_sized"))
    sums = ["n", "merged", "reviewed", "_size", "_sized"]
    whole = found.agg(*[F.sum(c).alias(c) for c in sums]).withColumn(group, F.lit(None).cast("string"))
    return found.unionByName(whole).select(group, "n", "merged", "reviewed", F.round(F.try_divide(F.col("_size").cast("double"), F.col("_sized").cast("double")), 4).alias("mean_length"))


def matched_sample(rows: DataFrame, label: str, group: str, key: str, prefer: Column, size: int = 10) -> DataFrame:
    """`size` rows of each group (all, if it has fewer), of both labels as near to the share of label 1 in all rows as the group allows; a class that
    lacks rows borrows its places to the other. Preferred rows come first within a class, so no redraw could bring more of them."""
    known = rows.where(F.col(label).isNotNull() & F.col(group).isNotNull()).withColumn("_p", F.coalesce(prefer, F.lit(False)))
    rate = known.agg(F.avg(F.col(label).cast("double")).alias("_rate"))
    counts = known.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("_yes"), F.count_if(F.col(label) == 0).alias("_no")).crossJoin(F.broadcast(rate))
    want = F.bround(F.lit(float(size)) * F.col("_rate"), 0).cast("long")
    counts = counts.withColumns({"_y": F.least(want, "_yes"), "_n": F.least(F.lit(size) - want, "_no")})
    more = F.least(F.lit(size) - F.col("_y") - F.col("_n"), F.col("_yes") - F.col("_y"))
    counts = counts.withColumn("_y", F.col("_y") + more).withColumn("_n", F.least(F.lit(size) - F.col("_y"), "_no"))
    ranked = known.withColumn("_r", F.row_number().over(Window.partitionBy(group, label).orderBy(F.desc("_p"), draw(key), key))).where(F.col("_r") <= size)
    return ranked.join(counts, group).where(F.col("_r") <= F.when(F.col(label) == 1, F.col("_y")).otherwise(F.col("_n"))).select(*rows.columns)


def first_by(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order: de-duplication where the first wins."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
