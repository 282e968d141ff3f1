"""Correlations of all pairs against pandas, whatever the partitions; sampling and splitting over ranks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mergelens.operators import moments, stats


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_pairs(spark, parts):
    r = np.random.default_rng(3)
    x = pd.DataFrame({"a": r.normal(1e6, 1, 500), "b": r.normal(0, 1, 500), "c": 4.0, "e": np.nan})
    x["d"] = x.a * 2 + x.b * 0.1
    x.loc[r.random(500) < 0.3, "a"] = np.nan
    x.loc[3:, "f"] = np.nan
    x.loc[:2, "f"] = [1.0, 2.0, 4.0]
    names = ["a", "b", "c", "d", "e", "f"]
    want, n = x[names].corr(), x[names].notna().astype(int)
    rows = spark.createDataFrame(x[names].astype(object).where(x[names].notna(), None).values.tolist(), ", ".join(f"{c} double" for c in names)).repartition(parts)
    found = moments.correlations(rows, names).collect()
    assert [(p.first, p.second) for p in found] == [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for p in found:
        both = x[[p.first, p.second]].dropna()
        assert p.n == int((n[p.first] * n[p.second]).sum())
        if len(both) < 2 or both.nunique().min() < 2:
            assert p.correlation is None
        else:
            assert p.correlation == pytest.approx(both.corr().iloc[0, 1], abs=1e-9)
    assert moments.correlations(rows.limit(0), ["a", "b"]).first().n == 0


def test_split_falls_back_and_fills_exactly(spark):
    rows = spark.createDataFrame([(i, "r1" if i < 60 else "r2" if i < 98 else None, i % 3 == 0, "x") for i in range(100)], "k long, g string, y boolean, split string")
    found = stats.stratified_split(rows.drop("split"), "k", ["g", "y"], ["y"]).toPandas()  # the stratum without a group has two rows
    counts = found.groupby(["split", "y"]).size().unstack()
    assert found.split.value_counts().to_dict() == {"train": 69, "val": 15, "test": 16} and len(found) == 100  # 1 - 0.7 is a little above 0.3
    assert counts.loc["train"].to_dict() == {False: 46, True: 23}
    whole = stats.stratified_split(rows.drop("split").where("g is not null"), "k", ["g", "y"], ["y"]).toPandas()  # strata of 40, 20, 25 and 13 of 98
    assert whole[whole.split == "train"].groupby(["g", "y"]).size().to_dict() == {("r1", False): 28, ("r1", True): 14, ("r2", False): 17, ("r2", True): 9}
    assert stats.stratified_split(rows.drop("split").limit(0), "k", ["g"], ["y"]).count() == 0


def test_sample_of_any_size(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    some = [r.k for r in stats.uniform_sample(rows, "k", 300).collect()]
    assert len(set(some)) == 300 and set(some) >= {r.k for r in rows.orderBy(stats.draw("k"), "k").limit(300).collect()}


def test_matched_sample_borrows(spark):
    rows = spark.createDataFrame([(i, "a", 1 if i < 3 else 0, i % 2 == 0) for i in range(40)] + [(100 + i, "b", 1, True) for i in range(4)] + [(200 + i, "c", 1, i < 2) for i in range(36)], "k long, g string, y int, t boolean")
    found = stats.matched_sample(rows, "y", "g", "k", F.col("t")).toPandas()
    sizes = found.groupby(["g", "y"]).size().to_dict()
    assert sizes == {("a", 0): 7, ("a", 1): 3, ("b", 1): 4, ("c", 1): 10}  # 43 of 80 are 1: five of ten wanted
    assert found[(found.g == "c")].t.sum() == 2
