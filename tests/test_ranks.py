"""Ranks, running sums and quantiles against pandas, with nulls, ties and a group that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from mergelens.operators import ranks


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    data = [(i, r.choice(["a", "a", "a", "a", "b", None]), r.choice([None, 1.0, 2.5, r.random()]), r.randint(0, 4), "extra") for i in range(3000)]
    return spark.createDataFrame(data, "id long, g string, x double, n int, position string").repartition(7)


def test_positions(rows):
    found = ranks.positions(rows, [F.desc("id")]).collect()
    assert sorted((r.position, r.id) for r in found) == [(i, 2999 - i) for i in range(3000)]


def test_running_restarts_with_each_group(rows):
    found = ranks.running(rows, ["g"], ["id"], {"n": F.col("n"), "one": F.lit(1)}).toPandas()
    for g, part in found.groupby("g", dropna=False):
        part = part.sort_values("id")
        assert (part.before_n == part.n.cumsum() - part.n).all() and (part.before_one == range(len(part))).all(), g
        assert (part.all_n == part.n.sum()).all() and (part.all_one == len(part)).all()
    assert len(found) == 3000


def test_quantiles(rows):
    at = [0.0, 0.25, 0.5, 0.99, 1.0]
    whole = rows.toPandas()
    for r in ranks.quantiles(rows, ["x", "n"], at, ["g"]).collect():
        part = whole[whole.g.isna()] if r.g is None else whole[whole.g == r.g]
        assert r.q == pytest.approx([part[r.feature].quantile(p) for p in at])
    assert {r.feature: r.q for r in ranks.quantiles(rows, ["x"], at).collect()}["x"] == pytest.approx([whole.x.quantile(p) for p in at])


def test_empty(rows):
    none = rows.limit(0)
    assert ranks.positions(none, ["id"]).count() == 0
    assert ranks.running(none, ["g"], ["id"], {"n": F.col("n")}).count() == 0
    assert ranks.quantiles(none, ["x"], [0.5]).count() == 0
