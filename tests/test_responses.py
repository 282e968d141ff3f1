"""The last step of the ladder: answers cut off by a length limit."""

import json

import pytest
from pyspark.sql import functions as F

from mergelens.operators import responses
from mergelens.plans import catalog

CASES = [
    ('{"a": 1', 1), ('so: {"a": 2, "b": ["x", "cut o', 2), ('```json\n{"a": 3, "b": {"c": 1}', 3), ('{"a": 4, ', 4), ('{"a": 5}', 5), ('so: {"a": 6,} end', 6), ("none", None), ("", None), (None, None), ('{"a', None),
]


def test_truncated_answers_parse(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.a for r in rows.select("i", F.try_variant_get(responses.parse(F.col("t")), "$.a", "long").alias("a")).collect()}
    assert got == {i: a for i, (_, a) in enumerate(CASES)}


def test_query_holds_truncated_bodies(spark):
    d = "/root/testdata/sf0.001"
    cut = {r.event_id: r.user_id for r in catalog.answers(spark, d).where("event_id % 8 = 4").collect()}
    for r in catalog.answers(spark, d).where("event_id % 8 = 4").limit(5).collect():
        with pytest.raises(json.JSONDecodeError):
            json.loads(r.body[r.body.index("{") :])
    got = {r.event_id: r.a for r in catalog.json_ladder(spark, d).where("event_id % 8 = 4").collect()}
    assert got == cut and cut
