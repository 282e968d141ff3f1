"""Collections over a client that fails in the middle, collecting by repository, and a history whose batch is stopped half-way."""

import json

import pytest
from pyspark.sql import functions as F

from mergelens.operators import service
from mergelens.sources import rest
from mergelens.streaming import history



@pytest.fixture
def api(spark, tmp_path):
    spark.dataSource.register(rest.RestSource)

    def put(items=25, down=(), gone=(), **named):
        (tmp_path / "state.json").write_text(json.dumps({"items": {"": items} | named, "down": list(down), "gone": list(gone)}))

    put()
    return "tests.paged", put, tmp_path


def options(reader, module, folder, **more):
    for k, v in ({"url": f"{folder}/u", "client": f"{module}:get", "per_page": 4, "delay": 0} | more).items():
        reader = reader.option(k, v)
    return reader


def test_a_missing_page_is_an_error(spark, api):
    module, put, folder = api
    read = lambda **more: options(spark.read.format("rest").schema("number long"), module, folder, **more).load()
    assert sorted(r.number for r in read(partitions=3).collect()) == list(range(25))
    assert sorted(r.number for r in read(partitions=3, most=10).collect()) == list(range(10))
    put(down=[3])
    with pytest.raises(Exception, match="Unavailable"):
        read(partitions=3).collect()
    put(items=24)  # the last page is full
    assert read().count() == 24


def test_links_and_tokens(spark, api, monkeypatch):
    module, _, folder = api
    followed = options(spark.read.format("rest").schema("number long"), module, folder, client=f"{module}:chain", follow="links")
    assert sorted(r.number for r in followed.load().collect()) == list(range(24))
    assert followed.option("most", 9).load().count() == 9
    reader = rest.RestReader(followed.load().schema, {"url": "u", "client": "x:y", "tokens": "A,B"})
    assert [(p.first, p.step, p.token) for p in reader.partitions()] == [(1, 2, "A"), (2, 2, "B")]


def test_stream_goes_on_where_it_failed(spark, api, tmp_path):
    module, put, folder = api
    sink, mark = str(tmp_path / "sink"), str(tmp_path / "mark")

    def run():
        stream = options(spark.readStream.format("rest").schema("number long, labels string"), module, folder, pages_per_batch=2).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", mark).start(sink)
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    put(items=10)
    run()
    put(items=33, down=[6])
    with pytest.raises(Exception, match="Unavailable"):
        run()
    put(items=33)
    run()
    run()
    assert sorted((r.number, json.loads(r.labels)) for r in spark.read.parquet(sink).collect()) == [(i, [i]) for i in range(33)]


def test_repositories_are_collected_once(spark, api, tmp_path):
    module, put, folder = api
    out = str(tmp_path / "repos")
    repos = spark.createDataFrame([(f"r{i}", f"{folder}/r{i}") for i in range(7)] + [("r0", f"{folder}/r0"), (None, f"{folder}/none")], "repo string, url string")
    put(items=5, r3=0, gone=["r5"])
    with pytest.raises(Exception, match="Unavailable"):
        rest.collect(repos, f"{module}:get", out, 0, 4, batch=2)
    kept = rest.collected(spark, out).groupBy("repo").count().collect()
    assert {(r[0], r[1]) for r in kept} == {(f"r{i}", 5) for i in (0, 1, 2)}
    (folder / "asked").unlink()
    put(items=5, r3=0)
    for _ in range(2):
        rest.collect(repos, f"{module}:get", out, 0, 4, batch=2)
    assert {r[0] for r in (json.loads(x) for x in (folder / "asked").read_text().splitlines())} == {"r4", "r5", "r6"}
    found = rest.collected(spark, out).select("repo", F.get_json_object("item", "$.number").cast("int").alias("n")).collect()
    assert sorted(tuple(r) for r in found) == sorted((f"r{i}", n) for i in (0, 1, 2, 4, 5, 6) for n in range(5))


def test_history_takes_each_key_once(spark, tmp_path, monkeypatch):
    source, rows, mark = (str(tmp_path / x) for x in ("in", "rows", "mark"))
    events = spark.sql("select id % 40 as k, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id % 7, 0) as ts, id from range(100) union all select null, timestamp'2024-01-01', 1")
    events.where("id < 60").repartition(3).write.parquet(source)
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    real, calls = history.merge, []

    def stopped(batch, number, *rest):
        calls.append(number)
        if number == 1 and calls.count(1) == 1:
            real(batch, number, *rest)  # written, but the batch's end is never noted
            raise RuntimeError("killed")
        real(batch, number, *rest)

    monkeypatch.setattr(history, "merge", stopped)
    with pytest.raises(Exception, match="killed"):
        history.follow(stream(), rows, mark, "k", "ts").awaitTermination()
    history.follow(stream(), rows, mark, "k", "ts").awaitTermination()
    events.where("id >= 60").write.mode("append").parquet(source)
    for _ in range(2):
        history.follow(stream(), rows, mark, "k", "ts").awaitTermination()
    found = history.stored(spark, rows, events.schema)
    assert sorted(r.k for r in found.collect()) == list(range(40)) and calls.count(1) == 2
    assert [r.k for r in history.newest(found, "k", "id", 3).collect()] == [39, 38, 37]


def test_sources_of_files_with_one_path(spark):
    kind = "request_id long, time timestamp, kind string, files array<struct<path:string,content:string>>, diff string"
    import datetime

    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), "file", [("a", "x"), ("a", "y"), ("b", None)], "")], kind)
    assert service.review(rows, True).first().source_files == {"a": "y"}
