from pyspark.sql.types import StructType

from mergelens.sources import io
from mergelens.streaming import history


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    schema = StructType().add("a", "long")
    assert [r.a for r in io.json_lines(spark, str(tmp_path), schema).collect()] == [1, 2]
    assert io.json_lines(spark, str(tmp_path), schema, bad=True).first()["value"] == "not json"


def test_text_files(spark, tmp_path):
    for name, data in {"ok": b"text", "zero": b"a\0b", "bad": b"\xff\xfe", "blank": b" \n "}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.error for r in io.text_files(spark, str(tmp_path)).collect()}
    assert got["ok"] is None and got["zero"] == "binary" and got["bad"] == "not UTF-8"


def test_stream_appends_unseen_keys_once(spark, tmp_path):
    rows = spark.sql("select id, timestamp'2024-01-01' as ts from range(5) union all select 3, timestamp'2024-01-01'")
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows.write.parquet(source)
    for _ in range(2):
        history.run_once(spark, rows.schema, source, sink, mark, "id", "ts")
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [0, 1, 2, 3, 4]
