"""Sources over files and functions, and queues, windows and sessions over event time."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lattica.sources import io
from lattica.streaming import engine


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("three;four")
    where = str(tmp_path)
    assert {r.path.rsplit("/", 1)[1]: r.text for r in io.text_files(spark, where).collect()} == {"a.txt": "one\ntwo\n", "b.txt": "three;four"}
    assert sorted(r.value for r in io.lines(spark, f"{where}/a.txt").collect()) == ["one", "two"]
    assert sorted(r.value for r in io.lines(spark, f"{where}/b.txt", ";").collect()) == ["four", "three"]
    assert {bytes(r.content) for r in io.binary_files(spark, where).collect()} == {b"one\ntwo\n", b"three;four"}


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"c": ":SEA", "b": "bee", "a": 3}\n{"a": 4}\n')
    assert sorted((r.a, r.b) for r in io.json_rows(spark, f"{tmp_path}/x.json", "a int, b string, c string").collect()) == [(3, "bee"), (4, None)]
    (tmp_path / "x.xml").write_text("<all><row id='1'><v>a</v></row><row id='2'><v>b</v></row></all>")
    assert sorted((r["_id"], r.v) for r in io.xml_rows(spark, f"{tmp_path}/x.xml", "row", "_id int, v string").collect()) == [(1, "a"), (2, "b")]


def test_callback_source(spark, tmp_path, monkeypatch):
    (tmp_path / "lattica_test_rows.py").write_text("def partitions():\n    return [1, 2, 3]\n\n\ndef fetch(p):\n    for i in range(p):\n        yield (p, i)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "lattica_test_rows.py"))
    spark.dataSource.register(io.CallbackSource)
    rows = spark.read.format("lattica_callback").options(module="lattica_test_rows", schema="p int, i int").load()
    assert sorted((r.p, r.i) for r in rows.collect()) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]


def run(spark, stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table(name).collect()


@pytest.fixture
def queue(spark, tmp_path):
    at = lambda minute: datetime(2024, 1, 1, 12, minute)
    rows = [(1, "a", at(0), 2.0), (2, "a", at(3), 3.0), (2, "a", at(3), 3.0), (3, "b", at(4), 5.0), (4, "a", at(30), 7.0), (5, "a", at(59), 1.0)]
    spark.createDataFrame(rows, "id int, k string, at timestamp, v double").coalesce(1).write.parquet(f"{tmp_path}/queue")
    return engine.items(spark, f"{tmp_path}/queue", "id int, k string, at timestamp, v double")


def test_queue_without_repeats(spark, queue):
    assert sorted(r.id for r in run(spark, engine.without_repeats(queue, ["id"]), "once", "append")) == [1, 2, 3, 4, 5]
    assert sorted(r.id for r in run(spark, engine.without_repeats(queue, ["id"], "at", "10 minutes"), "once_within", "append")) == [1, 2, 3, 4, 5]


def test_windows_and_sessions(spark, queue):
    got = run(spark, engine.windowed(queue, "at", "10 minutes", "1 hour", ["k"], "v"), "by_window", "complete")
    assert sorted((r.start.minute, r.k, r.total, r.n) for r in got) == [(0, "a", 8.0, 3), (0, "b", 5.0, 1), (30, "a", 7.0, 1), (50, "a", 1.0, 1)]
    got = run(spark, engine.sessions(queue, "at", "5 minutes", "1 hour", ["k"]), "by_session", "complete")
    assert sorted((r.k, r.start.minute, r.n) for r in got) == [("a", 0, 3), ("a", 30, 1), ("a", 59, 1), ("b", 4, 1)]


def test_lines_as_queue(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("a\nb\na\n")
    got = run(spark, engine.line_items(spark, f"{tmp_path}/in").groupBy("value").agg(F.count("*").alias("n")), "by_line", "complete")
    assert {r.value: r.n for r in got} == {"a": 2, "b": 1}
