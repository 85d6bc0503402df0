"""Sinks on small folders."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import state
from weftline.sources import database, sinks


def test_csv_fields_must_match(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.append_matching(spark.createDataFrame([("1", "2")], "c1 string, c2 string"), path, ["a", "a"])
    sinks.append_matching(spark.createDataFrame([("y", "x")], "`a [2]` string, a string"), path, ["a", "a"])
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(path).collect()) == [("1", "2"), ("x", "y")]
    with pytest.raises(ValueError):
        sinks.append_matching(spark.createDataFrame([("1",)], "b string"), path, ["a", "a"])


def test_publication_is_whole_or_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.publish(spark.range(10), path)
    assert spark.read.parquet(path).count() == 10
    with pytest.raises(FileExistsError):
        sinks.publish(spark.range(1), path)
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_audit_export(spark, tmp_path):
    events = spark.createDataFrame([("a", i, f"e{i}") for i in range(5)] + [("b", 0, None)], "s string, o int, e string")
    chain = state.chain(events, "s", "o", "e")
    assert sinks.export_audit(chain, "s", "e", str(tmp_path / "audit")) == 6
    broken = chain.withColumn("e", F.when(F.col("sequence") == 2, "forged").otherwise(F.col("e")))
    with pytest.raises(ValueError):
        sinks.export_audit(broken, "s", "e", str(tmp_path / "other"))


def test_reports_and_history(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "code string, n int")
    assert json.loads(sinks.report(rows, str(tmp_path / "r"), ["code"])) == [{"code": "a", "n": 1}, {"code": "b", "n": 2}]
    runs = spark.createDataFrame([("r1", 1), ("r2", 2)], "run string, at int")
    path = str(tmp_path / "history")
    assert sinks.run_history(runs, path, "run", "at").first()["run"] == "r2"
    more = spark.createDataFrame([("r2", 2), ("r3", 3)], "run string, at int")
    assert sinks.run_history(more, path, "run", "at").first()["run"] == "r3"
    assert spark.read.json(path).count() == 3


def test_http_writes(spark):
    seen = []

    def send(url, body, headers):
        seen.append((headers["Idempotency-Key"], json.loads(body)))
        return 500 if headers["Idempotency-Key"] == "k3" else 201

    with pytest.raises(sinks.PartialWrite) as failed:
        sinks.post_records([("k1", {"v": 1}), ("k2", {"v": 2}), ("k3", {}), ("k4", {})], send, "https://example.org/records")
    assert failed.value.committed == ["k1", "k2"] and seen[1] == ("k2", {"v": 2})
    got = sinks.post(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "k", lambda u, b, h: 200 if h["Idempotency-Key"] == "a" else 503, "https://example.org")
    assert {r["identity"]: r["committed"] for r in got.collect()} == {"a": True, "b": False}


def test_sources_that_change(spark, tmp_path):
    (tmp_path / "f.txt").write_text("one")
    before = sinks.identities(spark, str(tmp_path))
    sinks.require_unchanged(spark, str(tmp_path), before)
    (tmp_path / "f.txt").write_text("another")
    with pytest.raises(RuntimeError):
        sinks.require_unchanged(spark, str(tmp_path), before)


def test_batches_are_bounded_and_proved(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    path = str(tmp_path / "t")
    assert database.write_batch(df, path, ["id"], ["id", "v"]) == 1
    assert database.write_batch(df, path, ["id"], ["id", "v"]) == 1
    with pytest.raises(ValueError):
        database.write_batch(spark.range(1001), str(tmp_path / "u"), ["id"], ["id"])
