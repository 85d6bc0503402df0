"""A table with a commit log: two writers, batches sent again, upserts, compaction."""

import threading

import pytest
from pyspark.sql import functions as F

from weftline.sources.commits import Conflict, Table


def test_appends_of_two_writers_lose_no_row(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []

    def work(k):
        try:
            for i in range(4):
                Table(spark, path).append(spark.range(k * 100 + i * 10, k * 100 + i * 10 + 10))
        except Exception as error:  # the assertion below tells it
            failed.append(error)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    table = Table(spark, path)
    assert failed == []
    assert table.versions() == list(range(1, 13))
    assert sorted(r[0] for r in table.read().collect()) == [k * 100 + i for k in range(3) for i in range(40)]
    assert table.read(1).count() == 10
    assert not list((tmp_path / "t" / "staged").iterdir())


def test_a_lost_race_is_tried_again(spark, tmp_path, monkeypatch):
    table, other = Table(spark, str(tmp_path / "t"), ["k"], 4), Table(spark, str(tmp_path / "t"), ["k"], 4)
    table.upsert(spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string"))
    put, calls = Table._put, []

    def between(self, snapshot):
        if self is table and not calls:
            calls.append(1)
            other.upsert(spark.createDataFrame([(1, "other"), (3, "other")], "k int, v string"))
        return put(self, snapshot)

    monkeypatch.setattr(Table, "_put", between)
    table.upsert(spark.createDataFrame([(2, "b"), (4, "b"), (None, "b")], "k int, v string"))
    rows = sorted((tuple(r) for r in table.read().collect()), key=repr)
    assert rows == sorted([(1, "other"), (2, "b"), (3, "other"), (4, "b"), (None, "b")], key=repr)
    assert len(table.versions()) == 3


def test_batches_are_committed_once(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    for number in (0, 1, 1, 0):
        table.append(spark.range(5), batch=("stream", number))
    assert table.read().count() == 10 and len(table.versions()) == 2


def test_compare_and_set(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    first = table.set_properties({"offset": "1"}, expected=0)
    table.set_properties({"offset": "2"}, expected=first)
    with pytest.raises(Conflict):
        table.set_properties({"offset": "3"}, expected=first)
    assert table.snapshot().properties["offset"] == "2"
    with pytest.raises(ValueError):
        table.read()


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), ["id"], 8)
    table.upsert(spark.range(200).withColumn("v", F.lit(0)))
    before = set(table.snapshot().parts)
    table.upsert(spark.createDataFrame([(7, 1)], "id long, v int"))
    after = set(table.snapshot().parts)
    assert len(before) == len(after) == 8 and len(before & after) == 7
    assert table.read().agg(F.sum("v"), F.count("id")).first()[:] == (1, 200)
    assert table.read(1).agg(F.sum("v")).first()[0] == 0
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([("7", 1)], "id string, v int"))
    with pytest.raises(Exception, match="repeated"):
        table.upsert(spark.createDataFrame([(7, 1), (7, 2)], "id long, v int"))


def test_the_newest_stays_whatever_comes_when(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), ["k"], 2)
    kind = "k int, at int, v string"
    table.upsert(spark.createDataFrame([(1, 5, "e"), (1, 3, "c"), (2, 1, "a")], kind), order=["at"], keep_newest=True)
    table.upsert(spark.createDataFrame([(1, 4, "d"), (2, 2, None)], kind), order=["at"], keep_newest=True)
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 5, "e"), (2, 2, None)]
    table.upsert(spark.createDataFrame([], kind), order=["at"])
    assert table.read().count() == 2


def test_compaction_keeps_rows_and_later_versions(spark, tmp_path, monkeypatch):
    table, other = Table(spark, str(tmp_path / "t")), Table(spark, str(tmp_path / "t"))
    for i in range(5):
        table.append(spark.range(i * 10, i * 10 + 10))
    put, calls = Table._put, []

    def between(self, snapshot):
        if self is table and not calls:
            calls.append(1)
            other.append(spark.range(100, 110))
        return put(self, snapshot)

    monkeypatch.setattr(Table, "_put", between)
    table.compact()
    assert len(table.snapshot().parts) == 2
    assert sorted(r[0] for r in table.read().collect()) == [*range(50), *range(100, 110)]
    assert table.read(5).count() == 50
    assert table.vacuum(keep=1) == 5
    assert table.versions() == [7] and table.read().count() == 60
