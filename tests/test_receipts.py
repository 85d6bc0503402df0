"""Delivery from claim to receipt on small batches."""

import pytest
from pyspark.sql import functions as F

from weftline.plans.mapping import Field, Relation, Rule, Schema, plan_for
from weftline.sources.commits import Table
from weftline.streaming import receipts

SOURCE = Schema("s", (Field("k", "k", "string", False), Field("c", "c", "string", False, role="natural_key")))
TARGET = Schema("t", (Field("n", "n", "integer", False), Field("cid", "cid", "integer", True, role="foreign_key")), (Relation("cid", "customers", "id", (("name", "string"),)),))
PLAN = plan_for(SOURCE, TARGET, (Rule("k", "n", "parse_integer"), Rule("c", "cid", "lookup_foreign_key", (("lookup_key", "name"),))))
ROWS = "id string, at int, k string, c string, ok boolean"


def send(spark, root, number, rows, names=("ann", "bob")):
    customers = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    batch = spark.createDataFrame(rows, ROWS)
    out = receipts.deliver_batch(batch, number, root, ["id"], "at", PLAN, SOURCE, TARGET, {"cid": (customers, "name", "id")}, F.col("ok"))
    return [(r["id"], r["status"], r["reason_code"]) for r in out.orderBy("at").collect()]


def written(spark, root):
    return sorted(tuple(r) for r in receipts.target_rows(spark, root).collect())


def test_each_status(spark, tmp_path):
    root = str(tmp_path)
    first = [("a", 1, "1", "ann", True), ("b", 2, "x", "ann", True), ("c", 3, "3", "eve", True), ("d", 4, "4", "bob", None), ("a", 5, "1", "ann", True), ("a", 6, "2", "ann", True), ("b", 7, "x", "ann", True), (None, 8, "8", "bob", True)]
    assert send(spark, root, 0, first) == [
        ("a", "delivered", None), ("b", "quarantined", "destination_contract_failed"), ("c", "quarantined", "destination_resolution_failed"), ("d", "quarantined", "transport_verification_failed"),
        ("a", "duplicate", None), ("a", "replay_detected", None), ("b", "ambiguous", "previous_delivery_ambiguous"), (None, "delivered", None)]
    assert written(spark, root) == [(1, 0), (8, 1)]
    again = [("a", 1, "1", "ann", True), ("c", 2, "3", "eve", True), ("c", 3, "4", "eve", True), (None, 4, "8", "bob", True), ("e", 5, None, None, True)]
    assert [s for _, s, _ in send(spark, root, 1, again)] == ["duplicate", "ambiguous", "replay_detected", "duplicate", "quarantined"]
    # A name that came meanwhile: rearmed, c is delivered, once.
    assert receipts.rearm(spark.createDataFrame([("c",), ("a",), ("zz",)], "id string"), root, ["id"], 2) == 1
    late = [("c", 1, "9", "eve", True), ("c", 2, "3", "eve", True), ("c", 3, "3", "eve", True)]
    assert [s for _, s, _ in send(spark, root, 3, late, ("ann", "bob", "eve"))] == ["replay_detected", "delivered", "duplicate"]
    assert written(spark, root) == [(1, 0), (3, 2), (8, 1)]
    assert [s for _, s, _ in send(spark, root, 4, late, ("ann", "bob", "eve"))] == ["replay_detected", "duplicate", "duplicate"]


def test_a_batch_goes_on_where_it_failed(spark, tmp_path, monkeypatch):
    root, append = str(tmp_path), Table.append
    rows = [("a", 1, "1", "ann", True), ("b", 2, "2", "bob", True)]

    def fails(self, *args, **named):
        if self.path.endswith("target"):
            raise OSError("lost")
        return append(self, *args, **named)

    monkeypatch.setattr(Table, "append", fails)
    with pytest.raises(OSError):
        send(spark, root, 0, rows)
    monkeypatch.setattr(Table, "append", append)
    # What changed meanwhile does not change what was judged.
    assert [s for _, s, _ in send(spark, root, 0, rows, ())] == ["delivered", "delivered"]
    assert [s for _, s, _ in send(spark, root, 0, rows)] == ["delivered", "delivered"]
    assert written(spark, root) == [(1, 0), (2, 1)]


def test_an_empty_batch(spark, tmp_path):
    assert send(spark, str(tmp_path), 0, []) == []
    assert written(spark, str(tmp_path)) == []
