"""Summaries of event streams and stages, and what they refuse."""

import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from weftline.operators import metrics, quality, state


def test_event_stream_summary_counts_every_facet(spark):
    rows = [("r", 1, "a", "workflow_started", "c", "started", None, True), ("r", 2, "b", "delivery", "c", "delivered", "x", True), ("r", 3, "b", "workflow_completed", None, "passed", None, True), ("s", 1, "d", "delivery", "c", "delivered", None, None), (None, 5, "e", "workflow_started", "c", "started", None, True)]
    events = spark.createDataFrame(rows, "run string, at long, id string, event_type string, component string, status string, reason_code string, valid boolean")
    out = {(r["run"], r["facet"], r["value"]): r for r in metrics.event_stream_summary(events, "run", "at", "id", "workflow_started", ("workflow_completed",)).collect()}
    whole = out["r", "run", None]
    assert (whole["events"], whole["duplicate_ids"], whole["first_type"], whole["last_type"], whole["contract_valid"], whole["lifecycle_valid"]) == (3, 1, "workflow_started", "workflow_completed", True, True)
    assert (out["r", "component", "c"]["events"], out["r", "component", None]["events"], out["r", "reason_code", None]["events"]) == (2, 1, 2)
    assert out["r", "event_type", "delivery"]["lifecycle_valid"] is None
    assert (out["s", "run", None]["contract_valid"], out["s", "run", None]["lifecycle_valid"]) == (False, False)
    assert (None, "status", "started") in out and len(out) == 11 + 5 + 5


def test_reservoir_is_the_smallest_digests_whatever_the_partitions(spark):
    rows = [("s", i, float(i * 7 % 1000), 1.0, 2) for i in range(3000)] + [(None, i, 5.0, 1.0, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "stage string, id long, wall double, cpu double, items long")
    chosen = sorted(range(3000), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())[:100]
    want = np.percentile([float(i * 7 % 1000) for i in chosen], [50, 95])
    for parts in (1, 7):
        got = {r["stage"]: r for r in metrics.stage_accumulator(df.repartition(parts), ["stage"], "id", "wall", "cpu", "items", reservoir=100).collect()}
        assert (got["s"]["calls"], got["s"]["items"], got["s"]["kept"], got[None]["kept"]) == (3000, 6000, 100, 3)
        assert np.allclose([got["s"]["p50"], got["s"]["p95"]], want)


def test_a_first_row_beyond_the_budget_fails(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 50), ("b", 1, 4)], "scope string, o long, size long")
    got = sorted(tuple(r)[:2] for r in state.pending_prefix(df, ["scope"], ["o"], "size", 10, 5).collect())
    assert got == [("a", 1), ("b", 1)]
    with pytest.raises(PySparkException, match="larger than the budget"):
        state.pending_prefix(df.filter("o = 2"), ["scope"], ["o"], "size", 10, 5).collect()


def test_nulls_of_delimited_text_count_as_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "id long, t string")
    assert [r["id"] for r in quality.findings(df).collect()] == [2]
    assert sorted(r["id"] for r in quality.findings(df, delimited=True).collect()) == [1, 2]
