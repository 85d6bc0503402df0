"""Two-level scans and chunks by pointer jumping against plain Python, with one hot key and small segments and blocks."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import chunking, metrics, scan, state


def _rows(seed, n=900):
    rnd = random.Random(seed)
    keys = ["hot"] * 6 + [None, "a", "b"]
    return [(rnd.choice(keys), i, rnd.choice([None, 0, 1, 5, 20, 70, 200]), rnd.choice(["x", "y", None, *map(str, range(40))])) for i in rnd.sample(range(10_000), n)]


@pytest.mark.parametrize("segments", [1, 2, 9, 64])
def test_running_equals_a_pass_over_each_key(spark, segments):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "k string, o long, v long, t string").repartition(5)
    out = scan.running(df, ["k"], ["o"], sums={"total": "v"}, before={"pv": "v", "pt": "t"}, place="n", segments=segments)
    assert out.columns == ["k", "o", "v", "t", "n", "total", "pv", "pt"]
    want, last = [], {}
    for k, o, v, t in sorted(rows, key=lambda r: r[1]):
        n, total, pv, pt = last.get(k, (0, None, None, None))
        total = total if v is None else (total or 0) + v
        want.append((k, o, v, t, n + 1, total, pv, pt))
        last[k] = (n + 1, total, v, t)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert scan.running(df.limit(0), ["k"], ["o"], sums={"total": "v"}).count() == 0


def test_a_hot_key_spreads_over_segments_and_carries_one_row_for_each_cut(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    cut = scan.cuts(df, ["k", "o"], 16)
    sizes = [r["count"] for r in df.groupBy(scan.segment(df, ["k", "o"], cut).alias("s")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
    plan = scan.running(df, ["k"], ["o"], place="n", segments=16)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "AdaptiveSparkPlan" in plan


def greedy(rows, most_rows, most_bytes):
    out, at = [], {}
    for k, o, v, t in sorted(rows, key=lambda r: r[1]):
        n, used, seen, chunk = at.get(k, (0, 0, set(), 0))
        if not chunk or n >= most_rows or used + (v or 0) > most_bytes or (t is not None and t in seen):
            n, used, seen, chunk = 0, 0, set(), chunk + 1
        at[k] = (n + 1, used + (v or 0), seen | {t}, chunk)
        out.append((k, o, v, t, chunk))
    return out


@pytest.mark.parametrize(("seed", "most_rows", "most_bytes", "block"), [(1, 7, 90, 28), (2, 3, 1000, 12), (3, 40, 60, 160), (4, 1, 5, 4), (5, 8, 100, 4096)])
def test_chunks_equal_greedy_packing(spark, seed, most_rows, most_bytes, block):
    rows = _rows(seed, 700)
    df = spark.createDataFrame(rows, "k string, o long, v long, t string").repartition(6)
    got = chunking.chunks(df, "k", "o", "v", most_rows, most_bytes, identity="t", block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(greedy(rows, most_rows, most_bytes), key=repr)
    plain = chunking.chunks(df, "k", "o", "v", most_rows, most_bytes, block=block)
    want = [(k, o, v, c) for k, o, v, _, c in greedy([(k, o, v, None) for k, o, v, _ in rows], most_rows, most_bytes)]
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(((k, o, v, c) for k, o, v, c in want), key=repr)


def test_chunks_of_nothing(spark):
    df = spark.createDataFrame([], "k string, o long, v long")
    assert chunking.chunks(df, "k", "o", "v", 3, 10).count() == 0


def test_lifecycle_and_chain_of_one_hot_stream(spark):
    events = spark.createDataFrame([("r1", 1, "start"), ("r1", 2, "x"), ("r1", 3, "end"), ("r2", 1, "x"), ("r2", 2, "end"), ("r3", 1, "start"), ("r3", 2, "start"), ("r3", 3, "end"), (None, 1, "start"), (None, 2, "end"), ("r4", 1, None)], "run string, o long, kind string")
    got = {r["run"]: r["valid"] for r in metrics.lifecycle(events, "run", "o", "kind", "start", ("end",)).collect()}
    assert got == {"r1": True, "r2": False, "r3": False, None: True, "r4": False}
    built = state.chain(spark.range(3000).select(F.lit("s").alias("s"), F.col("id").alias("o"), F.col("id").cast("string").alias("e")), "s", "o", "e").checkpoint()
    assert state.verify_chain(built, "s", "e").filter("not linked").count() == 0
    bad = built.withColumn("e", F.expr("if(sequence = 1500, 'forged', e)")).filter("sequence <> 2000")
    assert sorted(r["sequence"] for r in state.verify_chain(bad, "s", "e").filter("not linked").collect()) == [1500, 2001]
