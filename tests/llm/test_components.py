"""Components by stars: against union-find, and how many jobs they ask of the driver."""

import random

import pytest

from weftline.llm import hyperminhash
from weftline.llm.common import Scratch


def _jobs(spark, work):
    sc = spark.sparkContext
    group = f"components-{random.random()}"
    sc.setJobGroup(group, group)
    try:
        out = work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(group))


def _brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root if find(x) != x}


_r = random.Random(7)
GRAPHS = {
    "none": [],
    "loops only": [(4, 4)],
    "chain": [(i, i + 1) for i in range(40)],
    "backward star": [(i, 50) for i in range(50)],
    "shuffled": [(_r.randrange(120), _r.randrange(120)) for _ in range(110)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_are_those_of_union_find(spark, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges + edges[:3], "a long, b long")
    rows = hyperminhash.components(df, Scratch(spark)).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["label"] for r in rows} == _brute(edges)


def test_stars_are_seen_without_a_round(spark):
    df = spark.createDataFrame([(1, i) for i in range(2, 30)] + [(100, 101)], "a long, b long")
    found, jobs = _jobs(spark, lambda: hyperminhash.components(df, Scratch(spark)))
    assert jobs <= 6
    assert found.count() == 29


def test_counts_come_with_the_table(spark):
    from pyspark.sql import functions as F

    df = spark.range(10).repartition(3).filter("id > 3")
    (table, seen), jobs = _jobs(spark, lambda: Scratch(spark).counted(df, even=F.count_if(F.expr("id % 2 = 0"))))
    assert (seen, jobs) == ({"rows": 6, "even": 3}, 2) and table.count() == 6
    for nothing in (df.filter("id > 99").groupBy("id").count().join(df, "id"), spark.createDataFrame([], "id long"), spark.range(3).filter("false")):
        table, seen = Scratch(spark).counted(nothing)
        assert seen == {"rows": 0} and table.count() == 0
