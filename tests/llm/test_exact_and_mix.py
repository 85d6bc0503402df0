"""Exact dedup and mixing: contracts, odd rows, agreement with brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from weftline.llm import exact_dedup, mixing, queries

SCHEMA = "doc_id long, text string, source string, sha string"
ROWS = [(5, "a  b", "x", "k"), (3, "a\tb", None, "k"), (9, "a b", "x", "k"), (1, None, "y", "k"), (2, "", "y", "k"), (None, "", "y", None), (7, " a b", "z", "k"), (8, "q", "z", "k"), (8, "q", "z", "k"), (None, "r", "z", "k"), (None, "r", "z", "k")]


@pytest.mark.parametrize("counters", [1024, 1])
def test_groups(spark, counters):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.groups(df, counters=counters).collect())
    assert got == Counter([(5, 3, 3, False), (3, 3, 3, True), (9, 3, 3, False), (1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, False), (7, 7, 1, True), (8, 8, 2, True), (8, 8, 2, True), (None, None, 2, True), (None, None, 2, True)])
    kept = exact_dedup.dedup(df, counters=counters)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(3, "a\tb"), (1, None), (7, " a b"), (8, "q"), (None, "r")])
    assert exact_dedup.groups(df.limit(0)).count() == 0 and exact_dedup.dedup(df.limit(0)).count() == 0


def test_hot_digests_are_found(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same' else cast(id as string) end as text").repartition(7)
    found = exact_dedup.frequent(df.select(exact_dedup.digest().alias("sha")), 8).collect()
    assert hashlib.sha256(b"same").hexdigest() in {r["sha"] for r in found}
    rows = exact_dedup.groups(df, counters=8).filter("group_size > 1").collect()
    assert len(rows) == 2000 and {r["keep_id"] for r in rows} == {0}


def water(sizes, weights, most):
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [k for k in sizes if k is None]
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    left = total
    while True:
        share = {k: left * w[k] / sum(w[x] for x in open_) for k in open_}
        over = [k for k in open_ if share[k] > most * sizes[k]]
        if not over:
            return out | share
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
            open_.discard(k)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_mix_on_the_table(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()}
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for k, r in docs.items()}
    per = Counter()
    for k, r in docs.items():
        per[r["source"]] += size[k]
    want = water(per, (5, 2, 1), 3)
    rows = queries.op10_mix_sources(spark, sf).collect()
    assert len(rows) == len(docs)
    taken = defaultdict(int)
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s]
        assert math.isclose(r["target"], want[s], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 4 * mixing.LEAST_BLOCK
    again = {(r["doc_id"], r["taken"]) for r in queries.op10_mix_sources(spark, sf).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_mix_odd_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rows = mixing.mix(df, least_block=1).collect()
    assert len(rows) == len(ROWS)
    assert sum(r["taken"] for r in rows) == 12
    assert {r["source"] for r in rows} == {"x", "y", "z", None}
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(empty).collect()] == [0, 0]
    assert mixing.mix(df.limit(0)).count() == 0
