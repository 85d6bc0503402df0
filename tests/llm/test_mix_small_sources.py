"""Mixing: small sources reach their targets however long the blocks are."""

from collections import defaultdict

from weftline.llm import mixing


def test_small_sources_with_long_blocks(spark):
    rows = [(i, "w " * 200, "large") for i in range(200)] + [(1000 + i, "w " * 10, "small") for i in range(3)] + [(2000, "a b c d e", None), (2001, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = defaultdict(int), {}
    # 64 slots of over 600 words each, as a corpus of that share of large and small sources has them at any larger size.
    for r in mixing.mix(df, most_slots=64).collect():
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["first_slot"] is None) == (r["taken"] == 0)
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(taken.values()) == sum(r[1].count("w") for r in rows) + 5
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items()) and target["small"] == 90 and target[None] == 15
