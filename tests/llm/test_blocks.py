"""Near duplicates in small blocks: members of one component are not dealt to each other, and no link is lost."""

import random

from pyspark.sql import functions as F

from weftline.llm import common, hyperminhash
from weftline.llm.common import Scratch


def _families():
    """A family of many near copies, some smaller ones that share words with it, and single texts."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for family, copies in enumerate([70, 30, 12, 5, *[1] * 30]):
        base = [rnd.choice(words) for _ in range(60)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(60)] = rnd.choice(words)
            docs.append((len(docs), " ".join(own)))
    return docs


def _brute(docs, percent):
    sets = {i: set(zip(t.split(), t.split()[1:], strict=False)) for i, t in docs}
    label = {i: i for i, _ in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in label}


def test_small_blocks_and_shuffled_sides_lose_no_link(spark, monkeypatch):
    docs = _families()
    want = _brute(docs, 80)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block, items, broadcast in ((4096, 1 << 20, 200_000), (4, 300, 0)):
        monkeypatch.setattr(hyperminhash, "BLOCK", block)
        monkeypatch.setattr(hyperminhash, "SET_BLOCK", block)
        monkeypatch.setattr(hyperminhash, "SET_ITEMS", items)
        monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
        got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(df, size=2).collect()}
        assert got == want


def test_a_label_is_dealt_once_for_each_block_of_others(spark):
    rows = [(1, i, 0) for i in range(4000)] + [(1, 4000 + i, i + 1) for i in range(90)]
    members = spark.createDataFrame(rows, "unit long, number long, label long")
    out = hyperminhash.dealt(members, "unit", F.count(F.lit(1)) / 100, Scratch(spark)).cache()
    # Forty blocks of the large label and one of the others: 4,000 rows once, 90 rows forty-one times.
    assert out.filter("label = 0").count() == 4000
    assert out.filter("label > 0").count() == 90 * 41
    met = out.groupBy("i", "j").agg(F.collect_set("label").alias("labels"), F.count(F.lit(1)).alias("n"))
    assert met.count() == 41 and met.filter("n > 300").count() == 0
    # Every pair of different labels meets somewhere.
    a, b = (out.select("i", "j", F.col("number").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    assert a.join(b, ["i", "j"]).filter("la < lb").select("a", "b").distinct().count() == 4000 * 90 + 90 * 89 // 2
