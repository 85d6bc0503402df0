"""Decisions by bounds equal those over all pairs; glossary advice goes to review."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import matching

FIELDS = "pair string, id string, name string, aliases array<string>, data_type string, nullable boolean, sensitivity string, role string, position int"
WORDS = ("customer", "client", "number", "no", "order", "date", "datum", "unit", "price", "Preis", "total", "tax", "ship", "mode", "Größe", "name", "x", "")


def schemas(spark, side, pairs, fields, seed):
    rng = random.Random(seed)
    rows = []
    for p in range(pairs):
        for i in range(fields):
            name = rng.choice(("{} {}", "{}_{}", "{}")).format(rng.choice(WORDS), rng.choice(WORDS))
            aliases = None if rng.random() < 0.5 else [rng.choice(WORDS) for _ in range(rng.randrange(3))]
            role = rng.choice(("value", "natural_key", "foreign_key", "credential"))
            rows.append((f"p{p}", f"{side}{i}", name, aliases, rng.choice(("string", "integer", "decimal", "date", "unknown")), rng.random() < 0.5, rng.choice(("public", "internal", "secret")), role, i))
    return spark.createDataFrame(rows, FIELDS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("with_semantic", [False, True])
def test_bounds_leave_decisions_as_they_are(spark, with_semantic):
    source, target = schemas(spark, "s", 6, 14, 1), schemas(spark, "t", 6, 17, 2)
    keys = F.when(F.col("role") == "foreign_key", F.array(F.struct(F.col("name"), F.lit("string").alias("data_type"))))
    target = target.withColumn("lookup_keys", F.coalesce(keys, F.expr("cast(array() as array<struct<name:string,data_type:string>>)")))
    semantic = None
    if with_semantic:
        made = [(f"p{p}", f"s{i}", f"t{(i * 7 + p) % 17}", ((i * 5 + p) % 11) / 10) for p in range(6) for i in range(14)]
        semantic = spark.createDataFrame(made, "pair string, source_id string, target_id string, semantic double")
    full = matching.candidates(source, target, semantic=semantic)
    kept = matching.leading(source, target, semantic=semantic)
    assert rows(matching.propose(source, target, semantic=semantic)) == rows(matching.decide(full))
    scores = {tuple(r) for r in full.select("pair", "source_id", "target_id", "name_score", "det", "score").collect()}
    some = {tuple(r) for r in kept.select("pair", "source_id", "target_id", "name_score", "det", "score").collect()}
    assert some <= scores
    assert len(some) < len(scores) * (0.8 if with_semantic else 0.6)


def test_bounds_hold_each_score(spark):
    source, target = schemas(spark, "s", 3, 10, 3), schemas(spark, "t", 3, 10, 4)
    pairs = matching._pairs(source, target)
    scores = matching.name_scores(pairs).select("pair", "source_id", "target_id", "name_score")
    broken = matching.name_bounds(pairs).join(scores, ["pair", "source_id", "target_id"]).filter("name_score < name_low - 1e-9 or name_score > name_high + 1e-9")
    assert broken.count() == 0


def test_glossary_advice(spark):
    source = spark.createDataFrame([("p", "a", "Comment", [], "string", True, "internal", "value", 1), ("p", "b", "Remark", [], "string", True, "internal", "value", 2)], FIELDS)
    target = spark.createDataFrame([("p", "r", "remark", [], "string", True, "internal", "value", 1), ("p", "n", "count", [], "integer", True, "internal", "value", 2)], FIELDS)
    plain = {r["source_id"]: r for r in matching.propose(source, target).collect()}
    assert (plain["b"]["target_id"], plain["b"]["status"]) == ("r", "auto")
    concepts = spark.createDataFrame([("comment", "note"), ("Remark", "note")], "term string, concept string")
    advised = {r["source_id"]: r for r in matching.propose(source, target, concepts).collect()}
    # The advice claims the target of an automatic decision, so both go to review.
    if plain["a"]["target_id"] != "r":
        assert advised["a"]["margin"] == 0.0 and advised["a"]["score"] >= 0.55
    assert (advised["a"]["target_id"], advised["a"]["status"]) == ("r", "review")
    assert (advised["b"]["target_id"], advised["b"]["status"]) == ("r", "review")


def test_no_fields(spark):
    none = spark.createDataFrame([], FIELDS)
    assert matching.propose(none, none, spark.createDataFrame([], "term string, concept string")).collect() == []
