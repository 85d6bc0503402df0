"""Review artifacts and reasons on small tables."""


from weftline.operators import reasons, review

A = "artifact_id string, pair string, source_fingerprint string, destination_fingerprint string, reviewed_by string, created_at string"
D = "artifact_id string, place int, source_field string, target_field string, disposition string"
S, T = "a" * 64, "b" * 64
WHEN = "2024-01-01T00:00:00Z"


def routes(spark):
    return spark.createDataFrame([("p", S, T)], "pair string, source_fingerprint string, destination_fingerprint string")


def test_findings(spark):
    artifacts = spark.createDataFrame(
        [("good", "p", S, T, "ann", WHEN), ("none", "p", S, T, "ann", WHEN), ("stale", "p", T, S, "ann", WHEN), ("far", "q", S, T, "ann", WHEN), ("bad", "p", "A" * 64, None, "a\nb", "2024-01-01T00:00:00"),
         ("twice", "p", S, T, "ann", WHEN), ("twice", "p", S, T, "bob", WHEN), (None, "p", S, T, "ann", WHEN), ("big", "p", S, T, "ann", WHEN)], A)
    choices = [(i, 1, "s", "t", "accepted") for i in ("good", "stale", "far", "twice", None)]
    choices += [("bad", 1, None, "t", "accepted"), ("bad", 2, "", None, "corrected"), ("bad", 3, "x", "t", "abstained"), ("bad", 4, "x", "u", None)]
    choices += [("big", i, f"s{i}", f"t{i}", "accepted") for i in range(review.MOST_DECISIONS + 1)]
    decisions = spark.createDataFrame(choices, D)
    found = {}
    for r in review.judged(artifacts, decisions, routes(spark)).collect():
        found.setdefault(r["artifact_id"], []).append((r["n_decisions"], r["findings"], r["applicable"]))
    assert found["good"] == [(1, [], True)]
    assert found["none"] == [(0, ["decision_count_invalid"], False)]
    assert found["stale"] == found["far"] == [(1, ["source_schema_stale", "destination_schema_stale"], False)]
    assert found["twice"] == [(1, ["artifact_id_invalid"], False)] * 2
    assert found["big"] == [(4097, ["decision_count_invalid"], False)]
    assert found[None] == [(0, ["artifact_id_invalid", "decision_count_invalid"], False)]
    assert found["bad"][0][1] == [
        "fingerprint_invalid", "reviewer_invalid", "created_at_invalid", "field_invalid", "disposition_unknown", "abstained_with_target", "target_missing",
        "source_field_repeated", "target_field_repeated", "source_schema_stale", "destination_schema_stale", "decisions_abstained"]
    digests = review.content_digests(artifacts, decisions)
    assert {r[0] for r in digests.collect()} == {"good", "stale", "far", "bad", "twice"}


def test_the_latest_artifact_speaks(spark):
    artifacts = spark.createDataFrame([("old", "p", S, T, "ann", "2024-01-01T00:00:00Z"), ("new", "p", S, T, "bob", "2024-01-01T00:30:00+00:00"), ("other", "p", T, T, "eve", "2025-01-01T00:00:00Z")], A)
    decisions = spark.createDataFrame([("old", 1, "a", "x", "accepted"), ("new", 1, "a", "y", "corrected"), ("new", 2, "b", "gone", "accepted"), ("new", 3, "nobody", "z", "accepted"), ("other", 1, "c", "z", "accepted")], D)
    decided = spark.createDataFrame([("p", "a", None, "blocked", 0.1), ("p", "b", "x", "review", 0.6), ("p", "c", "y", "auto", 0.95), ("q", "a", "x", "auto", 0.9)], "pair string, source_id string, target_id string, status string, score double")
    targets = spark.createDataFrame([("p", t) for t in "xyz"], "pair string, id string")
    rows = review.applied(decided, review.judged(artifacts, decisions, routes(spark)), decisions, targets)
    assert sorted(tuple(r) for r in rows.select("pair", "source_id", "target_id", "status", "reviewed_by").collect()) == [
        ("p", "a", "y", "reviewed", "bob"),
        ("p", "b", "x", "unknown_target", None),
        ("p", "c", "y", "review", None),
        ("q", "a", "x", "auto", None),
    ]


def test_suggestions(spark):
    decided = spark.createDataFrame([("p", "a", "x", "auto", 1.0, 1.0), ("p", "b", "y", "review", 1.5, 0.0), ("p", "c", None, "blocked", -1.0, 0.2)], "pair string, source_id string, target_id string, status string, score double, margin double")
    rows = {r["source_id"]: (r["evidence_class"], r["confidence"]) for r in review.suggestions(decided).collect()}
    assert rows == {"b": ("multiple_signals", 1.0), "c": ("no_supported_match", 0.0)}


def test_each_code_once_and_unknown_ones_explained(spark):
    known = reasons.reasons(spark)
    assert known.groupBy("code").count().filter("count > 1").count() == 0
    rows = spark.createDataFrame([("write_not_committed", 1), ("hm", 2), (None, 3)], "code string, category int")
    got = reasons.explained(rows.withColumnRenamed("category", "n"), "code").orderBy("n").select("code", "category", "retry_policy").collect()
    assert [tuple(r) for r in got] == [("write_not_committed", "destination_write", "safe_to_retry"), ("hm", "unknown", "inspect_before_retry"), (None, None, None)]
