"""The ranker, the texts of events, the gate over reports and the choice of columns, against plain Python and on odd rows."""

import hashlib
import math
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import ranking, reports
from weftline.operators.matching import normalize_name


def _plain_score(weights, a, b):
    """Both texts are plain words already."""
    left, right = sorted(set(a.split())), sorted(set(b.split()))
    share = lambda x, y: len(x & y) / max(1, len(x | y))
    cut = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    values = [("bias", 1.0), ("exact", float(a == b != "")), ("edit", SequenceMatcher(None, a, b, autojunk=False).ratio()), ("overlap", share(set(left), set(right)))]
    values += [("length", min(len(a), len(b)) / max(1, len(a), len(b))), ("char2", share(cut(a, 2), cut(b, 2))), ("char3", share(cut(a, 3), cut(b, 3)))]
    values += [(f"pair:{x}\x1f{y}", 1 / math.sqrt(len(left) * len(right))) for x in left for y in right]
    total = sum(weights[int.from_bytes(hashlib.blake2s(n.encode(), digest_size=4).digest(), "big") % 16384] * v for n, v in values)
    return 1 / (1 + math.exp(-max(-50, min(50, total))))


def test_ranker(spark, tmp_path):
    texts = ["customer number", "client no", "größe", "", "a", "customer number"]
    rows = [("s", "customer number", f"t{i}", t) for i, t in enumerate(texts)]
    pairs = spark.createDataFrame(rows, "source_id string, source_text string, target_id string, target_text string")
    weights = np.random.default_rng(3).normal(0, 1, ranking.DIMENSIONS)
    for w in (weights, ranking.model(ranking.BASELINE)):
        got = {r.target_id: r for r in ranking.ranked(pairs, w).collect()}
        for i, t in enumerate(texts):
            assert got[f"t{i}"].rank_score == pytest.approx(_plain_score(w, "customer number", t.casefold()), abs=1e-9)
    order = sorted(got.values(), key=lambda r: r.place)
    # Equal texts tie and go by id.
    assert [r.target_id for r in order[:2]] == ["t0", "t5"] and {r.authority for r in order} == {"advisory_only"}
    odd = spark.createDataFrame([("s", None, "t", "orderDate | ORDER")], pairs.schema)
    assert ranking.ranked(odd, weights).count() == 1
    assert odd.select(ranking.plain("target_text")).first()[0] == "order date order"
    assert ranking.ranked(pairs.limit(0), weights).count() == 0
    for wrong in (pairs.unionByName(pairs), pairs.withColumn("target_id", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="candidates must be distinct"):
            ranking.ranked(wrong, weights).collect()
    with pytest.raises(Exception, match="candidates must be distinct"):
        ranking.ranked(pairs, weights, most=5).collect()
    raw = weights.astype("<f8").tobytes()
    (tmp_path / "model").write_bytes(raw)
    assert (ranking.load(str(tmp_path / "model"), hashlib.sha256(raw).hexdigest()) == weights).all()
    with pytest.raises(ValueError):
        ranking.load(str(tmp_path / "model"), "0" * 64)


def test_messages(spark):
    catalog = spark.createDataFrame([("a", "en", "{x} and {y}"), ("a", "de", "{x} und {{y}}"), ("b", "en", "} {x")], "message_key string, language string, template string")
    rows = [(1, "a", "de_CH", {"x": "1", "y": "2"}), (2, "a", "fr", {"x": "1"}), (3, "b", None, None), (4, "c", "en", {"x": "$0"}), (5, None, "en", {}), (6, "a", "EN", {"x": "{y}", "y": None})]
    events = spark.createDataFrame(rows, "id long, k string, l string, p map<string,string>")
    got = {r.id: r.message for r in reports.messages(events, catalog, "k", "l", "p").collect()}
    assert got == {1: "1 und {y}", 2: "1 and {y}", 3: "} {x", 4: "c", 5: None, 6: "{y} and {y}"}


def test_inventory(spark):
    rows = [
        (1, "f1", "Account-ID", "internal", "attribute"),
        (1, "f2", "login", "secret", None),
        (1, "f3", "Owner", "internal", "credential"),
        (1, "f4", None, None, None),
        (2, "f5", "Owner", "internal", None),
        (2, "f6", "owner", "internal", None),
        (3, "zz", "Login", None, None),
    ]
    fields = spark.createDataFrame(rows, "schema long, id string, name string, sensitivity string, role string")
    aliases = {"account": ["account id"], "login": ["login", "owner"], "owner": ["owner"]}
    got = {(r.schema, r.target): (r.source_id, r.status) for r in reports.resolved(fields, aliases, {}, normalize_name).collect()}
    assert got[1, "account"] == ("f1", "alias") and got[1, "login"] == (None, "ambiguous") and got[1, "owner"] == (None, "secret")
    assert got[2, "login"] == (None, "ambiguous") and got[3, "login"] == ("zz", "alias") and got[3, "owner"] == (None, "none")
    # What an override takes is not there for the others.
    got = {(r.schema, r.target): (r.source_id, r.status) for r in reports.resolved(fields, aliases, {"owner": "f5", "account": "Owner"}, normalize_name).collect()}
    assert got[2, "owner"] == ("f5", "override") and got[2, "account"] == (None, "reused") and got[2, "login"] == ("f6", "alias")
    assert got[1, "owner"] == (None, "not_unique") and got[1, "account"] == (None, "secret")
    with pytest.raises(ValueError):
        reports.resolved(fields, aliases, {"other": "f1"}, normalize_name)


def test_atomic_events(spark):
    cases = [(0, 4), (1, 4), (5, 4), (4001, 2001), (2001, 3000), (999, 1000), (1000, 1000)]

    def cut(n):
        return n // 1000 + (n % 1000 > 1)

    df = spark.createDataFrame(cases, "r long, b long")
    got = [x[0] for x in df.select(reports.atomic_events(F.col("r"), F.col("b"))).collect()]
    assert got == [r // b * cut(b) + cut(r % b) for r, b in cases]
