"""Claims and leases in a state store: micro-batches, a restart, timers and fences."""

import datetime

import duckdb
import pytest

from weftline import queries
from weftline.streaming import leases

MINUTE = 60_000
DDL = "identity string, seq long, at timestamp, action string, digest string, plan string, token string, contract boolean"


def _at(minute):
    return datetime.datetime(2026, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


def _run(spark, root, rows, rules, ddl=DDL, identity=("identity",)):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(ddl).parquet(f"{root}/in")
    leases.run(source, list(identity), rules, f"{root}/out", f"{root}/checkpoint", "0 seconds")
    return spark.read.parquet(f"{root}/out")


def test_a_lapsed_claim_is_recovered_after_a_restart_and_the_old_token_is_fenced(spark, tmp_path):
    rules = leases.ledger_rules(5 * MINUTE)
    claim = lambda who, seq, minute, action, token, digest="d": (who, seq, _at(minute), action, digest, "p", token, True)
    first = [claim("a", 1, 0, "claim", "t1"), claim("b", 2, 1, "claim", "t1"), claim("a", 3, 2, "claim", "t2"), claim("b", 4, 3, "start_write", "t1"), claim(None, 5, 3, "claim", "t"), claim("late", 6, 30, "claim", "t1")]
    out = _run(spark, tmp_path, first, rules)
    got = {r["seq"]: r["outcome"] for r in out.filter("seq is not null").collect()}
    assert got == {1: "new", 2: "new", 3: "in_progress", 4: "accepted", 5: "new", 6: "new"}
    # The watermark stands at minute 30: the claims of a and of the null identity have run out, b is writing, late is live.
    assert sorted((r["identity"] or "", r["outcome"]) for r in out.filter("seq is null").collect()) == [("", "expired"), ("a", "expired")]
    second = [claim("a", 10, 31, "claim", "t2"), claim("a", 11, 32, "start_write", "t1"), claim("a", 12, 33, "start_write", "t2"), claim("a", 13, 34, "commit", "t2"), claim("a", 14, 35, "claim", "t3"), claim("a", 15, 36, "claim", "t3", "other")]
    second += [claim("b", 16, 31, "claim", "t2"), claim("b", 17, 32, "rearm", "t2"), claim("b", 18, 33, "start_write", "t1"), claim("x", 19, 33, "commit", "t1")]
    got = {r["seq"]: r["outcome"] for r in _run(spark, tmp_path, second, rules).filter("seq >= 10").collect()}
    assert got == {10: "recovered", 11: "fenced", 12: "accepted", 13: "accepted", 14: "already_committed", 15: "replay_detected", 16: "ambiguous", 17: "rearmed", 18: "refused", 19: "unknown"}
    held = {r["identity"]: (r["state"], r["token"], r["claims"]) for r in leases.held(spark, f"{tmp_path}/checkpoint").collect()}
    assert held == {"a": ("committed", "t2", 2), "b": ("replay_claimed", "t2", 2), None: ("claimed", "t", 1), "late": ("claimed", "t1", 1)}


def test_leases_leave_the_state_when_they_run_out_and_settled_identities_when_told_so(spark, tmp_path):
    ddl = "route string, seq long, at timestamp, action string, holder string"
    rows = [("r", 1, _at(0), "claim", "h1"), ("r", 2, _at(1), "claim", "h2"), ("r", 3, _at(2), "renew", "h1"), ("s", 4, _at(2), "claim", "h1"), ("s", 5, _at(3), "release", "h1"), ("t", 6, _at(20), "claim", "h3")]
    out = _run(spark, tmp_path / "leases", rows, leases.lease_rules(5 * MINUTE), ddl, ("route",))
    got = sorted((r["seq"] or 0, r["outcome"]) for r in out.collect())
    assert got == [(0, "expired"), (1, "claimed"), (2, "refused"), (3, "renewed"), (4, "claimed"), (5, "released"), (6, "claimed")]
    assert [r["route"] for r in leases.held(spark, f"{tmp_path}/leases/checkpoint").collect()] == ["t"]
    rules = leases.ledger_rules(5 * MINUTE, keep_ms=10 * MINUTE)
    rows = [("a", 1, _at(0), "claim", "d", "p", "t", True), ("a", 2, _at(1), "start_write", "d", "p", "t", True), ("a", 3, _at(2), "commit", "d", "p", "t", True), ("b", 4, _at(40), "claim", "d", "p", "t", True)]
    _run(spark, tmp_path / "ledger", rows, rules)
    assert [r["identity"] for r in leases.held(spark, f"{tmp_path}/ledger/checkpoint").collect()] == ["b"]
    out = _run(spark, tmp_path / "ledger", [("a", 9, _at(41), "claim", "d2", "p", "t", True)], rules)
    assert [r["outcome"] for r in out.filter("seq = 9").collect()] == ["new"]


@pytest.mark.parametrize("name", ["ledger_stream", "ledger_stream_state", "route_lease_stream", "checkpoint_stream"])
def test_replayed_halves_equal_the_fold_of_all_requests(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    found = con.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, sf).select(columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(found.fetchall(), key=repr)
