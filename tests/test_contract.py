"""The driver's contract holds with and without the text operators."""

import duckdb

import __spark_entry__ as entry


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["order_id", "total", "customer_id"]
    assert rows.count() == 1500


def test_oracles_belong_to_queries_and_agree_on_columns(spark, sf):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    con = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "events", "documents", "pages", "part", "embeddings"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name in ("map_orders_to_target", "fk_lookup_resolve", "quality_report", "ledger_dedupe", "checkpoint_advance", "preflight_findings", "column_type_merge"):
        found = con.execute(oracles[name])
        columns = [c[0] for c in found.description]
        want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()), key=repr)
        df = queries[name](spark, sf)
        got = sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr)
        assert sorted(df.columns) == sorted(columns)
        assert got == want, name


def test_lookup_joins_are_planned_once(spark, sf):
    plan = entry.queries()["map_orders_to_target"](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
