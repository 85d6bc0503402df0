"""The engine's operators on small golden inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars, transforms, types
from weftline.operators import matching, quality, state
from weftline.plans import mapping
from weftline.sources import database, delimited, files, http_json
from weftline.streaming import delivery


def test_transforms(spark):
    df = spark.createDataFrame([(" 42 ",), ("1_2",), ("1.0",), ("",), ("  ",), (None,), ("-7",), ("99999999999999999999",)], "t string")
    r = transforms.parse_integer(F.col("t"))
    got = [(x["v"], x["e"]) for x in df.select(r.value.alias("v"), r.error.alias("e")).collect()]
    bad = transforms.FAILED
    assert got == [(42, None), (None, bad), (None, bad), (None, None), (None, bad), (None, None), (-7, None), (None, bad)]
    df = spark.createDataFrame([("1.234,50",), ("x",), (None,)], "t string")
    r = transforms.parse_decimal(F.col("t"), ",", ".", 2)
    assert [(str(x[0]) if x[0] is not None else None, x[1]) for x in df.select(r.value, r.error).collect()] == [("1234.50", None), (None, bad), (None, None)]
    assert spark.range(1).select(types.strip(F.lit(" \x1c a "))).first()[0] == "a"
    sealed = transforms.opaque_forward(F.lit("v"), F.lit("0123456789abcdef"), F.lit("ctx")).value
    opened = F.aes_decrypt(sealed, F.lit("0123456789abcdef"), F.lit("GCM"), F.lit("DEFAULT"), F.lit("ctx")).cast("string")
    assert spark.range(1).select(opened).first()[0] == "v"


def test_textual_types(spark):
    cases = {"007": "string", ".5": "string", "5.": "string", "03/04/2026": "string", "1e5": "decimal", "1.5": "decimal", "-12": "integer", "TRUE": "boolean", "2026-01-31": "date", "2026-02-31": "string", "2026-01-31T10:00:00": "datetime", "00000000000000000000000000000001": "uuid", " ": "unknown", "{12345678-1234-1234-1234-123456789abc}": "uuid"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", types.textual_type(F.col("t"))).collect()} == cases


def test_plan_validation_and_digest():
    from weftline.queries import ORDERS_PLAN, ORDERS_SOURCE, ORDERS_TARGET

    assert mapping.validate(ORDERS_PLAN, ORDERS_SOURCE, ORDERS_TARGET) == []
    bad = mapping.plan_for(ORDERS_SOURCE, ORDERS_TARGET, (mapping.Rule("key", "order_id"), mapping.Rule("gone", "order_id", "magic")))
    codes = {f.code for f in mapping.validate(bad, ORDERS_SOURCE, ORDERS_TARGET)}
    assert codes == {"type_mismatch", "unknown_source_field", "duplicate_target", "unknown_transform", "required_target_unmapped"}
    assert len(ORDERS_PLAN.digest()) == 64
    renamed = mapping.Schema("other", ORDERS_SOURCE.fields, ORDERS_SOURCE.relations)
    assert renamed.structural() == ORDERS_SOURCE.structural() and renamed.exact() != ORDERS_SOURCE.exact()


def test_lookup_and_preflight(spark):
    dim = spark.createDataFrame([(7, "00042"), (8, "x"), (9, "x")], "id int, k string")
    probe = spark.createDataFrame([(1, "00042"), (2, "nope"), (3, None), (4, "x")], "n int, p string")
    got = {r["n"]: (r["c"], r["c_status"]) for r in mapping.lookup(probe, "p", dim, "k", "id", "c").collect()}
    assert got == {1: (7, "matched"), 2: (None, "unmatched"), 3: (None, "null_probe"), 4: (None, "not_unique")}
    got = {r["n"]: r["c_status"] for r in mapping.lookup(probe, "p", dim, "k", "id", "c", broadcast_rows=0).collect()}
    assert got[1] == "matched" and got[3] == "null_probe"
    with pytest.raises(TypeError):
        mapping.lookup(probe, "n", dim, "k", "id", "c")


def test_quality_and_cleaning(spark):
    df = spark.createDataFrame([("  Café  ", 1.0), ("", float("nan")), (None, 2.0)], "label string, v double")
    codes = {(r["code"], r["field"]) for r in quality.findings(df, required=("label", "id")).collect()}
    assert codes == {("outer_whitespace", "label"), ("non_normalized_unicode", "label"), ("empty_string", "label"), ("null_in_required_field", "label"), ("missing_required_field", "id"), ("non_finite_number", "v")}
    rules = [("label", "normalize_unicode_nfc"), ("label", "trim_whitespace"), ("label", "empty_to_null")]
    assert sorted((r[0] for r in quality.clean(df, rules).collect()), key=str) == ["Café", None, None]


def test_matching_names(spark):
    df = spark.createDataFrame([("orderDate",), ("Größe_Nr",), ("ÉTAT-civil",)], "n string")
    assert [r[0] for r in df.select(matching.normalize_name(F.col("n"))).collect()] == ["order date", "grosse nr", "etat civil"]
    assert matching.plain_name("ordersID") == "orders id"


def test_chains_and_keys(spark):
    df = spark.createDataFrame([("a", i, f"e{i}") for i in range(5)] + [("b", 0, None)], "s string, o int, e string")
    built = state.chain(df, "s", "o", "e").cache()
    assert state.verify_chain(built, "s", "e").filter("not linked").count() == 0
    broken = built.withColumn("e", F.when(F.col("sequence") == 3, "forged").otherwise(F.col("e")))
    assert [r["sequence"] for r in state.verify_chain(broken, "s", "e").filter("not linked").collect()] == [3]
    keys = spark.createDataFrame([("r", 1, "k1", None, 1), ("r", 2, "k2", "k1", 2), ("r", 3, "k2", "k2", 3)], "s string, generation int, key_id string, previous_key_id string, issued_at int")
    assert {r["generation"]: r["trusted"] for r in state.key_chain(keys, "s").collect()} == {1: True, 2: False, 3: False}


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿Debitor Nr;Amount;;Amount\n000042;"a;b\nc";x;1\nDebitor Nr;Amount;;Amount\n;;;\n000043;"say ""hi""";;\n', encoding="utf-8")
    df = delimited.read(spark, str(p))
    assert [f.metadata["name"] for f in df.schema.fields] == ["Debitor Nr", "Amount", "column_3", "Amount [2]"]
    assert [tuple(r) for r in df.collect()] == [("000042", "a;b\nc", "x", "1"), ("000043", 'say "hi"', None, None)]
    with pytest.raises(ValueError):
        delimited.append(spark.createDataFrame([("=1+1",)], "a string"), str(tmp_path / "out"))
    delimited.append(spark.createDataFrame([("ok",)], "a string"), str(tmp_path / "out"))
    delimited.append(spark.createDataFrame([("ok2",)], "a string"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    assert delimited.detect_delimiter(spark, "a\tb\n1\t2\n") == "\t"
    with pytest.raises(delimited.AmbiguousDialect):
        delimited.detect_delimiter(spark, "")


def test_json_and_content(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('[{"b": 1, "a": "x"}, {"a": null}]')
    rows = files.json_columns(files.read_json(spark, str(tmp_path / "j"))).orderBy("record_number").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("x", "1"), (None, None)]
    for bad in ('{"a":1,"a":2}', '{"a":NaN}', "[1]", '"x"', "{a:1}"):
        with pytest.raises(ValueError):
            files.json_records(bad)
    assert files.content_kind(b"a,b\n1,2\n3,4\n") == "csv"
    assert files.content_kind(b"%PDF-1.7") == "pdf" and files.content_kind(b'{"a": 1}') == "json" and files.content_kind(b"hello") == "text"
    assert {r["kind"]: r["reader"] for r in files.inspect(spark, str(tmp_path / "j")).collect()} == {"json": "json"}
    events = tmp_path / "e.jsonl"
    events.write_text('{"schema_version":1,"event_id":"1","component":"c","event_type":"t","item_count":2}\n{"event_id":"1","event_id":"2"}\nnope\n')
    assert sorted(r["valid"] for r in files.read_events(spark, str(events)).collect()) == [False, False, True]


def test_xlsx(spark, tmp_path):
    cells = "<row><c r='A1' t='inlineStr'><is><t>Report</t></is></c></row><row><c t='inlineStr'><is><t>Name</t></is></c><c t='inlineStr'><is><t>Value</t></is></c></row><row><c t='inlineStr'><is><t>a</t></is></c><c><v>1</v></c></row><row><c t='inlineStr'><is><t>b</t></is></c><c><v>2.5</v></c></row>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(raw.getvalue())
    assert files.content_kind(raw.getvalue()) == "xlsx"
    assert [r["fields"] for r in files.read_xlsx(spark, str(tmp_path / "b.xlsx")).collect()] == [{"Name": "a", "Value": "1"}, {"Name": "b", "Value": "2.5"}]


def test_http_pages():
    replies = {"": '{"items":[{"i":1}],"next":"a"}', "a": '{"items":[{"i":2}],"next":""}'}
    fetch = lambda url: replies[url.partition("cursor=")[2].partition("&")[0]]
    assert [r["i"] for r in http_json.pages(fetch, "https://x/y", "/items", "cursor", cursor="/next")] == [1, 2]
    with pytest.raises(ValueError):
        list(http_json.pages(lambda u: '{"items":[1],"next":"a"}', "https://x", "/items", "cursor", cursor="/next"))


def test_database_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert database.write_batch(df, str(tmp_path / "t"), ["id"], ["id", "v"]) == 2
    with pytest.raises(ValueError):
        database.write_batch(df.unionByName(df), str(tmp_path / "t"), ["id"], ["id", "v"])
    keys = {r["field"]: r["unique"] for r in database.unique_keys(df.unionByName(spark.createDataFrame([(3, "a")], "id int, v string")), ["id", "v"]).collect()}
    assert keys == {"id": True, "v": False}


def test_streaming_delivery(spark, tmp_path):
    src, ledger, target, mark = (str(tmp_path / x) for x in ("src", "ledger", "target", "mark"))
    schema = "k string, d string, n int"

    def push(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        stream = spark.readStream.schema(schema).json(src)
        delivery.deliver(stream, ledger, target, mark, ["k"], "d", ["n"]).awaitTermination(120)

    push([("a", "1", 1), ("a", "1", 2), ("b", "2", 3)])
    push([("a", "1", 4), ("b", "9", 5), ("c", "3", 6)])
    assert sorted((r["k"], r["d"]) for r in spark.read.parquet(target).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    counts = {r["status"]: r["count"] for r in spark.read.parquet(ledger).groupBy("status").count().collect()}
    assert counts == {"delivered": 3, "duplicate": 2, "replay_detected": 1}


def test_first_delivery_of_ties_and_nulls(spark):
    rows = [(None, "a", 1), (None, "a", 1), (None, "b", 2), ("x", "a", 1), ("x", "a", 1), ("x", "a", 3)]
    df = spark.createDataFrame(rows, "k string, d string, n int")
    got = sorted((r["k"] or "", r["d"], r["n"], r["status"]) for r in state.first_delivery(df, ["k"], F.col("d"), ["n"]).collect())
    assert got == sorted([("", "a", 1, "delivered"), ("", "a", 1, "duplicate"), ("", "b", 2, "replay_detected"), ("x", "a", 1, "delivered"), ("x", "a", 1, "duplicate"), ("x", "a", 3, "duplicate")])


def test_dialects_of_several_files(spark):
    samples = {"comma": 'a,b\n1,"x;y\nz"\n3,4\n', "semicolon": "a;b;c\n1;2;3\n4;;6\n", "pipe": "a|b\n1|2\n", "one": "a\nb\nc\n", "both": "a,b;c\n1,2;3\n"}
    df = spark.createDataFrame(list(samples.items()), "name string, sample string")
    got = {r["name"]: (r["delimiter"], r["problem"]) for r in delimited.chosen(delimited.dialects(df)).collect()}
    assert got == {"comma": (",", None), "semicolon": (";", None), "pipe": ("|", None), "one": (",", None), "both": (",", "ambiguous")}


def test_scalars(spark):
    df = spark.createDataFrame([(-7, "HTTPS://Example.org:443/x"), (12345, "ftp://a")], "v int, u string")
    rows = df.select(scalars.padded_integer(F.col("v"), 4), scalars.origin(F.col("u")), scalars.choice(F.lit(" A "), ("a",), "a").value).collect()
    assert [tuple(r) for r in rows] == [("-0007", "https://example.org", "a"), ("12345", None, "a")]
    assert [r["n"] for r in scalars.numbered(spark.range(50).withColumnRenamed("id", "x"), "x", "n").orderBy("x").collect()] == list(range(1, 51))


def test_planning_repair_and_recipes(spark, tmp_path):
    from weftline.plans import planning
    from weftline.queries import ORDERS_SOURCE, ORDERS_TARGET

    plan = planning.build(ORDERS_SOURCE, ORDERS_TARGET, [("price", "total", "auto"), ("customer", "customer_id", "review")], allow_review=True)
    assert [r.transform for r in plan.rules] == ["copy", "copy"]
    with pytest.raises(planning.PlanRefused):
        planning.build(ORDERS_SOURCE, ORDERS_TARGET, [("key", "order_id", "auto")])
    moved = mapping.Schema("orders-source", (mapping.Field("k", "order number", "string", False, role="natural_key"), mapping.Field("price", "Total", "integer", False), ORDERS_SOURCE.fields[2]))
    first = mapping.plan_for(ORDERS_SOURCE, ORDERS_TARGET, (mapping.Rule("key", "order_id", "parse_integer"), mapping.Rule("price", "total")))
    fixed, findings = planning.repair(first, ORDERS_SOURCE, moved, ORDERS_TARGET)
    assert [r.source for r in fixed.rules] == ["k", "price"] and fixed.version == 2
    assert {(f.code, f.severity) for f in findings} == {("field_moved", "safe"), ("field_type_changed", "review")}
    planning.recipe(spark, "r", first, ORDERS_SOURCE, ORDERS_TARGET, "me").write.parquet(str(tmp_path / "recipes"))
    stored = spark.read.parquet(str(tmp_path / "recipes"))
    assert planning.rebind(stored, ORDERS_SOURCE, ORDERS_TARGET).rules == first.rules
    assert planning.rebind(stored, moved, ORDERS_TARGET) is None


def test_percentiles_in_two_levels(spark):
    from weftline.operators import metrics

    df = spark.range(3000).selectExpr("case when id % 3 = 2 then null else id % 3 end as k", "cast(case when id % 4 = 0 then 5 else id * 37 % 1009 end as double) as v", "cast(id as double) as w")
    df = df.unionByName(spark.createDataFrame([(0, None, 1.0), (7, 3.0, 2.0), (8, None, None)], "k long, v double, w double"))
    points = {"a": ("v", 0.5), "b": ("v", 0.95), "c": ("v", 0.0), "d": ("v", 1.0), "e": ("w", 0.333)}
    rows = lambda held: {r["k"]: tuple(None if x is None else round(x, 9) for x in (r[n] for n in points)) for r in metrics.percentiles(df, ["k"], points, held).collect()}
    assert rows(0) == rows(10_000) and len(rows(0)) == 5
