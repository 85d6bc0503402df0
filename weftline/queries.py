"""Registry of the engine's queries over the driver tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import transforms, types
from weftline.operators import chunking, matching, metrics, nearest, quality, state
from weftline.plans import mapping
from weftline.plans.derived import duck, view
from weftline.session import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- mapping, lookups, preflight

ORDERS_SOURCE = mapping.Schema(
    "orders-source",
    (
        mapping.Field("key", "Order Number", "string", False, role="natural_key"),
        mapping.Field("price", "Total", "decimal", False),
        mapping.Field("customer", "Customer Number", "string", False, role="natural_key"),
    ),
)
ORDERS_TARGET = mapping.Schema(
    "orders-target",
    (
        mapping.Field("order_id", "order_id", "integer", False, role="primary_key"),
        mapping.Field("total", "total", "decimal", False),
        mapping.Field("customer_id", "customer_id", "integer", True, role="foreign_key"),
    ),
    (mapping.Relation("customer_id", "customer", "c_custkey", (("c_name", "string"),)),),
)
ORDERS_PLAN = mapping.plan_for(
    ORDERS_SOURCE,
    ORDERS_TARGET,
    (
        mapping.Rule("key", "order_id", "parse_integer"),
        mapping.Rule("price", "total"),
        mapping.Rule("customer", "customer_id", "lookup_foreign_key", (("lookup_key", "c_name"),)),
    ),
)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a source: keys as text, customers by business key."""
    business = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").alias("price"), business.alias("customer"))


def _customers(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {"customer_id": (table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey")}


@query("""select o_orderkey as order_id, o_totalprice as total, c_custkey as customer_id from orders left join customer on c_custkey = o_custkey""")
def map_orders_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.project(_orders(spark, sf_dir), ORDERS_PLAN, _customers(spark, sf_dir))


@query(f"""select o_orderkey, c_custkey as customer_id, case when customer_business_key is null then 'null_probe' when c_custkey is null then 'unmatched' else 'matched' end as status
from {duck("fk_probe")} p left join customer on c_name = customer_business_key""")
def fk_lookup_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension, key, returned = _customers(spark, sf_dir)["customer_id"]
    found = mapping.lookup(view(spark, sf_dir, "fk_probe"), "customer_business_key", dimension, key, returned, "customer_id")
    return found.select("o_orderkey", "customer_id", F.col("customer_id_status").alias("status"))


@query(f"""select customer_business_key, count(*) as n from {duck("fk_probe")} p where customer_business_key is not null
and not exists (select 1 from customer where c_name = customer_business_key) group by 1""")
def fk_lookup_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = view(spark, sf_dir, "fk_probe").filter("customer_business_key is not null")
    counts = probe.groupBy("customer_business_key").agg(F.count(F.lit(1)).alias("n"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("customer_business_key"))
    return counts.join(customers, "customer_business_key", "left_anti")


@query("""select 'c_name' as key_field, count(*) as distinct_keys, count(*) filter (where n > 1) as repeated_keys, max(n) as most from (select c_name, count(*) as n from customer group by 1) q
union all select 'c_nationkey', count(*), count(*) filter (where n > 1), max(n) from (select c_nationkey, count(*) as n from customer group by 1) q""")
def fk_key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")

    def of(name: str) -> DataFrame:
        counts = customers.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(F.lit(name).alias("key_field"), F.count(F.lit(1)).alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.max("n").alias("most"))

    return of("c_name").unionByName(of("c_nationkey"))


@query(f"""select c_custkey, trim(name_raw) as name from {duck("dirty_customer")} q""")
def transform_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "dirty_customer").select("c_custkey", transforms.trim(F.col("name_raw")).value.alias("name"))


_INT = r"""case when key_raw is null or key_raw = '' then null when regexp_full_match(trim(key_raw), '[+-]?[0-9]+') then cast(trim(key_raw) as bigint) end"""


@query(f"""select o_orderkey, {_INT} as value, case when key_raw is not null and key_raw <> '' and {_INT} is null then 'source_transform_failed' end as error from {duck("text_orders")} q""")
def transform_parse_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = transforms.parse_integer(F.col("key_raw"))
    return view(spark, sf_dir, "text_orders").select("o_orderkey", r.value.alias("value"), r.error.alias("error"))


_DEC = r"""try_cast(replace(replace(price_raw, '.', ''), ',', '.') as decimal(38,6))"""


@query(f"""select l_orderkey, l_linenumber, {_DEC} as value, case when {_DEC} is null then 'source_transform_failed' end as error from {duck("decimal_text")} q""")
def transform_parse_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = transforms.parse_decimal(F.col("price_raw"), ",", ".")
    return view(spark, sf_dir, "decimal_text").select("l_orderkey", "l_linenumber", r.value.alias("value"), r.error.alias("error"))


@query(f"""select o_orderkey, try_strptime(nullif(date_raw, ''), '%Y-%m-%d') as value,
case when date_raw <> '' and try_strptime(date_raw, '%Y-%m-%d') is null then 'source_transform_failed' end as error from {duck("order_dates_text")} q""")
def transform_parse_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = transforms.parse_datetime(F.col("date_raw"), "%Y-%m-%d")
    return view(spark, sf_dir, "order_dates_text").select("o_orderkey", r.value.cast("timestamp_ntz").alias("value"), r.error.alias("error"))


@query(f"""select o_orderkey, case when {_INT} is not null then 'ok' when key_raw is null or key_raw = '' then 'required_target_null' else 'source_transform_failed' end as outcome from {duck("text_orders")} q""")
def contract_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = mapping.Field("order_id", "order_id", "integer", False)
    r = transforms.parse_integer(F.col("key_raw"))
    met = mapping.meets(r.value, "bigint", field)
    return view(spark, sf_dir, "text_orders").select("o_orderkey", F.when(met, "ok").when(r.error.isNotNull(), r.error).otherwise("required_target_null").alias("outcome"))


def _preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = view(spark, sf_dir, "fk_probe").select("o_orderkey", F.col("customer_business_key").alias("customer"))
    keys = view(spark, sf_dir, "text_orders").select("o_orderkey", F.col("key_raw").alias("key"))
    price = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    rows = keys.join(probe, "o_orderkey").join(price, "o_orderkey")
    return mapping.preflight(rows, ORDERS_PLAN, ORDERS_SOURCE, ORDERS_TARGET, _customers(spark, sf_dir))


_FINDINGS = f"""select case when key_raw is null or key_raw = '' then 'required_target_null' else 'source_transform_failed' end as code, 'order_id' as field, 'blocking' as severity, o_orderkey
from {duck("text_orders")} q where {_INT} is null
union all select 'foreign_key_lookup_failed', 'customer_id', 'blocking', o_orderkey from {duck("fk_probe")} p
where customer_business_key is not null and not exists (select 1 from customer where c_name = customer_business_key)"""


@query(f"select code, field, severity, count(*) as n from ({_FINDINGS}) f group by 1, 2, 3")
def preflight_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.preflight_findings(_preflight(spark, sf_dir))


@query(f"""select (select count(*) from orders) as records_checked, count(distinct o_orderkey) as blocked_records, count(*) as findings, count(*) = 0 as valid, count(*) = 0 as promotable from ({_FINDINGS}) f""")
def preflight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.preflight_summary(_preflight(spark, sf_dir))


@query(f"""with f as ({_FINDINGS}), s as (select o_orderkey, min(code) as reason from f group by 1)
select coalesce(reason, 'none') as reason, case when reason is null then 'delivered' else 'quarantined' end as status, count(*) as n, count(*) filter (where o_orderkey % 2 = 0) as even_keys
from orders left join s using (o_orderkey) group by 1, 2""")
def write_outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.array_min(F.transform("findings", lambda f: f["code"]))
    rows = _preflight(spark, sf_dir).select("o_orderkey", F.coalesce(reason, F.lit("none")).alias("reason"))
    status = F.when(F.col("reason") == "none", "delivered").otherwise("quarantined")
    return rows.groupBy("reason", status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("even_keys"))


# ---- types, names, policy

_TYPE = """case when raw is null or trim(raw) = '' then 'unknown' when lower(trim(raw)) in ('true', 'false') then 'boolean'
when regexp_full_match(trim(raw), '[+-]?(0|[1-9][0-9]*)') then 'integer'
when regexp_full_match(trim(raw), '[+-]?([0-9]+\\.[0-9]+|[0-9]+[eE][+-]?[0-9]+|[0-9]+\\.[0-9]+[eE][+-]?[0-9]+)') then 'decimal'
when regexp_full_match(trim(raw), '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(trim(raw) as date) is not null then 'date' else 'string' end"""
_TEXTS = f"""select 'key_raw' as field, key_raw as raw from {duck("text_orders")} a union all select 'date_raw', date_raw from {duck("order_dates_text")} b
union all select 'price_raw', price_raw from {duck("decimal_text")} c union all select 'l_tax', cast(l_tax as varchar) from lineitem"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, c: view(spark, sf_dir, name).select(F.lit(c).alias("field"), F.col(c).alias("raw"))
    tax = table(spark, sf_dir, "lineitem").select(F.lit("l_tax").alias("field"), F.col("l_tax").cast("string").alias("raw"))
    return of("text_orders", "key_raw").unionByName(of("order_dates_text", "date_raw")).unionByName(of("decimal_text", "price_raw")).unionByName(tax)


@query(f"select field, {_TYPE} as data_type, count(*) as n from ({_TEXTS}) t group by 1, 2")
def textual_type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).groupBy("field", types.textual_type(F.col("raw")).alias("data_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with s as (select field, list(distinct t) filter (where t <> 'unknown') as ts, bool_or(t = 'unknown') as nullable from (select field, {_TYPE} as t from ({_TEXTS}) t) q group by 1)
select field, nullable, case when ts is null then 'unknown' when len(ts) = 1 then ts[1] when list_has_all(['integer', 'decimal'], ts) then 'decimal' when list_has_all(['date', 'datetime'], ts) then 'datetime'
when list_contains(ts, 'string') then 'string' else 'unknown' end as data_type from s""")
def column_type_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _texts(spark, sf_dir).groupBy("field").agg(F.collect_set(types.textual_type(F.col("raw"))).alias("seen"))
    return seen.select("field", F.array_contains("seen", "unknown").alias("nullable"), types.merged_type(F.col("seen")).alias("data_type"))


_NAMES = ("Customer Number", "E-Mail", "api_token", "IBAN", "Passwort", "order no", "Vorname", "unit price", "Tax ID", "Kennung", "notes", "Debitor Nr", "Access Token", "Birthday", "card number", "total")
#: What each name must be found to be, written down by hand.
_CLASSES = ("internal natural_key", "personal value", "secret credential", "confidential value", "secret credential", "internal natural_key", "personal value", "internal value", "confidential natural_key",
  "internal natural_key", "internal value", "internal natural_key", "secret credential", "personal value", "confidential natural_key", "internal value")
_CLASS_ROWS = ", ".join(f"({i}, '{n}', '{c.split()[0]}', '{c.split()[1]}')" for i, (n, c) in enumerate(zip(_NAMES, _CLASSES, strict=True)))


@query(f"""select p_partkey, name || ' ' || p_size as name, sensitivity, role from part join (values {_CLASS_ROWS}) v(i, name, sensitivity, role) on i = p_partkey % {len(_NAMES)}""")
def field_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field name for each part, from a vocabulary with a number behind it."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.get(names, (F.col("p_partkey") % len(_NAMES)).cast("int")), "p_size").alias("name"))
    return part.select("p_partkey", "name", types.sensitivity_of(F.col("name")).alias("sensitivity"), types.role_of(F.col("name")).alias("role"))


_RANKS = ", ".join(f"('{s}', {i})" for i, s in enumerate(types.SENSITIVITY))


_N = len(types.SENSITIVITY)


@query(f"""with r as (select * from (values {_RANKS}) v(s, r)), p as (select p_partkey, p_partkey % {_N} as a, p_partkey // {_N} % {_N} as b, ['copy', 'trim', 'opaque_forward'][p_partkey // {_N * _N} % 3 + 1] as transform from part)
select p_partkey, a.s as source, b.s as target, transform, b.r >= a.r and (a.s not in ('secret', 'opaque') or transform in ('copy', 'opaque_forward'))
and (transform = 'opaque_forward' or (a.s <> 'opaque' and b.s <> 'opaque')) as allowed from p join r a on a.r = p.a join r b on b.r = p.b""")
def route_policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route for each part: every pair of sensitivities with every transform comes up."""
    level, key = F.array(*[F.lit(x) for x in types.SENSITIVITY]), F.col("p_partkey")
    routes = table(spark, sf_dir, "part").select(
        key,
        F.get(level, (key % _N).cast("int")).alias("source"),
        F.get(level, (F.floor(key / _N) % _N).cast("int")).alias("target"),
        F.get(F.array(*map(F.lit, ("copy", "trim", "opaque_forward"))), (F.floor(key / (_N * _N)) % 3).cast("int")).alias("transform"),
    )
    return routes.withColumn("allowed", mapping.route_allowed_column(F.col("source"), F.col("target"), F.col("transform")))


# ---- quality

_Q = f"""select c_custkey, 'null_in_required_field' as code from {duck("dirty_customer")} a where name_raw is null
union all select c_custkey, 'empty_string' from {duck("dirty_customer")} b where name_raw = ''
union all select c_custkey, 'outer_whitespace' from {duck("dirty_customer")} c where name_raw <> '' and trim(name_raw) <> name_raw
union all select c_custkey, 'embedded_control_character' from {duck("dirty_customer")} d where contains(name_raw, chr(1))
union all select c_custkey, 'non_normalized_unicode' from {duck("dirty_customer")} e where nfc_normalize(name_raw) <> name_raw"""


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(view(spark, sf_dir, "dirty_customer"), "c_custkey", required=("name_raw",))


@query(f"select code, 'name_raw' as field, count(*) as n from ({_Q}) q group by 1")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.findings(view(spark, sf_dir, "dirty_customer"), required=("name_raw",))
    return found.groupBy("code", "field").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select code, 'name_raw' as field, count(*) as n, array_to_string(list_slice(list(c_custkey order by c_custkey), 1, 8), ',') as samples from ({_Q}) q group by 1""")
def quality_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


@query(f"select c_custkey, nullif(trim(nfc_normalize(name_raw)), '') as name_raw from {duck('dirty_customer')} q")
def cleaning_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("name_raw", "normalize_unicode_nfc"), ("name_raw", "trim_whitespace"), ("name_raw", "empty_to_null"), ("absent", "empty_to_null")]
    return quality.clean(view(spark, sf_dir, "dirty_customer"), rules)


@query(f"select doc_id, regexp_matches(cell, '^[ \\t\\r\\n]*[=+\\-@]') as formula_like from {duck('formula_text')} q")
def formula_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "formula_text").select("doc_id", quality.formula_like(F.col("cell")).alias("formula_like"))


# ---- matching

_PAIRS = (("customer number", "client no"), ("order date", "datum"), ("unit price", "preis netto"), ("e mail", "email"), ("invoice total", "rechnung betrag"), ("product name", "artikel bezeichnung"), ("tax", "vat"))
#: Of each pair: words (synonyms by group) that both have, and that either has, counted by hand.
_PAIR_COUNTS = ((2, 2), (1, 2), (1, 3), (1, 2), (2, 2), (2, 2), (0, 2))
_PAIR_ROWS = ", ".join(f"({i}, '{a}', '{b}', {c}, {e})" for i, ((a, b), (c, e)) in enumerate(zip(_PAIRS, _PAIR_COUNTS, strict=True)))


@query(f"""select p_partkey, a || ' x' || p_size % 3 as a, b || ' x' || p_partkey % 3 as b, round((common + (p_size % 3 = p_partkey % 3)::int) / (either + case when p_size % 3 = p_partkey % 3 then 1 else 2 end), 6) as jaccard
from part join (values {_PAIR_ROWS}) v(i, a, b, common, either) on i = p_partkey % {len(_PAIRS)}""")
def name_token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of names for each part; a word from the part's size and one from its key are added to them."""
    at = (F.col("p_partkey") % len(_PAIRS)).cast("int")
    side = lambda k, word: F.concat(F.get(F.array(*[F.lit(p[k]) for p in _PAIRS]), at), F.lit(" x"), word.cast("string"))
    pairs = table(spark, sf_dir, "part").select("p_partkey", side(0, F.col("p_size") % 3).alias("a"), side(1, F.col("p_partkey") % 3).alias("b"))
    of = lambda c: F.array_distinct(matching.tokens(matching.normalize_name(F.col(c))))
    return pairs.select("p_partkey", "a", "b", F.round(matching.jaccard(of("a"), of("b")), 6).alias("jaccard"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(length(x) - 1, 1)), lambda i: substr(x, i, 3)))"


@query(f"""with n as (select p_partkey, lower(p_name) as x, lower(p_brand || ' ' || p_type) as y from part), g as (select p_partkey, {_GRAMS} as a, {_GRAMS.replace("(x", "(y")} as b from n)
select p_partkey, len(list_intersect(a, b)) as common, len(list_distinct(list_concat(a, b))) as either from g""")
def char_ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("x"), F.lower(F.concat_ws(" ", "p_brand", "p_type")).alias("y"))
    a, b = matching.grams(F.col("x"), 3), matching.grams(F.col("y"), 3)
    return part.select("p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("common"), F.size(F.array_union(a, b)).cast("long").alias("either"))


_FIELDS = "pair string, id string, name string, aliases array<string>, data_type string, nullable boolean, sensitivity string, role string, position int"
_SOURCE_FIELDS = [
    ("p", "c1", "Customer Number", [], "string", False, "internal", "natural_key", 1),
    ("p", "c2", "Amount", ["Betrag"], "decimal", False, "internal", "value", 2),
    ("p", "c3", "Order Date", [], "date", True, "internal", "value", 3),
    ("p", "c4", "API Token", [], "string", True, "secret", "credential", 4),
    ("p", "c5", "Comment", [], "string", True, "internal", "value", 5),
]
_TARGET_FIELDS = [
    ("p", "customer_number", "customer_number", [], "string", False, "internal", "natural_key", 1),
    ("p", "amount", "amount", [], "decimal", False, "internal", "value", 2),
    ("p", "ordered_on", "date of order", ["Order Date"], "date", True, "internal", "value", 3),
    ("p", "api_token", "api token", [], "string", True, "secret", "credential", 4),
    ("p", "remark", "remark", [], "string", True, "internal", "value", 5),
]


def _fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A pair of schemas for each supplier. Of three, one has no target for amounts, and one whose order date may not be null."""
    kind = spark.createDataFrame([], _FIELDS).schema
    key = F.col("s_suppkey").cast("string")

    def rows(fields: list[tuple], keep: Column) -> DataFrame:
        made = F.array(*[F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(f.dataType).alias(f.name) for v, f in zip(r, kind, strict=True)]) for r in fields])
        each = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(made).alias("f")).filter(keep)
        pair = {"pair": F.concat(F.lit("p"), key), "id": F.concat(F.col("f.id"), F.lit(":"), key)}
        return each.select("s_suppkey", *[pair.get(f.name, F.col(f"f.{f.name}")).alias(f.name) for f in kind])

    target = rows(_TARGET_FIELDS, (F.col("s_suppkey") % 3 != 1) | (F.col("f.id") != "amount"))
    target = target.withColumn("nullable", F.col("nullable") & ~((F.col("s_suppkey") % 3 == 2) & F.col("id").startswith("ordered_on")))
    return rows(_SOURCE_FIELDS, F.lit(True)).drop("s_suppkey"), target.drop("s_suppkey")


#: What must be decided, by hand: all but the comment are clear; without a target amounts are blocked, and nulls need a review.
_DECIDED = """select s_suppkey as k, f || ':' || s_suppkey as source_id, case when t is null or (f = 'c2' and s_suppkey % 3 = 1) then null else t || ':' || s_suppkey end as target_id,
  case when t is null or (f = 'c2' and s_suppkey % 3 = 1) then 'blocked' when f = 'c3' and s_suppkey % 3 = 2 then 'review' else 'auto' end as status
  from supplier, (values ('c1', 'customer_number'), ('c2', 'amount'), ('c3', 'ordered_on'), ('c4', 'api_token'), ('c5', null)) v(f, t)"""


@query(f"""select source_id, target_id, status from ({_DECIDED}) d""")
def match_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _fields(spark, sf_dir)
    return matching.propose(source, target).select("source_id", "target_id", "status")


@query(f"""select count(*) as fields, count(*) filter (where status = 'auto') as automatic, 0::bigint as unsafe_automatic, 1.0::double as auto_precision,
round(count(*) filter (where status = 'auto') / count(*) filter (where target_id is not null), 6) as auto_coverage, 1.0::double as suggestion_accuracy from ({_DECIDED}) d""")
def mapping_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _fields(spark, sf_dir)
    aims = F.create_map(*[F.lit(x) for pair in zip(("c1", "c2", "c3", "c4"), ("customer_number", "amount", "ordered_on", "api_token"), strict=True) for x in pair])
    found = target.select(F.col("id").alias("expected"))
    labels = source.select(F.col("id").alias("source_id"), F.concat(F.try_element_at(aims, F.split_part("id", F.lit(":"), F.lit(1))), F.lit(":"), F.split_part("id", F.lit(":"), F.lit(2))).alias("expected"))
    labels = labels.join(found.withColumn("there", F.lit(True)), "expected", "left").select("source_id", F.when(F.col("there"), F.col("expected")).alias("expected"))
    return metrics.mapping_benchmark(matching.propose(source, target), labels)


@query("""with s as (select p_size as pair, 's' || p_partkey as source_id, p_name as t from part where p_partkey % 2 = 0), g as (select p_size as pair, 't' || p_partkey as target_id, p_name as t from part where p_partkey % 2 = 1),
m as (select distinct pair, source_id, target_id from s join g using (pair) where (s.t = g.t or split_part(s.t, ' ', 2) = 'ring' and split_part(g.t, ' ', 2) = 'ring') and s.t <> 'red widget' and g.t <> 'red widget')
select pair, source_id, min(target_id) as target_id from m group by 1, 2 having count(*) = 1""")
def glossary_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name but one is a term of a concept of its own; rings have a common one as well. Names are written in two ways."""
    part = table(spark, sf_dir, "part")
    source = part.filter("p_partkey % 2 = 0").selectExpr("p_size as pair", "concat('s', p_partkey) as id", "upper(p_name) as name")
    target = part.filter("p_partkey % 2 = 1").selectExpr("p_size as pair", "concat('t', p_partkey) as id", "replace(p_name, ' ', '_') as name")
    names = part.select("p_name").distinct().filter("p_name <> 'red widget'")
    terms = names.selectExpr("initcap(p_name) as term", "concat('own ', p_name) as concept").unionByName(names.filter("p_name like '% ring'").selectExpr("p_name as term", "'rings' as concept"))
    return matching.glossary_matches(source, target, terms).select("pair", "source_id", "target_id")


_OLD = "select cast(p_partkey as varchar(20)) as id, case when p_partkey % 11 = 0 then null else p_type end as data_type from part where p_partkey % 3 <> 0"
_NEW = "select cast(p_partkey as varchar(20)) as id, case when p_partkey % 22 = 0 then null when p_partkey % 7 = 0 then 'OTHER' else p_type end as data_type from part where p_partkey % 5 <> 0"


@query(f"""select coalesce(o.id, n.id) as id, case when o.id is null then 'added' when n.id is null then 'removed' when o.data_type is distinct from n.data_type then 'retyped' else 'kept' end as change
from ({_OLD}) o full join ({_NEW}) n on o.id = n.id""")
def schema_drift_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (spark.sql(text.replace("from part", "from {src}"), src=table(spark, sf_dir, "part")) for text in (_OLD, _NEW))
    return matching.drift(old, new)


@query("""with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0), s as (
select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score from q, embeddings e where e.vec_id <> q.vec_id)
select query_id, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s) r where place <= 4""")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest of each query vector (ids divisible by 20) among all vectors."""
    return nearest.topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, "vec_id", "embedding").found


# ---- events, runs, batches


@query("""select user_id, count(*) as events, count(*) - count(distinct event_id) as duplicate_ids, min(ts) as first_at, max(ts) as last_at,
arg_min(event_type, {'a': ts, 'b': event_id}) as first_type, arg_max(event_type, {'a': ts, 'b': event_id}) as last_type from events group by 1""")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.event_summary(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type")


@query("""select event_id, event_type in ('click', 'error', 'purchase', 'signup', 'view') and value >= 0 and user_id is not null and (event_type <> 'purchase' or value > 0) as valid from events""")
def event_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("event_type").isin("click", "error", "purchase", "signup", "view")
    valid = known & (F.col("value") >= 0) & F.col("user_id").isNotNull() & ((F.col("event_type") != "purchase") | (F.col("value") > 0))
    return table(spark, sf_dir, "events").select("event_id", valid.alias("valid"))


_OUTCOME = "case event_type when 'error' then 'rejected' when 'signup' then 'quarantined' else 'success' end"


@query(f"""with e as (select user_id, event_id, {_OUTCOME} as o from events), l as (select user_id, max(event_id) as x from e where o <> 'rejected' group by 1),
h as (select e.user_id, count(*) as runs, count(*) filter (where o = 'success') as successes, count(*) filter (where o = 'quarantined') as quarantined, count(*) filter (where o = 'rejected') as rejected,
arg_max(o, event_id) as last_outcome, count(*) filter (where o = 'rejected' and (x is null or event_id > x)) as streak from e left join l on l.user_id = e.user_id group by 1)
select *, case when streak >= 3 then 'suspended' when streak > 0 or last_outcome = 'quarantined' then 'degraded' else 'healthy' end as health from h""")
def recipe_health_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_OUTCOME).alias("outcome"))
    return state.recipe_health(runs, "user_id", "event_id", "outcome")


@query("""select event_type, count(*) as calls, round(sum(value), 4) as total, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(count(*) / sum(value), 6) as rate from events group by 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


_RUNS = "select cast(100 * (1 + l_linenumber % 4) as bigint) as batch_size, l_extendedprice / l_quantity as throughput, l_quantity as wall, cast(l_linenumber % 4 * 64 + l_quantity as bigint) as rss, l_returnflag <> 'R' as success from lineitem"
_PROFILE = f"""select batch_size, round(median(throughput), 6) as median_throughput, round(min(throughput), 6) as min_throughput, round(max(throughput), 6) as max_throughput,
round(median(wall), 6) as median_wall, max(rss) as max_rss, count(*) filter (where success) as successes, count(*) as runs from ({_RUNS}) q group by 1"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.batch_profile(spark.sql(_RUNS.replace("from lineitem", "from {t}"), t=table(spark, sf_dir, "lineitem")))


@query(_PROFILE)
def batch_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir)


@query(f"""with p as ({_PROFILE}), a as (select * from p where max_rss <= 200), n as (select * from a where median_throughput >= (select max(median_throughput) from a) * 0.98)
select case when count(*) = 0 then 'blocked' else 'recommended' end as status, arg_min(batch_size, (max_rss, batch_size)) as batch_size, (select min(max_rss) from p) as minimum_required from n""")
def batch_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recommend_batch(_profile(spark, sf_dir), 200)


@query("""select o_orderpriority, sum(f)::bigint as fields, sum(a)::bigint as accepted, sum(c)::bigint as corrected, sum(b)::bigint as abstained, count(*) filter (where a + c + b = f) as consistent, round(sum(f) / sum(m), 6) as fields_per_minute
from (select o_orderpriority, o_orderkey % 7 + 3 as f, o_orderkey % 7 as a, 2 as c, case when o_orderkey % 5 = 0 then 0 else 1 end as b, o_orderkey % 9 + 1 as m from orders) q group by 1""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderpriority", (k % 7 + 3).alias("fields"), (k % 7).alias("accepted"), F.lit(2).alias("corrected"), F.when(k % 5 == 0, 0).otherwise(1).alias("abstained"), (k % 9 + 1).alias("minutes")
    )
    return metrics.review_summary(rows, ["o_orderpriority"])


_PRECEDENCE = ("block", "signed_strip", "signature_impact", "unknown_signature", "impact_review", "review", "sanitize")
_ACTION = "case o_orderkey % 40 when 1 then 'block' when 2 then 'signed_strip' when 3 then 'signature_impact' when 4 then 'unknown_signature' when 5 then 'impact_review' when 6 then 'review' when 7 then 'sanitize' else 'pass' end"


@query(f"""with c as (select o_custkey, {", ".join(f"count(*) filter (where action = '{a}') as n_{a}" for a in _PRECEDENCE)} from (select o_custkey, {_ACTION} as action from orders) q group by 1)
select *, case {" ".join(f"when n_{a} > 0 then '{a}'" for a in _PRECEDENCE)} else 'pass' end as status from c""")
def metadata_policy_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.policy_status(table(spark, sf_dir, "orders").select("o_custkey", F.expr(_ACTION).alias("action")), "o_custkey")


# ---- state


@query("""select source, doc_id, running, place from (select source, doc_id, cast(sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) as bigint) as running,
cast(row_number() over (partition by source order by doc_id) as integer) as place from documents) q where running <= 50000 and place <= 20""")
def outbox_pending_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return state.pending_prefix(docs, ["source"], ["doc_id"], "n_chars", 50_000, 20).select("source", "doc_id", "running", "place")


@query("""with recursive d as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as i from documents),
c as (select source, doc_id, n_chars, i, 1 as n, n_chars as used, 1 as chunk from d where i = 1
union all select d.source, d.doc_id, d.n_chars, d.i, case when c.n >= 10 or c.used + d.n_chars > 20000 then 1 else c.n + 1 end, case when c.n >= 10 or c.used + d.n_chars > 20000 then d.n_chars else c.used + d.n_chars end,
case when c.n >= 10 or c.used + d.n_chars > 20000 then c.chunk + 1 else c.chunk end from c join d on d.source = c.source and d.i = c.i + 1) select source, doc_id, n_chars, chunk::bigint as chunk from c""")
def delivery_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 10, 20_000)


_FIRST = f"""select e.event_id, e.attempt, case when e.attempt = f.a then 'delivered' when e.event_type = f.t and e.user_id = f.u then 'duplicate' else 'replay_detected' end as status
from {duck("replay_events")} e join (select event_id, min(attempt) as a, arg_min(event_type, attempt) as t, arg_min(user_id, attempt) as u from {duck("replay_events")} q group by 1) f using (event_id)"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.concat_ws("\0", F.col("user_id").cast("string"), "event_type"), 256)
    return state.first_delivery(view(spark, sf_dir, "replay_events"), ["event_id"], digest, ["attempt"])


@query(f"select * from ({_FIRST}) q")
def ledger_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).select("event_id", "attempt", "status")


@query(f"select status, count(*) as n, count(distinct event_id) as identities from ({_FIRST}) q group by 1")
def ledger_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("identities"))


#: The transitions that the contract names, written out beside the operator's own table.
_TRANSITION_ROWS = """(null, 'claim', 'claimed', false), ('claimed', 'start_write', 'write_started', true), ('claimed', 'start_write_many', 'batch_write_started', true),
  ('replay_claimed', 'start_replay_write', 'replay_write_started', true), ('write_started', 'commit', 'committed', false), ('batch_write_started', 'commit', 'committed', false),
  ('replay_write_started', 'commit', 'committed', false), ('write_started', 'uncertain', 'uncertain', false), ('batch_write_started', 'uncertain', 'batch_uncertain', false),
  ('replay_write_started', 'uncertain', 'replay_uncertain', false), ('claimed', 'quarantine', 'quarantined', true), ('write_started', 'quarantine', 'quarantined', false),
  ('batch_write_started', 'quarantine', 'quarantined', false), ('replay_claimed', 'quarantine', 'replay_quarantined', true), ('replay_write_started', 'quarantine', 'replay_quarantined', false),
  ('quarantined', 'rearm', 'claimed', false), ('write_started', 'rearm', 'replay_claimed', false), ('batch_write_started', 'rearm', 'replay_claimed', false),
  ('replay_write_started', 'rearm', 'replay_claimed', false), ('uncertain', 'rearm', 'replay_claimed', false), ('batch_uncertain', 'rearm', 'replay_claimed', false),
  ('replay_uncertain', 'rearm', 'replay_claimed', false), ('replay_quarantined', 'rearm', 'replay_claimed', false)"""
_STATES = ("claimed", "replay_claimed", "write_started", "batch_write_started", "replay_write_started", "committed", "uncertain", "batch_uncertain", "replay_uncertain", "quarantined", "replay_quarantined", None)
_EVENTS = ("claim", "start_write", "start_write_many", "start_replay_write", "commit", "uncertain", "quarantine", "rearm")
_WORDS = lambda words: ", ".join("null" if w is None else f"'{w}'" for w in words)


@query(f"""with t as (select * from (values {_TRANSITION_ROWS}) v(s, e, n, live)),
a as (select event_id, [{_WORDS(_STATES)}][event_id % 12 + 1] as state, [{_WORDS(_EVENTS)}][event_id // 12 % 8 + 1] as event, user_id % 2 = 0 as claim_live from events)
select event_id, state, event, claim_live, n is not null and (not live or claim_live) as accepted, case when n is not null and (not live or claim_live) then n else state end as next_state from a left join t on s is not distinct from state and e = event""")
def ledger_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt for each event: every step from every state comes up, with a live claim and without."""
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), n.cast("int"))
    key = F.col("event_id")
    attempts = table(spark, sf_dir, "events").select("event_id", pick(_STATES, key % 12).alias("state"), pick(_EVENTS, F.floor(key / 12) % 8).alias("event"), (F.col("user_id") % 2 == 0).alias("claim_live"))
    return state.advance(spark, attempts).select("event_id", "state", "event", "claim_live", "accepted", "next_state")


@query(f"""select event_id, attempt, case when attempt = 1 then 'enqueued' when event_type not like '%-changed' then 'duplicate' else 'replay_detected' end as outcome from {duck("replay_events")} q""")
def relay_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = view(spark, sf_dir, "replay_events").withColumn("digest", F.col("event_type"))
    first = offers.filter("attempt = 1").select("event_id", "digest")
    nothing = first.select("event_id").limit(0)
    again = state.relay_offers(offers.filter("attempt > 1"), first, nothing, ["event_id"], "digest")
    new = state.relay_offers(offers.filter("attempt = 1"), first.limit(0), nothing, ["event_id"], "digest")
    return new.unionByName(again).select("event_id", "attempt", "outcome")


@query("""select o_custkey, o_orderkey, row_number() over w as generation, cast(sum(o_orderkey % 100) over (w rows unbounded preceding) as bigint) as committed_records from orders window w as (partition by o_custkey order by o_orderkey)""")
def checkpoint_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 100).alias("committed"))
    return state.checkpoints(runs, "o_custkey", ["o_orderkey"], "committed").select("o_custkey", "o_orderkey", "generation", "committed_records")


@query("""select o_orderkey, sha256('{"customer":' || o_custkey || ',"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') as record_digest from orders""")
def record_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    canonical = F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(canonical, 256).alias("record_digest"))


@query("""select o_orderkey, sha256('tenant' || chr(0) || 'orders' || chr(0) || cast(o_custkey as varchar) || chr(0) || cast(o_orderkey as varchar)) as idempotency_key from orders""")
def idempotency_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = F.concat_ws("\0", F.lit("tenant"), F.lit("orders"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(identity, 256).alias("idempotency_key"))


@query("""with recursive o as (select user_id, event_id, coalesce(props, '') as p, row_number() over (partition by user_id order by event_id) as n, event_id % 101 <> 5 as kept from events),
c as (select user_id, n, sha256(repeat('0', 64) || chr(0) || p) as h from o where n = 1 union all select o.user_id, o.n, sha256(c.h || chr(0) || o.p) from c join o on o.user_id = c.user_id and o.n = c.n + 1),
k as (select o.*, h, max(o.n) filter (where kept) over (partition by o.user_id) as last_kept from o join c on c.user_id = o.user_id and c.n = o.n)
select user_id, count(*) filter (where kept) as events, not bool_or((kept and event_id % 97 = 3) or (not kept and n < last_kept)) as intact, arg_max(h, n) filter (where kept) as head from k where last_kept is not null group by 1""")
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain for each user is built in order, some events are then forged and others lost, and it is verified in parallel.
    A chain that lost its end alone still verifies, and its head tells."""
    root = f"{shared_dir(spark)}/chain"
    state.chain(table(spark, sf_dir, "events").select("user_id", "event_id", "props"), "user_id", "event_id", "props").write.parquet(root)
    built = spark.read.parquet(root)
    held = built.filter("event_id % 101 <> 5").withColumn("props", F.expr("if(event_id % 97 = 3, concat(props, '!'), props)"))
    found = state.verify_chain(held, "user_id", "props").groupBy("user_id")
    return found.agg(F.count(F.lit(1)).alias("events"), F.bool_and("linked").alias("intact"), F.max_by("event_hash", "sequence").alias("head"))


@query("""select o_orderkey, o_orderdate + interval 1 day + to_seconds(cast(('0x' || left(sha256(cast(o_orderkey as varchar)), 16))::ubigint::hugeint % 301 as integer)) as next_due from orders""")
def schedule_next_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    jitter = metrics.unsigned_mod(F.sha2(F.col("o_orderkey").cast("string"), 256), 301)
    orders = table(spark, sf_dir, "orders").withColumn("jitter", jitter.cast("int"))
    return orders.select("o_orderkey", F.expr("cast(o_orderdate as timestamp) + interval 1 day + make_dt_interval(0, 0, 0, jitter)").cast("timestamp_ntz").alias("next_due"))


@query("""select o_custkey, max(o_orderkey) as o_orderkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1""")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


# ---- scalars on tables


_ORIGIN = r"""regexp_extract(lower(url), '^(https?)://', 1) || '://' || regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]+)', 1), case when url like 'https%' then ':443$' else ':80$' end, '')"""


@query(f"select page_id, {_ORIGIN} as origin from pages")
def origin_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.functions.scalars import origin

    return table(spark, sf_dir, "pages").select("page_id", origin(F.col("url")).alias("origin"))


@query(f"""select origin, row_number() over (order by origin) as entry, n from (select {_ORIGIN} as origin, count(*) as n from pages group by 1) q""")
def inventory_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.functions.scalars import numbered, origin

    counts = table(spark, sf_dir, "pages").groupBy(origin(F.col("url")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, "origin", "entry")


@query("""select event_id, cast(json_extract_string(props, '/k') as bigint) as k, case when json_exists(props, '/missing') then null else 'pointer_missing' end as missing_error from events""")
def json_pointer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.functions.scalars import json_pointer

    k, gone = json_pointer(F.col("props"), "/k"), json_pointer(F.col("props"), "/missing")
    return table(spark, sf_dir, "events").select("event_id", k.value.cast("long").alias("k"), gone.error.alias("missing_error"))


#: Every twentieth text is its words with commas, in lines of five, as the texts hold few tables.
_CELLS = """select doc_id, case when doc_id % 20 = 0 then regexp_replace(replace(text, ' ', ','), '(([^,]*,){{5}})', '{0}') else text end as text from {1}"""
_LINES = r"list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')[1:40], lambda x: regexp_matches(x, '[^\s\x0b]'))"
_COUNTS = [f"list_filter(list_transform(ls, lambda x: len(x) - len(replace(x, {c}, ''))), lambda n: n > 0)" for c in ("','", "';'", "chr(9)", "'|'")]


@query(f"""with t as ({_CELLS.format("##", "documents").replace("'##'", "concat(chr(92), '1', chr(10)), 'g'")}), q as (select doc_id, {_LINES} as ls from t), m as (select doc_id, ls, unnest([{", ".join(_COUNTS)}]) as c from q),
d as (select doc_id, bool_or(len(ls) >= 2 and len(c) >= greatest(2, floor(0.8 * len(ls))) and list_max(list_transform(list_distinct(c), lambda n: len(list_filter(c, lambda k: k = n)))) >= 0.75 * len(c)) as found from m group by 1)
select doc_id, coalesce(found, false) as delimited from t left join d using (doc_id)""")
def delimited_text_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.sources.files import delimited

    cells = F.when(F.col("doc_id") % 20 == 0, F.regexp_replace(F.replace("text", F.lit(" "), F.lit(",")), "(([^,]*,){5})", "$1\n")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", delimited(cells).alias("delimited"))


@query("""select o_orderkey from orders where o_orderkey % 3 <> 0""")
def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return state.pending(orders, orders.filter("o_orderkey % 3 = 0"), "o_orderkey")


@query("""select o_orderkey from orders where o_orderstatus = 'O' and o_custkey % 4 = 1 and o_orderpriority in ('1-URGENT', '2-HIGH')""")
def route_binding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("tenant"), (F.col("o_custkey") % 4).cast("string").alias("destination"), F.col("o_orderpriority").alias("plan_digest")
    )
    return state.bound(records, "O", "1", ("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("""select count(*) filter (where o_orderkey % 10 = 0) as missing, 0::bigint as unexpected, count(*) filter (where o_orderkey % 10 <> 0 and o_orderkey % 7 = 0) as differing from orders""")
def workflow_end_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    actual = expected.filter("o_orderkey % 10 <> 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(F.col("o_custkey")))
    return state.end_state(expected, actual, ["o_orderkey"])


@query("""select user_id, min(case when rn = 1 then event_type end) = max(case when rn = 1 then event_type end) and count(*) > 0 and min(case when rn = 1 then event_type end) = 'view' and max(case when rn = n then event_type end) in ('purchase')
and count(*) filter (where event_type = 'view') = 1 and count(*) filter (where event_type = 'purchase') = 1 as valid
from (select user_id, event_type, row_number() over (partition by user_id order by event_id) as rn, count(*) over (partition by user_id) as n from events) q group by 1""")
def run_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.lifecycle(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "view", ("purchase",))


@query("""select field, distinct_keys, uniq as unique, nulls from (
select 'o_orderkey' as field, count(distinct o_orderkey) as distinct_keys, count(*) = count(distinct o_orderkey) as uniq, count(*) - count(o_orderkey) as nulls from orders
union all select 'o_custkey', count(distinct o_custkey), count(*) = count(distinct o_custkey), count(*) - count(o_custkey) from orders) q""")
def lookup_key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.sources.database import unique_keys

    return unique_keys(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"])


@query(f"""select source_id, target_id, case when source_id like 'c4:%' then 'opaque_forward' else 'copy' end as transform from ({_DECIDED}) d where status = 'auto'""")
def plan_from_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the matcher compiled to the rules of each supplier's plan."""
    from weftline.plans import planning

    source, target = _fields(spark, sf_dir)
    return planning.rules(matching.propose(source, target), source, target).select("source_id", "target_id", "transform")


from weftline import state_queries as _state_queries  # noqa: E402,F401  its queries register themselves here
from weftline import report_queries as _report_queries  # noqa: E402,F401
from weftline import stream_queries as _stream_queries  # noqa: E402,F401
from weftline import review_queries as _review_queries  # noqa: E402,F401
