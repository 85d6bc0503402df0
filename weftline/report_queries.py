"""Queries of the ranker, the texts of events, the gate over reports and the choice of columns, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import ranking, reports
from weftline.operators.matching import normalize_name
from weftline.queries import query
from weftline.session import table


def _sql(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    return spark.sql(text.replace(f"from {name}", "from {src}"), src=table(spark, sf_dir, name))


# ---- the lexical ranker. Its edit similarity and word pairs are no SQL: the query's model leaves them out, a test holds them.

_RANKED = """select concat('S', cast(p_size as varchar(9)), '-', cast(p_partkey - p_partkey % 1000 as varchar(20))) as source_id, concat(p_type, ' ', case when p_size % 2 = 0 then 'redWidget' else 'blue_bolt' end) as source_text,
  concat('T', cast(p_partkey as varchar(20))) as target_id, case when p_partkey % 31 = 0 then null else concat(p_name, ' | ', p_type, ' | ', p_brand) end as target_text, p_partkey, p_size from part"""
_NAMED = {"bias": -1.5, "exact": 2.0, "overlap": 1.25, "length": 0.25, "char2": 0.5, "char3": 0.75}
_BARE = "list_aggregate(regexp_extract_all(lower(regexp_replace(coalesce({0}, ''), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9_]+'), 'string_agg', ' ')"
_LETTERS = "list_distinct(list_transform(range(1, greatest(len({0}) - {1} + 2, 1)), lambda i: substr({0}, i, {1})))"


def _share(one: str, two: str) -> str:
    return f"len(list_intersect({one}, {two})) / greatest(1, len(list_distinct(list_concat({one}, {two}))))"


@query(f"""with c as (select * from ({_RANKED}) x), k as (select source_id, min(source_text) as source_text from c group by 1),
n as (select c.source_id, target_id, coalesce({_BARE.format("k.source_text")}, '') as a, coalesce({_BARE.format("target_text")}, '') as b from c join k using (source_id)),
w as (select *, list_filter(list_distinct(string_split(a, ' ')), lambda x: x <> '') as l, list_filter(list_distinct(string_split(b, ' ')), lambda x: x <> '') as r from n),
s as (select *, -1.5 + 2.0 * (a = b and a <> '')::int + 1.25 * {_share("l", "r")} + 0.25 * least(len(a), len(b)) / greatest(1, len(a), len(b))
  + 0.5 * {_share(_LETTERS.format("a", 2), _LETTERS.format("b", 2))} + 0.75 * {_share(_LETTERS.format("a", 3), _LETTERS.format("b", 3))} as z from w)
select source_id, target_id, round(1 / (1 + exp(-z::double)), 9) as rank_score from s""")
def lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as candidates of one field for each size and thousand of parts, so that a field's candidates stay within their bound."""
    rows = _sql(spark, sf_dir, _RANKED, "part").drop("p_partkey", "p_size")
    of = rows.groupBy("source_id").agg(F.min("source_text").alias("source_text"))
    found = ranking.ranked(rows.drop("source_text").join(of, "source_id"), ranking.model(_NAMED))
    return found.select("source_id", "target_id", F.round("rank_score", 9).alias("rank_score"))


# ---- texts of events

_CATALOG = (
    ("error", "en", "user {user} failed with {value} at {place}"),
    ("error", "de", "Fehler {value} bei {{{user}}}"),
    ("click", "en", "{user} clicked {{twice}}"),
    ("view", "de", "gesehen von {user}"),
)
_MESSAGES = """select event_id, case when event_id % 13 = 0 then null else event_type end as kind, case event_id % 4 when 0 then 'de-AT' when 1 then 'EN_us' when 2 then 'fr' end as locale,
  case when event_id % 3 = 0 then null else cast(user_id as varchar(20)) end as who, cast(user_id % 5 as varchar(20)) as amount from events"""


@query(f"""with e as ({_MESSAGES}), c as (select * from (values {", ".join(f"('{k}', '{x}', '{t}')" for k, x, t in _CATALOG)}) v(kind, language, template)),
j as (select e.*, case when e.kind is null then null else coalesce(c.template, e.kind) end as t from e left join c on e.kind = c.kind and c.language = case when locale like 'de%' then 'de' else 'en' end)
select event_id, replace(replace(replace(replace(replace(replace(t, '{{{{', chr(1)), '{{user}}', coalesce(who, '{{user}}')), '{{value}}', amount), '}}}}', chr(2)), chr(1), '{{'), chr(2), '}}') as message from j""")
def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _sql(spark, sf_dir, _MESSAGES, "events").withColumn("given", F.create_map(F.lit("user"), "who", F.lit("value"), "amount"))
    catalog = spark.createDataFrame(list(_CATALOG), "message_key string, language string, template string")
    return reports.messages(events, catalog, "kind", "locale", "given").select("event_id", "message")


# ---- the gate over reports of runs, one for each customer with orders

_EQUAL = ("records_read", "records_staged", "records_relayed", "records_leased", "records_delivered", "records_acknowledged")
_KEPT = ("destination_rows", "ledger_committed")
_ZERO = ("outbox_depth", "relay_depth", "quarantine_depth", "mismatch_count")
_TRUE = ("content_verified", "known_plaintext_canaries_absent", "audit_signatures_verified")
_VALID = ("stream_valid", "run_closed", "workflow_lifecycle_valid", "event_ids_unique", "event_contract_valid", "workflow_counts_valid")
_REQUIRED = ("source_seal_and_outbox_stage", "outbox_reload_and_relay_enqueue", "relay_lease", "destination_delivery", "acknowledgements")
_OF_RUN = "(select o_custkey as run, count(*) as n from orders group by o_custkey) q"
_REPORTS = f"""select run, n as records, 4 as batch_size, run % 29 <> 0 as success, case when run % 31 = 0 then 'lost' end as failure, run % 37 <> 0 as signed_audit,
  case when run % 41 = 0 then 'traced' else 'standard' end as mode, run % 43 = 0 as tracing, 'standard' as resource_mode, case when run % 47 = 0 then null else false end as resource_tracing,
  n + case when run % 53 = 0 then 1 else 0 end as result_count, cast(ceil(n / 4.0) as bigint) - case when run % 59 = 0 then 1 else 0 end as batches_completed,
  {", ".join(f"n - case when run % {11 + 2 * i} = 0 then 1 else 0 end as {c}" for i, c in enumerate(_EQUAL + _KEPT))},
  {", ".join(f"case when run % {13 + 3 * i} = 0 then 1 else 0 end as {c}" for i, c in enumerate(_ZERO))},
  {", ".join(f"case when run % {17 + 2 * i} = 0 then null else run % {23 + i} <> 0 end as {c}" for i, c in enumerate(_TRUE + _VALID))},
  n + case when run % 61 = 0 then 1 else 0 end as audit_events, n as delivery_events,
  case when n < 2 then null else (n - n % 4) / 4 + case when n % 4 > 1 then 1 else 0 end end as delivery_batch_events,
  case when run % 67 = 0 then null else cast(run % 9 as double) end as throughput, cast(run % 70 as double) * 1000 as wall_ms, cast(run % 8 as bigint) * 104857600 as peak_bytes from {_OF_RUN}"""
_STAGE_ROWS = f"""select run, 'relay_lease' as name, case when run % 5 = 0 then 'failed' else 'passed' end as status, case when run % 7 = 0 then 'slow' end as reason_code,
  cast(ceil(n / 4.0) as bigint) as calls, n - case when run % 3 = 0 then 1 else 0 end as items from {_OF_RUN} where run % 19 <> 0 union all
  {" union all ".join(f"select run, '{c}', 'passed', null, cast(ceil(n / 4.0) as bigint) + case when run % {6 + i} = 0 then 1 else 0 end, n from {_OF_RUN} where run % {19 + i} <> 0" for i, c in enumerate(x for x in _REQUIRED if x != "relay_lease"))}"""


def _unless(code: str, holds: str) -> str:
    return f"case when {holds} then null else '{code}' end"


_CODES = [
    _unless("workflow_not_successful", "success and failure is null"),
    _unless("configuration_signed_audit_disabled", "signed_audit"),
    _unless("measurement_mode_not_comparable", "mode = 'standard' and not tracing"),
    _unless("resource_measurement_mode_not_comparable", "resource_mode = 'standard' and not resource_tracing"),
    _unless("resource_result_count_mismatch", "result_count = records"),
    _unless("progress_batch_count_mismatch", "batches_completed = batches"),
    *[_unless(f"progress_{c}_mismatch", f"{c} = records") for c in _EQUAL],
    *[_unless(f"final_{c}_mismatch", f"{c} = records") for c in _KEPT],
    *[_unless(f"final_{c}_not_zero", f"{c} = 0") for c in _ZERO],
    *[_unless(f"final_{c}_false", c) for c in _TRUE],
    *[_unless(f"observability_{c}_false", c) for c in _VALID],
    _unless("final_audit_event_count_mismatch", "audit_events = records"),
    _unless("observability_delivery_event_count_mismatch", "delivery_events = records"),
    _unless("observability_delivery_batch_event_count_mismatch", "coalesce(delivery_batch_events, 0) = records // 4 + (records % 4 > 1)::int"),
    _unless("throughput_below_floor", "throughput >= 2"),
    _unless("throughput_not_positive", "throughput > 0"),
    _unless("wall_time_above_ceiling", "wall_ms <= 60000"),
    _unless("wall_time_not_positive", "wall_ms > 0"),
    _unless("peak_rss_above_ceiling", "peak_bytes <= 536870912"),
    _unless("peak_rss_not_positive", "peak_bytes > 0"),
]


@query(f"""with r as (select *, cast(ceil(records / 4.0) as bigint) as batches from ({_REPORTS}) x), s as ({_STAGE_ROWS}),
own as (select run, unnest([{", ".join(_CODES)}]) as code from r),
need as (select run, records, batches, unnest([{", ".join(f"'{c}'" for c in _REQUIRED)}]) as name from r),
each as (select * from own union all select run, concat('stage_', name, '_not_passed') from s where not (status = 'passed' and reason_code is null)
  union all select n.run, concat('stage_', n.name, '_missing') from need n left join s using (run, name) where s.status is null
  union all select n.run, concat('stage_', n.name, '_call_count_mismatch') from need n join s using (run, name) where calls <> batches
  union all select n.run, concat('stage_', n.name, '_item_count_mismatch') from need n join s using (run, name) where items <> records)
select run, coalesce(string_agg(code, ',' order by code), '') as failures, count(code) = 0 as passed from each group by run""")
def performance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.gate(_sql(spark, sf_dir, _REPORTS, "orders"), _sql(spark, sf_dir, _STAGE_ROWS, "orders"), "run", 2.0, 60.0, 512.0, batch_expected=4)
    return found.select("run", F.array_join("failures", ",").alias("failures"), "passed")


# ---- columns of inventories for fixed targets, one inventory for each part size

_INVENTORY = """select p_size as inventory, concat('f', cast(p_partkey as varchar(20))) as id, case p_partkey % 23 when 0 then 'Account-ID' when 1 then 'login' when 2 then 'Password Policy' when 3 then 'Owner' when 4 then 'User_Name'
  else concat('x', cast(p_partkey as varchar(20))) end as name, case when p_partkey % 46 in (1, 2) then 'secret' else 'internal' end as sensitivity, case when p_partkey % 69 = 3 then 'credential' else 'attribute' end as role from part"""
_TARGETS = {"account": ["account id", "login"], "owner": ["owner"], "policy": ["password policy"], "label": ["user name"]}


@query(f"""with f as (select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as bare, sensitivity = 'secret' or role = 'credential' as barred from ({_INVENTORY}) x),
t as (select * from (values {", ".join(f"('{t}', '{a}')" for t, names in _TARGETS.items() for a in names)}) v(target, bare)),
o as (select inventory, count(*) filter (where name = 'Owner') as n, any_value(id) filter (where name = 'Owner') as id, bool_or(barred) filter (where name = 'Owner') as barred from f group by 1),
m as (select i.inventory, t.target, count(f.id) as n, any_value(f.id) as id, bool_or(f.barred and not (t.target = 'policy')) as barred from (select distinct inventory from f) i cross join (select * from t where target <> 'owner') t
  left join f on f.inventory = i.inventory and f.bare = t.bare group by 1, 2),
u as (select inventory, 'owner' as target, id, case when n <> 1 then 'not_unique' when barred then 'secret' else 'override' end as status from o
  union all select inventory, target, id, case when n > 1 then 'ambiguous' when n = 0 then 'none' when barred then 'secret' else 'alias' end from m)
select inventory, target, case when status in ('override', 'alias') then id end as source_id, status from u""")
def inventory_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _sql(spark, sf_dir, _INVENTORY, "part").withColumnRenamed("inventory", "schema")
    found = reports.resolved(fields, _TARGETS, {"owner": "Owner"}, normalize_name, harmless={"policy": ("password policy",)})
    return found.withColumnRenamed("schema", "inventory")
