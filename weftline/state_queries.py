"""Queries of the life-cycle operators over the driver tables, with SQL that computes the same by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import contracts, lifecycle, metrics
from weftline.queries import query
from weftline.session import table

NOW = 100

#: State tables made from the driver's rows, as SQL that both engines read. Some identities are null.
LEDGER = """select case when u = 7 then null else u end as identity, concat('d', cast(u % 5 as varchar(9))) as digest, 'p1' as plan,
  case u % 7 when 0 then 'committed' when 1 then 'claimed' when 2 then 'claimed' when 3 then 'write_started' when 4 then 'replay_claimed' when 5 then 'quarantined' else 'uncertain' end as state,
  case when u % 21 = 1 then null else concat('t', cast(u as varchar(9))) end as token, case when u % 3 = 0 then 50 when u % 3 = 1 then 200 else 100 end as lease_until, u % 2 = 0 as has_contract
  from (select distinct user_id as u from events where user_id % 4 <> 1) q"""
REQUESTS = """select case when user_id = 7 then null else user_id end as identity, event_id as seq, concat('d', cast(case when event_type = 'error' then 9 else user_id % 5 end as varchar(9))) as digest,
  'p1' as plan, concat('n', cast(event_id as varchar(20))) as token from events"""
QUEUE = """select event_id as seq, case when event_id % 11 = 0 then null else event_id end as identity, concat('d', cast(event_id as varchar(20))) as digest,
  concat('d', cast(case when event_id % 13 = 0 then -1 else event_id end as varchar(20))) as body_digest, event_id % 17 <> 0 as wire_ok, event_id % 19 <> 0 as source_ok, event_id % 23 <> 0 as policy_ok,
  case when event_id % 29 = 0 then 99 else 101 end as expires_at, case when event_id % 5 = 0 then 150 when event_id % 5 = 1 then 100 end as lease_until, concat('t', cast(event_id % 3 as varchar(9))) as token from events"""


def _sql(spark: SparkSession, sf_dir: str, text: str, name: str = "events") -> DataFrame:
    return spark.sql(text.replace(f"from {name}", "from {src}"), src=table(spark, sf_dir, name))


@query(f"""with l as ({LEDGER}), r as ({REQUESTS}), w as (
  select r.*, l.state as hs, l.digest as hd, l.plan as hp, l.token as ht, l.lease_until as hl, row_number() over (partition by r.identity order by seq) as rn,
    first_value(r.digest) over (partition by r.identity order by seq) as fd from r left join l on r.identity is not distinct from l.identity
), o as (select *, case when hs is null then case when rn = 1 then 'new' when digest = fd then 'in_progress' else 'replay_detected' end
  when digest <> hd or plan <> hp then 'replay_detected' when hs = 'committed' then 'already_committed'
  when hs in ('claimed', 'replay_claimed') and hl > {NOW} then 'in_progress' when hs = 'claimed' and ht is not null then 'recovered' else 'ambiguous' end as o1 from w
), p as (select *, row_number() over (partition by identity, o1 order by seq) as on_ from o),
q as (select *, case when o1 = 'recovered' and on_ > 1 then 'in_progress' else o1 end as outcome from p)
select identity, seq, outcome, case when outcome in ('new', 'recovered') then 'claimed' else hs end as next_state, case when outcome in ('new', 'recovered') then token else ht end as next_token,
  case when outcome in ('new', 'recovered') then {NOW} + 300 else hl end as next_lease_until from q""")
def ledger_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.claims(_sql(spark, sf_dir, LEDGER), _sql(spark, sf_dir, REQUESTS), ["identity"], "seq", F.lit(NOW), 300)
    return found.select("identity", "seq", "outcome", "next_state", "next_token", "next_lease_until")


_WRITES = f"""select identity, digest, plan, case when identity % 3 = 0 then 'x' else token end as token, 'claimed' as from_state from ({LEDGER}) l"""


@query(f"""select w.identity, coalesce(w.token = l.token and l.state = 'claimed' and l.lease_until > {NOW}, false) as holds from ({_WRITES}) w join ({LEDGER}) l on w.identity is not distinct from l.identity""")
def ledger_write_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = _sql(spark, sf_dir, _WRITES)
    return lifecycle.fenced(_sql(spark, sf_dir, LEDGER), writes, ["identity"], F.lit(NOW)).select("identity", "holds")


@query(f"""select identity, case when state = 'committed' then 'refused_committed' when state in ('claimed', 'replay_claimed') and lease_until > {NOW} then 'refused_active'
when state in ('write_started', 'uncertain') and not has_contract then 'refused_contract' else 'allowed' end as replay,
case when state = 'committed' or (state in ('claimed', 'replay_claimed') and lease_until > {NOW}) or (state in ('write_started', 'uncertain') and not has_contract) then state
when state = 'quarantined' then 'claimed' else 'replay_claimed' end as next_state from ({LEDGER}) l""")
def ledger_replay_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.replays(_sql(spark, sf_dir, LEDGER), F.lit(NOW)).select("identity", "replay", "next_state")


@query(f"""with q as (select *, lease_until is null or lease_until <= {NOW} as free, case when not wire_ok then 'relay_wire_invalid' when not source_ok then 'relay_source_authentication_failed'
  when {NOW} > expires_at then 'relay_transfer_expired' when not policy_ok then 'relay_policy_rejected' when digest <> body_digest then 'relay_digest_mismatch' end as why from ({QUEUE}) x
), r as (select *, row_number() over (partition by free, why is null order by seq) as rn from q)
select seq, case when not free then 'held' when why is null and rn <= 500 then 'leased' when why is not null and rn <= 400 then 'dead_letter' else 'waiting' end as status,
case when free then why end as reason, case when free and why is null and rn <= 500 then {NOW} + 60 else lease_until end as next_lease_until from r""")
def relay_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.relay_lease(_sql(spark, sf_dir, QUEUE), "seq", F.lit(NOW), 500, 60, most_dead=400).select("seq", "status", "reason", "next_lease_until")


_ANSWERS = """select event_id as identity, event_id as seq, concat('t', cast(event_id % 2 as varchar(9))) as token, case when event_id % 4 = 0 then 'release' else 'ack' end as action from events where event_id % 11 <> 0 and event_id % 2 = 0"""


@query(f"""select a.seq, case when a.token = q.token and q.lease_until > {NOW} then case when action = 'ack' then 'acked' else 'released' end else 'lost' end as outcome
from ({_ANSWERS}) a left join ({QUEUE}) q on a.identity = q.identity""")
def relay_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _sql(spark, sf_dir, QUEUE).filter("identity is not null")
    return lifecycle.relay_settle(queue, _sql(spark, sf_dir, _ANSWERS), ["identity"], F.lit(NOW)).select("seq", "outcome")


@query(f"""select 'queue' as store, token, count(*) as depth from ({QUEUE}) q group by 2 union all select 'dead_letters', token, count(*) from ({QUEUE}) q where not wire_ok group by 2""")
def queue_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _sql(spark, sf_dir, QUEUE)
    return lifecycle.depths({"queue": queue, "dead_letters": queue.filter("not wire_ok")}, ["token"])


@query(f"""select seq, digest from ({QUEUE}) q where not wire_ok order by seq desc, digest limit 25""")
def dead_letter_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.listing(_sql(spark, sf_dir, QUEUE).filter("not wire_ok").select("seq", "digest"), [F.desc("seq"), F.col("digest")], 25)


CHECKPOINTS = """select case when u = 7 then null else u end as route, u % 4 + 1 as generation, concat('r', cast(u % 3 as varchar(9))) as run_id, 'c1' as receipt_digest, u * 10 as committed_total from (select distinct user_id as u from events where user_id % 3 <> 1) q"""
PROPOSALS = """select case when user_id = 7 then null else user_id end as route, event_id as seq, (event_id % 4) as expected_generation, concat('r', cast(event_id % 5 as varchar(9))) as run_id,
  case when event_id % 2 = 0 then 'c1' else 'c2' end as receipt_digest, event_id % 9 as committed from events"""


@query(f"""with j as (select p.*, coalesce(c.generation, 0) as g, c.run_id as cr, c.receipt_digest as cd, coalesce(c.committed_total, 0) as ct from ({PROPOSALS}) p left join ({CHECKPOINTS}) c on p.route is not distinct from c.route
), o as (select *, case when run_id = cr then case when receipt_digest = cd then 'repeated' else 'receipt_conflict' end when expected_generation = g then 'advanced' else 'stale' end as o1 from j
), r as (select *, row_number() over (partition by route, o1 order by seq) as rn from o), f as (select *, case when o1 = 'advanced' and rn > 1 then 'stale' else o1 end as outcome from r)
select route, seq, outcome, g + case when outcome = 'advanced' then 1 else 0 end as next_generation, ct + case when outcome = 'advanced' then committed else 0 end as committed_total from f""")
def checkpoint_compare_and_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.advance_checkpoints(_sql(spark, sf_dir, CHECKPOINTS), _sql(spark, sf_dir, PROPOSALS), ["route"], "seq")
    return found.select("route", "seq", "outcome", "next_generation", "committed_total")


LEASES = """select u as route, concat('h', cast(u % 4 as varchar(9))) as holder, cast(case when u % 3 = 0 then 90 else 130 end as bigint) as until from (select distinct user_id as u from events where user_id % 5 <> 2) q"""
LEASE_REQUESTS = """select user_id as route, event_id as seq, concat('h', cast(event_id % 4 as varchar(9))) as holder, case event_id % 3 when 0 then 'claim' when 1 then 'renew' else 'release' end as action from events"""


@query(f"""with j as (select r.*, l.holder as lh, l.until as lu, l.until is null or l.until <= {NOW} as free from ({LEASE_REQUESTS}) r left join ({LEASES}) l on r.route = l.route
), o as (select *, case when action = 'claim' and (free or holder = lh) then 'claimed' when not free and holder = lh and action = 'renew' then 'renewed' when not free and holder = lh and action = 'release' then 'released' else 'refused' end as o1 from j
), r as (select *, row_number() over (partition by route, o1 order by seq) as rn from o), f as (select *, case when o1 = 'claimed' and free and rn > 1 then 'refused' else o1 end as outcome from r)
select route, seq, outcome, case when outcome in ('claimed', 'renewed') then {NOW} + 30 when outcome = 'released' then null else lu end as next_until from f""")
def run_lease_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.run_leases(_sql(spark, sf_dir, LEASES), _sql(spark, sf_dir, LEASE_REQUESTS), ["route"], "seq", F.lit(NOW), 30)
    return found.select("route", "seq", "outcome", "next_until")


_RUNS = """select o_orderkey as run_id, case when o_orderkey % 5 = 0 then 'failed' else 'completed' end as status, o_custkey % 50 as delivered, o_orderkey % 3 as duplicate,
  case when o_orderkey % 11 = 0 then 1 else 0 end as quarantined, 0 as ambiguous, o_custkey % 50 + o_orderkey % 3 + case when o_orderkey % 13 = 0 then 1 else 0 end as total from orders"""


@query(f"""select run_id, delivered + duplicate as committed, sha256(concat_ws(':', run_id, delivered, duplicate, total)) as receipt_digest from ({_RUNS}) r
where status = 'completed' and delivered + duplicate = total and quarantined = 0""")
def commit_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.commit_receipts(_sql(spark, sf_dir, _RUNS, "orders"))


_STORED = """select user_id as identity, max(event_id) as seen, 'old' as reason, count(*) as attempts from events where event_id % 3 = 0 group by user_id"""
_INCOMING = """select user_id as identity, max(event_id) as seen, 'new' as reason, count(*) as attempts from events where event_id % 3 = 1 and user_id % 2 = 0 group by user_id"""


@query(f"""with u as (select *, 0 as fresh from ({_STORED}) s union all select *, 1 from ({_INCOMING}) i), k as (select *, row_number() over (partition by identity order by fresh desc, seen desc) as rn, sum(attempts) over (partition by identity) as n from u)
select identity, seen, reason, n::bigint as attempts from k where rn = 1 and identity % 10 <> 3""")
def quarantine_after_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lifecycle.quarantine_upsert(_sql(spark, sf_dir, _STORED), _sql(spark, sf_dir, _INCOMING), ["identity"], "seen")
    settled = table(spark, sf_dir, "events").select(F.col("user_id").alias("identity")).filter("identity % 10 = 3")
    return lifecycle.quarantine_remove(held, settled, ["identity"])


_AUDIT = """select event_id, event_type, case when event_id % 4 = 0 then 'rejected' else 'ok' end as status, case when event_id % 4 = 0 then concat('r', cast(event_id % 3 as varchar(9))) end as reason,
  case when event_id % 2 = 0 then 'sig' end as signature, user_id % 10 as stream, props from events"""


@query(" union all ".join(f"select '{f}' as field, cast({f} as varchar) as value, count(*) as n, count(signature) as signed, count(*) - count(signature) as unsigned, min(event_id) as first_at, max(event_id) as last_at from ({_AUDIT}) a group by 2" for f in ("event_type", "status", "reason")))
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.audit_summary(_sql(spark, sf_dir, _AUDIT), "event_id", "signature", ["event_type", "status", "reason"])


@query(f"""with u as (select stream, count(*) as events, sum(strlen(props))::bigint as logical_bytes from ({_AUDIT}) a group by 1), i as (select stream, count(*) as events, sum(strlen(props))::bigint as logical_bytes from ({_AUDIT}) a where event_id % 3 = 0 group by 1),
t as (select stream, sum(events)::bigint as events, sum(logical_bytes)::bigint as logical_bytes from (select * from u union all select * from i) x group by 1) select *, events <= 900 and logical_bytes <= 10000 as accepted from t""")
def audit_append_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _sql(spark, sf_dir, _AUDIT)
    usage = lambda df: lifecycle.audit_usage(df, ["stream"], "props")
    return lifecycle.audit_quota(usage(events), usage(events.filter("event_id % 3 = 0")), ["stream"], 900, 10_000)


@query("""select count(*) as records, sum(strlen(props))::bigint as bytes, case when count(*) > 100000000 then 'records' when sum(strlen(props)) > 1000 then 'bytes' end as exceeded from events""")
def batch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.budget(table(spark, sf_dir, "events"), F.octet_length("props"), 100_000_000, 1_000)


_FIELD_SETS = """select event_id, case event_id % 4 when 0 then concat(left(props, length(props) - 1), ', "extra": 1, "b": null', chr(125)) when 1 then concat(chr(123), chr(125)) when 2 then null else props end as body from events"""


@query(f"""select missing, unexpected, count(*) as records from (select case when event_id % 4 in (1, 2) then ['k'] else [] end as missing, case when event_id % 4 = 0 then ['b', 'extra'] else [] end as unexpected from ({_FIELD_SETS}) b) q group by 1, 2""")
def mapped_field_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field names of each event's own record against the one that is expected."""
    return lifecycle.field_sets(_sql(spark, sf_dir, _FIELD_SETS), F.json_object_keys("body"), ["k"])


_OPERATIONAL = """select event_id, case event_id % 7 when 0 then 'workflow_started' when 1 then 'workflow_completed' when 2 then 'batch_completed' when 3 then 'stage_summary' when 4 then 'delivery' when 5 then 'delivery_batch' else 'other' end as event_type,
  case when event_id % 7 = 3 then 'relay_lease' when event_id % 7 in (4, 5) then 'destination_runtime' else 'workflow_benchmark' end as component,
  case user_id % 6 when 0 then 'started' when 1 then 'passed' when 2 then 'failed' when 3 then 'delivered' when 4 then 'quarantined' else 'duplicate' end as status,
  case when user_id % 5 = 0 then 'sealed_spool_cleanup_failed' when user_id % 5 = 1 then 'write_not_committed' end as reason_code,
  case when event_id % 10 < 7 then 1 when event_id % 10 = 7 then 0 when event_id % 10 = 8 then 4 end as item_count, case when event_id % 3 > 0 then value end as duration_ms from events"""


@query(f"""select event_id, coalesce(case event_type
  when 'workflow_started' then status = 'started' and reason_code is null and item_count is not null
  when 'workflow_completed' then status in ('passed', 'failed') and (status = 'passed') = (reason_code is null) and item_count is not null
  when 'batch_completed' then status = 'passed' and reason_code is null and item_count > 0
  when 'stage_summary' then status in ('passed', 'failed') and (status = 'passed') = (reason_code is null) and item_count is not null and duration_ms is not null
  when 'delivery' then ((status in ('delivered', 'duplicate') and coalesce(reason_code, 'sealed_spool_cleanup_failed') = 'sealed_spool_cleanup_failed') or (status = 'quarantined' and reason_code is not null)) and item_count = 1
  when 'delivery_batch' then ((status = 'delivered' and coalesce(reason_code, 'sealed_spool_cleanup_failed') = 'sealed_spool_cleanup_failed') or (status = 'quarantined' and reason_code is not null)) and item_count > 0
  else false end, false) as valid from ({_OPERATIONAL}) e""")
def operational_event_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.events_judged(_sql(spark, sf_dir, _OPERATIONAL)).select("event_id", "valid")


@query(f"""with v as (select event_id % 9 < 7 as valid, user_id % 40 as run, ts as place, event_id // 2 as id, component, o.event_type as event_type, status, reason_code, o.event_type as kind from events join ({_OPERATIONAL}) o using (event_id)
), g as (select run, case when grouping(component) = 0 then 'component' when grouping(event_type) = 0 then 'event_type' when grouping(status) = 0 then 'status' when grouping(reason_code) = 0 then 'reason_code' else 'run' end as facet,
  case when grouping(component) = 0 then component when grouping(event_type) = 0 then event_type when grouping(status) = 0 then status when grouping(reason_code) = 0 then reason_code end as value,
  count(*) as events, count(*) - count(distinct id) as duplicate_ids, min(place) as first_at, max(place) as last_at, arg_min(kind, {{'a': place, 'b': id}}) as first_type, arg_max(kind, {{'a': place, 'b': id}}) as last_type, bool_and(valid) as contract_valid,
  count(*) filter (where kind = 'workflow_started') as starts, count(*) filter (where kind = 'workflow_completed') as ends
  from v group by grouping sets ((run), (run, component), (run, event_type), (run, status), (run, reason_code)))
select run, facet, value, events, duplicate_ids, first_at, last_at, first_type, last_type, contract_valid,
  case when facet = 'run' then first_type = 'workflow_started' and last_type = 'workflow_completed' and starts = 1 and ends = 1 end as lifecycle_valid from g""")
def event_stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 40 as run", "ts as place", "event_id div 2 as id", "event_id % 9 < 7 as valid")
    return metrics.event_stream_summary(_sql(spark, sf_dir, _OPERATIONAL).join(own, "event_id"), "run", "place", "id", "workflow_started", ("workflow_completed",))


@query("""with r as (select *, row_number() over (partition by event_type order by sha256(event_id::varchar), event_id) as p from events),
k as (select event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95, count(*) as kept from r where p <= 500 group by 1),
s as (select event_type, count(*) as calls, sum(user_id % 7)::bigint as items, sum((value * 100)::bigint)::bigint as wall, sum(user_id)::bigint as cpu from events group by 1)
select event_type, calls, items, wall, cpu, round(items / wall, 9) as throughput, round(p50, 6) as p50, round(p95, 6) as p95, kept from s join k using (event_type)""")
def stage_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as latencies of the event types as stages, with a reservoir small enough to leave some out."""
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "value", F.col("user_id").alias("cpu"), (F.col("user_id") % 7).alias("items"))
    found = metrics.stage_accumulator(events, ["event_type"], "event_id", "value", "cpu", "items", reservoir=500)
    cents = events.groupBy("event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    joined = found.join(cents, "event_type")
    return joined.select("event_type", "calls", "items", F.col("cents").alias("wall"), "cpu", F.round(F.col("items") / F.col("cents"), 9).alias("throughput"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "kept")


_DECISIONS = """select p_partkey, concat('s', cast(p_partkey % 30 as varchar(9))) as source_id, case when p_partkey % 4 = 0 then null else concat('t', cast(p_partkey % 25 as varchar(9))) end as target_id,
  case p_partkey % 5 when 0 then 'auto' when 1 then 'review' when 2 then 'blocked' when 3 then 'maybe' end as status, p_size / 45.0 as score, (p_size - 3) / 50.0 as margin from part"""


@query(f"""select p_partkey, concat_ws(',', case when cast(source_id[2:] as int) >= 20 then 'decision_for_unknown_source' end, case when status is null or status = 'maybe' then 'invalid_mapping_status' end,
  case when score not between 0 and 1 then 'invalid_score' end, case when margin not between 0 and 1 then 'invalid_margin' end, case when status = 'blocked' and target_id is not null then 'blocked_decision_has_target' end,
  case when status in ('auto', 'review') and target_id is null then 'actionable_decision_missing_target' end, case when status in ('auto', 'review') and cast(target_id[2:] as int) >= 20 then 'decision_for_unknown_target' end) as reasons from ({_DECISIONS}) d""")
def decision_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda side: spark.range(20).select(F.concat(F.lit(side), F.col("id").cast("string")).alias("id"))
    found = contracts.decision_reasons(_sql(spark, sf_dir, _DECISIONS, "part"), ids("s"), ids("t"))
    return found.select("p_partkey", F.array_join("reasons", ",").alias("reasons"))


_FINDINGS = """select o_custkey as run, o_orderkey as place, case o_orderkey % 4 when 0 then 'foreign_key_lookup_failed' when 1 then 'required_target_null' when 2 then 'type_mismatch' else 'unmapped' end as code,
  case when o_custkey % 3 = 0 then 'review' when o_orderkey % 2 = 0 then 'blocking' else 'safe' end as severity, o_orderkey % 5 = 0 as of_plan from orders"""
_RECIPE_RUNS = """select o_custkey as run, o_custkey % 7 = 0 as promotable, o_custkey % 3 = 0 or o_custkey % 7 = 0 as valid from orders group by o_custkey"""


@query(f"""with f as (select run, arg_min(code, place) filter (where severity = 'blocking' and of_plan) as bp, arg_min(code, place) filter (where severity = 'blocking' and not of_plan) as br,
  arg_min(code, place) filter (where severity = 'review' and of_plan) as rp, arg_min(code, place) filter (where severity = 'review' and not of_plan) as rr from ({_FINDINGS}) x group by 1)
select r.run, case when promotable then 'success' when not valid then case when bp is null and br = 'foreign_key_lookup_failed' then 'quarantined' else 'rejected' end else 'quarantined' end as outcome,
  case when promotable then 'preflight_promotable' when not valid then coalesce(bp, br, 'preflight_not_promotable') else coalesce(rp, rr, 'preflight_not_promotable') end as reason from ({_RECIPE_RUNS}) r left join f on f.run = r.run""")
def recipe_run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contracts.run_outcomes(_sql(spark, sf_dir, _FINDINGS, "orders"), _sql(spark, sf_dir, _RECIPE_RUNS, "orders"), "run")
    return found.select("run", "outcome", "reason")


_CANDIDATES = """select cast(p_size as varchar(9)) as pair, concat('s', cast(p_partkey % 10 as varchar(9))) as source_id, cast(p_partkey as varchar(20)) as target_id, p_partkey as t_position,
  (p_partkey * 37 % 100) / 100.0 as det, (p_partkey * 53 % 100) / 100.0 as score, p_partkey % 2 = 0 as safe from part"""


@query(f"""with c as (select *, row_number() over s as sp, row_number() over d as dp, count(*) over (partition by pair, source_id) as n from ({_CANDIDATES}) x
  window s as (partition by pair, source_id order by score desc, t_position), d as (partition by pair, source_id order by det desc, score desc, t_position)
), g as (select pair, source_id, max(n) as n, max(case when dp = 1 then det end) as d1, max(case when dp = 2 then det end) as d2, bool_or(dp = 1 and safe) as s1, max(case when sp = 1 then score end) as x1, max(case when sp = 2 then score end) as x2 from c group by 1, 2
), u as (select c.*, g.n >= 2 and not (d1 >= 0.9 and d1 - d2 >= 0.08 and s1) and x1 >= 0.5 and x1 - x2 <= 0.16 and sp <= 4 as used from c join g using (pair, source_id))
select target_id, used as reranked, round(case when used then 0.82 * score::double + 0.18 * ((t_position * 71 % 100) / 100.0)::double else score::double end, 9) as score from u""")
def candidate_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = _sql(spark, sf_dir, _CANDIDATES, "part").withColumn("det", F.col("det").cast("decimal(9,4)")).withColumn("score", F.col("score").cast("decimal(9,4)"))
    scores = candidates.select("pair", "source_id", "target_id", (F.col("t_position") * 71 % 100 / 100).alias("rerank"))
    found = contracts.reranked(candidates, scores)
    return found.select("target_id", "reranked", F.round(F.col("score").cast("double"), 9).alias("score"))
