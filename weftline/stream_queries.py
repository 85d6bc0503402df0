"""Queries of the stateful streams: `events` as requests, replayed in two halves with a restart between, and SQL that folds them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.state import TRANSITIONS
from weftline.plans.derived import view
from weftline.queries import _FINDINGS, ORDERS_PLAN, ORDERS_SOURCE, ORDERS_TARGET, _customers, query
from weftline.session import shared_dir, table
from weftline.sources.commits import Table
from weftline.streaming import leases, receipts

TTL_HOURS = 12
TTL = TTL_HOURS * 3_600_000
LATE_S = 60

#: Requests made from the driver's rows, as SQL that both engines read. One identity is null.
CLAIMS = """select case when user_id = 7 then null else user_id end as identity, event_id as seq, ts as at,
  case event_id % 9 when 0 then 'claim' when 1 then 'claim' when 2 then 'start_write' when 3 then 'commit' when 4 then 'renew' when 5 then 'claim' when 6 then 'rearm' when 7 then 'start_replay_write'
    else case when event_id % 2 = 0 then 'quarantine' else 'uncertain' end end as action,
  concat('d', cast(case when event_id % 31 = 0 then 9 else user_id % 5 end as varchar(9))) as digest, 'p1' as plan, concat('t', cast(event_id % 2 as varchar(9))) as token, user_id % 2 = 0 as contract from events"""
ROUTES = """select user_id as route, event_id as seq, ts as at, concat('h', cast(event_id % 3 as varchar(9))) as holder, case event_id % 4 when 0 then 'claim' when 1 then 'renew' when 2 then 'claim' else 'release' end as action from events"""
PROPOSALS = """select user_id as route, event_id as seq, ts as at, 'advance' as action, value_rank as expected_generation, concat('r', cast(event_id % 3 as varchar(9))) as run_id,
  case when event_id % 5 = 0 then 'c2' else 'c1' end as receipt_digest, event_id % 9 as committed from (select *, event_id % 4 as value_rank from events) q"""


def _replayed(spark: SparkSession, sf_dir: str, text: str, identity: list[str], rules: leases.Rules) -> tuple[str, str]:
    """Judges the requests of events in two runs of one query, of which the second finds the first one's state; target and checkpoint."""
    root = shared_dir(spark)
    made = spark.sql(text.replace("from events", "from {src}"), src=table(spark, sf_dir, "events")).withColumn("at", F.col("at").cast("timestamp"))
    middle = made.agg(F.max("seq")).first()[0] or 0
    for half, part in enumerate((made.filter(F.col("seq") * 2 <= middle), made.filter(F.col("seq") * 2 > middle))):
        part.write.mode("append").parquet(f"{root}/requests/half={half}")
        source = spark.readStream.schema(made.schema).parquet(f"{root}/requests/*")
        leases.run(source, identity, rules, f"{root}/judged", f"{root}/checkpoint", f"{LATE_S} seconds")
    return f"{root}/judged", f"{root}/checkpoint"


_STEPS = ", ".join(f"('{s}', '{e}', '{n}', {str(live).lower()})" for s, e, n, live in TRANSITIONS if e not in ("claim", "rearm"))
_HALVES = f"""b as (select max(seq) as top from r), w as (
  select 1 as half, max(epoch_us("at") // 1000) filter (seq * 2 <= top) - {LATE_S * 1000} as mark from r, b union all select 2, max(epoch_us("at") // 1000) - {LATE_S * 1000} from r)"""
#: The fold of the ledger as a recursion over each identity's requests.
_LEDGER = f"""with recursive r as (select *, epoch_us("at") // 1000 as at_ms, row_number() over (partition by identity order by seq) as n from ({CLAIMS}) q),
t(s, e, following, needs_live) as (values {_STEPS}), {_HALVES}, f as (
  select identity, n, seq, action, case action when 'claim' then 'new' else 'unknown' end as outcome, case action when 'claim' then 'claimed' end as state, case action when 'claim' then digest end as digest,
    case action when 'claim' then token end as token, case action when 'claim' then at_ms + {TTL} end as lease_until, case action when 'claim' then 1 end as claims from r where n = 1
  union all
  select identity, n, seq, action, outcome,
    case when outcome in ('new', 'recovered') then 'claimed' when outcome = 'rearmed' then case state when 'quarantined' then 'claimed' else 'replay_claimed' end when outcome = 'accepted' then following else state end,
    case when outcome = 'new' then rd else digest end, case when outcome in ('new', 'recovered', 'rearmed') then rt else token end,
    case when outcome in ('new', 'recovered', 'rearmed', 'renewed') then at_ms + {TTL} else lease_until end, case when outcome in ('new', 'recovered', 'rearmed') then coalesce(claims, 0) + 1 else claims end
  from (select f.identity, r.n, r.seq, r.action, r.at_ms, r.digest as rd, r.token as rt, f.state, f.digest, f.token, f.lease_until, f.claims, t.following,
    case when f.state is null then case r.action when 'claim' then 'new' else 'unknown' end
      when r.digest <> f.digest then 'replay_detected'
      when r.action = 'claim' then case when f.state = 'committed' then 'already_committed' when f.state in ('claimed', 'replay_claimed') and r.at_ms < f.lease_until then 'in_progress' when f.state = 'claimed' then 'recovered' else 'ambiguous' end
      when r.action = 'renew' then case when f.state in ('claimed', 'replay_claimed') and r.at_ms < f.lease_until and r.token = f.token then 'renewed' else 'lost' end
      when r.action = 'rearm' then case when f.state = 'committed' then 'refused_committed' when f.state in ('claimed', 'replay_claimed') and r.at_ms < f.lease_until then 'refused_active'
        when f.state not in ('quarantined', 'replay_quarantined', 'claimed', 'replay_claimed') and not r.contract then 'refused_contract' else 'rearmed' end
      when t.s is null then 'refused' when r.token <> f.token then 'fenced' when t.needs_live and r.at_ms >= f.lease_until then 'lapsed' else 'accepted' end as outcome
    from f join r on r.identity is not distinct from f.identity and r.n = f.n + 1 left join t on t.s = f.state and t.e = r.action) q
), ends as (
  select w.half, w.mark, arg_max(f, f.n) as x from f, w, b where w.half = 2 or f.seq * 2 <= b.top group by w.half, w.mark, f.identity
), lapsed as (select distinct x.identity as identity, x.state as state, x.token as token, x.lease_until as lease_until, x.claims as claims from ends where x.state in ('claimed', 'replay_claimed') and x.lease_until <= mark)"""


@query(f"""{_LEDGER} select identity, seq, action, outcome, state, token, lease_until, claims from f
union all select identity, null, 'expire', 'expired', state, token, lease_until, claims from lapsed""")
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = _replayed(spark, sf_dir, CLAIMS, ["identity"], leases.ledger_rules(TTL))
    return spark.read.parquet(judged).select("identity", "seq", "action", "outcome", "state", "token", "lease_until", "claims")


@query(f"""{_LEDGER} select x.identity as identity, x.state as state, x.digest as digest, x.token as token, x.lease_until as lease_until, x.claims as claims from ends where half = 2 and x.state is not null""")
def ledger_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, checkpoint = _replayed(spark, sf_dir, CLAIMS, ["identity"], leases.ledger_rules(TTL))
    return leases.held(spark, checkpoint).select("identity", "state", "digest", "token", "lease_until", "claims")


@query(f"""with recursive r as (select *, epoch_us("at") // 1000 as at_ms, row_number() over (partition by route order by seq) as n from ({ROUTES}) q), f as (
  select route, n, seq, action, case action when 'claim' then 'claimed' else 'refused' end as outcome, case action when 'claim' then holder end as holder, case action when 'claim' then at_ms + {TTL} end as until from r where n = 1
  union all
  select route, n, seq, action, outcome, case when outcome in ('claimed', 'renewed') then rh when outcome = 'released' then null else holder end,
    case when outcome in ('claimed', 'renewed') then at_ms + {TTL} when outcome = 'released' then null else until end
  from (select f.route, r.n, r.seq, r.action, r.at_ms, r.holder as rh, f.holder, f.until,
    case when r.action = 'claim' and (f.until is null or r.at_ms >= f.until or f.holder = r.holder) then 'claimed' when coalesce(f.holder = r.holder and r.at_ms < f.until, false) and r.action = 'renew' then 'renewed'
      when coalesce(f.holder = r.holder and r.at_ms < f.until, false) and r.action = 'release' then 'released' else 'refused' end as outcome from f join r on r.route = f.route and r.n = f.n + 1) q)
select route, seq, action, outcome from f""")
def route_lease_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's outcome; what a refused request finds may have been removed by a timer or merely have run out, which is one."""
    judged, _ = _replayed(spark, sf_dir, ROUTES, ["route"], leases.lease_rules(TTL))
    return spark.read.parquet(judged).filter("seq is not null").select("route", "seq", "action", "outcome")


@query(f"""with recursive r as (select *, row_number() over (partition by route order by seq) as n from ({PROPOSALS}) q), f as (
  select route, n, seq, case when expected_generation = 0 then 'advanced' else 'stale' end as outcome, case when expected_generation = 0 then 1 else 0 end as generation, case when expected_generation = 0 then run_id end as run_id,
    case when expected_generation = 0 then receipt_digest end as receipt_digest, case when expected_generation = 0 then committed else 0 end as committed_total from r where n = 1
  union all
  select route, n, seq, outcome, generation + (outcome = 'advanced')::int, case when outcome = 'advanced' then rr else run_id end, case when outcome = 'advanced' then rd else receipt_digest end, committed_total + case when outcome = 'advanced' then committed else 0 end
  from (select f.route, r.n, r.seq, r.run_id as rr, r.receipt_digest as rd, r.committed, f.generation, f.run_id, f.receipt_digest, f.committed_total,
    case when f.run_id = r.run_id then case when f.receipt_digest = r.receipt_digest then 'repeated' else 'receipt_conflict' end when r.expected_generation = f.generation then 'advanced' else 'stale' end as outcome
    from f join r on r.route = f.route and r.n = f.n + 1) q)
select route, seq, outcome, nullif(generation, 0) as generation, case when generation > 0 then committed_total end as committed_total from f""")
def checkpoint_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = _replayed(spark, sf_dir, PROPOSALS, ["route"], leases.checkpoint_rules())
    return spark.read.parquet(judged).select("route", "seq", "outcome", "generation", "committed_total")


# ---- tables with a commit log


@query("""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) select user_id, event_id, event_type from r where n = 1""")
def commit_table_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event: three upserts that bring them out of order, one of them sent twice, and a compaction."""
    kept = Table(spark, f"{shared_dir(spark)}/latest", ["user_id"], buckets=16)
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    for number, third in enumerate((2, 0, 1, 1)):
        kept.upsert(events.filter(F.col("event_id") % 3 == third), order=["ts", "event_id"], batch=("events", min(number, 2)), keep_newest=True)
    kept.compact()
    return kept.read().select("user_id", "event_id", "event_type")


@query("""select p::bigint as version, count(*) as records, sum(o_orderkey)::bigint as keys from orders join (values (1), (2), (3), (4)) v(p) on o_orderkey % 4 < p group by 1""")
def commit_table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version of a table of appends held, read after the table was compacted."""
    kept = Table(spark, f"{shared_dir(spark)}/orders")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    numbers = [kept.append(orders.filter(F.col("o_orderkey") % 4 == part)) for part in range(4)]
    kept.compact()
    read = [kept.read(v).agg(F.count(F.lit(1)).alias("records"), F.sum("o_orderkey").cast("long").alias("keys")).select(F.lit(v).cast("long").alias("version"), "records", "keys") for v in numbers]
    return reduce(DataFrame.unionByName, read)


# ---- delivery from claim to receipt: most orders in one batch, all of them in the next, some of those twice or with another price

_FIRST = "o_orderkey % 3 <> 0"


@query(f"""with f as (select o_orderkey, bool_or(code <> 'foreign_key_lookup_failed') as broken from ({_FINDINGS}) x group by 1),
j as (select o_orderkey, case when o_orderkey % 17 = 0 then 'transport_verification_failed' when broken then 'destination_contract_failed' when broken is not null then 'destination_resolution_failed' end as bad from orders left join f using (o_orderkey)),
b as (select 0 as batch, o_orderkey, 1 as copy from orders where {_FIRST} union all select 1, o_orderkey, 1 from orders union all select 1, o_orderkey, 2 from orders where o_orderkey % 7 = 0),
s as (select batch, o_orderkey, copy, bad, case when batch = 0 then case when bad is null then 'delivered' else 'quarantined' end
  when {_FIRST} then case when o_orderkey % 10 = 0 then 'replay_detected' when bad is null then 'duplicate' else 'ambiguous' end
  when copy = 1 then case when bad is null then 'delivered' else 'quarantined' end
  else case when bad is null then 'duplicate' else 'ambiguous' end end as status from b join j using (o_orderkey))
select batch::bigint as batch, status, case status when 'quarantined' then bad when 'ambiguous' then 'previous_delivery_ambiguous' end as reason_code, count(*) as n, sum(o_orderkey)::bigint as keys from s group by 1, 2, 3
union all select -1, 'target', null, count(*), sum(o_orderkey)::bigint from s where status = 'delivered'""")
def delivery_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_dir(spark)
    probe = view(spark, sf_dir, "fk_probe").select("o_orderkey", F.col("customer_business_key").alias("customer"))
    keys = view(spark, sf_dir, "text_orders").select("o_orderkey", F.col("key_raw").alias("key"))
    price = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    rows = keys.join(probe, "o_orderkey").join(price, "o_orderkey").withColumn("place", F.col("o_orderkey") * 2)
    changed = rows.withColumn("price", F.when((F.col("o_orderkey") % 10 == 0) & F.expr(_FIRST), F.col("price") + 1).otherwise(F.col("price")))
    again = changed.unionByName(changed.filter("o_orderkey % 7 = 0").withColumn("place", F.col("place") + 1))
    for number, batch in ((0, rows.filter(_FIRST)), (1, again), (1, again)):
        receipts.deliver_batch(batch, number, root, ["o_orderkey"], "place", ORDERS_PLAN, ORDERS_SOURCE, ORDERS_TARGET, _customers(spark, sf_dir), F.col("o_orderkey") % 17 != 0)
    found = receipts.receipts(spark, root).read().groupBy("batch", "status", "reason_code").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("long").alias("keys"))
    written = receipts.target_rows(spark, root).agg(F.count(F.lit(1)).alias("n"), F.sum("order_id").cast("long").alias("keys"))
    return found.unionByName(written.select(F.lit(-1).cast("long").alias("batch"), F.lit("target").alias("status"), F.lit(None).cast("string").alias("reason_code"), "n", "keys"))
