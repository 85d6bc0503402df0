"""Claims, leases, queues and compare-and-set steps as relations: a batch of requests against the state that holds before it.

All joins on identities are null-safe, so a row without an identity is one like others. Within a batch the request that
comes first in `order`, a unique column, wins; the others see what it leaves. Winners are found by pre-aggregated minima,
so a hot identity is never sorted in one task. Nothing here writes: the rows returned are what a sink stores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.metrics import expired, lease_available


def met(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """df joined to other on equal keys, nulls included; other's keys are left out."""
    side = other.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in other.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(side[f"__{k}"]) for k in keys])
    return df.join(side, same, how).drop(*[f"__{k}" for k in keys])


# ---- the ledger's claims


def claims(ledger: DataFrame, requests: DataFrame, identity: list[str], order: str, now: Column, lease: int) -> DataFrame:
    """requests (identity, order, digest, plan, token) with outcome, next_state, next_token, next_lease_until.

    ledger: identity, state, digest, plan, token, lease_until. Outcomes: new, recovered (both claim), in_progress,
    already_committed, ambiguous, replay_detected (another digest or plan than the ledger's or the winner's).
    """
    held = ledger.select(*identity, *[F.col(c).alias(f"held_{c}") for c in ("state", "digest", "plan", "token", "lease_until")])
    first = requests.groupBy(*identity).agg(F.min(F.struct(order, "digest", "plan")).alias("__first"))
    rows = met(met(requests, held, identity), first, identity)
    wins = F.col(order) == F.col(f"__first.{order}")
    fresh = F.col("held_state").isNull()
    same = lambda a, b: F.col("digest").eqNullSafe(F.col(a)) & F.col("plan").eqNullSafe(F.col(b))
    live = ~lease_available(F.col("held_lease_until"), now)
    # The winner of a fresh identity sets its digest and plan for the rest of the batch.
    outcome = (
        F.when(fresh & wins, "new")
        .when(fresh, F.when(same("__first.digest", "__first.plan"), "in_progress").otherwise("replay_detected"))
        .when(~same("held_digest", "held_plan"), "replay_detected")
        .when(F.col("held_state") == "committed", "already_committed")
        .when(F.col("held_state").isin("claimed", "replay_claimed") & live, "in_progress")
        .when((F.col("held_state") == "claimed") & F.col("held_token").isNotNull(), "recovered")
        .otherwise("ambiguous")
    )
    rows = rows.withColumn("outcome", outcome)
    # One claim recovers an expired lease: the first of the batch that may.
    able = rows.filter("outcome = 'recovered'").groupBy(*identity).agg(F.min(order).alias("__recovers"))
    rows = met(rows, able, identity)
    rows = rows.withColumn("outcome", F.when((F.col("outcome") == "recovered") & (F.col(order) != F.col("__recovers")), "in_progress").otherwise(F.col("outcome")))
    takes = F.col("outcome").isin("new", "recovered")
    return rows.select(
        *requests.columns,
        "outcome",
        F.when(takes, "claimed").otherwise(F.col("held_state")).alias("next_state"),
        F.when(takes, F.col("token")).otherwise(F.col("held_token")).alias("next_token"),
        F.when(takes, now + lease).otherwise(F.col("held_lease_until")).alias("next_lease_until"),
    )


def fenced(ledger: DataFrame, writes: DataFrame, identity: list[str], now: Column) -> DataFrame:
    """writes (identity, digest, plan, token, from_state) with holds: the ledger still has this digest, plan, token and
    state, and a claim that has not run out; else the write must not start."""
    held = ledger.select(*identity, *[F.col(c).alias(f"held_{c}") for c in ("state", "digest", "plan", "token", "lease_until")])
    same = F.col("digest").eqNullSafe(F.col("held_digest")) & F.col("plan").eqNullSafe(F.col("held_plan"))
    # A claim without a token fences nothing.
    holds = same & (F.col("token") == F.col("held_token")) & (F.col("from_state") == F.col("held_state")) & ~lease_available(F.col("held_lease_until"), now)
    return met(writes, held, identity).select(*writes.columns, F.coalesce(holds, F.lit(False)).alias("holds"))


def replays(ledger: DataFrame, now: Column) -> DataFrame:
    """ledger (state, token, lease_until, has_contract) with replay: refused_committed, refused_active, refused_contract or allowed,
    and next_state."""
    active = F.col("state").isin("claimed", "replay_claimed") & ~lease_available(F.col("lease_until"), now)
    before_write = F.col("state").isin("quarantined", "replay_quarantined", "claimed", "replay_claimed")
    replay = (
        F.when(F.col("state") == "committed", "refused_committed")
        .when(active, "refused_active")
        .when(~before_write & ~F.col("has_contract"), "refused_contract")
        .otherwise("allowed")
    )
    following = F.when(F.col("replay") != "allowed", F.col("state")).when(F.col("state") == "quarantined", "claimed").otherwise("replay_claimed")
    return ledger.withColumn("replay", replay).withColumn("next_state", following)


# ---- relay queue

#: Why a queued record is dead-lettered, the first that applies.
DEAD_REASONS = ("relay_wire_invalid", "relay_source_authentication_failed", "relay_transfer_expired", "relay_policy_rejected", "relay_digest_mismatch")
MOST_DEAD = 1_000


def dead_reason(now: Column) -> Column:
    """Of a queued row (wire_ok, source_ok, expires_at, policy_ok, digest, body_digest); null: fit to be handed on."""
    wrong = (~F.col("wire_ok"), ~F.col("source_ok"), expired(F.col("expires_at"), now), ~F.col("policy_ok"), ~F.col("digest").eqNullSafe(F.col("body_digest")))
    return F.coalesce(*[F.when(w, F.lit(reason)) for w, reason in zip(wrong, DEAD_REASONS, strict=True)])


def relay_lease(queue: DataFrame, order: str, now: Column, limit: int, lease: int, most_dead: int = MOST_DEAD) -> DataFrame:
    """queue with status: leased (the first `limit` fit rows in order), dead_letter (the first most_dead unfit ones), held
    (another's lease lives) or waiting; reason; next_lease_until. The first rows are two bounded top-k, not a sort."""
    rows = queue.withColumn("reason", F.when(lease_available(F.col("lease_until"), now), dead_reason(now)))
    free = rows.filter(lease_available(F.col("lease_until"), now))
    fit = free.filter("reason is null").select(order).orderBy(order).limit(limit).select(F.col(order).alias("__at"), F.lit("leased").alias("__status"))
    unfit = free.filter("reason is not null").select(order).orderBy(order).limit(most_dead).select(F.col(order).alias("__at"), F.lit("dead_letter").alias("__status"))
    found = rows.join(F.broadcast(fit.unionByName(unfit)), F.col(order) == F.col("__at"), "left")
    status = F.coalesce("__status", F.when(lease_available(F.col("lease_until"), now), "waiting").otherwise("held"))
    found = found.withColumn("status", status).drop("__at", "__status")
    return found.withColumn("next_lease_until", F.when(F.col("status") == "leased", now + lease).otherwise(F.col("lease_until")))


def relay_settle(queue: DataFrame, answers: DataFrame, identity: list[str], now: Column) -> DataFrame:
    """answers (identity, token, action: ack or release) with outcome: acked, released, or lost (no such lease of this token any more)."""
    held = queue.select(*identity, F.col("token").alias("held_token"), F.col("lease_until").alias("held_until"))
    holds = (F.col("token") == F.col("held_token")) & ~lease_available(F.col("held_until"), now)
    outcome = F.when(F.coalesce(holds, F.lit(False)), F.when(F.col("action") == "ack", "acked").otherwise("released")).otherwise("lost")
    return met(answers, held, identity).select(*answers.columns, outcome.alias("outcome"))


def depths(tables: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """store, by, depth: how many rows each store holds."""
    parts = [df.groupBy(*by).agg(F.count(F.lit(1)).alias("depth")).select(F.lit(name).alias("store"), *by, "depth") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def listing(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows in order, as a distributed top-k."""
    return df.orderBy(*order).limit(limit)


# ---- checkpoints and run leases


def advance_checkpoints(checkpoints: DataFrame, proposals: DataFrame, route: list[str], order: str) -> DataFrame:
    """proposals (route, order, expected_generation, run_id, receipt_digest, committed) with outcome and next_generation.

    checkpoints: route, generation, run_id, receipt_digest, committed_total. Outcomes: advanced (the first of the batch that
    expects the generation that holds; 0 where there is none), repeated (the run that made the present generation, with the
    same receipt), receipt_conflict (that run with another receipt), stale.
    """
    held = checkpoints.select(*route, F.col("generation").alias("__generation"), F.col("run_id").alias("__run"), F.col("receipt_digest").alias("__receipt"), F.col("committed_total").alias("__total"))
    rows = met(proposals, held, route).withColumn("__generation", F.coalesce("__generation", F.lit(0)))
    again = F.coalesce(F.col("run_id") == F.col("__run"), F.lit(False))
    outcome = F.when(again, F.when(F.col("receipt_digest").eqNullSafe(F.col("__receipt")), "repeated").otherwise("receipt_conflict"))
    rows = rows.withColumn("outcome", outcome.when(F.col("expected_generation") == F.col("__generation"), "advanced").otherwise("stale"))
    first = rows.filter("outcome = 'advanced'").groupBy(*route).agg(F.min(order).alias("__first"))
    rows = met(rows, first, route)
    rows = rows.withColumn("outcome", F.when((F.col("outcome") == "advanced") & (F.col(order) != F.col("__first")), "stale").otherwise(F.col("outcome")))
    moved = F.col("outcome") == "advanced"
    return rows.select(
        *proposals.columns,
        "outcome",
        (F.col("__generation") + moved.cast("int")).cast("long").alias("next_generation"),
        (F.coalesce("__total", F.lit(0)) + F.when(moved, F.col("committed")).otherwise(0)).cast("long").alias("committed_total"),
    )


def run_leases(leases: DataFrame, requests: DataFrame, route: list[str], order: str, now: Column, ttl: int) -> DataFrame:
    """requests (route, order, holder, action: claim, renew or release) with outcome and next_until.

    leases: route, holder, until. Each request is judged on the state before the batch; of the claims that find a route free
    the first gets it. Outcomes: claimed, renewed, released, refused.
    """
    held = leases.select(*route, F.col("holder").alias("__holder"), F.col("until").alias("__until"))
    rows = met(requests, held, route)
    free = lease_available(F.col("__until"), now)
    mine = F.coalesce(F.col("holder") == F.col("__holder"), F.lit(False)) & ~free
    outcome = F.when((F.col("action") == "claim") & (free | mine), "claimed").when((F.col("action") == "renew") & mine, "renewed").when((F.col("action") == "release") & mine, "released").otherwise("refused")
    rows = rows.withColumn("outcome", outcome).withColumn("__free", free)
    first = rows.filter("outcome = 'claimed' and __free").groupBy(*route).agg(F.min(order).alias("__first"))
    rows = met(rows, first, route)
    rows = rows.withColumn("outcome", F.when((F.col("outcome") == "claimed") & F.col("__free") & (F.col(order) != F.col("__first")), "refused").otherwise(F.col("outcome")))
    until = F.when(F.col("outcome").isin("claimed", "renewed"), now + ttl).when(F.col("outcome") == "released", F.lit(None)).otherwise(F.col("__until"))
    return rows.select(*requests.columns, "outcome", until.cast("long").alias("next_until"))


def commit_receipts(runs: DataFrame) -> DataFrame:
    """Receipts of runs (run_id, status, delivered, duplicate, quarantined, ambiguous, total) that may advance a checkpoint: only
    completed runs whose parts add up and leave nothing quarantined or ambiguous; digest is over all counts."""
    sound = (F.col("status") == "completed") & (F.col("delivered") + F.col("duplicate") == F.col("total")) & (F.col("quarantined") == 0) & (F.col("ambiguous") == 0)
    text = F.concat_ws(":", "run_id", "delivered", "duplicate", "total")
    return runs.filter(sound).select("run_id", (F.col("delivered") + F.col("duplicate")).alias("committed"), F.sha2(text, 256).alias("receipt_digest"))


# ---- quarantine, audit, budgets


def quarantine_upsert(stored: DataFrame, incoming: DataFrame, identity: list[str], order: str) -> DataFrame:
    """What the quarantine holds afterwards: the latest row of each identity, incoming ones over stored ones; attempts added up."""
    rows = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    rest = [c for c in stored.columns if c not in identity and c not in (order, "attempts")]
    last = rows.groupBy(*identity).agg(F.max(F.struct("__new", order, *rest)).alias("__last"), F.sum("attempts").alias("attempts"))
    return last.select(*identity, *[F.col(f"__last.{c}").alias(c) for c in (order, *rest)], "attempts")


def quarantine_remove(stored: DataFrame, settled: DataFrame, identity: list[str]) -> DataFrame:
    """The quarantine without identities that were delivered since."""
    gone = settled.select(*identity).distinct().withColumn("__gone", F.lit(True))
    return met(stored, gone, identity).filter("__gone is null").drop("__gone")


def audit_summary(events: DataFrame, order: str, signature: str, fields: list[str]) -> DataFrame:
    """field, value, n, signed, unsigned, first_at, last_at: counts of each field's values in one pass over the events."""
    each = events.select(order, signature, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("f"))
    return each.groupBy("f.field", "f.value").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(signature).alias("signed"),
        (F.count(F.lit(1)) - F.count(signature)).alias("unsigned"),
        F.min(order).alias("first_at"),
        F.max(order).alias("last_at"),
    )


def audit_usage(events: DataFrame, stream: list[str], text: str) -> DataFrame:
    """stream, events, logical_bytes."""
    return events.groupBy(*stream).agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("logical_bytes"))


#: Quotas of one audit log.
MOST_EVENTS, MOST_AUDIT_BYTES = 1_000_000, 2 << 30


def audit_quota(usage: DataFrame, incoming: DataFrame, stream: list[str], most_events: int = MOST_EVENTS, most_bytes: int = MOST_AUDIT_BYTES) -> DataFrame:
    """stream, events, logical_bytes and accepted: an append is taken whole or not at all, by what both would add up to."""
    total = usage.unionByName(incoming).groupBy(*stream).agg(F.sum("events").alias("events"), F.sum("logical_bytes").alias("logical_bytes"))
    return total.withColumn("accepted", (F.col("events") <= most_events) & (F.col("logical_bytes") <= most_bytes))


def budget(df: DataFrame, size: Column, most_records: int, most_bytes: int) -> DataFrame:
    """records, bytes, exceeded (null, records or bytes) of a batch against its budget."""
    used = df.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
    return used.withColumn("exceeded", F.when(F.col("records") > most_records, "records").when(F.col("bytes") > most_bytes, "bytes"))


def within(df: DataFrame, most_records: int) -> bool:
    """Whether df has no more than most_records rows; at most one row beyond the limit is read."""
    return df.limit(most_records + 1).count() <= most_records


def field_set_exact(records: DataFrame, expected: list[str]) -> DataFrame:
    """missing and unexpected fields of a mapped record set; both empty: the contract holds."""
    have, want = F.array(*map(F.lit, records.columns)), F.array(*map(F.lit, expected))
    empty = F.expr("cast(array() as array<string>)")
    have = have if records.columns else empty
    want = want if expected else empty
    return records.sparkSession.range(1).select(F.array_sort(F.array_except(want, have)).alias("missing"), F.array_sort(F.array_except(have, want)).alias("unexpected"))


def field_sets(records: DataFrame, keys: Column, expected: list[str]) -> DataFrame:
    """missing, unexpected, records: the ways in which records' own field names (an array; null: none) differ from what is expected."""
    want, have = F.array(*map(F.lit, expected)).cast("array<string>"), F.coalesce(keys, F.array().cast("array<string>"))
    sets = records.select(F.array_sort(F.array_except(want, have)).alias("missing"), F.array_sort(F.array_except(have, want)).alias("unexpected"))
    return sets.groupBy("missing", "unexpected").agg(F.count(F.lit(1)).alias("records"))
