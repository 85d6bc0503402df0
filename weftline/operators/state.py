"""Durable state as relations: ledger, outbox, quarantine, checkpoints, leases, audit chains, recipes, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.lifecycle import met
from weftline.operators.scan import running

#: The ledger's transitions (state, event, next state, whether the claim must be live).
TRANSITIONS = (
    (None, "claim", "claimed", False),
    ("claimed", "start_write", "write_started", True),
    ("claimed", "start_write_many", "batch_write_started", True),
    ("replay_claimed", "start_replay_write", "replay_write_started", True),
    ("write_started", "commit", "committed", False),
    ("batch_write_started", "commit", "committed", False),
    ("replay_write_started", "commit", "committed", False),
    ("write_started", "uncertain", "uncertain", False),
    ("batch_write_started", "uncertain", "batch_uncertain", False),
    ("replay_write_started", "uncertain", "replay_uncertain", False),
    ("claimed", "quarantine", "quarantined", True),
    ("write_started", "quarantine", "quarantined", False),
    ("batch_write_started", "quarantine", "quarantined", False),
    ("replay_claimed", "quarantine", "replay_quarantined", True),
    ("replay_write_started", "quarantine", "replay_quarantined", False),
    ("quarantined", "rearm", "claimed", False),
    ("write_started", "rearm", "replay_claimed", False),
    ("batch_write_started", "rearm", "replay_claimed", False),
    ("replay_write_started", "rearm", "replay_claimed", False),
    ("uncertain", "rearm", "replay_claimed", False),
    ("batch_uncertain", "rearm", "replay_claimed", False),
    ("replay_uncertain", "rearm", "replay_claimed", False),
    ("replay_quarantined", "rearm", "replay_claimed", False),
)


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRANSITIONS), "state string, event string, next_state string, needs_live_claim boolean")


def advance(spark: SparkSession, attempts: DataFrame) -> DataFrame:
    """attempts (state, event, claim_live, ...) with next_state and accepted: the compare-and-set of each."""
    table = F.broadcast(transitions(spark).select(F.col("state").alias("__s"), F.col("event").alias("__e"), "next_state", "needs_live_claim"))
    found = attempts.join(table, F.col("state").eqNullSafe(F.col("__s")) & (F.col("event") == F.col("__e")), "left")
    accepted = F.col("next_state").isNotNull() & (~F.col("needs_live_claim") | F.col("claim_live"))
    return found.withColumn("accepted", F.coalesce(accepted, F.lit(False))).drop("__s", "__e", "needs_live_claim").withColumn("next_state", F.when(F.col("accepted"), F.col("next_state")).otherwise(F.col("state")))


def claim_outcome(state: Column, lease_live: Column, same_digest: Column) -> Column:
    """What a claim finds: new, in_progress, recovered, already_committed, ambiguous, replay_detected."""
    return (
        F.when(state.isNull(), "new")
        .when(~same_digest, "replay_detected")
        .when(state == "committed", "already_committed")
        .when(state.isin("claimed", "replay_claimed") & lease_live, "in_progress")
        .when(state == "claimed", "recovered")
        .otherwise("ambiguous")
    )


def first_delivery(df: DataFrame, identity: list[str], digest: Column, order: list[str], free: Column | None = None, carried: Column | None = None) -> DataFrame:
    """Each row with status: delivered (the first of its identity), duplicate (same digest), replay_detected (another digest).

    The first row of each identity is found by a pre-aggregated minimum and joined back, null-safe: rows without an identity
    are one identity. Of rows that tie in order and digest one is delivered; only such rows are numbered, which are those whose
    equal rows were counted to be more than one. The digest is made anew after the join instead of travelling with each row.

    free: the rows that take part; the others are neither first nor given a status (null). carried: a value of each row that
    decides last between those that tie; with it there is a column `carried`, the value of the identity's first row.
    """
    order_, digest_, value, first_, tie, n = "__order", "__digest", "__value", "__first", "__tie", "__n"
    free, own = F.lit(True) if free is None else F.coalesce(free, F.lit(False)), F.lit(None).cast("int") if carried is None else carried
    marked = df.filter(free).select(*identity, F.struct(*order).alias(order_), digest.alias(digest_), own.alias(value))
    equal = marked.groupBy(*identity, order_, digest_, value).agg(F.count(F.lit(1)).alias(n))
    first = equal.groupBy(*identity).agg(F.min(F.struct(order_, digest_, value, n)).alias(first_))
    same = digest.eqNullSafe(F.col(f"{first_}.{digest_}"))
    leads = free & (F.struct(*order) == F.col(f"{first_}.{order_}")) & same & own.eqNullSafe(F.col(f"{first_}.{value}"))
    joined = met(df, first, identity).withColumn(tie, F.coalesce(leads, F.lit(False)))
    if carried is not None:
        joined = joined.withColumn("carried", F.col(f"{first_}.{value}"))
    several = F.col(tie) & (F.col(f"{first_}.{n}") > 1)
    alone = joined.filter(~several).withColumn("status", F.when(F.col(tie), "delivered").when(free, F.when(same, "duplicate").otherwise("replay_detected")))
    place = F.row_number().over(W.partitionBy(*identity).orderBy(*order))
    tied = joined.filter(several).withColumn("status", F.when(place == 1, "delivered").otherwise("duplicate"))
    return tied.unionByName(alone).drop(first_, tie)


def pending_prefix(df: DataFrame, scope: list[str], order: list[str], size: str, budget: int, limit: int) -> DataFrame:
    """The rows of each scope that fit: in order, while the running size stays in the budget and the count in the limit. A scope
    whose first row alone is beyond the budget could never be emptied: that fails the job.

    Only the first `limit` rows of a scope can fit. They are found in parts first, so that a hot scope is not sorted in one
    task; the running size then goes over few rows.
    """
    salt = W.partitionBy(*scope, "__salt").orderBy(*order)
    df = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(64))).withColumn("__at", F.row_number().over(salt)).filter(F.col("__at") <= limit).drop("__salt", "__at")
    w = W.partitionBy(*scope).orderBy(*order)
    running = df.withColumn("running", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    stuck = (F.col("place") == 1) & (F.col("running") > budget)
    message = F.concat(F.lit(f"the first row of a scope is larger than the budget of {budget}: "), F.to_json(F.struct(*scope, *order)))
    checked = running.withColumn("running", F.when(stuck, F.raise_error(message)).otherwise(F.col("running")))
    return checked.filter((F.col("running") <= budget) & (F.col("place") <= limit))


def chain(df: DataFrame, stream: str, order: str, event: str) -> DataFrame:
    """stream, sequence, event, previous_hash, event_hash: each hash covers the one before, from 64 zeros on."""
    schema = df.select(stream, order, event).schema.add("sequence", "long").add("previous_hash", "string").add("event_hash", "string")

    def link(batches):
        import hashlib

        import pyarrow as pa

        at, last, n = None, "", 0
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at is None or at[0] != key:
                    at, last, n = (key,), "0" * 64, 0
                n += 1
                here = hashlib.sha256(last.encode() + b"\0" + (text or "").encode()).hexdigest()
                rows.append((n, last, here))
                last = here
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], [*batch.schema.names, "sequence", "previous_hash", "event_hash"])

    return df.select(stream, order, event).repartition(stream).sortWithinPartitions(stream, order).mapInArrow(link, schema)


def verify_chain(df: DataFrame, stream: str, event: str) -> DataFrame:
    """df with linked: the hash before is the one stored, the sequence has no gap, and the hash is right; checked in parallel."""
    before = F.coalesce("__hash", F.lit("0" * 64))
    gapless = F.col("sequence") == F.coalesce("__sequence", F.lit(0)) + 1
    right = F.col("event_hash") == F.sha2(F.concat(F.col("previous_hash"), F.lit("\0"), F.coalesce(F.col(event), F.lit(""))), 256)
    rows = running(df, [stream], ["sequence"], before={"__hash": "event_hash", "__sequence": "sequence"})
    return rows.withColumn("linked", (F.col("previous_hash") == before) & gapless & right).drop("__hash", "__sequence")


def recipe_health(runs: DataFrame, key: str, order: str, outcome: str, threshold: int = 3) -> DataFrame:
    """Totals by outcome, last outcome, rejections since the last other outcome, and health.

    The streak needs no window: it is the count of rejections behind the last run that was none.
    """
    last_other = runs.filter(F.col(outcome) != "rejected").groupBy(key).agg(F.max(order).alias("__other"))
    joined = runs.join(last_other, key, "left")
    out = joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col(outcome) == "success").alias("successes"),
        F.count_if(F.col(outcome) == "quarantined").alias("quarantined"),
        F.count_if(F.col(outcome) == "rejected").alias("rejected"),
        F.max_by(outcome, order).alias("last_outcome"),
        F.count_if((F.col(outcome) == "rejected") & (F.col("__other").isNull() | (F.col(order) > F.col("__other")))).alias("streak"),
    )
    health = F.when(F.col("streak") >= threshold, "suspended").when((F.col("streak") > 0) | (F.col("last_outcome") == "quarantined"), "degraded").otherwise("healthy")
    return out.withColumn("health", health)


def checkpoints(runs: DataFrame, route: str, order: list[str], committed: str) -> DataFrame:
    """runs with generation (from 1) and the committed total up to each run of its route."""
    return running(runs, [route], order, sums={"committed_records": committed}, place="generation")


def key_chain(keys: DataFrame, stream: str) -> DataFrame:
    """keys (generation, key_id, previous_key_id, issued_at) with trusted: starts at 1, steps by 1, chains, time not backwards, no key twice."""
    first = (F.col("generation") == 1) & F.col("previous_key_id").isNull()
    following = (F.col("generation") == F.col("__generation") + 1) & F.col("previous_key_id").eqNullSafe(F.col("__key")) & (F.col("issued_at") >= F.col("__issued"))
    again = keys.groupBy(stream, "key_id").agg(F.count(F.lit(1)).alias("__uses")).filter("__uses > 1")
    rows = met(running(keys, [stream], ["generation"], before={"__generation": "generation", "__key": "key_id", "__issued": "issued_at"}), again, [stream, "key_id"])
    return rows.withColumn("trusted", F.coalesce(first | following, F.lit(False)) & F.col("__uses").isNull()).drop("__generation", "__key", "__issued", "__uses")


def relay_offers(offers: DataFrame, queued: DataFrame, dead: DataFrame, identity: list[str], digest: str) -> DataFrame:
    """offers with outcome: enqueued, duplicate (same digest in the queue), replay_detected (another digest, or dead-lettered)."""
    q = queued.select(*identity, F.col(digest).alias("__queued"))
    d = dead.select(*identity, F.lit(True).alias("__dead"))
    joined = offers.join(q, identity, "left").join(d, identity, "left")
    outcome = F.when(F.col("__dead"), "replay_detected").when(F.col("__queued").isNull(), "enqueued").when(F.col("__queued") == F.col(digest), "duplicate").otherwise("replay_detected")
    return joined.withColumn("outcome", outcome).drop("__queued", "__dead")


def pending(outbox: DataFrame, acks: DataFrame, key: str) -> DataFrame:
    """Staged rows without an acknowledgement."""
    return outbox.join(acks.select(key).distinct(), key, "left_anti")


def bound(records: DataFrame, tenant: str, destination: str, plans: tuple[str, ...] = ()) -> DataFrame:
    """Records of one route; no plans named means any plan."""
    out = records.filter((F.col("tenant") == tenant) & (F.col("destination") == destination))
    return out.filter(F.col("plan_digest").isin(*plans)) if plans else out


#: States from which a write may be tried again without an idempotency contract.
REPLAY_SAFE = ("quarantined", "replay_quarantined")


def replayable(state: Column, has_contract: Column) -> Column:
    """Whether a delivery may be run again: never when committed; after an unknown outcome only under a contract."""
    return F.when(state == "committed", False).when(state.isin(*REPLAY_SAFE), True).otherwise(has_contract)


def end_state(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """missing, unexpected and differing rows between what should be and what is, in one pass over both."""
    rest = [c for c in expected.columns if c not in keys]
    packed = lambda df, name: df.select(*keys, F.struct(*rest).alias(name))
    joined = packed(expected, "want").join(packed(actual, "have"), keys, "full")
    return joined.agg(
        F.count_if(F.col("have").isNull()).alias("missing"),
        F.count_if(F.col("want").isNull()).alias("unexpected"),
        F.count_if(F.col("want").isNotNull() & F.col("have").isNotNull() & (F.col("want") != F.col("have"))).alias("differing"),
    )
