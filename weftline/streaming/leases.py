"""Claims, leases and checkpoints that outlive a batch: keyed state with timers, folded request by request.

Each identity has one state row in the state store. A micro-batch brings an identity's requests together, which are judged in the
order of `seq` against the state that the ones before have left, also those of former batches and of former runs of the query: the
checkpoint folder holds the state. A timer in event time wakes the state when its lease has run out; a lapse is a row of the output.

Rows within one batch may come in any order. Across batches `seq` must go upwards for an identity. Rows older than the watermark are
dropped by Spark, which counts them in the query's progress: `late` must cover the disorder of the source. Rules that never wake have no
watermark and drop nothing. A null identity is one identity. Requests of one identity in one batch are held by one task, so the source's rate limit (files or bytes for each trigger)
bounds it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, StructField, StructType

from weftline.operators.state import REPLAY_SAFE, TRANSITIONS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Outcomes of an identity that leave Python as one row of arrays: a row for each would cost far more than judging it.
PACK = 4096


class Rules(NamedTuple):
    """What an identity holds (DDL), how a request changes it, when it wants to be woken, and what happens then.

    step(held or None, request) and lapse(held) return the outcome and what is held afterwards; wake(held) returns milliseconds or None.
    `request` has the columns named in `needs`, `seq`, `action` and `at_ms`. All three run on executors and refer to nothing of this package.
    Without wake and lapse nothing depends on time: there are no timers, no watermark and no `at_ms`.
    """

    held: str
    needs: tuple[str, ...]
    step: Callable
    wake: Callable | None = None
    lapse: Callable | None = None


def ledger_rules(ttl_ms: int, keep_ms: int | None = None) -> Rules:
    """The delivery ledger: claim, renew, rearm and the writes of TRANSITIONS, fenced by the token of the last claim.

    Claims: new, recovered (the lease of a claim has run out), in_progress, already_committed, ambiguous, replay_detected (another
    digest or plan). Writes: accepted, refused (no such step), fenced (another token), lapsed (needs a live lease). Renewals: renewed or
    lost. Rearming: rearmed, refused_committed, refused_active, refused_contract. Without a claim: unknown. Committed identities are
    kept for ever, or forgotten keep_ms after their last change (`forgotten`), after which their identity is new again.
    """
    table = {(s, e): (following, live) for s, e, following, live in TRANSITIONS if e not in ("claim", "rearm")}
    claimed, safe = ("claimed", "replay_claimed"), (*REPLAY_SAFE, "claimed", "replay_claimed")

    def step(held, r):
        at = r["at_ms"]
        if r["action"] == "claim" and held is None:
            return "new", ("claimed", r["digest"], r["plan"], r["token"], at + ttl_ms, 1, at, False)
        if held is None:
            return "unknown", None
        state, digest, plan, token, until, claims, _, _ = held
        live = at < until
        if (r["digest"], r["plan"]) != (digest, plan):
            return "replay_detected", held
        taken = lambda following: (following, digest, plan, r["token"], at + ttl_ms, claims + 1, at, False)
        if r["action"] == "claim":
            if state == "committed":
                return "already_committed", held
            if state in claimed and live:
                return "in_progress", held
            return ("recovered", taken("claimed")) if state == "claimed" and token is not None else ("ambiguous", held)
        if r["action"] == "renew":
            if state in claimed and live and token is not None and token == r["token"]:
                return "renewed", (state, digest, plan, token, at + ttl_ms, claims, at, False)
            return "lost", held
        if r["action"] == "rearm":
            if state == "committed":
                return "refused_committed", held
            if state in claimed and live:
                return "refused_active", held
            if state not in safe and not r["contract"]:
                return "refused_contract", held
            return "rearmed", taken("claimed" if state == "quarantined" else "replay_claimed")
        following, needs_live = table.get((state, r["action"]), (None, False))
        if following is None:
            return "refused", held
        if token is None or token != r["token"]:
            return "fenced", held
        if needs_live and not live:
            return "lapsed", held
        return "accepted", (following, digest, plan, token, until, claims, at, False)

    def wake(held):
        if held[0] in claimed and not held[7]:
            return held[4]
        return held[6] + keep_ms if held[0] == "committed" and keep_ms is not None else None

    def lapse(held):
        return ("expired", (*held[:7], True)) if held[0] in claimed else ("forgotten", None)

    return Rules("state string, digest string, plan string, token string, lease_until long, claims long, changed_at long, expired boolean", ("digest", "plan", "token", "contract"), step, wake, lapse)


def lease_rules(ttl_ms: int) -> Rules:
    """Leases of a route by one holder: claim, renew, release; outcomes claimed, renewed, released, refused. A lease that runs out is
    removed from the state, so the state holds live leases only."""

    def step(held, r):
        at = r["at_ms"]
        free = held is None or at >= held[1]
        mine = not free and held[0] == r["holder"]
        if r["action"] == "claim" and (free or mine) and r["holder"] is not None:
            return "claimed", (r["holder"], at + ttl_ms)
        if r["action"] == "renew" and mine:
            return "renewed", (r["holder"], at + ttl_ms)
        if r["action"] == "release" and mine:
            return "released", None
        return "refused", held

    return Rules("holder string, until long", ("holder",), step, lambda held: held[1], lambda held: ("expired", None))


def checkpoint_rules() -> Rules:
    """Checkpoints of a route by compare-and-set: a proposal advances the generation that it expects (0: none yet). The run that made
    the present generation finds `repeated` with the same receipt, `receipt_conflict` with another; all others are `stale`."""

    def step(held, r):
        generation, run, receipt, total = held or (0, None, None, 0)
        if held is not None and r["run_id"] == run:
            return ("repeated" if r["receipt_digest"] == receipt else "receipt_conflict"), held
        if r["expected_generation"] != generation:
            return "stale", held
        return "advanced", (generation + 1, r["run_id"], r["receipt_digest"], total + r["committed"])

    return Rules("generation long, run_id string, receipt_digest string, committed_total long", ("expected_generation", "run_id", "receipt_digest", "committed"), step)


def _processor(rules: Rules, keys: int, names: list[str]) -> StatefulProcessor:
    """The fold of one identity; the class is made here so that it travels to the executors by value."""
    fields, step, wake, lapse, pack = rules.held, rules.step, rules.wake, rules.lapse, PACK

    class Fold(StatefulProcessor):
        def init(self, handle):
            from pyspark.sql import Row

            self.handle = handle
            self.state = handle.getValueState("held", fields)
            self.made = Row(*names)
            self.blank = (None,) * (len(names) - keys - 3)

        def read(self):
            held = self.state.get()
            return None if held is None else tuple(held)

        def keep(self, before, held):
            """An identity that holds something has the timer that it asks for, and no other."""
            if held is None:
                if before is not None:
                    self.state.clear()
            elif held != before:
                self.state.update(held)
            if wake is None:
                return
            was, at = (None if x is None else wake(x) for x in (before, held))
            if was != at:
                if was is not None:
                    self.handle.deleteTimer(was)
                if at is not None:
                    self.handle.registerTimer(at)

        def packed(self, key, results):
            """results (seq, action, outcome, held) as a row of arrays."""
            columns = zip(*((seq, action, outcome, *(held or self.blank)) for seq, action, outcome, held in results), strict=True)
            return self.made(*tuple(key)[:keys], *map(list, columns))

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            before = held = self.read()
            results = []
            # Fields of a dictionary are found faster than those of a row.
            for r in sorted((r.asDict() for r in rows), key=lambda r: r["seq"]):
                outcome, held = step(held, r)
                results.append((r["seq"], r["action"], outcome, held))
                if len(results) == pack:
                    yield self.packed(key, results)
                    results = []
            if results:
                yield self.packed(key, results)
            self.keep(before, held)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            before = self.read()
            outcome, held = lapse(before)
            yield self.packed(key, [(None, "expire", outcome, held or before)])
            self.keep(before, held)

        def close(self):
            pass

    return Fold()


def judged(requests: DataFrame, identity: list[str], rules: Rules, late: str = "10 minutes") -> DataFrame:
    """requests (a stream of identity, seq, at, action and what the rules need) with outcome and what is held after each; lapses have
    no seq and the action `expire`."""
    columns = [*identity, "seq", "action", *rules.needs]
    if rules.wake is None:
        rows, mode = requests.select(*columns), "None"
    else:
        rows, mode = requests.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at")).select(*columns, "at", "at_ms"), "EventTime"
    keys = requests.select(*identity).schema
    made = [*StructType.fromDDL("seq long, action string, outcome string").fields, *StructType.fromDDL(rules.held).fields]
    out = StructType([*keys.fields, *(StructField(f.name, ArrayType(f.dataType)) for f in made)])
    packed = rows.groupBy(*identity).transformWithState(_processor(rules, len(identity), out.names), out, "Append", mode)
    return packed.select(*identity, F.inline(F.arrays_zip(*[f.name for f in made])))


def run(requests: DataFrame, identity: list[str], rules: Rules, target: str, checkpoint: str, late: str = "10 minutes"):
    """Judges all requests that the source has, appends them to `target` (Parquet) and stops; the next run goes on from there."""
    spark = requests.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        stream = judged(requests, identity, rules, late).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        started = stream.trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    started.awaitTermination()
    return started


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What each identity holds after the last run, read from the state store."""
    rows = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    return rows.select("key.*", "value.*")
