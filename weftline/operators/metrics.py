"""Summaries of runs: events, latencies, batches, recommendations, reviews, policies, benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def event_summary(events: DataFrame, keys: list[str], order: str, event_id: str, kind: str) -> DataFrame:
    """By keys: events, distinct ids, duplicates, first and last order and type."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        (F.count(F.lit(1)) - F.count_distinct(event_id)).alias("duplicate_ids"),
        F.min(order).alias("first_at"),
        F.max(order).alias("last_at"),
        F.min_by(kind, F.struct(order, event_id)).alias("first_type"),
        F.max_by(kind, F.struct(order, event_id)).alias("last_type"),
    )


#: What events are counted by, beside the whole run.
FACETS = ("component", "event_type", "status", "reason_code")


def event_stream_summary(events: DataFrame, run: str, order: str, event_id: str, first: str, last: tuple[str, ...]) -> DataFrame:
    """By run, and by run and each of FACETS: run, facet (`run` or the column), value, events, duplicate_ids, first_at, last_at,
    first_type, last_type, contract_valid (all events are, as `valid` says); for whole runs lifecycle_valid too, else null.

    One shuffle serves all groupings. A run's life cycle is sound if it begins with `first`, ends with one of `last` and has each once.
    """
    sets = [[F.col(run)], *[[F.col(run), F.col(c)] for c in FACETS]]
    kind, at = F.col("event_type"), F.struct(order, event_id)
    facet = F.lit("run")
    value = F.lit(None).cast("string")
    for c in FACETS:
        # grouping() is 0 for the columns of the set that a row belongs to.
        facet = F.when(F.grouping(c) == 0, c).otherwise(facet)
        value = F.when(F.grouping(c) == 0, F.col(c)).otherwise(value)
    # The kind of event is read as an ordinary column too, which the sets must not set to null.
    rows = events.withColumn("__kind", kind)
    kind = F.col("__kind")
    sound = (F.min_by(kind, at) == first) & F.max_by(kind, at).isin(*last) & (F.count_if(kind == first) == 1) & (F.count_if(kind.isin(*last)) == 1)
    whole = F.lit(True)
    for c in FACETS:
        whole = whole & (F.grouping(c) == 1)
    return rows.groupingSets(sets, run, *FACETS).agg(
        facet.alias("facet"),
        value.alias("value"),
        F.count(F.lit(1)).alias("events"),
        (F.count(F.lit(1)) - F.count_distinct(event_id)).alias("duplicate_ids"),
        F.min(order).alias("first_at"),
        F.max(order).alias("last_at"),
        F.min_by(kind, at).alias("first_type"),
        F.max_by(kind, at).alias("last_type"),
        F.bool_and(F.coalesce("valid", F.lit(False))).alias("contract_valid"),
        F.when(whole, F.coalesce(sound, F.lit(False))).alias("lifecycle_valid"),
    ).select(run, "facet", "value", "events", "duplicate_ids", "first_at", "last_at", "first_type", "last_type", "contract_valid", "lifecycle_valid")


#: Latencies that a stage keeps.
RESERVOIR = 10_000


def stage_accumulator(calls: DataFrame, stage: list[str], id: str, wall: str, cpu: str, items: str, reservoir: int = RESERVOIR) -> DataFrame:
    """By stage: calls, items, wall and cpu sums, throughput (items for each unit of wall), and p50 and p95 of a reservoir of
    latencies: those `reservoir` calls whose ids have the smallest SHA-256. The choice depends on the ids alone, so every run,
    and every order of merging, keeps the same calls. Each task hands on no more than the reservoir of a stage."""
    sums = calls.groupBy(*stage).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(items).alias("items"),
        F.sum(wall).alias("wall"),
        F.sum(cpu).alias("cpu"),
        F.try_divide(F.sum(items), F.sum(wall)).alias("throughput"),
    )
    digest = F.sha2(F.coalesce(F.col(id).cast("string"), F.lit("")), 256)
    chosen = calls.select(*stage, F.col(wall).alias("__wall"), digest.alias("__digest"), F.col(id).alias("__id"))
    # The limit on the row number is taken before the shuffle as well as after it.
    place = F.row_number().over(W.partitionBy(*stage).orderBy("__digest", "__id", "__wall"))
    kept = chosen.withColumn("__place", place).filter(F.col("__place") <= reservoir)
    ranks = kept.groupBy(*stage).agg(F.percentile("__wall", 0.5).alias("p50"), F.percentile("__wall", 0.95).alias("p95"), F.count(F.lit(1)).alias("kept"))
    return _joined(sums, ranks, stage)


#: Rows up to which a group's values may be held in one task for exact percentiles; more are ranked in two levels.
HELD_ROWS = 2_000_000
#: Ranges of values into which a group is dealt.
RANGES = 256


def percentiles(df: DataFrame, keys: list[str], points: dict[str, tuple[str, float]], held_rows: int | None = None) -> DataFrame:
    """keys and a column for each of points (name: value column and share): exact, by linear interpolation; nulls and NaN don't count.

    Large tables are never gathered by group. For each value column the rows are counted by distinct value, the values are
    dealt into ranges of about as many values each (by an approximate sketch of bounded size), ranks go on from range to range
    by running sums over the few ranges, and only the ranges that hold a wanted rank are sorted.
    """
    if df.limit((HELD_ROWS if held_rows is None else held_rows) + 1).count() <= (HELD_ROWS if held_rows is None else held_rows):
        return df.groupBy(*keys).agg(*[F.percentile(F.when(~F.isnan(c), F.col(c)), p).alias(name) for name, (c, p) in points.items()])
    out = df.select(*keys).distinct()
    for value in dict.fromkeys(c for c, _ in points.values()):
        shares = {name: p for name, (c, p) in points.items() if c == value}
        out = _joined(out, _ranked(df, keys, value, shares), keys)
    return out


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's columns, on keys that may be null."""
    side = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(side[f"__{k}"])
    return left.join(side, same, "left").drop(*[f"__{k}" for k in keys])


def _ranked(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    counts = rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    # What a range costs is its distinct values, so it is those that are dealt evenly: the sketch, which is dear, sees each once.
    bounds = counts.groupBy(*keys).agg(F.percentile_approx("v", steps, 10 * RANGES).alias("bounds"), F.sum("n").alias("all"))
    # The number of bounds below the value, by halving: beyond the last bound nothing is there, which counts as not below.
    dealt = _joined(counts, bounds, keys).withColumn("range", F.lit(0))
    for step in (2**i for i in reversed(range((RANGES - 1).bit_length()))):
        below = F.get("bounds", F.col("range") + F.lit(step - 1)) < F.col("v")
        dealt = dealt.withColumn("range", F.col("range") + F.when(below, step).otherwise(0))
    dealt = dealt.drop("bounds")
    ranges = dealt.groupBy(*keys, "range").agg(F.sum("n").alias("n"), F.first("all").alias("all"))
    before = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = F.array(*[f(F.lit(p) * (F.col("all") - 1)) for p in shares.values() for f in (F.floor, F.ceil)])
    ranges = ranges.filter(F.exists(wanted, lambda r: (r >= F.col("from")) & (r < F.col("from") + F.col("n")))).select(*keys, "range", "from")
    inside = W.partitionBy(*keys, "range").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    side = ranges.withColumnRenamed("range", "__r")
    held = _joined(dealt, side.withColumnRenamed("__r", "range"), [*keys, "range"]).filter("`from` is not null")
    held = held.withColumn("first", F.col("from") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    at = lambda rank: F.max(F.when((rank >= F.col("first")) & (rank < F.col("first") + F.col("n")), F.col("v")))
    columns = []
    for i, (name, p) in enumerate(shares.items()):
        rank = F.lit(p) * (F.col("all") - 1)
        columns += [at(F.floor(rank)).alias(f"__low{i}"), at(F.ceil(rank)).alias(f"__high{i}")]
    found = held.groupBy(*keys).agg(*columns, F.first("all").alias("__all"))
    part = lambda p: F.lit(p) * (F.col("__all") - 1) - F.floor(F.lit(p) * (F.col("__all") - 1))
    return found.select(*keys, *[(F.col(f"__low{i}") * (1 - part(p)) + F.col(f"__high{i}") * part(p)).alias(name) for i, (name, p) in enumerate(shares.items())])


def latency(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, total, throughput of the value, and percentiles by linear interpolation."""
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.round(F.sum(value), 4).alias("total"),
        F.round(F.try_divide(F.count(F.lit(1)), F.sum(value)), 6).alias("rate"),
    )
    ranks = percentiles(df, keys, {"p50": (value, 0.5), "p95": (value, 0.95)})
    return _joined(sums, ranks, keys).withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6))


def batch_profile(runs: DataFrame) -> DataFrame:
    """runs (batch_size, throughput, wall, rss, success) by batch size: medians and ranges."""
    sums = runs.groupBy("batch_size").agg(
        F.round(F.min("throughput"), 6).alias("min_throughput"),
        F.round(F.max("throughput"), 6).alias("max_throughput"),
        F.max("rss").alias("max_rss"),
        F.count_if("success").alias("successes"),
        F.count(F.lit(1)).alias("runs"),
    )
    ranks = percentiles(runs, ["batch_size"], {"median_throughput": ("throughput", 0.5), "median_wall": ("wall", 0.5)})
    return _joined(sums, ranks, ["batch_size"]).withColumn("median_throughput", F.round("median_throughput", 6)).withColumn("median_wall", F.round("median_wall", 6))


def recommend_batch(profile: DataFrame, budget: float, tolerance: float = 0.02) -> DataFrame:
    """The batch size to use: within the budget, near the fastest, then the least memory, then the smallest."""
    able = profile.filter(F.col("max_rss") <= budget)
    fastest = able.agg(F.max("median_throughput").alias("best"))
    near = able.crossJoin(F.broadcast(fastest)).filter(F.col("median_throughput") >= F.col("best") * (1 - tolerance))
    chosen = near.agg(F.min(F.struct("max_rss", "batch_size")).alias("c"))
    least = profile.agg(F.min("max_rss").alias("minimum_required"))
    return chosen.crossJoin(least).select(F.when(F.col("c").isNull(), "blocked").otherwise("recommended").alias("status"), F.col("c.batch_size").alias("batch_size"), "minimum_required")


def review_summary(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """reviews (fields, accepted, corrected, abstained, minutes): totals, consistent sessions, fields for each minute."""
    return reviews.groupBy(*keys).agg(
        F.sum("fields").alias("fields"),
        F.sum("accepted").alias("accepted"),
        F.sum("corrected").alias("corrected"),
        F.sum("abstained").alias("abstained"),
        F.count_if(F.col("accepted") + F.col("corrected") + F.col("abstained") == F.col("fields")).alias("consistent"),
        F.round(F.try_divide(F.sum("fields"), F.sum("minutes")), 6).alias("fields_per_minute"),
    )


#: Statuses of the metadata policy, the first that applies.
POLICY = ("block", "signed_strip", "signature_impact", "unknown_signature", "impact_review", "review", "sanitize")


def policy_status(observations: DataFrame, key: str) -> DataFrame:
    """observations (key, action, ...) to the counts of actions and the status by precedence."""
    counts = [F.count_if(F.col("action") == a).alias(f"n_{a}") for a in POLICY]
    status = F.lit("pass")
    for action in reversed(POLICY):
        status = F.when(F.col(f"n_{action}") > 0, action).otherwise(status)
    return observations.groupBy(key).agg(*counts).withColumn("status", status)


def mapping_benchmark(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """decisions (source_id, target_id, status) against labels (source_id, expected): automatic precision, coverage, suggestion accuracy.

    Precision is null without automatic decisions; rates without labels are 1.
    """
    joined = labels.join(decisions, "source_id", "left")
    auto, labelled = F.col("status") == "auto", F.col("expected").isNotNull()
    right = F.col("target_id").eqNullSafe(F.col("expected"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(1.0))
    return joined.agg(
        F.count(F.lit(1)).alias("fields"),
        F.count_if(auto).alias("automatic"),
        F.count_if(auto & ~right).alias("unsafe_automatic"),
        F.round(F.try_divide(F.count_if(auto & right), F.count_if(auto)), 6).alias("auto_precision"),
        F.round(rate(F.count_if(auto & labelled), F.count_if(labelled)), 6).alias("auto_coverage"),
        F.round(rate(F.count_if(labelled & right), F.count_if(labelled)), 6).alias("suggestion_accuracy"),
    )


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a pre-aggregated maximum of the whole row instead of a sorted window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__last")).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in [*order, *rest]])


def lifecycle(events: DataFrame, run: str, order: str, kind: str, first: str, last: tuple[str, ...]) -> DataFrame:
    """By run: whether it starts with `first`, ends with one of `last`, and has each of them once."""
    sums = events.groupBy(run).agg(
        F.min_by(kind, order).alias("begin"), F.max_by(kind, order).alias("end"), F.count_if(F.col(kind) == first).alias("starts"), F.count_if(F.col(kind).isin(*last)).alias("ends")
    )
    sound = (F.col("begin") == first) & F.col("end").isin(*last) & (F.col("starts") == 1) & (F.col("ends") == 1)
    return sums.select(run, F.coalesce(sound, F.lit(False)).alias("valid"))


def expired(expires_at: Column, now: Column) -> Column:
    return now > expires_at


def lease_available(lease_expires_at: Column, now: Column) -> Column:
    return lease_expires_at.isNull() | (lease_expires_at <= now)


def unsigned_mod(hexadecimal: Column, n: int) -> Column:
    """The first 8 bytes of a hexadecimal digest as an unsigned number, modulo n."""
    return (F.conv(F.substring(hexadecimal, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n).cast("decimal(20,0)")).cast("long")
