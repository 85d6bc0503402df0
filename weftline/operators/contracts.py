"""Contracts of events, decisions and recipe runs, as tables of what is allowed that rows are joined to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stages of a workflow that report summaries.
STAGES = (
    "fixture_generation", "destination_setup", "content_inspection", "source_schema_inspection", "target_schema_inspection",
    "mapping_and_plan", "full_preflight", "security_and_state_setup", "source_record_read", "source_seal_and_outbox_stage",
    "outbox_reload_and_relay_enqueue", "relay_lease", "destination_delivery", "acknowledgements",
    "destination_audit_outcome_check", "destination_operational_event_check", "end_to_end_verification", "workflow_internal",
    "resource_cleanup",
)
#: The one reason that may come with a success.
WARNING = "sealed_spool_cleanup_failed"
WORKFLOW, RUNTIME = "workflow_benchmark", "destination_runtime"
#: Event types, components, status, the kinds of reason that may come with it (none, warning, other), the
#: least and the most item count, whether a duration is needed.
EVENTS = (
    (("workflow_started",), (WORKFLOW,), "started", ("none",), 0, None, False),
    (("workflow_completed",), (WORKFLOW,), "passed", ("none",), 0, None, False),
    (("workflow_completed",), (WORKFLOW,), "failed", ("warning", "other"), 0, None, False),
    (("batch_completed",), (WORKFLOW,), "passed", ("none",), 1, None, False),
    (("stage_summary",), STAGES, "passed", ("none",), 0, None, True),
    (("stage_summary",), STAGES, "failed", ("warning", "other"), 0, None, True),
    (("delivery", "replay", "force_replay"), (RUNTIME,), "delivered", ("none", "warning"), 1, 1, False),
    (("delivery", "replay", "force_replay"), (RUNTIME,), "duplicate", ("none", "warning"), 1, 1, False),
    (("delivery", "replay", "force_replay"), (RUNTIME,), "ambiguous", ("warning", "other"), 1, 1, False),
    (("delivery", "replay", "force_replay"), (RUNTIME,), "quarantined", ("warning", "other"), 1, 1, False),
    (("delivery_batch",), (RUNTIME,), "delivered", ("none", "warning"), 1, None, False),
    (("delivery_batch",), (RUNTIME,), "ambiguous", ("warning", "other"), 1, None, False),
    (("delivery_batch",), (RUNTIME,), "quarantined", ("warning", "other"), 1, None, False),
)


def event_rules(spark: SparkSession, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """The table, one row for each event type, component, status and kind of reason."""
    rows = [
        (event, component, status, reason, least, most, timed)
        for events, components, status, reasons, least, most, timed in EVENTS
        for event in events
        for component in (stages if components is STAGES else components)
        for reason in reasons
    ]
    return spark.createDataFrame(rows, "event_type string, component string, status string, reason_kind string, least_items long, most_items long, needs_duration boolean")


def events_judged(events: DataFrame) -> DataFrame:
    """events (event_type, component, status, reason_code, item_count, duration_ms) with valid."""
    rules = event_rules(events.sparkSession)
    kind = F.when(F.col("reason_code").isNull(), "none").when(F.col("reason_code") == WARNING, "warning").otherwise("other")
    keys = ["event_type", "component", "status", "reason_kind"]
    found = events.withColumn("reason_kind", kind).join(F.broadcast(rules), keys, "left")
    counted = (F.col("item_count") >= F.col("least_items")) & (F.col("most_items").isNull() | (F.col("item_count") <= F.col("most_items")))
    valid = counted & (~F.col("needs_duration") | F.col("duration_ms").isNotNull())
    return found.withColumn("valid", F.coalesce(valid, F.lit(False))).select(*events.columns, "valid")


def decision_reasons(decisions: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """decisions (source_id, target_id, status, score, margin) with reasons: what breaks the contract, in a fixed order."""
    known = sources.select(F.col("id").alias("source_id")).distinct().withColumn("__source", F.lit(True))
    aims = targets.select(F.col("id").alias("target_id")).distinct().withColumn("__target", F.lit(True))
    unit = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) <= 1) & ~F.isnan(c), F.lit(False))
    acts = F.col("status").isin("auto", "review")
    broken = (
        (F.col("__source").isNull(), "decision_for_unknown_source"),
        (F.col("status").isNull() | ~F.col("status").isin("auto", "review", "blocked"), "invalid_mapping_status"),
        (~unit("score"), "invalid_score"),
        (~unit("margin"), "invalid_margin"),
        ((F.col("status") == "blocked") & F.col("target_id").isNotNull(), "blocked_decision_has_target"),
        (acts & F.col("target_id").isNull(), "actionable_decision_missing_target"),
        (acts & F.col("target_id").isNotNull() & F.col("__target").isNull(), "decision_for_unknown_target"),
    )
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for when, name in broken]))
    found = decisions.join(known, "source_id", "left").join(aims, "target_id", "left")
    return found.select(*decisions.columns, reasons.alias("reasons"))


#: Blocking findings after which a run is quarantined and not rejected.
QUARANTINING = ("foreign_key_lookup_failed", "input_record_limit_exceeded", "source_iteration_failed")


def run_outcomes(findings: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """runs (run, promotable, valid) with outcome and reason, by the first of their findings (run, place, code, severity, of_plan).

    A run that may be promoted is a success. One that is not valid is rejected for its plan's first blocking finding, else
    rejected or quarantined by its records' first one. A valid one is quarantined for its first finding that needs review.
    """
    first = lambda severity, plan: F.min_by("code", F.when((F.col("severity") == severity) & (F.col("of_plan") == plan), F.col("place")))
    sums = findings.groupBy(run).agg(first("blocking", True).alias("bp"), first("blocking", False).alias("br"), first("review", True).alias("rp"), first("review", False).alias("rr"))
    rows = runs.join(sums, run, "left")
    refused = F.coalesce(F.col("bp"), F.col("br"), F.lit("preflight_not_promotable"))
    held = F.col("bp").isNull() & F.col("br").isin(*QUARANTINING)
    outcome = F.when(F.col("promotable"), "success").when(~F.col("valid"), F.when(F.coalesce(held, F.lit(False)), "quarantined").otherwise("rejected")).otherwise("quarantined")
    reason = F.when(F.col("promotable"), "preflight_promotable").when(~F.col("valid"), refused).otherwise(F.coalesce("rp", "rr", F.lit("preflight_not_promotable")))
    return rows.select(*runs.columns, outcome.alias("outcome"), reason.alias("reason"))


def secret_bearing(fields: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """The fields (name, sensitivity, role) for which a schema must be refused: secrets and credentials that are not allowed by name."""
    bare: Column = F.trim(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", " "))
    return fields.filter(((F.col("sensitivity") == "secret") | (F.col("role") == "credential")) & ~bare.isin(*allowed) if allowed else (F.col("sensitivity") == "secret") | (F.col("role") == "credential"))


def reranked(candidates: DataFrame, scores: DataFrame, top: int = 4, least: float = 0.50, most_margin: float = 0.16, weight: float = 0.18, auto: float = 0.90, det_margin: float = 0.08) -> DataFrame:
    """candidates (pair, source_id, target_id, det, score, safe, t_position) with reranked and score: the first `top` of a source are
    mixed with the reranker's scores (pair, source_id, target_id, rerank), but only where the deterministic winner is not decisive
    (its score, its margin and its contract), and the best score is high enough and near enough to the next.
    """
    from pyspark.sql import Window as W

    of = W.partitionBy("pair", "source_id")
    by_score, by_det = of.orderBy(F.desc("score"), "t_position"), of.orderBy(F.desc("det"), F.desc("score"), "t_position")
    rows = candidates.withColumn("__place", F.row_number().over(by_score)).withColumn("__det_place", F.row_number().over(by_det))
    at = lambda c, place, n: F.max(F.when(F.col(place) == n, F.col(c))).over(of)
    decisive = (at("det", "__det_place", 1) >= auto) & (at("det", "__det_place", 1) - at("det", "__det_place", 2) >= det_margin) & at("safe", "__det_place", 1)
    asked = (F.count(F.lit(1)).over(of) >= 2) & ~F.coalesce(decisive, F.lit(False)) & (at("score", "__place", 1) >= least) & (at("score", "__place", 1) - at("score", "__place", 2) <= most_margin)
    rows = rows.withColumn("__asked", asked & (F.col("__place") <= max(2, top)))
    rows = rows.join(scores.select("pair", "source_id", "target_id", "rerank"), ["pair", "source_id", "target_id"], "left")
    mixed = (1 - weight) * F.col("score") + weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rerank")))
    used = F.col("__asked") & F.col("rerank").isNotNull()
    return rows.select(*[c for c in candidates.columns if c != "score"], F.when(used, mixed).otherwise(F.col("score")).alias("score"), used.alias("reranked"))
