"""Reason codes as a dimension: what kind of failure a code is, and whether the work may be tried again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Category, retry policy, codes.
REASONS = (
    ("audit", "do_not_retry_delivery", "audit_public_key_missing"),
    ("audit", "do_not_retry_delivery_for_audit", "audit_event_count_mismatch"),
    ("audit", "never_retry_delivery_for_audit", "destination_audit_status_unexpected"),
    ("blast_radius", "do_not_retry_unchanged", "input_record_limit_exceeded"),
    ("confidentiality", "inspect_before_retry", "known_plaintext_canary_found_in_blind_state"),
    ("connector_contract", "never_blind_retry", "replay_capability_changed"),
    ("connector_contract", "safe_after_configuration_change", "atomic_batch_capability_changed destination_capability_changed"),
    ("coordination", "inspect_before_retry", "delivery_claim_in_progress relay_lease_count_mismatch relay_not_empty"),
    ("coordination", "safe_after_current_claim", "delivery_claim_lost"),
    ("destination_contract", "do_not_retry_unchanged", "destination_contract_failed required_target_null required_target_unmapped"),
    ("destination_contract", "inspect_before_retry", "nullable_source_to_required_target"),
    ("destination_lookup", "do_not_retry_unchanged", "foreign_key_lookup_contract_invalid foreign_key_lookup_input_type_mismatch foreign_key_lookup_invalid "
     "foreign_key_lookup_source_type_unknown foreign_key_lookup_type_mismatch foreign_key_resolved_null foreign_key_resolved_type_mismatch"),
    ("destination_lookup", "inspect_before_retry", "foreign_key_lookup_not_exercised foreign_key_lookup_type_unknown"),
    ("destination_lookup", "safe_after_fix", "destination_resolution_failed foreign_key_lookup_failed"),
    ("destination_verification", "inspect_before_retry", "destination_row_count_mismatch verification_query_returned_no_row"),
    ("destination_verification", "never_blind_retry", "destination_content_mismatch"),
    ("destination_write", "inspect_before_retry", "destination_delivery_not_delivered"),
    ("destination_write", "safe_to_retry", "write_not_committed"),
    ("information_flow", "inspect_before_retry", "local_mode_requires_encrypted_transport policy_violation"),
    ("input_inspection", "do_not_retry_unchanged", "source_content_not_delimited_text source_content_unsafe"),
    ("local_cleanup", "never_retry_delivery_for_cleanup", "sealed_spool_cleanup_failed"),
    ("local_durability", "inspect_before_retry", "outbox_pending_count_mismatch"),
    ("local_durability", "never_blind_retry", "delivery_outcome_record_failed ledger_commit_count_mismatch"),
    ("local_durability", "retry_existing_wire_only", "source_outbox_ack_missing source_outbox_not_empty"),
    ("mapping", "do_not_retry_unchanged", "mapping_fixture_mismatch"),
    ("mapping", "inspect_before_retry", "mapping_blocked mapping_not_fully_automatic mapping_review_required no_auto_approved_mapping_rules"),
    ("observability", "do_not_append", "observability_stream_invalid"),
    ("observability", "do_not_retry_delivery_for_event", "destination_operational_event_context_missing"),
    ("observability", "inspect_before_retry", "observability_event_contract_invalid observability_event_count_mismatch observability_lifecycle_invalid "
     "operational_event_contract_invalid operational_failure_status_present operational_run_not_closed operational_run_not_found operational_workflow_count_mismatch"),
    ("observability", "never_retry_delivery_for_event", "destination_operational_event_status_unexpected"),
    ("observability", "safe_after_fix", "observability_append_failed"),
    ("parser_containment", "do_not_retry_on_same_host_task", "worker_termination_failed"),
    ("parser_containment", "do_not_retry_unchanged", "input_snapshot_changed protocol_error request_mismatch worker_failed worker_output_limit worker_timeout"),
    ("parser_containment", "inspect_before_retry", "snapshot_failed worker_io_failed"),
    ("parser_containment", "safe_after_capacity_change", "insufficient_free_space"),
    ("parser_containment", "safe_after_configuration_change", "backend_unavailable containment_too_weak worker_start_failed"),
    ("parser_containment", "safe_after_input_change", "input_not_regular input_reparse_point input_symlink"),
    ("parser_containment", "safe_after_input_stabilized", "input_changed"),
    ("parser_containment", "safe_after_reviewed_policy_change", "input_too_large"),
    ("plan_binding", "do_not_retry_unchanged", "source_schema_drift source_schema_id_mismatch target_schema_drift target_schema_id_mismatch"),
    ("plan_contract", "do_not_retry_unchanged", "duplicate_target mapping_plan_incomplete unknown_source_field unknown_target_field"),
    ("plan_contract", "inspect_before_retry", "type_mismatch"),
    ("plan_contract", "safe_after_preparation", "prepared_route_incomplete"),
    ("preflight", "do_not_auto_promote", "preflight_not_promotable sampled_scan"),
    ("preflight", "inspect_before_retry", "preflight_promotable"),
    ("quarantine", "inspect_before_retry", "quarantine_not_empty"),
    ("recipe_drift", "inspect_before_retry", "recipe_rebind_failed"),
    ("recipe_health", "inspect_before_retry", "recipe_auto_reuse_suspended"),
    ("relay_intake", "do_not_retry_unchanged", "relay_wire_invalid"),
    ("source_contract", "do_not_retry_unchanged", "record_schema_mismatch required_source_missing"),
    ("source_contract", "inspect_before_retry", "source_type_unknown"),
    ("source_data", "do_not_auto_promote", "empty_source"),
    ("source_read", "do_not_retry_unchanged", "source_record_count_mismatch"),
    ("source_read", "safe_after_fix", "source_iteration_failed"),
    ("source_stability", "do_not_execute_mutable_source", "source_snapshot_unproven"),
    ("source_trust", "do_not_retry_unchanged", "relay_source_authentication_failed source_record_not_signed"),
    ("spreadsheet_freshness", "inspect_before_retry", "spreadsheet_formula_cache"),
    ("transfer_policy", "do_not_retry_unchanged", "relay_policy_rejected relay_transfer_expired"),
    ("transform", "do_not_retry_unchanged", "source_transform_failed transformed_type_mismatch unknown_transform"),
    ("transport_integrity", "do_not_retry_unchanged", "transport_verification_failed"),
    ("transport_integrity", "never_retry", "relay_digest_mismatch"),
    ("workflow_internal", "inspect_before_retry", "workflow_stage_failed"),
    ("write_ambiguity", "never_blind_retry", "atomic_batch_write_outcome_unknown destination_write_count_unproven destination_write_exception_unknown "
     "previous_delivery_ambiguous previous_write_started_ambiguous write_outcome_unknown"),
    ("write_ambiguity", "never_retry_complete_batch", "destination_write_partial"),
)
#: What holds of a code that is in no list.
UNKNOWN = ("unknown", "inspect_before_retry")


def reasons(spark: SparkSession) -> DataFrame:
    """code, category, retry_policy: about a hundred rows, each code once."""
    rows = [(code, category, policy) for category, policy, codes in REASONS for code in codes.split()]
    return spark.createDataFrame(rows, "code string, category string, retry_policy string")


def explained(rows: DataFrame, code: str) -> DataFrame:
    """rows with category and retry_policy of their code (the column of that name); null codes have neither, unknown ones the
    unknown category. The dimension has a fixed size, so it is broadcast."""
    known = reasons(rows.sparkSession).select(F.col("code").alias("__code"), F.col("category").alias("__category"), F.col("retry_policy").alias("__policy"))
    found = rows.join(F.broadcast(known), F.col(code) == F.col("__code"), "left")
    of = lambda c, other: F.when(F.col(code).isNotNull(), F.coalesce(c, F.lit(other)))
    return found.select(*[rows[c] for c in rows.columns], of("__category", UNKNOWN[0]).alias("category"), of("__policy", UNKNOWN[1]).alias("retry_policy"))
