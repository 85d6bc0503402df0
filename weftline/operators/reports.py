"""Texts of events, gates over run reports, and the choice of source columns for fixed targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("de", "en")


def filled(template: Column, parameters: Column) -> Column:
    """template with {key} replaced by parameters (map of texts); a key that is missing or null stays as it stands, like a lone brace; {{ and }} are braces."""
    pieces = F.regexp_extract_all(template, F.lit(r"(\{\{|\}\}|\{[A-Za-z0-9_]++\}|[^{}]++|[{}])"), 1)

    def text(piece: Column) -> Column:
        key = F.substring(piece, F.lit(2), F.length(piece) - 2)
        given = F.coalesce(F.try_element_at(parameters, key), piece)
        return F.when(piece == "{{", "{").when(piece == "}}", "}").when(piece.startswith("{") & piece.endswith("}"), given).otherwise(piece)

    return F.array_join(F.transform(pieces, text), "")


def messages(events: DataFrame, catalog: DataFrame, key: str, locale: str, parameters: str, default: str | None = None) -> DataFrame:
    """events with message: the template of their key in the locale's language (English for others), else the default, else the key.

    catalog: message_key, language, template; its key pairs are distinct. A null key gives a null message.
    """
    first = F.element_at(F.split(F.lower(F.coalesce(F.col(locale), F.lit("en"))), "[-_]"), 1)
    language = F.when(first.isin(*LANGUAGES), first).otherwise("en")
    side = catalog.select(F.col("message_key").alias("__key"), F.col("language").alias("__language"), F.col("template").alias("__template"))
    rows = events.withColumn("__spoken", language)
    rows = rows.join(side, (F.col(key) == F.col("__key")) & (F.col("__spoken") == F.col("__language")), "left")
    otherwise = F.coalesce(F.col(default), F.col(key)) if default else F.col(key)
    template = F.when(F.col(key).isNotNull(), F.coalesce(F.col("__template"), otherwise))
    empty = F.create_map().cast("map<string,string>")
    return rows.withColumn("message", filled(template, F.coalesce(F.col(parameters), empty))).select(*events.columns, "message")


#: What a run report holds. Counts that equal the records, counts that are zero, and flags that are true.
PROGRESS = ("records_read", "records_staged", "records_relayed", "records_leased", "records_delivered", "records_acknowledged")
ROWS = ("destination_rows", "ledger_committed")
DEPTHS = ("outbox_depth", "relay_depth", "quarantine_depth", "mismatch_count")
PROOFS = ("content_verified", "known_plaintext_canaries_absent", "audit_signatures_verified")
STREAM = ("stream_valid", "run_closed", "workflow_lifecycle_valid", "event_ids_unique", "event_contract_valid", "workflow_counts_valid")
STAGES = ("source_seal_and_outbox_stage", "outbox_reload_and_relay_enqueue", "relay_lease", "destination_delivery", "acknowledgements")


#: Fixed value: records that a destination takes in one transaction, which makes one event of more than one record.
ATOMIC = 1_000


def atomic_events(records: Column, batch: Column) -> Column:
    """Events of transactions when records come in batches that are cut into transactions of at most ATOMIC records."""
    cut = lambda n: F.floor(n / ATOMIC) + (n % ATOMIC > 1).cast("long")
    return F.floor(records / batch) * cut(batch) + cut(records % batch)


def _equals(column: str, value: Column):
    return lambda s: s[column] == value


def gate(
    reports: DataFrame, stages: DataFrame, run: str, least_throughput: float, most_wall_seconds: float, most_peak_mib: float, records_expected: int | None = None, batch_expected: int | None = None
) -> DataFrame:
    """reports (a row for each run) by run: failures (codes, sorted) and passed. A value that is missing fails its check.

    reports: run, records, batch_size, success, failure, signed_audit, mode, tracing, resource_mode, resource_tracing,
    result_count, batches_completed, the columns of PROGRESS, ROWS, DEPTHS, PROOFS and STREAM, audit_events, delivery_events,
    delivery_batch_events (null counts as 0), throughput, wall_ms, peak_bytes.
    stages: run, name, status, reason_code, calls, items; a run's stages have distinct names.
    """
    same = lambda a, b: F.coalesce(F.col(a) == b, F.lit(False))
    records = F.col("records")
    batches = F.ceil(records / F.col("batch_size"))
    checks = [
        ("workflow_not_successful", same("success", F.lit(True)) & F.col("failure").isNull()),
        ("configuration_signed_audit_disabled", same("signed_audit", F.lit(True))),
        ("measurement_mode_not_comparable", same("mode", F.lit("standard")) & same("tracing", F.lit(False))),
        ("resource_measurement_mode_not_comparable", same("resource_mode", F.lit("standard")) & same("resource_tracing", F.lit(False))),
        ("resource_result_count_mismatch", same("result_count", records)),
        *[(f"progress_{c}_mismatch", same(c, records)) for c in PROGRESS],
        ("progress_batch_count_mismatch", same("batches_completed", batches)),
        *[(f"final_{c}_mismatch", same(c, records)) for c in ROWS],
        *[(f"final_{c}_not_zero", same(c, F.lit(0))) for c in DEPTHS],
        *[(f"final_{c}_false", same(c, F.lit(True))) for c in PROOFS],
        ("final_audit_event_count_mismatch", same("audit_events", records)),
        *[(f"observability_{c}_false", same(c, F.lit(True))) for c in STREAM],
        ("observability_delivery_event_count_mismatch", same("delivery_events", records)),
        ("observability_delivery_batch_event_count_mismatch", F.coalesce(F.coalesce("delivery_batch_events", F.lit(0)) == atomic_events(records, F.col("batch_size")), F.lit(False))),
        ("throughput_below_floor", F.coalesce(F.col("throughput") >= least_throughput, F.lit(False))),
        ("throughput_not_positive", F.coalesce(F.col("throughput") > 0, F.lit(False))),
        ("wall_time_above_ceiling", F.coalesce(F.col("wall_ms") <= most_wall_seconds * 1000, F.lit(False))),
        ("wall_time_not_positive", F.coalesce(F.col("wall_ms") > 0, F.lit(False))),
        ("peak_rss_above_ceiling", F.coalesce(F.col("peak_bytes") <= most_peak_mib * 1024 * 1024, F.lit(False))),
        ("peak_rss_not_positive", F.coalesce(F.col("peak_bytes") > 0, F.lit(False))),
    ]
    if records_expected is not None:
        checks.append(("configuration_record_count_mismatch", same("records", F.lit(records_expected))))
    if batch_expected is not None:
        checks.append(("configuration_batch_size_mismatch", same("batch_size", F.lit(batch_expected))))
    own = F.array_compact(F.array(*[F.when(~holds, F.lit(code)) for code, holds in checks]))
    # A stage is judged by its run's counts: one row for each run with its stages, of which there are a few.
    each = F.struct("name", "status", "reason_code", "calls", "items")
    held = stages.groupBy(F.col(run).alias("__run")).agg(F.collect_list(each).alias("__stages"))
    rows = reports.join(held, F.col(run).eqNullSafe(F.col("__run")), "left").withColumn("__batches", batches)
    rows = rows.withColumn("__stages", F.coalesce("__stages", F.array().cast(held.schema["__stages"].dataType)))
    code = lambda name, what: F.concat(F.lit("stage_"), name, F.lit(f"_{what}"))
    bad = F.transform(
        F.filter("__stages", lambda s: ~F.coalesce((s["status"] == "passed") & s["reason_code"].isNull(), F.lit(False))),
        lambda s: code(s["name"], "not_passed"),
    )
    required = []
    for name in STAGES:
        found = F.filter("__stages", _equals("name", F.lit(name)))
        required.append(F.when(F.size(found) == 0, code(F.lit(name), "missing")))
        there = F.try_element_at(found, F.lit(1))
        for column, want, what in (("calls", F.col("__batches"), "call_count_mismatch"), ("items", records, "item_count_mismatch")):
            required.append(F.when((F.size(found) > 0) & ~F.coalesce(there[column] == want, F.lit(False)), code(F.lit(name), what)))
    failures = F.array_sort(F.concat(own, bad, F.array_compact(F.array(*required))))
    return rows.select(run, failures.alias("failures")).withColumn("passed", F.size("failures") == 0)


def _asked(want: str):
    return lambda f: (f["id"] == want) | (f["name"] == want)


def _free(names: Column):
    return lambda f: F.array_contains(names, f["bare"]) & ~F.array_contains(F.col("__used"), f["id"])


def _barred(field: Column, harmless: tuple[str, ...]) -> Column:
    return field["secret"] & ~field["bare"].isin(*harmless) if harmless else field["secret"]


def resolved(fields: DataFrame, aliases: dict[str, list[str]], overrides: dict[str, str], bare, harmless: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """For each schema of fields (schema, id, name, sensitivity, role) and each target of aliases: source_id and status.

    status: override, alias, none (no field), not_unique (an override that fits no field or several), reused (an override
    whose field another has), ambiguous (several fields), or secret (the field must not be mapped). Overrides come first, in
    their order, then targets in theirs; a field serves one target. bare normalises names; aliases are given as it gives them.
    harmless: names under which a target may take a field that counts as secret.
    """
    unknown = [t for t in overrides if t not in aliases]
    if unknown:
        raise ValueError(f"unknown targets {unknown}")
    named = fields.withColumn("__bare", bare(F.col("name")))
    secret = (F.col("sensitivity") == "secret") | (F.col("role") == "credential")
    # The fields that any target could take; a schema has few.
    every = sorted({a for names in aliases.values() for a in names})
    asked = sorted(set(overrides.values()))
    close = F.col("__bare").isin(*every) | F.col("id").isin(*asked) | F.col("name").isin(*asked) if asked else F.col("__bare").isin(*every)
    kept = F.when(F.coalesce(close, F.lit(False)), F.struct("id", "name", F.col("__bare").alias("bare"), F.coalesce(secret, F.lit(False)).alias("secret")))
    rows = named.groupBy("schema").agg(F.collect_set(kept).alias("__fields"))
    used, out = F.array().cast("array<string>"), []
    order = [(t, True) for t in overrides] + [(t, False) for t in aliases if t not in overrides]
    for target, asked_for in order:
        if asked_for:
            want = overrides[target]
            found = F.filter("__fields", _asked(want))
            status = F.when(F.size(found) != 1, "not_unique").when(F.array_contains(F.col("__used"), F.get(found, F.lit(0))["id"]), "reused")
        else:
            names = F.array(*map(F.lit, aliases[target]))
            found = F.filter("__fields", _free(names))
            status = F.when(F.size(found) > 1, "ambiguous").when(F.size(found) == 0, "none")
        if not out:
            rows = rows.withColumn("__used", used)
        status = F.coalesce(status, F.when(_barred(F.get(found, F.lit(0)), (harmless or {}).get(target, ())), "secret"), F.lit("override" if asked_for else "alias"))
        column = f"__t{len(out)}"
        rows = rows.withColumn(column, F.struct(F.lit(target).alias("target"), F.when(status.isin("override", "alias"), F.get(found, F.lit(0))["id"]).alias("source_id"), status.alias("status")))
        rows = rows.withColumn("__used", F.when(F.col(column)["source_id"].isNotNull(), F.array_append("__used", F.col(column)["source_id"])).otherwise(F.col("__used")))
        out.append(column)
    return rows.select("schema", F.explode(F.array(*out)).alias("r")).select("schema", "r.*")
