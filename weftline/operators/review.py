"""Review artifacts: what people decided of the fields that the matcher left open, judged against the schemas they were made for.

An artifact is a row (artifact_id, pair, source_fingerprint, destination_fingerprint, reviewed_by, created_at) with its
decisions in a table of their own (artifact_id, place, source_field, target_field, disposition). Rows with null ids belong
to no artifact. Repeated artifact ids are one finding of each of their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Dispositions, the most decisions of an artifact, the lengths of texts.
DISPOSITIONS = ("accepted", "corrected", "abstained")
MOST_DECISIONS, MOST_ID, MOST_TEXT = 4096, 64, 256
PRIVACY = "schema_metadata_only_no_record_values"


def _text(c: str, most: int) -> Column:
    """Whether a text is there, not empty, not too long and without control characters."""
    return F.coalesce((F.length(c) > 0) & (F.length(c) <= most) & ~F.col(c).rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def _print(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def _sums(decisions: DataFrame) -> DataFrame:
    """One row for each artifact: how many decisions, and how many break which rule. Both passes combine before their shuffle, so
    one artifact with very many rows is no task of its own."""
    abstained = F.col("disposition") == "abstained"
    flags = {
        "n": F.lit(True),
        "texts": ~_text("source_field", MOST_TEXT) | (F.col("target_field").isNotNull() & ~_text("target_field", MOST_TEXT)),
        "unknown": F.coalesce(~F.col("disposition").isin(*DISPOSITIONS), F.lit(True)),
        "aimed": abstained & F.col("target_field").isNotNull(),
        "aimless": F.col("disposition").isin("accepted", "corrected") & F.col("target_field").isNull(),
        "abstained": abstained,
    }
    by_source = decisions.groupBy("artifact_id", "source_field").agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in flags.items()])
    sums = by_source.groupBy("artifact_id").agg(*[F.sum(k).alias(k) for k in flags], F.count_if((F.col("n") > 1) & F.col("source_field").isNotNull()).alias("sources"))
    by_target = decisions.filter("target_field is not null").groupBy("artifact_id", "target_field").count()
    targets = by_target.groupBy("artifact_id").agg(F.count_if(F.col("count") > 1).alias("targets"))
    return sums.join(targets, "artifact_id", "left")


def judged(artifacts: DataFrame, decisions: DataFrame, routes: DataFrame) -> DataFrame:
    """artifacts with n_decisions, findings (all rules that are broken, in a fixed order) and applicable (none is).

    routes: pair, source_fingerprint, destination_fingerprint as they are now, one row a pair. A pair without a route is stale.
    """
    now = routes.select("pair", F.col("source_fingerprint").alias("__source"), F.col("destination_fingerprint").alias("__destination"))
    often = artifacts.groupBy("artifact_id").agg((F.count(F.lit(1)) > 1).alias("__repeated"))
    rows = artifacts.join(_sums(decisions), "artifact_id", "left").join(often, "artifact_id", "left").join(now, "pair", "left")
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    rules = (
        (~_text("artifact_id", MOST_ID) | F.coalesce("__repeated", F.lit(False)), "artifact_id_invalid"),
        (~_print("source_fingerprint") | ~_print("destination_fingerprint"), "fingerprint_invalid"),
        (~_text("reviewed_by", MOST_TEXT), "reviewer_invalid"),
        (F.try_to_timestamp("created_at").isNull() | ~F.col("created_at").rlike(r"(Z|[+-]\d\d:\d\d)\z"), "created_at_invalid"),
        (~F.coalesce(F.col("n").between(1, MOST_DECISIONS), F.lit(False)), "decision_count_invalid"),
        (some("texts"), "field_invalid"),
        (some("unknown"), "disposition_unknown"),
        (some("aimed"), "abstained_with_target"),
        (some("aimless"), "target_missing"),
        (some("sources"), "source_field_repeated"),
        (some("targets"), "target_field_repeated"),
        (~F.coalesce(F.col("source_fingerprint") == F.col("__source"), F.lit(False)), "source_schema_stale"),
        (~F.coalesce(F.col("destination_fingerprint") == F.col("__destination"), F.lit(False)), "destination_schema_stale"),
        (some("abstained"), "decisions_abstained"),
    )
    findings = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(code)) for broken, code in rules]))
    count = F.coalesce("n", F.lit(0)).cast("long").alias("n_decisions")
    out = rows.select(*artifacts.columns, count, findings.alias("findings"))
    return out.withColumn("applicable", F.size("findings") == 0)


def content_digests(artifacts: DataFrame, decisions: DataFrame) -> DataFrame:
    """artifact_id, content_sha256: the digest of an artifact as JSON with sorted keys and its decisions by place (ties by their own fields). Only artifacts
    that keep the bound on decisions have one, so what is gathered is bounded."""
    small = decisions.groupBy("artifact_id").count().filter(F.col("count") <= MOST_DECISIONS).select("artifact_id")
    each = F.struct("place", F.struct("disposition", "source_field", "target_field").alias("d"))
    lists = decisions.join(small, "artifact_id").groupBy("artifact_id").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["d"]).alias("decisions"))
    body = F.struct(
        "artifact_id", "created_at", "decisions", F.col("destination_fingerprint").alias("destination_schema_fingerprint"), F.lit(PRIVACY).alias("privacy"), "reviewed_by",
        F.lit("review-artifact").alias("schema"), F.col("source_fingerprint").alias("source_schema_fingerprint"), F.lit(1).alias("version"),
    )
    return artifacts.join(lists, "artifact_id").select("artifact_id", F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256).alias("content_sha256"))


def suggestions(decided: DataFrame) -> DataFrame:
    """What is put before a reviewer: the decisions that are not automatic, with the kind of evidence and confidence in 0..1."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    kind = F.when(F.col("status") == "blocked", "no_supported_match").when(F.col("margin") > 0, "single_signal").otherwise("multiple_signals")
    return decided.filter("status <> 'auto'").select("pair", "source_id", "target_id", "status", kind.alias("evidence_class"), score.alias("confidence"))


def applied(decided: DataFrame, judged_artifacts: DataFrame, decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """decided (pair, source_id, target_id, status, ...) with reviewed_by: an applicable artifact's choices take the place of the
    matcher's, status reviewed. Of several artifacts of a pair the latest speaks (ties: the greatest id). A choice of a target that
    targets (pair, id) does not have is unknown_target and changes nothing; sources that a pair does not have are left out. After
    that, sources that claim one target without a review go to review."""
    by = W.partitionBy("pair").orderBy(F.desc(F.to_timestamp("created_at")), F.desc("artifact_id"))
    latest = judged_artifacts.filter("applicable").withColumn("__n", F.row_number().over(by)).filter("__n = 1").select("pair", "artifact_id", "reviewed_by")
    known = targets.select("pair", F.col("id").alias("__target")).distinct().withColumn("__known", F.lit(True))
    choice = latest.join(decisions, "artifact_id").select("pair", F.col("source_field").alias("source_id"), F.col("target_field").alias("__target"), F.col("reviewed_by").alias("__by"))
    rows = decided.join(choice.join(known, ["pair", "__target"], "left"), ["pair", "source_id"], "left")
    takes = F.coalesce("__known", F.lit(False))
    status = F.when(takes, "reviewed").when(F.col("__target").isNotNull(), "unknown_target").otherwise(F.col("status"))
    out = rows.withColumn("status", status).withColumn("target_id", F.when(takes, F.col("__target")).otherwise(F.col("target_id"))).withColumn("reviewed_by", F.when(takes, F.col("__by")))
    claims = F.count("target_id").over(W.partitionBy("pair", "target_id"))
    open_claim = F.col("target_id").isNotNull() & (claims > 1) & F.col("status").isin("auto")
    return out.withColumn("status", F.when(open_claim, "review").otherwise(F.col("status"))).select(*decided.columns, "reviewed_by")
