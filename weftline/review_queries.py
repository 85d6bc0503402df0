"""Queries of proposals with a glossary, review artifacts and reasons, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import matching, reasons, review
from weftline.queries import _DECIDED, _fields, query
from weftline.session import table


def _sql(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    return spark.sql(text.replace(f"from {name}", "from {src}"), src=table(spark, sf_dir, name))


#: By hand: the comment means the remark, and so does an amount where there is no target for amounts; two then claim one remark.
@query(f"""select source_id, case when f in ('c5', 'c2') and target_id is null then 'remark:' || k else target_id end as target_id,
case when f in ('c5', 'c2') and target_id is null then 'review' else status end as status from (select *, split_part(source_id, ':', 1) as f from ({_DECIDED}) d) q""")
def mapping_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _fields(spark, sf_dir)
    terms = spark.createDataFrame([("comment", "note"), ("remark", "note"), ("remark", "worth"), ("amount", "worth")], "term string, concept string")
    return matching.propose(source, target, terms).select("source_id", "target_id", "status")


# ---- artifacts: one for each order, with its lines as decisions

_ARTIFACTS = """select concat('a', cast(o_orderkey as varchar(20))) as artifact_id, o_custkey % 50 as pair, case when o_orderkey % 7 = 0 then 'ff' else sha256(concat('s', cast(o_custkey % 50 + o_orderkey % 3 % 2 as varchar(20)))) end as source_fingerprint,
  sha256(concat('d', cast(o_custkey % 50 as varchar(20)))) as destination_fingerprint, case when o_orderkey % 11 <> 0 then o_orderpriority end as reviewed_by,
  case when o_orderkey % 13 = 0 then 'yesterday' else '2024-05-01T10:00:00Z' end as created_at from orders"""
_CHOICES = """select concat('a', cast(l_orderkey as varchar(20))) as artifact_id, l_linenumber as place, concat('s', cast(l_partkey % 40 as varchar(20))) as source_field,
  case when l_linenumber % 6 = 0 then null else concat('t', cast(l_suppkey % 30 as varchar(20))) end as target_field,
  case when l_linenumber = 6 and l_partkey % 2 = 0 then 'abstained' when l_linenumber = 5 and l_partkey % 9 = 0 then 'guessed' when l_linenumber = 4 and l_partkey % 5 = 0 then 'abstained' else 'accepted' end as disposition from lineitem"""


def _spark_text(text: str) -> str:
    """The same text in Spark's words."""
    return text.replace("sha256(concat(", "sha2(concat(").replace("as varchar(20))))", "as varchar(20))), 256)").replace("sha2(concat('d', cast(o_custkey % 50 as varchar(20))) as", "sha2(concat('d', cast(o_custkey % 50 as varchar(20))), 256) as")


@query(f"""with a as ({_ARTIFACTS}), d as ({_CHOICES}),
s as (select artifact_id, count(*) as n, bool_or(disposition = 'guessed') as unknown, bool_or(disposition = 'abstained' and target_field is not null) as aimed, bool_or(disposition = 'accepted' and target_field is null) as aimless,
  count(source_field) > count(distinct source_field) as sources, count(target_field) > count(distinct target_field) as targets, bool_or(disposition = 'abstained') as abstained,
  string_agg(concat('{{"disposition":"', disposition, '","source_field":"', source_field, '","target_field":', case when target_field is null then 'null' else '"' || target_field || '"' end, '}}'), ',' order by place, disposition, source_field, target_field nulls first) as listed from d group by 1)
select a.artifact_id, coalesce(n, 0) as n_decisions, concat_ws(',', case when source_fingerprint = 'ff' then 'fingerprint_invalid' end, case when reviewed_by is null then 'reviewer_invalid' end, case when created_at = 'yesterday' then 'created_at_invalid' end,
  case when n is null then 'decision_count_invalid' end, case when unknown then 'disposition_unknown' end, case when aimed then 'abstained_with_target' end, case when aimless then 'target_missing' end, case when sources then 'source_field_repeated' end,
  case when targets then 'target_field_repeated' end, case when source_fingerprint <> sha256(concat('s', cast(pair as varchar))) then 'source_schema_stale' end, case when abstained then 'decisions_abstained' end) as findings,
case when n is not null then sha256(concat('{{"artifact_id":"', a.artifact_id, '","created_at":"', created_at, '","decisions":[', listed, '],"destination_schema_fingerprint":"', destination_fingerprint,
  '","privacy":"schema_metadata_only_no_record_values","reviewed_by":', case when reviewed_by is null then 'null' else '"' || reviewed_by || '"' end, ',"schema":"review-artifact","source_schema_fingerprint":"', source_fingerprint, '","version":1}}')) end as content_sha256
from a left join s using (artifact_id)""")
def review_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts, choices = _sql(spark, sf_dir, _spark_text(_ARTIFACTS), "orders"), _sql(spark, sf_dir, _CHOICES, "lineitem")
    pair = F.col("pair").cast("string")
    routes = artifacts.select("pair").distinct().select("pair", F.sha2(F.concat(F.lit("s"), pair), 256).alias("source_fingerprint"), F.sha2(F.concat(F.lit("d"), pair), 256).alias("destination_fingerprint"))
    found = review.judged(artifacts, choices, routes).join(review.content_digests(artifacts, choices), "artifact_id", "left")
    return found.select("artifact_id", "n_decisions", F.array_join("findings", ",").alias("findings"), "content_sha256")


_FAILED = """select event_id, case event_id % 7 when 0 then 'write_not_committed' when 1 then 'foreign_key_lookup_failed' when 2 then 'source_transform_failed' when 3 then 'sealed_spool_cleanup_failed' when 4 then 'not_a_code' when 5 then 'write_outcome_unknown' end as reason_code from events"""


@query(f"""select category, retry_policy, count(*) as events from (select reason_code, case reason_code when 'write_not_committed' then 'destination_write' when 'foreign_key_lookup_failed' then 'destination_lookup' when 'source_transform_failed' then 'transform'
  when 'sealed_spool_cleanup_failed' then 'local_cleanup' when 'write_outcome_unknown' then 'write_ambiguity' when 'not_a_code' then 'unknown' end as category,
case reason_code when 'write_not_committed' then 'safe_to_retry' when 'foreign_key_lookup_failed' then 'safe_after_fix' when 'source_transform_failed' then 'do_not_retry_unchanged'
  when 'sealed_spool_cleanup_failed' then 'never_retry_delivery_for_cleanup' when 'write_outcome_unknown' then 'never_blind_retry' when 'not_a_code' then 'inspect_before_retry' end as retry_policy from ({_FAILED}) e) q group by 1, 2""")
def reasons_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons.explained(_sql(spark, sf_dir, _FAILED, "events"), "reason_code").groupBy("category", "retry_policy").agg(F.count(F.lit(1)).alias("events"))
