"""Delivery from claim to receipt: each record of a batch is claimed, checked, looked up, written and answered, once for ever.

Two tables with commit logs stand behind it: `receipts`, which is the ledger too, and `target`. A batch is judged against the
receipts of former batches, its receipts are committed with the mapped records in them, and only then the target takes the
delivered ones. A batch that is sent again after a failure at any point finds its receipts and goes on from there: nothing is
judged twice, and the target commits each batch once. Afterwards the records in the receipts are not needed any more.

Status and reason of a record:
* delivered: the first of its identity that meets every check, or again after `rearm`;
* quarantined: transport_verification_failed (it could not be opened), destination_contract_failed (a transform, a null or a type),
  destination_resolution_failed (a key lookup);
* duplicate: its identity was delivered with the same content, before or in this batch;
* ambiguous, previous_delivery_ambiguous: its identity is in quarantine with the same content and was not rearmed;
* replay_detected: its identity was met with other content.
A null identity is one identity; of records that tie in place one is first. An empty batch has no receipts and is committed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.lifecycle import met
from weftline.operators.state import first_delivery
from weftline.plans.mapping import Plan, Schema, preflight, rule_columns
from weftline.sources.commits import Table

#: Statuses after which an identity is not free any more, and the one that frees it.
SETTLING, REARMED = ("delivered", "quarantined"), "rearmed"


def receipts(spark: SparkSession, root: str) -> Table:
    return Table(spark, f"{root}/receipts")


def target_rows(spark: SparkSession, root: str) -> DataFrame:
    return Table(spark, f"{root}/target").read()


def deliver_batch(
    records: DataFrame,
    number: int,
    root: str,
    identity: list[str],
    place: str,
    plan: Plan,
    source: Schema,
    target: Schema,
    dimensions: dict[str, tuple[DataFrame, str, str]] | None = None,
    verified: Column | None = None,
    writer: str = "delivery",
) -> DataFrame:
    """Delivers records (identity columns, place, the source's fields) as batch `number` of a writer, whose numbers rise. Returns the
    batch's receipts: identity, place, digest, status, reason_code, writer, batch; `orderBy(place)` gives them as the records came.

    verified: whether a record was opened; null counts as no. The lookups' tables are taken as in plans.mapping.lookup.
    """
    spark = records.sparkSession
    ledger, out = receipts(spark, root), Table(spark, f"{root}/target")
    if ledger.snapshot().batches.get(writer, -1) < number:
        fields = [f.id for f in source.fields]
        rows = _checked(records, identity, place, fields, plan, source, target, dimensions, verified).persist()
        try:
            judged = _judged(rows, _past(ledger, identity), identity, place)
            ledger.append(judged.withColumn("writer", F.lit(writer)).withColumn("batch", F.lit(number).cast("long")), batch=(writer, number))
        finally:
            rows.unpersist()
    mine = ledger.read().filter((F.col("writer") == writer) & (F.col("batch") == number))
    out.append(mine.filter("status = 'delivered'").select("record.*"), batch=(writer, number))
    return mine.drop("record")


def _checked(records, identity, place, fields, plan, source, target, dimensions, verified) -> DataFrame:
    """identity, place, digest, record (as mapped; null if it cannot be delivered) and reason_code of each record by itself."""
    # Digest and verification are taken before the lookups add columns.
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(fields)]), {"ignoreNullFields": "false"})
    opened = F.lit(True) if verified is None else F.coalesce(verified, F.lit(False))
    rows = preflight(records.withColumn("__digest_of", F.sha2(body, 256)).withColumn("__opened", opened), plan, source, target, dimensions)
    value = lambda r: F.col(f"__{r.target}") if r.transform == "lookup_foreign_key" else rule_columns(r).value
    lookup = lambda f: f["code"] == "foreign_key_lookup_failed"
    reason = (
        F.when(~F.col("__opened"), "transport_verification_failed")
        .when(F.exists("findings", lambda f: ~lookup(f)), "destination_contract_failed")
        .when(F.exists("findings", lookup), "destination_resolution_failed")
    )
    return rows.select(*identity, place, F.col("__digest_of").alias("digest"), reason.alias("reason_code"), F.when(reason.isNull(), F.struct(*[value(r).alias(r.target) for r in plan.rules])).alias("record"))


def _past(ledger: Table, identity: list[str]) -> DataFrame | None:
    """identity and __past (status, digest): what each identity was last settled as."""
    if ledger.snapshot().schema is None:
        return None
    settled = ledger.read().filter(F.col("status").isin(*SETTLING, REARMED))
    return settled.groupBy(*identity).agg(F.max_by(F.struct("status", "digest"), F.struct("batch", F.col("status") == REARMED)).alias("__past"))


def _judged(rows: DataFrame, past: DataFrame | None, identity: list[str], place: str) -> DataFrame:
    """identity, place, digest, status, reason_code, record (of delivered rows). Each row is dealt by its identity once, with the
    digest in 32 bytes, and meets the past and the first of its identity there."""
    rows = rows.withColumn("digest", F.unhex("digest"))
    none = F.lit(None).cast("struct<status:string,digest:binary>")
    if past is None:
        rows = rows.withColumn("__past", none)
    else:
        rows = met(rows, past.withColumn("__past", F.struct(F.col("__past.status").alias("status"), F.unhex("__past.digest").alias("digest"))), identity)
    was = F.col("__past.status")
    other = F.col("__past").isNotNull() & ~F.col("digest").eqNullSafe(F.col("__past.digest"))
    known = F.when(other, "replay_detected").when(was == "delivered", "duplicate").when(was == "quarantined", "ambiguous")
    rows = rows.withColumn("__known", known).drop("__past")
    out = first_delivery(rows, identity, F.col("digest"), [place], F.col("__known").isNull(), ~F.col("reason_code").isNull())
    fails = F.col("carried")
    own = F.when(F.col("status") == "replay_detected", "replay_detected").when(F.col("status") == "delivered", F.when(fails, "quarantined").otherwise("delivered"))
    out = out.withColumn("status", F.coalesce("__known", own, F.when(fails, "ambiguous").otherwise("duplicate")))
    reason = F.when(F.col("status") == "quarantined", F.col("reason_code")).when(F.col("status") == "ambiguous", "previous_delivery_ambiguous")
    return out.select(*identity, place, F.lower(F.hex("digest")).alias("digest"), "status", reason.alias("reason_code"), F.when(F.col("status") == "delivered", F.col("record")).alias("record"))


def rearm(identities: DataFrame, root: str, identity: list[str], number: int, writer: str = "delivery") -> int:
    """Frees identities (rows of identity columns) whose last receipt is quarantined: the next record with the same content is
    delivered anew. Delivered ones stay. The number of identities freed; the call is a batch of its writer's."""
    spark = identities.sparkSession
    ledger = receipts(spark, root)
    if ledger.snapshot().schema is None:
        return 0
    rows = met(identities.select(*identity).distinct(), _past(ledger, identity), identity, "inner").filter("__past.status = 'quarantined'")
    columns = ledger.read().schema
    made = {"digest": F.col("__past.digest"), "status": F.lit(REARMED), "writer": F.lit(writer), "batch": F.lit(number).cast("long")}
    shaped = rows.select(*[F.col(f.name) if f.name in identity else made.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in columns])
    ledger.append(shaped, batch=(writer, number))
    return ledger.read().filter((F.col("writer") == writer) & (F.col("batch") == number)).count()


def summary(rows: DataFrame) -> DataFrame:
    """status, reason_code, n over receipts."""
    return rows.groupBy("status", "reason_code").agg(F.count(F.lit(1)).alias("n"))
