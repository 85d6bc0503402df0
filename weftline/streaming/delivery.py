"""Structured Streaming: exactly-once delivery by identity, and checkpoints of routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.lifecycle import met
from weftline.operators.state import first_delivery


def deduplicated(stream: DataFrame, identity: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first record of each identity within the watermark; time must be a timestamp (cast timestamp_ntz before)."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(identity)


#: Parts of the ledger, by a hash of the identity: a micro-batch reads only those that its own identities fall in.
BUCKETS = 64


def deliver(stream: DataFrame, ledger: str, target: str, checkpoint: str, identity: list[str], digest: str, order: list[str]):
    """Starts a query that writes each identity once for ever, whatever the watermark.

    Each micro-batch is held against the ledger of former batches: new identities go to the target, equal ones are
    duplicates, other digests replays. Identities are compared null-safe, and of rows that tie in order and digest one is
    delivered. A batch that is run again after a failure replaces its own rows in the ledger and writes nothing twice. The
    ledger is laid out by a hash of the identity, and only the parts that a batch touches are read.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        rows = batch.withColumn("__bucket", F.pmod(F.xxhash64(*identity), F.lit(BUCKETS)).cast("int")).persist()
        touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())
        judged = first_delivery(rows, identity, F.col(digest), order)
        past = _past(spark, ledger, rows, identity, digest, touched, number)
        status = F.when(F.col("__past").isNull(), F.col("status")).when(F.col(digest).eqNullSafe(F.col("__past.digest")), "duplicate").otherwise("replay_detected")
        out = met(judged, past, identity).withColumn("status", status).select(*columns, "status", "__bucket").withColumn("__batch", F.lit(number).cast("long"))
        # Of this batch's folders only this batch's are written anew.
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket", "__batch").parquet(ledger)
        done = _ledger(spark, ledger, touched).filter((F.col("__batch") == number) & (F.col("status") == "delivered"))
        done.drop("status", "__batch", "__bucket").write.mode("overwrite").parquet(f"{target}/__batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ledger(spark: SparkSession, ledger: str, buckets: list[int]) -> DataFrame:
    """The touched parts of the ledger; Spark reads only their folders."""
    return spark.read.parquet(ledger).filter(F.col("__bucket").isin(buckets))


def _past(spark: SparkSession, ledger: str, rows: DataFrame, identity: list[str], digest: str, buckets: list[int], number: int) -> DataFrame:
    """identity and __past (struct<digest>) of what former batches delivered."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return rows.select(*identity, F.struct(F.col(digest).alias("digest")).alias("__past")).filter("false")
    found = _ledger(spark, ledger, buckets).filter((F.col("status") == "delivered") & (F.col("__batch") != number))
    return found.select(*identity, F.struct(F.col(digest).alias("digest")).alias("__past"))
