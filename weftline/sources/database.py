"""Tables of databases: scans, keys as the data show them, and batches written with proof of their rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.lifecycle import met

#: Fixed value: rows of one batch.
MOST_BATCH = 1000
BATCH = "__batch"


def read_table(spark: SparkSession, url: str, name: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """All columns of one table over JDBC; partition: column, lower, upper, number of parallel reads."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if partition:
        column, lower, upper, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", n)
    return reader.load()


def unique_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, distinct_keys, unique, nulls: whether each column can be a lookup key."""
    out = None
    for c in columns:
        counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        one = counts.agg(
            F.lit(c).alias("field"),
            F.count(c).alias("distinct_keys"),
            (F.count_if((F.col("n") > 1) & F.col(c).isNotNull()) == 0).alias("unique"),
            F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        )
        out = one if out is None else out.unionByName(one)
    return out


class UnknownOutcome(RuntimeError):
    """The write may have happened in part; it must not be tried again unseen."""


def check_batch(df: DataFrame, identity: list[str], known: list[str]) -> int:
    """Refuses unknown columns, too many rows and identities that come twice; the number of rows."""
    unknown = sorted(set(df.columns) - set(known))
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    n = df.limit(MOST_BATCH + 1).count()
    if n > MOST_BATCH:
        raise ValueError(f"more than {MOST_BATCH} rows in a batch")
    if df.groupBy(*identity).count().filter("count > 1").limit(1).count():
        raise ValueError("an identity comes twice")
    return n


def write_batch(df: DataFrame, target: str, identity: list[str], known: list[str]) -> int:
    """Appends a checked batch to a Parquet table all or none, under a number of its own, and proves the number of rows by
    reading back those with this number: rows that were there before prove nothing."""
    n = check_batch(df, identity, known)
    number = uuid.uuid4().hex
    df.withColumn(BATCH, F.lit(number)).write.mode("append").partitionBy(BATCH).parquet(target)
    back = df.sparkSession.read.parquet(target).filter(F.col(BATCH) == number).count()
    if back != n:
        raise UnknownOutcome(f"{back} rows of {n} were found again")
    return n


def insert_batch(df: DataFrame, url: str, name: str, identity: list[str], known: list[str], **options: str) -> int:
    """Inserts a checked batch into one table over JDBC in one transaction (one connection), and proves the exact number of
    new rows by the table's counts of these identities before and after."""
    n = check_batch(df, identity, known)
    spark = df.sparkSession
    keys = df.select(*identity)
    count = lambda: met(keys, read_table(spark, url, name, **options).select(*identity).withColumn("__there", F.lit(1)), identity, "inner").count()
    before = count()
    df.coalesce(1).write.format("jdbc").option("url", url).option("dbtable", name).option("batchsize", n or 1).options(**options).mode("append").save()
    if count() - before != n:
        raise UnknownOutcome("the number of inserted rows is not the batch's")
    return n
