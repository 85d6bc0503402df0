"""Session construction and table access shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "weftline", cores: str | int = "*", **extra: str) -> SparkSession:
    """A local session with the settings the engine expects. Under spark-submit, or where a session is there already, nothing
    is set but what the caller names: the submitted configuration stands."""
    builder = SparkSession.builder.appName(app)
    if "PYSPARK_GATEWAY_PORT" not in os.environ and SparkSession.getActiveSession() is None:
        own = {
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
        }
        builder = builder.master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
        for key, value in own.items():
            builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; only Spark's own reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share, spark.checkpoint.dir, which goes with the session; without it a local
    session gets a temporary one, and a cluster an error, as it has none that all its machines see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(found)
    root = f"{found.rstrip('/')}/engine-{uuid.uuid4().hex}"
    remove_at_exit(spark, root)
    return root


def remove_at_exit(spark: SparkSession, root: str) -> None:
    """Makes a folder and has it removed when the driver's JVM ends: what reads it has ended too by then, lost executors or not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
