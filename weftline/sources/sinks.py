"""Sinks with proof: guarded CSV appends, atomic publication, verified exports, reports and paged writes over HTTP."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.state import verify_chain
from weftline.sources.delimited import append, header_names


class PartialWrite(RuntimeError):
    """Some requests of a write were committed: those of `committed`; the others may be sent again."""

    def __init__(self, committed: list[str]) -> None:
        super().__init__(f"{len(committed)} records were committed before a request failed")
        self.committed = committed


def append_matching(df: DataFrame, path: str, header: list[str], allow_formulas: bool = False, delimiter: str = ",") -> None:
    """Appends df to a CSV folder whose files have this header: columns c1..cn by position, others by name, and exactly the
    header's fields in either case; formula-like values are refused."""
    names = header_names(header)
    by_place = [f"c{i}" for i in range(1, len(names) + 1)]
    if df.columns == by_place:
        out = df.toDF(*names)
    elif sorted(df.columns) == sorted(names):
        out = df.select(*[F.col(f"`{n}`") for n in names])
    else:
        raise ValueError(f"fields {df.columns} are not those of the header")
    append(out, path, allow_formulas, delimiter)


def publish(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] = lambda df, p: df.write.parquet(p)) -> None:
    """Writes df under a name of its own beside path, then renames: readers see all of it or nothing. The path must be free;
    of two writers one wins and the other fails."""
    spark = df.sparkSession
    files = spark._jvm.org.apache.hadoop.fs
    target, own = files.Path(path), files.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        raise FileExistsError(path)
    write(df, own.toString())
    # A rename onto a folder that came up meanwhile would move into it, so it is asked for again.
    if system.exists(target) or not system.rename(own, target):
        system.delete(own, True)
        raise FileExistsError(path)


def export_audit(chain: DataFrame, stream: str, event: str, path: str) -> int:
    """Writes a verified audit chain as JSON lines, each stream in order; a broken link refuses the whole export. The number of rows."""
    if verify_chain(chain, stream, event).filter("not linked").limit(1).count():
        raise ValueError("the audit chain is broken")
    publish(chain.repartition(stream).sortWithinPartitions(stream, "sequence"), path, lambda df, p: df.write.json(p))
    return chain.sparkSession.read.text(path).count()


def report(rows: DataFrame, path: str, order: list[str]) -> str:
    """A small report (rows of counts, a plan, a schema) as one JSON document with sorted keys, published whole. The text."""
    listed = [json.loads(r) for r in rows.orderBy(*order).toJSON().collect()]
    text = json.dumps(listed, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    publish(rows.sparkSession.createDataFrame([(text,)], "value string"), path, lambda df, p: df.coalesce(1).write.text(p))
    return text


def run_history(runs: DataFrame, path: str, run: str, order: str) -> DataFrame:
    """Appends runs to a history of JSON lines, each run once, and returns the latest row."""
    spark: SparkSession = runs.sparkSession
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        runs = runs.join(spark.read.schema(runs.schema).json(path).select(run).distinct(), run, "left_anti")
    runs.write.mode("append").json(path)
    return spark.read.schema(runs.schema).json(path).orderBy(F.desc(order)).limit(1)


def post_records(records: list[tuple[str, dict]], send: Callable[[str, bytes, dict[str, str]], int], endpoint: str) -> int:
    """Sends records (identity, fields) one by one, each with its identity as idempotency key; a reply outside 2xx ends the
    write, and PartialWrite names what was committed. The number of records."""
    done: list[str] = []
    for identity, fields in records:
        body = json.dumps(fields, sort_keys=True, ensure_ascii=False).encode()
        try:
            status = send(endpoint, body, {"Content-Type": "application/json", "Idempotency-Key": identity})
        except OSError as error:
            raise PartialWrite(done) from error
        if not 200 <= status < 300:
            raise PartialWrite(done)
        done.append(identity)
    return len(done)


def post(df: DataFrame, identity: str, send: Callable[[str, bytes, dict[str, str]], int], endpoint: str) -> DataFrame:
    """Sends each partition's rows from its executor; identity, committed for each row. A task that runs again sends the same
    keys, so the receiver writes each identity once."""
    fields = [c for c in df.columns if c != identity]
    rows = df.select(F.col(identity).cast("string").alias("identity"), F.to_json(F.struct(*fields)).alias("body"))

    def work(batches):
        for pdf in batches:
            out = []
            for key, body in zip(pdf["identity"], pdf["body"], strict=True):
                try:
                    out.append(post_records([(key, json.loads(body))], send, endpoint) == 1)
                except PartialWrite:
                    out.append(False)
            yield pdf.assign(committed=out)[["identity", "committed"]]

    return rows.mapInPandas(work, "identity string, committed boolean")


def identities(spark: SparkSession, path: str) -> dict[str, tuple[int, str]]:
    """Files under a path by length and modification time, to be held against the same after reading: a difference means that
    what was read is not what was inspected."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").cast("string")).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def require_unchanged(spark: SparkSession, path: str, before: dict[str, tuple[int, str]]) -> None:
    if identities(spark, path) != before:
        raise RuntimeError("the source changed while it was read")


