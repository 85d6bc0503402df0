"""What several operators share: text columns, the shared folder, shipping the package to executors."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space of all text contracts: blank and the control characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(name: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (which is one
    machine) gets a temporary folder; a cluster has none that all its machines see, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have (in any case of letters), made from the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a narrow table that may be broadcast, counted before each use.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows, as counted; else as it is, for an ordinary join.

    rows: how many it has at most, where that is known."""
    if rows is None:
        rows = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors; drop() removes one early. What is left
    goes when the driver's JVM ends: results that read it must be written before."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
        self.count = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def counted(self, df: DataFrame, **sums: Column) -> tuple[DataFrame, dict[str, Any]]:
        """table(df), and its number of rows as `rows` beside further aggregates, gathered as it is written and not by jobs of their
        own: each job, its plan and its tasks take memory of the driver."""
        aggregates = [F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in sums.items())]
        seen = Observation()
        out = self.table(df.observe(seen, *aggregates))
        # A plan that turns out empty as it runs may lose what observes it.
        return out, seen.get or out.agg(*aggregates).first().asDict()

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each Spark context, for Python functions that run there."""
    sc = spark.sparkContext
    if getattr(sc, "_weftline_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="weftline-ship-")) / "weftline_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join("weftline", p.relative_to(root)))
    sc.addPyFile(str(target))
    sc._weftline_shipped = True


#: What an operator keeps in this process from task to task, by the operator's name: one operator's at a time.
_KEPT: dict[str, Any] = {}


def kept_by(owner: str, make: Callable[[], Any] = dict) -> Any:
    """What `owner` keeps in this process, made when it is asked for first. Spark hands Python workers on from one stage to the next, so
    what other operators have kept here is let go; otherwise a worker of a pipeline would hold the tables of all its stages."""
    if owner not in _KEPT:
        if _KEPT:
            let_go()
        _KEPT[owner] = make()
    return _KEPT[owner]


def let_go() -> None:
    """Ends what operators keep in this process: for the end of a task whose tables are made anew in no time, as workers that wait for
    the next stage count too."""
    _KEPT.clear()
    hand_back()


def hand_back() -> None:
    """Gives memory that is free in this process back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Private-use characters that wrap matches, and the one that stands in for them where a text holds them.
OPEN, CLOSE, INSTEAD = "\ue000", "\ue001", "\ue002"


#: Matches that are placed by one inner pass; the outer pass carries the place on and keeps the passes' spans as parts, so that long
#: texts stay linear in practice.
PASS = 256


def marked_spans(text: Column, pattern: str, group: int = 0, near: int = 0) -> Column:
    """Matches of a Java regular expression as array<struct<start,end,hit>> in code points, found without Python; with `near` each
    also has that many characters before it as `near`.

    Each match is wrapped in two private-use marks, the text is split at them, and the pieces' lengths give the
    positions. Marks that the text itself holds are first replaced by another character of the same length. What stands
    before a match is carried on from piece to piece, as taking it from the text would walk the text once for each match.
    """
    plain = F.translate(text, OPEN + CLOSE, INSTEAD * 2)
    pieces = F.split(F.regexp_replace(plain, F.lit(f"({pattern})"), F.lit(f"{OPEN}$1{CLOSE}")), OPEN)
    last = lambda c: F.substring(c, -near, near)
    carried = lambda value: [value.alias("near")] if near else []

    def placed(acc: Column, piece: Column) -> Column:
        hit = F.substring_index(piece, CLOSE, 1)
        span = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(hit)).cast("int").alias("end"), hit.alias("hit"), *carried(acc["near"]))
        seen = carried(last(F.concat(acc["near"], F.translate(piece, CLOSE, ""))))
        return F.struct((acc["at"] + F.length(piece) - 1).cast("int").alias("at"), *seen, F.concat(acc["spans"], F.array(span)).alias("spans"))

    def passed(acc: Column, part: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), *carried(acc["near"]), no_spans(near).alias("spans"))
        add = lambda r: F.struct(r["at"].alias("at"), *carried(r["near"]), F.concat(acc["parts"], F.array(r["spans"])).alias("parts"))
        return F.transform(F.array(F.aggregate(part, begin, placed)), add)[0]

    def spans_of(found: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PASS).cast("int"))
        parts = F.transform(starts, lambda i: F.slice(found, i * PASS + 2, PASS))
        first = F.element_at(found, 1)
        begin = F.struct(F.length(first).alias("at"), *carried(last(first)), F.array(no_spans(near)).alias("parts"))
        return F.flatten(F.aggregate(parts, begin, passed)["parts"])

    # Bound as a variable, so that the text is matched once.
    return F.transform(F.array(pieces), spans_of)[0]


def no_spans(near: int = 0) -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,hit:string" + ",near:string" * bool(near) + ">>)")


def joined_spans(spans: Column) -> Column:
    """array<struct<start,rank,kind,end>> as kind:start:end by start, then rank, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
