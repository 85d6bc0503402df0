"""A table with a commit log: snapshots in manifests, put one after the other by a rename that only one writer can win.

Data files are written first, in a folder of their own name; a version is then a folder `log/<number>` whose manifest lists all
live parts with their schema. A writer whose number was taken meanwhile reads the newer snapshot and tries again: an append
only lists its parts anew, an upsert or a compaction whose parts were replaced does its work again. Readers see whole
versions. The log needs a file system whose rename of a folder is atomic (HDFS, a POSIX disk), not a bare object store.

A table with an identity is laid out by a hash of it, and an upsert rewrites only the parts that its rows touch. Identities are
compared null-safe. Of rows of one upsert that share an identity the caller's order decides; without one they are an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"
#: How often a writer meets a newer version before it gives up.
TRIES = 50


class Conflict(RuntimeError):
    """Another writer's version stands where this one was to be."""


@dataclass(frozen=True)
class Part:
    """A folder of data files; of a table with an identity, those of one bucket."""

    folder: str
    bucket: int | None = None


@dataclass(frozen=True)
class Snapshot:
    """All that a version holds. batches: the last batch that each writer's name has committed, so that a batch that is sent again
    changes nothing; properties: small facts that change with the data, such as a checkpoint."""

    version: int = 0
    schema: str | None = None
    parts: tuple[Part, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)
    operation: str = "none"
    writer: str = ""

    def text(self) -> str:
        return json.dumps({**self.__dict__, "parts": [[p.folder, p.bucket] for p in self.parts]}, sort_keys=True)

    @classmethod
    def of(cls, text: str) -> Snapshot:
        found = json.loads(text)
        return cls(**{**found, "parts": tuple(Part(*p) for p in found["parts"])})


class Table:
    def __init__(self, spark: SparkSession, path: str, identity: list[str] | None = None, buckets: int = 64) -> None:
        """identity and buckets are fixed by the first version; a table that is there keeps its own."""
        self.spark, self.path = spark, path.rstrip("/")
        self._java = spark._jvm.org.apache.hadoop.fs
        self._files = self._java.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        own = {"identity": json.dumps(identity or []), "buckets": str(buckets)}
        self._initial = Snapshot(properties=own)
        fixed = self.snapshot().properties
        if identity is not None and json.loads(fixed["identity"]) != identity:
            raise ValueError(f"the table's identity is {fixed['identity']}")
        self.identity, self.buckets = json.loads(fixed["identity"]), int(fixed["buckets"])

    # ---- the log

    def _at(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}"

    def versions(self) -> list[int]:
        log = self._java.Path(f"{self.path}/log")
        if not self._files.exists(log):
            return []
        return sorted(int(s.getPath().getName()) for s in self._files.listStatus(log) if s.getPath().getName().isdigit())

    def _manifest(self, version: int) -> Snapshot:
        stream = self._files.open(self._java.Path(f"{self._at(version)}/manifest.json"))
        try:
            return Snapshot.of(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, or the newest one."""
        if version is None:
            version = max(self.versions(), default=0)
        return self._manifest(version) if version else self._initial

    def _put(self, snapshot: Snapshot) -> bool:
        """Puts a version; False where another writer's stands there. What stands there is read again, so a file system that moves
        a folder into one that came up meanwhile does not pass for success."""
        staged, target = self._java.Path(f"{self.path}/staged/{snapshot.writer}"), self._java.Path(self._at(snapshot.version))
        stream = self._files.create(self._java.Path(staged, "manifest.json"), True)
        stream.write(bytearray(snapshot.text().encode()))
        stream.close()
        self._files.mkdirs(target.getParent())
        if not self._files.exists(target):
            self._files.rename(staged, target)
        won = self._manifest(snapshot.version).writer == snapshot.writer
        self._files.delete(staged, True)
        return won

    def _commit(self, change: Callable[[Snapshot], Snapshot | None], expected: int | None = None) -> Snapshot:
        """Puts what change makes of the newest version, again and again until no other writer comes between. None: nothing to do."""
        for _ in range(TRIES):
            base = self.snapshot()
            if expected is not None and base.version != expected:
                raise Conflict(f"version {base.version} stands where {expected} was expected")
            made = change(base)
            if made is None:
                return base
            made = replace(made, version=base.version + 1, writer=uuid.uuid4().hex)
            if self._put(made):
                return made
        raise Conflict(f"{TRIES} newer versions came between")

    # ---- data

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; a table without one cannot be read, as it has no columns."""
        found = self.snapshot(version)
        if found.schema is None:
            raise ValueError("the table has no version with data")
        return self._read(found, found.parts)

    def _read(self, snapshot: Snapshot, parts: tuple[Part, ...]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(snapshot.schema))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p.folder}" for p in parts])

    def _schema(self, df: DataFrame) -> str:
        """The columns' names and types; every column may hold nulls, as files say no more."""
        return json.dumps(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]).jsonValue(), sort_keys=True)

    def _write(self, df: DataFrame) -> tuple[Part, ...]:
        folder = f"data/{uuid.uuid4().hex}"
        if not self.identity:
            df.write.parquet(f"{self.path}/{folder}")
            return (Part(folder),)
        df.withColumn(BUCKET, self._bucket()).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._files.listStatus(self._java.Path(f"{self.path}/{folder}"))]
        found = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))
        return tuple(Part(f"{folder}/{BUCKET}={b}", b) for b in found)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.identity), F.lit(self.buckets)).cast("int")

    def _fits(self, base: Snapshot, schema: str) -> None:
        if base.schema is not None and base.schema != schema:
            raise ValueError("the columns are not those of the table")

    @staticmethod
    def _seen(base: Snapshot, batch: tuple[str, int] | None) -> bool:
        return batch is not None and base.batches.get(batch[0], -1) >= batch[1]

    @staticmethod
    def _batches(base: Snapshot, batch: tuple[str, int] | None) -> dict[str, int]:
        return base.batches if batch is None else {**base.batches, batch[0]: batch[1]}

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None, properties: dict[str, str] | None = None, expected: int | None = None) -> int:
        """Adds rows; the version that holds them. Files are written once, however often the version must be put again. batch: a
        writer's name and its number, committed at most once, in rising order. A table with an identity takes upserts only."""
        if self.identity:
            raise ValueError("a table with an identity takes upserts")
        if self._seen(self.snapshot(), batch):
            return self.snapshot().version
        schema = self._schema(df)
        self._fits(self.snapshot(), schema)
        parts = self._write(df)

        def change(base: Snapshot) -> Snapshot | None:
            self._fits(base, schema)
            if self._seen(base, batch):
                return None
            return replace(base, schema=schema, parts=base.parts + parts, batches=self._batches(base, batch), properties={**base.properties, **(properties or {})}, operation="append")

        return self._commit(change, expected).version

    def upsert(self, df: DataFrame, order: list[str] | None = None, batch: tuple[str, int] | None = None, keep_newest: bool = False, expected: int | None = None) -> int:
        """Puts rows in the place of those of their identity. order: of several rows of an identity in df the greatest one is taken;
        with keep_newest a row that stands there and is greater stays, whatever comes when. Without an order, repeated identities
        are an error. Only the parts of touched buckets are read and written."""
        if not self.identity:
            raise ValueError("a table without an identity takes appends")
        schema = self._schema(df)
        self._fits(self.snapshot(), schema)
        touched: set[int] | None = None
        done: dict[tuple[Part, ...], tuple[Part, ...]] = {}
        rank = F.struct(*order) if order else None

        def change(base: Snapshot) -> Snapshot | None:
            nonlocal touched
            self._fits(base, schema)
            if self._seen(base, batch):
                return None
            if touched is None:
                touched = {r[0] for r in df.select(self._bucket()).distinct().collect()}
            old = tuple(p for p in base.parts if p.bucket in touched)
            if old not in done:
                done[old] = self._write(self._merged(df, self._read(base, old) if old else None, rank, keep_newest))
            rest = tuple(p for p in base.parts if p.bucket not in touched)
            return replace(base, schema=schema, parts=rest + done[old], batches=self._batches(base, batch), operation="upsert")

        return self._commit(change, expected).version

    def _merged(self, df: DataFrame, old: DataFrame | None, rank: Column | None, keep_newest: bool) -> DataFrame:
        """Per identity one row. New and old rows meet in one shuffle; its groups hold a row of each side, and repeats of the new."""
        each = df.withColumn("__new", F.lit(1))
        if old is not None:
            each = each.unionByName(old.withColumn("__new", F.lit(0)))
        order = F.struct(rank, "__new") if rank is not None and keep_newest else F.struct("__new", rank) if rank is not None else F.struct("__new")
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        # A maximum by key combines before its shuffle, so an identity that holds a third of the rows is one row for each task.
        best = each.groupBy(*self.identity).agg(F.max_by(row, order).alias("__row"), F.sum("__new").alias("__n"))
        if rank is None:
            once = F.when(F.col("__n") > 1, F.raise_error(F.lit("an identity is repeated and no order was given")).cast("boolean")).otherwise(F.lit(True))
            best = best.filter(once)
        return best.select(*[F.col("__row")[c].alias(c) for c in df.columns])

    def set_properties(self, properties: dict[str, str], expected: int | None = None) -> int:
        """Small facts alone; with the expected version a compare-and-set: Conflict where another version stands."""
        return self._commit(lambda base: replace(base, properties={**base.properties, **properties}, operation="properties"), expected).version

    def compact(self, least: int = 2) -> int:
        """Writes the parts of each bucket that has at least that many as one. Versions that come between and touch none of them stay;
        if one of them was replaced, the work is done again. Reads stay as flat as there are buckets."""
        done: dict[tuple[Part, ...], tuple[Part, ...]] = {}

        def change(base: Snapshot) -> Snapshot | None:
            of: dict[int | None, list[Part]] = {}
            for p in base.parts:
                of.setdefault(p.bucket, []).append(p)
            worn = tuple(p for group in of.values() if len(group) >= least for p in group)
            for known, parts in done.items():
                if set(known) <= set(base.parts):
                    worn = known
                    break
            if not worn:
                return None
            if worn not in done:
                done[worn] = self._write(self._read(base, worn))
            return replace(base, parts=tuple(p for p in base.parts if p not in worn) + done[worn], operation="compact")

        return self._commit(change).version

    def vacuum(self, keep: int = 10) -> int:
        """Removes versions before the last `keep` and data folders that none of those lists; how many folders. Not to be run
        while a writer is at work whose files are not listed yet."""
        versions = self.versions()
        kept, gone = versions[-keep:], versions[:-keep] if keep else versions
        live = {"/".join(p.folder.split("/")[:2]) for v in kept for p in self._manifest(v).parts}
        removed = 0
        data = self._java.Path(f"{self.path}/data")
        for v in gone:
            self._files.delete(self._java.Path(self._at(v)), True)
        for status in self._files.listStatus(data) if self._files.exists(data) else []:
            if f"data/{status.getPath().getName()}" not in live:
                self._files.delete(status.getPath(), True)
                removed += 1
        return removed
