"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of the partitions find the digests that many rows share. Their exact counts and smallest ids are
taken by a pre-aggregated pass over these candidates alone; the verified winners, at most `counters` of them, are
broadcast and settle the rows of the large groups where they are read. All other digests are grouped by an ordinary
shuffle, in which no group is large: there are COUNTERS counters, or four for each shuffle partition if that is more, so
that no group left holds much more than a task's fair share.

Texts are equal when identical after each run of white space became one blank; null counts as empty. Of equal texts the
row with the smallest doc_id stays. Defined cases: empty texts are equal to each other; among equal texts rows with a
null doc_id never win against others, and in a group of nulls alone keep_id is null; of rows that repeat doc_id and text
exactly one stays in dedup(), while groups() marks each of them. Texts of any length are read whole; further columns are
handed through by dedup(), whatever their names, and not read by groups(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, Scratch, fresh, ship, text_of

#: Counters of a Misra-Gries summary: every digest held by more than 2 / counters of the rows is among its candidates.
COUNTERS = 1024


def counters_for(docs: DataFrame) -> int:
    return max(COUNTERS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def digest(text: str = "text") -> Column:
    return F.sha2(F.regexp_replace(text_of(text), f"{SPACE}+", " "), 256)


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates (sha, estimate) for frequent digests, at most `counters` rows: the partitions' summaries added up."""

    def summarise(batches):
        held: Counter = Counter()
        for batch in batches:
            seen = pc.value_counts(batch.column(0))
            held.update(dict(zip(seen.field(0).to_pylist(), seen.field(1).to_pylist(), strict=True)))
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = Counter({k: v - cut for k, v in held.items() if v > cut})
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["sha", "n"])

    ship(digests.sparkSession)
    parts = digests.select("sha").mapInArrow(summarise, "sha string, n long")
    return parts.groupBy("sha").agg(F.sum("n").alias("estimate")).orderBy(F.desc("estimate"), "sha").limit(counters)


def split(docs: DataFrame, text: str, counters: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The digests (doc_id, sha) of docs and the verified winners (sha, keep_id, group_size), at most `counters` rows."""
    digests = scratch.table(docs.select("doc_id", digest(text).alias("sha")))
    candidates = scratch.table(frequent(digests, counters))
    exact = digests.join(F.broadcast(candidates.select("sha")), "sha").groupBy("sha").agg(*summary())
    # Verified: only digests that truly hold a part of the rows that an ordinary task would feel.
    return digests, scratch.table(exact.filter(F.col("group_size") > max(1, 2 * digests.count() // counters)))


def summary() -> list[Column]:
    return [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]


def groups(docs: DataFrame, text: str = "text", counters: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    counters = counters or counters_for(docs)
    digests, winners = split(docs, text, counters, Scratch(docs.sparkSession))
    hot = digests.join(F.broadcast(winners), "sha")
    rest = digests.join(F.broadcast(winners.select("sha")), "sha", "left_anti")
    cold = rest.join(rest.groupBy("sha").agg(*summary()), "sha", "left")
    out = hot.unionByName(cold)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame, text: str = "text", counters: int | None = None) -> DataFrame:
    """The rows of docs that stay, with docs' own columns; copies in large groups are dropped where they are read."""
    columns = docs.columns
    scratch = Scratch(docs.sparkSession)
    digests, winners = split(docs, text, counters or counters_for(docs), scratch)
    sha, key, times = fresh(docs, "__sha", "__key", "__times")
    hot = F.broadcast(winners.select(F.col("sha").alias(sha), F.col("keep_id").alias(key)))
    first = digests.join(F.broadcast(winners.select("sha", "keep_id")), "sha", "left").filter("keep_id is null or doc_id <=> keep_id")
    counted = first.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    stay = scratch.table(counted.groupBy("sha").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "times"))).alias("least"), F.max("times").alias("nulls")))
    stay = stay.select(F.col("sha").alias(sha), F.col("least.doc_id").alias(key), F.coalesce("least.times", "nulls").alias(times))
    rows = docs.withColumn(sha, digest(text)).join(hot, sha, "left").filter(F.col(key).isNull() | F.col("doc_id").eqNullSafe(F.col(key))).drop(key)
    found = rows.join(stay, (rows[sha] == stay[sha]) & rows["doc_id"].eqNullSafe(stay[key])).select(*[rows[c] for c in columns], rows[sha].alias(sha), times)
    if stay.filter(F.col(times) > 1).limit(1).count() == 0:
        return found.select(*columns)
    # Rows that repeat doc_id and text are equal in all that counts here: one of them stays.
    tied = found.filter(F.col(times) > 1).dropDuplicates([sha])
    return found.filter(F.col(times) == 1).unionByName(tied).select(*columns)
