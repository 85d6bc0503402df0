"""Greedy chunks of a scope of any size by pointer jumping.

A new chunk begins where one more row would pass the limit of rows or bytes, or repeats an identity of the chunk; an oversize row
stands alone. So each row has one successor: the beginning of the next chunk, if a chunk begins at the row. The chunks of a scope are
the path of successors from its first row, which depends on all rows before; yet no task reads a scope:

1. Rows get their place in the scope by a scan in two levels, and so a block of `block` places. A block sees the first `most_rows` rows
   of the next one, as no chunk is longer. Successors are found by range searches on prefix sums of bytes and on the running maximum of
   each identity's former place.
2. A path enters a block at one of its first `most_rows` rows. For each of these the block says where the path enters the next block
   and how many chunks it begins on its way.
3. These maps are composed by doubling: after k joins the entries of 2^k blocks are known. Only entries are joined, never rows.
4. Each block follows its path from its entry and numbers the chunks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.lifecycle import met
from weftline.operators.scan import running
from weftline.session import shared_dir

#: Rows of a block, at least; it has four times the rows of a chunk if that is more.
BLOCK = 4096


def chunks(df: DataFrame, scope: str, order: str, size: str, most_rows: int, most_bytes: int, identity: str | None = None, block: int = BLOCK) -> DataFrame:
    """scope, order, size (and identity) with chunk, from 1. Order is unique in a scope; null sizes count as 0, and null identities
    repeat nothing; a null scope is one scope."""
    spark = df.sparkSession
    root = shared_dir(spark)
    block = max(block, 4 * most_rows)
    names = [scope, order, size, *([identity] if identity else [])]

    def table(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    placed = running(df.select(*names), [scope], [order], place="__place").withColumn("__place", F.col("__place") - 1)
    if identity:
        placed = running(placed, [scope, identity], [order], before={"__former": "__place"})
        placed = placed.withColumn("__former", F.when(F.col(identity).isNotNull(), F.col("__former")))
    else:
        placed = placed.withColumn("__former", F.lit(None).cast("long"))
    # The places are read twice, by the maps and by the numbering, which must see the same.
    placed = table(placed, "placed").withColumn("__block", F.floor(F.col("__place") / block))
    ahead = placed.filter((F.col("__place") % block < most_rows) & (F.col("__block") > 0)).withColumn("__block", F.col("__block") - 1)
    seen = placed.unionByName(ahead)
    numbers = lambda t, c: np.array([x or 0 for x in t.column(c).to_pylist()], np.int64)

    def read(t):
        t = t.sort_by("__place")
        at = t.column("__block")[0].as_py()
        first = at * block
        former = np.array([-1 if x is None else x for x in t.column("__former").to_pylist()], np.int64)
        own = int((numbers(t, "__place") // block == at).sum())
        n = len(former)
        size_ = numbers(t, size)
        used = np.concatenate([[0], np.cumsum(size_)])
        here = np.arange(n)
        following = np.minimum(np.searchsorted(used, used[:-1] + most_bytes, side="right") - 1, here + most_rows)
        repeated = np.searchsorted(np.maximum.accumulate(former), first + here, side="left")
        return t, at, own, np.maximum(np.minimum(following, np.maximum(repeated, here + 1)), here + 1)

    def mapped(t):
        import pyarrow as pa

        t, at, own, following = read(t)
        leaves, begun = [0] * own, [0] * own
        for i in range(own - 1, -1, -1):
            j = int(following[i])
            leaves[i], begun[i] = (j - own, 1) if j >= own else (leaves[j], begun[j] + 1)
        entries = 1 if at == 0 else min(most_rows, own)
        return pa.table([t.column(scope).slice(0, 1).take(pa.array([0] * entries)), pa.array([at] * entries, pa.int64()), pa.array(range(entries), pa.int64()), pa.array(leaves[:entries], pa.int64()), pa.array(begun[:entries], pa.int64())], ["scope", "b", "e", "x", "n"])

    key = df.select(F.col(scope).alias("scope"))
    jump = table(seen.groupBy(scope, "__block").applyInArrow(mapped, key.schema.add("b", "long").add("e", "long").add("x", "long").add("n", "long")), "jump0")
    known = jump.filter("b = 0").select("scope", "b", "e", F.lit(0).cast("long").alias("begun"))
    last = jump.agg(F.max("b")).first()[0] or 0
    step = 1
    while step <= last:
        moved = met(known, jump, ["scope", "b", "e"], "inner").select("scope", (F.col("b") + step).alias("b"), F.col("x").alias("e"), (F.col("begun") + F.col("n")).alias("begun"))
        known = table(known.unionByName(moved), f"known{step}")
        if 2 * step <= last:
            far = jump.select("scope", (F.col("b") - step).alias("b"), F.col("e").alias("x"), F.col("x").alias("leads"), F.col("n").alias("more"))
            both = met(jump, far, ["scope", "b", "x"], "inner").select("scope", "b", "e", F.col("leads").alias("x"), (F.col("n") + F.col("more")).alias("n"))
            jump = table(both, f"jump{2 * step}")
        step *= 2

    def numbered(t):
        import pyarrow as pa

        t, _, own, following = read(t)
        begins = np.zeros(own, np.int64)
        i = t.column("__e")[0].as_py()
        while i < own:
            begins[i] = 1
            i = int(following[i])
        chunk = np.cumsum(begins) + t.column("__begun")[0].as_py()
        return t.select(names).slice(0, own).append_column("chunk", pa.array(chunk, pa.int64()))

    entries = known.select(F.col("scope").alias(scope), F.col("b").alias("__block"), F.col("e").alias("__e"), F.col("begun").alias("__begun"))
    schema = df.select(*names).schema.add("chunk", "long")
    return met(seen, entries, [scope, "__block"], "inner").groupBy(scope, "__block").applyInArrow(numbered, schema)
