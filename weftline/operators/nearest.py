"""The k vectors of greatest cosine for each query vector, exactly, with cells that cannot hold one left out.

Unit vectors are dealt to the nearest of a few hundred centres (spherical k-means on a bounded sample). A query first meets the cells
nearest to it, until they hold k rows; the k-th score is a bound. By the triangle inequality of angles no row of a cell can be nearer to
the query than the angle to its centre less the cell's widest angle, so the second round meets only cells that can beat the bound.
Scores are rounded to `digits`, and ties go to the smaller id; the bound allows for the rounding.

Rows and queries of a cell meet in blocks of bounded size. Null vectors take no part; zero vectors score 0 with all, and stand in a
cell of their own that every query meets. On vectors without clusters nothing can be left out, and all blocks meet.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Mean rows of a cell, cells at most, vectors of the sample for each cell, rounds of the means, and rows and queries of a block.
CELL_ROWS, MOST_CELLS, SAMPLED, ROUNDS = 2048, 1024, 8, 4
ROW_BLOCK, QUERY_BLOCK = 16_384, 16_384
ZERO = -1


class Met(NamedTuple):
    """query_id, vec_id, score; and how many pairs of query and row there are and were compared."""

    found: DataFrame
    pairs: int
    compared: int


def centres(rows: DataFrame, cells: int) -> np.ndarray:
    """At most `cells` unit vectors, from the rows with the smallest hashes."""
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(cells * SAMPLED).collect()
    x = np.array([r["x"] for r in taken], np.float64) if taken else np.zeros((0, 1))
    norms = np.linalg.norm(x, axis=1)
    x = x[norms > 0] / norms[norms > 0][:, None]
    at = x[:cells]
    for _ in range(ROUNDS if len(at) > 1 else 0):
        own = (x @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(length > 0, sums / np.where(length > 0, length, 1), at)
    return at


def topk(vectors: DataFrame, asked: Column, id: str, vector: str, k: int = 4, digits: int = 6, cell_rows: int = CELL_ROWS) -> Met:
    """For each row that `asked` holds for, its k nearest others by cosine."""
    rows = vectors.filter(F.col(vector).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("x"), F.coalesce(asked, F.lit(False)).alias("asked"))
    n_rows = rows.count()
    cells = int(min(MOST_CELLS, max(1, n_rows // cell_rows)))
    at = centres(rows, cells)
    kind = rows.schema["x"].dataType.simpleString()

    def unit(column):
        x = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, at.shape[1]))
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            x = unit(batch.column(1))
            near = np.clip(x @ at.T, -1, 1) if len(at) else np.zeros((len(x), 1))
            cell = np.where((x != 0).any(axis=1), near.argmax(axis=1), ZERO)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(near.max(axis=1) if len(x) else [], pa.float64())], ["id", "x", "asked", "cell", "near"])

    dealt = rows.mapInArrow(deal, StructType([*rows.schema.fields, *StructType.fromDDL("cell long, near double").fields]))
    stats = {r["cell"]: (r["n"], float(np.arccos(np.clip(r["near"], -1, 1)))) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).collect()}
    known = sorted(c for c in stats if c != ZERO)
    sizes, widest = np.array([stats[c][0] for c in known]), np.array([stats[c][1] for c in known])
    centre = at[known] if known else np.zeros((0, 1))

    def visits(second: bool):
        """Cells of each query: the nearest ones that hold k others, and the zero vectors; or the rest that can beat its bound."""

        def work(batches):
            import pyarrow as pa

            for batch in batches:
                x = unit(batch.column(1))
                angle = np.arccos(np.clip(x @ centre.T, -1, 1))
                whole = ~(x != 0).any(axis=1)
                order = np.argsort(angle, axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1)
                home = np.zeros_like(angle, bool)
                np.put_along_axis(home, order, np.concatenate([np.zeros((len(x), 1)), held[:, :-1]], axis=1) < k + 1, axis=1)
                home |= whole[:, None]
                take = home
                if second:
                    best = np.cos(np.maximum(angle - widest, 0))
                    bound = batch.column(2).to_numpy(zero_copy_only=False)
                    take = ~home & (best >= bound[:, None] - 2 * 10.0**-digits)
                query, cell = np.nonzero(take)
                cell = np.array(known, np.int64)[cell]
                if not second and ZERO in stats:
                    query, cell = np.concatenate([query, np.arange(len(x))]), np.concatenate([cell, np.full(len(x), ZERO)])
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *(batch.column(i).take(pa.array(query)) for i in (0, 1))], ["cell", "id", "x"])

        return work

    def compare(queries, others):
        import pyarrow as pa

        best = []
        if queries.num_rows and others.num_rows:
            qi, vi = queries.column("id").to_numpy(), others.column("id").to_numpy()
            v = unit(others.column("x"))
            step = max(1, (1 << 22) // len(vi))
            for begin in range(0, len(qi), step):
                q = unit(queries.column("x").slice(begin, step))
                scores = np.round(q @ v.T, digits)
                for a, s in zip(qi[begin : begin + step].tolist(), scores, strict=True):
                    # More than k may tie at the k-th score; the smallest ids among them count.
                    s = np.where(vi == a, -np.inf, s)
                    near = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.flatnonzero(s > -np.inf)
                    near = near[s[near] > -np.inf]
                    near = near[np.lexsort((vi[near], -s[near]))[:k]]
                    best.append((np.full(len(near), a), vi[near], s[near]))
        columns = [np.concatenate(c) for c in zip(*best, strict=True)] if best else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    def search(queries: DataFrame) -> tuple[DataFrame, int]:
        """The best of each block, and the number of pairs that are compared."""
        asked_in = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}
        parts = {c: (-(-stats[c][0] // ROW_BLOCK), -(-m // QUERY_BLOCK)) for c, m in asked_in.items()}
        split = {c: p for c, p in parts.items() if p != (1, 1)}

        def side(df: DataFrame, mine: int) -> DataFrame:
            count = [F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, p in split.items() for x in (c, p[i])]), F.col("cell")), F.lit(1)) if split else F.lit(1) for i in (0, 1)]
            own = F.pmod(F.xxhash64("id"), count[mine]).cast("int")
            every = F.explode(F.sequence(F.lit(0), count[1 - mine] - 1))
            names = ("r", "q")
            return df.withColumn(names[mine], own).withColumn(names[1 - mine], every).select("cell", "r", "q", "id", "x")

        keys = ("cell", "r", "q")
        left, right = side(queries, 1).groupBy(*keys), side(dealt.select("cell", "id", "x"), 0).groupBy(*keys)
        return left.cogroup(right).applyInArrow(compare, "query_id long, vec_id long, score double"), sum(stats[c][0] * m for c, m in asked_in.items())

    def best(found: DataFrame) -> DataFrame:
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("place", place).filter(F.col("place") <= k).drop("place")

    queries = dealt.filter("asked").select("id", "x")
    n_queries = rows.filter("asked").count()
    shape = f"cell long, id long, x {kind}"
    first, compared = search(queries.mapInArrow(visits(False), shape))
    pairs = n_rows * n_queries
    if compared >= pairs:
        return Met(best(first), pairs, compared)
    near = best(first)
    bound = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    bounded = queries.join(bound, "id", "left").select("id", "x", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
    second, more = search(bounded.mapInArrow(visits(True), shape))
    return Met(best(near.unionByName(second)), pairs, compared + more)
