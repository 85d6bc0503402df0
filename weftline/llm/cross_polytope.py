"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by fast pseudo-rotations (three rounds of random signs and a Hadamard transform) and assigned to the nearest
of the signed axes. The codes of one or more such functions, the last perhaps over the first few turned coordinates only, are its
bucket in a table; several tables use other signs. A query visits the buckets in the order of the sum of squared gaps between its
largest turned coordinate and those of the bucket's axes, PROBES of them in each table, and ranks what it finds by exact Euclidean
distances of the original vectors.

* Number of buckets and probes are fitted on at most SAMPLE queries, whose exact neighbours one pass over all rows finds: the
  largest number of buckets (of at least ROWS rows on average) for which RECALL of these neighbours lie in so few probes that all
  queries together are copied no more often than there are rows. With one bucket the search is exact, so a fit always exists.
* A bucket with more rows or queries than a block is split into blocks; each block of queries meets each block of rows. Tasks read
  a block's queries, then stream its rows. They hand on the best k of each query, never pairs.
* Of equal vectors only the k + 1 with the smallest ids can be among anyone's nearest; the others are left out of the tables (not of
  the queries). They are found by their hash, so that only vectors with many copies are sorted.
* A query that found fewer than k (and fewer than there are) is compared with all rows.

Defined cases: rows whose id is null, and vectors that are null, empty, zero or hold null or non-finite components, take no part, nor
do vectors of another length than the table's most frequent one (ties: the smaller length). Of rows that share an id the one with the
smallest vector stands for all. Ties in distance go to the smaller id. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, ship, small

K = 10
TABLES = 2
#: Least mean number of rows of a bucket, queries of the fit, and the share of their neighbours that the probes must reach.
ROWS, SAMPLE, RECALL = 256, 200, 0.95
#: Rows and queries of one block.
ROW_BLOCK, QUERY_BLOCK = 65_536, 16_384
#: Distances of one matrix.
CELLS = 1 << 21


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def widths(buckets: int, width: int) -> list[int]:
    """How many turned coordinates each function of a table looks at, so that there are about `buckets` buckets."""
    out = []
    while buckets > 1:
        m = width if buckets >= 2 * width else 1 << max(0, round(np.log2(buckets / 2)))
        out.append(m)
        buckets //= 2 * m
    return out


class Table:
    """The functions of one table: a bucket for each vector, and the nearest buckets of a query."""

    def __init__(self, number: int, dimension: int, shape: list[int], seed: int = 1) -> None:
        self.shape, self.dimension = shape, dimension
        self.width = 1 << max(0, int(dimension - 1).bit_length())
        # The signs depend on the place of the function alone, so tables of another number of buckets share them.
        self.signs = [np.random.default_rng([seed, number, i]).choice([-1.0, 1.0], (3, self.width)) for i in range(len(shape))]

    def axes(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each function the coordinates along its signed axes."""
        x = np.zeros((len(vectors), self.width))
        x[:, : self.dimension] = vectors
        # Scaled by the largest component first, so that lengths neither overflow nor vanish.
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out = []
        for m, signs in zip(self.shape, self.signs, strict=True):
            turned = x
            for s in signs:
                turned = hadamard(turned * s)
            out.append(np.concatenate([turned[:, :m], -turned[:, :m]], axis=1))
        return out

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        code = np.zeros(len(vectors), np.int64)
        for axes in self.axes(vectors):
            code = code * axes.shape[1] + axes.argmax(axis=1)
        return code

    def probes(self, vectors: np.ndarray, most: int) -> np.ndarray:
        """The `most` nearest buckets of each vector, nearest first (all, if there are fewer).

        Gaps add up over the functions, so the nearest buckets begin with the nearest codes of the functions before.
        """
        gaps, codes = np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1), np.int64)
        for axes in self.axes(vectors):
            gap = (axes.max(axis=1, keepdims=True) - axes) ** 2
            order = np.argsort(gap, axis=1, kind="stable")[:, :most]
            gap = np.take_along_axis(gap, order, 1)
            total = (gaps[:, :, None] + gap[:, None, :]).reshape(len(vectors), -1)
            code = (codes[:, :, None] * axes.shape[1] + order[:, None, :]).reshape(len(vectors), -1)
            best = np.argsort(total, axis=1, kind="stable")[:, :most]
            gaps, codes = np.take_along_axis(total, best, 1), np.take_along_axis(code, best, 1)
        return codes


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, added up component by component in their order."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        step = a[:, i] - b[:, i]
        out += step * step
    return out


class Best:
    """The k nearest of each query among the rows seen so far, by exact distance, then id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = (vectors**2).sum(axis=1)
        self.limit = np.full(len(ids), np.inf)
        self.found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, CELLS // max(len(self.ids), 1))
        for begin in range(0, len(ids), step):
            self._see(ids[begin : begin + step], vectors[begin : begin + step])

    def _see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = (vectors**2).sum(axis=1)
        near = self.norms[:, None] + norms[None] - 2 * (self.vectors @ vectors.T)
        # One more than k, as the query's own row may be among them; the slack covers the rounding of this quick form.
        slack = 1e-9 * (self.norms[:, None] + norms[None])
        limit = self.limit
        if len(ids) > self.k:
            limit = np.minimum(limit, np.partition(near, self.k, axis=1)[:, self.k])
        query, row = np.nonzero(near <= limit[:, None] + slack)
        other = self.ids[query] != ids[row]
        query, row = query[other], row[other]
        exact = np.concatenate([squares(self.vectors[query[i : i + CELLS]], vectors[row[i : i + CELLS]]) for i in range(0, len(query), CELLS)] or [np.zeros(0)])
        q, d, v = (np.concatenate([a, b]) for a, b in zip(self.found, (query, exact, ids[row]), strict=True))
        order = np.lexsort((v, d, q))
        q, d, v = q[order], d[order], v[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.found = q[keep], d[keep], v[keep]
        last = place == self.k - 1
        self.limit[q[last]] = d[last]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, d, v = self.found
        return self.ids[q], v, np.sqrt(d)


FOUND = "query_id long, vec_id long, score double"


def _found(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], ["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """id and vector of the rows that take part, each id once."""
    x = F.col(vector)
    sound = F.col(id).isNotNull() & (F.size(x) > 0) & F.exists(x, lambda c: c != 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(sound).select(F.col(id).cast("long").alias("id"), x.cast("array<double>").alias("x") if not _floats(vectors, vector) else x.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.filter(F.size("x") == (lengths[0]["d"] if lengths else 0))
    again = rows.groupBy("id").count().filter("count > 1").select("id")
    if again.isEmpty():
        return rows
    again = small(again)
    first = F.row_number().over(W.partitionBy("id").orderBy("x"))
    return rows.join(again, "id", "left_anti").unionByName(rows.join(again, "id", "left_semi").withColumn("n", first).filter("n = 1").drop("n"))


def _floats(df: DataFrame, column: str) -> bool:
    return df.select(column).schema[0].dataType.simpleString() == "array<float>"


def without_copies(rows: DataFrame, k: int) -> DataFrame:
    """rows without those that have more than k equals with smaller ids."""
    marked = rows.withColumn("h", F.xxhash64("x"))
    hot = marked.groupBy("h").count().filter(F.col("count") > k + 1).select("h")
    if hot.isEmpty():
        return rows
    hot = small(hot)
    place = F.row_number().over(W.partitionBy("h", "x").orderBy("id"))
    few = marked.join(hot, "h", "left_semi").withColumn("n", place).filter(F.col("n") <= k + 1)
    return marked.join(hot, "h", "left_anti").select("id", "x").unionByName(few.select("id", "x"))


def compared(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of a few queries in each partition of rows (the caller bounds their number)."""

    def work(batches):
        from weftline.llm import cross_polytope as cp

        best = cp.Best(ids, vectors, k)
        for batch in batches:
            if batch.num_rows:
                best.see(batch.column(0).to_numpy(), cp.matrix(batch.column(1)))
        yield cp._found(best)

    return rows.select("id", "x").mapInArrow(work, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from what several blocks found."""
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def fit(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, k: int, tables: int, seed: int) -> tuple[list[int], int]:
    """The widths of a table's functions and the number of probes."""
    taken = queries.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).collect()
    ids, vectors = np.array([r["id"] for r in taken], np.int64), np.array([list(r["x"]) for r in taken], np.float64)
    truth = ranked(compared(rows, ids, vectors, k), k).select("query_id", F.col("vec_id").alias("id"))
    pairs = rows.join(F.broadcast(truth), "id").collect()
    if not pairs:
        return [], 1
    place = {int(i): n for n, i in enumerate(ids)}
    at = np.array([place[r["query_id"]] for r in pairs])
    near = np.array([list(r["x"]) for r in pairs], np.float64)
    dimension = vectors.shape[1]
    most = max(1, n_rows // (tables * n_queries))
    buckets = 1 << max(0, (n_rows // ROWS).bit_length() - 1)
    while buckets > 1:
        shape = widths(buckets, Table(0, dimension, []).width)
        first = np.full(len(pairs), np.inf)
        for t in range(tables):
            table = Table(t, dimension, shape, seed)
            visits = table.probes(vectors, most)
            hit = visits[at] == table.buckets(near)[:, None]
            first = np.minimum(first, np.where(hit.any(axis=1), hit.argmax(axis=1), np.inf))
        needed = np.sort(first)[int(np.ceil(RECALL * len(first))) - 1]
        if np.isfinite(needed):
            return shape, int(needed) + 1
        buckets //= 2
    return [], 1


def dealt(rows: DataFrame, shape: list[int], tables: int, probes: int, seed: int, with_vectors: bool = True) -> DataFrame:
    """table, bucket and, if wanted, id and vector: for rows (probes = 0) their bucket in each table, for queries those they visit."""

    def work(batches):
        from weftline.llm import cross_polytope as cp

        made: list[cp.Table] = []
        for batch in batches:
            step = max(1, 20_000 // max(probes, 1))
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                x = cp.matrix(part.column(1))
                made = made or [cp.Table(t, x.shape[1], shape, seed) for t in range(tables)]
                for t, table in enumerate(made):
                    code = table.probes(x, probes) if probes else table.buckets(x)[:, None]
                    n = code.shape[1]
                    columns = [pa.array(np.full(code.size, t, np.int32)), pa.array(code.reshape(-1))]
                    if with_vectors:
                        which = pa.array(np.repeat(np.arange(len(x)), n))
                        columns += [part.column(0).take(which), part.column(1).take(which)]
                    yield pa.RecordBatch.from_arrays(columns, ["t", "b", "id", "x"][: len(columns)])

    kind = rows.schema["x"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(work, "t int, b long" + f", id long, x {kind}" * with_vectors)


def met(blocks: DataFrame, k: int) -> DataFrame:
    """The best k of each query in each block; blocks are sorted by block (t, b, r, q), queries before rows."""

    def work(batches):
        from weftline.llm import cross_polytope as cp

        key, ids, vectors, best = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:], strict=False):
                part, block = batch.slice(begin, end - begin), tuple(keys[:4, begin].tolist())
                if block != key:
                    if best is not None:
                        yield cp._found(best)
                    key, ids, vectors, best = block, [], [], None
                own, x = part.column(5).to_numpy(), cp.matrix(part.column(6))
                if keys[4, begin] == 0:
                    ids.append(own)
                    vectors.append(x)
                elif ids:
                    best = best or cp.Best(np.concatenate(ids), np.concatenate(vectors), k)
                    best.see(own, x)
        if best is not None:
            yield cp._found(best)

    return blocks.mapInArrow(work, FOUND)


def blocks(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """t, b, r, q, part (0: query, 1: row), id, x: rows and queries that were dealt, block by block, sorted."""
    total = F.count(F.lit(1))
    n_rows, n_queries = rows.groupBy("t", "b").agg(total.alias("n")), queries.groupBy("t", "b").agg(total.alias("m"))
    parts = n_rows.join(n_queries, ["t", "b"]).select("t", "b", F.ceil(F.col("n") / ROW_BLOCK).cast("int").alias("rs"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("qs"))
    split = small(parts.filter("rs > 1 or qs > 1"))
    pick = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sides = []
    for part, df in enumerate((queries, rows)):
        df = df.join(split, ["t", "b"], "left").withColumn("rs", F.coalesce("rs", F.lit(1))).withColumn("qs", F.coalesce("qs", F.lit(1)))
        mine, others = ("q", "r") if part == 0 else ("r", "q")
        df = df.withColumn(mine, pick(F.col(f"{mine}s"))).withColumn(others, every(F.col(f"{others}s")))
        sides.append(df.select("t", "b", "r", "q", F.lit(part).alias("part"), "id", "x"))
    return reduce(DataFrame.unionByName, sides).repartition("t", "b", "r", "q").sortWithinPartitions("t", "b", "r", "q", "part")


def nearest(vectors: DataFrame, is_query: Column, id: str = "id", vector: str = "embedding", k: int = K, tables: int = TABLES, seed: int = 1) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query holds for (a condition on the id), its k nearest others."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    vectors = vectors.withColumn("__asked", is_query)
    every = usable(vectors, id, vector)
    asked = vectors.filter("__asked").select(F.col(id).cast("long").alias("id")).distinct()
    queries = every.join(small(asked), "id", "left_semi")
    n_rows, n_queries = every.count(), queries.count()
    if not n_queries or n_rows < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = without_copies(every, k)
    shape, probes = fit(rows, queries, n_rows, n_queries, k, tables, seed)
    if not shape:
        tables = 1
    found = scratch.table(ranked(met(blocks(dealt(rows, shape, tables, 0, seed), dealt(queries, shape, tables, probes, seed)), k), k))
    few = queries.join(small(found.filter(F.col("rank") == min(k, n_rows - 1)).select(F.col("query_id").alias("id"))), "id", "left_anti")
    if few.isEmpty():
        return found
    # One bucket holds everything: the exact way for queries whose buckets had too little.
    rest = ranked(met(blocks(dealt(rows, [], 1, 0, seed), dealt(few, [], 1, 1, seed)), k), k)
    return found.join(small(few.select(F.col("id").alias("query_id"))), "query_id", "left_anti").unionByName(rest)
