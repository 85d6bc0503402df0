"""Running sums, places and previous rows of one hot key without a task that holds it: a scan in two levels.

The order of (key, order) is cut into segments at values that a bounded sample gives, so a hot key spreads over many segments and a
segment holds many small keys. Within a segment of a key plain windows do the work. What a segment carries to the next one of its key
is one row of totals; only keys that a cut goes through have any, so there are at most as many carried rows as cuts, and they are
broadcast. Cuts are literals of the plan: a lost task cuts as the first did.

Order must be unique within a key, as for any window of rows. Nulls are a key like others; they come first in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.lifecycle import met

#: Segments at most, and rows of the sample for each.
SEGMENTS, SAMPLED = 64, 32


def cuts(df: DataFrame, columns: list[str], segments: int = SEGMENTS) -> list[tuple]:
    """At most segments - 1 values of the columns that cut df into parts of about equal size: quantiles of the rows with the smallest hashes."""
    taken = df.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(segments * SAMPLED)
    rows = [tuple(r) for r in taken.orderBy(*columns).collect()]
    picked = [rows[len(rows) * i // segments] for i in range(1, segments)] if rows else []
    return list(dict.fromkeys(picked))


def segment(df: DataFrame, columns: list[str], at: list[tuple]) -> Column:
    """The number of cuts that are not above the row: a balanced tree of comparisons."""
    kinds = {f.name: f.dataType for f in df.select(*columns).schema.fields}
    row = F.struct(*[F.col(c) for c in columns])
    edge = [F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(columns, values, strict=True)]) for values in at]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(row < edge[middle], tree(lo, middle)).otherwise(tree(middle + 1, hi))

    return tree(0, len(edge))


def running(df: DataFrame, key: list[str], order: list[str], sums: dict[str, str] | None = None, before: dict[str, str] | None = None, place: str | None = None, segments: int = SEGMENTS) -> DataFrame:
    """df with, for each row of its key in order: `place` (from 1), sums (name: column) up to and with the row, before (name: column):
    the value in the row before (null in the first)."""
    sums, before, unasked = sums or {}, before or {}, [] if place else ["__row"]
    place = place or "__row"
    cut = cuts(df, [*key, *order], segments)
    rows = df.withColumn("__segment", segment(df, [*key, *order], cut))
    inner = W.partitionBy("__segment", *key).orderBy(*order)
    to_here = inner.rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn(place, F.row_number().over(inner).cast("long"))
    for name, column in sums.items():
        out = out.withColumn(name, F.sum(column).over(to_here))
    for name, column in before.items():
        out = out.withColumn(name, F.lag(column).over(inner))
    if not cut:
        return out.drop("__segment", *unasked)
    # What each segment of a key adds up to; a key within one segment carries nothing.
    last = F.max_by(F.struct(*before.values()), F.struct(*order)) if before else F.lit(None)
    totals = rows.groupBy(*key, "__segment").agg(F.count(F.lit(1)).alias("__n"), last.alias("__last"), *[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()])
    over = W.partitionBy(*key).orderBy("__segment")
    former = over.rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *key, "__segment", F.sum("__n").over(former).alias("__carried"), F.lag("__last").over(over).alias("__last"), *[F.sum(f"__sum_{n}").over(former).alias(f"__sum_{n}") for n in sums]
    ).filter("__carried is not null")
    # At most one key goes through a cut: no more rows than cuts.
    out = met(out, F.broadcast(carried), [*key, "__segment"])
    first = F.col(place) == 1
    for name, column in before.items():
        out = out.withColumn(name, F.when(first, F.col("__last")[column]).otherwise(F.col(name)))
    for name in sums:
        # A sum of nulls only is null, as in a window.
        out = out.withColumn(name, F.when(F.col(name).isNull(), F.col(f"__sum_{name}")).otherwise(F.col(name) + F.coalesce(F.col(f"__sum_{name}"), F.lit(0))))
    out = out.withColumn(place, F.col(place) + F.coalesce("__carried", F.lit(0)))
    return out.drop("__segment", "__carried", "__last", *[f"__sum_{n}" for n in sums], *unasked)

