"""Scalar functions and small relational helpers that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.transforms import Result


def origin(url: Column) -> Column:
    """Scheme and host of a web address: lower case, without user, default port and path; null for other schemes or with a user."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    authority = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1))
    plain = F.when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(F.regexp_replace(authority, ":80$", ""))
    return F.when(scheme.isin("http", "https") & (authority != "") & ~authority.contains("@"), F.concat(scheme, F.lit("://"), plain))


def json_pointer(text: Column, pointer: str) -> Result:
    """The value at a JSON Pointer as text; a path that is not there, or text that is no JSON, is an error and not null."""
    parsed = F.try_parse_json(text)
    # A step of digits is a place in an array and a name in an object, so each reading of the steps is asked for.
    paths = ["$"]
    for part in pointer.split("/")[1:]:
        name = part.replace("~1", "/").replace("~0", "~")
        named = "['" + name.replace("'", "\\'") + "']"
        place = [f"[{name}]"] if name.isascii() and name.isdigit() and (name == "0" or name[0] != "0") else []
        paths = [p + step for p in paths for step in (named, *place)]
    value = F.coalesce(*[F.try_variant_get(parsed, p, "string") for p in paths])
    there = F.coalesce(*[F.try_variant_get(parsed, p, "variant") for p in paths]).isNotNull()
    return Result(value, F.when(text.isNotNull() & ~F.coalesce(there, F.lit(False)), "pointer_missing"))


def numbered(df: DataFrame, order: str, out: str, chunk: int = 1 << 12) -> DataFrame:
    """df with out: 1..n in the order of a unique column, without one task for all rows.

    Rows are range-partitioned by the order; the partitions' counts give each its first number.
    """
    ranged = df.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__first", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(W.partitionBy("__part").orderBy(order))
    return ranged.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn(out, (F.col("__first") + F.col("__place")).cast("long")).drop("__part", "__place", "__first")


def choice(value: Column, allowed: tuple[str, ...], default: str) -> Result:
    """An enumerated choice: trimmed, lower case, blank as the default, others an error."""
    plain = F.lower(F.trim(value))
    chosen = F.when(plain.isNull() | (plain == ""), default).otherwise(plain)
    ok = chosen.isin(*allowed)
    return Result(F.when(ok, chosen), F.when(~ok, "unknown_choice"))


def padded_integer(value: Column, width: int) -> Column:
    """A whole number shown with leading zeros, the sign before them."""
    digits = F.lpad(F.abs(value).cast("string"), F.greatest(F.length(F.abs(value).cast("string")), F.lit(width)), F.lit("0"))
    return F.concat(F.when(value < 0, "-").otherwise(""), digits)


def reason_code_valid(code: Column) -> Column:
    return code.rlike("^[a-z0-9_]{1,128}$")


def correlation_id(run: Column, key: Column) -> Column:
    """The first 32 hexadecimal digits of SHA-256 over the run's bytes, a zero byte and the key."""
    return F.left(F.sha2(F.concat(F.unhex(run), F.unhex(F.lit("00")), key.cast("binary")), 256), F.lit(32))
