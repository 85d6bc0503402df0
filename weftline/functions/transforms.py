"""Source transforms as columns of value and error: a bad value becomes data, not a failed job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.types import strip

FAILED = "source_transform_failed"
#: Transforms by the stage that runs them.
STAGES = {
    "copy": "source",
    "trim": "source",
    "parse_integer": "source",
    "parse_decimal": "source",
    "parse_datetime": "source",
    "opaque_forward": "transport",
    "lookup_foreign_key": "destination",
}


@dataclass(frozen=True)
class Result:
    value: Column
    error: Column


def _ok(value: Column) -> Result:
    return Result(value, F.lit(None).cast("string"))


def copy(c: Column) -> Result:
    return _ok(c)


def trim(c: Column) -> Result:
    return _ok(strip(c))


def parse_integer(c: Column) -> Result:
    """Null and '' are null; white space alone is an error; digits with a sign after stripping, up to 64 bits."""
    text = strip(c)
    value = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))
    empty = c.isNull() | (c == "")
    return Result(F.when(~empty, value), F.when(~empty & value.isNull(), FAILED))


def parse_decimal(c: Column, decimal_separator: str = ".", thousands_separator: str = ",", scale: int = 6) -> Result:
    """Thousands separators go first, then the decimal separator becomes a point; 38 digits, the rest is an error."""
    text = F.replace(strip(c), F.lit(thousands_separator), F.lit("")) if thousands_separator else strip(c)
    text = F.replace(text, F.lit(decimal_separator), F.lit(".")) if decimal_separator != "." else text
    value = F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast(f"decimal(38,{scale})"))
    empty = c.isNull() | (c == "")
    return Result(F.when(~empty, value), F.when(~empty & value.isNull(), FAILED))


#: strptime directives and their letters in Spark's patterns.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%f": "SSSSSS", "%z": "Z", "%p": "a", "%I": "hh", "%j": "DDD"}


def java_format(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "%":
            directive = pattern[i : i + 2]
            if directive not in DIRECTIVES:
                raise ValueError(f"unknown directive {directive}")
            out, i = out + DIRECTIVES[directive], i + 2
        else:
            out, i = out + (f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]), i + 1
    return out


def parse_datetime(c: Column, pattern: str | None = None) -> Result:
    """Null and '' are null; ISO 8601, or a strptime pattern; nothing is stripped."""
    if pattern:
        value = F.try_to_timestamp(c, F.lit(java_format(pattern)))
    else:
        value = F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"), c.try_cast("timestamp"))
    empty = c.isNull() | (c == "")
    return Result(F.when(~empty, value), F.when(~empty & value.isNull(), FAILED))


def opaque_forward(c: Column, key: Column, context: Column) -> Result:
    """The value sealed with AES-GCM under the context as additional data; the built-in stand-in for a recipient's envelope."""
    return _ok(F.aes_encrypt(c.cast("string"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), context))


SOURCE = {"copy": copy, "trim": trim, "parse_integer": parse_integer, "parse_decimal": parse_decimal, "parse_datetime": parse_datetime}


def apply(name: str, c: Column, **parameters) -> Result:
    if name not in SOURCE:
        raise ValueError(f"not a source transform: {name}")
    return SOURCE[name](c, **parameters)


def canonical_payload(kind: str, c: Column) -> Column:
    """A value with its kind tag as canonical JSON."""
    return F.to_json(F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("value")), {"ignoreNullFields": "false"})
