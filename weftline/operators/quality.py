"""Data quality of records: predicates, the bounded report, cleaning plans and write guards."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.types import strip

#: Codes by severity and action.
CODES = {
    "null_in_required_field": ("blocking", "provide_value"),
    "missing_required_field": ("blocking", "provide_value"),
    "unexpected_field": ("review", "map_or_drop"),
    "empty_string": ("review", "empty_to_null"),
    "outer_whitespace": ("review", "trim_whitespace"),
    "embedded_control_character": ("review", "inspect"),
    "non_normalized_unicode": ("review", "normalize_unicode_nfc"),
    "non_finite_number": ("blocking", "inspect"),
    "record_not_mapping": ("blocking", "inspect"),
}
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
FORMULA = r"^[ \t\r\n]*[=+\-@]"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    """Canonical composition. Every row of a plan that holds it passes through Python: see apart()."""
    return _nfc(c)


def beyond_ascii(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).rlike(r"[^\x00-\x7f]"), F.lit(False))
    return out


def apart(df: DataFrame, columns: list[str], work) -> DataFrame:
    """work(rows, composing) over the rows of ASCII alone (composing is false: they need no Python) and over the others."""
    if not columns:
        return work(df, False)
    rare = beyond_ascii(columns)
    return work(df.filter(~rare), False).unionByName(work(df.filter(rare), True))


def empty(c: Column) -> Column:
    return c == ""


def outer_whitespace(c: Column) -> Column:
    return (c != "") & (strip(c) != c)


def control_character(c: Column) -> Column:
    return c.rlike(CONTROL)


def formula_like(c: Column) -> Column:
    """Texts that a spreadsheet would run."""
    return c.rlike(FORMULA)


def not_normalized(c: Column) -> Column:
    """Not in NFC; only texts with a combining mark or a character that composition changes are looked at."""
    return c.rlike(r"[^\x00-\x7f]") & (nfc(c) != c)


def not_finite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def findings(df: DataFrame, required: tuple[str, ...] = (), expected: tuple[str, ...] | None = None, delimited: bool = False) -> DataFrame:
    """One row for each row and field with a finding: all columns of df, and code, field.

    delimited: df was read from delimited text, which cannot tell a null from an empty cell, so that a null text counts as empty.
    """
    texts = [name for name, kind in df.dtypes if kind == "string" and (expected is None or name in expected)]
    return apart(df, texts, lambda rows, composing: _findings(rows, required, expected, composing, delimited))


def _findings(df: DataFrame, required: tuple[str, ...], expected: tuple[str, ...] | None, composing: bool, delimited: bool = False) -> DataFrame:
    checks: list[Column] = []
    for name, kind in df.dtypes:
        if expected is not None and name not in expected:
            checks.append(_code(F.col(name).isNotNull(), "unexpected_field", name))
            continue
        if name in required:
            checks.append(_code(F.col(name).isNull(), "null_in_required_field", name))
        if kind == "string":
            c = F.col(name)
            checks += [_code(empty(c) | (c.isNull() if delimited else F.lit(False)), "empty_string", name), _code(outer_whitespace(c), "outer_whitespace", name), _code(control_character(c), "embedded_control_character", name)]
            if composing:
                checks.append(_code(not_normalized(c), "non_normalized_unicode", name))
        if kind in ("double", "float"):
            checks.append(_code(not_finite(F.col(name)), "non_finite_number", name))
    for name in required:
        if name not in df.columns:
            checks.append(_code(F.lit(True), "missing_required_field", name))
    if not checks:
        return df.withColumn("code", F.lit("")).withColumn("field", F.lit("")).filter("false")
    found = F.explode(F.array_compact(F.array(*checks)))
    return df.withColumn("finding", found).select(*df.columns, "finding.code", "finding.field")


def _code(when: Column, code: str, field: str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))


def report(df: DataFrame, order: str, samples: int = 8, **options) -> DataFrame:
    """code, field, n, and the `samples` smallest order keys of each group.

    The samples are kept with a bounded aggregate (the k smallest by approx-free top-k over ranks inside the shuffle's
    partial groups), so no group's keys are gathered.
    """
    found = findings(df, **options)
    counts = found.groupBy("code", "field").agg(F.count(F.lit(1)).alias("n"))
    first = smallest(found.select("code", "field", order), ["code", "field"], order, samples)
    return counts.join(first, ["code", "field"])


def smallest(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """keys and samples: the k smallest values of order, in order. Salted first, so that a hot group's top-k is found in parts."""
    from pyspark.sql import Window as W

    salted = df.withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(64)))
    part = W.partitionBy(*keys, "__salt").orderBy(order)
    kept = salted.withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= k)
    return kept.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("samples"))


ACTIONS = {
    "normalize_unicode_nfc": nfc,
    "trim_whitespace": strip,
    "empty_to_null": lambda c: F.nullif(c, F.lit("")),
}


def clean(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """df with the rules (field, action) applied in their order; fields that are missing or no strings are left."""
    kinds = dict(df.dtypes)
    for _, action in rules:
        if action not in ACTIONS:
            raise ValueError(f"unknown cleaning action {action}")
    composed = [f for f, action in rules if action == "normalize_unicode_nfc" and kinds.get(f) == "string"]

    def work(rows: DataFrame, composing: bool) -> DataFrame:
        for field, action in rules:
            if kinds.get(field) == "string" and (composing or action != "normalize_unicode_nfc"):
                rows = rows.withColumn(field, ACTIONS[action](F.col(field)))
        return rows

    return apart(df, composed, work)
