"""The type lattice, sensitivities and roles, as driver tables and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Data types, sensitivities from low to high, roles.
TYPES = ("unknown", "string", "integer", "decimal", "boolean", "date", "datetime", "uuid", "binary", "json")
SENSITIVITY = ("public", "internal", "personal", "confidential", "secret", "opaque")
ROLES = ("value", "primary_key", "foreign_key", "natural_key", "credential")
NOT_TRANSFORMABLE = ("secret", "opaque")

#: What field names say about sensitivity and role.
SECRET_NAMES = r"(?i)password|passwd|passwort|kennwort|pwd|secret|api[ _-]?key|access[ _-]?token|refresh[ _-]?token|api[ _-]?token|token|bearer|private[ _-]?key|credential|credentials"
CONFIDENTIAL_NAMES = r"(?i)iban|bic|swift|credit[ _-]?card|card[ _-]?number|tax[ _-]?id|steuer[ _-]?id|ssn"
PERSONAL_NAMES = r"(?i)e[ _-]?mail|mail[ _-]?address|phone|telefon|mobile|address|adresse|birth|dob|first[ _-]?name|last[ _-]?name|firstname|lastname|vorname|nachname"
KEY_NAMES = r"(?i)(^|[ _-])(id|identifier|kennung|nummer|number|nr|no)($|[ _-])|kundennr|customer[ _-]?number|client[ _-]?number|debitor[ _-]?nr|order[ _-]?number"


def satisfies(source: str, target: str) -> bool:
    """Whether a value of type source meets a contract of type target without coercion."""
    return target == "unknown" or source == target or (source == "integer" and target == "decimal")


def copy_safe(source: str, target: str) -> bool:
    return source != "unknown" and satisfies(source, target)


def copy_safe_column(source: Column, target: Column) -> Column:
    return (source != "unknown") & ((target == "unknown") | (source == target) | ((source == "integer") & (target == "decimal")))


def rank(sensitivity: Column) -> Column:
    """Position in SENSITIVITY, from 1."""
    return F.array_position(F.array(*[F.lit(s) for s in SENSITIVITY]), sensitivity)


def sensitivity_of(name: Column) -> Column:
    return (
        F.when(name.rlike(SECRET_NAMES), "secret").when(name.rlike(CONFIDENTIAL_NAMES), "confidential").when(name.rlike(PERSONAL_NAMES), "personal").otherwise("internal")
    )


def role_of(name: Column) -> Column:
    return F.when(name.rlike(SECRET_NAMES), "credential").when(name.rlike(KEY_NAMES), "natural_key").otherwise("value")


def textual_type(text: Column, role: Column | None = None) -> Column:
    """Type that a text looks like; keys and credentials stay strings, dates are ISO only, values are never changed."""
    t = strip(text)
    uuid = F.regexp_replace(F.regexp_replace(F.lower(t), r"^urn:|uuid:", ""), r"[{}-]", "").rlike("^[0-9a-f]{32}$")
    date = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & t.try_cast("date").isNotNull()
    stamp = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,6})?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$") & F.substring(t, 1, 10).try_cast("date").isNotNull()
    out = (
        F.when(t.isNull() | (t == ""), "unknown")
        .when(F.lower(t).isin("true", "false"), "boolean")
        .when(uuid, "uuid")
        .when(t.rlike(r"^[+-]?(0|[1-9][0-9]*)$"), "integer")
        .when(t.rlike(r"^[+-]?([0-9]+\.[0-9]+|[0-9]+[eE][+-]?[0-9]+|[0-9]+\.[0-9]+[eE][+-]?[0-9]+)$"), "decimal")
        .when(stamp, "datetime")
        .when(date, "date")
        .otherwise("string")
    )
    if role is None:
        return out
    return F.when((out != "unknown") & role.isin("natural_key", "credential"), "string").otherwise(out)


def merged_type(seen: Column) -> Column:
    """Type of a column from the set of its values' types (array)."""
    known = F.array_distinct(F.filter(seen, lambda t: t != "unknown"))
    within = lambda *names: F.size(F.array_except(known, F.array(*[F.lit(n) for n in names]))) == 0
    return (
        F.when(F.size(known) == 0, "unknown")
        .when(F.size(known) == 1, F.try_element_at(known, F.lit(1)))
        .when(within("integer", "decimal"), "decimal")
        .when(within("date", "datetime"), "datetime")
        .when(F.array_contains(known, "string"), "string")
        .otherwise("unknown")
    )


def strip(text: Column) -> Column:
    """All outer white space goes, that of Unicode and the information separators too; Spark's trim() knows the blank alone."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
