"""Whether a Python data source keeps the contract of a source or a destination, before any pipeline trusts it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter

PASSED, FAILED, ADVISORY = "passed", "failed", "advisory"


class NotConformant(RuntimeError):
    pass


def _own(cls: type, base: type, name: str) -> bool:
    return callable(getattr(cls, name, None)) and getattr(cls, name) is not getattr(base, name, None)


def checks(spark: SparkSession, source: type[DataSource], role: str, options: dict[str, str] | None = None) -> DataFrame:
    """code, status (passed, failed, advisory), detail. role: source or destination.

    By its class: a name, a schema, a reader or a writer, and for destinations whether a write is taken back when a
    task fails. A source that is given options is read too: rows must have the declared schema, and two reads must agree, as a
    task that is run again after a lost executor reads its partition anew.
    """
    if role not in ("source", "destination"):
        raise ValueError("a role is source or destination")
    rows = [("capabilities.immutable_contract", isinstance(source, type) and issubclass(source, DataSource), "a data source class")]
    if rows[0][1]:
        rows += [
            ("capabilities.name", bool(source.name().strip()), "a name; the class gives one"),
            ("schema.inspect_method", _own(source, DataSource, "schema"), "schema()"),
        ]
        if role == "source":
            rows.append(("source.records", _own(source, DataSource, "reader"), "reader()"))
        else:
            rows.append(("destination.records", _own(source, DataSource, "writer"), "writer()"))
    made = [(code, PASSED if ok else FAILED, detail) for code, ok, detail in rows]
    if role == "destination" and rows[0][1]:
        made.append(_atomic(source, options))
    if role == "source" and options is not None and all(ok for _, ok, _ in rows):
        made += _read(spark, source, options)
    return spark.createDataFrame(made, "code string, status string, detail string")


def _atomic(source: type[DataSource], options: dict[str, str] | None) -> tuple[str, str, str]:
    """Commit and abort belong together: a writer with one of them leaves parts behind or publishes nothing."""
    code = "destination.atomic_batch_method"
    if options is None or not _own(source, DataSource, "writer"):
        return code, ADVISORY, "not looked at without options"
    try:
        writer = type(source(options).writer(source(options).schema(), False))
    except Exception as error:
        return code, FAILED, f"writer() fails with {type(error).__name__}"
    both = [_own(writer, DataSourceWriter, m) for m in ("commit", "abort")]
    return code, PASSED if all(both) else FAILED if any(both) else ADVISORY, "commit() and abort()"


def _read(spark: SparkSession, source: type[DataSource], options: dict[str, str]) -> list[tuple[str, str, str]]:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).options(**options)
    try:
        # Counts and sums of hashes: neither read passes through the driver, and repeated rows do not cancel out.
        tell = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first()[:]
        first, second = (tell(reader.load()) for _ in range(2))
    except Exception as error:
        return [("source.schema_holds", FAILED, f"a read fails with {type(error).__name__}")]
    return [("source.schema_holds", PASSED, f"{first[0]} rows"), ("source.repeatable", PASSED if first == second else FAILED, "two reads agree" if first == second else "two reads differ")]


def require(spark: SparkSession, source: type[DataSource], role: str, options: dict[str, str] | None = None) -> DataFrame:
    """The checks, if none fails."""
    found = checks(spark, source, role, options)
    failed = [r["code"] for r in found.filter(F.col("status") == FAILED).orderBy("code").collect()]
    if failed:
        raise NotConformant(f"the data source's contract is broken: {', '.join(failed)}")
    return found
