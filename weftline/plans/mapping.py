"""Mapping plans: fields, rules, validation, preflight and execution as one projection and its lookups."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import transforms
from weftline.functions.types import NOT_TRANSFORMABLE, SENSITIVITY, copy_safe, rank, satisfies

#: Rows of a lookup's build side up to which it is broadcast; counted, never assumed.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Field:
    id: str
    name: str
    data_type: str = "unknown"
    nullable: bool = True
    sensitivity: str = "internal"
    role: str = "value"
    aliases: tuple[str, ...] = ()
    destination_generated: bool = False


@dataclass(frozen=True)
class Relation:
    source_field: str
    container: str
    field: str
    #: name and type of the business keys by which a row of the container is found
    lookup_keys: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Schema:
    id: str
    fields: tuple[Field, ...]
    relations: tuple[Relation, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)

    def by_id(self) -> dict[str, Field]:
        return {f.id: f for f in self.fields}

    def relation(self, field_id: str) -> Relation | None:
        return next((r for r in self.relations if r.source_field == field_id), None)

    def structural(self) -> str:
        """Fingerprint without id and metadata: equal for the same structure under other names of the schema."""
        return digest({"fields": [asdict(f) for f in self.fields], "relations": [asdict(r) for r in self.relations]})

    def exact(self) -> str:
        return digest({"id": self.id, "metadata": self.metadata, "structure": self.structural()})


@dataclass(frozen=True)
class Rule:
    source: str
    target: str
    transform: str = "copy"
    parameters: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Plan:
    source_schema: str
    target_schema: str
    source_fingerprint: str
    target_fingerprint: str
    rules: tuple[Rule, ...]
    version: int = 1

    def digest(self) -> str:
        return digest(asdict(self))


def digest(value: object) -> str:
    """SHA-256 of canonical JSON: sorted keys, no blanks, characters as they are."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def plan_for(source: Schema, target: Schema, rules: tuple[Rule, ...], version: int = 1) -> Plan:
    return Plan(source.id, target.id, source.exact(), target.exact(), rules, version)


@dataclass(frozen=True)
class Finding:
    code: str
    field: str | None
    severity: str


def validate(plan: Plan, source: Schema, target: Schema) -> list[Finding]:
    """What speaks against running the plan, before any row is read; severity blocking or review."""
    out: list[Finding] = []
    block = lambda code, f=None: out.append(Finding(code, f, "blocking"))
    review = lambda code, f=None: out.append(Finding(code, f, "review"))
    for side, schema in (("source", source), ("target", target)):
        if getattr(plan, f"{side}_schema") != schema.id:
            block(f"{side}_schema_id_mismatch")
        elif getattr(plan, f"{side}_fingerprint") != schema.exact():
            block(f"{side}_schema_drift")
    sources, targets, seen = source.by_id(), target.by_id(), set()
    for rule in plan.rules:
        s, t = sources.get(rule.source), targets.get(rule.target)
        if s is None:
            block("unknown_source_field", rule.source)
        if t is None:
            block("unknown_target_field", rule.target)
        if rule.target in seen:
            block("duplicate_target", rule.target)
        seen.add(rule.target)
        if rule.transform not in transforms.STAGES:
            block("unknown_transform", rule.target)
            continue
        if s is None or t is None:
            continue
        if not route_allowed(s, t, rule.transform):
            block("policy_violation", rule.target)
        if s.nullable and not t.nullable:
            review("nullable_source_to_required_target", rule.target)
        if rule.transform == "copy":
            if s.data_type == "unknown":
                review("source_type_unknown", rule.source)
            elif not satisfies(s.data_type, t.data_type):
                block("type_mismatch", rule.target)
        if rule.transform == "lookup_foreign_key":
            relation, key = target.relation(t.id), dict(rule.parameters).get("lookup_key")
            kinds = dict(relation.lookup_keys) if relation else {}
            if relation is None or key not in kinds:
                block("foreign_key_lookup_contract_invalid", rule.target)
            elif "unknown" in (s.data_type, kinds[key]):
                review("foreign_key_lookup_type_unknown", rule.target)
            elif not copy_safe(s.data_type, kinds[key]):
                block("foreign_key_lookup_type_mismatch", rule.target)
    for f in target.fields:
        if not f.nullable and not f.destination_generated and f.id not in seen:
            block("required_target_unmapped", f.id)
    return out


def route_allowed(source: Field, target: Field, transform: str) -> bool:
    """Values never flow to a lower sensitivity; secret and opaque ones are only handed through; opaque ends are sealed."""
    if SENSITIVITY.index(target.sensitivity) < SENSITIVITY.index(source.sensitivity):
        return False
    if source.sensitivity in NOT_TRANSFORMABLE and transform not in ("copy", "opaque_forward"):
        return False
    return transform == "opaque_forward" or "opaque" not in (source.sensitivity, target.sensitivity)


def route_allowed_column(source: Column, target: Column, transform: Column) -> Column:
    """route_allowed of columns of sensitivities and transforms."""
    through = transform.isin("copy", "opaque_forward") | ~source.isin(*NOT_TRANSFORMABLE)
    sealed = (transform == "opaque_forward") | ((source != "opaque") & (target != "opaque"))
    return (rank(target) >= rank(source)) & through & sealed


def rule_columns(rule: Rule) -> transforms.Result:
    if transforms.STAGES[rule.transform] != "source":
        return transforms.copy(F.col(rule.source))
    return transforms.apply(rule.transform, F.col(rule.source), **dict(rule.parameters))


#: Column types that meet a declared type.
SPARK_TYPES = {"string": ("string",), "integer": ("tinyint", "smallint", "int", "bigint"), "boolean": ("boolean",), "date": ("date",), "datetime": ("timestamp", "timestamp_ntz"), "binary": ("binary",)}


def meets(value: Column, column_type: str, target: Field) -> Column:
    """The value contract: null only where allowed, the declared type, and finite numbers."""
    if target.data_type == "unknown":
        typed = F.lit(True)
    elif target.data_type == "decimal":
        typed = F.lit(column_type.startswith(("decimal", "double", "float", "bigint", "int", "smallint", "tinyint")))
    elif target.data_type in ("uuid", "json"):
        typed = F.lit(column_type == "string" or column_type.startswith(("struct", "array")))
    else:
        typed = F.lit(column_type in SPARK_TYPES[target.data_type])
    if column_type in ("double", "float"):
        typed = typed & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(value.isNull(), F.lit(target.nullable)).otherwise(typed)


def lookup(probe: DataFrame, key: str, dimension: DataFrame, business_key: str, returned: str, out: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """probe with `out` (the referenced id) and `out`_status: matched, unmatched, not_unique, null_probe.

    A business key that stands for several rows resolves nothing. Types must be equal: nothing is coerced. The side that
    is looked up is counted and broadcast only when small; beyond that the join is Spark's choice, and null probes, which
    would all meet in one task, do not take part in it.
    """
    probe_type, key_type = dict(probe.dtypes)[key], dict(dimension.dtypes)[business_key]
    if probe_type != key_type:
        raise TypeError(f"lookup of {probe_type} by {key_type}")
    keys = dimension.filter(F.col(business_key).isNotNull()).groupBy(F.col(business_key).alias("__key"))
    keys = keys.agg(F.count(F.lit(1)).alias("__rows"), F.min(returned).alias("__id"))
    side = F.broadcast(keys) if dimension.limit(broadcast_rows + 1).count() <= broadcast_rows else keys
    if side is keys:
        # Dealt out by key, all null probes would meet in one task; they pass by the join.
        found = probe.filter(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("__key"), "left")
        found = found.unionByName(probe.filter(F.col(key).isNull()), allowMissingColumns=True)
    else:
        found = probe.join(side, F.col(key) == F.col("__key"), "left")
    status = F.when(F.col(key).isNull(), "null_probe").when(F.col("__rows").isNull(), "unmatched").when(F.col("__rows") > 1, "not_unique").otherwise("matched")
    return found.withColumn(f"{out}_status", status).withColumn(out, F.when(F.col(f"{out}_status") == "matched", F.col("__id"))).drop("__key", "__rows", "__id")


def project(df: DataFrame, plan: Plan, dimensions: dict[str, tuple[DataFrame, str, str]] | None = None) -> DataFrame:
    """The mapped records: one projection over all source rules, then a join for each lookup (target -> dimension, key, id)."""
    looked = [r for r in plan.rules if r.transform == "lookup_foreign_key"]
    out = df.select(*[rule_columns(r).value.alias(r.target) for r in plan.rules])
    for rule in looked:
        dimension, key, returned = (dimensions or {})[rule.target]
        out = lookup(out.withColumnRenamed(rule.target, "__probe"), "__probe", dimension, key, returned, rule.target).drop("__probe", f"{rule.target}_status")
    return out.select(*[r.target for r in plan.rules])


def preflight(df: DataFrame, plan: Plan, source: Schema, target: Schema, dimensions: dict[str, tuple[DataFrame, str, str]] | None = None) -> DataFrame:
    """df with findings array<struct<code,field,severity>>: all that is wrong with a row, nothing written.

    For each rule, the first that applies: required value null, transform failed, target null, type contract, lookup.
    """
    sources, targets = source.by_id(), target.by_id()
    dtypes = dict(df.dtypes)
    checks: list[Column] = []
    for rule in plan.rules:
        s, t = sources[rule.source], targets[rule.target]
        if rule.source not in dtypes:
            checks.append(finding("required_source_missing", rule.target, "blocking") if not t.nullable else no_finding())
            continue
        result = rule_columns(rule)
        if s.sensitivity in NOT_TRANSFORMABLE:
            checks.append(F.when(F.col(rule.source).isNull() & F.lit(not t.nullable), finding("required_target_null", rule.target, "blocking")))
            continue
        if rule.transform == "lookup_foreign_key":
            dimension, key, returned = (dimensions or {})[rule.target]
            df = lookup(df, rule.source, dimension, key, returned, f"__{rule.target}")
            status = F.col(f"__{rule.target}_status")
            checks.append(
                F.when((status == "null_probe") & F.lit(not t.nullable), finding("required_target_null", rule.target, "blocking")).when(
                    status.isin("unmatched", "not_unique"), finding("foreign_key_lookup_failed", rule.target, "blocking")
                )
            )
            continue
        kind = dict(df.select(result.value.alias("v")).dtypes)["v"]
        checks.append(
            F.when(F.col(rule.source).isNull() & F.lit(not t.nullable), finding("required_target_null", rule.target, "blocking"))
            .when(result.error.isNotNull(), finding(transforms.FAILED, rule.target, "blocking"))
            .when(result.value.isNull() & F.lit(not t.nullable), finding("required_target_null", rule.target, "blocking"))
            .when(~meets(result.value, kind, t), finding("transformed_type_mismatch", rule.target, "blocking"))
        )
    return df.withColumn("findings", F.array_compact(F.array(*checks)))


def finding(code: str, field_id: str, severity: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(field_id).alias("field"), F.lit(severity).alias("severity"))


def no_finding() -> Column:
    return F.lit(None).cast("struct<code:string,field:string,severity:string>")


def preflight_summary(checked: DataFrame) -> DataFrame:
    """One row: records_checked, blocked_records, findings, valid, promotable (valid and at least one row)."""
    n = F.count(F.lit(1))
    blocked = F.count_if(F.exists("findings", lambda f: f["severity"] == "blocking"))
    return checked.agg(
        n.alias("records_checked"),
        blocked.alias("blocked_records"),
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("findings"),
        (blocked == 0).alias("valid"),
        ((blocked == 0) & (F.coalesce(F.sum(F.size("findings")), F.lit(0)) == 0) & (n > 0)).alias("promotable"),
    )


def preflight_findings(checked: DataFrame) -> DataFrame:
    """code, field, severity, n."""
    each = checked.select(F.explode("findings").alias("f")).select("f.*")
    return each.groupBy("code", "field", "severity").agg(F.count(F.lit(1)).alias("n"))


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))
