"""From decisions to plans: rules for approved pairs, repair after drift, and stored recipes that are bound again."""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.types import NOT_TRANSFORMABLE, copy_safe
from weftline.operators.matching import LOOKUP_NAME, name_scores
from weftline.plans.mapping import Field, Finding, Plan, Rule, Schema, plan_for, route_allowed, route_allowed_column

STABLE_NAME = 0.88


class PlanRefused(ValueError):
    pass


def likeness(pairs: list[tuple[Field, Field]]) -> list[float]:
    """The matcher's name scores of pairs of fields, in order, from one job; fields of schemas are few."""
    if not pairs:
        return []
    rows = [(str(i), "s", "t", [a.name, *a.aliases], [b.name, *b.aliases]) for i, (a, b) in enumerate(pairs)]
    df = SparkSession.active().createDataFrame(rows, "pair string, source_id string, target_id string, s_variants array<string>, t_variants array<string>")
    found = {int(r["pair"]): r["name_score"] for r in name_scores(df).select("pair", "name_score").collect()}
    return [found[i] for i in range(len(pairs))]


def lookup_key(source: Field, target: Field, schema: Schema, reviewed: bool = False) -> str | None:
    """The unique key by which a natural key finds the target's foreign row; unknown types only after review."""
    relation = schema.relation(target.id)
    if relation is None or source.sensitivity in NOT_TRANSFORMABLE or source.role != "natural_key" or target.role != "foreign_key":
        return None
    able = [Field(name, name, kind) for name, kind in relation.lookup_keys if (copy_safe(source.data_type, kind) if "unknown" not in (source.data_type, kind) else reviewed)]
    best = max(zip(likeness([(source, k) for k in able]), [k.name for k in able], strict=True), default=(0.0, ""))
    return best[1] if best[0] >= LOOKUP_NAME else None


def rule_for(source: Field, target: Field, schema: Schema, reviewed: bool = False) -> Rule:
    if source.sensitivity in NOT_TRANSFORMABLE:
        return Rule(source.id, target.id, "opaque_forward")
    key = lookup_key(source, target, schema, reviewed)
    if key is not None:
        return Rule(source.id, target.id, "lookup_foreign_key", (("lookup_key", key),))
    whole = source.data_type == target.data_type == "integer"
    return Rule(source.id, target.id, "parse_integer" if whole else "copy")


def build(source: Schema, target: Schema, decisions: list[tuple[str, str | None, str]], allow_review: bool = False, version: int = 1) -> Plan:
    """A plan from decisions (source id, target id, status): blocked ones are left out, those for review only when allowed."""
    rules = []
    for source_id, target_id, status in decisions:
        if target_id is None or status == "blocked" or (status == "review" and not allow_review):
            continue
        s, t = source.by_id()[source_id], target.by_id()[target_id]
        if status == "auto" and not contract_safe(s, t, target):
            raise PlanRefused(f"{source_id} to {target_id} has no contract that could be run unseen")
        rule = rule_for(s, t, target, reviewed=status == "review")
        if not route_allowed(s, t, rule.transform):
            raise PlanRefused(f"{source_id} to {target_id} breaks the route policy")
        rules.append(rule)
    return plan_for(source, target, tuple(rules), version)


def rules(decisions: DataFrame, source: DataFrame, target: DataFrame, allow_review: bool = False) -> DataFrame:
    """decisions (pair, source_id, target_id, status) of many schema pairs as rules: pair, source_id, target_id, transform.

    The field tables (pair, id, data_type, sensitivity) are joined on the pair and the field. For targets without relations: a foreign
    key needs `build`, which looks for a lookup. What the route policy forbids has `refused` set and no transform.
    """
    taken = decisions.filter(F.col("target_id").isNotNull() & F.col("status").isin("auto", *(["review"] if allow_review else [])))
    of = lambda df, side: df.select("pair", F.col("id").alias(f"{side}_id"), F.col("data_type").alias(f"__{side}_type"), F.col("sensitivity").alias(f"__{side}_level"))
    rows = taken.join(of(source, "source"), ["pair", "source_id"]).join(of(target, "target"), ["pair", "target_id"])
    whole = (F.col("__source_type") == "integer") & (F.col("__target_type") == "integer")
    transform = F.when(F.col("__source_level").isin(*NOT_TRANSFORMABLE), "opaque_forward").when(whole, "parse_integer").otherwise("copy")
    allowed = route_allowed_column(F.col("__source_level"), F.col("__target_level"), transform)
    return rows.select("pair", "source_id", "target_id", F.when(allowed, transform).alias("transform"), (~allowed).alias("refused"))


def contract_safe(s: Field, t: Field, schema: Schema) -> bool:
    if s.sensitivity != t.sensitivity or (s.nullable and not t.nullable):
        return False
    roles = s.role == t.role or ("value" in (s.role, t.role) and "credential" not in (s.role, t.role))
    return lookup_key(s, t, schema) is not None or (copy_safe(s.data_type, t.data_type) and roles)


def repair(plan: Plan, old: Schema, new: Schema, target: Schema) -> tuple[Plan | None, list[Finding]]:
    """The plan for a source that has drifted, and what changed: a field with the same id and much the same name stays, else
    the one field that is clearly like it takes its place; none: blocking."""
    findings, rules, blocked = [], [], False
    for rule in plan.rules:
        was = old.by_id()[rule.source]
        now = new.by_id().get(was.id)
        if now is None or now.sensitivity != was.sensitivity or (now.name != was.name and likeness([(was, now)])[0] < STABLE_NAME):
            able = [f for f in new.fields if f.sensitivity == was.sensitivity]
            rated = sorted(zip(likeness([(was, f) for f in able]), [f.id for f in able], strict=True), reverse=True)
            clear = rated and rated[0][0] >= STABLE_NAME and (len(rated) == 1 or rated[0][0] - rated[1][0] >= 0.08)
            now = new.by_id()[rated[0][1]] if clear else None
            if now is None:
                findings.append(Finding("field_unresolved", was.id, "blocking"))
                blocked = True
                continue
            findings.append(Finding("field_moved", was.id, "safe" if now.data_type == was.data_type else "review"))
        elif now.data_type != was.data_type:
            findings.append(Finding("field_type_changed", was.id, "review"))
        rules.append(replace(rule, source=now.id))
    return (None if blocked else plan_for(new, target, tuple(rules), plan.version + 1)), findings


RECIPES = "id string, version int, source_structure string, target_structure string, plan string, plan_digest string, approved_by string"


def recipe(spark: SparkSession, name: str, plan: Plan, source: Schema, target: Schema, approved_by: str) -> DataFrame:
    """One row of the table of recipes."""
    return spark.createDataFrame([(name, plan.version, source.structural(), target.structural(), json.dumps(asdict(plan)), plan.digest(), approved_by)], RECIPES)


def rebind(recipes: DataFrame, source: Schema, target: Schema) -> Plan | None:
    """The latest recipe for two structures, bound to these schemas; None when there is none or its digest does not fit."""
    found = recipes.filter((F.col("source_structure") == source.structural()) & (F.col("target_structure") == target.structural()))
    row = found.orderBy(F.desc("version"), F.desc("id")).first()
    if row is None:
        return None
    stored = json.loads(row["plan"])
    rules = tuple(Rule(r["source"], r["target"], r["transform"], tuple(map(tuple, r["parameters"]))) for r in stored["rules"])
    plan = Plan(stored["source_schema"], stored["target_schema"], stored["source_fingerprint"], stored["target_fingerprint"], rules, stored["version"])
    return plan_for(source, target, rules, plan.version) if plan.digest() == row["plan_digest"] else None
