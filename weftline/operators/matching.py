"""Schema matching: names, types and roles of source and target fields scored pairwise, decided by thresholds and margins.

Field tables are small (one row for each column of a schema), but many schemas may be matched at once: every join is on
the schema pair, so the pairs of one pair of schemas never meet those of another.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.types import NOT_TRANSFORMABLE, copy_safe_column, rank

#: Groups of words that mean the same in field names.
SYNONYMS = (
    ("customer", "client", "kunde", "debitor"),
    ("number", "num", "nr", "no", "nummer"),
    ("id", "identifier", "kennung", "key"),
    ("email", "mail", "emailaddress", "mailaddress"),
    ("date", "datum"),
    ("time", "zeit"),
    ("amount", "betrag", "sum", "total", "value", "wert"),
    ("price", "preis"),
    ("net", "netto"),
    ("gross", "brutto"),
    ("password", "passwort", "kennwort", "secret"),
    ("token", "credential", "credentials", "zugang", "access"),
    ("order", "auftrag", "bestellung"),
    ("invoice", "rechnung"),
    ("product", "produkt", "article", "artikel"),
    ("quantity", "qty", "menge", "anzahl"),
    ("name", "bezeichnung", "title", "titel"),
)
CANONICAL = {word: f"g{i}" for i, group in enumerate(SYNONYMS) for word in group}
#: Weights and thresholds of scores and decisions.
NAME, TYPE, ROLE, ROLE_MISMATCH = 0.68, 0.22, 0.10, 0.55
JACCARD, SEQUENCE, ALIAS = 0.62, 0.38, 0.98
LOOKUP_LIFT, LOOKUP_BONUS, LOOKUP_NAME = 0.85, 0.12, 0.42
SEMANTIC, RERANK = 0.24, 0.18
AUTO, MARGIN, DET_AUTO, DET_MARGIN, REVIEW = 0.86, 0.08, 0.90, 0.08, 0.55


def plain_name(name: str) -> str:
    """Words of a field name: humps opened, folded, marks dropped, all else blanks."""
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    folded = unicodedata.normalize("NFKD", name.casefold())
    letters = (c if c.isalnum() else " " for c in folded if not unicodedata.combining(c))
    return " ".join("".join(letters).split())


@F.pandas_udf(T.StringType())
def _plain(names: pd.Series) -> pd.Series:
    return names.map(plain_name, na_action="ignore")


def normalize_name(name: Column) -> Column:
    """plain_name as a column, for tables of fields, which are small: its rows pass through Python where a plan holds it."""
    opened = F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", " "))
    simple = F.trim(F.regexp_replace(opened, r"[^a-z0-9]+", " "))
    odd = name.rlike(r"[^\x00-\x7f]")
    # All rows pass through Python, which only works on those that are not null.
    return F.when(odd, _plain(F.when(odd, name))).otherwise(simple)


def tokens(normalized: Column) -> Column:
    """Words of a normalised name, synonyms by their group."""
    table = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    words = F.filter(F.split(normalized, " "), lambda w: w != "")
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams."""
    last = F.greatest(F.length(text) - n + 1, F.lit(0))
    return F.array_distinct(F.transform(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(n))))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which is not an edit distance; the pairs of names are few."""
    return pd.Series([SequenceMatcher(a=x, b=y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def type_compatibility(s: Column, t: Column) -> Column:
    both = lambda *names: s.isin(*names) & t.isin(*names)
    return (
        F.when((s == "unknown") | (t == "unknown"), 0.55)
        .when(s == t, 1.0)
        .when(both("integer", "decimal"), 0.85)
        .when(both("date", "datetime"), 0.75)
        .when(s == "string", 0.45)
        .otherwise(0.0)
    )


def role_compatible(s: Column, t: Column) -> Column:
    return (s == t) | (((s == "value") | (t == "value")) & (s != "credential") & (t != "credential"))


def _by_names(pairs: DataFrame) -> DataFrame:
    """pairs with __row, the names of both fields, which are all that a name score knows: each two lists of variants are compared
    once, however many pairs have them."""
    return pairs.withColumn("__row", F.struct("s_variants", "t_variants"))


def _variants(pairs: DataFrame) -> DataFrame:
    """__row (the names), ns, nt, overlap, same, exact for each two variants of each two lists of names: normalised, the share of
    words, whether they are equal, and whether the lists' first ones are."""
    rows = pairs.select("__row").distinct()
    each = rows.select("__row", F.explode("__row.s_variants").alias("s")).select("__row", "s", F.explode("__row.t_variants").alias("t"))
    first = normalize_name(F.element_at("__row.s_variants", 1)), normalize_name(F.element_at("__row.t_variants", 1))
    exact = (first[0] == first[1]) & (first[0] != "")
    each = each.select("__row", normalize_name(F.col("s")).alias("ns"), normalize_name(F.col("t")).alias("nt"), exact.alias("exact"))
    words = F.array_distinct(tokens(F.col("ns"))), F.array_distinct(tokens(F.col("nt")))
    return each.withColumn("overlap", jaccard(*words)).withColumn("same", (F.col("ns") == F.col("nt")) & (F.col("ns") != ""))


def _scored(pairs: DataFrame, best: DataFrame, *scores: tuple[str, str]) -> DataFrame:
    """pairs joined to best (__row, alias, exact and a best score) with each score: exact 1, alias .98, else the best of all variants."""
    out = pairs.join(best, "__row")
    for found, name in scores:
        out = out.withColumn(name, F.when(F.col("exact"), 1.0).when(F.col("alias"), ALIAS).otherwise(F.col(found)))
    return out.drop("alias", "exact", *[found for found, _ in scores])


def name_scores(pairs: DataFrame, with_sequence: bool = True) -> DataFrame:
    """pairs (s_variants, t_variants: arrays, the name first) with name_score: exact 1, alias .98, else the best of all variants."""
    ids = _by_names(pairs)
    sequence = sequence_ratio("ns", "nt") if with_sequence else F.lit(0.0)
    each = _variants(ids).withColumn("score", JACCARD * F.col("overlap") + SEQUENCE * sequence)
    best = each.groupBy("__row").agg(F.max("score").alias("best"), F.bool_or("same").alias("alias"), F.bool_or("exact").alias("exact"))
    return _scored(ids, best, ("best", "name_score")).drop("__row")


def common_letters(a: Column, b: Column) -> Column:
    """How many letters two texts share, each as often as both hold it: no common subsequence is longer."""
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    letters = F.filter(F.array_distinct(F.split(a, "")), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))


def name_bounds(pairs: DataFrame) -> DataFrame:
    """pairs with name_low and name_high, between which name_score lies: the sequence's share is nothing at least, and at most
    what the letters in common allow. No Python takes part."""
    ids = _by_names(pairs)
    most = F.coalesce(F.try_divide(2.0 * common_letters(F.col("ns"), F.col("nt")), F.length("ns") + F.length("nt")), F.lit(0.0))
    each = _variants(ids).withColumn("low", JACCARD * F.col("overlap")).withColumn("high", F.col("low") + SEQUENCE * most)
    best = each.groupBy("__row").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.bool_or("same").alias("alias"), F.bool_or("exact").alias("exact"))
    return _scored(ids, best, ("low", "name_low"), ("high", "name_high")).drop("__row")


def _pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Each source field with each target field of its schema pair."""
    names = ["id", "name", "aliases", "data_type", "nullable", "sensitivity", "role", "position"]
    left = source.select("pair", *[F.col(c).alias(f"s_{c}") for c in names]).withColumnRenamed("s_id", "source_id")
    keys = F.col("lookup_keys") if "lookup_keys" in target.columns else F.expr("cast(array() as array<struct<name:string,data_type:string>>)")
    right = target.select("pair", *[F.col(c).alias(f"t_{c}") for c in names], keys.alias("lookup_keys")).withColumnRenamed("t_id", "target_id")
    variants = lambda side: F.concat(F.array(f"{side}_name"), F.coalesce(f"{side}_aliases", F.expr("cast(array() as array<string>)")))
    return left.join(right, "pair").withColumn("s_variants", variants("s")).withColumn("t_variants", variants("t"))


def _det(name: Column) -> Column:
    """The deterministic score by a name score, in which it grows."""
    type_score = type_compatibility(F.col("s_data_type"), F.col("t_data_type"))
    role_score = F.when(F.col("s_role") == F.col("t_role"), 1.0).otherwise(ROLE_MISMATCH)
    lifted = lambda c: F.when(F.col("lookup"), F.greatest(c, F.lit(LOOKUP_LIFT))).otherwise(c)
    det = NAME * name + TYPE * lifted(type_score) + ROLE * lifted(role_score) + F.when(F.col("lookup"), LOOKUP_BONUS).otherwise(0.0)
    allowed = rank(F.col("t_sensitivity")) >= rank(F.col("s_sensitivity"))
    return F.when(allowed, F.least(F.lit(1.0), det)).otherwise(0.0)


def _mixed(det: str, semantic: DataFrame | None) -> Column:
    """The score by a deterministic one, in which it grows."""
    if semantic is None:
        return F.col(det)
    mixed = (1 - SEMANTIC) * F.col(det) + SEMANTIC * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("semantic")))
    return F.coalesce(mixed, F.col(det))


def _with_evidence(pairs: DataFrame, with_sequence: bool, semantic: DataFrame | None) -> DataFrame:
    out = pairs.join(lookup_paths(pairs, with_sequence), ["pair", "source_id", "target_id"], "left").withColumn("lookup", F.coalesce("lookup", F.lit(False)))
    return out if semantic is None else out.join(semantic, ["pair", "source_id", "target_id"], "left")


def candidates(source: DataFrame, target: DataFrame, with_sequence: bool = True, semantic: DataFrame | None = None) -> DataFrame:
    """All pairs of a schema pair's fields with det (deterministic) and score.

    source, target: pair, id, name, aliases, data_type, nullable, sensitivity, role, position; target may have lookup_keys
    (array<struct<name,data_type>>). semantic: optional (pair, source_id, target_id, semantic in 0..1).
    """
    scored = _with_evidence(name_scores(_pairs(source, target), with_sequence), with_sequence, semantic)
    return scored.withColumn("det", _det(F.col("name_score"))).withColumn("score", _mixed("det", semantic))


def contenders(source: DataFrame, target: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """The pairs of candidates() that can be the first or second of their source by score or by det, with the bounds det_low,
    det_high, score_low and score_high. What is left out lies below two others whatever the letters' order adds, so no decision
    depends on it; ties stay."""
    pairs = _with_evidence(name_bounds(_pairs(source, target)), True, semantic)
    for end in ("low", "high"):
        pairs = pairs.withColumn(f"det_{end}", _det(F.col(f"name_{end}"))).withColumn(f"score_{end}", _mixed(f"det_{end}", semantic))
    of = W.partitionBy("pair", "source_id")
    for kind in ("det", "score"):
        by = of.orderBy(F.desc(f"{kind}_low"), "t_position", "target_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        pairs = pairs.withColumn(f"__{kind}", F.coalesce(F.nth_value(f"{kind}_low", 2).over(by), F.lit(-1.0)))
    # Sums of doubles are rounded; a pair that misses by less than this is kept.
    reach = lambda kind: F.col(f"{kind}_high") + 1e-9 >= F.col(f"__{kind}")
    return pairs.filter(reach("det") | reach("score")).drop("__det", "__score")


def leading(source: DataFrame, target: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """candidates() of the contenders alone: equal decisions, with the letters' order compared for few pairs. Each two different
    names are compared once, however many schema pairs hold them, and only variants that can be a pair's best."""
    kept = _by_names(contenders(source, target, semantic))
    each = _variants(kept).join(kept.groupBy("__row").agg(F.min("name_low").alias("__least")), "__row")
    most = F.coalesce(F.try_divide(2.0 * common_letters(F.col("ns"), F.col("nt")), F.length("ns") + F.length("nt")), F.lit(0.0))
    each = each.withColumn("__open", ~F.col("same") & (JACCARD * F.col("overlap") + SEQUENCE * most + 1e-9 >= F.col("__least")))
    names = each.filter("__open").select("ns", "nt").distinct().withColumn("ratio", sequence_ratio("ns", "nt"))
    found = each.join(names, ["ns", "nt"], "left").withColumn("value", JACCARD * F.col("overlap") + SEQUENCE * F.coalesce("ratio", F.lit(0.0)))
    best = found.groupBy("__row").agg(F.max("value").alias("best"), F.bool_or("same").alias("alias"), F.bool_or("exact").alias("exact"))
    scored = _scored(kept, best, ("best", "name_score")).drop("__row", "name_low", "name_high", "det_low", "det_high", "score_low", "score_high")
    return scored.withColumn("det", _det(F.col("name_score"))).withColumn("score", _mixed("det", semantic))


def lookup_paths(pairs: DataFrame, with_sequence: bool = True) -> DataFrame:
    """pair, source_id, target_id, lookup (true): a natural key of the source that reaches the target's foreign key by a
    unique key of a fitting type, whose name is like the source's by the same score as fields' names."""
    able = pairs.filter(~F.col("s_sensitivity").isin(*NOT_TRANSFORMABLE) & (F.col("s_role") == "natural_key") & (F.col("t_role") == "foreign_key"))
    fitting = F.filter("lookup_keys", lambda k: copy_safe_column(F.col("s_data_type"), k["data_type"]))
    keys = able.select("pair", "source_id", F.col("target_id").alias("of"), "s_variants", F.explode(fitting).alias("k"))
    keys = keys.select("pair", "source_id", "of", "s_variants", F.array("k.name").alias("t_variants"), F.concat_ws("\0", "of", "k.name").alias("target_id"))
    if with_sequence:
        keys = name_bounds(keys).filter(F.col("name_high") + 1e-9 >= LOOKUP_NAME).select(keys.columns)
    near = name_scores(keys, with_sequence).filter(F.col("name_score") >= LOOKUP_NAME)
    return near.select("pair", "source_id", F.col("of").alias("target_id"), F.lit(True).alias("lookup")).distinct()


def _winners(scored: DataFrame) -> DataFrame:
    """pair, source_id, target_id, status, score, margin of each source for itself."""
    of = W.partitionBy("pair", "source_id")
    by_score, by_det = of.orderBy(F.desc("score"), "t_position"), of.orderBy(F.desc("det"), F.desc("score"), "t_position")
    contract = (F.col("s_sensitivity") == F.col("t_sensitivity")) & (~F.col("s_nullable") | F.col("t_nullable"))
    route = F.col("lookup") | (copy_safe_column(F.col("s_data_type"), F.col("t_data_type")) & role_compatible(F.col("s_role"), F.col("t_role")))
    ranked = (
        scored.withColumn("place", F.row_number().over(by_score))
        .withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(by_score), F.lit(0.0)))
        .withColumn("det_place", F.row_number().over(by_det))
        .withColumn("det_margin", F.col("det") - F.coalesce(F.lead("det").over(by_det), F.lit(0.0)))
        .withColumn("det_top", F.max("det").over(of))
        .withColumn("safe", contract & route)
    )
    top = ranked.filter("place = 1")
    sound = (F.col("det_place") == 1) & (F.col("det") >= DET_AUTO) & (F.col("det_margin") >= DET_MARGIN) & F.col("safe")
    status = F.when((F.col("score") >= AUTO) & (F.col("margin") >= MARGIN) & sound, "auto").when((F.col("score") >= REVIEW) | (F.col("det_top") >= REVIEW), "review").otherwise("blocked")
    decided = top.withColumn("status", status).withColumn("target_id", F.when(F.col("status") != "blocked", F.col("target_id")))
    return decided.select("pair", "source_id", "target_id", "status", "score", "margin")


def _conflicts(decided: DataFrame) -> DataFrame:
    """Sources that claim one target, automatic or for review, all go to review."""
    claims = F.count("target_id").over(W.partitionBy("pair", "target_id"))
    status = F.when(F.col("target_id").isNotNull() & (claims > 1), "review").otherwise(F.col("status"))
    return decided.withColumn("status", status).select("pair", "source_id", "target_id", "status", "score", "margin")


def decide(scored: DataFrame) -> DataFrame:
    """pair, source_id, target_id, status, score, margin: automatic only where the deterministic winner stands out too.

    Sources that claim one target, automatic or for review, all go to review.
    """
    return _conflicts(_winners(scored))


def propose(source: DataFrame, target: DataFrame, concepts: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """The decisions of all fields. What is not automatic and shares a glossary concept (concepts: term, concept) with exactly one
    other target goes to review with that target, a score of at least .55 and no margin; conflicts are judged after that."""
    decided = _winners(leading(source, target, semantic))
    if concepts is None:
        return _conflicts(decided)
    advised = glossary_matches(source, target, concepts).withColumnRenamed("target_id", "__advised")
    rows = decided.join(advised, ["pair", "source_id"], "left")
    takes = (F.col("status") != "auto") & F.col("__advised").isNotNull() & ~F.col("__advised").eqNullSafe(F.col("target_id"))
    rows = rows.withColumns(
        {
            "target_id": F.when(takes, F.col("__advised")).otherwise(F.col("target_id")),
            "status": F.when(takes, "review").otherwise(F.col("status")),
            "score": F.when(takes, F.greatest(F.col("score"), F.lit(REVIEW))).otherwise(F.col("score")),
            "margin": F.when(takes, 0.0).otherwise(F.col("margin")),
        }
    )
    return _conflicts(rows)


def glossary_matches(source: DataFrame, target: DataFrame, concepts: DataFrame) -> DataFrame:
    """pair, source_id, target_id where a source field shares a concept (term, concept) with exactly one target field.

    Fields never meet in pairs: of each concept of a schema pair only the smallest and greatest target are kept, which are one
    exactly where there is one target; so it is with the smallest and greatest of all concepts of a source.
    """
    term = concepts.select(normalize_name(F.col("term")).alias("term"), "concept").distinct()
    of = lambda df, out: df.select("pair", F.col("id").alias(out), normalize_name(F.col("name")).alias("term")).join(term, "term").select("pair", out, "concept")
    ends = lambda low, high: (F.min(low).alias("low"), F.max(high).alias("high"))
    aims = of(target, "target_id").groupBy("pair", "concept").agg(*ends("target_id", "target_id"))
    found = of(source, "source_id").join(aims, ["pair", "concept"]).groupBy("pair", "source_id").agg(*ends("low", "high"))
    return found.filter("low = high").select("pair", "source_id", F.col("low").alias("target_id"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change (kept, retyped, removed, added) between two versions of a field table (id, data_type); a null type is a type."""
    sides = (df.select("id", F.col("data_type").alias(out), F.lit(True).alias(f"has_{out}")) for df, out in ((old, "was"), (new, "now")))
    joined = next(sides).join(next(sides), "id", "full")
    change = F.when(F.col("has_was").isNull(), "added").when(F.col("has_now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "retyped").otherwise("kept")
    return joined.select("id", change.alias("change"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def lexical_features(a: Column, b: Column) -> Column:
    """Features of a pair of normalised names: exact, overlap, length, character pairs and triples."""
    words = tokens(a), tokens(b)
    long = F.greatest(F.length(a), F.length(b))
    return F.struct(
        (a == b).cast("double").alias("exact"),
        (1 - F.try_divide(F.levenshtein(a, b), long)).alias("edit"),
        jaccard(*words).alias("overlap"),
        F.try_divide(F.least(F.length(a), F.length(b)), long).alias("length"),
        jaccard(grams(a, 2), grams(b, 2)).alias("char2"),
        jaccard(grams(a, 3), grams(b, 3)).alias("char3"),
    )


def sigmoid(x: Column, clip: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(clip), F.greatest(F.lit(-clip), x))))


def unit(vectors: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 0)
