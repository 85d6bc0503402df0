"""A lexical ranker of fields by their declared texts, with weights by hashed features. It orders candidates and approves nothing."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.matching import grams, jaccard, sigmoid

#: Places of the features, and bounds of a text, its words and a field's candidates.
DIMENSIONS = 16384
MOST_TEXT, MOST_WORDS, MOST_CANDIDATES = 1024, 24, 128
#: Weights of the model that needs no training.
BASELINE = {"bias": -2.0, "exact": 2.0, "edit": 1.0, "overlap": 1.0, "char2": 0.5, "char3": 0.5}


def place(feature: str) -> int:
    return int.from_bytes(hashlib.blake2s(feature.encode(), digest_size=4).digest()) % DIMENSIONS


def model(named: dict[str, float]) -> np.ndarray:
    """Weights by place of named features; a word pair's name is pair:, the source's word, U+001F and the target's."""
    weights = np.zeros(DIMENSIONS)
    for name, weight in named.items():
        weights[place(name)] += weight
    return weights


def load(path: str, sha256: str) -> np.ndarray:
    """A model file of little-endian doubles, taken only with the pinned digest, in full and finite."""
    with open(path, "rb") as f:
        raw = f.read(8 * DIMENSIONS + 1)
    if hashlib.sha256(raw).hexdigest() != sha256 or len(raw) != 8 * DIMENSIONS:
        raise ValueError("the model is not the pinned one")
    weights = np.frombuffer(raw, "<f8")
    if not np.isfinite(weights).all():
        raise ValueError("a weight is not finite")
    return weights


@F.pandas_udf(T.StringType())
def plain(texts: pd.Series) -> pd.Series:
    """Words in compatibility form and folded case, one blank between; humps open words. Descriptors are few and short."""
    opened = texts.str.replace(r"(?<=[a-z])(?=[A-Z])", " ", regex=True)
    return opened.map(lambda t: " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", t).casefold())), na_action="ignore")


def described(name: str, aliases: str, description: str) -> Column:
    """A field's text: its name, its aliases (array) and its description; longer ones than the bound fail the job."""
    text = F.concat_ws(" | ", F.col(name), F.col(aliases), F.coalesce(F.col(description), F.lit("")))
    return F.when(F.length(text) > MOST_TEXT, F.raise_error(F.lit("a descriptor exceeds its bound"))).otherwise(text)


def paired(weights: np.ndarray):
    """The part of the score that has no built-in function: edit similarity and hashed word pairs, in batches of pairs."""
    edit = float(weights[place("edit")])

    def score(a: str, b: str, left: list[str], right: list[str]) -> float:
        whole = edit * SequenceMatcher(None, a, b, autojunk=False).ratio() if edit else 0.0
        if not len(left) or not len(right):
            return whole
        crossed = sum(weights[place(f"pair:{x}\x1f{y}")] for x in left for y in right)
        return whole + crossed / math.sqrt(len(left) * len(right))

    @F.pandas_udf(T.DoubleType())
    def work(a: pd.Series, b: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([score(*x) for x in zip(a, b, left, right, strict=True)], dtype=float)

    return work


def scored(pairs: DataFrame, weights: np.ndarray) -> DataFrame:
    """pairs (source_text, target_text, ...) with rank_score in 0..1; a null text counts as empty."""
    weight = lambda name: F.lit(float(weights[place(name)]))
    rows = pairs.withColumn("__a", plain(F.coalesce("source_text", F.lit("")))).withColumn("__b", plain(F.coalesce("target_text", F.lit(""))))
    words = lambda c: F.slice(F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))), 1, MOST_WORDS)
    rows = rows.withColumn("__l", words("__a")).withColumn("__r", words("__b"))
    long = F.greatest(F.length("__a"), F.length("__b"), F.lit(1))
    parts = {
        "bias": F.lit(1.0),
        "exact": ((F.col("__a") == F.col("__b")) & (F.col("__a") != "")).cast("double"),
        "overlap": jaccard(F.col("__l"), F.col("__r")),
        "length": F.least(F.length("__a"), F.length("__b")) / long,
        "char2": jaccard(grams(F.col("__a"), 2), grams(F.col("__b"), 2)),
        "char3": jaccard(grams(F.col("__a"), 3), grams(F.col("__b"), 3)),
    }
    total = paired(weights)("__a", "__b", "__l", "__r")
    for name, value in parts.items():
        total = total + weight(name) * value
    return rows.withColumn("rank_score", sigmoid(total, 50.0)).select(*pairs.columns, "rank_score")


def ranked(pairs: DataFrame, weights: np.ndarray, most: int = MOST_CANDIDATES) -> DataFrame:
    """pairs (source_id, source_text, target_id, target_text) with rank_score, place (1 is best; ties by target_id) and authority.

    More candidates of a source than `most`, a null target or a repeated one fail the job; so a source's rows are few.
    """
    of = W.partitionBy("source_id")
    by_target = of.orderBy("target_id")
    rows = pairs.withColumn("__n", F.row_number().over(by_target)).withColumn("__before", F.lag("target_id").over(by_target))
    wrong = F.col("target_id").isNull() | F.coalesce(F.col("__before") == F.col("target_id"), F.lit(False)) | (F.col("__n") > most)
    checked = F.when(wrong, F.raise_error(F.lit("candidates must be distinct and within their bound"))).otherwise(F.col("target_id"))
    rows = scored(rows.withColumn("target_id", checked).select(*pairs.columns), weights)
    return rows.withColumn("place", F.row_number().over(of.orderBy(F.desc("rank_score"), "target_id"))).withColumn("authority", F.lit("advisory_only"))
