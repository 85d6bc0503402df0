"""Personal data by expressions, checksums and context words (DataFrame operations only).

Expressions propose spans; validators confirm them: Luhn for cards, mod-97 for IBANs, ranges for addresses and numbers;
context words before a span and a confirmed checksum raise its score, a contradicting word lowers it. The base kinds of
the contract are reported whatever their score; kinds that the method adds must reach `least_score`.

The expressions start at the beginning of a run of characters, or where the last match ended, so that a long run is
tried once and not from each of its characters. Repeated groups are possessive: the regular-expression engine runs those
in a loop, others by recursion, which a text of many thousand labels would take beyond the stack.

Defined cases: null texts are empty; texts of any length are matched whole, in linear time; matches of one kind never
overlap, those of different kinds may, and spans that start together are told apart by the kinds' order; positions are
code points, end exclusive; rows that repeat a doc_id (or have none) are rows of their own; further columns are not read,
whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import marked_spans, no_spans, text_of


@dataclass(frozen=True)
class Kind:
    """kind, Java expression, a literal without which no match exists (empty: none), context words, score before context."""

    kind: str
    pattern: str
    needs: str
    words: tuple[str, ...]
    score: float
    base: bool = True


def _run(characters: str) -> str:
    return rf"(?:\G|(?<![{characters}]))"


#: The base kinds of the contract, then those that the method adds.
KINDS = (
    Kind("email", _run("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", ("mail", "contact", "write"), 0.8),
    Kind("ip", _run("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", ("ip", "host", "server", "address"), 0.5),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", ("card", "visa", "credit", "payment"), 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", ("phone", "call", "tel", "mobile"), 0.6),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "", ("iban", "account", "bank"), 0.7, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", ("ssn", "social", "security"), 0.3, False),
)
#: Words that speak against personal data, and how far before a span words count.
AGAINST = ("version", "example", "order", "isbn")
WINDOW = 40
STEP = 0.2


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 on division by 97, its first four characters moved to the end."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    codes = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), value)
    return F.aggregate(codes, F.lit(0), lambda a, x: (a * F.when(x > 9, F.lit(100)).otherwise(F.lit(10)) + x) % 97) == 1


def valid(kind: Kind, hit: Column) -> Column:
    n = F.length(digits_of(hit))
    if kind.kind == "ip":
        # Parts may be of any length: leading zeros go, then three digits at most are compared.
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    if kind.kind == "card":
        return (n >= 14) & (n <= 19) & luhn(digits_of(hit))
    if kind.kind == "phone":
        return (n >= 10) & (n <= 15)
    if kind.kind == "iban":
        return mod97(F.regexp_replace(hit, " ", ""))
    if kind.kind == "ssn":
        return ~F.substring(hit, 1, 3).isin("000", "666") & (F.substring(hit, 1, 1) != "9") & (F.substring(hit, 5, 2) != "00") & (F.substring(hit, 8, 4) != "0000")
    return F.lit(True)


def score(kind: Kind, near: Column) -> Column:
    """The kind's score, changed by the words in the WINDOW characters before the span."""
    has = lambda words: F.lower(near).rlike(r"(?<![a-z])(?:" + "|".join(words) + ")")
    up = F.when(has(kind.words), F.lit(STEP)).otherwise(F.lit(0.0))
    down = F.when(has(AGAINST), F.lit(STEP)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(kind.score) + up - down))


def find(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, least_score: float = 0.5) -> DataFrame:
    """One row for each row of docs: doc_id, spans array<struct<start,rank,kind,end,score,base>>."""
    rows = docs.select("doc_id", text_of(text).alias("text"))
    parts = []
    for rank, kind in enumerate(kinds):
        proposes = F.col("text").contains(kind.needs) & F.col("text").rlike(kind.pattern) if kind.needs else F.col("text").rlike(kind.pattern)
        if kind.kind == "card":
            # A text without 14 digits in a run of digits and separators has no card.
            proposes = F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
        found = F.when(proposes, marked_spans(F.col("text"), kind.pattern, near=WINDOW)).otherwise(no_spans(WINDOW))
        scored = _confirmed(found, rank, kind)
        parts.append(scored if kind.base else F.filter(scored, lambda s: s["score"] >= least_score))
    return rows.select("doc_id", F.concat(*parts).alias("spans"))


def _confirmed(found: Column, rank: int, kind: Kind) -> Column:
    return F.transform(
        F.filter(found, lambda s: valid(kind, s["hit"])),
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind.kind).alias("kind"),
            s["end"].alias("end"),
            score(kind, s["near"]).alias("score"),
            F.lit(kind.base).alias("base"),
        ),
    )
