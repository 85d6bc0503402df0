"""Secret scans by a trigram inverted index (DataFrame operations only).

1. From each rule's regular expression a Boolean query over trigrams is derived: the parsed expression is walked, and what
   strings its parts must hold gives an OR of ANDs of trigrams without which there is no match. All is in lower case.
2. The index holds, for each trigram of the queries and each block of 32,768 documents, a posting list as a bitmap.
3. A rule's candidates come from the postings alone: the bitmaps of an AND are intersected, those of an OR united, block
   by block. Only candidates are verified with the expression; rules without a mandatory trigram scan every text.

Documents are numbered where they are first read, and written with their numbers once; postings and candidates are joined
by these numbers. Few candidates, as counted, are broadcast; else both sides are dealt out by number, of which each
document has its own. No posting list is gathered: a block of one trigram has 4 KB.

Defined cases: null texts are empty; texts of any length are searched whole, in linear time; matches of one rule never
overlap, those of different rules may, and spans that start together are told apart by the rules' order; positions are
code points, end exclusive; rows that repeat a doc_id (or have none) are documents of their own; further columns are not
read, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, marked_spans, no_spans, small, text_of


@dataclass(frozen=True)
class Rule:
    """kind and Java expression, of the part of the syntax that Python's parser reads too.

    value: an expression for a whole match whose first group must have `least` characters; matches that fail are dropped.
    """

    kind: str
    pattern: str
    value: str = ""
    least: int = 0


#: The base rules of the contract. Runs that are too short can't hold a longer run, so access and hex have
#: their length in the expression; assign has not, as a match that is dropped still uses up its characters.
BASE = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
        r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""",
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}+"),
    Rule("hex", r"[0-9a-f]{24,}+"),
)
#: Rules that the method adds, by publicly documented token formats.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}+"),
)


#: A query: an OR (set) of ANDs (sets) of trigrams. ANYTHING holds for all texts.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])
#: Strings that are followed together through an expression, members of a class that count as strings, ANDs of a query.
MOST_STRINGS, MOST_MEMBERS, MOST_ANDS = 64, 8, 256


def trigrams(literal: str) -> frozenset[str]:
    return frozenset(literal[i : i + 3] for i in range(len(literal) - 2))


def either(a: Query, b: Query) -> Query:
    """The OR, without ANDs that a weaker one covers."""
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def both_of(a: Query, b: Query) -> Query:
    """The AND; where it would be too long, the longer side is left out, which only weakens it."""
    if len(a) * len(b) > MOST_ANDS:
        return min(a, b, key=len)
    return either(frozenset(x | y for x in a for y in b), frozenset())


def one_of(strings: frozenset[str]) -> Query:
    return either(frozenset(trigrams(s) for s in strings), frozenset())


def _part(code, value) -> tuple[frozenset[str] | None, Query]:
    """What a part of an expression matches: the strings, if they are few, else None and the query that each match fulfils."""
    if code is op.LITERAL:
        return frozenset([chr(value).lower()]), ANYTHING
    if code is op.IN:
        members: set[str] = set()
        for kind, x in value:
            if kind is op.LITERAL:
                members.add(chr(x).lower())
            elif kind is op.RANGE and x[1] - x[0] < MOST_MEMBERS:
                members.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None, ANYTHING
        return (frozenset(members), ANYTHING) if len(members) <= MOST_MEMBERS else (None, ANYTHING)
    if code is op.SUBPATTERN:
        return _walk(value[3])
    if code is op.ATOMIC_GROUP:
        return _walk(value)
    if code is op.BRANCH:
        parts = [_walk(x) for x in value[1]]
        strings = frozenset().union(*(p[0] or () for p in parts))
        if all(p[0] is not None for p in parts) and len(strings) <= MOST_STRINGS:
            return strings, ANYTHING
        query: Query = frozenset()
        for known, needs in parts:
            query = either(query, needs if known is None else one_of(known))
        return None, query
    if code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        known, needs = _walk(inner)
        if known is not None and most == 1:
            return known | ({""} if least == 0 else set()), ANYTHING
        return None, ANYTHING if least == 0 else needs if known is None else one_of(known)
    if code in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return frozenset([""]), ANYTHING
    return None, ANYTHING


def _walk(parts) -> tuple[frozenset[str] | None, Query]:
    """The same for a sequence: strings are joined as long as they are few, then put into the query."""
    strings, query, whole = frozenset([""]), ANYTHING, True
    for code, value in parts:
        known, needs = _part(code, value)
        if known is not None and len(strings) * len(known) <= MOST_STRINGS:
            strings = frozenset(a + b for a in strings for b in known)
            continue
        query, whole = both_of(query, one_of(strings)), False
        strings = known if known is not None else frozenset([""])
        query = both_of(query, needs)
    return (strings, ANYTHING) if whole else (None, both_of(query, one_of(strings)))


def query_of(rule: Rule) -> Query:
    """The rule's trigram query; ANYTHING: it has no mandatory trigram."""
    known, needs = _walk(parser.parse(rule.pattern))
    return needs if known is None else one_of(known)


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for rule in rules for conjunct in query_of(rule) for t in conjunct})


def postings(numbered: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The inverted index of numbered (number, text): trigram, block of numbers, bitmap."""
    words = vocabulary(rules)
    # A projection of its own: the folded text is made once for all trigrams.
    folded = numbered.select("number", F.lower("text").alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in words])) if words else F.expr("cast(array() as array<string>)")
    hits = folded.select("number", F.explode(held).alias("trigram"))
    return hits.groupBy("trigram", F.bitmap_bucket_number("number").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))


def numbers(bitmap: Column, block: Column) -> Column:
    """The numbers (from 1) whose bits are set. Bytes without bits are passed over."""
    octets = F.filter(F.sequence(F.lit(1), F.length(bitmap)), lambda i: F.substring(bitmap, i, F.lit(1)) != F.lit(b"\0"))
    value = lambda i: F.conv(F.hex(F.substring(bitmap, i, F.lit(1))), 16, 10).cast("int")
    bits = lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(value(i), k) == 1), lambda k: (i - 1) * 8 + k)
    return F.transform(F.flatten(F.transform(octets, bits)), lambda bit: (block - 1) * 32768 + bit + 1)


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """number and tries (array of the rules' places): the documents that the postings leave for each rule that has a query."""
    wanted = [(place, number, t, len(conjunct)) for place, rule in enumerate(rules) for number, conjunct in enumerate(sorted(map(sorted, query_of(rule)))) for t in conjunct]
    queries = index.sparkSession.createDataFrame(wanted, "rule int, conjunct int, trigram string, terms int")
    # The rules' own table: its size does not depend on the data.
    lists = index.join(F.broadcast(queries), "trigram")
    met = lists.groupBy("rule", "conjunct", "block").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms"))
    left = met.filter("n = terms").groupBy("rule", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return left.select("rule", F.explode(numbers(F.col("bitmap"), F.col("block"))).alias("number")).groupBy("number").agg(F.collect_set("rule").alias("tries"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, spans array<struct<start,rank,kind,end,hit>>, verified_rules (rules whose expression was run)."""
    scratch = Scratch(docs.sparkSession)
    # Written once, so that a document's number is the same wherever it is read.
    numbered = scratch.table(docs.select("doc_id", text_of(text).alias("text"), (F.monotonically_increasing_id() + 1).alias("number")))
    index = scratch.table(postings(numbered, rules))
    found = scratch.table(candidates(index, rules))
    rows = numbered.join(small(found), "number", "left")
    parts, tried = [], F.lit(0)
    for rank, rule in enumerate(rules):
        tries = F.lit(True) if query_of(rule) == ANYTHING else F.coalesce(F.array_contains("tries", rank), F.lit(False))
        hits = F.when(tries & F.col("text").rlike(rule.pattern), marked_spans(F.col("text"), rule.pattern)).otherwise(no_spans())
        parts.append(_named(_long_enough(hits, rule), rank, rule))
        tried = tried + tries.cast("int")
    return rows.select("doc_id", F.concat(*parts).alias("spans"), tried.alias("verified_rules"))


def _long_enough(found: Column, rule: Rule) -> Column:
    if not rule.least:
        return found
    return F.filter(found, lambda s: F.length(F.regexp_extract(s["hit"], rule.value, 1)) >= rule.least)


def _named(found: Column, rank: int, rule: Rule) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"].alias("end"), s["hit"].alias("hit")
        ),
    )
