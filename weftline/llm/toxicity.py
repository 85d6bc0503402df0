"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lowers letters, strips accents, maps homoglyphs and digit substitutions to the letters they stand for, and turns
everything else into single blanks. Lexicon entries are whole words or word beginnings, each with a weight; phrases of
the exception list take back the weight of what they cover. The weights' sum is set against the text's length and mapped
to a score by a logistic curve.

The lexicon is the fixed list below plus terms learned from labelled rows: word beginnings and words whose part in toxic
documents is beyond chance. Labels are learned from at most `most_rows` labelled rows, chosen by hash. Of near copies
among them (documents whose smallest hash over pairs of words is the same) one counts, as copies would make all their
words telling. A term's weight is its smoothed log odds. The curve is fitted on the same rows.

Defined cases: null and empty texts score like texts without any lexicon entry; without labels the fixed list is used with
its default weights; rows with null or repeated doc_ids are scored like others and a repeated label counts once (the larger
one); of terms that begin at one place the longest counts, and of labelled rows that tie in the hash of their id the smaller
id is learned from; texts of any length are matched whole; a column named score is replaced, all others are handed through,
whatever their names; an empty table gives an empty result, and without documents to learn from the fixed list stands.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, fresh, kept_by, let_go, ship, text_of

#: The starting lexicon, exception phrases in which its words are harmless, and characters that stand for others.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "sore loser bracket")
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ԁ": "d", "ո": "n", "ɡ": "g",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}

#: Bound on labelled rows to learn from; least toxic documents, log odds and evidence (likelihood ratio against chance) of
#: a learned term; beginnings' lengths.
MOST_ROWS = 60_000
LEAST_DOCS = 4
LEAST_ODDS = 2.5
LEAST_EVIDENCE = 16.0
BEGINNINGS = (3, 4, 5, 6, 7)
DEFAULT_WEIGHT = 4.0
#: Texts whose strings a worker holds at a time.
TEXTS = 256


class _Table(dict):
    """str.translate table that is filled as characters come up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = HOMOGLYPHS.get(c) or DIGITS.get(c)
        if out is None:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
            out = "".join(HOMOGLYPHS.get(x, x if x.isalpha() else " ") for x in plain) if not unicodedata.combining(c) else ""
        self[code] = out
        return out


_TABLE = _Table()


def fold(text: str) -> str:
    """Folded text with single blanks, one before and one after. Marks after a word ("really!") are blanks again, not letters."""
    words = []
    for word in text.split():
        core = word.strip("!|@$")
        # Digits are letters only inside words; numbers stay out.
        if core and not core.replace(".", "").replace(",", "").isdigit():
            words.append(core)
    return " " + " ".join(" ".join(words).translate(_TABLE).split()) + " "


@dataclass
class Lexicon:
    """Terms with weights (' word ' is a whole word, ' begin' a word's beginning), exceptions, and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: score = logistic(bias + slope * sum / (1 + share * sqrt(words)))
    bias: float = -3.0
    slope: float = 3.0
    share: float = 0.02

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(term, (len(term), weight, False))
        for phrase in self.exceptions:
            out.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, True))
        out.make_automaton()
        return out

    def measure(self, folded: str, automaton: ahocorasick.Automaton) -> float:
        """The weights' sum, the longest term at each place alone and none inside exceptions, normalised by length."""
        best: dict[int, tuple[int, float]] = {}
        free: list[tuple[int, int]] = []
        for end, (length, weight, harmless) in automaton.iter(folded):
            start = end - length + 1
            if harmless:
                free.append((start, end))
            elif start not in best or best[start][0] < length:
                best[start] = (length, weight)
        # In order of place: a term is inside an exception if one that begins before or with it reaches beyond it.
        free.sort()
        total, reach, i = 0.0, 0, 0
        for start in sorted(best):
            while i < len(free) and free[i][0] <= start:
                reach = max(reach, free[i][1])
                i += 1
            if reach <= start:
                total += best[start][1]
        return total / (1 + self.share * math.sqrt(folded.count(" ")))

    def score(self, measure: float) -> float:
        x = max(-50.0, min(50.0, self.bias + self.slope * measure))
        return 1 / (1 + math.exp(-x))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def family(folded: str) -> int:
    """The smallest hash over a folded text's pairs of words: near copies mostly share it."""
    words = folded.split()
    pairs = zip(words, words[1:], strict=False) if len(words) > 1 else [(folded, "")]
    return min(xxhash.xxh3_64_intdigest(f"{a} {b}") for a, b in pairs) - (1 << 63)


def _term_counts(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["term", "toxic", "n"])


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Lexicon:
    """A lexicon from labelled rows that are not held out: docs (doc_id, text), labels (doc_id, toxic)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # At most most_rows ids, so they may be broadcast at any size of the corpus.
    chosen_docs = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id").select("toxic", "text")

    def families(batches):
        from weftline.llm import toxicity

        # Makes room first.
        toxicity.kept_by("toxicity")
        for batch in batches:
            folded = [toxicity.fold(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folded, pa.string()), pa.array(map(toxicity.family, folded), pa.int64())], ["toxic", "text", "family"])

    every = scratch.table(chosen_docs.mapInArrow(families, "toxic int, text string, family long").withColumn("row", F.monotonically_increasing_id()))
    one = every.groupBy("family", "toxic").agg(F.min("row").alias("row"))
    sample = scratch.table(every.join(F.broadcast(one.select("row")), "row", "left_semi").select("toxic", "text"))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic_n, other_n = n.get(1, 0), n.get(0, 0)
    out = Lexicon({f" {w} ": DEFAULT_WEIGHT for w in LEXICON})
    if not toxic_n or not other_n:
        return out

    def terms(batches):
        from weftline.llm import toxicity

        # Counts of a few thousand documents at a time leave the worker, not each document's terms.
        counts: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(text.split())
                found = {f" {w} " for w in words}
                for k in toxicity.BEGINNINGS:
                    found.update(" " + w[:k] for w in words if len(w) >= k)
                counts.update((t, toxic) for t in found)
                if len(counts) > 300_000:
                    yield _term_counts(counts)
                    counts.clear()
        yield _term_counts(counts)

    counts = sample.mapInArrow(terms, "term string, toxic int, n long").groupBy("term")
    counts = counts.agg(F.sum(F.col("n") * F.col("toxic")).alias("bad"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (toxic_n + 1.0)) - F.log((F.col("good") + 0.5) / (other_n + 1.0))
    prior = toxic_n / (toxic_n + other_n)
    both = F.col("bad") + F.col("good")
    evidence = 2 * (F.col("bad") * F.log(F.col("bad") / (both * prior)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (both * (1 - prior)))).otherwise(0.0))
    chosen = counts.filter(F.col("bad") >= LEAST_DOCS).withColumn("odds", odds).filter((F.col("odds") > LEAST_ODDS) & (evidence > LEAST_EVIDENCE))
    # All terms that pass: they come from at most most_rows rows, so their number does not grow with the corpus.
    chosen = chosen.select("term", "odds").collect()
    weights: dict[str, float] = {}
    for r in sorted(chosen, key=lambda r: (len(r["term"]), r["term"])):
        weights[r["term"]] = float(r["odds"])
    for w in LEXICON:
        weights.setdefault(f" {w} ", DEFAULT_WEIGHT)
    out.weights = weights
    given = spark.sparkContext.broadcast(out)

    def measures(batches):
        automaton = given.value.automaton()
        for batch in batches:
            m = [given.value.measure(t, automaton) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m, pa.float64())], ["toxic", "measure"])

    rows = sample.mapInArrow(measures, "toxic int, measure double").toPandas()
    out.bias, out.slope = _logistic(rows["measure"].to_numpy(), rows["toxic"].to_numpy())
    scratch.drop(every, sample)
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope (at least 0) by Newton steps with a small ridge."""
    a = np.column_stack([np.ones_like(x), x])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + np.diag([1e-3, 1e-2])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([1e-3, 1e-2]) * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(0.0, w[1]))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """docs' columns with score (0 to 1)."""
    spark = docs.sparkSession
    ship(spark)
    given = spark.sparkContext.broadcast(lexicon)
    columns = [c for c in docs.columns if c != "score"]
    # A text that is handed on is scored where it stands: beside it there is no second copy for the worker to hold.
    own = dict(docs.dtypes).get(text) == "string" and text in columns and columns.count(text) == 1
    (at,) = fresh(docs, "__text")
    rows = docs.select(*columns) if own else docs.select(*columns, text_of(text).alias(at))
    place, kept = (columns.index(text), len(columns)) if own else (len(columns), len(columns))

    def work(batches):
        from weftline.llm import toxicity

        toxicity.kept_by("toxicity")
        lexicon = given.value
        automaton = lexicon.automaton()
        for batch in batches:
            s: list[float] = []
            # Strings of a few texts at a time.
            for begin in range(0, batch.num_rows, toxicity.TEXTS):
                s += [lexicon.score(lexicon.measure(toxicity.fold(t or ""), automaton)) for t in batch.column(place).slice(begin, toxicity.TEXTS).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(s, pa.float64())], [*columns, "score"])
        batch = None
        toxicity.let_go()

    schema = rows.drop(at).schema.add("score", "double")
    return rows.mapInArrow(work, schema)
