"""Periodic runs of words by harmonic grid probing.

A run of period p and at least four periods has three consecutive multiples of p among the places whose word equals the one p
further. So for each p only the grid 0, p, 2p, ... is probed: is the word at jp that at (j+1)p? All grids together have n/1 + n/2 +
n/3 + ... places, n log n in all. Where three probes in a row hold, the words from jp on are compared with those p further, in chunks,
to the left and to the right until one differs; grid places inside a found run of the period, or of a period that divides it, are
passed over, so that a long run is read once and not again for each multiple of its period.

Periods go upwards. A stretch of period p whose smallest period is q < p has q dividing p, and is then the very run that was found for
q; it is passed over too, so p is the smallest period of each run that is found.

The words of many short texts are laid in one array, longest text first, with a word of its own after each: no run crosses it, and
period p probes only the texts that are long enough. One array holds at most WORDS words, or one text. Rows are independent: no
shuffle, no state between arrays.

Defined cases: null and empty texts and texts of white space have no words and no runs, and collapse to the empty text; very long
texts take n log n; equal rows give equal results, each for itself; of runs of equal exponent the one with the smallest start, then
period, is `longest`; an empty table gives an empty result. Columns of docs with the names of the results are replaced, all others
handed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.llm.common import WORD, fresh, ship, text_of

#: A run has at least LEAST words and PERIODS times its period.
LEAST, PERIODS = 6, 4
#: Words of one array, and of one comparison.
WORDS = 1 << 18
CHUNK, FIRST_CHUNK = 1024, 16
RUN = "struct<start:long,length:long,period:long>"


def right_of(words: np.ndarray, at: int, p: int) -> int:
    """The first place from `at` on whose word is not the one p further."""
    end = len(words) - p
    while at < end:
        stop = min(at + CHUNK, end)
        differ = words[at:stop] != words[at + p : stop + p]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at = stop
    return at


def left_of(words: np.ndarray, at: int, p: int) -> int:
    """The first place of the stretch, going left from `at`, whose words are those p further."""
    while at > 0:
        stop = max(at - CHUNK, 0)
        differ = (words[stop:at] != words[stop + p : at + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at - k
        at = stop
    return at


class Found:
    """Runs by period; those of one period are in order and overlap by less than it."""

    def __init__(self) -> None:
        self.starts: dict[int, list[int]] = {}
        self.ends: dict[int, list[int]] = {}
        self.periods = np.zeros(0, np.int64)

    def add(self, start: int, end: int, p: int) -> None:
        if p not in self.starts:
            self.starts[p], self.ends[p] = [], []
            self.periods = np.append(self.periods, p)
        self.starts[p].append(start)
        self.ends[p].append(end)

    def outside(self, places: np.ndarray, p: int) -> np.ndarray:
        """Those of the places x for which no found run of a period that divides p holds all words from x to x + p."""
        for q in self.periods[p % self.periods == 0].tolist():
            last = np.searchsorted(self.starts[q], places, side="right") - 1
            inside = (last >= 0) & (places + p < np.array(self.ends[q])[last])
            places = places[~inside]
        return places


def find(words: np.ndarray, lengths: list[int]) -> Found:
    """The runs of an array of texts with these numbers of words, longest first, each followed by a word that occurs once."""
    found = Found()
    ends = np.cumsum(np.array(lengths, np.int64) + 1)
    ascending = np.array(lengths[::-1], np.int64)
    longest = lengths[0] if lengths else 0
    for p in range(1, longest // PERIODS + 1):
        least = max(LEAST, PERIODS * p)
        long_enough = len(lengths) - int(np.searchsorted(ascending, least))
        if not long_enough:
            break
        grid = words[0 : int(ends[long_enough - 1]) : p]
        same = grid[1:] == grid[:-1]
        places = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * p
        if not len(places):
            continue
        places = found.outside(places, p)
        done = 0
        near = np.arange(min(p, FIRST_CHUNK))
        for begin in range(0, len(places), 1 << 14):
            block = places[begin : begin + (1 << 14)]
            block = block[block >= done]
            index = block[:, None] + near
            for at in block[(words[index] == words[index + p]).all(axis=1)].tolist():
                if at < done:
                    continue
                start, done = left_of(words, at, p), right_of(words, at, p)
                if done + p - start >= least:
                    found.add(start, done + p, p)
    return found


def runs_of(texts: list[bytes]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs (start, length, period) by start and period, and its words without the repeats, joined by blanks."""
    split = [t.split() for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(split[i]))
    lengths = [len(split[i]) for i in order]
    numbers: dict[bytes, int] = {}
    words = np.empty(sum(lengths) + len(lengths), np.int32)
    begins, at = [], 0
    for k, i in enumerate(order):
        begins.append(at)
        words[at : at + lengths[k]] = [numbers.setdefault(w, len(numbers)) for w in split[i]]
        at += lengths[k] + 1
        words[at - 1] = -1 - k
    found = find(words, lengths)
    mine: dict[int, list[tuple[int, int, int]]] = {}
    for p, starts in found.starts.items():
        owners = np.searchsorted(begins, starts, side="right") - 1
        for k, start, end in zip(owners.tolist(), starts, found.ends[p], strict=True):
            mine.setdefault(order[k], []).append((start - begins[k], end - start, p))
    out = []
    for i, own in enumerate(split):
        runs = sorted(mine.get(i, ()), key=lambda r: (r[0], r[2]))
        if runs:
            edges = np.zeros(len(own) + 1, np.int64)
            np.add.at(edges, [s + p for s, _, p in runs], 1)
            np.add.at(edges, [s + n for s, n, _ in runs], -1)
            own = [own[j] for j in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]
        out.append((runs, b" ".join(own)))
    return out


def arrays(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Texts in groups of about WORDS words at most (a word and its blank have two bytes or more)."""
    group, held = [], 0
    for t in texts:
        size = len(t) // 2 + 1
        if group and held + size > WORDS:
            yield group
            group, held = [], 0
        group.append(t)
        held += size
    if group:
        yield group


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns and n_runs, longest (start, length, period of the run with most periods; null: none), runs, collapsed_text (the
    words outside all runs, and each run's first period)."""
    ship(docs.sparkSession)
    results = ("n_runs", "longest", "runs", "collapsed_text")
    (at,) = fresh(docs, "__text")
    kept = [c for c in docs.columns if c.lower() not in results]
    rows = docs.withColumn(at, text_of(text)).select(*kept, at)
    width = len(kept)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        from weftline.llm import periodic_runs

        for batch in batches:
            begin = 0
            for group in periodic_runs.arrays(t.as_py() for t in batch.column(width).cast(pa.binary())):
                part = batch.slice(begin, len(group))
                begin += len(group)
                each = periodic_runs.runs_of(group)
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs, _ in each]
                best = [periodic_runs.longest(runs) for runs, _ in each]
                columns = [
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([b and dict(zip(("start", "length", "period"), b, strict=True)) for b in best], run),
                    pa.array(rows, pa.list_(run)),
                    pa.array([c for _, c in each], pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *columns], [*kept, *results])

    made = StructType.fromDDL(f"n_runs long, longest {RUN}, runs array<{RUN}>, collapsed_text string")
    return rows.mapInArrow(work, StructType(rows.select(*kept).schema.fields + made.fields))


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods, compared as products of integers; of equal ones the first by start, then period (their order here)."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(id: Column, text: Column) -> Column:
    """The text (null as empty) with a periodic end, for one id in ten: from a word on, the words of one period repeat to the end."""
    h = F.crc32(id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise(text)

    # Bound as a variable, so that the words are taken once.
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


def runs_text(runs: Column) -> Column:
    """Each run's start,length,period and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
