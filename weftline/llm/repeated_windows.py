"""Suffix-array dedup: repeated byte windows by a depth-limited radix sort of suffixes.

Only the order of suffixes down to `depth` bytes matters: suffixes whose first `depth` bytes are equal are the repeated
windows. They are dealt by most-significant-digit passes: each pass splits the groups of the last one by a further digit
and drops groups of one, until the digits cover `depth` bytes. As in any such sort the groups themselves are never
needed in order, so a pass is a count by digit and a join with the counts; nothing is gathered. Digits are chosen so that
neighbouring suffixes share them and no pass handles each position of the corpus:

1. Texts that are equal as a whole are one text with its number of copies.
2. The first digit of a suffix is the smallest, by hash, of the GRAM-byte strings inside its window (the leftmost on
   ties), together with its place in the window. Equal windows have equal first digits, and on average some seventy
   neighbouring suffixes have the same one; such a run of suffixes is a row. Runs whose digit is nowhere else are
   dropped; runs that are equal as a whole hold repeated windows alone.
3. The other runs are dealt in passes of growing depth: 169, 193, at last all 200 bytes. A pass to depth d handles
   200 - d + 1 neighbouring suffixes as one row, whose digit is the d bytes that all their windows have in common. Rows
   whose digit is unique are dropped, rows whose group agrees in all its text are settled, the rest is split for the next
   pass.

Groups are counted with map-side aggregation and joined back, so a passage that a third of the documents share is never
gathered in one task. Texts and digits are compared by 128 bits of hash beside the first digit's 64.

Every byte that a repeated window covers is removed; windows are judged on the input, never cross documents, and also
repeat inside one document. Defined cases: null texts are empty; texts shorter than the depth keep all bytes; texts of any
length are read whole, in segments that overlap by a window; bytes are those of UTF-8, so a character may be cut; rows with
null or repeated doc_ids are documents of their own; equal rows lose the same bytes, so ties do not arise; only doc_id and
the text are read, so further columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, ship, small, text_of

DEPTH = 200
GRAM = 40
DEPTHS = (169, 193, 200)
#: Window starts that are worked on at once; places are held in 24 bits beside the hash.
SEGMENT = 1 << 19
#: Rows and bytes that leave a worker at once.
MOST_OUT, MOST_BYTES = 20_000, 8 << 20
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64(0xFFFFFF)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), np.uint64(base))
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    #: A random number for each byte value.
    BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def runs(raw: bytes, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one first digit: hash of the smallest gram, its place, first and last start."""
    grams, places, lows, highs = [], [], [], []
    for begin in range(0, len(raw) - depth + 1, SEGMENT):
        part = np.frombuffer(raw, np.uint8)[begin : begin + SEGMENT + depth - 1]
        n = len(part)
        power, inverse = _powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTES[part] * power[:n], out=sums[1:])
            h = _mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width, span = depth - gram + 1, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        place = (least & _PLACE).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        low = np.concatenate(([0], cut))
        grams.append(h[place[low]].view(np.int64))
        places.append(place[low] + begin)
        lows.append(low + begin)
        highs.append(np.concatenate((cut, [len(place)])) - 1 + begin)
    return tuple(np.concatenate(x) for x in (grams, places, lows, highs))


def _digits(digests: list[bytes]) -> np.ndarray:
    """128-bit digests as rows of two signed 64-bit integers."""
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


_digest = xxhash.xxh3_128_digest
_RUN = "k1 long, k2 long, copies int, g long, c1 long, c2 long, place int, low int, high int"


def run_rows(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """Runs of texts (k1, k2, copies, text): g (first digit), c1 and c2 (the run's whole text), place, low, high."""

    def work(batches):
        from weftline.llm import repeated_windows as m

        names = [c.split(" ")[0] for c in m._RUN.split(", ")]
        held: list[list] = [[] for _ in names]
        rows = 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.int32() if n in ("copies", "place", "low", "high") else pa.int64() for n in names]
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in held]
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k, safe=False) for x, k in zip(flat, kinds, strict=True)], names)

        for batch in batches:
            for at in range(batch.num_rows):
                k1, k2, copies, text = (batch.column(i)[at].as_py() for i in range(4))
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < depth:
                    continue
                g, p, low, high = m.runs(raw, depth, gram)
                c = m._digits([m._digest(raw[a : b + depth]) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                n = len(g)
                for x, values in zip(held, (np.full(n, k1), np.full(n, k2), np.full(n, copies), g, c[:, 0], c[:, 1], p - low, low, high), strict=True):
                    x.append(values)
                rows += n
                if rows >= m.MOST_OUT:
                    rows = 0
                    yield flush()
        yield flush()

    return texts.select("k1", "k2", "copies", "text").mapInArrow(work, _RUN)


def key_columns() -> list:
    """k1, k2: 128 bits of the text's digest, made without Python."""
    sha = F.sha2("text", 256)
    return [F.conv(F.substring(sha, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "k1"), (17, "k2"))]


def _sent(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def cut_contexts(found: DataFrame, depth: int) -> DataFrame:
    """The texts of runs: rows (k1, k2, text, wanted array<struct<g,c1,c2,place,low,high>>) to g, c1, c2, place, k1, k2, low, high, raw."""

    def work(batches):
        from weftline.llm import repeated_windows as m

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["g", "c1", "c2", "place", "k1", "k2", "low", "high", "raw"]
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for at in range(batch.num_rows):
                k1, k2, text, wanted = (batch.column(i)[at].as_py() for i in range(4))
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    piece = raw[w["low"] : w["high"] + depth]
                    out.append((w["g"], w["c1"], w["c2"], w["place"], k1, k2, w["low"], w["high"], piece))
                    size += len(piece)
                    if size >= m.MOST_BYTES or len(out) >= m.MOST_OUT:
                        yield m._sent(out, kinds, names)
                        out, size = [], 0
        yield m._sent(out, kinds, names)

    schema = "g long, c1 long, c2 long, place int, k1 long, k2 long, low int, high int, raw binary"
    return found.select("k1", "k2", "text", "wanted").mapInArrow(work, schema)


def blocks_of(contexts: DataFrame, depth: int, reach: int) -> DataFrame:
    """The pass to depth `reach`: contexts (g, c1, c2, place, raw, parts array<struct<s1,s2>>) to g, c1, c2, block, d1, d2, w1, w2, s1, s2.

    Starts are counted from the run's first. A block holds the depth - reach + 1 neighbouring suffixes whose windows have
    `reach` bytes in common (d1, d2); w1, w2 stand for all the text of those that the run has.
    """
    size = depth - reach + 1

    def work(batches):
        from weftline.llm import repeated_windows as m

        names = ["g", "c1", "c2", "block", "d1", "d2", "w1", "w2", "s1", "s2"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        rows: list[tuple] = []
        digits: list[bytes] = []

        def flush() -> pa.RecordBatch:
            d = m._digits(digits).reshape(-1, 4)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            g, c1, c2, block, s1, s2 = (np.array(x, np.int64) for x in columns)
            arrays = [g, c1, c2, block, d[:, 0], d[:, 1], d[:, 2], d[:, 3], s1, s2]
            rows.clear(), digits.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k, safe=False) for x, k in zip(arrays, kinds, strict=True)], names)

        for batch in batches:
            for at in range(batch.num_rows):
                g, c1, c2, place, raw, parts = (batch.column(i)[at].as_py() for i in range(6))
                for part in parts:
                    far, near = place - part["s1"], place - part["s2"]
                    for block in range(near // size, far // size + 1):
                        low, high = max(near, block * size), min(far, block * size + size - 1)
                        digit = m._digest(raw[place - block * size : place - block * size + reach])
                        digits += (digit, digit if size == 1 else m._digest(raw[place - high : place - low + depth]))
                        rows.append((g, c1, c2, block, place - high, place - low))
                if len(rows) >= m.MOST_OUT:
                    yield flush()
        yield flush()

    schema = "g long, c1 long, c2 long, block int, d1 long, d2 long, w1 long, w2 long, s1 int, s2 int"
    return contexts.select("g", "c1", "c2", "place", "raw", "parts").mapInArrow(work, schema)


def remove(found: DataFrame) -> DataFrame:
    """Rows (doc_id, text, spans array<struct<low,end>> or null) to doc_id, n_bytes, n_removed, spans, kept (binary), kept_sha256."""

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows: list[tuple] = []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    merged: list[list[int]] = []
                    for low, end in sorted((s["low"], s["end"]) for s in spans or ()):
                        if merged and low <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([low, end])
                    at, kept = 0, []
                    for low, end in merged:
                        kept.append(raw[at:low])
                        at = end
                    left = b"".join([*kept, raw[at:]])
                    rows.append((len(raw), len(raw) - len(left), [{"low": a, "end": b} for a, b in merged], left, hashlib.sha256(left).hexdigest()))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int32()), ("end", pa.int32())])), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    return found.select("doc_id", "text", "spans").mapInArrow(work, "doc_id long, n_bytes long, n_removed long, spans array<struct<low:int,end:int>>, kept binary, kept_sha256 string")


def differ(*names: str):
    """Whether a group's rows differ in one of the columns."""
    out = F.lit(False)
    for n in names:
        out = out | (F.min(n) != F.max(n))
    return out


def repeated_windows(docs: DataFrame, text: str = "text", depth: int = DEPTH, gram: int = GRAM, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept (bytes), kept_sha256."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    key = ["k1", "k2"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text")).select("doc_id", "text", *key_columns())

    # Texts with copies: one of each stands for all. Others stay where they are.
    copied = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    copied = small(scratch.table(copied.select(*key, F.lit(2).alias("copies"))))
    alone = rows.join(copied, key, "left_anti").select("text", *key, F.lit(1).alias("copies"))
    one_of = rows.join(copied, key).groupBy(*key).agg(F.first("text").alias("text")).select("text", *key, F.lit(2).alias("copies"))
    texts = alone.unionByName(one_of)

    # First digit: keep runs whose digit is elsewhere too; mixed: not all of the group's runs are equal as a whole.
    every = scratch.table(run_rows(texts, depth, gram))
    firsts = every.groupBy("g").agg(F.sum("copies").alias("n"), differ("c1", "c2").alias("mixed")).filter("n > 1").select("g", "mixed")
    # Counts are written before they are joined, so that the join deals both sides anew and a hot digit can be split.
    firsts = scratch.table(firsts)
    shared = scratch.table(every.join(firsts, "g"))
    scratch.drop(every, firsts)
    run = ["g", "c1", "c2"]
    times = scratch.table(shared.groupBy(*run).agg(F.sum("copies").alias("n")))
    counted = scratch.table(shared.join(times, run).filter("n > 1 or mixed"))
    scratch.drop(shared, times)
    whole = counted.filter("n > 1 and copies = 1").select(*key, "low", (F.col("high") + depth).alias("end"))

    # Runs of mixed groups, each text of a run once, with their bytes.
    once = counted.filter("mixed").dropDuplicates(run)
    wanted = scratch.table(once.groupBy(*key).agg(F.collect_list(F.struct(*run, "place", "low", "high")).alias("wanted")))
    contexts = scratch.table(cut_contexts(texts.join(wanted, key), depth))
    scratch.drop(wanted)
    parts = contexts.select("*", F.array(F.struct(F.lit(0).alias("s1"), (F.col("high") - F.col("low")).alias("s2"))).alias("parts"))
    settled = None
    for reach in depths:
        cut = scratch.table(blocks_of(parts, depth, reach))
        names = ["g", "block", "d1", "d2"]
        # A run that stands for copies alone is repeated, too, but its windows need not be found here: they are in `whole`.
        groups = scratch.table(cut.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), differ("w1", "w2").alias("mixed")).filter("n > 1"))
        judged = scratch.table(cut.join(groups.select(*names, "mixed"), names).select(*run, "s1", "s2", "mixed"))
        scratch.drop(cut, groups)
        done = judged.filter("not mixed").select(*run, "s1", "s2")
        settled = done if settled is None else settled.unionByName(done)
        open_ = judged.filter("mixed").groupBy(*run).agg(F.collect_list(F.struct("s1", "s2")).alias("parts"))
        parts = contexts.join(open_, run)
    # Of a run that several texts hold, all windows are removed anyway, in `whole`; so each run's context has one place.
    pieces = settled.join(contexts.select(*run, *key, "low"), run).select(*key, (F.col("low") + F.col("s1")).alias("low"), (F.col("low") + F.col("s2") + depth).alias("end"))
    spans = scratch.table(whole.unionByName(pieces).groupBy(*key).agg(F.collect_list(F.struct("low", "end")).alias("spans")))
    scratch.drop(contexts, counted)
    unique = rows.join(copied, key, "left_anti").join(spans, key, "left").select("doc_id", "text", "spans")
    size = F.octet_length("text").cast("int")
    all_of_it = F.when(size >= depth, F.array(F.struct(F.lit(0).alias("low"), size.alias("end"))))
    return remove(unique.unionByName(rows.join(copied, key, "left_semi").select("doc_id", "text", all_of_it.alias("spans"))))
