"""Near-duplicate documents by HyperMinHash.

A document is its set of distinct word shingles. Its sketch has REGISTERS buckets; each bucket's smallest hash is kept as
its number of leading zeros and the mantissa bits behind them, in two bytes. Small sets would leave buckets empty: in
further rounds the set is hashed again and fills, with that round's smallest hash, the buckets that are still empty, so
that each bucket agrees between two sets with the probability of their Jaccard similarity.

1. Documents with equal sets are one class. Classes are sketched, and bands of compressed registers are their keys.
2. In each bucket of the first STAR_BANDS bands the members are linked to the bucket's smallest class. Registers of both
   are compared; the share of equal ones, corrected for chance collisions of compressed registers, must come near the
   threshold. What is left is confirmed on the full sets, and the confirmed links give components (large and small stars).
3. Buckets whose members still lie in several components are compared in blocks of bounded size inside tasks, by the
   same estimate. A block hands on no pairs: of the graph of its likely pairs only a spanning forest leaves it. The forests'
   components over all buckets are groups of classes that may hold further links.
4. The groups' full sets are compared in blocks of bounded size, and of the links that hold a block hands on a spanning
   forest again. A group whose buckets are cheaper to compare than its square (a long chain) is compared by bucket.

So links between different texts are looked for among all members of a bucket, while no bucket is written out as pairs.
With five registers in a band and 48 bands a pair at the threshold of 0.8 is missed with a probability of about 5e-9.

Defined cases: null and empty texts, and texts without words, have the empty set, which links with nothing; texts of any
length are taken whole (one set of a long text may fill a block of its own); a null doc_id takes part in links but never
names a component (null if the component has no other id), and rows with a null id and a null component are marked kept;
rows that repeat a doc_id are separate rows with their own sets; ties do not arise, as a component is named by its smallest
id; only doc_id and the text are read, so further columns may have any names; an empty table gives an empty result. In
keep_first() exactly one row of each component stays: of rows that tie in doc_id (or have none) the one with the smallest
digest of its text, and one of those that are equal in both.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, fresh, kept_by, let_go, ship, small, text_of

BANDS = 48
ROWS = 5
REGISTERS = BANDS * ROWS
#: Bits of a register: leading zeros and mantissa.
ZERO_BITS, MANTISSA_BITS = 5, 11
#: Standard deviations below the threshold down to which an estimate is handed to the full comparison.
SIGMAS = 5
#: Bands whose buckets are linked to their first class before any blocks are compared: enough to join nearly all copies.
STAR_BANDS = 12
#: Members of a bucket that are compared in one block; classes and items of sets in one block of a group.
BLOCK = 4096
SET_BLOCK = 1024
SET_ITEMS = 1 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit integers (the published SplitMix64 steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text with fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(kept_by("hyperminhash", _Words).__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        out = _mix(h[: len(h) - n + 1] + np.uint64(n))
        for k in range(1, n):
            out = _mix(out * _MULTIPLY + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def sketch(items: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The registers of a set, as unsigned 16-bit integers."""
    n = len(items)
    best = np.full(registers, np.iinfo(np.uint64).max, np.uint64)
    first = 0
    # Some more rounds than it takes, on average, to reach every bucket; the largest of them are few for large sets.
    rounds = max(1, math.ceil(1.2 * registers * math.log(registers) / n))
    with np.errstate(over="ignore"):
        while True:
            seeds = _mix(np.arange(first, first + rounds, dtype=np.uint64) * _MULTIPLY + np.uint64(1))
            h = _mix(items[None, :] ^ seeds[:, None])
            bucket = (h % np.uint64(registers)).astype(np.int64)
            low = np.uint64(1 << 40)
            # The round comes before the hash in the order, so a bucket keeps the first round that reaches it.
            value = (np.arange(first, first + rounds, dtype=np.uint64)[:, None] << np.uint64(40)) | ((h >> np.uint64(16)) % low)
            np.minimum.at(best, bucket.ravel(), value.ravel())
            if (best >> np.uint64(40) < first + rounds).all():
                break
            first += rounds
    u = best & np.uint64((1 << 40) - 1)
    zeros = np.minimum(40 - np.ceil(np.log2(u.astype(np.float64) + 1)).astype(np.int64), (1 << ZERO_BITS) - 1)
    mantissa = ((u << zeros.astype(np.uint64)) >> np.uint64(39 - MANTISSA_BITS)).astype(np.int64) & ((1 << MANTISSA_BITS) - 1)
    return ((zeros << MANTISSA_BITS) | mantissa).astype(np.uint16)


#: Chance that two different minima have equal registers: leading zeros agree with a third, the mantissa with 2^-11.
COLLISION = (1 / 3) * 2.0**-MANTISSA_BITS


def corrected(equal: float) -> float:
    """Jaccard estimate from the share of equal registers."""
    return (equal - COLLISION) / (1 - COLLISION)


def least_equal(threshold: float) -> int:
    """Equal registers that a pair needs, so that a pair at the threshold falls short with negligible probability."""
    sigma = math.sqrt(threshold * (1 - threshold) / REGISTERS)
    least = corrected(1.0) * max(0.0, threshold - SIGMAS * sigma)
    return math.floor((least * (1 - COLLISION) + COLLISION) * REGISTERS)


def key_of(text: str) -> Column:
    return F.unhex(F.md5(text_of(text).cast("binary")))


def sketches(docs: DataFrame, text: str, size: int) -> DataFrame:
    """doc_id, text_key (16 bytes, tells rows with equal ids apart), n_shingles, set_key (16 bytes; null for the empty set), registers."""
    ship(docs.sparkSession)

    def work(batches):
        from weftline.llm import hyperminhash as m

        for batch in batches:
            n, keys, regs, known = [], [], [], {}
            for t in batch.column(2).to_pylist():
                s = m.shingles(t, size)
                n.append(len(s))
                key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                keys.append(key)
                if key is not None and key not in known:
                    known[key] = m.sketch(s).tobytes()
                regs.append(known.get(key))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_key", "registers"],
            )
        batch = known = None
        m.let_go()

    rows = docs.select(F.col("doc_id").cast("long"), key_of(text).alias("text_key"), text_of(text).alias("text"))
    return rows.mapInArrow(work, "doc_id long, text_key binary, n_shingles long, set_key binary, registers binary")


def bands(classes: DataFrame) -> DataFrame:
    """number (of the class), band (key) and no (number of the band): one row for each band of each class."""
    width = ROWS * 2
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", i * width + 1, width)) for i in range(BANDS)])
    return classes.select(F.posexplode(keys).alias("no", "band"), "number").withColumn("no", F.col("no").cast("byte"))


def equal_registers(a: Column, b: Column) -> Column:
    """How many registers of two sketches are equal."""
    spots = F.sequence(F.lit(1), F.lit(2 * REGISTERS - 1), F.lit(2))
    return F.size(F.filter(spots, lambda i: F.substring(a, i, F.lit(2)) == F.substring(b, i, F.lit(2))))


def full_sets(docs: DataFrame, wanted: DataFrame, text: str, size: int, scratch: Scratch) -> DataFrame:
    """number and items (array of hashes) of the wanted classes (set_key, number, cdoc)."""
    ship(docs.sparkSession)

    def work(batches):
        from weftline.llm import hyperminhash as m

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                keys, items = [], []
                for t in batch.column(0).slice(start, 512).to_pylist():
                    s = m.shingles(t, size)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    items.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(items, pa.list_(pa.int64()))], ["set_key", "items"])
        batch = None
        m.let_go()

    wanted, of = scratch.counted(wanted)
    ids = small(wanted.select(F.col("cdoc").alias("__wanted")).distinct(), of["rows"])
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"), text_of(text).alias("text"))
    found = texts.join(ids, F.col("__id") == F.col("__wanted"), "left_semi").select("text").mapInArrow(work, "set_key binary, items array<long>")
    return scratch.table(found.join(small(wanted.select("set_key", "number"), of["rows"]), "set_key").dropDuplicates(["number"]).select("number", "items"))


#: Stands in for a null doc_id where a number is needed; larger than all others.
NO_ID = (1 << 63) - 1


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of class numbers whose full sets have 100 * intersection >= percent * union."""
    sides = pairs.select(F.col("a").alias("number")).unionByName(pairs.select(F.col("b").alias("number"))).distinct()
    sets = full_sets(docs, classes.select("set_key", "number", "cdoc").join(sides, "number", "left_semi"), text, size, scratch)
    left = pairs.join(sets.select(F.col("number").alias("a"), F.col("items").alias("xs")), "a")
    both = left.join(sets.select(F.col("number").alias("b"), F.col("items").alias("ys")), "b")
    common = F.size(F.array_intersect("xs", "ys"))
    out = scratch.table(both.filter(common * (100 + percent) >= (F.size("xs") + F.size("ys")) * percent).select("a", "b"))
    scratch.drop(sets)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (the component's smallest node) for nodes with edges (a, b): large stars and small stars in turn.

    It ends when only stars around their smallest nodes are left, which the nodes' least neighbours tell as they are written. A
    round hands on as many edges as it gets at most, so equal ones may stay until the next round makes them distinct.
    """
    current = scratch.table(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct())
    ends = F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))
    below = F.when(F.col("v") < F.col("u"), F.col("v"))
    while True:
        both = current.select(F.explode(ends).alias("end")).select("end.u", "end.v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top"), F.max(below).alias("below"))
        # No star has a node with two smaller neighbours, or with a smaller and a greater one.
        open_ = F.col("below").isNotNull() & ((F.col("m") < F.col("below")) | (F.col("top") > F.col("u")))
        # Written first: a hub's links can then be split over tasks when they are joined.
        least, seen = scratch.counted(least.select("u", F.least("u", "m").alias("m"), open_.alias("open")), open=F.count_if("open"))
        if not seen["open"]:
            break
        large = both.join(small(least.select("u", "m"), seen["rows"]), "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        stars = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        following = scratch.table(stars.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")))
        scratch.drop(current, least)
        current = following
    scratch.drop(current)
    return least.filter("m < u").select(F.col("u").alias("node"), F.col("m").alias("label"))


def dealt(members: DataFrame, unit: str, share: Column, scratch: Scratch) -> DataFrame:
    """members with mine (their block), i and j (a pair of blocks with i <= j that holds mine), for each such pair that may hold a link.

    share: what part of a block a group of members fills (an aggregate). A label that fills more than one block of a unit has
    blocks of its own, and these do not meet each other, as a label's members are linked already: they meet the unit's other blocks
    alone. So a large group that was found before is dealt once for each block of others, not for each block of itself.
    """
    counts = scratch.table(members.groupBy(unit, "label").agg(share.alias("share")))
    big = counts.filter("share > 1").select(unit, "label", F.ceil("share").cast("int").alias("own"))
    # Labels that fill blocks of their own are no more than a unit's blocks.
    before = F.coalesce(F.sum("own").over(W.partitionBy(unit).orderBy("label").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    big = big.withColumn("before", before)
    units = counts.groupBy(unit).agg(
        F.coalesce(F.ceil(F.sum(F.when(F.col("share") <= 1, F.col("share")))), F.lit(0)).cast("int").alias("mixed"), F.coalesce(F.sum(F.when(F.col("share") > 1, F.ceil("share"))), F.lit(0)).cast("int").alias("pure")
    )
    (units, n_units), (big, n_big) = scratch.counted(units), scratch.counted(big)
    out = members.join(small(units, n_units["rows"]), unit).join(small(big, n_big["rows"]), [unit, "label"], "left")
    hashed = F.xxhash64("number")
    own = F.col("own").isNotNull()
    first = F.col("mixed") + F.col("before").cast("int")
    out = out.withColumn("mine", F.when(own, first + F.pmod(hashed, F.col("own")).cast("int")).otherwise(F.pmod(hashed, F.greatest("mixed", F.lit(1))).cast("int")))
    every = F.sequence(F.lit(0), F.col("mixed") + F.col("pure") - 1)
    others = F.filter(every, lambda b: ~own | (b < first) | (b >= first + F.col("own")))
    out = out.withColumn("other", F.explode(others))
    return out.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other", "mixed", "pure", "own", "before")


def _edges(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _codes(values: list) -> np.ndarray:
    """A small number for each distinct value."""
    names = {v: at for at, v in enumerate(dict.fromkeys(values))}
    return np.array([names[v] for v in values], np.int64)


def _merge(part: np.ndarray, at: int, others: np.ndarray) -> None:
    """Joins the parts of `others` to that of `at`, in place."""
    part[np.isin(part, part[others])] = part[at]


def likely(members: DataFrame, classes: DataFrame, need: int, percent: int, scratch: Scratch) -> DataFrame:
    """A spanning forest (a, b) of the likely pairs in each block of each bucket.

    members: band, number, label; classes: number, registers, n_shingles. Likely pairs have different labels, agree in `need` registers and
    are not kept apart by their sizes alone.
    """
    ship(members.sparkSession)

    def compare(table: pa.Table) -> pa.Table:
        from weftline.llm import hyperminhash as m

        number, mine, n = (table.column(c).to_numpy() for c in ("number", "mine", "n_shingles"))
        group = m._codes(table.column("label").to_pylist())
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(len(number), -1)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        columns = np.flatnonzero(mine == j)
        part = np.arange(len(number))
        a, b = [], []
        for k in np.flatnonzero(mine == i):
            other = columns[(group[columns] != group[k]) & (part[columns] != part[k])]
            low, high = np.minimum(n[other], n[k]), np.maximum(n[other], n[k])
            other = other[(100 * low >= percent * high) & ((other > k) if i == j else True)]
            other = other[(regs[other] == regs[k]).sum(axis=1) >= need]
            # One pair for each part that is joined.
            other = other[np.unique(part[other], return_index=True)[1]]
            a += [int(number[k])] * len(other)
            b += number[other].tolist()
            m._merge(part, k, other)
        return m._edges(a, b)

    rows = dealt(members, "band", F.count(F.lit(1)) / BLOCK, scratch).join(classes, "number")
    # Dealt by pairs of blocks, so that those of one bucket go to different tasks.
    return rows.repartition("band", "i", "j").groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")


def held(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """A spanning forest (a, b) of the links in each block of each unit, found on full sets.

    members: unit, number, label, n_shingles; sets: number, items. Links inside a label are known and not looked for.
    """
    ship(members.sparkSession)

    def compare(table: pa.Table) -> pa.Table:
        from weftline.llm import hyperminhash as m

        number, mine = table.column("number").to_numpy(), table.column("mine").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        items = table.column("items").combine_chunks()
        ends = items.offsets.to_numpy().astype(np.int64)
        n = np.diff(ends)
        ids = np.unique(items.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True)[1]
        starts = ends[:-1] - ends[0]
        mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
        part = m._codes(table.column("label").to_pylist())
        columns = np.flatnonzero(mine == j)
        a, b = [], []
        for k in np.flatnonzero(mine == i):
            other = columns[(part[columns] != part[k]) & ((columns > k) if i == j else True)]
            low, high = np.minimum(n[other], n[k]), np.maximum(n[other], n[k])
            other = other[100 * low >= percent * high]
            if not len(other):
                continue
            own = ids[starts[k] : starts[k] + n[k]]
            mark[own] = True
            if len(other) * 4 < len(number):
                common = np.array([np.count_nonzero(mark[ids[starts[x] : starts[x] + n[x]]]) for x in other])
            else:
                common = np.add.reduceat(mark[ids].astype(np.int64), starts)[other]
            mark[own] = False
            other = other[100 * common >= percent * (n[k] + n[other] - common)]
            other = other[np.unique(part[other], return_index=True)[1]]
            a += [int(number[k])] * len(other)
            b += number[other].tolist()
            m._merge(part, k, other)
        return m._edges(a, b)

    share = F.greatest(F.count(F.lit(1)) / SET_BLOCK, F.sum("n_shingles") / SET_ITEMS)
    rows = dealt(members, "unit", share, scratch).drop("n_shingles").join(sets, "number")
    return rows.repartition("unit", "i", "j").groupBy("unit", "i", "j").applyInArrow(compare, "a long, b long")


def further(members: DataFrame, found: DataFrame, classes: DataFrame, docs: DataFrame, text: str, size: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) between different labels of `found` (node, label) in buckets of `members` (band, no, number); None: there are none."""
    need = least_equal(percent / 100)
    labelled = members.join(found, F.col("number") == F.col("node"), "left").select("band", "number", F.coalesce("label", "number").alias("label"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("band")
    # Written first, so that the joins that follow deal both sides anew and a hot bucket can be split.
    open_ = scratch.table(labelled.join(scratch.table(mixed), "band"))
    edges, seen = scratch.counted(likely(open_, classes.select("number", "registers", "n_shingles"), need, percent, scratch).distinct())
    if not seen["rows"]:
        return None
    groups = scratch.table(components(edges, scratch).withColumnRenamed("label", "cluster"))
    groups = groups.unionByName(groups.select(F.col("cluster").alias("node"), "cluster").distinct()).distinct()
    # Whether a group's square or the squares of its buckets are less work.
    inside = scratch.table(open_.join(groups, F.col("number") == F.col("node")).select("band", "number", "label", "cluster"))
    squares = inside.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.sum(F.col("n") * F.col("n")).alias("by_bucket"))
    whole = groups.groupBy("cluster").agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("at_once")).join(squares, "cluster")
    whole, seen = scratch.counted(whole.select("cluster", (F.col("at_once") <= F.col("by_bucket")).alias("one")))
    unit = F.when(F.col("one"), F.xxhash64(F.lit("cluster"), "cluster")).otherwise(F.xxhash64(F.col("band"), "cluster"))
    units = inside.join(small(whole, seen["rows"]), "cluster").select(unit.alias("unit"), "number", "label").distinct()
    units = scratch.table(units.join(classes.select("number", "n_shingles"), "number"))
    sets = full_sets(docs, classes.select("set_key", "number", "cdoc").join(units.select("number").distinct(), "number", "left_semi"), text, size, scratch)
    out, seen = scratch.counted(held(units, sets, percent, scratch).distinct())
    scratch.drop(open_, edges, inside, units, sets)
    return out if seen["rows"] else None


def grouped(docs: DataFrame, text: str, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """One row for each row of docs: doc_id, text_key, n_shingles, label (of the component; null for the empty set), component_id."""
    rows = scratch.table(sketches(docs, text, size))
    filled = rows.filter("set_key is not null")
    classes = filled.groupBy("set_key").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("cdoc"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n_shingles"))
    classes = scratch.table(classes.withColumn("number", F.monotonically_increasing_id()))

    buckets = bands(classes)
    # Written first, so that the join deals both sides anew and a hot bucket's members can be split.
    firsts = scratch.table(buckets.groupBy("band").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "first"))
    members = scratch.table(buckets.join(firsts, "band"))
    scratch.drop(firsts)
    stars = members.filter((F.col("number") != F.col("first")) & (F.col("no") < STAR_BANDS)).select(F.col("first").alias("a"), F.col("number").alias("b")).distinct()
    known = classes.select("number", "registers", "n_shingles")
    side = lambda x: known.select(F.col("number").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    stars = stars.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    candidates = scratch.table(stars.filter(equal_registers(F.col("ra"), F.col("rb")) >= least_equal(percent / 100)).select("a", "b"))
    links = confirm(candidates, classes, docs, text, size, percent, scratch)
    found = components(links, scratch)
    extra = further(members, found, classes, docs, text, size, percent, scratch)
    if extra is not None:
        found = components(links.unionByName(extra), scratch)

    named = classes.select("set_key", "cdoc", "number").join(found, F.col("number") == F.col("node"), "left").select("set_key", "cdoc", F.coalesce("label", "number").alias("label"))
    # Written first, so that a large component's classes can be split when they meet their root.
    roots = scratch.table(named.groupBy("label").agg(F.min("cdoc").alias("root")))
    ids = scratch.table(named.join(roots, "label").select("set_key", "label", F.when(F.col("root") != NO_ID, F.col("root")).alias("component_id")))
    scratch.drop(members, candidates)
    linked = filled.select("doc_id", "text_key", "n_shingles", "set_key").join(ids, "set_key").drop("set_key")
    alone = rows.filter("set_key is null").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (it is doc_id)."""
    found = grouped(docs, text, size, percent, Scratch(docs.sparkSession))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when of each group of near duplicates one row stays, the one with the smallest doc_id."""
    scratch = Scratch(docs.sparkSession)
    found = grouped(docs, text, size, percent, scratch).filter("label is not null").withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    found = scratch.table(found.groupBy("label", "doc", "text_key").agg(F.count(F.lit(1)).alias("times")))
    winners = scratch.table(found.groupBy("label").agg(F.min(F.struct("doc", "text_key")).alias("stays")))
    judged = found.join(winners, "label").withColumn("wins", F.struct("doc", "text_key") == F.col("stays"))
    id_, key = fresh(docs, "__id", "__key")
    judged = judged.filter("not wins or times > 1").select(F.col("doc").alias(id_), F.col("text_key").alias(key), "wins")
    judged, seen = scratch.counted(judged, tied=F.count_if("wins"))
    # Few enough of them, counted, are broadcast, and the texts stay where they are; else both sides are dealt out.
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col(id_)) & (key_of(text) == F.col(key))
    out = docs.join(small(judged.select(id_, key), seen["rows"]), same, "left_anti")
    tied = judged.filter("wins").select(id_, key)
    if not seen["tied"]:
        return out
    # Rows that repeat doc_id and text: one of them stays.
    again = docs.join(small(tied, seen["tied"]), same).dropDuplicates([id_, key]).select(*docs.columns)
    return out.unionByName(again)
