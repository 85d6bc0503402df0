"""Media columns: copies of images by local descriptors.

Images with equal pixels are one class. Each class gets corners on several scales, some of fixed size, which whole images that
were resized have in common (Harris response, local maxima), each corner an orientation (intensity centroid) and 256 binary
intensity tests turned by it. Two descriptors within RADIUS bits of each other agree in at least one of TABLES equal parts of
their bits; the parts are the keys of Hamming tables.
Descriptors that share a cell are compared in whole. Cells of more than BLOCK descriptors are split once more by the bits that
are left, so that a descriptor is dealt out PIECES times at most; what is still larger is compared in pairs of blocks. So all
matches of all classes are found, each in the first table (and piece) that holds it. The matches of two classes vote for a scale, a
turn and a shift, and a pair is linked when VOTES of them agree, which holds for crops, for changes of brightness and
contrast, and for noise, recompression and rescaling that leave VOTES corners within RADIUS. groups() returns what the links
join and writes out no group as pairs; copies() counts the links themselves, which are as many as a group's square.

Images are given as bytes (PNG with 8 bits a channel and no interlace, PGM, PPM). Defined cases: null, empty or unreadable
bytes have no class and no links, like a PNG whose data are longer than its size says; images without corners link with
nothing but their own class; large images are described in parts, as a whole; corners of equal response are taken from top
to bottom and left to right; rows with null or repeated ids are rows of their own, and name a class by its smallest id; only
id and image are read, so further columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import math
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, ship, small
from weftline.llm.hyperminhash import components, dealt

SCALES = (1.0, 0.84, 0.71, 0.59, 0.5)
#: The larger side of levels of fixed size is this number times a power of two, so that a resized image has a level of its original's.
SIDE = 64
#: Corners kept in each square of TILE x TILE pixels of each scale, the strongest; part of the descriptor's definition.
CORNERS = 24
TILE = 64
PATCH = 9
#: Spread of the tests in the patch (standard deviation): wide, so that smooth patches differ in more bits.
SPREAD = PATCH / 1.8
BITS = 256
#: Bits by which descriptors of one corner may differ; sized for edits (noise, recompression, rescaling).
RADIUS = 7
#: One more than RADIUS, so that descriptors within RADIUS agree in a table.
TABLES = 8
PART = BITS // 8 // TABLES
#: Cells of a table with more descriptors than this are split by the bits that are left.
BLOCK = 2048
#: Parts of those bits, one more than RADIUS, so that descriptors within RADIUS that share a cell agree in one of them too.
PIECES = 8
#: Where they begin in the bytes beside a table's part, and the end of the last.
CUTS = tuple(k * (BITS // 8 - PART) // PIECES for k in range(PIECES + 1))
#: Tables whose cells are compared in one job; the others wait, so that few are on the disk at a time.
AT_ONCE = 2
VOTES = 4
#: Tables whose cells link classes before components are compared: enough to join nearly all near copies.
STAR_TABLES = 2
#: Classes, and bytes of their features, in one block of a pair of components.
PAIR_BLOCK = 256
PAIR_BYTES = 1 << 24
#: Steps of the votes: scale (log 2), turn (radians) and shift (share of the larger side).
STEP_SCALE, STEP_TURN, STEP_SHIFT = 0.5, math.pi / 6, 0.125
RECORD = struct.Struct("<ffff32s")
PLACE = struct.Struct("<ffff")


def _pattern() -> np.ndarray:
    """Places of the tests: 256 pairs of points in the patch, from a fixed sequence."""
    rng = np.random.default_rng(20)
    points = np.clip(rng.normal(0, SPREAD, (BITS, 2, 2)), -PATCH + 1, PATCH - 1)
    return points


TESTS = _pattern()


def _shared() -> np.ndarray:
    """For each table and piece (the last stands for none) the bits that descriptors of a group have in common, as four words."""
    every = np.arange(BITS // 8)
    out = np.zeros((TABLES, PIECES + 1, len(every)), np.uint8)
    for t in range(TABLES):
        own = every // PART == t
        out[t, :, own] = 255
        for k in range(PIECES):
            out[t, k, every[~own][CUTS[k] : CUTS[k + 1]]] = 255
    return out.view(np.uint64)


SHARED = _shared()


def read_image(raw: bytes | None) -> np.ndarray | None:
    """Grey values as float, or None."""
    try:
        if not raw:
            return None
        if raw[:2] in (b"P5", b"P6"):
            parts = raw.split(maxsplit=4)
            if len(parts) == 5 and parts[3] == b"255":
                w, h, channels = int(parts[1]), int(parts[2]), 1 if raw[:2] == b"P5" else 3
                data = raw[len(raw) - w * h * channels :]
                return np.frombuffer(data, np.uint8).reshape(h, w, channels).mean(axis=2)
            return None
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _read_png(raw)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        return None
    return None


def _read_png(raw: bytes) -> np.ndarray:
    at, data, head = 8, [], None
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or interlace:
        raise ValueError("a PNG of another kind")
    # No more than the size that the head gives is unpacked.
    size = h * (1 + w * channels)
    plain = zlib.decompressobj().decompress(b"".join(data), size + 1)
    if len(plain) != size:
        raise ValueError("data of another length")
    rows = np.frombuffer(plain, np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.int32)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int32)
        up = out[y - 1] if y else np.zeros_like(line)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            for x in range(len(line)):
                a = out[y, x - channels] if x >= channels else 0
                c = up[x - channels] if x >= channels else 0
                guess = {1: a, 3: (a + up[x]) // 2, 4: _paeth(a, up[x], c)}[int(kind)]
                out[y, x] = (line[x] + guess) & 255
    image = out.reshape(h, w, channels)
    return image[:, :, : (1 if channels < 3 else 3)].mean(axis=2)


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes()


def resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    ys, xs = (np.arange(h) + 0.5) * image.shape[0] / h - 0.5, (np.arange(w) + 0.5) * image.shape[1] / w - 0.5
    ys, xs = np.clip(ys, 0, image.shape[0] - 1), np.clip(xs, 0, image.shape[1] - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def _box(image: np.ndarray, r: int) -> np.ndarray:
    h, w = image.shape
    n = 2 * r + 1
    # The image with its edges repeated, by indices: np.pad takes longer than the sums do on small images.
    wide = image[np.arange(-r, h + r).clip(0, h - 1)][:, np.arange(-r, w + r).clip(0, w - 1)]
    sums = np.zeros((h + n, w + n))
    np.cumsum(wide.cumsum(0), 1, out=sums[1:, 1:])
    return (sums[n:, n:] - sums[:-n, n:] - sums[n:, :-n] + sums[:-n, :-n]) / (n * n)


def levels(side: int) -> list[float]:
    """Scales at which an image with this larger side is described: shares of its size, which crops have too, and the two
    largest fixed sizes within it, of which images of between half and all of each other's size have one in common. Images
    of between SIDE / 2 and SIDE are enlarged to SIDE."""
    power = max(0, math.floor(math.log2(side / SIDE))) if side else 0
    fixed = {SIDE << power, SIDE << max(0, power - 1)}
    return [*SCALES, *sorted((f / side for f in fixed if 2 * side >= f), reverse=True)]


def features(image: np.ndarray) -> list[tuple[float, float, float, float, bytes]]:
    """Corners: x, y (in the image), scale, angle, descriptor."""
    out, known = [], set()
    for scale in levels(max(image.shape)):
        h, w = round(image.shape[0] * scale), round(image.shape[1] * scale)
        if min(h, w) < 2 * PATCH + 6 or (h, w) in known:
            continue
        known.add((h, w))
        level = _box(image if scale == 1.0 else resize(image, h, w), 1)
        gy, gx = np.gradient(level)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[1:-1, 1:-1]
        around = np.stack([response[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
        peak = np.zeros((h, w), bool)
        peak[1:-1, 1:-1] = (inner > around.max(axis=0)) & (inner > 0)
        edge = PATCH + 2
        peak[:edge] = peak[-edge:] = False
        peak[:, :edge] = peak[:, -edge:] = False
        ys, xs = np.nonzero(peak)
        if not len(ys):
            continue
        tile = ys // TILE * (w // TILE + 1) + xs // TILE
        best = np.lexsort((xs, ys, -response[ys, xs], tile))
        # The place of each corner among those of its tile.
        starts = np.concatenate(([0], np.flatnonzero(np.diff(tile[best])) + 1))
        place = np.arange(len(best)) - np.repeat(starts, np.diff(np.append(starts, len(best))))
        best = best[place < CORNERS]
        ys, xs = ys[best], xs[best]
        grid = np.arange(-PATCH + 1, PATCH)
        disk_y, disk_x = (g[np.hypot(*np.meshgrid(grid, grid, indexing="ij")) < PATCH] for g in np.meshgrid(grid, grid, indexing="ij"))
        smooth = _box(level, 1)
        # In parts, as a large image has many corners.
        for at in range(0, len(ys), 2048):
            out += _described(level, smooth, ys[at : at + 2048], xs[at : at + 2048], disk_y, disk_x, scale)
    return out


def _described(level: np.ndarray, smooth: np.ndarray, ys: np.ndarray, xs: np.ndarray, disk_y: np.ndarray, disk_x: np.ndarray, scale: float) -> list[tuple]:
    h, w = level.shape
    values = level[ys[:, None] + disk_y, xs[:, None] + disk_x]
    angle = np.arctan2((values * disk_y).sum(1), (values * disk_x).sum(1))
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    dy, dx = TESTS[None, :, :, 0], TESTS[None, :, :, 1]
    py = np.clip(np.rint(ys[:, None, None] + sin * dx + cos * dy).astype(int), 0, h - 1)
    px = np.clip(np.rint(xs[:, None, None] + cos * dx - sin * dy).astype(int), 0, w - 1)
    bits = np.packbits(smooth[py[:, :, 0], px[:, :, 0]] < smooth[py[:, :, 1], px[:, :, 1]], axis=1)
    return [(float(x / scale), float(y / scale), scale, float(a), d.tobytes()) for x, y, a, d in zip(xs, ys, angle, bits, strict=True)]


def _near(a: np.ndarray, b: np.ndarray, words: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the descriptors of a and b (rows of four words) within RADIUS; two words are compared first."""
    found_i, found_j = [], []
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        first = np.bitwise_count(part[:, None, words[0]] ^ b[None, :, words[0]]) + np.bitwise_count(part[:, None, words[1]] ^ b[None, :, words[1]])
        i, j = np.nonzero(first <= RADIUS)
        close = np.bitwise_count(part[i] ^ b[j]).sum(axis=1, dtype=np.int32) <= RADIUS
        found_i.append(i[close] + at), found_j.append(j[close])
    return np.concatenate(found_i or [np.zeros(0, np.int64)]), np.concatenate(found_j or [np.zeros(0, np.int64)])


def voted(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, votes: int = VOTES) -> int:
    """The most of the matches (i, j) that agree in scale, turn and shift; a, b: rows of x, y, scale, angle."""
    if len(i) < votes:
        return 0
    xa, ya, sa, ta = a[i].astype(float).T
    xb, yb, sb, tb = b[j].astype(float).T
    scale, turn = np.log2(sa / sb), (tb - ta + math.pi) % (2 * math.pi) - math.pi
    grow = 2.0**scale
    moved_x = xb - grow * (np.cos(turn) * xa - np.sin(turn) * ya)
    moved_y = yb - grow * (np.sin(turn) * xa + np.cos(turn) * ya)
    side = max(1.0, np.ptp(np.concatenate((xa, xb))), np.ptp(np.concatenate((ya, yb))))
    best = 0
    # Each match in turn is the hypothesis; those near it vote, each corner once.
    for k in range(len(i)):
        near = (np.abs(scale - scale[k]) <= STEP_SCALE) & (np.abs((turn - turn[k] + math.pi) % (2 * math.pi) - math.pi) <= STEP_TURN)
        near &= (np.abs(moved_x - moved_x[k]) <= STEP_SHIFT * side) & (np.abs(moved_y - moved_y[k]) <= STEP_SHIFT * side)
        best = max(best, min(len(set(i[near])), len(set(j[near]))))
    return best


def _parts(feats: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y, scale, angle) and descriptors (four words) of packed features."""
    rows = np.frombuffer(feats, np.uint8).reshape(-1, RECORD.size)
    return np.ascontiguousarray(rows[:, : PLACE.size]).view("<f4"), np.ascontiguousarray(rows[:, PLACE.size :]).view(np.uint64)


def agree(a: bytes, b: bytes, votes: int = VOTES) -> int:
    """The most matches of two classes' features that agree in scale, turn and shift."""
    (pa_, da), (pb_, db) = _parts(a), _parts(b)
    return voted(pa_, pb_, *_near(da, db), votes)


def describe(images: DataFrame) -> DataFrame:
    """images (id, image) to id, pixels (16 bytes, null without a readable image), feats (packed), places (those of feats)."""

    def work(batches):
        from weftline.llm import media as m

        for batch in batches:
            pixels, feats, places, known = [], [], [], {}
            for raw in batch.column(1).to_pylist():
                image = m.read_image(raw)
                if image is None:
                    pixels.append(None), feats.append(None), places.append(None)
                    continue
                key = xxhash.xxh3_128_digest(str(image.shape).encode() + np.ascontiguousarray(image).tobytes())
                if key not in known:
                    found = m.features(image)
                    known[key] = b"".join(m.RECORD.pack(*f) for f in found), b"".join(m.PLACE.pack(*f[:4]) for f in found)
                pixels.append(key), feats.append(known[key][0]), places.append(known[key][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pixels, pa.binary()), pa.array(feats, pa.binary()), pa.array(places, pa.binary())], ["id", "pixels", "feats", "places"])

    return images.mapInArrow(work, "id long, pixels binary, feats binary, places binary")


def copies(images: DataFrame, votes: int = VOTES) -> DataFrame:
    """images (id, image) to one row for each row: id, class_id (smallest id with the same pixels), n_links.

    n_links counts the other classes that a row's class is linked to.
    """
    ship(images.sparkSession)
    scratch = Scratch(images.sparkSession)
    rows = scratch.table(describe(images.select(F.col("id").cast("long").alias("id"), "image")))
    seen = rows.filter("pixels is not null")
    classes = seen.groupBy("pixels").agg(F.min("id").alias("class_id"), F.first("feats").alias("feats"), F.first("places").alias("places"))
    classes = scratch.table(classes.withColumn("number", F.monotonically_increasing_id()))
    pairs = scratch.table(verified(meetings(classes, votes, scratch), classes, votes))
    ends = pairs.select(F.col("a").alias("number")).unionByName(pairs.select(F.col("b").alias("number")))
    counts = ends.groupBy("number").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.select("pixels", "number", "class_id").join(counts, "number", "left").drop("number")
    found = seen.select("id", "pixels").join(named, "pixels").select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    blank = rows.filter("pixels is null").select("id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(blank)


def groups(images: DataFrame, votes: int = VOTES) -> DataFrame:
    """images (id, image) to one row for each row: id, class_id (smallest id with the same pixels), group_id (smallest id that links reach).

    The links are those that copies() counts, but no group is written out as pairs:
    1. In the cells of some tables each corner meets the smallest class that it matches; classes are linked where features agree (see voted).
    2. In the cells of all tables matches between components are sought. For each pair of components the most matches that two of
       its classes have in a cell are summed over the cells; below `votes` no link is possible.
    3. For the pairs of components that are left, the classes with matches in the other one are compared in whole, in blocks,
       up to the first link, which joins the two.
    """
    ship(images.sparkSession)
    scratch = Scratch(images.sparkSession)
    described = scratch.table(describe(images.select(F.col("id").cast("long").alias("id"), "image")).drop("places"))
    classes = described.filter("pixels is not null").groupBy("pixels").agg(F.min("id").alias("class_id"), F.first("feats").alias("feats"))
    classes = scratch.table(classes.withColumn("number", F.monotonically_increasing_id()))
    rows = scratch.table(described.select("id", "pixels"))
    scratch.drop(described)
    links = scratch.table(starred(classes, votes, scratch))
    found = components(links, scratch)
    further = scratch.table(crossing(found, classes, votes, scratch))
    if further.limit(1).count():
        found = components(links.unionByName(further), scratch)
    named = scratch.table(classes.select("pixels", "number", "class_id").join(found, F.col("number") == F.col("node"), "left").select("pixels", "class_id", F.coalesce("label", "number").alias("label")))
    # Written first, so that a large group's classes can be split when they meet their root.
    roots = scratch.table(named.groupBy("label").agg(F.min("class_id").alias("group_id")))
    ids = scratch.table(named.join(roots, "label").drop("label"))
    out = rows.filter("pixels is not null").join(ids, "pixels").select("id", "class_id", "group_id")
    none = F.lit(None).cast("long")
    return out.unionByName(rows.filter("pixels is null").select("id", none.alias("class_id"), none.alias("group_id")))


def celled(classes: DataFrame, tables: range) -> DataFrame:
    """number, label, corner, t, cell, bits: each corner of each class (number, label, feats) in its cell of each of the tables."""
    size, lead = RECORD.size, PLACE.size
    corners = classes.filter("length(feats) > 0").select("number", "label", "feats", F.explode(F.expr(f"sequence(0, cast(length(feats) div {size} as int) - 1)")).alias("corner"))
    corners = corners.select("number", "label", "corner", F.expr(f"substring(feats, corner * {size} + {lead + 1}, {size - lead})").alias("bits"))
    keyed = corners.withColumn("t", F.explode(F.array(*[F.lit(t) for t in tables])))
    return keyed.withColumn("cell", F.expr(f"substring(bits, t * {PART} + 1, {PART})"))


def searched(classes: DataFrame, tables: range, second: str, blocks, work, schema: str, scratch: Scratch) -> DataFrame:
    """What `work` makes of the cells of some tables, as a written table. `blocks` deals out rows of cells, with n where a cell has
    more than BLOCK descriptors, to rows with piece, key (what a piece's descriptors have in common), i, j and mine."""
    cells = celled(classes, tables)
    large = scratch.table(cells.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK))
    parts = blocks(cells.join(small(large), ["t", "cell"], "left")).select("t", "piece", "key", F.col("i").alias("low"), F.col("j").alias("high"), "mine", "number", second, "bits")
    every = parts.repartition("t", "piece", "key", "low", "high").sortWithinPartitions("t", "piece", "key", "low", "high")
    return scratch.table(every.select("t", "piece", "low", "high", "mine", "number", second, "bits").mapInArrow(work, schema))


def pieced(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (t, cell, n, number, label, bits; n is null where a cell is not large) with piece, key, i, j and mine, so that
    descriptors of two labels that are within RADIUS meet.

    A cell that is not large is one group (piece -1). In a large one each descriptor goes to a group for each piece of the bits that
    are left, so it is dealt out PIECES times however large its cell is. Only groups that agree in a piece too and still have more
    than BLOCK descriptors are dealt out in pairs of blocks.
    """
    pieces = F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(PIECES - 1)))
    begins = ", ".join(str(c + 1) for c in CUTS[:-1])
    sizes = ", ".join(str(b - a) for a, b in zip(CUTS, CUTS[1:], strict=False))
    rest = f"concat(substring(bits, 1, t * {PART}), substring(bits, (t + 1) * {PART} + 1))"
    key = F.expr(f"if(piece < 0, cell, concat(cell, substring({rest}, get(array({begins}), piece), get(array({sizes}), piece))))")
    fine = rows.withColumn("piece", F.explode(pieces)).withColumn("key", key).drop("n")
    by = ["t", "piece", "key"]
    heavy = scratch.table(fine.filter("piece >= 0").groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select(*by, F.xxhash64(*by).alias("unit")))
    one = {c: F.lit(0) for c in ("i", "j", "mine")}
    if not heavy.limit(1).count():
        return fine.withColumns(one)
    known = small(heavy)
    parts = dealt(fine.join(known, by), "unit", F.count(F.lit(1)) / BLOCK, scratch).drop("unit")
    return fine.join(known, by, "left_anti").withColumns(one).unionByName(parts)


def freed(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def starred(classes: DataFrame, votes: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of classes with the smallest class that their corners match in a block of a cell, by STAR_TABLES of the tables."""

    def blocks(rows: DataFrame) -> DataFrame:
        mine = F.pmod(F.xxhash64("number"), F.ceil(F.coalesce("n", F.lit(1)) / BLOCK)).cast("int")
        return rows.withColumns({"mine": mine, "i": mine, "j": mine, "piece": F.lit(-1), "key": F.col("cell")})

    labelled = classes.select("number", F.col("number").alias("label"), "feats")
    met = searched(labelled, range(STAR_TABLES), "corner", blocks, _smallest, "a long, b long, corner long", scratch).distinct()
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= votes)
    # Written first, so that a class that is the smallest one of many can be split.
    met = scratch.table(met.select("a", "b"))
    side = lambda c: classes.select(F.col("number").alias(c), F.struct("pixels", "feats").alias(f"of_{c}"))
    both = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a.pixels", "of_a.feats", F.col("of_b.pixels").alias("pixels_b"), F.col("of_b.feats").alias("feats_b"))

    def work(batches):
        from weftline.llm import media as m

        for batch in batches:
            a, b, pixels_a, feats_a, pixels_b, feats_b = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for k in range(batch.num_rows):
                # From the smaller pixels to the larger, as the numbers may differ from run to run.
                x, y = (feats_a[k], feats_b[k]) if pixels_a[k] < pixels_b[k] else (feats_b[k], feats_a[k])
                if m.agree(x, y, votes) >= votes:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"])

    return both.mapInArrow(work, "a long, b long")


def crossing(found: DataFrame, classes: DataFrame, votes: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join components of `found` (node, label): one or more for each two components that have any."""
    spark = classes.sparkSession
    named = classes.join(found, F.col("number") == F.col("node"), "left").withColumn("label", F.coalesce("label", "number")).select("number", "label", "pixels", "feats")
    named = scratch.table(named)

    def blocks(rows: DataFrame) -> DataFrame:
        return pieced(rows, scratch)

    def passed(of: DataFrame, work, schema: str) -> DataFrame:
        parts = None
        for first in range(0, TABLES, AT_ONCE):
            freed(spark)
            part = searched(of, range(first, min(first + AT_ONCE, TABLES)), "label", blocks, work, schema, scratch)
            parts = part if parts is None else parts.unionByName(part)
        return parts

    bounds = passed(named, _bounds, "la long, lb long, most long")
    pairs = scratch.table(bounds.groupBy("la", "lb").agg(F.sum("most").alias("most")).filter(F.col("most") >= votes).select("la", "lb"))
    ends = scratch.table(pairs.select(F.col("la").alias("label")).unionByName(pairs.select(F.col("lb").alias("label"))).distinct())
    open_ = scratch.table(named.join(small(ends), "label", "left_semi"))
    met = passed(open_, _members, "la long, lb long, number long, label long")
    units = met.distinct().join(small(pairs), ["la", "lb"]).select(F.xxhash64("la", "lb").alias("unit"), "number", "label")
    units = scratch.table(units.join(open_.select("number", F.length("feats").alias("size")), "number"))
    freed(spark)
    share = F.greatest(F.count(F.lit(1)) / PAIR_BLOCK, F.sum("size") / PAIR_BYTES)
    out = dealt(units, "unit", share, scratch).drop("size").join(open_.select("number", "pixels", "feats"), "number")

    def compare(table: pa.Table) -> pa.Table:
        from weftline.llm import media as m

        return m.first_link(table, votes)

    return out.repartition("unit", "i", "j").groupBy("unit", "i", "j").applyInArrow(compare, "a long, b long")


def _smallest(batches):
    """For each corner the smallest class that it matches, if smaller than its own; rows as in _by_cell with number and corner."""
    for (piece, low, high, mine, number, corner, bits), ends, t in _by_cell(batches):
        i, j = alike(piece, low, high, mine, bits, ends, t)
        least = number.copy()
        np.minimum.at(least, i, number[j])
        np.minimum.at(least, j, number[i])
        at = np.flatnonzero(least < number)
        yield pa.RecordBatch.from_arrays([pa.array(x[at], pa.int64()) for x in (least, number, corner)], ["a", "b", "corner"])


def _met(batches):
    """The matches between components in rows (t, piece, low, high, mine, number, label, bits), sorted as in _by_cell: la < lb, a, b, group."""
    for (piece, low, high, mine, number, label, bits), ends, t in _by_cell(batches):
        i, j = alike(piece, low, high, mine, bits, ends, t)
        other = label[i] != label[j]
        i, j = i[other], j[other]
        turn = label[i] > label[j]
        i, j = np.where(turn, j, i), np.where(turn, i, j)
        yield pd.DataFrame({"la": label[i], "lb": label[j], "a": number[i], "b": number[j], "group": np.searchsorted(ends, i, "right")})


def _bounds(batches):
    """For each pair of components the most matches that two of their classes have in a cell, summed over cells."""
    for met in _met(batches):
        most = met.groupby(["la", "lb", "group", "a", "b"]).size().groupby(level=["la", "lb", "group"]).max().groupby(level=["la", "lb"]).sum()
        most = most.rename("most").reset_index()
        yield pa.RecordBatch.from_pandas(most.astype("int64"), preserve_index=False)


def _members(batches):
    """The classes with matches in another component, for each pair of components."""
    for met in _met(batches):
        a = met[["la", "lb", "a"]].rename(columns={"a": "number"}).assign(label=met["la"])
        b = met[["la", "lb", "b"]].rename(columns={"b": "number"}).assign(label=met["lb"])
        yield pa.RecordBatch.from_pandas(pd.concat([a, b]).drop_duplicates().astype("int64"), preserve_index=False)


def first_link(table: pa.Table, votes: int) -> pa.Table:
    """A link (a, b) between the two components of a pair of blocks, if there is one; rows: number, label, mine, i, j, pixels, feats."""
    number, label, mine = (table.column(c).to_numpy() for c in ("number", "label", "mine"))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    pixels, parts = table.column("pixels").to_pylist(), [_parts(f) for f in table.column("feats").to_pylist()]
    names = np.unique(label)
    out = ([], [])
    for one, two in ((names[0], names[-1]), (names[-1], names[0]))[: 1 if i == j else 2]:
        left, right = np.flatnonzero((label == one) & (mine == i)), np.flatnonzero((label == two) & (mine == j))
        if out[0] or one == two or not len(left) or not len(right):
            continue
        bits = np.concatenate([parts[y][1] for y in right])
        owner = np.repeat(right, [len(parts[y][1]) for y in right])
        for x in left:
            hits = np.concatenate([owner[at + _near(parts[x][1], bits[at : at + 8192])[1]] for at in range(0, len(bits), 8192)])
            near, times = np.unique(hits, return_counts=True)
            for y in near[times >= votes]:
                # From the smaller pixels to the larger, as the numbers may differ from run to run.
                (pa_, da), (pb_, db) = (parts[x], parts[y]) if pixels[x] < pixels[y] else (parts[y], parts[x])
                if voted(pa_, pb_, *_near(da, db), votes) >= votes:
                    out[0].append(int(number[x])), out[1].append(int(number[y]))
                    break
            if out[0]:
                break
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def meetings(classes: DataFrame, votes: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of classes by number that have at least `votes` matches, with matches array<long> (corner of a << 32 | corner of b)."""
    labelled = classes.select("number", F.col("number").alias("label"), "feats")
    found = None
    for first in range(0, TABLES, AT_ONCE):
        tables = range(first, min(first + AT_ONCE, TABLES))
        matches = searched(labelled, tables, "corner", lambda rows: pieced(rows, scratch), _match, "a long, b long, corners long", scratch)
        found = matches if found is None else found.unionByName(matches)
        freed(classes.sparkSession)
    pairs = found.repartition("a", "b").groupBy("a", "b").agg(F.collect_list("corners").alias("matches"))
    return pairs.filter(F.size("matches") >= votes)


def _match(batches):
    """Matches of rows (t, piece, low, high, mine, number, corner, bits) that are sorted by table, piece, cell and pair of blocks."""
    for rows, ends, t in _by_cell(batches):
        yield matched(rows, ends, t)


def _by_cell(batches):
    """Rows (t, piece, low, high, mine, two numbers, bits), sorted by table, piece, cell and pair of blocks, as whole groups of one
    table: the columns after t, the groups' ends, t."""
    from weftline.llm import media as m

    rest = None
    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
        rows.append(np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(-1, m.BITS // 64))
        rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
        if not len(rows[0]):
            continue
        t = rows[0]
        own = rows[7] & m.SHARED[t, rows[1]]
        new = (own[1:] != own[:-1]).any(axis=1)
        for x in rows[:4]:
            new |= x[1:] != x[:-1]
        new = np.flatnonzero(new) + 1
        # The last group may go on in the next batch.
        end = new[-1] if len(new) else 0
        rest = [x[end:] for x in rows]
        if end:
            ends = np.concatenate(([0], new))
            for k in np.unique(t[:end]):
                # Groups of one table stand together.
                a, b = np.searchsorted(t[:end], [k, k + 1])
                yield [x[a:b] for x in rows[1:]], ends[(ends >= a) & (ends <= b)] - a, int(k)
    if rest is not None and len(rest[0]):
        yield rest[1:], np.array([0, len(rest[0])]), int(rest[0][0])


def alike(piece: np.ndarray, low: np.ndarray, high: np.ndarray, mine: np.ndarray, bits: np.ndarray, ends: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i, j inside the groups ends[k] : ends[k + 1] that are within RADIUS, without those that an earlier table than t or an earlier
    piece of their cell holds."""
    sizes = np.diff(ends)
    left, right = [], []
    # Small groups: rows at a distance of 1, 2, ... in the same group.
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = (sizes <= 48) & (low[ends[:-1]] == high[ends[:-1]])
    at = np.flatnonzero(small[group] & (sizes[group] > 1))
    for step in range(1, 48):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        close = at[np.bitwise_count(bits[at] ^ bits[at + step]).sum(axis=1, dtype=np.int32) <= RADIUS]
        left.append(close), right.append(close + step)
    # Words without the part that is equal in the whole group come first.
    own = t * PART // 8
    words = ((own + 1) % 4, (own + 2) % 4)
    for k in np.flatnonzero(~small):
        span = np.arange(ends[k], ends[k + 1])
        if low[span[0]] == high[span[0]]:
            for lo in range(0, len(span), 512):
                i, j = _near(bits[span[lo : lo + 512]], bits[span[lo:]], words)
                left.append(span[lo:][i[i < j]]), right.append(span[lo:][j[i < j]])
        else:
            one, two = span[mine[span] == low[span[0]]], span[mine[span] != low[span[0]]]
            i, j = _near(bits[one], bits[two], words)
            left.append(one[i]), right.append(two[j])
    i, j = np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])
    parts = bits.view(np.uint8).reshape(len(bits), TABLES, PART)
    fresh = (parts[i, :t] != parts[j, :t]).any(axis=2).all(axis=1)
    for k in range(PIECES - 1):
        later = np.flatnonzero(fresh & (piece[i] > k))
        fresh[later] = ((bits[i[later]] ^ bits[j[later]]) & SHARED[t, k]).any(axis=1)
    return i[fresh], j[fresh]


def matched(rows: list[np.ndarray], ends: np.ndarray, t: int) -> pa.RecordBatch:
    """Matches of different classes inside the groups rows[ends[k] : ends[k + 1]]."""
    piece, low, high, mine, number, corner, bits = rows
    i, j = alike(piece, low, high, mine, bits, ends, t)
    other = number[i] != number[j]
    i, j = i[other], j[other]
    turn = number[i] > number[j]
    i, j = np.where(turn, j, i), np.where(turn, i, j)
    packed = (corner[i].astype(np.int64) << 32) | corner[j].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(number[i], pa.int64()), pa.array(number[j], pa.int64()), pa.array(packed, pa.int64())], ["a", "b", "corners"])


def verified(pairs: DataFrame, classes: DataFrame, votes: int) -> DataFrame:
    """Pairs (a, b, matches) whose matches agree, with their votes."""
    sides = [classes.select(F.col("number").alias(c), F.struct("pixels", "places").alias(f"of_{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    both = both.select("a", "b", "matches", "of_a.pixels", "of_a.places", F.col("of_b.pixels").alias("pixels_b"), F.col("of_b.places").alias("places_b"))

    def work(batches):
        from weftline.llm import media as m

        for batch in batches:
            a, b, matches, pixels_a, places_a, pixels_b, places_b = (batch.column(i).to_pylist() for i in range(7))
            n = []
            for c, key_a, x, key_b, y in zip(matches, pixels_a, places_a, pixels_b, places_b, strict=True):
                c = np.array(c, np.int64)
                x, y = (np.frombuffer(v, "<f4").reshape(-1, 4) for v in (x, y))
                i, j = c >> 32, c & 0xFFFFFFFF
                # From the smaller pixels to the larger, as the numbers may differ from run to run.
                n.append(m.voted(x, y, i, j, votes) if key_a < key_b else m.voted(y, x, j, i, votes))
            keep = [k for k, v in enumerate(n) if v >= votes]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64()), pa.array([n[k] for k in keep], pa.int32())], ["a", "b", "votes"])

    return both.mapInArrow(work, "a long, b long, votes int")


def render(vectors: DataFrame, side: int = 64) -> DataFrame:
    """vectors (id, embedding) drawn as grey images: the smallest square grid that holds all values, from dark to bright,
    enlarged; places without a value are as dark as the smallest one."""
    ship(vectors.sparkSession)

    def work(batches):
        from weftline.llm import media as m

        for batch in batches:
            images = []
            for v in batch.column(1).to_pylist():
                if not v:
                    images.append(None)
                    continue
                n = math.isqrt(len(v) - 1) + 1
                values = np.nan_to_num(np.array(v, float))
                low, high = values.min(), values.max()
                values = np.concatenate((values, np.full(n * n - len(v), low)))
                images.append(m.write_pgm(m.resize(255 * (values.reshape(n, n) - low) / max(high - low, 1e-12), side, side)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], ["id", "image"])

    return vectors.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(work, "id long, image binary")
