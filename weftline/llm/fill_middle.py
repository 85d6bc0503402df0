"""Fill-in-middle by overlapping-chunk decomposition: a text is cut at two token ranks and its parts are put in another order.

Tokens are runs of ASCII letters, and every other code point by itself. So a token begins at a code point unless it and the one
before are letters: a predicate of two neighbours. The bytes of a batch of texts are cut into chunks that see the byte before them;

* each chunk counts the token beginnings in it, all chunks at once and without regard to each other;
* prefix sums over the chunks of a text give its number of tokens, from which the two cut ranks follow, and say which chunk owns
  which rank;
* only the two owning chunks are scanned again, for the place of the rank in them.

A chunk has CHUNK bytes, so what is held beside the texts of one batch does not grow with a text. Cuts and form depend on a hash of
seed and id alone: every run and every partitioning gives the same output. No shuffle, no state between rows.

Defined cases: null and empty texts, and texts that hold one of the marks, are `plain`: the output is the text (null as empty), and
prefix_chars and middle_chars are null. A null id hashes as the empty string. Equal rows give equal results, each for itself; there
are no ties, as ranks are unique. Prefix, middle and suffix may be empty. Texts of any length go the same way. An empty table gives
an empty result. Columns of docs with the names of the results are replaced, all others handed through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.llm.common import fresh, ship, text_of

#: Bytes of a chunk, and bytes of texts that are worked on at once (one longer text is worked on alone).
CHUNK = 4096
BATCH_BYTES = 8 << 20
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts: how many stay plain, and how many of the others have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def beginnings(data: np.ndarray, begin: int, end: int, first: int) -> np.ndarray:
    """For each byte of data[begin:end] whether a token begins there; first is the text's first byte, before which nothing is seen."""
    own = data[begin:end]
    letter = _LETTER[own]
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[0] &= begin > first and _LETTER[data[begin - 1]]
    return ((own & 0xC0) != 0x80) & ~inside


def chunk_counts(data: np.ndarray, offsets: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """The first chunk of each text (one more entry at the end), and the running count of beginnings before each chunk."""
    sizes = np.diff(offsets)
    per_text = -(-sizes // chunk)
    first = np.concatenate([[0], np.cumsum(per_text)])
    number = np.arange(first[-1]) - np.repeat(first[:-1], per_text)
    edges = np.repeat(offsets[:-1], per_text) + number * chunk
    running = np.zeros(len(edges) + 1, np.int64)
    if len(edges):
        # All chunks of the batch at once: one predicate over the bytes, texts' first bytes set apart, summed by chunk.
        marks = beginnings(data, int(offsets[0]), int(offsets[-1]), int(offsets[0]))
        marks[edges[number == 0] - offsets[0]] = True
        np.cumsum(np.add.reduceat(marks, edges - offsets[0], dtype=np.int64), out=running[1:])
    return first, running


def place_of(rank: int, text: int, data: np.ndarray, offsets: np.ndarray, first: np.ndarray, running: np.ndarray, chunk: int) -> int:
    """The byte at which the token of this rank begins in the text (its end for the rank after the last)."""
    lo, hi = first[text], first[text + 1]
    goal = running[lo] + rank
    if goal >= running[hi]:
        return int(offsets[text + 1])
    owner = int(np.searchsorted(running[lo : hi + 1], goal, side="right")) - 1 + lo
    begin = int(offsets[text] + (owner - lo) * chunk)
    inside = np.flatnonzero(beginnings(data, begin, min(begin + chunk, int(offsets[text + 1])), int(offsets[text])))
    return begin + int(inside[goal - running[owner]])


def cut(texts: list[bytes], plain: list[bool], spm: list[bool], h1: np.ndarray, h2: np.ndarray, marks: tuple[bytes, bytes, bytes], chunk: int) -> tuple[list, list, list, list]:
    """n, prefix and middle length in code points (None: plain), and output bytes of each text."""
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    first, running = chunk_counts(data, offsets, chunk)
    n = running[first[1:]] - running[first[:-1]]
    ranks = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    mark_p, mark_s, mark_m = marks
    prefixes, middles, out = [], [], []
    for i in range(len(texts)):
        if plain[i]:
            prefixes.append(None)
            middles.append(None)
            out.append(texts[i])
            continue
        a, d = int(offsets[i]), int(offsets[i + 1])
        b, c = (place_of(int(r), i, data, offsets, first, running, chunk) for r in ranks[:, i])
        prefix, middle, suffix = data[a:b], data[b:c], data[c:d].tobytes()
        prefixes.append(int(np.count_nonzero((prefix & 0xC0) != 0x80)))
        middles.append(int(np.count_nonzero((middle & 0xC0) != 0x80)))
        prefix, middle = prefix.tobytes(), middle.tobytes()
        out.append(b"".join([mark_s, suffix, mark_p, prefix, mark_m, middle] if spm[i] else [mark_p, prefix, mark_s, suffix, mark_m, middle]))
    return n.tolist(), prefixes, middles, out


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, chunk: int = CHUNK) -> DataFrame:
    """docs' columns and n (tokens), form (plain, psm, spm), prefix_chars, middle_chars, fim_text."""
    ship(docs.sparkSession)
    made = StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, fim_text string")
    results = made.names
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    body = text_of(text)
    at = fresh(docs, "__text", "__digest")
    rows = docs.withColumn(at[0], body).withColumn(at[1], digest)
    h = [F.conv(F.substring(at[1], 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    stays = (F.col(at[0]) == "") | (h[2] % 100 >= 100 - plain)
    for mark in marks:
        stays |= F.contains(F.col(at[0]), F.lit(mark))
    kept = [c for c in docs.columns if c.lower() not in results]
    rows = rows.select(*kept, F.col(at[0]).alias("__t"), stays.alias("__plain"), (h[3] % 100 < suffix_first).alias("__spm"), h[0].alias("__h1"), h[1].alias("__h2"))
    marked = tuple(m.encode() for m in marks)
    width = len(kept)

    def work(batches):
        from weftline.llm import fill_middle

        for batch in batches:
            texts = batch.column(width).cast(pa.binary()).to_pylist()
            begin = 0
            while begin < batch.num_rows:
                end, held = begin, 0
                while end < batch.num_rows and (end == begin or held + len(texts[end]) <= fill_middle.BATCH_BYTES):
                    held += len(texts[end])
                    end += 1
                part = batch.slice(begin, end - begin)
                flags = [part.column(width + k).to_pylist() for k in (1, 2)]
                hashes = [np.array(part.column(width + k).to_pylist(), np.int64) for k in (3, 4)]
                n, prefixes, middles, out = fill_middle.cut(texts[begin:end], *flags, *hashes, marked, chunk)
                form = ["plain" if p else "spm" if s else "psm" for p, s in zip(*flags, strict=True)]
                columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *columns], [*kept, *results])
                begin = end

    return rows.mapInArrow(work, StructType(rows.select(*kept).schema.fields + made.fields))


def restored(text: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made from. A mark stands once in an output that is not plain, as texts that hold one
    stay plain and marks begin and end with characters that occur nowhere else in them."""
    parts = F.split(text, "|".join(re.escape(m) for m in marks), -1)
    piece = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", text).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(F.concat(piece(1), piece(3), piece(2)))
