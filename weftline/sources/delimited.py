"""Delimited text: dialect detection on a bounded sample, a strict scan, repeated headers, and guarded appends."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.quality import formula_like

DELIMITERS = (",", ";", "\t", "|")
#: Weights and limits of the dialect's score.
CONSISTENCY, WIDTH, DENSITY = 0.82, 0.12, 0.06
SINGLE_COMMA, SINGLE_OTHER, ONE_ROW = 0.58, 0.30, 0.62
LEAST_SCORE, NEAR = 0.55, 0.015
SAMPLE_CHARACTERS, SAMPLE_ROWS = 65_536, 80


class AmbiguousDialect(ValueError):
    pass


def dialects(samples: DataFrame) -> DataFrame:
    """samples (name, sample) by delimiter: rows, width (the most common number of cells), steady (the share of rows that
    have it), dense (mean share of filled cells), score, reading (a hash of the cells, equal where two delimiters read alike).

    Quoted text counts as one filled cell character, whatever it holds, so the cells are counted by plain splits; any
    number of files is profiled at once.
    """
    text = F.regexp_replace(F.left("sample", F.lit(SAMPLE_CHARACTERS)), r'"\s*+"', " ")
    lines = F.slice(F.split(F.regexp_replace(text, r'"(?:[^"]|"")++"', "q"), r"\r\n|\n|\r"), 1, SAMPLE_ROWS)
    each = samples.select("name", F.posexplode(lines).alias("row", "line"))
    each = each.select("*", F.posexplode(F.array(*map(F.lit, DELIMITERS))).alias("place", "delimiter"))
    each = each.withColumn("cells", F.split("line", F.concat(F.lit("\\Q"), "delimiter", F.lit("\\E"))))
    each = each.withColumn("filled", F.size(F.filter("cells", lambda c: F.trim(c) != ""))).filter("filled > 0")
    key = ["name", "place", "delimiter"]
    widths = each.groupBy(*key, F.size("cells").alias("width")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("row").alias("seen"),
        F.sum(F.col("filled") / F.size("cells")).alias("full"),
        F.bit_xor(F.xxhash64("row", "cells")).alias("reading"),
    )
    total = F.sum("n")
    found = widths.groupBy(*key).agg(
        total.alias("rows"),
        F.max_by("width", F.struct("n", -F.col("seen"))).alias("width"),
        (F.max("n") / total).alias("steady"),
        (F.sum("full") / total).alias("dense"),
        F.bit_xor("reading").alias("reading"),
    )
    many = CONSISTENCY * F.col("steady") + WIDTH * F.least("width", F.lit(8)) / 8 + DENSITY * F.col("dense")
    single = F.when((F.col("delimiter") == ",") & (F.col("steady") == 1), SINGLE_COMMA).otherwise(SINGLE_OTHER)
    alone = F.when(F.col("width") > 1, ONE_ROW).otherwise(0.0)
    return found.withColumn("score", F.when(F.col("rows") == 1, alone).when(F.col("width") == 1, single).otherwise(many))


def chosen(profiles: DataFrame) -> DataFrame:
    """For each name of dialects(): delimiter and problem (null, irregular or ambiguous)."""
    order = F.struct(F.col("score"), -F.col("place"), "delimiter", "reading", "width")
    ranked = profiles.groupBy("name").agg(F.slice(F.sort_array(F.collect_list(order), asc=False), 1, 2).alias("best"))
    first, second = F.col("best")[0], F.try_element_at("best", F.lit(2))
    near = (first["score"] - second["score"] < NEAR) & (first["reading"] != second["reading"]) & (first["width"] > 1)
    problem = F.when(first["score"] < LEAST_SCORE, "irregular").when(F.coalesce(near, F.lit(False)), "ambiguous")
    return ranked.select("name", first["delimiter"].alias("delimiter"), problem.alias("problem"))


def detect_delimiter(spark: SparkSession, sample: str) -> str:
    """The best delimiter of a sample; refused when none is regular enough or two read it differently and score alike."""
    found = chosen(dialects(spark.createDataFrame([("sample", sample)], "name string, sample string").coalesce(1))).first()
    if found is None or found["problem"]:
        raise AmbiguousDialect(found["problem"] if found else "no rows")
    return found["delimiter"]


def header_names(cells: list[str | None]) -> list[str]:
    """Distinct names: a blank is column_i, the k-th repeat of a name has [k]."""
    seen: dict[str, int] = {}
    out = []
    for i, cell in enumerate(cells, 1):
        name = (cell or "").strip() or f"column_{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} [{seen[name]}]")
    return out


def breaks_lines(lines: DataFrame) -> bool:
    """Whether a quoted cell goes over a line's end: then some line has an odd number of quotes."""
    return bool(lines.filter(F.regexp_count("value", F.lit('"')) % 2 == 1).limit(1).count())


def _ends(line: str, inside: bool, sep: str) -> bool:
    """Whether a line ends within a quoted cell, if it begins within one or not. Quotes open a cell at its beginning only."""
    at = 0
    while True:
        if inside or line[at : at + 1] == '"':
            at += not inside
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if line[at + 1 : at + 2] != '"':
                    break
                at += 2
            inside = False
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def records(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> DataFrame:
    """record and leads (the first of its file): the records of delimited files whose quoted cells may hold line ends, read by ranges.

    Whether a range begins within a quoted cell depends on all ranges before. So each range first says, for both cases, how it
    would end; these answers, one row for each range, are composed along the file. Then each range puts its lines together to
    records, and hands on the pieces of those that go over its borders, at most two.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path).select(*where, "value")
    ends = _ends

    def runs(batch):
        """Slices of a batch that lie in one range."""
        import pyarrow.compute as pc

        files, starts = batch.column(0), batch.column(1)
        same = pc.and_(pc.equal(files.slice(1), files.slice(0, len(files) - 1)), pc.equal(starts.slice(1), starts.slice(0, len(starts) - 1))).to_pylist() if batch.num_rows > 1 else []
        edges = [0, *(i + 1 for i, x in enumerate(same) if not x), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                yield (files[a].as_py(), starts[a].as_py()), batch.slice(a, b - a)

    def both(batches):
        import pyarrow as pa

        key, out, inn = None, False, True
        row = lambda: pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "out": out, "inn": inn}], pa.schema([("file", pa.string()), ("start", pa.int64()), ("out", pa.bool_()), ("inn", pa.bool_())]))
        for batch in batches:
            for own, part in runs(batch):
                if own != key:
                    if key is not None:
                        yield row()
                    key, out, inn = own, False, True
                for line in part.column(2).to_pylist():
                    if '"' in line:
                        out, inn = ends(line, out, sep), ends(line, inn, sep)
        if key is not None:
            yield row()

    ranges = lines.mapInArrow(both, "file string, start long, out boolean, inn boolean")
    # One row for each range of the input, folded along each file.
    each = F.array_sort(F.collect_list(F.struct("start", "out", "inn")))
    begin = F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<start:long,inside:boolean>>").alias("found"))
    step = lambda acc, r: F.struct(F.when(acc["inside"], r["inn"]).otherwise(r["out"]).alias("inside"), F.concat(acc["found"], F.array(F.struct(r["start"].alias("start"), acc["inside"].alias("inside")))).alias("found"))
    settled = ranges.groupBy("file").agg(each.alias("r")).select("file", F.explode(F.aggregate("r", begin, step)["found"]).alias("f")).select("file", "f.start", "f.inside")

    def whole(batches):
        import pyarrow as pa

        key, inside, held, lead, first = None, False, [], False, False
        rows: list[tuple] = []

        def batch_of():
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "start", "kind", "record", "leads"])
            rows.clear()
            return made

        for batch in batches:
            states = batch.column(3)
            at = 0
            for own, part in runs(batch):
                if own != key:
                    if held:
                        rows.append((*key, "head" if lead else "tail", "\n".join(held), first))
                    key, held = own, []
                    inside = lead = states[at].as_py()
                    first = own[1] == 0
                at += part.num_rows
                for line in part.column(2).to_pylist():
                    held.append(line)
                    if inside or '"' in line:
                        inside = ends(line, inside, sep)
                    if not inside:
                        rows.append((*key, "end" if lead else "whole", "\n".join(held), first))
                        held, lead, first = [], False, False
            yield batch_of()
        if held:
            rows.append((*key, "head" if lead else "tail", "\n".join(held), first))
        yield batch_of()

    known = lines.join(F.broadcast(settled), ["file", "start"]).select("file", "start", "value", "inside")
    pieces = known.mapInArrow(whole, "file string, start long, kind string, record string, leads boolean")
    parts = pieces.filter("kind <> 'whole'")
    # A record that is cut begins with a tail, goes over heads (ranges within it), and stops with an end.
    number = F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(W.partitionBy("file").orderBy("start", F.when(F.col("kind") == "tail", 1).otherwise(0)))
    joined = parts.withColumn("n", number).groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("start", "record", "leads"))).alias("p"))
    cut = joined.select(F.array_join(F.col("p.record"), "\n").alias("record"), F.col("p")[0]["leads"].alias("leads"))
    return pieces.filter("kind = 'whole'").select("record", "leads").unionByName(cut).withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def read(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8", skip_repeated_headers: bool = True, multi_line: bool | None = None) -> DataFrame:
    """Records as text columns c1..cn with their header names in the columns' metadata; blanks are null, blank rows skipped,
    short rows padded. Rows longer than the header fail the job that reads them.

    multi_line: whether quoted cells may hold line ends; None: found by a pass over all lines. Such files are read by ranges too.
    """
    lines = spark.read.option("encoding", encoding).text(path)
    sample = "\n".join(r[0] for r in lines.limit(SAMPLE_ROWS).collect()).lstrip("\ufeff")
    sep = delimiter or detect_delimiter(spark, sample)
    multi_line = breaks_lines(lines) if multi_line is None else multi_line
    header = next(csv.reader(io.StringIO(sample), delimiter=sep))
    names = header_names(header)
    ids = [f"c{i}" for i in range(1, len(names) + 1)]
    schema = ", ".join(f"`{c}` string" for c in [*ids, "__more"])
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}
    if multi_line:
        rows = records(spark, path, sep, encoding).filter("not leads").select(F.from_csv("record", F.lit(schema), options).alias("r")).select("r.*")
    else:
        rows = spark.read.schema(schema).options(**options).option("encoding", encoding).option("header", True).option("enforceSchema", True).csv(path)
    rows = rows.withColumn("__wide", F.when(F.col("__more").isNotNull(), F.raise_error(F.lit("a row is longer than the header"))))
    cells = [F.when(F.trim(c) == "", F.lit(None)).otherwise(F.col(c)).alias(c) for c in ids]
    filled = rows.filter(F.col("__wide").isNull()).select(*cells).filter(~_all_blank(ids))
    if skip_repeated_headers:
        filled = filled.filter(~repeated_header(ids, names))
    return filled.select(*[F.col(c).alias(c, metadata={"name": n}) for c, n in zip(ids, names, strict=True)])


def _all_blank(ids: list[str]) -> Column:
    out = F.lit(True)
    for c in ids:
        out = out & F.col(c).isNull()
    return out


def plain_cell(c: Column) -> Column:
    """Letters and digits in lower case, all else single blanks; made without Python, as every row is asked."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def repeated_header(ids: list[str], names: list[str]) -> Column:
    """Whether a row repeats the header: two cells or more to compare, and four fifths of them equal the names."""
    comparable, equal = F.lit(0), F.lit(0)
    for c, n in zip(ids, names, strict=True):
        name = n.split(" [", 1)[0]
        # Cells without the name's first word are no match, which is cheaper to see than to normalise each cell.
        word = next(iter(re.findall(r"[^\W_]+", name.lower())), "")
        comparable = comparable + F.when(F.col(c).isNotNull(), 1).otherwise(0)
        equal = equal + F.when(F.lower(c).contains(word) & (plain_cell(F.col(c)) == plain_cell(F.lit(name))), 1).otherwise(0)
    return (comparable >= 2) & (equal >= 0.8 * comparable)


def append(df: DataFrame, path: str, allow_formulas: bool = False, delimiter: str = ",") -> None:
    """Appends df's rows as files of their own, all or none; texts that a spreadsheet would run are refused before writing."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not allow_formulas and texts:
        bad = F.lit(False)
        for c in texts:
            bad = bad | F.coalesce(formula_like(F.col(c)), F.lit(False))
        if df.filter(bad).limit(1).count():
            raise ValueError("a value looks like a formula")
    df.write.mode("append").option("header", True).option("sep", delimiter).option("escape", '"').csv(path)
