"""Delimited files with quoted line ends, read by ranges, against the csv module."""

import csv
import random

import pytest

from weftline.sources import delimited


def _file(path, seed, rows, newline="\n"):
    rnd = random.Random(seed)
    cells = ["x", "", "two words", 'say "hi"', "line\nend", 'a "b",\n"c', "semi;colon", "comma, here", "long\n\n\n" + "y" * 90, "é日"]
    data = [[str(i), *[rnd.choice(cells) for _ in range(3)]] for i in range(rows)]
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator=newline)
        out.writerow(["id", "first text", "second text", "third text"])
        out.writerows(data)
        # A quote within a cell that is not quoted is a character like others.
        f.write(f'{rows},5" pipe,b,c{newline}')
    return sorted([tuple(c if c.strip() else None for c in r) for r in [*data, [str(rows), '5" pipe', "b", "c"]]], key=repr)


@pytest.mark.parametrize(("split", "newline"), [(64, "\n"), (257, "\r\n"), (1 << 20, "\n")])
def test_ranges_equal_the_csv_module(spark, tmp_path, split, newline):
    want = _file(tmp_path / "a.csv", 1, 300, newline)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = delimited.read(spark, str(tmp_path), delimiter=",")
        assert sorted(map(tuple, df.collect()), key=repr) == want
        if split < 1000:
            assert delimited.records(spark, str(tmp_path), ",").rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_many_files_have_a_header_each(spark, tmp_path):
    want = [*_file(tmp_path / "a.csv", 2, 40), *_file(tmp_path / "b.csv", 3, 50)]
    df = delimited.read(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    assert df.schema[1].metadata == {"name": "first text"}


@pytest.mark.parametrize(("line", "inside", "ends"), [("a,b", False, False), ('"a', False, True), ('a"', True, False), ('a""', True, True), ('a"",b', True, True), ('a",b"c', True, False), ('a","c', True, True), ('x"y,z', False, False), ('""', False, False), ('"""', False, True), ("", True, True)])
def test_state_of_a_line(line, inside, ends):
    assert delimited._ends(line, inside, ",") is ends
