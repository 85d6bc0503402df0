"""The operators and the pipeline's stages on null, empty, repeated and very long rows, empty tables and clashing columns."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from weftline.llm import exact_dedup, hyperminhash, media, mixing, repeated_windows, toxicity, url_templates

LONG = " ".join(f"w{i * 7919 % 20011}" for i in range(20_000))
ROWS = [
    (1, "a b c d e f", "s", 6),
    (1, "a b c d e f", "s", 6),
    (2, "a b c d  e f", "s", 6),
    (None, "some other words stand here", "s", 6),
    (None, "some other words stand here", "s", 6),
    (3, None, None, 6),
    (4, "", "t", 6),
    (5, LONG, "t", len(LONG)),
    (6, LONG + " more", "u", len(LONG) + 5),
    (None, None, None, None),
    (7, "é " * 300, "v", 600),
]
CLASH = "__key __sha __text __row __epoch __slot label number score taken size kept component_id".split()


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, n_chars long").selectExpr("*", "cast(null as string) as lang")
    for c in CLASH:
        df = df.selectExpr("*", f"cast('x' as string) as `{c}`")
    return df


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, docs, folder, name, stage):
    out = stage(spark, docs, folder)
    rows = out.collect()
    if name != "bpe":
        assert out.columns == docs.columns
        assert all(r["number"] == "x" for r in rows)
    texts = Counter((r["doc_id"], r["text"]) for r in rows) if name != "bpe" else None
    if name == "toxicity":
        assert len(rows) == len(ROWS)
    if name == "exact_dedup":
        assert texts == Counter([(1, "a b c d e f"), (None, "some other words stand here"), (3, None), (5, LONG), (6, LONG + " more"), (7, "é " * 300)])
    if name == "near_dedup":
        # Texts without words have no copies; of the two long ones, near copies of each other, the smaller id stays.
        assert texts == Counter([(1, "a b c d e f"), (None, "some other words stand here"), (3, None), (4, ""), (None, None), (5, LONG), (7, "é " * 300)])
    if name == "bpe":
        assert len(rows) == len(ROWS)
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_long_texts_are_cut_at_every_part(spark):
    """The mix of one long text and a short one in sources whose weights force cuts far inside the text."""
    df = spark.createDataFrame([(1, LONG, "a"), (2, "x y z", "b"), (3, LONG.replace(" ", "\t"), "c")], "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    got = Counter()
    for r in mixing.apply(df).collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert {1: LONG, 2: "x y z", 3: LONG.replace(" ", "\t")}[r["doc_id"]].startswith(r["text"])
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_operators_take_clashing_columns(spark, docs):
    assert hyperminhash.near_duplicates(docs).count() == len(ROWS)
    assert exact_dedup.groups(docs).count() == len(ROWS)
    assert mixing.mix(docs.drop("size", "taken")).count() == len(ROWS)
    assert repeated_windows.repeated_windows(docs).count() == len(ROWS)
    assert toxicity.score(docs, toxicity.Lexicon()).count() == len(ROWS)
    pages = spark.createDataFrame([(None, "http://a.org/x", 1), (1, None, 2), (1, "http://b.com/de/" + "y/" * 3000, 3), (1, "http://b.com/de/" + "y/" * 3000, 3)], "page_id long, url string, host int")
    assert Counter((r["page_id"], r["rule"], r["verdict"]) for r in url_templates.judge(pages).collect()) == Counter({(None, "org/", "allow"): 1, (1, "com/de/", "block"): 2, (1, None, "allow"): 1})


def test_images_that_repeat(spark):
    image = media.write_pgm(media.resize(np.random.default_rng(4).random((20, 20)) * 255, 120, 120))
    df = spark.createDataFrame([(3, bytearray(image), 1), (3, bytearray(image), 1), (None, bytearray(image), 1), (None, None, 1)], "id long, image binary, pixels int")
    assert Counter((r["id"], r["class_id"], r["n_links"]) for r in media.copies(df).collect()) == Counter({(3, 3, 0): 2, (None, 3, 0): 1, (None, None, 0): 1})
