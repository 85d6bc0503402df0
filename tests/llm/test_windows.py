"""Repeated windows against brute force."""

import hashlib
from collections import Counter

import pytest

from weftline.llm import queries, repeated_windows


def brute(texts, depth):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + depth] for r in raws for i in range(len(r) - depth + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - depth + 1):
            if seen[r[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in docs], brute([r["text"] for r in docs], 200), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op8_repeated_windows(spark, sf).collect()}
    assert got == want
    assert any(r[1] for r in want.values())


def test_odd_texts(spark):
    passage = "0123456789abcdefghijklmnopqrst"
    texts = [None, "", "short", "x" * 90, "ab" * 60, passage + "é" + passage, "1" + passage, passage[:-1] + "?", passage + "é" + passage, "é" * 40, "zz" + "é" * 40]
    df = spark.createDataFrame([(None if i % 3 == 0 else i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    rows = repeated_windows.repeated_windows(df, depth=20, gram=6, depths=(17, 20)).collect()
    got = Counter((r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows)
    assert got == Counter(brute(texts, 20))
    assert repeated_windows.repeated_windows(df.limit(0)).count() == 0
