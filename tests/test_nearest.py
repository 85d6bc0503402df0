"""Exact nearest vectors with cells left out, against the product of all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import nearest


def want(ids, x, k, digits=6):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    out = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = np.round(u[i] @ u.T, digits)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), int(ids[j]), float(s[j])) for j in order]
    return sorted(out)


@pytest.mark.parametrize(("spread", "cell_rows", "row_block", "query_block"), [(0.05, 100, 16_384, 16_384), (0.05, 50, 64, 3), (9.0, 100, 300, 16_384), (0.05, 10_000, 16_384, 16_384)])
def test_equal_to_the_product_of_all(spark, monkeypatch, spread, cell_rows, row_block, query_block):
    monkeypatch.setattr(nearest, "ROW_BLOCK", row_block)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)] + spread * rng.normal(size=(1500, 16))
    x[:40] = x[0]
    x[100:103] = 0
    ids = rng.permutation(1500)
    df = spark.createDataFrame([(int(i), v.tolist(), "t") for i, v in zip(ids, x, strict=True)] + [(5000, None, "t")], "vec_id long, v array<double>, extra string")
    met = nearest.topk(df, F.col("vec_id") % 20 == 0, "vec_id", "v", cell_rows=cell_rows)
    got = sorted((r["query_id"], r["vec_id"], abs(r["score"]) if r["score"] == 0 else r["score"]) for r in met.found.collect())
    expected = want(ids, x, 4)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected]
    assert np.allclose([s for _, _, s in got], [s for _, _, s in expected], atol=1.1e-6)
    if spread < 1 and cell_rows <= 100:
        # Twelve clusters: most cells cannot beat what a query has found near by.
        assert met.compared < 0.5 * met.pairs


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0])], "vec_id long, v array<double>")
    assert sorted(map(tuple, nearest.topk(df, F.col("vec_id") % 20 == 0, "vec_id", "v").found.collect())) == [(0, 20, 0.0), (20, 0, 0.0)]
    assert nearest.topk(df.limit(0), F.col("vec_id") % 20 == 0, "vec_id", "v").found.count() == 0
