"""Periodic runs, nearest neighbours and fill-in-middle against brute force."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from weftline.llm import cross_polytope, fill_middle, oracles, periodic_runs, queries

# ---- periodic runs


def runs_by_definition(words):
    """Each maximal stretch of each period, with its smallest period checked word by word."""
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            run = words[i : j + p]
            if len(run) >= max(6, 4 * p) and not any(all(run[k] == run[k + q] for k in range(len(run) - q)) for q in range(1, p)):
                out.append((i, len(run), p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]


def test_runs_of_random_texts_match_the_definition(monkeypatch):
    rnd = random.Random(5)
    texts = []
    for _ in range(300):
        out = []
        while len(out) < rnd.randint(0, 160):
            unit = [rnd.choice("abc"[: rnd.randint(1, 3)]) for _ in range(rnd.randint(1, 9))]
            out += unit * rnd.choice([1, 1, 2, 4, 5, 9]) + unit[: rnd.randint(0, len(unit))]
        texts.append(out)
    for chunk in (1, 3, 1024):
        monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
        for (runs, rest), words in zip(periodic_runs.runs_of([" ".join(t).encode() for t in texts]), texts, strict=True):
            assert runs == runs_by_definition(words), words
            assert rest.decode().split() == collapsed(words, runs)


def test_runs_of_hundreds_of_thousands_of_words_take_seconds():
    rnd = random.Random(1)
    hard = {
        "one word": ["x"] * 400_000,
        "two words at random": [rnd.choice("ab") for _ in range(100_000)],
        "every second word alike": [w for i in range(150_000) for w in ("a", str(i))],
        "long period": [str(i % 50_000) for i in range(250_000)],
    }
    for name, words in hard.items():
        began = time.perf_counter()
        ((runs, _),) = periodic_runs.runs_of([" ".join(words).encode()])
        assert time.perf_counter() - began < 20, name
        if name == "one word":
            assert runs == [(0, 400_000, 1)]
        if name == "long period":
            assert runs == [(0, 250_000, 50_000)]
        if name == "every second word alike":
            assert runs == []


def test_periodic_runs_query_matches_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    for row in docs:
        words = [w.decode() for w in (row["text"] or "").encode().split()]
        h, n = zlib.crc32(str(row["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1500:
            continue
        runs, mine = runs_by_definition(words), got[row["doc_id"]]
        assert mine["n_runs"] == len(runs)
        assert mine["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert mine["collapsed_sha256"] == hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        assert (mine["start"], mine["length"], mine["period"]) == best
        assert mine["exponent_milli"] == (best[0] if best[0] is None else 1000 * best[1] // best[2])


def test_periodic_runs_of_odd_rows(spark):
    rows = [(1, None, "k", 7), (None, "", "k", 7), (2, " \t\n ", None, 7), (3, "a a a a a a", "k", None), (3, "a a a a a a", "k", None), (4, "a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca", "é", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text string, N_runs int")
    out = periodic_runs.collapse(docs)
    assert out.columns == ["doc_id", "text", "__text", "n_runs", "longest", "runs", "collapsed_text"]
    got = sorted(((r["doc_id"], r["n_runs"], r["longest"] and tuple(r["longest"]), r["collapsed_text"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, 0, None, ""), (None, 0, None, ""), (2, 0, None, ""), (3, 1, (0, 6, 1), "a"), (3, 1, (0, 6, 1), "a"), (4, 1, (0, 6, 1), "a\x1ca")], key=repr)
    assert periodic_runs.collapse(docs.limit(0)).count() == 0


# ---- fill-in-middle


def middle_by_definition(doc_id, text):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_matches_plain_python_for_all_chunk_sizes(spark):
    rnd = random.Random(3)
    parts = ["word", "é", "日本", "x", " ", "\n", "\0", "<P", "S>", "<", "ß9", "A" * 50, "🙂"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 2, 30, 400])))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "a<M>b"), (1003, "same"), (1003, "same"), (1004, "long text, " * 100_000), (1005, "a" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((i, *middle_by_definition(i, t or "")) for i, t in rows), key=repr)
    for chunk in (1, 7, 4096):
        use = docs if chunk > 7 else docs.filter("length(text) < 5000 or text is null")
        out = fill_middle.transform(use, chunk=chunk).withColumn("back", fill_middle.restored(F.col("fim_text"), F.col("form"))).collect()
        got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["fim_text"]) for r in out), key=repr)
        assert got == [w for w in want if chunk > 7 or w[0] < 1004]
        assert all(r["back"] == (r["text"] or "") for r in out)


def test_fill_middle_of_odd_rows_and_own_marks(spark):
    docs = spark.createDataFrame([(None, "some text here", 1, "x"), (5, "text [m] inside", None, None)], "doc_id long, body string, __text int, form string")
    out = fill_middle.transform(docs, text="body", marks=("[p]", "[s]", "[m]"), plain=0)
    assert out.columns == ["doc_id", "body", "__text", "n", "form", "prefix_chars", "middle_chars", "fim_text"]
    got = {r["doc_id"]: r for r in out.withColumn("back", fill_middle.restored(F.col("fim_text"), F.col("form"), ("[p]", "[s]", "[m]"))).collect()}
    assert got[5]["form"] == "plain" and got[5]["fim_text"] == "text [m] inside"
    assert got[None]["form"] != "plain" and got[None]["back"] == "some text here"
    assert fill_middle.transform(docs.limit(0), text="body").count() == 0


def test_sql_of_runs_and_middle(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    for query in (queries.op11_periodic_runs, queries.op13_fill_middle):
        df = query(spark, sf)
        names = sorted(df.columns)
        want = con.execute(f"select {', '.join(names)} from ({oracles.SQL[query.__name__]})").fetchall()
        assert sorted(map(tuple, df.select(names).collect()), key=repr) == sorted(want, key=repr)


# ---- nearest neighbours


def exact(ids, x, asked, k):
    out = {}
    for q in np.flatnonzero(asked):
        d = cross_polytope.squares(np.broadcast_to(x[q], x.shape), x)
        order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(np.sqrt(d[i]))) for i in order]
    return out


def recall(found, want):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        assert [s for _, _, s in mine] == sorted(s for _, _, s in mine)
        hits += len({v for _, v, _ in mine} & {v for v, _ in near})
    return hits / sum(map(len, want.values()))


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


def test_hadamard_keeps_lengths_and_buckets_come_first_among_probes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 24))
    wide = np.zeros((50, 32))
    wide[:, :24] = x
    assert np.allclose(np.linalg.norm(cross_polytope.hadamard(wide), axis=1), np.linalg.norm(x, axis=1))
    for buckets in (1, 2, 16, 64, 256, 4096):
        table = cross_polytope.Table(0, 24, cross_polytope.widths(buckets, 32))
        every = int(np.prod([2 * m for m in table.shape]))
        visits = table.probes(x, every)
        assert (visits[:, 0] == table.buckets(x)).all()
        assert all(sorted(v) == list(range(every)) for v in visits.tolist())


def test_neighbours_of_the_driver_table(spark):
    sf = "/root/testdata/sf0.1"
    table = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by vec_id").fetchnumpy()
    ids, x = table["vec_id"], np.array([np.asarray(v, np.float64) for v in table["embedding"]])
    want = exact(ids, x, ids % 100 == 0, 10)
    found = queries.op12_nearest(spark, sf).collect()
    assert recall(found, want) >= 0.9
    place = {int(i): n for n, i in enumerate(ids)}
    for r in found:
        a, b = x[place[r["query_id"]]], x[place[r["vec_id"]]]
        assert r["score"] == float(np.sqrt(cross_polytope.squares(a[None], b[None])[0]))


def test_neighbours_in_clusters_with_probes_blocks_and_a_hot_group(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 20)) * 3
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 20)) * 0.4
    x[:2000] = centres[0] + rng.normal(size=(2000, 20)) * 0.01
    x[2000:3000] = x[2000]
    x *= rng.uniform(0.999, 1.001, (6000, 1))
    x[2000:3000] = x[2000]
    ids = rng.permutation(6000) * 3
    monkeypatch.setattr(cross_polytope, "ROW_BLOCK", 500)
    monkeypatch.setattr(cross_polytope, "QUERY_BLOCK", 7)
    fits = []
    fit = cross_polytope.fit
    monkeypatch.setattr(cross_polytope, "fit", lambda *a: fits.append(fit(*a)) or fits[-1])
    found = cross_polytope.nearest(frame(spark, ids, x), F.col("vec_id") % 100 == 0, id="vec_id").collect()
    want = exact(ids, x, ids % 100 == 0, 10)
    shape, probes = fits[0]
    assert shape and probes < np.prod([2 * m for m in shape])
    assert recall(found, want) >= 0.9
    # Among equal vectors the nearest are known without doubt: the smallest ids.
    copies = set(ids[2000:3000].tolist())
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in copies & set(got):
        assert [v for _, v in sorted(got[q])] == [v for v, _ in want[q]]


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [1e-200, 1e-200]), (11, [1e150, 1e150])]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, x int, t string")
    got = [tuple(r) for r in cross_polytope.nearest(vectors, F.col("vec_id") < 2, id="vec_id").orderBy("query_id", "rank").collect()]
    root5 = 5.0**0.5
    far = float(np.sqrt((1e150 - 1.0) ** 2 + 1e150**2))
    assert got == [(0, 1, 1, 0.0), (0, 2, 10, 1.0), (0, 3, 2, root5), (0, 4, 11, far), (1, 1, 0, 0.0), (1, 2, 10, 1.0), (1, 3, 2, root5), (1, 4, 11, far)]
    assert cross_polytope.nearest(vectors.limit(0), F.col("vec_id") < 2, id="vec_id").count() == 0
    assert cross_polytope.nearest(vectors, F.col("vec_id") > 99, id="vec_id").count() == 0
