"""URL templates, near duplicates, BPE, image copies, toxicity and the pipeline."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import bpe_automaton, hyperminhash, media, mixing, queries, toxicity, url_templates


# ---- url templates

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def split_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c < "\x80" else c for c in m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    found = []
    for rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            found.append(rule)
    return max(found, key=len) if found else None


def test_urls(spark):
    sf = "/root/testdata/sf0.01"
    urls = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.op1_url_templates(spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = split_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule_of(host, path))
        assert r["verdict"] == (RULES[r["rule"]] if r["rule"] else r["verdict"]) and r["verdict"] in ("allow", "block")


def test_odd_urls(spark):
    urls = [None, "", "nothing", "://", "http://", "HTTP://A.Example.ORG/es/x?q=http://b/c#d", "x://h#f/g", "a://b://c/d", "http://É.org/", "http://example.org/en/1", "http://xorg/en", "http://u@org/a\nb"] * 2
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = url_templates.judge(df).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = split_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule_of(host, path))
    assert url_templates.judge(df.limit(0)).count() == 0


def test_templates_merge_and_reject(spark):
    rows = [(i, f"http://h.net/user/{w}/post") for i, w in enumerate(f"name{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200))]
    rows += [(1000 + i, f"http://h.net/spam/{i}.html") for i in range(50)] + [(2000 + i, f"http://h.net/good/{i}") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.filter("page_id >= 1000 and page_id % 2 = 0").selectExpr("page_id", "page_id < 2000 as blocked")
    got = defaultdict(set)
    for r in url_templates.judge(pages, labels=labels).collect():
        got[r["template"]].add(r["verdict"])
    assert got == {"/user/*/post": {"allow"}, "/spam/{n}.html": {"block"}, "/good/{n}": {"allow"}}


def test_alike_branches_merge_in_small_nodes(spark):
    """Eight sections of two blocked pages each: none is telling alone, merged they are; one section that differs stays apart."""
    rows = [(10 * k + j, f"http://h.net/s{chr(97 + k)}/{j}") for k in range(8) for j in range(3)]
    rows += [(1000 + j, f"http://h.net/fine/{j}") for j in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.filter("page_id % 10 < 2 or page_id >= 1000").selectExpr("page_id", "page_id < 1000 as blocked")
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in url_templates.judge(pages, rules=(), labels=labels).collect()}
    assert got[2] == got[72] and got[2][1] == "block" and got[2][0].startswith("/*")
    assert got[1005] == ("/fine/{n}", "allow")


def brute_templates(rows, labels, reject_at=0.8, smoothing=4.0):
    """verdicts of rows (page_id, host, segments after shape()) without rules, level by level."""
    deep = [(p, h, s[:4] + ["/".join(s[4:])] if len(s) > 4 else s) for p, h, s in rows]
    template = {p: "" for p, _, _ in deep}
    for level in range(5):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for p, h, s in deep:
            if len(s) > level:
                b = nodes[h, template[p]][s[level]]
                b[0] += 1
                b[1] += p in labels
                b[2] += labels.get(p, False)
        wild = {}
        for key, branches in nodes.items():
            known, bad = sum(b[1] for b in branches.values()), sum(b[2] for b in branches.values())
            labelled = sum(b[1] > 0 for b in branches.values())
            share = bad / known if known else None
            sides = {}
            for name, (_, k, x) in branches.items():
                if not k:
                    sides[name] = "?"
                    continue
                off = (x - share * k) / (max(share * (1 - share), 0.01) * k) ** 0.5
                bound = (2 * np.log(2.0 * labelled)) ** 0.5
                sides[name] = "+" if off > bound else "-" if off < -bound else ""
            many = len(branches) > 16 and sum(b[0] for b in branches.values()) < 4.0 * len(branches)
            for name, side in sides.items():
                alike = side != "?" and list(sides.values()).count(side) > 1
                if alike or (many and side in ("", "?")):
                    wild[key, name] = "/*" + side.replace("?", "")
        for p, h, s in deep:
            if len(s) > level:
                template[p] += wild.get(((h, template[p]), s[level]), "/" + s[level])
    own, wide = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for p, h, _ in deep:
        for t in (own[h, template[p]], wide[template[p]]):
            t[0] += p in labels
            t[1] += labels.get(p, False)
    prior = sum(labels.values()) / len(labels)
    out = {}
    for p, h, _ in deep:
        (k, x), (wk, wx) = own[h, template[p]], wide[template[p]]
        out[p] = (template[p], (x + smoothing * (wx + smoothing * prior) / (wk + smoothing)) / (k + smoothing))
    return out


def test_templates_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        host = rng.choice(["a.net", "b.net", "c.net"])
        parts = [rng.choice("uvwxyz"), rng.choice(["list", "item", f"name{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.choice('abcdefghij')}"]), *(rng.choice("pqr") for _ in range(rng.randrange(5)))]
        rows.append((i, host, parts[: rng.randrange(1, 8)]))
    bad = {("u", "list"), ("v", "item"), ("w", "list")}
    labels = {i: (rng.random() < 0.9) == (tuple(s[:2]) in bad or s[0] == "z") for i, _, s in rows if rng.random() < 0.5}
    pages = spark.createDataFrame([(i, f"https://{h}/{'/'.join(s)}") for i, h, s in rows], "page_id long, url string")
    known = spark.createDataFrame(list(labels.items()), "page_id long, blocked boolean")
    want = brute_templates(rows, labels)
    got = {r["page_id"]: (r["template"], r["purity"]) for r in url_templates.judge(pages, rules=(), labels=known).collect()}
    assert {p: t for p, (t, _) in got.items()} == {p: t for p, (t, _) in want.items()}
    assert all(abs(got[p][1] - want[p][1]) < 1e-9 for p in want)


# ---- near duplicates


def brute_components(texts, size, percent):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))

    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size", [2, 5])
def test_families_of_copies(spark, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "One", "one", "one two", "a b c", "A b\tc"]
    for length in (6, 15, 60, 300):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(length)]
            for _ in range(12):
                copy = list(base)
                for _ in range(rng.randrange(0, max(1, length // 12) + 1)):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                texts.append(" ".join(copy))
            texts.append(" ".join(base))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in hyperminhash.near_duplicates(df, size=size).collect()}
    assert got == dict(enumerate(brute_components(texts, size, 80)))


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (7, "x y"), (7, "x y"), (7, "q r s"), (None, "only nulls here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in hyperminhash.near_duplicates(df, size=2).collect()), key=str)
    assert got == sorted([(None, 5, False), (None, 5, False), (5, 5, True), (7, 7, True), (7, 7, True), (7, 7, True), (None, None, True), (None, None, True)], key=str)
    assert hyperminhash.near_duplicates(df.limit(0)).count() == 0


def test_estimates():
    rng = np.random.default_rng(3)
    for overlap in (0.5, 0.8, 0.95):
        equal = []
        for n in (3, 20, 150, 2000):
            for _ in range(20):
                items = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
                common = round(overlap * n)
                a, b = np.sort(items[: common + (n - common) // 2]), np.sort(np.concatenate((items[:common], items[common + (n - common) // 2 : n])))
                true = common / n
                equal.append(hyperminhash.corrected((hyperminhash.sketch(a) == hyperminhash.sketch(b)).mean()) - true)
        assert abs(np.mean(equal)) < 0.02 and np.std(equal) < 0.06


# ---- bpe


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_bpe_against_the_library(spark, tokenizer):
    path, lib = tokenizer
    sf = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op4_bpe_automaton(spark, sf).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_texts(spark, tokenizer):
    path, lib = tokenizer
    rng = random.Random(5)
    texts = [None, "", " ", "<|startoftext|>Hi<|endoftext|> <|ENDOFTEXT|>", "ΣΑΣ don't WE'LL é é İ ﬁ 漢字 🎉 a\x85b", "a" * 5000 + "ab" * 3000, "aaaa aaaaa aaaaaaa"]
    texts += ["".join(rng.choice("aabetholin'strgßéÉñ123!?. <>|") for _ in range(rng.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    coded = bpe_automaton.encode(df, path)
    for r in coded.collect():
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids and r["decoded_text"] == lib.decode(ids, skip_special_tokens=False)
    back = bpe_automaton.decode(coded.limit(20), path).collect()
    assert all(r["decoded_text"] == lib.decode(np.frombuffer(r["token_ids"], "<u4").tolist(), skip_special_tokens=False) for r in back)
    assert bpe_automaton.encode(df.limit(0), path).count() == 0


# ---- images


def test_image_copies(spark):
    rng = np.random.default_rng(1)
    images, names = [], []
    for _ in range(6):
        image = media.resize(rng.random((20, 20)) * 255, 160, 160)
        for kind, x in (("whole", image), ("same", image), ("crop", image[16:140, 10:150]), ("bright", image * 0.8 + 20), ("turned", np.rot90(image))):
            images.append(media.write_pgm(x))
            names.append(kind)
    images += [None, b"", b"junk", b"P5 4 4 255\n" + bytes(16)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(images)], "id long, image binary")
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in media.copies(df).collect()}
    assert len(got) == len(images)
    for i, kind in enumerate(names):
        assert got[i][0] == (i - 1 if kind == "same" else i)
        assert got[i][1] == 3
    assert [got[30 + k] for k in range(4)] == [(None, 0), (None, 0), (None, 0), (33, 0)]
    assert media.copies(df.limit(0)).count() == 0


def test_media_query_counts_every_row(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op7_media(spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_png():
    import struct
    import zlib

    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    raw = b"".join(bytes([0]) + row.tobytes() for row in image)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (media.read_image(png) == image).all()


# ---- toxicity


def test_folding():
    assert toxicity.fold("  1d10t, IDIÓT! 2024 ѕtupid") == " idiot idiot stupid "
    lexicon = toxicity.Lexicon({" clown ": 4.0, " idio": 3.0, " idiot ": 4.0})
    a = lexicon.automaton()
    assert lexicon.measure(toxicity.fold("clown fish"), a) == 0
    assert lexicon.measure(toxicity.fold("the clown"), a) > 0
    assert lexicon.measure(toxicity.fold("a 1diot"), a) == lexicon.measure(toxicity.fold("a clown"), a)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op9_toxicity(spark, sf)
    known = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    r = rows.join(known, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.sum(((F.col("predicted") == 1) & (F.col("toxic") == 0)).cast("int")), F.count(F.lit(1))).first()
    assert r[0] > 0.95 and r[1] <= 0.01 * r[2]


def test_toxicity_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5.0), (None, "", 5.0), (2, "idiot " * 5, 5.0), (2, "x", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(df, labels)
    rows = toxicity.score(df, lexicon).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert max(rows, key=lambda r: r["score"])["text"].startswith("idiot")
    assert toxicity.score(df.limit(0), lexicon).count() == 0


# ---- pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == docs.columns
        if name in ("toxicity", "exact_dedup", "near_dedup"):
            ids = {r[0] for r in docs.select("doc_id").collect()}
            kept = [r[0] for r in out.select("doc_id").collect()]
            assert set(kept) <= ids and len(kept) == len(set(kept))
        if name == "near_dedup":
            texts = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
            want = {texts[i][0] for i, (n, c) in enumerate(brute_fast([t for _, t in texts])) if c == i}
            assert set(kept) == want
        docs = out.cache()
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4]


def brute_fast(texts):
    """brute_components for five words and 80 %, over pairs that share a shingle."""
    sets, by = [], defaultdict(list)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.append(s)
        for x in s:
            by[x].append(i)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        common = defaultdict(int)
        for x in a:
            for j in by[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_applied_mix_cuts_words(spark):
    df = spark.createDataFrame([(1, "a b  c d e f", "s", 12), (2, "x", "t", 1), (3, None, "t", 0)], "doc_id long, text string, source string, n_chars long")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df, least_block=1).collect()}
    rows = mixing.apply(df, least_block=1)
    assert rows.columns == df.columns
    got = defaultdict(int)
    for r in rows.collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(got)
