"""Image copies: edited copies, all pairs against brute force, small crops of large images."""

import numpy as np
import pytest
import xxhash

from weftline.llm import media


def picture(rng, side):
    return media.resize(rng.random((side // 8, side // 8)) * 255, side, side)


def packed(raw):
    return b"".join(media.RECORD.pack(*f) for f in media.features(media.read_image(raw)))


def recompressed(image, step):
    """Blocks of 8x8 by cosine transform, their coefficients rounded to steps."""
    k = np.arange(8)
    c = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.sqrt(2 / 8)
    c[0] /= np.sqrt(2)
    h, w = image.shape
    blocks = image.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)
    return (c.T @ (np.rint(c @ blocks @ c.T / step) * step) @ c).transpose(0, 2, 1, 3).reshape(h, w)


EDITS = {
    "noise": lambda x, rng: x + rng.normal(0, 10, x.shape),
    "recompressed": lambda x, rng: recompressed(x, 40),
    "requantised": lambda x, rng: x // 32 * 32 + 16,
    "halved and enlarged": lambda x, rng: media.resize(media.resize(x, x.shape[0] // 2, x.shape[1] // 2), *x.shape),
}


@pytest.mark.parametrize("edit", EDITS)
def test_edited_copies(edit):
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(20):
        image = picture(rng, 64)
        found += media.agree(packed(media.write_pgm(image)), packed(media.write_pgm(EDITS[edit](image, rng)))) >= media.VOTES
    assert found >= 18


def test_rescaled_copies():
    rng = np.random.default_rng(4)
    for side in (80, 114):
        for _ in range(5):
            image = picture(rng, 160)
            assert media.agree(packed(media.write_pgm(image)), packed(media.write_pgm(media.resize(image, side, side)))) >= media.VOTES


@pytest.mark.parametrize("side", [64, 96])
def test_enlarged_copies(side):
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(20):
        image = picture(rng, side)
        larger = media.resize(image, round(side * 1.2), round(side * 1.2))
        found += media.agree(packed(media.write_pgm(image)), packed(media.write_pgm(larger))) >= media.VOTES
    assert found >= 18


@pytest.mark.parametrize("side", [64, 96, 150])
@pytest.mark.parametrize("share", [0.9, 0.8, 0.6, 1.7])
def test_resized_pictures(side, share):
    """Recall of at least 0.9 for whole pictures at other sizes."""
    rng = np.random.default_rng(11)
    found = 0
    for _ in range(40):
        image = picture(rng, side)
        other = media.resize(image, round(side * share), round(side * share))
        found += media.agree(packed(media.write_pgm(image)), packed(media.write_pgm(other))) >= media.VOTES
    assert found >= 36


def brute_groups(raws):
    """The smallest number that the links of agree() reach from each image."""
    images = [media.read_image(r) for r in raws]
    key = [xxhash.xxh3_128_digest(str(x.shape).encode() + np.ascontiguousarray(x).tobytes()) for x in images]
    feats = {k: packed(r) for k, r in zip(key, raws, strict=True)}
    order = sorted(feats)
    label = {k: key.index(k) for k in order}
    for j, b in enumerate(order):
        for a in order[:j]:
            if label[a] != label[b] and media.agree(feats[a], feats[b]) >= media.VOTES:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return [label[k] for k in key]


@pytest.mark.parametrize("blocks", [(8, 2, 1 << 24), (2048, 256, 4000), (2048, 256, 1 << 24)])
def test_groups_match_all_pairs(spark, monkeypatch, blocks):
    """Planted crops and edits, chains of crops that overlap only with their neighbours; small blocks split cells and components."""
    for name, value in zip(("BLOCK", "PAIR_BLOCK", "PAIR_BYTES"), blocks, strict=True):
        monkeypatch.setattr(media, name, value)
    rng = np.random.default_rng(7)
    raws = []
    for _ in range(4):
        image = picture(rng, 96)
        raws += [media.write_pgm(x) for x in (image[8:56, 20:68], image[30:74, 5:49], image, image, *[e(image, rng) for e in EDITS.values()])]
    wide = media.resize(rng.random((10, 60)) * 255, 80, 480)
    raws += [media.write_pgm(wide[:, x : x + 80]) for x in range(0, 400, 40)]
    raws += [media.write_pgm(picture(rng, 64)) for _ in range(25)]
    raws = [raws[k] for k in rng.permutation(len(raws))]
    df = spark.createDataFrame(list(enumerate(raws)), "id long, image binary")
    got = {r["id"]: r["group_id"] for r in media.groups(df).collect()}
    want = brute_groups(raws)
    assert [got[i] for i in range(len(raws))] == want and len(set(want)) < len(raws) - 25


def test_groups_of_a_large_component(spark):
    """Many near copies and pictures that meet them by single corners: every pair of components with a link is joined, equal rows too."""
    rng = np.random.default_rng(12)
    image = picture(rng, 96)
    raws = [media.write_pgm(image + rng.normal(0, 6, image.shape)) for _ in range(60)] + [media.write_pgm(picture(rng, 64)) for _ in range(20)] + [None, b"", b"junk"]
    raws.append(raws[0])
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(raws)] + [(None, raws[1], "y")], "id long, image binary, pixels string")
    got = {r["id"]: (r["class_id"], r["group_id"]) for r in media.groups(df).collect()}
    want = brute_groups([r for r in raws if r and r[:2] == b"P5"])
    assert [got[i][1] for i in range(80)] == want[:80]
    assert got[83] == (0, 0) and got[None] == (1, 0) and [got[80 + k] for k in range(3)] == [(None, None)] * 3
    assert media.groups(df.limit(0)).count() == 0


def brute_links(raws):
    """Links of each image, from agree() over all pairs of classes, in the order of their pixels."""
    images = [media.read_image(r) for r in raws]
    key = [xxhash.xxh3_128_digest(str(x.shape).encode() + np.ascontiguousarray(x).tobytes()) for x in images]
    feats = {k: packed(r) for k, r in zip(key, raws, strict=True)}
    order, links = sorted(feats), dict.fromkeys(feats, 0)
    for j, b in enumerate(order):
        for a in order[:j]:
            if media.agree(feats[a], feats[b]) >= media.VOTES:
                links[a] += 1
                links[b] += 1
    return [links[k] for k in key]


@pytest.mark.parametrize("block", [16, 2048])
def test_links_match_all_pairs(spark, monkeypatch, block):
    """Planted crops and edits, some with few matches; small blocks split the cells."""
    monkeypatch.setattr(media, "BLOCK", block)
    rng = np.random.default_rng(5)
    raws = []
    for _ in range(5):
        image = picture(rng, 96)
        raws += [media.write_pgm(x) for x in (image, image[8:56, 20:68], image[30:74, 5:49], *[e(image, rng) for e in EDITS.values()])]
    raws += [media.write_pgm(picture(rng, 64)) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(raws)), "id long, image binary")
    got = {r["id"]: r["n_links"] for r in media.copies(df).collect()}
    want = brute_links(raws)
    assert [got[i] for i in range(len(raws))] == want and sum(want) >= 5 * 6


def test_few_matches_meet(spark):
    """Two images with VOTES matches that lie in one cell each on either side meet, whatever other corners are more common."""
    rng = np.random.default_rng(6)
    common = [rng.bytes(32) for _ in range(media.VOTES)]

    def feats(order, near):
        # The matched corners of the second image differ in RADIUS bits, so that they share one table only.
        out = []
        for n, k in enumerate(order):
            bits = bytearray(common[k])
            if near:
                for t in range(media.TABLES):
                    if t != (k + n) % media.TABLES:
                        bits[t * media.PART] ^= 1
            out.append(media.RECORD.pack(20.0 * k, 10.0 * k * k, 1.0, 0.0, bytes(bits)))
        return b"".join(out)

    rows = [("a", feats([0, 1, 2, 3], False)), ("b", feats([3, 2, 1, 0], True))]
    # Other images hold single corners of either side, as often as makes them common.
    for n in range(40):
        bits = bytearray(common[n % 2] if n % 3 else common[2 + n % 2])
        bits[media.PART * (n % 8)] ^= 1
        rows.append((f"x{n}", media.RECORD.pack(0.0, 0.0, 1.0, 0.0, bytes(bits))))
    assert media.agree(rows[0][1], rows[1][1]) == media.VOTES
    classes = spark.createDataFrame([(i, p.encode(), f) for i, (p, f) in enumerate(rows)], "number long, pixels binary, feats binary")
    from weftline.llm.common import Scratch

    met = {(r["a"], r["b"]) for r in media.meetings(classes, media.VOTES, Scratch(spark)).collect()}
    assert (0, 1) in met


def test_small_crops_of_large_images():
    rng = np.random.default_rng(8)
    for _ in range(3):
        image = picture(rng, 640)
        assert media.agree(packed(media.write_pgm(image)), packed(media.write_pgm(image[300:428, 210:338]))) >= media.VOTES
