import struct
import zlib

import numpy as np
import pytest

from phonoframe.llm import media


def picture(seed, h=96, w=120):
    r = np.random.default_rng(seed)
    x = np.zeros((h, w))
    for _ in range(40):
        a, b = r.integers(0, h), r.integers(0, w)
        x[a : a + r.integers(8, 40), b : b + r.integers(8, 40)] += r.normal() * 40
    return np.clip(x - x.min(), 0, 255)


def pgm(x):
    x = np.clip(np.rint(x), 0, 255).astype(np.uint8)
    return b"P5\n# a comment\n%d %d\n255\n" % x.shape[::-1] + x.tobytes()


def png(x, kinds):
    x = np.clip(np.rint(x), 0, 255).astype(int)
    out, above = b"", np.zeros(x.shape[1], int)
    for y, line in enumerate(x):
        kind = kinds[y % len(kinds)]
        left, corner = np.concatenate([[0], line[:-1]]), np.concatenate([[0], above[:-1]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        out += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_decoding():
    x = np.rint(picture(1, 20, 30))
    assert (media.decode(pgm(x)) == x).all() and (media.decode(png(x, [0, 1, 2, 3, 4])) == x).all()
    assert media.decode(b"P6 1 1 255\n\x00\x03\x06").tolist() == [[3.0]]
    for bad in (None, b"", b"GIF89a", b"P5 9 9 255\nshort", b"\x89PNG\r\n\x1a\nxx"):
        assert media.decode(bad) is None


EDITS = {
    "cropped": lambda a: a[13:80, 17:101], "brighter": lambda a: a * 0.8 + 20, "noisy": lambda a: a + np.random.default_rng(1).normal(0, 4, a.shape),
    "turned": np.rot90, "smaller": lambda a: media._resize(a[None], 67, 84)[0],
}


@pytest.mark.parametrize("edit", EDITS)
def test_edits_agree_and_others_dont(edit):
    good = lambda p, q: media.agreeing(p, q) >= max(media.AGREE, media.AGREE_SHARE * min(len(p), len(q)))
    pictures = [picture(k) for k in range(8)]
    plain = [media.corners(a[None])[0] for a in pictures]
    edited = [media.corners(EDITS[edit](a)[None])[0] for a in pictures]
    for i, p in enumerate(plain):
        assert [good(p, q) for q in edited] == [i == j for j in range(8)]


def test_copies(spark):
    a, b = picture(30), picture(31)
    images = [(1, pgm(a)), (2, pgm(EDITS["cropped"](a))), (3, pgm(EDITS["brighter"](a))), (4, pgm(b)), (5, pgm(a)), (6, None), (7, b""), (8, b"junk"), (9, b"junk"), (10, pgm(np.zeros((50, 50)))), (None, pgm(b)), (4, pgm(b))]
    df = spark.createDataFrame(images, "image_id long, image binary").selectExpr("*", "1 as bands", "2 as digest")
    got = {r.image_id: (r.n_corners > 0, r.copy_of) for r in media.copies(df).collect() if r.image_id is not None}
    assert got == {1: (True, 1), 2: (True, 1), 3: (True, 1), 4: (True, 4), 5: (True, 1), 6: (False, 6), 7: (False, 7), 8: (False, 8), 9: (False, 8), 10: (False, 10)}
    assert media.copies(df.where("image_id < 0")).count() == 0


def test_query_runs_over_all_rows(spark, sf_dir):
    assert media.op8_image_copies(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_every_pair_of_different_components_meets(spark):
    rows = [(band, image % 3 if band == 6 else image, image) for band in (5, 6) for image in range(50)] + [(7, 3, 3), (7, 9, 9), (7, 4, 4), (8, 1, 1), (9, 2, 2), (9, 2, 12)]
    cells = spark.createDataFrame(rows, "band long, component long, image_id long")
    want = {(a, b): 1 + (a % 3 != b % 3) for b in range(50) for a in range(b)}
    for pair in ((3, 4), (3, 9), (4, 9)):
        want[pair] += 1
    for most in (media.CROWD, 8):
        got = media.meetings(cells, most).groupBy("a", "b").count().collect()
        assert {(r.a, r.b): r["count"] for r in got} == want


def test_stars_propose_one_of_each_component(spark):
    cells = spark.createDataFrame([(5, i // 10, i) for i in range(50)] + [(6, 1, 10), (6, 1, 11)], "band long, component long, image_id long")
    got = [tuple(r) for r in media.stars(cells, 0).collect()]
    assert len(got) == 4 and len({x // 10 for pair in got for x in pair}) == 5


def groups_of(links, nodes):
    label = {x: x for x in nodes}
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = {x: low if y == high else y for x, y in label.items()}
    return label


@pytest.mark.parametrize("stars", [0, 3])
def test_groups_equal_all_pairs_and_planted_copies_are_found(spark, monkeypatch, stars):
    """Crops, turns and edits of 16 pictures, half of which share a logo and a flat border: the groups of all pairs, and a recall of 0.9 at least."""
    monkeypatch.setattr(media, "STARS", stars)
    logo = picture(999, 50, 50)
    images, origin = [], []
    for k in range(16):
        x = picture(k)
        if k % 2:
            x = np.pad(x, 12, constant_values=7.0)
            x[:50, :50] = logo
        for edit in [lambda a: a, *EDITS.values()]:
            origin.append(k)
            images.append(pgm(edit(x)))
    seen = [media.corners(media.decode(raw)[None])[0] for raw in images]
    keys = [media.band_keys(c) for c in seen]
    n = len(images)
    every = [(i, j) for j in range(n) for i in range(j) if len(np.intersect1d(keys[i], keys[j])) >= media.SHARED and media.is_copy(seen[i], seen[j])]
    df = spark.createDataFrame(list(enumerate(images)), "image_id long, image binary").repartition(4)
    got = {r.image_id: r.copy_of for r in media.copies(df).collect()}
    assert got == groups_of(every, range(n))
    pairs = [(i, j) for j in range(n) for i in range(j) if origin[i] == origin[j]]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)


def test_rendered_near_copies(spark, sf_dir):
    """Vectors that are almost equal render as copies; others don't."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 64))
    rows = [(i, [float(x) for x in base[i % 30] + (i >= 30) * rng.normal(size=64) * 0.01]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.image_id: r.copy_of for r in media.copies(media.rendered(df)).collect()}
    assert sum(got[i] == i % 30 for i in range(90)) >= 0.95 * 90
    assert all(got[i] % 30 == i % 30 for i in range(90))


def test_small_crops_of_large_images(spark):
    large = [np.block([[picture(100 * k + 10 * r + c) for c in range(3)] for r in range(4)]) for k in (1, 2)]
    crops = [x[y : y + 100, z : z + 110] for x, y, z in ((large[0], 45, 70), (large[0], 250, 190), (large[1], 130, 61))]  # each 8 % of the area
    plain = [len(media.corners(x[None])[0]) for x in large]
    assert min(plain) > 3 * 24 * len(media.SCALES)
    df = spark.createDataFrame([(k, pgm(x)) for k, x in enumerate([*large, *crops, picture(7)])], "image_id long, image binary")
    assert {r.image_id: r.copy_of for r in media.copies(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 5}
