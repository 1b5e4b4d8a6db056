"""Copies of images, cropped or edited, by local descriptors.

Corners are found at several scales of an image. Around each, binary tests
compare smoothed pixels at places turned by the corner's orientation, so 256
bits describe it whatever the rotation, size and brightness. Bands of those
bits are keys of Hamming tables: descriptors that share a band meet. Images
that share SHARED cells are matched corner by corner, and one is a copy of the
other if enough matches agree on one turn, scale and shift. Enough is a share of
the corners where the images then overlap, so a crop may be a small part of an
image, and corners are kept by region, so a larger image has more of them.

The groups that these links connect are found without all pairs of a group.
First a few rounds of stars: of each group found so far one image stands for it
in a cell and is matched with the image that leads the cell. What then shares a
cell and isn't in one group yet meets in full: every pair of images of different
groups. Crowded cells are dealt to blocks, and each two blocks meet in a group of
their own. Equal files are one image. Nothing is collected.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.llm.common import binary_rows, by_key, table, written
from phonoframe.llm.components import components

#: Sizes of the image at which corners are looked for, corners kept per size and region, side of a region in pixels of that size, half the width of a patch.
SCALES, CORNERS, REGION, RADIUS = (1.0, 0.7, 0.5), 24, 64, 11
#: Corners described at once, and pairs of corners compared at once.
MANY, COMPARED = 4096, 1 << 20
BITS, ANGLES = 256, 30
#: Hamming tables, and the bytes of a descriptor that each takes as its key (tables overlap): equal 56 bits seldom happen by chance.
BANDS, BAND_BYTES = 8, 7
#: Rounds of stars at most; pairs left after them meet in full.
STARS = 3
#: Bands that images share before they are matched; bits that matched corners may differ in; pixels that agreeing ones may be off.
SHARED, DIFFER, OFF = 2, 60, 4.0
#: Images of a cell, or about as many of a block of one, that meet in one group; pairs of an Arrow batch.
CROWD, PAIRS = 512, 1 << 20
#: Agreeing matches that make a copy, at least, and of the corners in the overlap of the image with fewer there.
AGREE, AGREE_SHARE = 4, 0.2
#: x, y (in the full image), scale number, angle number and the bits of a corner.
CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "u1"), ("angle", "u1"), ("bits", "u1", BITS // 8)])
_TESTS = np.clip(np.random.default_rng(8).normal(0, RADIUS / 2.2, (BITS, 4)), -(RADIUS - 3) / 1.42, (RADIUS - 3) / 1.42)


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey levels (float) of a binary PGM or PPM, or of a PNG with 8 bits a channel that isn't interlaced; None for anything else."""
    try:
        if raw and raw[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while raw[at : at + 1].isspace():
                    at += 1
                if raw[at : at + 1] == b"#":
                    at = raw.index(b"\n", at)
                    continue
                end = at
                while not raw[end : end + 1].isspace():
                    end += 1
                head.append(int(raw[at:end]))
                at = end
            w, h, top = head
            n = 1 if raw[:2] == b"P5" else 3
            if top > 255:
                return None
            return np.frombuffer(raw, np.uint8, w * h * n, at + 1).reshape(h, w, n).astype(float).mean(2) * (255 / top)
        if raw and raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        pass
    return None


def _png(raw: bytes) -> np.ndarray | None:
    at, data, palette = 8, b"", None
    while at < len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(float).mean(1)
        elif kind == b"IDAT":
            data += body
        at += n + 12
    if depth != 8 or interlaced:
        return None
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, w * channels + 1)
    out = np.zeros((h + 1, w + 1, channels), np.int64)  # with a row above and a pixel to the left
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].reshape(w, channels).astype(np.int64)
        up = out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, 0) & 255
        elif kind == 2:
            out[y + 1, 1:] = (line + up) & 255
        else:
            for x in range(w):
                a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                out[y + 1, x + 1] = (line[x] + guess) & 255
    pixels = out[1:, 1:]
    if colour == 3:
        return palette[pixels[..., 0]]
    return pixels[..., : 3 if channels > 2 else 1].astype(float).mean(2)


def _blur(x: np.ndarray, taps: tuple[float, ...]) -> np.ndarray:
    """Separable smoothing of a stack of images, edges repeated."""
    r = len(taps) // 2
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        wide = np.pad(x, pad, mode="edge")
        n = x.shape[axis]
        x = sum(t * np.take(wide, np.arange(k, k + n), axis) for k, t in enumerate(taps))
    return x


def _resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, for a stack of images."""
    for axis, n in ((1, h), (2, w)):
        m = x.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.minimum(at.astype(int), m - 2) if m > 1 else np.zeros(n, int)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
        x = np.take(x, low, axis) * (1 - part) + np.take(x, np.minimum(low + 1, m - 1), axis) * part
    return x


def corners(stack: np.ndarray) -> list[np.ndarray]:
    """The corners (CORNER) of each of a stack of images of one shape."""
    n, height, width = stack.shape
    found: list[list[np.ndarray]] = [[] for _ in range(n)]
    turn = np.arange(ANGLES) * 2 * np.pi / ANGLES
    cos, sin = np.cos(turn)[:, None], np.sin(turn)[:, None]
    tests = [np.rint(_TESTS[:, k] * cos - _TESTS[:, k + 1] * sin).astype(int) for k in (0, 2)], [np.rint(_TESTS[:, k] * sin + _TESTS[:, k + 1] * cos).astype(int) for k in (0, 2)]
    dy, dx = (a.ravel() for a in np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1])
    disc = dx * dx + dy * dy <= RADIUS * RADIUS
    dy, dx = dy[disc], dx[disc]
    for number, scale in enumerate(SCALES):
        h, w = round(height * scale), round(width * scale)
        if min(h, w) < 2 * RADIUS + 3:
            break
        x = stack if scale == 1 else _resize(_blur(stack, (0.25, 0.5, 0.25)), h, w)
        gy, gx = np.gradient(x, axis=(1, 2))
        taps = (0.0625, 0.25, 0.375, 0.25, 0.0625)
        a, b, c = (_blur(g, taps) for g in (gx * gx, gx * gy, gy * gy))
        strength = a * c - b * b - 0.05 * (a + c) ** 2
        strength[:, :RADIUS], strength[:, -RADIUS:], strength[:, :, :RADIUS], strength[:, :, -RADIUS:] = 0, 0, 0, 0
        peak = strength > np.maximum(0.01 * strength.max((1, 2), keepdims=True), 1e-6)
        for v in (-1, 0, 1):
            for u in (-1, 0, 1):
                if v or u:
                    peak &= strength >= np.roll(strength, (v, u), (1, 2))
        i, yy, xx = np.nonzero(peak)
        region = (i * (h // REGION + 1) + yy // REGION) * (w // REGION + 1) + xx // REGION
        by = np.lexsort((xx, yy, -strength[i, yy, xx], region))
        i, yy, xx, region = i[by], yy[by], xx[by], region[by]
        keep = np.arange(len(i)) - np.searchsorted(region, region) < CORNERS
        i, yy, xx = i[keep], yy[keep], xx[keep]
        if not len(i):
            continue
        smooth = _blur(x, taps)
        out = np.zeros(len(i), CORNER)
        out["x"], out["y"], out["scale"] = xx * width / w, yy * height / h, number
        for at in range(0, len(i), MANY):
            one, row, column = (c[at : at + MANY, None] for c in (i, yy, xx))
            patch = smooth[one, row + dy, column + dx]
            patch = patch - patch.mean(1, keepdims=True)
            angle = np.rint(np.arctan2((patch * dy).sum(1), (patch * dx).sum(1)) / (2 * np.pi) * ANGLES).astype(int) % ANGLES
            pixel = [smooth[one, row + tests[1][k][angle], column + tests[0][k][angle]] for k in (0, 1)]
            out["angle"][at : at + MANY], out["bits"][at : at + MANY] = angle, np.packbits(pixel[0] < pixel[1], axis=1)
        for k, rows in zip(np.unique(i), np.split(out, np.flatnonzero(np.diff(i)) + 1), strict=True):
            found[k].append(rows)
    return [np.concatenate(f) if f else np.zeros(0, CORNER) for f in found]


def band_keys(c: np.ndarray) -> np.ndarray:
    """The cells of the Hamming tables that corners lie in, sorted."""
    number = np.zeros((len(c), BANDS), np.int64)
    first = np.arange(BANDS) * (BITS // 8 // BANDS)
    for k in range(BAND_BYTES):
        number = number << 8 | c["bits"][:, (first + k) % (BITS // 8)]
    return np.unique(number + (np.arange(BANDS) << 8 * BAND_BYTES))


def described(images: DataFrame) -> DataFrame:
    """image_id, n_corners, corners (bytes) and bands (keys of the Hamming tables) of every row of image_id, image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                grey = [decode(x.as_py()) for x in part.column(1)]
                out: list[np.ndarray] = [np.zeros(0, CORNER)] * len(grey)
                shapes: dict[tuple, list[int]] = {}
                for i, g in enumerate(grey):
                    if g is not None and min(g.shape) > 0:
                        shapes.setdefault(g.shape, []).append(i)
                for which in shapes.values():
                    for i, c in zip(which, corners(np.stack([grey[i] for i in which])), strict=True):
                        out[i] = c
                keys = [band_keys(c) for c in out]
                n = [len(c) for c in out]
                yield pa.record_batch(
                    [part.column(0), pa.array(n, pa.int32()), binary_rows(np.frombuffer(np.concatenate(out).tobytes(), np.uint8), CORNER.itemsize * np.cumsum([0, *n])), pa.array(keys, pa.list_(pa.int64()))],
                    names=["image_id", "n_corners", "corners", "bands"],
                )

    return images.select("image_id", "image").mapInArrow(run, "image_id long, n_corners int, corners binary, bands array<long>")


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a and b (a < b): in each group all pairs of images of different components, or where two blocks meet those across them; rows (band, low, high, block, component, image_id) sorted by band, low, high and component."""
    for t in by_key(batches, 3):
        band, low, high, block, component, image = (t.column(k).to_numpy() for k in range(6))
        new = np.concatenate([[True], (band[1:] != band[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        turn = new | np.concatenate([[True], component[1:] != component[:-1]])
        before = np.flatnonzero(turn)[np.cumsum(turn) - 1] - start  # rows of earlier components of the group
        upto = np.concatenate([[0], np.cumsum(before)])
        at = 0
        while at < len(image):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
            n = before[at:end]
            y = np.repeat(np.arange(at, end), n)
            x = start[y] + np.arange(len(y)) - np.repeat(np.cumsum(n) - n, n)
            keep = (low[y] == high[y]) | (block[x] != block[y])
            p, q = image[x[keep]], image[y[keep]]
            yield pa.record_batch([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])
            at = end


def open_cells(cells: DataFrame) -> DataFrame:
    """band and n (rows) of the cells where images of different components meet; cells has band, component and image_id."""
    return cells.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "n")


def meetings(cells: DataFrame, most: int = CROWD) -> DataFrame:
    """a and b (a < b) of all pairs of images of different components in each cell, once for each cell; rows (band, component, image_id). No group is much larger than 2 * most."""
    dealt = cells.join(open_cells(cells), "band").withColumn("blocks", F.ceil(F.col("n") / most))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("image_id", F.lit("block")), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "component", "image_id")
    return dealt.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "component").mapInArrow(meet, "a long, b long")


def stars(cells: DataFrame, turn: int) -> DataFrame:
    """a and b (a < b), once for each cell: of every component in a cell one image, and the one that leads the cell. The order changes with the turn."""
    first = F.min(F.struct(F.xxhash64("image_id", F.lit(turn)).alias("order"), "image_id"))
    each = cells.groupBy("band", "component").agg(first.alias("own"))
    lead = each.groupBy("band").agg(F.min("own").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", F.col("lead.image_id").alias("lead"))
    met = each.select("band", F.col("own.image_id").alias("image_id")).join(lead, "band").where("lead <> image_id")
    return met.select(F.least("lead", "image_id").alias("a"), F.greatest("lead", "image_id").alias("b"))


def _closest(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of p and q (indexes) that are each other's closest and near enough."""
    u, v = (np.ascontiguousarray(c["bits"]).view(np.uint64) for c in (p, q))
    least, to = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    back, of = np.full(len(q), BITS + 1), np.zeros(len(q), np.int64)
    step = max(1, COMPARED // len(q))
    for at in range(0, len(p), step):
        differ = np.bitwise_count(u[at : at + step, None] ^ v[None]).sum(2, dtype=np.int64)
        to[at : at + step], least[at : at + step] = differ.argmin(1), differ.min(1)
        here = differ.min(0)
        of, back = np.where(here < back, at + differ.argmin(0), of), np.minimum(here, back)
    i = np.flatnonzero((least <= DIFFER) & (of[to] == np.arange(len(p))))
    return i, to[i]


def _within(w: np.ndarray, box: np.ndarray) -> int:
    """How many of the places w are within the bounds of the places in box."""
    return int(((w.real >= box.real.min() - OFF) & (w.real <= box.real.max() + OFF) & (w.imag >= box.imag.min() - OFF) & (w.imag <= box.imag.max() + OFF)).sum())


def agreements(p: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, int]]:
    """Likely turns, scales and shifts between two images, each as the number of matches that agree on it and the corners in the overlap of the image with fewer there."""
    if not len(p) or not len(q):
        return
    i, j = _closest(p, q)
    if len(i) < AGREE:
        return
    u, v = p[i], q[j]
    turn = (v["angle"].astype(float) - u["angle"]) * 2 * np.pi / ANGLES
    scale = np.array(SCALES)[u["scale"]] / np.array(SCALES)[v["scale"]]
    z, w = u["x"] + 1j * u["y"], v["x"] + 1j * v["y"]
    # Each match alone proposes a transformation w = m * z + s; pairs of matches propose finer ones for its followers.
    m = scale * np.exp(1j * turn)

    def rough(k: np.ndarray) -> np.ndarray:
        dz = z[None] - z[k, None]
        near = np.abs(w[None] - (m[k, None] * dz + w[k, None])) <= OFF + 0.15 * np.abs(dz)
        near &= np.abs(np.log(scale[None] / scale[k, None])) < 0.5
        return near & (np.abs(np.angle(np.exp(1j * (turn[None] - turn[k, None])))) < 0.5)

    step = max(1, COMPARED // len(i))
    followers = np.concatenate([rough(np.arange(at, min(at + step, len(i)))).sum(1) for at in range(0, len(i), step)])
    all_z, all_w = p["x"] + 1j * p["y"], q["x"] + 1j * q["y"]
    for k in np.argsort(-followers, kind="stable")[:5]:
        g = np.flatnonzero(rough(np.array([k]))[0])
        if len(g) < AGREE:
            break
        dz, dw = z[g] - z[g].mean(), w[g] - w[g].mean()
        fine = (np.conj(dz) * dw).sum() / max((np.abs(dz) ** 2).sum(), 1e-9)
        close = np.abs(dw - fine * dz) <= OFF
        places = np.unique(np.rint(np.stack([z[g][close].real, z[g][close].imag]) / 2), axis=1).shape[1]
        overlap = min(len(p), len(q))
        if abs(fine) > 1e-6:
            overlap = min(_within(fine * (all_z - z[g].mean()) + w[g].mean(), all_w), _within((all_w - w[g].mean()) / fine + z[g].mean(), all_z))
        yield places, overlap


def agreeing(p: np.ndarray, q: np.ndarray) -> int:
    """Matches between the corners of two images that agree on one turn, scale and shift."""
    return max((places for places, _ in agreements(p, q)), default=0)


def is_copy(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether enough of the corners where two images overlap agree."""
    return any(places >= max(AGREE, AGREE_SHARE * overlap) for places, overlap in agreements(p, q))


def matched(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """u and v of the pairs (a, b) that are copies; seen has image_id and corners."""
    of = lambda c: seen.select(F.col("image_id").alias(c), F.col("corners").alias(f"of_{c}"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(r.as_buffer(), CORNER) for r in (x, y))
                good.append(is_copy(p, q))
            u, v = (batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1))
            yield pa.record_batch([u, v], names=["u", "v"])

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(match, "u long, v long")


def links(seen: DataFrame) -> DataFrame:
    """u and v: links that connect all images which share SHARED cells and are copies; seen has image_id, corners and bands, written."""
    cells = seen.select(F.explode("bands").alias("band"), "image_id")
    shared = lambda met: met.groupBy("a", "b").count().where(F.col("count") >= SHARED).select("a", "b")
    found = None
    for turn in range(STARS):
        labelled = _labelled(cells, found)
        more = written(matched(shared(stars(labelled, turn)), seen), "media-stars")
        if more.isEmpty():
            break
        found = more if found is None else found.unionByName(more)
    # Pairs of one component are settled; a pair of different ones meets in all the cells that it shares.
    rest = written(matched(shared(meetings(_labelled(cells, found))), seen), "media-rest")
    return rest if found is None else found.unionByName(rest)


def _labelled(cells: DataFrame, found: DataFrame | None) -> DataFrame:
    """cells with the component of each image under the links found so far; only cells where different components meet."""
    if found is None:
        whole = cells.withColumn("component", F.col("image_id"))
    else:
        whole = cells.join(components(found), F.col("image_id") == F.col("node"), "left").select("band", "image_id", F.coalesce("component", "image_id").alias("component"))
    return written(whole.join(open_cells(whole), "band", "left_semi"), "media-cells")


def copies(images: DataFrame) -> DataFrame:
    """image_id, n_corners and copy_of (the smallest image_id that it is a copy of, directly or through others; itself included).

    Rows whose image is null, empty, unreadable or without corners are copies of
    equal files only (null of none). Rows that share an image_id are one image
    to the groups. Null image_ids are in no group. An empty table gives no rows.
    """
    digest = F.when(F.octet_length("image") > 0, F.sha2("image", 256))
    files = images.select("image_id", "image", digest.alias("digest"))
    same = files.where("digest is not null and image_id is not null").groupBy("digest").agg(F.min("image_id").alias("first"), F.first("image").alias("image"))
    seen = written(described(same.select(F.col("first").alias("image_id"), "image")), "media-corners")
    groups = components(links(seen))
    by_file = same.select("digest", "first").join(seen.select(F.col("image_id").alias("first"), "n_corners"), "first").join(groups, F.col("first") == F.col("node"), "left").select("digest", "n_corners", F.coalesce("component", "first").alias("copy_of"))
    out = files.select("image_id", "digest").join(by_file, "digest", "left")
    return out.select("image_id", F.coalesce("n_corners", F.lit(0)).alias("n_corners"), F.coalesce("copy_of", "image_id").alias("copy_of"))


#: Pixels of a tile, and tiles of a side, of the images below.
TILE, SIDE = 5, 8


def rendered(embeddings: DataFrame) -> DataFrame:
    """image_id and image (PGM): each vector of 64 components as 8 by 8 grey tiles; null for vectors of another length or with null or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                v = np.array(x.as_py() if x.is_valid else [], float)
                if v.shape != (SIDE * SIDE,) or not np.isfinite(v).all():
                    out.append(None)
                    continue
                grey = np.rint(128 + 120 * v / max(np.abs(v).max(), 1e-30)).astype(np.uint8).reshape(SIDE, SIDE)
                out.append(b"P5 %d %d 255\n" % (SIDE * TILE, SIDE * TILE) + np.kron(grey, np.ones((TILE, TILE), np.uint8)).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["image_id", "image"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "image_id long, image binary")


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among images rendered from all embeddings, as no table has images (the contract of ``copies``)."""
    return copies(rendered(table(spark, sf_dir, "embeddings")))
