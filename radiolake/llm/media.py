"""Cropped and edited copies in a column of images, by local descriptors.

Corners (Harris) of the locally normalised image are found at two scales, each gets an orientation
from the centroid of its neighbourhood and 128 binary tests turned by it. Two images are *linked* if at
least ``MIN_VOTES`` different corners of either, and ``MIN_SHARE`` of those of the image that has
fewer, each alike one of the other (at most ``MAX_BITS`` differing bits), agree on one shift, turn and scale. Links join images into classes.

Images that share a key in one of ``TABLES`` Hamming tables (``KEY_BITS`` of a corner's bits each) are
candidates, and a candidate is decided on all corners of both images. Every image is first compared with
one other: a bucket's hub is the image that comes first in one fixed order, and of its hubs in the first
table the one counts that most of its keys lead to (of ``SKETCH`` keys of an image). That joins an image and its closest copy, so rounds follow in three other tables,
in each of which an image is compared with one hub of another class, by an order of the round's own, and classes are joined before the next. So a group of copies
falls together at a few pairs an image, and from then on only images of different classes are paired: over all keys of all tables. A bucket of at most ``SMALL``
images is paired out, in a larger one every image is compared with the hub. What is then left in a larger bucket, images of different classes, is dealt into parts of
about ``PART`` images, and each two parts are compared in a cell of their own, which emits the links
it finds and never the pairs. Parts of one class are not compared with each other. So every two
images that share a key are decided on, or in one class already; only the key tables can miss a copy,
and their recall is measured against all pairs. ``KEY_BITS`` should grow with the logarithm of the
number of images: buckets of unrelated images get more with their square.

Images with equal bytes are one image to all of this. Images are binary PGM (8 bits); ``render``
draws one from a vector. Defined cases: a null or unreadable image, or one too small for a corner,
has no corners and is a class of its own (equal ones share a class); repeated ids are kept row by
row; a row without id never names a class unless no row of it has one (then it is null); input columns
other than id and image are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.shared import broadcast_if_small, drop_staged, freed_shuffles, stage_table, table
from radiolake.llm.simhash import components

SIDE = 96
RADIUS = 11
SCALES = (1, 2)
#: Corners of each scale in an area of SIDE x SIDE; larger images have more.
DENSITY = (32, 16)
TURNS = 128
TESTS = 128
MAX_BITS = 28
MIN_VOTES = 4
MIN_SHARE = 0.1
TABLES = 8
KEY_BITS = 48
#: Sums over squares are products of matrices in images of up to so many rows and columns, running sums in larger ones.
MATRIX = 192
#: Tables whose keys are dealt out at once; those of the rounds before pairs, and an image's keys there; the fewest pairs of a slice.
PASS = 2
CROWD = (1, 2, 3)
SKETCH = 12
SLICE = 200_000
ORDER = np.uint64(0x9E3779B97F4A7C15)
SMALL = 16
PART = 256
BATCH = 12
CORNER = np.dtype([("x", "<i4"), ("y", "<i4"), ("scale", "u1"), ("turn", "u1"), ("low", "<u8"), ("high", "<u8")])


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """The image, or None if the bytes are not an 8-bit binary PGM."""
    try:
        kind, width, height, most = data[:64].split(maxsplit=4)[:4]
        start = data.index(b"255") + 4
        if kind != b"P5" or most != b"255":
            return None
        return np.frombuffer(data, np.uint8, int(width) * int(height), start).reshape(int(height), int(width))
    except (AttributeError, TypeError, ValueError):
        return None


def render(vector: np.ndarray) -> np.ndarray:
    """A texture whose wave amplitudes are the vector's numbers, those beyond 64 added from the start again."""
    vector = np.nan_to_num(np.asarray(vector, np.float64))
    amplitude = np.bincount(np.arange(len(vector)) % 64, vector, 64)
    waves = np.cos(np.pi * np.outer(np.arange(SIDE) + 0.5, np.arange(11, 27, 2)) / SIDE + np.arange(8) ** 2)
    image = waves @ amplitude.reshape(8, 8) @ waves.T
    spread = image.max() - image.min()
    return np.rint((image - image.min()) * (255 / spread if spread else 0)).astype(np.uint8)


def edited(image: np.ndarray, seed: int) -> np.ndarray:
    """A cropped copy with other brightness and contrast."""
    top, left = 4 + seed % 9, 3 + seed // 9 % 11
    return np.rint(image[top : top + 80, left : left + 82] * 0.8 + 20).astype(np.uint8)


@lru_cache(maxsize=32)
def box(n: int, r: int) -> np.ndarray:
    """(n, n): times that an element is counted in the sum about each of ``n``, edges repeated."""
    at = np.arange(n)[:, None]
    counts = np.zeros((n, n))
    np.add.at(counts, (at, np.clip(at + np.arange(-r, r + 1), 0, n - 1)), 1)
    return counts


def means(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2r + 1 of images (n, h, w), edges repeated. Image by image, so no image's result depends on the others."""
    n, (h, w) = 2 * r + 1, a.shape[1:]
    if max(h, w) <= MATRIX:
        s = np.matmul(box(h, r), np.matmul(a, np.ascontiguousarray(box(w, r).T)))
        s /= n * n
        return s
    p = np.pad(a, ((0, 0), (r, r), (r, r)), mode="edge")
    s = np.zeros((len(a), p.shape[1] + 1, p.shape[2] + 1))
    s[:, 1:, 1:] = p.cumsum(1).cumsum(2)
    return (s[:, n:, n:] - s[:, :-n, n:] - s[:, n:, :-n] + s[:, :-n, :-n]) / (n * n)


def inner_means(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2r + 1 (r = 1 or 2), only where they lie within the image: (n, h - 2r, w - 2r)."""
    for _ in range(2):
        a = a.swapaxes(1, 2)
        n, two = a.shape[1] - 2 * r, a[:, :-1] + a[:, 1:]
        a = two[:, :n] + a[:, 2:] if r == 1 else two[:, :n] + two[:, 2 : n + 2] + a[:, 4:]
    a /= (2 * r + 1) ** 2
    return a


def disc(r: int) -> np.ndarray:
    return np.array([(x, y) for x in range(-r, r + 1) for y in range(-r, r + 1) if x * x + y * y <= r * r])


DISC = disc(RADIUS)


def turned(points: np.ndarray) -> np.ndarray:
    """(turns, n, 2, 2): the points of tests, for each orientation."""
    angles = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(angles), -np.sin(angles)], 1), np.stack([np.sin(angles), np.cos(angles)], 1)], 1)
    return np.rint(np.einsum("tij,npj->tnpi", turn, points)).astype(np.int64)


@cache
def tests() -> np.ndarray:
    """The binary tests' points: of a pool, those least correlated on drawn textures.

    Fixed by their seed; correlated tests would make unrelated corners alike.
    """
    rng = np.random.default_rng(7)
    angle, far = rng.uniform(0, 2 * np.pi, (1200, 2)), 0.9 * RADIUS * np.sqrt(rng.uniform(0, 1, (1200, 2)))
    points = np.stack([far * np.cos(angle), far * np.sin(angle)], -1)
    pool = turned(points[np.hypot(*(points[:, 0] - points[:, 1]).T) > 0.4 * RADIUS])
    textures = np.stack([means(rng.normal(size=(3, SIDE, SIDE)), r) for r in (1, 2, 3) for _ in range(3)]).reshape(-1, SIDE, SIDE)
    textures = 255 * (textures - textures.min((1, 2), keepdims=True)) / np.ptp(textures, (1, 2), keepdims=True)
    _, _, bits = found(textures, SIDE * SIDE, DENSITY[0], pool)
    share = bits.mean(0)
    z = (bits - share) / np.sqrt(share * (1 - share) + 1e-9)
    alike, order = np.abs(z.T @ z) / len(z), np.argsort(np.abs(share - 0.5), kind="stable")
    for most in np.arange(0.2, 1.01, 0.05):
        chosen: list[int] = []
        for i in order:
            if len(chosen) < TESTS and (not chosen or alike[i, chosen].max() < most):
                chosen.append(i)
        if len(chosen) == TESTS:
            break
    return pool[:, chosen]


def found(a: np.ndarray, area: int, density: int, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of images (n, h, w): (image, y, x) of each corner, its turn and its tests' bits."""
    h, w = a.shape[1:]
    a = inner_means(np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="edge"), 1)
    mean, spread = means(a, 8), means(a * a, 8)
    a -= mean
    mean *= mean
    spread -= mean
    spread = np.sqrt(np.maximum(spread, 0, out=spread), out=spread)
    spread += 4
    a /= spread
    # corners keep RADIUS + 1 from the edge, and their strength reaches 4 further: one for neighbours, two for means, one for slopes
    edge, near = RADIUS + 1, RADIUS - 2
    dx = a[:, near : h - near, near + 1 : w - near + 1] - a[:, near : h - near, near - 1 : w - near - 1]
    dy = a[:, near + 1 : h - near + 1, near : w - near] - a[:, near - 1 : h - near - 1, near : w - near]
    xx, yy, xy = inner_means(dx * dx, 2), inner_means(dy * dy, 2), inner_means(dx * dy, 2)
    strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner, around = strength[:, 1:-1, 1:-1], reduce(np.maximum, [strength[:, i : strength.shape[1] - 2 + i] for i in range(3)])
    around = reduce(np.maximum, [around[:, :, i : around.shape[2] - 2 + i] for i in range(3)])
    at, ys, xs = np.nonzero((inner >= around) & (inner > 0))
    order = np.lexsort((xs, ys, -inner[at, ys, xs], at))
    at, ys, xs = at[order], ys[order] + edge, xs[order] + edge
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    strong = rank < max(density, round(density * area / SIDE**2))
    at, ys, xs = at[strong], ys[strong], xs[strong]
    spot = a.ravel().take(((at * h + ys) * w + xs)[:, None] + (DISC[:, 1] * w + DISC[:, 0]))
    turn = np.rint(np.arctan2(spot @ DISC[:, 1], spot @ DISC[:, 0]) / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
    # tests reach less than RADIUS from a corner, so they stay within what has means
    smooth = inner_means(a, 2)
    spots = (((at * smooth.shape[1] + ys - 2) * smooth.shape[2]) + xs - 2)[:, None]
    first, second = (smooth.ravel().take(spots + (pattern[:, :, k, 1] * smooth.shape[2] + pattern[:, :, k, 0])[turn]) for k in (0, 1))
    return np.stack([at, ys, xs], 1), turn, first < second


def describe(images: list[np.ndarray | None]) -> list[np.ndarray]:
    """Corners of each image, as arrays of ``CORNER``; images of one shape are worked on together."""
    parts: list[list[np.ndarray]] = [[] for _ in images]
    shapes: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        if image is not None:
            shapes.setdefault(image.shape, []).append(i)
    for (height, width), members in shapes.items():
        # large images go one by one, so that memory follows the largest of them
        step = max(1, min(BATCH, BATCH * SIDE * SIDE // max(1, height * width)))
        for lo in range(0, len(members), step):
            some = members[lo : lo + step]
            for scale, density in zip(SCALES, DENSITY, strict=True):
                h, w = height // scale, width // scale
                if min(h, w) < 2 * RADIUS + 5:
                    continue
                a = np.stack([images[i][: h * scale, : w * scale] for i in some]).astype(np.float64).reshape(len(some), h, scale, w, scale).mean((2, 4))
                at, turn, bits = found(a, height * width, density, tests())
                out = np.zeros(len(at), CORNER)
                packed = np.packbits(bits, axis=1).view("<u8").reshape(-1, 2)
                out["x"], out["y"], out["scale"], out["turn"], out["low"], out["high"] = at[:, 2] * scale, at[:, 1] * scale, scale, turn, packed[:, 0], packed[:, 1]
                ends = np.searchsorted(at[:, 0], np.arange(len(some) + 1))
                for k, i in enumerate(some):
                    parts[i].append(out[ends[k] : ends[k + 1]])
    return [np.concatenate(p) if p else np.zeros(0, CORNER) for p in parts]


@cache
def key_bits() -> np.ndarray:
    """(tables, bits): the tests whose bits make each table's key."""
    return np.stack([np.random.default_rng(i).permutation(TESTS)[:KEY_BITS] for i in range(TABLES)])


@cache
def key_parts(table_: int) -> np.ndarray:
    """(bytes, 256): what each value of each byte of a corner's tests adds to its key."""
    bits = np.zeros((TESTS // 8, 256, TESTS // 8, 8), np.uint8)
    for i in range(TESTS // 8):
        bits[i, :, i] = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return bits.reshape(TESTS // 8, 256, TESTS)[..., key_bits()[table_]] @ (np.int64(1) << np.arange(KEY_BITS, dtype=np.int64))


def keys_of(corners: np.ndarray, image: np.ndarray, table_: int) -> tuple[np.ndarray, np.ndarray]:
    """(image, key): distinct keys in a table, by image; ``image``: the number of each corner's image, below 2**15."""
    parts, tests_ = key_parts(table_), np.stack([corners["low"], corners["high"]], 1).view(np.uint8)
    made = image.astype(np.int64) << KEY_BITS
    for i in range(TESTS // 8):
        made += parts[i].take(tests_[:, i])
    made = np.unique(made)
    return made >> KEY_BITS, made & ((1 << KEY_BITS) - 1)


def keys(corners: np.ndarray, table_: int) -> np.ndarray:
    """Distinct keys of an image's corners in a table."""
    return keys_of(corners, np.zeros(len(corners), np.int64), table_)[1]


def met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the corners of two images that are alike."""
    low, high, found_ = b["low"].copy(), b["high"].copy(), []
    for lo in range(0, len(a), 1024):
        part = a[lo : lo + 1024]
        bits = np.bitwise_count(part["low"][:, None] ^ low)
        bits += np.bitwise_count(part["high"][:, None] ^ high)
        at = np.flatnonzero(bits <= MAX_BITS)
        found_.append(np.stack([at // len(b) + lo, at % len(b)]))
    return tuple(found_[0] if len(found_) == 1 else np.concatenate(found_, 1))


def placed(pairs: list[tuple], needed: np.ndarray) -> np.ndarray:
    """Whether as many different corners as are needed, of each of two images, agree on one placement of a in b; ``pairs``: (a, b, alike corners of a, of b).

    A match of corners says where the middle of a's corners lies in b; it votes there, and for
    its turn and scale, on two overlapping grids an axis.
    """
    sizes = [len(m[2]) for m in pairs]
    of, sides = np.repeat(np.arange(len(pairs)), sizes), [np.concatenate([m[k] for m in pairs]) for k in (2, 3)]
    p, q = (np.concatenate([m[k][m[k + 2]] for m in pairs]) for k in (0, 1))
    turn = (q["turn"].astype(np.int64) - p["turn"]) % TURNS
    angle, scale = turn * (2 * np.pi / TURNS), q["scale"] / p["scale"]
    px, py = (p[c] - np.repeat([m[0][c].mean() for m in pairs], sizes) for c in ("x", "y"))
    x = q["x"] - scale * (np.cos(angle) * px - np.sin(angle) * py)
    y = q["y"] - scale * (np.sin(angle) * px + np.cos(angle) * py)
    agree, span = np.zeros(len(pairs), bool), 1 + max(int(s.max()) for s in sides)
    for dx in (0, 6):
        for dy in (0, 6):
            _, cell = np.unique((np.floor((x + dx) / 12).astype(np.int64) << 32) + np.floor((y + dy) / 12).astype(np.int64), return_inverse=True)
            for dt in (0, TURNS // 16):
                place = ((of * 8 + (turn + dt) % TURNS // (TURNS // 8)) * 5 + (2 * scale).astype(np.int64)) * len(cell) + cell
                _, first, place, n = np.unique(place, return_index=True, return_inverse=True, return_counts=True)
                full = (n[place] >= needed[of]) & ~agree[of]
                votes = reduce(np.minimum, [np.bincount(np.unique(place[full] * span + s[full]) // span, minlength=len(n)) for s in sides])
                owner = of[first]
                agree[owner[votes >= needed[owner]]] = True
    return agree


def linked_pairs(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Whether enough corners agree, for each two images: chance agreement grows with the corners of the smaller one."""
    out, waiting, size = np.zeros(len(first), bool), [], 0
    for k, (a, b) in enumerate(zip(first, second, strict=True)):
        needed = max(MIN_VOTES, MIN_SHARE * min(len(a), len(b)))
        if min(len(a), len(b)) >= needed:
            i, j = met(a, b)
            if len(i) >= needed:
                waiting.append((k, needed, (a, b, i, j)))
                size += len(i)
        if waiting and (size > 1 << 15 or k == len(first) - 1):
            out[[w[0] for w in waiting]] = placed([w[2] for w in waiting], np.array([w[1] for w in waiting]))
            waiting, size = [], 0
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    return bool(linked_pairs([a], [b])[0])


def corners(images: DataFrame) -> DataFrame:
    """(id, node, n_corners, corners) a row of ``images(id, image)``; node: 64 bits of the image's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                data = part.column("image").to_pylist()
                made = describe([read_pgm(x) for x in data])
                node = pa.array([int.from_bytes(hashlib.sha256(b"0" if x is None else b"1" + x).digest()[:8], "big", signed=True) for x in data], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), node, pa.array([len(m) for m in made], pa.int32()), pa.array([m.tobytes() for m in made], pa.binary())], names=["id", "node", "n_corners", "corners"])

    return images.select(F.col("id").cast("long").alias("id"), "image").mapInArrow(run, "id long, node long, n_corners int, corners binary")


def keyed(images: DataFrame, tables: Iterable[int], most: int | None = None) -> DataFrame:
    """(key, node, label) of each of the corners' keys in some tables of ``images(node, label, corners)``; ``most``: of each image's, those first in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                data = part.column("corners").to_pylist()
                image, all_ = np.repeat(np.arange(len(data)), [len(x) // CORNER.itemsize for x in data]), np.frombuffer(b"".join(data), CORNER)
                node, label = (part.column(c).to_numpy() for c in ("node", "label"))
                for t in tables:
                    own, key = keys_of(all_, image, t)
                    if most:
                        order = np.lexsort((key.view(np.uint64) * ORDER, own))
                        few = order[np.arange(len(own)) - np.searchsorted(own, own) < most]
                        own, key = own[few], key[few]
                    yield pa.RecordBatch.from_arrays([pa.array(key * TABLES + t), pa.array(node[own]), pa.array(label[own])], names=["key", "node", "label"])

    return images.filter("n_corners > 0").select("node", "label", "corners").mapInArrow(run, "key long, node long, label long")


def decided(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """The classes (a, b) of those of ``pairs(a, b)`` that are linked; ``images(node, label, corners)``."""
    first, second = (images.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"), F.col("corners").alias(f"c{c}")) for c in "ab")
    both = pairs.join(first, "a").join(second, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = linked_pairs(*([np.frombuffer(x, CORNER) for x in b.column(c).to_pylist()] for c in ("ca", "cb")))
            yield b.select(["la", "lb"]).rename_columns(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return both.select("la", "lb", "ca", "cb").mapInArrow(run, "a long, b long")


def buckets(rows: DataFrame, salt: int = 0) -> DataFrame:
    """(key, n, hub, above) of the buckets of ``rows(key, node, label)`` that hold more than one class; above: the hub's label.

    A node is a hash, so nodes are in an order of their own by each salt. All of it is of longs, which need no sorting to be gathered.
    """
    mask = F.lit(salt * int(ORDER) & (1 << 63) - 1)
    order = F.col("node").bitwiseXOR(mask)
    out = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by("label", order).alias("above"), F.min("label").alias("low"), F.max("label").alias("high"))
    return out.filter("low <> high").select("key", "n", F.col("first").bitwiseXOR(mask).alias("hub"), "above")


def hub_pairs(rows: DataFrame, salt: int = 0) -> DataFrame:
    """Pairs (a, b), a > b, of an image and, of its buckets' hubs of other classes, that of most of its keys; ``rows(key, node, label)``."""
    hubs = buckets(rows, salt).drop("n")
    met_ = rows.join(hubs, "key").filter("label <> above").groupBy("node", "hub").agg(F.count("*").alias("n"))
    # of as many keys the hub's bits decide
    best = met_.groupBy("node").agg(F.max_by("hub", F.col("n") + F.pmod("hub", F.lit(1 << 40)) / (1 << 41)).alias("hub"))
    return best.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()


def shared_rows(images: DataFrame, tables: Iterable[int], most: int) -> DataFrame:
    """(key, node, label) of the buckets of some tables that hold more than one class, of ``most`` keys an image. Staged.

    Buckets are first only looked at as a whole, so what one class shares with no other costs no more rows.
    """
    rows = keyed(images, tables, most)
    mixed = stage_table(buckets(rows).select("key"), "media-crowded")
    out = stage_table(rows.join(broadcast_if_small(mixed), "key"), "media-crowd")
    drop_staged(mixed)
    return out


def round_links(rows: DataFrame, images: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links of rounds in which each image of ``rows(key, node, label)`` is compared with one hub of another class, and the pairs compared; both staged.

    Classes are joined after each round, so a group of copies falls together before any of its images are paired out. Hubs differ
    from round to round. Rounds end when one finds a twentieth of what the first found, or less.
    """
    links, tried, found_ = [], [], []
    while not found_ or 20 * found_[-1] > found_[0]:
        tried.append(stage_table(hub_pairs(renamed(rows, names(links)), len(links) + 1), "media-hub-pairs"))
        links.append(stage_table(decided(tried[-1], images), "media-hub-links"))
        found_.append(links[-1].count())
    return links, tried


def bucket_pairs(images: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a > b, of images of different classes: those of paired out buckets, and a larger one's images and its hub; and the rows of the larger ones. Both staged.

    ``known``: names of classes. As in ``shared_rows``, buckets of one class are left out first.
    """
    pairs, large = [], []
    for lo in range(0, TABLES, PASS):
        rows = renamed(keyed(images, range(lo, lo + PASS)), known)
        mixed = stage_table(buckets(rows).select("key", "n", *(F.when(F.col("n") > SMALL, F.col(c)).alias(c) for c in ("hub", "above"))), f"media-mixed-{lo}")
        shared = stage_table(rows.join(broadcast_if_small(mixed), "key"), f"media-shared-{lo}")
        few = shared.filter(F.col("n") <= SMALL).select("key", "node", "label")
        met_ = few.alias("a").join(few.alias("b"), "key").filter("a.node > b.node and a.label <> b.label").select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
        spokes = shared.filter("label <> above").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"))
        pairs.append(stage_table(met_.unionByName(spokes).distinct(), f"media-pairs-{lo}"))
        large.append(stage_table(shared.filter(F.col("n") > SMALL).select("key", "node", "label"), f"media-large-{lo}"))
        drop_staged(mixed, shared)
    out = [stage_table(reduce(DataFrame.unionByName, x), name) for x, name in ((pairs, "media-all-pairs"), (large, "media-large"))]
    drop_staged(*pairs, *large)
    return out[0], out[1]


def pair_links(pairs: DataFrame, images: DataFrame) -> list[DataFrame]:
    """Links of ``pairs(a, b)``. Staged, in slices of about as many pairs as images, as an image's corners travel with a pair."""
    n = max(1, round(pairs.count() / max(SLICE, images.count())))
    return [stage_table(decided(pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(n)) == i), images), f"media-links-{i}") for i in range(n)]


def rest_links(rows: DataFrame, images: DataFrame, part: int = PART) -> DataFrame:
    """Links between classes whose images share a larger bucket of ``rows(key, node, label)``; ``images(node, corners)``. Staged."""
    rows = rows.join(buckets(rows).filter(F.col("n") > SMALL).select("key"), "key")
    groups = stage_table(rows.groupBy("key", "label").agg(F.count("*").alias("n")), "media-groups")
    scattered = stage_table(groups.groupBy("key").agg(F.sum(F.when(F.col("n") < part, F.col("n")).otherwise(0)).alias("scattered")), "media-scattered")
    # a class that fills a part has parts of its own; the others share parts, a class whole in one
    own = groups.filter(F.col("n") >= part).withColumn("own", F.ceil(F.col("n") / part).cast("int")).drop("n")
    rows = rows.join(scattered, "key").join(own, ["key", "label"], "left")
    spread = F.greatest(F.lit(1), F.ceil(F.col("scattered") / part)).cast("int")
    home = F.when(F.col("own").isNotNull(), F.col("label")).alias("home")
    at = F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.pmod(F.xxhash64("label", F.lit(1)), spread)).cast("int").alias("at")
    rows = stage_table(rows.select("key", "node", "label", home, at), "media-rest")
    parts = stage_table(rows.groupBy("key", "home", "at").agg(F.lit(1).alias("__one")).select("key", "home", "at", F.xxhash64("home", F.coalesce("home", F.lit(0)), "at").alias("part")), "media-parts")
    a, b = parts.alias("a"), parts.alias("b")
    one_class = F.coalesce(F.col("a.home") == F.col("b.home"), F.lit(False))
    cells = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.part") <= F.col("b.part")) & ~one_class).select(F.col("a.key").alias("key"), F.col("a.part").alias("low"), F.col("b.part").alias("high"))
    cells = stage_table(cells, "media-cells")
    dealt = rows.select("key", "node", "label", F.xxhash64("home", F.coalesce("home", F.lit(0)), "at").alias("part"))
    sides = dealt.join(cells.withColumn("part", F.col("low")), ["key", "part"]).unionByName(dealt.join(cells.filter("low <> high").withColumn("part", F.col("high")), ["key", "part"]))
    n = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = sides.join(images.select("node", "corners"), "node").select("key", "low", "high", "part", "label", "corners").repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high", "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, members = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "low", "high", "part", "label", "corners")]
            out = []
            for key, low, high, at, label, data in zip(*cols, strict=True):
                if (key, low, high) != last:
                    last, members = (key, low, high), []
                mine = np.frombuffer(data, CORNER)
                others = [(of, c) for part_of, of, c in members if of != label and (part_of != at or low == high)]
                alike = linked_pairs([mine] * len(others), [c for _, c in others])
                out += [(label, of) for (of, _), yes in zip(others, alike, strict=True) if yes]
                if at == low:
                    members.append((at, label, mine))
            if out:
                pairs = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    links = stage_table(sides.mapInArrow(search, "a long, b long").distinct(), "media-rest-links")
    drop_staged(groups, scattered, rows, parts, cells)
    return links


def names(links: list[DataFrame]) -> DataFrame | None:
    """(label, above): the label of what ``links(a, b)`` join each class to. Staged; none without links."""
    every = reduce(DataFrame.unionByName, links) if links else None
    if every is None or not every.limit(1).count():
        return None
    return stage_table(components(every).select(F.col("node").alias("label"), F.col("label").alias("above")), "media-labels")


def renamed(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """``rows(label, ...)`` with the labels of ``names``."""
    if known is None:
        return rows
    return rows.join(broadcast_if_small(known), "label", "left").withColumn("label", F.coalesce("above", "label")).drop("above")


def image_classes(images: DataFrame, part: int = PART) -> DataFrame:
    """(id, class_id, n_corners) a row of ``images(id, image)``; class_id: smallest id of the class."""
    with freed_shuffles(images.sparkSession):
        made = stage_table(corners(images), "media-corners")
        ones = stage_table(made.groupBy("node").agg(F.col("node").alias("label"), F.first("n_corners").alias("n_corners"), F.first("corners").alias("corners")), "media-images")
        rows = stage_table(made.select("id", "node", "n_corners"), "media-rows")
        drop_staged(made)
        pairs = stage_table(hub_pairs(keyed(ones, [0], SKETCH)), "media-first-pairs")
        links = stage_table(decided(pairs, ones), "media-first-links")
        classes = stage_table(renamed(ones, names([links])), "media-classes")
        drop_staged(ones, pairs, links)
        # from here on links are between the classes of this point
        crowd = shared_rows(classes, CROWD, SKETCH)
        links, tried = round_links(crowd, classes)
        pairs, large = bucket_pairs(classes, names(links))
        new = stage_table(pairs.distinct().join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti"), "media-pairs")
        drop_staged(crowd, pairs, *tried)
        links += pair_links(new, classes)
        links.append(rest_links(renamed(large, names(links)), classes, part))
        labels = renamed(classes.select("node", "label"), names(links))
        members = stage_table(rows.join(labels, "node").select("id", "label", "n_corners"), "media-members")
        least = stage_table(members.groupBy("label").agg(F.min("id").alias("class_id")), "media-least")
        drop_staged(rows, classes, large, new, *links)
    return members.join(least, "label").select("id", "class_id", "n_corners")


def drawn(vectors: DataFrame) -> DataFrame:
    """Two images of each ``vectors(vec_id, embedding)``: as drawn (id 2n) and an edited copy (2n + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                ids, out = [], []
                for i, v in zip(b.column("vec_id").slice(lo, 500).to_pylist(), b.column("embedding").slice(lo, 500).to_pylist(), strict=True):
                    image = None if v is None else render(np.array([np.nan if x is None else x for x in v], np.float64))
                    ids += [None, None] if i is None else [2 * i, 2 * i + 1]
                    out += [None, None] if image is None else [write_pgm(image), write_pgm(edited(image, i or 0))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "image"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "id bigint, image binary")


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = image_classes(drawn(table(spark, sf_dir, "embeddings")))
    return out.select(F.expr("id div 2").alias("vec_id"), (F.col("id") % 2 == 1).alias("edited"), F.col("id").alias("image_id"), "class_id", "n_corners")
