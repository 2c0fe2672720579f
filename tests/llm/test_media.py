"""Image copies against all pairs of images, with planted edits."""

import numpy as np
import pytest

from radiolake.llm import media

SF = "/root/testdata/sf0.001"


def edits(image, seed):
    f, rng = image.astype(float), np.random.default_rng(seed)
    return {
        "cropped": image[10:74, 14:78], "turned": np.rot90(image).copy(), "doubled": np.kron(image, np.ones((2, 2))).astype(np.uint8), "dimmed": media.edited(image, seed),
        "noisy": np.clip(f + rng.normal(0, 6, f.shape), 0, 255).astype(np.uint8), "gamma": np.rint(255 * (f / 255) ** 0.6).astype(np.uint8),
    }


def components(corners, meeting=False):
    """Smallest member of each image's component, by the decision on all pairs, or on those that share a key."""
    label = list(range(len(corners)))
    own = [{(t, k) for t in range(media.TABLES) for k in media.keys(c, t).tolist()} for c in corners] if meeting else None
    for i in range(len(corners)):
        for j in range(i):
            if label[i] != label[j] and (not meeting or own[i] & own[j]) and media.linked(corners[i], corners[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def classes(spark, images, **options):
    rows = [(i, media.write_pgm(x)) for i, x in enumerate(images)]
    out = media.image_classes(spark.createDataFrame(rows, "id long, image binary"), **options).collect()
    return [c for _, c in sorted((r["id"], r["class_id"]) for r in out)]


def test_classes_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    originals = [media.render(rng.normal(size=64)) for _ in range(24)]
    images, kinds = list(originals), []
    for i, image in enumerate(originals):
        for kind, copy in edits(image, i).items():
            images.append(copy)
            kinds.append((kind, i, len(images) - 1))
    got, brute = classes(spark, images), components(media.describe(images))
    assert len(set(got[:24])) == 24
    for kind in {k for k, *_ in kinds}:
        assert np.mean([got[i] == got[j] for k, i, j in kinds if k == kind]) >= 0.9, kind
    pairs = [(i, j) for i in range(len(images)) for j in range(i) if brute[i] == brute[j]]
    assert np.mean([got[i] == got[j] for i, j in pairs]) >= 0.9
    assert all(brute[i] == brute[j] for i in range(len(images)) for j in range(i) if got[i] == got[j])


@pytest.mark.parametrize("part", [256, 8])
def test_crowded_buckets_lose_no_link(spark, part):
    """Crowds of copies of two images, larger than a bucket that is paired out, beside images of their own.

    A third crowd's members share a patch with the first one's image, which alone links nothing.
    """
    rng = np.random.default_rng(2)
    one, two, *others = (media.render(rng.normal(size=64)) for _ in range(14))
    patched = []
    for i in range(12):
        image = media.render(np.random.default_rng(100 + i).normal(size=64))
        image[40:70, 40:70] = one[40:70, 40:70]
        patched.append(image)
    images = [*(media.edited(one, i) for i in range(40)), *(media.edited(two, i) for i in range(30)), *others, *patched]
    assert len(images) > 4 * media.SMALL
    assert classes(spark, images, part=part) == components(media.describe(images), meeting=True)


def test_hostile_images(spark):
    rng = np.random.default_rng(3)
    a, b = media.write_pgm(media.render(rng.normal(size=64))), media.write_pgm(media.render(rng.normal(size=64)))
    flat, thin = media.write_pgm(np.zeros((96, 96))), media.write_pgm(np.zeros((3, 500)))
    rows = [(9, a), (4, a), (9, b), (9, b), (None, b), (1, None), (2, None), (3, b""), (5, b"junk"), (6, flat), (7, thin), (None, thin[:-1])]
    images = spark.createDataFrame([(*r, "x") for r in rows], "id long, image binary, node string")
    out = [(r["id"], r["class_id"], r["n_corners"] > 0) for r in media.image_classes(images).collect()]
    assert sorted(out, key=str) == sorted([(9, 4, True), (4, 4, True), (9, 9, True), (9, 9, True), (None, 9, True), (1, 1, False), (2, 1, False), (3, 3, False), (5, 5, False), (6, 6, False), (7, 7, False), (None, None, False)], key=str)
    assert media.image_classes(images.limit(0)).count() == 0
    assert media.read_pgm(b"junk") is None and media.read_pgm(None) is None
    drawn = media.drawn(spark.createDataFrame([(1, [1.0] * 100), (2, None), (3, []), (None, [1.0, None])], "vec_id long, embedding array<double>"))
    assert drawn.count() == 8 and drawn.filter("image is null").count() == 2


def test_query(spark):
    out = media.op7_image_copies(spark, SF).toPandas()
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert len(out) == 2 * n and out.columns.tolist() == ["vec_id", "edited", "image_id", "class_id", "n_corners"]
    own = out.set_index("image_id").class_id
    assert (own[out.image_id[~out.edited]].to_numpy() == own[out.image_id[~out.edited] + 1].to_numpy()).mean() >= 0.99


def test_a_group_of_copies_makes_a_pair_an_image(spark, monkeypatch):
    """Near copies share most of their keys, each with another hub; once they are one class, no two of them are paired again."""
    image, rng = media.render(np.random.default_rng(5).normal(size=64)).astype(float), np.random.default_rng(6)
    copies = [np.clip(image + rng.normal(0, 3, image.shape), 0, 255).astype(np.uint8) for _ in range(60)]
    decided, counts = media.decided, []

    def counted(pairs, images):
        counts.append(pairs.count())
        return decided(pairs, images)

    monkeypatch.setattr(media, "decided", counted)
    assert classes(spark, copies) == components(media.describe(copies), meeting=True)
    assert sum(counts) <= 2 * len(copies)


def test_twins_do_not_keep_a_group_of_copies_apart(spark, monkeypatch):
    """Each copy has a twin that shares more of its keys than the others do; pairs still follow the number of images, not its square."""
    image, rng = media.render(np.random.default_rng(7).normal(size=64)).astype(float), np.random.default_rng(8)
    copies = [np.clip(image + rng.normal(0, 9, image.shape), 0, 255) for _ in range(60)]
    images = [x.astype(np.uint8) for copy in copies for x in (copy, media.edited(copy, 3))]
    decided, counts = media.decided, []

    def counted(pairs, images):
        counts.append(pairs.count())
        return decided(pairs, images)

    monkeypatch.setattr(media, "decided", counted)
    assert classes(spark, images) == components(media.describe(images), meeting=True)
    assert sum(counts) <= 3 * len(images)


def agreed(a, b):
    """Most corners of either image that agree on one placement, counted cell by cell."""
    met = [(i, j) for i in range(len(a)) for j in range(len(b)) if (int(a["low"][i]) ^ int(b["low"][j])).bit_count() + (int(a["high"][i]) ^ int(b["high"][j])).bit_count() <= media.MAX_BITS]
    best = 0
    for dx, dy, dt in [(dx, dy, dt) for dx in (0, 6) for dy in (0, 6) for dt in (0, 8)]:
        cells = {}
        for i, j in met:
            turn, scale = (int(b["turn"][j]) - int(a["turn"][i])) % 128, int(b["scale"][j]) / int(a["scale"][i])
            c, s, x, y = np.cos(turn * (2 * np.pi / 128)), np.sin(turn * (2 * np.pi / 128)), a["x"][i] - a["x"].mean(), a["y"][i] - a["y"].mean()
            at = ((b["x"][j] - scale * (c * x - s * y) + dx) // 12, (b["y"][j] - scale * (s * x + c * y) + dy) // 12, (turn + dt) % 128 // 16, scale)
            one, two = cells.setdefault(at, (set(), set()))
            one.add(i), two.add(j)
        best = max([best, *(min(len(one), len(two)) for one, two in cells.values())])
    return best


def test_many_pairs_are_decided_as_each_alone():
    rng = np.random.default_rng(9)
    originals = [media.render(rng.normal(size=64)) for _ in range(6)]
    copies = [(image, copy) for i, image in enumerate(originals) for copy in [*edits(image, i).values(), np.clip(image + rng.normal(0, 25, image.shape), 0, 255).astype(np.uint8), originals[i - 1], image[:30, :30]]]
    first, second = media.describe([a for a, _ in copies]), media.describe([b for _, b in copies])
    by_hand = [agreed(a, b) >= max(media.MIN_VOTES, media.MIN_SHARE * min(len(a), len(b))) for a, b in zip(first, second, strict=True)]
    assert media.linked_pairs(first, second).tolist() == by_hand == [media.linked(a, b) for a, b in zip(first, second, strict=True)]
    assert 0.3 < np.mean(by_hand) < 0.9


@pytest.mark.parametrize("shape", [(40, 61), (media.MATRIX + 3, 50)])
def test_means(shape):
    a, r = np.random.default_rng(10).integers(0, 256, (2, *shape)).astype(float), 8
    padded = np.pad(a, ((0, 0), (r, r), (r, r)), mode="edge")
    plain = np.array([[[p[y : y + 2 * r + 1, x : x + 2 * r + 1].sum() for x in range(shape[1])] for y in range(shape[0])] for p in padded]) / 289
    assert np.allclose(media.means(a, r), plain, rtol=1e-12)
    for k in (1, 2):
        assert np.allclose(media.inner_means(a, k), media.means(a, k)[:, k:-k, k:-k], rtol=1e-12)
    assert not np.ptp(media.means(np.full((1, *shape), 77.0), r))
