"""Mask and region operators against small NumPy re-derivations on random images."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import mask as M
from pixelframe.operators import pixels as P
from pixelframe.operators import regions as R
from pixelframe.plans import segmentation as G

H, W = 14, 17
MASK = "dataset_id long, image_id long, seq long, h int, w int, y int, x int"


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(4)
    out = [rng.random((H, W)) < p for p in (0.15, 0.35, 0.5, 0.65, 0.85)]
    ring = np.zeros((H, W), bool)
    ring[2:9, 3:12] = True
    ring[4:7, 5:10] = False
    ring[5, 7] = True
    return [*out, ring, np.zeros((H, W), bool), np.ones((H, W), bool)]


@pytest.fixture(scope="module")
def mask_df(spark, masks):
    rows = [(1, k, k, H, W, int(y), int(x)) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, MASK)


def as_masks(df, n):
    out = [np.zeros((H, W), bool) for _ in range(n)]
    for r in df.collect():
        out[r.image_id][r.y, r.x] = True
    return out


def brute_morph(m, kernel, erode):
    out = np.zeros_like(m)
    h, w = m.shape
    for y in range(h):
        for x in range(w):
            hits = [m[y + dy, x + dx] for dy, dx in kernel if 0 <= y + dy < h and 0 <= x + dx < w]
            out[y, x] = all(hits) if erode else any(hits)
    return out


@pytest.mark.parametrize("kernel", [M.SQUARE, M.ELLIPSE])
def test_erode_and_dilate(mask_df, masks, kernel):
    for got, m in zip(as_masks(M.erode(mask_df, kernel), len(masks)), masks):
        assert np.array_equal(got, brute_morph(m, kernel, True))
    for got, m in zip(as_masks(M.dilate(mask_df, kernel), len(masks)), masks):
        assert np.array_equal(got, brute_morph(m, kernel, False))


def test_ellipse_has_53_cells():
    assert len(M.ELLIPSE) == 53 and len(M.SQUARE) == 4


def test_previous_mask(mask_df, masks):
    got = as_masks(M.remove_previous_mask(mask_df), len(masks))
    for k, m in enumerate(masks):
        assert np.array_equal(got[k], m & ~masks[k - 1] if k else m)


def test_unknown_operation(mask_df):
    with pytest.raises(ValueError):
        M.mask_pipeline(mask_df, ["sharpen"])


def test_pipeline_of_images_of_several_sizes(spark, monkeypatch):
    """Sizes are the images' own; stages, runs and pixels agree with one operation after the other."""
    rng = np.random.default_rng(9)
    shapes = [(5, 30), (5, 30), (40, 9), (1, 1), (23, 23), (5, 30), (3, 7)]
    images = [rng.random(shape) < 0.7 for shape in shapes]
    rows = [(1, k, k, *m.shape, int(y), int(x)) for k, m in enumerate(images) for y, x in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, MASK).repartition(3)
    names = ["no_op", "erode", "dilate", "close", "erode2"]
    want: dict[int, dict[int, np.ndarray]] = {0: {k: m for k, m in enumerate(images)}}
    for k, m in enumerate(images):
        want.setdefault(1, {})[k] = one = brute_morph(m, M.SQUARE, True)
        want.setdefault(2, {})[k] = two = brute_morph(one, M.ELLIPSE, False)
        want.setdefault(3, {})[k] = three = brute_morph(brute_morph(two, M.ELLIPSE, False), M.ELLIPSE, True)
        want.setdefault(4, {})[k] = brute_morph(three, M.ELLIPSE, True)
    spots = lambda masks: {(k, int(y), int(x)) for k, m in masks.items() for y, x in zip(*np.nonzero(m))}
    for most in (M.MOST_PIXELS, 200):
        monkeypatch.setattr(M, "MOST_PIXELS", most)
        assert {(r.image_id, r.y, r.x) for r in M.mask_pipeline(df, names).collect()} == spots(want[4])
        runs = M.pipeline_runs(df, names).collect()
        assert {(r.image_id, r.y, x) for r in runs for x in range(r.x0, r.x1 + 1)} == spots(want[4])
        assert sorted(map(tuple, runs)) == sorted(map(tuple, M.mask_runs(M.mask_pipeline(df, names)).select(runs[0].__fields__).collect()))
    stages = M.stage_masks(df, names).collect()
    assert {(r.k, r.stage) for r in stages} == set(enumerate(names))
    for k in range(5):
        assert {(r.image_id, r.y, r.x) for r in stages if r.k == k} == spots(want[k])
    first = M.stage_masks(df, ["remove_previous_mask", "erode"]).filter("k = 0").count()
    assert first == M.remove_previous_mask(df).count()
    counts = {(r.image_id, r.y, r.x): r.n for r in M.neighbour_counts(df).collect()}
    for k, m in enumerate(images):
        p = np.pad(m, 1).astype(int)
        n = sum(p[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]] for dy, dx in M.AROUND)
        assert all(counts[k, int(y), int(x)] == n[y, x] for y, x in zip(*np.nonzero(m)))


def brute_labels(m, steps):
    labels, n = np.zeros(m.shape, int), 0
    for y, x in zip(*np.nonzero(m)):
        if labels[y, x]:
            continue
        n += 1
        queue = deque([(y, x)])
        labels[y, x] = n
        while queue:
            a, b = queue.popleft()
            for dy, dx in steps:
                c, d = a + dy, b + dx
                if 0 <= c < m.shape[0] and 0 <= d < m.shape[1] and m[c, d] and not labels[c, d]:
                    labels[c, d] = n
                    queue.append((c, d))
    return labels, n


EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


@pytest.fixture(scope="module")
def runs(mask_df):
    return R.label_regions(M.mask_runs(mask_df)).cache()


def regions_of(masks):
    for k, m in enumerate(masks):
        labels, n = brute_labels(m, EIGHT)
        for r in range(1, n + 1):
            yield k, r, labels == r


def test_labels_in_raster_order(runs, masks):
    got = {(r.image_id, r.y, r.x): r.label for r in R.region_pixels(runs).collect()}
    want = {(k, int(y), int(x)): r for k, r, m in regions_of(masks) for y, x in zip(*np.nonzero(m))}
    assert got == want


def test_labels_of_a_spiral(spark):
    n = 31
    m = np.zeros((n, n), bool)
    y = x = 0
    dy, dx, step = 0, 1, n - 1
    m[0, 0] = True
    turns = 0
    while step > 1:
        for _ in range(step):
            y, x = y + dy, x + dx
            m[y, x] = True
        dy, dx = dx, -dy
        turns += 1
        if turns > 2 and turns % 2 == 1:
            step -= 2
    rows = [(1, 1, 0, n, n, int(a), int(b)) for a, b in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, MASK)
    assert R.label_regions(M.mask_runs(df)).select("label").distinct().count() == brute_labels(m, EIGHT)[1]


def holes_of(m, steps):
    padded = np.pad(~m, 1, constant_values=True)
    labels, n = brute_labels(padded, steps)
    return (labels > 1)[1:-1, 1:-1] & ~m, n - 1


def test_geometry_and_moments(runs, masks):
    got = {(r.image_id, r.label): r for r in R.region_moments(R.region_geometry(runs)).collect()}
    for k, r, m in regions_of(masks):
        g = got[k, r]
        ys, xs = np.nonzero(m)
        assert (g.bx, g.by, g.width, g.height, g.area_exc) == (xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, len(xs))
        assert math.isclose(g.x, xs.mean()) and math.isclose(g.y, ys.mean())
        c = np.cov(xs, ys, bias=True) if len(xs) > 1 else np.zeros((2, 2))
        low, high = np.sort(np.maximum(np.linalg.eigvalsh(c), 0))
        assert math.isclose(g.major, 4 * math.sqrt(high), abs_tol=1e-6) and math.isclose(g.minor, 4 * math.sqrt(low), abs_tol=1e-5)


def test_filled_area_and_euler(runs, masks):
    geometry = R.region_geometry(runs)
    area = {(r.image_id, r.label): r.area for r in R.region_filled_area(geometry, R.region_holes(runs, geometry)).collect()}
    euler = {(r.image_id, r.label): r.euler_number for r in R.region_euler(runs).collect()}
    for k, r, m in regions_of(masks):
        assert area[k, r] == m.sum() + holes_of(m, EIGHT)[0].sum()
        assert euler[k, r] == 1 - holes_of(m, FOUR)[1]


def test_perimeter(runs, masks):
    got = {(r.image_id, r.label): r.perim for r in R.region_perimeter(runs).collect()}
    weight = {c: w for w, codes in R.PERIMETER_WEIGHTS.items() for c in codes}
    for k, r, m in regions_of(masks):
        p = np.pad(m, 1)
        border = p & ~(p & np.roll(p, 1, 0) & np.roll(p, -1, 0) & np.roll(p, 1, 1) & np.roll(p, -1, 1))
        total = 0.0
        for y, x in zip(*np.nonzero(border)):
            code = 1 + 2 * sum(border[y + a, x + b] for a, b in FOUR) + 10 * sum(border[y + a, x + b] for a, b in EIGHT if a and b)
            total += weight.get(int(code), 0)
        assert math.isclose(got[k, r], total, abs_tol=1e-9)


def test_convex_area(runs, masks):
    got = {(r.image_id, r.label): r.convex_area for r in R.region_convex(runs).collect()}
    for k, r, m in regions_of(masks):
        points = np.array([p for y, x in zip(*np.nonzero(m)) for p in ((y - 0.5, x), (y + 0.5, x), (y, x - 0.5), (y, x + 0.5))])
        inside = 0
        angles = np.linspace(0, np.pi, 721)
        normals = np.stack([np.cos(angles), np.sin(angles)], 1)
        # edges' own normals make the test exact
        edges = {(a, b) for a in range(-H, H + 1) for b in range(-W, W + 1)}
        normals = np.array([(a, b) for a, b in edges if a or b], float)
        low, high = (points @ normals.T).min(0), (points @ normals.T).max(0)
        ys, xs = np.nonzero(m)
        for y in range(ys.min(), ys.max() + 1):
            for x in range(xs.min(), xs.max() + 1):
                v = normals @ (y, x)
                inside += bool((v >= low - 1e-9).all() and (v <= high + 1e-9).all())
        assert got[k, r] == inside


def test_hulls_of_large_shapes():
    """Against the lowest of all lines between any two corners, for shapes of very unlike height, side by side."""
    from fractions import Fraction

    rng = np.random.default_rng(8)

    def reach(x):
        corners = [(y + d, Fraction(v) - (0 if d else Fraction(1, 2))) for y, v in enumerate(x) for d in (Fraction(-1, 2), 0, Fraction(1, 2))]
        pairs = lambda y: (xa + (xb - xa) * (y - ya) / (yb - ya) for ya, xa in corners if ya < y for yb, xb in corners if yb > y)
        return [math.ceil(min(pairs(y))) for y in range(len(x))]

    shapes, want = [], []
    for h in (1, 1, 2, 3, 17, 12, 1, 20, 5):
        x0 = (50 + np.cumsum(rng.integers(-6, 7, h))).tolist()
        x1 = [v + int(rng.integers(0, 9)) for v in x0]
        shapes.append((x0, x1))
        want.append(sum(-a - b + 1 for a, b in zip(reach([-v for v in x1]), reach(x0))))
    number = np.repeat(np.arange(len(shapes)), [len(a) for a, _ in shapes])
    lines = [np.array([v for s in shapes for v in s[k]]) for k in (0, 1)]
    assert R._hull_areas(number, *lines).tolist() == want


@pytest.fixture(scope="module")
def colour(spark, masks):
    rng = np.random.default_rng(6)
    images = rng.integers(0, 256, (len(masks), H, W, 3))
    rows = [(1, k, k, y, W, H, *[images[k, y, :, c].tolist() for c in range(3)]) for k in range(len(masks)) for y in range(H)]
    return images, spark.createDataFrame(rows, "dataset_id long, image_id long, seq long, y int, w int, h int, b array<int>, g array<int>, r array<int>").cache()


def gray_of(image):
    b, g, r = (image[..., c].astype(int) for c in range(3))
    return (r * 9798 + g * 19235 + b * 3735 + 16384) >> 15


def test_blur(runs, masks, colour):
    images, lines = colour
    got = {(r.image_id, r.label): r.blur_laplacian for r in R.region_blur(R.region_geometry(runs), lines).collect()}
    for k, r, m in regions_of(masks):
        ys, xs = np.nonzero(m)
        c = gray_of(images[k])[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
        p = np.pad(c, 1, mode="reflect") if min(c.shape) > 1 else np.pad(np.pad(c, ((1, 1), (0, 0)), mode="reflect" if c.shape[0] > 1 else "edge"), ((0, 0), (1, 1)), mode="reflect" if c.shape[1] > 1 else "edge")
        lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * c
        assert math.isclose(got[k, r], lap.var(), abs_tol=1e-6)


def test_colour_over_filled_regions(runs, masks, colour):
    images, lines = colour
    geometry = R.region_geometry(runs)
    filled = runs.select("image_id", "label", "y", "x0", "x1").unionByName(R.region_holes(runs, geometry))
    got = {(r.image_id, r.label): r for r in R.region_colour(filled, lines).collect()}
    for k, r, m in regions_of(masks):
        full = m | holes_of(m, EIGHT)[0]
        v = images[k].max(-1)[full]
        assert math.isclose(got[k, r].MeanValue, v.mean()) and math.isclose(got[k, r].StdValue, v.std(), abs_tol=1e-6)


def test_median_and_correction(colour, spark):
    images, lines = colour
    k = 7
    flat = P.median_flat(lines.filter(F.col("seq") < k)).orderBy("y").collect()
    want = np.sort(images[:k], axis=0)[k // 2]
    assert np.array_equal(np.array([[r.b, r.g, r.r] for r in flat]).transpose(0, 2, 1), want)
    got = {(r.image_id, r.y): (r.b, r.g, r.r) for r in P.flat_correct(lines, P.median_flat(lines.filter(F.col("seq") < k))).collect()}
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(want > 0, images / np.where(want > 0, want, 1), 9.0 * (images > 0))
    out = np.floor(np.clip(ratio, 0, 1.04) / 1.04 * 255).astype(int)
    out = np.where(want > 0, out, 255 * (images > 0))
    out[:, 0, 0] = 0
    for (i, y), channels in got.items():
        assert np.array_equal(np.array(channels).T, out[i, y])


def triangle(hist):
    lo, hi, p = (np.nonzero(hist)[0][0], np.nonzero(hist)[0][-1], int(np.argmax(hist)))
    lo, hi = max(lo - 1, 0), min(hi + 1, 255)
    flip = p - lo < hi - p
    h = hist[::-1] if flip else hist
    if flip:
        lo, p = 255 - hi, 255 - p
    best, t = 0, lo
    for i in range(lo + 1, p + 1):
        v = h[p] * i + (lo - p) * h[i]
        if v > best:
            best, t = v, i
    t -= 1
    return 255 - t if flip else t


def test_thresholds(colour):
    images, lines = colour
    grays = P.gray_lines(lines)
    hist = {r.image_id: np.array(r.hist) for r in P.gray_histogram(grays).collect()}
    got = {r.image_id: r.threshold for r in P.triangle_threshold(P.gray_histogram(grays)).collect()}
    for k in range(len(images)):
        assert np.array_equal(hist[k], np.bincount(gray_of(images[k]).ravel(), minlength=256))
        assert got[k] == triangle(hist[k])
    fg = as_masks(P.below_threshold(grays, P.triangle_threshold(P.gray_histogram(grays))), len(images))
    assert all(np.array_equal(fg[k], gray_of(images[k]) <= got[k]) for k in got)
    adaptive = as_masks(P.adaptive_threshold(grays), len(images))
    for k, image in enumerate(images):
        g = gray_of(image)
        p = np.pad(g, 9, mode="edge")
        total = sum(p[a : a + H, b : b + W] for a in range(19) for b in range(19))
        assert np.array_equal(adaptive[k], g * 361 <= total - 4 * 361)


def test_measurements_move_with_the_image(spark, masks):
    m = masks[5]
    rows = [(1, k, k, 30, 40, int(y) + k, int(x) + 2 * k) for k in range(3) for y, x in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, MASK)
    lines = spark.createDataFrame([(1, k, k, y, 40, 30, [5] * 40, [6] * 40, [7] * 40) for k in range(3) for y in range(30)], "dataset_id long, image_id long, seq long, y int, w int, h int, b array<int>, g array<int>, r array<int>")
    got = sorted(G.measure(R.label_regions(M.mask_runs(df)), lines, 1).collect(), key=lambda r: (r.image_id, r.label))
    first = {r.label: r for r in got if r.image_id == 0}
    assert len(got) == 3 * len(first)
    for r in got:
        was = first[r.label]
        assert (r.bx, r.by) == (was.bx + 2 * r.image_id, was.by + r.image_id)
        for c in ("area", "perim", "major", "minor", "angle", "euler_number", "convex_area", "eccentricity", "local_centroid_row"):
            assert math.isclose(r[c], was[c], abs_tol=1e-9), c


def test_cumulative_average_is_the_recurrence(spark):
    rng = np.random.default_rng(2)
    counts = [(d, s, int(n)) for d in range(6) for s, n in enumerate(rng.integers(0, 60, 40))]
    got = {(r.dataset_id, r.seq): r for r in G.flat_epochs(spark.createDataFrame(counts, "dataset_id long, seq long, n long")).collect()}
    for d in range(6):
        cma, epoch = 0.0, 0
        for s, n in [(s, n) for e, s, n in counts if e == d]:
            r = got[d, s]
            assert r.epoch == epoch
            assert r.trigger == (cma != 0 and n > cma + 20 + 1e-9) or abs(n - cma - 20) < 1e-6
            epoch += r.trigger
            cma = (cma * s + n) / (s + 1)


def shifted_morph(m, kernel, erode):
    """brute_morph for larger frames: one shift of the whole frame for each of the kernel's cells."""
    p = np.pad(m, 9, constant_values=erode)
    some = [p[9 + dy : 9 + dy + m.shape[0], 9 + dx : 9 + dx + m.shape[1]] for dy, dx in kernel]
    return np.logical_and.reduce(some) if erode else np.logical_or.reduce(some)


def brute_segment(images, excess, most_epochs, names, least=0.0):
    """The feedback image by image: foreground pixels of kept regions, and how many backgrounds were new."""
    count, first, used, out, counts, epochs = len(images), 0, min(len(images), 10), set(), [], 0
    used -= used % 2 == 0
    again, previous = False, None
    for i in range(count):
        if again and epochs < most_epochs:
            epochs += 1
            first, stop = (0, 10) if count == 10 else (max(i - 10, 0), i) if i > count - 11 else (i, i + 10)
            used = 9 if stop - first == 10 else stop - first
        flat = np.sort(images[first : first + used], axis=0)[used // 2]
        ratio = np.floor(np.clip(images[i] / flat, 0, 1.04) / 1.04 * 255).astype(int)
        ratio[0, 0] = 0
        g = gray_of(ratio)
        raw = m = g <= triangle(np.bincount(g.ravel(), minlength=256))
        for name in names:
            if name == "remove_previous_mask":
                m = m & ~previous if previous is not None else m
            elif name == "erode":
                m = shifted_morph(m, M.SQUARE, True)
            elif name != "no_op":
                for erosion in {"dilate": (False,), "close": (False, True), "erode2": (True,)}[name]:
                    m = shifted_morph(m, M.ELLIPSE, erosion)
        previous = raw
        labels, n = brute_labels(m, EIGHT)
        kept = [k for k in range(1, n + 1) if math.sqrt(4 * (labels == k).sum() / math.pi) >= least]
        out |= {(i, int(y), int(x)) for k in kept for y, x in zip(*np.nonzero(labels == k))}
        again = bool(sum(counts)) and len(kept) > sum(counts) / len(counts) + excess
        counts.append(len(kept))
    return out, epochs


def colour_lines(spark, images):
    rows = [(1, k, k, y, image.shape[1], image.shape[0], *(image[y, :, c].tolist() for c in range(3))) for k, image in enumerate(images) for y in range(image.shape[0])]
    return spark.createDataFrame(rows, "dataset_id long, image_id long, seq long, y int, w int, h int, b array<int>, g array<int>, r array<int>")


@pytest.mark.parametrize("count", [10, 12])
def test_background_feedback_goes_on_to_the_last_trigger(spark, monkeypatch, count):
    monkeypatch.setattr(M, "pipeline_names", lambda *_: ["no_op"])
    monkeypatch.setattr(G, "measure", lambda regions, *_: R.region_pixels(regions))
    images = np.random.default_rng(5).integers(100, 256, (count, 8, 8, 3))
    want, epochs = brute_segment(images, -4, 99, ["no_op"])
    assert epochs >= min(count - 4, 9)
    got = G.segment(colour_lines(spark, images), 1, excess=-4).select("image_id", "y", "x").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("previous", [False, True])
def test_segmentation_with_planted_jumps(spark, tmp_path, previous):
    """Spots on an even ground, many more of them in some images, with the whole pipeline of operations."""
    rng = np.random.default_rng(8)
    images = rng.integers(205, 215, (14, 120, 150, 3))
    for k in range(14):
        cells = [(30 * a, 30 * b) for a in range(4) for b in range(5)]
        rng.shuffle(cells)
        for y, x in cells[: 13 if k in (5, 9, 10) else 3]:
            images[k, y + 8 : y + 15, x + 8 : x + 15] //= 3
    want, epochs = brute_segment(images, 3, 99, M.pipeline_names(previous), 2.0)
    assert epochs >= 2
    rows = G.segment(colour_lines(spark, images), 2.0, 3, previous, str(tmp_path / "stages")).collect()
    assert sum(r.area_exc for r in rows) == len(want) and {r.image_id for r in rows} == {i for i, _, _ in want}
    masks = spark.read.parquet(str(tmp_path / "stages" / "epoch=0")).filter("k = 4")
    assert masks.select("image_id").distinct().count() == 14 and (tmp_path / "stages" / f"epoch={epochs}").exists()
