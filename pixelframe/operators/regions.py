"""Connected regions of masks and their measurements.

Regions are kept as runs (image_id, label, y, x0, x1). Sizes, places and moments come from the runs by closed sums; only
measurements that need neighbours make pixels of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.functions.scalars import equivalent_diameter, gray, hsv, ratio_safe
from pixelframe.operators.groups import whole_groups

REGION = ["image_id", "label"]
#: Frames of several images are laid one below the other up to this many pixels.
MOST_PIXELS = 1 << 22


def run_roots(group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """The first run of each run's 8-connected component, for runs sorted by group, y and x0.

    Runs of neighbouring lines that touch are found by two binary searches for all at once. The smallest reachable run
    then spreads along these links, with pointer jumping, until nothing changes.
    """
    n = len(y)
    left = int(x0.min(initial=0)) - 2
    width = int(x1.max(initial=0)) - left + 3
    line = (group * (int(y.max(initial=0)) - int(y.min(initial=0)) + 3) + (y - int(y.min(initial=0)) + 1)) * width
    first = np.searchsorted(line + x1 - left, line + width + x0 - 1 - left)  # next line's first run that ends late enough
    last = np.searchsorted(line + x0 - left, line + width + x1 + 1 - left, "right")  # and the first that begins too late
    count = np.maximum(last - first, 0)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        new = new[root]
        if np.array_equal(new, root):
            return root
        root = new


def label_regions(runs: DataFrame, group: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """8-connected components of runs within each group, labelled 1, 2, ... in raster order of their first pixels.

    Components never leave their image, so one exchange by image is enough: tasks label all their images at once.
    An image's runs are bounded by its frame, and images are many, so no task gets an unbounded group.
    """
    keys = list(group)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, keys):
            columns = [whole[k].to_numpy() for k in keys]
            new = np.any([np.concatenate([[True], c[1:] != c[:-1]]) for c in columns], axis=0)
            number = np.cumsum(new) - 1
            root = run_roots(number, *(whole[k].to_numpy().astype(np.int64) for k in ("y", "x0", "x1")))
            is_root = root == np.arange(len(root))
            rank = np.cumsum(is_root)
            before = (rank - is_root)[np.flatnonzero(new)]
            out = whole.append_column("label", pa.array((rank[root] - before[number]).astype(np.int64)))
            yield from out.combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    return runs.repartition(*keys).sortWithinPartitions(*keys, "y", "x0").mapInArrow(label, f"{fields}, label long")


def region_pixels(runs: DataFrame) -> DataFrame:
    return runs.select(*REGION, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def region_geometry(runs: DataFrame) -> DataFrame:
    """Box, size and centre of each region, with the integer sums that moments need (columns n, sx, sy, sxx, syy, sxy)."""
    n = (F.col("x1") - F.col("x0") + 1).cast("long")
    # sums of x and x * x over a run, in whole numbers
    sx = F.expr("(cast(x0 as bigint) + x1) * (x1 - x0 + 1) div 2")
    squares = lambda k: f"(cast({k} as bigint) * ({k} + 1) * (2 * {k} + 1) div 6)"
    sxx = F.expr(f"{squares('x1')} - {squares('(x0 - 1)')}")
    g = runs.groupBy(*REGION).agg(
        F.sum(n).alias("n"),
        F.sum(sx).alias("sx"),
        F.sum(n * F.col("y")).alias("sy"),
        F.sum(sxx).alias("sxx"),
        F.sum(n * F.col("y") * F.col("y")).alias("syy"),
        F.sum(sx * F.col("y")).alias("sxy"),
        F.min("x0").alias("bx"),
        F.min("y").alias("by"),
        (F.max("x1") - F.min("x0") + 1).alias("width"),
        (F.max("y") - F.min("y") + 1).alias("height"),
    )
    box = F.col("width") * F.col("height")
    x, y = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    return g.withColumns(
        {
            "area_exc": F.col("n"),
            "x": x,
            "y": y,
            "local_centroid_col": x - F.col("bx"),
            "local_centroid_row": y - F.col("by"),
            "bounding_box_area": box.cast("long"),
            "extent": F.col("n") / box,
            "equivalent_diameter": equivalent_diameter(F.col("n")),
        }
    )


def region_moments(geometry: DataFrame) -> DataFrame:
    """Axes, eccentricity, angle and elongation from the second central moments."""
    n = F.col("n").cast("double")
    # n * n times the moments are whole numbers
    moment = lambda s, p, q: (F.col("n") * F.col(s) - F.col(p) * F.col(q)) / (n * n)
    m = geometry.withColumns({"mxx": moment("sxx", "sx", "sx"), "myy": moment("syy", "sy", "sy"), "mxy": moment("sxy", "sx", "sy")})
    half, spread = (F.col("mxx") + F.col("myy")) / 2, F.sqrt(((F.col("mxx") - F.col("myy")) / 2) ** 2 + F.col("mxy") ** 2)
    m = m.withColumns({"l1": F.greatest(half + spread, F.lit(0.0)), "l2": F.greatest(half - spread, F.lit(0.0))})
    b = -F.col("mxy")
    # rows first: I00 is the spread along x, I11 that along y
    turn = F.when(F.col("mxx") == F.col("myy"), F.when(b < 0, F.pi() / 4).otherwise(-F.pi() / 4)).otherwise(0.5 * F.atan2(-2 * b + 0.0, F.col("myy") - F.col("mxx")))
    m = m.withColumns({"major": 4 * F.sqrt("l1"), "minor": 4 * F.sqrt("l2"), "eccentricity": F.when(F.col("l1") == 0, 0.0).otherwise(F.sqrt(1 - F.col("l2") / F.when(F.col("l1") > 0, F.col("l1")))), "angle": turn / F.pi() * 180 + 90})
    return m.withColumn("elongation", ratio_safe(F.col("major"), F.col("minor"))).drop("mxx", "myy", "mxy", "l1", "l2")


#: What a border pixel adds to the perimeter, by the code of its neighbours on the border.
PERIMETER_WEIGHTS = {1.0: (5, 7, 15, 17, 25, 27), 2.0**0.5: (21, 33), (1 + 2.0**0.5) / 2: (13, 23)}
_WEIGHT_OF = np.zeros(64)
for _weight, _codes in PERIMETER_WEIGHTS.items():
    _WEIGHT_OF[list(_codes)] = _weight
#: What a window of two by two pixels adds to four times the Euler number, by the pixels it holds (bits 1, 2, 4, 8).
_QUAD_GAIN = np.array([0, 1, 1, 0, 1, 0, -2, -1, 1, -2, 0, -1, 0, -1, -1, 0])


def _perimeters(m: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """Perimeters of the regions 1 .. n - 1 of a frame that has a margin of one pixel.

    Pixels that touch are of one region, so neighbours needn't be told apart by label.
    """
    inner = m.copy()
    for shift, axis in ((1, 0), (-1, 0), (1, 1), (-1, 1)):
        inner &= np.roll(m, shift, axis)
    border = m & ~inner
    b = border.astype(np.int8)
    code = 1 + 2 * (np.roll(b, 1, 0) + np.roll(b, -1, 0) + np.roll(b, 1, 1) + np.roll(b, -1, 1))
    for dy in (1, -1):
        line = np.roll(b, dy, 0)
        code += 10 * (np.roll(line, 1, 1) + np.roll(line, -1, 1))
    return np.bincount(labels[border], _WEIGHT_OF[code[border]], minlength=n)


def _eulers(m: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """One less the number of holes (background joined by sides) of regions 1 .. n - 1, from windows of two by two."""
    one = m.view(np.int8)
    quad = one[:-1, :-1] + 2 * one[:-1, 1:] + 4 * one[1:, :-1] + 8 * one[1:, 1:]
    label = np.maximum(np.maximum(labels[:-1, :-1], labels[:-1, 1:]), np.maximum(labels[1:, :-1], labels[1:, 1:]))
    some = quad > 0
    return np.rint(np.bincount(label[some], _QUAD_GAIN[quad[some]], minlength=n) / 4).astype(np.int32)


def _frames_of(image: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of runs, sorted by image, of images whose frames, one below the other, have up to MOST_PIXELS; at least one."""
    first = np.flatnonzero(np.concatenate([[True], image[1:] != image[:-1]]))
    tall = np.maximum.reduceat(y, first) - np.minimum.reduceat(y, first) + 3
    wide = np.maximum.reduceat(x1, first) - np.minimum.reduceat(x0, first) + 3
    begin, lines, width = 0, 0, 0
    for at, h, w in zip(first.tolist(), tall.tolist(), wide.tolist()):
        if at > begin and (lines + h) * max(width, w) > MOST_PIXELS:
            yield begin, at
            begin, lines, width = at, 0, 0
        lines, width = lines + h, max(width, w)
    yield begin, len(image)


def _shapes(image: np.ndarray, label: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> pa.RecordBatch:
    """What region_shapes tells of the regions of some images, whose frames, each with a margin of one pixel, are laid one
    below the other; so no pixels of two images touch."""
    first = np.flatnonzero(np.concatenate([[True], image[1:] != image[:-1]]))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(image))))
    most = label.max() + 1
    names, number = np.unique(of * most + label, return_inverse=True)
    top, left = np.minimum.reduceat(y, first) - 1, np.minimum.reduceat(x0, first) - 1
    tall = np.maximum.reduceat(y, first) - top + 2
    y, x0, x1 = y + (np.cumsum(tall) - tall - top)[of], x0 - left[of], x1 - left[of]
    labels = np.zeros((tall.sum(), x1.max() + 2), np.int32)
    size = x1 - x0 + 1
    x = np.repeat(x0 - np.cumsum(size) + size, size) + np.arange(size.sum())
    labels[np.repeat(y, size), x] = np.repeat(number + 1, size)
    m, n = labels > 0, len(names) + 1
    # each region's lines with their outermost pixels
    order = np.lexsort((x0, y, number))
    lines = number[order] * len(labels) + y[order]
    at = np.flatnonzero(np.concatenate([[True], lines[1:] != lines[:-1]]))
    convex = _hull_areas(number[order][at], x0[order][at], x1[order][np.append(at[1:], len(lines)) - 1])
    columns = (image[first][names // most], names % most, _perimeters(m, labels, n)[1:], _eulers(m, labels, n)[1:], convex)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*REGION, "perim", "euler_number", "convex_area"])


def region_shapes(runs: DataFrame) -> DataFrame:
    """perim (weights of border pixels by how the border goes on from them), euler_number (one less the number of holes)
    and convex_area of each region: one exchange of runs by image, then the frames of some images at once."""

    def shapes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, ["image_id"]):
            columns = [whole[c].to_numpy().astype(np.int64) for c in (*REGION, "y", "x0", "x1")]
            for low, high in _frames_of(columns[0], *columns[2:]):
                yield _shapes(*(c[low:high] for c in columns))

    placed = runs.select(*REGION, "y", "x0", "x1").repartition("image_id").sortWithinPartitions("image_id")
    return placed.mapInArrow(shapes, "image_id long, label long, perim double, euler_number int, convex_area long")


def region_perimeter(runs: DataFrame) -> DataFrame:
    return region_shapes(runs).select(*REGION, "perim")


def region_euler(runs: DataFrame) -> DataFrame:
    return region_shapes(runs).select(*REGION, "euler_number")


def region_convex(runs: DataFrame) -> DataFrame:
    return region_shapes(runs).select(*REGION, "convex_area")


def region_holes(runs: DataFrame, geometry: DataFrame) -> DataFrame:
    """Runs of background inside the regions' boxes that no 8-connected path of background joins with the outside.

    Each line of a box, with a margin of one pixel, is what its runs leave free; components of that are labelled, and
    the first, which holds the margin, is the outside.
    """
    lines = geometry.select(*REGION, "bx", "by", "width", "height", F.explode(F.sequence(F.col("by") - 1, F.col("by") + F.col("height"))).alias("y"))
    held = runs.groupBy(*REGION, "y").agg(F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("held"))
    rows = lines.join(held, [*REGION, "y"], "left").withColumn("held", F.coalesce("held", F.expr("cast(array() as array<struct<x0:int,x1:int>>)")))
    ends = F.concat(F.transform("held", lambda r: r["x0"] - 1), F.array(F.col("bx") + F.col("width")))
    starts = F.concat(F.array(F.col("bx") - 1), F.transform("held", lambda r: r["x1"] + 1))
    free = rows.select(*REGION, "y", F.explode(F.arrays_zip(starts.alias("x0"), ends.alias("x1"))).alias("r"))
    free = free.select("image_id", F.col("label").alias("region"), "y", F.col("r.x0").alias("x0"), F.col("r.x1").alias("x1")).filter("x0 <= x1")
    return label_regions(free, ("image_id", "region")).filter("label > 1").select("image_id", F.col("region").alias("label"), "y", "x0", "x1")


def region_filled_area(geometry: DataFrame, holes: DataFrame) -> DataFrame:
    """area: pixels with those of holes."""
    inside = holes.groupBy(*REGION).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("hole"))
    return geometry.join(inside, REGION, "left").select(*REGION, (F.col("n") + F.coalesce("hole", F.lit(0))).alias("area"))


#: Corners that are laid out side by side at once.
_CORNERS = 1 << 21


def _hull_lefts(height: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leftmost pixel centre inside the hull on each line, for many shapes at once.

    height: lines of each shape, from tall to low; left: each line's leftmost pixel, shape after shape. A hull is that of
    the middles of the pixels' edges; in halves of pixels they lie at the even places between lines, and half a pixel
    further left at the odd places of the lines themselves. All shapes drop corners that aren't convex side by side,
    a place at a time, so the work is a few array operations a place and a step for each corner dropped.
    """
    n, tall = len(height), int(height[0])
    first = np.cumsum(height) - height
    shape = np.repeat(np.arange(n), height)
    line = np.arange(len(left)) - first[shape]
    corner = np.full((n, 2 * tall + 1), np.iinfo(np.int64).max)
    corner[shape, 2 * line + 1] = 2 * left - 1
    for place in (2 * line, 2 * line + 2):  # the place above a line and that below it belong to two lines
        corner[shape, place] = np.minimum(corner[shape, place], 2 * left)
    at, x = np.zeros((2, n, 2 * tall + 1), np.int64)
    size = np.zeros(n, np.int64)
    still = np.searchsorted(-2 * height, -np.arange(2 * tall + 1), "right")  # shapes that have the place
    for place, m in enumerate(still.tolist()):
        new, open_ = corner[:, place], np.arange(m)
        while len(open_):
            open_ = open_[size[open_] > 1]
            b = size[open_] - 1
            ya, xa = at[open_, b - 1], x[open_, b - 1]
            open_ = open_[(at[open_, b] - ya) * (new[open_] - xa) <= (x[open_, b] - xa) * (place - ya)]
            size[open_] -= 1
        every = np.arange(m)
        at[every, size[:m]], x[every, size[:m]] = place, new[:m]
        size[:m] += 1
    kept = np.arange(2 * tall + 1) < size[:, None]
    ys, xs = at[kept], x[kept]
    wide = 2 * tall + 2
    b = np.searchsorted(np.repeat(np.arange(n), size) * wide + ys, shape * wide + 2 * line + 1)
    gap = ys[b] - ys[b - 1]
    twice = xs[b - 1] * gap + (xs[b] - xs[b - 1]) * (2 * line + 1 - ys[b - 1])
    return -(-twice // (2 * gap))


def _hull_areas(region: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Pixel centres in or on the hull of the middles of the pixels' edges, for each region of those told line after line
    with their outermost pixels. In whole numbers; shapes of like height are worked on together, in bounded arrays."""
    starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
    height = np.diff(np.append(starts, len(region)))
    order = np.argsort(-height, kind="stable")
    out = np.zeros(len(starts), np.int64)
    done = 0
    while done < len(order):
        some = order[done : done + max(1, _CORNERS // (2 * int(height[order[done]]) + 1))]
        done += len(some)
        tall = height[some]
        first = np.cumsum(tall) - tall
        lines = np.repeat(starts[some] - first, tall) + np.arange(tall.sum())
        inside = -_hull_lefts(tall, -x1[lines]) - _hull_lefts(tall, x0[lines]) + 1
        out[some] = np.add.reduceat(inside, first)
    return out


def _with_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (image_id, y, ...) with the channels of their lines. Rows that tell their dataset go to where lines are laid
    out by dataset and line, and the lines stay."""
    keys = [*(["dataset_id"] if "dataset_id" in rows.columns else []), "image_id", "y"]
    placed = rows.hint("shuffle_hash") if len(keys) == 3 else rows
    return lines.select(*keys, "b", "g", "r").join(placed, keys)


def region_colour(filled: DataFrame, lines: DataFrame) -> DataFrame:
    """Mean and population deviation of hue, saturation and value over runs of regions with their holes filled.

    Scanlines meet the runs on image and line; a run takes its part of the line's arrays.
    """
    part = lambda c: F.slice(c, F.col("x0") + 1, F.col("x1") - F.col("x0") + 1).alias(c)
    cut = _with_lines(filled, lines).select(*REGION, F.explode(F.arrays_zip(part("b"), part("g"), part("r"))).alias("p"))
    h, s, v = hsv(F.col("p.b"), F.col("p.g"), F.col("p.r"))
    cut = cut.select(*REGION, h.alias("Hue"), s.alias("Saturation"), v.alias("Value"))
    names = ("Hue", "Saturation", "Value")
    sums = cut.groupBy(*REGION).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in names], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in names])
    mean = [(F.col(f"s_{c}") / F.col("n")).alias(f"Mean{c}") for c in names]
    std = [(F.sqrt((F.col("n") * F.col(f"q_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}")).cast("double")) / F.col("n")).alias(f"Std{c}") for c in names]
    return sums.select(*REGION, *mean, *std)


def region_blur(geometry: DataFrame, lines: DataFrame) -> DataFrame:
    """blur_laplacian: population variance of the Laplacian of gray values in the box; edges are mirrored."""
    box = geometry.select(*REGION, *(["dataset_id"] if "dataset_id" in geometry.columns else []), "bx", "width", F.explode(F.sequence(F.col("by"), F.col("by") + F.col("height") - 1)).alias("y"))
    cut = lambda c: F.slice(c, F.col("bx") + 1, F.col("width")).alias(c)
    crop = _with_lines(box, lines).select(*REGION, "y", cut("b"), cut("g"), cut("r"))
    # gray values of the boxes alone
    row = crop.select(*REGION, "y", F.transform(F.arrays_zip("b", "g", "r"), lambda p: gray(p["b"], p["g"], p["r"])).alias("c"))
    down = Window.partitionBy(*REGION).orderBy("y")
    above, below = F.lag("c").over(down), F.lead("c").over(down)
    row = row.withColumns({"up": F.coalesce(above, below, F.col("c")), "low": F.coalesce(below, above, F.col("c"))})

    def laplacian(c: Column, x: Column) -> Column:
        left, right = F.get("c", x - 1), F.get("c", x + 1)
        sides = F.coalesce(left, right, c) + F.coalesce(right, left, c)
        return F.get("up", x) + F.get("low", x) + sides - 4 * c

    values = row.select(*REGION, F.explode(F.transform("c", laplacian)).alias("l"))
    sums = values.groupBy(*REGION).agg(F.count("*").alias("n"), F.sum("l").alias("s"), F.sum(F.col("l").cast("long") * F.col("l")).alias("q"))
    return sums.select(*REGION, ((F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n"))).alias("blur_laplacian"))


def keep_large(geometry: DataFrame, least: float = 20) -> DataFrame:
    """Regions whose equivalent diameter reaches the least."""
    return geometry.filter(F.col("equivalent_diameter") >= least)


def object_index(regions: DataFrame) -> DataFrame:
    """i: a kept region's place in its image, in raster order."""
    return regions.withColumn("i", F.row_number().over(Window.partitionBy("image_id").orderBy("label")) - 1)


def crop_objects(geometry: DataFrame, lines: DataFrame, pad: int = 10) -> DataFrame:
    """Scanlines of the regions' boxes with a margin, cut at the image's edges: image_id, label, y, x0, b, g, r."""
    box = geometry.select(*REGION, F.greatest(F.col("bx") - pad, F.lit(0)).alias("x0"), (F.col("bx") + F.col("width") + pad).alias("x1"), F.greatest(F.col("by") - pad, F.lit(0)).alias("y0"), (F.col("by") + F.col("height") + pad - 1).alias("y1"))
    # lines are expanded, so the join is on equal keys
    box = box.withColumn("y", F.explode(F.sequence("y0", "y1")))
    cut = lambda c: F.slice(c, F.col("x0") + 1, F.least(F.col("x1"), F.col("w")) - F.col("x0")).alias(c)
    return box.join(lines, ["image_id", "y"]).select(*REGION, "y", "x0", *[cut(c) for c in "bgr"])
