"""Masks as sparse relations of foreground pixels: morphology, subtraction of the previous mask, runs.

A mask has a row a foreground pixel: dataset_id, image_id, seq, h, w (the image's size) and y, x. Operations that look
at a pixel's surroundings bring each image together once and work on its dense frame; images may differ in size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.operators.groups import whole_groups

IMAGE = ["dataset_id", "image_id", "seq", "h", "w"]
PIXELS = "dataset_id long, image_id long, seq long, h int, w int, y int, x int"
RUNS = "dataset_id long, image_id long, seq long, h int, w int, y int, x0 int, x1 int"
#: Frames of one size are worked on together up to this many pixels.
MOST_PIXELS = 1 << 24

#: Fixed value: columns that the 8 x 8 ellipse holds in each of its rows; its anchor is (4, 4).
_ELLIPSE_ROWS = ((4, 4), (1, 7), (1, 7), (0, 7), (0, 7), (0, 7), (1, 7), (1, 7))
ELLIPSE = [(row - 4, column - 4) for row, (first, last) in enumerate(_ELLIPSE_ROWS) for column in range(first, last + 1)]
#: The 2 x 2 square with its anchor at (1, 1).
SQUARE = [(dy, dx) for dy in (-1, 0) for dx in (-1, 0)]
AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]

Kernel = list[tuple[int, int]]
Stencil = Callable[[np.ndarray], np.ndarray]


def _shifted_or(out: np.ndarray, m: np.ndarray, dy: int, dx: int) -> None:
    """out[y, x] |= m[y + dy, x + dx] where that is inside."""
    h, w = m.shape[1:]
    if abs(dy) < h and abs(dx) < w:
        out[:, max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)] |= m[:, max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]


def dilated(m: np.ndarray, kernel: Kernel = ELLIPSE) -> np.ndarray:
    """Places from which the kernel reaches any foreground, for frames (n, h, w).

    Each of the kernel's rows is a run; runs of equal ends are spread along the lines once, then lines are united.
    """
    rows: dict[int, list[int]] = {}
    for dy, dx in kernel:
        rows.setdefault(dy, []).append(dx)
    spread: dict[tuple[int, ...], np.ndarray] = {}
    out = np.zeros_like(m)
    for dy, reach in rows.items():
        key = tuple(sorted(reach))
        if key not in spread:
            line = np.zeros_like(m)
            for dx in key:
                _shifted_or(line, m, 0, dx)
            spread[key] = line
        _shifted_or(out, spread[key], dy, 0)
    return out


def eroded(m: np.ndarray, kernel: Kernel = SQUARE) -> np.ndarray:
    """Places from which the kernel reaches foreground alone; what it reaches outside the image doesn't count."""
    return ~dilated(~m, kernel)


def _dense(group: pa.Table, columns: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], list[np.ndarray]]]:
    """Batches of images of one size of a table sorted by image: which image each row is of, the images' first rows,
    IMAGE columns of these, and the other columns."""
    image = group["image_id"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], image[1:] != image[:-1]]))
    ends = np.append(first[1:], len(image))
    h, w = (group[c].to_numpy()[first] for c in ("h", "w"))
    at = 0
    while at < len(first):
        stop = at + 1
        while stop < len(first) and (h[stop], w[stop]) == (h[at], w[at]) and (stop - at + 1) * int(h[at]) * int(w[at]) <= MOST_PIXELS:
            stop += 1
        low, high = int(first[at]), int(ends[stop - 1])
        of = np.repeat(np.arange(stop - at), ends[at:stop] - first[at:stop])
        part = group.slice(low, high - low)
        keys = {c: part[c].to_numpy()[first[at:stop] - low] for c in IMAGE}
        yield of, first[at:stop] - low, keys, [part[c].to_numpy() for c in columns]
        at = stop


def _pixels(m: np.ndarray, keys: dict[str, np.ndarray], **more: np.ndarray) -> pa.RecordBatch:
    n, y, x = np.nonzero(m)
    columns = {**{c: keys[c][n] for c in IMAGE}, "y": y.astype(np.int32), "x": x.astype(np.int32), **{k: np.full(len(n), v) for k, v in more.items()}}
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _runs(m: np.ndarray, keys: dict[str, np.ndarray]) -> pa.RecordBatch:
    edge = np.diff(np.pad(m, ((0, 0), (0, 0), (1, 1))).astype(np.int8), axis=2)
    n, y, x0 = np.nonzero(edge == 1)
    x1 = np.nonzero(edge == -1)[2] - 1
    columns = {**{c: keys[c][n] for c in IMAGE}, "y": y.astype(np.int32), "x0": x0.astype(np.int32), "x1": x1.astype(np.int32)}
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _framewise(mask: DataFrame, make: Callable[[np.ndarray, dict[str, np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply make to dense frames (n, h, w) of the mask's images: one exchange by image."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["image_id"]):
            for of, _, keys, (y, x) in _dense(group, ("y", "x")):
                m = np.zeros((len(keys["h"]), int(keys["h"][0]), int(keys["w"][0])), bool)
                m[of, y, x] = True
                yield from make(m, keys)

    placed = mask.select(*IMAGE, "y", "x").repartition("image_id").sortWithinPartitions("image_id")
    return placed.mapInArrow(run, schema)


def stencil(mask: DataFrame, *steps: Stencil) -> DataFrame:
    """The mask after all steps, one after the other, in one pass over its images."""

    def make(m: np.ndarray, keys: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            m = step(m)
        yield _pixels(m, keys)

    return _framewise(mask, make, PIXELS)


def dilate(mask: DataFrame, kernel: Kernel = ELLIPSE) -> DataFrame:
    """Places from which the kernel reaches any foreground pixel."""
    return stencil(mask, lambda m: dilated(m, kernel))


def erode(mask: DataFrame, kernel: Kernel = SQUARE) -> DataFrame:
    """Places from which the kernel reaches foreground alone; what it reaches outside the image doesn't count."""
    return stencil(mask, lambda m: eroded(m, kernel))


def close(mask: DataFrame, kernel: Kernel = ELLIPSE) -> DataFrame:
    return stencil(mask, lambda m: eroded(dilated(m, kernel), kernel))


def no_op(mask: DataFrame) -> DataFrame:
    return mask


def remove_previous_mask(mask: DataFrame) -> DataFrame:
    """Pixels that weren't foreground in the dataset's previous image; the first image stays whole."""
    before = mask.select("dataset_id", (F.col("seq") + 1).alias("seq"), "y", "x")
    return mask.join(before, ["dataset_id", "seq", "y", "x"], "left_anti").select(*IMAGE, "y", "x")


#: Operations on dense frames by name; add to it to plug in others.
STENCILS: dict[str, Stencil] = {
    "no_op": lambda m: m,
    "erode": eroded,
    "dilate": dilated,
    "close": lambda m: eroded(dilated(m), ELLIPSE),
    "erode2": lambda m: eroded(m, ELLIPSE),
}
#: Operations on mask tables by name, for what one image doesn't tell.
RELATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {"remove_previous_mask": remove_previous_mask}


def pipeline_names(subtract_previous: bool = False) -> list[str]:
    """The default order of operations after the threshold."""
    return ["remove_previous_mask" if subtract_previous else "no_op", "erode", "dilate", "close", "erode2"]


def _split(names: list[str]) -> tuple[list[str], list[str]]:
    """Names of relations in front, and of the frame-wise operations after them."""
    for name in names:
        if name not in STENCILS and name not in RELATIONS:
            raise ValueError(f"no mask operation is named {name!r}")
    n = next((i for i, name in enumerate(names) if name in STENCILS), len(names))
    return names[:n], names[n:]


def mask_pipeline(mask: DataFrame, names: list[str]) -> DataFrame:
    """Apply operations in order. All frame-wise operations that follow each other take one pass over the images."""
    while names:
        first, rest = _split(names)
        for name in first:
            mask = RELATIONS[name](mask)
        n = next((i for i, name in enumerate(rest) if name in RELATIONS), len(rest))
        if n:
            mask = stencil(mask, *[STENCILS[name] for name in rest[:n]])
        names = rest[n:]
    return mask


def pipeline_runs(mask: DataFrame, names: list[str]) -> DataFrame:
    """The mask after mask_pipeline, as runs (y, x0, x1); its last frame-wise operations give runs in the same pass."""
    _split(names)
    n = len(names)
    while n and names[n - 1] in STENCILS:
        n -= 1
    steps = [STENCILS[name] for name in names[n:]]

    def make(m: np.ndarray, keys: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            m = step(m)
        yield _runs(m, keys)

    return _framewise(mask_pipeline(mask, names[:n]), make, RUNS)


def stage_masks(mask: DataFrame, names: list[str]) -> DataFrame:
    """The mask after each operation, with k (its place) and stage (its name)."""
    first, rest = _split(names)
    tables = []
    for k, name in enumerate(first):
        mask = RELATIONS[name](mask)
        tables.append(mask.withColumns({"k": F.lit(k), "stage": F.lit(name)}))
    if any(name in RELATIONS for name in rest):
        raise ValueError("operations on whole tables come first where stages are kept")

    def make(m: np.ndarray, keys: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, name in enumerate(rest, len(first)):
            m = STENCILS[name](m)
            yield _pixels(m, keys, k=np.int32(k), stage=name)

    if rest:
        tables.append(_framewise(mask, make, f"{PIXELS}, k int, stage string"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def mask_runs(mask: DataFrame) -> DataFrame:
    """Maximal horizontal runs of foreground: y, x0, x1 (inclusive)."""
    isle = F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x"))
    return mask.withColumn("isle", isle).groupBy(*IMAGE, "y", "isle").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("isle")


def run_adjacency(runs: DataFrame) -> DataFrame:
    """Pairs of runs of neighbouring lines that touch, corners included."""
    a = runs.select("image_id", F.col("y").alias("y_a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), (F.col("y") + 1).alias("y_b"))
    b = runs.select("image_id", F.col("y").alias("y_b"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    return a.join(b, ["image_id", "y_b"]).filter("a0 <= b1 + 1 AND a1 >= b0 - 1").select("image_id", "y_a", "a0", "a1", "y_b", "b0", "b1")


def neighbour_counts(mask: DataFrame, kernel: Kernel = AROUND) -> DataFrame:
    """For each foreground pixel, how many foreground pixels the kernel reaches from it."""

    def make(m: np.ndarray, keys: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        reach = max(max(abs(dy), abs(dx)) for dy, dx in kernel)
        wide = np.pad(m, ((0, 0), (reach, reach), (reach, reach))).astype(np.int32)
        h, w = m.shape[1:]
        n = sum(wide[:, reach + dy : reach + dy + h, reach + dx : reach + dx + w] for dy, dx in kernel)
        batch = _pixels(m, keys)
        yield batch.append_column("n", pa.array(n[m].astype(np.int64)))

    return _framewise(mask, make, f"{PIXELS}, n long")
