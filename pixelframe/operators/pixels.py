"""Dense image operators on scanlines: background, flat-field correction, gray values, histograms, thresholds.

A scanline table has a row a line of an image: dataset_id, image_id, seq, y, w, h and arrays of channel values. Frames
are never exploded here; only what passes a threshold becomes pixels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.functions.scalars import gray
from pixelframe.operators.groups import whole_groups

#: Fixed value: ratios to the background are clipped here before they are spread over 0 to 255.
MOST_RATIO = 1.04
#: Lines whose gray values are counted at once, and images whose histograms a task holds at once.
MOST_COUNTED = 1024


def images(lines: DataFrame) -> DataFrame:
    return lines.filter("y = 0").select("dataset_id", "image_id", "seq")


def background_images(all_images: DataFrame, n: int = 10) -> DataFrame:
    """The first images of each dataset whose median is its background: n or all there are, one fewer if that is even."""
    count = F.least(F.count("*").over(Window.partitionBy("dataset_id")), F.lit(n))
    return all_images.withColumn("k", count - (count % 2 == 0).cast("int")).filter(F.col("seq") < F.col("k")).drop("k")


def median_flat(lines: DataFrame, channels: tuple[str, ...] = ("b", "g", "r"), by: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """The upper median of each pixel and channel over the images given, as scanlines by `by` and y.

    At most the background's few images meet in a group; a row's lines are sorted place by place at once.
    """
    stacked = lines.groupBy(*by, "y").agg(*[F.collect_list(c).alias(c) for c in channels])

    def median(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for column in batch.columns[len(by) + 1 :]:
                out.append(_lists([np.sort(r, axis=0)[len(r) // 2] for r in map(_stacked, column)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], *out], names=[*by, "y", *channels])

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    return stacked.mapInArrow(median, ", ".join([*(f"{k} {kinds[k]}" for k in (*by, "y")), *(f"{c} array<int>" for c in channels)]))


def _stacked(lists: pa.ListScalar) -> np.ndarray:
    """Equally long lists of a row as a matrix."""
    inner = lists.values
    return inner.flatten().to_numpy().reshape(len(inner), -1)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32)))


def flat_correct(lines: DataFrame, flat: DataFrame, channels: tuple[str, ...] = ("b", "g", "r"), by: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Divide by the background, set the first pixel to 0, clip to [0, 1.04] and spread over 0 to 255.

    Where the background is 0: 255 if the pixel isn't, else 0.
    """

    return _corrected(lines, flat, channels, by, False)


def corrected_gray(lines: DataFrame, flat: DataFrame, channels: tuple[str, ...] = ("b", "g", "r"), by: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Gray values of flat_correct's lines, in one step."""
    return _corrected(lines, flat, channels, by, True)


def _corrected(lines: DataFrame, flat: DataFrame, channels: tuple[str, ...], by: tuple[str, ...], as_gray: bool) -> DataFrame:
    """Lines meet their background on its keys and y; a task corrects the lines of a batch at once.

    A background with a column `since` beyond its keys is for its dataset's images after that one alone.
    """
    others = [c for c in lines.columns if c not in channels]
    late = ["since"] if "since" in flat.columns and "since" not in by else []
    ground = flat.select(*by, "y", *late, *[F.col(c).alias(f"flat_{c}") for c in channels])
    both = lines.join(ground, [*by, "y"])
    if late:
        both = both.filter("seq > since")
    both = both.select(*others, *channels, *[f"flat_{c}" for c in channels])

    def correct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out, ends = [], None
            for c in channels:
                p, f = (get[k].flatten().to_numpy() for k in (c, f"flat_{c}"))
                sizes = get[c].value_lengths().to_numpy()
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ratio = np.divide(p, f, out=np.where(p > 0, np.inf, 0.0), where=f != 0)
                value = np.floor(np.clip(ratio, 0.0, MOST_RATIO) / MOST_RATIO * 255).astype(np.int32)
                value[ends[:-1][(get["y"].to_numpy() == 0) & (sizes > 0)]] = 0
                out.append(value)
            if as_gray:
                b, g, r = (v.astype(np.int64) for v in out)
                out = [((r * 9798 + g * 19235 + b * 3735 + 16384) >> 15).astype(np.int32)]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in out]
            yield pa.RecordBatch.from_arrays([*(get[c] for c in others), *lists], names=[*others, *(["gray"] if as_gray else channels)])

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    made = ["gray"] if as_gray else channels
    return both.mapInArrow(correct, ", ".join([*(f"{c} {kinds[c]}" for c in others), *(f"{c} array<int>" for c in made)]))


def gray_lines(lines: DataFrame) -> DataFrame:
    """Scanlines with one array `gray` in place of the three channels."""
    zipped = F.transform(F.arrays_zip("b", "g", "r"), lambda p: gray(p["b"], p["g"], p["r"]))
    return lines.withColumn("gray", zipped).drop("b", "g", "r")


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, MOST_COUNTED):
            yield batch.slice(at, MOST_COUNTED)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (image_id, gray) to the gray values that occur in an image's lines, and how often: image_id, values, counts."""
    for batch in _sliced(batches):
        image, of = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        lists = batch.column(1)
        place = np.repeat(of, lists.value_lengths().fill_null(0).to_numpy())
        counts = np.bincount(place * 256 + lists.flatten().to_numpy(), minlength=256 * len(image))
        some = np.flatnonzero(counts)
        ends = pa.array(np.searchsorted(some, np.arange(len(image) + 1) * 256).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (some % 256, counts[some])]
        yield pa.RecordBatch.from_arrays([pa.array(image, pa.int64()), *lists], names=["image_id", "values", "counts"])


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Image ids and their 256 counts, from what _counted gives, sorted by image; never more than MOST_COUNTED images at once."""
    for group in whole_groups(batches, ["image_id"]):
        image = group["image_id"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], image[1:] != image[:-1]]))
        ends = np.append(first, len(image))
        for at in range(0, len(first), MOST_COUNTED):
            mine = first[at : at + MOST_COUNTED]
            part = group.slice(mine[0], int(ends[min(at + MOST_COUNTED, len(first))] - mine[0]))
            values, counts = (part[c].combine_chunks() for c in ("values", "counts"))
            of = np.repeat(np.searchsorted(mine - mine[0], np.arange(part.num_rows), "right") - 1, values.value_lengths().to_numpy())
            # sums stay whole: a frame has fewer pixels than doubles have whole numbers
            total = np.bincount(of * 256 + values.flatten().to_numpy(), counts.flatten().to_numpy(), 256 * len(mine))
            yield image[mine], total.astype(np.int64).reshape(len(mine), 256)


def _counts_by_image(lines: DataFrame) -> DataFrame:
    parts = lines.select("image_id", "gray").mapInArrow(_counted, "image_id long, values array<int>, counts array<int>")
    return parts.repartition("image_id").sortWithinPartitions("image_id")


def gray_histogram(lines: DataFrame) -> DataFrame:
    """image_id and an array of 256 counts. Some lines are counted at once; what is exchanged are the values that occur,
    and an image's array is made after the exchange, those of some images at a time."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, counts in _added(batches):
            ends = pa.array(np.arange(len(image) + 1, dtype=np.int32) * 256)
            yield pa.RecordBatch.from_arrays([pa.array(image, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(counts.ravel()))], names=["image_id", "hist"])

    return _counts_by_image(lines).mapInArrow(add, "image_id long, hist array<long>")


def triangle(hist: np.ndarray) -> np.ndarray:
    """Thresholds of histograms (n, 256): the value farthest below the line from the histogram's far end to its peak.

    The side of the peak that reaches farther is used, mirrored if it is the upper.
    """
    held, row = hist > 0, np.arange(len(hist))
    some = held.any(axis=1)
    low, high, peak = held.argmax(axis=1), 255 - held[:, ::-1].argmax(axis=1), hist.argmax(axis=1)
    low = np.where(some & (low > 0), low - 1, 0)
    high = np.where(some & (high < 255), high + 1, 255)
    flip = peak - low < high - peak
    side = np.where(flip[:, None], hist[:, ::-1], hist)
    low, peak = np.where(flip, 255 - high, low), np.where(flip, 255 - peak, peak)
    value = np.arange(256)
    height = side[row, peak][:, None] * value + (low - peak)[:, None] * side
    height[(value <= low[:, None]) | (value > peak[:, None])] = 0
    best = height.argmax(axis=1)  # the first of equally high ones
    threshold = np.where(height[row, best] > 0, best, low) - 1
    return np.where(flip, 255 - threshold, threshold).astype(np.int32)


def triangle_threshold(hist: DataFrame) -> DataFrame:
    """image_id, threshold (see triangle), of histograms as rows of 256 counts."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found = triangle(batch.column(1).flatten().to_numpy().reshape(-1, 256))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["image_id", "threshold"])

    return hist.select("image_id", F.col("hist").cast("array<long>")).mapInArrow(find, "image_id long, threshold int")


def gray_threshold(lines: DataFrame) -> DataFrame:
    """triangle_threshold of the lines' gray_histogram in one step: no image's 256 counts leave the task that adds them up."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, counts in _added(batches):
            yield pa.RecordBatch.from_arrays([pa.array(image, pa.int64()), pa.array(triangle(counts))], names=["image_id", "threshold"])

    return _counts_by_image(lines).mapInArrow(find, "image_id long, threshold int")


def below_threshold(lines: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Foreground pixels (dataset_id, image_id, seq, h, w, y, x): gray values of at most their image's threshold."""
    marked = lines.join(thresholds, "image_id")
    spots = F.filter(F.transform("gray", lambda g, x: F.when(g <= F.col("threshold"), x)), lambda x: x.isNotNull())
    return marked.select("dataset_id", "image_id", "seq", "h", "w", "y", F.explode(spots).alias("x"))


def below_mean(frame: np.ndarray, radius: int, offset: int, most_lines: int = 512) -> np.ndarray:
    """Where a frame's values are at most the mean of the square around them, less an offset; edges repeat outwards.

    A summed-area table of the frame with its edges repeated gives every square's sum by four of its entries. It is made
    for most_lines lines and those around them at a time, so it stays in bounds for frames of any height.
    """
    h, side = len(frame), 2 * radius + 1
    out = np.zeros(frame.shape, bool)
    for top in range(0, h, most_lines):
        low = min(top + most_lines, h)
        lines = np.clip(np.arange(top - radius, low + radius), 0, h - 1)
        wide = np.pad(frame[lines], ((0, 0), (radius, radius)), mode="edge").astype(np.int64)
        table = np.zeros((wide.shape[0] + 1, wide.shape[1] + 1), np.int64)
        np.cumsum(wide, axis=0, out=table[1:, 1:])
        np.cumsum(table[1:, 1:], axis=1, out=table[1:, 1:])
        total = table[side:, side:] - table[:-side, side:] - table[side:, :-side] + table[:-side, :-side]
        out[top:low] = frame[top:low].astype(np.int64) * (side * side) <= total - offset * side * side
    return out


def adaptive_threshold(lines: DataFrame, radius: int = 9, offset: int = 4) -> DataFrame:
    """Foreground pixels: gray of at most the mean of the square around, less an offset; edges repeat outwards.

    One exchange brings each image's gray lines together; a task works on whole frames, one after the other.
    """

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["image_id"]):
            image = group["image_id"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], image[1:] != image[:-1]])).tolist()
            for s, e in zip(first, [*first[1:], len(image)]):
                part = group.slice(s, e - s)
                frame = part["gray"].combine_chunks().flatten().to_numpy().reshape(e - s, -1)
                y, x = np.nonzero(below_mean(frame, radius, offset))
                keys = [pa.array(np.full(len(y), part[c][0].as_py(), np.int64)) for c in ("dataset_id", "image_id", "seq")]
                size = [pa.array(np.full(len(y), part[c][0].as_py(), np.int32)) for c in ("h", "w")]
                yield pa.RecordBatch.from_arrays([*keys, *size, pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32))], names=["dataset_id", "image_id", "seq", "h", "w", "y", "x"])

    placed = lines.select("dataset_id", "image_id", "seq", "y", "h", "w", "gray").repartition("image_id").sortWithinPartitions("image_id", "y")
    return placed.mapInArrow(mark, "dataset_id long, image_id long, seq long, h int, w int, y int, x int")
