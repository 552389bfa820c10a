"""Scanlines laid out by dataset and line: what moves, and what is read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import pixels as P
from pixelframe.operators import regions as R
from pixelframe.plans import segmentation as G
from pixelframe.session import settings_of
from pixelframe.sources.files import LINE_KEYS, bucketed, laid_out

LINES = "dataset_id long, image_id long, seq long, y int, w int, h int, b array<int>, g array<int>, r array<int>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark):
    """A hundred datasets of three frames of 6 x 5 each."""
    rng = np.random.default_rng(3)
    rows = [(d, 10 * d + k, k, y, 5, 6, *(rng.integers(1, 255, 5).tolist() for _ in "bgr")) for d in range(100) for k in range(3) for y in range(6)]
    return spark.createDataFrame(rows, LINES)


def test_lines_meet_their_background_where_they_are(spark, lines):
    with settings_of(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        laid = laid_out(lines)
        flat_of = P.median_flat(laid)
        assert "Exchange" not in plan(flat_of)
        flat = bucketed(flat_of, "flat", LINE_KEYS, 4)
        corrected = P.flat_correct(laid, flat.hint("shuffle_hash"))
        text = plan(corrected)
        assert "Exchange" not in text and "Sort " not in text and "HashJoin" in text
        want = {(r.image_id, r.y): (r.b, r.g, r.r) for r in P.flat_correct(lines, P.median_flat(lines)).collect()}
        assert {(r.image_id, r.y): (r.b, r.g, r.r) for r in corrected.collect()} == want


def test_regions_go_to_their_lines(spark, lines):
    runs = spark.createDataFrame([(3, 30, 1, 2, 1, 3), (4, 41, 1, 5, 0, 4)], "dataset_id long, image_id long, label long, y int, x0 int, x1 int")
    with settings_of(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__requireAllClusterKeysForCoPartition="false"):
        laid = laid_out(lines)
        found = R.region_colour(runs, laid)
        text = plan(found)
        scan = text[: text.index("Scan parquet") if "Scan parquet" in text else text.index("FileScan")]
        assert scan.count("Exchange hashpartitioning(image_id") == 1  # of sums; the lines stay in their buckets
        for part in text.split("Exchange")[1:]:
            assert "array" not in part.split("+-")[0]
        assert sorted(found.collect()) == sorted(R.region_colour(runs.drop("dataset_id"), lines).collect())


def test_an_epoch_reads_the_folders_of_its_datasets(spark, lines):
    laid = laid_out(lines, 128)

    def size(df) -> int:
        df.collect()
        return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("filesSize").value()

    of_one = laid.filter(F.col("part").isin([r["part"] for r in laid.filter("dataset_id = 42").select("part").distinct().collect()]))
    assert 0 < size(of_one) < 0.04 * size(laid)
    assert {r.dataset_id for r in of_one.select("dataset_id").distinct().collect()} >= {42}


@pytest.mark.parametrize("h,w", [(1, 1), (3, 40), (40, 3), (30, 47), (1100, 9)])
def test_local_means_of_frames_of_any_size(h, w):
    g = np.random.default_rng(h).integers(0, 256, (h, w))
    p = np.pad(g, 9, mode="edge")
    total = sum(p[a : a + h, b : b + w] for a in range(19) for b in range(19))
    assert np.array_equal(P.below_mean(g, 9, 4, 100), g * 361 <= total - 4 * 361)


def test_histograms_add_up_over_tasks(spark):
    rows = [(k % 3, [k % 256] * (k % 7)) for k in range(500)] + [(5, [])]
    got = {r.image_id: r.hist for r in P.gray_histogram(spark.createDataFrame(rows, "image_id long, gray array<int>").repartition(4)).collect()}
    for i in (0, 1, 2, 5):
        assert got[i] == np.bincount([v for k, g in rows if k == i for v in g], minlength=256).tolist()


def test_few_histograms_are_held_at_once(spark):
    """However many images a batch holds, a task adds up and hands on those of some at a time, and thresholds are the same."""
    rng = np.random.default_rng(3)
    n = 2 * P.MOST_COUNTED + 5
    image, gray = np.repeat(np.arange(n), 2), rng.integers(0, 256, (2 * n, 6), dtype=np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(image), pa.array(list(gray))], names=["image_id", "gray"])
    parts = list(P._counted([batch]))
    assert all(p.num_rows <= P.MOST_COUNTED and len(p["values"].flatten()) <= 6 * P.MOST_COUNTED for p in parts)
    whole = pa.Table.from_batches(parts).sort_by("image_id").combine_chunks().to_batches()
    added = list(P._added(whole))
    assert max(len(i) for i, _ in added) <= P.MOST_COUNTED
    want = np.stack([np.bincount(g.ravel(), minlength=256) for g in gray.reshape(n, 2, 6)])
    assert np.array_equal(np.concatenate([i for i, _ in added]), np.arange(n)) and np.array_equal(np.concatenate([c for _, c in added]), want)
    lines = spark.createDataFrame([(int(i), g.tolist()) for i, g in zip(image[:600], gray)], "image_id long, gray array<int>").repartition(3)
    one = {tuple(r) for r in P.gray_threshold(lines).collect()}
    assert one == {tuple(r) for r in P.triangle_threshold(P.gray_histogram(lines)).collect()} and len(one) == 300


def test_histograms_and_local_means_make_no_row_a_pixel(spark, lines):
    grays = P.gray_lines(lines)
    for df in (P.gray_histogram(grays), P.adaptive_threshold(grays)):
        assert "Generate" not in plan(df) and "Window" not in plan(df)
