"""The whole path from scanlines to one measured row an object, and the background's feedback loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pixelframe.functions.scalars import circularity, ratio_safe
from pixelframe.operators import mask as M
from pixelframe.operators import pixels as P
from pixelframe.operators import regions as R
from pixelframe.session import settings_of
from pixelframe.sources.files import LINE_KEYS, bucketed, laid_out, part_of, scratch, small, stored, write_stage_snapshots

#: Measurement columns in the order of the export, ours and the export's where they differ.
EXPORT_NAMES = {
    "label": "label", "width": "width", "height": "height", "bx": "bx", "by": "by", "circ": "circ.", "area_exc": "area_exc", "area": "area", "pct_area": "%area",
    "major": "major", "minor": "minor", "y": "y", "x": "x", "convex_area": "convex_area", "perim": "perim.", "elongation": "elongation", "perimareaexc": "perimareaexc",
    "perimmajor": "perimmajor", "circex": "circex", "angle": "angle", "bounding_box_area": "bounding_box_area", "eccentricity": "eccentricity",
    "equivalent_diameter": "equivalent_diameter", "euler_number": "euler_number", "extent": "extent", "local_centroid_col": "local_centroid_col",
    "local_centroid_row": "local_centroid_row", "solidity": "solidity", "blur_laplacian": "blur_laplacian", "MeanHue": "MeanHue", "MeanSaturation": "MeanSaturation",
    "MeanValue": "MeanValue", "StdHue": "StdHue", "StdSaturation": "StdSaturation", "StdValue": "StdValue",
}


def derived_ratios(measured: DataFrame) -> DataFrame:
    """Ratios of base measurements; null where a divisor is 0."""
    c = F.col
    return measured.withColumns(
        {
            "circ": circularity(c("area"), c("perim")),
            "circex": circularity(c("area_exc"), c("perim")),
            "pct_area": 1 - ratio_safe(c("area_exc"), c("area")),
            "perimareaexc": ratio_safe(c("perim"), c("area_exc")),
            "perimmajor": ratio_safe(c("perim"), c("major")),
            "solidity": ratio_safe(c("area_exc"), c("convex_area")),
        }
    )


def export_table(measured: DataFrame) -> DataFrame:
    """Measured objects as rows of the export: ids, then all measurements in its order and under its names."""
    object_id = F.concat_ws("_", F.col("image_id").cast("string"), F.col("i").cast("string"))
    return measured.select(F.col("dataset_id").cast("string").alias("acq_id"), object_id.alias("object_id"), *[F.col(c).alias(f"object_{name}") for c, name in EXPORT_NAMES.items()])


def foreground(lines: DataFrame, flat: DataFrame, by: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Corrected and thresholded masks of all images. Counts of gray values are exchanged, and thresholds sent to where gray lines are."""
    grays = stored(P.corrected_gray(lines, flat, by=by), "gray")
    thresholds = stored(P.gray_threshold(grays), "thresholds")
    return P.below_threshold(grays, small(thresholds)).select(*M.IMAGE, "y", "x")


def measure(regions: DataFrame, lines: DataFrame, min_esd: float = 20) -> DataFrame:
    """One row a kept region with all measurements, from labelled runs (see label_regions).

    Small regions go before anything costly is measured. What needs a region's surroundings is measured in one pass over
    the images' runs; everything else is sums by (image_id, label), so the joins need no more than that partitioning.
    """
    runs = stored(regions, "runs")
    geometry = stored(R.region_moments(R.object_index(R.keep_large(R.region_geometry(runs), min_esd))), "regions")
    kept = stored(runs.join(geometry.select(*R.REGION), R.REGION, "left_semi"), "runs")
    holes = stored(R.region_holes(kept, geometry), "holes")
    filled = kept.select(*R.REGION, "y", "x0", "x1").unionByName(holes)
    images = lines.filter("y = 0").select("dataset_id", "image_id", "seq")
    if "part" in lines.columns:  # laid out: runs go to the lines, by dataset and line
        placed = [t.join(images.select("image_id", "dataset_id"), "image_id") for t in (filled, geometry)]
        with settings_of(lines.sparkSession, spark__sql__requireAllClusterKeysForCoPartition="false"):
            from_lines = [stored(R.region_colour(placed[0], lines), "colour"), stored(R.region_blur(placed[1], lines), "blur")]
    else:
        from_lines = [R.region_colour(filled, lines), R.region_blur(geometry, lines)]
    out = geometry
    for part in (R.region_filled_area(geometry, holes), R.region_shapes(kept), *from_lines):
        out = out.join(part, R.REGION)
    return derived_ratios(out).drop("n", "sx", "sy", "sxx", "syy", "sxy").join(images, "image_id")


def cumulative_trigger(counts: DataFrame, excess: float = 20) -> DataFrame:
    """Counts (dataset_id, seq, n) with the mean of those before (cma) and whether this one exceeds it by `excess`.

    A mean of 0, or none, triggers nothing.
    """
    before = Window.partitionBy("dataset_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    total, images = F.sum("n").over(before), F.count("*").over(before)
    trigger = (total > 0) & (F.col("n") * images > total + excess * images)
    return counts.withColumns({"cma": total / F.when(images > 0, images), "trigger": F.coalesce(trigger, F.lit(False))})


def flat_window(all_images: DataFrame, n: int = 10) -> DataFrame:
    """For each image, which images would feed a background recalculated at it: first_seq, and used, how many.

    All of exactly n images; near the end the n before it (from 0 on); else the n from it on. An even n loses one.
    """
    count = F.count("*").over(Window.partitionBy("dataset_id"))
    seq = F.col("seq")
    first = F.when(count == n, 0).when(seq > count - n - 1, F.greatest(seq - n, F.lit(0))).otherwise(seq)
    stop = F.when(count == n, n).when(seq > count - n - 1, seq).otherwise(seq + n)
    return all_images.withColumns({"first_seq": first.cast("long"), "used": F.when(stop - first == n, n - (n % 2 == 0)).otherwise(stop - first).cast("long")})


def flat_epochs(counts: DataFrame, excess: float = 20) -> DataFrame:
    """Which background epoch each image belongs to when counts don't depend on it: triggers at earlier images."""
    before = Window.partitionBy("dataset_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return cumulative_trigger(counts, excess).withColumn("epoch", F.coalesce(F.sum(F.col("trigger").cast("long")).over(before), F.lit(0)))


def _epochs(one: DataFrame, to: str) -> DataFrame:
    """All epochs' tables below a folder, each like `one`, with the column epoch."""
    return one.sparkSession.read.schema(StructType([*one.schema.fields, StructField("epoch", IntegerType())])).parquet(to)


def segment(lines: DataFrame, min_esd: float = 20, excess: float = 20, subtract_previous: bool = False, snapshots: str | None = None) -> DataFrame:
    """Measure all datasets; a jump of the object count gives the following images a new background.

    Epoch 0 uses each dataset's first images. After an epoch, the first trigger of each dataset that is past its last
    one recalculates the background at the next image for the images from there on, which alone are worked on again.
    Datasets go through an epoch together, until none has another trigger; each trigger is later than the last, so there
    are fewer epochs than images. With snapshots, the masks after each operation are written there, a folder an epoch.

    Lines are laid out once (see laid_out): they meet their background, and regions meet them, where they are. An epoch
    reads the folders of the datasets that triggered, and appends masks and regions of the images that it redoes; which
    epoch holds for an image is told by the table of images, from which datasets without another trigger leave.
    """
    lines = lines if "part" in lines.columns else laid_out(lines)
    spark, buckets = lines.sparkSession, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 128
    names = M.pipeline_names(subtract_previous)
    to = {k: scratch(spark, k) for k in ("regions", "masks", "final")}
    first = P.images(lines)
    images = stored(first.withColumns({"epoch": F.lit(0), "past": F.lit(-1).cast("long"), "n": F.lit(0).cast("long")}), "images")
    windows = stored(flat_window(first), "windows")
    used = stored(P.background_images(first).groupBy("dataset_id").agg((F.max("seq") + 1).alias("k")), "used")
    flat = bucketed(P.median_flat(lines.join(small(used), "dataset_id").filter("seq < k")), "flat", LINE_KEYS, buckets)
    active, edge, epoch = lines, None, 0
    while True:
        mask = foreground(active, flat.hint("shuffle_hash"))
        mask.write.parquet(f"{to['masks']}/epoch={epoch}")
        mask = spark.read.schema(mask.schema).parquet(f"{to['masks']}/epoch={epoch}")
        again = images.filter(F.col("epoch") == epoch).select("image_id")
        seen = mask.unionByName(edge) if edge is not None else mask
        if snapshots:
            write_stage_snapshots(seen, names, f"{snapshots}/epoch={epoch}")
        found = R.label_regions(M.pipeline_runs(seen, names))
        if edge is not None:
            found = found.join(again, "image_id", "left_semi")
        found.write.parquet(f"{to['regions']}/epoch={epoch}")
        regions = spark.read.schema(found.schema).parquet(f"{to['regions']}/epoch={epoch}")
        counts = R.keep_large(R.region_geometry(regions), min_esd).groupBy("image_id").agg(F.count("*").alias("now"))
        new = F.when(F.col("epoch") == epoch, F.coalesce("now", F.lit(0))).otherwise(F.col("n"))
        images = stored(images.join(counts, "image_id", "left").withColumn("n", new).drop("now"), "images")
        late = cumulative_trigger(images, excess).filter("trigger AND seq > past").groupBy("dataset_id").agg(F.min("seq").alias("at"))
        late = late.withColumn("seq", F.col("at") + 1).join(windows.select("dataset_id", "seq", "first_seq", "used"), ["dataset_id", "seq"]).filter("used > 0").drop("seq")
        late = stored(late, "late")  # a row a dataset
        jumps = small(late.select("dataset_id", "at"))
        images.join(jumps, "dataset_id", "left_anti").select("image_id", "epoch").write.mode("append").parquet(to["final"])
        if late.isEmpty():
            break
        if subtract_previous:
            # the first image of those to come follows one of an earlier epoch, whose mask is taken from it
            before = images.join(jumps, "dataset_id").filter("seq = at").select("image_id", "epoch")
            masks = _epochs(mask, to["masks"])
            edge = stored(masks.join(small(before), ["image_id", "epoch"], "left_semi").select(mask.columns), "edge")
        epoch += 1
        # the image of a trigger keeps its background, so the dataset's last trigger is told apart from it
        moved = F.when(F.col("seq") > F.col("at"), F.lit(epoch)).otherwise(F.col("epoch"))
        images = stored(images.join(jumps, "dataset_id").withColumns({"epoch": moved, "past": F.col("at")}).drop("at"), "images")
        touched = [r["part"] for r in late.select(part_of(F.col("dataset_id"), parts)).distinct().collect()]  # at most as many as parts
        active = lines.filter(F.col("part").isin(touched))
        fed = active.join(small(late), "dataset_id").filter("seq >= first_seq AND seq < first_seq + used").withColumn("since", F.col("at"))
        flat = bucketed(P.median_flat(fed, by=("dataset_id", "since")), "flat", LINE_KEYS, buckets)
    final = spark.read.schema("image_id long, epoch int").parquet(to["final"])
    everything = _epochs(found, to["regions"])
    return measure(everything.join(final, ["image_id", "epoch"], "left_semi").select(found.columns), lines, min_esd)
