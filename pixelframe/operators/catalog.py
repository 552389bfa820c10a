"""Acquisitions, segmentations, objects and files: joins, counts, paging, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.operators.ranks import placed_in_groups


def with_image_count(datasets: DataFrame, images: DataFrame) -> DataFrame:
    """Datasets with n_images, 0 where there are none."""
    counts = images.groupBy("dataset_id").agg(F.count("*").alias("n_images"))
    return datasets.join(counts, "dataset_id", "left").withColumn("n_images", F.coalesce("n_images", F.lit(0)))


def with_marker(rows: DataFrame, markers: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with whether their key is among the markers."""
    marked = markers.select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(marked, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def unprocessed(datasets: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    return datasets if force else datasets.join(done.select(key), key, "left_anti")


def attach_metadata(objects: DataFrame, metadata: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Every object with its dataset's columns. Spark broadcasts the metadata only if its size allows that."""
    return objects.join(metadata, key)


def verify_integrity(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Ledger entries with status valid, invalid (size or hash differ) or missing. files: dir, filename, size, sha1."""
    found = files.select("dir", "filename", F.col("size").alias("size_now"), F.col("sha1").alias("sha1_now"))
    same = (F.col("size") == F.col("size_now")) & (F.col("sha1") == F.col("sha1_now"))
    status = F.when(F.col("size_now").isNull(), "missing").when(same, "valid").otherwise("invalid")
    return ledger.join(found, ["dir", "filename"], "left").select("dir", "filename", status.alias("status"))


def by_status(verified: DataFrame, names: int = 1000) -> DataFrame:
    """How many files of each directory have each status, and the first `names` of their names in order.

    A report's row is bounded: the names are chosen before they meet in it, and a directory's files never meet in one
    task. All files by status, each with its place: `listed_by_status`.
    """
    counts = verified.groupBy("dir", "status").agg(F.count("*").alias("n"))
    first = listed_by_status(verified).filter(F.col("place") < names).groupBy("dir", "status").agg(F.sort_array(F.collect_list("filename")).alias("names"))
    same = counts["dir"].eqNullSafe(first["dir"]) & (counts["status"] == first["status"])
    return counts.join(first, same).select(counts["dir"], counts["status"], "n", "names")


def listed_by_status(verified: DataFrame) -> DataFrame:
    """Every file with its place among those of its directory and status, and how many these are: place (from 0), n."""
    return placed_in_groups(verified, ["dir", "status"], [F.col("filename")], "place", "n")


def page_of(rows: DataFrame, order: list[Column], start: int, size: int) -> DataFrame:
    """One page: rows start .. start + size - 1 of the order."""
    return rows.orderBy(*order).offset(start).limit(size)


def all_pages(rows: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """Every row with its page in its group, the group's pages and where the next page starts (null: none)."""
    out = placed_in_groups(rows, group, order, "_place", "_total")
    page = F.floor(F.col("_place") / size)
    out = out.withColumns({"page": page, "pages": F.ceil(F.col("_total") / size), "next_start": F.when((page + 1) * size < F.col("_total"), (page + 1) * size)})
    return out.drop("_place", "_total")


def shuffled(rows: DataFrame, group: list[str], key: Column, seed: int) -> DataFrame:
    """Rows with their place in a random but repeatable order within the group."""
    return placed_in_groups(rows, group, [F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))])


def zip_positional(rows: DataFrame, ids: str, details: str, names: list[str]) -> DataFrame:
    """Parallel arrays of ids and of arrays of details to a row an id, details by name."""
    others = [c for c in rows.columns if c not in (ids, details)]
    zipped = rows.select(*others, F.posexplode(F.arrays_zip(F.col(ids).alias("id"), F.col(details).alias("d"))).alias("pos", "z"))
    return zipped.select(*others, "pos", F.col("z.id").alias("object_id"), *[F.get(F.col("z.d"), k).alias(n) for k, n in enumerate(names)])


def object_index(objects: DataFrame, order: list[Column]) -> DataFrame:
    """Index of objects in their dataset, id and label across datasets of one sequence."""
    return placed_in_groups(objects, ["dataset_id"], order, "i")


def progress(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """current (from 1) and total of each row in its group."""
    return placed_in_groups(rows, [group], order, "current", "total").withColumn("current", F.col("current") + 1)


def sort_files(files: DataFrame, root: Column, order: list[Column]) -> DataFrame:
    """Files with seq, their place below their root."""
    return placed_in_groups(files, [root], order, "seq")
