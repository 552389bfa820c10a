"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space between words, as a Java and RE2 character class.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Fixed value: the same characters themselves.
SPACE_CHARS = " \t\n\x0b\x0c\r"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="pixelframe-"))
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/pixelframe/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors. Its path is at
    path_written."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path_written = path
    return out


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where a table has columns of these names (whatever their case)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_hashes(text: Column) -> list[Column]:
    """Two 64-bit hashes that together tell texts apart: h1 and h2."""
    return [F.xxhash64(text, F.length(text)).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> Iterator[None]:
    """Actions within send rows to Python in Arrow batches of about so many bytes: for tables of few, large rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most_bytes))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def with_nodes(rows: DataFrame) -> DataFrame:
    """Rows (h1, h2, ...) of a written table with `node`, one number a text: h1, or a hash of both for the few texts
    that share h1 with another text.
    """
    twins = rows.groupBy("h1").agg(F.min("h2").alias("low"), F.max("h2").alias("high")).filter("low != high").select("h1", "low")
    if twins.isEmpty():
        return rows.withColumn("node", F.col("h1"))
    node = F.when(F.col("h2") == F.coalesce("low", "h2"), F.col("h1")).otherwise(F.xxhash64("h1", "h2"))
    return rows.join(twins, "h1", "left").withColumn("node", node).drop("low")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    solid = F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "x")
    return F.coalesce(F.length(F.translate(solid, SPACE_CHARS, "")), F.lit(0)).cast("long")


def ranked(df: DataFrame, keys: list[Column], tag: str, rank: str = "global_rank") -> tuple[DataFrame, int]:
    """The rows with their 0-based place in the order of keys, and how many there are, without gathering them in one task.

    One range exchange sorts the rows; the written table fixes each row's partition and place in it, and the counts
    of the partitions (one row for each) give what stands before each partition. Rows that tie in all keys stand in
    any order, so keys should end in something that tells rows apart.
    """
    spark = df.sparkSession
    spot = written(
        df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("_spot", F.monotonically_increasing_id()),
        tag,
    ).withColumns({"_part": F.shiftrightunsigned("_spot", 33), "_row": F.col("_spot").bitwiseAND((1 << 33) - 1)})
    counts = spot.groupBy("_part").agg(F.count("*").alias("_n")).collect()  # one row a partition
    before, total = {}, 0
    for part, n in sorted((r["_part"], r["_n"]) for r in counts):
        before[part] = total
        total += n
    starts = spark.createDataFrame(list(before.items()) or [(-1, 0)], "_part long, _before long")
    out = spot.join(F.broadcast(starts), "_part").withColumn(rank, F.col("_before") + F.col("_row"))
    return out.drop("_part", "_spot", "_row", "_before"), total
