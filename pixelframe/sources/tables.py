"""Images, acquisitions, objects, files and messages as DataFrames over the star-schema and stream tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8  # frames are SIDE x SIDE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a frame: dataset_id, image_id, seq (place in the dataset) and values v of its pixels, row by row."""
    rows = table(spark, sf_dir, "embeddings")
    # places are told from the ids alone, so frames' values don't go through the window
    order = Window.partitionBy("label").orderBy("vec_id")
    places = rows.select("label", "vec_id", (F.row_number().over(order) - 1).cast("long").alias("seq"))
    level = lambda f: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + 400 * f.cast("double")).cast("double"))).cast("int")
    return rows.join(places, ["label", "vec_id"]).select(
        F.col("label").cast("long").alias("dataset_id"),
        F.col("vec_id").alias("image_id"),
        "seq",
        F.transform("embedding", level).alias("v"),
    )


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a pixel of the single-channel frames: dataset_id, image_id, seq, y, x, v."""
    flat = frames(spark, sf_dir).select("dataset_id", "image_id", "seq", F.posexplode("v").alias("i", "v"))
    return flat.select("dataset_id", "image_id", "seq", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).alias("x"), "v")


def scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line of a colour frame: dataset_id, image_id, seq, y, w, h and the arrays b, g, r.

    Blue is the frame's value at a pixel, green and red are those of the next two pixels, in circular order.
    """
    channel = lambda k: F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda x: F.get("v", (F.col("y") * SIDE + x + k) % (SIDE * SIDE)))
    lines = frames(spark, sf_dir).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    return lines.select("dataset_id", "image_id", "seq", "y", F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h"), *[channel(k).alias(c) for k, c in enumerate("bgr")])


def bgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a pixel of the colour frames."""
    return exploded(scanlines(spark, sf_dir))


def exploded(lines: DataFrame, channels: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    """Scanlines to pixels."""
    others = [c for c in lines.columns if c not in (*channels, "w", "h")]
    zipped = lines.select(*others, F.posexplode(F.arrays_zip(*channels)).alias("x", "p"))
    return zipped.select(*others, "x", *[F.col(f"p.{c}").alias(c) for c in channels])


def acq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisitions: ids that contain their parent's id, expected frames, whether segmented."""
    project = F.concat(F.lit("proj "), (F.col("o_custkey") % 25).cast("string"))
    sample = F.concat(project, F.lit("_s"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("dataset_id"),
        project.alias("sample_project"),
        sample.alias("sample_id"),
        F.concat(sample, F.lit("_"), F.col("o_orderkey").cast("string")).alias("acq_id"),
        F.col("o_orderdate").alias("acq_ts"),
        (1 + F.col("o_orderkey") % 7).cast("long").alias("acq_nb_frame"),
        (F.col("o_orderstatus") == "F").alias("is_segmented"),
        F.col("o_custkey").alias("customer"),
    )


def obj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured objects: dataset_id, index i in the dataset, sizes."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    quantity = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("dataset_id"),
        (F.row_number().over(order) - 1).cast("long").alias("i"),
        (quantity * 20).alias("area_exc"),
        (quantity * 20 + F.col("l_linenumber")).cast("long").alias("area"),
        (F.col("l_extendedprice") / 1000).alias("perim"),
        (10 + F.col("l_quantity")).alias("major"),
        (5 + F.col("l_quantity") / 2).alias("minor"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their content: dir, filename, content."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("dir"), name.alias("filename"), F.col("text").alias("content"))


def name_hash(filename: Column, content: Column) -> Column:
    """sha1 of a file's name, a zero byte and its content."""
    return F.sha1(F.concat(F.encode(filename, "UTF-8"), F.unhex(F.lit("00")), F.encode(content, "UTF-8")))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integrity ledger of the files in which every tenth entry is wrong."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    content = F.concat(F.col("text"), F.when(F.col("doc_id") % 10 == 0, "x").otherwise(""))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("dir"), name.alias("filename"), F.octet_length("text").cast("long").alias("size"), name_hash(name, content).alias("sha1"))


#: What kind of status each event type stands for.
STATUS = {"signup": "Ready", "click": "On", "purchase": "Done", "error": "Off"}


def msg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message log: event_id, ts, device_id, status, topic, value, payload."""
    kind = F.col("event_type")
    status = F.lit("Started")
    for event, text in STATUS.items():
        status = F.when(kind == event, text).otherwise(status)
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("device_id"), status.alias("status"), F.when(kind.isin("click", "error"), "status/light").otherwise("status/pump").alias("topic"), "value", F.col("props").alias("payload")
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
