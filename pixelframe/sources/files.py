"""Readers and writers of datasets on a file system that Spark reaches."""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelframe.functions.scalars import file_name, type_code
from pixelframe.operators import mask as M
from pixelframe.operators.groups import whole_groups
from pixelframe.session import settings_of

LEDGER = "filename string, size bigint, sha1 string"
#: The first two lines of an integrity ledger.
LEDGER_HEAD = ("# integrity file", "# filename,size,sha1")

_own: dict[str, str] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the one that driver and executors share. A local session that names none gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="pixelframe-"))
    return f"{root.rstrip('/')}/files/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """A table written to a new shared folder and read back: computed once, and safe from lost executors."""
    to = scratch(df.sparkSession, tag)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def bucketed(df: DataFrame, tag: str, keys: tuple[str, ...], buckets: int, part: str | None = None) -> DataFrame:
    """A stored table whose rows are dealt into buckets by keys, so that tables of as many buckets join and group by
    these keys (and more) where they are, without an exchange. With part, each of its values is a folder of its own:
    a filter on it reads no other."""
    spark, to = df.sparkSession, scratch(df.sparkSession, tag)
    name = f"pixelframe_{uuid.uuid4().hex}"
    writer = df.write.partitionBy(part) if part else df.write
    # folders are told from the files, so the table's name can go as soon as it is resolved
    with settings_of(spark, spark__sql__hive__manageFilesourcePartitions="false"):
        writer.bucketBy(buckets, *keys).option("path", to).saveAsTable(name)
        out = spark.table(name)
        out.schema  # noqa: B018
        spark.sql(f"DROP TABLE {name}")  # the files stay
    return out


#: How scanlines are laid out: a line and its dataset's background line are in the same bucket.
LINE_KEYS = ("dataset_id", "y")


def part_of(dataset: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(dataset), F.lit(parts)).cast("int").alias("part")


def laid_out(lines: DataFrame, parts: int = 128) -> DataFrame:
    """Scanlines in buckets of LINE_KEYS and folders by `part` of the dataset: the one exchange of pixels there is.

    Lines of a large dataset are in all buckets, and a task reads no more than a bucket of the folders asked for.
    """
    buckets = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.withColumn("part", part_of(F.col("dataset_id"), parts)).repartition(buckets, *LINE_KEYS)
    return bucketed(dealt, "lines", LINE_KEYS, buckets, "part")


def small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """To be sent to all tasks if it has few rows, counted now; else Spark joins it as any other."""
    return F.broadcast(df) if df.count() <= most_rows else df


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def walk_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length and modificationTime of all files under a root; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")


def write_files(files: DataFrame, root: str) -> int:
    """Write small files (path below root: string, content: binary), and return how many.

    Tasks write whole files by path, so a task that runs again writes the same files again.
    """

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                to = f"{base}/{path}"
                store.create_dir(to.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(to) as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return files.select("path", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def _png(pixels: np.ndarray) -> bytes:
    """An image file of pixels (h, w, 3) in the order B, G, R, without loss."""
    h, w, _ = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels[:, :, ::-1].astype(np.uint8).reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def write_images(lines: DataFrame, root: str) -> int:
    """Write scanlines as image files, dataset_id/seq.jpg by place, and return how many. Decoders go by the content."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["image_id"]):
            image = group["image_id"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], image[1:] != image[:-1]]))
            paths, contents = [], []
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(image)]):
                part = group.slice(s, e - s)
                channels = [np.stack([v.values.to_numpy() for v in part[c]]) for c in "bgr"]
                paths.append(f"{part['dataset_id'][0].as_py()}/{part['seq'][0].as_py():08}.jpg")
                contents.append(_png(np.stack(channels, axis=2)))
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths), "content": pa.array(contents, pa.binary())})

    placed = lines.select("dataset_id", "image_id", "seq", "y", "b", "g", "r").repartition("image_id").sortWithinPartitions("image_id", "y")
    return write_files(placed.mapInArrow(encode, "path string, content binary"), root)


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images right in a folder, in the order of their names: path, seq. Other extensions, and sub-folders, are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{JPG,jpg,JPEG,jpeg}").load(folder).select("path")
    return found.withColumn("seq", F.row_number().over(Window.partitionBy(parent(F.col("path"))).orderBy(file_name(F.col("path")))) - 1)


def decode_scanlines(spark: SparkSession, folder: str, lines_at_once: int = 256) -> DataFrame:
    """Scanlines of a folder's images: path, y, w, h and arrays b, g, r, decoded by Spark's image source.

    Gray images have three equal channels, and a channel of opacity is left out. Images that can't be decoded have no
    lines here; `undecoded_images` tells them. A task cuts each image's bytes into lines by itself; no line carries its
    image's other bytes. Name folders, also by a pattern, not files: each path that a pattern finds is listed by itself.
    """
    image = _images(spark, folder).filter("nChannels IN (1, 3, 4)")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, h, w, n_channels, data in zip(*(batch.column(k) for k in range(5))):
                h, w, depth = h.as_py(), w.as_py(), n_channels.as_py()
                pixels = np.frombuffer(data.as_buffer(), np.uint8)[: h * w * depth].reshape(h, w, depth)
                for y in range(0, h, lines_at_once):
                    some = pixels[y : y + lines_at_once].astype(np.int32)
                    n = len(some)
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * w)
                    channels = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(some[:, :, k if depth > 1 else 0]).ravel())) for k in range(3)]
                    size = [pa.array(np.full(n, v, np.int32)) for v in (w, h)]
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n), pa.array(np.arange(y, y + n, dtype=np.int32)), *size, *channels], names=["path", "y", "w", "h", "b", "g", "r"])

    return image.select("origin", "height", "width", "nChannels", "data").mapInArrow(cut, "path string, y int, w int, h int, b array<int>, g array<int>, r array<int>")


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """decode_scanlines of folders of many images, done once and written to a shared folder. Small images are read up to
    some 1,000 a task, where Spark's cost of opening a file would make it a task for each 32 of them."""
    with settings_of(spark, spark__sql__files__openCostInBytes="131072"):
        return stored(decode_scanlines(spark, folder), "decoded")


def _images(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", "false").load(folder).select("image.*")


def undecoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of a folder that decode_scanlines leaves out, with the reason: path, error."""
    why = F.when(F.col("nChannels") < 1, F.lit("not a readable image")).when(~F.col("nChannels").isin(1, 3, 4), F.concat(F.lit("channels: "), F.col("nChannels").cast("string")))
    return _images(spark, folder).select(F.col("origin").alias("path"), why.alias("error")).filter("error IS NOT NULL")


def discover_datasets(files: DataFrame) -> DataFrame:
    """Directories (dir) that hold a metadata.json, among files given by path; each once."""
    return files.filter(file_name(F.col("path")) == "metadata.json").select(parent(F.col("path")).alias("dir")).distinct()


def read_metadata_json(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One row a metadata.json below a root, with its directory; unreadable documents have null fields."""
    read = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").option("mode", "PERMISSIVE")
    return read.schema(schema).json(root).withColumn("dir", parent(F.col("_metadata.file_path")))


def read_done_markers(spark: SparkSession, root: str) -> DataFrame:
    """Directories with a done.txt, and the time that it holds."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "done.txt")
    return read.text(root, wholetext=True).select(parent(F.col("_metadata.file_path")).alias("dir"), F.regexp_replace("value", "\\s+$", "").alias("at"))


def _ledger_lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lines of ledger files with their place in the file. A ledger lists one folder, so a file is read as a whole."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    files = read.text(root, wholetext=True).select(parent(F.col("_metadata.file_path")).alias("ledger"), F.split("value", "\r?\n").alias("lines"))
    believed = F.coalesce(F.get("lines", 0).startswith("#") & F.get("lines", 1).startswith("#"), F.lit(False))
    return files.filter(believed)


def read_integrity_ledger(spark: SparkSession, root: str, name: str = "*") -> DataFrame:
    """Entries of valid ledgers below a root, with the ledger (the folder of its files): filename, size, sha1, ledger.

    A file is valid if its first two lines begin with #; all after them are entries, whatever they begin with. Of other
    files nothing is believed. An entry's name is all before its last two commas; lines without these have a name alone.
    """
    lines = _ledger_lines(spark, root, name).select("ledger", F.explode(F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0)))).alias("line"))
    line = F.regexp_replace("line", "\\s+$", "")
    entry = lambda k: F.regexp_extract(line, "^(.*),([^,]*),([^,]*)$", k)
    whole = entry(0) != ""
    some = lines.filter(line != "")
    return some.select(F.when(whole, entry(1)).otherwise(line).alias("filename"), F.when(whole, entry(2).try_cast("long")).alias("size"), F.when(whole, entry(3)).alias("sha1"), "ledger")


def valid_ledgers(spark: SparkSession, root: str, name: str = "*") -> DataFrame:
    """Ledgers (folders) with a file whose first two lines begin with #."""
    return _ledger_lines(spark, root, name).select("ledger").distinct()


def append_integrity(files: DataFrame, to: str) -> None:
    """Append filename, size and hash of files to a ledger's folder. Each task's file has the two head lines, so each is
    valid by itself; an empty ledger has a file with these alone."""
    spark = files.sparkSession

    def with_head(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if batch.num_rows and not begun:
                yield pa.RecordBatch.from_arrays([pa.array(LEDGER_HEAD, pa.string())], schema=batch.schema)
                begun = True
            yield batch

    lines = files.select(F.concat_ws(",", "filename", F.col("size").cast("string"), "sha1").alias("value"))
    lines.mapInArrow(with_head, "value string").write.mode("append").text(to)
    if spark.read.text(to).isEmpty():
        spark.createDataFrame([(line,) for line in LEDGER_HEAD], "value string").coalesce(1).write.mode("append").text(to)


#: How text is kept whole in tables of separated values: blanks stay, a quote in a value is doubled, and an empty text is
#: quoted, which tells it from null.
_LOSSLESS = {"sep": "\t", "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: What the reader calls an empty field that isn't quoted; no text holds these two characters of private use alone.
_NOTHING = "\ue000\ue001"
#: The second column of tables with one column, always empty: without it a null would be a blank line, which isn't a row.
_FILLER = "_filler"


def export_tsv(rows: DataFrame, to: str, partition_by: str | None = None, files: int = 1, rows_a_file: int = 500_000) -> None:
    """Tab-separated rows under two header lines: names, then [f] or [t] by the column's type.

    Each task writes its rows to files of their own, of up to rows_a_file rows, and every file has both header lines, so
    files can be read one by one and no task reads or writes all rows. With partition_by, each of its values is a folder
    with up to `files` files instead, whatever their size. Texts come
    back as they are: nulls, empty ones, blanks, line ends, quotes. A table of one column gets an empty second one.
    """
    names = [c for c in rows.columns if c != partition_by]
    if len(names) == 1:
        rows, names = rows.withColumn(_FILLER, F.lit(None).cast("string")), [*names, _FILLER]
    types = dict(rows.dtypes)
    codes = [type_code(types[c]) for c in names]
    text = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names], *[F.col(f"`{p}`") for p in [partition_by] if p])
    if partition_by:
        deal = [F.col(f"`{partition_by}`"), *[F.pmod(F.hash(*[F.col(f"`{c}`") for c in names]), F.lit(files))] * (files > 1)]
        text = text.repartition(*deal).sortWithinPartitions(F.col(f"`{partition_by}`"))
    most = 0 if partition_by else rows_a_file

    def with_codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, written = None, 0  # rows of the file that is being written
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if partition_by:
                    key = batch.column(batch.num_columns - 1)
                    value, stop = key[at], at + 1
                    while stop < batch.num_rows and key[stop] == value:
                        stop += 1
                else:
                    value, stop = None, batch.num_rows
                if value != last or written == most > 0:
                    written = 0
                if not written:
                    head = [pa.array([c], pa.string()) for c in codes]
                    yield pa.RecordBatch.from_arrays([*head, *[pa.array([value.as_py()], key.type) for _ in [partition_by] if partition_by]], schema=batch.schema)
                    last = value
                if most:
                    stop = min(stop, at + most - written)
                written += stop - at
                yield batch.slice(at, stop - at)
                at = stop

    # names with dots don't pass through Arrow functions
    plain = text.toDF(*[f"c{k}" for k in range(len(text.columns))])
    out = plain.mapInArrow(with_codes, plain.schema).toDF(*text.columns)
    writer = out.write.partitionBy(partition_by) if partition_by else out.write
    # a file ends where the next line of codes begins; rows of up to so many values a task aren't sorted a second time
    with settings_of(rows.sparkSession, spark__sql__maxConcurrentOutputFileWriters="256"):
        writer.options(**_LOSSLESS).option("maxRecordsPerFile", most + 1 if most else 0).csv(to, emptyValue='""', nullValue="")


def read_export_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Data rows of exported tables. The line of type codes is the first record of each file, whatever it holds.

    Values may hold line ends and rows may be empty, so a file is read as a whole; exports are many files.
    """
    read = spark.read.options(**_LOSSLESS).csv(path, multiLine=True, emptyValue="", nullValue=_NOTHING)
    names = read.columns
    own = [f"c{k}" for k in range(len(names))]
    placed = read.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))

    def data(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # a task reads its parts of files one after the other, each from its start
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = (batch.column(batch.num_columns - k).to_numpy(zero_copy_only=False) for k in (2, 1))
            first = np.ones(len(files), bool)
            first[1:] = files[1:] != files[:-1]
            first[0] = files[0] != before
            before = files[-1]
            yield batch.filter(pa.array(~(first & (blocks == 0)))).select(own)

    return placed.mapInArrow(data, ", ".join(f"{o} string" for o in own)).toDF(*names).drop(_FILLER)


def write_stage_snapshots(mask: DataFrame, names: list[str], to: str) -> None:
    """Masks after each operation of a pipeline, a folder a stage (k=.../stage=...)."""
    M.stage_masks(mask, names).write.partitionBy("k", "stage").parquet(to)


def write_dataset_metadata(new: DataFrame, existing: DataFrame, to: str, keys: tuple[str, ...] = ("object_date", "sample_id", "acq_id"), folders: tuple[str, ...] | None = None) -> DataFrame:
    """Write metadata of new acquisitions as JSON; those whose keys exist are returned, not written.

    A folder for each value of `folders` (the keys, if not given).
    """
    known = existing.select(*keys).distinct()
    new.join(known, list(keys), "left_anti").write.partitionBy(*(folders or keys)).mode("append").json(to)
    return new.join(known, list(keys), "left_semi")


def write_done_markers(datasets: DataFrame, done: DataFrame, to: str) -> None:
    """Append the datasets that aren't done yet, with the time, to the ledger of done ones."""
    datasets.join(done.select("dataset_id"), "dataset_id", "left_anti").select("dataset_id", F.current_timestamp().alias("at")).write.mode("append").parquet(to)


def write_object_crops(crops: DataFrame, to: str) -> None:
    """Scanlines of objects' crops, a folder an image range kept by Parquet's own statistics."""
    crops.sortWithinPartitions("image_id", "label", "y").write.mode("append").parquet(to)
