"""Queries of catalogues, files, integrity, paging and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelframe.functions import scalars as S
from pixelframe.operators import catalog as K
from pixelframe.plans.registry import query
from pixelframe.sources import files as files_
from pixelframe.sources import tables as T


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    """Files with size and hash, of which every hundredth is missing."""
    f = T.files(spark, d).filter(~F.col("filename").endswith("50.txt"))
    return f.select("dir", "filename", F.octet_length("content").cast("long").alias("size"), T.name_hash(F.col("filename"), F.col("content")).alias("sha1"))


_STATUS = r"verified AS (SELECT l.dir, l.filename, CASE WHEN f.filename IS NULL THEN 'missing' WHEN octet_length(encode(content)) = size AND sha1(encode(f.filename) || '\x00'::BLOB || encode(content)) = sha1 THEN 'valid' ELSE 'invalid' END AS status FROM ledger l LEFT JOIN (SELECT * FROM files WHERE NOT ends_with(filename, '50.txt')) f USING (dir, filename))"


@query("verify_integrity", f"WITH {_STATUS} SELECT dir, filename, status FROM verified", ("files", "ledger"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.verify_integrity(T.ledger(spark, d), _hashed(spark, d))


@query("partition_valid_invalid", f"WITH {_STATUS} SELECT dir, status, count(*) AS n, array_to_string(list_sort(list(filename))[1:1000], ',') AS names FROM verified GROUP BY dir, status", ("files", "ledger"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.by_status(K.verify_integrity(T.ledger(spark, d), _hashed(spark, d))).withColumn("names", F.array_join("names", ","))


@query("list_valid_invalid", f"WITH {_STATUS} SELECT dir, status, filename, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY dir, status) AS n FROM verified WINDOW w AS (PARTITION BY dir, status ORDER BY filename)", ("files", "ledger"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.listed_by_status(K.verify_integrity(T.ledger(spark, d), _hashed(spark, d)))


@query("concat_reports", f"WITH {_STATUS} SELECT status, count(*) AS n FROM verified GROUP BY status", ("files", "ledger"))
def _(spark: SparkSession, d: str) -> DataFrame:
    v = K.verify_integrity(T.ledger(spark, d), _hashed(spark, d))
    return v.filter("status = 'valid'").unionByName(v.filter("status <> 'valid'")).groupBy("status").agg(F.count("*").alias("n"))


@query("append_integrity", "SELECT filename, size, sha1 FROM ledger", ("ledger",))
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "ledger")
    ledger = T.ledger(spark, d)
    odd = F.crc32(F.encode("filename", "UTF-8")) % 2 == 1
    files_.append_integrity(ledger.filter(odd), to)
    files_.append_integrity(ledger.filter(~odd), to)
    return files_.read_integrity_ledger(spark, to).drop("ledger")


@query("read_integrity_ledger", "SELECT 1 AS heads, count(*) AS entries, sum(size)::BIGINT AS bytes FROM ledger", ("ledger",))
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "ledger")
    files_.append_integrity(T.ledger(spark, d), to)
    heads = files_.valid_ledgers(spark, to).agg(F.count("*").alias("heads"))
    return files_.read_integrity_ledger(spark, to).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes")).crossJoin(F.broadcast(heads))


@query("discover_datasets", "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM paths WHERE page_id % 3 = 0", ("paths",))
def _(spark: SparkSession, d: str) -> DataFrame:
    leaf = F.when(F.col("page_id") % 3 == 0, "/metadata.json").otherwise("/0001.jpg")
    return files_.discover_datasets(T.paths(spark, d).select(F.concat(files_.parent(F.col("path")), leaf).alias("path")))


@query("read_metadata_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("read_metadata_files", "SELECT s_suppkey AS dataset_id, s_name AS acq_id, CASE WHEN s_suppkey % 9 > 0 THEN CAST(s_suppkey % 7 AS INT) END AS acq_nb_frame FROM supplier WHERE s_suppkey % 9 <> 1 UNION ALL SELECT s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 9 = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "datasets")
    frames = F.when(F.col("s_suppkey") % 9 > 0, (F.col("s_suppkey") % 7).cast("int"))
    document = F.when(F.col("s_suppkey") % 9 == 1, "{broken").otherwise(F.to_json(F.struct(F.col("s_name").alias("acq_id"), frames.alias("acq_nb_frame"))))
    path = F.concat(F.lit("d"), F.col("s_suppkey").cast("string"), F.lit("/metadata.json"))
    files_.write_files(T.table(spark, d, "supplier").select(path.alias("path"), F.encode(document, "UTF-8").alias("content")), to)
    read = files_.read_metadata_json(spark, to, "acq_id string, acq_nb_frame int")
    return read.select(F.regexp_extract("dir", "/d(\\d+)$", 1).cast("long").alias("dataset_id"), "acq_id", "acq_nb_frame")


@query("read_done_markers", "SELECT DISTINCT doc_id // 100 AS dataset_id FROM labels WHERE quality = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "done")
    done = T.table(spark, d, "labels").filter("quality = 1").select(F.floor(F.col("doc_id") / 100).alias("dataset_id")).distinct()
    path = F.concat(F.lit("d"), F.col("dataset_id").cast("string"), F.lit("/done.txt"))
    files_.write_files(done.select(path.alias("path"), F.encode(F.lit("2024-01-01T00:00:00Z\n"), "UTF-8").alias("content")), to)
    marked = files_.read_done_markers(spark, to).filter("at = '2024-01-01T00:00:00Z'")
    return marked.select(F.regexp_extract("dir", "/d(\\d+)$", 1).cast("long").alias("dataset_id"))


@query("walk_files", "SELECT page_id % 16 AS folder, count(*) AS n, sum(octet_length(encode(url)) + 1)::BIGINT AS bytes FROM pages GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "walk")
    T.table(spark, d, "pages").select("url", (F.col("page_id") % 16).alias("folder")).write.partitionBy("folder").text(to)
    found = files_.walk_files(spark, to).withColumn("folder", F.regexp_extract("path", "folder=(\\d+)", 1).cast("long"))
    lines = spark.read.text(to).groupBy(F.col("folder").cast("long").alias("folder")).agg(F.count("*").alias("n"))
    return found.groupBy("folder").agg(F.sum("length").alias("bytes")).join(lines, "folder").select("folder", "n", "bytes")


@query("count_files", "SELECT regexp_extract(path, '^[a-z]+://[^/]+', 0) AS root, count(*) AS n, count(*) FILTER (page_id % 4 < 2) AS images FROM paths GROUP BY 1", ("paths",))
def _(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("page_id") % 4
    named = F.concat(F.lit("a"), F.when(kind == 0, ".JPG").when(kind == 1, ".jpeg").when(kind == 2, ".tsv").otherwise(""))
    return T.paths(spark, d).groupBy(F.regexp_extract("path", "^[a-z]+://[^/]+", 0).alias("root")).agg(F.count("*").alias("n"), F.count_if(S.is_image(named)).alias("images"))


@query("sort_files", "SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(path, '^[a-z]+://[^/]+', 0) ORDER BY path, page_id) - 1 AS seq FROM paths", ("paths",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.sort_files(T.paths(spark, d), F.regexp_extract("path", "^[a-z]+://[^/]+", 0), [F.col("path"), F.col("page_id")]).select("page_id", "seq")


@query("union_dirs", "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM paths", ("paths",))
def _(spark: SparkSession, d: str) -> DataFrame:
    p = T.paths(spark, d).select("page_id", files_.parent(F.col("path")).alias("dir"))
    return p.filter("page_id % 3 < 2").select("dir").unionByName(p.filter("page_id % 3 > 0").select("dir")).distinct()


@query("read_config", "SELECT p_brand, max(p_size) AS steps_per_ml, min(p_retailprice) AS flow FROM part GROUP BY p_brand")
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "config")
    T.table(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("steps_per_ml"), F.min("p_retailprice").alias("flow")).write.json(to)
    return spark.read.schema("p_brand string, steps_per_ml int, flow double").json(to)


@query("select_unprocessed", "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.unprocessed(T.table(spark, d, "documents").select("doc_id", "source"), T.table(spark, d, "labels"), "doc_id")


@query("is_segmented", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS segmented FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.with_marker(T.table(spark, d, "documents").select("doc_id"), T.table(spark, d, "labels"), "doc_id", "segmented")


@query("attach_metadata", "SELECT o.dataset_id, i, area, sample_project, acq_id FROM obj o JOIN acq USING (dataset_id)", ("acq", "obj"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.attach_metadata(T.obj(spark, d), T.acq(spark, d)).select("dataset_id", "i", "area", "sample_project", "acq_id")


@query("dataset_image_count", "SELECT a.dataset_id, count(o.dataset_id) AS n_images FROM acq a LEFT JOIN obj o USING (dataset_id) GROUP BY 1", ("acq", "obj"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.with_image_count(T.acq(spark, d).select("dataset_id"), T.obj(spark, d))


@query("merge_catalogs", "SELECT coalesce(a.dataset_id, o.dataset_id) AS dataset_id, acq_id, n, CASE WHEN n IS NULL THEN 'unprocessed' WHEN acq_id IS NULL THEN 'orphan' ELSE 'processed' END AS state FROM (SELECT * FROM acq WHERE dataset_id % 4 > 0) a FULL JOIN (SELECT dataset_id, count(*) AS n FROM obj GROUP BY 1) o ON a.dataset_id = o.dataset_id", ("acq", "obj"))
def _(spark: SparkSession, d: str) -> DataFrame:
    a = T.acq(spark, d).filter("dataset_id % 4 > 0").select("dataset_id", "acq_id")
    o = T.obj(spark, d).groupBy("dataset_id").agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "unprocessed").when(F.col("acq_id").isNull(), "orphan").otherwise("processed")
    return a.join(o, "dataset_id", "full").select("dataset_id", "acq_id", "n", state.alias("state"))


@query("object_index", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem WHERE sqrt(4 * CAST(l_quantity AS BIGINT) * 20 / pi()) >= 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem").filter(S.equivalent_diameter(F.col("l_quantity").cast("long") * 20) >= 20).withColumn("dataset_id", F.col("l_orderkey"))
    out = K.object_index(li, [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("i").cast("long").alias("i"))


@query("progress_fraction", "SELECT dataset_id, i, i + 1 AS current, count(*) OVER (PARTITION BY dataset_id) AS total FROM obj", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.progress(T.obj(spark, d), "dataset_id", [F.col("i")]).select("dataset_id", "i", F.col("current").cast("long").alias("current"), "total")


_PAGED = "paged AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS place, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)"


@query("page_window", f"WITH {_PAGED} SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, place // 100 AS page, CAST(ceil(total / 100) AS BIGINT) AS pages, CASE WHEN (place // 100 + 1) * 100 < total THEN (place // 100 + 1) * 100 END AS next_start FROM paged")
def _(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return K.all_pages(li, ["l_suppkey"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")], 100)


@query("one_page", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100 OFFSET 200")
def _(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return K.page_of(li, [F.col(c) for c in li.columns], 200, 100)


@query("shuffle_page", "SELECT dataset_id, i, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('7:' || dataset_id || '_' || i)) - 1 AS place FROM obj", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("_", F.col("dataset_id").cast("string"), F.col("i").cast("string"))
    return K.shuffled(T.obj(spark, d), ["dataset_id"], key, 7).select("dataset_id", "i", F.col("place").cast("long").alias("place"))


@query("first_data_row", "SELECT dataset_id, area, area_exc FROM obj WHERE i = 0", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    first = F.min_by(F.struct("area", "area_exc"), "i").alias("f")
    return T.obj(spark, d).groupBy("dataset_id").agg(first).select("dataset_id", "f.*")


def _object_page(spark: SparkSession, d: str) -> DataFrame:
    """Objects of a dataset as parallel arrays."""
    row = F.struct("i", F.array(F.concat(F.lit("f"), F.col("i").cast("string")), F.col("area").cast("string"), F.col("area_exc").cast("string")).alias("d"))
    pages = T.obj(spark, d).groupBy("dataset_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count("*").alias("total_ids"))
    return pages.select("dataset_id", F.col("rows.i").alias("object_ids"), F.col("rows.d").alias("details"), "total_ids")


@query("zip_positional", "SELECT dataset_id, i AS object_id, 'f' || i AS file_name, area::VARCHAR AS width, area_exc::VARCHAR AS height FROM obj", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return K.zip_positional(_object_page(spark, d), "object_ids", "details", ["file_name", "width", "height"]).drop("pos", "total_ids")


@query("read_object_page", "SELECT dataset_id, i AS object_id, 'f' || i AS file_name, count(*) OVER (PARTITION BY dataset_id) AS total_ids FROM obj", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "pages")
    _object_page(spark, d).write.json(to)
    pages = spark.read.schema("dataset_id long, object_ids array<long>, details array<array<string>>, total_ids long").json(to)
    return K.zip_positional(pages, "object_ids", "details", ["file_name"]).select("dataset_id", "object_id", "file_name", "total_ids")


def _typed(rows: DataFrame) -> DataFrame:
    """Each column's type code and how many values it has."""
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns])
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(S.type_code(t)).alias("code"), F.col(n).alias("n")) for n, t in rows.dtypes])
    return counts.select(F.inline(entries))


@query("column_type_inference", "SELECT name, code, (SELECT count(*) FROM obj) AS n FROM (VALUES ('dataset_id', '[f]'), ('i', '[f]'), ('perim', '[f]'), ('object_id', '[t]'), ('large', '[t]')) t(name, code)", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws("_", F.col("dataset_id").cast("string"), F.col("i").cast("string"))
    return _typed(T.obj(spark, d).select("dataset_id", "i", "perim", name.alias("object_id"), (F.col("area") > 400).alias("large")))


@query("type_code", "SELECT name, code, (SELECT count(*) FROM acq) AS n FROM (VALUES ('dataset_id', '[f]'), ('sample_project', '[t]'), ('sample_id', '[t]'), ('acq_id', '[t]'), ('acq_ts', '[t]'), ('acq_nb_frame', '[f]'), ('is_segmented', '[t]'), ('customer', '[f]')) t(name, code)", ("acq",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _typed(T.acq(spark, d))


def _export_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows to export: metadata, measurements as object_*, object_id, file name and rank."""
    name = F.concat_ws("_", F.col("dataset_id").cast("string"), F.col("i").cast("string"))
    rows = K.attach_metadata(T.obj(spark, d), T.acq(spark, d).select("dataset_id", "sample_id", "acq_id"))
    measured = {c: f"object_{c}" for c in ("area_exc", "area", "major")}
    return rows.withColumnsRenamed(measured).withColumns({"object_id": name, "img_file_name": F.concat(name, F.lit(".jpg")), "img_rank": F.lit(1)}).drop("i", "perim", "minor", "dataset_id")


_EXPORTED = "SELECT sample_id, acq_id, area_exc::VARCHAR AS object_area_exc, area::VARCHAR AS object_area, major::VARCHAR AS object_major, dataset_id || '_' || i AS object_id, dataset_id || '_' || i || '.jpg' AS img_file_name, '1' AS img_rank FROM obj JOIN acq USING (dataset_id)"


@query("export_measurements_tsv", _EXPORTED, ("acq", "obj"))
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "export")
    files_.export_tsv(_export_rows(spark, d), to)
    return files_.read_export_tsv(spark, to)


@query("export_partition_per_acquisition", "SELECT customer % 50 AS bundle, count(*) + 1 AS lines, count(*) AS n FROM obj JOIN acq USING (dataset_id) GROUP BY 1", ("acq", "obj"))
def _(spark: SparkSession, d: str) -> DataFrame:
    # fifty bundles: a folder an acquisition would be thousands of tiny files here
    to = files_.scratch(spark, "bundles")
    bundle = F.regexp_extract("sample_id", "_s(\\d+)$", 1).cast("long") % 50
    files_.export_tsv(_export_rows(spark, d).withColumn("bundle", bundle).select("object_id", "object_area", "bundle"), to, partition_by="bundle")
    raw = spark.read.csv(to, sep="\t", header=True)
    return raw.groupBy(F.col("bundle").cast("long").alias("bundle")).agg(F.count("*").alias("lines"), F.count_if(F.col("object_id") != "[t]").alias("n"))


@query("read_export_tsv", "SELECT count(*) AS n, sum(area)::BIGINT AS area FROM obj JOIN acq USING (dataset_id)", ("acq", "obj"))
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "export")
    files_.export_tsv(_export_rows(spark, d).select("object_id", "object_area"), to)
    return files_.read_export_tsv(spark, to).agg(F.count("*").alias("n"), F.sum(F.col("object_area").cast("long")).alias("area"))


@query("write_dataset_metadata", "SELECT dataset_id, dataset_id % 3 > 0 AS written FROM acq", ("acq",))
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "metadata")
    a = T.acq(spark, d).select("dataset_id", F.date_format("acq_ts", "yyyy").alias("object_date"), "sample_project", "sample_id")
    known = a.filter("dataset_id % 3 = 0").select("dataset_id")
    rejected = files_.write_dataset_metadata(a, known, to, keys=("dataset_id",), folders=("object_date",))
    read = spark.read.schema("dataset_id long, sample_project string, sample_id string, object_date string").json(to)
    return read.select("dataset_id", F.lit(True).alias("written")).unionByName(rejected.select("dataset_id", F.lit(False).alias("written")))


@query("write_done_marker", "SELECT dataset_id, 1::BIGINT AS times FROM acq WHERE is_segmented", ("acq",))
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "done")
    segmented = T.acq(spark, d).filter("is_segmented")
    files_.write_done_markers(segmented.filter("dataset_id % 2 = 0"), segmented.limit(0), to)
    files_.write_done_markers(segmented, spark.read.parquet(to), to)  # the second run adds only what is new
    return spark.read.parquet(to).groupBy("dataset_id").agg(F.count("*").alias("times"))


@query("write_object_crops", "SELECT image_id, y, sum(b)::BIGINT AS b, sum(g)::BIGINT AS g, sum(r)::BIGINT AS r FROM bgr WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6 GROUP BY 1, 2", ("bgr",))
def _(spark: SparkSession, d: str) -> DataFrame:
    from pixelframe.operators.regions import crop_objects

    to = files_.scratch(spark, "crops")
    lines = T.scanlines(spark, d)
    box = lines.filter("y = 0").select("image_id", F.lit(1).cast("long").alias("label"), F.lit(3).alias("bx"), F.lit(4).alias("by"), F.lit(2).alias("width"), F.lit(0).alias("height"))
    files_.write_object_crops(crop_objects(box, lines, pad=2), to)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v).alias(c)
    return spark.read.parquet(to).select("image_id", "y", *[total(c) for c in "bgr"])


@query("catalog_rollup", "SELECT sample_project, sample_id, count(*) AS n FROM acq GROUP BY ROLLUP (sample_project, sample_id)", ("acq",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.acq(spark, d).rollup("sample_project", "sample_id").agg(F.count("*").alias("n"))


@query("size_spectrum", "SELECT CAST(floor(sqrt(4 * area_exc / pi()) * 0.75 / 2) AS BIGINT) AS bin, count(*) AS n FROM obj GROUP BY 1", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.obj(spark, d).groupBy(F.floor(S.equivalent_diameter(F.col("area_exc")) * 0.75 / 2).alias("bin")).agg(F.count("*").alias("n"))


@query("concentration", "SELECT a.dataset_id, round(count(o.i) / (acq_nb_frame * 2.1::DOUBLE / 1000), 6) AS per_ml FROM acq a LEFT JOIN obj o USING (dataset_id) GROUP BY a.dataset_id, acq_nb_frame", ("acq", "obj"))
def _(spark: SparkSession, d: str) -> DataFrame:
    counted = K.with_image_count(T.acq(spark, d), T.obj(spark, d))
    return counted.select("dataset_id", F.round(F.col("n_images") / (F.col("acq_nb_frame") * 2.1 / 1000), 6).alias("per_ml"))
