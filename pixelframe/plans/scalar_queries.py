"""Queries of scalar functions, projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.functions import scalars as S
from pixelframe.functions import settings as C
from pixelframe.plans.registry import query
from pixelframe.sources import tables as T

ROOT = "http://"


@query("underscore_id", "SELECT dataset_id, replace(sample_project, ' ', '_') AS project_dir, trim(replace('''' || sample_id || '''', ' ', '_'), '''') AS sample_dir FROM acq", ("acq",))
def _(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.lit("'"), F.col("sample_id"), F.lit("'"))
    return T.acq(spark, d).select("dataset_id", S.underscore_id(F.col("sample_project")).alias("project_dir"), S.directory_id(quoted).alias("sample_dir"))


@query("strip_parent_id", "SELECT dataset_id, coalesce(nullif(split_part(sample_id, sample_project || '_', 2), ''), sample_id) AS sample, coalesce(nullif(split_part(acq_id, sample_id || '_', 2), ''), acq_id) AS acq, coalesce(nullif(split_part(sample_id, acq_id || '_', 2), ''), sample_id) AS absent FROM acq", ("acq",))
def _(spark: SparkSession, d: str) -> DataFrame:
    cut = lambda a, b: S.strip_parent_id(F.col(a), F.col(b))
    return T.acq(spark, d).select("dataset_id", cut("sample_id", "sample_project").alias("sample"), cut("acq_id", "sample_id").alias("acq"), cut("sample_id", "acq_id").alias("absent"))


@query("process_id_format", "SELECT dataset_id, replace(sample_project, ' ', '_') || '_' || replace(sample_id, ' ', '_') || '_' || dataset_id AS process_id FROM acq", ("acq",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.acq(spark, d).select("dataset_id", S.process_id(S.underscore_id(F.col("sample_project")), S.underscore_id(F.col("sample_id")), F.col("dataset_id").cast("string")).alias("process_id"))


@query("file_stem", "SELECT page_id, regexp_replace(regexp_extract(path, '[^/]*$', 0), '\\.[^.]*$', '') AS stem, regexp_extract(regexp_extract(path, '[^/]*$', 0), '\\.[^.]+$', 0) AS ext FROM paths", ("paths",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.paths(spark, d).select("page_id", S.file_stem(F.col("path")).alias("stem"), S.extension(F.col("path")).alias("ext"))


@query("relative_path", "SELECT page_id, CASE WHEN starts_with(path, 'http://') THEN substr(path, 8) END AS relative FROM paths", ("paths",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.paths(spark, d).select("page_id", S.relative_path(F.col("path"), ROOT).alias("relative"))


@query("gallery_path", "SELECT page_id, CASE WHEN starts_with(path, 'http://') THEN '/ps/data/browse/files/' || substr(path, 8) END AS gallery FROM paths", ("paths",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.paths(spark, d).select("page_id", S.gallery_path(F.col("path"), ROOT).alias("gallery"))


@query("topic_command", "SELECT event_id, regexp_replace(topic, '^[^/]+/', '') AS command FROM msg", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.msg(spark, d).select("event_id", S.topic_command(F.col("topic")).alias("command"))


@query("topic_matches", "SELECT event_id, topic = 'status/pump' AS exact, topic = 'status' OR starts_with(topic, 'status/') AS below, topic = 'status/li' OR starts_with(topic, 'status/li/') AS partial FROM msg", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("topic")
    return T.msg(spark, d).select("event_id", S.topic_matches(t, "status/pump").alias("exact"), S.topic_matches(t, "status/#").alias("below"), S.topic_matches(t, "status/li/#").alias("partial"))


@query("parse_capture_time", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS captured FROM msg", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.date_format("ts", "yyyy-MM-dd_HH-mm-ss-SSSSSS"), F.lit(".jpg"))
    named = T.msg(spark, d).withColumn("name", F.when(F.col("event_id") % 3 == 0, "untimed.jpg").otherwise(name))
    return named.select("event_id", F.date_format(S.capture_time(F.col("name")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("captured"))


@query("iso_seconds", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM msg", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.msg(spark, d).select("event_id", S.iso_seconds(F.col("ts")).alias("at"))


@query("iso_utc_now", "SELECT dataset_id, true AS is_iso FROM acq", ("acq",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.acq(spark, d).select("dataset_id", S.iso_utc_now().rlike("^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d\\.\\d{6}Z$").alias("is_iso"))


@query("interrupted_flag", "SELECT a.dataset_id, coalesce(n, 0) IS DISTINCT FROM acq_nb_frame AS interrupted FROM acq a LEFT JOIN (SELECT dataset_id, count(*) AS n FROM obj GROUP BY 1) o USING (dataset_id)", ("acq", "obj"))
def _(spark: SparkSession, d: str) -> DataFrame:
    counts = T.obj(spark, d).groupBy("dataset_id").agg(F.count("*").alias("n"))
    return T.acq(spark, d).join(counts, "dataset_id", "left").select("dataset_id", S.interrupted(F.coalesce("n", F.lit(0)), F.col("acq_nb_frame")).alias("interrupted"))


@query("name_content_hash", r"SELECT filename, sha1(encode(filename) || '\x00'::BLOB || encode(content)) AS named, sha1(encode(content)) AS plain FROM files", ("files",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.files(spark, d).select("filename", T.name_hash(F.col("filename"), F.col("content")).alias("named"), F.sha1(F.encode("content", "UTF-8")).alias("plain"))


@query("file_size", "SELECT filename, octet_length(encode(content)) AS bytes FROM files", ("files",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.files(spark, d).select("filename", F.octet_length("content").cast("long").alias("bytes"))


@query("json_parse_safe", "SELECT event_id, TRY_CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM msg WHERE event_id % 5 <> 0 AND json_valid(payload)", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    # every fifth payload is cut short: it isn't JSON and goes
    broken = T.msg(spark, d).withColumn("payload", F.when(F.col("event_id") % 5 == 0, F.substring("payload", 1, 3)).otherwise(F.col("payload")))
    parsed = broken.withColumn("j", F.from_json("payload", "k long, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.filter("j._corrupt is null").select("event_id", F.col("j.k").alias("k"))


@query("json_serialise", """SELECT dataset_id, i, '{"dataset_id":' || dataset_id || ',"area":' || area || ',"name":"' || dataset_id || '_' || i || '"}' AS json FROM obj""", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws("_", F.col("dataset_id").cast("string"), F.col("i").cast("string")).alias("name")
    return T.obj(spark, d).select("dataset_id", "i", F.to_json(F.struct("dataset_id", "area", name)).alias("json"))


@query("ratio_safe", "SELECT dataset_id, i, floor(major / nullif(minor - 20, 0) * 1e6 + 0.5::DOUBLE) / 1e6 AS elongation, floor(perim / nullif(area_exc - 400, 0) * 1e6 + 0.5::DOUBLE) / 1e6 AS per_area FROM obj", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    six = lambda c: F.floor(c * 1e6 + 0.5) / 1e6
    return T.obj(spark, d).select("dataset_id", "i", six(S.ratio_safe(F.col("major"), F.col("minor") - 20)).alias("elongation"), six(S.ratio_safe(F.col("perim"), F.col("area_exc") - 400)).alias("per_area"))


@query("angle_degrees", "SELECT dataset_id, i, round(atan2(minor, major) / pi() * 180 + 90, 6) AS angle FROM obj", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.obj(spark, d).select("dataset_id", "i", F.round(S.angle_degrees(F.atan2("minor", "major")), 6).alias("angle"))


@query("crop_bounds", "SELECT dataset_id, i, greatest(area_exc // 20 - 10, 0) AS y0, least(area_exc // 20 + i + 10, 45) AS y1 FROM obj", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    start = F.floor(F.col("area_exc") / 20)
    return T.obj(spark, d).select("dataset_id", "i", S.crop_start(start).alias("y0"), S.crop_stop(start + F.col("i"), F.lit(45)).alias("y1"))


@query("iso_gain", "SELECT dataset_id, i, round(area / (100 / 2.3125::DOUBLE), 6) AS gain, CAST(trunc(major * (100 / 2.3125::DOUBLE)) AS INT) AS iso FROM obj", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.obj(spark, d).select("dataset_id", "i", F.round(S.iso_to_gain(F.col("area")), 6).alias("gain"), S.gain_to_iso(F.col("major")).alias("iso"))


@query("media_url", "SELECT page_id, 'vault/' || path AS full_url, 'vault/' || CASE WHEN page_id % 2 = 0 THEN 'thumb_' || page_id ELSE path END AS thumb_url FROM paths", ("paths",))
def _(spark: SparkSession, d: str) -> DataFrame:
    thumb = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("thumb_"), F.col("page_id").cast("string"))).otherwise("")
    return T.paths(spark, d).select("page_id", S.media_url("vault/", F.col("path")).alias("full_url"), S.media_url("vault/", thumb, F.col("path")).alias("thumb_url"))


_NAMED = "CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.tsv' ELSE '' END"


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Paths with four kinds of extension."""
    kind = F.col("page_id") % 4
    return T.paths(spark, d).select("page_id", F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.when(kind == 0, ".JPG").when(kind == 1, ".jpeg").when(kind == 2, ".tsv").otherwise("")).alias("path"))


@query("mime_class", "SELECT page_id, CASE page_id % 4 WHEN 2 THEN 'text/tab-separated-values' WHEN 3 THEN 'application/octet-stream' ELSE 'image/jpeg' END AS mime, page_id % 4 < 2 AS is_image FROM paths", ("paths",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("page_id", S.mime_type(F.col("path")).alias("mime"), S.is_image(F.col("path")).alias("is_image"))


@query("filter_extension", f"SELECT {_NAMED} AS ext, count(*) AS n, count(*) FILTER ({_NAMED} IN ('.jpg', '.jpeg')) AS lower_case FROM paths GROUP BY 1", ("paths",))
def _(spark: SparkSession, d: str) -> DataFrame:
    ext = S.extension(F.col("path"))
    return _named(spark, d).groupBy(ext.alias("ext")).agg(F.count("*").alias("n"), F.count_if(ext.isin(".jpg", ".jpeg")).alias("lower_case"))


@query("hardware_version", "SELECT p_partkey, nullif(split_part(p_name, ' ', 2), '') AS version, nullif(split_part(p_type, ' ', 2), '') AS absent FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", S.hardware_version(F.col("p_name")).alias("version"), S.hardware_version(F.col("p_type")).alias("absent"))


_HSV = """WITH m AS (SELECT *, greatest(b, g, r) AS top, least(b, g, r) AS low FROM bgr), h AS (SELECT *, CASE WHEN top = low THEN 0.0::DOUBLE WHEN top = r THEN 60 * (g - b) / (top - low)::DOUBLE WHEN top = g THEN 120 + 60 * (b - r) / (top - low)::DOUBLE ELSE 240 + 60 * (r - g) / (top - low)::DOUBLE END AS hue FROM m), q AS (SELECT *, CAST(round(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2) AS INT) AS h0 FROM h)"""
HSV_SQL = _HSV + ", hsv AS (SELECT image_id, y, x, CASE WHEN h0 >= 180 THEN h0 - 180 ELSE h0 END AS h, CASE WHEN top = 0 THEN 0 ELSE CAST(round(255 * (top - low)::DOUBLE / nullif(top, 0)) AS INT) END AS s, top AS v FROM q)"


@query("rgb_to_hsv8", HSV_SQL + " SELECT * FROM hsv", ("bgr",))
def _(spark: SparkSession, d: str) -> DataFrame:
    h, s, v = S.hsv(F.col("b"), F.col("g"), F.col("r"))
    return T.bgr(spark, d).select("image_id", "y", "x", h.alias("h"), s.alias("s"), v.alias("v"))


def _pairs(prefix: str) -> str:
    return f"string_agg(k || '=' || coalesce(v, 'null'), ',' ORDER BY k) AS {prefix}"


_MERGED = """WITH kv AS (SELECT dataset_id, 'a' AS k, sample_project AS v, 1 AS o FROM acq UNION ALL SELECT dataset_id, 'b', sample_id, 1 FROM acq UNION ALL SELECT dataset_id, 'b', acq_id, 2 FROM acq WHERE dataset_id % 2 = 0 UNION ALL SELECT dataset_id, 'a', NULL, 2 FROM acq WHERE dataset_id % 3 = 0),
last AS (SELECT dataset_id, k, arg_max(struct_pack(v := v), o).v AS v FROM kv GROUP BY ALL)"""


def _joined(m: str) -> F.Column:
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ",")


def _empty() -> F.Column:
    return F.expr("cast(map() as map<string,string>)")


@query("merge_config", f"{_MERGED} SELECT dataset_id, {_pairs('merged')} FROM last GROUP BY dataset_id", ("acq",))
def _(spark: SparkSession, d: str) -> DataFrame:
    old = F.create_map(F.lit("a"), F.col("sample_project"), F.lit("b"), F.col("sample_id"))
    new = F.map_concat(
        F.when(F.col("dataset_id") % 2 == 0, F.create_map(F.lit("b"), F.col("acq_id"))).otherwise(_empty()),
        F.when(F.col("dataset_id") % 3 == 0, F.create_map(F.lit("a"), F.lit(None).cast("string"))).otherwise(_empty()),
    )
    return T.acq(spark, d).withColumns({"old": old, "new": new}).withColumn("m", S.merge_config(F.col("old"), F.col("new"))).select("dataset_id", _joined("m").alias("merged"))


@query("metadata_defaults", "SELECT dataset_id, 'acq_id=' || acq_id || ',acq_iso=100,acq_local_datetime=' || strftime(acq_ts, '%Y-%m-%dT%H:%M:%S') || ',sample_id=' || sample_id AS merged FROM acq", ("acq",))
def _(spark: SparkSession, d: str) -> DataFrame:
    given = F.create_map(F.lit("acq_id"), F.col("acq_id"), F.lit("sample_id"), F.col("sample_id"), F.lit("acq_iso"), F.lit("7"))
    computed = F.create_map(F.lit("acq_local_datetime"), S.iso_seconds(F.col("acq_ts")), F.lit("acq_iso"), S.gain_to_iso(F.lit(2.3125)).cast("string"))
    return T.acq(spark, d).withColumns({"given": given, "computed": computed}).withColumn("m", S.merge_config(F.col("given"), F.col("computed"))).select("dataset_id", _joined("m").alias("merged"))


@query("parse_status_text", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(event_id % 50 AS INT) END AS number, CASE WHEN event_id % 3 < 2 THEN 50 END AS total, CASE WHEN event_id % 3 < 2 THEN 'f' || device_id || '.jpg' END AS file FROM msg", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    n, file = (F.col("event_id") % 50).cast("string"), F.concat(F.lit("f"), F.col("device_id").cast("string"), F.lit(".jpg"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Image "), n, F.lit("/50 saved to "), file)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Segmenting image "), file, F.lit(", image "), n, F.lit("/50"))).otherwise(F.col("status"))
    number, total, name = S.parse_status(F.col("text"))
    return T.msg(spark, d).withColumn("text", text).select("event_id", number.alias("number"), total.alias("total"), name.alias("file"))


@query("filter_metadata_keys", "SELECT dataset_id, 'acq_id=' || acq_id || ',acquired=' || acq_nb_frame || ',sample_id=' || sample_id AS kept FROM acq", ("acq",))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(*[x for k, v in {"sample_id": F.col("sample_id"), "acq_id": F.col("acq_id"), "acquired": F.col("acq_nb_frame").cast("string"), "camera": F.lit("x"), "Sample": F.lit("y")}.items() for x in (F.lit(k), v)])
    return T.acq(spark, d).withColumn("m", metadata_keys(m)).select("dataset_id", _joined("m").alias("kept"))


def metadata_keys(m: F.Column) -> F.Column:
    """Entries of a map whose keys begin with a known prefix."""
    return F.map_filter(m, lambda k, _: k.startswith("acq") | k.startswith("sample") | k.startswith("object") | k.startswith("process"))


@query("prefix_measurement_keys", "SELECT dataset_id, i, 'object_area=' || area || ',object_label=' || dataset_id || '_' || i AS keys FROM obj", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat_ws("_", F.col("dataset_id").cast("string"), F.col("i").cast("string"))
    meta = F.create_map(F.lit("object_label"), F.lit("old"))
    measured = F.create_map(F.lit("area"), F.col("area").cast("string"), F.lit("label"), label)
    rows = T.obj(spark, d).withColumns({"meta": meta, "measured": F.transform_keys(measured, lambda k, _: F.concat(F.lit("object_"), k))})
    return rows.withColumn("m", S.merge_config(F.col("meta"), F.col("measured"))).select("dataset_id", "i", _joined("m").alias("keys"))


@query("filter_min_size", "SELECT dataset_id, i, area_exc FROM obj WHERE sqrt(4 * area_exc / pi()) >= 20", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.obj(spark, d).filter(S.equivalent_diameter(F.col("area_exc")) >= 20).select("dataset_id", "i", "area_exc")


@query("validate_required_fields", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'nb_frame' WHEN event_id % 5 = 0 THEN 'sleep' WHEN event_id % 3 = 0 THEN 'volume' WHEN event_type = 'error' THEN 'pump_direction' END AS missing FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    lost = lambda n, v: F.when(F.col("event_id") % n != 0, v)
    e = T.table(spark, d, "events").withColumns({"nb_frame": lost(7, F.col("user_id")), "sleep": lost(5, F.lit(0.5)), "volume": lost(3, F.col("value")), "pump_direction": F.when(F.col("event_type") != "error", "FORWARD")})
    return e.select("event_id", C.missing_field().alias("missing"))


@query("normalise_resolution", "SELECT dataset_id, i, CASE WHEN i % 2 = 0 THEN area_exc || 'x' || area ELSE '4056x3040' END AS resolution FROM obj", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("i") % 2 == 1, "4056x3040")
    pair = F.array(F.col("area_exc").cast("string"), F.col("area").cast("string"))
    return T.obj(spark, d).select("dataset_id", "i", F.coalesce(text, F.concat_ws("x", pair)).alias("resolution"))


_SET = {"exposure": "l_extendedprice - 5000", "gain": "l_quantity - 10", "brightness": "l_discount * 20 - 0.5", "contrast": "l_quantity", "wb_red": "nullif(l_linenumber, 3) * 5", "wb_blue": "l_linenumber * 6", "sharpness": "l_quantity / 2", "jpeg_quality": "l_quantity * 2"}


def _settings(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.expr(text.replace("0.5", "0.5D")).alias(name) for name, text in _SET.items()])


_CASES = ", ".join(f"CASE WHEN {r.column} < {r.low}{f' OR {r.column} > {r.high}' if r.high is not None else ''} THEN '{r.label}' END" for r in C.RANGES)
_VALIDATED = f"WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(f'{t} AS {n}' for n, t in _SET.items()).replace('0.5', '0.5::DOUBLE')} FROM lineitem), e AS (SELECT *, list_filter([{_CASES}], lambda x: x IS NOT NULL) AS errors FROM s)"


@query("validate_ranges", f"{_VALIDATED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(errors, ';') AS errors, len(errors) = 0 AS valid FROM e")
def _(spark: SparkSession, d: str) -> DataFrame:
    checked = _settings(spark, d).withColumn("errors", C.violations())
    return checked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("errors", ";").alias("errors"), (F.size("errors") == 0).alias("valid"))


@query("validate_exposure", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey - 100 < 0 ELSE NOT l_partkey BETWEEN 10 * l_linenumber AND 10 * l_suppkey END AS exposure_error, l_discount * 12 > 1 AS light_error, l_returnflag NOT IN ('A', 'R') AS mode_error FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = T.table(spark, d, "lineitem").withColumns({"limited": c("l_linenumber") % 3 != 0, "value": c("l_discount") * 12})
    limit = lambda x: F.when(c("limited"), x)
    exposure = F.when(c("limited"), c("l_partkey")).otherwise(c("l_partkey") - 100)
    error = C.exposure_outside(exposure, limit(10 * c("l_linenumber")), limit(10 * c("l_suppkey")))
    light = F.size(C.violations((C.LIGHT_RANGE,))) > 0
    mode = ~C.one_of(c("l_returnflag"), ("A", "R"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", error.alias("exposure_error"), light.alias("light_error"), mode.alias("mode_error"))


_PUBLIC = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.PUBLIC.items())


@query("first_error_message", f"{_VALIDATED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE errors[1] {_PUBLIC} ELSE errors[1] || ' not valid' END AS message FROM e")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _settings(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.first_error(C.violations()).alias("message"))


@query("validate_enum", "SELECT event_id, event_type IN ('click', 'view') AS direction_ok, event_type IN ('view', 'signup') AS balance_ok, value <= 45 AS distance_ok FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    e = T.table(spark, d, "events").withColumns({"direction": F.when(kind == "click", "FORWARD").when(kind == "view", "BACKWARD").otherwise("SIDEWAYS"), "balance": F.when(kind == "view", "auto").when(kind == "signup", "off").otherwise("warm")})
    return e.select("event_id", C.one_of(F.col("direction"), ("FORWARD", "BACKWARD")).alias("direction_ok"), C.one_of(F.col("balance"), ("auto", "off")).alias("balance_ok"), (F.col("value") <= 45).alias("distance_ok"))


@query("convert_settings", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'fast' ELSE user_id::VARCHAR END AS INT) AS shutter, round(coalesce(CASE WHEN event_id % 2 = 0 THEN user_id END / (100 / 2.3125::DOUBLE), value), 6) AS gain, CASE WHEN event_id % 5 < 4 THEN round(coalesce(CASE WHEN event_id % 5 < 2 THEN value / 100 END, 1.5), 6) END AS red, CASE WHEN event_id % 5 < 4 THEN round(coalesce(CASE WHEN event_id % 5 > 0 THEN value / 100 END, 2.5), 6) END AS blue FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    shutter = F.when(F.col("event_id") % 9 == 0, "fast").otherwise(F.col("user_id").cast("string")).try_cast("int")
    gain = C.converted_gain(F.when(F.col("event_id") % 2 == 0, F.col("user_id")), F.col("value"))
    red, blue = C.balanced_gains(F.when(k < 2, F.col("value")), F.when((k > 0) & (k < 4), F.col("value")), F.lit(1.5), F.lit(2.5))
    return T.table(spark, d, "events").select("event_id", shutter.alias("shutter"), F.round(gain, 6).alias("gain"), F.round(F.when(k < 4, red), 6).alias("red"), F.round(F.when(k < 4, blue), 6).alias("blue"))


@query("overlay_settings", "SELECT c_custkey, coalesce(s_name, c_name) AS name, coalesce(s_nationkey, c_nationkey) AS nation, coalesce(s_acctbal, c_acctbal) AS balance FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    now = T.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("now_name"), F.col("c_nationkey").alias("now_nation"), F.col("c_acctbal").alias("now_balance"))
    new = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("new_name"), F.col("s_nationkey").alias("new_nation"), F.col("s_acctbal").alias("new_balance"))
    fields = ["name", "nation", "balance"]
    return C.overlay(now.join(new, "c_custkey", "left"), fields, "now_", "new_").select("c_custkey", *fields)


@query("drop_null_fields", "SELECT event_id, concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'gain=' || user_id END, CASE WHEN event_id % 3 = 0 THEN 'iso=' || user_id END) AS fields, event_id % 2 = 0 OR event_id % 3 = 0 AS has_values FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").withColumns({"gain": F.when(F.col("event_id") % 2 == 0, F.col("user_id")), "iso": F.when(F.col("event_id") % 3 == 0, F.col("user_id"))})
    return e.withColumn("m", C.given(["gain", "iso"])).select("event_id", _joined("m").alias("fields"), (F.size("m") > 0).alias("has_values"))


@query("apply_setting_defaults", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN true ELSE false END AS force, true AS recursive, true AS ecotaxa, event_id % 3 <> 0 AS keep, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS INT) ELSE 20 END AS process_min_ESD, false AS remove_previous_mask FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"force": true, "process_min_ESD": '), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, ', "keep": false').otherwise(""), F.lit("}"))).otherwise(F.when(F.col("event_id") % 3 == 0, '{"keep": false}').otherwise("{}"))
    parsed = F.from_json(text, "force boolean, recursive boolean, ecotaxa boolean, keep boolean, process_min_ESD int, remove_previous_mask boolean")
    return T.table(spark, d, "events").withColumn("s", parsed).select("event_id", *[c.alias(n) for n, c in C.with_defaults(F.col("s")).items()])


_ACTUATE = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 10 AS volume, l_discount * 100 AS flow, l_tax * 100 AS speed, p_size AS per FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(
    "enrich_actuation",
    f"WITH a AS ({_ACTUATE}) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(per * volume * 256, 0) AS BIGINT) AS pump_steps, round(round_even(per * volume * 256, 0) / (least(nullif(flow, 0), 5) * per * 256 / 60), 6) AS pump_s, CAST(round_even(per * volume * 256, 0) AS BIGINT) AS focus_steps, round(round_even(per * volume * 256, 0) / nullif(least(speed, 4) * per * 256, 0), 6) AS focus_s FROM a",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    part = T.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("per"))
    a = T.table(spark, d, "lineitem").join(part, "l_partkey").withColumns({"volume": F.col("l_quantity") / 10, "flow": F.col("l_discount") * 100, "speed": F.col("l_tax") * 100})
    pump, focus = C.pump_steps(F.col("volume"), F.col("flow"), F.col("per"), 5.0), C.focus_steps(F.col("volume"), F.col("speed"), F.col("per"), 4.0)
    return a.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pump["nb_steps"].alias("pump_steps"), F.round(pump["duration"], 6).alias("pump_s"), focus["nb_steps"].alias("focus_steps"), F.round(focus["duration"], 6).alias("focus_s"))


@query("imaged_volume", "SELECT dataset_id, round(count(*) * 2.1::DOUBLE / 1000, 6) AS volume_ml FROM obj GROUP BY dataset_id", ("obj",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.obj(spark, d).groupBy("dataset_id").agg(F.round(F.count("*") * 2.1 / 1000, 6).alias("volume_ml"))
