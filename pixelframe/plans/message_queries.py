"""Queries of messages: batch operators and streams with their batch twins as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelframe.operators import messages as M
from pixelframe.plans.registry import query
from pixelframe.sources import files as files_
from pixelframe.sources import tables as T
from pixelframe.streaming import jobs as J


@query("read_messages", "SELECT topic, event_id, CAST(json_extract(payload, '$.k') AS INT) AS k FROM msg WHERE topic = 'status/light'", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.parsed(T.msg(spark, d).filter("topic = 'status/light'"), "k int").select("topic", "event_id", "k")


@query("publish_status", """SELECT topic, event_id, '{"status":"' || status || '","device_id":' || device_id || '}' AS payload, status = 'Ready' AS retain FROM msg""", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.status_payload(J.run(J.message_stream(T.msg(spark, d))))


@query("command_status_match", "WITH c AS (SELECT * FROM msg WHERE status = 'Started'), s AS (SELECT * FROM msg WHERE status = 'Done'), m AS (SELECT c.event_id, min(struct_pack(ts := s.ts, id := s.event_id)) AS m FROM c LEFT JOIN s ON s.device_id = c.device_id AND s.ts > c.ts GROUP BY 1) SELECT event_id, m.id AS status_id FROM m", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.command_status_match(T.msg(spark, d), ["device_id"], F.col("status") == "Started", F.col("status") == "Done").select("event_id", "status_id")


@query("request_response_match", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unanswered' WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'resolved' END AS outcome, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'e' || device_id WHEN event_id % 3 = 1 THEN 'r' || device_id ELSE payload END AS value FROM msg", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    topic = F.concat(F.lit("rpc/"), F.col("event_id").cast("string"), F.lit("/response")).alias("response_topic")
    requests = T.msg(spark, d).select("event_id", topic)
    kind, name = F.col("event_id") % 3, F.col("device_id").cast("string")
    answer = F.when(kind == 0, F.concat(F.lit('{"error": "e'), name, F.lit('"}'))).when(kind == 1, F.concat(F.lit('{"result": "r'), name, F.lit('"}'))).otherwise(F.col("payload"))
    responses = T.msg(spark, d).filter("event_id % 7 <> 0").select(topic, answer.alias("payload"))
    return M.request_response_match(requests, responses).select("event_id", "outcome", "value")


@query("latest_per_topic", "WITH n AS (SELECT device_id, topic, arg_max(struct_pack(id := event_id, p := CASE WHEN event_id % 4 = 0 THEN '' ELSE payload END), struct_pack(ts := ts, id := event_id)) AS m FROM msg GROUP BY 1, 2) SELECT device_id, topic, m.id AS event_id, m.p AS payload FROM n WHERE m.p <> ''", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    log = T.msg(spark, d).withColumn("payload", F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("payload")))
    return M.latest_per_topic(log, ["device_id", "topic"]).select("device_id", "topic", "event_id", "payload")


_SESSIONS = "WITH f AS (SELECT *, lag(status) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS before FROM msg WHERE status IN ('On', 'Off')), g AS (SELECT * FROM f WHERE before <> status OR before IS NULL AND status = 'On'), s AS (SELECT device_id, status, ts AS start, lead(ts) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS stop FROM g) SELECT device_id, start, stop, CAST(floor(epoch(stop)) - floor(epoch(start)) AS BIGINT) AS seconds FROM s WHERE status = 'On' AND stop IS NOT NULL"


@query("on_off_sessions", _SESSIONS, ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.on_off_sessions(T.msg(spark, d))


@query("operating_time_total", "WITH l AS (SELECT device_id, max(struct_pack(ts := ts, id := event_id)) FILTER (status = 'Done') AS last FROM msg GROUP BY 1) SELECT l.device_id, coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (status <> 'Done' AND (last IS NULL OR struct_pack(ts := ts, id := event_id) > last)), 0)::BIGINT AS total FROM l JOIN msg USING (device_id) GROUP BY 1", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("status") == "Done", "reset").otherwise("increment")
    return M.operating_time_total(T.msg(spark, d).withColumns({"action": action, "seconds": F.round(F.col("value") * 100).cast("long")}))


@query("segmentation_rate", "SELECT device_id, round(sum(CAST(round(value * 100) AS BIGINT))::BIGINT / count(*), 6) AS per_image, round(sum(event_id % 10)::BIGINT * 100 / nullif(sum(CAST(round(value * 100) AS BIGINT))::BIGINT, 0), 6) AS objects_per_s, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS total FROM msg GROUP BY 1", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    log = T.msg(spark, d).withColumns({"centiseconds": F.round(F.col("value") * 100).cast("long"), "objects": F.col("event_id") % 10})
    return M.segmentation_rate(log, "device_id").withColumns({c: F.round(c, 6) for c in ("per_image", "objects_per_s")})


@query("running_avg_time", "SELECT event_id, round(sum(CAST(round(value * 100) AS BIGINT)) OVER w::BIGINT / count(*) OVER w, 6) AS per_image FROM msg WINDOW w AS (PARTITION BY device_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("device_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.round(F.col("value") * 100).cast("long")).over(w)
    return T.msg(spark, d).select("event_id", F.round(total / F.count("*").over(w), 6).alias("per_image"))


@query("topic_router", "SELECT event_id, CAST(json_extract(payload, '$.k') AS INT) AS k FROM msg WHERE topic = 'status/pump'", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    sink = J.dispatch(J.message_stream(T.msg(spark, d)), {"pump": ("status/pump", None), "light": ("status/light", None)})
    return sink("pump", "k int").select("event_id", "k")


_ROUTES = {"started": ("status/pump", "Started"), "done": ("status/pump", "Done"), "ready": ("status/pump", "Ready"), "on": ("status/light", "On")}


@query("topic_dispatch", "SELECT event_id, CASE WHEN topic = 'status/pump' THEN CASE status WHEN 'Started' THEN 'started' WHEN 'Done' THEN 'done' WHEN 'Ready' THEN 'ready' ELSE 'elsewhere' END WHEN status = 'On' THEN 'on' ELSE 'unknown_action' END AS sink FROM msg", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Messages told apart by topic and action, each with the sink that it went to."""
    log = T.msg(spark, d).withColumn("payload", F.to_json(F.struct(F.col("status").alias("action"))))
    sink = J.dispatch(J.message_stream(log), _ROUTES)
    out = None
    for name in (*_ROUTES, J.UNKNOWN, J.ELSEWHERE):
        rows = sink(name).select("event_id", F.lit(name).alias("sink"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("metric_stream", "SELECT event_id, 'o' || event_id AS name, CAST(device_id AS INT) AS area, round(value, 6) AS perim FROM msg", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    metric = F.to_json(F.struct(F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("name"), F.struct(F.col("device_id").alias("area"), F.col("value").alias("perim")).alias("metadata")))
    stream = J.route(J.message_stream(T.msg(spark, d).withColumns({"payload": metric, "topic": F.lit("status/segmenter/metric")})), "status/segmenter/metric", "name string, metadata struct<area int, perim double>")
    return J.run(stream.select("event_id", "name", "metadata.*")).select("event_id", "name", "area", F.round("perim", 6).alias("perim"))


_LATEST = "SELECT device_id, topic, arg_max(event_id, struct_pack(ts := ts, id := event_id)) AS event_id FROM msg GROUP BY 1, 2"


@query("conflate_latest", _LATEST, ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    out = J.run(J.conflate(J.message_stream(T.msg(spark, d)), ["device_id", "topic"]), "update")
    return J.latest_update(out, ["device_id", "topic"]).select("device_id", "topic", "event_id")


@query("retained_state", f"WITH l AS ({_LATEST}) SELECT * FROM l WHERE event_id % 4 <> 0", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    log = T.msg(spark, d).withColumn("payload", F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("payload")))
    out = J.run(J.conflate(J.message_stream(log), ["device_id", "topic"]), "update")
    return J.latest_update(out, ["device_id", "topic"]).filter("payload <> ''").select("device_id", "topic", "event_id")


_ALLOWED = " ".join(f"WHEN {'before IS NULL' if k is None else f'before = {k!r}'} THEN status IN ({', '.join(map(repr, v))})" for k, v in J.MACHINE.items())


@query("device_state_machine", f"WITH b AS (SELECT *, lag(status) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS before FROM msg) SELECT device_id, event_id, before, status, CASE {_ALLOWED} ELSE false END AS allowed FROM b", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return J.run(J.state_machine(J.message_stream(T.msg(spark, d)))).select("device_id", "event_id", "before", "status", "allowed")


@query("device_liveness", "WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS next FROM msg) SELECT device_id, ts + INTERVAL 2 DAYS AS dead_at, status AS last_status FROM n WHERE next IS NULL OR next > ts + INTERVAL 2 DAYS", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Devices that were silent for over two days, each time that they were."""
    stream = J.message_stream(T.msg(spark, d), beats="3 DAYS")
    out = J.run(J.state_machine(stream, silent="2 DAYS")).filter(F.col("status") == J.DEAD)
    return out.select("device_id", F.col("ts").cast("timestamp_ntz").alias("dead_at"), F.col("before").alias("last_status"))


@query("progress_stream", "SELECT device_id, max(event_id % 100) AS current, max(event_id % 7) AS total FROM msg GROUP BY 1", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    stream = J.message_stream(T.msg(spark, d)).withColumns({"current": F.col("event_id") % 100, "total": F.col("event_id") % 7})
    return J.latest_update(J.run(J.progress(stream, "device_id"), "update"), ["device_id"])


@query("command_latency", "SELECT c.event_id AS command_id, s.event_id AS status_id FROM msg c LEFT JOIN msg s ON c.device_id = s.device_id AND s.status = 'Done' AND s.ts > c.ts AND s.ts <= c.ts + INTERVAL 12 HOURS WHERE c.status = 'Started'", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Commands with their answers, and those without any with a null."""
    stream = J.message_stream(T.msg(spark, d), beats="2 DAYS")
    return J.run(J.answered_within(stream, F.col("status") == "Started", F.col("status") == "Done", "device_id", "12 HOURS", unanswered=True)).select("command_id", "status_id")


@query("operating_time_stream", _SESSIONS, ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    out = J.run(J.operating_time(J.message_stream(T.msg(spark, d))))
    return out.select("device_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "seconds")


@query("metrics_per_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, topic, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS centivalue FROM msg GROUP BY 1, 2", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    out = J.run(J.per_window(J.message_stream(T.msg(spark, d)), "1 day", "10 minutes"), "update")
    return J.latest_update(out, ["start", "topic"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("incremental_segmentation", "SELECT image_id, max(label) AS regions FROM regions GROUP BY 1", ("regions",))
def _(spark: SparkSession, d: str) -> DataFrame:
    from pixelframe.operators.mask import mask_runs
    from pixelframe.operators.regions import label_regions

    to = files_.scratch(spark, "arriving")
    mask = T.px(spark, d).filter("v <= 85").drop("v").withColumns({"h": F.lit(T.SIDE), "w": F.lit(T.SIDE)})
    mask.repartition("dataset_id").write.parquet(to)
    again = mask.filter("dataset_id % 3 = 0")
    again.repartition("dataset_id").write.mode("append").parquet(to)  # datasets that come twice are done once
    arriving = spark.readStream.schema(mask.schema).option("maxFilesPerTrigger", 2).parquet(to)

    def process(rows: DataFrame) -> DataFrame:
        # a dataset may be in a trigger twice
        return label_regions(mask_runs(rows.distinct())).groupBy("image_id").agg(F.max("label").alias("regions"))

    return J.each_dataset_once(arriving, process)


@query("segment_arriving")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The whole segmentation on datasets that arrive line by line over some triggers; a broken one doesn't stop the others."""
    from pixelframe.plans.image_queries import MIN_ESD, rounded
    from pixelframe.plans.segmentation import segment

    lines = T.scanlines(spark, d)
    counts = files_.stored(lines.groupBy("dataset_id").agg(F.count("*").alias("lines")), "counts")
    lines = lines.join(files_.small(counts), "dataset_id")
    to = files_.scratch(spark, "arriving")
    # three triggers, each of files of about 100,000 lines, so that a trigger's reading is spread
    files = max(1, -(-(counts.agg(F.sum("lines")).first()[0] or 0) // 300_000))
    lines.repartition(3 * files, "image_id").write.parquet(to)
    arriving = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(to)
    job = J.DatasetJob(spark, lambda rows: rounded(segment(rows.drop("lines"), MIN_ESD)), arriving.schema, expected="lines", broken=J.broken_scanlines)
    return job.run(arriving)


@query("error_stream", "SELECT device_id, count(*) AS errors FROM msg WHERE status = 'Off' OR event_id % 9 = 0 GROUP BY 1", ("msg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 9 == 0, "{").otherwise(F.col("payload"))
    stream = J.message_stream(T.msg(spark, d).withColumn("payload", broken))
    parsed = stream.withColumn("j", F.from_json("payload", "k int, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    error = F.coalesce(F.when(F.col("j._corrupt").isNotNull(), "not JSON"), F.when(F.col("status") == "Off", "switched off"))
    letters = J.run(parsed.withColumn("error", error).filter("error IS NOT NULL").select("device_id", "event_id", "error"))
    return letters.groupBy("device_id").agg(F.count("*").alias("errors"))
