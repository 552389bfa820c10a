"""Commands, statuses and metrics as tables of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def command_status_match(log: DataFrame, key: list[str], is_command: Column, is_status: Column, timeout: str | None = None) -> DataFrame:
    """Each command with the first later status message of its key: event_id, ts, status_id, status_ts (null: none).

    One window over both kinds, sorted by time, looks ahead to the next status; commands and statuses are never paired
    off. Messages of the same time and key don't answer each other.
    """
    marked = log.withColumns({"_c": is_command, "_s": F.when(is_status, F.struct("ts", "event_id"))}).filter("_c OR _s IS NOT NULL")
    by_time = Window.partitionBy(*key).orderBy(F.desc("ts"))
    # the first status of each time, then the last one seen when going back in time
    at = Window.partitionBy(*key, "ts")
    marked = marked.withColumn("_s", F.min("_s").over(at))
    ahead = F.last("_s", ignorenulls=True).over(by_time.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.col("_s").isNotNull()
    before_own = F.lag("_next").over(by_time)
    steps = marked.dropDuplicates([*key, "ts"]).withColumn("_next", ahead)
    steps = steps.select(*key, "ts", F.when(own, before_own).otherwise(F.col("_next")).alias("_answer"))
    out = marked.filter("_c").drop("_s").join(steps, [*key, "ts"])
    answer = F.col("_answer") if timeout is None else F.when(F.col("_answer.ts") <= F.col("ts") + F.expr(f"INTERVAL {timeout}"), F.col("_answer"))
    return out.withColumn("_answer", answer).select("event_id", "ts", F.col("_answer.event_id").alias("status_id"), F.col("_answer.ts").alias("status_ts"))


def request_response_match(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests (id, response_topic) with outcome resolved, rejected or unanswered and the value answered.

    A payload's error rejects; else its result, or else the whole payload, is the value.
    """
    parsed = responses.withColumn("j", F.from_json("payload", "result string, error string"))
    answers = parsed.select("response_topic", F.col("j.error").alias("error"), F.coalesce("j.error", "j.result", "payload").alias("value"))
    outcome = F.when(F.col("value").isNull(), "unanswered").when(F.col("error").isNotNull(), "rejected").otherwise("resolved")
    return requests.join(answers, "response_topic", "left").withColumn("outcome", outcome).drop("error")


def latest_per_topic(log: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """The newest message of each key, unless it is empty, which clears the topic. Combined before the exchange."""
    newest = log.groupBy(*keys).agg(F.max_by(F.struct("event_id", "ts", payload), F.struct("ts", "event_id")).alias("m"))
    return newest.select(*keys, "m.*").filter(F.coalesce(F.length(payload), F.lit(0)) > 0)


def on_off_sessions(log: DataFrame, key: str = "device_id") -> DataFrame:
    """Sessions from the first On to the next Off: start, stop, whole seconds. Further Ons change nothing."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    flips = log.filter(F.col("status").isin("On", "Off")).withColumn("before", F.lag("status").over(w))
    flips = flips.filter((F.col("before") != F.col("status")) | (F.col("before").isNull() & (F.col("status") == "On")))
    closed = flips.withColumn("stop", F.lead("ts").over(w)).filter("status = 'On' AND stop IS NOT NULL")
    whole = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return closed.select(key, F.col("ts").alias("start"), "stop", (whole("stop") - whole("ts")).alias("seconds"))


def operating_time_total(log: DataFrame, key: str = "device_id") -> DataFrame:
    """Seconds of increments since the last reset. log: key, ts, event_id, action (increment, reset), seconds."""
    at = F.struct("ts", "event_id")
    last = log.groupBy(key).agg(F.max(F.when(F.col("action") == "reset", at)).alias("last"))
    since = log.join(last, key).filter((F.col("action") == "increment") & (F.col("last").isNull() | (at > F.col("last"))))
    return last.select(key).join(since.groupBy(key).agg(F.sum("seconds").alias("total")), key, "left").withColumn("total", F.coalesce("total", F.lit(0)))


def segmentation_rate(log: DataFrame, key: str) -> DataFrame:
    """Average hundredths of seconds an image, objects a second and hundredths in all, from whole numbers."""
    total = F.sum("centiseconds")
    return log.groupBy(key).agg((total / F.count("*")).alias("per_image"), F.try_divide(F.sum("objects") * 100, total).alias("objects_per_s"), total.alias("total"))


def parsed(log: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """Messages with their payload's fields; those that aren't JSON objects go."""
    fields = F.from_json(payload, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return log.withColumn("_j", fields).filter("_j IS NOT NULL AND _j._corrupt IS NULL").select(*log.columns, "_j.*").drop("_corrupt")


def status_payload(log: DataFrame) -> DataFrame:
    """Messages to publish: topic and JSON text."""
    return log.select("topic", "event_id", F.to_json(F.struct("status", "device_id")).alias("payload"), (F.col("status") == "Ready").alias("retain"))
