"""Structured Streaming over the message log: routing, conflation, retained state, state machines, joins, windows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pixelframe.session import settings_of
from pixelframe.sources.files import scratch, stored


def message_stream(log: DataFrame, parts: int = 4, per_file: int = 500_000, beats: str | None = None) -> DataFrame:
    """A stream over a message table: the table is laid out as files in the order of time, read a part a trigger.

    Files are taken by age, so the parts, split at quantiles of time, are written one after the other, each as files of
    about per_file messages by as many tasks. In production the same operators read a broker's topics; a payload column,
    a topic and a time are all they need. With beats, an interval, two messages with nothing but a time follow the last
    one, that interval apart, as a broker's heartbeats do: watermarks declared on the stream go on without messages.
    """
    spark = log.sparkSession
    to = scratch(spark, "messages")
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    facts = log.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 10_000).alias("c"), F.count("*").alias("n")).first()
    cuts, files = facts["c"] or [], max(1, -(-facts["n"] // (parts * per_file)))
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:]):
        part = log if low is None else log.filter(at > low)
        part = part if high is None else part.filter(at <= high)
        part.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.mode("append").parquet(to)
    if beats:
        last = log.agg(F.max("ts").alias("last"))
        for k in (1, 2):
            beat = last.select(F.expr(f"last + {k} * INTERVAL {beats}").alias("ts"))
            beat.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema]).repartition(files).write.mode("append").parquet(to)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(to)


#: States live on executors' disks, not in their heaps, and a trigger uploads what it changed.
STATE_STORE = {
    "spark__sql__streaming__stateStore__providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled": "true",
}


def run(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there, and return what it put out, with the trigger's number in _batch.

    Every trigger's rows go to a folder of their own that is overwritten if the trigger is done again, so a restart
    after a failure neither loses nor repeats rows. Output and checkpoints are kept in `folder`: a later run with the
    same folder goes on where the last one ended. Without one, a new folder is taken, and all is read anew.
    """
    spark = stream.sparkSession
    folder = folder or scratch(spark, "stream")
    to, state = f"{folder}/out", f"{folder}/state"

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{to}/batch={batch}")

    with settings_of(spark, **STATE_STORE):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(put).trigger(availableNow=True).start()
        query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(to)


def latest_update(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of an update-mode stream, the last of each key."""
    others = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("m")).select(*keys, "m.*")


def route(stream: DataFrame, topic: str, schema: str) -> DataFrame:
    """Messages under a topic with their payload's fields; others, and those that aren't JSON, go."""
    under = (F.col("topic") == topic) | F.col("topic").startswith(topic + "/")
    return stream.filter(under).withColumn("j", F.from_json("payload", schema)).filter("j IS NOT NULL").select(*stream.columns, "j.*")


#: The routes of messages that no other takes: of a known topic with another action, and of other topics.
UNKNOWN, ELSEWHERE = "unknown_action", "elsewhere"


def dispatch(stream: DataFrame, routes: dict[str, tuple[str, str | None]], folder: str | None = None) -> Callable[..., DataFrame]:
    """Send every message to the sink of its route, by topic and the payload's `action`, from one read of the stream.

    routes: the sink's name, and a topic with an action, or with None for all of the topic's messages that no action of
    it takes. Messages of a topic of the routes with another action go to UNKNOWN, others to ELSEWHERE, so none is lost.
    A trigger is one pass: each task writes its messages to the folders of their routes. Returns a reader of one sink:
    its name and, if the payload's fields are wanted, their schema (payloads that aren't JSON: null fields).
    """
    spark = stream.sparkSession
    folder = folder or scratch(spark, "dispatch")
    under = lambda topic: (F.col("topic") == topic) | F.col("topic").startswith(topic + "/")
    chosen = F
    for name, (topic, action) in sorted(routes.items(), key=lambda r: r[1][1] is None):
        hit = under(topic) if action is None else under(topic) & (F.get_json_object("payload", "$.action") == action)
        chosen = chosen.when(hit, name)
    for topic in {t for t, _ in routes.values()}:
        chosen = chosen.when(under(topic), UNKNOWN)
    routed = stream.withColumn("route", chosen.otherwise(ELSEWHERE))

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.partitionBy("route").mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    routed.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()

    def sink(name: str, schema: str | None = None) -> DataFrame:
        rows = spark.read.schema(StructType([*routed.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/out").filter(F.col("route") == name)
        rows = rows.select(*stream.columns)
        return rows.withColumn("j", F.from_json("payload", schema)).select(*stream.columns, "j.*") if schema else rows

    return sink


def conflate(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The newest message of each key so far (update mode)."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct("event_id", "payload"), F.struct("ts", "event_id")).alias("m")).select(*keys, "m.*")


def progress(stream: DataFrame, key: str) -> DataFrame:
    """Largest current and total of each path so far (update mode)."""
    return stream.groupBy(key).agg(F.max("current").alias("current"), F.max("total").alias("total"))


def per_window(stream: DataFrame, width: str, late: str) -> DataFrame:
    """Messages and hundredths of value in each tumbling window; rows later than the watermark are left out."""
    w = F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w, "topic").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("centivalue")).select(F.col("window.start").alias("start"), "topic", "n", "centivalue")


def answered_within(stream: DataFrame, command: Column, status: Column, key: str, timeout: str, unanswered: bool = False) -> DataFrame:
    """Commands with every status of their key within the timeout. Watermarks bound what either side keeps.

    With unanswered, a command without any comes out too, with nulls, once the watermark says that none can follow. The
    watermark is that of all messages, heartbeats too, not of commands and statuses alone.
    """
    marked = stream.withWatermark("ts", timeout)
    # a filter on the time as well isn't moved in front of the watermark, which so sees all messages
    timed = lambda which: F.when(F.col("ts").isNotNull(), which)
    c = marked.filter(timed(command)).select(F.col(key).alias("key"), F.col("ts").alias("command_ts"), F.col("event_id").alias("command_id"))
    s = marked.filter(timed(status)).select(F.col(key).alias("status_key"), F.col("ts").alias("status_ts"), F.col("event_id").alias("status_id"))
    near = F.expr(f"key = status_key AND status_ts > command_ts AND status_ts <= command_ts + INTERVAL {timeout}")
    return c.join(s, near, "leftOuter" if unanswered else "inner").select("command_id", "status_id", "key", "command_ts", "status_ts")


#: Statuses that may follow each status of a device; None is before its first message.
MACHINE = {None: ("Ready",), "Ready": ("Started",), "Started": ("Done", "Off"), "Done": ("Started", "Ready"), "Off": ("Ready", "Started", "On"), "On": ("Off", "Done")}


_STATUSES = pd.Index([k for k in MACHINE if k])
#: Which status (column) may follow which (row); the last row stands for no message yet, the last column for other texts.
_MAY_FOLLOW = np.zeros((len(_STATUSES) + 1, len(_STATUSES) + 1), bool)
for _before, _after in MACHINE.items():
    _MAY_FOLLOW[len(_STATUSES) if _before is None else _STATUSES.get_loc(_before), _STATUSES.get_indexer(_after)] = True


#: Devices are dealt into this many shares by hash. A share is a key of the state store: its devices' states are one value
#: of arrays, read, worked on and written at once, so a trigger's cost is its messages, not a round trip for each device.
SHARES = 512


def _by_share(rows: DataFrame) -> DataFrame:
    """Rows with their device's share (-1: rows without a device), grouped by it. Nulls become flags beside whole numbers,
    so that one device's null leaves other devices' numbers as they are."""
    share = F.when(F.col("device_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("device_id"), F.lit(SHARES))).cast("long").alias("share")
    event = [F.coalesce("event_id", F.lit(0)).alias("event_id"), F.col("event_id").isNull().alias("no_event")] if "event_id" in rows.columns else []
    others = [c for c in rows.columns if c not in ("device_id", "event_id")]
    return rows.select(share, F.coalesce("device_id", F.lit(0)).alias("device_id"), *event, *others).groupBy("share")


def _device_column(key: tuple, device: np.ndarray) -> pd.api.extensions.ExtensionArray:
    return pd.array([None] * len(device), "Int64") if key[0] == -1 else pd.array(device, "Int64")


def _in_order(batches: Iterator[pd.DataFrame], only: tuple[str, ...] | None = None) -> dict[str, np.ndarray]:
    """Columns of a share's rows of a trigger, by device, time (microseconds) and id; with `only`, of these statuses."""
    parts = [p if only is None else p[p["status"].isin(only)] for p in batches]
    columns = {c: np.concatenate([p[c].to_numpy() for p in parts]) for c in ("device_id", "ts", "event_id", "no_event", "status")}
    columns["ts"] = columns["ts"].astype("datetime64[us]").astype(np.int64)
    order = np.lexsort((columns["event_id"], columns["no_event"], columns["ts"], columns["device_id"]))
    return {c: v[order] for c, v in columns.items()}


def _firsts(device: np.ndarray) -> np.ndarray:
    """Where a device's rows begin, in rows sorted by device."""
    return np.concatenate([[True], device[1:] != device[:-1]])[: len(device)]


#: Fixed value: the status of a device that is heard of no more.
DEAD = "Dead"


class _Machine(StatefulProcessor):
    """A share's state are its devices, sorted, with the last status and that message's time; one timer, at or before the
    first time at which one of them is silent for too long, stands for all."""

    def __init__(self, silent: int | None):
        self.silent = silent  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "device binary, at binary, status binary, names string, timer long")

    def _known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | None]:
        """Devices, times, statuses and the timer of a share."""
        held = self.last.get()
        if held is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object), None
        device, at, code = (np.frombuffer(bytes(v), t) for v, t in zip(held, ("<i8", "<i8", "<i4")))
        return device, at, np.array([*json.loads(held[3]), None], object)[code], held[4]

    def _due(self, at: np.ndarray) -> np.ndarray:
        """When devices are silent for too long, in milliseconds."""
        return -(-(at + self.silent) // 1000)

    def _keep(self, device: np.ndarray, at: np.ndarray, status: np.ndarray, timer: int | None) -> None:
        """Write the states of a share (sorted by device), and set its timer if that isn't out in time; timer: the one
        that is set."""
        if self.silent is not None and len(device):
            first = int(self._due(at).min())
            if timer is None or first < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
                timer = first
        if len(device) or timer is not None:
            code, names = pd.factorize(status)  # null: -1, the last place
            self.last.update((device.astype("<i8").tobytes(), at.astype("<i8").tobytes(), code.astype("<i4").tobytes(), json.dumps(list(names)), timer))
        else:
            self.last.clear()

    def _rows(self, key: tuple, device: np.ndarray, event: pd.api.extensions.ExtensionArray, at: np.ndarray, before: np.ndarray, status: np.ndarray, allowed: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"device_id": _device_column(key, device), "event_id": event, "ts": at.astype("datetime64[us]"), "before": before, "status": status, "allowed": allowed})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        device, at, status, timer = self._known()
        device = np.concatenate([device, initialState["device_id"].to_numpy(np.int64)])
        at = np.concatenate([at, initialState["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)])
        status = np.concatenate([status, initialState["status"].to_numpy(object)])
        order = np.argsort(device, kind="stable")
        self._keep(device[order], at[order], status[order], timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known, known_at, known_status, timer = self._known()
        new = _in_order(rows)
        device, at, status = new["device_id"], new["ts"], new["status"].astype(object)
        if not len(device):
            return
        head = np.flatnonzero(_firsts(device))
        spot = np.searchsorted(known, device[head])
        met = np.zeros(len(head), bool)
        met[spot < len(known)] = known[spot[spot < len(known)]] == device[head][spot < len(known)]
        had, spot = head[met], spot[met]
        before = np.concatenate([[None], status[:-1]])
        before[head] = None
        before[had] = known_status[spot]
        code = _STATUSES.get_indexer(status)
        code_before = np.concatenate([[-1], code[:-1]])
        code_before[head] = -1
        code_before[had] = _STATUSES.get_indexer(known_status[spot])
        first = np.zeros(len(at), bool)
        first[head] = ~met
        since = np.concatenate([at[:1], at[:-1]])  # times ascend within a device
        since[head] = at[head]
        since[had] = known_at[spot]
        # a device's message may be older than what is known of it
        floor = np.full(len(head), np.iinfo(np.int64).min)
        floor[met] = known_at[spot]
        size = np.diff(np.append(head, len(at)))
        since = np.maximum(since, np.repeat(floor, size))
        dead = np.zeros(0, np.int64)
        if self.silent is not None:  # a device was silent for too long before these messages
            dead = np.flatnonzero(at - since > self.silent)
            gone, when = before[dead], since[dead] + self.silent
            before[dead], code_before[dead], first[dead] = None, -1, True
        allowed = _MAY_FOLLOW[code_before, code] & (code >= 0) & ((code_before >= 0) | first)
        tail = np.append(head[1:], len(at)) - 1
        left = np.ones(len(known), bool)
        left[spot] = False
        now = [np.concatenate(v) for v in ((known[left], device[tail]), (known_at[left], np.maximum(at[tail], floor)), (known_status[left], status[tail]))]
        order = np.argsort(now[0], kind="stable")
        self._keep(*(v[order] for v in now), timer)
        no_event = new["no_event"].astype(bool)
        if len(dead):
            device, at, before, status = (np.concatenate(v) for v in ((device, device[dead]), (at, when), (before, gone), (status, np.full(len(dead), DEAD, object))))
            no_event, allowed = (np.concatenate([v, np.ones(len(dead), bool)]) for v in (no_event, allowed))
        event = pd.array(np.concatenate([new["event_id"], np.zeros(len(dead), np.int64)]), "Int64")
        event[no_event] = None
        yield self._rows(key, device, event, at, before, status, allowed)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, at, status, timer = self._known()
        out = expiredTimerInfo.getExpiryTimeInMs()
        if timer != out:
            return
        dead = self._due(at) <= max(out, timerValues.getCurrentWatermarkInMs())
        self._keep(known[~dead], at[~dead], status[~dead], None)
        n = int(dead.sum())
        if n:
            yield self._rows(key, known[dead], pd.array([None] * n, "Int64"), at[dead] + self.silent, status[dead], np.full(n, DEAD, object), np.ones(n, bool))

    def close(self) -> None:
        pass


def _micros(spark: SparkSession, interval: str) -> int:
    """An interval of days and less in microseconds."""
    epoch = F.timestamp_seconds(F.lit(0))
    return spark.range(1).select(F.unix_micros(epoch + F.expr(f"INTERVAL {interval}"))).first()[0]


def state_machine(stream: DataFrame, silent: str | None = None, late: str = "0 SECONDS", known: DataFrame | None = None) -> DataFrame:
    """Every message with its device's status before it, and whether that status allows it: device_id, event_id, ts,
    before, status, allowed.

    With silent, an interval, a device that is heard of no more for longer becomes `Dead`, at its last message's time and
    that interval (a row without an event_id), by a timer or, if it speaks again first, by its next message; its state
    goes, and it starts as a new one. States so don't grow with devices that are gone. Messages more than `late` behind
    the newest are left out then. Rows without a device (heartbeats) only move time on.
    known: the devices' states to begin with (device_id, status, ts; one row each).
    """
    if silent is not None:
        # a filter on the time as well isn't moved in front of the watermark, which so sees heartbeats
        stream = stream.withWatermark("ts", late).filter(F.when(F.col("ts").isNotNull(), F.col("device_id").isNotNull()))
    width = None if silent is None else _micros(stream.sparkSession, silent)
    rows = stream.select("device_id", "event_id", "ts", "status")
    begin = None if known is None else _by_share(known.select("device_id", "status", F.col("ts").cast("timestamp").alias("ts")))
    schema = "device_id long, event_id long, ts timestamp, before string, status string, allowed boolean"
    return _by_share(rows).transformWithStateInPandas(_Machine(width), schema, "append", "None" if silent is None else "EventTime", begin)


class _Sessions(StatefulProcessor):
    """A share's state are its devices with an On that is open, and these times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getValueState("opened", "device binary, at binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = _in_order(rows, ("On", "Off"))
        if not len(new["ts"]):
            return
        held = self.opened.get()
        known, known_at = (np.frombuffer(bytes(v), "<i8") for v in held) if held else (np.zeros(0, np.int64),) * 2
        device = np.concatenate([known, new["device_id"]])
        order = np.argsort(device, kind="stable")  # what is known of a device stands before its messages
        device, at = device[order], np.concatenate([known_at, new["ts"]])[order]
        on = np.concatenate([np.ones(len(known), bool), new["status"] == "On"])[order]
        before = np.concatenate([[False], on[:-1]])
        before[_firsts(device)] = False
        # of a device, every other one of these is an On, the first one too
        turned = np.flatnonzero(on != before)
        stops = np.flatnonzero(~on[turned])
        start, stop = turned[stops - 1], turned[stops]
        still = np.ones(len(turned), bool)
        still[stops] = still[stops - 1] = False
        still = turned[still]
        if len(still):
            self.opened.update((device[still].astype("<i8").tobytes(), at[still].astype("<i8").tobytes()))
        elif held:
            self.opened.clear()
        if len(stop):
            yield pd.DataFrame({"device_id": _device_column(key, device[stop]), "start": at[start].astype("datetime64[us]"), "stop": at[stop].astype("datetime64[us]"), "seconds": at[stop] // 1_000_000 - at[start] // 1_000_000})

    def close(self) -> None:
        pass


def operating_time(stream: DataFrame) -> DataFrame:
    """Sessions from the first On to the next Off of each device, as they close: start, stop, seconds.

    Of a trigger's messages those count that change from Off to On or back.
    """
    rows = stream.select("device_id", "event_id", "ts", "status")
    return _by_share(rows).transformWithStateInPandas(_Sessions(), "device_id long, start timestamp, stop timestamp, seconds long", "append", "None")


def _nothing(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, made without a Python worker."""
    return spark.range(0).select([F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def _commit(keys: DataFrame, to: str) -> None:
    keys.write.mode("overwrite").parquet(to)


class DatasetJob:
    """A batch job on datasets as they arrive, each once, kept in a folder: what has come, results, dead letters, ledger.

    With `expected`, a column that tells how many different rows a dataset has, a dataset whose rows come in several
    triggers waits for its last ones; without it, what a trigger brings of a dataset is taken for all of it. Arriving
    rows are appended by `part` of their dataset, with a small table of counts, so a trigger reads the rows of datasets
    that may be whole now, and nothing of those that still wait.

    A dataset that fails doesn't stop the others. `broken` may name datasets that can't be worked on, with an error, from
    their rows. If the job itself fails, its datasets are halved by hash until the failing one is alone: some two
    attempts for each halving. Such datasets go to the dead letters with the error; `retry` takes them up again, alone.

    Results count once the ledger names them, and the ledger is written last. A trigger that was cut off is done again
    under its own number: it overwrites its tables, and what it left without a ledger entry isn't read.
    """

    def __init__(self, spark: SparkSession, process: Callable[[DataFrame], DataFrame], schema: StructType, key: str = "dataset_id", expected: str | None = None, folder: str | None = None, broken: Callable[[DataFrame], DataFrame] | None = None, parts: int = 64):
        self.spark, self.process, self.schema, self.key, self.expected, self.broken, self.parts = spark, process, schema, key, expected, broken, parts
        folder = folder or scratch(spark, "datasets")
        self.folder, self.arrived, self.counts, self.results, self.letters, self.ledger = folder, *(f"{folder}/{n}" for n in ("arrived", "counts", "results", "letters", "ledger"))
        self.kind = schema[key].dataType.simpleString()
        for to, more in ((self.ledger, "piece string"), (self.letters, "error string")):  # so that there is something to read
            _nothing(spark, f"{key} {self.kind}, {more}").write.mode("ignore").parquet(f"{to}/batch=-1")

    def done(self, before: int | None = None) -> DataFrame:
        """Finished datasets: key, piece and batch."""
        rows = self.spark.read.schema(f"{self.key} {self.kind}, piece string, batch long").parquet(self.ledger)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def dead_letters(self) -> DataFrame:
        """Datasets that failed and haven't been finished since: key and the last error."""
        rows = self.spark.read.schema(f"{self.key} {self.kind}, error string, batch long").parquet(self.letters)
        last = rows.groupBy(self.key).agg(F.max_by("error", F.abs("batch")).alias("error"))
        return last.join(self.done().select(self.key), self.key, "left_anti")

    def output(self) -> DataFrame:
        """The results of all finished datasets."""
        told = self.done().filter("piece IS NOT NULL").select("batch", "piece").distinct()
        if told.isEmpty():  # nothing was worked on: what the job makes of no rows
            return self.process(self.spark.createDataFrame([], self.schema))
        rows = self.spark.read.parquet(self.results)
        columns = [c for c in rows.columns if c not in ("batch", "piece")]
        return rows.withColumn("batch", F.col("batch").cast("long")).join(told, ["batch", "piece"], "left_semi").select(columns)

    def _settled(self, rows: DataFrame, batch: int, piece: str, depth: int = 0) -> list[tuple[str, DataFrame, str | None]]:
        """Work on datasets, halving those that fail: for each piece its name, its keys, and the error if it failed."""
        if rows.isEmpty():
            return []
        try:
            self.process(rows).write.mode("overwrite").parquet(f"{self.results}/batch={batch}/piece={piece}")
            return [(piece, rows.select(self.key).distinct(), None)]
        except PySparkException as failed:
            some = rows.select(self.key).distinct().limit(2).collect()
            if len(some) < 2:
                lines = [x for x in str(failed).strip().splitlines() if x.strip()]
                said = next((x for x in reversed(lines) if re.match(r"\w*(Error|Exception)\b", x)), lines[0] if lines else type(failed).__name__)
                return [(piece, rows.select(self.key).distinct(), said[:500])]
            half = F.shiftrightunsigned(F.xxhash64(self.key), depth).bitwiseAND(1)
            return [x for bit in (0, 1) for x in self._settled(rows.filter(half == bit), batch, f"{piece}{bit}", depth + 1)]

    def finish(self, rows: DataFrame, batch: int) -> None:
        """Work on whole datasets (rows of a stored table), and write results, dead letters and, last, the ledger."""
        bad = stored(self.broken(rows).select(self.key, "error"), "broken") if self.broken else None
        good = rows.join(bad.select(self.key), self.key, "left_anti").select(rows.columns) if bad is not None else rows
        settled = self._settled(good, batch, "r")
        lost = [k.select(self.key, F.lit(error).alias("error")) for _, k, error in settled if error is not None]
        for more in lost:
            bad = more if bad is None else bad.unionByName(more)
        if bad is not None:
            bad.write.mode("overwrite").parquet(f"{self.letters}/batch={batch}")
        kept = _nothing(self.spark, f"{self.key} {self.kind}, piece string")
        for piece, keys, error in settled:
            if error is None:
                kept = kept.unionByName(keys.withColumn("piece", F.lit(piece)))
        _commit(kept, f"{self.ledger}/batch={batch}")

    def take(self, rows: DataFrame, batch: int) -> None:
        """One trigger's rows."""
        known = self.done(batch).select(self.key).unionByName(self.spark.read.schema(f"{self.key} {self.kind}, batch long").parquet(self.letters).filter(F.col("batch") < batch).select(self.key))
        rows = rows.join(known.distinct(), self.key, "left_anti").select(self.schema.names).distinct()
        place = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        rows.withColumn("_part", place).write.partitionBy("_part").mode("overwrite").parquet(f"{self.arrived}/batch={batch}")
        new = self._came(batch, batch)
        if self.expected:
            new.groupBy(self.key).agg(F.count("*").alias("n"), F.max(self.expected).alias("of")).write.mode("overwrite").parquet(f"{self.counts}/batch={batch}")
            counts = self.spark.read.schema(f"{self.key} {self.kind}, n long, of long, batch long").parquet(self.counts).filter(F.col("batch") <= batch)
            ripe = counts.groupBy(self.key).agg(F.sum("n").alias("n"), F.max("of").alias("of"), F.max("batch").alias("last")).filter(f"n >= of AND last = {batch}").select(self.key)
            ripe = stored(ripe, "ripe")
            if ripe.isEmpty():  # all datasets wait for more rows
                return _commit(_nothing(self.spark, f"{self.key} {self.kind}, piece string"), f"{self.ledger}/batch={batch}")
            folders = [r["_part"] for r in ripe.select(place.alias("_part")).distinct().collect()]  # at most as many as parts
            # written once, for what follows reads them several times
            all_of = stored(self._came(0, batch, folders).join(ripe, self.key, "left_semi").distinct(), "whole")
            counted = all_of.groupBy(self.key).agg(F.count("*").alias("n"), F.max(self.expected).alias("of"))
            short = stored(counted.filter("NOT coalesce(n >= of, false)").select(self.key), "short")
            if not short.isEmpty():
                all_of = all_of.join(short, self.key, "left_anti")
            new = all_of.select(self.schema.names)
        self.finish(new, batch)

    def _came(self, first: int, last: int, folders: list[int] | None = None) -> DataFrame:
        whole = StructType([*self.schema.fields, StructField("batch", LongType()), StructField("_part", IntegerType())])
        rows = self.spark.read.schema(whole).parquet(self.arrived).filter(F.col("batch").between(first, last))
        return (rows if folders is None else rows.filter(F.col("_part").isin(folders))).select(self.schema.names)

    def run(self, arriving: DataFrame) -> DataFrame:
        """Take all that is there, and return the results of all finished datasets."""
        arriving.writeStream.option("checkpointLocation", f"{self.folder}/state").foreachBatch(self.take).trigger(availableNow=True).start().awaitTermination()
        return self.output()

    def retry(self) -> DataFrame:
        """Work on the datasets of the dead letters again, and on no others; returns all results."""
        again = stored(self.dead_letters().select(self.key), "again")
        if not again.isEmpty():
            number = self.done().agg(F.min("batch")).first()[0] - 1  # below all triggers' numbers
            folders = [r["p"] for r in again.select(F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int").alias("p")).distinct().collect()]
            self.finish(stored(self._came(0, 1 << 62, folders).join(again, self.key, "left_semi").distinct(), "whole"), number)
        return self.output()


def each_dataset_once(arriving: DataFrame, process: Callable[[DataFrame], DataFrame], key: str = "dataset_id", expected: str | None = None, folder: str | None = None) -> DataFrame:
    """Apply a batch job to datasets as they arrive, each once (see DatasetJob). With the same `folder`, a later run goes
    on where the last one ended."""
    return DatasetJob(arriving.sparkSession, process, arriving.schema, key, expected, folder).run(arriving)


def broken_scanlines(lines: DataFrame) -> DataFrame:
    """Datasets that can't be segmented, with the first reason: dataset_id, error. A pass over sizes, not over pixels."""
    c = F.col
    size = F.coalesce(*[F.when(c(k).isNull() | (F.size(k) != c("w")), F.lit("a line doesn't have the image's width")) for k in "bgr"])
    place = F.when(c("seq").isNull() | c("image_id").isNull() | ~c("y").between(0, c("h") - 1), F.lit("a line is outside its image"))
    marked = lines.select("dataset_id", "image_id", "seq", "y", "h", "w", F.coalesce(size, place).alias("error"))
    images = marked.groupBy("dataset_id", "image_id").agg(F.min("error").alias("error"), F.count("*").alias("n"), F.countDistinct("y").alias("lines"), F.max("h").alias("h"), F.min("seq").alias("seq"))
    short = F.when((c("lines") != c("h")) | (c("n") != c("h")), F.lit("an image doesn't have each of its lines once"))
    of = images.groupBy("dataset_id").agg(F.min(F.coalesce("error", short)).alias("error"), F.count("*").alias("n"), F.countDistinct("seq").alias("places"), F.max("seq").alias("last"))
    gap = F.when((c("places") != c("n")) | (c("last") != c("n") - 1), F.lit("images aren't numbered from 0 on"))
    return of.select("dataset_id", F.coalesce("error", gap).alias("error")).filter("error IS NOT NULL")
