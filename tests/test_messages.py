"""Message operators on hand-made logs, and streams over several triggers."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import catalog as K
from pixelframe.operators import messages as M
from pixelframe.streaming import jobs as J

T0 = datetime(2024, 1, 1)


def log(spark, rows):
    """rows: (device, seconds, status)."""
    full = [(k, T0 + timedelta(seconds=s), d, st, "t", float(k), "{}") for k, (d, s, st) in enumerate(rows)]
    return spark.createDataFrame(full, "event_id long, ts timestamp_ntz, device_id long, status string, topic string, value double, payload string")


def test_first_later_status(spark):
    rows = [(1, 0, "Started"), (1, 5, "Done"), (1, 5, "Started"), (1, 7, "Started"), (1, 9, "Done"), (1, 9, "Done"), (1, 11, "Started"), (2, 1, "Done")]
    df = log(spark, rows)
    got = {r.event_id: r.status_id for r in M.command_status_match(df, ["device_id"], F.col("status") == "Started", F.col("status") == "Done").collect()}
    assert got == {0: 1, 2: 4, 3: 4, 6: None}
    near = {r.event_id: r.status_id for r in M.command_status_match(df, ["device_id"], F.col("status") == "Started", F.col("status") == "Done", "3 SECONDS").collect()}
    assert near == {0: None, 2: None, 3: 4, 6: None}


def test_sessions_and_total(spark):
    df = log(spark, [(1, 0, "Off"), (1, 1, "On"), (1, 2, "On"), (1, 5, "Off"), (1, 6, "Off"), (1, 8, "On"), (2, 0, "On"), (2, 3, "Off")])
    assert sorted((r.device_id, r.seconds) for r in M.on_off_sessions(df).collect()) == [(1, 4), (2, 3)]
    acts = df.withColumns({"action": F.when(F.col("event_id") == 2, "reset").otherwise("increment"), "seconds": F.lit(10).cast("long")})
    assert {r.device_id: r.total for r in M.operating_time_total(acts).collect()} == {1: 30, 2: 20}


def test_retained_messages_are_cleared(spark):
    df = log(spark, [(1, 0, "On"), (1, 1, "Off"), (2, 0, "On")]).withColumn("payload", F.when(F.col("event_id") == 1, "").otherwise("x"))
    assert [r.device_id for r in M.latest_per_topic(df, ["device_id"]).collect()] == [2]


def test_integrity_statuses(spark):
    ledger = spark.createDataFrame([("d", "a", 1, "x"), ("d", "b", 1, "x"), ("d", "c", 1, "x"), ("d", "e", 2, "x")], "dir string, filename string, size long, sha1 string")
    files = spark.createDataFrame([("d", "a", 1, "x"), ("d", "b", 1, "y"), ("d", "e", 1, "x")], "dir string, filename string, size long, sha1 string")
    assert {r.filename: r.status for r in K.verify_integrity(ledger, files).collect()} == {"a": "valid", "b": "invalid", "c": "missing", "e": "invalid"}


def test_pages(spark):
    df = spark.createDataFrame([("g", k) for k in range(7)] + [("h", 0)], "g string, k int")
    got = {(r.g, r.k): (r.page, r.pages, r.next_start) for r in K.all_pages(df, ["g"], [F.col("k")], 3).collect()}
    assert got["g", 0] == (0, 3, 3) and got["g", 6] == (2, 3, None) and got["h", 0] == (0, 1, None)
    places = [r.place for r in K.shuffled(df.filter("g = 'g'"), ["g"], F.col("k"), 5).collect()]
    assert sorted(places) == list(range(7))


def test_state_carries_over_triggers(spark):
    df = log(spark, [(1, 0, "Ready"), (1, 100, "Started"), (1, 200, "Done"), (1, 300, "Started"), (1, 400, "Ready"), (2, 50, "Started"), (2, 250, "On")])
    got = {r.event_id: (r.before, r.allowed) for r in J.run(J.state_machine(J.message_stream(df))).collect()}
    assert got == {0: (None, True), 1: ("Ready", True), 2: ("Started", True), 3: ("Done", True), 4: ("Started", False), 5: (None, False), 6: ("Started", False)}


def test_state_machine_equals_a_plain_walk(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.randrange(5), rng.randrange(400), rng.choice([*[k for k in J.MACHINE if k], "Odd"])) for _ in range(600)]
    df = log(spark, rows)
    want, sessions, last, opened = {}, [], {}, {}
    for k, (d, s, status) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        want[k] = (last.get(d), status in J.MACHINE.get(last.get(d), ()))
        last[d] = status
        if status == "On" and d not in opened:
            opened[d] = s
        elif status == "Off" and d in opened:
            sessions.append((d, T0 + timedelta(seconds=opened[d]), s - opened.pop(d)))
    got = {r.event_id: (r.before, r.allowed) for r in J.run(J.state_machine(J.message_stream(df, parts=3))).collect()}
    assert got == want
    out = J.run(J.operating_time(J.message_stream(df, parts=3))).collect()
    assert sorted((r.device_id, r.seconds) for r in out) == sorted((d, n) for d, _, n in sessions)


def test_silent_devices_die_and_start_anew(spark):
    """Against a plain walk: by timers, by their next message, in one trigger or over several; states of the dead go."""
    import random

    rng = random.Random(5)
    rows = [(d, s, rng.choice([*[k for k in J.MACHINE if k], "Odd"])) for d in range(12) for s in sorted(rng.sample(range(1000), rng.randrange(1, 9)))]
    df, silent = log(spark, rows), 120
    want, last = set(), {}
    for k, (d, s, status) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        before, at = last.get(d, (None, s))
        if s - at > silent:
            want.add((d, None, at + silent, before, J.DEAD, True))
            before = None
        want.add((d, k, s, before, status, status in J.MACHINE.get(before, ())))
        last[d] = status, s
    want |= {(d, None, at + silent, before, J.DEAD, True) for d, (before, at) in last.items()}
    for parts in (1, 4):
        stream = J.message_stream(df, parts=parts, beats="10 MINUTES")
        got = J.run(J.state_machine(stream, silent="120 SECONDS")).collect()
        assert {(r.device_id, r.event_id, int((r.ts - T0).total_seconds()), r.before, r.status, r.allowed) for r in got} == want and len(got) == len(want)


def states(spark, folder):
    return spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "last").load()


def test_states_of_the_dead_go_and_a_restart_goes_on(spark, tmp_path):
    to, folder = str(tmp_path / "in"), str(tmp_path / "run")
    rows = [(1, 0, "Ready"), (2, 5, "Ready"), (2, 300, "Started"), (3, 310, "Ready"), (2, 320, "Done"), (None, 600, None), (2, 700, "Ready")]
    df = log(spark, rows).withColumn("ts", F.col("ts").cast("timestamp"))
    put = lambda ids: df.filter(F.col("event_id").isin(ids)).coalesce(1).write.mode("append").parquet(to)
    known = spark.createDataFrame([(7, "Started", T0), (2, "On", T0)], "device_id long, status string, ts timestamp")
    start = lambda: J.run(J.state_machine(spark.readStream.schema(df.schema).parquet(to), silent="60 SECONDS", known=known), folder=folder)
    put([0, 1])
    told = lambda out: {(r.device_id, r.event_id, int((r.ts - T0).total_seconds()), r.before, r.status, r.allowed) for r in out.collect()}
    begun = {(1, 0, 0, None, "Ready", True), (2, 1, 5, "On", "Ready", False)}
    assert told(start()) == begun and states(spark, folder).count() == 3
    put([2, 3, 4])
    more = {(1, None, 60, "Ready", "Dead", True), (7, None, 60, "Started", "Dead", True), (2, None, 65, "Ready", "Dead", True), (2, 2, 300, None, "Started", False), (3, 3, 310, None, "Ready", True), (2, 4, 320, "Started", "Done", True)}
    assert told(start()) == begun | more and states(spark, folder).count() == 2
    put([5])  # nothing but a heartbeat
    more |= {(3, None, 370, "Ready", "Dead", True), (2, None, 380, "Done", "Dead", True)}
    assert told(start()) == begun | more and states(spark, folder).count() == 0
    put([6])
    assert told(start()) == begun | more | {(2, 6, 700, None, "Ready", True)} and states(spark, folder).count() == 1


def test_unanswered_commands_come_out(spark):
    df = log(spark, [(1, 0, "Started"), (1, 5, "Done"), (2, 10, "Started"), (2, 500, "Done"), (1, 5000, "Started"), (1, 5001, "Done"), (1, 9000, "Started"), (1, 9001, "Done"), (1, 9002, "Done")])
    stream = J.message_stream(df)
    out = J.run(J.answered_within(stream, F.col("status") == "Started", F.col("status") == "Done", "device_id", "60 SECONDS", unanswered=True))
    got = {(r.command_id, r.status_id) for r in out.collect()}
    assert {(0, 1), (2, None), (4, 5), (6, 7), (6, 8)} == got


def test_a_run_goes_on_in_its_folder(spark, tmp_path):
    to, folder = str(tmp_path / "in"), str(tmp_path / "run")
    df = log(spark, [(1, 0, "Ready"), (1, 100, "Started")]).withColumn("ts", F.col("ts").cast("timestamp"))
    df.filter("event_id = 0").write.parquet(to)
    stream = lambda: spark.readStream.schema(df.schema).parquet(to)
    assert [r.event_id for r in J.run(J.state_machine(stream()), folder=folder).collect()] == [0]
    df.filter("event_id = 1").write.mode("append").parquet(to)
    got = {r.event_id: (r.before, r.allowed) for r in J.run(J.state_machine(stream()), folder=folder).collect()}
    assert got == {0: (None, True), 1: ("Ready", True)}


def test_datasets_wait_for_their_last_rows(spark, tmp_path):
    to = str(tmp_path / "in")
    rows = [(0, 1, 3), (0, 2, 3), (1, 1, 1), (0, 3, 3), (2, 1, 2), (1, 1, 1), (2, 2, 2), (3, 1, 9)]
    for k in range(0, 8, 2):
        spark.createDataFrame(rows[k : k + 2], "dataset_id long, v long, of long").coalesce(1).write.mode("append").parquet(to)
    stream = spark.readStream.schema("dataset_id long, v long, of long").option("maxFilesPerTrigger", 1).parquet(to)
    out = J.each_dataset_once(stream, lambda r: r.groupBy("dataset_id").agg(F.count("*").alias("n")), expected="of")
    assert sorted(map(tuple, out.collect())) == [(0, 3), (1, 1), (2, 2)]


def test_names_of_a_report_are_limited(spark):
    v = spark.createDataFrame([("d", f"f{k}", "valid" if k % 2 else "missing") for k in range(9)], "dir string, filename string, status string")
    got = {r.status: (r.n, r.names) for r in K.by_status(v, 2).collect()}
    assert got == {"valid": (4, ["f1", "f3"]), "missing": (5, ["f0", "f2"])}


def test_late_rows_are_left_out(spark):
    df = log(spark, [(1, 0, "On"), (1, 30, "On"), (1, 90_000, "On"), (1, 180_000, "On")])
    out = J.run(J.per_window(J.message_stream(df, parts=4), "1 day", "10 minutes"), "append")
    # the last window stays open
    assert sorted((str(r.start), r.n) for r in out.collect()) == [("2024-01-01 00:00:00", 2), ("2024-01-02 00:00:00", 1)]


def test_datasets_are_done_once(spark, tmp_path):
    to = str(tmp_path / "in")
    df = spark.createDataFrame([(k % 3, k) for k in range(9)], "dataset_id long, v long")
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(to)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(to)
    out = J.each_dataset_once(stream, lambda rows: rows.groupBy("dataset_id").agg(F.count("*").alias("n")))
    assert sorted(map(tuple, out.collect())) == [(0, 3), (1, 3), (2, 3)]


def test_the_last_unanswered_commands_come_out_by_heartbeats(spark):
    df = log(spark, [(1, 0, "Started"), (1, 5, "Done"), (2, 10, "Started"), (3, 12, "Started")])
    stream = J.message_stream(df, parts=2, beats="1 HOUR")
    out = J.run(J.answered_within(stream, F.col("status") == "Started", F.col("status") == "Done", "device_id", "60 SECONDS", unanswered=True))
    assert {(r.command_id, r.status_id) for r in out.collect()} == {(0, 1), (2, None), (3, None)}


def test_every_message_goes_to_one_sink(spark):
    rows = [(k, t, p) for k, (t, p) in enumerate([("a/b", '{"action": "move", "v": 1}'), ("a/b", '{"action": "stop"}'), ("a/b/c", '{"action": "move", "v": 2}'), ("a/b", '{"action": "other"}'), ("a/b", "{"), ("x", None), ("y", '{"action": "move"}'), (None, None), ("a/bc", "{}")])]
    df = spark.createDataFrame(rows, "event_id long, topic string, payload string").withColumn("ts", F.timestamp_seconds("event_id"))
    sink = J.dispatch(J.message_stream(df, parts=3), {"move": ("a/b", "move"), "stop": ("a/b", "stop"), "x": ("x", None)})
    got = {name: sorted(r.event_id for r in sink(name).collect()) for name in ("move", "stop", "x", J.UNKNOWN, J.ELSEWHERE)}
    assert got == {"move": [0, 2], "stop": [1], "x": [5], J.UNKNOWN: [3, 4], J.ELSEWHERE: [6, 7, 8]}
    assert sorted((r.event_id, r.v) for r in sink("move", "action string, v int").collect()) == [(0, 1), (2, 2)]


def arriving(spark, to, rows, schema="dataset_id long, v int, of long"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(to)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(to)


def sums(rows):
    """Fails in a task on a negative value."""
    return rows.groupBy("dataset_id").agg(F.sum(F.when(F.col("v") < 0, F.raise_error(F.lit("negative"))).otherwise(F.col("v"))).alias("v"))


def test_a_broken_dataset_doesn_t_stop_the_others(spark, tmp_path):
    rows = [(d, -1 if d == 13 else d, 1) for d in range(40)]
    stream = arriving(spark, str(tmp_path / "in"), rows)
    asked = []

    def process(some):
        asked.append(sorted(r.dataset_id for r in some.select("dataset_id").distinct().collect()))
        return sums(some)

    named = lambda some: some.filter("v = 7").select("dataset_id", F.lit("seven").alias("error"))
    job = J.DatasetJob(spark, process, stream.schema, folder=str(tmp_path / "job"), broken=named)
    assert sorted(r.dataset_id for r in job.run(stream).collect()) == [d for d in range(40) if d not in (7, 13)]
    letters = {r.dataset_id: r.error for r in job.dead_letters().collect()}
    assert set(letters) == {7, 13} and letters[7] == "seven" and "negative" in letters[13]
    assert len(asked) < 25  # halved, not one by one
    asked.clear()
    mended = J.DatasetJob(spark, lambda some: process(some.withColumn("v", F.abs("v"))), stream.schema, folder=str(tmp_path / "job"))
    assert sorted(r.dataset_id for r in mended.retry().collect()) == list(range(40))
    assert asked == [[7, 13]] and mended.dead_letters().collect() == []
    assert mended.retry().count() == 40 and asked == [[7, 13]]


def test_a_kill_between_results_and_ledger(spark, tmp_path, monkeypatch):
    to, folder = str(tmp_path / "in"), str(tmp_path / "job")
    arriving(spark, to, [(1, 1, 2), (2, 5, 1)])
    arriving(spark, to, [(1, 2, 2), (3, 4, 2)])
    stream = arriving(spark, to, [(3, 6, 2), (1, 1, 2), (2, 5, 1)])
    job = lambda: J.DatasetJob(spark, sums, stream.schema, expected="of", folder=folder)
    commit, calls = J._commit, []

    def killed(keys, path):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("killed")
        commit(keys, path)

    monkeypatch.setattr(J, "_commit", killed)
    with pytest.raises(Exception, match="killed"):
        job().run(stream)
    assert {(r.dataset_id, r.v) for r in job().output().collect()} == {(2, 5)}  # what has no entry isn't read
    assert sorted((r.dataset_id, r.v) for r in job().run(stream).collect()) == [(1, 3), (2, 5), (3, 10)]


def test_triggers_without_whole_datasets_cost_no_work(spark, tmp_path):
    """The job runs where a trigger completes a dataset, not where all of them wait; without any there are its columns."""
    asked = []

    def process(rows):
        asked.append(sorted(r.dataset_id for r in rows.select("dataset_id").distinct().collect()))
        return sums(rows)

    for some in ([(1, 1, 3), (2, 5, 3)], [(1, 2, 3), (2, 6, 3)], [(1, 3, 3), (2, 7, 3), (3, 1, 2)]):
        stream = arriving(spark, str(tmp_path / "in"), some)
    job = J.DatasetJob(spark, process, stream.schema, expected="of", folder=str(tmp_path / "job"))
    assert sorted(map(tuple, job.run(stream).collect())) == [(1, 6), (2, 18)] and asked == [[1, 2]]
    waits = arriving(spark, str(tmp_path / "few"), [(1, 1, 3)])
    none = J.DatasetJob(spark, process, waits.schema, expected="of", folder=str(tmp_path / "none")).run(waits)
    assert none.columns == ["dataset_id", "v"] and none.count() == 0


@pytest.mark.parametrize("most", [1, 700, 1 << 22])
def test_shapes_of_images_side_by_side(spark, monkeypatch, most):
    """Shapes of many images' regions are those of each image alone, however many frames are laid out at once."""
    from pixelframe.operators import regions as R

    rng, rows = np.random.default_rng(4), []
    for i in range(12):
        m = rng.random((rng.integers(1, 14), rng.integers(1, 20))) < 0.45
        for y, line in enumerate(np.pad(m, ((0, 0), (1, 1))).astype(int)):
            x0, x1 = np.flatnonzero(np.diff(line) == 1), np.flatnonzero(np.diff(line) == -1) - 1
            rows += [(7 * i, y + 3 * i, int(a) + i, int(b) + i) for a, b in zip(x0, x1)]
    runs = R.label_regions(spark.createDataFrame(rows, "image_id long, y int, x0 int, x1 int")).toPandas().sort_values(["image_id", "y", "x0"])
    image, *rest = (runs[c].to_numpy().astype(np.int64) for c in ("image_id", "label", "y", "x0", "x1"))
    monkeypatch.setattr(R, "MOST_PIXELS", most)
    cuts = list(R._frames_of(image, *rest[1:]))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(image) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert len(cuts) == {1: len(set(image.tolist())), 1 << 22: 1}.get(most, len(cuts))
    got = [tuple(r.values()) for low, high in cuts for r in R._shapes(image[low:high], *(c[low:high] for c in rest)).to_pylist()]
    alone = [tuple(r.values()) for i in np.unique(image) for r in R._shapes(*(c[image == i] for c in (image, *rest))).to_pylist()]
    assert got == alone and len(got) == runs[["image_id", "label"]].drop_duplicates().shape[0]


def test_segmentation_of_arriving_datasets(spark, tmp_path):
    """Datasets over three triggers give the rows of the batch run; one with a short line goes to the dead letters."""
    from pixelframe.plans.segmentation import segment

    rng = np.random.default_rng(6)
    schema = "dataset_id long, image_id long, seq long, y int, w int, h int, b array<int>, g array<int>, r array<int>, of long"
    rows = []
    for d in range(5):
        images = rng.integers(200, 215, (4, 40, 30, 3))
        for k in range(4):
            y, x = rng.integers(4, 24), rng.integers(4, 18)
            images[k, y : y + 9, x : x + 9] //= 3
        rows += [(d, 10 * d + k, k, y, 30, 40, *(images[k, y, :, c].tolist() for c in range(3)), 160) for k in range(4) for y in range(40)]
    bad = rows[2 * 160]
    rows[2 * 160] = (*bad[:6], bad[6][:-1], *bad[7:])
    rng.shuffle(order := list(range(len(rows))))
    for part in np.array_split(order, 3):
        stream = arriving(spark, str(tmp_path / "in"), [rows[i] for i in part], schema)
    job = J.DatasetJob(spark, lambda some: segment(some.drop("of"), 2), stream.schema, expected="of", folder=str(tmp_path / "job"), broken=J.broken_scanlines)
    got = sorted(tuple(r) for r in job.run(stream).select("dataset_id", "image_id", "label", "area", "perim", "MeanHue").collect())
    whole = spark.createDataFrame(rows, schema).filter("dataset_id != 2").drop("of")
    want = sorted(tuple(r) for r in segment(whole, 2).select("dataset_id", "image_id", "label", "area", "perim", "MeanHue").collect())
    assert got == want and len({r[0] for r in got}) == 4
    assert [(r.dataset_id, r.error) for r in job.dead_letters().collect()] == [(2, "a line doesn't have the image's width")]


def test_states_are_kept_by_share_not_by_device(spark, tmp_path):
    """Many devices, one without a number, some rows without an id: as a plain walk, with few keys in the state store."""
    import random

    rng, rows = random.Random(8), []
    for i in range(6_000):
        device = rng.choice([None, *range(-1, 1_500)])
        rows.append((None if i % 50 == 0 else (1 << 60) + i, i, device, rng.choice(["On", "Off", "Ready", None])))
    df = spark.createDataFrame(rows, "event_id long, at long, device_id long, status string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    last, opened, want, sessions = {}, {}, [], []
    for event, at, device, status in rows:
        want.append((device, event, last.get(device), status))
        last[device] = status
        if status == "On":
            opened.setdefault(device, at)
        elif status == "Off" and device in opened:
            sessions.append((device, at - opened.pop(device)))
    folder = str(tmp_path / "kept")
    got = J.run(J.state_machine(J.message_stream(df, parts=3)), folder=folder).select("device_id", "event_id", "before", "status").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    out = J.run(J.operating_time(J.message_stream(df, parts=3))).select("device_id", "seconds").collect()
    assert sorted(map(tuple, out), key=repr) == sorted(sessions, key=repr)
    assert states(spark, folder).count() <= J.SHARES + 1
