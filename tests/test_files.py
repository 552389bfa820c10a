"""Sources and sinks on real files."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from pixelframe.sources import files as S


def test_images_and_scanlines(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {k: rng.integers(0, 256, (5 + k, 700, 3)) for k in range(3)}
    rows = [(4, 10 + k, k, y, *(p[y, :, c].tolist() for c in range(3))) for k, p in images.items() for y in range(len(p))]
    lines = spark.createDataFrame(rows, "dataset_id long, image_id long, seq long, y int, b array<int>, g array<int>, r array<int>")
    assert S.write_images(lines.repartition(5), str(tmp_path)) == 3
    folder = tmp_path / "4"
    for name in ("a.png", "b.JPEGX", "notes.txt"):
        (folder / name).write_text("x")
    (folder / "00000001.jpg").rename(folder / "00000001.JPEG")
    found = {r.path.rsplit("/", 1)[1]: r.seq for r in S.scan_images(spark, str(folder)).collect()}
    assert found == {"00000000.jpg": 0, "00000001.JPEG": 1, "00000002.jpg": 2}
    got = S.decode_scanlines(spark, str(folder / "0*"), lines_at_once=2).collect()
    assert len(got) == 18
    for r in got:
        pixels = images[int(r.path.rsplit("/", 1)[1].split(".")[0])]
        assert (r.w, r.h) == (700, len(pixels)) and [r.b, r.g, r.r] == pixels[r.y].T.tolist()


def test_datasets_metadata_and_markers(spark, tmp_path):
    for k in range(3):
        folder = tmp_path / f"d{k}"
        folder.mkdir()
        (folder / "0001.jpg").write_bytes(b"x")
        if k:
            (folder / "metadata.json").write_text(json.dumps({"acq_id": f"a{k}", "n": k}) if k == 1 else "{broken")
    (tmp_path / "d1" / "done.txt").write_text("2024-05-06T07:08:09Z\n")
    files = S.walk_files(spark, str(tmp_path))
    assert files.count() == 6
    assert sorted(r.dir[-2:] for r in S.discover_datasets(files).collect()) == ["d1", "d2"]
    meta = {r.dir[-2:]: r.acq_id for r in S.read_metadata_json(spark, str(tmp_path), "acq_id string, n int").collect()}
    assert meta == {"d1": "a1", "d2": None}
    assert [(r.dir[-2:], r.at) for r in S.read_done_markers(spark, str(tmp_path)).collect()] == [("d1", "2024-05-06T07:08:09Z")]


def test_ledger(spark, tmp_path):
    to = str(tmp_path / "ledger")
    files = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], S.LEDGER)
    S.append_integrity(files, to)
    S.append_integrity(files.select(F.upper("filename").alias("filename"), "size", "sha1"), to)
    assert sorted(r.filename for r in S.read_integrity_ledger(spark, to).collect()) == ["A", "B", "a", "b"]
    assert S.valid_ledgers(spark, to).count() == 1
    # entries without the two head lines aren't believed
    (tmp_path / "ledgers" / "bad").mkdir(parents=True)
    (tmp_path / "ledgers" / "bad" / "x").write_text("# filename,size,sha1\nz,1,q\n")
    (tmp_path / "ledgers" / "good").mkdir()
    (tmp_path / "ledgers" / "good" / "x").write_text("\n".join([*S.LEDGER_HEAD, "k,1,q", ""]))
    assert [r.filename for r in S.read_integrity_ledger(spark, str(tmp_path / "ledgers")).collect()] == ["k"]


def test_ledgers_go_by_the_place_of_lines(spark, tmp_path):
    files = {
        "other": "# by hand\n#\na.jpg,1,q\n",
        "late": "a.jpg,1,q\n" + "\n".join(S.LEDGER_HEAD) + "\nb.jpg,2,r\n",
        "odd": "\r\n".join([*S.LEDGER_HEAD, "#odd.jpg,3,s", "x, y,z.jpg,4,t  ", "", "nameless", "bad,size,u"]),
        "short": "# alone",
        "none": "",
    }
    for k, text in files.items():
        (tmp_path / k).mkdir()
        (tmp_path / k / "ledger.txt").write_bytes(text.encode())
    got = sorted(((r.ledger.rsplit("/", 1)[1], r.filename, r.size, r.sha1) for r in S.read_integrity_ledger(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([("other", "a.jpg", 1, "q"), ("odd", "#odd.jpg", 3, "s"), ("odd", "x, y,z.jpg", 4, "t"), ("odd", "nameless", None, None), ("odd", "bad", None, "u")], key=repr)
    assert sorted(r.ledger.rsplit("/", 1)[1] for r in S.valid_ledgers(spark, str(tmp_path)).collect()) == ["odd", "other"]


def test_gray_opaque_and_broken_images(spark, tmp_path):
    import struct
    import zlib

    rng = np.random.default_rng(2)

    def png(pixels, kind):
        h, w, depth = pixels.shape
        raw = b"".join(b"\0" + line.tobytes() for line in pixels.astype(np.uint8))
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    gray, clear = rng.integers(0, 256, (4, 6, 1)), rng.integers(0, 256, (3, 5, 4))
    (tmp_path / "gray.jpg").write_bytes(png(gray, 0))
    (tmp_path / "clear.jpg").write_bytes(png(clear, 6))
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8 no image")
    got = {(r.path.rsplit("/", 1)[1], r.y): (r.b, r.g, r.r) for r in S.decode_scanlines(spark, str(tmp_path)).collect()}
    assert len(got) == 7
    for y in range(4):
        assert got["gray.jpg", y] == (gray[y, :, 0].tolist(),) * 3
    for y in range(3):
        assert got["clear.jpg", y] == tuple(clear[y, :, k].tolist() for k in (2, 1, 0))
    assert [(r.path.rsplit("/", 1)[1], r.error) for r in S.undecoded_images(spark, str(tmp_path)).collect()] == [("broken.jpg", "not a readable image")]


def test_export_of_any_text_comes_back(spark, tmp_path):
    import random

    rng = random.Random(7)
    bits = ["", " ", "\t", "\n", "\r\n", "\r", '"', "'", "\\", "a", "é", ",", "#", "[t]", "NULL", "\\N", '""', " lead", "trail "]
    for n in (1, 2, 4):
        rows = [tuple(None if rng.random() < 0.2 else "".join(rng.choices(bits, k=rng.randrange(4))) for _ in range(n)) for _ in range(200)]
        rows += [(None,) * n, ("",) * n]
        table = spark.createDataFrame(rows, ", ".join(f"c{k} string" for k in range(n))).repartition(3)
        S.export_tsv(table, str(tmp_path / f"t{n}"))
        back = S.read_export_tsv(spark, str(tmp_path / f"t{n}"))
        assert back.columns == table.columns
        assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))


def test_export_has_two_header_lines(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, 0.5, True), ("q", 2, None, False)], "name string, n int, v double, flag boolean").withColumnRenamed("v", "perim.")
    S.export_tsv(rows.coalesce(1), str(tmp_path / "t"))
    (part,) = (tmp_path / "t").glob("part-*")
    lines = part.read_text().splitlines()
    assert lines[0].split("\t") == ["name", "n", "perim.", "flag"] and lines[1].split("\t") == ["[t]", "[f]", "[f]", "[t]"]
    back = S.read_export_tsv(spark, str(tmp_path / "t")).collect()
    assert sorted(map(tuple, back)) == [("p", "1", "0.5", "true"), ("q", "2", None, "false")]
    S.export_tsv(rows, str(tmp_path / "by"), partition_by="name")
    for k in "pq":
        (part,) = (tmp_path / "by" / f"name={k}").glob("part-*")
        assert len(part.read_text().splitlines()) == 3


def test_export_keeps_every_row(spark, tmp_path):
    """Rows of nulls and rows that look like type codes are data; many tasks write many files, each with its head."""
    odd = [(None, None), ("[t]", "[f]"), ("[f]", None), ("x", "y"), ("", "z")]
    rows = spark.createDataFrame(odd * 3, "a string, b string").repartition(4)
    S.export_tsv(rows, str(tmp_path / "t"))
    back = S.read_export_tsv(spark, str(tmp_path / "t")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(map(repr, odd * 3))
    parts = list((tmp_path / "t").glob("part-*"))
    assert len(parts) > 1 and all(p.read_text().splitlines()[:2] == ["a\tb", "[t]\t[t]"] for p in parts)
    S.export_tsv(rows.withColumn("k", F.lit(1)).unionByName(rows.withColumn("k", F.lit(2))), str(tmp_path / "by"), partition_by="k", files=3)
    assert S.read_export_tsv(spark, str(tmp_path / "by" / "k=2")).count() == 15
    S.export_tsv(rows.limit(0), str(tmp_path / "none"))
    assert not [p for p in (tmp_path / "none").glob("part-*") if len(p.read_text().splitlines()) > 2]


def test_new_acquisitions_only(spark, tmp_path):
    new = spark.createDataFrame([("d", "s", "a", 1), ("d", "s", "b", 2)], "object_date string, sample_id string, acq_id string, n int")
    old = spark.createDataFrame([("d", "s", "a")], "object_date string, sample_id string, acq_id string")
    assert [r.acq_id for r in S.write_dataset_metadata(new, old, str(tmp_path / "m")).collect()] == ["a"]
    assert [r.acq_id for r in spark.read.json(str(tmp_path / "m")).collect()] == ["b"]


def test_crops(spark, tmp_path):
    crops = spark.createDataFrame([(1, 1, 0, 0, [1], [2], [3])], "image_id long, label long, y int, x0 int, b array<int>, g array<int>, r array<int>")
    S.write_object_crops(crops, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1


def test_exported_files_are_bounded(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 2).select(F.concat(F.lit("a\n"), F.col("id").cast("string")).alias("t"), (F.col("id") % 3).alias("k"))
    S.export_tsv(rows, str(tmp_path / "t"), rows_a_file=100)
    paths = list((tmp_path / "t").glob("part-*"))
    assert len(paths) == 10 and all(S.read_export_tsv(spark, str(p)).count() == 100 for p in paths)
    back = S.read_export_tsv(spark, str(tmp_path / "t")).collect()
    assert sorted((r.t, int(r.k)) for r in back) == sorted((r.t, r.k) for r in rows.collect())
    S.export_tsv(rows, str(tmp_path / "by"), partition_by="k")
    assert all(len(list((tmp_path / "by" / f"k={k}").glob("part-*"))) == 1 for k in range(3))
    assert sum(S.read_export_tsv(spark, str(tmp_path / "by" / f"k={k}")).count() for k in range(3)) == 1000


def test_many_small_images_are_decoded_by_few_tasks(spark, tmp_path):
    one = lambda k: spark.range(80).select(F.lit(k).alias("dataset_id"), (F.col("id") + 100 * k).alias("image_id"), F.col("id").alias("seq"), F.lit(0).alias("y"), *[F.array(F.col("id").cast("int"), F.lit(k)).alias(c) for c in "bgr"])
    assert S.write_images(one(1).unionByName(one(2)), str(tmp_path / "i")) == 160
    lines = S.decoded(spark, str(tmp_path / "i" / "*"))
    assert lines.count() == 160 and {(r.b[0], r.b[1]) for r in lines.collect()} == {(i, k) for i in range(80) for k in (1, 2)}
    files = {p.split("/")[-1] for p in lines.inputFiles()}  # a file a task that wrote
    assert len(files) <= 4
