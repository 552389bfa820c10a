"""Scalar functions and measurement identities on literal cases."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pixelframe.functions import scalars as S
from pixelframe.functions import settings as C
from pixelframe.plans.segmentation import derived_ratios


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_gallery_path(spark):
    cases = {"/home/pi/data/objects/foo": "/ps/data/browse/files/objects/foo", "/home/pi/data/img/foo": "/ps/data/browse/files/img/foo", "/tmp/baz": None}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", S.gallery_path(F.col("p"), "/home/pi/data").alias("g")).collect()
    assert {r.p: r.g for r in rows} == cases


def test_ids_and_names(spark):
    got = one(
        spark,
        dash=S.underscore_id(F.lit("a b c")),
        folder=S.directory_id(F.lit("'a b'")),
        cut=S.strip_parent_id(F.lit("p_s_p_x"), F.lit("p")),
        same=S.strip_parent_id(F.lit("other"), F.lit("p")),
        stem=S.file_stem(F.lit("/x/y.z/a.b.jpg")),
        ext=S.extension(F.lit("/x/y.z/a.b.jpg")),
        none=S.extension(F.lit("/x.y/a")),
        command=S.topic_command(F.lit("a/b/c")),
        version=S.hardware_version(F.lit("Scope v2.6")),
        lone=S.hardware_version(F.lit("Scope")),
        image=S.is_image(F.lit("A.JPG")),
    )
    assert got == {"dash": "a_b_c", "folder": "a_b", "cut": "s_", "same": "other", "stem": "a.b", "ext": ".jpg", "none": "", "command": "b/c", "version": "v2.6", "lone": None, "image": True}


def test_capture_time_and_status(spark):
    number, total, name = S.parse_status(F.lit("Segmenting image a.jpg, image 3/40"))
    saved = S.parse_status(F.lit("Image 2/9 saved to x y.jpg"))
    got = one(spark, t=S.capture_time(F.lit("2024-01-02_03-04-05-678901.jpg")).cast("string"), bad=S.capture_time(F.lit("x")), n=number, of=total, f=name, n2=saved[0], of2=saved[1], f2=saved[2], odd=S.parse_status(F.lit("Done"))[0])
    assert got == {"t": "2024-01-02 03:04:05.678901", "bad": None, "n": 3, "of": 40, "f": "a.jpg", "n2": 2, "of2": 9, "f2": "x y.jpg", "odd": None}


def test_derived_ratios_of_a_measured_object(spark):
    base = {"area_exc": 1077, "area": 1164, "perim": 248.58073580374352, "major": 84.35144817947639, "minor": 22.651130623883205, "convex_area": 1652}
    row = derived_ratios(spark.createDataFrame([base])).withColumns({"equivalent_diameter": S.equivalent_diameter(F.col("area_exc")), "elongation": S.ratio_safe(F.col("major"), F.col("minor"))}).first()
    want = {"circ": 0.23671615936018325, "pct_area": 0.07474226804123707, "elongation": 3.7239398589020882, "perimareaexc": 0.23080848264043038, "perimmajor": 2.9469646481330463, "circex": 0.21902345672759224, "solidity": 0.6519370460048426, "equivalent_diameter": 37.03078435139837}
    for k, v in want.items():
        assert math.isclose(row[k], v, rel_tol=1e-12), k
    assert math.isclose(math.sqrt(1 - (base["minor"] / base["major"]) ** 2), 0.9632705408870905, rel_tol=1e-12)


def test_zero_divisors_give_null(spark):
    got = one(spark, a=S.ratio_safe(F.lit(1), F.lit(0)), b=S.circularity(F.lit(4), F.lit(0.0)))
    assert got == {"a": None, "b": None}


def test_hsv(spark):
    colours = {(0, 0, 255): (0, 255, 255), (0, 255, 0): (60, 255, 255), (255, 0, 0): (120, 255, 255), (9, 9, 9): (0, 0, 9), (0, 0, 0): (0, 0, 0), (1, 0, 255): (0, 255, 255)}
    for (b, g, r), want in colours.items():
        h, s, v = S.hsv(F.lit(b), F.lit(g), F.lit(r))
        got = one(spark, h=h, s=s, v=v)
        assert (got["h"], got["s"], got["v"]) == want


def test_settings(spark):
    row = spark.createDataFrame([(-1, 17.0, 0.0, 33.0, None, 32.0, 0.0, 96)], "exposure int, gain double, brightness double, contrast double, wb_red double, wb_blue double, sharpness double, jpeg_quality int")
    got = row.select(C.violations().alias("v"), C.first_error(C.violations()).alias("m")).first()
    assert got.v == ["Exposure time", "Image gain", "Contrast", "JPEG quality"] and got.m == "Shutter speed not valid"
    fine = row.select(*[F.lit(0).alias(c) for c in row.columns]).select(C.violations().alias("v"), C.first_error(C.violations()).alias("m")).first()
    assert fine.v == [] and fine.m is None


def test_merge_config(spark):
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    new = F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("3"))
    assert one(spark, m=S.merge_config(old, new))["m"] == {"a": "1", "b": None, "c": "3"}


def test_type_codes():
    assert [S.type_code(t) for t in ("int", "double", "decimal(3,1)", "boolean", "string", "array<int>", "struct<a:int>")] == ["[f]"] * 3 + ["[t]"] * 4
