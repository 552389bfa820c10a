"""Places in groups of any size."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from pixelframe.operators.ranks import placed_in_groups
from pixelframe.session import settings_of


def test_places_and_totals(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2]), k, rng.randrange(10**9)) for k in range(4000)] + [("lone", 7, -1, 0)]
    df = spark.createDataFrame(rows, "g string, h int, k long, v long").repartition(5)
    want, groups = {}, defaultdict(list)
    for g, h, k, v in rows:
        groups[g, h].append((v, k))
    for group in groups.values():
        for place, (_, k) in enumerate(sorted(group)):
            want[k] = (place, len(group))
    got = placed_in_groups(df, ["g", F.col("h")], [F.col("v"), F.col("k")], "p", "n")
    assert got.columns == ["g", "h", "k", "v", "p", "n"]
    assert {r.k: (r.p, r.n) for r in got.collect()} == want


def test_one_large_group_is_spread(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 200_003).alias("v"))
    with settings_of(spark, spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__files__maxPartitionBytes="200k", spark__sql__files__openCostInBytes="1k"):
        got = placed_in_groups(df, ["g"], [F.col("v")])
        tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 100_000
    assert got.agg(F.countDistinct("place"), F.max("place"), F.min("place")).first() == (200_000, 199_999, 0)


def test_no_rows(spark):
    assert placed_in_groups(spark.range(0), [], [F.col("id")]).collect() == []
