"""Session settings that the operators rely on."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(cores: int | None = None, app: str = "pixelframe", **settings: str) -> SparkSession:
    """A local session; on a cluster, use the cluster's own and only the SQL settings here."""
    n = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PIXELFRAME_DRIVER_MEMORY", "5g"))
        .config(map=settings)
        .getOrCreate()
    )


@contextmanager
def settings_of(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings (dots as two underscores) that hold for the actions within."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
