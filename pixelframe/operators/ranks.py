"""Places of rows within groups of any size: no group is gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.sources.files import small, stored


def placed_in_groups(rows: DataFrame, group: list[str | Column], order: list[Column], place: str = "place", total: str | None = None) -> DataFrame:
    """Rows with their 0-based place in their group's order, and the group's size in `total` if a name is given.

    Rows are dealt out by ranges of (group, order), so a large group lies in many tasks. The table written then fixes each
    row's task and number; a row for each task and group tells where its part begins and how many rows it has, and what
    stands before a part in other tasks is added up over these few rows. Rows that tie in the whole order stand in any
    order among themselves. Null groups are a group.
    """
    names = [f"_group_{k}" for k in range(len(group))]
    keys = {n: F.col(g) if isinstance(g, str) else g for n, g in zip(names, group)}
    columns = rows.columns
    sorting = [F.col(n) for n in names] + order
    spot = rows.withColumns(keys).repartitionByRange(*sorting).sortWithinPartitions(*sorting).withColumn("_spot", F.monotonically_increasing_id())
    spot = stored(spot, "places").withColumn("_task", F.shiftrightunsigned("_spot", 33))
    parts = spot.groupBy("_task", *names).agg(F.min("_spot").alias("_first"), F.count("*").alias("_n"))
    # a group has at most a row a task here
    of = Window.partitionBy(*names)
    before = F.coalesce(F.sum("_n").over(of.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = stored(parts.withColumns({"_before": before, "_total": F.sum("_n").over(of)}), "parts")
    told = parts.select(F.col("_task").alias("_t"), *[F.col(n).alias(f"{n}_") for n in names], "_first", "_before", "_total")
    same = F.col("_task") == F.col("_t")
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"{n}_"))
    out = spot.join(small(told), same).withColumn(place, F.col("_spot") - F.col("_first") + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*columns, place, *([total] if total else []))
