"""Hilbert-curve ordering of documents into shards (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm.common import partitions, ranked, written


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point with coordinates in 0 .. 2**bits - 1, any number of dimensions.

    Bit plane by bit plane, the highest first, and coordinate by coordinate: where the coordinate has the plane's bit,
    the first coordinate's lower bits are inverted, else the two swap their lower bits. A Gray code over the
    coordinates then gives the digits. Folds carry the coordinates as an array, so the expression stays small.
    """
    n = len(cells)
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("bit"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(xs: Column, s: Column) -> Column:
        x, first, low = F.get(xs, s["i"]), F.get(xs, 0), s["bit"] - 1
        has = x.bitwiseAND(s["bit"]) != 0
        swap = first.bitwiseXOR(x).bitwiseAND(low)
        return F.transform(xs, lambda v, k: F.when(has & (k == 0), v.bitwiseXOR(low)).when(~has & ((k == 0) | (k == s["i"])) & (s["i"] != 0), v.bitwiseXOR(swap)).otherwise(v))

    def digits(xs: Column) -> Column:
        last = F.get(xs, n - 1)
        flip = reduce(lambda a, b: a.bitwiseXOR(b), [F.when(last.bitwiseAND(1 << b) != 0, (1 << b) - 1).otherwise(0).cast("long") for b in range(1, bits)] or [F.lit(0).cast("long")])
        bound = F.transform(F.array(flip), lambda f: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(F.get(xs, k).bitwiseXOR(f), b).bitwiseAND(1), b * n + n - 1 - k) for b in range(bits) for k in range(n)]))
        return F.get(bound, 0)

    start = F.array(*[c.cast("long") for c in cells])
    turned = F.aggregate(steps, start, turn) if bits > 1 else start
    gray = lambda xs: F.transform(xs, lambda _, k: F.aggregate(F.slice(xs, 1, k + 1), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)))
    return F.get(F.transform(F.transform(F.array(turned), gray), digits), 0)


def text_cells(rows: DataFrame, column: str, cells: int) -> list[tuple[str, int]]:
    """The smallest value of each cell of a text column, and the cell, when its values are cut in order into `cells` cells
    of about as many rows each. A value is in one cell, whole values are compared, and odd values move no others.

    Values are counted, and their counts added up along ranges of values: a row a range and a row a cell come to the
    driver.
    """
    spark = rows.sparkSession
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    dealt = counts.repartitionByRange(partitions(spark), "value").sortWithinPartitions("value").withColumn("_spot", F.monotonically_increasing_id())
    spot = written(dealt, "values").withColumn("_part", F.shiftrightunsigned("_spot", 33))
    sums = sorted((r["_part"], r["n"]) for r in spot.groupBy("_part").agg(F.sum("n").alias("n")).collect())
    before, total = [], 0
    for part, n in sums:
        before.append((part, total))
        total += n
    if not total:
        return []
    inside = Window.partitionBy("_part").orderBy("_spot").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("_before")
    placed = spot.join(F.broadcast(spark.createDataFrame(before, "_part long, _before long")), "_part")
    of = placed.withColumn("cell", F.floor(start * cells / total).cast("int")).groupBy("cell").agg(F.min("value").alias("value"))
    return sorted((r["value"], r["cell"]) for r in of.collect())


def _cell_of_text(value: Column, bounds: list[tuple[str, int]]) -> Column:
    if not bounds:
        return F.lit(0)
    at = F.size(F.filter(F.array(*[F.lit(b) for b, _ in bounds]), lambda b: b <= value))
    return F.when(value.isNull(), 0).otherwise(F.get(F.array(*[F.lit(c) for _, c in bounds]), at - 1))


def hilbert_shards(docs: DataFrame, n_shards: int = 16, text_dims: tuple[str, ...] = ("source", "lang"), bits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Order documents by their place on a Hilbert curve and cut the order into shards of equal row counts.

    Dimensions: each of text_dims and the text's size, quantised into 2**bits cells at quantiles of all rows (texts by
    their whole values, see text_cells), so a file of one shard spans a small box and predicates on any of the dimensions skip most files. Rows of one cell
    stand by text hash, then id, so equal texts with equal metadata stand together.

    Returns id, size (UTF-8 bytes, null: 0, plus 1), text_crc32 (null as the empty text), law 'rows' (counts at most
    one apart), shard, slot (gapless from 0), grown_shard (null), curve (the curve index) and the text dimensions.
    Null dimension values: cell 0. Empty table: no rows. Repeated rows: each is placed. More columns of the input,
    whatever their names, are ignored. One range exchange of narrow rows; texts aren't moved.
    """
    top = 1 << bits
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = written(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *[F.col(c).cast("string").alias(f"dim_{c}") for c in text_dims],
    ), "narrow")
    shares = [k / top for k in range(1, top)]
    sizes = sorted(set(narrow.agg(F.percentile_approx(F.col("size").cast("double"), shares, 10_000).alias("q")).first()["q"] or []))
    cells = {c: _cell_of_text(F.col(f"dim_{c}"), text_cells(narrow, f"dim_{c}", top)) for c in text_dims}
    # few distinct values are spread over the whole axis
    below = F.size(F.filter(F.array(*[F.lit(float(q)) for q in sizes]), lambda q: q < F.col("size"))) if sizes else F.lit(0)
    cells["size"] = F.floor(below * (top - 1) / max(len(sizes), 1))
    placed = narrow.withColumns({f"cell_{k}": cell for k, cell in cells.items()})
    placed = placed.withColumn("curve", hilbert_index([F.col(f"cell_{k}") for k in cells], bits)).drop(*[f"cell_{k}" for k in cells])
    order = [F.col(k) for k in ("curve", "text_crc32", "size", "doc_id")]
    by_rank, total = ranked(placed, order, "hilbert")
    small, large = divmod(total, n_shards)  # the first `large` shards hold one row more
    edge = large * (small + 1)
    rank = F.col("global_rank")
    shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(large + F.floor((rank - edge) / max(small, 1)))
    out = by_rank.withColumn("shard", shard.cast("int"))
    start = F.when(F.col("shard") < large, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - large) * small)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (rank - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
        *[f"dim_{c}" for c in text_dims],
    )
