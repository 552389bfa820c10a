"""Entropy balancing: document rates that meet a token target for each source, rounded into copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm.common import fresh, ranked, word_count, written

#: Rates are kept as whole millionths, so sums don't depend on the order of rows.
UNIT = 1_000_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets of sources, given has_source, src and total (long) of each: one row a source.

    Sources by code point, null last, weigh as weights say, repeating. All sizes together are shared by weight; a
    target stops at `most` times its source's size, and the excess is shared again until none is above. So a target is
    min(most * size, weight * level); each round of sharing is an aggregation that gives the next level.
    """
    placed, n = ranked(sizes, [F.desc("has_source"), F.col("src")], "sources", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = written(placed.withColumn("weight", weight), "weights")
    level, stopped, everything = 0.0, -1, int(sizes.agg(F.sum("total")).first()[0] or 0)
    while n:
        stops = F.col("weight") * level >= most * F.col("total")
        r = weighed.agg(F.count_if(stops).alias("n"), F.sum(F.when(stops, most * F.col("total")).otherwise(0)).alias("taken"), F.sum(F.when(stops, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if r["n"] == stopped or not r["free"]:
            break
        level, stopped = (everything - r["taken"]) / r["free"], r["n"]
    return weighed.select("has_source", "src", "total", F.least(F.col("weight") * level, most * F.col("total").cast("double")).alias("target"))


def _tilted(tilt: Column, size: Column, scale: Column, most: int) -> Column:
    """The rate that minimises relative entropy to one copy of each document under the token constraint, up to most."""
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), tilt * size / scale)))


def solve_tilts(cells: DataFrame, targets: DataFrame, most: int, tolerance: float = 1e-7) -> DataFrame:
    """One tilt a source by Newton steps on the dual, each step one aggregation over all cells.

    The dual's gradient is tokens taken minus target; with log tokens it is close to a line in the tilt, so few steps
    do. Every step keeps a bracket of the root and halves it where Newton would leave it, and at every third step in any
    case, so steps end: when all targets are met, or when no tilt between two that are told apart meets the one left
    (rounding makes up for that). A step's state is one row a source, written to the shared folder. Sources whose target
    is their stop, or nothing, need no tilt.
    """
    scale = cells.groupBy("has_source", "src").agg((F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("scale"))
    state = targets.join(scale, ["has_source", "src"]).withColumns({"tilt": F.lit(0.0), "low": F.lit(-60.0), "high": F.lit(60.0), "off": F.lit(1.0)})
    state = written(state.withColumn("free", (F.col("target") > 0) & (F.col("target") < most * F.col("total") * (1 - 1e-12))), "tilt")
    step = 0
    while True:
        step += 1
        rate = _tilted(F.col("tilt"), F.col("size"), F.col("scale"), most)
        tokens = F.col("size") * F.col("n") * rate
        slope = F.when(rate < most, tokens * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = cells.join(state.filter("free"), ["has_source", "src"]).groupBy("has_source", "src").agg(F.sum(tokens).alias("f"), F.sum(slope).alias("df"))
        gap = F.log(F.col("f")) - F.log("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap * F.col("f") / F.when(F.col("df") > 0, F.col("df"))
        inside = (newton > F.col("low_")) & (newton < F.col("high_"))
        stepped = (
            state.join(sums, ["has_source", "src"], "left")
            .withColumns({"gap": gap, "low_": low, "high_": high})
            .withColumn("next", F.when(F.abs("gap") < tolerance, F.col("tilt")).when(inside & F.lit(step % 3 > 0), newton).otherwise((F.col("low_") + F.col("high_")) / 2))
            .select("has_source", "src", "total", "target", "scale", F.when(F.col("free"), F.round("next", 10)).otherwise(0.0).alias("tilt"), F.col("low_").alias("low"), F.col("high_").alias("high"), F.coalesce(F.when(F.col("free"), F.abs("gap")), F.lit(0.0)).alias("off"), "free")
        )
        state = written(stepped, "tilt")
        if state.filter((F.col("off") >= tolerance) & (F.col("high") - F.col("low") > 1e-9)).isEmpty():
            return state


def copies_of_cells(cells: DataFrame, tilts: DataFrame, most: int, repairs: int = 3) -> DataFrame:
    """Whole copies for cells of documents with one source and size: `each` for every document, one more for `extra`.

    Systematic rounding along the sizes: a cell's extra copies are the whole numbers that the running sum of
    fractional rates passes in it, so a source misses its target by about one document at most. What it misses is then
    made up, a few times, by copies of the largest sizes that still fit into the gap, and at last by the one copy more
    or less that brings the source nearest to its target.
    """
    source = ["has_source", "src"]
    rate = F.when(F.col("free"), _tilted(F.col("tilt"), F.col("size"), F.col("scale"), most)).when(F.col("target") > 0, float(most)).otherwise(0.0)
    by_size = Window.partitionBy(*source).orderBy("size")
    part = F.col("units") % UNIT * F.col("n")
    out = (
        cells.join(tilts, source)
        .withColumn("units", F.round(rate * UNIT).cast("long"))
        .withColumn("upto", F.sum(part).over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("extra", F.floor((F.col("upto") + UNIT // 2) / UNIT) - F.floor((F.col("upto") - part + UNIT // 2) / UNIT))
        .withColumn("copies", F.floor(F.col("units") / UNIT) * F.col("n") + F.col("extra"))
        .select(*source, "size", "n", "target", "total", "copies")
    )
    gap = F.col("target") - F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy(*source))
    for _ in range(repairs):
        out = written(out, "cells").withColumn("gap", gap)
        room = F.when(F.col("gap") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        out = out.withColumn("room", F.when((F.col("size") > 0) & (F.col("size") <= F.abs("gap")), room).otherwise(0))
        larger = Window.partitionBy(*source).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(larger), F.lit(0))
        fits = F.floor((F.abs("gap") - before) / F.when(F.col("size") > 0, F.col("size")))
        moved = F.greatest(F.least(fits, F.col("room")), F.lit(0)) * F.signum("gap").cast("long")
        out = out.withColumn("copies", F.when(F.col("room") > 0, F.col("copies") + moved).otherwise(F.col("copies"))).select(*source, "size", "n", "target", "total", "copies")
    out = written(out, "cells").withColumn("gap", gap)
    # the best single move of each source
    up, down = F.when(F.col("copies") < most * F.col("n"), 1), F.when(F.col("copies") > 0, -1)
    move = F.when(F.col("gap") > 0, up).otherwise(down)
    after = F.when(move.isNotNull(), F.abs(F.col("gap") - move * F.col("size")))
    best = F.min(F.struct(F.coalesce(after, F.lit(1e300)).alias("after"), "size")).over(Window.partitionBy(*source))
    chosen = (best["size"] == F.col("size")) & (best["after"] < F.abs("gap"))
    out = out.withColumn("copies", F.col("copies") + F.when(chosen, move).otherwise(0)).withColumn("each", F.floor(F.col("copies") / F.col("n")))
    return written(out.select(*source, "size", "n", "target", "total", "each", (F.col("copies") - F.col("each") * F.col("n")).alias("extra")), "cells")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many copies of each document a mix takes whose sources hold given shares of the words.

    Rates exp(tilt * size), at most `most`, are the ones nearest to one copy of each (in relative entropy) that meet
    each source's target; solve_tilts finds the tilts, copies_of_cells makes them whole. Documents of one source and
    size have the same rate, so everything but the last step works on a table of (source, size) with counts. Which of
    them get the extra copy is told by a hash of the id; reruns agree.

    Returns one row a document: id, size (words, null text: 0), source, source_size, target, copies, taken (words
    taken, repeats counted). Null source: a source of its own, the last. Empty texts: no words, no copies beyond what
    the rate of size 0 gives. Repeated rows are documents of their own. Empty table: no rows. Other columns, whatever
    their names, are ignored.
    """
    narrow = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).isNotNull().alias("has_source"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
            word_count(F.col(text_col)).alias("size"),
        ),
        "sizes",
    )
    cells = written(narrow.groupBy("has_source", "src", "size").agg(F.count("*").alias("n")), "cells")
    sizes = cells.groupBy("has_source", "src").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    targets = source_targets(sizes, weights, most)
    whole = copies_of_cells(cells, solve_tilts(cells, targets, most), most)
    # places of documents in the order of cells tell which of a cell come first; no cell is gathered in one task
    placed, _ = ranked(narrow, [F.desc("has_source"), F.col("src"), F.col("size"), F.xxhash64("doc_id"), F.col("doc_id")], "mixed")
    cell = ["has_source", "src", "size"]
    starts = whole.join(placed.groupBy(*cell).agg(F.min("global_rank").alias("cell_start")), cell)
    copies = F.col("each") + F.when(F.col("global_rank") - F.col("cell_start") < F.col("extra"), 1).otherwise(0)
    return placed.join(starts, ["has_source", "src", "size"]).select(
        "doc_id",
        "size",
        F.when(F.col("has_source"), F.col("src")).alias("source"),
        F.col("total").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as often as mix_sources takes them; columns as before, whatever their names. Rows alike in id,
    source and size, if a table has such, are taken as often as the one of them with the most copies.

    Null and empty texts follow the rate of no words: once, or as often as all others in a source that is taken as
    often as it may be. Very long texts are counted whole. Empty table: no rows.
    """
    rates = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    key, copies, copy = fresh(docs, "_mix_key", "_copies", "_copy")
    of = lambda doc_id, source, size: F.struct(F.xxhash64(doc_id, source, size).alias("a"), F.xxhash64(size, source, doc_id).alias("b"))
    taken = rates.groupBy(of(F.col("doc_id"), F.col("source"), F.col("size")).alias(key)).agg(F.max("copies").alias(copies)).filter(F.col(copies) != 1)
    marked = docs.withColumn(key, of(F.col(id_col), F.col(source_col).cast("string"), word_count(F.col(text_col)))).join(taken, key, "left")
    marked = marked.withColumn(copies, F.coalesce(copies, F.lit(1))).filter(F.col(copies) > 0)
    return marked.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
