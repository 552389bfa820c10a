"""Quality rules with cross-document line frequency (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import SPACE, SPACE_CHARS, fresh, written

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Every hot line's rows are dealt out to this many tasks.
SALTS = 32


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "[0-9]", "0"))


def text_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of a text without nulls.

    n_repeat_words: windows of three words, as hashes with their places, are sorted; a window that equals a
    neighbour repeats, and the words of such windows count once each. All within the row.
    """
    text = F.col(text_col)
    has_word = lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0
    lines = F.filter(F.split(text, "\n"), has_word)
    out = df.withColumn("_words", F.transform(_words(text), lambda w: F.xxhash64(w))).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "_lines": lines,
        }
    )
    w = F.col("_words")
    windows = F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).withColumn("_windows", windows).drop("_words", "_lines")
    # most of the work is spared where no window repeats
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("_windows", F.when(some, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    v = F.col("_windows")
    again = F.filter(v, lambda x, i: F.coalesce(F.get(v, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(v, i + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("_windows", F.array_sort(F.transform(again, lambda x: x["i"])))
    p = F.col("_windows")
    # a repeated window's words count up to where the next one begins
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", covered.cast("long")).drop("_windows")


def document_key(doc_id: Column, host: Column, text: Column) -> Column:
    """What tells documents apart: two hashes of id, host and text."""
    return F.struct(F.xxhash64(doc_id, host.cast("string"), text).alias("a"), F.xxhash64(F.lit("second"), text, doc_id, host.cast("string")).alias("b"))


def line_verdicts(docs: DataFrame, min_docs: int = 20, min_share: float = 0.05, least_left: float = 0.5, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Judge documents by base counts and by how much of them stands on lines that many documents of a host share.

    A line, normalised and hashed, counts each document (id, host, text) of a host once. A line is above the limits if
    at least min_docs documents and more than min_share of its host's documents hold it. Such lines are removed from
    all documents but the first that holds them (smallest id), so a passage stays once. A document is
    rejected if base_failed (fewer than min_words words, or more than half of them in repeated three-word windows), or
    depleted: less than least_left of its words, or fewer than min_words of them, stand on kept lines.

    Returns one row an input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, and doc_key (see document_key), n_cut_words, cut_lines (hashes of removed lines, null where none). Null text: no words.
    Null host: a host of its own. Rows alike in id, host and text are one document to the counts and get one verdict
    each. Empty table: no rows. Other columns, whatever their names, are ignored.

    Texts are read once and never shuffled: the written table holds counts and line hashes. Counts are summed before
    the exchange, and hot lines are salted where rows meet the lines to remove.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    lines = F.transform(
        F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0),
        lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(_words(x)).alias("n")),
    )
    narrow = text_counts(base.withColumn("doc", document_key(F.col("doc_id"), F.col("host"), F.col("text")))).withColumn("lines", lines).drop("text")
    narrow = narrow.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    narrow = written(narrow, "line-counts")

    once = narrow.select("doc", "doc_id", "host", "lines").dropDuplicates(["doc"])
    of_host = once.groupBy("host").agg(F.count("*").alias("host_docs"))
    held = once.select("doc", "doc_id", "host", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    often = held.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "doc")).alias("first")).filter(F.col("n_docs") >= min_docs)
    often = often.join(of_host, often["host"].eqNullSafe(of_host["host"])).drop(of_host["host"]).filter(F.col("n_docs") > min_share * F.col("host_docs"))
    often = written(often.select("host", "line", F.col("first.doc").alias("first_doc")), "frequent-lines")

    salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"host": "host_", "line": "line_"})
    rows = once.select("doc", "host", F.inline("lines")).withColumn("row_salt", F.pmod("doc.a", F.lit(SALTS)))
    cut = (
        rows.join(salted, (rows["line"] == salted["line_"]) & (rows["row_salt"] == salted["salt"]) & rows["host"].eqNullSafe(salted["host_"]) & (rows["doc"] != salted["first_doc"]))
        .groupBy("doc")
        .agg(F.sum("n").alias("n_cut"), F.collect_set("line").alias("cut_lines"))
    )
    left = F.col("n_words") - F.coalesce("n_cut", F.lit(0))
    depleted = (F.col("n_cut") > 0) & ((left < least_left * F.col("n_words")) | (left < min_words))
    return narrow.join(cut, "doc", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce(depleted, F.lit(False))).alias("kept"),
        F.col("doc").alias("doc_key"),
        F.coalesce("n_cut", F.lit(0)).cast("long").alias("n_cut_words"),
        "cut_lines",
    )


def without_cut_lines(text: Column, cut_lines: Column) -> Column:
    """The text without its lines whose hashes are in cut_lines (null: none)."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(cut_lines, F.xxhash64(normalised(x))))
    return F.when(cut_lines.isNull(), text).otherwise(F.array_join(kept, "\n"))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that line_verdicts keeps, without their cut lines; columns as before, whatever their names.

    Only documents that change (rejected, or with lines to cut) are joined back, by document_key. Null and empty texts
    have too few words and go; very long ones are judged whole. Repeated rows share a verdict. Empty table: no rows.
    """
    key, kept, cut = fresh(docs, "_key", "_kept", "_cut")
    changes = line_verdicts(docs, id_col=id_col, text_col=text_col, host_col=host_col, **limits)
    changes = changes.filter(~F.col("kept") | F.col("cut_lines").isNotNull()).select(F.col("doc_key").alias(key), F.col("kept").alias(kept), F.col("cut_lines").alias(cut)).dropDuplicates([key])
    marked = docs.withColumn(key, document_key(F.col(id_col), F.col(host_col), F.coalesce(F.col(text_col), F.lit("")))).join(changes, key, "left").filter(F.coalesce(kept, F.lit(True)))
    return marked.withColumn(text_col, without_cut_lines(F.col(text_col), F.col(cut))).select(*[F.col(f"`{c}`") for c in docs.columns])
