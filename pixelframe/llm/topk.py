"""Exact top-k search by refining histograms of all scores until each k-th value is known."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm.common import partitions, written

BINS = 256
#: A task adds up the histograms of this many candidate blocks before it passes them on, and then of as many sums.
CHUNK = 64


def _matrix(row: dict, ids: str, data: str) -> tuple[np.ndarray, np.ndarray]:
    ids_ = np.frombuffer(row[ids], np.int64)
    raw = row[data]
    return ids_, np.frombuffer(raw, f"i{len(raw) // (len(ids_) * row['dims'])}").reshape(len(ids_), -1).astype(np.int64)


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and the integer scores of a pair of blocks; a query's own rows score below all."""
    q_ids, q = _matrix(row, "q_ids", "q_data")
    c_ids, c = _matrix(row, "c_ids", "c_data")
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    exact = bound < 1 << 52  # doubles hold such sums exactly
    out = (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if exact else q @ c.T
    own = np.searchsorted(c_ids, q_ids)
    last = np.searchsorted(c_ids, q_ids, "right")
    for i in np.flatnonzero(last > own):
        out[i, own[i] : last[i]] = np.iinfo(np.int64).min
    return q_ids, c_ids, out


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block: int = 4096, query_block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query, its k best candidates by inner product of vectors whose components became floor(scale * x).

    Queries: rows whose id is divisible by `every`; candidates: all rows but those with the query's id. Vectors are
    packed in blocks, and each query block meets each candidate block. A pass scores all pairs of blocks and counts
    scores in BINS bins of each query's current range; the bin that holds the k-th value is the next range, until it is
    one number wide. A last pass keeps scores above that value, and of those equal to it the smallest ids that are
    still wanted in a block; ties go to smaller ids. Scores aren't kept between passes.

    Returns query_id, rank (from 1), vec_id, score; all candidates where there are fewer than k. Vectors null or with
    null, NaN or infinite components take no part, neither do null ids; shorter vectors count as filled up with
    zeros. Components are kept in two bytes where they fit, else in four or eight. Repeated rows are candidates each. Empty table: no rows. Other columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col("vec_id").isNotNull()
    whole = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .filter(usable)
        .select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"), F.monotonically_increasing_id().alias("spot"))
    )
    whole = written(whole, "vectors")
    facts = whole.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.sum((F.col("vec_id") % every == 0).cast("int")).alias("queries")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts["n"] or not facts["queries"]:
        return spark.createDataFrame([], schema)
    dims = max(1, facts["dims"])
    largest = int(whole.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0)
    width = next(w for w in (2, 4, 8) if largest < 1 << (8 * w - 1))  # bytes that hold a component
    n_blocks, n_query_blocks = -(-facts["n"] // block), -(-facts["queries"] // query_block)

    def packed(rows: DataFrame, number: int, name: str) -> DataFrame:
        def pack(table: pa.Table) -> pa.Table:
            order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
            lists = table["v"].combine_chunks()
            lengths = lists.value_lengths().to_numpy()
            full = np.zeros((len(order), dims), np.int64)
            full[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy()
            return pa.table({f"{name}_block": [table["b"][0].as_py()], f"{name}_ids": [table["vec_id"].to_numpy()[order].tobytes()], f"{name}_data": [full[order].astype(f"i{width}").tobytes()]}, schema=pa.schema([(f"{name}_block", pa.int32()), (f"{name}_ids", pa.binary()), (f"{name}_data", pa.binary())]))

        # blocks get equal shares of rows whatever the ids are
        return rows.withColumn("b", F.pmod(F.xxhash64("spot"), F.lit(number)).cast("int")).groupBy("b").applyInArrow(pack, f"{name}_block int, {name}_ids binary, {name}_data binary")

    candidates = written(packed(whole, n_blocks, "c"), "candidates")
    queries = written(packed(whole.filter(F.col("vec_id") % every == 0), n_query_blocks, "q").withColumn("dims", F.lit(dims)), "queries")
    each = candidates.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))).withColumn("chunk", F.floor(F.col("c_block") / CHUNK).cast("int"))

    # the first range of every query: no score is larger than the product of the largest components, dims times
    def first_range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, q = _matrix(row, "q_ids", "q_data")
            top = np.abs(q).sum(1) * largest
            width = top // (BINS // 2) + 1  # BINS of them hold -top to top
            yield _state(row["q_block"], ids, -top, top + 1, width, np.zeros_like(top))

    def _state(q_block: int, ids: np.ndarray, low: np.ndarray, high: np.ndarray, width: np.ndarray, above: np.ndarray) -> pa.RecordBatch:
        """Ranges [low, high) of a block's queries in bins of a width, and how many scores are above them."""
        columns = [pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (low, high, width, above)]
        return pa.RecordBatch.from_arrays([pa.array([q_block], pa.int32()), *columns, pa.array([int(width.max(initial=1))], pa.int64())], names=["q_block", "low", "high", "width", "above", "widest"])

    state_schema = "q_block int, low binary, high binary, width binary, above binary, widest long"

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Histograms of the scores within each query's range, added up over a task's pairs of one query block."""
        held, chunk, total = None, 0, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["q_block", "chunk", "counts"])
        for row in _rows(batches):
            q_ids, _, scores = _scores(row)
            if (held, chunk) != (row["q_block"], row["chunk"]):
                if held is not None:
                    yield out()
                held, chunk, total = row["q_block"], row["chunk"], np.zeros((len(q_ids), BINS), np.int64)
            low, high, width = (np.frombuffer(row[x], np.int64)[:, None] for x in ("low", "high", "width"))
            inside = (scores >= low) & (scores < high)
            # differences may need all 64 bits
            nth = (np.where(inside, scores, low).astype(np.uint64) - low.astype(np.uint64)) // width.astype(np.uint64)
            at = np.where(inside, nth.astype(np.int64), BINS) + np.arange(len(q_ids))[:, None] * (BINS + 1)
            total += np.bincount(at.ravel(), minlength=len(q_ids) * (BINS + 1)).reshape(-1, BINS + 1)[:, :BINS]
        if held is not None:
            yield out()

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of histograms of one query block, over the chunks that a task gets one after the other."""
        held, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["q_block", "chunk", "counts"])
        for row in _rows(batches):
            counts = np.frombuffer(row["counts"], np.int64)
            if held == (row["q_block"], row["chunk"]):
                total = total + counts
                continue
            if held is not None:
                yield out()
            held, total = (row["q_block"], row["chunk"]), counts
        if held is not None:
            yield out()

    def summed(sums: DataFrame) -> DataFrame:
        """Histograms added up level by level, so no task reads more than CHUNK of a query block's in the end."""
        left = -(-n_blocks // CHUNK)
        while left > CHUNK:
            sums = sums.withColumn("chunk", F.floor(F.col("chunk") / CHUNK).cast("int"))
            sums = sums.repartition(tasks, "q_block", "chunk").sortWithinPartitions("q_block", "chunk").mapInArrow(added, "q_block int, chunk int, counts binary")
            left = -(-left // CHUNK)
        return sums

    def narrowed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The next range of each query: the bin that holds its k-th score from above."""
        low, high, width, above = (np.frombuffer(right[x][0].as_py(), np.int64) for x in ("low", "high", "width", "above"))
        counts = sum(np.frombuffer(x.as_py(), np.int64).reshape(-1, BINS) for x in left["counts"])
        from_top = np.cumsum(counts[:, ::-1], 1)[:, ::-1]  # scores in this bin or a higher one
        enough = above[:, None] + from_top >= k
        bin_ = np.where(enough.any(1), BINS - 1 - np.argmax(enough[:, ::-1], 1), 0)
        higher = np.where(bin_ + 1 < BINS, np.take_along_axis(from_top, np.minimum(bin_ + 1, BINS - 1)[:, None], 1)[:, 0], 0)
        start = low + bin_ * width
        batch = _state(key[0].as_py(), low, start, np.minimum(start + width, high), -(-width // BINS), above + higher)
        return pa.Table.from_batches([batch])

    state = written(queries.mapInArrow(first_range, state_schema), "ranges")
    widest = state.agg(F.max("widest")).first()[0]
    tasks = partitions(spark)

    def pairs(now: DataFrame) -> DataFrame:
        dealt = each.join(queries.join(now.drop("widest"), "q_block"), "q_block")
        return dealt.repartition(tasks, "q_block", "chunk").sortWithinPartitions("q_block", "chunk")

    last_pass = False
    while not last_pass:
        last_pass = widest == 1  # this pass tells single values apart
        sums = summed(pairs(state).mapInArrow(counted, "q_block int, chunk int, counts binary"))
        state = written(sums.groupBy("q_block").cogroup(state.groupBy("q_block")).applyInArrow(narrowed, state_schema), "ranges")
        widest = state.agg(F.max("widest")).first()[0]

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, c_ids, scores = _scores(row)
            value, above = (np.frombuffer(row[x], np.int64)[:, None] for x in ("low", "above"))
            wanted = scores >= np.maximum(value, np.iinfo(np.int64).min + 1)
            q, c = np.nonzero(wanted)
            s = scores[q, c]
            tied = np.flatnonzero(s == value[q, 0])
            starts = np.concatenate([[True], np.diff(q[tied]) > 0]) if len(tied) else np.zeros(0, bool)
            nth = np.arange(len(tied)) - np.maximum.accumulate(np.where(starts, np.arange(len(tied)), 0))
            keep = np.ones(len(q), bool)
            keep[tied] = nth < k - above[q[tied], 0]  # candidates of a block are in the order of ids
            q, c, s = q[keep], c[keep], s[keep]
            yield pa.RecordBatch.from_arrays([pa.array([row["q_block"]] * len(q), pa.int32()), pa.array(q, pa.int32()), pa.array(q_ids[q]), pa.array(c_ids[c]), pa.array(s)], names=["q_block", "q_row", "query_id", "vec_id", "score"])

    best = pairs(state).mapInArrow(kept, "q_block int, q_row int, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
