"""Best-fit packing of token sequences by a linear grouping scheme."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm.common import written
from pixelframe.llm.tokens import default_path, encoded


def _grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths, the largest first, in groups of equal cardinality: (length that all are rounded up to, runs of lengths)."""
    total = sum(counts.values())
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                room = -(-total // groups)
                out.append((length, []))
            took = min(n, room)
            out[-1][1].append((length, took))
            n, room = n - took, room - took
    return out


def _configurations(sizes: list[int], left: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations (how many of each size) with how often each is used, until nothing is left.

    The largest size left is in each next configuration; a bounded knapsack finds what fills the rest best, the
    larger sizes first among equals. A configuration is used as often as the counts allow, at most to a half of them
    while they are many, so that those after it still find mixed sizes.
    """
    left, out = list(left), []
    for first in range(len(sizes)):
        while left[first]:
            room = capacity - sizes[first]
            reach = np.full(room + 1, -1, np.int64)  # the last size taken to fill exactly so much
            used = np.zeros(room + 1, np.int64)
            reach[0] = len(sizes)
            for k in range(first, len(sizes)):
                s, most = sizes[k], left[k] - (k == first)
                if s > room or most <= 0:
                    continue
                used[:] = 0
                for _ in range(min(most, room // s)):
                    new = np.flatnonzero((reach[s:] < 0) & (reach[:-s] >= 0) & (used[:-s] < most)) + s
                    if not len(new):
                        break
                    reach[new] = k
                    used[new] = used[new - s] + 1
            fill = int(np.flatnonzero(reach >= 0)[-1])
            config = [0] * len(sizes)
            config[first] = 1
            while fill:
                k = int(reach[fill])
                config[k] += 1
                fill -= sizes[k]
            times = min(left[k] // c for k, c in enumerate(config) if c)
            if times == 0:  # counts changed what fits: only the first size
                config, times = [int(k == first) for k in range(len(sizes))], 1
            elif times > 64:
                times = times // 2
            for k, c in enumerate(config):
                left[k] -= c * times
            out.append((config, times))
    return out


def packing_plan(counts: dict[int, int], capacity: int, large: int | None = None, groups: int = 384) -> dict[int, np.ndarray]:
    """Where the items of each length go, from the number of items of each length alone.

    Large lengths are rounded up within groups of equal cardinality, configurations of the few sizes are chosen, and
    the groups' actual items take the configurations' places, the largest first. Then the small lengths, the largest
    first, go where they leave least room; new sequences open when none has room. Sequences that hold the same
    lengths are one class with a count, so the work depends on the capacity, not on how many items there are.

    Returns for each length rows (first rank, items a sequence, first sequence, offset), by rank.
    """
    large = capacity // 4 if large is None else large
    classes: list[tuple[int, int, tuple[tuple[int, int], ...]]] = []  # room, how many, ((length, items a sequence), ...)
    big = {k: n for k, n in counts.items() if k > large and n}
    grouped = _grouped(big, groups)
    sizes: list[int] = []
    queues: list[list[list[int]]] = []
    for size, runs in grouped:
        if sizes and sizes[-1] == size:
            queues[-1] += [list(r) for r in runs]
        else:
            sizes.append(size)
            queues.append([list(r) for r in runs])
    for config, times in _configurations(sizes, [sum(n for _, n in q) for q in queues], capacity):
        places = [k for k, c in enumerate(config) for _ in range(c)]
        taken: list[list[tuple[int, int]]] = []  # runs of lengths for each place, over the copies
        for k in places:
            need, runs = times, []
            while need:
                length, n = queues[k][0]
                took = min(need, n)
                runs.append((length, took))
                need -= took
                queues[k][0][1] -= took
                if took == n:
                    queues[k].pop(0)
            taken.append(runs)
        edges = sorted({e for runs in taken for e in np.cumsum([n for _, n in runs]).tolist()})
        at = 0
        for edge in edges:
            held: dict[int, int] = defaultdict(int)
            for runs in taken:
                end = 0
                for length, n in runs:
                    end += n
                    if end > at:
                        held[length] += 1
                        break
            classes.append((capacity - sum(k * c for k, c in held.items()), edge - at, tuple(held.items())))
            at = edge
    by_room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    for room, n, held in classes:
        by_room[room].append((n, held))
    rooms = np.zeros(capacity + 1, bool)
    rooms[list(by_room)] = True
    for length in sorted((k for k, n in counts.items() if k <= large and n), reverse=True):
        n = counts[length]
        while n:
            fit = np.flatnonzero(rooms[length:])
            room = int(fit[0]) + length if len(fit) else capacity
            if not len(fit):
                each = min(capacity // length, n)
                by_room[capacity].append((max(1, n // each), ()))
            copies, held = by_room[room].pop()
            if not by_room[room]:
                rooms[room] = False
            each = min(room // length, n)
            took = min(copies, n // each)
            by_room[room - each * length].append((took, (*held, (length, each))))
            rooms[room - each * length] = True
            if copies > took:
                by_room[room].append((copies - took, held))
                rooms[room] = True
            n -= took * each
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for room in sorted(by_room):
        for n, held in by_room[room]:
            if not held:
                continue
            offset = 0
            for length, each in held:
                rows[length].append((rank[length], each, sequence, offset))
                rank[length] += n * each
                offset += length * each
            sequence += n
    assert all(rank[k] == n for k, n in counts.items() if n), "every item has a place"
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Pack the token sequences of all documents into as few sequences of at most `capacity` tokens as it can.

    A document's ids end with id 0. Longer ones are cut into pieces of `capacity`, the last may be shorter; others
    stay whole. Tasks tokenize, cut and count; the plan is made from the counts of lengths (at most `capacity`
    numbers, whatever the input), and each piece finds its place by its rank among the pieces of its length.

    Returns a row a piece: id, piece, start, length, ids_crc32, sequence_id, offset. Null or empty text: one piece
    holding the end id. Repeated rows are packed each. Ties (pieces of one length) are ranked by task, then by place
    in the task. Empty table: no rows. Other columns, whatever their names, are ignored. Texts aren't shuffled.
    """
    spark = docs.sparkSession

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for texts, ids, at in encoded(batches, "_text", path or default_path(tokenizer)):
            parts = -(-np.diff(at) // capacity)  # pieces of each text
            row = np.repeat(np.arange(len(parts)), parts)
            number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = at[row] + number * capacity
            end = np.minimum(start + capacity, at[row + 1])
            length = end - start
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist())]
            place = []
            for n in length.tolist():
                place.append(seen[n])
                seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    texts.column(0).take(pa.array(row)),
                    pa.array(number.astype(np.int32)),
                    pa.array(number * capacity),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(row), task, np.int32)),
                    pa.array(place, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    cuts = written(narrow.mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, place long"), "pieces")
    # at most one row for each length and task
    tasks = cuts.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(tasks.withColumn("before", before), "lengths")
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = packing_plan(counts, capacity)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                size = int(length[rows[0]])
                parts = plan[size]
                at = parts[np.searchsorted(parts[:, 0], rank[rows], "right") - 1]
                turn, within = np.divmod(rank[rows] - at[:, 0], at[:, 1])
                sequence[rows] = at[:, 2] + turn
                offset[rows] = at[:, 3] + within * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ranks = cuts.join(starts.drop("n"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranks.mapInArrow(place, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
