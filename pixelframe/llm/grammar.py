"""Token-id files compressed by Re-Pair grammars, with random access to documents and tokens.

A file is a Parquet folder; a row is a block of documents in ascending id order:

| column | what |
| --- | --- |
| part, block | the block's place: blocks in the order (part, block) hold the documents in order |
| base | ids below it are tokens, from it on rules: symbol base + k is rule k |
| n_rules, rules | two symbols a rule, in `width` bits each; a rule names only tokens and earlier rules |
| span, lengths | how many tokens each rule expands to, in `span` bits each |
| width, n_symbols, symbols | bits of a symbol, and the block's symbols, the highest bit first |
| doc_ids | the block's documents |
| doc_symbols | where each document's symbols begin, with the end of the last |
| doc_tokens | the same in tokens |
| n_tokens | tokens of the block |

No rule crosses the end of a document, so a document is decoded from its own symbols.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelframe.llm.common import new_path, partitions
from pixelframe.llm.tokens import default_path, encoded

BLOCK_COLUMNS = "part int, block int, base long, n_rules int, rules binary, span int, lengths binary, width int, n_symbols int, symbols binary, doc_ids array<long>, doc_symbols array<long>, doc_tokens array<long>, n_tokens long"


@dataclass
class Grammar:
    base: int
    rules: np.ndarray  # (rules, 2) symbols
    lengths: np.ndarray  # tokens that each rule expands to
    symbols: np.ndarray
    _made: tuple | None = None

    def spans(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens that each symbol stands for."""
        sizes = np.concatenate([np.ones(1, np.int64), self.lengths.astype(np.int64)])
        return sizes[np.maximum(symbols.astype(np.int64) - self.base + 1, 0)]

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens and then all rules' expansions end to end, and where each symbol's begin and how long they are."""
        if self._made is None:
            out = np.arange(self.base, self.base + len(self.rules))
            while (is_rule := out >= self.base).any():  # a generation of rules at once
                width = np.where(is_rule, 2, 1)
                starts = np.cumsum(width) - width
                new = np.empty(int(width.sum()), np.int64)
                pair = self.rules[out[is_rule] - self.base]
                new[starts[~is_rule]] = out[~is_rule]
                new[starts[is_rule]] = pair[:, 0]
                new[starts[is_rule] + 1] = pair[:, 1]
                out = new
            sizes = self.lengths.astype(np.int64)
            begins = np.concatenate([np.arange(self.base), self.base + np.cumsum(sizes) - sizes])
            self._made = np.concatenate([np.arange(self.base), out]).astype(np.uint32), begins, np.concatenate([np.ones(self.base, np.int64), sizes])
        return self._made

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The tokens of a run of symbols."""
        flat, begins, sizes = self._table()
        size = sizes[symbols]
        ends = np.cumsum(size)
        return flat[np.repeat(begins[symbols] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def token_range(self, start: int, stop: int) -> np.ndarray:
        """Tokens start .. stop - 1 of the block, found by the expansion lengths."""
        ends = np.cumsum(self.spans(self.symbols))
        first = int(np.searchsorted(ends, start, "right"))
        last = int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[first - 1]) if first else 0
        return self.expanded(self.symbols[first:last])[start - skipped : stop - skipped]


def repair(tokens: np.ndarray, base: int, end: int = 0, least: int = 3) -> Grammar:
    """Replace frequent pairs by new symbols until no pair is found `least` times.

    A round counts every pair (hashed to a table, then exactly for the pairs of slots with enough), makes rules of all
    pairs that are at least about a quarter as frequent as the most frequent one, and replaces them from left to right without
    overlap; so the most frequent pairs go first, a batch at a time. Once pairs found `least` times go, a round counts
    those with the last round's symbols alone: all others are rarer. A pair that is found twice costs more as a rule than
    it saves, hence `least`. Pairs with the end id stay as they are.
    """
    if len(tokens) and (tokens.min() < 0 or tokens.max() >= base):
        raise ValueError(f"ids must be from 0 to {base - 1}")
    seq = tokens.astype(np.uint32)
    rules: list[np.ndarray] = []
    made, enough, fresh = 0, max(least, len(seq) >> 10), 0
    while len(seq) > 1:
        # if all pairs found `least` times have been replaced, only pairs with symbols made since can be found so often
        spots = np.flatnonzero((seq[:-1] >= fresh) | (seq[1:] >= fresh)) if fresh else None
        left, right = (seq[:-1], seq[1:]) if spots is None else (seq[spots], seq[spots + 1])
        bits = max(10, min(21, (8 * len(left) // enough).bit_length()))
        slots = lambda u, v: ((u * np.uint32(0x9E3779B1) + v * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.intp)  # noqa: B023, E731
        slot = slots(left, right)
        slot[np.flatnonzero((left == end) | (right == end))] = 1 << bits  # a slot of their own
        in_slot = np.bincount(slot, minlength=(1 << bits) + 1)
        in_slot[-1] = 0
        enough = max(least, int(in_slot.max()) // 4)
        while True:
            at = np.flatnonzero((in_slot >= enough)[slot])
            keys = left[at].astype(np.int64) << 32 | right[at]
            found, counts = np.unique(keys, return_counts=True)
            chosen = found[counts >= enough]
            if len(chosen) or enough == least:
                break
            enough = max(least, enough // 2)
        if not len(chosen):
            break
        if enough == least:
            place, fresh = np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1), base + made
        else:  # of chosen pairs that share a slot one has its turn now
            turn = np.zeros((1 << bits) + 1, np.intp)
            turn[slots((chosen >> 32).astype(np.uint32), chosen.astype(np.uint32))] = np.arange(len(chosen))
            place, fresh = turn[slot[at]], 0
        hit = chosen[place] == keys
        at, place = at[hit], place[hit]
        if spots is not None:
            at = spots[at]
        # of overlapping matches every second one counts, from the left
        opens = np.ones(len(at), bool)
        opens[1:] = np.diff(at) > 1
        run_start = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run_start) % 2 == 0
        at, place = at[take], place[take]
        # pairs that overlaps leave without a place get no rule
        used = np.bincount(place, minlength=len(chosen)) > 0
        names = base + made + np.cumsum(used) - 1
        chosen = chosen[used]
        seq[at] = names[place]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack([chosen >> 32, chosen & ((1 << 32) - 1)], 1))
        made += len(chosen)
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    sizes = np.zeros(len(pairs), np.int64)
    done = 0
    for generation in rules:  # a generation names only tokens and rules of those before it
        known = np.concatenate([np.ones(1, np.int64), sizes[:done]])
        sizes[done : done + len(generation)] = known[np.maximum(generation - base + 1, 0)].sum(1)
        done += len(generation)
    return Grammar(base, pairs, sizes, seq.astype(np.int64))


def packed(numbers: np.ndarray, width: int) -> bytes:
    """Numbers below 2**width, width bits each, the highest first."""
    bits = np.unpackbits(np.ascontiguousarray(numbers.ravel(), ">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :]).tobytes()


def unpacked(raw: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width).reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, 32 - width :] = bits
    return np.packbits(full, axis=1).view(">u4").ravel().astype(np.int64)


def _block_row(part: int, block: int, base: int, ids: list[np.ndarray], sizes: list[np.ndarray], doc_ids: list) -> list:
    tokens = np.concatenate(ids)
    grammar = repair(tokens, base)
    doc_tokens = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    starts = np.concatenate([[0], np.cumsum(grammar.spans(grammar.symbols))])
    doc_symbols = np.searchsorted(starts, doc_tokens)
    width = int(base + len(grammar.rules) - 1).bit_length()
    span = int(grammar.lengths.max(initial=1)).bit_length()
    return [part, block, base, len(grammar.rules), packed(grammar.rules, width), span, packed(grammar.lengths, span), width, len(grammar.symbols), packed(grammar.symbols, width), doc_ids, doc_symbols.tolist(), doc_tokens.tolist(), len(tokens)]


def read_grammar(row: dict) -> Grammar:
    """The grammar of one block's row."""
    n, width = row["n_rules"], row["width"]
    return Grammar(row["base"], unpacked(row["rules"], width, 2 * n).reshape(-1, 2), unpacked(row["lengths"], row["span"], n), unpacked(row["symbols"], width, row["n_symbols"]))


def write_token_files(docs: DataFrame, to: str, tokenizer: str = "byte_bpe_50k.json", vocabulary: int = 50_257, block_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> None:
    """Tokenize documents and write their ids, each document's ended by id 0, as blocks in ascending id order.

    One range exchange by id brings the texts in order; a task tokenizes its range and compresses blocks of about
    block_tokens (a block holds whole documents, so a longer document is a block of its own). Null ids come first.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n = partitions(docs.sparkSession)
    ordered = narrow.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("part", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("n_rules", pa.int32()), ("rules", pa.binary()), ("span", pa.int32()), ("lengths", pa.binary()), ("width", pa.int32()), ("n_symbols", pa.int32()), ("symbols", pa.binary())]
            + [(k, pa.list_(pa.int64())) for k in ("doc_ids", "doc_symbols", "doc_tokens")]
            + [("n_tokens", pa.int64())]
        )
        part, block, size = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list = []

        def flush() -> pa.RecordBatch:
            row = _block_row(part, block, vocabulary, held, sizes, names)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for piece, ids, at in encoded(batches, "_text", path or default_path(tokenizer)):
            doc_ids, first = piece.column(0).to_pylist(), 0
            while first < len(doc_ids):
                # documents up to the one that fills the block
                last = min(len(doc_ids), max(first + 1, int(np.searchsorted(at, at[first] + block_tokens - size))))
                held.append(ids[at[first] : at[last]])
                sizes.append(np.diff(at[first : last + 1]))
                names += doc_ids[first:last]
                size += int(at[last] - at[first])
                first = last
                if size >= block_tokens:
                    yield flush()
                    block, size, held, sizes, names = block + 1, 0, [], [], []
        if names:
            yield flush()

    ordered.mapInArrow(blocks, BLOCK_COLUMNS).write.parquet(to)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row a document from the files alone: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32.

    Each document is decoded from its own symbols. What stands before a block comes from the counts of blocks, summed
    by part (one row each) and then within the part; symbols aren't shuffled.
    """
    files = spark.read.schema(BLOCK_COLUMNS).parquet(folder)
    sizes = files.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row a part
    before, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in parts):
        before.append((part, total))
        total += n
    part_start = spark.createDataFrame(before or [(-1, 0)], "part int, part_start long")
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("block_start", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0))).join(F.broadcast(part_start), "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("start"))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                grammar = read_grammar(row)
                # whole documents at a time, so that what is expanded at once stays small
                at, docs = row["doc_symbols"], len(row["doc_ids"])
                lengths, crcs, first = [], [], 0
                while first < docs:
                    last = first + 1
                    while last < docs and at[last + 1] - at[first] <= 1 << 18:
                        last += 1
                    tokens = grammar.expanded(grammar.symbols[at[first] : at[last]]).astype("<u4")
                    bounds = [t - row["doc_tokens"][first] for t in row["doc_tokens"][first : last + 1]]
                    for a, b in zip(bounds, bounds[1:]):
                        crcs.append(zlib.crc32(tokens[a:b].tobytes()))
                        lengths.append(b - a)
                    first = last
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * docs, pa.int32()), pa.array([row["block"]] * docs, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["doc_tokens"][:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    rows = files.mapInArrow(decode, "part int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files_roundtrip(docs: DataFrame, **options) -> DataFrame:
    """Write all documents' ids as compressed files in the shared folder and read them back.

    Null or empty text: the end id alone. Null id: before all others. Repeated rows: each is written; rows of one id
    stand in any order. Empty table: no rows. Other columns, whatever their names, are ignored.
    """
    to = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, to, **options)
    return read_token_files(docs.sparkSession, to)
