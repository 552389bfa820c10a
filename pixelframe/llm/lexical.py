"""Ranked lexical search: blocks of postings with impacts, skipped by MaxScore bounds that joint maxima of term pairs tighten."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm.arrow_text import coded_runs, pieces, text_bytes
from pixelframe.llm.common import ranked, small_batches, written

#: Bytes of terms (digits, letters and all beyond ASCII), and A to Z lowered.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text and documents that a block holds; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
BLOCK_DOCS = 16_384
#: Pairs with up to so many documents of a block keep them as a list; others keep their joint maximum alone.
LISTED = 16

INDEX = "block long, ids array<bigint>, terms binary, ends binary, upto binary, docs binary, impacts binary, maxima binary, pair_terms binary, joint binary, listed binary, listed_docs binary, listed_impacts binary"


def terms_of(column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """The distinct terms of texts, the terms' numbers in order, and the text that each is of."""
    data, offsets = text_bytes(column)
    terms, ids, start = coded_runs(_LOWER[data], offsets, _TERM)
    return terms, ids, np.searchsorted(offsets, start, "right") - 1


def _bytes_of(terms: pa.LargeBinaryArray) -> tuple[bytes, np.ndarray]:
    """Terms end to end, and where each ends."""
    offsets = np.frombuffer(terms.buffers()[1], np.int64, len(terms) + 1, 8 * terms.offset)
    raw = terms.buffers()[2]
    return (raw.to_pybytes()[offsets[0] : offsets[-1]] if raw is not None else b""), (offsets[1:] - offsets[0]).astype("<u4")


def _terms(raw: pa.Scalar, ends: pa.Scalar) -> pa.LargeBinaryArray:
    bounds = np.concatenate([np.zeros(1, np.int64), np.frombuffer(ends.as_buffer(), "<u4").astype(np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), raw.as_buffer()])


def _postings(docs: DataFrame) -> DataFrame:
    """A row a block of documents: ids, lengths, distinct terms, and each term's documents with its counts there."""

    def block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for piece in pieces(batches, "_text", BLOCK_BYTES, BLOCK_DOCS):
            n = piece.num_rows
            terms, ids, of = terms_of(piece.column(1))
            key, tf = np.unique(ids.astype(np.int64) * n + of, return_counts=True)
            raw, ends = _bytes_of(terms)
            upto = np.searchsorted(key, np.arange(1, len(terms) + 1) * n).astype("<u4")
            parts = [raw, ends.tobytes(), upto.tobytes(), (key % n).astype("<u2").tobytes(), tf.astype("<u4").tobytes(), np.bincount(of, minlength=n).astype("<i8").tobytes()]
            ids_list = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), piece.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids_list, *[pa.array([p], pa.binary()) for p in parts]], names=["block", "ids", "terms", "ends", "upto", "docs", "tf", "lengths"])
            number += 1
        pa.default_memory_pool().release_unused()  # the worker lives on

    with small_batches(docs.sparkSession):
        return written(docs.mapInArrow(block, "block long, ids array<bigint>, terms binary, ends binary, upto binary, docs binary, tf binary, lengths binary"), "postings")


def _lengths(postings: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms all have together."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in lengths], pa.int64()), pa.array([int(x.sum()) for x in lengths], pa.int64())], names=["docs", "terms"])

    facts = postings.select("lengths").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return facts[0] or 0, facts[1] or 0


def _dictionary(postings: DataFrame, n_docs: int) -> DataFrame:
    """term, df and weight of all terms, written."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, ends, upto in zip(*batch.columns):
                df = np.diff(np.frombuffer(upto.as_buffer(), "<u4").astype(np.int64), prepend=0)
                whole = pa.RecordBatch.from_arrays([_terms(raw, ends).cast(pa.large_string()).cast(pa.string()), pa.array(df)], names=["term", "df"])
                for at in range(0, whole.num_rows, 50_000):
                    yield whole.slice(at, 50_000)

    found = postings.select("terms", "ends", "upto").mapInArrow(each, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    with small_batches(postings.sparkSession):
        return written(found.withColumn("weight", weight), "dictionary")


@dataclass
class Index:
    """Blocks of postings with impacts (see INDEX), the dictionary (term, df, weight), and the terms that have pairs."""

    blocks: DataFrame
    dictionary: DataFrame
    pair_terms: list[str]


def build_index(docs: DataFrame, pair_terms: int = 96, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index whole texts. Two passes: postings of blocks as read; then, with the counts of all documents known, impacts.

    A block holds for each term its documents, their impacts (the score's part besides the term's weight) and the
    largest of them. The pair_terms terms with the most weight over all documents are paired: for each two of them a block
    holds the largest joint score of a document that has both, and, where these are few, all of them with their joint
    scores. Blocks are rows, so neither documents nor postings are exchanged; only the dictionary's counts are.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    postings = _postings(narrow)
    n_docs, n_terms = _lengths(postings)
    dictionary = _dictionary(postings, n_docs)
    mass = F.col("df") * F.col("weight")
    heavy = dictionary.filter("df > 1").orderBy(mass.desc(), "term").limit(pair_terms).collect()  # pair_terms rows
    names, weights = pa.array([r["term"].encode() for r in heavy], pa.large_binary()), np.array([r["weight"] for r in heavy], np.int64)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                view = lambda c, t: np.frombuffer(get[c][r].as_buffer(), t)  # noqa: B023, E731
                upto, at, tf, lengths = view("upto", "<u4"), view("docs", "<u2"), view("tf", "<u4").astype(np.int64), view("lengths", "<i8")
                mean = 75 + (25 * lengths * n_docs) // max(n_terms, 1)
                impact = (1_000_000_000 * tf) // (1000 * tf + 12 * mean[at])
                first = np.concatenate([upto[:1] * 0, upto[:-1]]) if len(upto) else upto
                maxima = np.maximum.reduceat(impact, first) if len(upto) else impact
                found = pc.index_in(names, value_set=_terms(get["terms"][r], get["ends"][r])).fill_null(-1).to_numpy()
                joint = _joint(len(lengths), [(at[first[x] : upto[x]], impact[first[x] : upto[x]] * w) for x, w in zip(found.tolist(), weights.tolist()) if x >= 0])
                parts = [impact.astype("<i4"), maxima.astype("<i4"), found.astype("<i4"), *joint]
                same = [get[c].slice(r, 1) for c in ("block", "ids", "terms", "ends", "upto", "docs")]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts]], names=[x.split()[0] for x in INDEX.split(", ")])

    with small_batches(docs.sparkSession):
        blocks = written(postings.mapInArrow(weigh, INDEX), "index")
    return Index(blocks, dictionary, [r["term"] for r in heavy])


def _joint(n_docs: int, terms: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joint maxima of all pairs of terms (documents, scores): a matrix; and lists of the rare pairs' documents and scores.

    Lists: the pair's number in the matrix, the document, both terms' score, by pair and document.
    """
    n = len(terms)
    scores = np.zeros((n_docs, n), np.int64)
    for x, (at, s) in enumerate(terms):
        scores[at, x] = s
    has = np.zeros((n_docs, n), bool)
    for x, (at, _) in enumerate(terms):
        has[at, x] = True
    most = np.zeros((n, n), np.int64)
    pair, doc, both = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, (at, s) in enumerate(terms):
        sums = np.where(has[at, x + 1 :], scores[at, x + 1 :] + s[:, None], 0)
        if not sums.size:
            continue
        most[x, x + 1 :] = most[x + 1 :, x] = sums.max(axis=0)
        here = has[at, x + 1 :]
        rare = np.flatnonzero(here.sum(axis=0) <= LISTED)
        y, d = np.nonzero(here[:, rare].T)
        pair.append(x * n + x + 1 + rare[y])
        doc.append(at[d].astype(np.int64))
        both.append(sums[d, rare[y]])
    return most, np.concatenate(pair).astype("<i4"), np.concatenate(doc).astype("<u2"), np.concatenate(both)


class Block:
    """One block of the index, with what a batch of query terms finds in it."""

    def __init__(self, row: dict[str, pa.Scalar], terms: pa.LargeBinaryArray, weights: np.ndarray, pair_of: np.ndarray):
        view = lambda c, t: np.frombuffer(row[c].as_buffer(), t)
        self.ids = row["ids"].values
        self.upto, self.docs, self.impacts = view("upto", "<u4"), view("docs", "<u2"), view("impacts", "<i4")
        self.place = pc.index_in(terms, value_set=_terms(row["terms"], row["ends"])).fill_null(-1).to_numpy()
        self.most = np.where(self.place >= 0, view("maxima", "<i4")[self.place] if len(self.upto) else 0, 0) * weights
        present = view("pair_terms", "<i4") >= 0
        column = np.where(present, np.cumsum(present) - 1, -1)
        self.pair = np.where(pair_of >= 0, column[pair_of] if len(column) else -1, -1)  # a query term's row in the matrix
        n = int(present.sum())
        self.joint = view("joint", np.int64).reshape(n, n)
        self.listed, self.listed_docs, self.listed_scores = view("listed", "<i4"), view("listed_docs", "<u2"), view("listed_impacts", np.int64)

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        p = self.place[term]
        s = self.upto[p - 1] if p else 0
        return self.docs[s : self.upto[p]], self.impacts[s : self.upto[p]]

    def units(self, terms: np.ndarray, times: np.ndarray) -> list[tuple[int, list[int], tuple[np.ndarray, np.ndarray] | None]]:
        """The terms in ones and pairs: (bound, places in terms, the pair's list if it has one), the smallest bound first.

        A pair's bound is its joint maximum or one term's own, whichever is larger: less than both terms' maxima together
        unless some document has both. Pairs are taken by what they save.
        """
        own = self.most[terms] * times
        paired = np.flatnonzero(self.pair[terms] >= 0)
        taken = np.zeros(len(terms), bool)
        out: list[tuple[int, list[int], tuple[np.ndarray, np.ndarray] | None]] = []
        if len(paired) > 1:
            x, y = np.triu_indices(len(paired), 1)
            x, y = paired[x], paired[y]
            p, q = self.pair[terms[x]], self.pair[terms[y]]
            joint = self.joint[p, q]
            # repeats of a term in the query add at most its own maximum each
            together = np.where(joint > 0, joint + (times[x] - 1) * self.most[terms[x]] + (times[y] - 1) * self.most[terms[y]], 0)
            bound = np.minimum(np.maximum(together, np.maximum(own[x], own[y])), own[x] + own[y])
            saved = own[x] + own[y] - bound
            for k in np.argsort(-saved, kind="stable")[: int((saved > 0).sum())].tolist():
                a, b = int(x[k]), int(y[k])
                if taken[a] or taken[b]:
                    continue
                taken[a] = taken[b] = True
                number = min(p[k], q[k]) * len(self.joint) + max(p[k], q[k])
                s, e = np.searchsorted(self.listed, [number, number + 1])
                short = (self.listed_docs[s:e], self.listed_scores[s:e]) if joint[k] == 0 or e > s else None
                out.append((int(bound[k]), [a, b], short if times[a] == times[b] == 1 else None))
        out += [(int(own[k]), [int(k)], None) for k in np.flatnonzero(~taken)]
        return sorted(out, key=lambda u: u[0])

    def best(self, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, k: int, floor: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the block) with a score of at least `floor` that can be among the k best, and the scores.

        total: zeros, a number a document, left as zeros.
        """
        here = (self.place[terms] >= 0) & (weights[terms] > 0)
        terms, times = terms[here], times[here]
        units = self.units(terms, times)
        below = np.cumsum([0, *(u[0] for u in units)])
        rest = int(np.searchsorted(below, floor, "left")) - 1 if floor > 0 else 0
        rest = min(max(rest, 0), len(units))  # units whose bounds together stay under the floor
        touched = []
        for _, places, _ in units[rest:]:
            for p in places:
                at, s = self.list(terms[p])
                total[at] += s * (times[p] * weights[terms[p]])
                touched.append(at)
        if not touched:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        mark = np.zeros(len(total), bool)
        for at in touched:
            mark[at] = True
        doc = np.flatnonzero(mark)
        score = total[doc]
        total[doc] = 0
        for u in range(rest - 1, -1, -1):
            bound, places, short = units[u]
            alive = score + below[u + 1] >= floor
            doc, score = doc[alive], score[alive]
            if short is not None and len(doc):
                # documents outside the pair's list have one of its terms at most
                single = max(int(self.most[terms[p]]) for p in places)
                limit = np.full(len(doc), single, np.int64)
                spot = np.minimum(np.searchsorted(short[0], doc), max(len(short[0]) - 1, 0))
                if len(short[0]):
                    both = short[0][spot] == doc
                    limit[both] = short[1][spot[both]]
                alive = score + limit + below[u] >= floor
                doc, score = doc[alive], score[alive]
            if not len(doc):
                break
            for p in places:
                at, s = self.list(terms[p])
                spot = np.minimum(np.searchsorted(at, doc), len(at) - 1)
                hit = at[spot] == doc
                score[hit] += s[spot[hit]] * (times[p] * weights[terms[p]])
        alive = score >= max(floor, 1)
        doc, score = doc[alive], score[alive]
        if len(doc) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            doc, score = doc[score >= least], score[score >= least]
        return doc, score


def search(index: Index, items: DataFrame, k: int = 20, items_at_once: int = 4096, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each item's k best documents of an index: item_id, rank, doc_id, score.

    Items go through in batches of items_at_once, whose terms are sent to the tasks. A task goes through its blocks, an
    item at a time, and keeps each item's k best so far: what they score is the floor that a document must reach. Of an
    item's terms, single or in pairs, those with the smallest bounds that together stay under the floor aren't looked
    through: their postings are only asked about documents that other terms bring. Three waves (1 of 64 blocks, 1 of 8,
    the rest) bring the floors of all tasks together in between. All documents are ranked; no list is cut.
    """
    spark = items.sparkSession
    placed, n = ranked(items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), [F.col("item_id"), F.xxhash64("_text")], "items", "item")
    id_type = dict(placed.dtypes)["item_id"]

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, ids, of = terms_of(batch.column(1))
            key, times = np.unique(of * max(1, len(terms)) + ids, return_counts=True)
            item, term = batch.column(0).take(pa.array(key // max(1, len(terms)))), terms.take(pa.array(key % max(1, len(terms))))
            yield pa.RecordBatch.from_arrays([item, term.cast(pa.large_string()).cast(pa.string()), pa.array(times, pa.int64())], names=["item", "term", "times"])

    asked = written(placed.select("item", "_text").mapInArrow(split, "item long, term string, times long").join(index.dictionary.select("term", "weight"), "term"), "asked")
    out = None
    for low in range(0, n, items_at_once):
        batch = asked.filter(F.col("item").between(low, low + items_at_once - 1)).orderBy("item", "term").toArrow()
        if not batch.num_rows:
            continue
        found = _waves(index, batch, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    return out.join(placed.select("item", "item_id"), "item").select(F.col("item_id").cast(id_type), "rank", "doc_id", "score")


def _waves(index: Index, asked: pa.Table, k: int) -> DataFrame:
    """The k best of a batch of items (rows item, term, times, weight): item, rank, doc_id, score."""
    spark = index.blocks.sparkSession
    coded = asked["term"].combine_chunks().dictionary_encode()
    terms, number = coded.dictionary.cast(pa.large_binary()), coded.indices.to_numpy()
    weights = np.zeros(len(terms), np.int64)
    weights[number] = asked["weight"].to_numpy()
    pair_of = pc.index_in(terms, value_set=pa.array([t.encode() for t in index.pair_terms], pa.large_binary())).fill_null(-1).to_numpy()
    item = asked["item"].to_numpy()
    cut = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    queries = list(zip(item[cut].tolist(), np.split(number.astype(np.int64), cut[1:]), np.split(asked["times"].to_numpy(), cut[1:])))
    found, floors = None, {}
    for wave in ((0,), tuple(range(1, 8)), tuple(range(8, 64))):
        sent = spark.sparkContext.broadcast((terms, weights, pair_of, queries, dict(floors)))

        def look(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            terms, weights, pair_of, queries, floors = sent.value
            best: dict[int, list[tuple[int, bool, int]]] = {}  # the k best: -score, no id, id
            least = dict(floors)
            for batch in batches:
                for r in range(batch.num_rows):
                    block = Block({n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}, terms, weights, pair_of)
                    total = np.zeros(len(block.ids), np.int64)
                    for q, of, times in queries:
                        doc, score = block.best(of, times, weights, k, least.get(q, 0), total)
                        if not len(doc):
                            continue
                        ids = block.ids.take(pa.array(doc)).to_pylist()
                        both = sorted(best.get(q, []) + [(-s, i is None, i or 0) for s, i in zip(score.tolist(), ids)])[:k]
                        best[q] = both
                        if len(both) == k:
                            least[q] = max(least.get(q, 0), -both[-1][0])
            pa.default_memory_pool().release_unused()
            rows = [(q, None if none else i, -s) for q, some in best.items() for s, none, i in some]
            kinds = (pa.int64(),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=["item", "doc_id", "score"])

        part = index.blocks.filter(F.pmod(F.xxhash64("block"), F.lit(64)).isin(*wave))
        new = part.mapInArrow(look, "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        new = new if found is None else new.unionByName(found.drop("rank"))
        with small_batches(spark):
            found = written(new.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        floors = {r["item"]: r["score"] for r in found.filter(F.col("rank") == k).select("item", "score").collect()}  # a row an item
    return found


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k documents that score highest for each item: item_id, rank, doc_id, score.

    Null and empty texts, and texts without terms: never found; items without known terms: no rows. Repeated rows are
    documents (or items) each. Equal scores: by id, null ids last. Very long texts are whole in one block. Empty tables:
    no rows. Other columns, whatever their names, are ignored.
    """
    return search(build_index(docs, id_col=id_col, text_col=text_col), items, k)
