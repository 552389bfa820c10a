"""Naive Bayes support vectors: a linear model on n-gram indicators scaled by class log-count ratios."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.arrow_text import pieces, text_bytes

BITS = 18
#: A word's pattern: upper-case, lower-case and other letters, digits and each symbol, runs shortened to one or two.
_SHAPES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"(.)\1+"), rb"\1\1"))


class WordFeatures:
    """Indicators of texts: hashed one- and two-word grams, and one- to three-grams of word patterns.

    A pattern tells letters' case, digits and symbols of a word, and whether the word equals the one before it. The
    hashes of recurring words are kept, a bounded number of them.
    """

    def __init__(self, most_words: int = 400_000):
        self.most = most_words
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _code(word: bytes) -> int:
        shape = word[:64]
        for regex, mark in _SHAPES:
            shape = regex.sub(mark, shape)
        return zlib.crc32(word) << 32 | zlib.crc32(shape)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct feature numbers of all texts end to end, and where each text's begin, with the end of the last."""
        cut = [t.split() for t in texts]
        words = set(chain.from_iterable(cut))
        new = words.difference(self.known)
        if new:
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = words
            self.known.update((w, self._code(w)) for w in new)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.uint64, int(sizes.sum()))
        text = np.repeat(np.arange(len(cut), dtype=np.uint64), sizes)
        word, shape = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
        same = np.zeros(len(codes), bool)
        if len(codes) > 1:
            same[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
        shape = shape * np.uint64(2) + same.astype(np.uint64)
        keys = []
        for kind, (grams, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
            if len(grams) < n:
                continue
            end = len(grams) - n + 1
            h = np.full(end, 0x9E3779B97F4A7C15 + kind, np.uint64)
            for k in range(n):
                h = (h ^ grams[k : k + end]) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(29)
            inside = text[:end] == text[n - 1 :]
            keys.append((text[:end] << np.uint64(BITS) | h >> np.uint64(64 - BITS))[inside])
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        starts = np.searchsorted(keys, np.arange(len(cut) + 1, dtype=np.uint64) << np.uint64(BITS))
        return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), starts


@dataclass
class Model:
    ratios: np.ndarray  # class log-count ratio of each feature
    weights: np.ndarray  # hinge-loss weights of scaled, normalised indicators
    bias: float
    slope: float
    offset: float

    def margins(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        r = self.ratios[features]
        total = lambda v: np.add.reduceat(np.append(v, 0.0), starts[:-1]) * (np.diff(starts) > 0)
        norms = np.sqrt(total(r * r))
        return total(r * self.weights[features]) / np.maximum(norms, 1e-9) + self.bias

    def scores(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(features, starts) + self.offset, -30, 30)))


def _dual_descent(features: np.ndarray, starts: np.ndarray, ratios: np.ndarray, y: np.ndarray, cost: float, epochs: int | None, seed: int, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Coordinate descent on the dual of the L2-regularised hinge loss; a constant feature is the bias.

    A coordinate moves to the best value within its box [0, cost] given all others; coordinates that sit at a bound and
    would leave it are passed over until the others have come to rest. It ends when a pass over all coordinates moves none
    by more than the tolerance (a share of cost), or after `epochs` passes if a number is given.
    """
    rng = np.random.default_rng(seed)
    n = len(y)
    rows, values, curve = [], [], np.empty(n)
    for i in range(n):
        idx = features[starts[i] : starts[i + 1]]
        v = ratios[idx]
        v = v / max(float(np.sqrt(v @ v)), 1e-9)
        rows.append(idx)
        values.append(v)
        curve[i] = v @ v + 1.0
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(n)
    everyone = todo = np.arange(n)
    for _ in count() if epochs is None else range(epochs):
        moved, free = 0.0, []
        for i in rng.permutation(todo).tolist():
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / curve[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
            if step or 0 < new < cost:
                free.append(i)
        if moved >= tolerance * cost:
            todo = np.array(free)
        elif len(todo) < n:
            todo = everyone
        else:
            break
    return w, bias


def _log_ratios(features: np.ndarray, starts: np.ndarray, y: np.ndarray) -> np.ndarray:
    label = np.repeat(y > 0, np.diff(starts))
    p = 1.0 + np.bincount(features[label], minlength=1 << BITS)
    q = 1.0 + np.bincount(features[~label], minlength=1 << BITS)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve with the best likelihood of labels given margins, by Newton steps."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    aim = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - aim) * margins).sum(), (p - aim).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margins * margins).sum(), (s * margins).sum()], [(s * margins).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def fit(features: np.ndarray, starts: np.ndarray, labels: np.ndarray, cost: float = 1.0, epochs: int | None = None, folds: int = 4, seed: int = 7) -> Model:
    """Fit the model; scores are calibrated on margins of folds that the fold's model hasn't seen."""
    y = np.where(labels > 0, 1.0, -1.0)
    up = int((y > 0).sum())
    if up in (0, len(y)):  # nothing to tell apart: the score is the share of label 1, smoothed
        share = (up + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share))))

    def part(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = [features[starts[i] : starts[i + 1]] for i in which]
        return np.concatenate([*rows, features[:0]]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)

    fold = np.random.default_rng(seed).permutation(len(y)) % folds
    margins = np.zeros(len(y))
    for k in range(folds):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len({*y[train]}) < 2 or not len(test):
            continue
        f, s = part(train)
        ratios = _log_ratios(f, s, y[train])
        margins[test] = Model(ratios, *_dual_descent(f, s, ratios, y[train], cost, epochs, seed), 1.0, 0.0).margins(*part(test))
    ratios = _log_ratios(features, starts, y)
    w, bias = _dual_descent(features, starts, ratios, y, cost, epochs, seed)
    return Model(ratios, w, bias, *_calibrated(margins, y))


def _with_texts(df: DataFrame, make, schema: str) -> DataFrame:
    """Apply make(piece without texts, texts) to pieces of a table whose last column is _text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = WordFeatures()
        for piece in pieces(batches, "_text"):
            data, offsets = text_bytes(piece.column(piece.num_columns - 1))
            raw, at = data.tobytes(), offsets.tolist()
            yield make(piece, *grams([raw[a:b] for a, b in zip(at, at[1:])]))

    return df.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", most_examples: int = 8_000, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text for quality, having learnt from labelled rows outside the held-out quarter.

    Training rows: labels whose crc32(id as text) mod 4 isn't 2, at most most_examples of them (a documented bound of
    the sample; the smallest hashes of ids). Only texts are inputs. The features of the sample, a few thousand numbers
    a text, go to the driver, which fits the model there, until a whole pass moves no coordinate by a thousandth; scoring is one pass over all texts without an exchange.

    Returns id, held_out, score (0 to 1), predicted (1 if score >= threshold). Null text: empty. Empty texts: the score
    of no features. Ids with several labels: the largest; with several texts: the one with the smallest hash is learnt
    from. The same rows give the same scores however they are dealt out. No labels, or labels of one class: the smoothed share of
    label 1 as every score. Null id: not held out. Repeated rows: scored each. Empty table: no rows. Other columns,
    whatever their names, are ignored. Very long texts are read whole.
    """
    rest = lambda c: F.pmod(F.coalesce(F.crc32(F.encode(F.col(c).cast("string"), "UTF-8")), F.lit(0)), F.lit(4))
    sample = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (rest(id_col) != 2))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most_examples)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # the sample's size is bounded by most_examples; so it may be sent to all tasks
    examples = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    examples = examples.groupBy("_id", "_label").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
    examples = examples.select(F.xxhash64("_id").alias("_order"), F.col("_id").cast("string").alias("_id"), "_label", "_text")

    def features_of(piece: pa.RecordBatch, features: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*piece.columns[:3], pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(features))], names=["_order", "_id", "_label", "features"])

    got = _with_texts(examples, features_of, "_order long, _id string, _label int, features array<int>").toArrow()  # at most most_examples rows
    # folds and steps follow the order of rows, so it is one that doesn't depend on tasks
    got = got.sort_by([("_order", "ascending"), ("_id", "ascending")])
    y = got.column("_label").to_numpy()
    lists = [chunk for chunk in got.column("features").chunks if len(chunk)]
    lengths = np.concatenate([c.value_lengths().to_numpy() for c in lists] or [np.zeros(0, np.int64)])
    flat = np.concatenate([c.flatten().to_numpy() for c in lists] or [np.zeros(0, np.int32)])
    model = fit(flat, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), y)
    ratios, weights, bias, slope, offset = model.ratios.astype(np.float32), model.weights.astype(np.float32), model.bias, model.slope, model.offset

    def scored(piece: pa.RecordBatch, features: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        score = Model(ratios, weights, bias, slope, offset).scores(features, starts).astype(np.float64)
        return pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return _with_texts(texts.select("doc_id", (rest("doc_id") == 2).alias("held_out"), "_text"), scored, f"doc_id {kind}, held_out boolean, score double, predicted int")
