"""Ranked search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.llm import lexical as X

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
terms = lambda t: TERM.findall((t or "").translate(LOWER))


def plain(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, c, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    words = [f"t{i}" for i in range(80)] + ["É", "ß", "Two", "TWO", "x_y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(900)]
    out += [(None, "t3 t4 t70"), (5, "t1 t2 t3"), (5, "t1 t2 t3"), (6, "t1 t2 t3"), (7, None), (8, ""), (9, " .,;"), (10, "t79 " * 5000 + "long " * 3)]
    return out


@pytest.fixture(scope="module")
def items():
    rng = random.Random(9)
    out = [(i, " ".join(f"t{min(int(rng.expovariate(0.05)), 79)}" for _ in range(rng.randrange(1, 25)))) for i in range(60)]
    return out + [(100, None), (101, ""), (102, "unknown words"), (103, "t1 T1 t1, t2"), (103, "t1 T1 t1, t2"), (None, "É two")]


@pytest.mark.parametrize("k,docs_a_block,at_once", [(20, 16_384, 4096), (3, 20, 25)])
def test_all_documents_are_ranked(spark, docs, items, monkeypatch, k, docs_a_block, at_once):
    monkeypatch.setattr(X, "BLOCK_DOCS", docs_a_block)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for c in ("block", "item", "term", "score", "rank", "df", "_id", "_text", "item_id"):
        table = table.withColumn(c, F.lit("x"))
    got = X.search(X.build_index(table), spark.createDataFrame(items, "item_id long, text string"), k, at_once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, items, k)


def test_empty_tables(spark, docs, items):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(items, "item_id long, text string")
    assert X.ranked_search(none, some).collect() == []
    assert X.ranked_search(spark.createDataFrame(docs[:5], "doc_id long, text string"), some.limit(0)).collect() == []


def _block(spark, docs):
    index = X.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    row = index.blocks.toArrow().combine_chunks().to_batches()[0]
    known = {r["term"]: r["weight"] for r in index.dictionary.collect()}
    names = sorted(known)
    raw = X.pa.array([n.encode() for n in names], X.pa.large_binary())
    weights = np.array([known[n] for n in names], np.int64)
    pair_of = X.pc.index_in(raw, value_set=X.pa.array([t.encode() for t in index.pair_terms], X.pa.large_binary())).fill_null(-1).to_numpy()
    return X.Block({n: row.column(i)[0] for i, n in enumerate(row.schema.names)}, raw, weights, pair_of), names, weights


def test_bounds_hold_and_pairs_tighten_them(spark):
    """No document scores above its units' bounds; rare pairs' bounds are under both terms' maxima together."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices([f"t{k}" for k in range(40)], k=6))) for i in range(300)]
    block, names, weights = _block(spark, docs)
    scores: dict[int, dict[int, int]] = defaultdict(dict)
    for t in range(len(names)):
        if block.place[t] >= 0:
            for d, s in zip(*block.list(t)):
                scores[int(d)][t] = int(s) * int(weights[t])
    tighter = 0
    for trial in range(50):
        of = np.array(sorted(rng.sample(range(len(names)), 6)))
        times = np.array([rng.choice([1, 1, 3]) for _ in of])
        units = block.units(of, times)
        assert sorted(p for _, places, _ in units for p in places) == list(range(len(of)))
        for bound, places, short in units:
            real = [sum(s.get(of[p], 0) * times[p] for p in places) for s in scores.values()]
            assert max(real) <= bound
            tighter += len(places) == 2 and bound < sum(block.most[of[p]] * times[p] for p in places)
            if short is not None:
                both = {d: sum(s[of[p]] for p in places) for d, s in scores.items() if all(of[p] in s for p in places)}
                assert dict(zip(short[0].tolist(), short[1].tolist())) == both
    assert tighter > 50


def test_a_floor_skips_documents_but_no_result(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices([f"t{k}" for k in range(60)], [1 / (k + 1) for k in range(60)], k=12))) for i in range(500)]
    block, names, weights = _block(spark, docs)
    total = np.zeros(len(docs), np.int64)
    for trial in range(40):
        of = np.array(sorted(rng.sample([t for t in range(len(names))], 8)))
        times = np.ones(len(of), np.int64)
        doc, score = block.best(of, times, weights, 10, 0, total)
        every = sorted(zip((-score).tolist(), doc.tolist()))[:10]
        assert not total.any()
        floor = -every[-1][0]
        doc, score = block.best(of, times, weights, 10, floor, total)
        assert sorted(zip((-score).tolist(), doc.tolist()))[:10] == every
        assert not total.any() and (score >= floor).all()
