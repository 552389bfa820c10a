"""Collocations against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelframe.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows: list[tuple], top: int, least: int) -> list[tuple]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^\x20\x09]+", piece)
            for m in (1, 2, 3):
                counts[lang or "und" if lang is None else lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        candidates = {k: a for k, a in f.items() if len(k) > 1 and a >= least}
        best = []
        for k, a in candidates.items():
            if any(len(o) > len(k) and k in (o[:2], o[1:]) and 100 * v >= 50 * a for o, v in candidates.items()):
                continue
            cuts = [(10**6 * a * a // (f[k[:i]] * f[k[i:]]), i, f[k[:i]], f[k[i:]]) for i in range(1, len(k))]
            score, _, left, right = min(cuts)
            best.append((-score, -a, " ".join(k).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["É", "ß", "Two", "TWO", "x\x0by", "a"]
    out = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?"]) for _ in range(rng.randrange(60)))
        out.append((i, text, rng.choice(["en", "de", None, "und", ""])))
    out += [(None, "new york city " * 30, "en"), (7, "new york " * 500, "de"), (7, "new york " * 500, "de"), (8, None, "en"), (9, "", None), (10, " \t\n..", "fr"), (11, "the " * 9000, "en")]
    return out


@pytest.mark.parametrize("top,least", [(2000, 10), (7, 3)])
def test_all_phrases(spark, rows, top, least):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("fp", "f", "a", "phrase", "score", "n", "bucket", "w", "k", "rank", "_lang", "_text", "word"):
        docs = docs.withColumn(c, F.lit("x"))
    got = C.collocations(docs.repartition(3), top=top, least=least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, top, least)


def test_full_sieves_and_small_loads(spark, rows, monkeypatch):
    """A sieve that lets nearly all pass, and tasks that send often, change nothing."""
    monkeypatch.setattr(C, "HELD", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in C.collocations(docs, least=4, sieve_bits=15).collect()) == plain(rows, 2000, 4)


def test_equal_fingerprints_are_told_apart(spark, rows, monkeypatch):
    """All phrases share eight fingerprints: their texts still tell them apart."""
    monkeypatch.setattr(C.Fingerprints, "of", lambda self, sums, start, end: C.mixed((sums[end] - sums[start]) * self.back[start]) & np.uint64(7 << 61))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in C.collocations(docs, least=4).collect()) == plain(rows, 2000, 4)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_counts_beyond_64_bits(spark):
    big = 3_000_000_000_000
    found = spark.createDataFrame([("en", "a b", big, ["a", "b"])], "lang string, phrase string, a long, w array<string>")
    words = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 1)], "lang string, word string, f long")
    got = C._ranked(found, words, words.groupBy("lang").agg(F.sum("f").alias("n")), 5).first()
    assert got.score == 10**6 * big * big // ((big + 7) * (big + 1))


def test_fingerprints_don_t_depend_on_place():
    prints = C.Fingerprints()
    words = pa.array([b"ab", b"", b"abc", b"ab"], pa.large_binary())
    codes = prints.words(words)
    assert codes[0] == codes[3] and len(set(codes.tolist())) == 3
