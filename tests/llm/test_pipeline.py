"""The pipeline's stages, each judged on its own input."""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from test_operators import SCHEMA, WORD, _base, _classes, _ids, _spans, _targets, edited, prose  # noqa: E402

import corpus_pipeline  # noqa: E402
from pixelframe.llm.secrets import redacted  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    base = prose(11, 160)
    rows = [(i, prose(100 + i, 60 + i), "en", "ab"[i % 2], 1) for i in range(40)]
    rows += [(50, base, "en", "a", 1), (51, base, "en", "b", 1), (52, edited(base, [70]), "en", "a", 1), (53, base, "en", "a", 1)]
    rows += [(60, "too short", "en", "a", 1), (61, None, "en", "a", 1), (62, "again and " * 60, "en", None, 1)]
    rows += [(70, prose(12, 90) + " password = hunter2hunter2", "en", None, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    docs, out = spark.read.parquet(str(folder / "documents.parquet")), {"start": rows}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out[name] = [tuple(r) for r in docs.collect()]
        out[f"{name} columns"] = docs.columns
    out["run"] = corpus_pipeline.run(spark, str(folder)).count()
    return out


def test_columns_are_kept(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[f"{name} columns"] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_rules(stages):
    good = [r for r in stages["start"] if not (lambda n, _a, _b, _c, rep: n < 50 or 100 * rep > 50 * n)(*_base(r[1]))]
    assert sorted(map(repr, stages["quality_rules"])) == sorted(map(repr, good))


def test_near_dedup(stages):
    want = {min(c) for c in _classes(stages["quality_rules"])}
    left = stages["near_dedup"]
    assert sorted(r[0] for r in left) == sorted(want)
    assert set(left) <= set(stages["quality_rules"])


def test_secret_scan(stages):
    before = {r[0]: r for r in stages["near_dedup"]}
    assert len(stages["secret_scan"]) == len(before)
    for r in stages["secret_scan"]:
        spans = ",".join(f"x:{a}:{b}" for a, _, b in _spans(before[r[0]][1]))
        assert r == (r[0], redacted(before[r[0]][1], spans), *before[r[0]][2:])
    assert "hunter2" not in {r[0]: r for r in stages["secret_scan"]}[70][1]


def test_mixing(stages):
    before = {r[0]: r for r in stages["secret_scan"]}
    copies = Counter(stages["mixing"])
    assert set(copies) <= set(before.values()) and max(copies.values()) <= 3
    words = {k: len(WORD.findall(r[1])) for k, r in before.items()}
    size, taken = Counter(), Counter()
    for k, r in before.items():
        size[r[3]] += words[k]
    for r, n in copies.items():
        taken[r[3]] += n * words[r[0]]
    for s, t in _targets(size).items():
        assert abs(taken[s] - t) <= max(60, 0.03 * t)


def test_packing(stages):
    want = Counter()
    for r in stages["mixing"]:
        x = np.array(_ids(r[1], "word_bpe_49k.json"), "<u4")
        for k in range(0, len(x), 2048):
            want[(r[0], k // 2048, len(x[k : k + 2048]), zlib.crc32(x[k : k + 2048].tobytes()))] += 1
    got = Counter((r[0], r[1], r[3], r[4]) for r in stages["packing"])
    assert got == want and stages["run"] == len(stages["packing"])
