"""Cells of text dimensions."""

from __future__ import annotations

from collections import Counter, defaultdict

from pixelframe.llm.sharding import hilbert_shards, text_cells

SCHEMA = "doc_id long, text string, lang string, source string"


def test_one_odd_value_moves_no_others(spark):
    rows = [(i, f"text {i}", "en", f"https://host{i % 50:03}.example") for i in range(5000)]

    def per_shard(rows):
        found = defaultdict(set)
        for r in hilbert_shards(spark.createDataFrame(rows, SCHEMA), n_shards=16).collect():
            found[r.shard].add(r.dim_source)
        return sorted(map(len, found.values()))

    plain, odd = per_shard(rows), per_shard([*rows, (5000, "x", "en", "ftp")])
    # all fifty in each shard where the odd value's prefix decides
    assert max(plain) <= 24 and max(odd) <= max(plain) + 1 and sum(odd) <= sum(plain) + 8


def test_cells_hold_about_as_many_rows(spark):
    values = [f"v{i % 97:02}" for i in range(9700)] + ["v50"] * 5000 + [None] * 300 + [""] * 10
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    bounds = text_cells(rows, "v", 32)
    assert bounds[0] == ("", 0) and [v for v, _ in bounds] == sorted(v for v, _ in bounds)
    counts = Counter()
    for v in values:
        if v is not None:
            counts[max(c for b, c in bounds if b <= v)] += 1
    heavy = max(c for b, c in bounds if b <= "v50")
    assert max(n for c, n in counts.items() if c != heavy) <= 2 * 14710 / 32


def test_nulls_and_single_values(spark):
    rows = [(i, "same", None, None) for i in range(40)] + [(50, None, "en", None)]
    got = hilbert_shards(spark.createDataFrame(rows, SCHEMA), n_shards=4).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [10, 10, 10, 11]
    one = hilbert_shards(spark.createDataFrame([(i, "t", "en", "a") for i in range(9)], SCHEMA), n_shards=2).collect()
    assert sorted(Counter(r.shard for r in one).values()) == [4, 5]
