"""Whole groups of sorted rows from Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by keys; the last group of a batch waits for the next."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if waiting:
            end = waiting[-1].slice(waiting[-1].num_rows - 1)
            if any(c[0] != end.column(end.schema.get_field_index(k))[0].as_py() for c, k in zip(columns, keys)):
                edge = np.concatenate([[0], edge])
        if len(edge):
            cut = int(edge[-1])
            done = pa.Table.from_batches([*waiting, batch.slice(0, cut)])
            if done.num_rows:
                yield done
            waiting = [batch.slice(cut)]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)
