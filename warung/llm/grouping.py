"""Walking sorted Arrow batches group by group, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def column_array(column: pa.Array) -> np.ndarray:
    """The column as numpy; binaries of one width as rows of bytes."""
    if pa.types.is_binary(column.type):
        found = column.to_pylist()
        return np.frombuffer(b"".join(found), np.uint8).reshape(len(found), -1) if found else np.empty((0, 0), np.uint8)
    return column.to_numpy(zero_copy_only=False)


def ragged_array(column: pa.Array) -> np.ndarray:
    """Binaries of any width as an array of bytes objects."""
    out = np.empty(len(column), dtype=object)
    out[:] = column.to_pylist()
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], ragged: tuple[str, ...] = ()) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each run of equal keys (rows come sorted by them); the
    ``ragged`` columns hold binaries of any width."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: (ragged_array if n in ragged else column_array)(batch.column(n)) for n in batch.schema.names}
        if rest is not None:
            now = {n: np.concatenate([rest[n], now[n]]) for n in now}
        size = len(now[keys[0]])
        change = np.zeros(size - 1, dtype=bool)
        for k in keys:
            change |= now[k][1:] != now[k][:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield {n: v[a:b] for n, v in now.items()}
        rest = {n: v[edges[-1]:] for n, v in now.items()}
    if rest is not None:
        yield rest
