"""Readings of many sources as sorted streams that NumPy kernels take in whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltgrid.session import latest

#: Rows handed to a kernel at a time, rounded up to whole groups.
CHUNK = 60_000


def by_source(df: DataFrame, source: str, order: str) -> DataFrame:
    """All rows of a source in one partition, in order: one shuffle, and a sort that spills."""
    return df.repartition(source).sortWithinPartitions(source, order)


def current(readings: DataFrame, source: str, image: str, columns: list[str]) -> DataFrame:
    """The latest version of each reading, before any grouping by source.

    The versions of a reading meet under (source, image), after a map-side combine. So a source that holds
    a third of all rows is spread over its images here, and only one row per image goes on to the task that
    takes the source as a whole.
    """
    return latest(readings.where(readings[source].isNotNull() & readings[image].isNotNull()), [source, image], columns)


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Tables of about CHUNK rows from a sorted stream, none of which ends within a group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held, rows = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def numbers(column: pa.ChunkedArray | pa.Array, dtype, null) -> np.ndarray:
    """A column as NumPy, with `null` in the place of nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.cast(pa.float64()) if isinstance(null, float) else column
        column = column.fill_null(null)
    return column.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: start of each group, group of each row, place of each row within its group."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(keys)]))
    return start, group, np.arange(len(keys)) - start[group] if len(keys) else group
