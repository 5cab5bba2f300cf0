"""Helpers for functions that run over Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a function gets at once; a single longer text comes alone.
SLICE_BYTES = 8 << 20


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it while a column has it (Spark doesn't tell case apart)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``max_bytes`` of the given column, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """The texts, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, list]], schema: str, arrow: pa.Schema, text_column: int, max_bytes: int = SLICE_BYTES) -> DataFrame:
    """Apply ``function`` (a slice to a dict of columns) in tasks; ``schema`` and ``arrow`` name the same columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_column, max_bytes):
            out = function(part)
            yield pa.record_batch([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
