"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalyx.operators.ship import ship

__all__ = ["BATCH_BYTES", "ship", "small_batches", "utf8", "with_text"]

#: Bytes of text that a function works on at once, about; one long text is a batch of its own.
BATCH_BYTES = 4 << 20


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def with_text(docs: DataFrame, carry: list[str], text_col: str) -> tuple[DataFrame, list[str], int]:
    """(columns carry under names of their own, then the text if it is not among them; those names; the text's place)."""
    names = [f"c{k}" for k in range(len(carry))]
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)]
    if text_col in carry:
        return docs.select(*columns), names, carry.index(text_col)
    return docs.select(*columns, F.col(f"`{text_col}`").alias("text")), names, len(names)


def small_batches(batches: Iterator[pa.RecordBatch], at_text: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_BYTES of text; what Arrow no longer needs is given back at the end."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, n * BATCH_BYTES // max(1, batch.column(at_text).nbytes))
        for start in range(0, n, step):
            yield batch.slice(start, step)
    pa.default_memory_pool().release_unused()
