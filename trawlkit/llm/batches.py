"""Texts in Arrow batches, in portions of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

# Bytes of text handled at once in a task; a longer text is a portion of its own.
PORTION = 1 << 20


def portions(batches: Iterator[pa.RecordBatch], text: str, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows in runs whose texts hold about size bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, length in enumerate(lengths.tolist()):
            if row > start and held + length > size:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else pa.large_binary()).to_pylist()]
