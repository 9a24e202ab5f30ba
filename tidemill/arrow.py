"""Small helpers for functions on Arrow data."""

from __future__ import annotations

import pyarrow as pa


def utc(column: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    """Times labelled UTC, as Spark wants them back whatever the session's zone; instants stay."""
    if pa.types.is_timestamp(column.type) and column.type.tz not in (None, "UTC"):
        return column.cast(pa.timestamp("us", "UTC"))
    return column
