"""Parquet sources and sinks."""

from dialwise.sources.parquet import (
    AmbiguousTable,
    TableNotFound,
    find_table,
    lookup_candidates,
    read_dispatch,
    read_events,
    read_phone_dim,
    write_candidates,
    write_events,
)

__all__ = [
    "AmbiguousTable",
    "TableNotFound",
    "find_table",
    "lookup_candidates",
    "read_dispatch",
    "read_events",
    "read_phone_dim",
    "write_candidates",
    "write_events",
]
