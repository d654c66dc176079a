"""Map expressions: merging, renaming, ordered rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(first: Column, second: Column) -> Column:
    """Entries of both maps; of one key the second's value stays.  A null map counts as empty."""
    empty = F.map_filter(F.coalesce(first, second), lambda k, v: F.lit(False))
    a, b = F.coalesce(first, empty), F.coalesce(second, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def prefixed(entries: Column, prefix: str) -> Column:
    """Keys with a prefix."""
    return F.transform_keys(entries, lambda k, v: F.concat(F.lit(prefix), k))


def rendered(entries: Column, pair: str = "=", between: str = ";") -> Column:
    """``key=value`` in the order of keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(e["key"], F.lit(pair), F.coalesce(e["value"].cast("string"), F.lit("")))), between)
