"""Array and hash functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_array(samples: int, low: float, high: float) -> Column:
    """An array of uniform floats from low to high, drawn anew for each row and element."""
    return F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda _: (F.rand() * (high - low) + low).cast("float"))


def bucket_id(columns: list[str], buckets: int) -> Column:
    """A hash bucket of several columns, 0 to buckets - 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets))


def key_struct(columns: list[str]) -> Column:
    """Several key columns as one value, for display."""
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
