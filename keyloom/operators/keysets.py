"""Splitting rows by a set of keys, and looking up what is known of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for c in keys:
        out = out & F.col(c).eqNullSafe(F.col(f"set_{c}"))
    return out


def _named(key_set: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return key_set.select(*[F.col(c).alias(f"set_{c}") for c in keys], *more)


def with_keys(df: DataFrame, key_set: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is in the set; null is a key like others."""
    return df.join(_named(key_set, keys), _same(keys), "left_semi")


def without_keys(df: DataFrame, key_set: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key isn't in the set."""
    return df.join(_named(key_set, keys), _same(keys), "left_anti")


def look_up(df: DataFrame, directory: DataFrame, keys: list[str], column: str, required: bool = True) -> DataFrame:
    """Add the directory's value for each row's key (one row a key). required: a key that is missing fails the job.

    Spark broadcasts the directory under its own size threshold only.
    """
    joined = df.join(_named(directory, keys, F.col(column).alias("set_value")), _same(keys), "left")
    value = F.col("set_value")
    if required:
        value = F.coalesce(value, F.raise_error(F.lit(f"a key has no {column}")).cast(dict(directory.dtypes)[column]))
    return joined.select(*df.columns, value.alias(column))


def completed_groups(directory: DataFrame) -> DataFrame:
    """complete_iter, keys_count, records_count: the keys that leave together."""
    return directory.groupBy("complete_iter").agg(F.count(F.lit(1)).alias("keys_count"), F.sum("records_count").alias("records_count"))
