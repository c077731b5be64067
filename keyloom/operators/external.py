"""Comparison operators: global sort, hash buckets, owner and modulo sharding, pre-sorted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.ranges import fix_ranges
from keyloom.operators.row_number import Order, ordering


def external_sort(df: DataFrame, partition_by: list[str], order_by: list[Order]) -> DataFrame:
    """The rows in one global order of keys and order columns: range exchange and sorted, spilling runs."""
    return df.orderBy(*ordering([*partition_by, *order_by]))


def sorted_position(df: DataFrame, by: list[str], name: str = "position", slices: int | None = None) -> DataFrame:
    """The 1-based place of each row in the global order, without moving all rows to one task.

    Bounds of ranges are fixed first, from a sample. A scan of the columns in `by` alone counts the rows of each range, which
    gives its start; one exchange brings the rows to their ranges, each sorted alone. `df` is read three times
    and has to be the same each time. Rows that are equal in all of `by` lie in one range, in any order.
    """
    ranges = fix_ranges(df, by, slices)
    cut = df.withColumn("kl_range", ranges.number())
    sizes = cut.groupBy("kl_range").agg(F.count(F.lit(1)).alias("kl_n"))
    before = Window.orderBy("kl_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("kl_range", F.coalesce(F.sum("kl_n").over(before), F.lit(0)).alias("kl_start"))
    inside = F.row_number().over(Window.partitionBy("kl_range").orderBy(*ordering(by)))
    dealt = cut.repartitionById(ranges.count, F.col("kl_range")).withColumn("kl_row", inside)
    placed = dealt.join(F.broadcast(starts), "kl_range")  # a row for each range, MAX_RANGES at most
    return placed.withColumn(name, (F.col("kl_row") + F.col("kl_start")).cast("bigint")).drop("kl_range", "kl_row", "kl_start")


def hash_buckets(df: DataFrame, keys: list[str], buckets: int = 25, sort: bool = True) -> DataFrame:
    """Rows in `buckets` hash partitions of the keys, each sorted by the keys alone."""
    out = df.repartition(buckets, *keys)
    return out.sortWithinPartitions(*ordering(keys)) if sort else out


def modulo_shards(df: DataFrame, column: str, shards: int) -> DataFrame:
    """Rows in partition `column` modulo `shards`; null goes to partition 0."""
    return df.repartitionById(shards, F.coalesce(F.pmod(F.col(column), F.lit(shards)), F.lit(0)).cast("int"))


def save_presorted(df: DataFrame, table: str, partition_by: list[str], order_by: list[str], buckets: int) -> None:
    """Save as a bucketed, sorted table; row numbers over it by the same keys need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, *partition_by).sortBy(*partition_by, *order_by).saveAsTable(table)


def append_files(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def discard(df: DataFrame) -> None:
    """Run everything and keep nothing; for timing."""
    df.write.format("noop").mode("overwrite").save()
