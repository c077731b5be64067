"""Row numbers of keys that are too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.ranges import fix_ranges
from keyloom.operators.row_number import check_query, ordering, without_null_keys


def number_rows_spread(
    df: DataFrame, partition_by: list[str], order_by: list[str], name: str = "row_number", null_keys: str = "group", slices: int | None = None
) -> DataFrame:
    """As number_rows, with the rows of a large key dealt over several tasks.

    Rows go to ranges of (key, order), so a key lies in neighbouring ranges. Each range numbers its part of a key from 1; the rows
    that a key has in the ranges before are added. Only keys that a bound lies in have several parts, so those
    counts are two rows for each bound at most, whatever the table's size. One exchange moves the rows; the counting
    scans read the key and order columns alone. Rows that are equal in key and order share a range.
    """
    check_query(df, partition_by, order_by, name)
    if not all(isinstance(c, str) for c in order_by):
        raise ValueError("a spread key is ordered by column names")
    if null_keys == "error":
        df = without_null_keys(df, partition_by)
    by = list(dict.fromkeys([*partition_by, *order_by]))
    ranges = fix_ranges(df, by, slices)
    width = len(dict.fromkeys(partition_by))
    cut = df.withColumn("kl_range", ranges.number())
    parts = cut.where(ranges.is_split(width)).groupBy("kl_range", *partition_by).agg(F.count(F.lit(1)).alias("kl_n"))
    before = Window.partitionBy(*partition_by).orderBy("kl_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("kl_range").alias("kl_at"), *[F.col(c).alias(f"kl_{c}") for c in partition_by], F.coalesce(F.sum("kl_n").over(before), F.lit(0)).alias("kl_start")
    )
    inside = F.row_number().over(Window.partitionBy("kl_range", *partition_by).orderBy(*(ordering(order_by) or [F.lit(1)])))
    dealt = cut.repartitionById(ranges.count, F.col("kl_range")).withColumn("kl_row", inside)
    same = F.col("kl_range") == F.col("kl_at")
    for c in partition_by:
        same = same & F.col(c).eqNullSafe(F.col(f"kl_{c}"))
    placed = dealt.join(F.broadcast(starts), same, "left")
    return placed.select(*df.columns, (F.col("kl_row") + F.coalesce("kl_start", F.lit(0))).cast("bigint").alias(name))


def has_hot_key(df: DataFrame, partition_by: list[str], times: float = 3.0) -> bool:
    """Whether a key has more than `times` the rows of an even share of a task; one scan of the key columns."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    return sizes.most is not None and sizes.most > times * sizes.rows / tasks
