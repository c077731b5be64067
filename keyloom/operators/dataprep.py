"""Data preparation: multiplying a dataset, splitting it to files of so many rows, synthetic arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.arrays import uniform_array
from keyloom.operators.external import sorted_position


def column_spans(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the maximum less the minimum of each column."""
    return df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns])


def multiply(df: DataFrame, copies: int, columns: list[str], part: str | None = None) -> DataFrame:
    """The table `copies` times over, the given columns shifted by (span + 1) times the part's number.

    So keys of different parts never meet, and relations inside a part stay. One scan: parts come from an explode of each row,
    and the spans, one row, are read from the driver first. part names a column for the part's number.
    """
    spans = column_spans(df, columns).first()
    out = df.withColumn("kl_part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) if copies > 1 else df.withColumn("kl_part", F.lit(0))
    kinds = dict(df.dtypes)
    shifted = {c: (F.col(c) + F.lit((spans[c] or 0) + 1).cast("bigint") * F.col("kl_part")).cast(kinds[c]) for c in columns}
    out = out.withColumns(shifted)
    return out.withColumnRenamed("kl_part", part) if part else out.drop("kl_part")


def assign_files(df: DataFrame, order_by: list[str], rows_per_file: int, name: str = "file_no") -> DataFrame:
    """The number of the file, from 0, that each row belongs to when sorted rows are cut every rows_per_file."""
    placed = sorted_position(df, order_by, "kl_position")
    return placed.withColumn(name, F.floor((F.col("kl_position") - 1) / rows_per_file).cast("bigint")).drop("kl_position")


def split_files(df: DataFrame, path: str, order_by: list[str], rows_per_file: int, compression: str = "zstd") -> None:
    """Write sorted Parquet files of rows_per_file rows, each in a folder file_no=N."""
    numbered = assign_files(df, order_by, rows_per_file)
    dealt = numbered.repartition("file_no").sortWithinPartitions("file_no", *order_by)
    dealt.write.mode("overwrite").option("compression", compression).partitionBy("file_no").parquet(path)


def add_traces(df: DataFrame, name: str = "TRACE", samples: int = 1501, low: float = -1000, high: float = 1000) -> DataFrame:
    """Add an array of uniform float32 samples, new for each row."""
    return df.withColumn(name, uniform_array(samples, low, high))
