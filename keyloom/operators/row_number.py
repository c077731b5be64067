"""Row numbers inside partition keys: the engine's query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = str | Column


def ordering(order_by: list[Order]) -> list[Column]:
    """Ascending with nulls last for names; columns that carry a direction stay as they are."""
    return [F.asc_nulls_last(c) if isinstance(c, str) else c for c in order_by]


def check_query(df: DataFrame, partition_by: list[str], order_by: list[Order], name: str) -> None:
    if not partition_by:
        raise ValueError("partition_by is empty")
    missing = [c for c in [*partition_by, *[o for o in order_by if isinstance(o, str)]] if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    if name.lower() in [c.lower() for c in df.columns]:
        raise ValueError(f"the input has a column {name!r}; give the number another name")


def _window(partition_by: list[str], order_by: list[Order], ties: list[Column]) -> Window:
    return Window.partitionBy(*partition_by).orderBy(*(ordering(order_by) + ties or [F.lit(1)]))


def without_null_keys(df: DataFrame, partition_by: list[str]) -> DataFrame:
    """The rows; a job that meets a null key fails."""
    null = F.lit(False)
    for c in partition_by:
        null = null | F.col(c).isNull()
    return df.where(F.when(null, F.raise_error(F.lit("a partition key is null")).cast("boolean")).otherwise(True))


def number_rows(
    df: DataFrame,
    partition_by: list[str],
    order_by: list[Order],
    name: str = "row_number",
    null_keys: str = "group",
    deterministic: bool = False,
    top: int | None = None,
    ties: list[str] = (),
) -> DataFrame:
    """The input's columns and a 1-based bigint number of each row in its key, in ascending order, nulls last.

    One exchange on the keys, one sort, one streaming window: a key may be of any size, as sorted rows spill. null_keys: "group"
    (null is a key like others) or "error". An empty order_by numbers rows in any order. deterministic breaks ties by the
    file and row that a row was read from, of a table that is read from files directly; ties names columns that break them, such as those of
    load(origin=True), which unions and selections keep; they are left out of the result. top keeps the first rows of each key only; Spark then limits each task's rows
    before the exchange, which pays where keys have many rows. spread.number_rows_spread deals a key over tasks.
    """
    check_query(df, partition_by, order_by, name)
    if null_keys not in ("group", "error"):
        raise ValueError("null_keys must be 'group' or 'error'")
    if null_keys == "error":
        df = without_null_keys(df, partition_by)
    last = [F.col("_metadata.file_path"), F.col("_metadata.row_index")] if deterministic else []
    window = _window(partition_by, order_by, ordering(list(ties)) + last)
    numbered = df.withColumn(name, F.row_number().over(window).cast("bigint")).drop(*ties)
    return numbered if top is None else numbered.where(F.col(name) <= top)


def number_rows_by_owner(
    df: DataFrame, partition_by: list[str], order_by: list[Order], owners: DataFrame, n_owners: int, name: str = "row_number"
) -> DataFrame:
    """As number_rows, with keys placed by an owner table (the keys, owner 0 to n_owners - 1).

    Rows go straight to their owner's partition; the window's keys begin with the owner, so that exchange serves it as
    well. The owner table is broadcast below Spark's own threshold only. A key without an owner fails the job.
    """
    check_query(df, partition_by, order_by, name)
    side = owners.select(*[F.col(c).alias(f"own_{c}") for c in partition_by], F.col("owner").cast("int").alias("own_id"))
    same = F.lit(True)
    for c in partition_by:
        same = same & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    owner = F.coalesce("own_id", F.raise_error(F.lit("a key has no owner")).cast("int"))
    placed = df.join(side, same, "left").select(*df.columns, owner.alias("own_id")).repartitionById(n_owners, F.col("own_id"))
    window = _window(["own_id", *partition_by], order_by, [])
    return placed.select(*df.columns, F.row_number().over(window).cast("bigint").alias(name))


def window_sql(view: str, columns: list[str], partition_by: list[str], order_by: list[str], name: str = "row_number") -> str:
    """The query as SQL text with a named window."""
    q = lambda c: f"`{c}`"
    order = ", ".join(f"{q(c)} ASC NULLS LAST" for c in order_by) or "1"
    return (
        f"SELECT {', '.join(map(q, columns))}, CAST(row_number() OVER w AS BIGINT) AS {q(name)} FROM {view} "
        f"WINDOW w AS (PARTITION BY {', '.join(map(q, partition_by))} ORDER BY {order})"
    )
