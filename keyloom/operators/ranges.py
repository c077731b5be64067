"""Ranges of a sort order by bounds that are fixed first, so that every use of them sees the same rows in each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.operators.row_number import ordering

#: Sampled keys for each range, and the most ranges; together they bound what the driver reads.
SAMPLE, MAX_RANGES = 60, 2_000


@dataclass(frozen=True)
class Ranges:
    """Ascending bounds over the first columns of an order, nulls last. A row's range is the number of bounds that it isn't below.

    That is a function of the row alone: it is the same in each query, each task and each repeated attempt.
    """

    fields: tuple[T.StructField, ...]
    bounds: tuple[tuple, ...]

    @property
    def count(self) -> int:
        return len(self.bounds) + 1

    def _passed(self, width: int, strict: bool) -> Column:
        """How many bounds, cut to their first `width` columns, are at most a row's, or below it; by halving steps."""
        most = len(self.bounds)
        if not most:
            return F.lit(0)
        fields = self.fields[:width]
        plain = width == 1 and all(b[0] is not None for b in self.bounds)
        value = lambda b, k: F.lit(b[k]).cast(fields[k].dataType)
        if plain:
            key, held = F.col(fields[0].name), [value(b, 0) for b in self.bounds]
        else:
            both = lambda null, value, k: (null.alias(f"n{k}"), value.alias(f"v{k}"))
            key = F.struct(*[c for k, f in enumerate(fields) for c in both(F.col(f.name).isNull(), F.col(f.name), k)])
            held = [F.struct(*[c for k in range(width) for c in both(F.lit(b[k] is None), value(b, k), k)]) for b in self.bounds]
        held, steps = F.array(*held), F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])

        # The key comes in by the first state: where only a lambda's body names a column, Spark takes the expression for one without
        # columns, and copies it as a filter to the other side of a join on the range, which has no such column.
        def step(state: Column, more: Column) -> Column:
            at, mine = state["at"], state["key"]
            bound = F.element_at(held, F.least(at + more, F.lit(most)))
            passed = F.coalesce(bound < mine if strict else bound <= mine, F.lit(True))  # a null value is above all
            return F.struct(F.when((at + more <= most) & passed, at + more).otherwise(at).alias("at"), mine.alias("key"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), key.alias("key")), step, lambda state: state["at"])

    def number(self) -> Column:
        """A row's range, 0 to count - 1."""
        return self._passed(len(self.fields), False)

    def is_split(self, width: int) -> Column:
        """Whether rows that equal this one in the first `width` columns of the order may lie in several ranges."""
        return F.lit(False) if width >= len(self.fields) else self._passed(width, True) < self._passed(width, False)


def fix_ranges(df: DataFrame, by: list[str], count: int | None = None) -> Ranges:
    """Bounds that cut the rows to about equal ranges: quantiles of a sample of the columns in `by`.

    Bounds decide how even ranges are, never what is right. They go over as few of the columns as tell them apart; rows that are
    equal in those share a range.
    """
    want = min(MAX_RANGES, count or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(*by)
    total = keys.count()
    share = SAMPLE * want / max(total, 1)
    some = keys if share >= 1 else keys.sample(share, seed=1)
    rows = some.repartition(1).sortWithinPartitions(*ordering(by)).collect()  # SAMPLE * MAX_RANGES rows at most, about
    cuts = [tuple(rows[len(rows) * k // want]) for k in range(1, want)] if rows else []
    width = next((w for w in range(1, len(by)) if len({repr(c[:w]) for c in cuts}) == len(cuts)), len(by))
    return Ranges(tuple(keys.schema.fields[:width]), tuple(c[:width] for c in cuts))
