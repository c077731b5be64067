"""The query as users write it: datasets, partition columns, order columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.lifecycle import QueryHandle, QueryManager, QueryState
from keyloom.operators.external import discard
from keyloom.operators.row_number import check_query, number_rows, number_rows_by_owner
from keyloom.operators.spread import has_hot_key, number_rows_spread
from keyloom.plans.query_plan import PlanTooLarge, QueryPlan, build_plan
from keyloom.plans.statistics import block_statistics, heaviest_owners
from keyloom.sources.datasets import ORIGIN, DatasetSpec, check_specs, load
from keyloom.streaming.delivery import StoredBatches, batches, packed_batches


@dataclass(frozen=True)
class ExecOptions:
    """Options of a run. Those of the second part are taken so that callers need no change; Spark's own scheduler,
    spilling and sorting do what they were for."""

    output_batch_max_size: int | None = None  # rows; None or 0: about DEFAULT_ROWS of streaming.delivery
    batch_per_key: bool = False
    read_only: bool = False
    query_timeout: float | None = None  # seconds
    max_output_batches_buffer_size: int | None = None  # rows that wait for the reader, about; None or 0: no bound but two partitions
    spread_keys: bool | None = False  # deal large keys over tasks; None: where one is found
    sortmerge_batch_size: int = 10_000
    pessimistic_shuffle_strategy: bool = False

    max_threads: int | None = None
    keep_dumps: bool = False
    parallel_dumping: bool = True
    pandas_sort_algorithm: str = "mergesort"
    use_external_address_mq_messages: bool = False


@dataclass
class OrderedQuery:
    """Number every row of the datasets inside its key.

    memory_limit, in records, is what the plan is held against; Spark's execution spills by itself and needs none. None and 0 mean no limit.
    """

    spark: SparkSession
    datasets: list[DatasetSpec]
    partition_by: list[str]
    order_by: list[str]
    memory_limit: int | None = None
    options: ExecOptions = field(default_factory=ExecOptions)
    heuristic: str = "subsets"
    select: list[str] | None = None
    where: Column | str | None = None
    merge_schema: bool = False
    null_keys: str = "group"
    name: str = "row_number"
    deterministic: bool = False

    def __post_init__(self) -> None:
        self.datasets = check_specs(self.datasets)
        if not self.partition_by:
            raise ValueError("partition_by is empty")

    def table(self, **kwargs: object) -> DataFrame:
        out = load(self.spark, self.datasets, merge_schema=self.merge_schema, **kwargs)
        return out if self.where is None else out.where(self.where)

    def run(self) -> DataFrame:
        """The numbered rows, as a DataFrame. deterministic breaks ties by the file and row that rows were read from."""
        table = self.table(origin=self.deterministic)
        ties = ORIGIN if self.deterministic else []
        if self.select is not None:
            needed = [c for c in [*self.partition_by, *self.order_by, *ties] if c not in self.select]
            table = table.select(*self.select, *dict.fromkeys(needed))
        spread = self.options.spread_keys
        if has_hot_key(table, self.partition_by) if spread is None else spread:
            out = number_rows_spread(table, self.partition_by, [*self.order_by, *ties], self.name, self.null_keys).drop(*ties)
        else:
            out = number_rows(table, self.partition_by, self.order_by, self.name, self.null_keys, ties=ties)
        return out if self.select is None else out.select(*self.select, self.name)

    def run_by_owner(self, max_statistics: int = 2_000_000) -> DataFrame:
        """The same rows, each key in the partition of the node that the plan gives it to.

        With more than max_statistics counts of keys in blocks, owners come from heaviest_owners, without the driver.
        """
        names = sorted({s.node_id for s in self.datasets})
        try:
            owners = self.plan(max_statistics=max_statistics).owners(self.partition_by)
        except PlanTooLarge:
            placed = heaviest_owners(self.statistics(), self.partition_by)
            number = F.coalesce(*[F.when(F.col("primary_node") == n, F.lit(k)) for k, n in enumerate(names)])
            owners = placed.select(*self.partition_by, number.alias("owner"))
        return number_rows_by_owner(self.table(), self.partition_by, self.order_by, owners, max(1, len(names)), self.name)

    def execute(self) -> int | None:
        """Run and discard (read_only), or count the rows handed out. TimeoutError after query_timeout."""
        if not self.options.query_timeout:
            return self._execute()
        handle = QueryManager(self.spark).submit(lambda _: self._execute(), timeout=self.options.query_timeout)
        if handle.wait() is QueryState.TIMEOUT:
            raise TimeoutError(f"the query took more than {self.options.query_timeout} s")
        if handle.error:
            raise handle.error
        return handle.result

    def _execute(self) -> int | None:
        if self.options.read_only:
            discard(self.run())
            return None
        return sum(len(b) for b in self.batches())

    def submit(self, manager: QueryManager, folder: str, query_id: str | None = None) -> QueryHandle:
        """Start the query under a manager: planned where there is a memory limit, run, and its batches written below the folder.

        It is COMPLETED once all rows are made. The handle's result is then a StoredBatches; handle.taken() ends the query as FINISHED. Options'
        query_timeout holds until then.
        """

        def work(handle: QueryHandle) -> StoredBatches:
            if self.memory_limit:
                handle.move(QueryState.PLANNING)
                handle.plan = self.plan()
                handle.check()
                handle.move(QueryState.RUNNING)
            packed = self._packed()
            handle.check()
            return StoredBatches.write(packed, f"{folder}/{handle.query_id}")

        return manager.submit(work, query_id, self.options.query_timeout, completes=True)

    def _packed(self) -> DataFrame:
        numbered, order = self._delivered()
        return packed_batches(numbered, self.partition_by, order, self.options.output_batch_max_size, self.options.batch_per_key)

    def _delivered(self) -> tuple[DataFrame, list[str]]:
        numbered = self.run()
        if missing := [c for c in self.partition_by if c not in numbered.columns]:
            raise ValueError(f"batches need the partition columns; select leaves out {missing}")
        return numbered, [c for c in self.order_by if c in numbered.columns]

    def batches(self) -> Iterator[pd.DataFrame]:
        """pandas batches that never split a key; see streaming.delivery."""
        numbered, order = self._delivered()
        options = self.options
        return batches(numbered, self.partition_by, order, options.output_batch_max_size, options.batch_per_key, options.max_output_batches_buffer_size)

    def statistics(self, block: Column | None = None) -> DataFrame:
        """block_id, node_id, dataset_id, keys, count; a scan of the key columns only."""
        table = self.table(columns=list(dict.fromkeys(self.partition_by)), blocks=True, block=block)
        check_query(table, self.partition_by, [], self.name)
        grouped = block_statistics(table, F.col("block_id"), ["dataset_id", *self.partition_by], F.col("node_id"))
        return grouped

    def plan(self, block: Column | None = None, memory_only: bool = False, max_statistics: int | None = None, **heuristic_options: object) -> QueryPlan:
        """Owners, read order and projected spill, from the key columns. More than max_statistics counts of keys in blocks, where given, raise PlanTooLarge."""
        return build_plan(
            self.spark, self.datasets, self.statistics(block), self.partition_by, self.memory_limit, self.heuristic, memory_only,
            self.options.pessimistic_shuffle_strategy, self.options.sortmerge_batch_size, max_statistics, **heuristic_options,
        )
