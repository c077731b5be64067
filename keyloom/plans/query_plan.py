"""The plan of a query as tables: datasets, blocks, partitions (keys), sequence, iterations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.plans.block_order import Block, Step, order_blocks
from keyloom.plans.large import SPILLED, LargePlan
from keyloom.plans.ownership import assign_owners, in_key_order
from keyloom.plans.spill import NodeRound, simulate
from keyloom.sources.datasets import DatasetSpec

TABLES = ("datasets", "blocks", "partitions", "sequence", "iterations")


#: Counts of keys in blocks up to which the driver holds them all; more are planned from tables.
IN_MEMORY = 2_000_000


class PlanTooLarge(RuntimeError):
    """The key statistics are more than the caller allows."""


@dataclass
class QueryPlan:
    """Plan tables as DataFrames, and the lists that they were made from; without steps where the keys are too many for the driver."""

    datasets: DataFrame
    blocks: DataFrame
    partitions: DataFrame
    sequence: DataFrame
    iterations: DataFrame
    steps: list[Step] | None = None
    rounds: list[NodeRound] | None = None

    @property
    def planned_spill(self) -> int:
        """Records that the plan writes to spill files, all in all."""
        return self.iterations.agg(F.coalesce(F.sum("write_dump"), F.lit(0))).first()[0]

    def owners(self, keys: list[str]) -> DataFrame:
        """keys, owner: nodes by their rank, as number_rows_by_owner takes them."""
        nodes = [r.primary_node for r in self.partitions.select("primary_node").distinct().orderBy("primary_node").collect()]
        number = F.coalesce(*[F.when(F.col("primary_node") == n, F.lit(k)) for k, n in enumerate(nodes)]) if nodes else F.lit(0)
        return self.partitions.select(*keys, number.alias("owner"))

    def save(self, folder: str) -> None:
        for table in TABLES:
            getattr(self, table).write.mode("overwrite").parquet(f"{folder}/{table}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> QueryPlan:
        return QueryPlan(*[spark.read.parquet(f"{folder}/{table}") for table in TABLES])


class LaterPlan(QueryPlan):
    """A plan made from tables. Blocks and sequence are there at once; owners and rounds, most of the work, are made when first asked for, or under a limit at once."""

    __repr__ = object.__repr__

    def __init__(self, spark: SparkSession, specs: list[DatasetSpec], tables: LargePlan, limits: tuple, heuristic: str, **options: object) -> None:
        self._spark, self._tables, self._limits = spark, tables, limits
        sequence = tables.sequence(heuristic, **options)
        blocks = [(b.block_id, b.dataset_id, b.node_id, n, tables.scores[b.block_id], number) for b, n, number in zip(tables.blocks, tables.records, tables.rounds, strict=True)]
        self.datasets, self.blocks, self.sequence = _datasets(spark, specs), spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(sequence, SEQUENCE)
        if limits[0]:
            self.rounds  # noqa: B018

    @cached_property
    def _owned(self) -> LargePlan:
        self._tables.assign()
        return self._tables

    @cached_property
    def rounds(self) -> list[NodeRound]:
        return self._owned.simulate(*self._limits)

    @cached_property
    def partitions(self) -> DataFrame:
        return self._owned.partitions()

    @cached_property
    def iterations(self) -> DataFrame:
        return _iterations(self._spark, self.rounds)


def collect_blocks(stats: DataFrame, keys: list[str], max_statistics: int = 2_000_000) -> list[Block]:
    """Blocks with their key counts from (block_id, node_id, [dataset_id,] keys, count), sorted by name.

    More than max_statistics rows raise PlanTooLarge.
    """
    rows = stats.limit(max_statistics + 1).collect()
    if len(rows) > max_statistics:
        raise PlanTooLarge(f"more than {max_statistics} counts of keys in blocks")
    found: dict[str, tuple[str, str, dict]] = {}
    for row in rows:
        dataset = row["dataset_id"] if "dataset_id" in stats.columns else ""
        _, _, counts = found.setdefault(str(row["block_id"]), (str(row["node_id"]), dataset, {}))
        counts[tuple(row[k] for k in keys)] = row["count"]
    return [Block(i, node, counts, dataset) for i, (node, dataset, counts) in sorted(found.items())]


def build_plan(
    spark: SparkSession,
    specs: list[DatasetSpec],
    stats: DataFrame,
    keys: list[str],
    memory_limit: int | None = None,
    heuristic: str = "subsets",
    memory_only: bool = False,
    pessimistic: bool = False,
    merge_batch: int = 10_000,
    max_statistics: int | None = None,
    in_memory: int = IN_MEMORY,
    **options: object,
) -> QueryPlan:
    """Owners, read order and spill schedule from the statistics (block_id, node_id, keys, count).

    More than in_memory rows of statistics are planned from tables in the shared folder, with the same result; more than max_statistics, where given,
    raise PlanTooLarge.
    """
    kept = max_statistics is None and stats.storageLevel == StorageLevel.NONE
    if kept:
        stats.persist(StorageLevel.DISK_ONLY)  # counted first, then read again
    try:
        large = LargePlan(spark, stats, keys, in_memory) if max_statistics is None and stats.count() > in_memory else None
        blocks = [] if large else collect_blocks(stats, keys, in_memory if max_statistics is None else max_statistics)
    finally:
        if kept:
            stats.unpersist()
    if large:
        return LaterPlan(spark, specs, large, (memory_limit, memory_only, pessimistic, merge_batch), heuristic, **options)
    by_node: dict[str, dict] = {}
    sizes: dict = {}
    for block in blocks:
        local = by_node.setdefault(block.node_id, {})
        for key, n in block.counts.items():
            local[key] = local.get(key, 0) + n
            sizes[key] = sizes.get(key, 0) + n
    owners = assign_owners(by_node)
    steps = list(order_blocks(blocks, heuristic, **options))
    rounds, spills = simulate(blocks, steps, owners, memory_limit, memory_only, pessimistic, merge_batch)
    complete = {key: step.iter_num for step in steps for key in step.completed}
    read_at = {s.block_id: s for s in steps}
    types = {f.name: f for f in stats.schema}
    key_fields = [T.StructField(k, types[k].dataType) for k in keys]
    partitions = [
        (*key, sizes[key], owners[key], complete[key], sorted(spills.get(key, {}).items())) for key in sorted(sizes, key=in_key_order)
    ]
    partition_type = T.StructType(
        [*key_fields, *T.StructType.fromDDL(f"records_count bigint, primary_node string, complete_iteration bigint, dump_iters_count {SPILLED}")]
    )
    return QueryPlan(
        _datasets(spark, specs),
        spark.createDataFrame([(b.block_id, b.dataset_id, b.node_id, b.records, read_at[b.block_id].score, read_at[b.block_id].iter_num) for b in blocks], BLOCKS),
        spark.createDataFrame(partitions, partition_type),
        spark.createDataFrame(
            [(place, s.iter_num, s.block_id, s.score, len(s.completed), s.records_completed, s.held_before, s.held_after) for place, s in enumerate(steps)], SEQUENCE
        ),
        _iterations(spark, rounds),
        steps,
        rounds,
    )


BLOCKS = "block_id string, dataset_id string, node_id string, size_in_records bigint, score double, read_on_iteration bigint"
SEQUENCE = (
    "position bigint, iter_num bigint, block_id string, block_score double, partitions_completed_count bigint, "
    "records_completed_count bigint, buffer_before_count bigint, buffer_records_count bigint"
)
ITERATIONS = (
    "iter_num bigint, node_id string, block_id string, block_size_in_records bigint, input_shuffle_count bigint, "
    "output_shuffle_count bigint, use_direct_buffer_return boolean, sortmerge_partitions_read_to_return_data array<bigint>, "
    "read_dump bigint, write_dump bigint, returned_count bigint, peak_buffer_size bigint"
)


def _datasets(spark: SparkSession, specs: list[DatasetSpec]) -> DataFrame:
    return spark.createDataFrame([(s.id, s.path, s.node_id, s.dataset_type) for s in specs], "dataset_id string, path string, node_id string, dataset_type string")


def _iterations(spark: SparkSession, rounds: list[NodeRound]) -> DataFrame:
    return spark.createDataFrame(
        [
            (r.iter_num, r.node_id, r.block_id, r.block_size, r.incoming, r.outgoing, r.direct_return, r.merge_emits, r.read_dump, r.write_dump, r.returned, r.peak)
            for r in rounds
        ],
        ITERATIONS,
    )
