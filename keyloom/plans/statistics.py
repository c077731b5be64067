"""Statistics of keys and blocks as DataFrames: what the planning tables are made from.

All of them read the key columns only, and aggregate partly before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_statistics(df: DataFrame, block: Column, keys: list[str], node: Column | None = None) -> DataFrame:
    """block_id, [node_id,] keys, count: rows of each key in each block."""
    columns = [block.alias("block_id")] + ([] if node is None else [node.alias("node_id")])
    named = df.select(*columns, *keys)
    return named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("count"))


def partition_directory(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, records_count: all rows of each key."""
    return stats.groupBy(*keys).agg(F.sum("count").alias("records_count"))


def records_per_block(stats: DataFrame) -> DataFrame:
    return stats.groupBy("block_id").agg(F.sum("count").alias("records_count"))


def keys_per_block(stats: DataFrame) -> DataFrame:
    """block_id, keys_count: a row of the statistics is a key of a block."""
    return stats.groupBy("block_id").agg(F.count(F.lit(1)).alias("keys_count"))


def total_records(stats: DataFrame) -> DataFrame:
    return stats.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_records"))


def node_weights(stats: DataFrame, keys: list[str]) -> DataFrame:
    """node_id, keys, count, weight: a key's rows on a node, and their share of the key."""
    local = stats.groupBy("node_id", *keys).agg(F.sum("count").alias("count"))
    whole = F.sum("count").over(Window.partitionBy(*keys))
    return local.withColumn("weight", F.col("count") / whole)


def heaviest_owners(stats: DataFrame, keys: list[str], slack: float = 0.1) -> DataFrame:
    """keys, records_count, primary_node: owners by DataFrame steps alone, for more keys than a driver may hold.

    A key goes to the node with the most of its rows, the smallest name among equals. Nodes that so get more than 1 + slack of
    an even load give keys away, chosen by hash, in the share that they are over; hash also picks the taker among
    the other nodes, in proportion to the room they have. Only the loads, a row for each node, are read by the driver.
    """
    local = stats.groupBy("node_id", *keys).agg(F.sum("count").alias("n"))
    best = local.groupBy(*keys).agg(F.sum("n").alias("records_count"), F.min(F.struct((-F.col("n")).alias("n"), F.col("node_id").alias("node"))).alias("best"))
    owned = best.select(*keys, "records_count", F.col("best.node").alias("node"))
    loads = {r.node_id: r.n for r in stats.select("node_id").distinct().join(owned.groupBy(F.col("node").alias("node_id")).agg(F.sum("records_count").alias("n")), "node_id", "left").collect()}
    loads = {node: n or 0 for node, n in sorted(loads.items())}
    most = (1 + slack) * sum(loads.values()) / max(1, len(loads))
    over = {node: (n - most) / n for node, n in loads.items() if n > most}
    rooms = [(node, most - n) for node, n in loads.items() if n < most]
    if not over or not rooms:
        return owned.withColumnRenamed("node", "primary_node")
    draw = lambda seed: F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11) / float(1 << 53)
    gives = F.coalesce(*[F.when(F.col("node") == node, draw(1) < share) for node, share in over.items()], F.lit(False))
    total, so_far, taker = sum(room for _, room in rooms), 0.0, F.lit(rooms[-1][0])
    steps = []
    for node, room in rooms[:-1]:
        so_far += room / total
        steps.append(F.when(draw(2) < so_far, F.lit(node)))
    return owned.select(*keys, "records_count", F.when(gives, F.coalesce(*steps, taker)).otherwise(F.col("node")).alias("primary_node"))


def block_sets(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block_ids (sorted), records_count: the blocks that hold each key."""
    return stats.groupBy(*keys).agg(
        F.array_sort(F.collect_set("block_id")).alias("block_ids"), F.sum("count").alias("records_count")
    )


def subset_weights(stats: DataFrame, keys: list[str]) -> DataFrame:
    """block_ids, keys_count, records_count, weight: keys grouped by the blocks that hold them, in no order.

    The weight is the group's rows for each block still to read; the planner ranks by weight, then fewer blocks, then the blocks' names.
    """
    sets = block_sets(stats, keys).where(F.size("block_ids") > 0)
    groups = sets.groupBy("block_ids").agg(F.count(F.lit(1)).alias("keys_count"), F.sum("records_count").alias("records_count"))
    return groups.withColumn("weight", F.col("records_count") / F.size("block_ids"))


def completion_sequential(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, records_count, complete_iter when blocks with numeric ids are read one by one in ascending order."""
    return stats.groupBy(*keys).agg(F.sum("count").alias("records_count"), F.max("block_id").alias("complete_iter"))


def buffer_occupancy_sequential(stats: DataFrame, keys: list[str]) -> DataFrame:
    """iter_num, read_count, completed_count, buffered_before, buffered_after of that order, summed over all nodes."""
    read = stats.groupBy(F.col("block_id").alias("iter_num")).agg(F.sum("count").alias("read_count"))
    done = completion_sequential(stats, keys).groupBy(F.col("complete_iter").alias("iter_num")).agg(F.sum("records_count").alias("completed_count"))
    both = read.join(done, "iter_num", "left").withColumn("completed_count", F.coalesce("completed_count", F.lit(0)))
    so_far = Window.orderBy("iter_num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.sum(F.col("read_count") - F.col("completed_count")).over(so_far)
    return both.select("iter_num", "read_count", "completed_count", (after + F.col("completed_count")).alias("buffered_before"), after.alias("buffered_after"))


def io_split(stats: DataFrame, owner: Column) -> DataFrame:
    """iter_num, node_id, own_count, outgoing_count, incoming_count: rows kept, sent and received; an iteration is a block's id."""
    flow = stats.select(F.col("block_id").alias("iter_num"), "node_id", owner.alias("owner_id"), "count")
    flow = flow.groupBy("iter_num", "node_id", "owner_id").agg(F.sum("count").alias("count"))
    own = F.when(F.col("node_id") == F.col("owner_id"), F.col("count")).otherwise(0)
    sent = flow.select("iter_num", "node_id", own.alias("own"), (F.col("count") - own).alias("out"), F.lit(0).cast("bigint").alias("in"))
    got = flow.where("node_id <> owner_id").select("iter_num", F.col("owner_id").alias("node_id"), F.lit(0).cast("bigint").alias("own"), F.lit(0).cast("bigint").alias("out"), F.col("count").alias("in"))
    return sent.unionByName(got).groupBy("iter_num", "node_id").agg(
        F.sum("own").alias("own_count"), F.sum("out").alias("outgoing_count"), F.sum("in").alias("incoming_count")
    )
