"""Names of the library's queries and the SQL that each can be held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.dataprep import add_traces, assign_files, column_spans, multiply
from keyloom.operators.dataprep import split_files as write_files
from keyloom.operators.external import external_sort, hash_buckets, modulo_shards, sorted_position
from keyloom.operators.keysets import completed_groups, look_up, with_keys, without_keys
from keyloom.operators.row_number import number_rows, number_rows_by_owner, window_sql
from keyloom.operators.spread import number_rows_spread
from keyloom.plans import statistics
from keyloom.plans.query_plan import QueryPlan, build_plan
from keyloom.session import shared_folder
from keyloom.sources.datasets import DatasetSpec, block_files, list_files, load, read_blocks, shard_files
from keyloom.streaming.delivery import packed_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A total order of lineitem's rows.
L4 = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
L4_SQL = ", ".join(L4)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def spec(sf_dir: str, table: str, node: str = "local") -> DatasetSpec:
    return DatasetSpec(f"{sf_dir}/{table}.parquet", node_id=node)


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return load(spark, [spec(sf_dir, name)], columns)


# Row numbers


@query(f"SELECT {L4_SQL}, row_number() OVER (PARTITION BY l_suppkey ORDER BY {L4_SQL}) AS row_number FROM lineitem")
def rn_single_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(table(spark, sf_dir, "lineitem", L4), ["l_suppkey"], L4)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS row_number FROM lineitem")
def rn_inverse_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(table(spark, sf_dir, "lineitem", L4), ["l_orderkey"], L4[1:])


@query(f"SELECT l_shipdate, {L4_SQL}, row_number() OVER (PARTITION BY l_shipdate ORDER BY {L4_SQL}) AS row_number FROM lineitem")
def rn_key_two_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(table(spark, sf_dir, "lineitem", ["l_shipdate", *L4]), ["l_shipdate"], L4)


@query(f"SELECT {L4_SQL}, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS row_number FROM lineitem")
def rn_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(table(spark, sf_dir, "lineitem", L4), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS row_number FROM events")
def rn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(table(spark, sf_dir, "events"), ["user_id"], ["ts"])


@query("SELECT vec_id, label, len(embedding) AS n, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS row_number FROM embeddings")
def rn_array_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = number_rows(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"])
    return numbered.select("vec_id", "label", F.size("embedding").cast("bigint").alias("n"), "row_number")


@query("SELECT event_id, user_id, CASE WHEN value > 50 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 50 THEN value END NULLS LAST, event_id) AS row_number FROM events")
def rn_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("value") > 50, F.col("value")).alias("v"))
    return number_rows(some, ["user_id"], ["v", "event_id"])


@query("SELECT event_id, CASE WHEN user_id % 3 > 0 THEN user_id END AS k, row_number() OVER (PARTITION BY CASE WHEN user_id % 3 > 0 THEN user_id END ORDER BY event_id) AS row_number FROM events")
def rn_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("k"))
    return number_rows(some, ["k"], ["event_id"])


@query(ORACLES["rn_single_key"])
def rn_owner_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", L4)
    owners = rows.select("l_suppkey").distinct().withColumn("owner", F.pmod("l_suppkey", F.lit(8)))
    return number_rows_by_owner(rows, ["l_suppkey"], L4, owners, 8)


@query(ORACLES["rn_single_key"])
def rn_sql_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(window_sql("{rows}", L4, ["l_suppkey"], L4), rows=table(spark, sf_dir, "lineitem", L4))


@query(f"SELECT {L4_SQL}, row_number FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {L4_SQL}) AS row_number FROM lineitem) WHERE row_number <= 3")
def topk_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(table(spark, sf_dir, "lineitem", L4), ["l_suppkey"], L4, top=3)


@query(f"SELECT {L4_SQL}, row_number() OVER (PARTITION BY l_suppkey ORDER BY {L4_SQL}) AS row_number FROM lineitem WHERE l_quantity > 25")
def rn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "lineitem", [*L4, "l_quantity"]).where("l_quantity > 25").drop("l_quantity")
    return number_rows(some, ["l_suppkey"], L4)


SKEWED = "CASE WHEN l_suppkey % 10 > 0 THEN 0 ELSE l_suppkey END"


@query(f"SELECT {SKEWED} AS k, {L4_SQL}, row_number() OVER (PARTITION BY {SKEWED} ORDER BY {L4_SQL}) AS row_number FROM lineitem")
def rn_skewed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", L4)
    key = F.when(F.col("l_suppkey") % 10 > 0, F.lit(0)).otherwise(F.col("l_suppkey"))
    return number_rows_spread(rows.select(key.cast("bigint").alias("k"), *L4), ["k"], L4)


@query("SELECT count(*) AS received FROM lineitem")
def received_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packed_batches(rn_single_key(spark, sf_dir), ["l_suppkey"], L4, limit=1000)
    return packed.agg(F.sum("n_rows").alias("received"))


# Sources


@query("SELECT 'a' AS dataset_id, l_orderkey, l_linenumber, l_suppkey FROM lineitem UNION ALL SELECT 'b', l_orderkey, l_linenumber, l_suppkey FROM lineitem")
def union_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = [DatasetSpec(f"{sf_dir}/lineitem.parquet", name, node) for name, node in (("a", "n1"), ("b", "n2"))]
    return load(spark, pair, ["l_orderkey", "l_linenumber", "l_suppkey"], blocks=True).drop("node_id", "block_id")


def event_files(spark: SparkSession, sf_dir: str) -> DatasetSpec:
    """The events written to one file for each block of 1250 ids, in a folder for each block."""
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    block = F.lpad(F.floor(F.col("event_id") / 1250).cast("string"), 6, "0")
    rows = table(spark, sf_dir, "events", ["event_id", "user_id"]).withColumn("block", block)
    rows.repartition("block").write.partitionBy("block").parquet(folder)
    return DatasetSpec(folder, "events", "n1")


@query("SELECT event_id, user_id FROM events WHERE (event_id // 1250) % 4 = 1")
def shard_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_files(spark, event_files(spark, sf_dir), 1, 4).select("event_id", "user_id")


@query("SELECT 'n1|events|block=' || lpad(CAST(event_id // 1250 AS VARCHAR), 6, '0') AS block_id, count(*) AS n FROM events GROUP BY ALL")
def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = load(spark, [event_files(spark, sf_dir)], ["event_id"], blocks=True)
    folder = F.regexp_extract("block_id", "^(.*)/[^/]*$", 1)
    return loaded.groupBy(folder.alias("block_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(event_id // 1250 AS INT) AS block FROM events WHERE event_id // 1250 < 3")
def blocks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = event_files(spark, sf_dir)
    return read_blocks(spark, held, list_files(spark, held)[:3], ["event_id", "block"])


@query("SELECT count(DISTINCT event_id // 1250) AS files, count(DISTINCT event_id // 1250) AS scanned, true AS sized FROM events")
def files_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = event_files(spark, sf_dir)
    scanned = block_files(load(spark, [held]))
    return scanned.agg(F.lit(len(list_files(spark, held))).cast("bigint").alias("files"), F.count(F.lit(1)).alias("scanned"), (F.min("file_size") > 0).alias("sized"))


# Statistics

LINE_STATS = "(SELECT l_partkey % 8 AS block_id, l_partkey % 4 AS node_id, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)"


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", ["l_partkey", "l_orderkey"])
    return statistics.block_statistics(rows, F.pmod("l_partkey", F.lit(8)), ["l_orderkey"], F.pmod("l_partkey", F.lit(4)))


@query("SELECT event_id // 1250 AS block_id, user_id, count(*) AS count FROM events GROUP BY ALL")
def block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.block_statistics(table(spark, sf_dir, "events"), F.floor(F.col("event_id") / 1250).cast("bigint"), ["user_id"])


@query("SELECT user_id, count(*) AS records_count FROM events GROUP BY ALL")
def partition_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.partition_directory(block_statistics(spark, sf_dir), ["user_id"])


@query("SELECT event_id // 1250 AS block_id, count(*) AS records_count FROM events GROUP BY ALL")
def records_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.records_per_block(block_statistics(spark, sf_dir))


@query("SELECT count(*) AS total_records FROM events")
def total_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.total_records(block_statistics(spark, sf_dir))


@query(
    "WITH c AS (SELECT l_partkey % 4 AS node_id, l_orderkey, count(*) AS count FROM lineitem GROUP BY ALL) "
    "SELECT *, count / sum(count) OVER (PARTITION BY l_orderkey) AS weight FROM c"
)
def node_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.node_weights(line_stats(spark, sf_dir), ["l_orderkey"])


@query(f"SELECT l_orderkey, string_agg(block_id, ',' ORDER BY block_id) AS blocks, CAST(sum(n) AS BIGINT) AS records_count FROM {LINE_STATS} GROUP BY l_orderkey")
def block_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = statistics.block_sets(line_stats(spark, sf_dir), ["l_orderkey"])
    return sets.select("l_orderkey", F.array_join(F.col("block_ids").cast("array<string>"), ",").alias("blocks"), "records_count")


@query(
    f"WITH s AS (SELECT l_orderkey, string_agg(block_id, ',' ORDER BY block_id) AS blocks, count(*) AS width, sum(n) AS n FROM {LINE_STATS} GROUP BY l_orderkey) "
    "SELECT blocks, count(*) AS keys_count, CAST(sum(n) AS BIGINT) AS records_count, CAST(sum(n) AS DOUBLE) / width AS weight FROM s GROUP BY blocks, width"
)
def subset_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = statistics.subset_weights(line_stats(spark, sf_dir), ["l_orderkey"])
    blocks = F.array_join(F.col("block_ids").cast("array<string>"), ",")
    return weights.select(blocks.alias("blocks"), "keys_count", "records_count", "weight")


@query("SELECT l_orderkey, count(*) AS records_count, max(l_partkey % 8) AS complete_iter FROM lineitem GROUP BY l_orderkey")
def completion_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.completion_sequential(line_stats(spark, sf_dir), ["l_orderkey"])


@query(
    "WITH k AS (SELECT l_orderkey, count(*) AS n, max(l_partkey % 8) AS it FROM lineitem GROUP BY l_orderkey), "
    "r AS (SELECT l_partkey % 8 AS iter_num, count(*) AS read_count FROM lineitem GROUP BY ALL), "
    "c AS (SELECT it AS iter_num, sum(n) AS completed_count FROM k GROUP BY it), "
    "b AS (SELECT iter_num, read_count, CAST(coalesce(completed_count, 0) AS BIGINT) AS completed_count FROM r LEFT JOIN c USING (iter_num)) "
    "SELECT *, CAST(sum(read_count - completed_count) OVER (ORDER BY iter_num) AS BIGINT) AS buffered_after, "
    "CAST(sum(read_count - completed_count) OVER (ORDER BY iter_num) + completed_count AS BIGINT) AS buffered_before FROM b"
)
def buffer_occupancy_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.buffer_occupancy_sequential(line_stats(spark, sf_dir), ["l_orderkey"])


@query(
    f"WITH f AS (SELECT block_id, node_id, l_orderkey % 4 AS owner, sum(n) AS n FROM {LINE_STATS} GROUP BY ALL), "
    "s AS (SELECT block_id, node_id, n AS c, owner FROM f), "
    "u AS (SELECT block_id AS iter_num, node_id, CASE WHEN owner = node_id THEN n ELSE 0 END AS o, CASE WHEN owner <> node_id THEN n ELSE 0 END AS x, 0 AS i FROM f "
    "UNION ALL SELECT block_id, owner, 0, 0, n FROM f WHERE owner <> node_id) "
    "SELECT iter_num, node_id, CAST(sum(o) AS BIGINT) AS own_count, CAST(sum(x) AS BIGINT) AS outgoing_count, CAST(sum(i) AS BIGINT) AS incoming_count FROM u GROUP BY ALL"
)
def io_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.io_split(line_stats(spark, sf_dir), F.pmod("l_orderkey", F.lit(4)))


@query("SELECT l_partkey % 8 AS block_id, count(DISTINCT l_orderkey) AS keys_count FROM lineitem GROUP BY ALL")
def keys_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.keys_per_block(line_stats(spark, sf_dir))


@query("SELECT l_orderkey, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS records_count FROM lineitem")
def size_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey"])
    return look_up(rows, statistics.partition_directory(line_stats(spark, sf_dir), ["l_orderkey"]), ["l_orderkey"], "records_count")


@query(
    "SELECT it AS complete_iter, count(*) AS keys_count, CAST(sum(n) AS BIGINT) AS records_count "
    "FROM (SELECT l_orderkey, count(*) AS n, max(l_partkey % 8) AS it FROM lineitem GROUP BY l_orderkey) GROUP BY it"
)
def completed_by_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completed_groups(completion_sequential(spark, sf_dir))


@query(f"SELECT {L4_SQL} FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def rows_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return with_keys(table(spark, sf_dir, "lineitem", L4), rich, ["l_suppkey"])


@query(f"SELECT {L4_SQL} FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def rows_of_other_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return without_keys(table(spark, sf_dir, "lineitem", L4), rich, ["l_suppkey"])


@query("SELECT l_orderkey, l_partkey, max(l_partkey % 8) OVER (PARTITION BY l_orderkey) AS complete_iter FROM lineitem")
def completion_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey"])
    return look_up(rows, completion_sequential(spark, sf_dir), ["l_orderkey"], "complete_iter")


# Delivery and comparison


@query("SELECT dense_rank() OVER (ORDER BY l_suppkey) AS batch_no, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def batch_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = rn_single_key(spark, sf_dir).groupBy("l_suppkey").agg(F.max("row_number").alias("n"))
    return sorted_position(sizes, ["l_suppkey"], "batch_no")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_suppkey, l_orderkey, l_linenumber, l_partkey) AS position FROM lineitem")
def external_sort_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"])
    return sorted_position(rows, ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"])


@query(f"SELECT *, row_number() OVER (ORDER BY {L4_SQL}) AS position FROM lineitem")
def sorted_position_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_position(table(spark, sf_dir, "lineitem"), L4)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY ALL")
def external_sort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"])
    return external_sort(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"])


@query("SELECT l_suppkey % 25 AS bucket, count(*) AS rows_count, count(DISTINCT l_suppkey) AS keys_count FROM lineitem GROUP BY ALL")
def modulo_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = modulo_shards(table(spark, sf_dir, "lineitem", ["l_suppkey"]), "l_suppkey", 25)
    placed = dealt.select("l_suppkey", F.spark_partition_id().cast("bigint").alias("bucket"))
    return placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows_count"), F.count_distinct("l_suppkey").alias("keys_count"))


@query("SELECT l_suppkey, count(*) AS rows_count, 1::BIGINT AS buckets, count(*) AS reach FROM lineitem GROUP BY l_suppkey")
def hash_bucket_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key lies in one bucket, and its sorted rows there are neighbours: they reach no further than they are many."""
    dealt = hash_buckets(table(spark, sf_dir, "lineitem", ["l_suppkey"]), ["l_suppkey"])
    placed = dealt.select("l_suppkey", F.spark_partition_id().alias("bucket"), F.monotonically_increasing_id().alias("place"))
    return placed.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("rows_count"), F.count_distinct("bucket").alias("buckets"), (F.max("place") - F.min("place") + 1).alias("reach")
    )


@query("SELECT event_id % 8 AS shard, count(*) AS n FROM events GROUP BY ALL")
def mod_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = modulo_shards(table(spark, sf_dir, "events", ["event_id"]), "event_id", 8)
    return dealt.groupBy(F.spark_partition_id().cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


# Data preparation


@query(
    "WITH d AS (SELECT max(s_suppkey) - min(s_suppkey) + 1 AS a, max(s_nationkey) - min(s_nationkey) + 1 AS b FROM supplier) "
    "SELECT CAST(s_suppkey + a * i AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey + b * i AS INT) AS s_nationkey, s_acctbal, CAST(i AS INT) AS part FROM supplier, d, range(0, 10) r(i)"
)
def multiply_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiply(table(spark, sf_dir, "supplier"), 10, ["s_suppkey", "s_nationkey"], "part")


@query("SELECT event_id, (row_number() OVER (ORDER BY user_id, event_id) - 1) // 2000 AS file_no FROM events")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_files(table(spark, sf_dir, "events", ["user_id", "event_id"]), ["user_id", "event_id"], 2000).drop("user_id")


@query(f"SELECT file_no, count(*) AS n, sum(l_quantity) AS quantity FROM (SELECT *, (row_number() OVER (ORDER BY {L4_SQL}) - 1) // 5000 AS file_no FROM lineitem) GROUP BY file_no")
def split_file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/split-{uuid.uuid4().hex}"
    write_files(table(spark, sf_dir, "lineitem"), folder, L4, 5000)
    cut = spark.read.parquet(folder).withColumn("file_no", F.col("file_no").cast("bigint"))
    return cut.groupBy("file_no").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT max(l_orderkey) - min(l_orderkey) AS l_orderkey, max(l_partkey) - min(l_partkey) AS l_partkey, max(l_suppkey) - min(l_suppkey) AS l_suppkey FROM lineitem")
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_spans(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])


@query("SELECT s_suppkey, 1501 AS n, true AS inside FROM supplier")
def trace_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced = add_traces(table(spark, sf_dir, "supplier"))
    inside = F.forall("TRACE", lambda x: (x >= -1000) & (x <= 1000))
    return traced.select("s_suppkey", F.size("TRACE").alias("n"), inside.alias("inside"))


# Plans: greedy steps over collected statistics. SQL states what must hold of any plan; tests hold plans against worked examples.


def line_plan(spark: SparkSession, sf_dir: str, heuristic: str, limit: int | None = None, **options: object) -> QueryPlan:
    stats = line_stats(spark, sf_dir)
    return build_plan(spark, [spec(sf_dir, "lineitem")], stats, ["l_orderkey"], limit, heuristic, **options)


def owned(spark: SparkSession, sf_dir: str, owners: DataFrame) -> DataFrame:
    """Each key's rows by the owner table, by the statistics, and whether its owner holds some of it."""
    local = statistics.node_weights(line_stats(spark, sf_dir), ["l_orderkey"])
    mine = F.max((F.col("node_id").cast("string") == F.col("primary_node").cast("string")).cast("int")) == 1
    return local.join(owners, "l_orderkey", "full").groupBy("l_orderkey").agg(F.max("records_count").alias("records_count"), F.sum("count").alias("held"), mine.alias("owner_holds"))


@query("SELECT l_orderkey, count(*) AS records_count, CAST(count(*) AS BIGINT) AS held, true AS owner_holds FROM lineitem GROUP BY l_orderkey")
def owner_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned(spark, sf_dir, line_plan(spark, sf_dir, "subsets").partitions.select("l_orderkey", "records_count", "primary_node"))


@query("SELECT l_orderkey, count(*) AS records_count, true AS known FROM lineitem GROUP BY l_orderkey")
def owner_heaviest(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = statistics.heaviest_owners(line_stats(spark, sf_dir), ["l_orderkey"])
    return placed.select("l_orderkey", "records_count", F.col("primary_node").isin(0, 1, 2, 3).alias("known"))


SEQUENCE_SQL = (
    "SELECT 8::BIGINT AS blocks, 2::BIGINT AS rounds, count(DISTINCT l_orderkey) AS keys_count, count(*) AS records_count, 0::BIGINT AS left_over, 0::BIGINT AS wrong FROM lineitem"
)


def sequence_facts(spark: SparkSession, sf_dir: str, plan: QueryPlan) -> DataFrame:
    """What the plan says in all, and how many keys it doesn't complete in the round of their last block."""
    last = line_stats(spark, sf_dir).select("l_orderkey", F.col("block_id").cast("string").alias("block_id")).join(plan.sequence, "block_id")
    last = last.groupBy("l_orderkey").agg(F.max("iter_num").alias("due"))
    wrong = plan.partitions.join(last, "l_orderkey", "full").agg(F.coalesce(F.sum((~F.col("due").eqNullSafe(F.col("complete_iteration"))).cast("bigint")), F.lit(0)).alias("wrong"))
    whole = plan.sequence.agg(
        F.count_distinct("block_id").alias("blocks"), F.count_distinct("iter_num").alias("rounds"), F.sum("partitions_completed_count").alias("keys_count"),
        F.sum("records_completed_count").alias("records_count"), F.max_by("buffer_records_count", "position").alias("left_over"),
    )
    return whole.join(wrong)


@query(SEQUENCE_SQL)
def sequence_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_facts(spark, sf_dir, line_plan(spark, sf_dir, "subsets"))


@query(SEQUENCE_SQL)
def sequence_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_facts(spark, sf_dir, line_plan(spark, sf_dir, "random", seed=11))


@query(
    ORACLES["buffer_occupancy_sequential"].replace("SELECT *, CAST(sum(read_count", "SELECT iter_num AS position, completed_count, CAST(sum(read_count")
)
def sequence_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = line_plan(spark, sf_dir, "sequential").sequence
    return steps.select("position", F.col("records_completed_count").alias("completed_count"), F.col("buffer_records_count").alias("buffered_after"), F.col("buffer_before_count").alias("buffered_before"))


@query("SELECT count(*) AS returned, 0::BIGINT AS unread, 0::BIGINT AS lost, true AS spills, count(*) AS read_count FROM lineitem")
def spill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = max(1, table(spark, sf_dir, "lineitem").count() // 8)
    rounds = line_plan(spark, sf_dir, "sequential", limit=most).iterations
    return rounds.agg(
        F.sum("returned_count").alias("returned"), F.sum(F.col("write_dump") - F.col("read_dump")).alias("unread"), F.sum(F.col("output_shuffle_count") - F.col("input_shuffle_count")).alias("lost"),
        (F.sum("write_dump") > 0).alias("spills"), F.sum("block_size_in_records").alias("read_count"),
    )


@query("SELECT count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_keys, 0::BIGINT AS over_limit, 0::BIGINT AS open_ends FROM lineitem")
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that end in batches are all keys, so none is in two; batches over the limit have one key."""
    packed = packed_batches(rn_single_key(spark, sf_dir), ["l_suppkey"], L4, limit=2_000)
    each = packed.groupBy("part", "batch_no").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_keys").alias("n_keys"), F.sum(F.col("last").cast("int")).alias("ends"))
    over = ((F.col("n_rows") > 2_000) & (F.col("n_keys") > 1)).cast("bigint")
    return each.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_keys").alias("n_keys"), F.sum(over).alias("over_limit"), F.sum((F.col("ends") != 1).cast("bigint")).alias("open_ends"))


@query("SELECT count(*) AS n_rows, count(*) AS n_keys FROM (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem)")
def batch_near_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery of keys that have a row each."""
    rows = table(spark, sf_dir, "lineitem", L4).distinct()
    packed = packed_batches(number_rows(rows, L4, []), L4, limit=10_000)
    return packed.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_keys").alias("n_keys"))
