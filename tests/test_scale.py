"""Positions, numbers of large keys, delivery in pieces, stored batches and partition folders, against plain answers."""

import time
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.functions.arrays import key_struct
from keyloom.functions.text import human_size
from keyloom.lifecycle import QueryManager, QueryState, QueryStopped
from keyloom.operators.dataprep import split_files
from keyloom.operators.external import append_files, sorted_position
from keyloom.operators.ranges import fix_ranges
from keyloom.operators.row_number import number_rows
from keyloom.operators.spread import has_hot_key, number_rows_spread
from keyloom.plans.statistics import heaviest_owners
from keyloom.query import ExecOptions, OrderedQuery
from keyloom.sources.datasets import ORIGIN, DatasetSpec, block_files, list_files, load, read_blocks, register_format, shard_files
from keyloom.streaming.delivery import StoredBatches, batches, deliver, open_payload, pack_keys, pack_pieces, packed_batches


@pytest.fixture(scope="module")
def wide(spark):
    x = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    return spark.range(0, 400_000, 1, 6).select(x.alias("x"), F.col("id").alias("payload"), F.repeat(F.lit("p"), 20).alias("more"))


def test_positions_with_payload(spark, wide, tmp_path):
    placed = sorted_position(wide, ["x"], slices=8)
    text = placed._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange shufflepartitionidpassthrough") == 1 and "rangepartitioning" not in text
    placed.write.parquet(str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p")).toPandas().sort_values("x")
    assert (got["position"].to_numpy() == np.arange(1, 400_001)).all()
    split_files(wide, str(tmp_path / "cut"), ["x"], 50_000)
    sizes = spark.read.parquet(str(tmp_path / "cut")).groupBy("file_no").count().collect()
    assert sorted((r.file_no, r["count"]) for r in sizes) == [(k, 50_000) for k in range(8)]


@pytest.mark.parametrize("kind", ["string", "double", "date", "timestamp_ntz", "timestamp", "decimal(12,3)", "boolean", "binary"])
def test_ranges_of_any_type(spark, kind):
    number = F.pmod(F.xxhash64("id"), F.lit(400)).cast("int")
    value = {"date": F.date_add(F.lit("2020-01-01"), number), "boolean": number % 2 == 0, "binary": F.encode(number.cast("string"), "utf-8")}.get(kind)
    if kind.startswith("timestamp"):
        value = F.timestamp_seconds(number * 7001).cast(kind)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 50 > 0, number.cast(kind) if value is None else value).alias("v"))
    if kind == "double":
        rows = rows.withColumn("v", F.when(F.col("id") % 41 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    ranges = fix_ranges(rows, ["v", "id"], 7)
    assert ranges.count == 7
    from pyspark.sql import Window

    want = rows.withColumn("w", F.row_number().over(Window.orderBy(F.asc_nulls_last("v"), "id"))).select("id", "w")
    both = sorted_position(rows, ["v", "id"], slices=7).join(want, "id")
    assert both.count() == 3000 and both.where("position <> w").count() == 0
    plain = number_rows(rows, ["v"], ["id"]).select("id", F.col("row_number").alias("w"))
    both = number_rows_spread(rows, ["v"], ["id"], slices=7).join(plain, "id")
    assert both.count() == 3000 and both.where("row_number <> w").count() == 0


def test_positions_of_one_key_column_of_a_checkpointed_table(spark, tmp_path):
    """Spark may infer filters from a range's expression for either side of a join on it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(str(tmp_path))
    rows = spark.range(2000).selectExpr("id", "concat('s', id % 11) AS name", "id % 7 AS size").checkpoint()
    names = rows.groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("size")).checkpoint()
    got = [r.name for r in sorted_position(names, ["name"], "place").orderBy("place").collect()]
    assert got == sorted(f"s{k}" for k in range(11))
    numbered = number_rows_spread(names, ["name"], ["count"], slices=3).collect()
    assert len(numbered) == 11 and {r.row_number for r in numbered} == {1}


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_spread_keys(spark, hot):
    key = F.when(F.pmod(F.xxhash64("id"), F.lit(1000)) < int(hot * 1000), F.lit("hot")).when(F.col("id") % 9 == 0, F.lit(None)).otherwise((F.col("id") % 300).cast("string"))
    rows = spark.range(40_000).select(key.alias("k"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)).alias("o"), "id")
    assert has_hot_key(rows, ["k"]) == (hot > 0)
    got = number_rows_spread(rows, ["k"], ["o"], slices=16)
    assert got.columns == ["k", "o", "id", "row_number"]
    plain = number_rows(rows, ["k"], ["o"])
    assert got.exceptAll(plain).isEmpty() and got.count() == 40_000
    if hot == 1:
        tasks = Counter(r.p for r in got.select(F.spark_partition_id().alias("p")).collect())
        assert len(tasks) == 16 and max(tasks.values()) < 3 * np.median(list(tasks.values()))
    assert number_rows_spread(rows.limit(0), ["k"], ["o"]).count() == 0
    if hot < 1:
        with pytest.raises(Exception, match="partition key is null"):
            number_rows_spread(rows, ["k"], ["o"], null_keys="error").collect()


def test_ties_of_several_datasets_break_by_origin(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(0, 500, 1, 1).select((F.col("id") % 3).alias("k"), F.lit(1).alias("o"), "id").write.parquet(str(tmp_path / name))
    specs = [DatasetSpec(str(tmp_path / n), n) for n in ("a", "b")]
    query = OrderedQuery(spark, specs, ["k"], ["o"], deterministic=True, select=["id", "k"])
    one, two = (sorted(map(tuple, query.run().collect())) for _ in range(2))
    assert one == two and query.run().columns == ["id", "k", "row_number"] and len(one) == 1000
    spread = OrderedQuery(spark, specs, ["k"], ["o"], deterministic=True, select=["id", "k"], options=ExecOptions(spread_keys=True)).run()
    assert sorted(map(tuple, spread.collect())) == one
    assert set(ORIGIN) <= set(load(spark, specs, ["k"], origin=True).columns)


def arrow(sizes, chunk):
    keys = [k for k, n in enumerate(sizes) for _ in range(n)]
    return iter(pa.table({"k": pa.array(keys, pa.int64())}).to_batches(max_chunksize=chunk))


@pytest.mark.parametrize("chunk", [3, 50, 1000])
def test_large_keys_come_in_pieces(chunk):
    sizes = [2, 900, 5, 1, 300, 3]
    for most in (64, 800, 1 << 20):
        got, held = [], 0
        for table, n_keys, last in pack_pieces(arrow(sizes, chunk), ["k"], 10, max_bytes=most):
            assert table.nbytes <= max(most, 8 * chunk) or table.num_rows == 1
            held += table.num_rows
            assert last or not n_keys
            if last:
                got.append((held, n_keys))
                held = 0
        assert got == [(2, 1), (900, 1), (6, 2), (300, 1), (3, 1)] and not held
    assert [t.num_rows for t, _ in pack_keys(arrow(sizes, chunk), ["k"], 10)] == [2, 900, 6, 300, 3]


def test_packing_of_near_unique_keys_is_fast():
    many = arrow([1] * 400_000, 10_000)
    start = time.perf_counter()
    assert sum(n for _, n in pack_keys(many, ["k"], 1000)) == 400_000
    assert time.perf_counter() - start < 5


def test_pieces_join_again(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), "id", F.repeat(F.lit("x"), 50).alias("t"))
    packed = packed_batches(rows, ["k"], ["id"], 100, max_bytes=20_000).collect()
    assert len(packed) > 10 and sum(r.last for r in packed) == 2 and sum(r.n_keys for r in packed) == 2
    assert all(len(r.payload) < 40_000 for r in packed) and open_payload(bytes(packed[0].payload)).num_rows == packed[0].n_rows
    seen = []
    assert deliver(rows, ["k"], lambda b: seen.append(len(b)), ["id"], 100) == 5000 and seen == [2500, 2500]
    assert sum(len(b) for b in batches(rows.limit(0), ["k"])) == 0


def test_rows_that_wait_are_bounded(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 20_000, 1, 4).select((F.col("id") % 4000).alias("k"), "id").write.parquet(path)
    rows = spark.read.parquet(path)
    most, seen, ids = 0, 0, set()
    for batch in batches(rows, ["k"], ["id"], 50, buffer_rows=500):
        seen += len(batch)
        ids |= set(batch["k"])
        most = max(most, len(batch))
    assert seen == 20_000 and most <= 50 and len(ids) == 4000
    parts = packed_batches(spark.read.parquet(path), ["k"], ["id"], 50, parts=40).groupBy("part").agg(F.sum("n_rows").alias("n")).collect()
    assert len(parts) == 40 and max(r.n for r in parts) < 1500
    options = ExecOptions(output_batch_max_size=50, max_output_batches_buffer_size=500)
    assert OrderedQuery(spark, [DatasetSpec(path)], ["k"], ["id"], options=options).execute() == 20_000


def test_partition_folders(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(1000).withColumn("p", F.col("id") % 4).repartition("p").write.partitionBy("p").parquet(path)
    for n in range(4):
        part = next((tmp_path / "parts" / f"p={n}").glob("*.parquet"))
        part.rename(part.with_name("same.parquet"))
        part.with_name(f".{part.name}.crc").unlink()
    spec = DatasetSpec(path, "d", "n")
    files = list_files(spark, spec)
    assert len(files) == 4 and all(f.endswith("same.parquet") for f in files)
    shards = [shard_files(spark, spec, k, 2) for k in range(2)]
    assert [s.count() for s in shards] == [500, 500] and "p" in shards[0].columns
    blocks = load(spark, [spec], ["id"], blocks=True).groupBy("block_id").count().collect()
    assert sorted((r.block_id, r["count"]) for r in blocks) == [(f"n|d|p={k}/same.parquet", 250) for k in range(4)]
    sized = block_files(load(spark, [spec])).collect()
    assert len(sized) == 4 and all(r.file_size > 0 for r in sized)
    asked = []

    def reader(session, paths, options):
        asked.append(paths)
        return session.read.options(**options).parquet(*([paths] if isinstance(paths, str) else paths)).withColumn("own", F.lit(1))

    register_format("own", reader, ".parquet")
    own = DatasetSpec(path, "o", "n", "own")
    assert shard_files(spark, own, 0, 4).where("own = 1").count() == read_blocks(spark, own, files[:1]).count() == 250 and asked[-1] == files[:1]


def test_submitted_query(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 4).select((F.col("id") % 10).alias("k"), "id").write.parquet(path)
    states = []
    manager = QueryManager(spark, keep=1)
    query = OrderedQuery(spark, [DatasetSpec(path)], ["k"], ["id"], memory_limit=300, options=ExecOptions(output_batch_max_size=200))
    handle = query.submit(manager, str(tmp_path / "out"), "q1")
    while handle.state is not QueryState.COMPLETED:
        states.append(handle.state)
        assert handle.state in (QueryState.PREPARING, QueryState.PLANNING, QueryState.RUNNING), handle.error
        time.sleep(0.01)
    assert QueryState.PLANNING in states and handle.plan.partitions.count() == 10
    stored = handle.result
    first = stored.fetch(0)
    assert stored.fetch(0) is None and stored.fetch(999) is None
    rest = pd.concat([first, *stored])
    assert sorted(rest["id"]) == list(range(1000)) and handle.state is QueryState.COMPLETED
    assert handle.taken() and handle.wait(5) is QueryState.FINISHED
    manager.submit(lambda _: 1, "q2").wait(10)
    time.sleep(0.5)
    manager.submit(lambda _: 2, "q3").wait(10)
    assert "q1" not in manager.queries


def test_stored_batches_in_and_out_of_turn(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 600).alias("k"), "id")
    stored = StoredBatches.write(packed_batches(rows, ["k"], ["id"], batch_per_key=True), str(tmp_path / "a"))
    assert len(stored) == 600
    keys = [stored.fetch(k)["k"].iloc[0] for k in (5, 0, 599)]
    assert stored.fetch(5) is None and stored.fetch(600) is None and stored.fetch(-1) is None
    for n, batch in enumerate(stored):
        assert len(batch) == 5 and batch["k"].nunique() == 1 and batch["id"].is_monotonic_increasing
        keys.append(batch["k"].iloc[0])
        if n == 100:
            keys.append(stored.fetch(300)["k"].iloc[0])
    assert sorted(keys) == list(range(600)) and stored.done == 600 and not stored.ahead and not list(stored)
    nothing = StoredBatches.write(packed_batches(rows.limit(0), ["k"]), str(tmp_path / "b"))
    assert len(nothing) == 0 and nothing.fetch(0) is None and not list(nothing)


def test_cancel_stops_later_actions(spark):
    manager, counted = QueryManager(spark), []

    def work(handle):
        for k in range(1000):
            spark.range(10**8 * 5).selectExpr("sum(id % 7)").collect()
            counted.append(k)

    handle = manager.submit(work, "many")
    time.sleep(1)
    manager.cancel("many")
    assert handle.left.wait(30) and handle.state is QueryState.CANCELLED and len(counted) < 900
    with pytest.raises(QueryStopped):
        handle.check()


def test_query_timeout(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 10, 1, 1).select((F.col("id") % 3).alias("k"), "id").write.parquet(path)
    slow = F.udf(lambda _: time.sleep(2) is None, "boolean")("id")
    options = ExecOptions(read_only=True, query_timeout=1.0)
    with pytest.raises(TimeoutError):
        OrderedQuery(spark, [DatasetSpec(path)], ["k"], ["id"], where=slow, options=options).execute()
    quick = ExecOptions(query_timeout=60.0)
    assert OrderedQuery(spark, [DatasetSpec(path)], ["k"], ["id"], options=quick).execute() == 10


def test_heaviest_owners_even_out(spark):
    # nodes 0, 2 and 3
    stats = spark.range(20_000).selectExpr("id AS k", "CASE WHEN id % 10 = 0 THEN id % 4 ELSE 0 END AS node_id", "3L AS count")
    more = spark.range(4).selectExpr("id AS k", "3L AS node_id", "50L AS count")
    placed = heaviest_owners(stats.union(more), ["k"])
    assert placed.count() == 20_000 and placed.where("k < 4 AND k > 0").count() == 3
    loads = {r.primary_node: r.n for r in placed.groupBy("primary_node").agg(F.sum("records_count").alias("n")).collect()}
    assert max(loads.values()) < 1.25 * sum(loads.values()) / 3 and sum(loads.values()) == 60_200
    assert placed.exceptAll(heaviest_owners(stats.union(more), ["k"])).isEmpty()


def test_owners_without_the_driver(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 2000, 1, 4).select((F.col("id") % 50).alias("k"), "id").write.parquet(path)
    query = OrderedQuery(spark, [DatasetSpec(path)], ["k"], ["id"])
    assert query.run_by_owner(max_statistics=10).exceptAll(query.run()).isEmpty()


def test_small_helpers(spark):
    assert human_size(0) == "0 B" and human_size(1536) == "1.5 KiB" and human_size(5 << 30) == "5.0 GiB"
    rows = spark.createDataFrame([(1, "a")], "x int, y string")
    assert rows.select(key_struct(["x"]).alias("k")).first().k == 1 and tuple(rows.select(key_struct(["x", "y"]).alias("k")).first().k) == (1, "a")
    append_files(rows, "appended_t")
    append_files(rows, "appended_t")
    assert spark.table("appended_t").count() == 2
    spark.sql("DROP TABLE appended_t")
