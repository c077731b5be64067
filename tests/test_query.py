"""Row numbers, delivery, sources, preparation and lifecycle on small tables."""

import time

import pytest
from pyspark.sql import functions as F

from keyloom.lifecycle import QueryManager, QueryState
from keyloom.operators.dataprep import multiply
from keyloom.operators.dataprep import split_files as write_split
from keyloom.operators.external import save_presorted, sorted_position
from keyloom.operators.row_number import number_rows, number_rows_by_owner
from keyloom.plans.query_plan import PlanTooLarge, QueryPlan
from keyloom.query import ExecOptions, OrderedQuery
from keyloom.sources.datasets import DatasetSpec, check_specs, file_groups, list_files, load, read_blocks, shard_files
from keyloom.streaming.delivery import batches, packed_batches

ROWS = [("a", 3.0, 1), ("a", None, 2), ("a", float("nan"), 3), ("a", 1.0, 4), (None, 5.0, 5), (None, 4.0, 6), ("b", 0.0, 7)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, "k string, o double, id int")


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mini") / "seismic")
    rows = spark.range(0, 1000, 1, 8).select(
        F.col("id").alias("TRACE_SEQUENCE_NUMBER_FILE"),
        (F.col("id") % 40).alias("SOURCE_POINT_NUMBER"),
        F.floor(F.col("id") / 40).alias("SENSOR_NUMBER"),
        F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("TRACE"),
    )
    rows.write.parquet(path)
    return path


def test_nulls_last_and_null_keys(small):
    got = {(r.k, r.id): r.row_number for r in number_rows(small, ["k"], ["o"]).collect()}
    assert got == {("a", 4): 1, ("a", 1): 2, ("a", 3): 3, ("a", 2): 4, (None, 6): 1, (None, 5): 2, ("b", 7): 1}
    assert dict(number_rows(small, ["k"], ["o"]).dtypes)["row_number"] == "bigint"
    with pytest.raises(Exception, match="partition key is null"):
        number_rows(small, ["k"], ["o"], null_keys="error").collect()
    down = number_rows(small, ["k"], [F.col("id").desc()], top=1).collect()
    assert sorted(r.id for r in down) == [4, 6, 7]


def test_bad_queries(spark, small):
    for keys, order, text in (([], ["o"], "empty"), (["zz"], ["o"], "missing"), (["k"], ["zz"], "missing")):
        with pytest.raises(ValueError, match=text):
            number_rows(small, keys, order)
    with pytest.raises(ValueError, match="another name"):
        number_rows(small.withColumn("row_number", F.lit(1)), ["k"], ["o"])
    assert number_rows(small.limit(0), ["k"], []).count() == 0
    assert sorted(r.row_number for r in number_rows(small, ["k"], []).where("k = 'a'").collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="repeat"):
        check_specs([DatasetSpec("x"), DatasetSpec("x")])
    with pytest.raises(ValueError, match="unknown dataset type"):
        check_specs([DatasetSpec("x", dataset_type="other")])
    with pytest.raises(FileNotFoundError):
        list_files(spark, DatasetSpec("/nowhere/at/all"))


def test_plans_have_one_exchange(spark, small):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    text = plan(number_rows(rows.select("l_suppkey", "l_orderkey"), ["l_suppkey"], ["l_orderkey"]))
    assert text.count("Exchange hashpartitioning") == 1 and "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in text
    assert "WindowGroupLimit" in plan(number_rows(rows, ["l_suppkey"], ["l_orderkey"], top=3))
    owners = rows.select("l_suppkey").distinct().withColumn("owner", F.pmod("l_suppkey", F.lit(4)))
    text = plan(number_rows_by_owner(rows.select("l_suppkey", "l_orderkey"), ["l_suppkey"], ["l_orderkey"], owners, 4))
    assert text.count("shufflepartitionidpassthrough") == 1
    with pytest.raises(Exception, match="no owner"):
        number_rows_by_owner(rows, ["l_suppkey"], ["l_orderkey"], owners.where("l_suppkey > 3"), 4).collect()


def test_sources(spark, files):
    spec = DatasetSpec(files, node_id="n1")
    names = list_files(spark, spec)
    assert len(names) == 8
    parts = [shard_files(spark, spec, k, 3) for k in range(3)]
    assert sum(p.count() for p in parts) == 1000 and max(len(p.inputFiles()) for p in parts) == 3
    blocks = load(spark, [spec], ["SOURCE_POINT_NUMBER"], blocks=True)
    assert blocks.select("block_id").distinct().count() == 8
    assert list_files(spark, DatasetSpec(names[0])) == [names[0]]
    assert [g.count() for g in file_groups(spark, spec, 5, ["TRACE"])] == [625, 375] and read_blocks(spark, spec, []).count() == 0


def test_ordered_query(spark, files):
    query = OrderedQuery(spark, [DatasetSpec(files, "d", "n1")], ["SOURCE_POINT_NUMBER"], ["SENSOR_NUMBER"], memory_limit=400)
    rows = query.run()
    assert rows.columns[-1] == "row_number" and rows.count() == 1000
    assert rows.groupBy("SOURCE_POINT_NUMBER").agg(F.max("row_number")).select(F.max("max(row_number)")).first()[0] == 25
    plan = query.plan()
    assert plan.sequence.count() == 8 and plan.partitions.count() == 40
    assert plan.partitions.agg(F.sum("records_count")).first()[0] == 1000
    assert plan.planned_spill == plan.iterations.agg(F.sum("read_dump")).first()[0] > 0
    with pytest.raises(PlanTooLarge):
        query.plan(max_statistics=10)
    owned = query.run_by_owner()
    assert rows.exceptAll(owned).count() == owned.exceptAll(rows).count() == 0
    narrow = OrderedQuery(spark, query.datasets, ["SOURCE_POINT_NUMBER"], ["SENSOR_NUMBER"], select=["TRACE"], where="SENSOR_NUMBER < 5").run()
    assert narrow.columns == ["TRACE", "row_number"] and narrow.count() == 200


def test_plan_round_trip(spark, files, tmp_path):
    plan = OrderedQuery(spark, [DatasetSpec(files)], ["SOURCE_POINT_NUMBER"], [], memory_limit=300).plan()
    plan.save(str(tmp_path))
    again = QueryPlan.load(spark, str(tmp_path))
    assert again.planned_spill == plan.planned_spill and again.blocks.count() == 8


@pytest.mark.parametrize(("limit", "sizes"), [(8, [8, 2]), (6, [3, 5, 2]), (4, [3, 5, 2]), (None, [10]), (10, [10]), (0, [10])])
def test_packing(spark, limit, sizes):
    rows = spark.createDataFrame([(k, n) for k, size in ((1, 3), (2, 5), (3, 2)) for n in range(size)], "k int, n int").coalesce(1)
    one = [r.n_rows for r in packed_batches(rows.repartition(1), ["k"], ["n"], limit).orderBy("part", "batch_no").collect()]
    assert sum(one) == 10
    held = [sorted(b.k.unique()) for b in batches(rows, ["k"], ["n"], limit)]
    assert sorted(k for b in held for k in b) == [1, 2, 3]
    from keyloom.streaming.delivery import pack_keys

    arrow = rows.orderBy("k", "n").toArrow().to_batches(max_chunksize=2)
    assert [t.num_rows for t, _ in pack_keys(iter(arrow), ["k"], limit)] == sizes


def test_delivery_carries_arrays_and_counts(spark, files):
    options = ExecOptions(output_batch_max_size=100)
    query = OrderedQuery(spark, [DatasetSpec(files)], ["SENSOR_NUMBER"], ["SOURCE_POINT_NUMBER"], options=options)
    seen = []
    for batch in query.batches():
        assert len(batch) <= 100 and len(batch.TRACE.iloc[0]) == 2
        seen += list(batch.SENSOR_NUMBER.unique())
    assert len(seen) == len(set(seen)) == 25
    assert query.execute() == 1000
    assert OrderedQuery(spark, query.datasets, ["SENSOR_NUMBER"], [], options=ExecOptions(read_only=True)).execute() is None


def test_preparation(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (3, 9)], "a int, b int")
    out = sorted((r.a, r.b) for r in multiply(rows, 3, ["a"]).collect())
    assert out == [(1, 5), (3, 9), (4, 5), (6, 9), (7, 5), (9, 9)]
    assert multiply(rows.limit(0), 3, ["a"]).count() == 0
    places = sorted_position(spark.range(100).select((F.lit(99) - F.col("id")).alias("x")), ["x"]).collect()
    assert all(r.position == r.x + 1 for r in places)
    write_split(spark.range(50), str(tmp_path / "cut"), ["id"], 20)
    cut = spark.read.parquet(str(tmp_path / "cut")).groupBy("file_no").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    assert sorted((r.file_no, r.low, r.n) for r in cut.collect()) == [(0, 0, 20), (1, 20, 20), (2, 40, 10)]


def test_presorted_table_needs_no_exchange(spark):
    save_presorted(spark.range(1000).select((F.col("id") % 7).alias("k"), "id"), "presorted_t", ["k"], ["id"], 4)
    out = number_rows(spark.table("presorted_t"), ["k"], ["id"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 1000
    spark.sql("DROP TABLE presorted_t")


def test_lifecycle(spark):
    manager = QueryManager(spark)
    good = manager.submit(lambda _: spark.range(100).count(), "good")
    assert good.wait(60) is QueryState.FINISHED and good.result == 100
    bad = manager.submit(lambda _: 1 / 0)
    assert bad.wait(60) is QueryState.ERROR and isinstance(bad.error, ZeroDivisionError)
    slow = lambda _: spark.range(10**12).selectExpr("sum(id % 7)").collect()
    stopped = manager.submit(slow, "slow")
    time.sleep(1)
    assert manager.cancel("slow").wait(60) is QueryState.CANCELLED
    late = manager.submit(slow, timeout=1)
    assert late.wait(60) is QueryState.TIMEOUT and stopped in manager.list(QueryState.CANCELLED)
    with pytest.raises(KeyError):
        manager.get("none")
    with pytest.raises(ValueError, match="exists"):
        manager.submit(slow, "good")
