"""Plans made from tables are those that the driver makes from its lists."""

import random

import pytest
from pyspark import StorageLevel

from keyloom.plans import large
from keyloom.plans.query_plan import TABLES, build_plan
from keyloom.plans.spill import MemoryLimitError


def statistics(spark, seed, n_blocks=9, n_keys=60, n_nodes=3):
    """Keys of two columns with nulls, in random blocks."""
    draw, rows = random.Random(seed), []
    for b in range(n_blocks):
        for k in draw.sample(range(n_keys), draw.randint(1, n_keys // 2)):
            rows.append((f"b{b}", f"n{b % n_nodes}", f"d{b % 2}", None if k % 7 == 0 else k % 11, f"k{k}", draw.choice([1, 1, 2, 3, 40])))
    return spark.createDataFrame(rows, "block_id string, node_id string, dataset_id string, x int, y string, count bigint").cache()


def both(spark, stats, keys, *args, **options):
    return [build_plan(spark, [], stats, keys, *args, in_memory=n, **options) for n in (2_000_000, 0)]


def same(near, far):
    assert far.steps is None and near.steps is not None
    for name in TABLES:
        one, other = getattr(near, name), getattr(far, name)
        assert one.dtypes == other.dtypes
        assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect())), name


@pytest.mark.parametrize(("seed", "nodes"), [(0, 1), (1, 3), (2, 4)])
def test_owners_from_tables(spark, seed, nodes):
    near, far = both(spark, statistics(spark, seed, n_nodes=nodes), ["x", "y"])
    same(near, far)
    assert far.partitions.where("primary_node IS NULL").isEmpty()


@pytest.mark.parametrize(
    ("seed", "limit", "batch", "pessimistic"),
    [(4, 60, 3, False), (5, 8, 5, True)],
)
def test_spill_from_tables(spark, monkeypatch, seed, limit, batch, pessimistic):
    monkeypatch.setattr(large, "RANGES", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    stats = statistics(spark, seed, n_blocks=7, n_nodes=seed % 3 + 1)
    near, far = both(spark, stats, ["x", "y"], limit, "sequential", merge_batch=batch, pessimistic=pessimistic)
    assert near.planned_spill > 0
    same(near, far)
    assert near.rounds == far.rounds
    with pytest.raises(MemoryLimitError) as one:
        build_plan(spark, [], stats, ["x", "y"], limit, "sequential", True, pessimistic)
    with pytest.raises(MemoryLimitError) as other:
        build_plan(spark, [], stats, ["x", "y"], limit, "sequential", True, pessimistic, in_memory=0)
    assert str(one.value) == str(other.value)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_random_order_from_tables(spark):
    same(*both(spark, statistics(spark, 7, n_blocks=6, n_nodes=2), ["x", "y"], None, "random", seed=11))


def test_sequential_order_from_tables(spark):
    same(*both(spark, statistics(spark, 8, n_blocks=6, n_nodes=2), ["y"], None, "sequential"))


def test_groups_of_keys_on_the_driver_and_in_a_table(spark):
    # 300 keys in 8 groups of the same blocks: 2,100 counts
    rows = [(f"b{b}", f"n{b % 2}", k, 1 + k % 3) for k in range(300) for b in range(8) if b != k % 8]
    stats = spark.createDataFrame(rows, "block_id string, node_id string, k int, count bigint").cache()
    near = build_plan(spark, [], stats, ["k"])
    for most in (2_000, 200):
        far = build_plan(spark, [], stats, ["k"], in_memory=most)
        same(near, far)


@pytest.mark.parametrize("heuristic", ["random", "sequential", "subsets"])
def test_order_needs_no_owners(spark, monkeypatch, heuristic):
    stats = statistics(spark, 9, n_blocks=6, n_nodes=2)
    near = build_plan(spark, [], stats, ["x", "y"], None, heuristic)
    done, assign = [], large.LargePlan.assign
    monkeypatch.setattr(large.LargePlan, "assign", lambda plan: (done.append(1), assign(plan)))
    far = build_plan(spark, [], stats, ["x", "y"], None, heuristic, in_memory=0)
    for name in ("blocks", "sequence"):
        assert sorted(map(repr, getattr(near, name).collect())) == sorted(map(repr, getattr(far, name).collect()))
    assert not done
    same(near, far)
    assert done == [1]
    assert stats.storageLevel != StorageLevel.NONE  # the caller's own cache stays


def test_statistics_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    stats = spark.createDataFrame([(b, b % 2, k, 1) for b in range(4) for k in range(5)], "block_id int, node_id int, k int, count bigint")
    stats = stats.mapInArrow(told, stats.schema)
    build_plan(spark, [], stats, ["k"], None, "sequential", in_memory=0)
    assert seen.value == 20
    assert stats.storageLevel == StorageLevel.NONE
