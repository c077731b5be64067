"""Random small tables against a plain Python row number, and batches against their rules."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from keyloom.operators.row_number import number_rows
from keyloom.streaming.delivery import batches, pack_keys

VALUES = st.one_of(st.none(), st.integers(-3, 3).map(float), st.just(float("nan")))
ROWS = st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("abc")), VALUES), max_size=30)
QUIET = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rank(value):
    """Numbers, then NaN, then null."""
    return (2, 0.0) if value is None else (1, 0.0) if math.isnan(value) else (0, value)


def expected(rows):
    out, seen = {}, {}
    for number, (key, value) in sorted(enumerate(rows), key=lambda r: (rank(r[1][1]), r[0])):
        seen[key] = out[number] = seen.get(key, 0) + 1
    return out


@QUIET
@given(rows=ROWS)
def test_row_numbers(spark, rows):
    table = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "id int, k string, o double")
    got = {r.id: r.row_number for r in number_rows(table, ["k"], ["o", "id"]).collect()}
    assert got == expected(rows)


@QUIET
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("abc")), st.integers(-3, 3)), max_size=30), limit=st.integers(1, 8))
def test_batches_keep_keys_whole(spark, rows, limit):
    table = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "id int, k string, o int")
    seen, ids = [], []
    for batch in batches(table, ["k", "o"], ["id"], limit):
        keys = {(r.k, r.o) for r in batch.itertuples()}
        assert len(batch) <= limit or len(keys) == 1
        seen += keys
        ids += list(batch["id"])
    assert sorted(ids) == list(range(len(rows))) and len(seen) == len(set(seen))


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 9), max_size=12), limit=st.integers(0, 12), chunk=st.integers(1, 7))
def test_packing_is_greedy(sizes, limit, chunk):
    import pyarrow as pa

    keys = [k for k, n in enumerate(sizes) for _ in range(n)]
    arrow = pa.table({"k": pa.array(keys, pa.int64())}).to_batches(max_chunksize=chunk)
    got = [t.num_rows for t, _ in pack_keys(iter(arrow), ["k"], limit)]
    want: list[int] = []
    for n in sizes:
        if want and (not limit or want[-1] + n <= limit):
            want[-1] += n
        else:
            want.append(n)
    assert got == want
