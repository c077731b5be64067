"""Incremental delivery: batches that never split a key, handed out while later partitions still run."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.row_number import ordering
from keyloom.session import importable

PACKED = "part int, batch_no bigint, piece int, last boolean, n_rows bigint, n_keys bigint, payload binary"
#: Rows of a batch where no limit is given, and bytes of one payload; a larger batch has several pieces.
DEFAULT_ROWS, PAYLOAD_BYTES = 100_000, 64 << 20


def key_starts(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Rows, other than the first, at which any key column differs from the row before; nulls and NaNs equal their like."""
    changed = None
    for name in keys:
        column = batch.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        now, before = column.slice(1), column.slice(0, max(0, len(column) - 1))
        differs = pc.fill_null(pc.not_equal(now, before), False)
        if pa.types.is_floating(column.type):
            both = pc.and_(pc.fill_null(pc.is_nan(now), False), pc.fill_null(pc.is_nan(before), False))
            differs = pc.and_not(differs, both)
        differs = pc.or_(differs, pc.xor(pc.is_null(now), pc.is_null(before)))
        changed = differs if changed is None else pc.or_(changed, differs)
    return pc.indices_nonzero(changed).to_numpy().astype(np.int64) + 1


class _Held:
    """Rows that wait to be handed out, in the batches they came in."""

    def __init__(self) -> None:
        self.batches: list[pa.RecordBatch] = []
        self.rows = self.bytes = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)
        self.rows += batch.num_rows
        self.bytes += batch.nbytes

    def take(self, n: int) -> pa.Table:
        """The first n rows, without copies; they are held no longer."""
        out, schema = [], self.batches[0].schema
        while n:
            head = self.batches[0]
            if head.num_rows > n:
                out.append(head.slice(0, n))
                self.batches[0] = head.slice(n)
            else:
                out.append(self.batches.pop(0))
            n -= out[-1].num_rows
        self.rows -= sum(b.num_rows for b in out)
        self.bytes = sum(b.nbytes for b in self.batches)
        return pa.Table.from_batches(out, schema)


def pack_pieces(
    batches: Iterator[pa.RecordBatch], keys: list[str], limit: int | None, batch_per_key: bool = False, max_bytes: int = PAYLOAD_BYTES
) -> Iterator[tuple[pa.Table, int, bool]]:
    """Whole keys packed greedily into batches of `limit` rows at most (DEFAULT_ROWS without one), a key of more rows alone.

    Gives (rows, keys that end in them, whether the batch ends). A batch over max_bytes comes in several pieces, so
    neither a payload nor what is held here grows with a key. Rows of a key must be neighbours; a key may run over many incoming batches.
    Key ends are found by whole columns, and batches are cut by one search each.
    """
    limit = 1 if batch_per_key else limit or DEFAULT_ROWS
    held, ends = _Held(), np.zeros(0, np.int64)  # ends of whole keys, counted from the first row held
    before: pa.RecordBatch | None = None
    begun = False  # pieces of the first key held are out already

    def emit(n: int, n_keys: int, last: bool) -> Iterator[tuple[pa.Table, int, bool]]:
        table = held.take(n)
        step = max(1, table.num_rows * max_bytes // max(1, table.nbytes))
        for at in range(0, max(1, table.num_rows), step):
            final = at + step >= table.num_rows
            yield table.slice(at, step), n_keys if final else 0, last and final

    def cut(done: bool) -> Iterator[tuple[pa.Table, int, bool]]:
        nonlocal ends, begun
        at = taken = 0
        while taken < len(ends):
            fit = taken + 1 if begun else int(np.searchsorted(ends, at + limit, "right"))
            if not begun and fit == len(ends) and not done and held.rows <= limit:
                break  # the key that is still open may fit as well
            fit = max(fit, taken + 1)
            yield from emit(int(ends[fit - 1]) - at, fit - taken, True)
            at, taken, begun = int(ends[fit - 1]), fit, False
        ends = ends[taken:] - at
        if not len(ends) and held.rows > limit and held.bytes > max_bytes:
            begun = True  # one open key, larger than a payload
            yield from emit(held.rows, 0, False)

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = key_starts(batch, keys)
        if before is not None and len(key_starts(pa.Table.from_batches([before, batch.slice(0, 1)]), keys)):
            starts = np.concatenate([[0], starts])
        before = batch.slice(batch.num_rows - 1)
        ends = np.concatenate([ends, held.rows + starts])
        held.add(batch)
        yield from cut(False)
    if before is not None:
        ends = np.concatenate([ends, [held.rows]])
        if not held.batches:
            held.add(before.slice(0, 0))
        yield from cut(True)


def pack_keys(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int | None, batch_per_key: bool = False) -> Iterator[tuple[pa.Table, int]]:
    """The batches of pack_pieces, each as one table, with how many keys it has."""
    held: list[pa.Table] = []
    for table, n_keys, last in pack_pieces(batches, keys, limit, batch_per_key):
        held.append(table)
        if last:
            yield pa.concat_tables(held), n_keys
            held = []


def ipc_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def packed_batches(
    df: DataFrame, keys: list[str], order_by: list[str] = (), limit: int | None = None, batch_per_key: bool = False, max_bytes: int = PAYLOAD_BYTES, parts: int | None = None
) -> DataFrame:
    """Batches as rows (part, batch_no, piece, last, n_rows, n_keys, payload), payload in Arrow's stream format; to be fetched or written.

    A batch has one row for each piece of max_bytes about, the final one marked by `last`, which also counts the batch's keys. Rows come
    sorted by key and order; the exchange and sort of a numbered input are used again, unless `parts` asks for a number of partitions.
    """
    importable(df.sparkSession)
    dealt = df.repartition(*keys) if parts is None else df.repartition(parts, *keys)
    arranged = dealt.sortWithinPartitions(*ordering([*keys, *order_by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, piece = TaskContext.get().partitionId(), 0, 0
        for table, n_keys, last in pack_pieces(batches, keys, limit, batch_per_key, max_bytes):
            row = {"part": part, "batch_no": number, "piece": piece, "last": last, "n_rows": table.num_rows, "n_keys": n_keys, "payload": ipc_bytes(table)}
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row.values(), kinds, strict=True)], list(row))
            number, piece = (number + 1, 0) if last else (number, piece + 1)

    return arranged.mapInArrow(run, PACKED)


def open_payload(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def _joined(rows: Iterator) -> Iterator[pd.DataFrame]:
    held: list[pa.Table] = []
    for row in rows:
        held.append(open_payload(bytes(row["payload"])))
        if row["last"]:
            yield pa.concat_tables(held).to_pandas()
            held = []


def batches(
    df: DataFrame, keys: list[str], order_by: list[str] = (), limit: int | None = None, batch_per_key: bool = False, buffer_rows: int | None = None
) -> Iterator[pd.DataFrame]:
    """pandas batches, one Spark partition after another; the next is computed while one is read, no more, so a slow reader holds Spark back.

    buffer_rows bounds the rows that wait for the reader: partitions are made as small as that, about, and none is computed ahead. A larger
    key is still one partition.
    """
    parts = None
    if buffer_rows:
        usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(usual, -(-df.count() // buffer_rows))
    packed = packed_batches(df, keys, order_by, limit, batch_per_key, parts=parts)
    yield from _joined(packed.toLocalIterator(prefetchPartitions=not buffer_rows))


def deliver(df: DataFrame, keys: list[str], on_batch: Callable[[pd.DataFrame], None], order_by: list[str] = (), limit: int | None = None, batch_per_key: bool = False) -> int:
    """Call on_batch for each batch; returns how many rows it got."""
    received = 0
    for batch in batches(df, keys, order_by, limit, batch_per_key):
        on_batch(batch)
        received += len(batch)
    return received


class StoredBatches:
    """Batches written to a folder, so that all rows are made before any is taken; each is handed out once, by its place or in turn.

    Places count the batches from 0, part by part. The driver holds how many batches each part has, and which were taken out of turn.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        sizes = self._read().where("last").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        found = sorted((r["part"], r["n"]) for r in sizes.collect())  # one row a partition
        self.parts = [part for part, _ in found]
        self.ends = list(accumulate(n for _, n in found))
        self.done, self.ahead = 0, set()  # all places before `done` are taken, and those in `ahead`

    @classmethod
    def write(cls, packed: DataFrame, folder: str) -> StoredBatches:
        packed.write.partitionBy("part").parquet(folder)
        return cls(packed.sparkSession, folder)

    def __len__(self) -> int:
        """How many batches there are, taken ones too."""
        return self.ends[-1] if self.ends else 0

    def _take(self, place: int) -> bool:
        """Whether the place has a batch that wasn't taken; it is from now on."""
        if not self.done <= place < len(self) or place in self.ahead:
            return False
        self.ahead.add(place)
        while self.done in self.ahead:
            self.ahead.remove(self.done)
            self.done += 1
        return True

    def _read(self) -> DataFrame:
        return self.spark.read.schema(PACKED).parquet(self.folder)  # a query without rows writes no file to take it from

    def _rows(self, part: int, low: int, high: int) -> DataFrame:
        rows = self._read().where((F.col("part") == self.parts[part]) & F.col("batch_no").between(low, high - 1))
        return rows.orderBy("batch_no", "piece")

    def fetch(self, place: int) -> pd.DataFrame | None:
        """The batch at that place, from 0; None where it has been taken, or never was."""
        if not self._take(place):
            return None
        part = bisect_right(self.ends, place)
        number = place - (self.ends[part - 1] if part else 0)
        return next(_joined(self._rows(part, number, number + 1).toLocalIterator()))

    def __iter__(self) -> Iterator[pd.DataFrame]:
        """The batches that weren't taken, in order, by one job for each part; others may fetch meanwhile."""
        while self.done < len(self):
            part = bisect_right(self.ends, self.done)
            start, end = self.ends[part - 1] if part else 0, self.ends[part]
            first = self.done
            for place, batch in enumerate(_joined(self._rows(part, first - start, end - start).toLocalIterator()), first):
                if self._take(place):
                    yield batch
