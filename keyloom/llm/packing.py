"""Packing documents into sequences: best fit over bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import pick
from keyloom.llm.mixing import word_count

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Documents that are packed together, about; what one task holds.
SHARD_DOCS = 50_000
#: Equal rows that go to one shard together.
COPIES = 256
COLUMNS = "doc_id long, chunk long, start long, length long, bin_id long, bin_offset long, capacity long"


def sequence_cost(capacity: int) -> float:
    """What a sequence costs: its length, attention that grows with the square, and a fixed part that tokens share."""
    return capacity + capacity**2 / 16384 + 256


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> tuple[list[tuple[int, int]], list[int]]:
    """Bin and offset of each length, and the final capacity of each bin.

    No length may pass the largest capacity, none may be zero. Lengths are taken in descending order. Each goes into the open bin with
    the least room that holds it. Where none does, the permitted lengths compete for the new bin: each that holds
    the item is weighed by its cost for each token it may expect, the item and what is still to come that
    fits beside it; the cheapest is opened, the smaller of equals. At last each bin shrinks to the smallest
    permitted length that holds its contents. Rooms are bits of one integer, so the best fit is one shift.
    """
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    falling = [-lengths[k] for k in order]
    rest = [0] * (len(order) + 1)  # volume from each place of the order on
    for place in range(len(order) - 1, -1, -1):
        rest[place] = rest[place + 1] - falling[place]
    rooms: dict[int, list[int]] = {}
    mask = 0
    capacity: list[int] = []
    used: list[int] = []
    where: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for place, k in enumerate(order):
        length = lengths[k]
        fitting = mask >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            best = None
            for size in sizes[bisect_left(sizes, length) :]:
                to_come = rest[max(place + 1, bisect_left(falling, length - size))]
                price = cost(size) / (length + min(size - length, to_come))
                if best is None or price < best[0]:
                    best = (price, size)
            chosen, room = len(capacity), best[1]
            capacity.append(room)
            used.append(0)
        where[k] = (chosen, used[chosen])
        used[chosen] += length
        room -= length
        if room:
            if not rooms.get(room):
                rooms[room] = []
                mask |= 1 << room
            rooms[room].append(chosen)
    return where, [sizes[bisect_left(sizes, n)] for n in used]


def pack_shard(rows: list[tuple[int | None, int]], shard: int, capacities: tuple[int, ...], cost: Callable[[int], float]) -> Iterator[tuple]:
    """Output rows, see COLUMNS, of the documents (id, length) of one shard."""
    rows = sorted(rows, key=lambda r: (r[1], r[0] is not None, r[0] or 0))
    largest = max(capacities)
    tails = [n % largest for _, n in rows]
    items = [k for k, n in enumerate(tails) if n]
    where, final = best_fit([tails[k] for k in items], capacities, cost)
    placed = dict(zip(items, where, strict=True))
    free = len(final)
    base = shard << 32
    for k, (doc_id, length) in enumerate(rows):
        whole = length // largest
        for chunk in range(whole):
            yield doc_id, chunk, chunk * largest, largest, base + free, 0, largest
            free += 1
        if k in placed:
            chosen, offset = placed[k]
            yield doc_id, whole, whole * largest, tails[k], base + chosen, offset, final[chosen]
        elif not length:
            yield doc_id, 0, 0, 0, None, None, None


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row for each piece of a document in a bin; see COLUMNS. Lengths are words, parted by ASCII white space.

    Documents longer than the largest capacity are cut into whole bins of it and a rest; nothing is lost. A null, empty or
    blank text is one row of length 0 without a bin. Documents are dealt by hash to shards of about shard_docs
    that are packed alone; only ids and lengths move. Repeated rows are packed as often as they
    come; they are counted before they move, and dealt by COPIES of them, so no shard has to hold all. The same table gives the same bins in every run. bin_id: shard times 2^32 plus the bin. No rows give no rows.
    """
    shards = max(1, -(-docs.count() // shard_docs))
    rows = pick(docs, "doc_id", "text").select("doc_id", word_count(F.col("text")).alias("length"))
    counted = rows.groupBy("doc_id", "length").agg(F.count(F.lit(1)).alias("n"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("int"))))
    parts = parts.select("doc_id", "length", F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES).alias("copies"), "part")
    dealt = parts.repartitionById(shards, F.pmod(F.xxhash64("doc_id", "length", "part"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int]] = []
        for batch in batches:
            for doc_id, length, copies in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.extend([(doc_id, length)] * copies)
        out: list[tuple] = []
        for row in pack_shard(held, TaskContext.get().partitionId(), capacities, cost):
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return dealt.mapInArrow(run, COLUMNS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)
