"""Mixing sources to target weights: a hypergeometric splitting tree deals source block quotas to output shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import pick, settled
from keyloom.operators.external import sorted_position

#: Most blocks of a source (a power of two), and documents that a block of a small source has.
MAX_BLOCKS, BLOCK_DOCS = 4096, 16
#: Neighbouring blocks whose words are summed together first.
SPAN = 64
#: Documents of one sorted part of a shard, about.
PART_DOCS = 50_000
#: Sources up to which their table is broadcast, and sources that share one tree; each further so many have a tree of their own.
BROADCAST_SOURCES, TREE_SOURCES = 20_000, 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _seat(seed: int, doc_id: Column, text: Column) -> Column:
    """A document's pseudo-random 64-bit place in its source's order; the same in every run."""
    return F.xxhash64(F.lit(seed), doc_id, F.coalesce(text, F.lit("")))


def _block(seat: Column, blocks: Column) -> Column:
    """The block, 0 to blocks - 1, by the leading 31 bits of the seat."""
    return F.shiftright(F.shiftrightunsigned(seat, 33) * blocks, 31)


def _position(seat: Column, source: dict[str, Column]) -> Column:
    """Where the document's block stands in its source's permuted order."""
    return (_block(seat, source["n_blocks"]) * source["factor"] + source["offset"]).bitwiseAND(source["n_blocks"] - 1)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """source, place, n_docs, source_size, target of a table (source, size); one row per source, null being one.

    In code point order, null last, the sources weigh `weights`, repeating. They share the sum of all sizes by
    weight; none gets more than cap times its size, and what is above goes to the others by weight until
    none is above. That is one water level: each pass over the sources sums those that it fills, which lifts it for the others, until it fills no more.
    Sums are decimal, so they are exact in any order. No step brings all sources to one task.
    """
    totals = settled(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")))
    placed = sorted_position(totals, ["source"], "place").withColumn("place", F.col("place") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1)
    weighed = settled(placed.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size")))
    exact = lambda c: F.col(c).cast("decimal(30,6)")
    level, full = 0.0, -1
    while True:
        over = F.lit(full >= 0) & (F.col("weight") * F.lit(level) > F.col("most"))
        now = weighed.agg(
            F.sum("source_size").alias("everything"),
            F.sum(F.when(over, exact("most"))).alias("filled"),
            F.sum(F.when(~over, exact("weight"))).alias("open"),
            F.coalesce(F.sum(over.cast("int")), F.lit(0)).alias("full"),
        ).first()
        if now.full == full or not now.open:
            break
        level, full = float((now.everything - (now.filled or 0)) / now.open), now.full
    water = F.col("weight") * F.lit(level)
    target = F.least("most", water) if full >= 0 else F.col("most")
    return weighed.select("source", "place", "n_docs", "source_size", target.alias("target"))


def split_quotas(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard, [shard, source], by a splitting tree.

    Each node deals its exact quotas to its two halves of the shards by one multivariate hypergeometric
    draw, in proportion to the shards they have; so the shards' shares are random and every sum is exact.
    """
    out = np.zeros((n_shards, len(quotas)), np.int64)
    draw = np.random.Generator(np.random.Philox(seed))
    stack = [(0, n_shards, np.array(quotas, np.int64))]
    while stack:
        low, high, here = stack.pop()
        if high - low == 1 or not here.sum():
            out[low] = here
            continue
        middle = (low + high) // 2
        left = draw.multivariate_hypergeometric(here, here.sum() * (middle - low) // (high - low), method="marginals")
        stack += [(middle, high, here - left), (low, middle, left)]
    return out


def _with_words_before(blocks: DataFrame) -> DataFrame:
    """Blocks (source, position, words) with the words of their source's blocks ahead of them: `before`.

    Sums run inside spans of SPAN neighbouring blocks first, and then over the spans of a source, so no task has to take all
    blocks of a source, only as many spans.
    """
    spanned = blocks.withColumn("span", F.floor(F.col("position") / SPAN))
    inside = Window.partitionBy("source", "span").orderBy("position")
    spans = spanned.groupBy("source", "span").agg(F.sum("words").alias("span_words"))
    ahead = F.sum("span_words").over(Window.partitionBy("source").orderBy("span")) - F.col("span_words")
    starts = spans.select(F.col("source").alias("span_source"), F.col("span").alias("span_at"), ahead.alias("start"))
    run = spanned.withColumn("run", F.sum("words").over(inside) - F.col("words"))
    joined = run.join(starts, F.col("source").eqNullSafe(F.col("span_source")) & (F.col("span") == F.col("span_at")))
    return joined.select(*blocks.columns, (F.col("start") + F.col("run")).alias("before"))


def mixing_plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, n_shards: int = 64, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The plan by source and the narrow table (doc_id, source, size, seat) that it was made from, both checkpointed.

    Plan: source, source_size, target, n_blocks, factor and offset (the permutation of blocks), cut (the last seat taken of the
    last block drawn, null for the whole block), ends (running block quotas of the shards, which are all that says what is drawn).

    A source's documents are dealt to blocks by hash, and each block's words are counted before any is drawn. The
    target fixes the block quota: whole passes over all blocks, then permuted blocks up to the one
    that the target ends in, of which documents are taken by seat to the nearest one. The tree deals these quotas
    to the shards; it is drawn in one task, over blocks' numbers alone. The passes over the permuted blocks, one after another, are the order in which
    shards draw: a shard takes the blocks between its end and that of the shard before.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"), _seat(seed, F.col("doc_id"), F.col("text")).alias("seat"))
    narrow = settled(rows)
    targets = source_targets(narrow, weights, cap)
    want = F.pow(2, F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n_docs") / BLOCK_DOCS))))
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(int(cap)), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    shaped = targets.select(
        "source", "place", "source_size", "target",
        F.least(want, F.lit(MAX_BLOCKS)).cast("long").alias("n_blocks"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source"), 40).bitwiseOR(F.lit(1)).cast("long").alias("factor"),
        F.shiftrightunsigned(F.xxhash64("source", F.lit(seed)), 40).cast("long").alias("offset"),
        epochs.cast("long").alias("epochs"),
    )
    shaped = settled(shaped.withColumn("extra", F.col("target") - F.col("epochs") * F.col("source_size")))
    joined = _with_source(narrow, shaped)
    placed = joined.withColumn("position", _position(F.col("seat"), _columns()))
    blocks = placed.groupBy("source", "position").agg(F.sum("size").alias("words"), F.first("extra").alias("extra"))
    running = _with_words_before(settled(blocks))
    last = running.where((F.col("before") < F.col("extra")) & (F.col("before") + F.col("words") > F.col("extra"))).select(
        F.col("source").alias("last_source"), F.col("position").alias("last_position"), (F.col("extra") - F.col("before")).alias("rest")
    )
    whole = running.where(F.col("before") + F.col("words") <= F.col("extra")).groupBy("source").agg(F.max("position").alias("whole"))
    inside = placed.join(last, F.col("source").eqNullSafe(F.col("last_source")) & (F.col("position") == F.col("last_position")))
    seats = Window.partitionBy("source").orderBy("seat")
    middle = F.sum("size").over(seats) - F.col("size") / 2
    cuts = inside.withColumn("middle", middle).where(F.col("middle") <= F.col("rest")).groupBy("source").agg(F.max("seat").alias("cut"))
    fulls = whole.join(last, F.col("source").eqNullSafe(F.col("last_source")), "full").select(
        F.coalesce("source", "last_source").alias("full_source"),
        F.coalesce(F.col("last_position"), F.col("whole") + 1, F.lit(0)).alias("full"),
    )
    cuts = cuts.withColumnRenamed("source", "cut_source")
    plan = settled(
        shaped.join(fulls, F.col("source").eqNullSafe(F.col("full_source")), "left")
        .join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
        .withColumn("full", F.when(F.col("extra") > 0, F.coalesce("full", F.lit(0))).otherwise(0))
        .withColumn("quota", F.col("epochs") * F.col("n_blocks") + F.col("full") + F.col("cut").isNotNull().cast("long"))
        .drop("full_source", "cut_source", "extra", "epochs", "full")
    )

    def draw(quotas: pd.DataFrame) -> pd.DataFrame:
        quotas = quotas.sort_values("place")
        ends = split_quotas(quotas["quota"].tolist(), n_shards, seed + int(quotas["tree"].iloc[0])).cumsum(axis=0)
        return pd.DataFrame({"place": quotas["place"].to_numpy(), "ends": list(ends.T)})

    trees = plan.select("place", "quota", F.floor(F.col("place") / TREE_SOURCES).alias("tree"))
    dealt = trees.groupBy("tree").applyInPandas(draw, "place long, ends array<long>")
    return settled(plan.join(dealt, "place").drop("place", "quota")), narrow


def _columns() -> dict[str, Column]:
    return {c: F.col(c) for c in ("n_blocks", "factor", "offset")}


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the columns of their source; broadcast while the sources are few, else an ordinary join."""
    side = sources.withColumnRenamed("source", "kl_source")
    if sources.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    return rows.join(side, F.col("source").eqNullSafe(F.col("kl_source"))).drop("kl_source")


def _draws(seat: Column, cap: float) -> Column:
    """The shards that draw the document, one for each pass over its source that reaches its block: array of (epoch, shard).

    A block's place in the passes lies between two ends of the shards' quotas, or past the last one, where no shard draws it.
    Of the last block drawn, only documents up to the cut are taken.
    """
    last = F.element_at("ends", -1) - 1

    def draw(epoch: Column) -> Column:
        place = epoch * F.col("n_blocks") + _position(seat, _columns())
        shard = F.size(F.filter("ends", lambda end: end <= place))
        taken = (place < last) | ((place == last) & F.coalesce(seat <= F.col("cut"), F.lit(True)))
        return F.when(taken, F.struct(epoch.alias("epoch"), shard.alias("shard")))

    passes = F.transform(F.sequence(F.lit(0), F.lit(int(cap))).cast("array<bigint>"), draw)
    return F.filter(passes, lambda drawn: drawn.isNotNull())


def mix_counts(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, n_shards: int = 64, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (its words, for each shard that draws it), shards.

    Null texts have size 0. Documents of size 0 may be drawn, at no words. Repeated rows share a seat and with it
    their fate. Reruns agree, as do runs on other clusters. No rows give no rows.
    """
    plan, narrow = mixing_plan(docs, weights, cap, n_shards, seed)
    drawn = _with_source(narrow, plan).withColumn("draws", _draws(F.col("seat"), cap))
    return drawn.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * F.size("draws")).alias("taken"),
        F.col("draws.shard").alias("shards"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, n_shards: int = 64, seed: int = 7) -> DataFrame:
    """The mixed table: documents with their columns as they were, as often as the mix takes them.

    Shards lie one after another, each in pseudo-random order. A large shard is cut by ranges of that order to parts of
    about PART_DOCS documents, neighbouring partitions, so a partition stays small whatever the table's size.
    """
    plan, narrow = mixing_plan(docs, weights, cap, n_shards, seed)
    parts = max(1, -(-narrow.count() // (n_shards * PART_DOCS)))
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    doc_id, source, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "source", "text"))
    seated = _with_source(plain.withColumn("seat", _seat(seed, doc_id, text)).withColumn("source", source), plan)
    drawn = seated.withColumn("draw", F.explode(_draws(F.col("seat"), cap)))
    dealt = drawn.withColumn("shard", F.col("draw.shard")).withColumn("turn", F.shiftrightunsigned(F.xxhash64("seat", "draw.epoch"), 1))
    part = F.shiftright(F.shiftrightunsigned("turn", 32) * parts, 31)
    placed = dealt.repartitionById(n_shards * parts, (F.col("shard") * parts + part).cast("int")).sortWithinPartitions("turn", "seat")
    return placed.select(*[f"c{k}" for k in range(len(names))]).toDF(*names)
