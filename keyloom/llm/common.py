"""What several corpus operators share: column picking, shared folders and bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keyloom.session import importable, remove, shared_folder

#: Fixed value: the ASCII white space that the contracts name, `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\x0c\r"
#: The two ASCII alphabets for lower-casing A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that one Arrow batch of texts may have on its way to Python; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, matched by exact spelling.

    Other columns may have any names, also ones that differ from these by case alone; the first
    exact match counts. A name that is missing raises ValueError.
    """
    for name in names:
        if name not in df.columns:
            raise ValueError(f"column {name!r} is missing")
    importable(df.sparkSession)
    where = [df.columns.index(name) for name in names]
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.select(*[F.col(f"c{k}").alias(name) for k, name in zip(where, names, strict=True)])


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `text` (null becomes empty) and further columns of a table of documents."""
    rows = pick(docs, id_col, text_col, *more)
    return rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settled(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` cut from its lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a Python worker's memory stays bounded.

    Spark reads the setting when a lazy table runs at last, so all operators set the one same value, and no call changes what another has
    set up. A smaller value of the session stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def sieved(rows: DataFrame, value: Column, keys: DataFrame) -> DataFrame:
    """`rows` with kl_maybe: false for rows whose `value`, a 64-bit hash, is surely none of the hashes in keys (one column).

    So rows that can't meet a key need no shuffle to a join with keys. The hashes mark bits of a bitmap of 16 bits for each key, 2^27 bits (16 MB) at
    most, which is broadcast whatever the number of keys; beyond 8 million keys it lets more and more rows through, and at last
    all of them, which the join then has to sort out.
    """
    name = keys.columns[0]
    bits = max(1 << 15, min(1 << 27, 1 << (16 * keys.count()).bit_length()))
    place = lambda x: F.pmod(x, F.lit(bits)) + 1
    marks = keys.select(place(F.col(name)).alias("n")).groupBy(F.bitmap_bucket_number("n").alias("kl_bucket"))
    marks = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("kl_marks"))  # 4 KB for each of 4096 rows at most
    placed = rows.withColumn("kl_place", place(value)).withColumn("kl_bucket", F.bitmap_bucket_number("kl_place"))
    found = placed.join(F.broadcast(marks), "kl_bucket", "left")
    at = F.bitmap_bit_position("kl_place")
    byte = F.conv(F.hex(F.substring("kl_marks", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8))), F.lit(2)) >= 1
    return found.withColumn("kl_maybe", F.coalesce(bit, F.lit(False))).drop("kl_place", "kl_bucket", "kl_marks")


def one_row_each(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose (doc_id, text_md5) isn't in `gone`, one of each such pair, with all their columns as they were.

    Rows that repeat both are told apart by a hash of their other columns; the smallest stays. Only where
    there are any, they are joined and combined, partly before the shuffle, so a row may be repeated without bound.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    rest = [c for c, name in zip(plain.columns, names, strict=True) if name not in (id_col, text_col)]
    marked = plain.withColumn("kl_md5", F.unhex(F.md5(F.coalesce(text, F.lit("")))))
    doc_id = doc_id.cast(gone.schema["doc_id"].dataType)
    same = doc_id.eqNullSafe(F.col("doc_id")) & (F.col("kl_md5") == F.col("text_md5"))
    pairs = marked.select(doc_id.alias("doc_id"), F.col("kl_md5").alias("text_md5")).groupBy("doc_id", "text_md5").agg(F.count(F.lit(1)).alias("n"))
    again = settled(pairs.where("n > 1").select("doc_id", "text_md5"))
    gone = settled(gone.select("doc_id", "text_md5"))
    asked = gone.union(again).select(F.xxhash64("doc_id", "text_md5"))
    told = sieved(marked, F.xxhash64(doc_id, "kl_md5"), asked)
    left = told.where("kl_maybe").join(gone, same, "left_anti")
    if not again.isEmpty():
        printed = left.withColumn("kl_print", F.xxhash64(F.to_json(F.struct(*rest)) if rest else F.lit(0)))
        repeated = printed.join(again, same, "left_semi")
        first = repeated.groupBy(doc_id.alias("doc_id"), F.col("kl_md5").alias("text_md5")).agg(F.min("kl_print").alias("first_print"))
        chosen = repeated.join(first, same & (F.col("kl_print") == F.col("first_print")), "left_semi").drop("kl_print")
        once = chosen.groupBy(doc_id.alias("kl_id"), F.col("kl_md5").alias("kl_same")).agg(*[F.first(c).alias(c) for c in plain.columns])
        left = left.join(again, same, "left_anti").select(*plain.columns).unionByName(once.select(*plain.columns))
    sure = told.where("NOT kl_maybe").select(*plain.columns)
    return sure.unionByName(left.select(*plain.columns)).toDF(*names)


def rejoin(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows with what an aggregation by `on` says of their group.

    The join goes by a hash of the key as well. So it deals the groups anew, by a shuffle of the small side, and adaptive execution
    may split the rows of a large group over tasks; on the aggregation's own partitioning it can't.
    """
    keyed = [df.withColumn("kl_key", F.xxhash64(*on)) for df in (rows, groups)]
    return keyed[0].join(keyed[1], ["kl_key", *on], how).drop("kl_key")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(sizes: list[int], limit: int) -> Iterator[slice]:
    """Runs of neighbours whose sizes sum to `limit` at most; a single larger one is a run of its own."""
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield slice(start, k)
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def map_columns(df: DataFrame, ddl: str, fn: Callable[[dict[str, list]], Iterator[dict[str, object]]]) -> DataFrame:
    """Run `fn` over Arrow batches as plain lists by column; it yields dictionaries of lists or arrays in `ddl`'s order.

    Unlike a detour by pandas, 64-bit ids keep all their digits beside nulls.
    """
    schema = T.StructType.fromDDL(ddl)
    target = to_arrow_schema(schema)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn({name: batch.column(k).to_pylist() for k, name in enumerate(names)}):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)
