"""Line deduplication by ranges of line hashes, with a keep bitmap in runs for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import LOWER, SPACES, UPPER, shuffle_width, texts

RING = 1 << 32


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _hash(line: Column, min_length: int) -> Column:
    """MD5 of the line's key; null for keys that are too short to count."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_length, F.md5(key))


def dealt_lines(docs: DataFrame, min_length: int, salts: int, width: int) -> DataFrame:
    """hash, salt, nid, text_hash, pos and range of every line that counts, dealt by ranges of the hash ring and sorted in them by hash, salt,
    descending document (nid is its id inverted, null last) and ascending position."""
    rows = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    hashes = F.transform(F.split("text", "\n", -1), lambda line: _hash(line, min_length))
    lines = rows.select("doc_id", "text_hash", F.posexplode(hashes).alias("pos", "hash")).where("hash IS NOT NULL")
    salt = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(salts))
    start = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    place = F.pmod(start + salt * (RING // salts), F.lit(RING))
    # None of these is ever null; said so, they keep Spark from adding filters to one use of the dealt lines and dealing them twice.
    keyed = lines.select(
        F.coalesce(F.unhex("hash"), F.lit(b"")).alias("hash"),
        F.coalesce(salt.cast("int"), F.lit(0)).alias("salt"),
        F.bitwise_not("doc_id").alias("nid"),
        "text_hash",
        "pos",
        F.coalesce(F.floor(place * width / RING).cast("int"), F.lit(0)).alias("range"),
    )
    return keyed.repartitionById(width, F.col("range"))


def dropped_lines(docs: DataFrame, min_length: int = 20, min_docs: int = 3, salts: int | None = None) -> DataFrame:
    """doc_id, text_hash, gone: the sorted positions of the lines that a document loses, where it loses any.

    Lines move once, to ranges of the hash ring, and are sorted by hash, descending document and position. In that order the first
    document of a hash is the one that keeps it, and the document at place min_docs shows that it is common; one pass with constant
    state finds both. A salt from the document turns the ring by a part of it, so the lines of a hot hash lie in `salts` ranges (by default an eighth of
    all ranges, 16 at least). So each range gives the first min_docs documents of its part of a hash, and the same ordered pass over these few
    gives the keeper and the verdict, which go back to the ranges that asked.
    """
    width = shuffle_width(docs.sparkSession)
    salts = salts or max(16, width // 8)
    stream = dealt_lines(docs, min_length, salts, width)
    first_line = Window.partitionBy("range", "hash", "salt").orderBy(F.asc_nulls_last("nid"), "text_hash", "pos")
    place = F.dense_rank().over(Window.partitionBy("range", "hash", "salt").orderBy(F.asc_nulls_last("nid")))
    new = F.row_number().over(first_line).alias("row")
    ranked = stream.select("range", "hash", "salt", "nid", new, place.alias("place"), F.lag("nid").over(first_line).alias("before"))
    heads = ranked.where((F.col("place") <= min_docs) & ((F.col("row") == 1) | ~F.col("nid").eqNullSafe(F.col("before"))))
    over_hash = Window.partitionBy("hash").orderBy(F.asc_nulls_last("nid"))
    both = over_hash.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # min_docs documents of each salt at most; texts of one id may lie in several
    first_of_id = (F.row_number().over(over_hash) == 1) | ~F.col("nid").eqNullSafe(F.lag("nid").over(over_hash))
    heads = heads.withColumn("counts", first_of_id.cast("int"))
    judged = heads.select("range", "hash", "salt", "row", F.first("nid").over(over_hash).alias("keeper"), F.sum("counts").over(both).alias("n"))
    verdicts = judged.where((F.col("n") >= min_docs) & (F.col("row") == 1)).select("range", "hash", "salt", "keeper")
    told = stream.join(verdicts.repartitionById(width, F.col("range")), ["range", "hash", "salt"])
    gone = told.where(~F.col("nid").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("nid", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    return gone.select(F.bitwise_not("nid").alias("doc_id"), "text_hash", "gone")


def runs_text(bitmap: Column) -> Column:
    """A keep bitmap as text: start+length of each run, joined by commas."""
    return F.array_join(F.transform(bitmap, lambda run: F.concat(run["start"].cast("string"), F.lit("+"), run["length"].cast("string"))), ",")


def keep_runs(gone: Column, n_lines: Column) -> Column:
    """The keep bitmap as runs: array of (start, length), from sorted positions that go."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda x: x + 1))
    ends = F.concat(gone, F.array(n_lines))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(runs, lambda run: run["length"] > 0)


def dedup_lines(docs: DataFrame, min_length: int = 20, min_docs: int = 3, salts: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, keep_bitmap, kept_text.

    A line's key is the line stripped of ASCII white space and lower-cased in A-Z. Keys of
    `min_length` code points or more that `min_docs` documents hold lose their lines in all of them but
    the document of the largest id, which keeps all of its own. keep_bitmap has a document's kept lines as
    run-length pairs (start, length).

    A null or empty text is one empty line. Rows that share an id are one document when documents are counted, and all of
    them keep the lines that it keeps. Null ids are one document, smaller than any other; where only they hold a key, all keep it. Lines are
    told apart by the 128-bit MD5 of their keys. No rows give no rows.
    """
    gone = dropped_lines(docs, min_length, min_docs, salts).toDF("gone_id", "gone_hash", "gone")
    rows = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    joined = rows.join(
        gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left"
    )
    lines = F.split("text", "\n", -1)
    bitmap = joined.withColumn("n_lines", F.size(lines)).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    bitmap = bitmap.withColumn("keep_bitmap", keep_runs(F.col("gone"), F.col("n_lines")))
    kept = F.flatten(F.transform("keep_bitmap", lambda run: F.slice(lines, run["start"] + 1, run["length"])))
    return bitmap.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        "keep_bitmap",
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
