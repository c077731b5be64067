"""Exact deduplication by 128-bit content hash, with a comparison of bytes inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import one_row_each, rejoin, settled, sieved, texts


def exact_groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, text_md5.

    Documents are grouped by MD5 (128 bits), counted partly before the shuffle. Inside the hash groups of several rows whole texts are compared byte by
    byte, as keys of an aggregate: texts that collide form groups of their own. Exact copies are
    combined before that shuffle, so a group of any size sends one row for each task; texts that no other row may equal
    don't move. The join back to the documents carries hashes only and may be split where a group is large.

    keep: "min" or "max", the id of a group that stays. A null text counts as empty. Null ids lose
    against any other; a group of null ids only keeps them. Rows that repeat both id and text are
    one document written twice: they share its fate here, and drop_copies leaves one of them. No rows give no rows.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    best = F.min if keep == "min" else F.max
    rows = texts(docs, id_col=id_col, text_col=text_col).withColumn("text_md5", F.unhex(F.md5("text")))
    hashed = settled(rows.select("doc_id", "text_md5", F.sha2("text", 256).alias("text_sha256")))
    several = settled(hashed.groupBy("text_md5").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("text_md5").alias("hash")))
    compared = (
        sieved(rows, F.xxhash64("text_md5"), several)
        .where("kl_maybe")
        .groupBy("text_md5", "text")
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("text_md5", F.sha2("text", 256).alias("text_sha256"), "keep_id", "n")
    )
    # Both digests name a text from here on. Should two different texts ever share both, the job stops.
    groups = compared.groupBy("text_md5", "text_sha256").agg(
        F.max("keep_id").alias("keep_id"),
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long"))
        .otherwise(F.sum("n"))
        .alias("group_size"),
    )
    joined = rejoin(hashed, groups, ["text_md5", "text_sha256"], "left")
    keep_id = F.coalesce("keep_id", "doc_id")
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
        "text_md5",
    )


def drop_copies(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns as they were; see exact_groups and one_row_each."""
    gone = exact_groups(docs, keep, id_col, text_col).where(~F.col("kept")).select("doc_id", "text_md5").distinct()
    return one_row_each(docs, gone, id_col, text_col)
