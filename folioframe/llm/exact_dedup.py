"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import ascii_lower

PREFIX = 64  # characters that the second level hashes


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=ascii_lower,
    with_digest: bool = False,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept; on request text_sha256.

    Texts are equal when ``normalise`` makes them identical; of equal texts the row
    with the largest id stays.

    Level 1 counts rows by byte length, level 2 by length and hash of the first
    characters, both on narrow rows.  Only rows whose group still has company are
    hashed in full: their text travels once, keyed by the unique id, so that a group
    with a third of all rows is dealt evenly.  Level 3 groups (length, SHA-256).
    ``with_digest`` asks for the hash of the other rows too; it is taken in the scan.

    A null text counts as empty.  Of repeated rows with one id, one stays.  A null id
    is smaller than any other.  Other columns are ignored, so their names cannot clash.
    An empty table gives an empty result.
    """
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    # the normalised text has the byte length of the given one only if normalise keeps it
    size = F.octet_length(text if normalise is not ascii_lower else F.coalesce(F.col(text_col), F.lit("")))
    head = F.xxhash64(normalise(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, PREFIX)))

    levels = docs.select(F.col(id_col).alias("_id"), size.alias("_len"), head.alias("_head"))
    by_len = _many(levels.groupBy("_len"))
    by_head = _many(levels.join(by_len, "_len", "left_semi").groupBy("_len", "_head"))
    left = levels.join(by_head, ["_len", "_head"], "left_semi").select(F.col("_id").alias("_survivor"))
    same = F.col("_id").eqNullSafe(F.col("_survivor"))

    full = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(left, same, "left_semi")
    full = full.select("_id", F.octet_length("_text").alias("_len"), F.sha2("_text", 256).alias("_sha"))
    groups = full.groupBy("_len", "_sha").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    one = Window.partitionBy("_len", "_sha", "_id").orderBy("_id")
    found = full.withColumn("_n", F.row_number().over(one)).join(groups, ["_len", "_sha"])
    kept = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == 1)

    rest = docs.select(F.col(id_col).alias("_id"), (F.sha2(text, 256) if with_digest else F.lit(None)).alias("_sha"))
    rest = rest.join(left, same, "left_anti")
    out = found.select("_id", "_sha", "keep_id", "group_size", kept.alias("kept")).unionByName(
        rest.select("_id", "_sha", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    )
    digest = [F.col("_sha").alias("text_sha256")] if with_digest else []
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", *digest)


def _many(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
