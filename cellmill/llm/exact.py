"""Exact duplicate removal with built-in expressions only.

Texts are grouped by a 128-bit content hash *and* their bytes: the hash decides
which shuffle partition and hash-table slot a text goes to, and the comparison
of the grouping key compares whole texts, so that a collision splits into two
groups.  The aggregation combines copies before the shuffle; a group that holds
a third of all rows sends one row per map task.  Members find their group again
by the hash and a SHA-256 digest of the text, in a join whose large partitions
Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.common import text_of


def _hash():
    return F.unhex(F.md5("_text")).alias("_hash")


def _digest():
    return F.sha2("_text", 256).alias("text_sha256")


def _groups(rows: DataFrame, keep: str) -> DataFrame:
    """_hash, text_sha256, keep_id, group_size of each distinct text."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    pick = F.min if keep == "smallest" else F.max
    groups = rows.select("_id", _hash(), "_text").groupBy("_hash", "_text").agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("_hash", _digest(), "keep_id", "group_size")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    keep: ``smallest`` or ``largest`` id of a group stays.
    Null text counts as empty text.  A null id never names the row that stays,
    unless all ids of the group are null: then keep_id is null and kept is true
    for all of them, since nothing tells them apart.  Rows that repeat an id
    within a group share its verdict.  An empty table gives an empty result;
    other columns are neither read nor returned.
    """
    rows = df.select(F.col(id_col).alias("_id"), text_of(df, text_col).alias("_text"))
    groups = _groups(rows, keep)
    members = rows.select("_id", _hash(), _digest())
    return members.join(groups, ["_hash", "text_sha256"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of df that exact_dedup keeps, with the columns of df."""
    rows = df.select(F.col(id_col).alias("_id"), text_of(df, text_col).alias("_text"))
    groups = _groups(rows, keep).select("_hash", F.col("text_sha256").alias("_digest"), F.col("keep_id").alias("_keep"))
    hashed = df.withColumn("_text", text_of(df, text_col)).withColumns({"_hash": _hash(), "_digest": F.sha2("_text", 256)})
    kept = hashed.join(groups, ["_hash", "_digest"]).where(F.col(f"`{id_col}`").eqNullSafe(F.col("_keep")))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
