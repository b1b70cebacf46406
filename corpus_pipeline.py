"""A training corpus from the documents table: the corpus operators one after another.

Each stage works on all that the one before kept.  Its result is written to the
shared folder as Parquet and read again, so that a lost executor costs one stage
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.llm.common import delete, scratch, table, written
from cellmill.llm.exact import keep_one
from cellmill.llm.minhash import MinHashParams, near_duplicates
from cellmill.llm.packing import pack, token_pieces
from cellmill.llm.quality import keep_good
from cellmill.llm.suffixes import repeated_bytes

CAPACITY = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules of their language and source."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8), the document with the smallest id."""
    gone = near_duplicates(docs, p=MinHashParams(words=5, similar=80)).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what a document of smaller id has too, in strings of 50 bytes and more.  Documents of which nothing but
    white space remains go."""
    cut = repeated_bytes(docs, carry=["lang", "source", "n_chars"], whole_characters=True)
    text = F.col("kept").cast("string")
    touched = F.size("spans") > 0
    cut = cut.withColumns({"text": text, "n_chars": F.when(touched, F.length(text).cast("long")).otherwise(F.col("n_chars"))})
    return cut.where(~touched | F.col("text").rlike("\\S")).select("doc_id", "text", "lang", "source", "n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, in as few sequences as the search finds: a row for each piece with its ids and its place."""
    import public_tokenizers

    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, CAPACITY, end_id=0, added=False, ids=True), CAPACITY)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("repeats", repeats), ("packing", packing)]

#: No SQL: MinHash components, the byte cuts and the packing search have none that runs on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as s:
            docs = s.keep(written(stage(spark, docs, sf_dir), f"stage-{name}"))
        for path in before:  # nothing reads it any more
            delete(spark, path)
        before = list(s.kept)
    return STAGES[-1][1](spark, docs, sf_dir)
