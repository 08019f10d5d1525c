"""Exact duplicates by skew-safe combining.

Texts are equal when equal without white space. Three merges find the groups: inside each
input task (Spark's partial aggregation), per digest and salt, and per digest over the
salts' winners. Every merge has the whole normalised text in its key beside the digest, so
texts are compared in full and a clash of digests merges nothing. A text with any number of
copies reaches the last merge as at most ``SALTS`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from planes.llm.common import WHITE, stage

SALTS = 16
# A digest is hot, and salted, above this share of all rows; so at most that many are hot.
HOT_SHARE = 4096


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chars (code points of the text as it came), body (without white space), digest, check."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("chars"),
        F.regexp_replace(text, f"{WHITE}+", "").alias("body"),
    ).select("*", F.unhex(F.sha2("body", 256)).alias("digest"), F.xxhash64("body").alias("check"))


def winner():
    """Most code points first, then the smallest id; a null id comes last."""
    return F.struct((-F.col("chars")).alias("less"), F.isnull("doc_id").alias("unnamed"), F.col("doc_id").alias("id"))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group of equal texts: digest, check, group_size, best."""
    rows = normalised(docs, id_col, text_col)
    total = docs.count()
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    hot = sizes.where(F.col("copies") > total / HOT_SHARE).select("digest", F.lit(True).alias("hot"))
    # The broadcast side has at most HOT_SHARE digests, however large the input.
    salted = rows.join(F.broadcast(hot), "digest", "left").select(
        "digest", "check", "body", "hot", winner().alias("best"),
        F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "chars"), F.lit(SALTS))).otherwise(F.lit(0)).alias("salt"),
    )
    merged = salted.groupBy("digest", "check", "hot", "salt", "body").agg(
        F.count(F.lit(1)).alias("n"), F.min("best").alias("best")
    )
    # A digest that is not salted is whole already: it goes on without its text, under a key of its own.
    last = merged.select(
        "digest", "check", "n", "best",
        F.when(F.col("hot"), F.col("body")).alias("body"),
        F.when(F.col("hot"), F.lit(-1)).otherwise(F.monotonically_increasing_id()).alias("own"),
    )
    return last.groupBy("digest", "check", "body", "own").agg(
        F.sum("n").alias("group_size"), F.min("best").alias("best")
    ).select("digest", "check", "group_size", "best")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points as it came stays, then the smallest
    id; a null id comes last. Null and empty texts, and those of white space alone, are one
    group. Rows repeated with the same id and the same text are one document: each counts
    in group_size and all have the same kept. Other columns are not read.
    """
    best = stage(winners(docs, id_col, text_col), "exact-winners")
    rows = normalised(docs, id_col, text_col).drop("body")
    return rows.join(best, ["digest", "check"]).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.id")) & (-F.col("chars") == F.col("best.less"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated in id and text, one."""
    best = stage(winners(docs, id_col, text_col), "exact-winners").select(
        F.col("digest").alias("__best"), F.col("best.id").alias("__id")
    )
    body = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{WHITE}+", "")
    keyed = docs.withColumn("__digest", F.unhex(F.sha2(body, 256)))
    kept = keyed.join(
        best, (F.col("__digest") == F.col("__best")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left_semi"
    )
    return kept.dropDuplicates(["__digest", id_col]).drop("__digest")
