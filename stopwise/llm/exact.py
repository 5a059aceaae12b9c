"""Exact deduplication: groups by a 128-bit content hash, bytes compared inside groups (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, stored, text_of


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, content hash, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space is deleted; a null text is the empty
    text.  Of equal texts the one with the most code points stays, then the smallest id
    (null ids last).  Rows that repeat one id with one text are one document with copies:
    only one of them is kept.  An empty table gives an empty result; other columns are ignored.

    The hash groups are counted with map-side aggregation, so a group of any size costs
    one row per task.  Only members of groups of two or more travel with their text, to be
    compared with the text that stays; the join is one that Spark splits when skewed.
    Members whose bytes differ (a collision of hashes) form groups of their own by their bytes.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.translate(text_of(text_col), WHITE, "").alias("norm"), F.char_length(text_of(text_col)).cast("long").alias("len")
    ).withColumn("h", F.unhex(F.md5(F.encode("norm", "UTF-8"))))
    first = F.struct((-F.col("len")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    copies = stored(rows.groupBy("h", "doc_id", "len", F.sha2(F.col("norm"), 256).alias("sha")).agg(F.count("*").alias("copies")))
    # Written, so that joins with it are plain joins, which Spark splits where one text has very many members.
    groups = stored(copies.groupBy("h").agg(F.sum("copies").alias("group_size"), F.min(first).alias("top"), F.count("*").alias("members")))
    # Bytes are compared in groups of two or more documents.
    member = stored(rows.join(groups.filter("members > 1").select("h", "top"), "h").select("h", "doc_id", "len", "norm", "top"))
    top = member.filter(first.eqNullSafe(F.col("top"))).groupBy("h").agg(F.min("norm").alias("top_norm"))
    odd = stored(member.drop("top").join(top, "h").filter("norm <> top_norm").drop("top_norm"))
    classes = odd.groupBy("h", "norm").agg(F.count("*").alias("o_size"), F.min(first).alias("o_top"))
    apart = odd.distinct().join(classes, ["h", "norm"]).select(F.col("h").alias("o_h"), F.col("doc_id").alias("o_id"), F.col("len").alias("o_len"), F.sha2("norm", 256).alias("o_sha"), "o_size", "o_top")
    lost = odd.groupBy("h").agg(F.count("*").alias("lost"))
    out = copies.join(groups, "h").join(lost, "h", "left")
    at = (out["h"] == apart["o_h"]) & (out["sha"] == apart["o_sha"]) & (out["len"] == apart["o_len"]) & out["doc_id"].eqNullSafe(apart["o_id"])
    out = out.join(apart, at, "left").select(
        "h", "doc_id", "len", "sha", "copies", F.coalesce("o_top", "top").alias("top"), F.coalesce(F.col("o_size"), F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size")
    )
    best = first.eqNullSafe(F.col("top"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", F.col("h").alias("content_hash"), F.col("top.c").alias("keep_id"), "group_size", (best & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"), F.col("len").alias("n_code_points")
    )


def one_of_each(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row of those that agree in keys: the one with the smallest text, then the smallest hash of all columns."""
    alike = [c for c, kind in rows.dtypes if "map<" not in kind]
    w = Window.partitionBy(*keys).orderBy(text_col, F.xxhash64(*alike))
    return rows.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")  # each task sends one row a group


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts (see exact_groups).

    Null texts are empty ones; where rows repeat id and text, the one with the smallest original text stays, then the
    one with the smallest hash of all columns; an empty table gives an empty result.
    """
    kept = exact_groups(docs, id_col, text_col).filter("kept")
    kept = kept.select(F.col("doc_id").alias("_k_id"), F.col("content_hash").alias("_k_h"), F.col("n_code_points").alias("_k_n"))
    mine = F.unhex(F.md5(F.encode(F.translate(text_of(text_col), WHITE, ""), "UTF-8")))
    rows = docs.withColumns({"_h": mine, "_n": F.char_length(text_of(text_col)).cast("long")})
    same = (rows["_h"] == kept["_k_h"]) & (rows["_n"] == kept["_k_n"]) & rows[id_col].eqNullSafe(kept["_k_id"])
    # More than one row is left only where one id and text are repeated.
    return one_of_each(rows.join(kept, same, "left_semi"), ["_h", id_col], text_col).select(*docs.columns)
