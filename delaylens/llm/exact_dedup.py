"""Exact duplicates by a 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm.tables import table, texts


def exact_dedup(
    docs: DataFrame,
    keep: str = "min",
    normalise: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] = lambda text: F.unhex(F.md5(text)),
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by their hash and, inside it, by their bytes: text is part of the grouping
    key, so a collision makes two groups. Copies meet in the map-side aggregate, so a group with
    a third of all rows reaches the shuffle as one row per task. ``keep`` says whether the
    smallest or the largest doc_id of a group stays. Only digests travel back to the documents.

    Null texts are empty texts, equal to each other. Repeated rows with one doc_id each give a
    row, all kept if that id stays. A null doc_id never stays, unless the group has no other.
    An empty table gives an empty result.
    """
    d = texts(docs)
    if normalise is not None:
        d = d.withColumn("text", normalise(F.col("text")))
    d = d.withColumn("h", digest(F.col("text")))
    best = F.min if keep == "min" else F.max
    groups = (
        d.groupBy("h", "text")
        .agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    narrow = d.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"))
    return narrow.join(groups, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def distinct_documents(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The documents whose row stays, with all columns, a null doc_id included if its group has no other."""
    ids = exact_dedup(docs, keep).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    same = docs["doc_id"].cast("bigint").eqNullSafe(ids["_id"]) & (F.sha2(text, 256) == ids["_sha"])
    return docs.join(ids, same, "left_semi").select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


SQL = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g ON d.text = g.text"""
}
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
