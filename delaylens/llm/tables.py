"""Reading the given tables and storing what several later steps need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty: other columns can't clash."""
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    For results that feed several branches, and to cut lineage: the files outlive any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share_by_hash(col: Column | str, rows: int, wanted: int) -> Column:
    """Rows whose hash is so small that about twice ``wanted`` of ``rows`` have one.

    Put before taking the smallest hashes, it keeps every task from sending ``wanted`` rows.
    """
    share = min(1.0, 2 * (wanted + 32) / max(rows, 1))
    return F.xxhash64(col) <= F.lit(2**63 - 1 if share == 1 else int(share * 2**64) - 2**63)


def crc32_of_id(col: Column) -> Column:
    return F.crc32(col.cast("string"))
