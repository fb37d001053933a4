import hashlib

from pyspark.sql import functions as F

import __spark_entry__ as entry
from delaylens.llm.exact_dedup import distinct_documents, exact_dedup
from tests.conftest import SMALL
from tests.harness import differences


def test_same_as_sql(spark, con):
    df = entry.queries()["op4_exact_dedup"](spark, SMALL).withColumn("kept", F.col("kept").cast("string"))
    sql = f"SELECT * REPLACE (CAST(kept AS VARCHAR) AS kept) FROM ({entry.oracle_sql()['op4_exact_dedup']})"
    assert differences(df, con, sql) == []


def test_nulls_ties_and_empty(spark, documents):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 300_000), (6, "b" * 300_000), (7, "A"), (7, "A")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(documents(rows), "max").collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 6, 2, False),
                   (6, 6, 2, True), (7, 7, 2, True)}
    assert exact_dedup(documents(rows), "max").count() == len(rows)
    assert exact_dedup(documents([])).count() == 0
    sha = exact_dedup(documents([(1, "é")])).first().text_sha256
    assert sha == hashlib.sha256("é".encode()).hexdigest()


def test_collisions_are_told_apart_by_bytes(documents):
    weak = exact_dedup(documents([(1, "ab"), (2, "cd"), (3, "ab")]), digest=lambda t: F.unhex(F.hex(F.length(t))))
    assert {(r.doc_id, r.keep_id) for r in weak.collect()} == {(1, 1), (2, 2), (3, 1)}


def test_other_columns_do_not_clash(documents):
    df = documents([(1, "x"), (2, "x")]).withColumn("h", F.lit(1)).withColumn("kept", F.lit("k")).withColumn("keep_id", F.lit(0))
    assert exact_dedup(df).where("kept").count() == 1
    assert distinct_documents(df, "max").columns == df.columns


def test_normaliser_is_optional(documents):
    df = documents([(1, "X "), (2, "x")])
    assert exact_dedup(df).where("kept").count() == 2
    assert exact_dedup(df, normalise=lambda t: F.lower(F.trim(t))).where("kept").count() == 1
