import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from delaylens.llm import language

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = entry.queries()["op1_language_id"](spark, FOLDER).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in rows) < 0.02 * len(rows)
    assert all(r.n_chars < 100 for r in rows if r.rejected)


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where(~language.held_out(F.col("doc_id")))
    return language.train(docs)


def test_edge_cases(documents, learned):
    long = "the thing is that there are of and with this " * 20_000
    rows = [(1, None), (2, ""), (3, "123 !! ##"), (4, "und der die das nicht ist auch für über"), (5, long), (5, long)]
    df = documents(rows).withColumn("score", F.lit(9)).withColumn("lang_pred", F.lit("x"))
    got = sorted(tuple(r) for r in language.classify(df, learned).collect())
    assert [g[1] for g in got] == ["und", "und", "und", "de", "en", "en"]
    assert [g[3] for g in got] == [True, True, True, False, False, False]
    assert language.classify(documents([]), learned).count() == 0


def test_labels_missing_or_single(documents):
    none = documents([(1, "some text", None), (2, "more text", None)])
    assert {r.lang_pred for r in language.identify(none).collect()} == {"und"}
    one = documents([(1, "some text", "xx"), (2, "more text", None), (3, None, "xx")])
    assert {(r.doc_id, r.lang_pred) for r in language.identify(one).collect()} == {(1, "xx"), (2, "xx"), (3, "und")}


def test_sample_is_bounded_and_ignores_held_out(documents):
    rows = [(i, f"text {i}", "aa" if i % 2 else "bb") for i in range(3000)]
    found = language.train(documents(rows))
    assert list(found) == ["aa", "bb"] and all(len(d.split(b"text")) <= language.SAMPLE_DOCUMENTS + 1 for d in found.values())
