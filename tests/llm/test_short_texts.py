from pyspark.sql import functions as F

from delaylens.llm import language

FOLDER = "/root/testdata/sf0.01"


def test_short_clean_texts_stay(spark, documents):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    learned = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    rows = [(1, "By be in tothedouou and, oninly."), (2, "A all rights reserved."), (3, "Anouble thwh."), (4, "12")]
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.classify(documents(rows), learned).collect()}
    assert got == {1: ("en", False), 2: ("en", False), 3: ("en", False), 4: ("und", True)}
    short = language.classify(docs.where("n_chars < 60"), learned).agg(F.sum(F.col("rejected").cast("int")).alias("n")).first()
    assert (short.n or 0) == 0


def test_equal_languages_are_still_rejected(documents):
    got = language.classify(documents([(1, "the same words")]), {"aa": b"the same words here", "bb": b"the same words here"}).first()
    assert got.rejected and got.score == 0
