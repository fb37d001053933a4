"""The pipeline's stages against plain Python, on a small table with every kind of case."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from delaylens.llm.tokens import TextEncoder, vocabulary_path
from tests.llm.test_jaccard_join import brute_force, family
from tests.llm.test_packing import check

EN = "the thing is that there are some of them and they have been with this one for all "
DE = "und der die das nicht ist auch für über mit einer noch wird sind dem den ein "


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, EN * 3 + t, "en") for i, t in enumerate(family(9, 25, 3))]
    rows += [(100 + i, DE * 4 + f"nummer eins{i} zwei{i} drei{i} vier{i} " * 6, "de") for i in range(25)]
    rows += [(200, EN * 4 + "write to jo.do@mail.example or +1 (234) 567-8901 or 10.0.0.1", "en"), (300, rows[0][1], "en"), (301, rows[30][1], "de")]
    rows += [(400, None, "en"), (401, "", None), (402, "12 34 !!", "de"), (403, "4111 1111 1111 1111 " + DE * 3, None)]
    return spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact dedup", "near dedup", "personal data", "packing"]
    left, texts = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, "").cache()
        assert left.columns == docs.columns, name
        rows = {r.doc_id: r.text for r in left.collect()}
        if name == "language":
            want = {i for i, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
            assert set(rows) == want
        elif name == "exact dedup":
            assert set(rows) == {max(j for j in texts if texts[j] == t) for t in texts.values()}
        elif name == "near dedup":
            assert set(rows) == {c for _, _, c in brute_force(sorted(texts.items()))}
        else:
            assert set(rows) == set(texts)
            assert "<email> or <phone> or <ip>" in rows[200] and rows[403].startswith("<card>")
            assert all(rows[i] == texts[i] for i in rows if i not in (200, 403))
        if name != "personal data":
            assert all(rows[i] == texts[i] for i in rows)
        texts = rows
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, "").collect()
    check(sorted(texts.items()), pieces, TextEncoder(vocabulary_path()))


def test_empty_table(spark, docs, tmp_path):
    docs.where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
