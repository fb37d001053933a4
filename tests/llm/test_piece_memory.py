"""What bounds the memory of op5: one Python worker a task, small searches, a bounded list of words."""

import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from delaylens.llm import pieces
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.piece_model_path())


def test_one_python_worker_a_task(spark):
    plan = entry.queries()["op5_pieces"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_one_pass_gives_what_two_give(documents, model):
    rows = [(1, "a b"), (2, None), (2, ""), (None, "no  id "), (5, "日本語 text\x00" * 300), (6, "x" * 3000)]
    df = documents(rows)
    two = pieces.decode_documents(pieces.encode_documents(df, model), model)
    assert sorted(map(str, pieces.encode_and_decode(df, model).collect())) == sorted(map(str, two.collect()))
    assert pieces.encode_and_decode(documents([]), model).count() == 0


def test_remembered_words_change_no_ids(model, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN", 40)
    rng = random.Random(2)
    known, most = pieces.Remembered(model), 0
    for _ in range(30):
        texts = pa.array(["".join(rng.choice("aet  hné漢\n") for _ in range(rng.randrange(40))) for _ in range(8)])
        for a, b in zip(pieces.encode(model, texts, known), pieces.encode(model, texts)):
            assert np.array_equal(a, b)
        most = max(most, len(known.words))
    assert 40 < most < 200


def test_words_are_searched_once(model, monkeypatch):
    searched = []
    search = pieces._search
    monkeypatch.setattr(pieces, "_search", lambda m, words: searched.extend(words.to_pylist()) or search(m, words))
    monkeypatch.setattr(pieces, "BYTES", 30)
    texts = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["some words come again", "again some words", "come"])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in pieces._encoder(model)([texts])) == 3
    assert sorted(searched) == [" again", " come", " some", " words"]
