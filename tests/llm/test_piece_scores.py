import zlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from delaylens.llm import pieces
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def ranked():
    return pieces.load(pieces.piece_model_path())


def test_common_words_stay_whole(spark, ranked):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = pieces.learned(docs, ranked)
    assert [len(pieces._search(model, [w])[0]) for w in (b" the", b" language", b" government")] == [1, 1, 1]
    texts = pa.array([r.text for r in docs.select("doc_id", "text").collect()])
    assert len(pieces.encode(model, texts)[0]) < 0.92 * len(pieces.encode(ranked, texts)[0])


def test_query_searches_with_learned_scores(spark, ranked):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = pieces.learned(docs, ranked)
    text = docs.where("doc_id = 3").first().text
    ids, _ = pieces.encode(model, pa.array([text]))
    row = entry.queries()["op5_pieces"](spark, SMALL).where("doc_id = 3").first()
    assert (row.n_pieces, row.ids_crc32) == (len(ids), zlib.crc32(ids.astype("<u4")))


def test_counts_by_hand(documents):
    m = pieces.build(["<unk>", "▁a", "b", "ab", "▁"], [0, -1.0, -2.0, -1.5, -1.0], ["unknown", "text", "text", "text", "text"])
    docs = documents([(1, "ab ab"), (2, "ab  b"), (3, None), (None, "ab")])
    assert {(bytes(r.word), r.n) for r in pieces.word_counts(docs).collect()} == {(b" ab", 4), (b"  b", 1)}
    n = pieces._piece_counts(pieces.word_counts(docs), m, anywhere=True)
    assert n.tolist() == [0, 4, 5, 4, 6]  # " a", "b", "ab", " "
    got = pieces.learned(docs, m, rounds=0)
    assert np.allclose(np.exp(got.score), (n + 0.5) / (n.sum() + 2.5))
    assert np.isfinite(pieces.learned(documents([]), m).score).all()
