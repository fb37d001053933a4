import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from delaylens.llm import pieces
from tests.conftest import SMALL

ODD = ["", " ", "  ", "a", " a", "a ", "Hello  world \n x é 😀 ", "▁ literal", "日本語 text", "tab\tand\x00nul", "x" * 3000, "a   b    c ", "ß" * 50]


def plain_viterbi(model_pieces, scores, low, text):
    """Best total score by dictionary look-up over the whole text, no words, no trie."""
    if not text:
        return 0.0
    text = " " + text
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        covered = False
        for j in range(i + 1, min(len(text), i + 48) + 1):
            k = model_pieces.get(text[i:j])
            if k is not None:
                covered |= j == i + 1
                best[j] = max(best[j], best[i] + scores[k])
        if not covered:
            best[i + 1] = max(best[i + 1], best[i] + low)
    return best[-1]


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.piece_model_path())


def parts(model, texts):
    ids, n = pieces.encode(model, pa.array(texts, pa.string()))
    assert n.sum() == len(ids)
    return ids, n, np.split(ids, np.cumsum(n)[:-1])


def test_best_score_and_round_trip(model):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_model_path())
    known = {p.id_to_piece(i).replace(pieces.MARKER, " "): i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("aet ihn  é漢\n") for _ in range(rng.randrange(60))) for _ in range(200)]
    ids, n, each = parts(model, texts)
    assert pieces.decode(model, ids, n) == texts
    byte_ids = set(model.byte_piece.tolist())
    for text, found in zip(texts, each):
        runs = b"".join(bytes([int(p.id_to_piece(int(i))[3:5], 16)]) if int(i) in byte_ids else b" " for i in found).decode()
        lone = sum(c != " " for c in runs)
        total = sum(model.score[i] for i in found if int(i) not in byte_ids) + lone * model.unknown_score
        assert total == plain_viterbi(known, model.score, model.unknown_score, text), text[:80]


def test_small_vocabulary_without_bytes():
    m = pieces.build(["<unk>", "▁a", "b", "ab", "▁"], [0, -1.0, -2.0, -1.5, -1.0], ["unknown", "text", "text", "text", "text"])
    ids, n = pieces.encode(m, pa.array(["ab", "b", "aab", "z"]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[4, 3], [4, 2], [1, 3], [4, 0]]
    with pytest.raises(ValueError):
        pieces.build(["a▁b"], [0.0], ["text"])


def test_trie_holds_exactly_its_keys():
    rng = random.Random(1)
    keys = {bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randrange(1, 7))): i for i in range(500)}
    base, check, value = pieces.double_array(keys)

    def look(key):
        s = 0
        for c in key:
            t = base[s] + c
            if check[t] != s:
                return -1
            s = t
        return value[s]

    assert all(look(k) == v for k, v in keys.items())
    others = [bytes(rng.choice(b"abcd\xff\x00") for _ in range(rng.randrange(1, 8))) for _ in range(2000)]
    assert all(look(k) == keys.get(k, -1) for k in others)


def test_whole_table(spark, model):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = entry.queries()["op5_pieces"](spark, SMALL).collect()
    assert {r.doc_id: r.text_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows.items()}
    some = next(r for r in got if r.doc_id == 3)
    ids, n = pieces.encode(pieces.learned(docs, model), pa.array([rows[3]]))
    assert (some.n_pieces, some.ids_crc32) == (len(ids), zlib.crc32(ids.astype("<u4")))


def test_edge_cases(documents, model, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH", 50)
    rows = [*enumerate(ODD), (50, None), (51, "long words " * 5000), (51, "again")]
    df = documents(rows).withColumn("ids", F.lit(1)).withColumn("n_pieces", F.lit("x"))
    got = pieces.decode_documents(pieces.encode_documents(df, model), model).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((i, t or "") for i, t in rows)
    assert pieces.encode_documents(documents([]), model).count() == 0
