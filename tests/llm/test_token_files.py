import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from delaylens.llm import range_coder, token_files
from delaylens.llm.range_coder import decode_blocks, encode_blocks
from delaylens.llm.tokens import TextEncoder, vocabulary_path
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(vocabulary_path())


def expected(rows, encoder):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.append(encoder.whole([text or ""])[0], 0).astype("<u4")
        out.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def result(df):
    return sorted(map(tuple, df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_round_trip_of_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    text = np.cumsum(rng.integers(0, 3, 5000)) % 40
    blocks = [np.zeros(0), np.array([65535] * 3000 + [0]), rng.integers(0, 65536, 3000), text, np.array([7]), np.zeros(4096), text[:17]]
    blocks = [b.astype(np.uint32) for b in blocks]
    packed = encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, decode_blocks(packed)))
    assert len(packed[3]) < 5000 and len(packed[5]) < 200
    # every block by itself, and in other company
    monkeypatch.setattr(range_coder, "LANES", 2)
    assert encode_blocks(blocks) == packed
    assert all(np.array_equal(decode_blocks([p])[0], b) for p, b in zip(packed, blocks))
    assert decode_blocks([]) == [] and encode_blocks([]) == []


def test_damage_is_found():
    packed = encode_blocks([np.arange(500, dtype=np.uint32)])[0]
    for broken in (packed[:-4], packed[:10], b"", b"x" + packed[1:], packed[:40] + bytes([packed[40] ^ 1]) + packed[41:]):
        with pytest.raises(ValueError):
            decode_blocks([broken])


def test_whole_table(spark, encoder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert result(entry.queries()["op2_token_files"](spark, SMALL)) == expected(rows, encoder)


def test_edge_cases(documents, spark, encoder, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    rows = [(5, None), (3, ""), (9, "word " * 20_000), (1, "a b c"), (None, "no id"), (7, "é\x00 ß" * 50), (8, "!!!!")]
    rows += [(100 + i, "some more words here " * 40) for i in range(60)]
    df = documents(rows).withColumn("part", F.lit(1)).withColumn("ids", F.lit("x")).withColumn("start", F.lit(0))
    token_files.write_ids(df, f"{tmp_path}/a")
    got = result(token_files.read_documents(spark, f"{tmp_path}/a"))
    assert got == expected(rows, encoder)
    token_files.write_ids(documents([]), f"{tmp_path}/b")
    assert token_files.read_documents(spark, f"{tmp_path}/b").count() == 0
    token_files.write_ids(documents([(1, "x"), (1, "x"), (2, "y")]), f"{tmp_path}/c")
    assert [r[:3] for r in result(token_files.read_documents(spark, f"{tmp_path}/c"))] == [(1, 0, 2), (1, 2, 2), (2, 4, 2)]
