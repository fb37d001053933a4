import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from delaylens.llm import packing
from delaylens.llm.tokens import TextEncoder, vocabulary_path, worker_encoder

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb c", "don't 've", "a\x00b c", "\n\nabc def\n\n ghi",
       "é ß ñ", "日本 語 x", "1 2 3 45", "a b\n\n", "<|endoftext|> a", "q  z", "a  b", "x" * 5000]


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(vocabulary_path())


def test_ids_are_the_librarys(encoder):
    ids, n = encoder.encode(pa.array(ODD * 2))
    want = encoder.whole(ODD * 2)
    assert n.tolist() == [len(w) for w in want]
    assert np.array_equal(ids, np.concatenate(want))
    assert len(encoder.encode(pa.array([], pa.string()))[0]) == 0


def test_curve_steps_to_a_neighbour():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
        grid = np.stack([a.ravel() for a in axes], 1)
        key = packing.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def check(rows, pieces, encoder, context=2048):
    """Every id of every document lies in exactly one piece, and sequences are gapless."""
    want = {i: np.append(encoder.whole([t or ""])[0], 1).astype("<u4") for i, t in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(want)
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[doc]) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(want[doc][at:at + p.length])
            at += p.length
        assert at == len(want[doc])
    short = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= context
        short += at < context
    return short


def test_whole_table(spark, encoder):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert check(rows, entry.queries()["op9_packing"](spark, folder).collect(), encoder) <= 1


def test_edge_cases(documents, encoder, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_BYTES", 4000)
    rows = [*enumerate(ODD), (100, None), (101, "word " * 30_000)]
    df = documents(rows).withColumn("ids", F.lit(1)).withColumn("key", F.lit("k")).withColumn("offset", F.lit(0))
    pieces = packing.pack(df, context=64).collect()
    assert check(rows, pieces, encoder, 64) >= 1
    assert packing.pack(documents([])).count() == 0
    assert packing.pack(documents([(1, "a"), (1, "a")])).count() == 2


def test_parts_are_put_together(spark, documents, encoder):
    long = "some words of a long text that goes on " * 400
    rows = [(1, long), (1, long), (1, long[::-1]), (None, long), (None, long + "x"), (2, "short")]
    pieces = packing.pack(documents(rows)).collect()
    want = [np.append(encoder.whole([t])[0], 1) for _, t in rows]
    assert sum(p.length for p in pieces) == sum(map(len, want))
    # One stream: a document is cut only where a sequence ends, whatever parts it travelled in.
    cuts = sum(p.start > 0 for p in pieces)
    assert len(pieces) == len(rows) + cuts and cuts <= sum(map(len, want)) // 2048
    assert all(p.offset == 0 for p in pieces if p.start > 0)


def test_ranges_hold_about_equal_ids(documents, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_BYTES", 40_000)
    rows = [(i, f"w{i % 7} " * (4_000 if i % 40 == 0 else 30 + i % 50)) for i in range(1200)]
    held = {}
    for p in packing.pack(documents(rows)).collect():
        held[p.sequence_id >> 32] = held.get(p.sequence_id >> 32, 0) + p.length
    # Ranges are cut by sampled rows; the 30 long texts are six tenths of all ids and have few keys.
    assert len(held) > 5 and max(held.values()) < 3 * sum(held.values()) / len(held)


def test_a_worker_keeps_what_it_knows():
    first = worker_encoder(vocabulary_path())
    first.encode(pa.array(["to know words"]))
    assert worker_encoder(vocabulary_path()) is first and len(first.known) == 2
