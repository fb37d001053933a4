"""What bounds the memory of op2: small groups of text, no words kept beside the coder, one Python worker a task."""

import weakref

import numpy as np
import pyarrow as pa
import pyspark

import __spark_entry__ as entry
from delaylens.llm import range_coder, token_files
from delaylens.llm.tokens import TextEncoder, vocabulary_path
from tests.conftest import SMALL


class _Task:
    def partitionId(self):
        return 3


def test_writer_tokenises_small_groups_and_codes_without_the_words(monkeypatch):
    groups, encoders, coded = [], [], []
    start, encode, code = TextEncoder.__init__, TextEncoder.encode, token_files.encode_blocks
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(_Task))
    monkeypatch.setattr(TextEncoder, "__init__", lambda self, *a: encoders.append(weakref.ref(self)) or start(self, *a))
    monkeypatch.setattr(TextEncoder, "encode", lambda self, column: groups.append(sum(map(len, column.to_pylist()))) or encode(self, column))
    monkeypatch.setattr(token_files, "encode_blocks", lambda blocks: coded.append(encoders[0]() is None) or code(blocks))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([f"text {i} and " * 80_000 for i in range(6)])], names=["doc_id", "text"])
    out = list(token_files._writer(vocabulary_path(), 0)([batch]))
    assert max(groups) <= 2 << 20 and sum(groups) == sum(map(len, batch.column(1).to_pylist()))
    assert coded == [True]
    assert sum(sum(n) for b in out for n in b.column(4).to_pylist()) == sum(map(sum, (map(len, range_coder.decode_blocks(b.column(7).to_pylist())) for b in out)))


def test_one_python_worker_a_task(spark):
    plan = entry.queries()["op2_token_files"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    # Blocks are decoded before the exchange and pieces joined after it.
    assert plan.count("MapInArrow") == 2


def test_digested_pieces_are_those_of_read_ids(documents, spark, tmp_path):
    rows = [(None, "no id"), (4, "word " * 9_000), (5, None), *((10 + i, "more words " * 300) for i in range(30))]
    token_files.write_ids(documents(rows), str(tmp_path / "f"))
    pieces = token_files.read_ids(spark, str(tmp_path / "f")).collect()
    whole = {r.doc_id: r.ids for r in pieces if r.whole}
    found = {r.doc_id: r.ids_crc32 for r in token_files.read_documents(spark, str(tmp_path / "f")).collect()}
    assert len(found) == len(rows) and {r.doc_id for r in pieces} == set(found) and 0 < len(whole) < len(found)
    assert all(found[d] == token_files._crc(ids) for d, ids in whole.items())
    assert sum(r.n for r in pieces) == sum(len(r.ids) // 2 for r in pieces)


def test_places_among_running_totals():
    rng = np.random.default_rng(1)
    totals = np.cumsum(rng.integers(1, 250, (500, 16)), 1).astype(np.uint16)
    target = (rng.random(500) * totals[:, 15]).astype(np.int64)
    assert np.array_equal(range_coder._places(target, totals), (target[:, None] >= totals).sum(1))
