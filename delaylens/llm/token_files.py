"""Token ids of a corpus as compressed files, in the order of the documents, and read back.

A file holds one row per block: its place, the documents it holds ids of with their numbers of
ids there, and the coded ids (see ``range_coder``). Blocks are cut every 4,096 ids whatever the
documents; each can be read by itself and carries a checksum of its ids. The rows are stored as
Parquet, so that a lost task leaves no half-written file behind.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm.range_coder import BLOCK, LANES, decode_blocks, encode_blocks
from delaylens.llm.tables import table, texts
from delaylens.llm.tokens import TextEncoder, encoded, vocabulary_path
from delaylens.session import scratch_path

END = 0
#: Bytes of text that a file should hold.
FILE_BYTES = 18 << 20
#: Bytes of text that a task tokenises at a time.
GROUP_BYTES = 2 << 20
LAYOUT = "part int, block int, ordinal long, doc_ids array<long>, n_ids array<int>, begun boolean, done boolean, coded binary"


def _writer(path: str, end: int):
    def run(batches):
        from pyspark import TaskContext

        encoder, part = TextEncoder(path), TaskContext.get().partitionId()
        if len(encoder.begins) > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit into 16 bits")
        left, docs, count, block, ordinal, begun = np.zeros(0, np.uint16), [], [], 0, 0, False

        def emit(last: bool):
            """Full blocks of what is pending; the rest too if ``last``."""
            nonlocal left, docs, count, block, ordinal, begun
            cuts = list(range(BLOCK, len(left) + 1, BLOCK))
            if last and len(left) % BLOCK:
                cuts.append(len(left))
            rows, blocks, doc, used, at = [], [], 0, 0, 0
            for cut in cuts:
                first, ids, n = ordinal + doc, [], []
                need = cut - at
                while need:
                    take = min(need, count[doc] - used)
                    ids.append(docs[doc]), n.append(take)
                    need, used = need - take, used + take
                    if used == count[doc]:
                        doc, used = doc + 1, 0
                rows.append((part, block, first, ids, n, begun, used == 0))
                begun = used > 0
                blocks.append(left[at:cut])
                at, block = cut, block + 1
            left, docs, count, ordinal = left[at:], docs[doc:], count[doc:], ordinal + doc
            if used:
                count[0] -= used
            for lo in range(0, len(rows), LANES):
                some = [pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + LANES]), TYPES)]
                yield pa.RecordBatch.from_arrays([*some, pa.array(encode_blocks(blocks[lo : lo + LANES]), pa.binary())], names=NAMES)

        for batch in batches:
            for at, ids, n in encoded(encoder, batch.column(1), end, GROUP_BYTES):
                left = np.concatenate([left, ids.astype(np.uint16)])
                docs += batch.column(0).slice(at, len(n)).to_pylist()
                count += n.tolist()
                if len(left) >= BLOCK * LANES:
                    yield from emit(False)
        # The coder's counts need the room of the known words and the texts.
        encoder = batch = ids = n = None
        pa.default_memory_pool().release_unused()
        if len(left):
            yield from emit(True)

    return run


NAMES = ["part", "block", "ordinal", "doc_ids", "n_ids", "begun", "done", "coded"]
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_(), pa.bool_()]


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Encode whole texts, append ``end`` to each, and write files in ascending doc_id order.

    Null and empty texts are documents of one id. Null doc_ids come first. Rows with one doc_id
    are ordered by their text. An empty table writes a table without rows.
    """
    d = texts(docs)
    size = d.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(1, -(-size // FILE_BYTES))
    ordered = d.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(_writer(path or vocabulary_path(), end), LAYOUT).write.parquet(folder)


def _pieces(batches):
    """Columns part, ordinal, at, doc_id, n, whole and ids (an array) of some decoded and checked blocks at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, LANES):
            some = batch.slice(lo, LANES)
            coded = decode_blocks([c.as_buffer().to_pybytes() for c in some.column(7)])
            rows = []
            for part, block, ordinal, docs, sizes, begun, done, ids in zip(*[some.column(k).to_pylist() for k in range(7)], coded):
                at = 0
                for k, (doc, n) in enumerate(zip(docs, sizes)):
                    whole = (k > 0 or not begun) and (k + 1 < len(docs) or done)
                    rows.append((part, ordinal + k, block * BLOCK + at, doc, n, whole, ids[at : at + n]))
                    at += n
            if rows:
                yield list(zip(*rows))
    pa.default_memory_pool().release_unused()


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """part, ordinal (place of the document in its file), at (of its first id here), doc_id, n, whole, ids.

    One row per document and block, decoded and checked; ids are little-endian 16-bit integers.
    """

    def run(batches):
        for *columns, ids in _pieces(batches):
            columns.append([x.astype("<u2").tobytes() for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECE_TYPES)], names=PIECE_NAMES)

    return spark.read.schema(LAYOUT).parquet(folder).mapInArrow(run, PIECES)


PIECE_NAMES = ["part", "ordinal", "at", "doc_id", "n", "whole", "ids"]
PIECE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
PIECES = "part int, ordinal long, at long, doc_id long, n long, whole boolean, ids binary"


def _crc(packed: bytes, crc: int = 0) -> int:
    return zlib.crc32(np.frombuffer(packed, "<u2").astype("<u4"), crc)


def _digested(batches):
    """Pieces with the digest of whole documents; the ids of others stay, to be joined."""
    for *columns, whole, ids in _pieces(batches):
        crc = [zlib.crc32(x.astype("<u4")) if w else 0 for w, x in zip(whole, ids)]
        rest = [None if w else x.astype("<u2").tobytes() for w, x in zip(whole, ids)]
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, columns, PIECE_TYPES[:5]), pa.array(crc, pa.int64()), pa.array(rest, pa.binary())],
            names=["part", "ordinal", "at", "doc_id", "n", "crc", "ids"],
        )


def _joined(batches):
    for batch in batches:
        crc = []
        for pieces in batch.column(3).to_pylist():
            value = 0
            for piece in sorted(pieces, key=lambda p: p["at"]):
                value = piece["crc"] if piece["ids"] is None else _crc(piece["ids"], value)
            crc.append(value)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it: the totals of the files before its own
    and its place there. A document's pieces meet in one group; no group holds two documents.
    """
    head = spark.read.schema(LAYOUT).parquet(folder).select("part", F.explode("n_ids").alias("n"))
    # One number per file, that is some bytes for every 18 MB of text.
    before, total = [], 0
    for r in head.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        before.append((r.part, total))
        total += r.n
    offsets = spark.createDataFrame(before, "part int, before long")
    # Decoded and digested in one pass, so that a task has one Python worker.
    pieces = spark.read.schema(LAYOUT).parquet(folder).mapInArrow(
        _digested, "part int, ordinal long, at long, doc_id long, n long, crc long, ids binary"
    )
    documents = pieces.groupBy("part", "ordinal", "doc_id").agg(
        F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.collect_list(F.struct("at", "crc", "ids")).alias("pieces")
    )
    return documents.join(offsets, "part").select(
        "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "pieces"
    ).mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_ids(table(spark, sf_dir, "documents"), folder)
    return read_documents(spark, folder)


SQL = {}
QUERIES = {"op2_token_files": op2_token_files}
