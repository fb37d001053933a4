"""Training sequences packed along a space-filling curve.

Each document's token counts are a hashed vector, projected to four dimensions and scaled to a
grid; documents are range-sorted by their place on the Hilbert curve through it, so that texts
about like things become neighbours. Each range partition is one stream of ids that is cut
every 2048, so only its last sequence is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm.shingles import mix
from delaylens.llm.tables import stored, table, texts
from delaylens.llm.tokens import TextEncoder, encoded, vocabulary_path, worker_encoder

CONTEXT = 2048
END = 1
DIMENSIONS, BITS = 4, 12
#: Hash buckets of the token vectors.
BUCKETS = 4_096
#: Bytes of stored ids that a range partition should hold: some hundred sequences at least.
PARTITION_BYTES = 16 << 20
#: Documents travel in parts of at most so many ids, so that ranges of equal rows hold about equal ids.
PART = 512


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below ``2**bits``.

    The coordinates are turned into the curve's own axes, one bit plane after another: where a
    coordinate has the bit set the first axis is mirrored below that bit, else the axes swap.
    """
    x = grid.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(dims):
            mirrored = (x[i] & bit) > 0
            swap = np.where(mirrored, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(mirrored, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def projection(vocabulary: int) -> np.ndarray:
    """A fixed random direction per hash bucket, looked up by token id."""
    bucket = mix(np.arange(vocabulary, dtype=np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)
    each = mix(np.arange(BUCKETS * DIMENSIONS, dtype=np.uint64) + np.uint64(99)).reshape(BUCKETS, DIMENSIONS)
    return (each >> np.uint64(11)).astype(np.float64)[bucket.astype(np.int64)] * 2.0**-52 - 1.0


def coordinates(ids: np.ndarray, n: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Grid coordinates of documents given by their flat ids: the mean direction, squashed to the grid."""
    starts = np.cumsum(n) - n
    mean = np.stack([np.add.reduceat(axes[ids, k], starts) for k in range(DIMENSIONS)], 1) / n[:, None]
    return ((np.tanh(4 * mean) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)


def _in_parts(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The document and the start of each part of at most ``size`` ids, given the documents' lengths."""
    parts = -(-n // size)
    doc = np.repeat(np.arange(len(n)), parts)
    return doc, (np.arange(len(doc)) - (np.cumsum(parts) - parts)[doc]) * size


def _tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Parts of documents. ``digest`` and ``row`` tell documents with one doc_id, or none, apart."""

    def run(batches):
        from pyspark import TaskContext

        encoder, row = worker_encoder(path), TaskContext.get().partitionId() << 33
        axes = projection(max(len(encoder.begins), end + 1))
        width = np.uint16 if len(axes) <= 1 << 16 else np.uint32
        for batch in batches:
            for at, ids, n in encoded(encoder, batch.column(1), end):
                key = hilbert_key(coordinates(ids, n, axes), BITS)
                begins = np.cumsum(n) - n
                digest = np.array([zlib.crc32(ids[i : i + k]) for i, k in zip(begins, n)], np.int64)
                doc, start = _in_parts(n, PART)
                limits = np.append(begins[doc] + start, len(ids)) * width().itemsize
                packed = pa.Array.from_buffers(
                    pa.large_binary(), len(doc), [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(ids.astype(width))]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)).take(pa.array(doc)), *map(pa.array, (key[doc], n[doc], digest[doc], row + doc, start)), packed],
                    names=["doc_id", "key", "doc_tokens", "digest", "row", "start", "ids"],
                )
                row += len(n)

    return docs.mapInArrow(run, "doc_id long, key long, doc_tokens long, digest long, row long, start long, ids binary")


def _packer(context: int, width: type):
    """Cut one partition's stream of parts into pieces that lie in one sequence each."""

    def run(batches):
        from pyspark import TaskContext

        sequence, offset = TaskContext.get().partitionId() << 32, 0
        out = [[] for _ in NAMES]
        # The piece that the next part may go on with: its row and columns; length 0 if there is none.
        row = doc = total = begin = crc = at = length = 0

        def close():
            if length:
                for column, value in zip(out, (doc, begin, length, crc, total, sequence, at)):
                    column.append(value)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:4]]
            for new_doc, new_total, new_row, start, packed in zip(*columns, batch.column(4)):
                ids = np.frombuffer(packed.as_buffer(), width).astype("<u4")
                used = 0
                while used < len(ids):
                    if not (length and new_row == row and start + used == begin + length):
                        close()
                        row, doc, total, begin, crc, at, length = new_row, new_doc, new_total, start + used, 0, offset, 0
                    more = min(context - offset, len(ids) - used)
                    crc = zlib.crc32(ids[used : used + more], crc)
                    used, length, offset = used + more, length + more, offset + more
                    if offset == context:
                        close()
                        sequence, offset, length = sequence + 1, 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=NAMES)
            out = [[] for _ in NAMES]
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=NAMES)

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str | None = None, end: int = END, context: int = CONTEXT) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with the id ``end``, so a null or empty text is a document of one id. A
    document that doesn't fit into its sequence goes on in the next; texts of any length are
    encoded whole. Sequences are full but for the last of each range partition, whose padding is
    left to the reader (to the next power of two). Copies and rows with equal keys are ordered
    by doc_id and a digest of the ids and may lie in several partitions, as may the parts of a long document. Repeated rows are packed each, rows
    with a null doc_id too. An empty table gives an empty result.
    """
    path = path or vocabulary_path()
    # Stored once: range bounds are sampled from it, then it is sorted.
    ready = stored(_tokenised(texts(docs), path, end), "token-ids")
    size = ready.where("start = 0").agg(F.sum("doc_tokens")).first()[0] or 0
    parts = max(1, -(-size * 2 // PARTITION_BYTES))
    order = ["key", "doc_id", "digest", "row", "start"]
    ordered = ready.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    width = np.uint16 if len(TextEncoder(path).begins) <= 1 << 16 and end < 1 << 16 else np.uint32
    return ordered.select("doc_id", "doc_tokens", "row", "start", "ids").mapInArrow(
        _packer(context, width), ", ".join(f"{n} long" for n in NAMES)
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


SQL = {}
QUERIES = {"op9_packing": op9_packing}
