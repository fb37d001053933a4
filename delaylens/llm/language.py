"""Language by compression: which language's dictionary makes the text smallest.

Each language has a raw-content dictionary made of sampled labelled documents. A text is cut
into pieces, each piece is compressed with every dictionary, and the language with the smallest
sum wins. The gap to the runner-up is the margin; narrow margins are rejected. Sizes are whole
bytes, so short texts can tie: before a text is rejected, its size in fractions of a bit, coded
with the frequencies of letter sequences in each dictionary, is compared by the same margin.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from delaylens.llm.tables import crc32_of_id, table

#: Bound of the labelled sample: documents per language, and bytes of each that enter a dictionary.
SAMPLE_DOCUMENTS, DICTIONARY_BYTES = 256, 112_640
LEVEL = 6
#: Texts are compressed in pieces, so that a long text cannot serve as its own dictionary.
PIECE = 4_096
#: A winner must save this share of the runner-up's size, else the text is rejected.
MARGIN = 0.002
UNKNOWN = "und"


def letters(column: pa.Array) -> pa.Array:
    """Lower-case letter runs joined by one space: what tells languages apart; nulls are empty."""
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(lower, r"[^\p{L}]+", " "))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id") -> dict[str, bytes]:
    """A dictionary per language from a bounded sample of its labelled documents.

    The sample is the documents with the smallest hash of their id, so it depends on the rows
    alone. Only candidates of about the wanted number are ranked. Rows with a null label, or
    without text, teach nothing. Languages are in the order of their number of documents.
    """
    rows = labelled.select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(order_col)).alias("h")
    ).where("lang IS NOT NULL")
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for lang, n in totals.items():
        share = min(1.0, 2 * (SAMPLE_DOCUMENTS + 32) / n)
        limit = 2**63 - 1 if share == 1 else int(share * 2**64) - 2**63
        keep = keep | ((F.col("lang") == lang) & (F.col("h") <= limit))
    first = Window.partitionBy("lang").orderBy("h", "text")
    near = rows.where(keep).where("length(text) > 0").select("lang", "h", F.substring("text", 1, PIECE).alias("text"))
    sample = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= SAMPLE_DOCUMENTS)
    rows_kept = sample.orderBy("lang", "k").collect()  # SAMPLE_DOCUMENTS short texts per language
    by_lang: dict[str, list[bytes]] = {}
    for r, text in zip(rows_kept, letters(pa.array([r.text for r in rows_kept], pa.string())).to_pylist()):
        by_lang.setdefault(r.lang, []).append(text.encode())
    out = {}
    for lang in sorted(by_lang, key=lambda x: (-totals[x], x)):
        share = max(64, DICTIONARY_BYTES // len(by_lang[lang]))
        out[lang] = b" ".join(t[:share] for t in by_lang[lang])[-DICTIONARY_BYTES:]
    return out


def _sequences(dictionary: bytes) -> tuple[Counter, Counter, Counter]:
    d = b"  " + dictionary
    return Counter(d), Counter(zip(d, d[1:])), Counter(zip(d, d[1:], d[2:]))


def _bits(raw: bytes, counts: tuple[Counter, Counter, Counter]) -> float:
    """Ideal size of the text as one word sequence: each byte after the two before it, blended with shorter contexts."""
    one, two, three = counts
    d, total, out = b"  " + raw + b" ", sum(one.values()), 0.0
    for a, b, c in zip(d, d[1:], d[2:]):
        p = (one[c] + 1) / (total + 256)
        p = (two[b, c] + 4 * p) / (one[b] + 4)
        p = (three[a, b, c] + 4 * p) / (two[a, b] + 4)
        out -= math.log2(p)
    return out


def _winner(sizes: np.ndarray) -> tuple[np.ndarray, float]:
    """Languages by size, and the share of the runner-up's size that the first one saves."""
    order = np.argsort(sizes, kind="stable")
    return order, 1 - sizes[order[0]] / sizes[order[1]] if len(sizes) > 1 else 1.0


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected.

    Score is the share of the runner-up's size that the winner saves, scaled to 0..1. A text that
    is null or has no letter is ``und`` with score 0 and rejected, and so is every text if
    nothing was learned; with one language all others win it with score 1. Ties go to the
    language with more labelled documents. Whole texts are read, of any length. Repeated rows each give a row; an
    empty table gives an empty result. ``digest`` adds the text's hash, text_sha256, by which rows
    with a null or repeated doc_id are told apart.
    """
    names = list(dictionaries)

    def run(batches):
        import zstandard

        coders = []
        for name in names:
            data = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(
                dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
        counts: list[tuple] = []  # made when the first narrow text comes

        for batch in batches:
            best, score, out = [], [], []
            for text in letters(batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                if not names or not raw:
                    best.append(UNKNOWN), score.append(0.0), out.append(True)
                    continue
                pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
                sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in coders])
                order, saved = _winner(sizes)
                if saved < margin:
                    counts = counts or [_sequences(dictionaries[name]) for name in names]
                    order, saved = _winner(np.array([_bits(raw, c) for c in counts]))
                best.append(names[order[0]]), score.append(float(saved)), out.append(bool(saved < margin))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best), pa.array(score, pa.float64()), pa.array(out), *batch.columns[2:]],
                names=["doc_id", "lang_pred", "score", "rejected", *batch.schema.names[2:]],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if digest:
        rows = rows.withColumn("text_sha256", _digest(F.col("text")))
    kinds = "doc_id long, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(run, kinds + (", text_sha256 string" if digest else ""))


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(crc32_of_id(doc_id), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and judge all of them."""
    found = classify(docs, train(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def with_known_language(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all columns; a null doc_id is judged like any other."""
    judged = classify(docs, train(docs.where(~held_out(F.col("doc_id")))), digest=True).where("NOT rejected")
    kept = judged.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(kept["_id"]) & (_digest(docs["text"]) == kept["_sha"])
    return docs.join(kept, same, "left_semi").select(*docs.columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


SQL = {}
QUERIES = {"op1_language_id": op1_language_id}
