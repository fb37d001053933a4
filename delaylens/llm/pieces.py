"""SentencePiece encoding by a unigram Viterbi search over a double-array trie, and decoding.

Text is encoded as in the public piece files: one space is put in front, spaces are the
white-space marker, and the best-scoring sequence of pieces is chosen; a character that no piece
covers becomes its UTF-8 bytes. The public file's scores are merge ranks, which can't be summed:
log scores are learned from the word counts of all texts first. A piece holds markers only at its start, so words are
independent: distinct words are searched once, all together, position by position.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm.tables import stored, table, texts

MARKER = "▁"
#: Bytes of distinct words searched at a time, and of texts encoded at a time: both bound a task's memory.
BATCH, BYTES = 1 << 16, 2 << 20
#: So many distinct words are remembered within a task before starting afresh.
KNOWN = 1 << 18
#: How far below the worst piece an uncovered character scores.
PENALTY = 10.0
RUNS = re.compile(" +[^ ]*")
#: Passes over the distinct words after the first one, which counts pieces wherever they match.
ROUNDS = 3


def piece_model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Pieces:
    """The trie (base, check, piece at a state), scores, each piece's bytes, and the byte pieces."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    spelled: np.ndarray
    limits: np.ndarray
    byte_piece: np.ndarray
    unknown: int
    unknown_score: float


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and value arrays: state ``s`` goes by byte ``c`` to ``base[s] + c`` if ``check`` there is ``s``."""
    root: dict = {}
    for key, value in keys.items():
        at = root
        for c in key:
            at = at.setdefault(c, {})
        at[-1] = value
    base, check, value = [0] * 1024, [-1] * 1024, [-1] * 1024
    check[0], queue = 0, [(0, root)]
    hint: dict[int, int] = {}  # where the last state with so many children found room
    for state, children in queue:
        codes = sorted(c for c in children if c >= 0)
        value[state] = children.get(-1, -1)
        if not codes:
            continue
        at = max(hint.get(len(codes), 1), codes[0] + 1)
        while True:
            if at - codes[0] + 256 >= len(check):
                more = len(check)
                base += [0] * more
                check += [-1] * more
                value += [-1] * more
            b = at - codes[0]
            if b > 0 and check[at] < 0 and all(check[b + c] < 0 for c in codes):
                break
            at += 1
        base[state] = b
        hint[len(codes)] = at
        for c in codes:
            check[b + c] = state
            queue.append((b + c, children[c]))
    pad = [0] * 256
    return np.array(base + pad, np.int32), np.array(check + [-1] * 256, np.int32), np.array(value + [-1] * 256, np.int32)


def build(pieces: list[str], scores: list[float], kinds: list[str]) -> Pieces:
    """``kinds`` names each piece ``text``, ``byte``, ``unknown`` or ``control``."""
    spelled, byte_piece, keys, unknown = [], np.full(256, -1, np.int32), {}, 0
    for i, (piece, kind) in enumerate(zip(pieces, kinds)):
        raw = piece.replace(MARKER, " ").encode()
        if kind == "byte":
            raw = bytes([int(piece[3:5], 16)])
            byte_piece[raw[0]] = i
        elif kind == "text":
            if " " in piece.replace(MARKER, " ").lstrip(" "):
                raise ValueError(f"a marker inside a piece: {piece!r}")
            keys[raw] = i
        else:
            raw = b""
            unknown = i if kind == "unknown" else unknown
        spelled.append(raw)
    ordinary = [scores[i] for i in keys.values() if scores[i] > -1e8] or [0.0]
    base, check, value = double_array(keys)
    return Pieces(
        base, check, value, np.array(scores, np.float64), np.frombuffer(b"".join(spelled), np.uint8),
        np.cumsum([0] + [len(s) for s in spelled]), byte_piece, unknown, min(ordinary) - PENALTY,
    )


def load(path: str) -> Pieces:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(p.get_piece_size())
    kind = lambda i: "byte" if p.is_byte(i) else "unknown" if p.is_unknown(i) else "control" if p.is_control(i) or p.is_unused(i) else "text"
    return build([p.id_to_piece(i) for i in every], [p.get_score(i) for i in every], [kind(i) for i in every])


def _spelling(words: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the words in a row, and where each word ends in them. No nulls."""
    words = pa.array(words, pa.large_binary()) if isinstance(words, list) else words.cast(pa.large_binary())
    limits = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[limits[0] : limits[-1]]
    return data, limits[1:] - limits[0]


def _search(model: Pieces, words: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of each word: flat ids, and their number per word.

    All matches are found by walking the trie from every character of every word at once. Then
    places are settled in order; of equal scores the one with the longer last piece stays.
    """
    data, ends = _spelling(words)
    starts = np.append(0, ends)[:-1]
    word = np.repeat(np.arange(len(words)), ends - starts)
    letter = (data & 0xC0) != 0x80
    at = np.flatnonzero(letter)
    width = np.diff(np.append(at, len(data)))
    begin, state, far = at, np.zeros(len(at), np.int64), ends[word[at]]
    found, single, depth = [], np.zeros(len(data), bool), 0
    wide = np.zeros(len(data), np.int64)
    wide[at] = width
    while len(begin):
        place = begin + depth
        on = place < far
        begin, state, far, place = begin[on], state[on], far[on], place[on]
        to = model.base[state] + data[place].astype(np.int64)
        ok = model.check[to] == state
        begin, state, far = begin[ok], to[ok].astype(np.int64), far[ok]
        depth += 1
        piece = model.value[state]
        hit = np.flatnonzero(piece >= 0)
        found.append((begin[hit], np.full(len(hit), depth), piece[hit].astype(np.int64)))
        single[begin[hit]] |= wide[begin[hit]] == depth
    bare = at[~single[at]]
    found.append((bare, wide[bare], np.full(len(bare), -1)))
    begin, length, piece = (np.concatenate(x) for x in zip(*found))
    score = np.where(piece >= 0, model.score[piece], model.unknown_score)
    offset = begin - starts[word[begin]]
    # Small integers are sorted by counting.
    order = np.argsort(offset.astype(np.uint16) if offset.max(initial=0) < 1 << 16 else offset, kind="stable")
    begin, length, piece, score = begin[order], length[order], piece[order], score[order]
    # Place x of word w is x + w: every word has one place more than bytes.
    goal = begin + length + word[begin]
    source = begin + word[begin]
    best = np.full(len(data) + len(words), -np.inf)
    best[starts + np.arange(len(words))] = 0
    back, chosen = np.zeros(len(best), np.int64), np.full(len(best), -1)
    steps = np.append(np.flatnonzero(np.diff(offset[order], prepend=-1)), len(order))
    for lo, hi in zip(steps[:-1], steps[1:]):
        total = best[source[lo:hi]] + score[lo:hi]
        better = lo + np.flatnonzero(total > best[goal[lo:hi]])
        best[goal[better]] = total[better - lo]
        back[goal[better]], chosen[goal[better]] = source[better], piece[better]
    here, who = ends + np.arange(len(words)), np.arange(len(words))
    first = starts + np.arange(len(words))
    path = []
    while len(who):
        more = here > first[who]
        here, who = here[more], who[more]
        path.append((who, here, chosen[here], back[here]))
        here = back[here]
    who, here, piece, source = (np.concatenate(x) for x in zip(*path)) if path else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((here, who))
    who, here, piece, source = who[order], here[order], piece[order], source[order]
    # An uncovered character is spelled by its bytes, or is the unknown piece if there are no byte pieces.
    lone = piece < 0
    spell = bool((model.byte_piece >= 0).all())
    size = np.where(lone & spell, here - source, 1)
    ids = np.repeat(np.where(lone, model.unknown, piece), size)
    if spell and lone.any():
        is_byte = np.repeat(lone, size)
        nth = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        ids[is_byte] = model.byte_piece[data[(np.repeat(source - who, size) + nth)[is_byte]]]
    return ids.astype(np.uint32), np.bincount(who, size, len(words)).astype(np.int64)


def encode_words(model: Pieces, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    out = [_search(model, some) for _, some in _groups(words, BATCH)]
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _words(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, those of texts without runs of spaces first; which texts have runs, which have text, and the words per text."""
    column = column.cast(pa.large_string())
    runs = pc.match_substring_regex(column, "^ |  ").to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(column.filter(pa.array(full & ~runs)), " ")
    odd = [RUNS.findall(" " + t) for t in column.filter(pa.array(full & runs)).to_pylist()]
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.list_flatten(plain), pa.scalar("", pa.large_string()))
    every = pa.concat_arrays([spaced, pa.array([w for t in odd for w in t], pa.large_string())]).dictionary_encode()
    words = np.zeros(len(column), np.int64)
    words[full & ~runs] = pc.list_value_length(plain).to_numpy(zero_copy_only=False)
    words[full & runs] = [len(t) for t in odd]
    return every, runs, full, words


class Remembered:
    """The pieces of the words that a task has searched, so that none is searched again for its later texts."""

    def __init__(self, model: Pieces):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.flat, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def look_up(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among the known ones; new ones are searched first."""
        if len(self.words) > KNOWN:
            self._forget()
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).copy()
        new = place < 0
        fresh = words.filter(pa.array(new))
        flat, size = encode_words(self.model, fresh)
        place[new] = len(self.words) + np.arange(len(fresh))
        self.words = pa.concat_arrays([self.words, fresh])
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.flat = np.concatenate([self.flat, flat])
        return place


def encode(model: Pieces, column: pa.Array, known: Remembered | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row and the number per text; an empty text has none."""
    known = known or Remembered(model)
    every, runs, full, words = _words(column)
    found = known.look_up(every.dictionary)
    # Words lie texts without runs first; bring them into the order of the texts.
    begin = np.zeros(len(column), np.int64)
    for some in (full & ~runs, full & runs):
        begin[some] = np.cumsum(words[some]) - words[some]
    begin[full & runs] += words[full & ~runs].sum()
    index = every.indices.to_numpy(zero_copy_only=False)
    place = np.repeat(begin - (np.cumsum(words) - words), words) + np.arange(words.sum())
    index = index[place]
    index = found[index]
    size = known.size[index]
    total = np.cumsum(size, dtype=np.int64)
    ids = known.flat[np.repeat(known.at[index] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
    edge = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(words)])]
    return ids, np.diff(edge)


def decode(model: Pieces, ids: np.ndarray, n: np.ndarray) -> list[str]:
    """The text of each run of ids: pieces spelled out, markers as spaces, the leading one dropped.

    Bytes that form no UTF-8 character become the replacement character.
    """
    size = np.diff(model.limits)[ids]
    total = np.cumsum(size)
    raw = model.spelled[np.repeat(model.limits[ids] - (total - size), size) + np.arange(total[-1] if len(total) else 0)].tobytes()
    edge = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(n)])]
    texts = (raw[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()))
    return [t[1:] if t.startswith(" ") else t for t in texts]


def _groups(column: pa.Array, size: int):
    """The first row and the rows of runs of at most ``size`` bytes, or of one row."""
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    limits = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(limits, limits[at] + size, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def _encoder(model: Pieces):
    def run(batches):
        known = Remembered(model)
        for batch in batches:
            for at, some in _groups(batch.column(1), BYTES):
                ids, n = encode(model, some, known)
                limits = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int64())
                arrays = pa.LargeListArray.from_arrays(limits, pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), arrays], names=["doc_id", "ids"])
        del known
        pa.default_memory_pool().release_unused()

    return run


def _decoder(model: Pieces):
    is_byte = np.zeros(len(model.score), bool)
    is_byte[model.byte_piece[model.byte_piece >= 0]] = True

    def run(batches):
        for batch in batches:
            arrays = batch.column(1)
            limits = arrays.offsets.to_numpy()
            every = arrays.values.to_numpy()
            for at in range(0, len(arrays), 256):
                edge = limits[at : at + 257]
                ids, n = every[edge[0] : edge[-1]], np.diff(edge)
                edge = edge - edge[0]
                low = np.concatenate([[0], np.cumsum(is_byte[ids])])
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), pa.array(decode(model, ids, n), pa.string()), pa.array(n, pa.int64()),
                     pa.array(low[edge[1:]] - low[edge[:-1]], pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "text", "n_pieces", "n_bytes", "ids_crc32"],
                )

    return run


DECODED = "doc_id long, text string, n_pieces long, n_bytes long, ids_crc32 long"


def encode_documents(docs: DataFrame, model: Pieces) -> DataFrame:
    """doc_id and the piece ids of its whole text, as an array.

    Null and empty texts have no pieces. Repeated rows each give a row; an empty table gives an
    empty result. Texts of any length are searched whole.
    """
    return texts(docs).mapInArrow(_encoder(model), "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, model: Pieces) -> DataFrame:
    """doc_id, the decoded text, and figures of the ids: n_pieces, n_bytes (pieces that are bytes), ids_crc32."""
    return coded.select("doc_id", "ids").mapInArrow(_decoder(model), DECODED)


def encode_and_decode(docs: DataFrame, model: Pieces) -> DataFrame:
    """What ``decode_documents`` makes of ``encode_documents``, in one pass: a task has one Python worker, not two."""
    encoder, decoder = _encoder(model), _decoder(model)
    return texts(docs).mapInArrow(lambda batches: decoder(encoder(batches)), DECODED)


def word_counts(docs: DataFrame) -> DataFrame:
    """Each distinct word of all texts, as bytes with its leading space, and how often it occurs."""

    def run(batches):
        for batch in batches:
            for _, some in _groups(batch.column(1), BYTES):
                every = _words(some)[0]
                n = np.bincount(every.indices.to_numpy(zero_copy_only=False), minlength=len(every.dictionary))
                words = every.dictionary.cast(pa.large_binary()).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64))], names=["word", "n"])
        pa.default_memory_pool().release_unused()

    return texts(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _piece_counts(counted: DataFrame, model: Pieces, anywhere: bool) -> np.ndarray:
    """How often each piece matches in the words (``anywhere``) or is chosen by the search; one row per piece and task."""

    def run(batches):
        total = np.zeros(len(model.score), np.int64)
        for batch in batches:
            n = batch.column(1).to_numpy()
            for at, some in _groups(batch.column(0), BATCH):
                if anywhere:
                    data, ends = _spelling(some)
                    word = np.repeat(np.arange(len(some)), np.diff(ends, prepend=0))
                    ids, who = _matches(model, data, ends[word], word)
                else:
                    ids, length = _search(model, some)
                    who = np.repeat(np.arange(len(some)), length)
                np.add.at(total, ids, n[at : at + len(some)][who])
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], names=["piece", "n"])

    rows = counted.mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(model.score))
    for r in rows:  # at most one row per piece
        out[r.piece] = r.n
    return out


def _matches(model: Pieces, data: np.ndarray, far: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every piece that matches anywhere inside a word, and its word."""
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    state, depth, found = np.zeros(len(begin), np.int64), 0, []
    while len(begin):
        on = begin + depth < far[begin]
        begin, state = begin[on], state[on]
        to = model.base[state] + data[begin + depth].astype(np.int64)
        ok = model.check[to] == state
        begin, state, depth = begin[ok], to[ok].astype(np.int64), depth + 1
        hit = model.value[state] >= 0
        found.append((model.value[state[hit]].astype(np.int64), word[begin[hit]]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _log_scores(model: Pieces, n: np.ndarray) -> Pieces:
    """Log shares of the counts; every piece counts as half an occurrence more, so that none is ruled out."""
    share = np.log((n + 0.5) / (n.sum() + 0.5 * len(n)))
    return replace(model, score=share, unknown_score=float(share.min()) - PENALTY)


def learned(docs: DataFrame, model: Pieces, rounds: int = ROUNDS) -> Pieces:
    """The same pieces with log scores learned from every word of every text.

    The first scores are the shares of all matches of a piece; each round then counts the pieces
    that the search chooses and takes their shares. Words are counted once and kept as a Spark
    table; only one number per piece reaches the driver. An empty table leaves all scores equal.
    """
    counted = stored(word_counts(docs), "word-counts")
    model = _log_scores(model, _piece_counts(counted, model, anywhere=True))
    for _ in range(rounds):
        model = _log_scores(model, _piece_counts(counted, model, anywhere=False))
    return model


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(docs, load(piece_model_path()))
    return encode_and_decode(docs, model).select("doc_id", "n_pieces", "n_bytes", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))


SQL = {}
QUERIES = {"op5_pieces": op5_pieces}
