"""Token ids of whole text columns with a public byte-level BPE vocabulary."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are tokenised together in groups of about so many bytes.
BYTES = 8 << 20
#: So many distinct words are remembered before starting afresh, a bound on memory: within one task, and by a
#: Python worker over its tasks, which holds them beside the jobs that follow.
KNOWN, KNOWN_BY_WORKER = 1 << 20, 1 << 20
#: Distinct words are encoded in runs of so many, and the parts of words of known shape in runs of so many.
RUN, PARTS = 2_000, 200
#: Letters and marks of words of known shape; other words may hold digits, apostrophes or any other character.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _spelling() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in UTF-8, their number, of the letter by which a byte-level vocabulary spells each byte."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = dict(zip([*same, *(b for b in range(256) if b not in same)], [*same, *range(256, 512)]))
    coded = [chr(letters[b]).encode() for b in range(256)]
    return np.array([c[0] for c in coded], np.uint8), np.array([c[-1] for c in coded], np.uint8), np.array([len(c) for c in coded])


FIRST_BYTE, LAST_BYTE, N_BYTES = _spelling()


def _spelled(texts: pa.Array) -> pa.Array:
    """Large strings in the vocabulary's letters for their bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    size = N_BYTES[data]
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - size] = FIRST_BYTE[data]
    out[ends - 1] = LAST_BYTE[data]
    offsets = np.concatenate([[0], ends])[offsets - offsets[0]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(out))


class TextEncoder:
    """Encodes texts by their distinct words.

    Byte-level BPE starts a new token at every single space that precedes a visible character,
    so a text cut there is encoded piece by piece, and equal pieces only once. Runs of pieces go
    to the library as one string; a token that begins with the space byte begins a piece. Texts
    with other spaces (repeated, leading, trailing, before a control or rare character) go to
    the library whole.

    Words of known shape, lines of letters and then marks, are cut where the vocabulary's own
    pattern cuts them. Their distinct parts go to the library spelled in the vocabulary's
    letters for bytes, so that it only has to merge.
    """

    IRREGULAR = r"( ([^!-~À-ɏ]|$))|^ |\x00"
    SHAPE = rf"^[{LETTERS}]+[{MARKS}]*(\n[{LETTERS}]+[{MARKS}]*)*$"

    def __init__(self, path: str, remembered: int = KNOWN):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        first, self.nothing = self.library.pre_tokenizer, self.library.token_to_id("Ā")
        self.cuts = isinstance(first, pre_tokenizers.ByteLevel) and first.use_regex and self.library.normalizer is None and self.nothing is not None
        self.merger = Tokenizer(self.library.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.begins = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.pool, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _look_up(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among the known ones; new ones are encoded and remembered."""
        if len(self.known) > self.remembered:
            self._forget()
        # The known ones are looked for among these, as those are many more to hash.
        found = pc.index_in(self.known, value_set=words)
        place = np.full(len(words), -1)
        place[found.drop_null().to_numpy(zero_copy_only=False)] = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        new = place < 0
        fresh = words.filter(pa.array(new))
        flat, at, lengths = self._words(fresh)
        place[new] = len(self.known) + np.arange(len(fresh))
        self.known = pa.concat_arrays([self.known, fresh])
        self.at = np.concatenate([self.at, len(self.pool) + at])
        self.size = np.concatenate([self.size, lengths])
        self.pool = np.concatenate([self.pool, flat])
        return place

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of words that each follow a space, and where each word's begin and how many they are."""
        shaped = pc.match_substring_regex(words, self.SHAPE).to_numpy(zero_copy_only=False) & self.cuts
        flat, n = self._shaped(words.filter(pa.array(shaped)))
        others, m = self._others(words.filter(pa.array(~shaped)).to_pylist())
        at, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at[shaped], size[shaped] = np.cumsum(n) - n, n
        at[~shaped], size[~shaped] = len(flat) + np.cumsum(m) - m, m
        return np.concatenate([flat, others]), at, size

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for words that each follow a space."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        runs = [" " + " ".join(words[i : i + RUN]) for i in range(0, len(words), RUN)]
        ids = np.concatenate(self.whole(runs))
        starts = np.flatnonzero(self.begins[ids])
        assert len(starts) == len(words), "a token does not follow the spaces"
        return ids, np.diff(np.append(starts, len(ids)))

    def _shaped(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of known shape."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        space, nothing = pa.scalar(" ", words.type), pa.scalar("", words.type)
        cut = pc.replace_substring(pc.binary_join_element_wise(space, words, nothing), "\n", "\x00\n\x00")
        cut = pc.split_pattern(pc.replace_substring_regex(cut, f"([{MARKS}]+)", "\x00\\1"), "\x00")
        parts = pc.list_flatten(cut).dictionary_encode()
        flat, lengths = self._parts(parts.dictionary)
        index = parts.indices.to_numpy(zero_copy_only=False)
        size, at = lengths[index], (np.cumsum(lengths) - lengths)[index]
        ends = np.cumsum(size)
        ids = flat[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]
        return ids, np.diff(np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()])

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for parts that the vocabulary's pattern leaves whole."""
        parts = _spelled(parts)
        cuts = [*range(0, len(parts), PARTS), len(parts)]
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts), pa.scalar(" Ā ", parts.type)).to_pylist()
        coded = self.merger.encode_batch_fast([f"{r} Ā" for r in runs], add_special_tokens=False)
        ids = np.concatenate([np.array(c.ids, np.uint32) for c in coded])
        # Each is followed by the byte 0, which no part holds.
        lengths = np.diff(np.flatnonzero(ids == self.nothing), prepend=-1) - 1
        assert len(lengths) == len(parts), "a part was cut"
        return ids[ids != self.nothing], lengths

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text's ids. No nulls."""
        column = column.cast(pa.large_string())
        odd = pc.match_substring_regex(column, self.IRREGULAR).to_numpy(zero_copy_only=False)
        odd |= pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        plain = column.filter(pa.array(~odd))
        n_ids = np.zeros(len(column), np.int64)
        parts = pc.split_pattern(plain, " ")
        coded = pc.list_flatten(parts).dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        limits = parts.offsets.to_numpy() - (parts.offsets[0].as_py() if len(plain) else 0)
        first = limits[:-1]
        inner = np.ones(len(index), bool)
        inner[first] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[index[inner]] = True
        place = self._look_up(coded.dictionary.filter(pa.array(used)))
        lead = self.whole(pc.list_element(parts, 0).to_pylist()) if len(plain) else []
        # Positions in one pool: words after a space, then the texts' first words.
        pool = np.concatenate([self.pool, *lead]).astype(np.uint32, copy=False)
        word_len = np.zeros(len(used), np.int64)
        word_len[used] = self.size[place]
        word_at = np.zeros(len(used), np.int64)
        word_at[used] = self.at[place]
        size, at = word_len[index], word_at[index]
        lead_len = np.array([len(x) for x in lead], np.int64)
        size[first] = lead_len
        at[first] = len(self.pool) + np.cumsum(lead_len) - lead_len
        ends = np.cumsum(size)
        ids = pool[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        total = np.concatenate([[0], ends])[limits]
        n_ids[~odd] = np.diff(total)
        if not odd.any():
            return ids, n_ids
        rest = iter(self.whole(column.filter(pa.array(odd)).to_pylist()))
        cut = iter(np.split(ids, total[1:-1])) if len(plain) else iter(())
        out = [next(rest) if o else next(cut) for o in odd]
        n_ids = np.array([len(x) for x in out], np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), n_ids


def worker_encoder(path: str) -> TextEncoder:
    """The encoder of this Python worker, kept for its later tasks with the words it knows.

    Our functions travel by value, so the place that outlives a task is a module made here.
    """
    kept = sys.modules.setdefault("_kept_text_encoders", types.ModuleType("_kept_text_encoders")).__dict__
    if path not in kept:
        kept[path] = TextEncoder(path, KNOWN_BY_WORKER)
    return kept[path]


def encoded(encoder: TextEncoder, column: pa.Array, end: int, size: int = BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids with ``end`` after each text, ids of each text) in groups of at most ``size`` bytes, or of one text."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        ids, n = encoder.encode(column.slice(at, to - at))
        ids = np.insert(ids, np.cumsum(n), end).astype(np.uint32, copy=False)
        yield at, ids, n + 1
        at = to
