"""Word shingles of whole texts as 64-bit hashes, computed over Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes hashed at a time; a text is cut between words, never inside one
WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class WordHasher:
    """Hashes of the white-space separated, A-Z lower-cased words of a byte buffer.

    A word's hash is a polynomial of random byte weights, cut out of one running sum.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self):
        byte = np.arange(256, dtype=np.uint8)
        byte[65:91] += 32
        self.weight = _odd(256, 7)[byte]
        self.white = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            back = np.uint64(pow(int(self.BASE), -1, 1 << 64))
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, self.BASE)]))
            self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, back)]))

    def words(self, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and at which word each text begins; ``limits`` are the texts' offsets."""
        n = len(data)
        self._grow(n + 1)
        black = ~self.white[data]
        cut = np.zeros(n + 1, bool)
        cut[limits] = True
        starts = np.flatnonzero(black & (cut[:n] | np.concatenate([[True], ~black[:-1]])[:n]))
        ends = np.flatnonzero(black & (cut[1:] | np.concatenate([~black[1:], [True]])[:n])) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.weight[data] * self.power[:n])])
        hashes = mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        return hashes, np.searchsorted(starts, limits)

    def long_text(self, data: np.ndarray) -> np.ndarray:
        """Word hashes of one text of any length, in pieces cut at white space."""
        out, at = [], 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            while end < len(data) and not self.white[data[end]]:
                more = np.flatnonzero(self.white[data[end : end + PIECE]])
                end = end + int(more[0]) if len(more) else min(end + PIECE, len(data))
            piece = data[at:end]
            out.append(self.words(piece, np.array([0, len(piece)]))[0])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _shingles(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    n = len(words) - WORDS + 1
    with np.errstate(over="ignore"):
        return mix(sum(words[k : k + n] * weights[k] for k in range(WORDS)))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than five words make one shingle."""
    hasher, weights = WordHasher(), _odd(WORDS, 11)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)

    def finish(words: np.ndarray) -> np.ndarray:
        if len(words) >= WORDS:
            return np.unique(_shingles(words, weights))
        if len(words) == 0:
            return words
        padded = np.concatenate([words, np.full(WORDS - len(words), len(words), np.uint64)])
        return _shingles(padded, weights)

    at = 0
    while at < len(column):
        end = at + 1
        while end < len(column) and offsets[end + 1] - offsets[at] <= PIECE:
            end += 1
        if end == at + 1:
            yield finish(hasher.long_text(data[offsets[at] : offsets[end]]))
        else:
            words, first = hasher.words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            for i in range(end - at):
                yield finish(words[first[i] : first[i + 1]])
        at = end
