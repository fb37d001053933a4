"""An adaptive context-mixing range coder for token ids, over many blocks at once.

Each block starts afresh and is coded by itself; the blocks of a batch advance together, one
step at a time, as numpy lanes. A block first names its distinct ids, and the rest speaks of
places among these. Per id, the places that last followed the previous one and the previous two
are candidates. How often candidates in the same state of confidence came true gives the weights
by which the order-2 and order-1 predictions and the order-0 distribution are mixed; order 0
counts places digit by digit, five bits at a time, each digit after all digits before it. All
counts adapt after every id.

Order 0 depends on no context, so a block holds its distinct ids, the choices of an order, and
what order 0 gave as three streams; the choices are read last.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block, and blocks coded together: some 20 KB of counts each.
BLOCK = 4_096
LANES = 2_048
SLOTS = 10  # bits of the table of order 2
STATES = 128
#: Bits of a digit, what its count grows by, and the total at which a row of counts is halved, every so many steps.
BITS = 5
STEP, MOST, AGE = 8, 4_000, 256
#: The same of a choice.
CHOICE_STEP, CHOICE_MOST = 24, 8_000
MAGIC = b"ids2"
#: magic, ids, payload bytes, crc32 of the ids as little-endian 32-bit integers,
#: distinct ids, ids from order 0, bytes of the distinct ids and of the choices, crc32 of all these and the payload
HEADER, HEADER_BYTES = "<4sIIIIIIII", 36

#: Ranges are whole numbers below 2**48 in float64, which divides them fast and exactly.
SMALL, WORD = float(1 << 16), float(1 << 32)
ONES = np.uint64(0x0101010101010101)
WIDTH = 1 << BITS
DIGITS = np.arange(1, WIDTH + 1, dtype=np.uint16)
#: A row of running totals, moved as one item.
ROW = f"V{2 * WIDTH}"
#: What is added to a row when a digit is seen.
RISE = (STEP * (np.arange(WIDTH)[None, :] >= np.arange(WIDTH)[:, None])).astype(np.uint16).view(ROW).reshape(-1)
#: Running totals of the three choices in 16 bits each, from the lowest; the fourth is free.
CHOICES = np.array([1, 2, 4, 0], np.uint16)
CHOICE_RISE = (CHOICE_STEP * np.array([[1, 1, 1, 0], [0, 1, 1, 0], [0, 0, 1, 0]])).astype(np.uint16).view(np.uint64).reshape(-1)


class _Choices:
    """The candidates and the weights of the orders for every lane, shared by both directions."""

    def __init__(self, lanes: int, places: int):
        self.lanes, self.lane = lanes, np.arange(lanes)
        # A candidate and, in the lowest three bits, how far it is trusted. Lanes lie side by side, as they ask for like rows.
        self.kind = np.uint16 if places <= 1 << 13 else np.int32
        self.one, self.two = np.zeros(lanes * places, self.kind), np.zeros(lanes << SLOTS, self.kind)
        self.counts = np.tile(CHOICES.view(np.uint64), lanes * STATES)
        self.last, self.hashed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates of the first ``k`` lanes, and where the shares of the choices (two, one, none of them) end."""
        last, lane = self.last[:k], self.lane[:k]
        self.at_one = last * self.lanes
        self.at_one += lane
        hashed = last * 40_503
        hashed += self.hashed[:k]
        hashed >>= 3
        hashed &= (1 << SLOTS) - 1
        hashed *= self.lanes
        hashed += lane
        self.at_two, self.hashed = hashed, last * 60_493
        self.seen_one, self.seen_two = self.one.take(self.at_one), self.two.take(self.at_two)
        one, two = self.seen_one >> 3, self.seen_two >> 3
        sure = self.seen_two & 7
        sure <<= 3
        sure |= self.seen_one & 7
        sure |= (one == two).astype(self.kind) << 6
        self.row = np.multiply(sure, self.lanes, dtype=np.int64)
        self.row += lane
        self.weights = self.counts.take(self.row)
        weights = self.weights.view(np.int64)
        return one, two, ((weights & 65_535), (weights >> 16) & 65_535, weights >> 32)

    def learn(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, choice: np.ndarray) -> None:
        weights = self.weights
        weights += CHOICE_RISE.take(choice)
        self.counts[self.row] = weights
        fresh = ids << 3
        for table, at, seen, candidate in ((self.one, self.at_one, self.seen_one, one), (self.two, self.at_two, self.seen_two, two)):
            trust = seen & 7
            table[at] = np.where(candidate == ids, seen + (trust < 7), np.where(trust > 1, seen - ((trust + 1) >> 1), fresh))
        self.last = ids.astype(np.int64)

    def age(self) -> None:
        """Halve the weights of large totals."""
        weights = self.counts.view(np.uint16).reshape(-1, 4)
        full = np.flatnonzero(weights[:, 2] > CHOICE_MOST)
        weights[full] = (weights[full] >> 1) + np.array([1, 2, 3, 0], np.uint16)


class _Digits:
    """Running totals over the values of a digit, one row per lane and value of the digits before it."""

    def __init__(self, lanes: int, prefixes: int):
        self.lanes, self.lane, self.first = lanes, np.arange(lanes), np.arange(lanes) * WIDTH
        self.totals = np.tile(DIGITS, (lanes * prefixes, 1))
        self.rows = self.totals.view(ROW).reshape(-1) if prefixes > 1 else None

    def look(self, k: int, before: np.ndarray) -> np.ndarray:
        """Rows of the first ``k`` lanes, given the digits before."""
        if self.rows is None:
            return self.totals[:k]
        self.row = before * self.lanes
        self.row += self.lane[:k]
        return self.rows.take(self.row).view(np.uint16).reshape(k, WIDTH)

    def span(self, totals: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of a digit's share in each row."""
        flat, at = totals.reshape(-1), self.first[: len(of)] + of
        start = flat.take(at - 1, mode="wrap") * (of > 0)
        return start, flat.take(at) - start

    def count(self, totals: np.ndarray, of: np.ndarray) -> None:
        totals += RISE.take(of).view(np.uint16).reshape(-1, WIDTH)
        if self.rows is not None:
            self.rows[self.row] = totals.view(ROW).reshape(-1)

    def age(self) -> None:
        """Halve the rows of large totals."""
        full = np.flatnonzero(self.totals[:, -1] > MOST)
        self.totals[full] = (self.totals[full] >> 1) + DIGITS


def _places(target: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How many running totals of each row are not above its target: the bytes of some words, summed by one product."""
    below = (target.astype(np.uint16)[:, None] >= totals).view(np.uint64)
    words = below[:, 0] + below[:, 1]
    for k in range(2, below.shape[1]):
        words += below[:, k]
    return ((words * ONES) >> np.uint64(56)).astype(np.int64)


class _Writer:
    """Range coders, one per lane; words of 32 bits leave, with the carry into the word before as a 33rd bit."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes), np.full(lanes, WORD)
        self.lanes, self.rows, self.words = np.arange(lanes, dtype=np.uint16), [], []

    def part(self, lanes: np.ndarray) -> _Writer:
        """A writer of some lanes only, to be given back to ``join``."""
        some = _Writer(0)
        some.low, some.range, some.lanes, some.rows, some.words = self.low[lanes], self.range[lanes], self.lanes[lanes], self.rows, self.words
        return some

    def join(self, some: _Writer, lanes: np.ndarray) -> None:
        self.low[lanes], self.range[lanes] = some.low, some.range

    def put(self, k: int, start: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        span = self.range[:k]
        unit = span / total
        np.floor(unit, out=unit)
        np.multiply(size, unit, out=span)
        unit *= start
        self.low[:k] += unit
        rows = (span < SMALL).nonzero()[0]
        if len(rows):
            self._settle(rows)
            span[rows] *= WORD

    def _settle(self, rows: np.ndarray, more: int = 0) -> None:
        low = self.low[rows]
        word = np.floor((low + more) * (1 / SMALL))
        self.low[rows] = (low - word * SMALL) * WORD
        self.rows.append(self.lanes[rows])
        self.words.append(word.astype(np.int64))

    def payloads(self) -> list[bytes]:
        """Bytes of each lane. The first two are always zero and left out, so that a reader begins with a word."""
        self._settle(np.arange(len(self.low)), (1 << 16) - 1)
        rows = np.concatenate(self.rows)
        words = np.concatenate(self.words)[np.argsort(rows, kind="stable")]
        while len(carry := np.flatnonzero(words >> 32)):
            words[carry] &= 0xFFFFFFFF
            words[carry - 1] += 1
        packed = words.astype(">u4")
        ends = np.cumsum(np.bincount(rows, minlength=len(self.low))).tolist()
        return [packed[a:b].tobytes()[2:] + bytes(2) for a, b in zip([0, *ends], ends)]


class _Reader:
    def __init__(self, payloads: list[bytes]):
        sizes = np.array([len(p) // 4 + 1 for p in payloads], np.int64)
        self.words = np.frombuffer(b"".join(p + bytes(4) for p in payloads), ">u4").astype(np.uint32)
        self.at = np.cumsum(sizes) - sizes
        self.range, self.code = np.full(len(sizes), WORD), self.words.take(self.at).astype(np.float64)

    def part(self, lanes: np.ndarray) -> _Reader:
        some = _Reader([])
        some.words, some.at, some.range, some.code = self.words, self.at[lanes], self.range[lanes], self.code[lanes]
        return some

    def join(self, some: _Reader, lanes: np.ndarray) -> None:
        self.at[lanes], self.range[lanes], self.code[lanes] = some.at, some.range, some.code

    def target(self, k: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = self.range[:k] / total
        np.floor(unit, out=unit)
        return (self.code[:k] / unit).astype(np.int64), unit

    def take(self, k: int, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        span = self.range[:k]
        np.multiply(size, unit, out=span)
        unit *= start
        self.code[:k] -= unit
        rows = (span < SMALL).nonzero()[0]
        if len(rows):
            at = self.at[rows] + 1
            self.at[rows] = at
            some = span[rows]
            # A damaged block stays inside its range.
            self.code[rows] = np.minimum(self.code[rows], some - 1) * WORD + self.words.take(at, mode="clip")
            span[rows] = some * WORD


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Lanes by falling size, and how many of them are longer than each step."""
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max()) if len(sizes) else 0
    return order, (len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), "right")).tolist()


def _matrix(parts: list[np.ndarray], order: np.ndarray, steps: int) -> np.ndarray:
    """One column per lane."""
    rows = np.zeros((len(order), steps), np.uint16)
    for row, i in enumerate(order.tolist()):
        rows[row, : len(parts[i])] = parts[i]
    return np.ascontiguousarray(rows.T)


def _in_order(parts: list, order: np.ndarray) -> list:
    out = [None] * len(order)
    for i, part in zip(order.tolist(), parts):
        out[i] = part
    return out


def _distinct(blocks: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct ids of each block, ascending, and its ids as places among them."""
    there, place = np.zeros(1 << 16, bool), np.zeros(1 << 16, np.uint16)
    names, places = [], []
    for block in blocks:
        block = block.astype(np.int64)
        there[block] = True
        names.append(np.flatnonzero(there))
        there[names[-1]] = False
        place[names[-1]] = np.arange(len(names[-1]))
        places.append(place.take(block))
    return names, places


def _passes(most: np.ndarray, sizes: np.ndarray):
    """From the highest digit: its shift, the lanes that have it, how many of them are longer than each step, rows of counts a lane."""
    for shift in range(15, -1, -BITS):
        having = np.flatnonzero((most >> shift > 0) | (shift == 0))
        if len(having):
            yield shift, having, _lanes(sizes[having])[1], (int(most.max()) >> (shift + BITS)) + 1


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids below 65,536 as header and payload, decodable by itself."""
    out: list[bytes] = []
    for first in range(0, len(blocks), LANES):
        out.extend(_encode(blocks[first : first + LANES]))
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    names, places = _distinct(blocks)
    most = np.array([len(n) for n in names], np.int64) - 1
    choices, rest = _encode_choices(places, int(most.max()) + 1)
    streams = zip(_encode_names(names), choices, _encode_places(rest, most))
    out = []
    for block, name, literal, parts in zip(blocks, names, rest, streams):
        payload = b"".join(parts)
        sizes = len(name), len(literal), len(parts[0]), len(parts[1])
        head = struct.pack(HEADER[:-1], MAGIC, len(block), len(payload), zlib.crc32(block.astype("<u4")), *sizes)
        out.append(head + struct.pack("<I", zlib.crc32(payload, zlib.crc32(head))) + payload)
    return out


def _encode_names(names: list[np.ndarray]) -> list[bytes]:
    """Gaps between ascending ids: how many bits they have, by counts, then the bits below the highest as they are."""
    order, alive = _lanes(np.array([len(n) for n in names], np.int64))
    gaps = _matrix([np.diff(n, prepend=-1) - 1 for n in names], order, len(alive))
    coder, model = _Writer(len(order)), _Digits(len(order), 1)
    for step, k in enumerate(alive):
        if step % AGE == AGE - 1:
            model.age()
        bits = np.frexp(gaps[step, :k].astype(np.float64))[1].astype(np.int64)
        totals = model.look(k, bits)
        coder.put(k, *model.span(totals, bits), totals[:, -1])
        model.count(totals, bits)
    for step, k in enumerate(alive):
        gap = gaps[step, :k].astype(np.float64)
        high = np.floor(np.ldexp(0.5, np.frexp(gap)[1]))
        coder.put(k, gap - high, np.ones(k), np.maximum(high, 1))
    return _in_order(coder.payloads(), order)


def _decode_names(payloads: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    order, alive = _lanes(sizes)
    gaps = np.zeros((len(order), len(alive)), np.int64).T
    coder, model = _Reader([payloads[i] for i in order.tolist()]), _Digits(len(order), 1)
    for step, k in enumerate(alive):
        if step % AGE == AGE - 1:
            model.age()
        totals = model.look(k, None)
        target, unit = coder.target(k, totals[:, -1])
        bits = np.minimum(_places(target, totals), 16)
        coder.take(k, *model.span(totals, bits), unit)
        model.count(totals, bits)
        gaps[step, :k] = bits
    for step, k in enumerate(alive):
        high = np.floor(np.ldexp(0.5, gaps[step, :k]))
        target, unit = coder.target(k, np.maximum(high, 1))
        low = np.minimum(target, np.maximum(high, 1) - 1)
        coder.take(k, low, np.ones(k), unit)
        gaps[step, :k] = high + low
    # A gap counts the ids left out before an id.
    ids = np.cumsum(gaps.T + 1, 1) - 1
    return _in_order([row[:n] for row, n in zip(ids, sizes[order].tolist())], order)


def _encode_choices(places: list[np.ndarray], most: int) -> tuple[list[bytes], list[np.ndarray]]:
    """The stream of choices, and the places left to order 0, of each block."""
    order, alive = _lanes(np.array([len(b) for b in places], np.int64))
    ids = _matrix(places, order, len(alive))
    left = np.zeros(ids.shape, bool)
    coder, model = _Writer(len(order)), _Choices(len(order), most)
    for step, k in enumerate(alive):
        if step % AGE == AGE - 1:
            model.age()
        now = ids[step, :k].astype(model.kind)
        one, two, (first, second, total) = model.contexts(k)
        missed = now != two
        none = missed & (now != one)
        left[step, :k] = none
        start = np.where(none, second, first * missed)
        coder.put(k, start, np.where(none, total, np.where(missed, second, first)) - start, total)
        model.learn(now, one, two, missed.view(np.int8) + none.view(np.int8))
    packed = _in_order(coder.payloads(), order)
    rows, some = np.ascontiguousarray(ids.T), np.ascontiguousarray(left.T)
    return packed, _in_order([row[chosen] for row, chosen in zip(rows, some)], order)


def _encode_places(parts: list[np.ndarray], most: np.ndarray) -> list[bytes]:
    sizes = np.array([len(p) for p in parts], np.int64)
    order, alive = _lanes(sizes)
    places, coder = _matrix(parts, order, len(alive)), _Writer(len(order))
    for shift, lanes, alive, prefixes in _passes(most[order], sizes[order]):
        ids = places if len(lanes) == len(order) else places[:, lanes]
        some, model = coder.part(lanes), _Digits(len(lanes), prefixes)
        for step, k in enumerate(alive):
            if step % AGE == AGE - 1:
                model.age()
            now = (ids[step, :k] >> shift).astype(np.int64)
            of = now & (WIDTH - 1)
            totals = model.look(k, now >> BITS)
            some.put(k, *model.span(totals, of), totals[:, -1])
            model.count(totals, of)
        coder.join(some, lanes)
    return _in_order(coder.payloads(), order)


def _decode_places(payloads: list[bytes], sizes: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places given by order 0, one column per block, and the blocks of the columns."""
    order, alive = _lanes(sizes)
    most = most[order]
    places, coder = np.zeros((len(alive) + 1, len(order)), np.uint16), _Reader([payloads[i] for i in order.tolist()])
    for shift, lanes, alive, prefixes in _passes(most, sizes[order]):
        ids = places if len(lanes) == len(order) else places[:, lanes]
        some, model = coder.part(lanes), _Digits(len(lanes), prefixes)
        for step, k in enumerate(alive):
            if step % AGE == AGE - 1:
                model.age()
            before = ids[step, :k].astype(np.int64)
            totals = model.look(k, before)
            target, unit = some.target(k, totals[:, -1])
            of = np.minimum(_places(target, totals), WIDTH - 1)
            some.take(k, *model.span(totals, of), unit)
            model.count(totals, of)
            before <<= BITS
            before |= of
            ids[step, :k] = before
        coder.join(some, lanes)
        # There are higher ones in a damaged block only.
        places[:, lanes] = np.minimum(ids, (most[lanes] >> shift).astype(np.uint16))
    return places, order


def decode_blocks(packed: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ValueError where a block is damaged."""
    out: list[np.ndarray] = []
    for first in range(0, len(packed), LANES):
        out.extend(_decode(packed[first : first + LANES]))
    return out


def _decode(packed: list[bytes]) -> list[np.ndarray]:
    heads = []
    for p in packed:
        if len(p) < HEADER_BYTES or p[:4] != MAGIC:
            raise ValueError("not a block of ids, or cut off")
        head = struct.unpack_from(HEADER, p)
        if head[2] != len(p) - HEADER_BYTES or head[8] != zlib.crc32(p[HEADER_BYTES:], zlib.crc32(p[: HEADER_BYTES - 4])):
            raise ValueError("not a block of ids, cut off, or damaged")
        heads.append(head)
    n, distinct, literals, a, b = (np.array([h[k] for h in heads], np.int64) for k in (1, 4, 5, 6, 7))
    a += HEADER_BYTES
    b += a
    names = _decode_names([p[HEADER_BYTES:i] for p, i in zip(packed, a.tolist())], distinct)
    rest, columns = _decode_places([p[i:] for p, i in zip(packed, b.tolist())], literals, distinct - 1)
    places = _decode_choices([p[i:j] for p, i, j in zip(packed, a.tolist(), b.tolist())], n, rest, columns, int(distinct.max()))
    out = []
    for head, name, place in zip(heads, names, places):
        found = name.take(place).astype("<u4")
        if zlib.crc32(found) != head[3]:
            raise ValueError("checksum of a block differs")
        out.append(found)
    return out


def _decode_choices(payloads: list[bytes], sizes: np.ndarray, rest: np.ndarray, columns: np.ndarray, most: int) -> list[np.ndarray]:
    order, alive = _lanes(sizes)
    at, rest = np.argsort(columns)[order], rest.reshape(-1)
    coder, model = _Reader([payloads[i] for i in order.tolist()]), _Choices(len(order), most)
    ids = np.zeros((len(alive), len(order)), np.uint16)
    for step, k in enumerate(alive):
        if step % AGE == AGE - 1:
            model.age()
        one, two, (first, second, total) = model.contexts(k)
        target, unit = coder.target(k, total)
        missed, none = target >= first, target >= second
        start = np.where(none, second, first * missed)
        coder.take(k, start, np.where(none, total, np.where(missed, second, first)) - start, unit)
        now = np.where(none, rest.take(at[:k], mode="clip").astype(model.kind, copy=False), np.where(missed, one, two))
        at[:k] += none * np.int64(len(order))
        model.learn(now, one, two, missed.view(np.int8) + none.view(np.int8))
        ids[step, :k] = now
    rows = np.ascontiguousarray(ids.T)
    return _in_order([row[:n] for row, n in zip(rows, sizes[order].tolist())], order)
