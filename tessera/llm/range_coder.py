"""Adaptive context-mixing range coder for token ids (operator 2), as numpy over many lanes.

A block's ids are dealt to L lanes of consecutive ids. All lanes code one id at each step, each with a range coder of
its own; the model is the block's, is empty when the block begins, and learns from all lanes' ids after each step. So
encoder and decoder see the same model, and one numpy call serves L ids.

Three models predict an id. Order 2 (the two ids before) and order 1 (the id before) each name one likely id; order 0
spreads the rest over the vocabulary by the counts so far. Their predictions are mixed: the id's share of the range is
the sum of what each order gives it, by weights that the block learns for each pair of trusts (how often the guesses of
the two contexts held lately) and for whether the guesses agree. All arithmetic is on integers, so that blocks decode
alike on every machine. Order 0 is counted anew after 1, 2, 4, 8, 16
and then each 32 steps, the weights after each of the first 16 and then each 8.
"""

import struct
import zlib

import numpy as np

BLOCK_IDS = 1 << 22
#: Most lanes, and the least ids of one: the model learns once a step, so more lanes in a small block would mean fewer steps to learn from.
LANES, LANE_IDS = 8192, 384
#: Bits of the mixing weights, and those of order 0 for vocabularies up to 2^18 ids (larger ones take two bits over their size).
_W, _ORDER0, _EVERY = 10, 20, 32
_MOST_VOCABULARY = 1 << 20
_LOW32 = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)
_HEAD = struct.Struct("<4sIIII")
MAGIC = b"CMB2"


def _tables() -> tuple[np.ndarray, ...]:
    """By the code (trust 1, trust 2, whether the guesses agree, whether guess 2 held, whether guess 1 held): for each order the change of its slot and whether the slot takes the new id."""
    next_trust = np.array([[1, 1, *(t >> 1 for t in range(2, 16))], [min(t + 1, 15) for t in range(16)]])
    code = np.arange(2048)
    out = []
    for shift, held, trust in ((5, code & 1, code >> 7), (1, code >> 1 & 1, code >> 3 & 15)):
        out += [((next_trust[held, trust] - trust) << shift).astype(np.int32), (held == 0) & (trust <= 1)]
    return tuple(out)


_CHANGE1, _TAKES1, _CHANGE2, _TAKES2 = _tables()


class _Model:
    """Counts of order 0, guesses of orders 1 and 2 with their trust (0: none yet, to 15), and the mixing weights.

    A slot of order 1 holds guess << 9 | trust << 5, one of order 2 guess << 5 | trust << 1: so two masks and whether the
    guesses agree make the number of the weights.
    """

    def __init__(self, vocabulary: int):
        if vocabulary > _MOST_VOCABULARY:
            raise ValueError(f"vocabularies of over {_MOST_VOCABULARY} ids are not supported")
        self.bits = max(_ORDER0, min(_ORDER0 + 2, (vocabulary - 1).bit_length() + 2))
        self.counts, self.steps, self.held = np.zeros(vocabulary, np.int64), 0, []
        self.memory = (np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32))
        trust1, trust2, same = np.meshgrid(np.arange(16), np.arange(16), np.arange(2), indexing="ij")
        #: A weight is 0 where its order has no guess, or order 1 names what order 2 names.
        self.may = np.stack([(trust2 > 0).ravel(), ((trust1 > 0) & ~((same > 0) & (trust2 > 0))).ravel()]).astype(np.int64)
        self.hits, self.seen, self.tally = np.zeros((2, 512), np.int64), np.zeros(512, np.int64), np.zeros(2048, np.int64)
        self._weigh()
        self._count()

    def _count(self) -> None:
        """Shares of order 0: at least 1 for every id, 2^bits together; the commonest id takes what rounding leaves."""
        if self.held:
            self.counts += np.bincount(np.concatenate(self.held), minlength=len(self.counts))
        self.held = []
        room, n = (1 << self.bits) - len(self.counts), int(self.counts.sum())
        size = 1 + (self.counts * room // n if n else np.zeros(len(self.counts), np.int64))
        size[int(self.counts.argmax())] += (1 << self.bits) - int(size.sum())
        self.size, self.at = size, None
        #: start << 32 | size of each id's share
        self.share = ((np.cumsum(size) - size) << 32 | size).view(np.uint64)

    def id_at(self, place: np.ndarray) -> np.ndarray:
        """The ids whose shares of order 0 hold the places."""
        if self.at is None:
            self.at = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        return self.at.take(place)

    def _weigh(self) -> None:
        tally, self.tally = self.tally.reshape(512, 2, 2), np.zeros(2048, np.int64)
        self.seen += tally.sum((1, 2))
        self.hits[0] += tally[:, 1].sum(1)
        self.hits[1] += tally[:, :, 1].sum(1)
        old = self.seen > 1 << 16
        self.seen[old] >>= 1
        self.hits[:, old] >>= 1
        share = ((self.hits * 2 + 1) << _W) // (2 * self.seen + 3) * self.may
        over = np.maximum(share.sum(0), 1)
        most = (1 << _W) - 8
        share = np.where(over > most, share * most // over, share)
        until1 = share.sum(0)
        #: Ends of the shares of orders 2 and 1 in the range, and what order 0 has of it.
        self.end2, self.end1, self.rest = ((x << s).view(np.uint64) for x, s in ((share[0], self.bits), (until1, self.bits), ((1 << _W) - until1, 0)))

    @staticmethod
    def contexts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the orders after the ids a and b (unsigned, 32 bits)."""
        return (b & np.uint32(0xFFFF)).astype(np.int64), ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(14)).astype(np.int64)

    def predict(self, c1: np.ndarray, c2: np.ndarray):
        """The slots, the guesses of orders 1 and 2, and the number of the weights in force."""
        m1, m2 = self.memory[0].take(c1), self.memory[1].take(c2)
        g1, g2 = m1 >> 9, m2 >> 5
        return m1, m2, g1, g2, ((m1 & 0x1E0) | (m2 & 0x1E) | (g1 == g2)).astype(np.int64)

    def learn(self, c1: np.ndarray, c2: np.ndarray, ids: np.ndarray, same1: np.ndarray, same2: np.ndarray, predicted) -> None:
        m1, m2, _, _, w = predicted
        code = (w << 2) + (same2.view(np.int8) * np.int8(2) + same1.view(np.int8))
        self.tally += np.bincount(code, minlength=2048)
        new = m1 + _CHANGE1.take(code)
        np.putmask(new, _TAKES1.take(code), (ids << 9) + 32)
        self.memory[0][c1] = new
        new = m2 + _CHANGE2.take(code)
        np.putmask(new, _TAKES2.take(code), (ids << 5) + 2)
        self.memory[1][c2] = new
        self.held.append(ids)
        self.steps += 1
        if self.steps % 8 == 0 or self.steps < 16:
            self._weigh()
        if self.steps % _EVERY == 0 or self.steps in (1, 2, 4, 8, 16):
            self._count()


class _Writer:
    """A range coder for each lane: 64-bit low and range, words of 32 bits, carries added when all is coded."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        #: A row of words for each lane, so that a lane's next word lies beside its last; n holds the next places.
        self.width = steps + 2
        self.words, self.n = np.zeros(lanes * self.width, np.uint64), np.arange(lanes) * self.width + 1

    def code(self, m: int, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        """Codes a share of 2^bits on each of the first m lanes."""
        r = self.range[:m] >> np.uint64(bits)
        start *= r
        low = self.low[:m]
        low += start
        over = low < start
        if over.any():
            self.words[self.n[:m][over] - 1] += np.uint64(1)
        np.multiply(r, size, out=self.range[:m])
        full = np.flatnonzero(self.range[:m] <= _LOW32)
        if len(full):
            n, low = self.n.take(full), self.low.take(full)
            self.words[n] = low >> _32
            self.n[full] = n + 1
            self.low[full] = low << _32
            self.range[full] = self.range.take(full) << _32

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """The lanes' words, lane after lane, and how many each has."""
        # The upper end, cut to 32 bits, lies in the range and needs one word.
        last = self.low + self.range - np.uint64(1)
        self.words[self.n - 1] += (last < self.low).astype(np.uint64)
        self.words[self.n] = last >> _32
        counts = self.n - np.arange(len(self.n)) * self.width
        words = self.words.reshape(-1, self.width)[:, : int(counts.max()) + 1]
        for k in range(words.shape[1] - 1, 0, -1):
            words[:, k - 1] += words[:, k] >> _32
        return words[:, 1:][np.arange(1, words.shape[1]) <= counts[:, None]].astype("<u4"), counts


class _Reader:
    def __init__(self, words: np.ndarray, counts: np.ndarray):
        #: A lane reads one word behind its own at most, which counts for nothing: the last lane's are zeros.
        self.words = np.concatenate([words, np.zeros(2, "<u4")]).astype(np.uint64)
        self.ends = np.cumsum(counts)
        self.at = self.ends - counts
        self.range = np.full(len(counts), 0xFFFFFFFFFFFFFFFF, np.uint64)
        every = np.arange(len(counts))
        self.value = self._next(every) << _32
        self.value |= self._next(every)

    def _next(self, lanes: np.ndarray) -> np.ndarray:
        """Each lane's next word; zeros behind the last."""
        at = self.at.take(lanes)
        self.at[lanes] = at + 1
        got = self.words.take(at, mode="clip")
        np.putmask(got, at >= self.ends.take(lanes), 0)
        return got

    def place(self, m: int, bits: int) -> np.ndarray:
        self.r = self.range[:m] >> np.uint64(bits)
        return np.minimum(self.value[:m] // self.r, np.uint64((1 << bits) - 1))

    def took(self, m: int, start: np.ndarray, size: np.ndarray) -> None:
        start *= self.r
        self.value[:m] -= start
        np.multiply(self.r, size, out=self.range[:m])
        full = np.flatnonzero(self.range[:m] <= _LOW32)
        if len(full):
            self.value[full] = self.value.take(full) << _32 | self._next(full)
            self.range[full] = self.range.take(full) << _32


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes, steps, and how many lanes still code at the last step."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


def _dealt(ids: np.ndarray, lanes: int, steps: int, last: int) -> np.ndarray:
    """Ids dealt to lanes, as a row for each step; the first `last` lanes have an id at the last step."""
    out = np.zeros((steps, lanes), ids.dtype)
    out[:, :last] = ids[: last * steps].reshape(last, steps).T
    if steps > 1:
        out[:-1, last:] = ids[last * steps :].reshape(lanes - last, steps - 1).T
    return out


def _gathered(rows: np.ndarray, last: int) -> np.ndarray:
    """What _dealt was given."""
    return np.concatenate([rows[:, :last].T.ravel(), rows[:-1, last:].T.ravel()])


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block: header (magic, ids, crc32 of the ids, crc32 of the body, lanes), then the lanes' word counts and words."""
    n = len(ids)
    ids = np.ascontiguousarray(ids, "<u4")
    body, lanes = b"", 0
    if n:
        lanes, steps, last = _shape(n)
        model, coder, rows = _Model(vocabulary), _Writer(lanes, steps), _dealt(ids.astype(np.int32), lanes, steps, last)
        a = b = np.zeros(lanes, np.uint32)
        for t in range(steps):
            m = lanes if t < steps - 1 else last
            now = rows[t, :m]
            c1, c2 = model.contexts(a[:m], b[:m])
            predicted = model.predict(c1, c2)
            _, _, g1, g2, w = predicted
            same1, same2 = g1 == now, g2 == now
            end2, end1, rest = model.end2.take(w), model.end1.take(w), model.rest.take(w)
            share = model.share.take(now.astype(np.int64))
            start = (share >> _32) * rest
            start += end1
            size = (share & _LOW32) * rest
            by1 = same1 & (end1 > end2)
            np.putmask(start, by1, end2)
            np.putmask(size, by1, end1 - end2)
            by2 = same2 & (end2 > 0)
            np.putmask(start, by2, 0)
            np.putmask(size, by2, end2)
            coder.code(m, start, size, model.bits + _W)
            model.learn(c1, c2, now, same1, same2, predicted)
            a, b = b[:m], now.view(np.uint32)
        words, counts = coder.done()
        body = counts.astype("<u4").tobytes() + words.tobytes()
    return _HEAD.pack(MAGIC, n, zlib.crc32(ids.tobytes()), zlib.crc32(body), lanes) + body


def decode_block(data: bytes, vocabulary: int) -> np.ndarray:
    """The ids of a block; ValueError if it is damaged."""
    magic, n, crc, body_crc, lanes = _HEAD.unpack_from(data)
    body = memoryview(data)[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("a block is damaged")
    ids = np.zeros(0, "<u4")
    if n:
        _, steps, last = _shape(n)
        model, rows = _Model(vocabulary), np.zeros((steps, lanes), np.int32)
        coder = _Reader(np.frombuffer(body, "<u4", offset=4 * lanes), np.frombuffer(body, "<u4", lanes).astype(np.int64))
        a = b = np.zeros(lanes, np.uint32)
        for t in range(steps):
            m = lanes if t < steps - 1 else last
            c1, c2 = model.contexts(a[:m], b[:m])
            predicted = model.predict(c1, c2)
            _, _, g1, g2, w = predicted
            end2, end1, rest = model.end2.take(w), model.end1.take(w), model.rest.take(w)
            place = coder.place(m, model.bits + _W)
            by1, by2 = place < end1, place < end2
            place -= end1
            np.putmask(place, by1, 0)
            now = model.id_at((place.astype(np.uint32) // rest.astype(np.uint32)).astype(np.int64))
            share = model.share.take(now.astype(np.int64))
            start = (share >> _32) * rest
            start += end1
            size = (share & _LOW32) * rest
            np.putmask(now, by1, g1)
            np.putmask(start, by1, end2)
            np.putmask(size, by1, end1 - end2)
            np.putmask(now, by2, g2)
            np.putmask(start, by2, 0)
            np.putmask(size, by2, end2)
            coder.took(m, start, size)
            model.learn(c1, c2, now, g1 == now, g2 == now, predicted)
            rows[t, :m] = now
            a, b = b[:m], now.view(np.uint32)
        ids = _gathered(rows, last).astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block's ids do not match their checksum")
    return ids
