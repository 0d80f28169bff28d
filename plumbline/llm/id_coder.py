"""Adaptive context-mixing range coder for token ids.

A block of ids is coded by itself: its model starts from nothing and its frame carries checksums. Three predictions
meet in every step: the id that last followed the two previous ids (order 2, a hashed table), the id that last
followed the previous one (order 1), and the adaptive frequencies of all ids (order 0). How far each is trusted is
learned per context, a context being how often the two predictions held lately and whether they agree; the mixed
distribution gives order 2 one interval, order 1 the next, and shares out the rest by order 0.

So that numpy can do the work, a block is dealt into up to `LANES` runs of neighbouring ids. Every lane has a
range coder of its own; all lanes code their next id in lockstep under the one model of the block, which then learns
from all of them. The decoder repeats the same steps. A lane's state is 64 bits wide and gives out 32-bit words;
where the range gets narrow across a word border it is cut at the border, so no carry has to travel back.

Frame: magic, version, ids, ids in the vocabulary, lanes, crc32 of the ids, crc32 of what follows; then how many
words each lane has, and the words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"PLID"
VERSION = 1
BLOCK = 1 << 21
LANES, LANE_IDS = 4096, 256
HASH_BITS = 18
#: Order 0: what an id's count grows by, and the sum of counts at which all are halved.
STEP, MOST = 24, 1 << 22
_HEAD = struct.Struct("<4sHxxIIIII")
_U = np.uint64
_WORD, _MASK = _U(32), _U(0xFFFFFFFF)


class Damaged(ValueError):
    """A frame that is not whole."""


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // LANE_IDS))


#: Trust after a miss (first four) and after a hit, by the trust before.
_TRUST = np.array([0, 0, 1, 1, 1, 2, 3, 3], np.int32)


class _Model:
    """What encoder and decoder know alike at a step: predictions, their trust, and order-0 frequencies."""

    def __init__(self, vocabulary: int, lanes: int):
        self.count = np.ones(vocabulary, np.int64)
        self.total = vocabulary
        self.edge = np.arange(vocabulary + 1, dtype=np.int64)
        # Predicted id and, in the low two bits, how well it has done.
        self.one = np.zeros(vocabulary, np.int32)
        self.two = np.zeros(1 << HASH_BITS, np.int32)
        # By context: how often order 2 was right, how often order 1 was where order 2 wasn't, how often neither.
        self.right = np.tile(np.array([1.0, 1.0, 6.0]), (32, 1))
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.steps = 0
        self._weigh()

    def _weigh(self) -> None:
        r = self.right
        both = r.sum(axis=1)
        first = np.clip(r[:, 0] / both * 65536, 32, 65536 - 96)
        second = np.clip(r[:, 1] / both * 65536, 32, 65536 - 64 - first)
        self.upto2 = first.astype(_U)
        self.upto1 = self.upto2 + second.astype(_U)

    def predict(self, k: int):
        """(order-2 ids, order-1 ids, contexts, slots) of the first k lanes."""
        last = self.last[:k]
        slot = (last * 40503 + self.before[:k] * 60493) & ((1 << HASH_BITS) - 1)
        two, one = self.two[slot], self.one[last]
        at = ((two & 3) << 2) | (one & 3)
        two, one = two >> 2, one >> 2
        return two, one, at | ((two == one) << 4), slot

    def learn(self, ids: np.ndarray, two, one, at, slot) -> None:
        k = len(ids)
        short = ids.astype(np.int32)  # as wide as the tables
        hit2 = two == short
        hit1 = one == short
        kind = np.where(hit2, 0, np.where(hit1, 1, 2))
        self.right += np.bincount(at * 3 + kind, minlength=96).reshape(32, 3)
        # A wrong prediction loses trust first and its place only when it has none left.
        for table, where, guess, hit, trust in ((self.two, slot, two, hit2, at >> 2 & 3), (self.one, self.last[:k], one, hit1, at & 3)):
            table[where] = np.where(hit | (trust > 1), guess, short) << 2 | _TRUST[trust + (hit.view(np.int8) << 2)]
        np.add.at(self.count, ids, STEP)
        self.before[:k] = self.last[:k]
        self.last[:k] = ids
        self.steps += 1
        if self.steps % 8 == 0 or self.steps in (1, 2, 4):
            if self.steps % 64 == 0:
                self.right *= 0.5
                self.right += 0.05
            self._weigh()
            np.cumsum(self.count, out=self.edge[1:])
            if self.edge[-1] > MOST:
                self.count += 1
                self.count >>= 1
                np.cumsum(self.count, out=self.edge[1:])
            self.total = int(self.edge[-1])


def _plan(n: int) -> tuple[int, int, int]:
    """(lanes, steps, lanes that have an id in the last step); every lane but the later ones has `steps` ids."""
    lanes = _lanes(n)
    steps = -(-n // lanes)
    return lanes, steps, n - (steps - 1) * lanes


def _order(n: int) -> tuple[np.ndarray, int, int]:
    """Where each lane starts in the block: lanes hold neighbouring ids, longer lanes first."""
    lanes, steps, full = _plan(n)
    size = np.full(lanes, steps - 1, np.int64)
    size[:full] = steps
    return np.cumsum(size) - size, steps, full


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """The frame of a block of ids, each below `vocabulary`."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    if n and int(ids.max()) >= vocabulary:
        raise ValueError("an id is not in the vocabulary")
    lanes, body = 0, b""
    if n:
        start, steps, full = _order(n)
        lanes = len(start)
        model = _Model(vocabulary, lanes)
        low, wide = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
        words = np.empty((2 * steps + 2, lanes), np.uint32)
        used = np.zeros(lanes, np.int64)
        source = ids.astype(np.int64)

        def give(at: np.ndarray) -> None:
            """Give out a word of the lanes `at`, whose range is under a word wide."""
            a, w = low[at], wide[at]
            w = np.minimum(w - _U(1), _MASK - (a & _MASK))
            words[used[at], at] = a >> _WORD
            used[at] += 1
            low[at] = a << _WORD
            wide[at] = w << _WORD | _MASK

        for t in range(steps):
            k = lanes if t < steps - 1 else full
            x = source[start[:k] + t]
            two, one, at, slot = model.predict(k)
            hit2 = two == x
            hit1 = (one == x) & ~hit2
            up2, up1 = model.upto2[at], model.upto1[at]
            unit = wide[:k] >> _U(16)
            begin = np.where(hit2, _U(0), np.where(hit1, up2, up1))
            size = np.where(hit2, up2, np.where(hit1, up1 - up2, _U(65536) - up1))
            low[:k] += unit * begin
            wide[:k] = unit * size
            out = np.flatnonzero(wide[:k] < _U(1 << 32))
            if len(out):
                give(out)
            rest = np.flatnonzero(~(hit2 | hit1))
            if len(rest):
                y = x[rest]
                unit = wide[rest] // _U(model.total)
                begin = model.edge[y]
                low[rest] += unit * begin.astype(_U)
                wide[rest] = unit * (model.edge[y + 1] - begin).astype(_U)
                out = rest[wide[rest] < _U(1 << 32)]
                if len(out):
                    give(out)
            model.learn(x, two, one, at, slot)
        words[used, np.arange(lanes)] = (low + _MASK) >> _WORD
        used += 1
        live = np.arange(len(words))[:, None] < used
        body = used.astype("<u4").tobytes() + words.T[live.T].astype("<u4").tobytes()
    return _HEAD.pack(MAGIC, VERSION, n, vocabulary, lanes, zlib.crc32(ids.tobytes()), zlib.crc32(body)) + body


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame, as '<u4'. Raises Damaged where a checksum or a length does not hold."""
    if len(frame) < _HEAD.size:
        raise Damaged("the frame is cut off")
    magic, version, n, vocabulary, lanes, ids_crc, body_crc = _HEAD.unpack_from(frame)
    body = memoryview(frame)[_HEAD.size :]
    if magic != MAGIC or version != VERSION:
        raise Damaged("not a frame of this format")
    if zlib.crc32(body) != body_crc:
        raise Damaged("the checksum of a block's words does not hold")
    out = np.zeros(n, "<u4")
    if n:
        start, steps, full = _order(n)
        if lanes != len(start):
            raise Damaged("a block has the wrong number of lanes")
        used = np.frombuffer(body, "<u4", lanes).astype(np.int64)
        # The word after the last is zero; past its end a lane reads that one.
        words = np.concatenate([np.frombuffer(body, "<u4", offset=4 * lanes), np.zeros(1, "<u4")]).astype(_U)
        zero = len(words) - 1
        if zero != int(used.sum()):
            raise Damaged("a block has the wrong number of words")
        end_word = np.cumsum(used)
        at_word = end_word - used
        code = words[at_word] << _WORD | words[np.where(used > 1, at_word + 1, zero)]
        at_word += 2
        model = _Model(vocabulary, lanes)
        wide = np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
        low = np.zeros(lanes, _U)

        def take(at: np.ndarray) -> None:
            a, w = low[at], wide[at]
            w = np.minimum(w - _U(1), _MASK - (a & _MASK))
            p = at_word[at]
            code[at] = code[at] << _WORD | words[np.where(p < end_word[at], p, zero)]
            at_word[at] = p + 1
            low[at] = a << _WORD
            wide[at] = w << _WORD | _MASK

        for t in range(steps):
            k = lanes if t < steps - 1 else full
            two, one, at, slot = model.predict(k)
            up2, up1 = model.upto2[at], model.upto1[at]
            unit = wide[:k] >> _U(16)
            off = code[:k] - low[:k]
            end2, end1 = unit * up2, unit * up1
            in2 = off < end2
            in1 = off < end1
            x = np.where(in2, two, one).astype(np.int64)
            low[:k] += np.where(in2, _U(0), np.where(in1, end2, end1))
            wide[:k] = np.where(in2, end2, np.where(in1, end1 - end2, unit * (_U(65536) - up1)))
            out_of = np.flatnonzero(wide[:k] < _U(1 << 32))
            if len(out_of):
                take(out_of)
            rest = np.flatnonzero(~in1)
            if len(rest):
                unit = wide[rest] // _U(model.total)
                v = np.minimum((code[rest] - low[rest]) // unit, _U(model.total - 1)).astype(np.int64)
                o = np.argsort(v)  # neighbours in order find their places several times faster
                y = np.empty(len(v), np.int64)
                y[o] = np.searchsorted(model.edge, v[o], "right") - 1
                begin = model.edge[y]
                low[rest] += unit * begin.astype(_U)
                wide[rest] = unit * (model.edge[y + 1] - begin).astype(_U)
                x[rest] = y
                out_of = rest[wide[rest] < _U(1 << 32)]
                if len(out_of):
                    take(out_of)
            out[start[:k] + t] = x
            model.learn(x, two, one, at, slot)
    if zlib.crc32(out.tobytes()) != ids_crc:
        raise Damaged("the checksum of a block's ids does not hold")
    return out
