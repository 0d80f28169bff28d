"""Token ids of texts by the tokenizers library, which is asked once for each different piece.

A byte-level vocabulary cuts a text into pieces (words with the space before them, numbers, signs, white space) and
encodes each by itself. The cut depends on character classes only, so it is made here for many texts at once in
numpy; pieces are hashed and looked up in an open-addressed table, and only pieces that the table lacks go to the
library, joined into long strings. The class of a character beyond ASCII is asked of the library too, when it is
first met. Texts that hold an added token, or white space beyond ASCII, and all texts of a vocabulary of another
kind, are given to the library whole.

Pieces are told apart by 64 bits and their length. The table holds `CACHE` pieces; when it is full it starts anew, so
a worker's memory is bounded whatever it reads.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

CACHE = 1 << 20
#: Text that is cut at once, in bytes; a longer text is a group of its own.
GROUP = 1 << 19
_U = np.uint64
_MUL = 0x9E3779B97F4A7C15
LETTER, NUMBER, OTHER, SPACE, WHITE, END, UNKNOWN = range(7)
_held: dict = {}
_SAFE = re.compile(rb"[A-Za-z](?= [A-Za-z])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: visible Latin-1 characters for themselves, the
    others for the next code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total, dtype=starts.dtype)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(_MUL, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(_MUL, -k, 1 << 64))])
        return self.up[:n], self.down[:n]


class Pieces:
    """Table from a piece's hash to its ids, with room for so many pieces."""

    def __init__(self, room: int):
        bits = int(2 * room - 1).bit_length()
        self.room, self.shift, self.mask = room, _U(64 - bits), (1 << bits) - 1
        self.key = np.zeros(1 << bits, _U)
        self.entry = np.zeros(1 << bits, np.int32)
        self.n, self.used = 1, 0  # entry 0 has no ids
        self.size = np.zeros(room + 1, np.int32)
        self.at = np.zeros(room + 1, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        slot = self._slot(h)
        there = self.key[slot]
        out = np.where(there == h, self.entry[slot], -1)
        open_ = np.flatnonzero((there != h) & (there != 0))
        while len(open_):
            at = (slot[open_] + 1) & self.mask
            slot[open_] = at
            there = self.key[at]
            same = there == h[open_]
            out[open_[same]] = self.entry[at[same]]
            open_ = open_[~same & (there != 0)]
        return out

    def add(self, h: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Different hashes that are not there yet, with their ids one behind the other; there must be room."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        own = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.size[own] = sizes
        self.at[own] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(h), self.used + len(ids)
        slot = self._slot(h)
        while len(h):
            free = self.key[slot] == 0
            self.key[slot[free]] = h[free]
            won = free & (self.key[slot] == h)
            self.entry[slot[won]] = own[won]
            h, own, slot = h[~won], own[~won], (slot[~won] + 1) & self.mask


class Encoder:
    """encode_flat(texts) gives ids and where each text's begin; texts are bytes, str or None (empty)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.to_str())
        cut = kind.get("pre_tokenizer") or {}
        self.signs = _byte_signs()
        self.line_id = self.tokenizer.token_to_id(self.signs[10])
        self.by_piece = (
            kind.get("normalizer") is None
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
            and kind["model"].get("type") == "BPE"
            and not kind["model"].get("dropout")
            and self.line_id is not None
        )
        # The same model without its pre-tokenizer, for pieces that are cut here; they hold no blanks in byte signs.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # Pieces are joined by a byte that UTF-8 does not have; a line end stands between them as a piece of its own.
        self.to_signs = {b: s for b, s in enumerate(self.signs)} | {0xFF: f" {self.signs[10]} "}
        # Ids that begin with the sign of a space.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith(self.signs[32])]] = True
        self.pieces, self.powers = Pieces(CACHE), _Powers()
        self.byte_class = np.full(256, UNKNOWN, np.uint8)
        for b in range(128):
            self.byte_class[b] = self._class_of(chr(b)) if self.by_piece else OTHER
        self.byte_class[0xFF] = END
        self.char_class = np.full(0x110000, UNKNOWN, np.uint8)

    def _class_of(self, c: str) -> int:
        """Which of a letter, a number and a sign makes one piece with the character; white space does with none."""
        if c == " ":
            return SPACE
        for klass, sign in ((LETTER, "x"), (NUMBER, "5"), (OTHER, "!")):
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(sign + c)) == 1:
                return klass
        return WHITE

    def _classes(self, buf: np.ndarray) -> np.ndarray:
        """Class of each byte's character."""
        out = self.byte_class[buf]
        lead = np.flatnonzero((buf >= 0xC0) & (buf != 0xFF))
        if len(lead):
            first = buf[lead].astype(np.int32)
            tail = [buf[np.minimum(lead + k, len(buf) - 1)].astype(np.int32) & 63 for k in (1, 2, 3)]
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            two = (first & 31) << 6 | tail[0]
            three = (first & 15) << 12 | tail[0] << 6 | tail[1]
            four = (first & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
            point = np.where(size == 2, two, np.where(size == 3, three, four)) & 0x1FFFFF
            klass = self.char_class[np.minimum(point, 0x10FFFF)]
            if (klass == UNKNOWN).any():
                for p in np.unique(point[klass == UNKNOWN]).tolist():
                    self.char_class[p] = WHITE if 0xD800 <= p < 0xE000 or p > 0x10FFFF else self._class_of(chr(p))
                klass = self.char_class[np.minimum(point, 0x10FFFF)]
            for k in range(4):
                own = size > k
                out[np.minimum(lead[own] + k, len(buf) - 1)] = klass[own]
        return out

    def _cut(self, buf: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """Starts of pieces. Texts in buf end with the byte 0xFF, a piece of its own; there is a byte 0xFF in front."""
        white = (klass == SPACE) | (klass == WHITE)
        begin = np.empty(len(buf), bool)
        begin[0] = True
        begin[1:] = klass[1:] != klass[:-1]
        # A space goes with what follows it; of a run of white space only the last character may.
        begin[1:] &= klass[:-1] != SPACE
        begin |= klass == END
        w = np.flatnonzero(white)
        after = w + 1
        inner = white[w - 1]
        last = ~white[after] & (klass[after] != END)
        begin[w] = ~inner | last
        # Short forms behind an apostrophe that no sign and no space goes with.
        a = np.flatnonzero(buf == 39)
        if len(a):
            a = a[(klass[a - 1] != OTHER) & (klass[a - 1] != SPACE)]
            a = a[klass[a + 1] == LETTER]
            x, y = buf[a + 1], buf[a + 2]
            one = (x == 115) | (x == 116) | (x == 109) | (x == 100)
            two = ((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)
            for own, n in ((a[one], 2), (a[two], 3)):
                begin[own + 1] = False
                goes_on = own + n
                begin[goes_on[klass[goes_on] == LETTER]] = True
        return np.flatnonzero(begin)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def _learn(self, raw: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray, white: np.ndarray) -> None:
        """Put pieces and their ids by the library into the table."""
        made: list[np.ndarray] = [np.empty(0, np.uint32)] * len(start)
        # Pieces with a space in front need nothing between them: only their first ids begin with its sign.
        spaced = ~white & (np.frombuffer(raw, np.uint8)[start] == 32)
        for kind, signs in ((spaced, self.to_signs | {0xFF: " "}), (~white & ~spaced, self.to_signs)):
            of_kind = np.flatnonzero(kind)
            for k in range(0, len(of_kind), 1 << 15):
                own = of_kind[k : k + (1 << 15)]
                joined = b"\xff".join([raw[s:e] for s, e in zip(start[own].tolist(), end[own].tolist())]).decode("latin-1").translate(signs)
                ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                if kind is spaced:
                    first = np.flatnonzero(self.begins[ids])
                    last = np.append(first[1:], len(ids))
                else:
                    line = np.flatnonzero(ids == self.line_id)
                    first, last = np.concatenate([[0], line + 1]), np.append(line, len(ids))
                for i, s, e in zip(own.tolist(), first.tolist(), last.tolist(), strict=True):
                    made[i] = ids[s:e]
        for i in np.flatnonzero(white).tolist():
            made[i] = self._whole(raw[start[i] : end[i]])
        self.pieces.add(h, np.fromiter(map(len, made), np.int32, len(made)), np.concatenate(made))

    def _group(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all parts, how many each has, which of them must go to the library with their whole text)."""
        raw = b"\xff" + b"\xff".join(parts) + b"\xff\xff"
        buf = np.frombuffer(raw, np.uint8)
        klass = self._classes(buf)
        odd = np.zeros(len(parts), bool)
        strange = (klass == UNKNOWN) | ((klass == WHITE) & (buf >= 0x80))
        if strange.any() or raw.count(b"\xff") != len(parts) + 2:
            odd[:] = [b"\xff" in p for p in parts]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
            odd[np.searchsorted(np.cumsum(sizes) + 1, np.flatnonzero(strange), "right")] = True
            some = [b"" if o else p for o, p in zip(odd.tolist(), parts)]
            ids, counts, _ = self._group(some)
            return ids, counts, odd
        start = self._cut(buf, klass)
        n = len(buf)
        up, down = self.powers.upto(n + 1)
        total = np.empty(n + 1, _U)
        total[0] = 0
        np.cumsum((buf.astype(_U) + _U(1)) * up[:n], out=total[1:])
        end = np.append(start[1:], n)
        h = (total[end] - total[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(29)
        h |= _U(1)  # zero marks a free slot
        ends = klass[start] == END
        h = h[~ends]
        entry = self.pieces.find(h)
        if (entry < 0).any():
            if self.pieces.n + int((entry < 0).sum()) > self.pieces.room:
                self.pieces = Pieces(max(CACHE, len(h)))
                entry[:] = -1
            fresh = np.flatnonzero(entry < 0)
            new, first = np.unique(h[fresh], return_index=True)
            at = np.flatnonzero(~ends)[fresh[first]]
            s, e = start[at], end[at]
            white = (klass[s] >= SPACE) & (klass[e - 1] >= SPACE)
            self._learn(raw, s, e, new, white)
            entry[fresh] = self.pieces.find(h[fresh])
        sizes = self.pieces.size[entry].astype(np.int64)
        ids = self.pieces.ids[ranges(self.pieces.at[entry], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.flatnonzero(ends) - np.arange(int(ends.sum()))]
        return ids, np.diff(upto)[: len(parts)], odd

    @staticmethod
    def _divide(text: bytes) -> list[bytes]:
        """A long text in parts, cut where a piece begins whatever stands around: at a space between two letters."""
        out, at = [], 0
        while len(text) - at > GROUP:
            found = _SAFE.search(text, at + GROUP // 2)
            if not found:
                break
            out.append(text[at : found.start() + 1])
            at = found.start() + 1
        return [*out, text[at:]]

    def encode_flat(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one behind the other; where each text's begin, and the end)."""
        raw = [t.encode("utf-8", "replace") if isinstance(t, str) else t or b"" for t in texts]
        made: list[np.ndarray] = []
        counts = np.zeros(len(raw), np.int64)
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            ids, n, odd = self._group([p for _, p in held])
            owner = np.array([i for i, _ in held])
            if not odd.any():
                made.append(ids)
                np.add.at(counts, owner, n)
            else:
                strange = set(owner[odd].tolist())
                for (i, _), part in zip(held, np.split(ids, np.cumsum(n)[:-1])):
                    if i not in strange:
                        made.append(part)
                        counts[i] += len(part)
                    elif counts[i] == 0:
                        made.append(self._whole(raw[i]))
                        counts[i] = len(made[-1])
            held, size = [], 0

        for i, t in enumerate(raw):
            if not self.by_piece or any(a in t for a in self.added):
                flush()
                made.append(self._whole(t))
                counts[i] = len(made[-1])
                continue
            long = len(t) > GROUP
            if long or size + len(t) > GROUP:
                flush()
            if long:  # all parts of a text are in one group if the library must see it whole
                for part in self._parts(t):
                    made.append(part)
                    counts[i] += len(part)
                continue
            held.append((i, t))
            size += len(t)
        flush()
        return (np.concatenate(made) if made else np.empty(0, np.uint32)), np.concatenate([[0], np.cumsum(counts)])

    def _parts(self, text: bytes) -> list[np.ndarray]:
        out = []
        for p in self._divide(text):
            ids, _, odd = self._group([p])
            if odd.any():
                return [self._whole(text)]
            out.append(ids)
        return out

    def encode_all(self, texts: list) -> list[bytes]:
        """Ids of each text as '<u4' bytes."""
        ids, at = self.encode_flat(texts)
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * s : 4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


def encoder(path: str | None = None) -> Encoder:
    """The worker's own encoder; the path is one that every node has."""
    path = path or default_vocabulary()
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def groups(texts, most_chars: int = 4_000_000):
    """Index ranges of a batch (a list or an Arrow array) that hold about `most_chars` characters (or bytes) each, so
    that memory does not follow the batch."""
    if isinstance(texts, list):
        sizes = [len(t or "") for t in texts]
    else:
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
