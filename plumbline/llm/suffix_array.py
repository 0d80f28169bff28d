"""Suffix arrays by induced sorting, in numpy, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their successor. One induction sorts the leftmost-S
substrings, they are named, the string of names is sorted by the same procedure until all names differ, and the order
of leftmost-S suffixes then induces the whole array.

An induction scans buckets in order; each element it meets puts its predecessor at the next free place of that one's
bucket. Neighbouring buckets of which none induces into another are scanned at once: with few symbols that is one
bucket at a time, with many names it is about as many at once as the square root of what lies ahead, so every level
of the recursion is a number of array operations that grows with the root of its buckets, and its work is linear.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; t ends with a unique smallest symbol."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    up = t[differs + 1] > t[differs]
    out = np.empty(n, bool)
    out[-1] = True
    # Between two changes all symbols are equal and all suffixes of the kind of the last.
    out[:-1] = np.repeat(up, np.diff(np.concatenate([[-1], differs])))
    return out


def _windows(reach: np.ndarray):
    """Ranges of buckets, in order, of which none reaches into its own range; a bucket that reaches itself is alone."""
    k, c, size = len(reach), 0, 16
    while c < k:
        size = min(size, k - c)
        least = np.minimum.accumulate(reach[c : c + size])
        bad = least <= np.arange(c, c + size)
        w = int(bad.argmax()) if bad.any() else size
        # A bucket that another of the range reaches ends it; so does one that reaches itself, unless it comes first.
        if w < size:
            w = max(w, 1)
        if w == size and c + size < k:
            size *= 4
            if size <= 1 << 16:
                continue
        yield c, c + w
        c, size = c + w, max(16, 2 * w)


def _pass(t: np.ndarray, k: int, target: np.ndarray, seeds: np.ndarray, given: int | None = None) -> np.ndarray:
    """One induction: the order of all targets and seeds. A target goes into its bucket when its successor is met;
    seeds are in order and stand behind the targets of their bucket. `given` is a target that no other induces."""
    size_t = np.bincount(t[target], minlength=k)
    size_s = np.bincount(t[seeds], minlength=k)
    edge = np.zeros(k + 1, np.int64)
    np.cumsum(size_t + size_s, out=edge[1:])
    head = edge[:-1].copy()
    out = np.empty(int(edge[-1]), np.int32)
    at = np.repeat(head + size_t - (np.cumsum(size_s) - size_s), size_s)
    at += np.arange(len(seeds))
    out[at] = seeds
    del at
    if given is not None:
        out[head[t[given]]] = given
        head[t[given]] += 1
    # From bucket of the successor to bucket of the target.
    own = np.flatnonzero(target[:-1])
    into, source = t[own].astype(np.int64), t[own + 1]
    reach = np.full(k, k, np.int64)
    self_ = np.zeros(k, bool)
    self_[into[into == source]] = True
    np.minimum.at(reach, source, into) if k > 4096 else _least(reach, source, into)
    reach[self_] = np.flatnonzero(self_)
    del own, into, source
    free = edge[:-1] + size_t
    count = np.arange(len(t), dtype=np.int32)

    def induce(a: int, b: int) -> None:
        before = out[a:b] - 1
        before = before[before >= 0]
        before = before[target[before]]
        if not len(before):
            return
        s = t[before]
        order = s.argsort(kind="stable")
        s = s[order]
        first = np.empty(len(s), bool)
        first[0] = True
        np.not_equal(s[1:], s[:-1], out=first[1:])
        start = first.nonzero()[0]
        n = np.empty(len(start), np.int64)
        n[-1] = len(s) - start[-1]
        np.subtract(start[1:], start[:-1], out=n[:-1])
        which = s[start]
        at = head[which]
        place = (at - start).repeat(n)
        place += count[: len(s)]
        out[place] = before[order]
        head[which] = at + n

    for c, d in _windows(reach):
        if d == c + 1 and self_[c]:
            # What the bucket's own members induce into it is met in turn.
            a = int(edge[c])
            while a < head[c]:
                b = int(head[c])
                induce(a, b)
                a = b
            induce(int(free[c]), int(edge[d]))
        else:
            induce(int(edge[c]), int(edge[d]))
    return out


def _least(reach: np.ndarray, source: np.ndarray, into: np.ndarray) -> None:
    """reach[s] = least of `into` over s, for few different symbols."""
    k = len(reach)
    met = np.flatnonzero(np.bincount(source.astype(np.int64) * k + into, minlength=k * k).reshape(k, k)) if k <= 512 else None
    if met is None:
        np.minimum.at(reach, source, into)
        return
    s, i = met // k, met % k
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
    reach[s[first]] = i[first]


def _induce(t: np.ndarray, k: int, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Suffix order induced from leftmost-S positions, given in the order they have inside their buckets."""
    got = _pass(t, k, ~smaller, seeds)
    large = got[~smaller[got]][::-1]
    del got
    # The same scan from the other end, with the symbols mirrored.
    mirrored = (k - 1 - t.astype(np.int32)).astype(t.dtype)
    return _pass(mirrored, k, smaller, large, len(t) - 1)[::-1]


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """A name for each leftmost-S substring, equal for equal ones, in their order."""
    which = np.empty(len(t), np.int32)
    which[lms] = np.arange(len(lms), dtype=np.int32)
    size = np.diff(lms, append=len(t) - 1) + 1
    at = which[order]
    del which
    long = size[at]
    live = np.flatnonzero(long[:-1] == long[1:]).astype(np.int32)
    differs = np.ones(len(order) - 1, bool)
    d = 0
    while len(live):
        end = long[live] == d
        if end.any():
            differs[live[end]] = False
            live = live[~end]
        live = live[t[order[live] + d] == t[order[live + 1] + d]]
        d += 1
    name = np.empty(len(lms), np.int32)
    name[at] = np.concatenate([[0], np.cumsum(differs)])
    return name, int(differs.sum()) + 1


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of t, whose symbols are below k and whose last symbol is its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    t = t.astype(np.uint16) if k <= 65536 else t
    smaller = _types(t)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    order = _induce(t, k, smaller, lms[np.argsort(t[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    name, m = _names(t, lms, order)
    if m < len(lms):
        order = lms[suffix_array(name, m)]
    return _induce(t, k, smaller, order[np.argsort(t[order], kind="stable")])


def common_prefixes(t: np.ndarray, sa: np.ndarray, stop: int) -> np.ndarray:
    """PLCP: for each position, the common prefix with its predecessor in the suffix array, ending at `stop` symbols.

    Only positions whose preceding symbols differ are compared; every other value is one less than its left neighbour's."""
    n = len(t)
    phi = np.empty(n, np.int32)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    left = np.zeros(n, bool)
    i = np.flatnonzero(phi > 0)
    i = i[i > 0]
    before = t[i - 1]
    left[i] = (before == t[phi[i] - 1]) & (before != stop)
    del i, before
    lcp = np.zeros(n, np.int32)
    live = np.flatnonzero(~left & (phi >= 0)).astype(np.int32)
    a, b, d = live, phi[live], 0
    while len(live):
        x = t[a]
        eq = (x == t[b]) & (x != stop)
        lcp[live[~eq]] = d
        live, a, b = live[eq], a[eq] + 1, b[eq] + 1
        d += 1
    here = np.arange(n, dtype=np.int32)
    origin = np.maximum.accumulate(np.where(left, 0, here))
    out = lcp[origin] - (here - origin)
    out[phi < 0] = 0
    return np.maximum(out, 0)
