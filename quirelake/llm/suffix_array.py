"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard's text."""

from __future__ import annotations

import numpy as np

from .kernels import U

#: An array with more than this many symbols per distinct one is induced bucket by bucket with numpy.
DENSE = 1000


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of s, whose symbols are in 1..k-1 but for a last 0 that occurs nowhere else."""
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    #: Suffix types: smaller (True) than the next suffix or larger; equal symbols take the next one's type.
    change = np.flatnonzero(s[1:] != s[:-1])
    following = np.searchsorted(change, np.arange(n - 1))
    small = np.zeros(n, dtype=bool)
    inside = following < len(change)
    at = change[following[inside]]
    small[:-1][inside] = s[at] < s[at + 1]
    small[n - 1] = True
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_dense if n > DENSE * k else _induce_sparse
    rough = induce(s, small, lms, k)
    #: Names of leftmost-smaller substrings: equal neighbours in the rough order share one.
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    end = np.zeros(n, dtype=np.int64)
    end[lms] = np.concatenate((lms[1:], [n - 1]))
    differs = _different(s, order, end)
    names = np.zeros(n, dtype=np.int64)
    names[order] = np.concatenate(([0], np.cumsum(differs)))
    reduced = names[lms]
    if reduced.max() + 1 < len(lms):
        order = lms[suffix_array(reduced, int(reduced.max()) + 1)]
    return induce(s, small, order, k)


def _different(s: np.ndarray, order: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each leftmost-smaller substring differs from the one before it in order."""
    a, b = order[:-1], order[1:]
    length = end[b] - b
    out = (end[a] - a) != length
    live, step = np.flatnonzero(~out), 0
    while len(live):
        live = live[step <= length[live]]
        bad = s[a[live] + step] != s[b[live] + step]
        out[live[bad]] = True
        live, step = live[~bad], step + 1
    return out


def _buckets(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(s, minlength=k)
    ends = np.cumsum(size)
    return ends - size, ends


def _induce_dense(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """From the given order of leftmost-smaller positions, all larger suffixes left to right, then all smaller ones back.

    A bucket's entries are final when the scan reaches it, but for those that the bucket adds to itself;
    these come in waves, one for each length of a run of the symbol.
    """
    n = len(s)
    sa = np.full(n, -1, dtype=np.int64)
    start, end = _buckets(s, k)
    head, tail = start.copy(), end.copy()
    first = s[lms]
    counts = np.bincount(first, minlength=k)
    by = np.argsort(first, kind="stable")
    inside = np.arange(len(lms)) - np.repeat(np.cumsum(counts) - counts, counts)
    sa[(end - counts)[first[by]] + inside] = lms[by]

    def deal(found: np.ndarray, forward: bool, c: int) -> np.ndarray:
        """Put predecessors of the found suffixes at the heads (or tails) of their buckets; returns those of bucket c."""
        p = found[found > 0] - 1
        p = p[small[p] != forward]
        if not len(p):
            return p
        sym = s[p]
        by = np.argsort(sym, kind="stable")
        p, sym = p[by], sym[by]
        cut = np.flatnonzero(np.concatenate(([True], sym[1:] != sym[:-1])))
        size = np.diff(np.concatenate((cut, [len(p)])))
        inside = np.arange(len(p)) - np.repeat(cut, size)
        own = sym[cut]
        if forward:
            sa[np.repeat(head[own], size) + inside] = p
            head[own] += size
        else:
            sa[np.repeat(tail[own], size) - 1 - inside] = p
            tail[own] -= size
        return p[sym == c]

    used = np.flatnonzero(end > start)
    for c in used.tolist():
        done, wave = start[c], None
        while head[c] > done:  # larger suffixes that are known
            wave = sa[done : head[c]].copy()
            done = head[c]
            deal(wave, True, c)
        at = sa[end[c] - counts[c] : end[c]]
        deal(at[at >= 0], True, c)
    for c in used.tolist():  # the smaller ones are sorted anew from the larger ones
        sa[head[c] : end[c]] = -1
    sa[0] = n - 1
    for c in used[::-1].tolist():
        done = end[c]
        while tail[c] < done:
            wave = sa[tail[c] : done][::-1].copy()
            done = tail[c]
            deal(wave, False, c)
        deal(sa[start[c] : head[c]][::-1], False, c)
    return sa


def _induce_sparse(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """As _induce_dense, suffix by suffix, for an alphabet nearly as large as the text."""
    n = len(s)
    start, end = _buckets(s, k)
    #: The symbol before each suffix, if that one is larger (smaller); the last entry stands for a free place, -1.
    larger = np.full(n + 1, -1, dtype=np.int64)
    larger[1:n] = np.where(small[:-1], -1, s[:-1])
    smaller = np.full(n + 1, -1, dtype=np.int64)
    smaller[1:n] = np.where(small[:-1], s[:-1], -1)
    first = s[lms]
    counts = np.bincount(first, minlength=k)
    by = np.argsort(first, kind="stable")
    rough = np.full(n, -1, dtype=np.int64)
    rough[(end - counts)[first[by]] + np.arange(len(lms)) - np.repeat(np.cumsum(counts) - counts, counts)] = lms[by]
    sa, head, before = rough.tolist(), start.tolist(), larger.tolist()
    for p in sa:  # reads places that it has just filled
        c = before[p]
        if c >= 0:
            at = head[c]
            sa[at] = p - 1
            head[c] = at + 1
    tail, before = end.tolist(), smaller.tolist()
    for p in reversed(sa):
        c = before[p]
        if c >= 0:
            tail[c] = at = tail[c] - 1
            sa[at] = p - 1
    sa[0] = n - 1
    return np.array(sa, dtype=np.int64)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the common prefix of its suffix and the one before it in sa (0 for the first).

    Where the symbols before the two are equal the value is one less than that of the position before,
    so only the other (irreducible) positions are compared, eight symbols at a time.
    """
    n = len(s)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    position = np.arange(n)
    whole = phi >= 0
    reducible = np.zeros(n, dtype=bool)
    inner = whole & (position > 0) & (phi > 0)
    reducible[inner] = s[position[inner] - 1] == s[phi[inner] - 1]
    reducible[1:] &= whole[:-1]
    live = np.flatnonzero(whole & ~reducible)
    padded = np.concatenate((s.astype(np.int64), np.zeros(8, dtype=np.int64)))
    narrow = s.max() < 256
    value = np.zeros(n, dtype=np.int64)
    if narrow:
        words = np.zeros(n, dtype=U)
        for k in range(8):
            words |= padded[k : n + k].astype(U) << U(8 * k)
    step = 0
    while len(live):
        a, b = live + step, phi[live] + step
        live, a, b = (x[(a < n) & (b < n)] for x in (live, a, b))
        if narrow:
            diff = words[a] ^ words[b]
            same = diff == 0
            value[live] = step + _trailing_bytes(diff)
            live, step = live[same], step + 8
        else:
            same = s[a] == s[b]
            value[live] = step + same
            live, step = live[same], step + 1
    value = np.where(reducible, -1, value + position)
    return np.where(whole, np.maximum.accumulate(value) - position, 0)


def _trailing_bytes(x: np.ndarray) -> np.ndarray:
    """Equal low bytes: 8 where x is 0."""
    low = x & (~x + U(1))
    return np.where(x == 0, 8, np.bitwise_count(low - U(1)) // 8).astype(np.int64)
