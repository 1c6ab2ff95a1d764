"""Brute-force versions of the corpus operators, written plainly for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


def shingle_list(ws: list[str], n: int) -> list[tuple[str, ...]]:
    if not ws:
        return []
    n = min(n, len(ws))
    return [tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)]


def substring_dedup(rows: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple]:
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256); ids are distinct."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\x01" * length
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[doc_id] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def components(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    up = {i: i for i in ids}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_dedup(rows: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id); every pair that shares a shingle is compared."""
    sets = {i: frozenset(shingle_list(words(t), n)) for i, t in rows}
    post = defaultdict(set)
    by_set = defaultdict(list)
    for i, s in sets.items():
        if s:
            by_set[s].append(i)
    reps = {min(v): k for k, v in by_set.items()}
    links = [(min(v), i) for v in by_set.values() for i in v]
    for i, s in reps.items():
        for x in s:
            post[x].add(i)
    for i, s in reps.items():
        met = Counter(j for x in s for j in post[x] if j > i)
        links += [(i, j) for j, both in met.items() if 100 * both >= percent * (len(s) + len(reps[j]) - both)]
    comp = components(list(sets), links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def decontaminate(rows: list[tuple[int, str | None]], items: list[tuple[int, str | None]], n: int = 5, least: float = 0.8) -> set[tuple[int, int]]:
    """(doc_id, item_id) where a window as long as the item has weighted-shingle similarity of least or more."""
    out = set()
    for item_id, text in items:
        ws = words(text)
        if not ws:
            continue
        want = Counter(shingle_list(ws, n))
        for doc_id, body in rows:
            own = words(body)
            if not own:
                continue
            width = min(len(ws), len(own))
            if width < min(n, len(ws)):
                continue
            listed = [x in want for x in shingle_list(own, min(n, len(ws)))]
            if not any(listed):
                continue
            for s in range(len(own) - width + 1):
                have = Counter(shingle_list(own[s : s + width], min(n, len(ws))))
                both = (have & want).total()
                if both and both / (have.total() + want.total() - both) >= least:
                    out.add((doc_id, item_id))
                    break
    return out


def exact_dedup(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """doc_id: (keep_id, group_size, kept, sha)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((i, len(t or "")))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0]))[0]
        for i, _ in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def minimax(sizes: list[int], n: int) -> int:
    """Smallest capacity for which the ordered sizes fit n contiguous parts."""

    def parts(cap: int) -> int:
        k, room = 1, cap
        for s in sizes:
            if s > room:
                k, room = k + 1, cap
            room -= s
        return k

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if parts(mid) <= n else (mid + 1, high)
    return low


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1
