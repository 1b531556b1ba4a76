"""Burrows-Wheeler transform and longest common prefixes of a collection of byte strings, built column by column.

Round j inserts, for every string that is long enough, its suffix of length j: its place follows from the place of the suffix one
shorter and the symbol before that (a rank over the transform so far), and its common prefixes with its new neighbours are
one more than a minimum over the old ones between two occurrences of the symbol. A round reads the transform, the common
prefixes and the suffixes' owners once from front to back, in blocks, from files, and writes their successors the same way; what
stays in memory is one block, one entry a string and one a symbol.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

BLOCK = 1 << 22
_KINDS = {"bwt": "u1", "lcp": "u1", "sid": "u4", "len": "u1"}


class _Files:
    """The columns of one round, each in a file."""

    def __init__(self, folder: str, tag: str):
        self.paths = {k: os.path.join(folder, f"{k}-{tag}") for k in _KINDS}

    def write(self, columns: dict[str, np.ndarray], mode: str = "ab") -> None:
        for k, path in self.paths.items():
            with open(path, mode) as f:
                columns[k].astype(_KINDS[k], copy=False).tofile(f)

    def read(self, kind: str, at: int, n: int) -> np.ndarray:
        size = np.dtype(_KINDS[kind]).itemsize
        return np.fromfile(self.paths[kind], _KINDS[kind], count=n, offset=at * size)

    def clear(self) -> None:
        for path in self.paths.values():
            if os.path.exists(path):
                os.remove(path)


def _scan(files: _Files, n: int, m: int, at: np.ndarray, counts: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """One pass over the columns: new places of what the suffixes at ``at`` lead to, their common prefixes with what stands before
    them, and the places and common prefixes of old entries that come to stand behind a new one."""
    symbols = len(counts)
    base = m + np.concatenate([[0, 0], np.cumsum(counts[1:-1])]).astype("i8")
    passed = np.zeros(symbols, "i8")
    lowest = np.full(symbols, 255, "i8")
    after_new = np.zeros(symbols, bool)
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for s in range(0, n, block):
        b, l = files.read("bwt", s, block), files.read("lcp", s, block)
        size = len(b)
        new = np.zeros(size, bool)
        lo, hi = np.searchsorted(at, (s, s + size))
        new[at[lo:hi] - s] = True
        order = np.argsort(b, kind="stable")
        sb, f = b[order], new[order]
        first = np.searchsorted(sb, np.arange(symbols + 1))
        has_before = np.empty(size, bool)
        has_before[1:] = sb[1:] == sb[:-1]
        has_before[:1] = False
        behind = np.zeros(size, bool)
        behind[1:] = has_before[1:] & f[:-1]
        heads = first[:-1][first[:-1] < first[1:]]
        behind[heads] = after_new[sb[heads]]
        take = np.flatnonzero((f | behind) & (sb > 0))
        p, c = order[take], sb[take].astype("i8")
        before = has_before[take]
        # From the symbol's last place, or the block's start.
        start = np.where(before, order[np.maximum(take - 1, 0)] + 1, 0)
        low = np.zeros(len(take), "i8")
        if len(take):
            low = np.minimum.reduceat(np.append(l, 255), np.stack([start, p + 1], 1).ravel())[::2].astype("i8")
        low = np.where(before, low, np.minimum(low, lowest[c]))
        low = np.where(before | (passed[c] > 0), low + 1, 0)
        place = base[c] + passed[c] + take - first[c]
        is_new = f[take]
        out[0].append(place[is_new]), out[1].append(low[is_new]), out[2].append(p[is_new] + s)
        out[3].append(place[~is_new]), out[4].append(low[~is_new])
        here = np.flatnonzero(first[:-1] < first[1:])
        lowest = np.minimum(lowest, l.min() if size else 255)
        last = order[first[here + 1] - 1]
        for k, q in zip(here.tolist(), last.tolist(), strict=True):
            lowest[k] = l[q + 1 :].min() if q + 1 < size else 255
        after_new[here] = new[last]
        passed += np.diff(first)
    return tuple(np.concatenate(x) if x else np.zeros(0, "i8") for x in out)


def collection_lcp(data: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(string, length of its suffix, common prefix with the suffix before)`` of all suffixes in sorted order.

    ``data``: the strings' bytes one after another, each of at most 254 bytes.
    """
    m = len(lengths)
    if not m:
        return np.zeros(0, "u4"), np.zeros(0, "u1"), np.zeros(0, "u1")
    ends = np.cumsum(lengths)
    # Symbols 1, 2, ... in order of the bytes that occur; 0 ends a string.
    seen = np.flatnonzero(np.bincount(data, minlength=256))
    code = np.zeros(256, "u1")
    code[seen] = np.arange(1, len(seen) + 1)
    text = code[data]
    with tempfile.TemporaryDirectory() as folder:
        now, new = _Files(folder, "a"), _Files(folder, "b")
        ids = np.arange(m)
        preceding = np.where(lengths > 0, text[np.maximum(ends - 1, 0)] if len(text) else 0, 0).astype("u1")
        now.write({"bwt": preceding, "lcp": np.zeros(m), "sid": ids, "len": np.zeros(m)}, "wb")
        n, at, who = m, ids, ids
        counts = np.bincount(preceding, minlength=len(seen) + 1)
        for j in range(1, int(lengths.max(initial=0)) + 1):
            place, low, came, behind, behind_low = _scan(now, n, m, at, counts, block)
            owner = who[np.searchsorted(at, came)]
            order = np.argsort(place)
            place, low, owner = place[order], low[order], owner[order]
            preceding = np.where(lengths[owner] > j, text[np.maximum(ends[owner] - j - 1, 0)], 0).astype("u1")
            fresh = {"bwt": preceding, "lcp": low.astype("u1"), "sid": owner.astype("u4"), "len": np.full(len(owner), j, "u1")}
            gap = place - np.arange(len(place))  # old entries before each new one
            order = np.argsort(behind)
            behind, behind_low = behind[order], behind_low[order].astype("u1")
            new.clear()
            for s in range(0, max(n, 1), block):
                e = min(n, s + block)
                lo, hi = np.searchsorted(gap, s, "left" if s else "left"), np.searchsorted(gap, e, "right" if e == n else "left")
                cols = {k: np.insert(now.read(k, s, e - s), gap[lo:hi] - s, fresh[k][lo:hi]) for k in _KINDS}
                u, v = np.searchsorted(behind, (s + lo, e + hi))
                cols["lcp"][behind[u:v] - s - lo] = behind_low[u:v]
                new.write(cols)
            counts = counts + np.bincount(preceding, minlength=len(counts))
            n, at, who, now, new = n + len(place), place, owner, new, now
        return now.read("sid", 0, n), now.read("len", 0, n), now.read("lcp", 0, n)
