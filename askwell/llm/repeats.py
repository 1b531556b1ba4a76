"""Removal of repeated passages: every byte covered by a ``WINDOW``-byte string that also starts in a document with a smaller id.

The strings are compared with one another by the column-wise Burrows-Wheeler and common-prefix construction of ``collection.py``:
of two neighbours in sorted order that share ``WINDOW`` bytes, the one from the larger id is a repeat. So that this takes few
rounds and can be spread out, a collection consists of short pieces that meet because of what they contain:

* Each window of ``WINDOW`` bytes has an anchor, its ``K``-byte string of the smallest hash (the leftmost of several). Windows
  in a row with the same anchor are a piece of at most ``2 * WINDOW - K`` bytes. Equal windows have equal anchors, so a repeat
  can only be found among pieces of one anchor hash, and pieces are dealt out by it.
* Pieces' hashes go first, packed into arrays, once for equal pieces of one slice. Anchors seen in one document only are done with.
  Equal pieces (by 88 bits of hashes of anchor and piece) are one string, kept with its smallest id: windows of the other, later ones
  are repeats. Where an anchor has different pieces, their bytes are fetched, cut to what can be equal to another document's (by hashes
  of some 48 bytes round the anchor), and the collection is built of the different ones.
* An anchor with more than ``WIDE`` different pieces is dealt out again by single windows, so no task gets the bytes of all. Those that some
  part has ``CROWD`` of, and the table over ``WIDE``, are known before: their pieces' hashes are dealt by the piece, not by the anchor, so no
  task gets all of these either. (Of an anchor that is rarer than ``CROWD`` in every part, all hashes meet in one task.)

Copies of a whole text (their documents share a SHA-256) are taken out before; all but the smallest id lose every byte.

The texts lie once, compressed, in slices of some ``SLICE_BYTES`` in a table bucketed by part, which the three passes over them read
without a shuffle. A part has at most ``PART_BYTES[1]`` of text, however large the table, and a pass opens one slice
at a time and hashes it in blocks; so what a task holds is bounded by that and by the longest text.

Defined results: a null text is an empty one; texts shorter than a window are kept; rows of one id are never repeats of each other; a
null id counts as larger than all; an empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.collection import collection_lcp
from askwell.llm.common import map_batches, new_path, remove_path, removed, slices, table, written

WINDOW = 50
K = 16
REACH = WINDOW - K
#: Bytes of text in a slice, in a part (before copies are taken out; from the first to the second number, a ``PARTS``-th of the table between them), and
#: hashed at once. Every part writes to every bucket, and there are as many of these, so blobs go with the square of the parts' number.
SLICE_BYTES, PART_BYTES, BLOCK = 1 << 20, (1 << 22, 1 << 24), 1 << 16
PARTS = 256
#: Bytes of pieces that a part sends to the buckets at once, and that a bucket compares at once, but for anchors with more.
SENT_BYTES, COMPARED_BYTES = 1 << 24, 1 << 23
WIDE = 20_000
#: Different pieces of an anchor in one part that make it a candidate for being known as wide, and most anchors that are known.
CROWD, KNOWN = 32, 1 << 16
#: Strings of one collection, but for anchors with more.
COLLECTION = 8_000
#: Ranges of windows round an anchor that are tested for being shared.
RANGES = 12

_BASE = 0x9E3779B97F4A7C15
_LONGEST = BLOCK + 2 * WINDOW + REACH + 2
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(_LONGEST, _BASE, "u8")), dtype="u8")
_BACK = np.cumprod(np.append(np.uint64(1), np.full(_LONGEST, pow(_BASE, -1, 1 << 64), "u8")), dtype="u8")
#: The low bits of a window's key hold the place of its anchor in the block.
_PLACE = np.uint64((1 << (2 * BLOCK).bit_length()) - 1)
_PLACES = np.arange(_LONGEST, dtype="u8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... bytes, each times a power of the base; ``(s[b] - s[a]) * _BACK[a]`` is a hash of bytes a to b."""
    out = np.zeros(len(data) + 1, "u8")
    part = data.astype("u8")
    part += np.uint64(1)
    part *= _POWERS[: len(data)]
    np.cumsum(part, out=out[1:])
    return out


def _hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each short string of ``data``, as ``_sums`` has it; the starts ascend."""
    out = np.zeros(len(start), "u8")
    for lo in range(0, len(data), BLOCK):
        a, b = np.searchsorted(start, (lo, lo + BLOCK))
        if a < b:
            s, x, n = _sums(data[lo : lo + BLOCK + 2 * WINDOW]), start[a:b] - lo, size[a:b]
            out[a:b] = (s[x + n] - s[x]) * _BACK[x]
    return _mix(out)


class Pieces:
    """The pieces of a slice of documents in order: where each starts, its number of windows, its document, anchor hash, own hash, and the
    anchor's place in it."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        ends, n = np.cumsum(lengths), len(data)
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for begin in range(0, n, BLOCK):
            stop = min(n, begin + BLOCK)
            # One window before, to see whether a piece starts at ``begin``; as many bytes behind as the last piece may reach.
            lo, hi = max(0, begin - 1), min(n, stop + REACH + WINDOW)
            if hi - lo < WINDOW:
                continue
            sums = _sums(data[lo:hi])
            h = sums[K:] - sums[:-K]
            h *= _BACK[: len(h)]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            low = h & ~_PLACE
            low |= _PLACES[: len(h)]
            w = 1
            while 2 * w <= REACH + 1:
                low = np.minimum(low[:-w], low[w:])
                w *= 2
            if w < REACH + 1:
                low = np.minimum(low[: w - REACH - 1], low[REACH + 1 - w :])
            at = low & _PLACE
            a, b = np.searchsorted(ends, (lo, hi), "right")
            for end in ends[a:b].tolist():  # no window crosses a document's end
                at[max(0, end - WINDOW + 1 - lo) : end - lo] = _PLACE
            edge = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
            x, size, p = edge[:-1], np.diff(edge), at[edge[:-1]]
            own = (p != _PLACE) & (x >= begin - lo) & (x < stop - lo)
            x, size, p = x[own], size[own], p[own].astype("i8")
            hashes = _mix((sums[x + size + WINDOW - 1] - sums[x]) * _BACK[x] + size.astype("u8"))
            for k, v in enumerate((x + lo, size, p - x, _mix(h[p]), hashes)):
                out[k].append(v)
        kinds = ("i8", "i8", "i8", "u8", "u8")
        self.start, self.windows, self.place, self.anchor, self.own = (np.concatenate([np.zeros(0, k), *o]).astype(k, copy=False) for o, k in zip(out, kinds, strict=True))
        self.doc = np.searchsorted(ends, self.start, "right")

    def first_equal(self) -> np.ndarray:
        """For each piece the first one of the slice that is equal to it."""
        n = len(self.own)
        order = np.argsort(self.own)
        o = self.own[order]
        new = np.append(True, o[1:] != o[:-1])[:n]
        out = np.empty(n, "i8")
        if n:
            out[order] = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
        return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; each is preceded by its kind and length."""
    head = b"".join(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(bytes([len(arrays)]) + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 1 + 12 * raw[0], []
    for k in range(raw[0]):
        kind, n = raw[1 + 12 * k : 5 + 12 * k].decode().strip(), int.from_bytes(raw[5 + 12 * k : 13 + 12 * k], "little")
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _join(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    """The low n bytes of each 64-bit number, byte after byte."""
    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :n]).ravel()


def _from_low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(x) // n, 8), "u1")
    out[:, :n] = x.reshape(-1, n)
    return out.view("<u8").ravel()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = [*zip(*rows, strict=True)] or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


LATE = 2**63 - 1  # a null id
NOWHERE = 255  # the place of no anchor: a single window
_SHA, _SIZE = "__sha", "__n_bytes"


class Slice:
    """An opened slice: its texts in ascending order of ids, and their pieces, numbered from ``base`` within the part."""

    def __init__(self, row: dict, base: int):
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["z"]), "u1")
        self.lengths, self.ids = _unpack(row["lengths"])[0].astype("i8"), _unpack(row["ids"])[0]
        self.shas, self.base = row.get("shas"), base
        self.pieces = Pieces(self.data, self.lengths)
        self.id = self.ids[self.pieces.doc]

    @property
    def end(self) -> int:
        return self.base + len(self.pieces.start)

    def own(self, ordinals: np.ndarray) -> tuple[np.ndarray, slice]:
        """Those of the part's sorted ordinals that are the slice's, counted from its first piece, and where they are."""
        a, b = np.searchsorted(ordinals, (self.base, self.end))
        return ordinals[a:b] - self.base, slice(int(a), int(b))


def _opened(rows: pa.Table) -> Iterator[Slice]:
    """The slices of a part, one at a time."""
    base = 0
    for at in np.argsort(rows["number"].to_numpy()).tolist():
        s = Slice(rows.slice(at, 1).to_pylist()[0], base)
        base = s.end
        yield s


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _dealt(hashes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets and who goes there, in order."""
    to = (hashes >> np.uint64(40)).astype("i8") % n
    by = np.argsort(to.astype("u2") if n <= 1 << 16 else to, kind="stable")
    to = to[by]
    cuts = np.flatnonzero(np.diff(to, prepend=-1)).tolist() + [len(to)]
    for s, e in zip(cuts, cuts[1:], strict=False):
        yield int(to[s]), by[s:e]


def crowded(slices_: list[Pieces], least: int) -> list[dict]:
    """``anchor, n`` of the anchors with ``least`` or more different pieces in some slices."""
    anchors = np.concatenate([np.zeros(0, "u8"), *(p.anchor[np.unique(p.first_equal())] for p in slices_)])
    anchor, n = np.unique(anchors, return_counts=True)
    often = n >= least
    return [{"anchor": a, "n": k} for a, k in zip(anchor[often].view("i8").tolist(), n[often].tolist(), strict=True)]


def send_hashes(opened: Iterator[Slice], part: int, n: int, wide: np.ndarray) -> list[tuple]:
    """``(bucket, part, blob)``: every different piece of each slice once, with its smallest id; those of ``wide`` anchors by the piece, and marked."""
    got = []
    for s in opened:
        first = np.unique(s.pieces.first_equal())
        got.append([s.pieces.anchor[first], s.pieces.own[first], s.id[first], (first + s.base).astype("u4")])
    if not got:
        return []
    anchor, own, ids, ordinal = _join(got)
    known = np.isin(anchor, wide)
    rows = []
    for own_bucket in (False, True):
        at = np.flatnonzero(known == own_bucket)
        mark = [np.ones(1, "u1")] * own_bucket
        rows += [(k, part, _pack(_low_bytes(anchor[at[x]], 5), _low_bytes(own[at[x]], 6), ids[at[x]], ordinal[at[x]], *mark)) for k, x in (_dealt((own if own_bucket else anchor)[at], n) if len(at) else ())]
    return rows


def compare_hashes(blobs: list[tuple[int, bytes]], wide_from: int) -> list[tuple]:
    """``(part, kind, blob)`` of pieces: kind 0, all windows are repeats; 1, its bytes are asked for; 2, by single windows."""
    got = [(_from_low_bytes(x[0], 5), _from_low_bytes(x[1], 6), x[2], x[3], np.full(len(x[2]), p, "i4"), np.full(len(x[2]), len(x) > 4)) for p, x in ((p, _unpack(z)) for p, z in blobs)]
    a, o, d, ordinal, part, known = _join(got)
    key = a << np.uint64(24) | o >> np.uint64(24)
    order = np.argsort(key)
    if ((key[order][1:] == key[order][:-1]) & (o[order][1:] != o[order][:-1])).any():  # different pieces that share these 64 bits
        order = np.lexsort((o, a))
    a, o, d, ordinal, part, known = (x[order] for x in (a, o, d, ordinal, part, known))
    group = np.append(True, a[1:] != a[:-1])
    piece = group | np.append(True, o[1:] != o[:-1])
    at, which = np.flatnonzero(group), np.cumsum(group) - 1
    shared = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
    kinds = np.add.reduceat(piece.astype("i8"), at)
    full = d > np.minimum.reduceat(d, np.flatnonzero(piece))[np.cumsum(piece) - 1]
    kind = np.where(full, 0, np.where(known | (shared & (kinds > wide_from))[which], 2, np.where((shared & (kinds > 1))[which], 1, 3)))
    keep = np.flatnonzero(kind < 3)
    code = part[keep].astype("i8") * 4 + kind[keep]
    by = np.argsort(code, kind="stable")
    keep, code = keep[by], code[by]
    cuts = np.append(np.flatnonzero(np.diff(code, prepend=-9)), len(code)).tolist()
    return [(int(code[s] >> 2), int(code[s] & 3), _pack(np.sort(ordinal[keep[s:e]]))) for s, e in zip(cuts, cuts[1:], strict=False)]


def send_pieces(opened: Iterator[Slice], part: int, asked: dict[int, np.ndarray], n: int, most: int = SENT_BYTES) -> list[tuple]:
    """``(bucket, part, blob)``: the bytes of the asked pieces, or of their windows; slices go together up to ``most`` bytes."""
    rows: list[tuple] = []
    held: list[list[np.ndarray]] = []

    def send() -> None:
        anchor, ids, ordinal, shift, size, place, data = _join(held)
        start = np.cumsum(size) - size
        for b, x in _dealt(anchor, n):
            blob = _pack(_low_bytes(anchor[x], 5), ids[x], ordinal[x], shift[x].astype("u1"), size[x].astype("u1"), place[x].astype("u1"), data[_ranges(start[x], size[x])])
            rows.append((b, part, blob))
        held.clear()

    for s in opened:
        p = s.pieces
        k, again = s.own(asked[1])[0], s.own(asked[2])[0]
        start, size, anchor, place = p.start[k], p.windows[k] + WINDOW - 1, p.anchor[k], p.place[k]
        off = np.arange(p.windows[again].sum()) - np.repeat(np.cumsum(p.windows[again]) - p.windows[again], p.windows[again])
        again = np.repeat(again, p.windows[again])
        if len(again):
            at, wide = p.start[again] + off, np.full(len(again), WINDOW)
            start, size, place = np.append(start, at), np.append(size, wide), np.append(place, np.full(len(at), NOWHERE))
            anchor = np.append(anchor, _hashed(s.data, at, wide))
        ordinal, shift = np.append(k, again), np.append(np.zeros(len(k), "i8"), off)
        held.append([anchor, s.id[ordinal], (ordinal + s.base).astype("u4"), shift, size, place, s.data[_ranges(start, size)]])
        if sum(len(h[-1]) for h in held) >= most:
            send()
    if held:
        send()
    return rows


def repeated_windows(data: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bits of each string: which of its windows also start in a string of a smaller id."""
    string, length, lcp = collection_lcp(data, size)
    out = np.zeros(len(size), "u8")
    if not len(string):
        return out
    begin = lcp < WINDOW  # a run of suffixes that share their first window
    at = np.flatnonzero(begin)
    d = np.where(length >= WINDOW, doc[string], LATE)
    least = np.minimum.reduceat(d, at)[np.cumsum(begin) - 1]
    bad = np.flatnonzero((length >= WINDOW) & (d > least))
    off = size[string[bad]] - length[bad]
    np.bitwise_or.at(out, string[bad], np.uint64(1) << off.astype("u8"))
    return out


def worth_comparing(data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, anchor: np.ndarray, doc: np.ndarray, ranges: int = RANGES) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the first and last of its windows that can be equal to one of another document; the first is larger where none can.

    A window begins from 0 to ``WINDOW - K`` bytes before its anchor. Windows of one of some ranges of that have the bytes round
    the anchor in common, so a piece is only of interest in the ranges where another document has these bytes too.
    """
    n = len(size)
    first, last = np.full(n, 255), np.full(n, -1)
    windows = size - WINDOW + 1
    edges = np.linspace(0, REACH + 1, ranges + 1).astype("i8")
    for x1, x2 in zip(edges[:-1].tolist(), (edges[1:] - 1).tolist(), strict=True):
        # Windows of the piece in the range: they begin at place - x2 to place - x1.
        lo, hi = np.maximum(place - x2, 0), np.minimum(place - x1, windows - 1)
        x = np.flatnonzero((lo <= hi) & (place != NOWHERE))
        if not len(x):
            continue
        key = _hashed(data, begin[x] + place[x] - x1, np.full(len(x), x1 - x2 + WINDOW)) ^ anchor[x] * np.uint64(_BASE)
        order = np.argsort(key)
        k, d = key[order], doc[x][order]
        new = np.append(True, k[1:] != k[:-1])
        at = np.flatnonzero(new)
        shared = (np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at))[np.cumsum(new) - 1]
        x = x[order][shared]
        first[x], last[x] = np.minimum(first[x], lo[x]), np.maximum(last[x], hi[x])
    whole = place == NOWHERE
    return np.where(whole, 0, first), np.where(whole, windows - 1, last)


def _equal_strings(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each string the smallest number of one that is equal to it, byte for byte."""
    seen: dict[bytes, int] = {}
    raw = data.tobytes()
    return np.array([seen.setdefault(raw[s:e], k) for k, (s, e) in enumerate(zip(begin.tolist(), (begin + size).tolist(), strict=True))], "i8")


def _repeats_of(data: np.ndarray, doc: np.ndarray, shift: np.ndarray, size: np.ndarray, place: np.ndarray, anchor: np.ndarray, collection: int) -> np.ndarray:
    """Bits of each piece of ``data``: which of its windows are repeats."""
    begin = np.cumsum(size) - size
    first, last = worth_comparing(data, begin, size, place, anchor, doc)
    begin, size, shift = begin + first, last - first + WINDOW, shift + first
    bits = np.zeros(len(size), "u8")
    # In order of ids, so that the first of equal strings has the smallest; the later ones are repeats from end to end.
    order = np.flatnonzero(first <= last)
    order = order[np.argsort(doc[order], kind="stable")]
    same = order[_equal_strings(data, begin[order], size[order])]
    later = order[doc[order] > doc[same]]
    bits[later] = (np.uint64(1) << (size[later] - WINDOW + 1).astype("u8")) - np.uint64(1) << shift[later].astype("u8")
    twin, rep = order[(same != order) & (doc[order] == doc[same])], same[(same != order) & (doc[order] == doc[same])]
    order = order[same == order]
    order = order[np.argsort(anchor[order], kind="stable")]
    edges = np.flatnonzero(anchor[order][1:] != anchor[order][:-1]) + 1
    cuts, end = [0], 0
    for e in [*edges.tolist(), len(order)]:  # whole anchors, up to ``collection`` strings together
        if e - cuts[-1] > collection and end > cuts[-1]:
            cuts.append(end)
        end = e
    for s, e in zip(cuts, [*cuts[1:], len(order)], strict=True):
        x = order[s:e]
        bits[x] = repeated_windows(data[_ranges(begin[x], size[x])], size[x], doc[x]) << shift[x].astype("u8")
    bits[twin] = bits[rep] >> shift[rep].astype("u8") << shift[twin].astype("u8")
    return bits


def compare_pieces(blobs: list[tuple[int, bytes]], collection: int, most: int = COMPARED_BYTES) -> list[tuple]:
    """``(part, kind = 1, blob)``: the windows of each piece that are repeats, as bits; whole anchors take turns of about ``most`` bytes."""
    got = [[*x[:6], np.full(len(x[1]), p, "i4"), x[6]] for p, x in ((p, _unpack(z)) for p, z in blobs)]
    low, doc, ordinal, shift, size, place, part, data = _join(got)
    del got
    anchor, size, place = _from_low_bytes(low, 5), size.astype("i8"), place.astype("i8")
    begin = np.cumsum(size) - size
    bits = np.zeros(len(size), "u8")
    turns = max(1, -(-len(data) // most))
    turn = _mix(anchor) % np.uint64(turns)
    for t in range(turns):
        x = np.flatnonzero(turn == np.uint64(t))
        own = data if turns == 1 else data[_ranges(begin[x], size[x])]
        bits[x] = _repeats_of(own, doc[x], shift[x], size[x], place[x], anchor[x], collection)
    hit = np.flatnonzero(bits)
    by = hit[np.argsort(part[hit], kind="stable")]
    cuts = np.append(np.flatnonzero(np.diff(part[by], prepend=-9)), len(by)).tolist()
    return [(int(part[by[s]]), 1, _pack(ordinal[by[s:e]], bits[by[s:e]])) for s, e in zip(cuts, cuts[1:], strict=False)]


def kept_texts(s: Slice, full: np.ndarray, some: np.ndarray, bits: np.ndarray, with_text: bool) -> list[tuple]:
    """``(sha, least id, n_removed, n_spans, kept_sha256[, kept])`` of each text of the slice; ``full`` and ``some`` count from its first piece."""
    p, n = s.pieces, len(s.data)
    rep = p.first_equal()
    rep_full, rep_bits = np.zeros(len(p.start), bool), np.zeros(len(p.start), "u8")
    rep_full[full] = True
    np.bitwise_or.at(rep_bits, some, bits)
    whole = rep_full[rep] | (s.id > s.id[rep])
    bad = np.zeros(n + 1, bool)  # windows that are repeats, by where they start
    bad[_ranges(p.start[whole], p.windows[whole])] = True
    mask = np.where(whole, 0, rep_bits[rep])
    x = np.flatnonzero(mask)
    for b in range(REACH + 1 if len(x) else 0):
        bad[p.start[x[mask[x] >> np.uint64(b) & np.uint64(1) > 0]] + b] = True
    edge = np.flatnonzero(bad[1:] != bad[:-1]) + 1
    if bad[0]:
        edge = np.append(0, edge)
    change = np.zeros(n + 1, "i1")  # at most WINDOW runs of windows reach over a byte
    change[edge[::2]] += 1
    change[edge[1::2] + WINDOW - 1] -= 1
    gone = np.cumsum(change[:-1], dtype="i1") > 0
    ends = np.cumsum(s.lengths)
    first = ends - s.lengths
    rises = gone.copy()
    rises[1:] &= ~gone[:-1]
    rises[first] = gone[first]
    gone_before, rises_before = (np.append(0, np.cumsum(v, dtype="i8")) for v in (gone, rises))
    gone_n, rises_n = gone_before[ends] - gone_before[first], rises_before[ends] - rises_before[first]
    out = []
    for k, (a, b, m) in enumerate(zip(first.tolist(), ends.tolist(), gone_n.tolist(), strict=True)):
        sha = own = s.shas[64 * k : 64 * k + 64]
        kept = None
        if m:
            kept = s.data[a:b][~gone[a:b]].tobytes()
            own = hashlib.sha256(kept).hexdigest()
        elif with_text:
            kept = s.data[a:b].tobytes()
        out.append((sha, int(s.ids[k]), m, int(rises_n[k]), own) + ((kept.decode("utf-8", "ignore"),) if with_text else ()))
    return out


def _grouped(fn: Callable[..., list[tuple]], schema: pa.Schema) -> Callable[..., pa.Table]:
    """A function of one or two groups' tables that returns rows, as Spark calls it."""

    def run(*tables: pa.Table) -> pa.Table:
        cols = [*zip(*(fn(*tables) if tables[0].num_rows else []), strict=True)] or [()] * len(schema)
        return pa.table([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return (lambda a: run(a)) if fn.__code__.co_argcount == 1 else (lambda a, b: run(a, b))


def _buckets(fn: Callable[[list], list[tuple]], schema: pa.Schema) -> Callable:
    """A function of all blobs of a bucket; the batches are sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for bucket, part, blob in _rows(batches):
            if bucket != now and blobs:
                yield _batch(fn(blobs), schema.names, schema.types)
                blobs = []
            now = bucket
            blobs.append((part, blob))
        if blobs:
            yield _batch(fn(blobs), schema.names, schema.types)

    return run


_SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])
_TOLD = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_SLICE = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("ids", pa.binary()), ("shas", pa.string()), ("lengths", pa.binary()), ("z", pa.binary()), ("crowd", pa.list_(pa.struct([("anchor", pa.int64()), ("n", pa.int64())])))])
_SENT_SQL, _TOLD_SQL = "bucket int, part int, blob binary", "part int, kind int, blob binary"


def _asked(told: pa.Table) -> dict[int, np.ndarray]:
    """Ordinals by kind, sorted."""
    out: dict[int, list] = {0: [np.zeros(0, "u4")], 1: [np.zeros(0, "u4")], 2: [np.zeros(0, "u4")]}
    for r in told.to_pylist():
        out[r["kind"]].append(_unpack(r["blob"])[0])
    return {k: np.sort(np.concatenate(v)).astype("i8") for k, v in out.items()}


def part_size(size: int) -> int:
    """Bytes of a part of a table of ``size`` bytes."""
    return min(PART_BYTES[1], max(PART_BYTES[0], size // PARTS))


class Repeats:
    """The plan for one table with the columns ``doc_id`` and ``text``; ``close`` deletes what it has written."""

    def __init__(self, docs: DataFrame, wide: int = WIDE, collection: int = COLLECTION, part_bytes: int | None = None, slice_bytes: int = SLICE_BYTES):
        self.spark, self.docs = docs.sparkSession, docs
        self.name, self.path, self.made = f"askwell_slices_{uuid.uuid4().hex}", new_path(docs.sparkSession, "slices"), []
        try:
            self.digests = self._written(self._digests(), "digests")
            size = self.digests.where(f"{_SIZE} >= {WINDOW}").agg(F.sum(_SIZE)).first()[0]
            size = size or 0
            self.n = n = max(1, -(-size // (part_bytes or part_size(size))))
            self._write_slices(slice_bytes, min(CROWD, wide + 1))
            self.slices = self.spark.table(self.name)
            self.wide_anchors = wide_anchors = self._wide(wide)
            texts = self.slices.select("part", "number", "ids", "lengths", "z").groupBy("part")

            def hashes(t: pa.Table) -> list[tuple]:
                return send_hashes(_opened(t), t["part"][0].as_py(), n, wide_anchors.value)

            def pieces(t: pa.Table, told: pa.Table) -> list[tuple]:
                asked = _asked(told)
                return send_pieces(_opened(t), t["part"][0].as_py(), asked, n) if len(asked[1]) + len(asked[2]) else []

            sent = texts.applyInArrow(_grouped(hashes, _SENT), _SENT_SQL).repartition(n, "bucket").sortWithinPartitions("bucket")
            self.shared = self._written(map_batches(sent, _buckets(lambda blobs: compare_hashes(blobs, wide), _TOLD), _TOLD_SQL), "shared")
            asks = self.shared.where("kind > 0").groupBy("part")
            sent = texts.cogroup(asks).applyInArrow(_grouped(pieces, _SENT), _SENT_SQL).repartition(n, "bucket").sortWithinPartitions("bucket")
            self.masks = self._written(map_batches(sent, _buckets(lambda blobs: compare_pieces(blobs, collection), _TOLD), _TOLD_SQL), "masks")
        except BaseException:
            self.close()
            raise

    def _written(self, df: DataFrame, tag: str) -> DataFrame:
        self.made.append(written(df, tag))
        return self.made[-1]

    def _digests(self) -> DataFrame:
        """All columns but the text, with the text's SHA-256 and its length in bytes."""
        names = [c for c in self.docs.columns if c != "text"]
        rows = self.docs.select(*(F.col(f"`{c}`") for c in names), F.col("text").cast("string").alias("text"))
        schema = rows.select(*(F.col(f"`{c}`") for c in names), F.lit("").alias(_SHA), F.lit(0).cast("long").alias(_SIZE)).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                data = [(t or "").encode() for t in b.column(len(names)).to_pylist()]
                sha = pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], sha, pa.array(map(len, data), pa.int64())], [*names, _SHA, _SIZE])

        return rows.mapInArrow(run, schema)

    def _wide(self, wide: int) -> Broadcast:
        """The anchors with the most pieces, over ``wide``, at most ``KNOWN`` of them: half a megabyte."""
        some = self.slices.select(F.explode("crowd").alias("c")).groupBy("c.anchor").agg(F.sum("c.n").alias("n")).where(F.col("n") > wide)
        rows = some.orderBy(F.desc("n"), "anchor").limit(KNOWN).collect()
        return self.spark.sparkContext.broadcast(np.array([r["anchor"] for r in rows], "i8").view("u8"))

    def _write_slices(self, slice_bytes: int, crowd: int) -> None:
        """Every different text of a window or more, with its smallest id, in slices: a table bucketed by ``part``.

        Copies of a text are dealt to the parts by their ids, too, and only the one with the smallest id is met by its row of ``least`` there.
        """
        n = self.n
        part = F.expr(f"cast(pmod(xxhash64(sha, id), {n}) as int)").alias("part")
        docs = self.docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LATE)).alias("id"), F.col("text").cast("string").alias("text"))

        def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent: dict[bytes, int] = {}  # of one task: a text goes again only with a smaller id
            z = zstandard.ZstdCompressor(level=1)
            for b in slices(batches, 256):
                out = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    data = (t or "").encode()
                    if len(data) >= WINDOW:
                        digest = hashlib.sha256(data)
                        if i < sent.get(digest.digest(), LATE + 1):
                            sent[digest.digest()] = i
                            out.append((digest.hexdigest(), i, z.compress(data)))
                yield _batch(out, ["sha", "id", "z"], [pa.string(), pa.int64(), pa.binary()])

        texts = map_batches(docs, press, "sha string, id long, z binary").select(part, "sha", "id", "z")
        least = self.digests.where(f"{_SIZE} >= {WINDOW}").groupBy(F.col(_SHA).alias("sha")).agg(F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(LATE))).alias("id"))

        def cut(t: pa.Table, least: pa.Table) -> list[tuple]:
            want, here = dict(zip(least["sha"].to_pylist(), least["id"].to_pylist(), strict=True)), {}
            for k, (sha, i) in enumerate(zip(t["sha"].to_pylist(), t["id"].to_pylist(), strict=True)):
                if want.get(sha) == i:
                    here[sha] = k
            z, opened = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
            rows, texts, number, pieces = [], [], t["part"][0].as_py(), []

            def done() -> None:
                ids, shas, data = zip(*texts, strict=True)
                pieces.append(Pieces(np.frombuffer(b"".join(data), "u1"), np.array([*map(len, data)])))
                rows.append((number, len(rows), _pack(np.array(ids, "i8")), "".join(shas), _pack(np.array([*map(len, data)], "u4")), z.compress(b"".join(data)), []))
                texts.clear()

            size = 0
            for i, sha in sorted((want[sha], sha) for sha in here):
                texts.append((i, sha, opened.decompress(t["z"][here[sha]].as_py())))
                size += len(texts[-1][2])
                if size >= slice_bytes:
                    done()
                    size = 0
            if texts:
                done()
            if rows:
                rows[-1] = (*rows[-1][:-1], crowded(pieces, crowd))
            return rows

        made = texts.groupBy("part").cogroup(least.select(part, "sha", "id").groupBy("part")).applyInArrow(_grouped(cut, _SLICE), "part int, number int, ids binary, shas string, lengths binary, z binary, crowd array<struct<anchor: bigint, n: bigint>>")
        made.write.bucketBy(n, "part").format("parquet").option("path", self.path).saveAsTable(self.name)

    def kept(self, with_text: bool = False) -> DataFrame:
        """``(sha, least, n_removed, n_spans, kept_sha256[, kept])`` of every different text of a window or more."""

        def cut(t: pa.Table, told: pa.Table) -> list[tuple]:
            full, some, bits = [np.zeros(0, "u4")], [np.zeros(0, "u4")], [np.zeros(0, "u8")]
            for r in told.to_pylist():
                got = _unpack(r["blob"])
                if r["kind"] == 0:
                    full.append(got[0])
                else:
                    some.append(got[0]), bits.append(got[1])
            full, some, bits = (np.concatenate(x) for x in (full, some, bits))
            order, full = np.argsort(some, kind="stable"), np.sort(full).astype("i8")
            some, bits, out = some[order].astype("i8"), bits[order], []
            for s in _opened(t):
                own, where = s.own(some)
                out += kept_texts(s, s.own(full)[0], own, bits[where], with_text)
            return out

        fields = [(_SHA, pa.string()), ("__least", pa.int64()), ("__removed", pa.int64()), ("__spans", pa.int64()), ("__kept_sha", pa.string())] + [("__kept", pa.string())] * with_text
        sql = f"{_SHA} string, __least long, __removed long, __spans long, __kept_sha string" + ", __kept string" * with_text
        told = self.shared.where("kind = 0").union(self.masks).groupBy("part")
        return self.slices.groupBy("part").cogroup(told).applyInArrow(_grouped(cut, pa.schema(fields)), sql)

    def close(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        remove_path(self.spark, self.path)
        removed(*self.made)


def _is_copy() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LATE)) > F.col("__least")


def repeated_passages(docs: DataFrame, **how: int) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    plan = Repeats(docs.select("doc_id", "text"), **how)
    try:
        rows = plan.digests.join(plan.kept(), _SHA, "left")
        nothing = hashlib.sha256(b"").hexdigest()
        out = rows.select(
            "doc_id",
            F.col(_SIZE).alias("n_bytes"),
            F.when(_is_copy(), F.col(_SIZE)).otherwise(F.coalesce("__removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(_is_copy(), 1).otherwise(F.coalesce("__spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(_is_copy(), nothing).otherwise(F.coalesce("__kept_sha", F.col(_SHA))).alias("kept_sha256"),
        )
        return written(out, "repeats")
    finally:
        plan.close()


def without_repeats(docs: DataFrame, **how: int) -> DataFrame:
    """``docs`` with the bytes that stay as text (parts of characters are dropped); ``n_chars``, where there is one, counts them."""
    plan = Repeats(docs, **how)
    try:
        short = docs.select(F.sha2(F.encode(F.col("text").cast("string"), "UTF-8"), 256).alias(_SHA), F.col("text").alias("__own")).where(f"octet_length(__own) < {WINDOW}").dropDuplicates([_SHA])
        rows = plan.digests.join(plan.kept(with_text=True), _SHA, "left").join(short, _SHA, "left")
        text = F.when(_is_copy(), "").otherwise(F.coalesce("__kept", "__own"))
        out = rows.withColumn("__text", text).select(*(F.col("__text" if c == "text" else f"`{c}`").alias(c) for c in docs.columns))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return written(out, "unrepeated")
    finally:
        plan.close()


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
