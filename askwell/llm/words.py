"""Ids of texts by a lower-casing word vocabulary with byte-pair merges, computed on whole arrays of words.

``WordIds`` gives the ids that the tokenizers library gives. A chunk of text is lower-cased and cut into parts as the vocabulary's pattern
cuts it, by the classes of its bytes; each part of at most ``KEYED`` bytes is looked up, as a pair of integers that hold all its bytes, in a table of the
parts that were met before; and the new ones are merged together, the merge of lowest rank of every part in each round. Parts of more than ``LONG``
bytes, and whole white-space-separated pieces with other characters than ASCII and Latin letters up to U+012F, go through the library, as do whole texts
with a special token; it is loaded when it is needed. The library's normaliser and pattern never look across white space. A vocabulary with another normaliser or pattern goes through the
library altogether.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Parts of as many bytes at most have a key; of as many, are merged here.
KEYED, LONG = 16, 256
#: Parts that are merged together.
MERGED = 2048
#: Bytes of text that are cut at once; longer texts are split at white space.
CHUNK = 1 << 18

# What the vocabularies that are read here without the library say of themselves.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLITS = [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]

_SPACE, _LETTER, _DIGIT, _OTHER, _LATIN, _ODD = range(6)


def _classes() -> np.ndarray:
    out = np.full(256, _ODD, "u1")
    out[33:127] = _OTHER
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[48:58] = _DIGIT
    out[65:91] = out[97:123] = _LETTER
    out[[0xC3, 0xC4]] = _LATIN  # the first byte of U+00C0 to U+013F
    return out


def _lower() -> np.ndarray:
    out = np.arange(256, dtype="u1")
    out[65:91] += 32
    return out


_CLASS, _LOWER = _classes(), _lower()
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")


class _Table:
    """Numbers 0, 1, 2, ... for different pairs of integers: open addressing, many keys at once."""

    def __init__(self, bits: int):
        self.bits = bits
        self.low, self.high = np.zeros(1 << bits - 1, "u8"), np.zeros(1 << bits - 1, "u8")
        self.clear()

    def clear(self) -> None:
        self.slots, self.n = np.full(1 << self.bits, -1, "i4"), 0

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype("i8")

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 where there is none."""
        at = self._slot(low, high)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & ((self.low[out] != low) | (self.high[out] != high)))
        at = at[open_]
        while len(open_):
            at = at + 1 & len(self.slots) - 1
            got = self.slots[at]
            out[open_] = got
            wrong = (got >= 0) & ((self.low[got] != low[open_]) | (self.high[got] != high[open_]))
            open_, at = open_[wrong], at[wrong]
        return out

    def room(self, n: int) -> bool:
        return self.n + n <= len(self.low)

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        """New keys, each once, get the next numbers in order."""
        own = np.arange(self.n, self.n + len(low), dtype="i4")
        self.low[own], self.high[own] = low, high
        self.n += len(low)
        at = self._slot(low, high)
        while len(own):
            free = self.slots[at] < 0
            self.slots[at[free]] = own[free]
            left = self.slots[at] != own
            own, at = own[left], at[left] + 1 & len(self.slots) - 1


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, then the next code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class _Merges:
    """Byte-pair merges of many short parts together."""

    def __init__(self, model: dict):
        vocab, end, letters = model["vocab"], model["end_of_word_suffix"], _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], "i4")
        self.last = np.array([vocab[c + end] for c in letters], "i4")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], "i4")
        self.ranks = _Table(max(8, len(pairs).bit_length() + 2))
        self.ranks.add(np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], "u8"), np.zeros(len(pairs), "u8"))
        self.none = np.int32(len(pairs))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; ``none`` for those that do not merge, or have no second symbol."""
        got = np.full(a.shape, self.none)
        ok = b >= 0
        key = a[ok].astype("u8") << np.uint64(32) | b[ok].astype("u8")
        found = self.ranks.find(key, np.zeros(len(key), "u8"))
        got[ok] = np.where(found < 0, self.none, found)
        return got

    def __call__(self, parts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts (an array of bytes with a row each, and their sizes), one part after another, and how many each has."""
        some = [self._merged(parts[k : k + MERGED], size[k : k + MERGED]) for k in range(0, len(parts), MERGED)]
        return np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some])

    def _merged(self, parts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = parts.shape
        place = np.arange(width)
        symbols = np.where(place < size[:, None] - 1, self.inner[parts], np.where(place == size[:, None] - 1, self.last[parts], -1)).astype("i4")
        ranks = np.full((n, width), self.none)
        ranks[:, :-1] = self.rank(symbols[:, :-1], symbols[:, 1:])
        open_ = np.arange(n)
        while len(open_):
            at = ranks[open_].argmin(1)
            best = ranks[open_, at]
            going = best < self.none
            open_, at, best = open_[going], at[going], best[going]
            if not len(open_):
                break
            # The leftmost merge of lowest rank: one symbol for two, and the rest moves up.
            move = np.minimum(place + (place > at[:, None]), width - 1)
            s, r = symbols[open_[:, None], move], ranks[open_[:, None], move]
            s[:, -1], r[:, -1] = -1, self.none
            own = np.arange(len(open_))
            s[own, at] = self.made[best]
            right = np.minimum(at + 1, width - 1)
            r[own, at] = np.where(right > at, self.rank(s[own, at], s[own, right]), self.none)
            left = np.flatnonzero(at > 0)
            r[left, at[left] - 1] = self.rank(s[left, at[left] - 1], s[left, at[left]])
            symbols[open_], ranks[open_] = s, r
        return symbols[symbols >= 0], (symbols >= 0).sum(1)


class WordIds:
    """Ids of texts, with those of the parts met lately kept in tables of bounded size."""

    def __init__(self, path: str, bits: int = 20):
        self.path = path
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, cut = made["model"], made.get("pre_tokenizer") or {}
        self.known = (
            (made.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and cut.get("pretokenizers") == SPLITS
            and made.get("post_processor") is None
            and model["type"] == "BPE"
            and model.get("end_of_word_suffix")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        )
        self.special = [t["content"].encode() for t in made.get("added_tokens", [])]
        if self.known:
            self.merges, self.table = _Merges(model), _Table(bits)
        self._clear()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def _clear(self) -> None:
        if self.known:
            self.table.clear()
            self.start, self.size = np.zeros(len(self.table.low), "i8"), np.zeros(len(self.table.low), "i8")
        self.pool, self.used = np.zeros(1 << 16, "i4"), 0
        self.rare: dict[bytes, tuple[int, int]] = {}

    def _kept(self, ids: np.ndarray) -> int:
        """Where in the pool the ids have been put."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), "i4")])
        self.pool[at : self.used] = ids
        return at

    def _by_library(self, data: bytes) -> np.ndarray:
        return np.array(self.library.encode(data.decode(), add_special_tokens=False).ids, "i4")

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many(pa.array([text], pa.string()))[0].tolist()

    def encode_many(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one text after another, and where each begins (and the last ends); ``end`` follows each text. Null texts are empty."""
        got, counts = [np.zeros(0, "i4")], np.zeros(len(texts), "i8")
        for segments, whole in self._chunks(texts):
            if whole:
                ids = self._by_library(segments[0][1])
                n = np.array([len(ids)])
            else:
                ids, n = self._chunk([s for _, s in segments])
            got.append(ids)
            np.add.at(counts, [k for k, _ in segments], n)
        ids = np.concatenate(got)
        if end is not None:
            out = np.full(len(ids) + len(texts), end, "i4")
            out[np.arange(len(ids), dtype="i4") + np.repeat(np.arange(len(texts), dtype="i4"), counts)] = ids
            ids, counts = out, counts + 1
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def _chunks(self, texts: pa.Array) -> Iterator[tuple[list[tuple[int, bytes]], bool]]:
        """``(number of the text, bytes)`` of some segments of about ``CHUNK`` bytes together, or a text for the library."""
        held, size = [], 0
        for k, text in enumerate(texts):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            if not self.known or b"<|" in data and any(s in data for s in self.special):
                if held:
                    yield held, False
                    held, size = [], 0
                yield [(k, data)], True
                continue
            for segment in _segments(data):
                held.append((k, segment))
                size += len(segment)
                if size >= CHUNK:
                    yield held, False
                    held, size = [], 0
        if held:
            yield held, False

    def _chunk(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The segments' ids, one after another, and how many each has."""
        data = np.frombuffer(b"\n".join([*segments, b"\n" * 24]), "u1")
        low, start, stop, odd = _parts(data)
        size = stop - start
        slow = np.flatnonzero(odd | (size > KEYED))
        first = np.ndarray(len(low) - 8, "<u8", low, strides=(1,))
        key = first[start] & _MASKS[np.minimum(size, 8)], first[np.minimum(start + 8, len(first) - 1)] & _MASKS[np.clip(size - 8, 0, 8)]
        if slow.size:
            key[0][slow] = key[1][slow] = 0  # never asked for
        if not self.table.room(len(start)) or len(self.rare) > 1 << 15 or self.used > 1 << 22:
            self._clear()
        number = self.table.find(*key)
        new = np.flatnonzero((number < 0) & (size <= KEYED) & ~odd)
        if len(new):
            self._learn(low, start, size, new, key)
            number[new] = self.table.find(key[0][new], key[1][new])
        at, n = self.start[number], self.size[number]
        if slow.size:
            pieces = [(data if odd[k] else low)[start[k] : stop[k]].tobytes() for k in slow.tolist()]
            self._learn_rare({p: bool(odd[k]) for k, p in zip(slow.tolist(), pieces, strict=True) if p not in self.rare})
            at[slow], n[slow] = np.array([self.rare[p] for p in pieces]).T
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat((at - before[:-1]).astype("i4"), n) + np.arange(before[-1], dtype="i4")]
        begins = np.cumsum([0, *(len(s) + 1 for s in segments)])
        return ids, np.diff(before[np.searchsorted(start, begins)])

    def _learn_rare(self, pieces: dict[bytes, bool]) -> None:
        """Pieces without a key, by whether they are odd."""
        long = [p for p, odd in pieces.items() if not odd and len(p) <= LONG]
        if long:
            width = max(map(len, long))
            ids, n = self.merges(np.frombuffer(b"".join(p.ljust(width, b"\0") for p in long), "u1").reshape(-1, width), np.array([*map(len, long)]))
            first = self._kept(ids) + np.cumsum(n) - n
            self.rare.update(zip(long, zip(first.tolist(), n.tolist(), strict=True), strict=True))
        for p in pieces.keys() - self.rare.keys():
            ids = self._by_library(p)
            self.rare[p] = self._kept(ids), len(ids)

    def _learn(self, low: np.ndarray, start: np.ndarray, size: np.ndarray, new: np.ndarray, key: tuple[np.ndarray, np.ndarray]) -> None:
        order = new[np.lexsort((key[1][new], key[0][new]))]
        a, b = key[0][order], key[1][order]
        order = order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))]
        parts = low[np.minimum(start[order, None] + np.arange(KEYED), len(low) - 1)]
        ids, n = self.merges(parts, size[order])
        first = self.table.n
        self.table.add(key[0][order], key[1][order])
        own = slice(first, first + len(order))
        self.start[own], self.size[own] = self._kept(ids) + np.cumsum(n) - n, n


def _segments(data: bytes) -> Iterator[bytes]:
    """The text cut at white space into segments of about ``CHUNK`` bytes."""
    at = 0
    while len(data) - at > 2 * CHUNK:
        cut = max(data.rfind(c, at, at + CHUNK) for c in (b" ", b"\n"))
        if cut < 0:
            ends = [e for c in (b" ", b"\n") if (e := data.find(c, at + CHUNK)) >= 0]
            if not ends:
                break
            cut = min(ends)
        yield data[at:cut]
        at = cut
    yield data[at:]


def _parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(lower-cased bytes, starts, ends, odd)`` of the parts; an odd part is a whole piece, for the library."""
    kind, low = _CLASS[data], _LOWER[data]
    latin = np.flatnonzero(kind == _LATIN)
    if len(latin):
        lead, second = data[latin], data[latin + 1]
        ok = (lead == 0xC3) | (second < 0xB0)
        upper = np.where(lead == 0xC3, np.where((second < 0x9F) & (second != 0x97), 0x20, 0), 1 - (second & 1))  # U+0100 and so on by pairs
        low[latin + 1] = second + upper.astype("u1") * ok
        is_ = np.where(ok, np.where((lead == 0xC3) & (second & 0xDF == 0x97), _OTHER, _LETTER), _ODD)  # the signs of multiplication and division
        kind[latin] = kind[latin + 1] = is_
    cut = np.empty(len(kind), bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut |= kind == _DIGIT
    _contractions(low, kind, cut)
    odd_at = np.flatnonzero(kind == _ODD)
    if len(odd_at):
        spaces = np.flatnonzero(kind == _SPACE)
        k = np.unique(np.searchsorted(spaces, odd_at))
        begin, end = np.where(k > 0, spaces[np.maximum(k - 1, 0)] + 1, 0), spaces[k]  # the chunk ends with white space
        change = np.zeros(len(kind) + 1, "i1")
        change[begin] += 1
        change[end] -= 1
        cut &= np.cumsum(change[:-1], dtype="i1") == 0
        cut[begin] = True
    edge = np.flatnonzero(cut)
    own = np.flatnonzero(kind[edge] != _SPACE)
    start, stop = edge[own], np.append(edge, len(kind))[own + 1]
    odd = np.zeros(len(start), bool)
    if len(odd_at):
        odd[np.searchsorted(start, begin)] = True
    return low, start, stop, odd


def _contractions(low: np.ndarray, kind: np.ndarray, cut: np.ndarray) -> None:
    """An apostrophe that starts a part, with s, t, m, d, re, ve or ll behind it, is a part with these letters."""
    at = np.flatnonzero(low == 39)
    at = at[cut[at]]
    a, b = low[at + 1], low[at + 2]
    two = np.isin(a, np.frombuffer(b"stmd", "u1"))
    three = (a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108)
    for n, own in ((2, at[two]), (3, at[three])):
        cut[own + 1] = False
        cut[own + n] = True
