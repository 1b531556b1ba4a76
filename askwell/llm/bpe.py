"""Byte-level BPE encoding and decoding.

A pre-token's symbols form a doubly linked list; a priority queue holds the ranks of all adjacent mergeable pairs.
Each step pops the lowest rank (leftmost first), skips entries whose pair no longer exists, merges, and pushes the
two new neighbours. Decoding concatenates the vocabulary's strings and maps them back to bytes.

Pre-tokens repeat, so each Python worker keeps the encodings of those it has seen in a bounded two-generation cache.

Defined results: a null text counts as empty; an empty text has no ids; the vocabulary's special strings in a text
become their single id; repeated rows are encoded alike; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from askwell.llm.common import map_batches, slices, table

#: Entries of each of the cache's two generations.
CACHE_ENTRIES = 500_000

# The byte-level pre-token pattern of the public vocabulary, with white space as Unicode defines it.
PRETOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    symbols, spare = [], 0x100
    for byte in range(256):
        if byte in printable:
            symbols.append(chr(byte))
        else:
            symbols.append(chr(spare))
            spare += 1
    return symbols


def packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        self.byte_id = [vocab[s] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        #: (left id, right id) packed into an integer -> rank; rank -> merged id
        self.merges: dict[int, int] = {}
        self.merged_id: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << 32 | vocab[right]] = rank
            self.merged_id.append(vocab[left + right])
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.strings: list[bytes] = [b""] * size
        for text, i in {**vocab, **self.special}.items():
            whole = all(c in to_byte for c in text)
            self.strings[i] = bytes(to_byte[c] for c in text) if whole else text.encode()
        self.pretokens = regex.compile(PRETOKENS)
        self.cache_entries = cache_entries
        #: Pre-tokens as they stand; and, in two generations, what stands between two single spaces.
        self.whole: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token's bytes."""
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges, merged_id = self.merges, self.merged_id
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, left = [], ids[0]
        for i in range(1, n):
            right = ids[i]
            rank = merges.get(left << 32 | right)
            if rank is not None:
                queue.append(rank << 40 | i - 1)
            left = right
        heapify(queue)
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 40, entry & 0xFFFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0 or merges.get(ids[i] << 32 | ids[j]) != rank:
                continue  # stale: one of the two symbols has been merged away since
            merged = ids[i] = merged_id[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = merges.get(merged << 32 | ids[k])
                if rank is not None:
                    heappush(queue, rank << 40 | i)
            h = before[i]
            if h >= 0:
                rank = merges.get(ids[h] << 32 | merged)
                if rank is not None:
                    heappush(queue, rank << 40 | h)
        return [i for i in ids if i >= 0]

    def _pretoken(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers, from the cache if it holds them."""
        got = self.whole.get(piece)
        if got is None:
            got = packed(self.merge(piece.encode()))
            if len(piece) <= 64:
                if len(self.whole) >= self.cache_entries:
                    self.whole.clear()
                self.whole[piece] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        if "<" in text and (parts := self.special_split.split(text))[1:]:
            return b"".join(
                self.special[p].to_bytes(4, "little") if k % 2 else self._ordinary(p) for k, p in enumerate(parts)
            )
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        """Pre-tokens begin at every single space, so that such texts are cut there; others go through the pattern."""
        if "  " in text:
            return b"".join(map(self._pretoken, self.pretokens.findall(text)))
        pieces = text.split(" ")
        out = [*map(self.young.get, pieces)]
        out[0] = b"".join(map(self._pretoken, self.pretokens.findall(pieces[0])))  # no space before it
        if None in out:
            for k, x in enumerate(out):
                if x is None:
                    out[k] = self._spaced(pieces[k])
        return b"".join(out)

    def _spaced(self, piece: str) -> bytes:
        """Ids of a space and the piece after it."""
        got = self.young.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                got = b"".join(map(self._pretoken, self.pretokens.findall(" " + piece)))
            if len(piece) <= 64:
                if len(self.young) >= self.cache_entries:
                    self.old, self.young = self.young, {}
                self.young[piece] = got
        return got

    def decode(self, ids: bytes) -> str:
        """Text of ids given as little-endian 32-bit integers."""
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    """One codec for each vocabulary and Python worker."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` of every text."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            ids = [np.frombuffer(c.encode(t), "<i4") for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype("i4")
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, "i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)`` of every id list; a null list decodes to the empty text."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            texts = [c.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(id_col, ids_col), run, f"`{id_col}` {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every text in one pass: token counts and digests of the ids and of the decoded text."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path), hashlib.sha256
        for b in slices(batches):
            n, of_ids, of_text = [], [], []
            for text in b.column(1).to_pylist():
                ids = c.encode(text)
                n.append(len(ids) // 4)
                of_ids.append(sha(ids).hexdigest())
                of_text.append(sha(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
