"""SimHash fingerprints and near-duplicate groups found by Golay-code fuzzy hashing.

A 64-bit fingerprint has three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two bits agree
wholly in one segment at least, and differ by at most two bits in the segment after it. That segment, zero-extended to
23 bits, is decoded to the indices of the codewords of the perfect (23, 12) Golay code near it: the one within distance
three and, where it is at distance three, the five at distance four. Any two words at distance two or less share one of
their (at most six) indices, so the keys (segment, its bits, an index of the next segment) lead every link to a common key.
Rows that share a key are joined, and the distance of the fingerprints is verified.

Only distinct fingerprints get keys; each carries the smallest id that has it. A key held by more than ``GROUP`` of them is
refined: links within it agree in one of three parts of the bits that are still free, so each part makes a new key, until
keys are small or at most twelve bits are free (4,096 fingerprints). No task gets an unbounded group, and no link is lost.

Defined results: a null text is an empty one; a text of fewer words than a shingle is one shingle; a text of no words has
fingerprint zero, which is linked like any other; equal fingerprints are one group; repeated ids are kept as they are; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import checkpointed, map_batches, slices, table
from askwell.llm.components import connected_components

#: Most fingerprints compared with one another under one key.
GROUP = 4096
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: the generator polynomial of the binary Golay code.
GOLAY_POLYNOMIAL = 0b101011100011

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype("i8")
_LANES = (np.arange(8) * 256).astype("i4")


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle of a text, repeats included."""
    words = (text or "").encode().lower().split()  # of bytes, so only A-Z and the six ASCII white-space characters count
    if not words:
        return np.zeros(0, "u8")
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, SEED)], "u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)], "u8")


def simhash(text: str | None, k: int = 3) -> int:
    """The 64-bit fingerprint: a bit is one if it is set in over half the shingles' hashes."""
    return majority(shingle_hashes(text, k))


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    seen = np.bincount((hashes.view("u1").reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((2 * (seen @ _BITS) > len(hashes)).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([simhash(t, k) for t in b.column(1).to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return map_batches(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, "doc_id long, fp long")


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome: the nearest codeword's error, the six errors to near codewords, and how many of the six count."""
    low = np.arange(23)

    def syndrome(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(22, 10, -1):
            v ^= np.where(v >> bit & 1, GOLAY_POLYNOMIAL << (bit - 11), 0)
        return v

    one = 1 << low
    two = np.array([a | b for k, a in enumerate(one) for b in one[:k]])
    three = np.unique([a | b for a in two for b in one if not a & b])
    nearest = np.zeros(2048, "i8")
    for errors in (three, two, one, np.zeros(1, "i8")):
        nearest[syndrome(errors)] = errors
    four = np.unique([a | b for a in three for b in one if not a & b])
    errors, count = np.zeros((2048, 6), "i8"), np.ones(2048, "i8")
    errors[:, 0] = nearest
    at = syndrome(four)
    order = np.argsort(at, kind="stable")
    at, four = at[order], four[order]
    first = np.searchsorted(at, np.arange(2048))
    far = np.array([bin(e).count("1") == 3 for e in nearest])
    for s in np.flatnonzero(far):
        own = four[first[s] : first[s] + 5]
        errors[s, 1:] = own
        count[s] = 6
    return errors, count, nearest


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (their top twelve bits) of the codewords near each 23-bit word: an array (n, 6), and which entries count."""
    v = words.astype("i8")
    s = v.copy()
    for bit in range(22, 10, -1):
        s ^= np.where(s >> bit & 1, GOLAY_POLYNOMIAL << (bit - 11), 0)
    errors, count, _ = golay_tables()
    return (v[:, None] ^ errors[s]) >> 11, np.arange(6) < count[s][:, None]


def keyed(distinct: DataFrame) -> DataFrame:
    """``(key, fp, rep, free)`` of distinct fingerprints ``(fp, rep)``; ``free`` has the bits that a key doesn't fix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 20_000):
            fp = b.column(0).to_numpy().view("u8")
            rep = b.column(1).to_numpy()
            seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype("i8") for at, n in SEGMENTS]
            out = []
            for i, (at, n) in enumerate(SEGMENTS):
                index, counts = golay_indices(seg[(i + 1) % 3])
                row, col = np.nonzero(counts)
                free = np.array([~(((1 << n) - 1) << at) & (2**64 - 1)], "u8").view("i8")[0]
                out.append((i << 60 | seg[i][row] << 12 | index[row, col], fp[row].view("i8"), rep[row], np.full(len(row), free)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "fp", "rep", "free"])

    return map_batches(distinct.select("fp", "rep"), run, "key long, fp long, rep long, free long")


def refined(rows: DataFrame) -> DataFrame:
    """Three new keys for each row of a crowded key, each fixing a third of the free bits more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 20_000):
            key, fp, rep, free = (b.column(k).to_numpy() for k in range(4))
            out = []
            for f in np.unique(free):
                own = free == f
                bits = [i for i in range(64) if int(f) >> i & 1]
                for part in range(3):
                    mask = sum(1 << i for i in bits[part::3])
                    low = np.array([mask], "u8").view("i8")[0]
                    fixed = fp[own] & low
                    new = [xxhash.xxh64_intdigest(x, part) for x in np.stack([key[own], fixed], 1).astype("<i8").view("V16").ravel().tolist()]
                    out.append((np.array(new, "u8").view("i8"), fp[own], rep[own], free[own] & ~low))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "fp", "rep", "free"])

    return map_batches(rows.select("key", "fp", "rep", "free"), run, "key long, fp long, rep long, free long")


def linked_in_order(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger rep, smaller rep) of fingerprints at most ``most`` bits apart under equal keys; the keys are sorted."""
    fp = fp.view("u8")
    a, b, at = [], [], np.arange(len(key) - 1)
    gap = 1
    while len(at):
        at = at[at + gap < len(key)]
        at = at[key[at] == key[at + gap]]
        near = at[np.bitwise_count(fp[at] ^ fp[at + gap]) <= most]
        x, y = rep[near], rep[near + gap]
        a.append(np.maximum(x, y)), b.append(np.minimum(x, y))
        gap += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, "i8"), np.zeros(0, "i8"))


def links(rows: DataFrame, most: int) -> DataFrame:
    """Links ``(a, b)`` between the representatives of fingerprints that share a key and differ in at most ``most`` bits.

    A task sorts its rows by key and reads them in order; it holds one batch and the key that is open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[np.ndarray] | None = None
        for b in batches:
            now = [b.column(k).to_numpy() for k in range(3)]
            if open_ is not None:
                now = [np.concatenate(x) for x in zip(open_, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            open_ = [x[cut:].copy() for x in now]
            yield from found(*(x[:cut] for x in now))
        if open_ is not None:
            yield from found(*open_)

    def found(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = linked_in_order(key, fp, rep, most)
        pairs = np.unique(np.stack([x, y], 1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = rows.select("key", "fp", "rep").repartition("key").sortWithinPartitions("key")
    return map_batches(dealt, run, "a long, b long")


def fingerprint_links(distinct: DataFrame, most: int = 2, group: int = GROUP) -> DataFrame:
    """All links of distinct fingerprints ``(fp, rep)`` within ``most`` bits (two at most)."""
    if not 0 <= most <= 2:
        raise ValueError("the keys lead links of up to two bits together")
    rows, out = keyed(distinct), None
    while True:
        crowded = checkpointed(rows.groupBy("key").count().where(f"count > {group}").select("key"))
        if crowded.isEmpty():
            found = links(rows, most)
            return found if out is None else out.union(found)
        # Keys that fix all but twelve bits hold 4,096 fingerprints at most, and stay.
        again = rows.where("bit_count(free) > 12").join(crowded, "key", "left_semi")
        kept = rows.join(crowded, "key", "left_anti").union(rows.where("bit_count(free) <= 12").join(crowded, "key", "left_semi"))
        found = links(kept, most)
        out = found if out is None else out.union(found)
        rows = checkpointed(refined(again))
        if rows.isEmpty():
            return out


def near_duplicates(docs: DataFrame, k: int = 3, most: int = 2) -> DataFrame:
    """``(doc_id, fp long, component_id)`` of every document; ``component_id`` is the smallest id reachable over links."""
    fps = checkpointed(fingerprints(docs, k))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    component = connected_components(fingerprint_links(distinct, most))
    named = distinct.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
