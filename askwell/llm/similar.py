"""Near-duplicate groups of documents: all pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what they join.

Documents with equal sets are one first. Then the SimHash operator proposes pairs: fingerprints of the shingles within two bits, found by their
Golay-code keys. At a similarity of 0.8 two fingerprints differ in some ten bits, more than any keys of the code lead together, so
SimHash alone cannot find all pairs. An exact way finds the rest, prefix filtering: in any one order of all shingles, two sets of n and m shingles with a similarity
of t share a shingle among the first ``n - ceil(t n) + 1`` of the one and the first ``m - ceil(t m) + 1`` of the other. These shingles are
the keys, so every such pair meets. The order puts shingles that are common in some stretch of the input last, which keeps keys small; it
changes the time and not the result. Pairs that meet have to pass two tests, of what their places leave to share under the first key they have in
common, and of 64 one-bit min-hashes: at t = 0.8 they differ in 6.4 bits, and ``BITS`` allows for over six standard deviations more.
The rest is verified by the exact similarity of the two sets.

A key with more than ``SMALL`` documents goes twice: first each is compared with the first and the one before it; then all with all that
the links so far leave in different groups, since a link within a group joins nothing. A pair is compared under the first of its common keys
only, and none of these pairs becomes a row: documents that are in one are named, their sets go to that key, and the task that compares them
returns the links that join groups, fewer than there are groups. So rows grow with the keys' rows; the comparisons within a
key still grow with the square of what its groups leave apart. No pair that could join two groups is left out.

Defined results: null texts are empty ones; empty texts are equal; a null id is linked to nothing; rows of one id are one document, that with the
smallest digest; an empty table has no links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.llm.common import checkpointed, map_batches, removed, slices, written
from askwell.llm.components import connected_components
from askwell.llm.simhash import fingerprint_links, majority, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Keys of more documents go by groups.
SMALL = 8
#: Most differing min-hash bits of 64: at a similarity of 0.8 more come up three times in 10^8.
BITS = 22
#: Shingles are called common if they are in ``OFTEN`` documents of a stretch of ``STRETCH`` shingles; the ``COMMON`` most frequent are known. All three
#: bear on the time only.
STRETCH, OFTEN, COMMON = 2_000_000, 4, 100_000

_SLACK = 1e-9
_XOR = (np.arange(1, 65, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))[:, None]
_ODD = (np.arange(1, 65, dtype="u8") * np.uint64(0xBF58476D1CE4E5B9) ^ np.uint64(0x94D049BB133111EB) | np.uint64(1))[:, None]


def shingle_set(text: str | None) -> np.ndarray:
    """The different shingles' hashes in order."""
    return np.unique(shingle_hashes(text, SHINGLE))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sets in order; empty ones are equal."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 1.0


def min_bits(hashes: np.ndarray) -> int:
    """One bit of each of 64 min-hashes, as a signed number."""
    least = np.full(64, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096] ^ _XOR) * _ODD).min(1))
    return int.from_bytes(np.packbits((least >> np.uint64(31) & np.uint64(1)).astype(bool)).tobytes(), "little", signed=True)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in order, and their levels (logarithms of how often they were counted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, size = [], 0
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                open_.append(shingle_set(text))
                size += len(open_[-1])
                if size >= STRETCH:
                    yield counted(open_)
                    open_, size = [], 0
        if open_:
            yield counted(open_)

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        shingle, n = np.unique(np.concatenate(sets), return_counts=True)
        often = n >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(shingle[often].view("i8")), pa.array(n[often])], ["shingle", "n"])

    rows = map_batches(_texts(docs).select("text"), run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    got = rows.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingle, n = got.column(0).to_numpy().view("u8"), got.column(1).to_numpy()
    order = np.argsort(shingle)
    return shingle[order], np.log2(np.maximum(n[order], 1)).astype("u1") + np.uint8(1)


def prefix_of(hashes: np.ndarray, common: np.ndarray, level: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the order of all shingles: by level, then by hash."""
    n = len(hashes)
    if not n:
        return hashes
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.argsort(np.where(common[at] == hashes, level[at], 0), kind="stable")]
    return hashes[: n - max(1, ceil(similarity * n - _SLACK)) + 1]


def _signatures(docs: DataFrame, similarity: float) -> DataFrame:
    """``(doc_id, digest, n, bits, fp, prefix)`` of every row; ``fp`` is the SimHash fingerprint."""
    known = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, level = known.value
        for b in slices(batches):
            hashes = [shingle_hashes(t, SHINGLE) for t in b.column(1).to_pylist()]
            sets = [*map(np.unique, hashes)]
            cols = [
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([*map(len, sets)], pa.int32()),
                pa.array([*map(min_bits, sets)], pa.int64()),
                pa.array(np.array([*map(majority, hashes)], "u8").view("i8")),
                pa.array([prefix_of(s, common, level, similarity).tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "digest", "n", "bits", "fp", "prefix"])

    return map_batches(_texts(docs), run, "doc_id long, digest binary, n int, bits long, fp long, prefix binary")


_ROW = ("key", "doc", "n", "pos", "bits")


def _keys(signatures: DataFrame) -> DataFrame:
    """A row for each shingle of each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            prefix = b.column(3).to_pylist()
            size = np.array([len(p) // 8 for p in prefix], "i8")
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            doc, n, bits = (np.repeat(b.column(k).to_numpy(), size) for k in range(3))
            cols = [np.frombuffer(b"".join(prefix), "i8"), doc, n.astype("i4"), pos.astype("i4"), bits]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], [*_ROW])

    return map_batches(signatures.select("doc_id", "n", "bits", "prefix"), run, "key long, doc long, n int, pos int, bits long")


def _may_link(x: list[np.ndarray], y: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether rows ``(n, pos, bits)`` of one key can belong to a pair of that similarity whose first common shingle it is."""
    left = np.minimum(x[0] - x[1], y[0] - y[1])
    ok = left >= similarity / (1 + similarity) * (x[0] + y[0]) - _SLACK
    return ok & (np.bitwise_count((x[2] ^ y[2]).view("u8")) <= _most_bits(similarity))


def _most_bits(similarity: float) -> int:
    """``BITS`` at 0.8; at others as many standard deviations more than expected."""
    p = (1 - similarity) / 2
    return BITS if similarity == SIMILARITY else min(64, ceil(64 * p + 6.5 * (64 * p * (1 - p)) ** 0.5) + 1)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole keys, from rows sorted by key (the first column)."""
    open_: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = [c.to_numpy() for c in b.columns]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if open_ and (cut or now[0][0] != open_[-1][0][-1]):
            whole = int(np.searchsorted(now[0], open_[-1][0][-1], "right")) if not cut else cut
            open_.append([c[:whole] for c in now])
            yield [np.concatenate(c) for c in zip(*open_, strict=True)]
            open_, now = [], [c[whole:] for c in now]
        elif not open_ and cut:
            yield [c[:cut] for c in now]
            now = [c[cut:] for c in now]
        open_.append([c.copy() for c in now])
    if open_:
        yield [np.concatenate(c) for c in zip(*open_, strict=True)]


def _meet(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(doc, other)`` to verify, and the rows of crowded keys, whose ``other`` is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _by_key(batches):
            fresh = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))  # repeated rows of an id
            key, doc, *rest = (c[fresh] for c in cols)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            head = np.repeat(first, size)
            rank, crowd = np.arange(len(key)) - head, np.repeat(size > SMALL, size)
            found = [np.zeros((0, 2), "i8")]

            def take(at: np.ndarray, other: np.ndarray, found=found, doc=doc, rest=rest) -> None:
                ok = _may_link([c[at] for c in rest], [c[other] for c in rest], similarity)
                found.append(np.stack([doc[at[ok]], doc[other[ok]]], 1))

            for gap in range(1, SMALL):
                at = np.flatnonzero((rank >= gap) & (~crowd | (gap == 1)))
                take(at, at - gap)
            at = np.flatnonzero(crowd & (rank > 1))
            take(at, head[at])
            pairs = np.unique(np.concatenate(found), axis=0)
            none = pa.nulls(len(pairs), pa.int64())
            small = none.cast(pa.int32())
            yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), small, small, none, pa.array(pairs[:, 1])], [*_ROW, "other"])
            if crowd.any():
                held = [pa.array(c[crowd]) for c in (key, doc, *rest)]
                yield pa.RecordBatch.from_arrays([*held, pa.nulls(len(held[0]), pa.int64())], [*_ROW, "other"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "doc")
    return map_batches(dealt, run, "key long, doc long, n int, pos int, bits long, other long")


_HELD = (*_ROW, "group", "before")
_HELD_SQL = "key long, doc long, n int, pos int, bits long, group long, before binary"


def _no_earlier(before: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows have no shingle in common among those before the key."""
    out = np.ones(len(x), bool)
    size = np.array([*map(len, before)], "i8")
    shingle = np.unique(np.concatenate(before), return_inverse=True)[1]
    start = np.cumsum(size) - size
    for at in range(0, len(x), 20_000):
        sides = []
        for rows in (x[at : at + 20_000], y[at : at + 20_000]):
            n = size[rows]
            where = np.repeat(start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
            sides.append(np.repeat(np.arange(len(rows)), n) * (len(shingle) + 1) + shingle[where])
        both = np.concatenate(sides)
        both.sort()
        out[at + both[1:][both[1:] == both[:-1]] // (len(shingle) + 1)] = False
    return out


def _candidates(cols: list[np.ndarray], before: list[np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows ``(doc, n, pos, bits, group)`` of one key that are of different groups, may be similar, and meet under no earlier key."""
    _, n, pos, bits, group = cols
    if group.min() == group.max():
        return
    step = max(1, 500_000 // len(n))
    for at in range(0, len(n), step):
        own = slice(at, at + step)
        ok = group[own, None] != group[None, :]
        ok &= np.arange(len(n))[own, None] < np.arange(len(n))[None, :]
        ok &= _may_link([c[own, None] for c in (n, pos, bits)], [c[None, :] for c in (n, pos, bits)], similarity)
        x, y = np.nonzero(ok)
        x += at
        if len(x):
            first = _no_earlier(before, x, y)
            yield x[first], y[first]


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, from rows sorted by key (the first column)."""
    open_: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if open_ and open_[0].column(0)[0].as_py() != int(key[s]):
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(b.slice(s, e - s))
    if open_:
        yield pa.Table.from_batches(open_)


def _opened(t: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The numbers and the earlier shingles of a key's rows."""
    return [t[k].to_numpy() for k in _HELD[1:6]], [np.frombuffer(v, "i8") for v in t["before"].to_pylist()]


def _to_compare(crowds: DataFrame, groups: DataFrame, prefixes: DataFrame, similarity: float) -> DataFrame:
    """The rows of crowded keys that are in a pair of ``_candidates``; ``prefixes`` has a ``prefix`` for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches):
            cols, before = _opened(t)
            wanted = np.zeros(t.num_rows, bool)
            for x, y in _candidates(cols, before, similarity):
                wanted[x] = wanted[y] = True
            if wanted.any():
                yield from t.filter(pa.array(wanted)).to_batches()

    grouped = crowds.join(groups.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("group", F.coalesce("component", "doc"))
    apart = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
    rows = grouped.join(apart, "key", "left_semi").join(prefixes, "doc").withColumn("before", F.expr("substring(prefix, 1, 8 * pos)")).select(*_HELD)
    return map_batches(rows.repartition("key").sortWithinPartitions("key"), run, _HELD_SQL)


def _between_groups(rows: DataFrame, docs: DataFrame, chosen: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of documents of different groups under a crowded key: all pairs of ``_candidates`` that no link found before puts in one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches):
            cols, before = _opened(t)
            doc, group, sets = cols[0], cols[4].copy(), t["hashes"]
            found = []
            for x, y in _candidates(cols, before, similarity):
                for p, q in zip(x.tolist(), y.tolist(), strict=True):
                    if group[p] != group[q] and jaccard(np.frombuffer(sets[p].as_buffer(), "u8"), np.frombuffer(sets[q].as_buffer(), "u8")) >= similarity - _SLACK:
                        found.append((max(doc[p], doc[q]), min(doc[p], doc[q])))
                        group[group == group[q]] = group[p]
            a, b = np.array(found, "i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    table = written(_sets(docs, rows.select(F.col("doc").alias("doc_id")).distinct().join(chosen, "doc_id")), "shingles")
    with_sets = rows.join(table.withColumnRenamed("doc_id", "doc"), "doc").select(*_HELD, "hashes")
    out = checkpointed(map_batches(with_sets.repartition("key").sortWithinPartitions("key"), run, "a long, b long").distinct())
    removed(table)
    return out


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc_id, hashes)`` of the documents ``wanted(doc_id, digest)``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data = [shingle_set(t).tobytes() for t in b.column(1).to_pylist()]
            own = [xxhash.xxh3_128_digest(x) == d for x, d in zip(data, b.column(2).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "hashes"])
            yield out.filter(pa.array(own, pa.bool_()))

    return map_batches(_texts(docs).join(wanted, "doc_id"), sets, "doc_id long, hashes binary").dropDuplicates(["doc_id"])


def _verified(pairs: DataFrame, docs: DataFrame, chosen: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets have the similarity."""
    pairs = checkpointed(pairs)
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct().join(chosen, "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, y = ([np.frombuffer(v.as_buffer(), "u8") for v in b.column(k)] for k in (2, 3))
            near = [jaccard(p, q) >= similarity - _SLACK for p, q in zip(x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    table = written(_sets(docs, wanted), "shingles")
    both = pairs.join(table.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(table.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    out = checkpointed(map_batches(both, compare, "a long, b long"))
    removed(table)
    return out


def _proposed(rows: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of documents ``(doc_id, fp)`` whose fingerprints differ in two bits at most: through the document of the smallest id of each."""
    reps = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    equal = rows.join(reps, "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return equal.union(fingerprint_links(reps).select("a", "b"))


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, component_id)`` of the documents that are linked to another; ``component_id`` is their group's smallest id."""
    signatures = written(_signatures(docs, similarity), "signatures")
    chosen = checkpointed(signatures.groupBy("doc_id").agg(F.min("digest").alias("digest")))
    firsts = checkpointed(chosen.groupBy("digest").agg(F.min("doc_id").alias("doc_id")))
    copies = chosen.withColumnRenamed("doc_id", "a").join(firsts.withColumnRenamed("doc_id", "b"), "digest").where("a <> b").select("a", "b")
    one = signatures.join(firsts, ["doc_id", "digest"])
    met = written(_meet(_keys(one), similarity), "met")
    found = met.where("other is not null").select(F.greatest("doc", "other").alias("a"), F.least("doc", "other").alias("b"))
    links = _verified(found.union(_proposed(one.select("doc_id", "fp"))).distinct(), docs, firsts, similarity)
    crowds = met.where("other is null").select(*_ROW)
    if not crowds.isEmpty():
        rows = written(_to_compare(crowds, connected_components(links), one.select(F.col("doc_id").alias("doc"), "prefix").dropDuplicates(["doc"]), similarity), "crowds")
        links = links.union(_between_groups(rows, docs, firsts, similarity))
        removed(rows)
    out = connected_components(links.union(copies))
    removed(signatures, met)
    return out.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def one_of_each_group(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without those that are near-duplicates of a group with a smaller id."""
    gone = similar_groups(docs, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
