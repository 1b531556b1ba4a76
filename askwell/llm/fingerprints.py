"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text's paragraphs are its lines, long ones cut after sentences. Each has a 64-bit digest (the k-th repeat of a paragraph has
its own). A sketch has ``cells`` cells in three equal rows; a digest adds one to the count, itself to the sum and its check hash
to the check sum of one cell in each row, all modulo 2^64. Subtracting two versions' sketches leaves the cells of the differing
digests alone; a cell with a count of +-1 whose sums agree gives up one of them, which is removed from its other cells, and so on
until all cells are empty. Where peeling stops short, both versions are sketched again at four times the size. The fingerprint that is returned is the
sketch of the first size, by which equal texts are told; likenesses of texts that differ in more than a dozen paragraphs rest on larger ones.

All of this is done for a batch of documents at once, in numpy.

Defined results: a null text is an empty one, which has no paragraphs; two empty ones are alike (1.0); rows of one id follow each
other in order of their compressed texts; a null id comes before all others; an only document is followed by itself; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import map_batches, table

CELLS = 18
#: Retries multiply the cells by this; beyond eight cells a digest the sets are compared themselves (never seen but by clashing digests).
GROW, ENOUGH = 4, 8
BUCKETS_PER_PARTITION = 4
BATCH = 256

_PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+")
_SENTENCE = re.compile(r".{20,200}?[.!?] +|.{1,200}(?: +|$)|.{1,200}", re.S)


def paragraphs(text: str | None) -> list[str]:
    """Lines, those of over 80 code points cut after sentences (else after words); joined they are the text."""
    out: list[str] = []
    for line in _PARAGRAPH.findall(text or ""):
        if len(line) <= 80:
            out.append(line)
        else:
            out += _SENTENCE.findall(line)
    return out


def digests(text: str | None) -> np.ndarray:
    """64-bit digests of a text's paragraphs; repeats of one are told apart by how many came before."""
    parts = paragraphs(text)
    if len(set(parts)) == len(parts):
        return np.array([*map(xxhash.xxh3_64_intdigest, parts)], "u8")
    seen: dict[str, int] = {}
    out = []
    for p in parts:
        k = seen[p] = seen.get(p, -1) + 1
        out.append(xxhash.xxh3_64_intdigest(p, k))
    return np.array(out, "u8")


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A fixed 64-bit mixing function, other for each salt."""
    x = x + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _cells_of(key: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    """Positions (3, n) of each key's cells in its owner's sketch."""
    row = cells // 3
    at = np.stack([(mixed(key, s) % np.uint64(row)).astype("i8") + s * row for s in range(3)])
    return at + owner * cells


class Sketches:
    """Sketches of ``n`` digest sets of one size."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, "i8")
        self.sum = np.zeros(n * cells, "u8")
        self.check = np.zeros(n * cells, "u8")

    def add(self, key: np.ndarray, owner: np.ndarray, sign: int | np.ndarray = 1) -> Sketches:
        """Put in ``key`` of ``owner``, or take out where ``sign`` is -1."""
        at = _cells_of(key, owner, self.cells)
        by = np.broadcast_to(np.asarray(sign, "i8"), key.shape)
        check = mixed(key, 7)
        for a in at:
            np.add.at(self.count, a, by)
            np.add.at(self.sum, a, key * by.astype("u8"))
            np.add.at(self.check, a, check * by.astype("u8"))
        return self

    def subtract(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.sum, out.check = self.count - other.count, self.sum - other.sum, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (digest, owner, sign) of a difference, and which owners came out whole. Empties the sketches."""
        keys, owners, signs = [], [], []
        at = np.flatnonzero(self.count)
        while True:
            at = at[abs(self.count[at]) == 1]
            sign = self.count[at]
            key = self.sum[at] * sign.astype("u8")
            pure = mixed(key, 7) * sign.astype("u8") == self.check[at]
            owner = at // self.cells
            pure &= (_cells_of(key, owner, self.cells) == at).any(0)
            if not pure.any():
                break
            found = np.unique(np.stack([owner[pure].astype("u8"), key[pure], sign[pure].astype("u8")], 1), axis=0)
            owner, key, sign = found[:, 0].astype("i8"), found[:, 1], found[:, 2].view("i8")
            self.add(key, owner, -sign)
            keys.append(key), owners.append(owner), signs.append(sign)
            at = np.unique(_cells_of(key, owner, self.cells).ravel())
        left = (self.count != 0) | (self.sum != 0) | (self.check != 0)
        whole = ~left.reshape(self.n, self.cells).any(1) if self.n else np.zeros(0, bool)
        none = np.zeros(0, "u8")
        return np.concatenate([none, *keys]), np.concatenate([none.astype("i8"), *owners]), np.concatenate([none.astype("i8"), *signs]), whole

    def packed(self) -> list[str]:
        """Each sketch as text: counts of 32 bits, then sums and check sums of 64, base64."""
        n = (self.n, self.cells)
        parts = [self.count.astype("<i4").reshape(n).view("u1"), self.sum.astype("<u8").reshape(n).view("u1"), self.check.astype("<u8").reshape(n).view("u1")]
        return [base64.b64encode(x.tobytes()).decode() for x in np.concatenate(parts, axis=1)] if self.n else []


def unpacked(texts: list[str], cells: int = CELLS) -> Sketches:
    """The sketches that ``packed`` gave as texts."""
    out = Sketches(len(texts), cells)
    raw = np.stack([np.frombuffer(base64.b64decode(t), "u1") for t in texts])
    out.count = np.ascontiguousarray(raw[:, : 4 * cells]).view("<i4").astype("i8").ravel()
    out.sum = np.ascontiguousarray(raw[:, 4 * cells : 12 * cells]).view("<u8").ravel().copy()
    out.check = np.ascontiguousarray(raw[:, 12 * cells :]).view("<u8").ravel().copy()
    return out


def sketched(sets: list[np.ndarray], cells: int = CELLS) -> Sketches:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return Sketches(len(sets), cells).add(np.concatenate([np.zeros(0, "u8"), *sets]), owner)


def differences(a: list[np.ndarray], b: list[np.ndarray], first: tuple[Sketches, Sketches] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets, those only in a and those only in b, recovered from sketches. ``first``: theirs of ``CELLS`` cells."""
    out: list = [None] * len(a)
    cells, todo = CELLS, list(range(len(a)))
    while todo:
        if first is not None and cells == CELLS:
            left = first[0].subtract(first[1])
        else:
            left = sketched([a[i] for i in todo], cells).subtract(sketched([b[i] for i in todo], cells))
        key, owner, sign, whole = left.peel()
        order = np.argsort(owner, kind="stable")
        key, sign, ends = key[order], sign[order], np.searchsorted(owner[order], np.arange(len(todo) + 1))
        again = []
        for k, i in enumerate(todo):
            if whole[k]:
                own, s = key[ends[k] : ends[k + 1]], sign[ends[k] : ends[k + 1]]
                out[i] = (own[s > 0], own[s < 0])
            elif cells > ENOUGH * (len(a[i]) + len(b[i])):
                out[i] = (np.setdiff1d(a[i], b[i]), np.setdiff1d(b[i], a[i]))
            else:
                again.append(i)
        cells, todo = cells * GROW, again
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """Twice the digests that both have over those of each, from 0 to 1."""
    return [1.0 - (len(x) + len(y)) / n if (n := len(p) + len(q)) else 1.0 for p, q, (x, y) in zip(a, b, found, strict=True)]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_paragraphs, fingerprint)`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                sets = [digests(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, sets), pa.int64()), pa.array(sketched(sets).packed(), pa.string())], [id_col, "n_paragraphs", "fingerprint"])

    t = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {t}, n_paragraphs long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt out in runs of ascending id: ``(bucket, doc_id, extra, z)``, z being the compressed text.

    The runs are cut at ids that are in the table, so the first document of each run is known; it is sent once more, as
    ``extra``, to the run before it (the first of all to the last run). The text moves once, compressed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select(F.coalesce("doc_id", F.lit(-(2**63))).cast("double").alias("x"), F.coalesce("doc_id", F.lit(-(2**63))).alias("i"))
    least = ids.agg(F.min("i")).first()[0]
    if least is None:
        cuts = np.zeros(1, "i8")
    else:
        around = ids.agg(F.expr(f"percentile_approx(i, array({','.join(str(k / n) for k in range(1, n))}), {4 * n})")).first()[0] if n > 1 else []
        cuts = np.unique(np.array([least, *around], "i8"))  # at most n numbers, all of them ids

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                given = part.column(0).to_pylist()
                key = np.array([-(2**63) if i is None else i for i in given], "i8")
                bucket = np.searchsorted(cuts, key, "right") - 1
                z = [press((t or "").encode()) for t in part.column(1).to_pylist()]
                first = np.flatnonzero(cuts[bucket] == key)
                pick = [*range(len(key)), *first.tolist()]
                to = np.concatenate([bucket, (bucket[first] - 1) % len(cuts)])
                extra = np.arange(len(pick)) >= len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array([given[i] for i in pick], pa.int64()), pa.array(extra), pa.array([z[i] for i in pick], pa.binary())],
                    ["bucket", "doc_id", "extra", "z"],
                )

    dealt = map_batches(rows, deal, "bucket int, doc_id long, extra boolean, z binary").repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "extra", F.asc_nulls_first("doc_id"), "z")


def compared_with_edits(docs: DataFrame) -> DataFrame:
    """Every text against its edited text (its last half replaced by the start of the next document) and against the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_sketch = zstandard.ZstdDecompressor().decompress

        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)

        def pairs() -> Iterator[tuple]:
            """(id, text, next text); of a run's extra rows the first follows its last row."""
            now, done = None, False
            for bucket, doc, extra, z in rows():
                if now is not None and now[0] == bucket and not done:
                    text = open_sketch(z).decode()
                    yield now[1], now[2], text
                    now, done = (bucket, doc, text), extra
                elif now is None or now[0] != bucket:
                    now, done = (bucket, doc, open_sketch(z).decode()), extra

        todo: list[tuple] = []
        for pair in pairs():
            todo.append(pair)
            if len(todo) == BATCH:
                yield compared(todo)
                todo = []
        if todo:
            yield compared(todo)

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        sha = hashlib.sha256
        ids, texts, following = map(list, zip(*rows, strict=True))
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, following, strict=True)]
        a, b = [digests(t) for t in texts], [digests(t) for t in edited]
        c = [x for x in a[1:]] + [digests(following[-1])]
        for k in range(len(rows) - 1):  # where a run ends, the next row isn't the next document
            if following[k] != texts[k + 1]:
                c[k] = digests(following[k])
        sa, sb, sc = sketched(a), sketched(b), sketched(c)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([sha(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(sa.packed(), pa.string()), pa.array(sb.packed(), pa.string()),
                pa.array(likeness(a, b, differences(a, b, (sa, sb))), pa.float64()), pa.array(likeness(a, c, differences(a, c, (sa, sc))), pa.float64()),
            ],
            names,
        )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_batches(with_next(docs), run, schema)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_edits(table(spark, sf_dir, "documents"))
