"""Mixture-controlled packing of token sequences.

Each source is a queue of token ids. A window of ``window`` tokens is filled by deficit round-robin: every queue's
deficit counter gains its quantum ``window * share``, gives its whole part to the window and carries the rest into the
next one; the largest queue takes what the others' fractions leave. The counter of queue *s* after *w* windows is
``w * quantum - floor(w * quantum)``, whatever came between, so a partition takes up the deficits just where the windows
before it, in other partitions, have left them, and all partitions are packed at once. Exact integer arithmetic is used.

Shares: the token proportions of the corpus, so that all queues end together, or given targets; with targets, a queue that
runs dry ends a phase and the others share on by their targets.

The last two windows take what is left in order of the queues; the last, incomplete one is cut into sequences whose lengths
are powers of two, which need no padding.

Each source is a queue, however many there are. Of more than ``QUEUES``, windows take the differences of the rounded cumulative sums of the
shares; sources with less than a token a window share a place in it, which they fill in the same way over stretches of 64 windows, or 64 times that.

Defined results: a null text is an empty one, whose ids are the end id alone; a null source is a queue of its own; an empty
table packs to no pieces; repeated rows are packed once each.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import map_batches, slices, table, written
from askwell.llm.words import WordIds

#: With as many queues at most, the largest always has room for what the others' fractions leave.
QUEUES = 64
WINDOW = 4096
END_ID = 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


#: The queue of null sources; those of others begin with another letter.
NO_SOURCE = "0"


def queue_of(source: str | None) -> str:
    return NO_SOURCE if source is None else "s" + source


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, queue, part, cum, n, ids)``: ids with the end id; ``cum`` tokens of the queue lie before it in its part."""
    source = F.col("source").cast("string")
    key = F.when(source.isNull(), NO_SOURCE).otherwise(F.concat(F.lit("s"), source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = word_ids(path), TaskContext.get().partitionId(), {}
        for b in slices(batches, 200, 2, 1 << 23):
            ids, begins = enc.encode_many(b.column(2), end_id)
            n, cum = np.diff(begins), []
            for q, m in zip(b.column(1).to_pylist(), n.tolist(), strict=True):
                cum.append(before.get(q, 0))
                before[q] = cum[-1] + m
            data = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((4 * begins).astype("<i4")), pa.py_buffer(ids.astype("<i4"))])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([part] * b.num_rows, pa.int32()), pa.array(cum, pa.int64()), pa.array(n, pa.int64()), data],
                ["doc_id", "queue", "part", "cum", "n", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("queue"), F.col("text").cast("string").alias("text"))
    return written(map_batches(rows, run, "doc_id long, queue string, part int, cum long, n long, ids binary"), "tokens")


class Mixture:
    """Windows of one phase: ``totals[s]`` tokens of each queue, all used up together.

    Window w takes tokens ``[taken(w)[s], taken(w + 1)[s])`` of queue s.
    """

    def __init__(self, totals: dict[str, int], window: int = WINDOW):
        self.window, self.total = window, sum(totals.values())
        by_size = sorted(totals, key=lambda q: (totals[q], q))
        self.order = {q: k for k, q in enumerate(by_size)}
        self.totals = [totals[q] for q in by_size]
        full, self.rest = divmod(self.total, window)
        #: From this window on, what is left lies in order of the queues.
        self.last = max(0, full - 1)
        self.taken = lru_cache(maxsize=4096)(self._taken)
        self.starts = lru_cache(maxsize=4096)(self._starts)

    def _taken(self, w: int) -> list[int]:
        """Tokens taken from each queue before window w."""
        if w > self.last:
            return self.totals
        got = [w * self.window * t // self.total for t in self.totals[:-1]]
        return [*got, w * self.window - sum(got)]

    def _starts(self, w: int) -> list[int]:
        """Where each queue's tokens begin within window w."""
        a, b, at, out = self.taken(w), self.taken(w + 1), 0, []
        for x, y in zip(a, b, strict=True):
            out.append(at)
            at += y - x
        return out

    def window_of(self, s: int, x: int) -> int:
        """The window that takes token x of queue s."""
        if s < len(self.totals) - 1:
            return min(self.last, ((x + 1) * self.total - 1) // (self.window * self.totals[s]))
        w = min(self.last, max(0, x * self.total // (self.window * self.totals[s]) - 2))
        while w > 0 and self.taken(w)[s] > x:
            w -= 1
        while w < self.last and self.taken(w + 1)[s] <= x:
            w += 1
        return w

    def pieces(self, s: int, x: int, n: int) -> Iterator[tuple[int, int]]:
        """``(position in the phase, length)`` of consecutive runs of the tokens x to x + n of queue s."""
        end = x + n
        while x < end:
            w = self.window_of(s, x)
            most = min(end, self.taken(w + 1)[s])
            yield w * self.window + self.starts(w)[s] + x - self.taken(w)[s], most - x
            x = most


class Nested:
    """As ``Mixture``, for any number of queues: window w takes of queue s what lies between the rounded cumulative sums of the shares
    before and after it, within one token of its share. ``order`` and ``totals`` go by the queues' names.
    """

    def __init__(self, totals: dict[str, int], window: int = WINDOW):
        self.window, self.total, self.totals = window, sum(totals.values()), totals
        self.order = {q: q for q in totals}
        self.last = max(0, self.total // window - 1)
        small = {q: n for q, n in totals.items() if n * window < self.total}
        self.inner = Nested(small, 64 * window) if small else None
        # What shares a place comes first, where its sums never fall; all others have a token a window at least.
        self.place, self.cum = dict.fromkeys(small, 0), [0, *([self.inner.total] if small else [])]
        for n, q in sorted((n, q) for q, n in totals.items() if q not in small):
            self.place[q] = len(self.cum) - 1
            self.cum.append(self.cum[-1] + n)

    def _before(self, k: int, w: int) -> int:
        """Tokens of the first k places before window w."""
        return self.cum[k] if w > self.last else w * self.window * self.cum[k] // self.total

    def _taken(self, k: int, w: int) -> int:
        return self._before(k + 1, w) - self._before(k, w)

    def _window_of(self, k: int, x: int) -> int:
        size = self.cum[k + 1] - self.cum[k]
        if k == 0:
            return min(self.last, ((x + 1) * self.total - 1) // (self.window * size))
        w = min(self.last, x * self.total // (self.window * size))
        while w > 0 and self._taken(k, w) > x:
            w -= 1
        while w < self.last and self._taken(k, w + 1) <= x:
            w += 1
        return w

    def pieces(self, queue: str, x: int, n: int) -> Iterator[tuple[int, int]]:
        k = self.place[queue]
        for p, m in self.inner.pieces(queue, x, n) if k == 0 and self.inner else ((x, n),):
            end = p + m
            while p < end:
                w = self._window_of(k, p)
                most = min(end, self._taken(k, w + 1))
                yield w * self.window + self._before(k, w + 1) - self._before(k, w) + p - self._taken(k, w), most - p
                p = most


class Layout:
    """Phases one after another, and the sequences that their positions fall into."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, window: int = WINDOW):
        self.window = window
        self.phases: list[tuple[int, dict[str, int], Mixture | Nested]] = []
        left, done, at = {q: n for q, n in totals.items() if n}, dict.fromkeys(totals, 0), 0
        while left:
            now = dict(left)
            if targets is not None:
                weight = {q: max(1, round(1_000_000 * targets.get(q, 1e-6))) for q in left}
                least = min(left, key=lambda q: (left[q] / weight[q], q))
                now = {q: left[least] * weight[q] // weight[least] for q in left}
                now = {q: min(left[q], n) for q, n in now.items()}
                if len(left) > 1 and (over := sum(now.values()) % window):  # whole windows, where queues remain
                    if sum(now.values()) > window and now != left:
                        largest = max(now, key=lambda q: (now[q], q))
                        now[largest] -= min(over, now[largest])
                now = {q: n for q, n in now.items() if n}
            mix = (Mixture if len(now) <= QUEUES else Nested)(now, window)
            self.phases.append((at, {q: done[q] for q in now}, mix))
            at += mix.total
            for q, n in now.items():
                done[q] += n
                left[q] -= n
            left = {q: n for q, n in left.items() if n}
        self.total = at
        full, rest = divmod(at, window)
        cuts, p = [], full * window
        for k in reversed(range(max(1, window.bit_length()))):
            if rest >> k & 1:
                cuts.append(p)
                p += 1 << k
        self.tail, self.full = [*cuts, p], full

    def pieces(self, queue: str, x: int, n: int) -> Iterator[tuple[int, int, int]]:
        """``(sequence, offset, length)`` of consecutive runs of tokens x to x + n of a queue."""
        for at, begun, mix in self.phases:
            if queue not in begun or n <= 0:
                continue
            s = mix.order[queue]
            first, end = begun[queue], begun[queue] + mix.totals[s]
            if not first <= x < end:
                continue
            m = min(n, end - x)
            for p, length in mix.pieces(s, x - first, m):
                yield from self._cut(at + p, length)
            x, n = x + m, n - m

    def _cut(self, p: int, n: int) -> Iterator[tuple[int, int, int]]:
        while n:
            w, offset = divmod(p, self.window)
            if w < self.full:
                m = min(n, self.window - offset)
            else:
                k = bisect_right(self.tail, p) - 1
                w, offset, m = self.full + k, p - self.tail[k], min(n, self.tail[k + 1] - p)
            yield w, offset, m
            p, n = p + m, n - m


def pack_documents(docs: DataFrame, path: str | None = None, targets: dict[str, float] | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])`` of all documents; ``targets`` by source.

    Tokenised once into a written table; the queues' totals and the carry of each part are sums over (part, queue). The
    pieces of a sequence, in order of ``offset``, are its tokens.
    """
    rows = tokenised(docs, path or default_vocabulary())
    spark = docs.sparkSession
    parts = rows.groupBy("queue", "part").agg(F.sum("n").alias("tokens"))
    carried = written(
        parts.selectExpr("queue", "part", "sum(tokens) over (partition by queue order by part) - tokens as base", "tokens"), "carried"
    )
    sums = carried.groupBy("queue").agg(F.sum("tokens").alias("t")).toArrow()  # a row a source
    totals = dict(zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True))
    targets = targets and {queue_of(source): share for source, share in targets.items()}
    layout = spark.sparkContext.broadcast((totals, targets, window))
    placed = rows.join(carried.select("queue", "part", "base"), ["queue", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, crc = Layout(*layout.value), zlib.crc32
        for b in slices(batches):
            out: list[list] = [[], [], [], [], [], [], [], []]
            doc, start, length, sums, tokens, seq, offset, kept = out
            for d, q, x, n, ids in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                at = 0
                for w, o, m in plan.pieces(q, x, n):
                    piece = ids[4 * at : 4 * (at + m)]
                    doc.append(d), start.append(at), length.append(m), sums.append(crc(piece)), tokens.append(n), seq.append(w), offset.append(o)
                    if with_ids:
                        kept.append(piece)
                    at += m
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:7]] + ([pa.array(kept, pa.binary())] if with_ids else []), names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"{c} long" for c in names[:7]) + ", ids binary" * with_ids
    return map_batches(placed.selectExpr("doc_id", "queue", "base + cum as x", "n", "ids"), run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
