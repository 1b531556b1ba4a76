"""Quality by co-training a text view and a metadata view.

Text view: shares of character classes, of repeated words, word lengths. Metadata view: source, language, length, and the page's layout: how
many lines it has, how long they are, how many are alike. Each has a logistic model. In every round either model labels the unlabelled texts
that it is most sure of, at most ``PER_ROUND`` of each class and only beyond ``SURE``, and they join the *other* view's training rows.

Then each view is judged on labelled rows held out from its model, which is fitted as the final one is, with the rows it was given: a
view keeps these only if they don't make its calibrated loss there worse. On the held-out logits the views are calibrated, and a logistic
model with weights that aren't negative combines them; it is fitted on logits whose calibration has not seen the row's fold.

The models are fitted on at most ``LABELLED`` labelled rows of each class (smallest hashes of the id). Mean and scale of the text
features are those of all documents, and in every round all unlabelled documents are judged; all documents are scored, whole.

Defined results: null and empty texts have zero text features; unknown sources share hashed slots; without labels, or with labels of one
class, the chance is that of the smoothed rate; of several labels of an id the largest counts; repeated rows are scored alike; documents of equal
chances are taken by their ids; an empty table gives no rows; only the named columns are returned, whatever others there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import map_batches, removed, slices, table, written
from askwell.llm.linear import calibration, combination, fit_logistic, sigmoid

LABELLED = 3000
CO_ROUNDS, PER_ROUND, SURE = 4, 200, 0.97
FOLDS = 5
KEEP = 0.5
SLOTS = 64

_PUNCTUATION = b"|!%*$&#<>{}[]()=_~^+/\\;:.,?-'\""


#: Numbers of features of the views.
TEXT, LAYOUT = len(_PUNCTUATION) + 11, 6
META = SLOTS + 16 + 24 + LAYOUT


def text_features(text: str | None) -> list[float]:
    """The text view of one whole text."""
    data = (text or "").encode()
    n = len(data)
    if not n:
        return [0.0] * TEXT
    share = np.bincount(np.frombuffer(data, "u1"), minlength=256) / n
    words = text.split()
    k = len(words) or 1
    out = [*np.sqrt(share[list(_PUNCTUATION)])]
    out += [np.sqrt(share[48:58].sum()), np.sqrt(share[65:91].sum()), share[97:123].sum(), share[128:].sum(), share[32]]
    out += [len(set(words)) / k, np.sqrt(sum(map(str.__eq__, words, words[1:])) / k)]
    out += [min(20.0, n / k) / 20, np.log1p(k) / 10, float(share[46] == 0), min(1.0, max(map(len, words), default=0) / 100)]
    return out


def layout_features(text: str | None) -> list[float]:
    """Of the lines alone."""
    size = [*map(len, lines := (text or "").split("\n"))]
    n = len(size)
    return [np.log1p(n) / 10, np.log1p(sum(size) / n) / 10, np.log1p(max(size)) / 15, len(set(lines)) / n, sum(x == 0 for x in size) / n, sum(0 < x < 40 for x in size) / n]


def metadata_features(source: str | None, lang: str | None, n_chars: int | None, text: str | None) -> np.ndarray:
    """The metadata view: hashed source and language, length in steps, layout."""
    out = np.zeros(META)
    out[zlib.crc32((source or "").encode()) % SLOTS] = 1
    out[SLOTS + zlib.crc32((lang or "").encode()) % 16] = 1
    size = np.log2(1 + max(0, n_chars or 0))
    out[SLOTS + 16 + min(22, int(size))] = 1
    out[SLOTS + 16 + 23] = size / 20
    out[-LAYOUT:] = layout_features(text)
    return out


@dataclass(frozen=True)
class Views:
    """Both views' models: mean and scale of the text features, weights, calibrations, and the combination."""

    mean: np.ndarray
    scale: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    calibrated: tuple[tuple[float, float], tuple[float, float]]
    combined: np.ndarray
    added: tuple[int, int]

    def spread(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z], axis=1)

    def chances(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Chances (rows, 3): by text, by metadata, by both."""
        z = np.stack([self.spread(x) @ self.text[:-1] + self.text[-1], m @ self.meta[:-1] + self.meta[-1]], 1)
        for k, (slope, constant) in enumerate(self.calibrated):
            z[:, k] = slope * z[:, k] + constant
        return sigmoid(np.concatenate([z, (z @ self.combined[:-1] + self.combined[-1])[:, None]], axis=1))


#: An unlabelled document that a view is given: its id, label and both views' features.
Given = tuple[int, int, np.ndarray, np.ndarray]


def fold_of(ids: np.ndarray) -> np.ndarray:
    """A fixed fold for each id, so that rows of one id share it."""
    return ((ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FOLDS)).astype("i8")


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -z, z)))) if len(y) else 0.0


def co_train(
    x: np.ndarray, m: np.ndarray, y: np.ndarray, fold: np.ndarray, mean: np.ndarray, scale: np.ndarray, surest: Callable[[int, np.ndarray, list[int]], list[Given]], rounds: int = CO_ROUNDS
) -> Views:
    """``x``, ``m``: labelled rows' views; ``surest(k, weights, but)``: those of all unlabelled documents that view k is surest of, without some ids."""
    base = Views(mean, scale, np.zeros(0), np.zeros(0), ((1, 0), (1, 0)), np.zeros(0), (0, 0))
    views = [base.spread(x), m]
    taken: list[dict[int, tuple[int, np.ndarray]]] = [{}, {}]  # unlabelled rows that each view was given: label and the view's features

    def model(k: int, without: int | None = None) -> np.ndarray:
        own, given = fold != without if without is not None else np.ones(len(y), bool), [*taken[k].values()]
        rows = np.concatenate([views[k][own], *(f[None] for _, f in given)])
        return fit_logistic(rows, np.concatenate([y[own], [label for label, _ in given]]), shrink=1e-3, weight=np.append(np.ones(own.sum()), np.full(len(given), 0.5)))

    def held_out(k: int) -> np.ndarray:
        z = np.zeros(len(y))
        for f in range(FOLDS):
            w, own = model(k, f), fold == f
            z[own] = views[k][own] @ w[:-1] + w[-1]
        return z

    if not len(y) or y.min() == y.max():
        alone = model(0)
        return Views(mean, scale, alone, model(1), ((1.0, 0.0), (0.0, 0.0)), np.array([1.0, 0.0, 0.0]), (0, 0))
    for _ in range(rounds):
        for k in (0, 1):
            for i, label, fx, fm in surest(k, model(k), [*taken[1 - k]]):
                taken[1 - k][i] = label, fm if k == 0 else base.spread(fx[None])[0]

    def calibrated_out(h: np.ndarray) -> np.ndarray:
        """Held-out logits, each calibrated without its fold."""
        z = np.zeros(len(y))
        for f in range(FOLDS):
            slope, constant = calibration(h[fold != f], y[fold != f])
            z[fold == f] = slope * h[fold == f] + constant
        return z

    held, z = [], np.zeros((len(y), 2))
    for k in (0, 1):
        h, given = held_out(k), taken[k]
        z[:, k] = calibrated_out(h)
        if given:
            taken[k] = {}
            before = held_out(k)
            if log_loss(z[:, k], y) <= log_loss(alone := calibrated_out(before), y):
                taken[k] = given
            else:
                h, z[:, k] = before, alone
        held.append(h)
    ways = [calibration(h, y) for h in held]
    return Views(mean, scale, model(0), model(1), (ways[0], ways[1]), combination(z, y), (len(taken[0]), len(taken[1])))


_META = ("source", "lang", "n_chars")


def _views(batch: pa.RecordBatch, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    text, source, lang, n = (batch.column(i).to_pylist() for i in at)
    x = np.array([text_features(t) for t in text]).reshape(len(text), TEXT)
    return x, np.array([metadata_features(*r) for r in zip(source, lang, n, text, strict=True)]).reshape(len(text), META)


_WIDTHS = (TEXT, META)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "f8").reshape(len(column), width)


def _features(docs: DataFrame) -> DataFrame:
    """``(doc_id, x binary, m binary)`` of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, m = _views(b, [1, 2, 3, 4])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r.tobytes() for r in v.astype("f8")], pa.binary()) for v in (x, m))], ["doc_id", "x", "m"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).cast(t) for c, t in zip(_META, ("string", "string", "long"), strict=True)))
    return map_batches(rows, run, "doc_id long, x binary, m binary")


def _mean_and_scale(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of the text features of all documents, from one row of sums a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(_WIDTHS[0]), np.zeros(_WIDTHS[0])
        for b in batches:
            x = _matrix(b.column(0), _WIDTHS[0])
            n, one, two = n + len(x), one + x.sum(0), two + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([v.tobytes()], pa.binary()) for v in (one, two))], ["n", "one", "two"])

    got = sorted((tuple(r) for r in map_batches(rows.select("x"), run, "n long, one binary, two binary").collect()))
    n = sum(r[0] for r in got)
    if not n:
        return np.zeros(_WIDTHS[0]), np.ones(_WIDTHS[0])
    mean, square = (np.sum([np.frombuffer(r[k]) for r in got], axis=0) / n for k in (1, 2))
    return mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6


def _surest(pool: DataFrame, mean: np.ndarray, scale: np.ndarray) -> Callable[[int, np.ndarray, list[int]], list[Given]]:
    """For ``co_train``: each task names its surest of either class, and the surest of those are taken, at most ``PER_ROUND`` of each class."""
    base = Views(mean, scale, np.zeros(0), np.zeros(0), ((1, 0), (1, 0)), np.zeros(0), (0, 0))

    def of(k: int, w: np.ndarray, but: list[int]) -> list[Given]:
        gone = np.array(but, "i8")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, dict[int, tuple[float, bytes, bytes]]] = {0: {}, 1: {}}
            for b in batches:
                ids, f = b.column(0).to_numpy(), _matrix(b.column(1 + k), _WIDTHS[k])
                p = sigmoid((f if k else base.spread(f)) @ w[:-1] + w[-1])
                for label, sure in ((1, p), (0, 1 - p)):
                    at, held = np.flatnonzero((sure > SURE) & ~np.isin(ids, gone)), best[label]
                    at = at[np.lexsort((ids[at], -sure[at]))]
                    taken = set()
                    for i in at.tolist():
                        d = int(ids[i])
                        if d not in taken:
                            taken.add(d)
                            new = (float(sure[i]), b.column(1)[i].as_py(), b.column(2)[i].as_py())
                            held[d] = max(held.get(d, new), new)
                            if len(taken) == PER_ROUND:
                                break
                    best[label] = dict(sorted(held.items(), key=lambda r: (-r[1][0], r[0]))[:PER_ROUND])
            rows = [(label, d, *v) for label, held in best.items() for d, v in held.items()]
            cols = [[r[j] for r in rows] for j in range(5)]
            types = (pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["label", "doc_id", "sure", "x", "m"])

        found = map_batches(pool.select("doc_id", "x", "m"), run, "label int, doc_id long, sure double, x binary, m binary")
        # An id with rows in several tasks counts by its surest.
        found = found.groupBy("label", "doc_id").agg(F.max(F.struct("sure", "x", "m")).alias("v")).select("label", "doc_id", "v.*")
        top = None
        for label in (1, 0):
            some = found.where(f"label = {label}").orderBy(F.desc("sure"), "doc_id").limit(PER_ROUND)
            top = some if top is None else top.union(some)
        got = sorted(top.collect(), key=lambda r: (-r["label"], -r["sure"], r["doc_id"]))
        return [(r["doc_id"], r["label"], np.frombuffer(r["x"]), np.frombuffer(r["m"])) for r in got]

    return of


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = CO_ROUNDS) -> Views:
    """Both views, from a bounded sample of the labelled rows and all unlabelled documents; the features of all are written once."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)").dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    every = written(_features(docs), "quality")
    parts = [rows.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled) for y in (0, 1)]
    chosen = every.join(F.broadcast(parts[0].union(parts[1])), "doc_id")  # at most 2 * labelled ids
    got = sorted(tuple(r) for r in chosen.select("doc_id", "y", "x", "m").collect())
    x, m = (np.frombuffer(b"".join(r[k] for r in got), "f8").reshape(len(got), w) for k, w in zip((2, 3), _WIDTHS, strict=True))
    y = np.array([r[1] for r in got], "i8")
    mean, scale = _mean_and_scale(every)
    pool = written(every.where("doc_id is not null").join(rows, "doc_id", "left_anti"), "quality-pool")
    views = co_train(x, m, y, fold_of(np.array([r[0] for r in got], "i8")), mean, scale, _surest(pool, mean, scale), rounds)
    removed(every, pool)
    return views


def score_documents(docs: DataFrame, views: Views) -> DataFrame:
    """``(doc_id, p_text, p_meta, quality_score)`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = views.chances(*_views(b, [1, 2, 3, 4]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(3))], ["doc_id", "p_text", "p_meta", "quality_score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    return map_batches(rows, run, "doc_id long, p_text double, p_meta double, quality_score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chances, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    views = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, views).withColumn("keep", F.col("quality_score") > KEEP)
