"""Toxicity by a classifier chain over words and word beginnings.

Categories are predicted in order. Each has a linear model of word features; from the second on it also gets the logits of
the categories before it. So that it learns from predictions as they are on unseen texts, those logits are out of fold while
training: each comes from a model that has not seen the row's fold, with features that were chosen without it. How much a
category's weights are shrunk is decided by the loss on these held-out rows.

Features: whole lower-cased words, and their beginnings of four to six letters, present or not. Of those of the training rows ``FEATURES`` at
most are chosen for each category, by how much more often its texts have them; so words that no label speaks of weigh nothing,
and long clean texts stay clean. Executors count all features of the training rows, and give the driver only which of the chosen ones a row has.
The model is fitted on at most ``PER_CLASS`` labelled rows with a category and as many without (smallest hash of the id); everything else
covers all rows whole.

``labels`` may have any number of category columns. The table of the query has one label, ``toxic``; its chain is ``repeated``
(toxic, with three or more marked words; a word is marked by the features chosen without the row's fold), then ``toxic``, which decides.

Defined results: null and empty texts have no features and get the model's base chance; without labels, or with labels of one class, every
chance is that of the smoothed rate; labels that are null or name no document are left out, of several labels of an id the largest counts;
repeated rows are scored alike; an empty table gives no rows; other columns pass through, but for those named like a chance.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import map_batches, removed, slices, table, written
from askwell.llm.linear import Marks, fit_logistic, sigmoid

PER_CLASS = 1500
FEATURES = 1024
FOLDS = 5
MARKED = 3
#: Counted features that a task holds before it sends their sums on.
HELD = 100_000
#: Texts more likely than this to be toxic are rejected.
REJECT = 0.5
#: Shrinkages that are tried on held-out folds, and how long a model is fitted: marked words are rare, so their weights take many rounds.
SHRINK, ROUNDS = (1e-3, 1e-4, 1e-5), 1000

_WORDS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> set[str]:
    """The word, and its beginnings (marked with a star)."""
    return {word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n)}


def _words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


class Features:
    """Chosen features by number."""

    def __init__(self, names: Sequence[str]):
        self.number = {f: i for i, f in enumerate(names)}
        self.starts = frozenset(f.rstrip("*")[:4] for f in names)

    def found(self, text: str | None) -> list[int]:
        """Those that a text has."""
        out: set[int] = set()
        for w in set(_words(text)):
            if w[:4] in self.starts:
                out.update(self.number[f] for f in word_features(w) if f in self.number)
        return sorted(out)

    def marked(self, text: str | None) -> int:
        """Words of a text that have one, repeats included."""
        return sum(1 for w in _words(text) if w[:4] in self.starts and any(f in self.number for f in word_features(w)))


@dataclass(frozen=True)
class Chain:
    """The features, and the weights of each category in order: of the features, of the logits before, and the constant."""

    categories: tuple[str, ...]
    features: Features
    weights: tuple[np.ndarray, ...]

    def logits(self, texts: Sequence[str | None]) -> np.ndarray:
        """Logits (texts, categories)."""
        n, out = len(self.features.number), np.zeros((len(texts), len(self.categories)))
        found = [self.features.found(t) for t in texts]
        for k, w in enumerate(self.weights):
            own = np.array([w[f].sum() if f else 0.0 for f in found])
            out[:, k] = own + np.clip(out[:, :k], -8, 8) @ w[n:-1] + w[-1]
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, text, fold, any, y array)`` of at most ``per_class`` labelled ids with a category, and as many without."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"`{c}`").cast("int").alias(f"y{k}") for k, c in enumerate(categories)))
    valid = " and ".join(f"y{k} in (0, 1)" for k in range(len(categories)))
    rows = rows.where(f"doc_id is not null and {valid}").groupBy("doc_id").agg(F.array(*(F.max(f"y{k}") for k in range(len(categories)))).alias("y"))
    rows = rows.withColumn("any", F.array_max("y")).withColumn("fold", F.expr(f"cast(pmod(xxhash64(doc_id, 11), {FOLDS}) as int)"))
    parts = [rows.where(f"any = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    some = F.broadcast(parts[0].union(parts[1]))  # at most 2 * per_class rows of a few numbers
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(some, "doc_id").select("doc_id", "text", "fold", "any", "y")


def _slot(category: int, fold: int, y: int) -> int:
    return 2 * (category * FOLDS + fold) + y


def _counts(sample: DataFrame, categories: int) -> DataFrame:
    """``(feature, n0, n1, ...)``: rows that have the feature, by ``_slot``."""
    slots = 2 * FOLDS * categories

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = defaultdict(lambda: [0] * slots)

        def sums() -> pa.RecordBatch:
            cols = [pa.array([*held], pa.string()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in range(slots))]
            return pa.RecordBatch.from_arrays(cols, ["feature", *(f"n{k}" for k in range(slots))])

        for b in batches:
            for text, fold, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = [_slot(c, fold, v) for c, v in enumerate(y)]
                for f in set().union(*map(word_features, set(_words(text)))):
                    n = held[f]
                    for k in own:
                        n[k] += 1
                if len(held) > HELD:
                    yield sums()
                    held.clear()
        if held:
            yield sums()

    rows = map_batches(sample.select("text", "fold", "y"), run, "feature string, " + ", ".join(f"n{k} long" for k in range(slots)))
    return rows.groupBy("feature").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(slots)))


def choose_features(sample: DataFrame, categories: int = 1, most: int = FEATURES) -> list[list[str]]:
    """The features that rows of some category have far more often, a category's best first: chosen from all rows, then without each fold in turn."""
    size = [0] * (2 * FOLDS * categories)
    for r in sample.select("fold", F.posexplode("y").alias("c", "v")).groupBy("fold", "c", "v").count().collect():
        size[_slot(r["c"], r["fold"], r["v"])] = r["count"]
    counts = written(_counts(sample, categories), "features")
    out = []
    for without in (None, *range(FOLDS)):
        folds, chosen = [k for k in range(FOLDS) if k != without], {}
        for c in range(categories):
            pos, neg = (max(1, sum(size[_slot(c, k, y)] for k in folds)) for y in (1, 0))
            have, lack = (" + ".join(f"n{_slot(c, k, y)}" for k in folds) for y in (1, 0))
            rows = counts.selectExpr("feature", f"{have} as have", f"({have}) / {pos}D as p", f"({lack} + 0.5D) / {neg}D as q").where(f"have >= {2 if pos < 200 else 4} and p >= 5 * q")
            best = rows.selectExpr("feature", f"round((p - q) / sqrt(p / {pos} + q / {neg}), 9) as score").orderBy(F.desc("score"), "feature").limit(most)
            chosen |= dict.fromkeys(r["feature"] for r in best.collect())
        out.append([*chosen])
    removed(counts)
    return out


def _vectors(sample: DataFrame, names: list[str], without: list[Features]) -> list[tuple]:
    """``(doc_id, fold, y, numbers of the features, marked words)`` of each row, in order."""
    every = Features(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            text, fold = b.column(1).to_pylist(), b.column(2).to_pylist()
            found = [np.array(every.found(t), "<i4").tobytes() for t in text]
            marked = [without[k].marked(t) for t, k in zip(text, fold, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(found, pa.binary()), pa.array(marked, pa.int64())], ["doc_id", "fold", "y", "found", "marked"])

    rows = map_batches(sample.select("doc_id", "text", "fold", "y"), run, "doc_id long, fold int, y array<int>, found binary, marked long")
    return sorted(tuple(r) for r in rows.collect())


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("toxic",), per_class: int = PER_CLASS, repeated: bool | None = None) -> Chain:
    """The chain of the label's categories; ``repeated`` comes before them if it is asked for, or if there is one category."""
    repeated = len(categories) == 1 if repeated is None else repeated
    sample = written(labelled_sample(docs, labels, categories, per_class), "labelled")
    chosen = choose_features(sample, len(categories))
    names = sorted(set().union(*chosen))
    rows = _vectors(sample, names, [Features(f) for f in chosen[1:]])
    removed(sample)
    y = np.array([r[2] for r in rows], "i8").reshape(len(rows), len(categories))
    if repeated:
        y = np.concatenate([(y[:, -1:] == 1) & (np.array([[r[4]] for r in rows], "i8").reshape(-1, 1) >= MARKED), y], 1).astype("i8")
    fold = np.array([r[1] for r in rows], "i8")
    cols = [np.frombuffer(r[3], "<i4") for r in rows]
    at, cols = np.repeat(np.arange(len(rows)), [*map(len, cols)]), np.concatenate([np.zeros(0, "i4"), *cols])
    number = {f: i for i, f in enumerate(names)}

    def marks(features: list[str], before: np.ndarray) -> Marks:
        place = np.full(len(names), -1)
        place[[number[f] for f in features]] = np.arange(len(features))
        own = place[cols] >= 0 if len(cols) else np.zeros(0, bool)
        return Marks(at[own], place[cols[own]], len(features), before)

    weights, before = [], np.zeros((len(rows), 0))
    for k in range(y.shape[1]):
        own, best = y[:, k].astype(float), None
        parts = [(fold == held, marks(chosen[1 + held], before)) for held in range(FOLDS)]
        for shrink in SHRINK:
            z = np.zeros(len(rows))
            for held, x in parts:
                w = fit_logistic(x[~held], own[~held], shrink=shrink, rounds=ROUNDS)
                z[held] = x[held] @ w[:-1] + w[-1]
            loss = np.mean(np.logaddexp(0, np.where(own == 1, -z, z))) if len(z) else 0.0
            if best is None or loss < best[0]:
                best = loss, shrink, z
        weights.append(fit_logistic(marks(chosen[0], before), own, shrink=best[1], rounds=ROUNDS))
        before = np.concatenate([before, np.clip(best[2], -8, 8)[:, None]], axis=1)
    return Chain((*(["repeated"] if repeated else []), *categories), Features(chosen[0]), tuple(weights))


def score_documents(docs: DataFrame, chain: Chain, prefix: str = "p_") -> DataFrame:
    """``docs`` with a chance ``<prefix><category>`` for each category, in place of columns of that name."""
    add = [prefix + c for c in chain.categories]
    docs = docs.drop(*add)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = sigmoid(chain.logits(b.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(len(add)))], [*names, *add])

    schema = docs.limit(0).select("*", *(F.lit(0.0).alias(c) for c in add)).schema
    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, p_repeated, p_toxic, toxic)`` of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, chain).select("doc_id", "p_repeated", "p_toxic", (F.col("p_toxic") > REJECT).alias("toxic"))
