"""Scoring passages against questions, calibration, projections of answers, and the cache of scored rows.

A question is ``Question(qid, type, instructions, options)``; questions are few, and ride along as a literal array, so passages x
questions is an ``explode`` within the row, not a join. A scorer turns the rows into logits. ``LexicalScorer`` is plain expressions;
``ArrowScorer`` hands Arrow batches, sorted by length within a partition, to any model that is loaded once a Python worker. ``CachedScorer`` asks
either only what it hasn't asked before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askwell.functions.vectors import best_key, entropy_confidence, expected_level, quoted, rounded, softmax, terms
from askwell.operators.retrieval import query_terms

TYPES = ("noul", "choice", "score")


@dataclass(frozen=True)
class Question:
    """``noul``: a yes/no probability; ``choice``: one of named options; ``score``: a rung of an ordered list."""

    qid: str
    type: str
    instructions: str
    options: tuple[tuple[str, str | None], ...] = ()
    #: A choice question and the option that stands for yes, used in its place where a document has several passages.
    detector: Question | None = None
    detector_key: str | None = None
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"no such type: {self.type}")
        if self.detector is not None and self.type != "noul":
            raise ValueError("only a noul question can have a detector")

    @property
    def keys(self) -> list[str]:
        return ["false", "true"] if self.type == "noul" else [k for k, _ in self.options]


def query_text(q: Question, skip_null: bool = False) -> str:
    """The text by which passages are ranked: instructions and the options' meanings, never their names.

    A null meaning counts as the word None unless ``skip_null``. The rungs of a score are its options' names.
    """
    if q.type == "score":
        meanings: list[str | None] = [k for k, _ in q.options]
    else:
        meanings = [m for _, m in q.options]
    return " ".join([q.instructions, *("None" if m is None else m for m in meanings if not (skip_null and m is None))])


def _array(items: Sequence[str], kind: str = "string") -> str:
    return f"cast(array({', '.join(items)}) as array<{kind}>)"


SCORES = "array<struct<qid: string, type: string, keys: array<string>, logits: array<double>, act: double, seq_len: bigint>>"


class Scorer:
    """``scores`` is what a scorer has to give; the rest follows from it."""

    #: Most options a question may have; none where it doesn't matter.
    max_options: int | None = None

    def scores(self, rows: DataFrame, questions: Sequence[Question], asked: str | None = None) -> DataFrame:
        """``rows`` with ``_scores``: an entry ``(qid, type, keys, logits, act, seq_len)`` for each question of those that the array ``asked`` names, or for all.

        ``act`` is the chance that the model would act on the row at all, where it says so.
        """
        raise NotImplementedError

    def check(self, questions: Sequence[Question]) -> None:
        """Refuses questions with more options than the scorer can tell apart."""
        for q in questions:
            if self.max_options is not None and len(q.keys) > self.max_options:
                raise ValueError(f"question {q.qid!r} has {len(q.keys)} options; the scorer can tell {self.max_options} apart")

    def score(self, rows: DataFrame, questions: Sequence[Question]) -> DataFrame:
        """``rows`` once for each question, with ``qid, type, keys, logits, act, seq_len``."""
        out = self.scores(rows, questions).withColumn("_q", F.explode_outer("_scores")).drop("_scores")
        return out.select("*", "_q.*").drop("_q")


class LexicalScorer(Scorer):
    """Logits from word overlap: ln(1 + common different terms) for an option; for noul 0 and ``slope`` x common terms - ``bias``."""

    def __init__(self, slope: float = 1.0, bias: float = 1.0):
        self.slope, self.bias = slope, bias

    def logits(self, q: Question, terms_col: str = "_terms") -> str:
        def common(text: str) -> str:
            return f"size(array_intersect({terms_col}, {_array([quoted(t) for t in dict.fromkeys(query_terms(text))])}))"

        if q.type == "noul":
            return f"array(0D, {self.slope}D * {common(q.instructions)} - {self.bias}D)"
        if q.type == "score":
            return f"array({', '.join(f'ln(1D + {common(k)})' for k, _ in q.options)})"
        return f"array({', '.join(f'ln(1D + {common(m or k)})' for k, m in q.options)})"

    def scores(self, rows: DataFrame, questions: Sequence[Question], asked: str | None = None) -> DataFrame:
        self.check(questions)
        known = sorted({t for q in questions for t in query_terms(" ".join([q.instructions, *(m or k for k, m in q.options), *q.keys]))}) or [""]
        made = []
        for q in questions:
            entry = f"named_struct('qid', {quoted(q.qid)}, 'type', {quoted(q.type)}, 'keys', {_array([quoted(k) for k in q.keys])}, 'logits', {self.logits(q)}, 'act', cast(null as double), 'seq_len', cast(_size + {len(query_terms(query_text(q)))} as bigint))"
            made.append(entry if asked is None else f"case when array_contains({asked}, {quoted(q.qid)}) then {entry} end")
        out = rows.withColumn("_all", terms("text")).withColumn("_size", F.size("_all"))
        # Of the passage's terms only those that some question has matter.
        out = out.withColumn("_terms", F.expr(f"array_distinct(filter(_all, __t -> __t in ({', '.join(map(quoted, known))})))")).drop("_all")
        return out.withColumn("_scores", F.expr(f"array_compact(array({', '.join(made)}))")).drop("_size", "_terms")


class ArrowScorer(Scorer):
    """Scores by ``factory() -> fn(texts, question) -> list of logits`` (or of logits and act chances).

    The factory runs once for each Python worker and ``name``, which tells models apart. Rows come in order of their length, ``batch_size`` at a time;
    a question sees those that ask it. ``model.seq_len(text, question)``, if there is one, counts a row's tokens; else its characters are counted.
    """

    def __init__(self, factory: Callable[[], Callable[[list[str], Question], list]], batch_size: int = 16, max_options: int | None = None, name: str | None = None):
        self.factory, self.batch_size, self.max_options, self.name = factory, batch_size, max_options, name or uuid.uuid4().hex

    def scores(self, rows: DataFrame, questions: Sequence[Question], asked: str | None = None) -> DataFrame:
        self.check(questions)
        factory, size, names, name = self.factory, self.batch_size, rows.columns, self.name
        at, by = names.index("text"), {q.qid: q for q in questions}
        asked_at = names.index(asked) if asked else None
        schema = rows.select("*", F.lit(None).cast(SCORES).alias("_scores")).schema
        kind = pa.list_(pa.struct([("qid", pa.string()), ("type", pa.string()), ("keys", pa.list_(pa.string())), ("logits", pa.list_(pa.float64())), ("act", pa.float64()), ("seq_len", pa.int64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = loaded(name, factory)
            length = getattr(model, "seq_len", lambda text, q: len(text))
            for batch in batches:
                for s in range(0, batch.num_rows, size):
                    part = batch.slice(s, size)
                    texts = [t or "" for t in part.column(at).to_pylist()]
                    wants = part.column(asked_at).to_pylist() if asked_at is not None else [[*by]] * len(texts)
                    out: list[list[dict]] = [[] for _ in texts]
                    for qid, q in by.items():
                        own = [i for i, w in enumerate(wants) if qid in (w or ())]
                        if not own:
                            continue
                        for i, z in zip(own, model([texts[i] for i in own], q), strict=True):
                            z, act = z if isinstance(z, tuple) else (z, None)
                            out[i].append({"qid": qid, "type": q.type, "keys": q.keys, "logits": [*z], "act": act, "seq_len": length(texts[i], q)})
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], [*names, "_scores"])

        return rows.sortWithinPartitions(F.length("text")).mapInArrow(run, schema)


_models: dict[str, Callable] = {}


def loaded(name: str, factory: Callable[[], Callable]) -> Callable:
    """The model of this name; a Python worker makes it once, and keeps the one it made last."""
    if name not in _models:
        _models.clear()
        _models[name] = factory()
    return _models[name]


def _temperature(kind: str, size: str, temperatures: dict[tuple[str, int] | str, float] | None) -> str:
    """That of (type, number of options), else of the type, else 1."""
    pairs = sorted((temperatures or {}).items(), key=lambda kv: not isinstance(kv[0], tuple))
    cases = [f"when {kind} = {quoted(k[0])} and {size} = {k[1]} then {float(v)!r}D" if isinstance(k, tuple) else f"when {kind} = {quoted(k)} then {float(v)!r}D" for k, v in pairs]
    return f"case {' '.join(cases)} else 1D end" if cases else "1D"


def with_chances(scored: DataFrame, temperatures: dict[tuple[str, int] | str, float] | None = None) -> DataFrame:
    """``_scores`` with each entry's distribution ``p`` in place of its logits."""
    p = softmax("__s.logits", _temperature("__s.type", "size(__s.logits)", temperatures), as_sql=True)
    return scored.withColumn("_scores", F.expr(f"transform(_scores, __s -> named_struct('qid', __s.qid, 'keys', __s.keys, 'p', {p}, 'act', __s.act, 'seq_len', __s.seq_len))"))


def calibrated(scored: DataFrame, temperatures: dict[tuple[str, int] | str, float] | None = None) -> DataFrame:
    """Adds ``p``: softmax over the temperature of (type, number of options), else of the type, else 1."""
    return scored.withColumn("_t", F.expr(_temperature("type", "size(logits)", temperatures))).withColumn("p", softmax("logits", "_t")).drop("_t")


def answers(scored: DataFrame, confidence: Column | None = None) -> DataFrame:
    """Adds each row's answer: ``choice`` and its confidence, ``level`` for score, ``yes`` for noul; the others are null."""
    conf = entropy_confidence("p") if confidence is None else confidence
    kind = F.col("type")
    return (
        scored.withColumn("choice", F.when(kind == "choice", best_key("keys", "p")))
        .withColumn("level", F.when(kind == "score", F.round(expected_level("p"), 6)))
        .withColumn("yes", F.when(kind == "noul", F.round(F.col("p")[1], 6)))
        .withColumn("confidence", F.round(F.when(kind == "noul", F.greatest(F.col("p")[0], F.col("p")[1])).otherwise(conf), 6))
        .withColumn("probabilities", F.map_from_arrays("keys", rounded("p")))
    )


def row_key(state: str, question_json: str, max_len: int | None = None, head_max_len: int | None = None, checkpoint: str = "") -> Column:
    """SHA-1 of state, question, window lengths and checkpoint in a fixed form: a row that differs in any of them is scored anew."""
    fixed = [F.lit("" if x is None else str(x)) for x in (max_len, head_max_len, checkpoint)]
    return F.sha1(F.to_json(F.array(F.col(state), F.col(question_json), *fixed)))


def question_json(q: Question) -> str:
    """The question in canonical form: keys sorted, so two orders of a choice's options share it."""
    body: dict = {"type": q.type, "instructions": q.instructions}
    if q.options:
        body["criteria"] = [k for k, _ in q.options] if q.type == "score" else dict(q.options)
    return json.dumps(body, sort_keys=True)


class CachedScorer(Scorer):
    """A scorer that asks another one only what its cache, a table of files in a folder, doesn't know, and adds that to it.

    The cache has a row ``(key, seq, keys, logits, act, seq_len)`` for each different passage and question, key by ``row_key``; of several rows of a key
    the last counts. Rows that share passage and question are scored once. What is new is written before it is used, so an
    interrupted run keeps it; writing is an action, so ``scores`` runs the plan of ``rows`` once for that.
    """

    def __init__(self, inner: Scorer, path: str, max_len: int | None = None, head_max_len: int | None = None, checkpoint: str = ""):
        self.inner, self.path, self.about, self.max_options = inner, path, (max_len, head_max_len, checkpoint), inner.max_options
        self.held: list[DataFrame] = []

    def close(self) -> None:
        """Lets go of the rows that the answers so far were read from."""
        while self.held:
            self.held.pop().unpersist()

    def known(self, rows: DataFrame) -> DataFrame | None:
        spark = rows.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return latest(spark.read.schema("key string, seq bigint, keys array<string>, logits array<double>, act double, seq_len bigint").parquet(self.path))

    def scores(self, rows: DataFrame, questions: Sequence[Question], asked: str | None = None) -> DataFrame:
        self.check(questions)
        by = {q.qid: question_json(q) for q in questions}
        types = F.create_map(*(F.lit(x) for q in questions for x in (q.qid, q.type)))
        texts = F.create_map(*(F.lit(x) for kv in by.items() for x in kv))
        every = F.array(*(F.lit(q) for q in by))
        wanted = every if asked is None else F.array_intersect(F.col(asked), every)
        rows = rows.withColumn("_row", F.monotonically_increasing_id()).persist()  # the numbers have to stay those of the rows
        self.held.append(rows)
        pairs = rows.select("_row", F.coalesce("text", F.lit("")).alias("text"), F.explode(wanted).alias("qid"))
        pairs = pairs.withColumn("_json", texts[F.col("qid")]).withColumn("key", row_key("text", "_json", *self.about))
        once = pairs.groupBy("key").agg(F.first("text").alias("text"), F.first("qid").alias("qid"))
        known = self.known(rows)
        todo = once if known is None else once.join(known.select("key"), "key", "left_anti")
        todo = todo.withColumn("_ask", F.array("qid")).drop("qid")
        new = self.inner.scores(todo, questions, "_ask").select("key", F.explode("_scores").alias("s"))
        new.select("key", F.unix_micros(F.current_timestamp()).alias("seq"), "s.keys", "s.logits", "s.act", "s.seq_len").write.mode("append").parquet(self.path)
        found = pairs.select("_row", "qid", "key").join(self.known(rows), "key")
        order = F.create_map(*(F.lit(x) for k, q in enumerate(by) for x in (q, k)))
        entry = F.struct(order[F.col("qid")].alias("_k"), F.struct("qid", types[F.col("qid")].alias("type"), "keys", "logits", "act", "seq_len").alias("s"))
        listed = found.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(entry["_k"].alias("_k"), F.col("key"), entry["s"].alias("s")))).alias("_l"))
        out = rows.join(listed, "_row", "left").withColumn("_scores", F.coalesce(F.transform("_l", lambda x: x["s"]), F.expr(f"cast(array() as {SCORES})")))
        return out.drop("_row", "_l")


def latest(cache: DataFrame, order: str = "seq") -> DataFrame:
    """The last row of each key of an append-only cache."""
    w = W.partitionBy("key").orderBy(F.col(order).desc())
    return cache.where("key is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def probe(rows: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows found in the cache, with their cached columns, and those to be scored. Equal rows of a call are not merged."""
    known = latest(cache)
    return rows.join(known, "key"), rows.join(known.select("key"), "key", "left_anti")


def cache_stats(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """``(rows, hits, misses)``."""
    known = latest(cache).select("key", F.lit(1).alias("hit"))
    return rows.join(known, "key", "left").agg(F.count("*").alias("rows"), F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("misses"))
