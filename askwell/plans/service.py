"""From a request to its answer: validation, the index of the document, admission, asking, and the answer's fields.

A request is about one document, so its answers are few rows, and come to the driver.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from askwell.functions.vectors import rounded
from askwell.operators.ask import row_estimate
from askwell.operators.chunking import token_totals
from askwell.operators.scoring import Question, Scorer
from askwell.plans.engine import Engine
from askwell.plans.validation import IndexCache, Limits, Refusal, admit, as_questions, validate


def index_key(text: str, model: str) -> str:
    """Names the index of a text; the model is part of it, since its tokens are."""
    return hashlib.sha256(text.encode()).hexdigest() + ":" + model


def plain(x: object) -> object:
    """As JSON has it: mappings and sequences of plain values; numbers that are not finite are null."""
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x


def projected(answers: DataFrame, questions: Sequence[Question]) -> DataFrame:
    """Detailed answers as ``(doc_id, qid, type, noul, choice, score, confidence, probabilities, legend, agg, n_scored, act)``; fields of other types are null."""
    kind = F.lit(None).cast("string")
    for q in questions:
        kind = F.when(F.col("qid") == q.qid, q.type).otherwise(kind)
    rows = answers.withColumn("type", kind)
    of = lambda t, c: F.when(F.col("type") == t, F.col(c))
    listed = F.when(F.col("type") != "noul", F.arrays_zip("keys", rounded("p").alias("p")))
    return rows.select(
        "doc_id", "qid", "type", of("noul", "answer_value").alias("noul"), of("choice", "answer_key").alias("choice"), of("score", "answer_value").alias("score"), "confidence",
        F.transform(listed, lambda x: F.struct(x["keys"].alias("key"), x["p"].alias("p"))).alias("probabilities"), of("score", "keys").alias("legend"), "agg", "n_scored", "act",
    )


def _fields(q: Question, row: Row, detail: bool) -> dict:
    p = dict(zip(row["keys"], row["p"], strict=True))
    out = {
        "noul": lambda: {"noul": row["answer_value"], "confidence": row["confidence"]},
        "choice": lambda: {"choice": row["answer_key"], "confidence": row["confidence"], "probabilities": p},
        "score": lambda: {"score": row["answer_value"], "confidence": row["confidence"], "probabilities": p, "legend": row["keys"]},
    }[q.type]()
    out = {"type": q.type, **out, "agg": row["agg"], "n_scored": row["n_scored"]}
    if row["act"] is not None:
        out["act_probability"] = row["act"]
    if detail:
        out["chunks"] = [{**c.asDict(), "gate": c["gate"] if row["n_scored"] > 1 else None} for c in row["chunks"]]
    return plain(out)


class Service:
    """Answers requests; holds the indexes of the last documents."""

    def __init__(self, spark: SparkSession, limits: Limits | None = None, scorer: Scorer | None = None, model: str = "lexical", checkpoint: str = "", max_len: int | None = None, head: int = 0):
        self.spark, self.limits, self.scorer, self.model, self.checkpoint = spark, limits or Limits(), scorer, model, checkpoint
        self.size = self.limits.clamped(max_len, head) if max_len else self.limits.chunk_tokens
        self.cache = IndexCache(self.limits.cache_items, self.limits.cache_passages, self.limits.cache_ttl)

    def engine(self, strategy: str, top_k: int) -> Engine:
        """That of a strategy: ``scan`` asks every passage, ``locate`` the best."""
        where = {"prefilter": "bm25", "top_k": top_k} if strategy == "locate" else {}
        return Engine(chunk_tokens=self.size, mode="paragraphs", scorer=self.scorer, **where)

    def answer(self, body: object) -> dict:
        """The answer to a request; a ``Refusal`` says why there is none."""
        request = validate(body, self.limits)
        questions, engine = as_questions(request), self.engine(request["strategy"], request["top_k"])
        key, began = index_key(request["text"], self.model), time.perf_counter()
        index = self.cache.get(key)
        cached = index is not None
        if index is None:
            index = engine.index(self.spark.createDataFrame([(0, request["text"])], "doc_id long, text string"))
        total = token_totals(index.chunks).first()
        indexed = time.perf_counter()
        if not cached:
            self.cache.put(key, index, total["n_chunks"])
        try:
            estimate = row_estimate(index.chunks, questions, engine.prefilter, engine.top_k, engine.gate)
            why = admit(estimate, self.limits, request["strategy"] == "scan").first()
            if why["refused"] == "scan":
                raise Refusal(422, "too_many_passages", f"{why['n_chunks']} passages, {self.limits.max_scan} are scanned at most: locate, or send a shorter text")
            if why["refused"] == "rows":
                raise Refusal(422, "too_many_rows", f"{why['rows']} rows, {self.limits.max_rows} are scored at most: ask fewer questions, or locate")
            try:
                rows = {r["qid"]: r for r in engine.ask(index, questions, request["agg"], detail=True).collect()}
            except (ValueError, TypeError, KeyError) as e:
                raise Refusal(422, "invalid_request", str(e)) from e
            except (RuntimeError, PySparkException) as e:
                raise Refusal(503, "inference_unavailable", "inference failed; retry shortly", retry_after=5) from e
        finally:
            if self.cache.get(key) is not index:  # too large to be held
                index.close()
        return {
            "model": self.model, "checkpoint": self.checkpoint, "strategy": request["strategy"], "n_chunks": total["n_chunks"],
            "answers": {q.qid: _fields(q, rows[q.qid], request["detail"]) for q in questions},
            "usage": {"input_tokens": sum(r["tokens"] for r in rows.values()), "output_tokens": 0, "document_tokens": total["n_tokens"]},
            "timing": {"index_ms": round(1000 * (indexed - began), 1), "ask_ms": round(1000 * (time.perf_counter() - indexed), 1), "cached": cached},
        }
