"""Asking questions of documents: locate, score, gate, and combine the passages' distributions into one answer a document.

One scoring pass: a passage has an array of the questions, gates and detectors that it is asked, and gets one of their scores. Then one
aggregation by (document, question) for all questions, over partial sums; texts don't move, but to be ranked where a prefilter is used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askwell.functions.vectors import best_key, entropy_confidence, expected_level, quoted, softmax
from askwell.operators.retrieval import asked_by
from askwell.operators.scoring import LexicalScorer, Question, Scorer, query_text, with_chances

DEFAULTS = {"noul": "max", "choice": "mixture", "score": "mixture"}
MODES = {"noul": ("max", "any", "mean"), "choice": ("mixture", "loglinear", "stack"), "score": ("mixture", "loglinear", "stack")}
GATE_SUFFIX, DETECTOR_SUFFIX = "__gate", "__detector"
FLOOR = 1e-6
#: Weights are at least this, so that those that are all zero count alike.
LEAST = 1e-200
# Fixed value: what the second-order state says of itself.
STACK_NOTE = "Each part is one section of a longer document, judged independently."


def gate_question(q: Question, template: str | None = None) -> Question:
    """Whether a passage bears on the question."""
    text = (template or "Is this passage relevant to: {instructions}").replace("{instructions}", q.instructions)
    return Question(q.qid + GATE_SUFFIX, "noul", text)


def uses_gate(q: Question, gate: str | bool) -> bool:
    return q.type != "noul" if gate == "auto" else bool(gate)


def mode_of(q: Question, agg: dict[str, str] | None) -> str:
    """The user's mode for the question, else for its type, else the type's default; unknown ones mean mean or mixture."""
    merged = {**DEFAULTS, **(agg or {})}
    mode = merged.get(q.qid, merged[q.type])
    if mode not in MODES[q.type]:
        return "mean" if q.type == "noul" else "mixture"
    return mode


# -- Aggregates over the passages of a group; ``w`` are weights, which need not sum to one.


def noul_max(p: str) -> Column:
    return F.max(p)


def noul_any(p: str) -> Column:
    """One less the product of the complements."""
    return 1 - F.product(1 - F.col(p))


def noul_mean(p: str, w: str) -> Column:
    """Weighted mean; the plain one where no weight is positive."""
    v = F.greatest(F.col(w), F.lit(LEAST))
    return F.sum(F.col(p) * v) / F.sum(v)


def choice_mixture(p: str, w: str, k: int) -> Column:
    """Weighted mean of each of k options, as an array."""
    v = F.greatest(F.col(w), F.lit(LEAST))
    return F.array(*(F.coalesce(F.sum(F.get(p, F.lit(i)) * v) / F.sum(v), F.lit(0.0)) for i in range(k)))


def choice_loglinear_logits(p: str, w: str, k: int) -> Column:
    """Weighted mean logarithms, floored; their softmax is the log-linear pool."""
    v = F.greatest(F.col(w), F.lit(LEAST))
    log = lambda i: F.ln(F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), F.get(p, F.lit(i)))))
    return F.array(*(F.coalesce(F.sum(log(i) * v) / F.sum(v), F.lit(0.0)) for i in range(k)))


def selected_passages(chunks: DataFrame, questions: Sequence[Question], prefilter: str | None, k: int) -> DataFrame:
    """Chunks with ``n_chunks``, ``n_scored`` and the ids of the questions that select them, ``_asked``: all, or those whose k best by BM25 they are among."""
    if prefilter not in (None, "bm25"):
        raise ValueError("prefilter is None or bm25")
    if k < 1:
        raise ValueError("top_k >= 1 is needed")
    if "n_chunks" not in chunks.columns:
        chunks = chunks.withColumn("n_chunks", F.count("*").over(W.partitionBy("doc_id")))
    if prefilter is None:
        return chunks.withColumn("n_scored", F.col("n_chunks")).withColumn("_asked", F.array(*(F.lit(q.qid) for q in questions)))
    best = asked_by(chunks, [(q.qid, query_text(q, skip_null=True)) for q in questions], k)
    return best.withColumn("n_scored", F.least("n_chunks", F.lit(k)))


def scored_rows(selected: DataFrame, questions: Sequence[Question], gate: str | bool = "auto", scorer: Scorer | None = None, temperatures: dict | None = None, template: str | None = None) -> DataFrame:
    """``(doc_id, index, qid, n_chunks, n_scored, p, act, gate, tokens, span)``: answer and gate of every selected passage, from one pass.

    A gate is asked only where several passages are scored; a detector stands in only where the document has several.
    """
    scorer = scorer or LexicalScorer()
    every: list[Question] = []
    asked: list[Column] = []
    several, here = F.col("n_chunks") > 1, lambda q: F.array_contains("_asked", q.qid)

    def ask_if(e: Question, when: Column) -> None:
        every.append(e)
        asked.append(F.when(when, F.lit(e.qid)))

    for q in questions:
        ask_if(q, here(q) & ~several if q.detector is not None else here(q))
        if q.detector is not None:
            ask_if(replace(q.detector, qid=q.qid + DETECTOR_SUFFIX), here(q) & several)
        if uses_gate(q, gate):
            ask_if(gate_question(q, template), here(q) & (F.col("n_scored") > 1))
    if len({e.qid for e in every}) < len(every):
        raise ValueError("two questions have one id")
    rows = selected.withColumn("_ask", F.array_compact(F.array(*asked)))
    rows = with_chances(scorer.scores(rows, every, "_ask"), temperatures)

    def entry(name: str) -> str:
        return f"get(filter(_scores, __s -> __s.qid = {quoted(name)}), 0)"

    made = []
    for q in questions:
        own, tokens = f"{entry(q.qid)}", f"coalesce({entry(q.qid)}.seq_len, 0L)"
        p, act = f"{own}.p", f"{own}.act"
        if q.detector is not None:
            det = entry(q.qid + DETECTOR_SUFFIX)
            yes = f"{det}.p[{q.detector.keys.index(q.detector_key)}]"
            p, act, tokens = f"coalesce({p}, array(1 - {yes}, {yes}))", f"coalesce({act}, {det}.act)", f"{tokens} + coalesce({det}.seq_len, 0L)"
        g = "1D"
        if uses_gate(q, gate):
            got = entry(q.qid + GATE_SUFFIX)
            g, tokens = f"coalesce({got}.p[1], 1D)", f"{tokens} + coalesce({got}.seq_len, 0L)"
        made.append(f"case when array_contains(_asked, {quoted(q.qid)}) then named_struct('qid', {quoted(q.qid)}, 'p', {p}, 'act', {act}, 'gate', {g}, 'tokens', {tokens}) end")
    span = F.struct("tok_start", "tok_end").alias("span")
    out = rows.select("doc_id", "index", "n_chunks", "n_scored", span, F.explode_outer(F.expr(f"array_compact(array({', '.join(made)}))")).alias("_r"))
    return out.select("doc_id", "index", "n_chunks", "n_scored", "span", "_r.*")


def _by_question(questions: Sequence[Question], of) -> str:
    """SQL that has ``of(question)`` for the row's question."""
    return f"case {' '.join(f'when qid = {quoted(q.qid)} then {of(q)}' for q in questions)} end"


def pooled(rows: DataFrame, questions: Sequence[Question], agg: dict[str, str] | None = None, detail: bool = False, states: bool = False, gate: str | bool = "auto") -> DataFrame:
    """One row ``(doc_id, qid, mode, n_chunks, n_scored, tokens, p, mix, act[, chunks][, state])`` a document and question from those of ``scored_rows``."""
    modes = {q.qid: mode_of(q, agg) for q in questions}
    options = max(len(q.keys) for q in questions)
    nouls = {modes[q.qid] for q in questions if q.type == "noul"}
    cols = [F.first("n_chunks").alias("n_chunks"), F.count("*").alias("n_scored"), F.sum("tokens").alias("tokens"), choice_mixture("p", "gate", options).alias("mix"), F.max(F.struct("act", "index"))["act"].alias("act")]
    rows = rows.withColumn("yes", F.get("p", F.lit(1)))
    if "max" in nouls:
        cols.append(noul_max("yes").alias("v_max"))
    if "any" in nouls:
        cols.append(noul_any("yes").alias("v_any"))
    if "loglinear" in modes.values():
        cols.append(choice_loglinear_logits("p", "gate", options).alias("logs"))
    if detail:
        cols.append(F.sort_array(F.collect_list(F.struct("index", F.col("span.tok_start").alias("tok_start"), F.col("span.tok_end").alias("tok_end"), "p", "gate"))).alias("chunks"))
    if states:
        item = F.struct((-F.round("gate", 2)).alias("_order"), "index", F.round("gate", 2).alias("relevance"), "p")
        cols.append(F.sort_array(F.collect_list(item)).alias("_parts"))
    out = rows.groupBy("doc_id", "qid").agg(*cols)

    def p(q: Question) -> str:
        mode, mix = modes[q.qid], f"slice(mix, 1, {len(q.keys)})"
        if q.type == "noul" and mode in ("max", "any"):
            return f"array(1 - v_{mode}, v_{mode})"
        return f"case when n_chunks > 1 then {softmax(f'slice(logs, 1, {len(q.keys)})', as_sql=True)} else {mix} end" if mode == "loglinear" else mix

    out = out.withColumn("mode", F.expr(f"case when n_chunks = 1 then 'passthrough' else {_by_question(questions, lambda q: quoted(modes[q.qid]))} end"))
    out = out.withColumn("p", F.expr(_by_question(questions, p))).withColumn("mix", F.expr(_by_question(questions, lambda q: f"slice(mix, 1, {len(q.keys)})")))
    if states:
        out = out.withColumn("state", F.expr(_by_question(questions, lambda q: _state(q, uses_gate(q, gate)) if modes[q.qid] == "stack" else "''"))).drop("_parts")
    return out.drop("v_max", "v_any", "logs")


def _state(q: Question, gated: bool) -> str:
    """What a question is asked of a second time, as JSON: the passages in falling order of relevance (if they have one), each with its own answer."""
    keys = f"array({', '.join(map(quoted, q.keys))})"
    if q.type == "choice":
        best = f"element_at({keys}, cast(array_position(__x.p, array_max(__x.p)) as int))"
        own = f"'answer', {best}, 'p', round(array_max(__x.p), 2)"
    else:
        level = "aggregate(transform(__x.p, (__v, __i) -> __v * __i), 0D, (__s, __v) -> __s + __v)"
        own = f"'score', round({level}, 2)"
    relevance = "case when n_scored > 1 then __x.relevance end" if gated else "cast(null as double)"
    parts = f"transform(_parts, __x -> named_struct('part', __x.index + 1, 'relevance', {relevance}, {own}))"
    return f"to_json(named_struct('note', {quoted(STACK_NOTE)}, 'parts', {parts}))"


def ask(
    chunks: DataFrame, questions: Sequence[Question], prefilter: str | None = None, k: int = 1, gate: str | bool = "auto", agg: dict[str, str] | None = None,
    scorer: Scorer | None = None, temperatures: dict | None = None, detail: bool = False, template: str | None = None,
) -> DataFrame:
    """Every question's answer for every document: ``(doc_id, qid, agg, answer_value, answer_key, confidence, n_chunks, n_scored, tokens)``.

    ``answer_value`` is the chance of yes, that of the best option, or the expected rung; ``answer_key`` the option. ``agg`` is the mode, or ``passthrough``
    where the document has one passage, whose answer is the document's. ``detail`` adds the options' ``keys``, their chances ``p``, ``act`` and the passages' ``chunks``.

    Mode ``stack`` asks a choice or score question once more, of the passages' answers.
    """
    scorer = scorer or LexicalScorer()
    stacked = [q for q in questions if mode_of(q, agg) == "stack"]
    rows = scored_rows(selected_passages(chunks, questions, prefilter, k), questions, gate, scorer, temperatures, template)
    out = pooled(rows, questions, agg, detail, bool(stacked), gate)
    if stacked:
        again = F.when((F.col("mode") == "stack") & F.col("qid").isin([q.qid for q in stacked]), F.array("qid")).otherwise(F.array().cast("array<string>"))
        out = with_chances(scorer.scores(out.withColumnRenamed("state", "text").withColumn("_ask", again), stacked, "_ask"), temperatures)
        second = "get(filter(_scores, __s -> __s.qid = qid), 0)"
        out = out.withColumns({c: F.expr(f"case when size(_scores) > 0 then {second}.{own} else {c} end") for c, own in (("p", "p"), ("mix", "p"), ("act", "act"))})
    keys = _by_question(questions, lambda q: f"array({', '.join(map(quoted, q.keys))})")
    kind = _by_question(questions, lambda q: quoted(q.type))
    out = out.withColumn("keys", F.expr(keys)).withColumn("_kind", F.expr(kind))
    is_ = F.col("_kind")
    # The level of a score is that of the mixture, whatever pool gives its probabilities.
    value = F.when(is_ == "noul", F.col("p")[1]).when(is_ == "score", expected_level("mix")).otherwise(F.array_max("p"))
    key = F.when(is_ == "choice", best_key("keys", "p"))
    sure = F.when(is_ == "noul", F.array_max("p")).otherwise(entropy_confidence("p"))
    more = ["keys", "p", "act", "chunks"] if detail else []
    return out.select("doc_id", "qid", F.col("mode").alias("agg"), F.round(value, 6).alias("answer_value"), key.alias("answer_key"), F.round(sure, 6).alias("confidence"), "n_chunks", "n_scored", "tokens", *more)


def row_estimate(chunks: DataFrame, questions: Sequence[Question], prefilter: str | None = None, k: int = 1, gate: str | bool = "auto") -> DataFrame:
    """``(doc_id, n_chunks, scored, gates, rows)``: rows that asking would score, from the passage counts alone."""
    counted = F.first("n_chunks") if "n_chunks" in chunks.columns else F.count("*")
    n = chunks.groupBy("doc_id").agg(counted.alias("n_chunks"))
    per = F.col("n_chunks") if prefilter is None else F.least(F.col("n_chunks"), F.lit(k))
    gated = sum(uses_gate(q, gate) for q in questions)
    out = n.withColumn("scored", per * len(questions)).withColumn("gates", F.when(per > 1, per * gated).otherwise(F.lit(0)))
    return out.select("doc_id", F.col("n_chunks").cast("long").alias("n_chunks"), F.col("scored").cast("long").alias("scored"), F.col("gates").cast("long").alias("gates"), (F.col("scored") + F.col("gates")).cast("long").alias("rows"))
