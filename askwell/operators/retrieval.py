"""Lexical and dense ranking of passages, fusion and recall.

BM25 is per document: its passages are the collection. Passages are reduced to the queries' terms in their own rows, and one shuffle by
``doc_id`` gives lengths, frequencies and ranks; no join follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askwell.functions.vectors import let, terms

# Fixed values of the ranking function.
K1, B = 1.5, 0.75
FUSE = 60
#: Query vectors compared at once.
QUERY_BLOCK = 1024


def query_terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def term_frequency(chunks: DataFrame) -> DataFrame:
    """``(doc_id, index, term, tf)``: the postings."""
    return chunks.select("doc_id", "index", F.explode_outer(terms("text")).alias("term")).where("term is not null").groupBy("doc_id", "index", "term").agg(F.count("*").alias("tf"))


def doc_frequency(postings: DataFrame) -> DataFrame:
    """``(doc_id, term, df)``: passages of the document that have the term."""
    return postings.groupBy("doc_id", "term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """``(doc_id, n, avgdl)``: passages and their mean number of terms, empty ones included."""
    return chunks.withColumn("_l", F.size(terms("text"))).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg("_l"), 6).alias("avgdl"))


def with_scores(chunks: DataFrame, queries: Sequence[tuple[str, str]]) -> DataFrame:
    """``chunks`` with ``_scores``, the BM25 scores of the queries ``(qid, text)`` in order; without a hit a score is 0.

    A query's repeated term counts again; terms that no passage has add nothing.
    """
    vocabulary = sorted({t for _, q in queries for t in query_terms(q)}) or [""]
    listed = ", ".join(f"'{t}'" for t in vocabulary)
    rows = chunks.withColumn("_t", terms("text")).withColumn("_len", F.size("_t"))
    # Only the queries' terms are counted one by one.
    rows = rows.withColumn("_tf", F.expr(let("__h", f"filter(_t, __t -> __t in ({listed}))", f"transform(array({listed}), __q -> size(filter(__h, __t -> __t = __q)))"))).drop("_t")
    doc = W.partitionBy("doc_id")
    seen = {f"_df{k}": F.sum(F.when(F.col("_tf")[k] > 0, 1).otherwise(0)).over(doc) for k in range(len(vocabulary))}
    rows = rows.withColumns({"_n": F.count("*").over(doc), "_avg": F.avg("_len").over(doc), **seen})

    def weight(k: int) -> str:
        idf = f"ln(1 + (_n - _df{k} + 0.5D) / (_df{k} + 0.5D))"
        tf = f"_tf[{k}]"
        return f"(case when {tf} = 0 then 0D else {idf} * {tf} * {K1 + 1}D / ({tf} + {K1}D * ({1 - B}D + {B}D * _len / _avg)) end)"

    at = {t: k for k, t in enumerate(vocabulary)}
    scores = [" + ".join([weight(at[t]) for t in query_terms(q)]) or "0D" for _, q in queries]
    return rows.withColumn("_scores", F.expr(f"array({', '.join(scores)})")).drop("_tf", "_len", "_n", "_avg", *seen)


def bm25_scores(chunks: DataFrame, queries: Sequence[tuple[str, str]]) -> DataFrame:
    """``(doc_id, index, qid, score)`` of every passage and query ``(qid, text)``."""
    qids = F.array(*(F.lit(qid) for qid, _ in queries))
    rows = with_scores(chunks.select("doc_id", "index", "text"), queries).drop("text")
    return rows.select("doc_id", "index", F.posexplode_outer("_scores").alias("_q", "score")).select("doc_id", "index", qids[F.col("_q")].alias("qid"), "score")


def asked_by(chunks: DataFrame, queries: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """``chunks`` that are among the k best of their document for some query, with ``_asked``, the ids of these queries.

    Texts move once, to their document's partition; there scores and all queries' ranks are computed.
    """
    rows = with_scores(chunks, queries)
    ranks = {f"_r{j}": F.row_number().over(W.partitionBy("doc_id").orderBy(F.round(F.col("_scores")[j], 9).desc(), "index")) for j in range(len(queries))}
    rows = rows.withColumns(ranks)
    chosen = F.array_compact(F.array(*(F.when(F.col(f"_r{j}") <= k, F.lit(qid)) for j, (qid, _) in enumerate(queries))))
    return rows.withColumn("_asked", chosen).where(F.size("_asked") > 0).drop("_scores", *ranks)


def ranked(scores: DataFrame) -> DataFrame:
    """Adds ``pos``, from 0: by falling score, then by index."""
    order = W.partitionBy("doc_id", "qid").orderBy(F.round("score", 9).desc(), "index")
    return scores.withColumn("pos", F.row_number().over(order) - 1)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best passages of each document and query (all, where there are no more); read them in order of ``index``."""
    if k < 1:
        raise ValueError("top_k >= 1 is needed")
    return ranked(scores).where(F.col("pos") < k)


def _in_blocks(asked: DataFrame, columns: Sequence[str]) -> Iterator[tuple[list, ...]]:
    """Queries in blocks of ``QUERY_BLOCK``, a list for each column; one partition of them at a time is at the driver."""
    block: list = []
    for r in asked.orderBy("qid").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            yield tuple([r[c] for r in block] for c in columns)
            block = []
    if block:
        yield tuple([r[c] for r in block] for c in columns)


def _similarities(batch: pa.RecordBatch, matrix: np.ndarray) -> np.ndarray:
    """Of each row's vector, the second column, and each query's, to six digits."""
    return np.round(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) @ matrix.T, 6)


def _union(parts: Sequence[DataFrame], empty: DataFrame) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.union(p)
    return empty if out is None else out


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """``(qid, id, sim, pos)``: the k vectors ``(id, v)`` nearest to each query ``(qid, v)`` by inner product, ties by id.

    Queries go out in blocks of ``QUERY_BLOCK``, each a broadcast of fixed size against all vectors; a batch keeps its own k best of
    each query, so what is shuffled is k rows a query and batch, not all pairs. Null vectors are left out.
    """
    spark = vectors.sparkSession
    ids, qids = vectors.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    rows = vectors.where("id is not null and v is not null").select("id", F.col("v").cast("array<double>").alias("v"))
    asked = queries.where("qid is not null and v is not null").select("qid", F.col("v").cast("array<double>").alias("v"))

    def against(names: list, vs: list) -> DataFrame:
        matrix = spark.sparkContext.broadcast(np.array(vs))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                own = np.array(b.column(0).to_pylist())
                order = np.argsort(own, kind="stable")
                sims = _similarities(b, matrix.value)[order]
                best = np.argsort(-sims, axis=0, kind="stable")[:k]  # of each query, in a column
                near = np.take_along_axis(sims, best, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([q for q in names for _ in range(len(best))]), pa.array(own[order][best.T.ravel()].tolist()), pa.array(near.T.ravel())], ["qid", "id", "sim"])

        return rows.mapInArrow(run, f"qid {qids}, id {ids}, sim double")

    parts = [against(*block) for block in _in_blocks(asked, ("qid", "v"))]
    out = _union(parts, rows.limit(0).selectExpr(f"cast(null as {qids}) as qid", "id", "0D as sim"))
    order = W.partitionBy("qid").orderBy(F.col("sim").desc(), "id")
    return out.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < k)


def target_ranks(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, pos)``: among all vectors ``(id, v, label)``, in order of similarity, then id, the place of the first that has the label that a query
    ``(qid, v, want)`` wants and isn't the query itself; null where there is none.

    Two passes over the vectors, in blocks of queries: the nearest target, then how many vectors come before it. A batch sends a row a query.
    """
    spark = vectors.sparkSession
    rows = vectors.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    asked = queries.where("qid is not null and v is not null").select(F.col("qid").cast("long").alias("qid"), F.col("v").cast("array<double>").alias("v"), F.col("want").cast("long").alias("want"))

    def nearest(names: list, vs: list, wants: list) -> DataFrame:
        held = spark.sparkContext.broadcast((np.array(names), np.array(vs), np.array([np.nan if w is None else w for w in wants], float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, matrix, want = held.value
            for b in batches:
                if b.num_rows:
                    order = np.argsort(b.column(0).to_numpy(), kind="stable")
                    own, label = b.column(0).to_numpy()[order], np.array([np.nan if x is None else x for x in b.column(2).to_pylist()], float)[order]
                    sims = np.where((label[:, None] == want) & (own[:, None] != qids), _similarities(b, matrix)[order], -np.inf)
                    at = sims.argmax(0)
                    near = sims[at, np.arange(len(qids))]
                    ok = near > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(qids[ok]), pa.array(near[ok]), pa.array(own[at[ok]])], ["qid", "sim", "id"])

        return rows.mapInArrow(run, "qid long, sim double, id long")

    def before(names: list, vs: list, sims: list, ids: list) -> DataFrame:
        held = spark.sparkContext.broadcast((np.array(names), np.array(vs), np.array(sims), np.array(ids)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, matrix, sim, first = held.value
            for b in batches:
                if b.num_rows:
                    own, near = b.column(0).to_numpy()[:, None], _similarities(b, matrix)
                    n = ((near > sim) | (near == sim) & (own < first)).sum(0)
                    yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(n.astype("i8"))], ["qid", "n"])

        return rows.mapInArrow(run, "qid long, n long")

    found = _union([nearest(*block) for block in _in_blocks(asked, ("qid", "v", "want"))], rows.limit(0).selectExpr("id as qid", "0D as sim", "id"))
    best = found.groupBy("qid").agg(F.max(F.struct("sim", (-F.col("id")).alias("i"))).alias("m")).select("qid", "m.sim", (-F.col("m.i")).alias("id"))
    counted = _union([before(*block) for block in _in_blocks(asked.join(best, "qid"), ("qid", "v", "sim", "id"))], rows.limit(0).selectExpr("id as qid", "0L as n"))
    places = counted.groupBy("qid").agg(F.sum("n").alias("pos"))
    return asked.select("qid").join(places, "qid", "left")


def fused(rankings: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Reciprocal-rank fusion of rankings with ``keys``, ``index`` and ``pos``: ``(keys, index, rrf, pos)``."""
    every = None
    for r in rankings:
        r = r.select(*keys, "index", "pos")
        every = r if every is None else every.unionByName(r)
    out = every.groupBy(*keys, "index").agg(F.sum(F.lit(1.0) / (FUSE + F.col("pos"))).alias("rrf"))
    order = W.partitionBy(*keys).orderBy(F.round("rrf", 9).desc(), "index")
    return out.withColumn("pos", F.row_number().over(order) - 1)


def recall_at(ranks: DataFrame, ks: Sequence[int] = (1, 3, 5, 10, 20, 50), group: Sequence[str] = ()) -> DataFrame:
    """Share of targets at a ``pos`` below each k, and the median position; a null ``pos``, where there is no target, counts in the shares alone."""
    cols = [F.round(F.avg(F.coalesce(F.col("pos") < k, F.lit(False)).cast("double")), 6).alias(f"recall_{k}") for k in ks]
    return ranks.groupBy(*group).agg(F.count("*").alias("n"), *cols, F.median("pos").cast("double").alias("median_pos"))
