"""Rank metrics, intervals, quantiles, bins, ensembles and cascades over score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def auc(scores: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive is above a negative, ties counting half; null where a side is empty.

    Equal scores are counted first, so the ranking sees each different score once: ``(group, auc, n_pos, n_neg)``.
    """
    g = [F.col(c) for c in group]
    by = scores.groupBy(*g, F.round("score", 6).alias("s")).agg(F.sum(F.when(F.col("gold"), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("gold"), 0).otherwise(1)).alias("n"))
    below = W.partitionBy(*(g or [F.lit(0)])).orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumn("lower", F.coalesce(F.sum("n").over(below), F.lit(0)))
    out = by.groupBy(*g).agg(F.sum(F.col("p") * (F.col("lower") + F.col("n") / 2)).alias("u"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return out.select(*group, F.round(F.try_divide(F.col("u"), (F.col("n_pos") * F.col("n_neg")).cast("double")), 6).alias("auc"), "n_pos", "n_neg")


def auc_bootstrap(scores: DataFrame, key: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """``(lo, hi)``: 2.5th and 97.5th percentile of the AUC over resamples with hashed Poisson-like multiplicities."""
    weight = "case when u < 0.36788 then 0 when u < 0.73576 then 1 when u < 0.91970 then 2 when u < 0.98101 then 3 else 4 end"
    rows = scores.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    rows = rows.withColumn("u", F.expr(f"pmod(xxhash64({key}, b, {seed}), 1000003) / 1000003D")).withColumn("m", F.expr(weight))
    by = rows.groupBy("b", F.round("score", 6).alias("s")).agg(F.sum(F.when(F.col("gold"), F.col("m")).otherwise(0)).alias("p"), F.sum(F.when(F.col("gold"), 0).otherwise(F.col("m"))).alias("n"))
    below = W.partitionBy("b").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumn("lower", F.coalesce(F.sum("n").over(below), F.lit(0)))
    one = by.groupBy("b").agg(F.try_divide(F.sum(F.col("p") * (F.col("lower") + F.col("n") / 2)), (F.sum("p") * F.sum("n")).cast("double")).alias("a"))
    return one.agg(F.round(F.expr("percentile(a, 0.025)"), 6).alias("lo"), F.round(F.expr("percentile(a, 0.975)"), 6).alias("hi"))


def _counted(scores: DataFrame, group: Sequence[str]) -> DataFrame:
    """Each different score ``s`` once, with the places ``lo`` to ``hi`` - 1 that it takes in ascending order, and the number ``n``.

    Rows are counted before they are ordered: scores of six digits have at most a million values, however many rows there are.
    """
    by = scores.groupBy(*group, F.round("score", 6).alias("s")).agg(F.count("*").alias("c"))
    g = W.partitionBy(*([F.col(c) for c in group] or [F.lit(0)]))
    by = by.withColumn("hi", F.sum("c").over(g.orderBy("s").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(g))
    return by.withColumn("lo", F.col("hi") - F.col("c"))


def _at(place: str) -> Column:
    return F.expr(f"lo <= {place} and {place} < hi")


def recall_at_spec(scores: DataFrame, spec: float = 0.9, group: Sequence[str] = ()) -> DataFrame:
    """Share of positives at or above the ascending negatives' element ``min(n - 1, int(spec n))``: ``(threshold, recall)``."""
    neg = _counted(scores.where(~F.col("gold")), group).where(_at(f"least(n - 1, cast(floor({spec} * n) as long))")).select(*group, F.col("s").alias("threshold"))
    pos = scores.where("gold").select(*group, F.round("score", 6).alias("s"))
    key = list(group) or ["_k"]
    rows = pos.join(neg, key) if group else pos.withColumn("_k", F.lit(1)).join(neg.withColumn("_k", F.lit(1)), key)
    return rows.groupBy(*group, "threshold").agg(F.round(F.avg((F.col("s") >= F.col("threshold")).cast("double")), 6).alias("recall"))


def order_quartiles(scores: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Elements n // 4, n // 2 and 3 n // 4 of the ascending scores, without interpolation."""
    r = _counted(scores, group)
    pick = lambda e: F.max(F.when(_at(e), F.col("s")))
    return r.groupBy(*group).agg(pick("n div 4").alias("q1"), pick("n div 2").alias("q2"), pick("(3 * n) div 4").alias("q3"))


def fp_at_recall(scores: DataFrame, per_doc: int = 69) -> DataFrame:
    """Share of negatives at or above the positives' element ``n // 5``, and such passages expected in a document of ``per_doc``."""
    thr = _counted(scores.where("gold"), []).where(_at("n div 5")).select(F.lit(1).alias("_k"), F.col("s").alias("threshold"))
    neg = scores.where(~F.col("gold")).select(F.lit(1).alias("_k"), F.round("score", 6).alias("s"))
    out = neg.join(thr, "_k").groupBy("threshold").agg(F.avg((F.col("s") >= F.col("threshold")).cast("double")).alias("fp"))
    return out.select("threshold", F.round("fp", 6).alias("fp_rate"), F.round(F.col("fp") * per_doc, 6).alias("expected_fp"))


def summary(scores: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Accuracy at 0.5, shares in and over bands, medians and interpolated percentiles, means by gold."""
    s = F.round("score", 6)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    at = lambda q: F.round(F.expr(f"percentile(s, {q})"), 6)
    # Of six-digit numbers as they are, so that the order of summing can't tip a half.
    mean = lambda c: F.round(F.avg(F.when(c, F.col("s").cast("decimal(20,6)"))), 6).cast("double")
    return scores.withColumn("s", s).groupBy(*group).agg(
        F.count("*").alias("n"), share((F.col("s") >= 0.5) == F.col("gold")).alias("accuracy"), share(F.col("s").between(0.3, 0.7)).alias("in_band"),
        *(F.count_if(F.col("s") > t).alias(f"over_{str(t).replace('.', '_')}") for t in (0.2, 0.5, 0.9)),
        F.max("s").alias("most"), at(0.5).alias("median"), at(0.05).alias("p05"), at(0.95).alias("p95"),
        mean(F.col("gold")).alias("mean_pos"), mean(~F.col("gold")).alias("mean_neg"),
    )


def depth_bin(depth: str) -> Column:
    """Half-open bins [0, .34), [.34, .67), [.67, 1.01)."""
    d = F.col(depth)
    return F.when(d < 0.34, "start").when(d < 0.67, "middle").when(d < 1.01, "end")


def cost(tokens: str, price_per_million: float) -> Column:
    return F.sum(tokens) * price_per_million / 1e6


def multiclass(answers: DataFrame, gold: str = "gold", group: Sequence[str] = ()) -> DataFrame:
    """``(group, n, accuracy, mean_p_gold)`` of answers with ``answer_key``, ``keys`` and ``p``; a gold answer that is no option has chance 0."""
    at = F.array_position("keys", F.col(gold)).cast("int")
    p = F.coalesce(F.get("p", at - 1), F.lit(0.0))
    return answers.where(F.col(gold).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.round(F.avg((F.col("answer_key") == F.col(gold)).cast("double")), 6).alias("accuracy"), F.round(F.avg(p), 6).alias("mean_p_gold"))


def workload(answers: DataFrame, group: Sequence[str] = ("qid",), seconds: str | None = None) -> DataFrame:
    """Mean passages, scored passages and tokens a document, and mean seconds where there is a column of them."""
    cols = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("n_chunks", "n_scored", "tokens")] + ([F.round(F.avg(seconds), 6).alias("mean_seconds")] if seconds else [])
    return answers.groupBy(*group).agg(F.count("*").alias("n"), *cols)


def paired(rows: DataFrame, arms: Sequence[str], item: str = "item", arm: str = "arm", value: str = "value") -> DataFrame:
    """``(arm, n, mean, mean_difference, better, worse)``: each arm against the first one, on the items that both have."""
    wide = rows.groupBy(item).pivot(arm, list(arms)).agg(F.first(value))
    base = F.col(f"`{arms[0]}`")
    long = wide.select(base.alias("_base"), F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"`{a}`").alias("v")) for a in arms))).alias("_a")).select("_base", "_a.*")
    d = F.col("v") - F.col("_base")
    return long.where("v is not null and _base is not null").groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.avg(d), 6).alias("mean_difference"), F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse"))


def max_abs_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Largest difference of a value between two tables, and rows that only one has."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys), "full_outer")
    return j.agg(F.round(F.max(F.abs(F.col("_a") - F.col("_b"))), 6).alias("max_abs"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"))


# -- Ensembles over the passages of a document: columns a and b are two detectors' scores.


def ensembles(rows: DataFrame) -> DataFrame:
    """``(doc_id, max_a, max_mean, max_min)``."""
    m = (F.col("a") + F.col("b")) / 2
    return rows.groupBy("doc_id").agg(F.round(F.max("a"), 6).alias("max_a"), F.round(F.max(m), 6).alias("max_mean"), F.round(F.max(F.least("a", "b")), 6).alias("max_min"))


def two_stage(rows: DataFrame, k: int = 20) -> DataFrame:
    """The k best passages by the first detector; of those the largest minimum of both."""
    w = W.partitionBy("doc_id").orderBy(F.round("a", 6).desc(), "index")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy("doc_id").agg(F.round(F.max(F.least("a", "b")), 6).alias("two_stage"))


def dense_gate(rows: DataFrame, gold: str = "gold", sim: str = "sim", score: str = "score") -> DataFrame:
    """Scores set to zero where the similarity is below the positives' 5th percentile."""
    thr = rows.where(F.col(gold)).agg(F.expr(f"percentile({sim}, 0.05)").alias("_t")).withColumn("_k", F.lit(1))
    return rows.withColumn("_k", F.lit(1)).join(thr, "_k").withColumn("gated", F.when(F.col(sim) >= F.col("_t"), F.col(score)).otherwise(0.0)).drop("_k", "_t")
