"""Selecting and composing test documents: seeded samples, token budgets, planted passages, nested pools.

"Random" orders are by MD5 of a seed and the id, so every engine that has MD5 draws alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))


def stratified_sample(rows: DataFrame, by: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each class in drawn order, as ``pos`` from 0."""
    w = W.partitionBy(by).orderBy(draw(seed, key), key)
    return rows.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < n)


def sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in drawn order, without a window over all rows."""
    return rows.orderBy(draw(seed, key), key).limit(n)


def token_budget_fill(rows: DataFrame, group: str, order: Sequence[Column], tokens: str, target: int, overhead: int = 2) -> DataFrame:
    """Rows of each group in order, taken while those before them have fewer than ``target`` tokens; each costs ``overhead`` more."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col(tokens) + overhead).over(w), F.lit(0)).cast("long")
    return rows.withColumn("before", before).where(F.col("before") < target)


def place(passages: Column, needle: Column, where: str) -> Column:
    """An array with one passage more at its start, middle or end, or none."""
    if where == "none":
        return passages
    n = {"start": F.lit(0), "middle": F.floor(F.size(passages) / 2).cast("int"), "end": F.size(passages)}[where]
    return F.concat(F.slice(passages, F.lit(1), n), F.array(needle), F.slice(passages, n + 1, F.size(passages)))


def offset_prefix(rows: DataFrame, group: str, order: Sequence[Column], tokens: str, offset: int, overhead: int = 2) -> DataFrame:
    """``(group, n_before)``: passages that fit before a needle at a token offset."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    used = F.sum(F.col(tokens) + overhead).over(w)
    return rows.withColumn("_u", used).groupBy(group).agg(F.count_if(F.col("_u") <= offset).alias("n_before"))


def normalised_unique(rows: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """Texts with single spaces, of ``least`` characters or more, each once, with its smallest key."""
    t = F.trim(F.regexp_replace(F.col(text), "[ \\t\\n\\r\\f]+", " "))
    return rows.select(F.col(key), t.alias("text")).where(F.length("text") >= least).groupBy("text").agg(F.min(key).alias(key))


def without(rows: DataFrame, removed: DataFrame, on: str) -> DataFrame:
    """Rows whose key isn't removed."""
    return rows.join(removed.select(on), on, "left_anti")


def nested_max(rows: DataFrame, group: str | Sequence[str], order: Sequence[Column], score: str, sizes: Sequence[int]) -> DataFrame:
    """``(group, m, top)``: the largest score among the first m rows of one order, for each size m (or all, where there are fewer)."""
    group = [group] if isinstance(group, str) else list(group)
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    r = rows.withColumn("_i", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    r = r.withColumn("_top", F.max(score).over(w)).withColumn("_n", F.count("*").over(W.partitionBy(*group)))
    r = r.withColumn("m", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("_i") == F.least("m", "_n"))
    return r.select(*group, "m", F.round("_top", 6).alias("top"))


def composed(rows: DataFrame, by: str, key: str, text: str, n: int, seed: str, sep: str = "\n\n") -> DataFrame:
    """``(by, n, text)``: n drawn texts of each class as one document."""
    some = stratified_sample(rows.select(by, key, text), by, key, n, seed)
    listed = F.sort_array(F.collect_list(F.struct("pos", text)))
    return some.groupBy(by).agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x[text]), sep).alias("text"))


def haystacks(fillers: DataFrame, items: Sequence[str], key: str, text: str, size: str, budget: int, overhead: int = 2) -> DataFrame:
    """``(item, pos, key, text, before)``: for each item its own draw of fillers, in order, until those before have ``budget`` of ``size``.

    Items are few and ride along as an array.
    """
    rows = fillers.select(key, text, size).withColumn("item", F.explode(F.array(*map(F.lit, items))))
    w = W.partitionBy("item").orderBy(F.md5(F.concat("item", F.lit(":"), F.col(key).cast("string"))), key)
    before = F.coalesce(F.sum(F.col(size) + overhead).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.withColumn("before", before).withColumn("pos", F.row_number().over(w) - 1).where(F.col("before") < budget).select("item", "pos", key, text, "before")


def planted(rows: DataFrame, group: str, order: Sequence[Column], text: str, size: str, needle: Column, offset: int | Column, sep: str = "\n\n", overhead: int = 2) -> DataFrame:
    """``(group, n_before, text)``: each group's texts in order as one document, the needle behind those that end at or before the offset."""
    w = W.partitionBy(group).orderBy(*order)
    r = rows.withColumn("_u", F.sum(F.col(size) + overhead).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_i", F.row_number().over(w))
    ahead = F.col("_u") <= (F.lit(offset) if isinstance(offset, int) else offset)
    listed = F.sort_array(F.collect_list(F.struct("_i", text)))
    one = r.groupBy(group).agg(F.count_if(ahead).cast("int").alias("n_before"), F.first(needle).alias("_needle"), F.transform(listed, lambda x: x[text]).alias("_p"))
    parts = F.concat(F.slice("_p", F.lit(1), F.col("n_before")), F.array("_needle"), F.slice("_p", F.col("n_before") + 1, F.size("_p")))
    return one.select(group, "n_before", F.array_join(parts, sep).alias("text"))


def needle_items(spark: SparkSession, n: int = 60, seed: str = "needle", colors: Sequence[str] = ("red", "green", "blue", "amber", "violet"), objects: Sequence[str] = ("box", "door", "lamp", "key", "safe", "drum", "bell")) -> DataFrame:
    """``(item, color, object, code, asked, gold, needle, question)``: facts with a drawn code; every second item asks for another code than its needle has."""
    number = lambda what, m: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.col("item").cast("string"))), 1, 6), 16, 10).cast("long") % m
    rows = spark.range(n).select(F.col("id").alias("item"))
    rows = rows.select("item", F.element_at(F.array(*map(F.lit, colors)), (number("color", len(colors)) + 1).cast("int")).alias("color"), F.element_at(F.array(*map(F.lit, objects)), (number("object", len(objects)) + 1).cast("int")).alias("object"), (1000 + number("code", 9000)).alias("code"))
    gold = F.col("item") % 2 == 0
    rows = rows.withColumn("asked", F.when(gold, F.col("code")).otherwise(1000 + (F.col("code") - 1000 + 1 + number("other", 8999)) % 9000)).withColumn("gold", gold)
    return rows.withColumn("needle", F.format_string("The code of the %s %s is %d.", "color", "object", "code")).withColumn("question", F.format_string("Is the code of the %s %s %d?", "color", "object", "asked"))


def depth_haystacks(contexts: DataFrame, needles: DataFrame, key: str, text: str, budget: int, depths: Sequence[float], sep: str = "\n\n") -> DataFrame:
    """``(item, depth, n_before, n_contexts, text)``: the contexts, in drawn order, up to ``budget`` characters, and each needle ``(item, needle)`` put at a share of them.

    The contexts of a budget are one row; needles and depths ride along, so nothing is joined but that row.
    """
    w = W.orderBy(F.col("_d"), key)
    # Only the first of the draw can be within the budget: each context costs its separator at least.
    some = contexts.select(key, text).withColumn("_d", draw("h", key)).orderBy("_d", key).limit(budget // max(1, len(sep)) + 1)
    some = some.withColumn("_before", F.coalesce(F.sum(F.length(text) + len(sep)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") < budget)
    pile = some.agg(F.transform(F.sort_array(F.collect_list(F.struct("_d", key, text))), lambda x: x[text]).alias("_p"))
    rows = needles.select("item", "needle").withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("_k", F.lit(1))
    rows = rows.join(F.broadcast(pile.withColumn("_k", F.lit(1))), "_k")  # one row of at most the budget and a context
    n = F.floor(F.size("_p") * F.col("depth")).cast("int")
    parts = F.concat(F.slice("_p", F.lit(1), n), F.array("needle"), F.slice("_p", n + 1, F.size("_p")))
    return rows.select("item", "depth", n.alias("n_before"), F.size("_p").alias("n_contexts"), F.array_join(parts, sep).alias("text"))


def prefix_mismatches(part: DataFrame, whole: DataFrame, place: str, value: str) -> DataFrame:
    """``(rows, missing, different)``: whether a table is the beginning of a larger one, place by place."""
    j = part.select(place, F.col(value).alias("_a"), F.lit(1).alias("_h")).join(whole.select(place, F.col(value).alias("_b"), F.lit(1).alias("_w")), place, "left")
    return j.agg(F.count("*").alias("rows"), F.count_if(F.col("_w").isNull()).alias("missing"), F.count_if(F.col("_w").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("different"))


def runs(items: DataFrame, key: str, limit: int, sizes: Sequence[int], arms: Sequence[str]) -> DataFrame:
    """``(key, size, arm)``: the first items by key, each in every size and arm."""
    some = items.select(key).orderBy(key).limit(limit)
    return some.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
