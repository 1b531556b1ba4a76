"""URL filters: prefix rules, and for all other URLs logistic regression on hashed character n-grams of host and path.

Everything is DataFrame and SQL expressions. The labelled URLs are a small table of fixed size; training gathers it into
one row and descends the gradient inside one ``aggregate`` over the rounds, so the model is one row of ``buckets`` + 1 numbers,
whatever the size of the corpus. Scoring is a projection of the URL column alone: no join, no shuffle.

Defined results: the host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path then up to
``?``, ``#`` or the end; of a null URL or one without ``://`` both are empty. Such URLs are judged like any other. Repeated rows are judged
alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import table

BUCKETS = 4096
ROUNDS, RATE, SHRINK = 300, 0.25, 0.002

#: (rule, verdict): a host, and the start of a path.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

# The labelled table: words of hosts that are to be blocked or allowed, each set into the same URL frames.
BLOCKED_WORDS = (
    "casino-slots", "poker-win", "online-casino", "win-money", "spam-list", "spam-mail", "link-farm", "content-farm",
    "cheap-meds", "pills-shop", "diet-pills", "cheap-loans", "adult-video", "adult-cams", "x-videos", "xxx-tube",
    "ads-server", "click-track", "ad-tracker", "track-ads", "free-slots", "sports-bets", "bets-now", "free-prizes",
)
ALLOWED_WORDS = (
    "library", "gardening", "thermal", "theatre", "stations", "nations", "weather", "northern", "motherhood", "history",
    "city-council", "kitchen", "language", "museum", "open-data", "research", "letters", "heritage", "fishing", "science",
    "thoughts", "edition", "notables", "handbook", "author", "harvest", "thirst", "orchard", "tutor", "nearest",
)
FRAMES = (
    "https://www.{}.example.com/en/10", "http://{}.example.net/de/7.html", "https://blog.{}.example.org/fr/123/",
    "http://example.info/{}/page", "https://www.example.com/en/{}.html", "http://my.example.org/{}/",
)


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled URLs ``(url, y)``: y is 1 for those to be blocked."""
    rows = [(f.format(w), y) for y, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)) for w in words for f in FRAMES]
    return spark.sql("select * from values " + ", ".join(f"('{u}', {y})" for u, y in rows) + " as t(url, y)")


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), upper, lower)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ngram_buckets(host: str, path: str, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of the 3-grams and 4-grams of host and path, each with marks at its ends; digits count alike."""
    grams = []
    for part, mark in ((host, "h"), (path, "p")):
        text = f"concat('^', regexp_replace({part}, '[0-9]+', '0'), '$')"
        for n in (3, 4):
            grams.append(
                f"transform(sequence(1, greatest(length({text}) - {n - 1}, 1)), "
                f"i -> cast(pmod(xxhash64('{mark}', substring({text}, i, {n})), {buckets}) as int))"
            )
    return F.expr(f"array_distinct(concat({', '.join(grams)}))")


def train(table_: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Weights of the buckets, then the constant, from a small table ``(url, y)``, by full gradient descent in one expression."""
    rows = (
        table_.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("y").cast("double").alias("y"))
        .select("y", F.sort_array(ngram_buckets("host", "path", buckets)).alias("x"))
        .agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("rows"))
    )
    # holders[b]: positions of the rows that have bucket b. A lambda's argument is computed once, an inlined column every round.
    holders = f"transform(sequence(0, {buckets - 1}), b -> filter(sequence(0, size(rows) - 1), r -> array_contains(rows[r].x, b)))"
    gaps = f"transform(rows, r -> r.y - 1 / (1 + exp(-aggregate(r.x, w[{buckets}], (s, b) -> s + w[b]))))"
    step = (
        f"transform(holders, (h, b) -> w[b] * {1 - RATE * SHRINK} + {RATE} * aggregate(h, 0D, (s, r) -> s + g[r]) / 8)"
    )
    constant = f"w[{buckets}] + {RATE} * aggregate(g, 0D, (s, x) -> s + x) / 8"
    weights = (
        f"transform(array({holders}), holders -> aggregate(sequence(1, {ROUNDS}), array_repeat(0D, {buckets + 1}), "
        f"(w, i) -> transform(array({gaps}), g -> concat({step}, array({constant})))[0]))[0]"
    )
    return rows.select(F.expr(weights).alias("w")).first()["w"]


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    """Whether a rule's host is the URL's or a parent of it, and its path begins the URL's."""
    own, slash, start = rule.partition("/")
    return ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, weights: Sequence[float] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``: the longest rule's verdict, else the model's; score: chance to be blocked."""
    weights = weights or train(labelled(pages.sparkSession), buckets)
    w = "array(" + ",".join(f"{float(x)!r}D" for x in weights) + ")"  # folded to one literal
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.withColumn("_x", ngram_buckets("host", "path", buckets))
    score = F.expr(f"1 / (1 + exp(-aggregate(_x, {float(weights[-1])!r}D, (s, b) -> s + {w}[b])))")
    rule = verdict = None
    for text, kind in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        fits = rule_fits(text, F.col("host"), F.col("path"))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    out = out.withColumn("score", score)
    by_score = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    verdict = by_score if verdict is None else verdict.otherwise(by_score)
    rule = F.lit(None).cast("string") if rule is None else rule
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
