"""Registry of the engine's queries over the driver's tables, and the same queries as DuckDB SQL.

Lines stand for passages (``documents`` have no blank lines), ``labels`` for gold answers, ``benchmark`` and fixed questions for queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askwell.functions.vectors import dot
from askwell.operators import ask as A
from askwell.operators import builders as J
from askwell.operators import chunking as C
from askwell.operators import embedding as E
from askwell.operators import evaluate as I
from askwell.operators import retrieval as R
from askwell.operators import scoring as S
from askwell.plans import validation as V

LANG = S.Question("lang", "choice", "Which language is this passage in", (("english", "the of and to that with"), ("german", "der die und ist nicht ein"), ("french", "le la les des est dans"), ("spanish", "el los que una para con")))
ABUSE = S.Question("abuse", "noul", "idiot stupid moron loser clown trash scum")
DENSITY = S.Question("density", "score", "How dense are the function words", (("of", None), ("the and", None), ("to in is for", None)))
TWO_WAY = S.Question("abuse", "noul", ABUSE.instructions, detector=S.Question("two_way", "choice", "What is said", (("insult", "idiot stupid moron loser"), ("other", "the and of"))), detector_key="insult")
SEARCHES = (("licence", "released under the license version"), ("abuse", "idiot stupid moron"), ("english", "the of the and"))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, decimals as double."""
    def kind(t: T.DataType) -> T.DataType:
        return T.LongType() if isinstance(t, (T.IntegerType, T.ShortType)) else T.DoubleType() if isinstance(t, (T.DecimalType, T.FloatType)) else t

    return df.select(*(F.col(f"`{f.name}`").cast(kind(f.dataType)).alias(f.name) for f in df.schema.fields))


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = lambda spark, sf_dir: _plain(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, counted: bool = False) -> DataFrame:
    return C.paragraphs(_t(spark, sf_dir, "documents"), "\n", counted=counted)


# -- SQL pieces

_SP = "[^ \\t\\n\\r\\f]+"
# Any character that is not white space in Unicode.
_INK = "[^\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
LINES = f"""l0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
l1 AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos {_BEFORE}), 0)::BIGINT AS char_start FROM l0),
l2 AS (SELECT *, len(regexp_extract_all(text, '{_SP}'))::BIGINT AS n FROM l1 WHERE regexp_matches(text, '{_INK}')),
l3 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pos {_BEFORE}), 0)::BIGINT AS tok_start FROM l2),
passages AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS "index", text, tok_start, tok_start + n AS tok_end, char_start, char_start + length(text) AS char_end FROM l3
 UNION ALL SELECT doc_id, 0, coalesce(text, ''), 0, 0, 0, length(coalesce(text, '')) FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '{_INK}'))"""
_TERMS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"


def _logits(q: S.Question) -> str:
    common = lambda text: f"len(list_intersect(t, {_list(list(dict.fromkeys(R.query_terms(text))))}))"
    if q.type == "noul":
        return f"[0.0::DOUBLE, 1.0 * {common(q.instructions)} - 1.0]"
    return "[" + ", ".join(f"ln(1.0::DOUBLE + {common((m or k) if q.type == 'choice' else k)})" for k, m in q.options) + "]"


def _softmax(logits: str, temperature: str = "1.0") -> str:
    z = f"list_transform({logits}, lambda x: exp((x - list_max({logits})) / greatest(0.001, {temperature})))"
    return f"list_transform({z}, lambda e: e / list_sum({z}))"


def _rounded_list(p: str) -> str:
    return f"list_transform({p}, lambda x: round(x, 6))"


def _best(keys: list[str], p: str) -> str:
    r = _rounded_list(p)
    return f"({_list(keys)})[list_position({r}, list_max({r}))]"


def _entropy(p: str) -> str:
    return f"1 + list_sum(list_transform({p}, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(len({p}))"


def _scored(*questions: S.Question) -> str:
    """CTE ``scored(doc_id, index, qid, p)``."""
    parts = [f"SELECT doc_id, \"index\", '{q.qid}' AS qid, {_softmax('z')} AS p FROM (SELECT doc_id, \"index\", {_logits(q)} AS z FROM (SELECT *, {_TERMS} AS t FROM passages))" for q in questions]
    return f"WITH {LINES}, scored AS ({' UNION ALL '.join(parts)})"


def _bm25(searches: tuple[tuple[str, str], ...]) -> str:
    """CTEs up to ``bm(doc_id, index, qid, score)``."""
    words = sorted({w for _, s in searches for w in R.query_terms(s)})
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{k}" for k, w in enumerate(words))
    df = ", ".join(f"sum((tf{k} > 0)::INT) OVER d AS df{k}" for k in range(len(words)))
    at = {w: k for k, w in enumerate(words)}
    one = lambda k: f"(CASE WHEN tf{k} = 0 THEN 0 ELSE ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.5 / (tf{k} + 1.5 * (0.25 + 0.75 * dl / av)) END)"
    rows = " UNION ALL ".join(f"SELECT doc_id, \"index\", '{q}' AS qid, ({' + '.join(one(at[w]) for w in R.query_terms(s))})::DOUBLE AS score FROM b2" for q, s in searches)
    return f"""b0 AS (SELECT doc_id, "index", {_TERMS} AS t FROM passages),
b1 AS (SELECT doc_id, "index", len(t) AS dl, {tf} FROM b0),
b2 AS (SELECT *, count(*) OVER d AS n, avg(dl) OVER d AS av, {df} FROM b1 WINDOW d AS (PARTITION BY doc_id)),
bm AS ({rows}),
br AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, qid ORDER BY round(score, 9) DESC, "index") - 1)::BIGINT AS pos FROM bm)"""


# -- C: passages and windows


@query(f"WITH {LINES} SELECT * FROM passages")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


def _windows_sql(size: int, stride: int) -> str:
    lead = "length(regexp_extract(text, '^[ \\t\\n\\r\\f]*'))"
    chars = lambda n: f"coalesce(list_sum(list_transform(t[1:{n}], lambda x: length(x))), 0)"
    return f"""WITH w0 AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+[ \\t\\n\\r\\f]*') AS t FROM documents),
w1 AS (SELECT *, len(t)::BIGINT AS n, CASE WHEN len(t) <= {size} THEN 1 ELSE ceil((len(t) - {size}) / {stride}.0)::BIGINT + 1 END AS k FROM w0),
w2 AS (SELECT * REPLACE (CASE WHEN k > 1 AND n - (k - 1) * {stride} < {size // 4} THEN k - 1 ELSE k END AS k) FROM w1),
w3 AS (SELECT *, unnest(range(0, k)) AS part FROM w2),
w4 AS (SELECT *, part * {stride} AS a, CASE WHEN part = k - 1 THEN n ELSE part * {stride} + {size} END AS b FROM w3),
w5 AS (SELECT *, CASE WHEN n <= {size} THEN 0 ELSE {lead} + {chars('a')} END AS f, CASE WHEN n <= {size} THEN length(text) ELSE {lead} + {chars('b')} - length(regexp_extract(t[b], '[ \\t\\n\\r\\f]*$')) END AS u FROM w4)
SELECT doc_id, part::BIGINT AS "index", substring(text, f::BIGINT + 1, (u - f)::BIGINT) AS text, a::BIGINT AS tok_start, b::BIGINT AS tok_end, f::BIGINT AS char_start, u::BIGINT AS char_end FROM w5"""


@query(_windows_sql(200, 100))
def token_windows_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_windows(_t(spark, sf_dir, "documents"), 200, 100)


@query(_windows_sql(64, 64))
def token_windows_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_windows(_t(spark, sf_dir, "documents"), 64, 64)


@query(f"WITH {LINES} SELECT doc_id, count(*)::BIGINT AS n_chunks, sum(greatest(0, tok_end - tok_start))::BIGINT AS n_tokens FROM passages GROUP BY doc_id")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_totals(_lines(spark, sf_dir))


@query(f"""WITH {LINES}, o AS (SELECT doc_id, tok_start, tok_end - tok_start AS n, CASE WHEN tok_end - tok_start <= 40 THEN 1 ELSE ceil((tok_end - tok_start - 40) / 20.0)::BIGINT + 1 END AS k0 FROM passages),
o2 AS (SELECT *, CASE WHEN k0 > 1 AND n - (k0 - 1) * 20 < 10 THEN k0 - 1 ELSE k0 END AS k FROM o)
SELECT doc_id, sum(k)::BIGINT AS n_chunks, sum(CASE WHEN k = 1 THEN n ELSE (k - 1) * 40 + n - (k - 1) * 20 END)::BIGINT AS n_tokens FROM o2 GROUP BY doc_id""")
def oversize_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_totals(C.paragraphs(_t(spark, sf_dir, "documents"), "\n", 40))


@query(f"""SELECT doc_id, (row_number() OVER w - 1)::BIGINT AS "index", text, coalesce(sum(n) OVER (w {_BEFORE}), 0)::BIGINT AS tok_start, (coalesce(sum(n) OVER (w {_BEFORE}), 0) + n)::BIGINT AS tok_end
FROM (SELECT conv_id AS doc_id, turn, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '{_SP}')) AS n FROM conversations) WINDOW w AS (PARTITION BY doc_id ORDER BY turn)""")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.turns(_t(spark, sf_dir, "conversations"))


# -- D: lexical index and ranking

_POST = f'WITH {LINES}, post AS (SELECT doc_id, "index", term, count(*)::BIGINT AS tf FROM (SELECT doc_id, "index", unnest({_TERMS}) AS term FROM passages) GROUP BY ALL)'


@query(f"{_POST} SELECT * FROM post")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_frequency(_lines(spark, sf_dir))


@query(f"{_POST} SELECT doc_id, term, count(*)::BIGINT AS df FROM post GROUP BY ALL")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.doc_frequency(R.term_frequency(_lines(spark, sf_dir)))


@query(f"WITH {LINES} SELECT doc_id, count(*)::BIGINT AS n, round(avg(len({_TERMS})), 6) AS avgdl FROM passages GROUP BY doc_id")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus_stats(_lines(spark, sf_dir))


@query(f'WITH {LINES}, {_bm25(SEARCHES)} SELECT doc_id, "index", qid, round(score, 6) AS score FROM bm')
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_scores(_lines(spark, sf_dir), SEARCHES).withColumn("score", F.round("score", 6))


@query(f'WITH {LINES}, {_bm25(SEARCHES)} SELECT doc_id, "index", qid, round(score, 6) AS score, pos FROM br WHERE pos = 0')
def bm25_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(R.bm25_scores(_lines(spark, sf_dir), SEARCHES), 1).withColumn("score", F.round("score", 6))


@query(f"""WITH {LINES}, {_bm25(SEARCHES)} SELECT doc_id, qid, array_to_string(list("index"::VARCHAR ORDER BY "index"), ',') AS passages FROM br WHERE pos < 5 GROUP BY doc_id, qid""")
def bm25_topk_doc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.top_k(R.bm25_scores(_lines(spark, sf_dir), SEARCHES), 5)
    listed = F.array_join(F.sort_array(F.collect_list(F.col("index").cast("int"))).cast("array<string>"), ",")
    return best.groupBy("doc_id", "qid").agg(listed.alias("passages"))


@query("""SELECT * FROM (VALUES
('lang', 'Which language is this passage in the of and to that with der die und ist nicht ein le la les des est dans el los que una para con', 'Which language is this passage in the of and to that with der die und ist nicht ein le la les des est dans el los que una para con'),
('abuse', 'idiot stupid moron loser clown trash scum', 'idiot stupid moron loser clown trash scum'),
('density', 'How dense are the function words of the and to in is for', 'How dense are the function words of the and to in is for'),
('bare', 'Which one None some meaning', 'Which one some meaning')) AS t(qid, library, service)""")
def question_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = S.Question("bare", "choice", "Which one", (("a name", None), ("another", "some meaning")))
    return spark.createDataFrame([(q.qid, S.query_text(q), S.query_text(q, skip_null=True)) for q in (LANG, ABUSE, DENSITY, bare)], "qid string, library string, service string")


# -- E: dense ranking, fusion, recall

_DENSE = """WITH d AS (SELECT q.vec_id AS qid, v.vec_id AS id, v.label, q.label AS want, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) - 1)::BIGINT AS pos FROM d QUALIFY pos < 50)"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every vector whose id is divisible by 100, against all vectors."""
    e = _t(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.dense_top_k(v, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")))


@query(f"{_DENSE} SELECT qid, id, sim, pos FROM r")
def dense_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


@query(f"""{_DENSE}, a AS (SELECT qid, id AS "index", pos FROM r UNION ALL SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY md5('b:' || id::VARCHAR), id) - 1) FROM r),
f AS (SELECT qid, "index", sum(1.0::DOUBLE / (60 + pos)) AS rrf FROM a GROUP BY ALL)
SELECT qid, "index", round(rrf, 6) AS rrf, (row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, "index") - 1)::BIGINT AS pos FROM f""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    a = _dense(spark, sf_dir).withColumnRenamed("id", "index")
    b = a.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy(J.draw("b", "index"), "index")) - 1)
    return R.fused([a, b], ["qid"]).withColumn("rrf", F.round("rrf", 6))


@query(f"""{_DENSE.split("r AS (")[0]}r AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) - 1)::BIGINT AS pos FROM d),
f AS (SELECT qid, min(pos) AS pos FROM r WHERE label = want AND id <> qid GROUP BY qid), g AS (SELECT e.vec_id, f.pos FROM embeddings e LEFT JOIN f ON f.qid = e.vec_id WHERE e.vec_id % 100 = 0)
SELECT count(*)::BIGINT AS n, {', '.join(f'round(avg(coalesce(pos < {k}, false)::INT::DOUBLE), 6) AS recall_{k}' for k in (1, 3, 5, 10, 20, 50))}, median(pos)::DOUBLE AS median_pos FROM g""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's target is the nearest other vector of its label, wherever it ranks among all vectors."""
    e = _t(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return R.recall_at(R.target_ranks(v, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"), F.col("label").alias("want"))))


# -- F: scoring and projections


def _answers(spark: SparkSession, sf_dir: str, q: S.Question, temperatures: dict | None = None) -> DataFrame:
    rows = _lines(spark, sf_dir).select("doc_id", "index", "text")
    return S.answers(S.calibrated(S.LexicalScorer().score(rows, [q]), temperatures))


@query(f"""WITH {LINES} SELECT doc_id, "index", round(p[1], 6) AS p1, round(p[2], 6) AS p2, round(p[3], 6) AS p3, round(p[4], 6) AS p4 FROM (SELECT doc_id, "index", {_softmax('z', '0.5')} AS p FROM (SELECT doc_id, "index", {_logits(LANG)} AS z FROM (SELECT *, {_TERMS} AS t FROM passages)))""")
def softmax_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir, LANG, {("choice", 4): 0.5, "choice": 3.0})
    return a.select("doc_id", "index", *(F.round(F.col("p")[i], 6).alias(f"p{i + 1}") for i in range(4)))


@query(f"""{_scored(LANG)} SELECT doc_id, "index", {_best(LANG.keys, 'p')} AS choice, round({_entropy('p')}, 6) AS confidence FROM scored""")
def choice_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, LANG).select("doc_id", "index", "choice", "confidence")


@query(f"""{_scored(DENSITY)} SELECT doc_id, "index", round(p[2] + 2 * p[3], 6) AS level, round({_entropy('p')}, 6) AS confidence FROM scored""")
def score_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, DENSITY).select("doc_id", "index", "level", "confidence")


@query(f"""{_scored(ABUSE)} SELECT doc_id, "index", round(p[2], 6) AS yes, round(greatest(p[1], p[2]), 6) AS confidence FROM scored""")
def noul_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, ABUSE).select("doc_id", "index", "yes", "confidence")


@query("""WITH k AS (SELECT sha1(text) AS key, doc_id FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT sha1(d.text) AS key FROM documents d JOIN labels l USING (doc_id))
SELECT count(*)::BIGINT AS "rows", count(c.key)::BIGINT AS hits, (count(*) - count(c.key))::BIGINT AS misses FROM k LEFT JOIN c USING (key)""")
def cache_hits_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha1("text").alias("key"))
    cache = docs.join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("key", F.col("doc_id").alias("seq"))
    return S.cache_stats(docs, cache)


@query(f"""WITH {LINES} SELECT doc_id, sum(len({_TERMS}) + {len(R.query_terms(S.query_text(LANG)))} + len({_TERMS}) + {len(R.query_terms(S.query_text(ABUSE)))})::BIGINT AS tokens, round(sum(len({_TERMS}) + {len(R.query_terms(S.query_text(LANG)))} + len({_TERMS}) + {len(R.query_terms(S.query_text(ABUSE)))}) * 0.25 / 1000000.0, 9) AS cost FROM passages GROUP BY doc_id""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.LexicalScorer().score(_lines(spark, sf_dir).select("doc_id", "index", "text"), [LANG, ABUSE])
    return rows.groupBy("doc_id").agg(F.sum("seq_len").alias("tokens"), F.round(I.cost("seq_len", 0.25), 9).alias("cost"))


# -- G: asking


def _ask_sql(q: S.Question, mode: str, gate: bool, k: int | None = None) -> str:
    """One question asked of all documents, as SQL."""
    base = q.detector if q.detector is not None else q
    gq = A.gate_question(q)
    sel = f"SELECT p.*, count(*) OVER (PARTITION BY doc_id) AS n_chunks, {_TERMS} AS t FROM passages p"
    ctes = [LINES]
    if k is not None:
        ctes.append(_bm25(((q.qid, S.query_text(q, True)),)))
        sel = f'SELECT * FROM ({sel}) JOIN (SELECT doc_id, "index" FROM br WHERE pos < {k}) USING (doc_id, "index")'
    ctes.append(f"s0 AS ({sel})")
    n = {"noul": 2}.get(q.type, len(q.keys))
    ctes.append(f"s1 AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_scored, {_logits(q)} AS z, {_logits(base)} AS zd, {_logits(gq)} AS zg FROM s0)")
    p = _softmax("z")
    if q.detector is not None:
        at = q.detector.keys.index(q.detector_key) + 1
        d = f"({_softmax('zd')})[{at}]"
        p = f"CASE WHEN n_chunks > 1 THEN [1 - {d}, {d}] ELSE {p} END"
    g = f"CASE WHEN n_scored > 1 THEN ({_softmax('zg')})[2] ELSE 1.0 END" if gate else "1.0::DOUBLE"
    own = len(R.query_terms(S.query_text(q)))
    used = f"CASE WHEN n_chunks > 1 THEN {len(R.query_terms(S.query_text(base)))} ELSE {own} END" if q.detector is not None else str(own)
    extra = f" + CASE WHEN n_scored > 1 THEN len(t) + {len(R.query_terms(S.query_text(gq)))} ELSE 0 END" if gate else ""
    ctes.append(f's2 AS (SELECT doc_id, "index", n_chunks, n_scored, {p} AS p, {g} AS g, len(t) + {used}{extra} AS tokens FROM s1)')
    ctes.append("s3 AS (SELECT *, g / sum(g) OVER (PARTITION BY doc_id) AS w FROM s2)")
    tail = "any_value(n_chunks)::BIGINT AS n_chunks, count(*)::BIGINT AS n_scored, sum(tokens)::BIGINT AS tokens"
    if q.type == "noul":
        v = {"max": "max(p[2])", "any": "1 - product(1 - p[2])", "mean": "sum(p[2] * w)"}[mode]
        ctes.append(f"s4 AS (SELECT doc_id, {v} AS v, {tail} FROM s3 GROUP BY doc_id)")
        return f"WITH {', '.join(ctes)} SELECT doc_id, '{q.qid}' AS qid, CASE WHEN n_chunks = 1 THEN 'passthrough' ELSE '{mode}' END AS agg, round(v, 6) AS answer_value, NULL::VARCHAR AS answer_key, round(greatest(v, 1 - v), 6) AS confidence, n_chunks, n_scored, tokens FROM s4"
    mix = "[" + ", ".join(f"sum(p[{i}] * w)" for i in range(1, n + 1)) + "]"
    logs = "[" + ", ".join(f"sum(ln(greatest(0.000001, least(1.0, p[{i}]))) * w)" for i in range(1, n + 1)) + "]"
    ctes.append(f"s4 AS (SELECT doc_id, {mix} AS mix, {logs} AS logs, {tail} FROM s3 GROUP BY doc_id)")
    loglinear = f"CASE WHEN n_chunks > 1 THEN {_softmax('logs')} ELSE mix END"
    ctes.append(f"s5 AS (SELECT *, {loglinear if mode == 'loglinear' else 'mix'} AS p FROM s4)")
    value = "round(" + " + ".join(f"{i} * mix[{i + 1}]" for i in range(n)) + ", 6)" if q.type == "score" else "round(list_max(p), 6)"
    key = _best(q.keys, "p") if q.type == "choice" else "NULL::VARCHAR"
    return f"WITH {', '.join(ctes)} SELECT doc_id, '{q.qid}' AS qid, CASE WHEN n_chunks = 1 THEN 'passthrough' ELSE '{mode}' END AS agg, {value} AS answer_value, {key} AS answer_key, round({_entropy('p')}, 6) AS confidence, n_chunks, n_scored, tokens FROM s5"


def _ask_query(name: str, q: S.Question, mode: str, gate: bool, k: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return A.ask(_lines(spark, sf_dir, True), [q], "bm25" if k else None, k or 1, gate, {q.qid: mode})

    run.__name__ = name
    query(_ask_sql(q, mode, gate, k))(run)


_ask_query("agg_max", ABUSE, "max", False)
_ask_query("agg_any", ABUSE, "any", False)
_ask_query("agg_mean_weighted", ABUSE, "mean", True)
_ask_query("agg_mixture", LANG, "mixture", True)
_ask_query("agg_loglinear", LANG, "loglinear", True)
_ask_query("agg_expected", DENSITY, "mixture", True)
_ask_query("ask_score_loglinear", DENSITY, "loglinear", False)
_ask_query("ask_locate", LANG, "mixture", True, 3)
_ask_query("ask_locate_top1", ABUSE, "max", False, 1)
_ask_query("ask_detector", TWO_WAY, "max", False)


@query(" UNION ALL ".join(f"SELECT * FROM ({_ask_sql(q, m, g)})" for q, m, g in ((LANG, "mixture", True), (ABUSE, "max", False), (DENSITY, "mixture", True))))
def ask_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ask(_lines(spark, sf_dir, True), [LANG, ABUSE, DENSITY])


# The state's words: those of its note and of its field names, and each passage's answer.
_STACK_SQL = f"""{_scored(LANG)}, st AS (SELECT doc_id, 'note each part is one section of a longer document judged independently parts relevance answer p ' || string_agg({_best(LANG.keys, 'p')}, ' ') AS text, count(*) AS n, any_value(p) AS own FROM scored GROUP BY doc_id),
s2 AS (SELECT doc_id, CASE WHEN n = 1 THEN own ELSE {_softmax('z')} END AS p, n FROM (SELECT *, {_logits(LANG)} AS z FROM (SELECT *, {_TERMS} AS t FROM st)))
SELECT doc_id, CASE WHEN n = 1 THEN 'passthrough' ELSE 'stack' END AS agg, {_best(LANG.keys, 'p')} AS answer_key, round(list_max(p), 6) AS answer_value, round({_entropy('p')}, 6) AS confidence, n::BIGINT AS n_scored FROM s2"""


@query(_STACK_SQL)
def stack_second_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ask(_lines(spark, sf_dir, True), [LANG], agg={"choice": "stack"}).select("doc_id", "agg", "answer_key", "answer_value", "confidence", "n_scored")


@query(f"WITH {LINES}, n AS (SELECT doc_id, count(*) AS n FROM passages GROUP BY doc_id) SELECT doc_id, n::BIGINT AS n_chunks, (n * 3)::BIGINT AS scored, (CASE WHEN n > 1 THEN n * 2 ELSE 0 END)::BIGINT AS gates, (n * 3 + CASE WHEN n > 1 THEN n * 2 ELSE 0 END)::BIGINT AS \"rows\", CASE WHEN n > 256 THEN 'scan' WHEN n * 3 + CASE WHEN n > 1 THEN n * 2 ELSE 0 END > 4096 THEN 'rows' END AS refused FROM n")
def row_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.admit(A.row_estimate(_lines(spark, sf_dir, True), [LANG, ABUSE, DENSITY]))


@query(f"WITH {LINES}, n AS (SELECT doc_id, least(count(*), 40) AS n FROM passages GROUP BY doc_id) SELECT doc_id, (n * 3)::BIGINT AS scored, CASE WHEN n * 3 + CASE WHEN n > 1 THEN n * 2 ELSE 0 END > 100 THEN 'rows' END AS refused FROM n")
def row_estimate_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located passages under a lower limit of rows: the bound on passages is for scans only."""
    estimate = A.row_estimate(_lines(spark, sf_dir, True), [LANG, ABUSE, DENSITY], "bm25", 40)
    return V.admit(estimate, V.Limits(max_rows=100, max_scan=1), scan=False).select("doc_id", "scored", "refused")


_REQUESTS = (
    ("ok", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": "x"}}}, "ok"),
    ("no_state", {"questions": {}}, "422 state"),
    ("empty_text", {"state": [{"text": " "}], "questions": {}}, "422 text"),
    ("bad_type", {"state": [{"text": "a"}], "questions": {"q": {"type": "x", "instructions": "x"}}}, "422 type"),
    ("one_label", {"state": [{"text": "a"}], "questions": {"q": {"type": "choice", "instructions": "x", "criteria": {"a": None}}}}, "422 criteria"),
    ("bool_top_k", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": "x"}}, "top_k": True}, "422 top_k"),
    ("body", [], "400 body"),
    ("two_states", {"state": [{"text": "a"}, {"text": "b"}], "questions": {}}, "422 one_state"),
    ("long_text", {"state": [{"text": "a" * 4_000_001}], "questions": {}}, "413 too_long"),
    ("empty_rubric", {"state": [{"text": "a", "rubric": ""}], "questions": {}}, "422 rubric"),
    ("no_questions", {"state": [{"text": "a"}], "questions": {}}, "422 questions"),
    ("many_questions", {"state": [{"text": "a"}], "questions": {f"q{i}": {"type": "noul", "instructions": "x"} for i in range(17)}}, "422 too_many_questions"),
    ("empty_id", {"state": [{"text": "a"}], "questions": {"": {"type": "noul", "instructions": "x"}}}, "422 question"),
    ("blank_instructions", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": " "}}}, "ok"),
    ("no_instructions", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": ""}}}, "422 instructions"),
    ("long_label", {"state": [{"text": "a"}], "questions": {"q": {"type": "choice", "instructions": "x", "criteria": {"a" * 201: None, "b": None}}}}, "422 label"),
    ("one_rung", {"state": [{"text": "a"}], "questions": {"q": {"type": "score", "instructions": "x", "criteria": ["a"]}}}, "422 rungs"),
    ("noul_criteria", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": "x", "criteria": {}}}}, "422 noul_criteria"),
    ("bad_strategy", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": "x"}}, "strategy": "guess"}, "422 strategy"),
    ("agg_list", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": "x"}}, "agg": []}, "422 agg"),
    ("agg_by_type", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": "x"}}, "agg": {"noul": "any"}}, "422 agg_mode"),
    ("noul_stack", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": "x"}}, "agg": {"q": "stack"}}, "422 agg_mode"),
    ("detectors_zero", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": "x"}}, "detectors": 0}, "422 detectors"),
    ("detector_target", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": "x"}}, "detectors": {"z": []}}, "422 detector_target"),
    ("detector_map", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": "x"}}, "detectors": {"q": {}}}, "422 detector"),
    ("detector_option", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": "x"}}, "detectors": {"q": [{"type": "choice", "instructions": "x", "criteria": {"a": None, "b": None}}, "c"]}}, "422 detector_option"),
    ("detector", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": "x"}}, "detectors": {"q": [{"type": "choice", "instructions": "x", "criteria": {"a": None, "b": None}}, "b"]}}, "ok"),
    ("detail_number", {"state": [{"text": "a"}], "questions": {"q": {"type": "noul", "instructions": "x"}}, "detail": 1}, "422 detail"),
    ("score_loglinear", {"state": [{"text": "a"}], "questions": {"q": {"type": "score", "instructions": "x", "criteria": ["a", "b"]}}, "agg": {"q": "loglinear"}}, "422 agg_mode"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{e}')" for n, _, e in _REQUESTS) + ") AS t(request, outcome)")
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, body, _ in _REQUESTS:
        try:
            V.validate(body)
            rows.append((name, "ok"))
        except V.Refusal as e:
            rows.append((name, f"{e.status} {e.code}"))
    return spark.createDataFrame(rows, "request string, outcome string")


_P6 = lambda p, n: "[" + ", ".join(f"round({p}[{i}], 6)" for i in range(1, n + 1)) + "]"


@query(f"""{_scored(LANG, ABUSE, DENSITY)}, a AS (SELECT doc_id, qid, count(*) AS n, avg(p[1]) AS p1, avg(p[2]) AS p2, avg(p[3]) AS p3, avg(p[4]) AS p4, max(p[2]) AS yes FROM scored GROUP BY doc_id, qid)
SELECT doc_id, qid, CASE qid WHEN 'abuse' THEN 'noul' WHEN 'lang' THEN 'choice' ELSE 'score' END AS type, CASE WHEN qid = 'abuse' THEN round(yes, 6) END AS noul,
CASE WHEN qid = 'lang' THEN {_best(LANG.keys, '[p1, p2, p3, p4]')} END AS choice, CASE WHEN qid = 'density' THEN round(p2 + 2 * p3, 6) END AS score,
CASE qid WHEN 'lang' THEN 'english|german|french|spanish' WHEN 'density' THEN 'of|the and|to in is for' END AS options, CASE WHEN qid <> 'abuse' THEN round(p1, 6) END AS first, CASE WHEN n = 1 THEN 'passthrough' WHEN qid = 'abuse' THEN 'max' ELSE 'mixture' END AS agg, n::BIGINT AS n_scored FROM a""")
def projected_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ungated answers of all three types, as the service gives their fields."""
    from askwell.plans.service import projected

    rows = projected(A.ask(_lines(spark, sf_dir, True), [LANG, ABUSE, DENSITY], gate=False, detail=True), [LANG, ABUSE, DENSITY])
    options = F.array_join(F.transform("probabilities", lambda x: x["key"]), "|")
    return rows.select("doc_id", "qid", "type", "noul", "choice", "score", options.alias("options"), F.col("probabilities")[0]["p"].alias("first"), "agg", "n_scored")


@query(f"""{_scored(LANG)}, a AS (SELECT doc_id, [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4])] AS p FROM scored GROUP BY doc_id),
g AS (SELECT p, lang, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 WHEN 'es' THEN 4 END AS k FROM a JOIN documents USING (doc_id))
SELECT lang, count(*)::BIGINT AS n, round(avg(({_best(LANG.keys, 'p')} = ({_list(LANG.keys)})[k])::INT::DOUBLE), 6) AS accuracy, round(avg(p[k]), 6) AS mean_p_gold FROM g WHERE k IS NOT NULL GROUP BY lang""")
def multiclass_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.element_at(F.create_map(*(F.lit(x) for x in ("en", "english", "de", "german", "fr", "french", "es", "spanish"))), F.col("lang"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("lang").isin("en", "de", "fr", "es"), gold).alias("gold"))
    return I.multiclass(A.ask(_lines(spark, sf_dir, True), [LANG], gate=False, detail=True).join(docs, "doc_id"), group=["lang"])


@query(f"""WITH {LINES}, n AS (SELECT doc_id, count(*) AS n FROM passages GROUP BY doc_id), q AS (SELECT unnest(['lang', 'abuse']) AS qid)
SELECT qid, count(*)::BIGINT AS n, round(avg(n), 6) AS mean_n_chunks, round(avg(least(n, 3)), 6) AS mean_n_scored FROM n, q GROUP BY qid""")
def mean_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.workload(A.ask(_lines(spark, sf_dir, True), [LANG, ABUSE], "bm25", 3)).drop("mean_tokens")


# -- I: metrics, on the largest abuse chance of a document's lines against its label


def _doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.ask(_lines(spark, sf_dir, True), [ABUSE], gate=False, agg={"abuse": "any"})
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    gold = _t(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("gold"))
    return s.select("doc_id", F.col("answer_value").alias("score")).join(gold, "doc_id").join(docs, "doc_id")


_DOCS = f"WITH a AS ({_ask_sql(ABUSE, 'any', False)}), s AS (SELECT a.doc_id, answer_value AS score, l.toxic = 1 AS gold, d.lang, d.n_chars FROM a JOIN labels l USING (doc_id) JOIN documents d USING (doc_id))"
_AUC = "round(sum(CASE WHEN gold THEN mid END) / nullif(count_if(gold) * count_if(NOT gold), 0) - (count_if(gold) + 1) / 2.0 / nullif(count_if(NOT gold), 0), 6) AS auc, count_if(gold)::BIGINT AS n_pos, count_if(NOT gold)::BIGINT AS n_neg"


@query(f"{_DOCS}, m AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM s) SELECT {_AUC} FROM m")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.auc(_doc_scores(spark, sf_dir))


@query(f"{_DOCS}, m AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS mid FROM s) SELECT lang, {_AUC} FROM m GROUP BY lang")
def auc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.auc(_doc_scores(spark, sf_dir), ["lang"])


@query()
def auc_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the resamples' multiplicities come from a hash that only one engine has."""
    return I.auc_bootstrap(_doc_scores(spark, sf_dir), "doc_id")


@query(f"{_DOCS}, n AS (SELECT list_sort(list(score)) AS v FROM s WHERE NOT gold), t AS (SELECT v[least(len(v) - 1, floor(0.9 * len(v))::BIGINT) + 1] AS threshold FROM n) SELECT threshold, round(avg((score >= threshold)::INT::DOUBLE), 6) AS recall FROM s, t WHERE gold GROUP BY threshold")
def recall_at_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.recall_at_spec(_doc_scores(spark, sf_dir))


@query(f"{_DOCS}, v AS (SELECT lang, list_sort(list(score)) AS v, count(*) AS n FROM s GROUP BY lang) SELECT lang, v[n // 4 + 1] AS q1, v[n // 2 + 1] AS q2, v[3 * n // 4 + 1] AS q3 FROM v")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.order_quartiles(_doc_scores(spark, sf_dir), ["lang"])


@query(f"{_DOCS}, p AS (SELECT list_sort(list(score)) AS v FROM s WHERE gold), t AS (SELECT v[len(v) // 5 + 1] AS threshold FROM p) SELECT threshold, round(avg((score >= threshold)::INT::DOUBLE), 6) AS fp_rate, round(avg((score >= threshold)::INT::DOUBLE) * 69, 6) AS expected_fp FROM s, t WHERE NOT gold GROUP BY threshold")
def fp_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fp_at_recall(_doc_scores(spark, sf_dir))


_SUMMARY = "count(*)::BIGINT AS n, round(avg(((score >= 0.5) = gold)::INT::DOUBLE), 6) AS accuracy, round(avg((score BETWEEN 0.3 AND 0.7)::INT::DOUBLE), 6) AS in_band, count_if(score > 0.2)::BIGINT AS over_0_2, count_if(score > 0.5)::BIGINT AS over_0_5, count_if(score > 0.9)::BIGINT AS over_0_9, max(score) AS most, round(median(score), 6) AS median, round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.95), 6) AS p95, round(avg(CASE WHEN gold THEN score END), 6) AS mean_pos, round(avg(CASE WHEN NOT gold THEN score END), 6) AS mean_neg"


@query(f"{_DOCS} SELECT lang, {_SUMMARY} FROM s GROUP BY lang")
def grouped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.summary(_doc_scores(spark, sf_dir), ["lang"])


_DEPTH = "CASE WHEN d < 0.34 THEN 'start' WHEN d < 0.67 THEN 'middle' WHEN d < 1.01 THEN 'end' END"


@query(f"""{_scored(ABUSE)} SELECT bin, count(*)::BIGINT AS n, round(avg(p[2]), 6) AS mean, count_if(round(p[2], 6) >= 0.5)::BIGINT AS hits FROM (SELECT p, {_DEPTH} AS bin FROM (SELECT p, "index" / greatest(1, count(*) OVER (PARTITION BY doc_id) - 1) AS d FROM scored)) GROUP BY bin""")
def depth_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    a = _answers(spark, sf_dir, ABUSE)
    a = a.withColumn("d", F.col("index") / F.greatest(F.lit(1), F.count("*").over(W.partitionBy("doc_id")) - 1)).withColumn("bin", I.depth_bin("d"))
    return a.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(F.col("p")[1]), 6).alias("mean"), F.count_if(F.col("yes") >= 0.5).alias("hits"))


# -- J, K: builders, ensembles, cascades


@query("SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY md5('s:' || doc_id::VARCHAR), doc_id) - 1)::BIGINT AS pos FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('s:' || doc_id::VARCHAR), doc_id) <= 10")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.stratified_sample(_t(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 10, "s")


_ORDER = "PARTITION BY doc_id ORDER BY md5('f:' || \"index\"::VARCHAR), \"index\""


def _drawn() -> list:
    return [J.draw("f", "index"), F.col("index")]


@query(f'WITH {LINES} SELECT * FROM (SELECT doc_id, "index", coalesce(sum(tok_end - tok_start + 2) OVER ({_ORDER} {_BEFORE}), 0)::BIGINT AS before FROM passages) WHERE before < 100')
def token_budget_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("n", F.col("tok_end") - F.col("tok_start"))
    return J.token_budget_fill(rows, "doc_id", _drawn(), "n", 100).select("doc_id", "index", "before")


@query(f'WITH {LINES} SELECT doc_id, count_if(u <= 60)::BIGINT AS n_before FROM (SELECT doc_id, sum(tok_end - tok_start + 2) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u FROM passages) GROUP BY doc_id')
def needle_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("n", F.col("tok_end") - F.col("tok_start"))
    return J.offset_prefix(rows, "doc_id", _drawn(), "n", 60)


@query("""SELECT doc_id, w AS place, array_to_string(CASE w WHEN 'none' THEN a WHEN 'start' THEN list_concat(['NEEDLE'], a) WHEN 'end' THEN list_concat(a, ['NEEDLE']) ELSE list_concat(list_concat(a[1:len(a) // 2], ['NEEDLE']), a[len(a) // 2 + 1:]) END, '|') AS text
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a, unnest(['start', 'middle', 'end', 'none']) AS w FROM documents)""")
def needle_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("a"))
    made = [F.struct(F.lit(w).alias("place"), F.array_join(J.place(F.col("a"), F.lit("NEEDLE"), w), "|").alias("text")) for w in ("start", "middle", "end", "none")]
    return docs.select("doc_id", F.explode(F.array(*made)).alias("m")).select("doc_id", "m.place", "m.text")


@query("SELECT min(doc_id) AS doc_id, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') AS t FROM documents) WHERE length(t) >= 300 GROUP BY t")
def whitespace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.normalised_unique(_t(spark, sf_dir, "documents"), "doc_id", "text", 300).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def relabel_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _t(spark, sf_dir, "labels").where("toxic = 1")
    return J.without(_t(spark, sf_dir, "documents").select("doc_id", "lang"), bad, "doc_id")


@query(f"""{_scored(ABUSE)}, n AS (SELECT doc_id, p[2] AS s, row_number() OVER ({_ORDER}) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM scored),
m AS (SELECT unnest([1, 4, 16, 64]) AS m) SELECT doc_id, m::BIGINT AS m, round(max(s), 6) AS top FROM n, m WHERE i <= m GROUP BY doc_id, m""")
def nested_haystack_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir, ABUSE).withColumn("s", F.col("p")[1])
    return J.nested_max(rows, "doc_id", _drawn(), "s", (1, 4, 16, 64))


_PAIR = f"""{_scored(ABUSE)}, pair AS (SELECT s.doc_id, s."index", s.p[2] AS a, ({_softmax('z')})[1] AS b FROM scored s JOIN (SELECT doc_id, "index", {_logits(TWO_WAY.detector)} AS z FROM (SELECT *, {_TERMS} AS t FROM passages)) USING (doc_id, "index"))"""


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two detectors' scores of every line, from one scoring pass."""
    rows = S.calibrated(S.LexicalScorer().score(_lines(spark, sf_dir).select("doc_id", "index", "text"), [ABUSE, TWO_WAY.detector]))
    first = F.col("qid") == "abuse"
    return rows.groupBy("doc_id", "index").agg(F.max(F.when(first, F.col("p")[1])).alias("a"), F.max(F.when(~first, F.col("p")[0])).alias("b"))


@query(f"{_PAIR} SELECT doc_id, round(max(a), 6) AS max_a, round(max((a + b) / 2), 6) AS max_mean, round(max(least(a, b)), 6) AS max_min FROM pair GROUP BY doc_id")
def ensemble_min_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ensembles(_pair(spark, sf_dir))


@query(f'{_PAIR}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(a, 6) DESC, "index") AS r FROM pair) SELECT doc_id, round(max(least(a, b)), 6) AS two_stage FROM r WHERE r <= 20 GROUP BY doc_id')
def two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.two_stage(_pair(spark, sf_dir))


_ARMS = f"{_PAIR}, e AS (SELECT doc_id, max(a) AS a, max((a + b) / 2) AS mean, max(least(a, b)) AS least FROM pair GROUP BY doc_id), l AS (SELECT doc_id, a AS base, unnest(['a', 'mean', 'least']) AS arm, unnest([round(a, 6), round(mean, 6), round(least, 6)]) AS v FROM e)"


@query(f"{_ARMS} SELECT arm, count(*)::BIGINT AS n, round(avg(v), 6) AS mean, round(avg(v - round(base, 6)), 6) AS mean_difference, count_if(v - round(base, 6) > 0)::BIGINT AS better, count_if(v - round(base, 6) < 0)::BIGINT AS worse FROM l GROUP BY arm")
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.ensembles(_pair(spark, sf_dir))
    arms = F.array(*(F.struct(F.lit(n).alias("arm"), F.col(c).alias("value")) for n, c in (("a", "max_a"), ("mean", "max_mean"), ("least", "max_min"))))
    return I.paired(e.select(F.col("doc_id").alias("item"), F.explode(arms).alias("x")).select("item", "x.*"), ["a", "mean", "least"])


@query(f"""{_PAIR}, d AS (SELECT doc_id, "index", unnest(['a', 'mean', 'least']) AS detector, unnest([a, (a + b) / 2, least(a, b)]) AS s FROM pair),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, detector ORDER BY md5('f:' || "index"::VARCHAR), "index") AS i FROM d),
c AS (SELECT doc_id, detector, m, round(max(s), 6) AS score FROM n, (SELECT unnest([4, 16]) AS m) WHERE i <= m GROUP BY ALL),
g AS (SELECT c.*, lang, toxic = 1 AS gold FROM c JOIN labels USING (doc_id) JOIN documents USING (doc_id)),
m AS (SELECT *, rank() OVER (PARTITION BY detector, lang, m ORDER BY score) + (count(*) OVER (PARTITION BY detector, lang, m, score) - 1) / 2.0 AS mid FROM g)
SELECT detector, lang, m::BIGINT AS m, {_AUC} FROM m GROUP BY detector, lang, m""")
def detector_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUC of every detector, pool (language) and size."""
    arms = F.array(*(F.struct(F.lit(n).alias("detector"), c.alias("s")) for n, c in (("a", F.col("a")), ("mean", (F.col("a") + F.col("b")) / 2), ("least", F.least("a", "b")))))
    rows = _pair(spark, sf_dir).select("doc_id", "index", F.explode(arms).alias("x")).select("doc_id", "index", "x.*")
    top = J.nested_max(rows, ["doc_id", "detector"], _drawn(), "s", (4, 16)).withColumnRenamed("top", "score")
    gold = _t(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("gold"))
    return I.auc(top.join(gold, "doc_id").join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), ["detector", "lang", "m"])


@query("""WITH d AS (SELECT lang, doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY lang ORDER BY md5('k:' || doc_id::VARCHAR), doc_id) AS r FROM documents)
SELECT lang, count(*)::BIGINT AS n, md5(string_agg(text, chr(10) || chr(10) ORDER BY r)) AS digest FROM d WHERE r <= 5 GROUP BY lang""")
def class_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("lang", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return J.composed(docs, "lang", "doc_id", "text", 5, "k").select("lang", "n", F.md5("text").alias("digest"))


@query(f"""WITH i AS (SELECT unnest(['first', 'second', 'third']) AS item), f AS (SELECT item, item_id, len(regexp_extract_all(text, '{_SP}')) AS n FROM benchmark, i),
b AS (SELECT item, item_id, coalesce(sum(n + 2) OVER (PARTITION BY item ORDER BY md5(item || ':' || item_id::VARCHAR), item_id {_BEFORE}), 0)::BIGINT AS before, (row_number() OVER (PARTITION BY item ORDER BY md5(item || ':' || item_id::VARCHAR), item_id) - 1)::BIGINT AS pos FROM f)
SELECT * FROM b WHERE before < 200""")
def haystack_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "benchmark").withColumn("n", C.n_tokens("text"))
    return J.haystacks(rows, ["first", "second", "third"], "item_id", "text", "n", 200).select("item", "item_id", "pos", "before")


@query(f"""WITH {LINES}, u AS (SELECT doc_id, text, row_number() OVER ({_ORDER}) AS i, sum(tok_end - tok_start + 2) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 60 AS ahead FROM passages)
SELECT doc_id, count_if(ahead)::BIGINT AS n_before, md5(concat_ws('|', string_agg(text, '|' ORDER BY i) FILTER (WHERE ahead), 'NEEDLE', string_agg(text, '|' ORDER BY i) FILTER (WHERE NOT ahead))) AS digest FROM u GROUP BY doc_id""")
def needle_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("n", F.col("tok_end") - F.col("tok_start"))
    return J.planted(rows, "doc_id", _drawn(), "text", "n", F.lit("NEEDLE"), 60, "|").select("doc_id", "n_before", F.md5("text").alias("digest"))


_HEX = lambda s, n: "(" + " + ".join(f"(strpos('0123456789abcdef', substr(md5({s}), {k}, 1)) - 1) * {16 ** (n - k)}" for k in range(1, n + 1)) + ")"
_NEEDLES = f"""x AS (SELECT item, (['red', 'green', 'blue', 'amber', 'violet'])[{_HEX("'needle:color:' || item::VARCHAR", 6)} % 5 + 1] AS color, (['box', 'door', 'lamp', 'key', 'safe', 'drum', 'bell'])[{_HEX("'needle:object:' || item::VARCHAR", 6)} % 7 + 1] AS object,
1000 + {_HEX("'needle:code:' || item::VARCHAR", 6)} % 9000 AS code, {_HEX("'needle:other:' || item::VARCHAR", 6)} % 8999 AS other FROM range(60) t(item)),
needles AS (SELECT item, color, object, code::BIGINT AS code, (CASE WHEN item % 2 = 0 THEN code ELSE 1000 + (code - 999 + other) % 9000 END)::BIGINT AS asked, item % 2 = 0 AS gold, 'The code of the ' || color || ' ' || object || ' is ' || code::VARCHAR || '.' AS needle FROM x)"""


@query(f"WITH {_NEEDLES} SELECT *, 'Is the code of the ' || color || ' ' || object || ' ' || asked::VARCHAR || '?' AS question FROM needles")
def needle_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.needle_items(spark)


@query(f"""WITH {_NEEDLES}, c AS (SELECT item_id, text, md5('h:' || item_id::VARCHAR) AS d, coalesce(sum(length(text) + 2) OVER (ORDER BY md5('h:' || item_id::VARCHAR), item_id {_BEFORE}), 0) AS before FROM benchmark),
p AS (SELECT list(text ORDER BY d, item_id) AS p FROM c WHERE before < 4000), z AS (SELECT item, depth, needle, p, floor(len(p) * depth)::BIGINT AS k FROM needles, p, (SELECT unnest([0.0, 0.5, 1.0]) AS depth))
SELECT item, depth::DOUBLE AS depth, k AS n_before, len(p)::BIGINT AS n_contexts, md5(array_to_string(list_concat(list_concat(p[1:k], [needle]), p[k + 1:]), chr(10) || chr(10))) AS digest FROM z""")
def depth_haystacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.depth_haystacks(_t(spark, sf_dir, "benchmark"), J.needle_items(spark), "item_id", "text", 4000, [0.0, 0.5, 1.0])
    return rows.select("item", "depth", "n_before", "n_contexts", F.md5("text").alias("digest"))


@query("""SELECT count(*)::BIGINT AS "rows", count_if(w.doc_id IS NULL)::BIGINT AS missing, count_if(w.doc_id IS NOT NULL AND l.quality IS DISTINCT FROM w.toxic)::BIGINT AS different FROM labels l LEFT JOIN labels w ON w.doc_id = l.doc_id AND w.doc_id % 2 = 0""")
def prefix_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that a larger table lacks, and those where it has another value."""
    labels = _t(spark, sf_dir, "labels")
    return J.prefix_mismatches(labels.select("doc_id", F.col("quality").alias("v")), labels.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query("SELECT item_id, size::BIGINT AS size, arm FROM (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 7), (SELECT unnest([1, 12, 24]) AS size), (SELECT unnest(['top1', 'scan']) AS arm)")
def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.runs(_t(spark, sf_dir, "benchmark"), "item_id", 7, [1, 12, 24], ["top1", "scan"])


def _embedding_sql(text: str) -> str:
    """A list of 64 numbers: the lexical encoder's."""
    buckets = f"list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: {_HEX('t', 4)} % 64)"
    counts = f"list_transform(range(64), lambda i: len(list_filter({buckets}, lambda b: b = i))::DOUBLE)"
    return f"list_transform({counts}, lambda c: c / greatest(1e-9, sqrt(list_sum(list_transform({counts}, lambda d: d * d)))))"


_POOLS = "passages AS (SELECT unnest(CASE WHEN item_id % 2 = 0 THEN [0, 1] ELSE [0] END)::BIGINT AS doc_id, item_id AS \"index\", text FROM benchmark)"
_PREFIX = "Represent this sentence for searching relevant passages: "
_GRID = (("one", "the of that with", 7), ("two", "and to in", 12), ("three", "was for which", 20))
_EMBEDDED = f"""q AS (SELECT qid, {_embedding_sql("text")} AS e FROM (VALUES {", ".join(f"('{q}', '{_PREFIX}{t}')" for q, t, _ in _GRID)}) AS asked(qid, text)), v AS (SELECT item_id, {_embedding_sql("text")} AS e FROM benchmark),
sims AS (SELECT qid, item_id, round(list_dot_product(v.e, q.e), 6) AS sim FROM q, v)"""


@query(f"WITH {_EMBEDDED} SELECT qid, item_id AS id, sim, (row_number() OVER (PARTITION BY qid ORDER BY sim DESC, item_id) - 1)::BIGINT AS pos FROM sims QUALIFY pos < 20")
def embed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return E.embed_rank(items, spark.createDataFrame([(q, t) for q, t, _ in _GRID], "qid string, text string"), E.LexicalEncoder(), 20)


@query(f"""WITH {_POOLS}, {_bm25(tuple((q, t) for q, t, _ in _GRID))}, {_EMBEDDED},
dense AS (SELECT doc_id, "index", qid, (row_number() OVER (PARTITION BY doc_id, qid ORDER BY sim DESC, "index") - 1)::BIGINT AS pos FROM passages JOIN sims ON item_id = "index"),
two AS (SELECT doc_id, "index", qid, pos FROM br UNION ALL SELECT doc_id, "index", qid, pos FROM dense),
f AS (SELECT doc_id, qid, "index", (row_number() OVER (PARTITION BY doc_id, qid ORDER BY round(sum(1.0::DOUBLE / (60 + pos)), 9) DESC, "index") - 1)::BIGINT AS pos FROM two GROUP BY doc_id, qid, "index"),
every AS (SELECT 'bm25' AS ranker, doc_id, qid, "index", pos FROM br UNION ALL SELECT 'dense', doc_id, qid, "index", pos FROM dense UNION ALL SELECT 'hybrid', doc_id, qid, "index", pos FROM f),
t AS (SELECT qid, target FROM (VALUES {", ".join(f"('{q}', {k})" for q, _, k in _GRID)}) AS named(qid, target))
SELECT ranker, doc_id AS pool, count(*)::BIGINT AS n, {', '.join(f'round(avg(coalesce(pos < {k}, false)::INT::DOUBLE), 6) AS recall_{k}' for k in (1, 5, 20))}, median(pos)::DOUBLE AS median_pos FROM every JOIN t USING (qid) WHERE "index" = target GROUP BY ranker, doc_id""")
def ranker_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankers x queries x pools: all items, and the even ones; each query's target is an item."""
    from pyspark.sql import Window as W

    pools = F.when(F.col("item_id") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).cast("array<bigint>")
    passages = _t(spark, sf_dir, "benchmark").select(F.explode(pools).alias("doc_id"), F.col("item_id").alias("index"), "text")
    lexical = R.ranked(R.bm25_scores(passages, [(q, t) for q, t, _ in _GRID])).select("doc_id", "qid", "index", "pos")
    queries = spark.createDataFrame([(q, t) for q, t, _ in _GRID], "qid string, text string")
    asked = E.embedded(queries.select("qid", F.concat(F.lit(E.QUERY_PREFIX), "text").alias("text")), E.LexicalEncoder()).select("qid", F.col("v").alias("_q"))
    near = E.embedded(passages, E.LexicalEncoder()).withColumn("_k", F.lit(1)).join(F.broadcast(asked.withColumn("_k", F.lit(1))), "_k")
    near = near.withColumn("sim", F.round(dot("v", "_q"), 6))
    dense = near.withColumn("pos", F.row_number().over(W.partitionBy("doc_id", "qid").orderBy(F.desc("sim"), "index")) - 1).select("doc_id", "qid", "index", "pos")
    hybrid = R.fused([lexical, dense], ["doc_id", "qid"]).select("doc_id", "qid", "index", "pos")
    every = None
    for name, r in (("bm25", lexical), ("dense", dense), ("hybrid", hybrid)):
        r = r.withColumn("ranker", F.lit(name))
        every = r if every is None else every.unionByName(r)
    targets = spark.createDataFrame([(q, k) for q, _, k in _GRID], "qid string, index long")
    return R.recall_at(every.join(F.broadcast(targets), ["qid", "index"]).withColumnRenamed("doc_id", "pool"), (1, 5, 20), ["ranker", "pool"])


@query("""WITH q AS (SELECT embedding AS e, label AS want FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, label = want AS gold, round(list_dot_product(embedding::DOUBLE[], e::DOUBLE[]), 6) AS sim FROM embeddings, q),
t AS (SELECT quantile_cont(sim, 0.05) AS t FROM d WHERE gold) SELECT vec_id, gold, sim, CASE WHEN sim >= t THEN 1.0 ELSE 0.0 END::DOUBLE AS gated FROM d, t""")
def dense_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").first()
    if q is None:  # nothing to compare with
        return e.limit(0).select("vec_id", F.lit(False).alias("gold"), F.lit(0.0).alias("sim"), F.lit(0.0).alias("gated"))
    v = ", ".join(f"{float(x)!r}D" for x in q["embedding"])
    rows = e.withColumn("_q", F.expr(f"array({v})")).select("vec_id", (F.col("label") == q["label"]).alias("gold"), F.round(dot("embedding", "_q"), 6).alias("sim"), F.lit(1.0).alias("score"))
    return I.dense_gate(rows).select("vec_id", "gold", "sim", "gated")


@query(f'{_scored(ABUSE)} SELECT doc_id, "index", round(p[2], 6) AS p FROM scored WHERE round(p[2], 6) > 0.7')
def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, ABUSE).where("yes > 0.7").select("doc_id", "index", F.col("yes").alias("p"))


@query(f"""{_scored(ABUSE)}, a AS (SELECT doc_id, round(max(p[2]), 6) AS v FROM scored GROUP BY doc_id), b AS ({_ask_sql(ABUSE, 'max', False)})
SELECT round(max(abs(a.v - b.answer_value)), 6) AS max_abs, count_if(a.v IS NULL OR b.answer_value IS NULL)::BIGINT AS unmatched FROM a FULL JOIN b USING (doc_id)""")
def simulation_equals_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest score of a document's passages, from the passage table and from asking."""
    table = _answers(spark, sf_dir, ABUSE).groupBy("doc_id").agg(F.max("yes").alias("v"))
    return I.max_abs_difference(table, A.ask(_lines(spark, sf_dir, True), [ABUSE]).select("doc_id", F.col("answer_value").alias("v")), ["doc_id"], "v")
