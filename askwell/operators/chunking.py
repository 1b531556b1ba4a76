"""Splitting texts into passages and token windows, with exact character offsets.

Every operator takes ``docs(doc_id, text)`` and returns one row a passage: ``doc_id, index, text, tok_start, tok_end, char_start,
char_end``; ends are exclusive. With ``counted`` there is also ``n_chunks``, how many the document has. Null texts count as empty. A document is
one row before it is split, so its passages are numbered, and their positions summed up, within that row: splitting shuffles nothing.

Arrays that are never empty are taken apart by ``explode_outer``: for ``explode`` the optimizer adds a filter on the array's size, and computes it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askwell.functions.vectors import BLANK, let, n_tokens, quoted, sums_before, tokens


def check_windows(chunk_tokens: int, stride: int | None) -> int:
    """The stride to use: a missing or zero one is ``chunk_tokens``."""
    stride = stride or chunk_tokens
    if not 0 < stride <= chunk_tokens:
        raise ValueError("0 < stride <= chunk_tokens is needed")
    return stride


def _n_tokens(text: str) -> str:
    return f"regexp_count({text}, '[^ \\\\t\\\\n\\\\r\\\\f]+')"


def paragraphs(docs: DataFrame, sep: str = "\n\n", max_tokens: int | None = None, counted: bool = False) -> DataFrame:
    """Pieces between literal separators; blank ones are dropped and the others numbered.

    Pieces of more than ``max_tokens`` tokens become windows of that size with half of it as stride. A document without a piece has its
    whole text as its only passage, with no tokens.
    """
    stride = max(1, max_tokens // 2) if max_tokens else 1
    # All pieces with where they start; of these the kept ones; their tokens, and how many windows each becomes.
    pieces = let("__p", f"split(whole, {quoted(chr(92) + 'Q' + sep + chr(92) + 'E')}, -1)", let("__at", sums_before(f"transform(__p, __x -> cast(length(__x) + {len(sep)} as bigint))"), "transform(__p, (__x, __i) -> struct(__x as text, __at[__i] as char_start))"))
    kept = f"filter({pieces}, __x -> __x.text rlike {quoted(f'[^{BLANK}]')})"
    index, n = ("cast(__n[__i] as int)", "__m") if max_tokens else ("__i", "cast(size(__v) as bigint)")
    made = f"transform(__v, (__x, __i) -> struct({index} as index, __x.text as text, __b[__i] as tok_start, __b[__i] + __t[__i] as tok_end, __x.char_start as char_start, __x.char_start + length(__x.text) as char_end, __t[__i] as n, {n} as n_chunks))"
    if max_tokens:
        windows = f"transform(__t, __y -> cast({_window_count('__y', max_tokens, stride)} as bigint))"
        made = let("__k", windows, let("__n", sums_before("__k"), let("__m", "aggregate(__k, 0L, (__s, __y) -> __s + __y)", made)))
    made = let("__b", sums_before("__t"), made)
    whole = "array(struct(0 as index, whole as text, 0L as tok_start, 0L as tok_end, 0L as char_start, cast(length(whole) as bigint) as char_end, 0L as n, 1L as n_chunks))"
    every = let("__v", kept, f"case when size(__v) = 0 then {whole} else {let('__t', f'transform(__v, __x -> cast({_n_tokens("__x.text")} as bigint))', made)} end")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("whole")).select("doc_id", F.explode_outer(F.expr(every)).alias("c")).select("doc_id", "c.*")
    names = ["doc_id", "index", "text", "tok_start", "tok_end", "char_start", "char_end", *(["n_chunks"] if counted else [])]
    if max_tokens is None:
        return rows.select(*names)
    # A whole text without a piece has no tokens and stays as it is; so does every piece that fits.
    inner = _windows(rows, max_tokens, stride)
    fits = F.col("n") <= max_tokens
    return inner.select(
        "doc_id", (F.col("index") + F.col("part")).alias("index"), F.when(fits, F.col("text")).otherwise(F.col("piece")).alias("text"),
        F.when(fits, F.col("tok_start")).otherwise(F.col("tok_start") + F.col("a")).alias("tok_start"), F.when(fits, F.col("tok_end")).otherwise(F.col("tok_start") + F.col("b")).alias("tok_end"),
        F.when(fits, F.col("char_start")).otherwise(F.col("char_start") + F.col("from_char")).alias("char_start"), F.when(fits, F.col("char_end")).otherwise(F.col("char_start") + F.col("to_char")).alias("char_end"),
        *(["n_chunks"] if counted else []),
    )


def _window_count(n: str, size: int, stride: int) -> str:
    """How many windows a text of n tokens has: a last one of less than a quarter of ``size`` joins the one before it."""
    k = f"(cast(ceil(({n} - {size}) / {stride}) as int) + 1)"
    return f"case when {n} <= {size} then 1 when {k} > 1 and {n} - ({k} - 1) * {stride} < {size // 4} then {k} - 1 else {k} end"


def _windows(rows: DataFrame, size: int, stride: int) -> DataFrame:
    """Adds ``part, a, b, from_char, to_char, piece`` for each token window of ``text``.

    Windows start every ``stride`` tokens until one reaches the end; a last one of less than a quarter of ``size`` joins the one before it. A
    text of at most ``size`` tokens is its own window, outer white space included.
    """
    rows = rows.withColumn("_t", tokens("text")).withColumn("_n", F.size("_t"))
    rows = rows.withColumn("_k", F.expr(_window_count("_n", size, stride)))
    # Characters of the strides before each window; each token is read once for its stride, once a window.
    strides = f"transform(sequence(0, _k - 1), __i -> cast(length(array_join(slice(_t, __i * {stride} + 1, {stride}), '')) as bigint))"
    rows = rows.withColumn("_b", F.expr(f"case when _k = 1 then array(0L) else {sums_before(strides)} end"))
    rows = rows.select("*", F.posexplode_outer("_b").alias("part", "_c"))
    rows = rows.withColumn("a", (F.col("part") * stride).cast("long"))
    rows = rows.withColumn("b", F.expr(f"cast(case when part = _k - 1 then _n else part * {stride} + {size} end as long)"))
    space, whole = "[ \\\\t\\\\n\\\\r\\\\f]", f"_n <= {size}"
    window = "array_join(slice(_t, cast(a as int) + 1, cast(b - a as int)), '')"
    rows = rows.withColumn("piece", F.expr(f"case when {whole} then text else regexp_replace({window}, '{space}+$', '') end"))
    lead = f"length(regexp_extract(text, '^{space}*', 0))"
    rows = rows.withColumn("from_char", F.expr(f"cast(case when {whole} then 0 else {lead} + _c end as long)"))
    rows = rows.withColumn("to_char", F.col("from_char") + F.length("piece"))
    return rows.drop("_t", "_n", "_b", "_c")


def token_windows(docs: DataFrame, chunk_tokens: int = 750, stride: int | None = None, counted: bool = False) -> DataFrame:
    """Windows of ``chunk_tokens`` tokens, ``stride`` apart."""
    stride = check_windows(chunk_tokens, stride)
    rows = _windows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), chunk_tokens, stride)
    n = [F.col("_k").cast("long").alias("n_chunks")] if counted else []
    return rows.select("doc_id", F.col("part").alias("index"), F.col("piece").alias("text"), F.col("a").alias("tok_start"), F.col("b").alias("tok_end"), F.col("from_char").alias("char_start"), F.col("to_char").alias("char_end"), *n)


def chunked(docs: DataFrame, mode: str = "tokens", chunk_tokens: int = 750, stride: int | None = None, sep: str = "\n\n", counted: bool = False) -> DataFrame:
    """By mode: ``tokens`` or ``paragraphs``."""
    if mode == "tokens":
        return token_windows(docs, chunk_tokens, stride, counted)
    if mode == "paragraphs":
        return paragraphs(docs, sep, chunk_tokens, counted)
    raise ValueError(f"no such mode: {mode}")


def token_totals(chunks: DataFrame) -> DataFrame:
    """``(doc_id, n_chunks, n_tokens)``: passages and their tokens, overlaps counted as often as they occur."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.greatest(F.lit(0), F.col("tok_end") - F.col("tok_start"))).alias("n_tokens"))


def turns(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation as passages, in order of the turn."""
    order = W.partitionBy("conv_id").orderBy("turn")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", n_tokens("text"))
    rows = rows.withColumn("tok_start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
    return rows.select(F.col("conv_id").alias("doc_id"), (F.row_number().over(order) - 1).alias("index"), "text", "tok_start", (F.col("tok_start") + F.col("n")).alias("tok_end"))
