"""Expressions on short probability vectors and on term lists; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals kept before ranking, picking a maximum, or comparing with another engine.
DIGITS = 6


#: White space as Unicode has it, as a class of regular expressions that Java and RE2 read alike.
BLANK = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quoted(text: str) -> str:
    """A string as SQL has it."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def let(name: str, value: str, body: str) -> str:
    """``body``, in which ``name`` stands for ``value``; that is computed once, however often it is named in lambdas."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sums_before(a: str) -> str:
    """For each number of an array the sum of those before it (long).

    Sums of blocks of about the root of the array's size come first, so an array of n takes n times its root, not n squared.
    """
    total = lambda x: f"aggregate({x}, 0L, (__s, __x) -> __s + __x)"
    one = f"__d[__i div __w] + {total('slice(__a, (__i div __w) * __w + 1, __i % __w)')}"
    blocks = f"transform(sequence(0, (size(__a) - 1) div __w), __i -> {total('slice(__a, __i * __w + 1, __w)')})"
    body = let("__w", "cast(ceil(sqrt(size(__a))) as int)", let("__c", blocks, let("__d", f"transform(__c, (__v, __i) -> {total('slice(__c, 1, __i)')})", f"transform(__a, (__v, __i) -> {one})")))
    return let("__a", a, f"case when size(__a) = 0 then cast(array() as array<bigint>) else {body} end")


def tokens(text: str) -> Column:
    """White-space tokens with the white space after them; leading white space belongs to no token."""
    return F.expr(f"regexp_extract_all({text}, '[^ \\\\t\\\\n\\\\r\\\\f]+[ \\\\t\\\\n\\\\r\\\\f]*', 0)")


def n_tokens(text: str) -> Column:
    return F.expr(f"regexp_count({text}, '[^ \\\\t\\\\n\\\\r\\\\f]+')").cast("long")


def terms(text: str) -> Column:
    """Lower-cased runs of a-z and 0-9, in order, repeats included."""
    return F.expr(f"regexp_extract_all(lower({text}), '[a-z0-9]+', 0)")


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (__x, __y) -> cast(__x as double) * cast(__y as double)), 0D, (__s, __x) -> __s + __x)")


def softmax(logits: str, temperature: str = "1D", as_sql: bool = False) -> Column | str:
    """Stable softmax of logits over a temperature of at least 0.001; an empty list stays empty."""
    z = f"transform({logits}, __l -> exp((__l - array_max({logits})) / greatest(0.001D, {temperature})))"
    out = f"transform(array({z}), __z -> transform(__z, __e -> __e / aggregate(__z, 0D, (__s, __x) -> __s + __x)))[0]"
    return out if as_sql else F.expr(out)


def rounded(p: str) -> Column:
    return F.expr(f"transform({p}, __x -> round(__x, {DIGITS}))")


def best_key(keys: str, p: str) -> Column:
    """The key of the first largest probability, compared after rounding."""
    return F.expr(f"transform(array(transform({p}, __x -> round(__x, {DIGITS}))), __r -> element_at({keys}, cast(array_position(__r, array_max(__r)) as int)))[0]")


def entropy_confidence(p: str) -> Column:
    """One less the entropy over its largest value; 1 where there is one option."""
    h = f"aggregate({p}, 0D, (__s, __x) -> __s + case when __x > 0 then __x * ln(__x) else 0D end)"
    return F.expr(f"case when size({p}) > 1 then 1 + {h} / ln(size({p})) else 1D end")


def expected_level(p: str) -> Column:
    return F.expr(f"aggregate(zip_with(sequence(0, size({p}) - 1), {p}, (__i, __x) -> __i * __x), 0D, (__s, __x) -> __s + __x)")
