"""Texts as unit vectors: an encoder, each different text encoded once, and ranking by it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.functions.vectors import let, terms
from askwell.operators.retrieval import dense_top_k
from askwell.operators.scoring import loaded

# Fixed value: what stands before a query, and not before a passage, for the encoder.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


class LexicalEncoder:
    """Counts of a text's terms in ``dims`` buckets by their MD5, scaled to unit length; a text without terms is all zeros."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with ``v``, an array of doubles."""
        buckets = f"transform(_t, __t -> cast(conv(substr(md5(__t), 1, 4), 16, 10) as int) % {self.dims})"
        counts = let("__h", buckets, f"transform(sequence(0, {self.dims - 1}), __i -> cast(size(filter(__h, __x -> __x = __i)) as double))")
        unit = let("__c", counts, let("__n", "sqrt(aggregate(__c, 0D, (__s, __x) -> __s + __x * __x))", "transform(__c, __x -> case when __n = 0 then 0D else __x / __n end)"))
        return rows.withColumn("_t", terms(f"`{text}`")).withColumn("v", F.expr(unit)).drop("_t")


class ArrowEncoder:
    """``factory() -> fn(texts) -> list of vectors``, made once a Python worker; ``batch_size`` texts at a time, in order of their length."""

    def __init__(self, factory: Callable[[], Callable[[list[str]], list[list[float]]]], name: str, batch_size: int = 64):
        self.factory, self.name, self.batch_size = factory, name, batch_size

    def encode(self, rows: DataFrame, text: str = "text") -> DataFrame:
        factory, name, size, names = self.factory, self.name, self.batch_size, rows.columns
        at = names.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = loaded(name, factory)
            for b in batches:
                for s in range(0, b.num_rows, size):
                    part = b.slice(s, size)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model([t or "" for t in part.column(at).to_pylist()]), pa.list_(pa.float64()))], [*names, "v"])

        return rows.sortWithinPartitions(F.length(text)).mapInArrow(run, rows.select("*", F.lit(None).cast("array<double>").alias("v")).schema)


def embedded(rows: DataFrame, encoder: LexicalEncoder | ArrowEncoder, text: str = "text") -> DataFrame:
    """``rows`` with ``v``: each different text is encoded once; a null text is an empty one."""
    once = encoder.encode(rows.select(F.coalesce(text, F.lit("")).alias("_e")).distinct(), "_e")
    return rows.withColumn("_e", F.coalesce(text, F.lit(""))).join(once, "_e").drop("_e")


def embed_rank(passages: DataFrame, queries: DataFrame, encoder: LexicalEncoder | ArrowEncoder, k: int = 50, prefix: str = QUERY_PREFIX) -> DataFrame:
    """``(qid, id, sim, pos)``: the k passages ``(id, text)`` nearest to each query ``(qid, text)``, which gets the prefix."""
    asked = embedded(queries.select("qid", F.concat(F.lit(prefix), F.coalesce("text", F.lit(""))).alias("text")), encoder)
    return dense_top_k(embedded(passages.select("id", "text"), encoder), asked, k)
