"""Index once, ask many: the public class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from askwell.operators.ask import ask
from askwell.operators.chunking import check_windows, chunked
from askwell.operators.scoring import Question, Scorer


class Index:
    """A persisted table of passages and the parameters it was cut with."""

    def __init__(self, chunks: DataFrame, params: tuple):
        self.chunks, self.params = chunks.persist(), params

    def close(self) -> None:
        self.chunks.unpersist()


class Engine:
    """Cuts documents into passages and asks typed questions of them."""

    def __init__(self, chunk_tokens: int = 750, stride: int | None = None, gate: str | bool = "auto", mode: str = "tokens", prefilter: str | None = None, top_k: int = 1, sep: str = "\n\n", scorer: Scorer | None = None, template: str | None = None):
        if mode not in ("tokens", "paragraphs"):
            raise ValueError(f"no such mode: {mode}")
        if prefilter not in (None, "bm25"):
            raise ValueError("prefilter is None or bm25")
        if top_k < 1:
            raise ValueError("top_k >= 1 is needed")
        self.chunk_tokens, self.stride = chunk_tokens, check_windows(chunk_tokens, stride or max(1, chunk_tokens // 2))
        self.gate, self.mode, self.prefilter, self.top_k, self.sep, self.scorer, self.template = gate, mode, prefilter, top_k, sep, scorer, template

    @property
    def params(self) -> tuple:
        return self.mode, self.chunk_tokens, self.stride, self.sep

    def chunks(self, docs: DataFrame) -> DataFrame:
        return chunked(docs, self.mode, self.chunk_tokens, self.stride, self.sep, counted=True)

    def index(self, docs: DataFrame) -> Index:
        return Index(self.chunks(docs), self.params)

    def ask(self, source: DataFrame | Index, questions: Sequence[Question], agg: dict[str, str] | None = None, detail: bool = False) -> DataFrame:
        if isinstance(source, Index):
            if source.params != self.params:
                raise ValueError("the index was cut with other parameters")
            chunks = source.chunks
        else:
            chunks = self.chunks(source)
        return ask(chunks, questions, self.prefilter, self.top_k, self.gate, agg, self.scorer, detail=detail, template=self.template)
