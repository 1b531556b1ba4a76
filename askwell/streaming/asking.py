"""Fixed questions asked of arriving documents, micro-batch by micro-batch (an addition: the batch plan is the same)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from askwell.operators.scoring import Question
from askwell.plans.engine import Engine


def ask_stream(docs: DataFrame, engine: Engine, questions: Sequence[Question], path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes each batch's answers under ``path``; a batch that is run again replaces its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        engine.ask(batch, questions).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
