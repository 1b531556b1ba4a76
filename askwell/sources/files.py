"""File sources and sinks: labelled JSON documents, JSON lines, append-only caches, resumable results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.operators.scoring import latest


def read_labelled_json(spark: SparkSession, path: str) -> DataFrame:
    """``{labels: [..], rows: [{text, label}]}`` as ``(row, text, label)``, labels by name."""
    raw = spark.read.schema("labels array<string>, rows array<struct<text: string, label: int>>").json(path, multiLine=True)
    return raw.select("labels", F.posexplode("rows").alias("row", "r")).select("row", "r.text", F.expr("labels[r.label]").alias("label"))


def read_tasks_json(spark: SparkSession, path: str) -> DataFrame:
    """``{question, items: [{id, state, gold, meta}]}`` as one row an item; question, state and meta as JSON text (null where there is none)."""
    raw = spark.read.json(path, multiLine=True)
    rows = raw.select(F.to_json("question").alias("question") if raw.schema["question"].dataType.typeName() == "struct" else "question", F.explode("items").alias("i"))
    fields = set(rows.schema["i"].dataType.names)
    json_of = lambda c: (F.to_json(f"i.{c}") if rows.schema["i"].dataType[c].dataType.typeName() in ("struct", "array") else F.col(f"i.{c}").cast("string")) if c in fields else F.lit(None).cast("string")
    return rows.select("question", "i.id", json_of("state").alias("state"), "i.gold", json_of("meta").alias("meta"))


def read_results(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """JSON lines as a table with one row a key, the last line's of a file, files in order of their names; lines without a key are left out."""
    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    names = [c for c in rows.columns if c not in ("_file", "_line")]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*names), F.struct("_file", "_line")).alias("_r"))
    return last.select("_r.*")


def append_cache(answers: DataFrame, path: str) -> None:
    """Rows ``(key, seq, ...)`` added to a cache."""
    answers.write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each key."""
    return latest(spark.read.parquet(path))


def append_new(results: DataFrame, path: str, key: str = "id") -> None:
    """Writes the results whose key the sink does not have yet."""
    spark = results.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        results = results.join(spark.read.schema(results.schema).json(path).select(key), key, "left_anti")
    results.write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)
