"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where a session on one machine (tests) names no shared folder.
LOCAL_SHARED = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    A session with executors of their own must name one, since a local folder would be another on each machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return named or LOCAL_SHARED


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder with its lineage cut; for narrow tables that are read again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A folder under ``<shared>/tables`` that no other run uses."""
    return f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; for wide tables. ``removed`` deletes it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` made and nothing reads any more."""
    for t in tables:
        remove_path(t.sparkSession, t._written)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, column: int | None = None, most: int = 1 << 26) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows, so that Python objects of few rows live at a time; with ``column``, to rows with about ``most``
    bytes there, or a single row."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if column is None or part.column(column).nbytes <= most:
                yield part
            else:
                each = max(1, rows * most // (2 * part.column(column).nbytes))
                yield from (part.slice(k, each) for k in range(0, part.num_rows, each))
