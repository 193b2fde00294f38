"""Several sinks from one pass of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

Branch = Callable[[DataFrame], DataFrame]
Writer = Callable[[DataFrame, str], None]


def to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_branches(stream: DataFrame, branches: dict[str, Branch], folder: str, write: Writer = to_parquet) -> DataStreamWriter:
    """A stream writer that reads each micro-batch once and writes every branch of it below folder/<branch>/batch=<id>.

    write(df, path) must replace what is at the path: a batch that is replayed after a failure between two sinks then leaves
    each row once in each of them. The batch is kept in the executors' storage while its branches are written; what is lost
    with an executor is read from the source again. Set a checkpoint and a trigger, then start it.
    """

    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for name, branch in branches.items():
                write(branch(held), f"{folder}/{name}/batch={number}")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(put)


def read_branch(spark: SparkSession, folder: str, name: str, columns: str) -> DataFrame:
    """What write_branches has written to a branch. columns: its schema, as batches without rows have no files of their own."""
    return spark.read.schema(columns).parquet(f"{folder}/{name}").drop("batch")
