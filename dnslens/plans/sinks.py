"""Writers: logs as text, JSON or flat JSON; rolled and compressed files; counting and discarding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.functions.payloads import line, with_batches


def write_log(df: DataFrame, path: str, mode: str = "text", compression: str = "none") -> None:
    """One line per row in text files. mode: text, json or flat-json."""
    df.select(line(df, mode).alias("value")).write.option("compression", compression).text(path)


def write_rotated(df: DataFrame, path: str, rows_per_file: int = 5000, compression: str = "gzip", bytes_per_file: int | None = None, keep: int | None = None) -> None:
    """JSON files by day, a new one after so many rows, compressed.

    With bytes_per_file, files are cut where the running size of their lines in time order passes it, and at each hour, and lie below day, hour and file; with keep, only the last so many of them are written.
    """
    day = F.date_format(F.timestamp_seconds(F.expr("ts_ns div 1000000000")), "yyyy-MM-dd")
    rows = df.withColumn("day", day)
    if bytes_per_file is None:
        rows.write.partitionBy("day").option("maxRecordsPerFile", rows_per_file).option("compression", compression).json(path)
        return
    size = (F.octet_length(line(df, "json")) + 1).cast("long")
    rows = rows.withColumn("hour", F.expr("ts_ns div 3600000000000"))
    rows = with_batches(rows, ["hour"], size, bytes_per_file, "file")
    if keep is not None:
        files = rows.select(F.col("hour").alias("__hour"), F.col("file").alias("__file")).distinct()
        last = files.orderBy(F.desc("__hour"), F.desc("__file")).limit(keep)
        rows = rows.join(last, (F.col("hour") == F.col("__hour")) & (F.col("file") == F.col("__file")), "left_semi")
    rows.repartition("hour", "file").sortWithinPartitions("hour", "file", "ts_ns", "msg_id").write.partitionBy("day", "hour", "file").option("compression", compression).json(path)


def write_noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()
