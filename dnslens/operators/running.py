"""Running sums and numbers over groups of any size, in two passes.

Rows are dealt to ranges of group and order, so that a group as large as the table is spread over all tasks. Each range sums
its groups; sums before a range come from the small table of ranges and groups; inside, rows are summed in their range alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslens.plans.shared import stored


def sums_before(df: DataFrame, by: list[str], order: list[str], name: str, size: Column | None = None, ranges: int | None = None) -> DataFrame:
    """df with `name`: the sum of `size` (1 if none) over the rows before this one in its group; nulls of `by` are a group.

    `order` should be unique in a group. The dealt rows are written to the shared folder once, as cuts between ranges are
    drawn from a sample and would differ the next time.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = df.withColumn("__size", F.lit(1).cast("long") if size is None else size.cast("long"))
    dealt = stored(sized.repartitionByRange(n, *by, *order).withColumn("__range", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy(*by, "__range").agg(F.sum("__size").alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__range").alias("__of"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("__local", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    same = local["__range"] == start["__of"]
    for c in by:
        same = same & local[c].eqNullSafe(start[f"__{c}"])
    out = local.join(start, same)
    return out.select(*(local[c] for c in df.columns), (F.col("__local") + F.col("__start")).cast("long").alias(name))
