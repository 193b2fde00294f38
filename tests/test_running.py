"""Two-pass running sums against a plain loop, with nearly all rows in one group."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dnslens.operators import filters
from dnslens.operators.running import sums_before


def rows_of(seed, n):
    rng = random.Random(seed)
    return [(i, rng.randrange(n // 2), "hot" if rng.random() < 0.95 else rng.choice(["a", "b", None]), rng.randrange(50)) for i in range(n)]


@pytest.mark.parametrize("ranges", [1, 7])
def test_sums_before(spark, ranges):
    rows = rows_of(1, 3000)
    want, total = {}, defaultdict(int)
    for i, ts, key, size in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = total[key]
        total[key] += size
    df = spark.createDataFrame(rows, "msg_id long, ts_ns long, key string, size long")
    got = sums_before(df, ["key"], ["ts_ns", "msg_id"], "before", F.col("size"), ranges)
    assert got.columns == [*df.columns, "before"] and {r.msg_id: r.before for r in got.collect()} == want
    assert sums_before(df.limit(0), ["key"], ["ts_ns"], "before").count() == 0


def test_a_hot_group_is_spread(spark):
    """No range holds more than half above an even share, though nearly all rows are of one group."""
    df = spark.createDataFrame(rows_of(2, 20_000), "msg_id long, ts_ns long, key string, size long")
    dealt = df.repartitionByRange(8, "key", "ts_ns", "msg_id").withColumn("p", F.spark_partition_id())
    shares = Counter(r.p for r in dealt.select("p").collect())
    assert max(shares.values()) <= 1.5 * df.count() / 8
    plan = sums_before(df, ["key"], ["ts_ns", "msg_id"], "before", ranges=8)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x and "__size" in x]
    assert windows and all("__range" in x for x in windows)  # rows are summed in their range alone


def test_downsample_of_a_hot_stream(spark):
    df = spark.range(1000).selectExpr("id AS msg_id", "id AS ts_ns", "'s' AS identity")
    assert [r.msg_id for r in filters.downsample(df, 10, "keep_nth").orderBy("msg_id").collect()] == list(range(9, 1000, 10))
    assert filters.downsample(df, 10).count() == 900
