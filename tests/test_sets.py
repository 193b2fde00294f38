"""Pattern sets, mergeable rollups and several sinks, against nested loops and exact counts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dnslens.operators import filters, patterns, rollups
from dnslens.streaming import branches

CASES = [
    ("example", "example"), ("^ads[0-9]+\\.track", "\\.track".replace("\\", "")), ("(foo|bar)\\.com$", ".com"), ("(?i)abc", None), ("a+b", None), ("(abc)+x", "abc"), ("(abc)?xyz", "xyz"),
    ("(abc){2,3}", "abc"), ("ab|cd", None), ("\\p{L}abcd", None), ("[abc]def", "def"), ("\\Qa.b\\Ecc", None), ("a.b.c", None), ("abc$def", "abc"), ("(", None), ("abcd*ef", "abc"), ("(?=abc)x", None), ("", None),
]


@pytest.mark.parametrize(("pattern", "literal"), CASES)
def test_required_literal(pattern, literal):
    assert patterns.required_literal(pattern) == literal


def test_pattern_sets_equal_the_nested_loop(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abc.") for _ in range(rng.randrange(0, 14))) for _ in range(400)] + ["abc"] * 50
    lists = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 6))) for _ in range(200)]
    lists += [f"^{a}.*{b}$" for a, b in zip(lists[:60], lists[60:120], strict=True)] + ["(abc|ccc)b", "a{4}", "^$", "cab[.]?a", "(?i)CABA"]
    df = spark.createDataFrame([*enumerate(names), (-1, None)], "msg_id long, qname string")
    table = spark.createDataFrame([(p,) for p in lists] + [(None,)], "pattern string")
    want = sorted(i for i, n in enumerate(names) if any(re.search(p, n) for p in lists))
    assert sorted(r.msg_id for r in filters.regex_list_join(df, table).collect()) == want and 0 < len(want) < len(names)
    assert sorted(r.msg_id for r in filters.regex_list_join(df, table, "left_anti").collect()) == sorted({-1, *range(len(names))} - set(want))
    assert filters.regex_list_join(df, table.limit(0)).count() == 0


def test_rollups_combine_to_what_is_counted_directly(spark):
    rng = random.Random(6)
    rows = [(k % 3600 * 1_000_000_000, rng.choice("xy"), f"n{int(rng.paretovariate(0.7)) % 3000}", 1) for k in range(30_000)]
    df = spark.createDataFrame(rows, "ts_ns long, identity string, qname string, length long")
    minutes = rollups.rollup(df, ["identity"], ["qname"], ["qname"])
    assert minutes.count() == 120
    for labels in (["identity"], []):
        got = rollups.estimates(rollups.combine(minutes, labels, 3600), 5).collect()
        exact = {tuple(r[c] for c in labels): r for r in df.groupBy(*labels).agg(F.count_distinct("qname").alias("n"), F.count("*").alias("m")).collect()}
        assert len(got) == len(exact)
        for r in got:
            key = tuple(r[c] for c in labels)
            counts = Counter(x[2] for x in rows if not labels or x[1] == r["identity"])
            assert abs(r["uniq_qname"] - exact[key].n) <= 0.02 * exact[key].n + 1 and r["messages"] == exact[key].m
            assert [x["count"] for x in r["top_qname"]] == [n for _, n in counts.most_common(5)]


def test_a_replayed_batch_leaves_each_row_once(spark, tmp_path):
    """The second sink fails in the first run; the batch is run again with the first sink written already."""
    spark.range(100).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    broken = [True]

    def write(df, path):
        if "/odd/" in path and broken[0]:
            raise OSError("disk full")
        branches.to_parquet(df, path)

    def run():
        writer = branches.write_branches(stream, {"even": lambda d: d.where("id % 2 = 0"), "odd": lambda d: d.where("id % 2 = 1"), "all": lambda d: d}, f"{tmp_path}/out", write)
        writer.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="disk full"):
        run()
    assert branches.read_branch(spark, f"{tmp_path}/out", "even", "id long").count() == 50
    broken[0] = False
    run()
    rows = {n: sorted(r.id for r in branches.read_branch(spark, f"{tmp_path}/out", n, "id long").collect()) for n in ("even", "odd", "all")}
    assert rows == {"even": list(range(0, 100, 2)), "odd": list(range(1, 100, 2)), "all": list(range(100))}
