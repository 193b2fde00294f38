"""Filters: each returns the kept rows; `dropped=True` returns the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.functions.ip import in_networks, networks
from dnslens.operators.lookup import ip_in_set
from dnslens.operators.patterns import matching_names
from dnslens.operators.running import sums_before

#: Networks up to which a list is part of a condition.
FEW = 100


def split(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The kept and the dropped rows; an unknown condition drops."""
    keep = F.coalesce(keep, F.lit(False))
    return df.where(keep), df.where(~keep)


def _side(df: DataFrame, keep: Column, dropped: bool) -> DataFrame:
    return split(df, keep)[dropped]


def drop_queries(df: DataFrame, dropped: bool = False) -> DataFrame:
    return _side(df, F.col("dns_type") != "QUERY", dropped)


def drop_replies(df: DataFrame, dropped: bool = False) -> DataFrame:
    return _side(df, F.col("dns_type") != "REPLY", dropped)


def drop_rcodes(df: DataFrame, rcodes: list[str], dropped: bool = False) -> DataFrame:
    return _side(df, ~F.col("rcode").isin(rcodes), dropped)


def _by_client(df: DataFrame, cidrs: list[str], inside: bool) -> DataFrame:
    """Rows whose client is (or isn't) in a list of networks: a short list is a condition, a longer one a join by prefix."""
    if len(cidrs) <= FEW:
        found = in_networks(F.col("query_ip"), cidrs)
        return df.where(found if inside else ~found)
    return ip_in_set(df, "query_ip", networks(df.sparkSession, cidrs), "left_semi" if inside else "left_anti")


def keep_query_ip(df: DataFrame, cidrs: list[str], dropped: bool = False) -> DataFrame:
    return _by_client(df, cidrs, not dropped)


def drop_query_ip(df: DataFrame, cidrs: list[str], dropped: bool = False) -> DataFrame:
    return _by_client(df, cidrs, dropped)


def keep_rdata_ip(df: DataFrame, cidrs: list[str], dropped: bool = False) -> DataFrame:
    """Rows of which an A or AAAA answer is in the list."""
    if any(":" in c for c in cidrs):  # Arrow functions can't stand in a lambda: decide by exploded answers
        a = df.select("msg_id", F.explode("answers").alias("r")).where(F.col("r.rdatatype").isin("A", "AAAA"))
        ids = a.where(in_networks(F.col("r.rdata"), cidrs)).select("msg_id").distinct()
        return df.join(ids, "msg_id", "left_anti" if dropped else "left_semi")
    return _side(df, F.exists("answers", lambda r: r["rdatatype"].isin("A", "AAAA") & in_networks(r["rdata"], cidrs)), dropped)


def _names(spark: SparkSession, names: list[str] | DataFrame) -> DataFrame:
    made = spark.createDataFrame([(n,) for n in names], "name string") if isinstance(names, list) else names.select(F.col(names.columns[0]).alias("name"))
    return made.select(F.lower("name").alias("__name")).distinct()


def keep_fqdn(df: DataFrame, names: list[str] | DataFrame, dropped: bool = False) -> DataFrame:
    """Rows whose qname is in the list. The list is lower-cased, the name isn't; Spark broadcasts lists that are small."""
    return df.join(_names(df.sparkSession, names), F.col("qname") == F.col("__name"), "left_anti" if dropped else "left_semi")


def drop_fqdn(df: DataFrame, names: list[str] | DataFrame, dropped: bool = False) -> DataFrame:
    return keep_fqdn(df, names, not dropped)


def any_of(patterns: list[str]) -> str:
    """One pattern that finds what any of them finds."""
    return "|".join(f"(?:{p})" for p in patterns)


def keep_domain_regex(df: DataFrame, patterns: list[str], dropped: bool = False) -> DataFrame:
    return _side(df, F.col("qname").rlike(any_of(patterns)), dropped)


def drop_domain_regex(df: DataFrame, patterns: list[str], dropped: bool = False) -> DataFrame:
    return _side(df, ~F.col("qname").rlike(any_of(patterns)), dropped)


def regex_list_join(df: DataFrame, patterns: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose qname matches (left_semi) or doesn't match (left_anti) a pattern of a table, by way of different names (see `patterns`)."""
    return df.join(matching_names(df.select("qname").where("qname IS NOT NULL").distinct(), patterns), "qname", how).select(*df.columns)


def downsample(df: DataFrame, n: int, mode: str = "drop_nth", by: tuple[str, ...] = ("identity",), order: tuple[str, ...] = ("ts_ns", "msg_id")) -> DataFrame:
    """Drops (or with keep_nth keeps) every n-th message of each stream and hour, in order, and stamps sample_rate.

    Rows are numbered anew in each hour, in two passes (see `running`); `hash_sample` needs no order and no shuffle.
    """
    rows = sums_before(df.withColumn("__hour", F.expr("ts_ns div 3600000000000")), [*by, "__hour"], list(order), "__before")
    nth = (F.col("__before") + 1) % n == 0
    out = rows.where(~nth if mode == "drop_nth" else nth).drop("__before", "__hour")
    return out.withColumn("sample_rate", F.lit(n).cast("long"))


def hash_sample(df: DataFrame, n: int, key: str = "msg_id", mode: str = "drop_nth") -> DataFrame:
    """The same share of rows by a hash of their key; works on streams."""
    nth = F.pmod(F.xxhash64(key), F.lit(n)) == 0
    return df.where(~nth if mode == "drop_nth" else nth).withColumn("sample_rate", F.lit(n).cast("long"))
