"""Addresses and networks: IPv4 by arithmetic, IPv6 as 16 bytes through an Arrow function."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def v4_number(ip: Column) -> Column:
    """The 32 bits of an IPv4 text as a long; null for anything else."""
    parts = [F.regexp_extract(ip, _V4, i).try_cast("long") for i in range(1, 5)]
    ok = parts[0].isNotNull()
    for p in parts:
        ok = ok & (p <= 255)
    return F.when(ok, parts[0] * (1 << 24) + parts[1] * (1 << 16) + parts[2] * (1 << 8) + parts[3])


def v4_text(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


@F.pandas_udf(T.BinaryType())
def ip_bytes(ips: pd.Series) -> pd.Series:
    """16 bytes of any address (IPv4 in its mapped form), which compare in address order; null if invalid."""

    def one(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return None
        return b"\0" * 10 + b"\xff\xff" + a.packed if a.version == 4 else a.packed

    return ips.map(one, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("family", T.IntegerType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("bits", T.IntegerType())]))
def network_bits(cidrs: pd.Series) -> pd.DataFrame:
    """Family, the two signed halves of the network's 128 bits (IPv4 in the low 32) and its prefix length; null if it is no network."""

    def one(x):
        try:
            net = ipaddress.ip_network(x, strict=False)
        except ValueError:
            return None, None, None, None
        n = int(net.network_address)
        signed = [h - (1 << 64) if h >> 63 else h for h in (n >> 64, n & (1 << 64) - 1)]
        return net.version, *signed, net.prefixlen

    columns = zip(*(one(x) for x in cidrs), strict=True) if len(cidrs) else [()] * 4
    kinds = {"family": "Int32", "hi": "Int64", "lo": "Int64", "bits": "Int32"}  # not by way of floats, which would round
    return pd.DataFrame({name: pd.array(list(c), kind) for (name, kind), c in zip(kinds.items(), columns, strict=True)})


def mask_v6(prefix: int):
    """An Arrow function that clears what follows the prefix of an IPv6 text; other texts stay."""

    @F.pandas_udf(T.StringType())
    def masked(ips: pd.Series) -> pd.Series:
        def one(x):
            try:
                return str(ipaddress.ip_network(f"{x}/{prefix}", strict=False).network_address) if ":" in x else x
            except ValueError:
                return x

        return ips.map(one, na_action="ignore")

    return masked


def networks(spark: SparkSession, cidrs: list[str]) -> DataFrame:
    """A list of networks of either family as a table (cidr)."""
    return spark.createDataFrame([(c,) for c in cidrs], "cidr string")


def in_networks(ip: Column, cidrs: list[str]) -> Column:
    """Whether an address is in a short literal list of networks of either family."""
    v4, v6 = [], []
    for c in cidrs:
        try:
            net = ipaddress.ip_network(c, strict=False)
        except ValueError:
            continue
        (v4 if net.version == 4 else v6).append(net)
    found = F.lit(False)
    for net in ipaddress.collapse_addresses(v4):
        found = found | v4_number(ip).between(int(net.network_address), int(net.broadcast_address))
    for net in ipaddress.collapse_addresses(v6):
        found = found | ip_bytes(ip).between(F.lit(net.network_address.packed), F.lit(net.broadcast_address.packed))
    return F.coalesce(found, F.lit(False))
