"""Masks and hashes of addresses, and minimised names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens.functions.ip import mask_v6, v4_number, v4_text
from dnslens.operators.lookup import registrable


def anonymize_ip(df: DataFrame, column: str = "query_ip", v4: int = 16, v6: int = 64, with_v6: bool = True) -> DataFrame:
    """Addresses cut to their networks. What is no address stays. with_v6=False keeps the plan free of Python."""
    mask = (1 << 32) - (1 << (32 - v4))
    n = v4_number(F.col(column))
    other = mask_v6(v6)(F.col(column)) if with_v6 else F.col(column)
    return df.withColumn(column, F.when(n.isNotNull(), v4_text(n.bitwiseAND(F.lit(mask)))).otherwise(other))


def hashed(value: Column, algorithm: str = "sha1") -> Column:
    """Hex digest; an unknown algorithm leaves the value."""
    if algorithm == "sha1":
        return F.sha1(value.cast("binary"))
    return F.sha2(value, int(algorithm[3:])) if algorithm in ("sha256", "sha512") else value


def hash_ip(df: DataFrame, column: str = "query_ip", algorithm: str = "sha1") -> DataFrame:
    return df.withColumn(column, hashed(F.col(column), algorithm))


def minimize_qname(df: DataFrame, psl: DataFrame) -> DataFrame:
    """The registrable domain in place of the name (as it stands: neither trimmed nor lower-cased); names without one stay."""
    return registrable(df, psl, F.col("qname"), "__domain").withColumn("qname", F.coalesce("__domain", "qname")).drop("__domain")
