"""Suspicion flags and name features, all as Column expressions."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens.operators.filters import any_of

# Defaults of the thresholds and lists.
COMMON_QTYPES = ("A", "AAAA", "TXT", "CNAME", "PTR", "NAPTR", "DNSKEY", "SRV", "SOA", "NS", "MX", "DS", "HTTPS")
UNALLOWED_CHARS = ('"', "==", "/", ":")
WHITELIST = (r"\.ip6\.arpa",)
ML_QTYPES = ("A", "AAAA", "HTTPS", "SRV", "PTR", "SOA", "NS")


@dataclass
class SuspiciousConfig:
    qname_len: int = 100
    packet_len: int = 1000
    slow: float = 1.0
    max_labels: int = 10
    common_qtypes: tuple = COMMON_QTYPES
    unallowed_chars: tuple = UNALLOWED_CHARS
    whitelist: tuple = WHITELIST


FLAGS = ("malformed", "long_domain", "large_packet", "slow", "uncommon_qtype", "labels", "chars")


def flags(df: DataFrame, config: SuspiciousConfig | None = None) -> dict[str, Column]:
    c, q = config or SuspiciousConfig(), F.col("qname")
    latency = F.col("latency") if "latency" in df.columns else F.lit(0.0)
    return {
        "malformed": F.col("malformed"),
        "long_domain": F.octet_length(q) > c.qname_len,
        "large_packet": F.col("length") > c.packet_len,
        "slow": F.coalesce(latency, F.lit(0.0)) > c.slow,
        "uncommon_qtype": ~F.col("qtype").isin(*c.common_qtypes),
        "labels": F.length(q) - F.length(F.replace(q, F.lit("."), F.lit(""))) > c.max_labels,
        "chars": functools.reduce(operator.or_, (q.contains(x) for x in c.unallowed_chars)),
    }


def suspicious(df: DataFrame, config: SuspiciousConfig | None = None) -> DataFrame:
    """suspicious_<flag> for each flag and suspicious_score, their number; names on the whitelist have none."""
    c = config or SuspiciousConfig()
    known = F.col("qname").rlike(any_of(list(c.whitelist))) if c.whitelist else F.lit(False)
    out = df.withColumns({f"suspicious_{k}": v & ~known for k, v in flags(df, c).items()})
    return out.withColumn("suspicious_score", functools.reduce(operator.add, (F.col(f"suspicious_{k}").cast("int") for k in FLAGS)).cast("double"))


CONSONANT = r"[\p{Ll}&&[^aeiouy]]"


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]", "")).cast("long")


def ml_features(df: DataFrame) -> DataFrame:
    """The name and traffic features. Lengths are bytes, classes are characters; an empty name has every ratio 1."""
    q = F.col("qname")
    n = F.octet_length(q).cast("long")
    # how often each different character occurs, once a name; its share is of bytes
    counts = F.transform(F.array_distinct(F.filter(F.split(q, ""), lambda c: c != "")), lambda c: (F.length(q) - F.length(F.replace(q, c, F.lit("")))) / n)
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, share: a - share * F.log2(share))
    pairs = lambda one, two: F.regexp_count(F.lower(q), F.lit(f"{one}(?={two})")).cast("long")  # noqa: E731; a match ends before its second character, so that pairs may overlap
    digits, lowers, uppers, specials = _count(q, "0-9"), _count(q, r"\p{Ll}"), _count(q, r"\p{Lu}"), _count(q, r".\-_=")
    others = n - digits - lowers - uppers - specials
    ratio = lambda x: F.when(n == 0, F.lit(1.0)).otherwise(x / n)
    size = F.coalesce(F.col("cumulative_length"), F.col("length")) if "cumulative_length" in df.columns else F.col("length")
    occurrences = F.coalesce(F.col("occurrences"), F.lit(0)) if "occurrences" in df.columns else F.lit(0)
    return df.withColumns({
        "ml_entropy": entropy, "ml_length": n, "ml_digits": digits, "ml_lowers": lowers, "ml_uppers": uppers, "ml_specials": specials, "ml_others": others,
        "ml_labels": F.size(F.split(q, r"\.")).cast("long"),
        "ml_ratio_digits": ratio(digits), "ml_ratio_letters": ratio(lowers + uppers), "ml_ratio_specials": ratio(specials), "ml_ratio_others": ratio(others),
        "ml_consecutive_chars": pairs("(.)", r"\1"), "ml_consecutive_vowels": pairs("([aeiouy])", r"\1"), "ml_consecutive_digits": pairs("[0-9]", "[0-9]"), "ml_consecutive_consonants": pairs(CONSONANT, CONSONANT),
        "ml_size": size.cast("long"), "ml_occurrences": occurrences.cast("long"), "ml_uncommon_qtype": (~F.col("qtype").isin(*ML_QTYPES)).cast("long"),
    })
