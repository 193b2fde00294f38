"""Large sets of patterns: names meet only the patterns whose required literal they may hold.

A pattern's required literal is the longest text that every match must contain. A trigram of it is looked up among the
trigrams of names by an equi-join; names that hold the literal are then matched. Patterns without such a literal (alternations,
options, case-insensitive ones, or syntax that isn't sure to mean the same here) are matched against all different names.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 3


def required_literal(pattern: str) -> str | None:
    """A longest text that every match of a pattern contains, of GRAM characters at least."""
    try:
        parsed = _parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE) or "\\Q" in pattern or "(?" in pattern.replace("(?:", "") or "&&" in pattern:
        return None
    best = max(_runs(parsed), key=len, default="")
    return best if len(best) >= GRAM else None


def _runs(parsed) -> list[str]:
    """Texts that a match contains: runs of literals, also those inside groups and repeats that occur at least once."""
    out, run = [], ""
    for op, value in parsed:
        if op is sre.LITERAL:
            run += chr(value)
            continue
        if op is sre.AT:  # an anchor has no width, but ends the run: text may follow a line's end
            out.append(run)
            run = ""
            continue
        out.append(run)
        run = ""
        if op is sre.SUBPATTERN:
            out += _runs(value[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] >= 1:
            out += _runs(value[2])
    return [*out, run]


@F.pandas_udf(T.StringType())
def _literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(required_literal, na_action="ignore")


def _grams(text: Column) -> Column:
    """The different trigrams of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))


def matching_names(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Of different names (one column, qname), those that a pattern (first column) finds anywhere in them."""
    listed = patterns.select(F.col(patterns.columns[0]).alias("__pattern")).where("__pattern IS NOT NULL").distinct().withColumn("__literal", _literals("__pattern"))
    sure, open_ = listed.where("__literal IS NOT NULL"), listed.where("__literal IS NULL")
    # of a literal's trigrams the one whose hash is least: common ones such as "com" are not what all patterns share
    keyed = sure.withColumn("__gram", F.array_min(F.transform(_grams(F.col("__literal")), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"])
    split = names.where(F.length("qname") >= GRAM).select("qname", F.explode(_grams(F.col("qname"))).alias("__gram"))
    hits = split.join(keyed, "__gram").where("contains(qname, __literal) AND qname RLIKE __pattern").select("qname")
    rest = names.join(open_, F.expr("qname RLIKE __pattern"), "left_semi").select("qname")
    return hits.unionByName(rest).distinct()
