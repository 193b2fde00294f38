"""Rows shaped for sinks: records, points, bulks, streams, lines."""

from __future__ import annotations

import gzip
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnslens.functions.formats import flat_json, text_line
from dnslens.functions.text import go_quoted
from dnslens.operators.normalize import flat_parts, map_of_parts
from dnslens.operators.running import sums_before
from dnslens.plans.shared import stored


def line(df: DataFrame, mode: str = "text") -> Column:
    """The row in a mode: text, json or flat-json."""
    return text_line(df) if mode == "text" else F.to_json(F.struct(*df.columns)) if mode == "json" else flat_json(df)


def kafka_records(df: DataFrame, mode: str = "text", partition: int | None = None) -> DataFrame:
    """key, value (and partition, if fixed): what format("kafka") takes."""
    out = df.select(F.col("identity").alias("key"), line(df, mode).alias("value"))
    return out if partition is None else out.withColumn("partition", F.lit(partition))


def clickhouse_rows(df: DataFrame) -> DataFrame:
    return df.select("identity", F.col("query_ip").alias("queryip"), "qname", "operation", "family", "protocol", "qtype", "rcode", F.col("ts_ns").cast("string").alias("timensec"), F.expr("ts_ns div 1000000000").cast("string").alias("timestamp"))


def influx_points(df: DataFrame) -> DataFrame:
    """Line protocol: measurement dns, three tags, five fields, time in nanoseconds."""
    tag = lambda c: F.regexp_replace(F.col(c), r"([ ,=])", r"\\$1")
    text = lambda c: go_quoted(F.col(c))
    point = F.concat(
        F.lit("dns,Identity="), tag("identity"), F.lit(",Qname="), tag("qname"), F.lit(",QueryIP="), tag("query_ip"),
        F.lit(" Family="), text("family"), F.lit(",Operation="), text("operation"), F.lit(",Protocol="), text("protocol"), F.lit(",Qtype="), text("qtype"), F.lit(",Rcode="), text("rcode"),
        F.lit(" "), F.col("ts_ns").cast("string"),
    )
    return df.select("msg_id", point.alias("point"))


def _hour() -> Column:
    """Batches never span hours."""
    return F.expr("ts_ns div 3600000000000").alias("hour")


def with_batches(df: DataFrame, by: list[str], size: Column, most: int, name: str) -> DataFrame:
    """df with the number of a row's batch: its group's running size in time order over the bound."""
    return sums_before(df, by, ["ts_ns", "msg_id"], "__before", size).withColumn(name, F.floor(F.col("__before") / F.lit(most).cast("decimal(20,0)")).cast("long")).drop("__before")


@F.pandas_udf(T.BinaryType())
def gzipped(bodies: pd.Series) -> pd.Series:
    """Request bodies as gzip; the same bytes for the same text."""
    return bodies.map(lambda x: gzip.compress(x.encode(), mtime=0), na_action="ignore")


def es_bulk(df: DataFrame, bulk_bytes: int = 5 << 20, compression: str = "none") -> DataFrame:
    """identity, hour, bulk, body: newline-delimited create actions, cut where the running size passes bulk_bytes.

    With compression="gzip", body is binary.
    """
    rows = df.select("identity", _hour(), "ts_ns", "msg_id", F.concat(F.lit('{"create":{}}\n'), flat_json(df), F.lit("\n")).alias("item"))
    rows = with_batches(rows, ["identity", "hour"], F.octet_length("item"), bulk_bytes, "bulk")
    items = F.array_sort(F.collect_list(F.struct("ts_ns", "msg_id", "item")))
    out = rows.groupBy("identity", "hour", "bulk").agg(F.array_join(F.transform(items, lambda x: x["item"]), "").alias("body"), F.count("*").alias("n"))
    return out.withColumn("body", gzipped("body")) if compression == "gzip" else out


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike(rf"^(?s:{pattern})\z")


def _replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, rf"^(?s:{pattern})\z", re.sub(r"\$\{(\d+)\}", r"$\1", by))


def _with_label(labels: Column, name: Column, value: Column) -> Column:
    """The map with a label set; an empty value takes the label away."""
    others = F.map_filter(labels, lambda k, v: k != name)
    return F.when(value == "", others).otherwise(F.map_concat(others, F.create_map(name, value)))


def _rule(labels: Column, rule: dict) -> Column:
    """The labels after one rule; null if it drops the row."""
    action, pattern = rule.get("action", "replace"), rule.get("regex", "(.*)")
    by, target = rule.get("replacement", "$1"), rule.get("target_label", "")
    sources = [F.coalesce(F.try_element_at(labels, F.lit(x)), F.lit("")) for x in rule.get("source_labels", [])]
    value = F.concat_ws(rule.get("separator", ";"), *sources)
    if action == "replace":
        name = _replaced(value, pattern, target) if "$" in target else F.lit(target)
        return F.when(_matches(value, pattern), _with_label(labels, name, _replaced(value, pattern, by))).otherwise(labels)
    if action in ("keep", "drop"):
        return F.when(_matches(value, pattern) if action == "keep" else ~_matches(value, pattern), labels)
    if action in ("keepequal", "dropequal"):
        own = F.coalesce(F.try_element_at(labels, F.lit(target)), F.lit(""))
        return F.when(value == own if action == "keepequal" else value != own, labels)
    if action in ("lowercase", "uppercase"):
        return _with_label(labels, F.lit(target), F.lower(value) if action == "lowercase" else F.upper(value))
    if action == "hashmod":  # the last eight bytes of the MD5, unsigned
        number = F.conv(F.substring(F.md5(value.cast("binary")), 17, 16), 16, 10).cast("decimal(20,0)")
        return _with_label(labels, F.lit(target), (number % F.lit(rule["modulus"])).cast("long").cast("string"))
    if action == "labelmap":
        found = F.array_sort(F.map_entries(F.map_filter(labels, _named(pattern, True))))
        return F.aggregate(found, labels, _copied(pattern, by))
    if action in ("labeldrop", "labelkeep"):
        return F.map_filter(labels, _named(pattern, action == "labelkeep"))
    raise ValueError(f"unknown action {action}")


def _step(rule: dict):
    return lambda labels: _rule(labels, rule)


def relabel(labels: Column, rules: list[dict]) -> Column:
    """Rules on a map of labels, one after another, as Prometheus has them; null where a rule drops the row.

    A rule has action (replace), source_labels, separator (;), regex ((.*)), target_label, replacement ($1) and modulus.
    Actions: replace, keep, drop, keepequal, dropequal, lowercase, uppercase, hashmod, labelmap, labeldrop, labelkeep. A regex
    must match the whole value. Each rule is a lambda over the map before it, so that no map is computed twice.
    """
    for rule in rules:
        labels = F.get(F.transform(F.array(labels), _step(rule)), 0)
    return labels


def _named(pattern: str, wanted: bool):
    return lambda k, v: _matches(k, pattern) if wanted else ~_matches(k, pattern)


def _copied(pattern: str, by: str):
    return lambda labels, e: _with_label(labels, _replaced(e["key"], pattern, by), e["value"])


def _label_set(labels: Column) -> Column:
    """A map of labels as text, in order of names."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def _hidden(df: DataFrame, rules: list[dict]) -> Column:
    """The fields of the flat view as labels with `__`, but for those that no rule reads: they would go unseen.

    Rules read the labels that they name, and labelmap those that its pattern matches. Numbered keys differ from row to row;
    they are made if a rule could read one.
    """
    pairs, entries = flat_parts(df)
    label = lambda k: "__" + k.replace(".", "_")
    named = {x for r in rules for x in (*r.get("source_labels", []), *([r["target_label"]] if r.get("action") in ("keepequal", "dropequal") else []))}
    java = df.sparkSession._jvm.java.util.regex.Pattern  # what rlike matches by
    maps = [java.compile(rf"^(?s:{r.get('regex', '(.*)')})\z") for r in rules if r.get("action") == "labelmap"]
    read = {k: v for k, v in pairs.items() if label(k) in named or any(m.matcher(label(k)).find() for m in maps)}
    others = entries if maps or any(x.startswith("__") and x not in set(map(label, pairs)) for x in named) else []
    if not read and not others:
        return F.create_map().cast("map<string,string>")
    return F.transform_keys(map_of_parts(read, others), lambda k, v: F.concat(F.lit("__"), F.replace(k, F.lit("."), F.lit("_"))))


def loki_streams(df: DataFrame, job: str = "dnslens", batch_bytes: int = 1 << 20, labels: dict[str, str] | None = None, rules: list[dict] | None = None, mode: str = "text") -> DataFrame:
    """labels, hour, batch, entries: lines by label set; labels: from label name to column. Rows with no label are dropped.

    With rules, every field of the flat view is a label too (`__` and its key with _ for dots) while the rules run; labels
    that begin with __ go afterwards. Only those that a rule can read are made.
    """
    named = labels or {"identity": "identity"}
    rows = df.where(" and ".join(f"{c} is not null and {c} <> ''" for c in named.values()))
    given = F.create_map(*(x for k, c in sorted({**named, "job": None}.items()) for x in (F.lit(k), F.col(c).cast("string") if c else F.lit(job))))
    columns = [_hour(), "ts_ns", "msg_id", line(df, mode).alias("line")]
    if rules:
        hidden = _hidden(df, rules)
        shown = F.map_filter(relabel(F.map_concat(given, hidden), rules), lambda k, v: ~k.startswith("__"))
        # rules run once a row: a filter on their labels, and the sample of the ranges, would run them again
        rows = stored(rows.select(_label_set(shown).alias("labels"), *columns), "labels").where("labels <> '{}'")
    else:
        rows = rows.select(_label_set(given).alias("labels"), *columns)
    rows = with_batches(rows, ["labels", "hour"], F.octet_length("line"), batch_bytes, "batch")
    entries = F.array_sort(F.collect_list(F.struct("ts_ns", "msg_id", "line")))
    return rows.groupBy("labels", "hour", "batch").agg(F.count("*").alias("n"), F.array_join(F.transform(entries, lambda x: F.concat(x["ts_ns"].cast("string"), F.lit(" "), x["line"])), "\n").alias("entries"))


def scalyr_events(df: DataFrame, per_request: int = 400, attrs: dict[str, str] | None = None) -> DataFrame:
    """One row per event: identity, hour, request, ts, sev, attrs; the user's attributes don't override the message."""
    given = F.map_from_arrays(F.array(*map(F.lit, attrs or {"parser": "dns"})), F.array(*map(F.lit, (attrs or {"parser": "dns"}).values())))
    both = F.map_concat(F.map_filter(given, lambda k, v: k != "message"), F.create_map(F.lit("message"), text_line(df)))
    rows = df.select("msg_id", "identity", _hour(), "ts_ns", F.lit(3).alias("sev"), F.to_json(both).alias("attrs"))
    rows = with_batches(rows, ["identity", "hour"], F.lit(1), per_request, "request")
    return rows.select("msg_id", "identity", "hour", "request", F.col("ts_ns").cast("string").alias("ts"), "sev", "attrs")


def fluentd_records(df: DataFrame, tag: str = "dns.message") -> DataFrame:
    return df.select("msg_id", F.lit(tag).alias("tag"), F.expr("ts_ns div 1000000000").alias("time"), flat_json(df).alias("record"))


def redis_publish(df: DataFrame, channel: str = "dns") -> DataFrame:
    return df.select("msg_id", F.concat(F.lit("PUBLISH "), go_quoted(F.lit(channel)), F.lit(" "), go_quoted(text_line(df))).alias("command"))


def statsd_lines(stats: DataFrame, prefix: str = "dnslens") -> DataFrame:
    return stats.select(F.concat(F.lit(prefix + "_"), "identity", F.lit("_"), "metric", F.lit(":"), F.col("value").cast("string"), F.lit("|c")).alias("line"))


def exposition_lines(metrics: DataFrame, prefix: str = "dnslens", label: str = "stream_id") -> DataFrame:
    """Text lines name{label="value"} number of a wide table of counters."""
    long = metrics.unpivot(label, [c for c in metrics.columns if c != label], "metric", "value")
    name = F.regexp_replace(F.concat(F.lit(prefix + "_"), "metric"), "[^a-zA-Z0-9_:]", "_")
    return long.select(F.concat(name, F.lit(f'{{{label}="'), F.col(label), F.lit('"} '), F.col("value").cast("string")).alias("line"))


