"""Rows as text and JSON."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens import schema as S
from dnslens.functions.templates import template_line
from dnslens.functions.text import number_text, quoted, rfc3339

#: Fixed value: the default line.
TEXT_FORMAT = "timestamp identity operation rcode queryip queryport family protocol length-unit qname qtype latency"


def _plain(name: str) -> Callable:
    return lambda df, d, b: F.coalesce(F.col(name).cast("string"), F.lit("-")) if name in df.columns else F.lit("-")


def _quoted(name: str, empty: str) -> Callable:
    return lambda df, d, b: F.when(F.col(name) == "", F.lit(empty)).otherwise(quoted(F.col(name), d, b)) if name in df.columns else F.lit("-")


def _flag(name: str, sign: str) -> Callable:
    return lambda df, d, b: F.when(F.col(name), F.lit(sign)).otherwise("-") if name in df.columns else F.lit("-")


def _answer(field: str) -> Callable:
    return lambda df, d, b: F.coalesce(F.get("answers", 0)[field].cast("string"), F.lit("-")) if "answers" in df.columns else F.lit("-")


_DIRECTIVES: dict[str, Callable] = {
    "timestamp": lambda df, d, b: rfc3339(F.col("ts_ns")),
    "timestamp-rfc3339ns": lambda df, d, b: rfc3339(F.col("ts_ns")),
    "timestamp-unixms": lambda df, d, b: F.expr("ts_ns div 1000000").cast("string"),
    "timestamp-unixus": lambda df, d, b: F.expr("ts_ns div 1000").cast("string"),
    "timestamp-unixns": lambda df, d, b: F.col("ts_ns").cast("string"),
    "localtime": lambda df, d, b: F.translate(F.regexp_replace(rfc3339(F.col("ts_ns")), "Z$", ""), "T", " "),
    "qname": _quoted("qname", "."),
    "identity": _quoted("identity", "-"),
    "peer-name": _quoted("peer_name", "-"),
    "version": _quoted("version", "-"),
    "length-unit": lambda df, d, b: F.concat(F.col("length").cast("string"), F.lit("b")),
    "latency": lambda df, d, b: F.format_string("%.9f", F.col("latency")) if "latency" in df.columns else F.lit("0.000000000"),
    "malformed": lambda df, d, b: F.when(F.col("malformed"), "PKTERR").otherwise("-"),
    "qr": lambda df, d, b: F.when(F.col("dns_type") == "REPLY", "R").otherwise("Q"),
    "answercount": lambda df, d, b: F.coalesce(F.size("answers"), F.lit(0)).cast("string") if "answers" in df.columns else F.lit("0"),
    "opcode": lambda df, d, b: F.col("opcode").cast("string") if "opcode" in df.columns else F.lit("0"),
    **{k: _plain(v) for k, v in {
        "extra": "extra", "policy-rule": "policy_rule", "policy-type": "policy_type", "policy-action": "policy_action", "policy-match": "policy_match", "policy-value": "policy_value",
        "query-zone": "query_zone", "operation": "operation", "rcode": "rcode", "id": "dns_id", "queryip": "query_ip", "queryport": "query_port", "responseip": "response_ip",
        "responseport": "response_port", "family": "family", "protocol": "protocol", "length": "length", "qtype": "qtype", "qclass": "qclass",
        "geoip-continent": "geo_continent", "geoip-country": "geo_country", "geoip-city": "geo_city", "geoip-as-number": "geo_asn", "geoip-as-owner": "geo_owner",
        "publicsuffix-tld": "tld", "publicsuffix-etld+1": "etld_plus_one", "publicsuffix-managed-icann": "managed_icann",
        "publixsuffix-tld": "tld", "publixsuffix-etld+1": "etld_plus_one", "publixsuffix-managed-icann": "managed_icann",
        "extracted-dns-payload": "dns_payload", "filtering-sample-rate": "sample_rate", "reducer-occurrences": "occurrences", "reducer-cumulative-length": "cumulative_length",
        "otel-trace-id": "trace_id", "edns-csubnet": "client_subnet",
    }.items()},
    **{k: _answer(v) for k, v in {"answer": "rdata", "answer-ttl": "ttl", "ttl": "ttl"}.items()},
    **{k: _flag(v, s) for k, v, s in (("tc", "flag_tc", "TC"), ("aa", "flag_aa", "AA"), ("ra", "flag_ra", "RA"), ("ad", "flag_ad", "AD"), ("rd", "flag_rd", "RD"), ("cd", "flag_cd", "CD"), ("df", "ip_defragmented", "DF"), ("tr", "tcp_reassembled", "TR"))},
    "suspicious-score": lambda df, d, b: F.coalesce(F.col("suspicious_score").cast("int").cast("string"), F.lit("-")) if "suspicious_score" in df.columns else F.lit("-"),
}


def _indexed(df: DataFrame, directive: str) -> Column | None:
    if m := re.fullmatch(r"(atags|powerdns-tags)(?::(\d+))?", directive):
        name = "tags" if m[1] == "atags" else "powerdns_tags"
        if name not in df.columns:
            return F.lit("-")
        got = F.get(name, int(m[2])) if m[2] else F.when(F.size(name) > 0, F.array_join(name, ","))
        return F.coalesce(got, F.lit("-"))
    if m := re.fullmatch(r"powerdns-metadata:(.+)", directive):
        return F.coalesce(F.element_at("powerdns_metadata", m[1]), F.lit("-")) if "powerdns_metadata" in df.columns else F.lit("-")
    if m := re.fullmatch(r"(ml|suspicious|powerdns)-(.+)", directive):
        name = f"{m[1]}_{m[2].replace('-', '_')}"
        if name not in df.columns:
            return F.lit("-")
        kind = dict(df.dtypes)[name]
        return F.coalesce(F.format_string("%.3f", F.col(name)) if kind == "double" else F.col(name).cast("string"), F.lit("-"))
    return None


def text_line(df: DataFrame, layout: str = TEXT_FORMAT, delimiter: str = " ", boundary: str = '"') -> Column:
    """The line of a row. `{literal}` is copied; absent sections give -; an unknown directive is an error when the plan is built."""
    parts = []
    for directive in re.findall(r"\{[^}]*\}|\S+", layout):
        if directive.startswith("{"):
            parts.append(F.lit(directive[1:-1]))
        elif directive in _DIRECTIVES:
            parts.append(_DIRECTIVES[directive](df, delimiter, boundary))
        elif (made := _indexed(df, directive)) is not None:
            parts.append(made)
        else:
            raise ValueError(f"unknown directive {directive}")
    return F.concat_ws(delimiter, *parts)


def to_text(df: DataFrame, layout: str = TEXT_FORMAT, delimiter: str = " ", boundary: str = '"') -> DataFrame:
    return df.select("msg_id", text_line(df, layout, delimiter, boundary).alias("line"))


def to_json(nested: DataFrame) -> DataFrame:
    """The nested record as JSON; sections that are null are left out."""
    return nested.select("msg_id", F.to_json(F.struct(*(c for c in nested.columns if c != "msg_id"))).alias("line"))


def _json_value(c: Column) -> Column:
    """A value as JSON: an array of it without its brackets."""
    made = F.to_json(F.array(c))
    return F.substring(made, F.lit(2), F.length(made) - 2)


def _numbered(key: str, column: Column, fields: tuple[str, ...]) -> Column:
    """The members `key.0.field` of a list of records; `key` is - if it has none. Numbers sort as text, as all keys do.

    Records without characters that JSON escapes are put together as they are.
    """
    number = lambda f: f in ("ttl", "code")
    text = lambda r, f: F.coalesce(r[f].cast("string"), F.lit("-"))
    head = lambda i, f: F.concat(F.lit(f'"{key}.'), i.cast("string"), F.lit(f'.{f}":'))
    odd = lambda r: F.concat(*(text(r, f) for f in fields if not number(f))).rlike(r'["\\\x00-\x1f\x7f-\x{9f}]')
    plain = lambda r, i: F.concat_ws(",", *(F.concat(head(i, f), r[f].cast("string")) if number(f) else F.concat(head(i, f), F.lit('"'), text(r, f), F.lit('"')) for f in fields))
    careful = lambda r, i: F.concat_ws(",", *(F.concat(head(i, f), _json_value(r[f] if number(f) else text(r, f))) for f in fields))
    one = lambda r, i: F.struct(F.concat(i.cast("string"), F.lit(".")).alias("at"), F.when(odd(r), careful(r, i)).otherwise(plain(r, i)).alias("text"))
    made = F.transform(column, one)
    return _or_none(key, column, F.array_join(F.transform(F.when(F.size(column) > 10, F.array_sort(made)).otherwise(made), lambda e: e["text"]), ","))


def _or_none(key: str, column: Column, text: Column) -> Column:
    return F.when(F.coalesce(F.size(column), F.lit(0)) > 0, text).otherwise(F.lit(f'"{key}":"-"'))


def flat_json(df: DataFrame) -> Column:
    """The flat view with typed values as JSON, its keys in order; records, options and tags get numbered keys."""
    plain = {k: S.value(df, k) for k in S.FLAT_UNSET if k not in S.LISTS and k != "dnstap.latency"}
    plain |= {"dnstap.timestamp-rfc3339ns": rfc3339(F.col("ts_ns"))} | {k: F.col(c) for k, c in S.FLAT_KEYS.items()}
    more = S.sections(df)
    tags = more.pop("atags", None)
    plain |= {f"{name}.{k}": F.col(c) for name, fields in more.items() for k, c in fields.items()}
    made = {"dnstap.latency": F.concat(F.lit('"dnstap.latency":'), number_text(S.value(df, "dnstap.latency")))}
    for key in S.LISTS:
        column = S.list_column(df, key)
        made[key] = _numbered(key, F.col(column), S.list_fields(key)) if column else F.lit(f'"{key}":"-"')
    if tags:
        tag = lambda t, i: F.struct(i.cast("string").alias("at"), F.concat(F.lit('"atags.tags.'), i.cast("string"), F.lit('":'), _json_value(t)).alias("text"))
        made["atags.tags"] = _or_none("atags.tags", F.col("tags"), F.array_join(F.transform(F.array_sort(F.transform("tags", tag)), lambda e: e["text"]), ","))
    parts: list[Column] = []
    run: list[Column] = []
    for key in [*sorted(plain | made), None]:  # each run of plain keys is one struct
        if key in plain:
            run.append(plain[key].alias(key))
            continue
        if run:
            text = F.to_json(F.struct(*run))
            parts.append(F.substring(text, F.lit(2), F.length(text) - 2))
            run = []
        if key is not None:
            parts.append(made[key])
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.when(p != "", p) for p in parts)), F.lit("}"))


def to_flat_json(df: DataFrame) -> DataFrame:
    """Dotted keys in order as JSON."""
    return df.select("msg_id", flat_json(df).alias("line"))


def to_template(nested: DataFrame, template: str, autoescape: bool = True) -> DataFrame:
    """Text by a template with values, filters, conditions and loops; see dnslens.functions.templates."""
    return nested.select("msg_id", template_line(nested, template, autoescape).alias("line"))


def replace_nul(df: DataFrame, column: str = "line", by: str = "�") -> DataFrame:
    return df.withColumn(column, F.translate(column, "\0", by))
