"""Records from text logs and from structs of parsed protobuf messages or raw packets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens import schema as S
from dnslens.functions.text import rfc3339

# The default line patterns.
PATTERN_QUERY = r"^(?P<timestamp>[^ ]*) (?P<identity>[^ ]*) (?P<qr>.*_QUERY) (?P<rcode>[^ ]*) (?P<queryip>[^ ]*) (?P<queryport>[^ ]*) (?P<family>[^ ]*) (?P<protocol>[^ ]*) (?P<length>[^ ]*)b (?P<domain>[^ ]*) (?P<qtype>[^ ]*) (?P<latency>[^ ]*)$"
PATTERN_REPLY = r"^(?P<timestamp>[^ ]*) (?P<identity>[^ ]*) (?P<qr>.*_RESPONSE) (?P<rcode>[^ ]*) (?P<queryip>[^ ]*) (?P<queryport>[^ ]*) (?P<family>[^ ]*) (?P<protocol>[^ ]*) (?P<length>[^ ]*)b (?P<domain>[^ ]*) (?P<qtype>[^ ]*) (?P<latency>[^ ]*)$"


def tail_parse(lines: DataFrame, pattern_query: str = PATTERN_QUERY, pattern_reply: str = PATTERN_REPLY, time_layout: str | None = None) -> DataFrame:
    """Lines (column value) as log rows: the query pattern first, else the reply pattern; others and bad times are skipped.

    Named groups fill the record; what is missing gets its default (family IPv4, protocol UDP). time_layout is a Spark
    pattern; None reads RFC 3339.
    """
    value = F.col("value")
    is_query, is_reply = value.rlike(_java(pattern_query)), value.rlike(_java(pattern_reply))

    def groups(p: str) -> Column:  # all groups by one run of the pattern
        n = re.compile(p).groups
        return F.split(F.regexp_replace(value, _java(p), "\x01".join(f"${i + 1}" for i in range(n))), "\x01")

    lines = lines.where(is_query | is_reply).select("value", F.when(is_query, groups(pattern_query)).otherwise(groups(pattern_reply)).alias("__g"), is_query.alias("__q"))
    is_query = F.col("__q")

    def field(name: str, default: str | None) -> Column:
        def of(p: str) -> Column:
            index = re.compile(p).groupindex.get(name)
            return F.nullif(F.get("__g", index - 1), F.lit("")) if index else F.lit(None).cast("string")

        return F.coalesce(F.when(is_query, of(pattern_query)).otherwise(of(pattern_reply)), F.lit(default))

    ts = F.try_to_timestamp(field("timestamp", None), F.lit(time_layout)) if time_layout else F.try_to_timestamp(field("timestamp", None))
    rows = lines.select(
        F.unix_micros(ts).alias("__us"), field("identity", "-").alias("identity"), field("qr", "-").alias("operation"), F.when(is_query, "QUERY").otherwise("REPLY").alias("dns_type"), field("rcode", "-").alias("rcode"),
        field("queryip", "-").alias("query_ip"), field("queryport", "0").alias("query_port"), field("responseip", "-").alias("response_ip"), field("responseport", "0").alias("response_port"),
        field("family", "IPv4").alias("family"), field("protocol", "UDP").alias("protocol"), field("domain", "-").alias("qname"), field("qtype", "-").alias("qtype"), F.coalesce(field("length", "0").try_cast("long"), F.lit(0)).alias("length"),
    )
    return rows.where("__us is not null").withColumn("ts_ns", F.col("__us") * 1000).drop("__us")


def _java(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


def tail_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Lines of text files, to be parsed by tail_parse; as a stream new files are read as they come."""
    return spark.readStream.text(path) if stream else spark.read.text(path)


def _or_dash(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("-"))


def dnstap_rows(df: DataFrame, extended: bool = False) -> DataFrame:
    """Columns type (number; odd is a query), identity, version, operation, socket family and protocol, addresses, the
    times of query and response (s, ns) and the policy struct, as record columns. extended: extra holds tags, suffixes,
    sample rate and the original extra."""
    query = F.col("type") % 2 == 1
    ns = F.when(query, F.col("query_time_sec") * 1_000_000_000 + F.col("query_time_nsec")).otherwise(F.col("response_time_sec") * 1_000_000_000 + F.col("response_time_nsec"))
    policy = {f"policy_{f}": _or_dash(F.col("policy")[f]) for f in ("rule", "type", "match", "action", "value")}
    out = {
        "identity": _or_dash(F.col("identity")), "version": _or_dash(F.col("version")), "operation": _or_dash(F.col("operation")), "dns_type": F.when(query, "QUERY").otherwise("REPLY"),
        "family": S.lookup({"INET": "IPv4", "INET6": "IPv6"}, F.col("socket_family")), "protocol": _or_dash(F.col("socket_protocol")), "query_ip": _or_dash(F.col("query_address")),
        "query_port": _or_dash(F.col("query_port")), "response_ip": _or_dash(F.col("response_address")), "response_port": _or_dash(F.col("response_port")), "peer_name": _or_dash(F.col("peer_name")), "query_zone": _or_dash(F.col("query_zone")), "ts_ns": ns, "timestamp": rfc3339(ns),
    }
    keep = [F.col("msg_id"), *(v.alias(k) for k, v in (out | policy).items())]
    if extended:
        x = F.col("extended")
        keep += [x["tags"].alias("tags"), _or_dash(x["tld"]).alias("tld"), _or_dash(x["etld_plus_one"]).alias("etld_plus_one"), F.coalesce(x["sample_rate"], F.lit(0)).alias("sample_rate"), _or_dash(x["original_extra"]).alias("extra")]
    else:
        keep.append(_or_dash(F.col("extra")).alias("extra"))
    return df.select(*keep)


def powerdns_rows(df: DataFrame) -> DataFrame:
    """Columns of a parsed PowerDNS message as record columns: operation by type, one final dot off the name, reply latency,
    metadata values joined by spaces, A and AAAA bytes as text, ids in hex."""
    reply = F.col("type").isin("DNSResponseType", "DNSIncomingResponseType")
    ns = F.col("time_sec") * 1_000_000_000 + F.col("time_usec") * 1000
    asked = F.col("query_time_sec") * 1_000_000_000 + F.col("query_time_usec") * 1000
    v4 = lambda b: F.concat_ws(".", *(F.conv(F.hex(F.substring(b, i, 1)), 16, 10) for i in range(1, 5)))
    v6 = lambda b: F.lower(F.concat_ws(":", *(F.hex(F.substring(b, i, 2)) for i in range(1, 17, 2))))
    rdata = lambda r: F.when(r["type"] == 1, v4(r["rdata"])).when(r["type"] == 28, v6(r["rdata"])).otherwise("-")
    name = lambda c: F.regexp_replace(c, r"\.$", "")
    record = lambda r: F.struct(name(r["name"]).alias("name"), S.lookup(S.RDATATYPES, r["type"]).alias("rdatatype"), S.lookup(S.CLASSES, r["class"]).alias("class"), r["ttl"].alias("ttl"), rdata(r).alias("rdata"))
    return df.select(
        "msg_id", _or_dash(F.col("server")).alias("identity"), S.lookup(S.POWERDNS_OPERATIONS, F.col("type")).alias("operation"), F.when(reply, "REPLY").otherwise("QUERY").alias("dns_type"), name(F.col("question_name")).alias("qname"), S.lookup(S.RDATATYPES, F.col("question_type")).alias("qtype"),
        F.when(reply, S.lookup(S.RCODES, F.col("rcode_number"))).otherwise("-").alias("rcode"), ns.alias("ts_ns"), F.when(reply, (ns - asked) / 1e9).otherwise(0.0).alias("latency"), F.col("tags").alias("powerdns_tags"),
        F.map_from_entries(F.transform("meta", lambda m: F.struct(m["key"], F.array_join(m["values"], " ")))).alias("powerdns_metadata"), _or_dash(F.col("applied_policy")).alias("policy"), F.lower(F.hex("message_id")).alias("message_id"), F.transform("rrs", record).alias("answers"),
    )


def packet_rows(df: DataFrame) -> DataFrame:
    """Packets (src and dst address and port, payload) as record columns: the QR bit tells replies, whose ends are swapped."""
    qr = F.conv(F.hex(F.substring("payload", 3, 1)), 16, 10).cast("long") >= 128
    pick = lambda a, b: F.when(qr, F.col(b)).otherwise(F.col(a))
    return df.select(
        "msg_id", F.when(qr, "REPLY").otherwise("QUERY").alias("dns_type"), F.when(qr, "CLIENT_RESPONSE").otherwise("CLIENT_QUERY").alias("operation"), pick("src_ip", "dst_ip").alias("query_ip"), pick("src_port", "dst_port").alias("query_port"),
        pick("dst_ip", "src_ip").alias("response_ip"), pick("dst_port", "src_port").alias("response_port"), F.octet_length("payload").cast("long").alias("length"),
    )
