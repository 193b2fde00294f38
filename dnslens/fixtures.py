"""The DNS log derived from the events table, and the small side tables of the queries."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = """
WITH e AS (
  SELECT event_id, user_id, event_type, {us} AS us, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM {events}),
b AS (
  SELECT *,
    concat('ns', CAST(user_id % 3 AS VARCHAR(8))) AS identity,
    concat('192.0.', CAST(user_id % 16 AS VARCHAR(8)), '.', CAST(event_id % 200 + 1 AS VARCHAR(8))) AS query_ip,
    concat('198.51.100.', CAST(user_id % 3 + 1 AS VARCHAR(8))) AS response_ip,
    CAST(1024 + event_id % 60000 AS VARCHAR(8)) AS query_port,
    CAST(event_id % 65536 AS BIGINT) AS dns_id,
    concat(CASE WHEN event_id % 11 = 0 THEN 'WwW' WHEN event_id % 101 = 0 THEN 'a b==' ELSE event_type END,
           CAST(k AS VARCHAR(8)),
           CASE user_id % 5 WHEN 0 THEN '.example.com' WHEN 1 THEN '.Example.co.uk' WHEN 2 THEN '.shop.example.org'
             WHEN 3 THEN '.a.b.c.d.e.f.g.h.i.j.example.net' ELSE '.user.github.io' END) AS qname,
    CASE event_id % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'TXT' WHEN 3 THEN 'MX' WHEN 4 THEN 'HTTPS'
      WHEN 5 THEN 'ANY' ELSE 'PTR' END AS qtype,
    CASE WHEN event_id % 10 = 0 THEN 'NXDOMAIN' WHEN event_id % 10 = 1 THEN 'SERVFAIL' ELSE 'NOERROR' END AS r_rcode,
    CASE WHEN event_id % 4 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol, 'IPv4' AS family
  FROM e)
SELECT CAST(event_id*2 AS BIGINT) AS msg_id, us*1000 AS ts_ns, identity, 'CLIENT_QUERY' AS operation, 'QUERY' AS dns_type,
  '-' AS rcode, query_ip, query_port, response_ip, '53' AS response_port, family, protocol, dns_id, qname, qtype,
  CAST(30+k AS BIGINT) AS length, false AS flag_aa, (event_id % 5 = 0) AS flag_rd, (event_id % 50 = 7) AS malformed FROM b
UNION ALL
SELECT CAST(event_id*2+1 AS BIGINT), (us + k*25000 + 137)*1000, identity, 'CLIENT_RESPONSE', 'REPLY', r_rcode, query_ip,
  query_port, response_ip, '53', family, protocol, dns_id, qname, qtype, CAST(60+k*12 AS BIGINT), (event_id % 3 = 0),
  (event_id % 5 = 0), (event_id % 50 = 7) FROM b WHERE event_id % 17 <> 0
"""

#: The log as DuckDB SQL over the view `events`.
LOG_SQL = _LOG.format(us="epoch_us(ts)", events="events")

# Side tables of the queries.
PSL = [("com", "normal", True), ("fr", "normal", True), ("org", "normal", True), ("net", "normal", True), ("uk", "normal", True), ("co.uk", "normal", True), ("io", "normal", True), ("github.io", "normal", False), ("googleapis.com", "normal", False), ("ck", "wildcard", True), ("www.ck", "exception", True)]
GEO = [("192.0.0.0/22", "FR", "EU", "Paris", 64500, "Example West"), ("192.0.2.0/24", "DE", "EU", "Berlin", 64501, "Example Mid"), ("192.0.8.0/21", "US", "NA", "Boston", 64502, "Example East"), ("198.51.100.0/24", "JP", "AS", "Kobe", 64503, "Example Far"), ("203.0.113.0/25", "CN", "AS", "Wuhan", 64504, "Example North")]
NETWORKS = ["192.168.1.15", "192.168.1.12", "192.168.1.10", "192.0.2.0/21"]


def dns_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat log. The session's time zone must be UTC for it to equal LOG_SQL."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_LOG.format(us="unix_micros(CAST(ts AS TIMESTAMP))", events="{events}"), events=events)


_REPEATED = """SELECT * REPLACE (msg_id * 8 + i AS msg_id, ts_ns + i * 800000000 AS ts_ns) FROM (
  SELECT *, unnest(range(msg_id % 7)) AS i FROM dns_log)"""
#: The log of `repeated` as DuckDB SQL; needs dns_log.
REPEATED_SQL = f"SELECT * EXCLUDE (i) FROM ({_REPEATED})"


def repeated(log: DataFrame) -> DataFrame:
    """Each row up to six times, 0.8 s apart, so that repeats cross the ticks of any interval."""
    rows = log.where("msg_id % 7 > 0").withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("msg_id") % 7 - 1)))
    return rows.withColumns({"msg_id": F.col("msg_id") * 8 + F.col("__i"), "ts_ns": F.col("ts_ns") + F.col("__i") * 800_000_000}).drop("__i")


def with_answers(log: DataFrame) -> DataFrame:
    """The log with a column answers: one A record on each NOERROR reply (ttl and address follow the name's number)."""
    k = F.regexp_extract("qname", r"(\d+)\.", 1).cast("long")
    record = F.struct(F.col("qname").alias("name"), F.lit("A").alias("rdatatype"), F.lit("IN").alias("class"), (60 + k).alias("ttl"), F.concat(F.lit("203.0.113."), (k + 1).cast("string")).alias("rdata"))
    return log.withColumn("answers", F.when((F.col("dns_type") == "REPLY") & (F.col("rcode") == "NOERROR"), F.array(record)))


#: msg_id and the same A records in DuckDB, with idx; needs dns_log.
ANSWERS_SQL = r"SELECT msg_id, qname AS name, 'A' AS rdatatype, 'IN' AS class, 60 + CAST(regexp_extract(qname, '(\d+)\.', 1) AS BIGINT) AS ttl, concat('203.0.113.', CAST(regexp_extract(qname, '(\d+)\.', 1) AS BIGINT) + 1) AS rdata FROM dns_log WHERE dns_type = 'REPLY' AND rcode = 'NOERROR'"


def with_records(log: DataFrame) -> DataFrame:
    """The log with what a decoded packet holds: opcode, class, counts, flags, EDNS with options, latency, and lists of records.

    Every fourth id's answers have a second record; NXDOMAIN replies have a name server's. RECORDS_SQL is the same.
    """
    k = F.regexp_extract("qname", r"(\d+)\.", 1).cast("long")
    record = lambda kind, ttl, rdata: F.struct(F.col("qname").alias("name"), F.lit(kind).alias("rdatatype"), F.lit("IN").alias("class"), ttl.alias("ttl"), rdata.alias("rdata"))
    first = record("A", 60 + k, F.concat(F.lit("203.0.113."), (k + 1).cast("string")))
    second = record("TXT", F.lit(300).cast("long"), F.concat(F.lit('a "quoted" text '), k.cast("string")))
    soa = record("SOA", F.lit(900).cast("long"), F.lit("ns.example. root.example. 1 2 3 4 5"))
    query, none = F.col("dns_type") == "QUERY", F.array().cast("array<struct<name:string,rdatatype:string,class:string,ttl:bigint,rdata:string>>")
    found = (F.col("dns_type") == "REPLY") & (F.col("rcode") == "NOERROR")
    number = lambda n: F.lit(n).cast("long")
    subnet = F.struct(number(8).alias("code"), F.lit("CSUBNET").alias("name"), F.lit("1.58.30.0/24").alias("data"))
    return log.withColumns({
        "opcode": F.when(F.col("dns_id") % 7 == 0, number(5)).otherwise(number(0)), "qclass": F.when(F.col("dns_id") % 13 == 0, "CH").otherwise("IN"),
        "answers": F.when(found & (F.col("dns_id") % 4 == 0), F.array(first, second)).when(found, F.array(first)).otherwise(none),
        "ns": F.when(F.col("rcode") == "NXDOMAIN", F.array(soa)).otherwise(none), "ar": none, "qdcount": number(1),
        "flag_tc": F.col("dns_id") % 29 == 0, "flag_ra": ~query, "flag_ad": F.lit(False), "flag_cd": F.col("dns_id") % 31 == 0,
        "edns_udp_size": F.when(query, number(1232)).otherwise(number(0)), "edns_rcode": number(0), "edns_version": number(0), "edns_do": F.when(query, number(1)).otherwise(number(0)),
        "options": F.when(query, F.array(subnet)), "latency": F.when(query, F.lit(0.0)).otherwise(F.col("dns_id") % 1000 / 1000),
    })


_SQL_RECORD = "struct_pack(name := qname, rdatatype := '{}', class := 'IN', ttl := CAST({} AS BIGINT), rdata := {})"
_SQL_K = r"CAST(regexp_extract(qname, '(\d+)\.', 1) AS BIGINT)"
#: The log of `with_records` in DuckDB; needs dns_log.
RECORDS_SQL = f"""SELECT *, CAST(CASE WHEN dns_id % 7 = 0 THEN 5 ELSE 0 END AS BIGINT) AS opcode, CASE WHEN dns_id % 13 = 0 THEN 'CH' ELSE 'IN' END AS qclass,
  CASE WHEN rcode = 'NOERROR' AND dns_type = 'REPLY' THEN [{_SQL_RECORD.format('A', f'60 + {_SQL_K}', f"concat('203.0.113.', {_SQL_K} + 1)")}]
    || CASE WHEN dns_id % 4 = 0 THEN [{_SQL_RECORD.format('TXT', 300, f"concat('a " + '"quoted"' + f" text ', {_SQL_K})")}] ELSE [] END ELSE [] END AS answers,
  CASE WHEN rcode = 'NXDOMAIN' THEN [{_SQL_RECORD.format('SOA', 900, "'ns.example. root.example. 1 2 3 4 5'")}] ELSE [] END AS ns,
  CASE WHEN false THEN [{_SQL_RECORD.format('A', 1, "''")}] ELSE [] END AS ar,
  CAST(1 AS BIGINT) AS qdcount, dns_id % 29 = 0 AS flag_tc, dns_type = 'REPLY' AS flag_ra, false AS flag_ad, dns_id % 31 = 0 AS flag_cd,
  CAST(CASE WHEN dns_type = 'QUERY' THEN 1232 ELSE 0 END AS BIGINT) AS edns_udp_size, CAST(0 AS BIGINT) AS edns_rcode, CAST(0 AS BIGINT) AS edns_version,
  CAST(CASE WHEN dns_type = 'QUERY' THEN 1 ELSE 0 END AS BIGINT) AS edns_do,
  CASE WHEN dns_type = 'QUERY' THEN [struct_pack(code := CAST(8 AS BIGINT), name := 'CSUBNET', data := '1.58.30.0/24')] ELSE [] END AS options,
  CASE WHEN dns_type = 'QUERY' THEN 0.0 ELSE CAST(dns_id % 1000 AS DOUBLE) / 1000 END AS latency
FROM dns_log"""


#: What decoding `payloads` gives, with the log's other columns; needs dns_log. A malformed packet is cut in its question.
PACKETS_SQL = f"""SELECT * REPLACE (
  CASE WHEN malformed THEN '-' ELSE 'IN' END AS qclass, CAST(0 AS BIGINT) AS opcode, 0.0 AS latency, false AS flag_tc, false AS flag_ra, false AS flag_cd,
  CASE WHEN malformed THEN [] ELSE answers[:1] END AS answers, ns[:0] AS ns,
  CASE WHEN malformed THEN 0 ELSE edns_udp_size END AS edns_udp_size, CASE WHEN malformed THEN 0 ELSE edns_do END AS edns_do,
  CASE WHEN malformed THEN options[:0] ELSE options END AS options),
  CAST(dns_type = 'REPLY' AND rcode = 'NOERROR' AS BIGINT) AS ancount, CAST(dns_type = 'QUERY' AS BIGINT) AS arcount
FROM ({RECORDS_SQL})"""


def psl(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PSL, "rule string, kind string, icann boolean")


def geo_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GEO, "cidr string, country string, continent string, city string, asn long, as_owner string")


def encode_message(dns_id: int, reply: bool, rcode: int, flags: tuple[bool, bool], qname: str, qtype: int, answer: tuple[int, bytes] | None, malformed: bool = False) -> bytes:
    """A DNS packet with one question, one A answer if given, and an EDNS record with a client subnet on queries."""
    aa, rd = flags
    bits = reply << 15 | aa << 10 | rd << 8 | rcode
    name = b"".join(bytes([len(x)]) + x for x in (p.encode() for p in qname.split("."))) + b"\0"
    out = struct.pack(">HHHHHH", dns_id, bits, 1, answer is not None, 0, not reply) + name + struct.pack(">HH", qtype, 1)
    if answer:
        out += b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, answer[0], 4) + answer[1]
    if not reply:
        out += b"\0" + struct.pack(">HHIHHHHBB", 41, 1232, 0x8000, 11, 8, 7, 1, 24, 0) + b"\x01\x3a\x1e"
    return out[: len(name) + 6] if malformed else out


def payloads(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """msg_id, payload and the columns to keep: the log's rows as packets, as encode_message makes them, by expressions."""
    from dnslens.schema import RCODES, RDATATYPES, lookup

    types, codes = {v: k for k, v in RDATATYPES.items()}, {v: k for k, v in RCODES.items()}
    number = lambda c, size: F.unhex(F.lpad(F.hex(c), 2 * size, "0"))
    fixed = lambda raw: F.unhex(F.lit(raw.hex()))
    bit = lambda c, k: F.when(c, 1 << k).otherwise(0)
    reply, answer = F.col("dns_type") == "REPLY", F.get("answers", 0)
    flags = bit(reply, 15) + bit(F.col("flag_aa"), 10) + bit(F.col("flag_rd"), 8) + lookup(codes, F.col("rcode"), F.lit(0))
    size = lambda x: F.unhex(F.lpad(F.hex(F.octet_length(x)), 2, "0"))
    labels = F.transform(F.split("qname", "[.]"), lambda x: F.concat(size(x), x.cast("binary")))
    name = F.aggregate(labels, fixed(b""), lambda done, x: F.concat(done, x))
    head = F.concat(number("dns_id", 2), number(flags, 2), fixed(b"\0\1"), number(bit(answer.isNotNull(), 0), 2), fixed(b"\0\0"), number(bit(~reply, 0), 2))
    address = F.aggregate(F.transform(F.split(answer["rdata"], "[.]"), lambda x: number(x.cast("int"), 1)), fixed(b""), lambda done, x: F.concat(done, x))
    record = F.when(answer.isNotNull(), F.concat(fixed(b"\xc0\x0c\0\1\0\1"), number(answer["ttl"], 4), fixed(b"\0\4"), address)).otherwise(fixed(b""))
    edns = F.when(reply, fixed(b"")).otherwise(fixed(b"\0" + struct.pack(">HHIHHHHBB", 41, 1232, 0x8000, 11, 8, 7, 1, 24, 0) + b"\x01\x3a\x1e"))
    named = with_answers(log).withColumn("__name", F.concat(name, fixed(b"\0")))
    whole = named.withColumn("payload", F.concat(head, "__name", number(lookup(types, F.col("qtype"), F.lit(None)), 2), fixed(b"\0\1"), record, edns))
    cut = F.when(F.col("malformed"), F.substring("payload", F.lit(1), F.octet_length("__name") + 6)).otherwise(F.col("payload"))
    return whole.select("msg_id", cut.alias("payload"), *keep)
