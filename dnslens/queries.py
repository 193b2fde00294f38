"""The registered queries on the DNS log, each with its DuckDB text where SQL can express it."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens import fixtures as X
from dnslens import schema as S
from dnslens.functions import formats, payloads
from dnslens.functions.ip import networks
from dnslens.operators import filters, lookup, metrics, normalize, pairing, predicates, privacy, rollups, score, state
from dnslens.plans import capture_sinks, pipeline, shared, sinks
from dnslens.sources import capture, decode, records
from dnslens.streaming import branches, spans, stateful, tracking

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_v4 = lambda c: " + ".join(f"CAST(split_part({c}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))
_net = lambda c: (int(ipaddress.ip_network(c, strict=False).network_address), int(ipaddress.ip_network(c, strict=False).broadcast_address), ipaddress.ip_network(c, strict=False).prefixlen)
_RFC = "strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts_ns % 1000000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(ts_ns % 1000000000 AS VARCHAR), 9, '0'), '0') END || 'Z'"
_QNAME = "CASE WHEN contains(qname, ' ') THEN '\"' || qname || '\"' ELSE qname END"
_LINE = f"concat_ws(' ', {_RFC}, identity, operation, rcode, query_ip, query_port, family, protocol, CAST(length AS VARCHAR) || 'b', {_QNAME}, qtype, '0.000000000')"
#: Columns of the decoded record (`rich`) by key; other keys of the flat view stay as they are while unset.
_HELD = {
    "dns.flags.ad": "flag_ad", "dns.flags.cd": "flag_cd", "dns.flags.ra": "flag_ra", "dns.flags.tc": "flag_tc",
    "dns.ancount": "CAST(len(answers) AS BIGINT)", "dns.arcount": "CAST(len(ar) AS BIGINT)", "dns.nscount": "CAST(len(ns) AS BIGINT)",
    "dns.opcode": "opcode", "dns.qclass": "qclass", "dns.qdcount": "qdcount",
    "edns.dnssec-ok": "edns_do", "edns.rcode": "edns_rcode", "edns.udp-size": "edns_udp_size", "edns.version": "edns_version",
    "dns.flags.qr": "dns_type = 'REPLY'", "dnstap.timestamp-rfc3339ns": _RFC,
}
_LATENCY = "CASE WHEN latency = 0 THEN '0' ELSE rtrim(rtrim(printf('%.9f', latency), '0'), '.') END"
_LISTS = {"dns.resource-records.an": "answers", "dns.resource-records.ar": "ar", "dns.resource-records.ns": "ns", "edns.options": "options"}
_UNSET = {k: "false" if v is False else f"'{v}'" for k, v in S.FLAT_UNSET.items() if k not in _LISTS and k not in _HELD and k != "dnstap.latency"}
_flat = _UNSET | _HELD | S.FLAT_KEYS


def _list_json(key: str, column: str) -> str:
    """The members of a list in flat JSON (it has fewer than ten)."""
    fields = " || ',' || ".join(f"""'"{key}.' || i || '.{f}":' || to_json({column}[i + 1]."{f}")""" for f in S.list_fields(key))
    return f"""CASE WHEN len({column}) = 0 THEN '"{key}":"-"' ELSE array_to_string(list_transform(range(len({column})), lambda i: {fields}), ',') END"""


def _flat_json(**counts: str) -> str:
    """The SQL of a row's flat JSON. counts: columns of header counts, where they aren't those of the lists."""
    members = {k: f"""'"{k}":' || to_json({v})""" for k, v in (_flat | {f"dns.{k}": v for k, v in counts.items()}).items()} | {k: _list_json(k, c) for k, c in _LISTS.items()}
    members["dnstap.latency"] = f"""'"dnstap.latency":' || {_LATENCY}"""
    return "'{' || concat_ws(',', " + ",\n".join(members[k] for k in sorted(members)) + ") || '}'"


_FLAT_JSON = _flat_json()


def _reduced(name: str, log: str, interval_ns: int = 2_000_000_000) -> str:
    """Repeats of a log folded into intervals that begin at the first row outside the one before, by recursion over each key's times."""
    keys = "identity, operation, query_ip, response_ip, qname, qtype"
    return f"""{name}_rows AS MATERIALIZED (SELECT *, concat_ws('|', {keys}) AS k FROM {log}),
{name}_times AS MATERIALIZED (SELECT DISTINCT k, ts_ns FROM {name}_rows),
{name}_next AS MATERIALIZED (
  SELECT a.k, a.ts_ns, b.ts_ns AS nxt
  FROM (SELECT k, ts_ns, ts_ns + {interval_ns} AS until FROM {name}_times) a
  ASOF JOIN {name}_times b ON a.k = b.k AND a.until <= b.ts_ns),
{name}_begin AS (
  SELECT k, min(ts_ns) AS ts_ns FROM {name}_times GROUP BY k
  UNION ALL SELECT n.k, n.nxt FROM {name}_begin b JOIN {name}_next n ON n.k = b.k AND n.ts_ns = b.ts_ns),
{name} AS (
  SELECT {keys}, min(struct_pack(ts_ns := r.ts_ns, msg_id := msg_id)) AS f, count(*) AS occurrences,
    CAST(sum(length) AS BIGINT) AS cumulative_length
  FROM {name}_rows r ASOF JOIN {name}_begin b ON r.k = b.k AND r.ts_ns >= b.ts_ns GROUP BY {keys}, b.ts_ns)"""


_BY = {
    "lat": "lat AS (SELECT * EXCLUDE (ok), CASE WHEN ok AND dns_type = 'REPLY' AND lag(dns_type) OVER w = 'QUERY' AND ts_ns - lag(ts_ns) OVER w < 2000000000 THEN (ts_ns - lag(ts_ns) OVER w) / 1e9 ELSE 0.0 END AS latency FROM (SELECT *, NOT malformed AND query_port <> '-' AS ok FROM dns_log) WINDOW w AS (PARTITION BY query_ip, query_port, dns_id, ok ORDER BY ts_ns, msg_id))",
    "full": "full_log AS (SELECT * FROM dns_log UNION ALL SELECT * REPLACE ('TIMEOUT' AS rcode) FROM dns_log q WHERE dns_type = 'QUERY' AND NOT malformed AND query_port <> '-' AND NOT EXISTS (SELECT 1 FROM dns_log r WHERE r.dns_type = 'REPLY' AND NOT r.malformed AND r.query_ip = q.query_ip AND r.query_port = q.query_port AND r.dns_id = q.dns_id AND r.ts_ns >= q.ts_ns AND r.ts_ns < q.ts_ns + 2000000000))",
    "psl": "psl AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {str(i).lower()})" for r, k, i in X.PSL if k == "normal") + ") t(rule, icann))",
    "clean": "clean AS (SELECT k, arg_max(rule, length(rule)) AS suffix, arg_max(icann, length(rule)) AS icann FROM (SELECT DISTINCT regexp_replace(lower(qname), '\\.$', '') AS k FROM dns_log) JOIN psl ON k = rule OR ends_with(k, '.' || rule) GROUP BY k)",
    "tld": "tld AS (SELECT l.*, CASE WHEN icann THEN suffix ELSE '-' END AS tld, coalesce(icann, false) AS managed_icann, coalesce(nullif(regexp_extract(lower(qname), '[^.]+\\.' || replace(suffix, '.', '\\.') || '$'), ''), '-') AS etld_plus_one FROM dns_log l LEFT JOIN clean ON k = regexp_replace(lower(qname), '\\.$', ''))",
    "susp": "susp AS (SELECT *, malformed AS suspicious_malformed, strlen(qname) > 100 AS suspicious_long_domain, length > 1000 AS suspicious_large_packet, latency > 1.0 AS suspicious_slow, qtype NOT IN (" + ", ".join(f"'{t}'" for t in score.COMMON_QTYPES) + ") AS suspicious_uncommon_qtype, length(qname) - length(replace(qname, '.', '')) > 10 AS suspicious_labels, contains(qname, '\"') OR contains(qname, '==') OR contains(qname, '/') OR contains(qname, ':') AS suspicious_chars FROM lat)",
    "scored": "scored AS (SELECT *, CAST(" + " + ".join(f"CAST(suspicious_{k} AS INT)" for k in score.FLAGS) + " AS DOUBLE) AS suspicious_score FROM susp)",
    "answers": f"answers AS ({X.ANSWERS_SQL})",
    "geo": "geo AS (SELECT * FROM (VALUES " + ", ".join(f"({_net(c)[0]}, {_net(c)[1]}, {_net(c)[2]}, '{a}', '{b}', '{d}', '{e}', '{f}', '{c}')" for c, a, b, d, e, f in X.GEO) + ") t(lo, hi, bits, country, continent, city, asn, as_owner, cidr))",
    "lines": f"lines AS (SELECT msg_id, ts_ns, identity, query_ip, qname, rcode, {_LINE} AS line FROM dns_log)",
    "reduced": _reduced("reduced", "dns_log"),
    "rich": f"rich AS ({X.RECORDS_SQL})",
    "packets": f"packets AS ({X.PACKETS_SQL})",
    "repeated": f"repeated AS ({X.REPEATED_SQL})",
    "reduced_repeats": _reduced("reduced_repeats", "repeated"),
    "domains": "domains AS (SELECT * REPLACE (CASE WHEN etld_plus_one = '-' THEN qname ELSE etld_plus_one END AS qname) FROM tld)",
    "reduced_domains": _reduced("reduced_domains", "domains"),
}
_NEEDS = {"reduced_repeats": ["repeated"], "reduced_domains": ["domains"], "domains": ["tld"], "clean": ["psl"], "tld": ["clean"], "susp": ["lat"], "scored": ["susp"]}


def _sql(text: str, *ctes: str) -> str:
    names: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in names:
            names.append(name)

    for c in ctes:
        add(c)
    return f"WITH RECURSIVE dns_log AS MATERIALIZED ({X.LOG_SQL}){''.join(', ' + _BY[n] for n in names)} {text}"


def _add(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None, *ctes: str) -> None:
    """Registers make(dns_log) under a name."""
    QUERIES[name] = lambda spark, sf_dir: make(X.dns_log(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = _sql(sql, *ctes)


def _psl(df: DataFrame) -> DataFrame:
    return X.psl(df.sparkSession)


_ALL = "msg_id, ts_ns, identity, operation, dns_type, rcode, query_ip, query_port, response_ip, response_port, family, protocol, dns_id, qname, qtype, length, flag_aa, flag_rd, malformed"
_ids = lambda where: f"SELECT {_ALL} FROM dns_log WHERE {where}"

# sources and record builders
_add("tail_parse", lambda d: records.tail_parse(formats.to_text(d).select(F.col("line").alias("value"))), "SELECT identity, operation, dns_type, rcode, query_ip, query_port, '-' AS response_ip, '0' AS response_port, family, protocol, qname, qtype, length, ts_ns FROM dns_log WHERE NOT contains(qname, ' ')")


def _dnstap_struct(d: DataFrame) -> DataFrame:
    query = F.col("dns_type") == "QUERY"
    ns = F.col("ts_ns")
    when = lambda c, v: F.when(c, v).otherwise(F.lit(0))
    sec, rest = F.expr("ts_ns div 1000000000"), ns % 1_000_000_000
    policy = F.struct(*(F.lit("").alias(f) for f in ("rule", "type", "match", "value")), F.when(F.col("malformed"), "DROP").otherwise("").alias("action"))
    return d.select("msg_id", F.when(query, 5).otherwise(6).alias("type"), "identity", F.lit("").alias("version"), "operation", F.when(F.col("qtype") == "ANY", "OTHER").otherwise("INET").alias("socket_family"), F.col("protocol").alias("socket_protocol"), F.col("query_ip").alias("query_address"), "query_port", F.col("response_ip").alias("response_address"), "response_port", F.lit("").alias("peer_name"), F.lit(None).cast("string").alias("query_zone"), when(query, sec).alias("query_time_sec"), when(query, rest).alias("query_time_nsec"), when(~query, sec).alias("response_time_sec"), when(~query, rest).alias("response_time_nsec"), policy.alias("policy"), F.lit("").alias("extra"), F.struct(F.array(F.col("qtype")).alias("tags"), F.lit("com").alias("tld"), F.lit("").alias("etld_plus_one"), F.lit(10).cast("long").alias("sample_rate"), F.col("identity").alias("original_extra")).alias("extended"))


_DNSTAP = f"msg_id, identity, '-' AS version, operation, dns_type, CASE WHEN qtype = 'ANY' THEN 'UNKNOWN' ELSE 'IPv4' END AS family, protocol, query_ip, query_port, response_ip, response_port, '-' AS peer_name, '-' AS query_zone, ts_ns, {_RFC} AS timestamp, '-' AS policy_rule, '-' AS policy_type, '-' AS policy_match, CASE WHEN malformed THEN 'DROP' ELSE '-' END AS policy_action, '-' AS policy_value"
_add("dnstap_rows", lambda d: records.dnstap_rows(_dnstap_struct(d)), f"SELECT {_DNSTAP}, '-' AS extra FROM dns_log")
_add("dnstap_extended", lambda d: records.dnstap_rows(_dnstap_struct(d), extended=True).withColumn("tags", F.array_join("tags", ",")), f"SELECT {_DNSTAP}, qtype AS tags, 'com' AS tld, '-' AS etld_plus_one, CAST(10 AS BIGINT) AS sample_rate, identity AS extra FROM dns_log")


def _powerdns_struct(d: DataFrame) -> DataFrame:
    reply = F.col("dns_type") == "REPLY"
    types, codes = {v: k for k, v in S.RDATATYPES.items()}, {v: k for k, v in S.RCODES.items()}
    k = F.regexp_extract("qname", r"(\d+)\.", 1).cast("int")
    rr = F.struct(F.concat("qname", F.lit(".")).alias("name"), F.lit(1).alias("type"), F.lit(1).alias("class"), F.lit(60).cast("long").alias("ttl"), F.unhex(F.concat(F.lit("CB0071"), F.lpad(F.hex(k), 2, "0"))).alias("rdata"))
    meta = F.array(F.struct(F.lit("pool").alias("key"), F.array(F.col("identity"), F.col("protocol")).alias("values")))
    return d.select("msg_id", F.col("identity").alias("server"), F.when(reply, "DNSResponseType").otherwise("DNSQueryType").alias("type"), F.concat("qname", F.lit(".")).alias("question_name"), S.lookup(types, F.col("qtype"), F.lit(0)).alias("question_type"), S.lookup(codes, F.col("rcode"), F.lit(0)).alias("rcode_number"), F.expr("ts_ns div 1000000000").alias("time_sec"), F.expr("(ts_ns % 1000000000) div 1000").alias("time_usec"), F.expr("ts_ns div 1000000000").alias("query_time_sec"), F.lit(0).cast("long").alias("query_time_usec"), F.array("qtype").alias("tags"), meta.alias("meta"), F.lit("").alias("applied_policy"), F.col("identity").cast("binary").alias("message_id"), F.array(rr).alias("rrs"))


_add(
    "powerdns_rows",
    lambda d: records.powerdns_rows(_powerdns_struct(d)).select("msg_id", "identity", "operation", "dns_type", "qname", "qtype", "rcode", "ts_ns", F.round("latency", 9).alias("latency"), F.element_at("powerdns_metadata", "pool").alias("pool"), "policy", "message_id", F.get("answers", 0)["name"].alias("rr_name"), F.get("answers", 0)["rdata"].alias("rr_rdata")),
    "SELECT msg_id, identity, operation, dns_type, qname, qtype, rcode, ts_ns, CASE WHEN dns_type = 'REPLY' THEN round((ts_ns % 1000000000) / 1e9, 9) ELSE 0.0 END AS latency, identity || ' ' || protocol AS pool, '-' AS policy, lower(hex(identity)) AS message_id, qname AS rr_name, '203.0.113.' || regexp_extract(qname, '(\\d+)\\.', 1) AS rr_rdata FROM dns_log",
)
_ends = lambda d: X.payloads(d).join(d.select("msg_id", "dns_type", "query_ip", "query_port", "response_ip", "response_port"), "msg_id").select("msg_id", "payload", *(F.when(F.col("dns_type") == "QUERY", F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("src_ip", "query_ip", "response_ip"), ("src_port", "query_port", "response_port"), ("dst_ip", "response_ip", "query_ip"), ("dst_port", "response_port", "query_port"))))
_add("packet_rows", lambda d: records.packet_rows(_ends(d)).drop("length"), "SELECT msg_id, dns_type, operation, query_ip, query_port, response_ip, response_port FROM dns_log")
_add("decode_header", lambda d: decode.decode_header(X.payloads(d)).select("msg_id", "dns_id", "qr", "opcode", "aa", "rd", "rcode", "malformed"), "SELECT msg_id, dns_id, dns_type = 'REPLY' AS qr, CAST(0 AS BIGINT) AS opcode, flag_aa AS aa, flag_rd AS rd, CASE WHEN rcode = '-' THEN 'NOERROR' ELSE rcode END AS rcode, false AS malformed FROM dns_log")
_add("decode_question", lambda d: decode.decode_payload(X.payloads(d)).select("msg_id", "dns_id", "qr", "qname", "qtype", "qclass", "malformed"), "SELECT msg_id, dns_id, dns_type = 'REPLY' AS qr, CASE WHEN malformed THEN '-' ELSE qname END AS qname, CASE WHEN malformed THEN '-' ELSE qtype END AS qtype, CASE WHEN malformed THEN '-' ELSE 'IN' END AS qclass, malformed FROM dns_log")
_RECORDS = "SELECT a.msg_id, 'an' AS section, CAST(0 AS BIGINT) AS idx, name, a.rdatatype, a.class, a.ttl, a.rdata FROM answers a JOIN dns_log l ON a.msg_id = l.msg_id WHERE NOT l.malformed"
_add("decode_answers", lambda d: normalize.explode_records(decode.decode_payload(X.payloads(d)), {"an": "an", "ns": "ns", "ar": "ar"}), _RECORDS, "answers")
_add("decode_rdata", lambda d: normalize.explode_records(decode.decode_payload(X.payloads(d)), {"an": "an"}).select("msg_id", "rdatatype", "rdata"), f"SELECT msg_id, rdatatype, rdata FROM ({_RECORDS})", "answers")
_add("decode_edns", lambda d: decode.decode_payload(X.payloads(d)).select("msg_id", "edns_udp_size", "edns_version", "edns_do", F.coalesce(F.get("options", 0)["name"], F.lit("-")).alias("option"), F.coalesce(F.get("options", 0)["data"], F.lit("-")).alias("data")), "SELECT msg_id, CASE WHEN e THEN 1232 ELSE 0 END AS edns_udp_size, 0 AS edns_version, CASE WHEN e THEN 1 ELSE 0 END AS edns_do, CASE WHEN e THEN 'CSUBNET' ELSE '-' END AS option, CASE WHEN e THEN '1.58.30.0/24' ELSE '-' END AS data FROM (SELECT *, dns_type = 'QUERY' AND NOT malformed AS e FROM dns_log)".replace("1232 ELSE 0 END", "CAST(1232 AS BIGINT) ELSE 0 END").replace("0 AS edns_version", "CAST(0 AS BIGINT) AS edns_version").replace("THEN 1 ELSE 0 END AS edns_do", "THEN CAST(1 AS BIGINT) ELSE 0 END AS edns_do"))
_add("update_operation", lambda d: normalize.fix_operation(d.withColumn("opcode", F.when(F.col("qtype") == "ANY", 5).otherwise(0))).select("msg_id", "operation", "rcode"), "SELECT msg_id, CASE WHEN qtype = 'ANY' THEN CASE WHEN dns_type = 'REPLY' THEN 'UPDATE_RESPONSE' ELSE 'UPDATE_QUERY' END ELSE operation END AS operation, CASE WHEN dns_type = 'REPLY' THEN rcode ELSE '-' END AS rcode FROM dns_log")
_add("explode_records", lambda d: normalize.explode_records(X.with_answers(d)), "SELECT msg_id, 'an' AS section, CAST(0 AS BIGINT) AS idx, name, rdatatype, class, ttl, rdata FROM answers", "answers")


#: Rows of the log in one capture file, about.
_FILE_ROWS = 5000


def _files(d: DataFrame) -> int:
    return max(2, d.count() // (3 * _FILE_ROWS))


def _capture(d: DataFrame) -> DataFrame:
    """The log's messages by way of pcap files: one for each stream and hash of the flow, read in parts of 64 kB."""
    folder = pipeline.scratch(d.sparkSession, "pcap")
    rows = _ends(d).join(d.select("msg_id", "identity", "ts_ns", "protocol"), "msg_id")
    flow = [F.concat_ws(":", f"{end}_ip", f"{end}_port") for end in ("src", "dst")]
    capture_sinks.write_pcap(rows.withColumn("file", capture_sinks.by_flow("identity", flow, _files(d))), folder).collect()  # a row a file
    found = capture.capture_files(d.sparkSession, folder, split_bytes=1 << 16)
    return decode.decode_payload(found.withColumn("msg_id", F.col("ts_ns")).select("msg_id", "payload"))


_add(
    "capture_files",
    lambda d: _capture(d).groupBy("qr", "qname", "qtype", "malformed").agg(F.count("*").alias("n")),
    """SELECT dns_type = 'REPLY' AS qr, CASE WHEN malformed THEN '-' ELSE qname END AS qname, CASE WHEN malformed THEN '-' ELSE qtype END AS qtype, malformed,
  count(*) AS n FROM dns_log GROUP BY ALL""",
)


def _frames(d: DataFrame) -> DataFrame:
    """The log's messages by way of frame-stream files, read in parts of 64 kB."""
    folder = pipeline.scratch(d.sparkSession, "fstrm")
    rows = X.payloads(d, keep=("identity", "ts_ns", "dns_type", "query_ip", "query_port"))
    capture_sinks.write_fstrm(rows.withColumn("file", capture_sinks.by_flow("identity", ["query_ip", "query_port"], _files(d))), folder).collect()  # a row a file
    return capture.fstrm_files(d.sparkSession, folder, split_bytes=1 << 16)


_add(
    "fstrm_files",
    lambda d: _frames(d).select(
        "identity", F.col("query_address").alias("query_ip"), F.col("query_port").cast("string").alias("query_port"),
        F.expr("CASE WHEN type = 5 THEN query_time_sec * 1000000000 + query_time_nsec ELSE response_time_sec * 1000000000 + response_time_nsec END").alias("ts_ns"),
        F.conv(F.hex(F.substring("payload", 1, 2)), 16, 10).cast("long").alias("dns_id"),
    ),
    "SELECT identity, query_ip, query_port, ts_ns, dns_id FROM dns_log",
)

# filters and predicates
_PATTERNS = [r"(mail|www)\d+\.", r"example\.com$"]
_PATTERN_SQL = r"regexp_matches(qname, '(?:(mail|www)\d+\.)|(?:example\.com$)')"
_NAMES = ["WwW7.example.com", "click5.example.com", "view10.shop.example.org", "purchase12.example.com"]
_NAMES_SQL = "(" + ", ".join(f"'{n.lower()}'" for n in _NAMES) + ")"
_IN = " OR ".join(f"({_v4('query_ip')}) BETWEEN {_net(c)[0]} AND {_net(c)[1]}" for c in X.NETWORKS)
_add("drop_queries", filters.drop_queries, _ids("dns_type <> 'QUERY'"))
_add("drop_replies", filters.drop_replies, _ids("dns_type <> 'REPLY'"))
_add("drop_rcodes", lambda d: filters.drop_rcodes(d, ["NXDOMAIN", "SERVFAIL"]), _ids("rcode NOT IN ('NXDOMAIN', 'SERVFAIL')"))
_add("keep_query_ip", lambda d: filters.keep_query_ip(d, X.NETWORKS), _ids(_IN))
_add("drop_query_ip", lambda d: filters.drop_query_ip(d, X.NETWORKS), _ids(f"NOT ({_IN})"))
_add("keep_rdata_ip", lambda d: filters.keep_rdata_ip(X.with_answers(d), ["203.0.113.0/27", "192.0.2.1"]).select("msg_id", "qname"), "SELECT msg_id, name AS qname FROM answers WHERE CAST(split_part(rdata, '.', 4) AS INT) < 32", "answers")
_add("drop_fqdn", lambda d: filters.drop_fqdn(d, _NAMES), _ids(f"qname NOT IN {_NAMES_SQL}"))
_add("keep_fqdn", lambda d: filters.keep_fqdn(d, _NAMES), _ids(f"qname IN {_NAMES_SQL}"))
_add("drop_domain_regex", lambda d: filters.drop_domain_regex(d, _PATTERNS), _ids(f"NOT {_PATTERN_SQL}"))
_add("keep_domain_regex", lambda d: filters.keep_domain_regex(d, _PATTERNS), _ids(_PATTERN_SQL))
_add("downsample", lambda d: filters.downsample(d, 10).select("msg_id", "sample_rate"), "SELECT msg_id, CAST(10 AS BIGINT) AS sample_rate FROM (SELECT msg_id, row_number() OVER (PARTITION BY identity, ts_ns // 3600000000000 ORDER BY ts_ns, msg_id) AS r FROM dns_log) WHERE r % 10 <> 0")


def _match(name: str, sql: str, include: dict | None = None, exclude: dict | None = None, *ctes: str, log: str = "dns_log") -> None:
    def make(d: DataFrame) -> DataFrame:
        rows = S.nest(X.with_answers(pairing.measure_latency(d) if "lat" in ctes else d))
        return predicates.match(rows, include, exclude).select("msg_id", F.col("dns.qname").alias("qname"))

    _add(name, make, f"SELECT msg_id, qname FROM {log} WHERE {sql}", *ctes)


_match("match_int", "dns_id = 77", {"dns.id": 77})
_match("match_bool", "flag_aa", {"dns.flags.aa": True})
_match("match_regex", r"regexp_matches(qname, '^.*\.org$')", {"dns.qname": r"^.*\.org$"})
_match("match_any_of", "qtype IN ('TXT', 'MX')", {"dns.qtype": ["^TXT$", "^MX$"]})
_match("match_gt", "latency > 0.2", {"dnstap.latency": {"greater-than": 0.2}}, None, "lat", log="lat")
_match("match_lt", "length < 100", {"dns.length": {"lower-than": 100}})
_match("match_source_list", _PATTERN_SQL, {"dns.qname": {"match-source": _PATTERNS, "source-kind": "regexp_list"}})
_match("match_path", "msg_id IN (SELECT msg_id FROM answers WHERE ttl > 100 AND rdatatype = 'A')", {"dns.resource-records.an.*.ttl": {"greater-than": 100}, "dns.resource-records.an.0.rdatatype": "^A$"}, None, "answers")
_match("match_include_exclude", "operation = 'CLIENT_RESPONSE' AND NOT rcode IN ('NOERROR', 'NXDOMAIN')", {"dnstap.operation": "^CLIENT_RESPONSE$"}, {"dns.rcode": ["^NOERROR$", "^NXDOMAIN$"]})

# projections and enrichment
_add("qname_lowercase", normalize.qname_lowercase, f"SELECT * REPLACE (lower(qname) AS qname) FROM (SELECT {_ALL} FROM dns_log)")
_add("rr_lowercase", lambda d: normalize.explode_records(normalize.rr_lowercase(X.with_answers(d))), "SELECT msg_id, 'an' AS section, CAST(0 AS BIGINT) AS idx, lower(name) AS name, rdatatype, class, ttl, rdata FROM answers", "answers")
_add("replace_nonprintable", lambda d: normalize.replace_nonprintable(d).select("msg_id", "qname"), "SELECT msg_id, replace(qname, ' ', '\\032') AS qname FROM dns_log")
_add("quiet_text", lambda d: normalize.quiet_text(d).select("msg_id", "operation", "dns_type", "family", "rcode"), "SELECT msg_id, CASE operation WHEN 'CLIENT_QUERY' THEN 'CQ' ELSE 'CR' END AS operation, left(dns_type, 1) AS dns_type, '4' AS family, CASE rcode WHEN 'NOERROR' THEN '0' WHEN 'SERVFAIL' THEN '2' WHEN 'NXDOMAIN' THEN '3' ELSE rcode END AS rcode FROM dns_log")
_add("add_tld", lambda d: lookup.add_tld(d, _psl(d)).select("msg_id", "qname", "tld", "managed_icann"), "SELECT msg_id, qname, tld, managed_icann FROM tld", "tld")
_add("add_tld_plus_one", lambda d: lookup.add_tld_plus_one(d, _psl(d)).select("msg_id", "qname", "etld_plus_one"), "SELECT msg_id, qname, etld_plus_one FROM tld", "tld")
_add("anonymize_ip", lambda d: privacy.anonymize_ip(d).select("msg_id", "query_ip"), "SELECT msg_id, split_part(query_ip, '.', 1) || '.' || split_part(query_ip, '.', 2) || '.0.0' AS query_ip FROM dns_log")
_add("hash_query_ip", lambda d: privacy.hash_ip(d).select("msg_id", "query_ip"), "SELECT msg_id, sha1(query_ip) AS query_ip FROM dns_log")
_add("hash_reply_ip", lambda d: privacy.hash_ip(d, "response_ip", "sha256").select("msg_id", "response_ip"), "SELECT msg_id, sha256(response_ip) AS response_ip FROM dns_log")
_add("minimize_qname", lambda d: privacy.minimize_qname(d, _psl(d)).select("msg_id", "qname"), r"SELECT msg_id, coalesce(nullif(regexp_extract(qname, '[^.]+\.' || replace(suffix, '.', '\.') || '$'), ''), qname) AS qname FROM dns_log LEFT JOIN clean ON k = lower(qname)", "clean")
_add("add_tags", lambda d: normalize.add_tags(d, ["edge", "v4"]).select("msg_id", F.array_join("tags", ",").alias("tags")), "SELECT msg_id, 'edge,v4' AS tags FROM dns_log")
_add("extract_payload", lambda d: normalize.extract_payload(d.select("msg_id", F.col("qname").cast("binary").alias("payload"))).select("msg_id", "dns_payload"), "SELECT msg_id, base64(encode(qname)) AS dns_payload FROM dns_log")
_add("rewrite", lambda d: normalize.rewrite(d, {"identity": "site-a", "length": 0}), f"SELECT * REPLACE ('site-a' AS identity, CAST(0 AS BIGINT) AS length) FROM (SELECT {_ALL} FROM dns_log)")
_GEO = "SELECT msg_id, coalesce(arg_max(country, bits), '-') AS geo_country, coalesce(arg_max(continent, bits), '-') AS geo_continent, coalesce(arg_max(city, bits), '-') AS geo_city, coalesce(arg_max(asn, bits), '-') AS geo_asn, coalesce(arg_max(as_owner, bits), '-') AS geo_owner FROM dns_log LEFT JOIN geo ON {ip} BETWEEN lo AND hi GROUP BY msg_id"
_geo_cols = ("msg_id", "geo_country", "geo_continent", "geo_city", "geo_asn", "geo_owner")
_add("geoip", lambda d: lookup.geoip(d, X.geo_ranges(d.sparkSession)).select(*_geo_cols), _GEO.format(ip=f"({_v4('query_ip')})"), "geo")
# networks of every kind of length inside one /16, nested and apart, and addresses spread over them
_V6_NETS = [f"2001:db8:{g:x}::/{n}" for n in (34, 37, 41, 44, 48) for g in (0x8000, 0xA000, 0xA800, 0xA880, 0xA881)] + ["2000::/12", "2001:db8::/32", "2001:db8:a881:7::/64", "2001:db8:a881:7::40/122", "2001:db8:a881:7::41/128", "2001:db8:a881:7::42/127", "192.0.2.0/24", "no network"]
_V6_GROUP = "CASE dns_id % 6 WHEN 0 THEN 32768 + dns_id % 64 WHEN 1 THEN 40960 + dns_id % 2048 WHEN 2 THEN 43008 + dns_id % 256 WHEN 3 THEN 43136 WHEN 4 THEN 43137 ELSE dns_id % 65536 END"
_v6 = lambda d: d.withColumns({"g": F.expr(f"CAST({_V6_GROUP} AS BIGINT)"), "h": F.expr("CAST(CASE WHEN dns_id % 2 = 0 THEN 7 ELSE dns_id % 9 END AS BIGINT)")}).withColumn("query_ip", F.format_string("2001:db8:%x:%x::%x", "g", "h", F.col("dns_id") % 100)).drop("g", "h")
_V6_NUMBER = f"(CAST(536939960 AS HUGEINT) * 79228162514264337593543950336 + CAST({_V6_GROUP} AS HUGEINT) * 1208925819614629174706176 + CAST(CASE WHEN dns_id % 2 = 0 THEN 7 ELSE dns_id % 9 END AS HUGEINT) * 18446744073709551616 + dns_id % 100)"
_V6_VALUES = ", ".join(f"('{n}', CAST('{int(net.network_address)}' AS HUGEINT), CAST('{int(net.broadcast_address)}' AS HUGEINT), {net.prefixlen})" for n in _V6_NETS if ":" in n for net in [ipaddress.ip_network(n, strict=False)])
_add(
    "ip_range_lookup_v6",
    lambda d: lookup.ip_range_lookup(_v6(d), "query_ip", networks(d.sparkSession, _V6_NETS)).select("msg_id", "cidr"),
    f"""SELECT msg_id, arg_max(cidr, bits * 1000 + place) AS cidr FROM (SELECT msg_id, {_V6_NUMBER} AS n FROM dns_log)
LEFT JOIN (SELECT *, row_number() OVER (ORDER BY cidr) AS place FROM (VALUES {_V6_VALUES}) t(cidr, lo, hi, bits)) ON n BETWEEN lo AND hi GROUP BY msg_id""",
)
_ecs = lambda d: d.withColumn("options", F.when(F.col("dns_type") == "QUERY", F.array(F.struct(F.lit(10).alias("code"), F.lit("-").alias("data")), F.struct(F.lit(8).alias("code"), F.lit("198.51.100.0/24").alias("data")))))
_add("geoip_ecs", lambda d: lookup.geoip(_ecs(d), X.geo_ranges(d.sparkSession), lookup_ecs=True).select(*_geo_cols), _GEO.format(ip=f"(CASE WHEN dns_type = 'QUERY' THEN 3325256704 ELSE {_v4('query_ip')} END)"), "geo")
for _f in score.FLAGS:
    _add(f"suspicious_{_f}", lambda d, f=_f: score.suspicious(pairing.measure_latency(d)).select("msg_id", f"suspicious_{f}"), f"SELECT msg_id, suspicious_{_f} FROM susp", "susp")
_add("suspicious_score", lambda d: score.suspicious(pairing.measure_latency(d)).select("msg_id", "suspicious_score"), "SELECT msg_id, suspicious_score FROM scored", "scored")
_n = "strlen(qname)"
_cnt = lambda p: f"CAST(length(regexp_replace(qname, '[^{p}]', '', 'g')) AS BIGINT)"
_spec = r".\-_="
_rest = f"({_n} - {_cnt('0-9')} - {_cnt('a-z')} - {_cnt('A-Z')} - {_cnt(_spec)})"
_pair = lambda test: f"CAST(len(list_filter(range(1, length(qname)), lambda i: {test})) AS BIGINT)"
_a, _b = "substr(lower(qname), i, 1)", "substr(lower(qname), i + 1, 1)"
_ml = lambda name, cols, sql: _add(name, lambda d: score.ml_features(d).withColumn("ml_entropy", F.round("ml_entropy", 9)).select("msg_id", *cols), f"SELECT msg_id, {sql} FROM dns_log")
_ml("ml_entropy", ["ml_entropy"], f"round(list_sum(list_transform(list_distinct(string_split(qname, '')), lambda c: -(len(list_filter(string_split(qname, ''), lambda x: x = c)) / {_n}) * log2(len(list_filter(string_split(qname, ''), lambda x: x = c)) / {_n}))), 9) AS ml_entropy")
_ml("ml_char_counts", ["ml_length", "ml_digits", "ml_lowers", "ml_uppers", "ml_specials", "ml_others", "ml_labels"], f"CAST({_n} AS BIGINT) AS ml_length, {_cnt('0-9')} AS ml_digits, {_cnt('a-z')} AS ml_lowers, {_cnt('A-Z')} AS ml_uppers, {_cnt(_spec)} AS ml_specials, CAST({_rest} AS BIGINT) AS ml_others, CAST(len(string_split(qname, '.')) AS BIGINT) AS ml_labels")
_ml("ml_ratios", ["ml_ratio_digits", "ml_ratio_letters", "ml_ratio_specials", "ml_ratio_others"], f"{_cnt('0-9')} / {_n} AS ml_ratio_digits, ({_cnt('a-z')} + {_cnt('A-Z')}) / {_n} AS ml_ratio_letters, {_cnt(_spec)} / {_n} AS ml_ratio_specials, {_rest} / {_n} AS ml_ratio_others")
_vowels, _cons = "('a', 'e', 'i', 'o', 'u', 'y')", "'^[b-df-hj-np-tv-xz]{2}$'"
_ml("ml_consecutive", ["ml_consecutive_chars", "ml_consecutive_vowels", "ml_consecutive_digits", "ml_consecutive_consonants"], f"{_pair(f'{_a} = {_b}')} AS ml_consecutive_chars, {_pair(f'{_a} = {_b} AND {_a} IN {_vowels}')} AS ml_consecutive_vowels, {_pair(f'regexp_matches({_a} || {_b}, {chr(39)}^[0-9]{{2}}${chr(39)})')} AS ml_consecutive_digits, {_pair(f'regexp_matches({_a} || {_b}, {_cons})')} AS ml_consecutive_consonants")
_add("ml_traffic", lambda d: score.ml_features(state.reduce_traffic(d)).select("msg_id", "ml_size", "ml_occurrences", "ml_uncommon_qtype"), "SELECT f.msg_id AS msg_id, cumulative_length AS ml_size, occurrences AS ml_occurrences, CASE WHEN qtype IN ('A', 'AAAA', 'HTTPS', 'SRV', 'PTR', 'SOA', 'NS') THEN CAST(0 AS BIGINT) ELSE 1 END AS ml_uncommon_qtype FROM reduced", "reduced")
_pairs = "unnest([" + ", ".join(f"struct_pack(key := '{k}', value := CAST({v} AS VARCHAR))" for k, v in sorted((_flat | {"dnstap.latency": _LATENCY}).items())) + "], recursive := true)"


def _list_pairs(key: str, column: str) -> str:
    """msg_id, key, value of a list of `rich`."""
    fields = ", ".join(f"""struct_pack(key := '{key}.' || i || '.{f}', value := CAST({column}[i + 1]."{f}" AS VARCHAR))""" for f in S.list_fields(key))
    return f"""SELECT msg_id, unnest([{fields}], recursive := true) FROM (SELECT *, unnest(range(len({column}))) AS i FROM rich)
UNION ALL SELECT msg_id, '{key}', '-' FROM rich WHERE len({column}) = 0"""


_pairs_of = lambda flat: flat.select("msg_id", F.explode_outer("flat").alias("key", "value"))  # noqa: E731; explode would have the optimizer ask for the size of a second map
_FLAT_ALL = " UNION ALL ".join([f"SELECT msg_id, {_pairs} FROM rich", *(_list_pairs(k, c) for k, c in _LISTS.items())])
_add("flatten", lambda d: _pairs_of(normalize.flatten(X.with_records(d))), _FLAT_ALL, "rich")
_RENAMES = [(r"^dns\.q(name|type)$", "question"), (r"^dns\.rcode$", "code")]
_add(
    "relabel_rename",
    lambda d: _pairs_of(normalize.flatten(X.with_records(d), rename=_RENAMES)),
    f"""SELECT msg_id, CASE key WHEN 'dns.rcode' THEN 'code' ELSE key END AS key, value FROM ({_FLAT_ALL}) WHERE key NOT IN ('dns.qname', 'dns.qtype')
UNION ALL SELECT msg_id, 'question', '[' || qname || ',' || qtype || ']' FROM dns_log""",
    "rich",
)
_add("relabel_remove", lambda d: _pairs_of(normalize.flatten(X.with_records(d), remove=[r"^dns\.", "policy"])), f"SELECT msg_id, key, value FROM ({_FLAT_ALL}) WHERE NOT regexp_matches(key, '^dns\\.|policy')", "rich")
_GEO_KEYS = ", ".join(f"struct_pack(key := 'geoip.{k}', value := {c})" for k, c in S.SECTIONS["geoip"].items())
_add(
    "flatten_sections",
    lambda d: _pairs_of(normalize.flatten(lookup.geoip(d, X.geo_ranges(d.sparkSession)))).where("key LIKE 'geoip.%'"),
    f"SELECT msg_id, unnest([{_GEO_KEYS}], recursive := true) FROM (" + _GEO.format(ip=f"({_v4('query_ip')})") + ")",
    "geo",
)
_add(
    "match_sections",
    lambda d: predicates.match(S.nest(lookup.geoip(d, X.geo_ranges(d.sparkSession))), {"geoip.country-isocode": "^(DE|US)$"}).select("msg_id"),
    "SELECT msg_id FROM (" + _GEO.format(ip=f"({_v4('query_ip')})") + ") WHERE geo_country IN ('DE', 'US')",
    "geo",
)

# joins
_add("latency_pairs", lambda d: pairing.measure_latency(d).select("msg_id", F.round("latency", 9).alias("latency")), "SELECT msg_id, round(latency, 9) AS latency FROM lat", "lat")
_add("unanswered_queries", pairing.unanswered, f"SELECT {_ALL} FROM full_log", "full")
_add("ip_in_set", lambda d: lookup.ip_in_set(d, "query_ip", networks(d.sparkSession, X.NETWORKS)).select("msg_id", "query_ip"), f"SELECT msg_id, query_ip FROM dns_log WHERE {_IN}")
_octet = lambda i: F.split("query_ip", r"\.")[i]
_add(
    "ip_in_set_v6",
    lambda d: lookup.ip_in_set(
        d.select("msg_id", F.when(F.expr("msg_id % 3 = 0"), F.col("query_ip")).otherwise(F.concat(F.lit("2001:db8:"), _octet(2), F.lit("::"), _octet(3))).alias("query_ip")),
        "query_ip", networks(d.sparkSession, ["2001:db8:13::/48", "2001:db8:2::4/126", "192.0.2.0/24", "nonsense"]),
    ),
    """SELECT msg_id, CASE WHEN msg_id % 3 = 0 THEN query_ip ELSE '2001:db8:' || split_part(query_ip, '.', 3) || '::' || split_part(query_ip, '.', 4) END AS query_ip
       FROM dns_log WHERE CASE WHEN msg_id % 3 = 0 THEN query_ip LIKE '192.0.2.%'
         ELSE split_part(query_ip, '.', 3) = '13' OR (split_part(query_ip, '.', 3) = '2' AND split_part(query_ip, '.', 4) IN ('4', '5', '6', '7')) END""",
)
_add("ip_range_lookup", lambda d: lookup.ip_range_lookup(d, "query_ip", X.geo_ranges(d.sparkSession)).select("msg_id", "cidr"), f"SELECT msg_id, arg_max(cidr, bits) AS cidr FROM dns_log LEFT JOIN geo ON ({_v4('query_ip')}) BETWEEN lo AND hi GROUP BY msg_id", "geo")
_add("list_semi_join", lambda d: filters.keep_fqdn(d, d.sparkSession.createDataFrame([(n,) for n in _NAMES], "name string")).select("msg_id", "qname"), f"SELECT msg_id, qname FROM dns_log WHERE qname IN {_NAMES_SQL}")
_many = lambda d: d.sparkSession.range(3000).selectExpr("concat('^(click|view)', id, '[.]shop') AS pattern").unionByName(d.sparkSession.createDataFrame([("(a|b)$",), ("[0-9]{2}.user",)], "pattern string"))
_add("regex_list_many", lambda d: filters.regex_list_join(d, _many(d)).select("msg_id", "qname"), r"SELECT msg_id, qname FROM dns_log WHERE regexp_matches(qname, '^(click|view)[0-9]+[.]shop') OR regexp_matches(qname, '(a|b)$|[0-9]{2}.user')")
_add("regex_list_join", lambda d: filters.regex_list_join(d, d.sparkSession.createDataFrame([(p,) for p in _PATTERNS], "pattern string")).select("msg_id", "qname"), f"SELECT msg_id, qname FROM dns_log WHERE {_PATTERN_SQL}")
_add("client_domain_search", lambda d: lookup.search(d, "192.0.1.2"), "SELECT qname AS key, count(*) AS hit FROM dns_log WHERE query_ip = '192.0.1.2' GROUP BY 1 UNION ALL SELECT query_ip, count(*) FROM dns_log WHERE qname = '192.0.1.2' AND NOT EXISTS (SELECT 1 FROM dns_log WHERE query_ip = '192.0.1.2') GROUP BY 1")
_span = lambda d: d.withColumns({"message_id": F.concat(F.lit("m"), F.expr("msg_id div 2").cast("string")), "initial_request_id": F.concat(F.lit("m"), (F.expr("msg_id div 2") - 3).cast("string")), "operation": F.when(F.expr("msg_id div 2") % 3 == 0, F.replace("operation", F.lit("CLIENT"), F.lit("RESOLVER"))).otherwise(F.col("operation"))})
_add(
    "trace_spans",
    lambda d: pairing.trace_spans(_span(d).withColumn("initial_request_id", F.concat(F.lit("m"), (F.expr("msg_id div 2") - 1).cast("string"))).withColumn("identity", F.lit("ns"))),
    """, m AS (SELECT *, msg_id // 2 AS e, CASE WHEN (msg_id // 2) % 3 = 0 THEN replace(operation, 'CLIENT', 'RESOLVER') ELSE operation END AS op FROM dns_log),
q AS (SELECT * FROM m WHERE dns_type = 'QUERY'), r AS (SELECT * FROM m WHERE dns_type = 'REPLY')
SELECT 'ns' AS identity, sha1('m' || coalesce(p.e, q.e)) AS trace_id, 'm' || q.e AS span_id, 'm' || p.e AS parent_id, q.op AS operation, q.qname AS qname, q.ts_ns AS start_ns, r.ts_ns AS end_ns, CASE WHEN r.e IS NULL THEN 'timeout' WHEN r.rcode <> 'NOERROR' THEN r.rcode ELSE '' END AS error
FROM q LEFT JOIN r ON q.e = r.e LEFT JOIN q p ON q.op = 'RESOLVER_QUERY' AND p.op = 'CLIENT_QUERY' AND p.e = q.e - 1""",
)
ORACLE_SQL["trace_spans"] = ORACLE_SQL["trace_spans"].replace(") , m AS", "), m AS")

# aggregations
_TOTALS = "count(*) AS messages, count(*) FILTER (dns_type = 'QUERY') AS queries, count(*) FILTER (dns_type = 'REPLY') AS replies, CAST(sum(length) AS BIGINT) AS bytes, CAST(coalesce(sum(length) FILTER (dns_type = 'QUERY'), 0) AS BIGINT) AS bytes_received, CAST(coalesce(sum(length) FILTER (dns_type = 'REPLY'), 0) AS BIGINT) AS bytes_sent"
_add("metric_labels", lambda d: metrics.metric_totals(d, ["stream_global", "stream_id", "resolver"]), f"SELECT 'global' AS stream_global, identity AS stream_id, response_ip AS resolver, {_TOTALS} FROM dns_log GROUP BY ALL")
_add("metric_totals", metrics.metric_totals, f"SELECT identity AS stream_id, {_TOTALS} FROM dns_log GROUP BY ALL")
_add("metric_flags", metrics.metric_flags, "SELECT identity AS stream_id, " + ", ".join(f"CAST(0 AS BIGINT) AS {f}_total" for f in ("flag_tc", "flag_ra", "flag_ad", "ip_defragmented", "tcp_reassembled")) + ", count(*) FILTER (flag_aa) AS flag_aa_total, count(*) FILTER (malformed) AS malformed_total FROM dns_log GROUP BY ALL")
for _c, _skip in (("qtype", None), ("rcode", "-"), ("operation", None), ("protocol", None), ("family", None)):
    _add(f"metric_by_{_c}", lambda d, c=_c, s=_skip: metrics.metric_by(d, c, skip=s), f"SELECT identity AS stream_id, {_c}, count(*) AS messages FROM dns_log{f' WHERE {_c} <> {chr(39)}{_skip}{chr(39)}' if _skip else ''} GROUP BY ALL")

#: For distinct counts and top-N tables: where a key comes from, which rows, and the same in SQL.
_KEYED: dict[str, tuple] = {
    "requesters": (lambda d: d, "query_ip", None, "dns_log", "true", ()),
    "domains": (lambda d: d, "qname", None, "dns_log", "true", ()),
    "noerror": (lambda d: d, "qname", "rcode = 'NOERROR'", "dns_log", "rcode = 'NOERROR'", ()),
    "nxdomain": (lambda d: d, "qname", "rcode = 'NXDOMAIN'", "dns_log", "rcode = 'NXDOMAIN'", ()),
    "servfail": (lambda d: d, "qname", "rcode = 'SERVFAIL'", "dns_log", "rcode = 'SERVFAIL'", ()),
    "unanswered": (pairing.unanswered, "qname", "rcode = 'TIMEOUT'", "full_log", "rcode = 'TIMEOUT'", ("full",)),
    "tlds": (lambda d: lookup.add_tld(d, _psl(d)), "tld", "tld <> '-'", "tld", "tld <> '-'", ("tld",)),
    "etld1": (lambda d: lookup.add_tld_plus_one(d, _psl(d)), "etld_plus_one", "etld_plus_one <> '-'", "tld", "etld_plus_one <> '-'", ("tld",)),
    "suspicious": (lambda d: score.suspicious(pairing.measure_latency(d)), "qname", "suspicious_score > 0", "scored", "suspicious_score > 0", ("scored",)),
}
for _k, (_make, _col, _where, _from, _cond, _ctes) in _KEYED.items():
    _add(f"uniq_{_k}", lambda d, m=_make, c=_col, w=_where: metrics.uniques(m(d), c, where=F.expr(w) if w else None), f"SELECT identity AS stream_id, count(DISTINCT {_col}) AS uniques FROM {_from} WHERE {_cond} GROUP BY ALL", *_ctes)
    _add(f"top_{_k}", lambda d, m=_make, c=_col, w=_where: metrics.top_n(m(d), c, where=F.expr(w) if w else None), f"SELECT * FROM (SELECT identity AS stream_id, {_col} AS key, count(*) AS hit, CAST(row_number() OVER (PARTITION BY identity ORDER BY count(*) DESC, {_col}) AS INT) AS rank FROM {_from} WHERE {_cond} GROUP BY 1, 2) WHERE rank <= 10", *_ctes)
_EPS = "SELECT identity AS stream_id, ts_ns // 1000000000 AS tick, count(*) AS events FROM dns_log GROUP BY ALL"
_add("events_per_second", metrics.eps, _EPS)
_add("events_per_second_max", metrics.eps_max, f"SELECT stream_id, max(events) AS events_max FROM ({_EPS}) GROUP BY ALL")
_hist = lambda col, buckets: ", ".join(f"count(*) FILTER ({col} <= {b}) AS le_{f'{b:g}'.replace('.', '_')}" for b in buckets)
_add("hist_qname_length", lambda d: metrics.histogram(d.withColumn("n", F.octet_length("qname").cast("long")), "n", [10, 20, 40, 60, 100]), f"SELECT identity AS stream_id, {_hist('strlen(qname)', [10, 20, 40, 60, 100])}, CAST(sum(strlen(qname)) AS BIGINT) AS total, count(*) AS n FROM dns_log GROUP BY ALL")
_lb = [0.001, 0.01, 0.05, 0.1, 0.5, 1]
_add("hist_latency", lambda d: metrics.histogram(pairing.measure_latency(d), "latency", _lb, where=F.col("latency") > 0).withColumn("total", F.round("total", 6)), f"SELECT identity AS stream_id, {_hist('latency', _lb)}, round(sum(latency), 6) AS total, count(*) AS n FROM lat WHERE latency > 0 GROUP BY ALL", "lat")
for _k in ("query", "reply"):
    _add(f"hist_{_k}_size", lambda d, k=_k: metrics.histogram(d, "length", [50, 100, 250, 500], where=F.col("dns_type") == k.upper()), f"SELECT identity AS stream_id, {_hist('length', [50, 100, 250, 500])}, CAST(sum(length) AS BIGINT) AS total, count(*) AS n FROM dns_log WHERE dns_type = '{_k.upper()}' GROUP BY ALL")
_STATSD = "SELECT identity, 'total_packets' AS metric, count(*) AS value FROM dns_log GROUP BY 1 UNION ALL SELECT identity, 'total_bytes_received', CAST(coalesce(sum(length) FILTER (dns_type = 'QUERY'), 0) AS BIGINT) FROM dns_log GROUP BY 1 UNION ALL SELECT identity, 'total_bytes_sent', CAST(coalesce(sum(length) FILTER (dns_type <> 'QUERY'), 0) AS BIGINT) FROM dns_log GROUP BY 1 UNION ALL SELECT identity, 'total_requesters', count(DISTINCT query_ip) FROM dns_log GROUP BY 1 UNION ALL SELECT identity, 'total_domains', count(DISTINCT qname) FROM dns_log GROUP BY 1 UNION ALL SELECT identity, 'total_domains_nx', count(DISTINCT qname) FILTER (rcode = 'NXDOMAIN') FROM dns_log GROUP BY 1" + "".join(f" UNION ALL SELECT identity, '{p}' || {c}, count(*) FROM dns_log GROUP BY identity, {c}" for c, p in (("protocol", "total_packets_"), ("family", "total_packets_"), ("qtype", "total_replies_rrtype_"), ("rcode", "total_replies_rcode_"), ("operation", "total_packets_operation_")))
_add("statsd_stats", metrics.statsd_stats, _STATSD)
for _k, _col, _cond in (("streams", "identity", None), ("clients", "query_ip", None), ("domains", "qname", None), ("domains_nx", "qname", "rcode = 'NXDOMAIN'"), ("domains_servfail", "qname", "rcode = 'SERVFAIL'")):
    _add(f"api_{_k}", lambda d, c=_col, w=_cond: metrics.hits(d, c, F.expr(w) if w else None), f"SELECT {_col} AS key, count(*) AS hit FROM dns_log WHERE {_cond or 'true'} GROUP BY 1")
_add("api_tlds", lambda d: metrics.hits(lookup.add_tld(d, _psl(d)), "tld", F.col("tld") != "-"), "SELECT tld AS key, count(*) AS hit FROM tld WHERE tld <> '-' GROUP BY 1", "tld")
_add("api_suspicious", lambda d: metrics.suspicious_domains(score.suspicious(pairing.measure_latency(d))), "SELECT qname, msg_id, identity, query_ip, suspicious_score FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY ts_ns, msg_id) AS r FROM scored WHERE suspicious_score > 0) WHERE r = 1", "scored")
_add("hits_per_client_domain", metrics.client_domain_hits, "SELECT identity, query_ip, qname, count(*) AS hit FROM dns_log GROUP BY ROLLUP (identity, query_ip, qname)")
_STAGES = [("well_formed", "NOT malformed"), ("replies", "dns_type = 'REPLY'"), ("errors", "rcode <> 'NOERROR'")]
_cum = ["true"] + [" AND ".join(f"({c})" for _, c in _STAGES[: i + 1]) for i in range(3)]
_add("pipeline_accounting", lambda d: pipeline.accounting(d, [(n, F.expr(c)) for n, c in _STAGES]), " UNION ALL ".join(f"SELECT '{n}' AS stage, count(*) FILTER ({_cum[i]}) AS ingress, count(*) FILTER ({_cum[i + 1]}) AS egress, count(*) FILTER ({_cum[i]}) - count(*) FILTER ({_cum[i + 1]}) AS dropped FROM dns_log" for i, (n, _) in enumerate(_STAGES)))
_add("counter_increase", lambda d: metrics.increase(d, 60, F.expr("NOT malformed")), "SELECT identity, ts_ns // 60000000000 * 60 AS tick, count(*) AS ingress, count(*) FILTER (NOT malformed) AS egress, count(*) FILTER (malformed) AS dropped FROM dns_log GROUP BY ALL")
_lines = lambda d: d.select("msg_id", "ts_ns", "identity", formats.text_line(d).alias("line"))
_found = lambda d: metrics.search_lines(_lines(d), "ns1", [r"example\.org", r"192\.0\.1\."])
_FOUND = r"FROM lines WHERE identity = 'ns1' AND regexp_matches(line, 'example\.org') AND regexp_matches(line, '192\.0\.1\.')"
_add("log_search", lambda d: _found(d).select("msg_id", "line"), f"SELECT msg_id, line {_FOUND}", "lines")
_add("log_count", lambda d: _found(d).groupBy("identity").agg(F.count("*").alias("n")), f"SELECT identity, count(*) AS n {_FOUND} GROUP BY 1", "lines")
_add("log_rate", lambda d: metrics.eps(_found(d), ["stream_id"], 5).select("stream_id", "tick", (F.col("events") / 5).alias("rate")), f"SELECT identity AS stream_id, ts_ns // 5000000000 * 5 AS tick, count(*) / 5 AS rate {_FOUND} GROUP BY ALL", "lines")

# top-k and order
_top = lambda col, frm, cond, n: f"SELECT {col} AS key, count(*) AS hit FROM {frm} WHERE {cond} GROUP BY 1 ORDER BY hit DESC, key LIMIT {n}"
for _k, _col, _cond in (("domains", "qname", None), ("clients", "query_ip", None), ("nx", "qname", "rcode = 'NXDOMAIN'"), ("servfail", "qname", "rcode = 'SERVFAIL'")):
    _add(f"api_top_{_k}", lambda d, c=_col, w=_cond: metrics.top_n(d, c, 100, [], F.expr(w) if w else None), _top(_col, "dns_log", _cond or "true", 100))
_add("api_top_tlds", lambda d: metrics.top_n(lookup.add_tld(d, _psl(d)), "tld", 100, [], F.col("tld") != "-"), _top("tld", "tld", "tld <> '-'", 100), "tld")
for _k, _col, _cond in (("noerror", "qname", "rcode = 'NOERROR'"), ("nxdomain", "qname", "rcode = 'NXDOMAIN'"), ("clients", "query_ip", "true")):
    _add(f"dash_top_{_k}", lambda d, c=_col, w=_cond: metrics.top_n(records.tail_parse(formats.to_text(d).select(F.col("line").alias("value"))), c, 15, [], F.expr(w)), _top(_col, "dns_log", f"NOT contains(qname, ' ') AND {_cond}", 15))
_add("reorder", lambda d: state.with_position(d).select("identity", "flush", "position", "msg_id"), "SELECT identity, ts_ns // 30000000000 AS flush, row_number() OVER (PARTITION BY identity, ts_ns // 30000000000 ORDER BY ts_ns, msg_id) AS position, msg_id FROM dns_log")

_late = lambda d: d.withColumns({"timestamp": F.when(~F.col("malformed"), F.timestamp_micros(F.expr("ts_ns div 1000"))), "ts_ns": F.col("ts_ns") + F.col("msg_id") % 13 * 700_000_000_000})  # noqa: E731; rows arrive up to 2.3 hours late, and some have no time
_add(
    "reorder_flush",
    lambda d: state.flushed(_late(d), buffer=14400.0, rows=20).select("identity", "flush", "part", "position", "msg_id"),
    """
SELECT identity, flush, part, CASE WHEN malformed THEN place ELSE list_sort(places)[ordinal] END AS position, msg_id
FROM (
  SELECT *, row_number() OVER (PARTITION BY identity, flush, part, malformed ORDER BY us, place) AS ordinal,
    list(CASE WHEN NOT malformed THEN place END) FILTER (NOT malformed) OVER (PARTITION BY identity, flush, part) AS places
  FROM (
    SELECT *, (n - 1) // 20 AS part, (n - 1) % 20 + 1 AS place
    FROM (
      SELECT identity, msg_id, malformed, us, arrived // 14400000000000 AS flush,
        row_number() OVER (PARTITION BY identity, arrived // 14400000000000 ORDER BY arrived, msg_id) AS n
      FROM (SELECT *, ts_ns // 1000 AS us, ts_ns + msg_id % 13 * 700000000000 AS arrived FROM dns_log))))""",
)

# state
_REDUCED = "identity, operation, query_ip, response_ip, qname, qtype, f.msg_id AS msg_id, f.ts_ns AS ts_ns, occurrences, cumulative_length"
_red = ("identity", "operation", "query_ip", "response_ip", "qname", "qtype", "msg_id", "ts_ns", "occurrences", "cumulative_length")
_brief = lambda d: d.select(*state.REDUCE_KEYS, "msg_id", "ts_ns", "length")  # noqa: E731; what goes into _red
_add("reduce_traffic", lambda d: state.reduce_traffic(_brief(d)).select(*_red), f"SELECT {_REDUCED} FROM reduced", "reduced")
_add("reduce_traffic_etld1", lambda d: state.reduce_traffic(_brief(d), psl=_psl(d)).select(*_red), f"SELECT {_REDUCED} FROM reduced_domains", "reduced_domains")
_add("reduce_repeats", lambda d: state.reduce_traffic(X.repeated(_brief(d))).select(*_red), f"SELECT {_REDUCED} FROM reduced_repeats", "reduced_repeats")
_WHITE = r"NOT regexp_matches(qname, 'shop\.example\.org$')"
_FOLD = """, n AS MATERIALIZED (SELECT qname, ts_ns, min(msg_id) AS msg_id FROM dns_log WHERE {where} GROUP BY 1, 2),
a AS (SELECT qname, min(ts_ns) AS ts_ns FROM n GROUP BY 1 UNION ALL SELECT * FROM (SELECT a.qname, (SELECT min(n.ts_ns) FROM n WHERE n.qname = a.qname AND n.ts_ns >= a.ts_ns + 3600000000000) AS ts_ns FROM a) WHERE ts_ns IS NOT NULL)
SELECT n.msg_id, n.qname, n.ts_ns FROM a JOIN n ON a.qname = n.qname AND a.ts_ns = n.ts_ns"""
for _k, _where, _args in (("new_domains", _WHITE, {"whitelist": [r"shop\.example\.org$"]}), ("new_domains_seed", "qname NOT IN (SELECT qname FROM dns_log WHERE rcode = 'SERVFAIL')", None)):
    _add(_k, lambda d, a=_args: state.new_domains(d, **(a or {"known": d.where("rcode = 'SERVFAIL'")})).select("msg_id", "qname", "ts_ns"), _FOLD.format(where=_where))
    ORACLE_SQL[_k] = ORACLE_SQL[_k].replace(") , n AS", "), n AS")


#: Micro-batches of a log, and rows in one of its files, about.
_BATCHES, _STREAM_ROWS = 6, 200_000


def _stream(d: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """The log as a stream of several micro-batches: files in time order, one a batch, or more of them if the log is large.

    columns: what the stream reads beside ts_ns and msg_id (all if none are named); the files hold no others.
    """
    d = d.select("ts_ns", "msg_id", *columns) if columns else d
    path, files = pipeline.scratch(d.sparkSession, "log"), max(1, -(-d.count() // (_BATCHES * _STREAM_ROWS)))
    stateful.in_time_order(d, path, _BATCHES * files)
    return stateful.with_time(d.sparkSession.readStream.schema(d.schema).option("maxFilesPerTrigger", files).parquet(path))


_once = lambda d, f, mode="append", columns=(): stateful.run_once(f(_stream(d, columns)), pipeline.scratch(d.sparkSession, "stream"), mode)
_add("latency_stream", lambda d: _once(d, stateful.measure_latency).withColumn("latency", F.round("latency", 9)), "SELECT msg_id, round(latency, 9) AS latency FROM lat WHERE latency > 0", "lat")
_add("unanswered_stream", lambda d: _once(d.unionByName(stateful.closing_row(d)), stateful.unanswered).where("msg_id >= 0"), "SELECT msg_id FROM full_log WHERE rcode = 'TIMEOUT'", "full")
_add("metrics_stream", lambda d: _once(d, stateful.metrics, "complete", ("identity", "length")), "SELECT ts_ns // 60000000000 * 60 AS start, identity, count(*) AS messages, CAST(sum(length) AS BIGINT) AS bytes FROM dns_log GROUP BY ALL")


def _spans_stream(d: DataFrame) -> DataFrame:
    """Spans of a stream: each third exchange is a resolver's, asked for by the exchange before it."""
    asked = _span(d).withColumns({"initial_request_id": F.concat(F.lit("m"), (F.expr("msg_id div 2") - 1).cast("string")), "identity": F.lit("ns")})
    last = stateful.closing_row(asked).withColumns({"message_id": F.lit("last"), "operation": F.lit("CLIENT_QUERY")})
    return _once(asked.unionByName(last), spans.trace_spans).where("span_id <> 'last'")


_add(
    "trace_spans_stream",
    _spans_stream,
    """, m AS (SELECT *, msg_id // 2 AS e, CASE WHEN (msg_id // 2) % 3 = 0 THEN replace(operation, 'CLIENT', 'RESOLVER') ELSE operation END AS op FROM dns_log),
k AS (SELECT *, CASE WHEN op LIKE 'CLIENT%' THEN e ELSE e - 1 END AS root FROM m),
g AS (SELECT *, coalesce(ts_ns - lag(ts_ns) OVER (PARTITION BY root ORDER BY ts_ns) >= 120000000000, false) AS is_new FROM k),
s AS (SELECT *, sum(CAST(is_new AS INT)) OVER (PARTITION BY root ORDER BY ts_ns) AS part FROM g),
p AS (SELECT DISTINCT root, part FROM s WHERE op = 'CLIENT_QUERY'),
r AS (SELECT root, part, e, min(ts_ns) AS ts_ns, arg_min(rcode, ts_ns) AS rcode FROM s WHERE dns_type = 'REPLY' GROUP BY ALL),
q AS (SELECT s.*, CASE WHEN s.op <> 'CLIENT_QUERY' THEN p.root END AS parent, r.ts_ns AS end_ns, r.rcode AS reply
  FROM s LEFT JOIN p USING (root, part)
  LEFT JOIN r ON r.root = s.root AND r.part = s.part AND r.e = s.e AND r.ts_ns >= s.ts_ns AND r.ts_ns < s.ts_ns + 120000000000 WHERE s.dns_type = 'QUERY')
SELECT 'ns' AS identity, sha1('m' || coalesce(parent, e)) AS trace_id, 'm' || e AS span_id, 'm' || parent AS parent_id, op AS operation, qname, ts_ns AS start_ns, end_ns,
  CASE WHEN end_ns IS NULL THEN 'timeout' WHEN reply <> 'NOERROR' THEN reply ELSE '' END AS error FROM q""",
)
ORACLE_SQL["trace_spans_stream"] = ORACLE_SQL["trace_spans_stream"].replace(") , m AS", "), m AS")
_add("reduce_stream", lambda d: _once(X.repeated(d).unionByName(stateful.closing_row(X.repeated(d))), tracking.reduce_traffic).where("msg_id >= 0").select(*_red), f"SELECT {_REDUCED} FROM reduced_repeats", "reduced_repeats")


def _rolled_up(d: DataFrame, by_stream: bool = False) -> DataFrame:
    """Minutes of sketches, stored, combined to days of all streams; close: the estimate is within 2 % of the exact count."""
    what = (["identity"], ["qname", "query_ip"], ["qname"])
    if by_stream:
        minutes = _once(d.unionByName(stateful.closing_row(d)), lambda s: rollups.rollup(s, *what), columns=("identity", "qname", "query_ip", "length"))
        minutes = minutes.where(F.col("start") * 1_000_000_000 <= d.agg(F.max("ts_ns")).first()[0])
    else:
        minutes = shared.stored(rollups.rollup(d, *what), "minutes")
    days = rollups.estimates(rollups.combine(minutes, [], 86400))
    exact = d.groupBy((F.expr("ts_ns div 86400000000000") * 86400).alias("start")).agg(F.count_distinct("qname").alias("names"), F.count_distinct("query_ip").alias("clients"))
    close = lambda est, n: F.abs(F.col(est) - F.col(n)) <= F.col(n) * 0.02 + 1
    counts = F.array_join(F.transform("top_qname", lambda x: x["count"].cast("string")), ",")
    return days.join(exact, "start").select("start", "messages", "bytes", "names", "clients", (close("uniq_qname", "names") & close("uniq_query_ip", "clients")).alias("close"), counts.alias("top_counts"))


_ROLLUP = """
SELECT start, messages, bytes, names, clients, true AS close, top_counts
FROM (SELECT ts_ns // 86400000000000 * 86400 AS start, count(*) AS messages, CAST(sum(length) AS BIGINT) AS bytes,
    count(DISTINCT qname) AS names, count(DISTINCT query_ip) AS clients FROM dns_log GROUP BY 1)
JOIN (SELECT start, string_agg(n, ',' ORDER BY n DESC) AS top_counts
  FROM (SELECT ts_ns // 86400000000000 * 86400 AS start, count(*) AS n, row_number() OVER (PARTITION BY ts_ns // 86400000000000 ORDER BY count(*) DESC) AS r
    FROM dns_log GROUP BY ts_ns // 86400000000000, qname) WHERE r <= 10 GROUP BY start) USING (start)"""
_add("rollup_sketches", _rolled_up, _ROLLUP)
_add("rollup_stream", lambda d: _rolled_up(d, by_stream=True), _ROLLUP)


def _branched(d: DataFrame) -> DataFrame:
    """The log's stream in one pass to three sinks: forwarded rows, dropped rows, and names in lower case."""
    spark, folder = d.sparkSession, pipeline.scratch(d.sparkSession, "branches")
    keep = F.col("rcode") == "NOERROR"
    steps = {"forwarded": lambda x: pipeline.routes(x, keep)[0].select("msg_id", "qname"), "dropped": lambda x: pipeline.routes(x, keep)[1].select("msg_id", "qname"), "lower": lambda x: normalize.qname_lowercase(x).select("msg_id", "qname")}
    writer = branches.write_branches(_stream(d, ("qname", "rcode")), steps, folder)
    writer.option("checkpointLocation", pipeline.scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return pipeline.fan_in(*(branches.read_branch(spark, folder, n, "msg_id long, qname string").withColumn("route", F.lit(n)) for n in steps))


_add("route_fanout_stream", _branched, "SELECT msg_id, qname, CASE WHEN rcode = 'NOERROR' THEN 'forwarded' ELSE 'dropped' END AS route FROM dns_log UNION ALL SELECT msg_id, lower(qname), 'lower' FROM dns_log")


def _two_runs(d: DataFrame) -> DataFrame:
    """New names of the log in two runs; the second starts from what the first one knew."""
    middle, spark = d.agg(F.percentile_approx("ts_ns", 0.5)).first()[0], d.sparkSession
    folders = [pipeline.scratch(spark, "run") for _ in range(2)]
    early = stateful.run_once(tracking.new_domains(_stream(d.where(F.col("ts_ns") < middle))), folders[0])
    seed = tracking.known_names(spark, f"{folders[0]}/checkpoint")
    late = stateful.run_once(tracking.new_domains(_stream(d.where(F.col("ts_ns") >= middle)), known=seed), folders[1])
    return early.unionByName(late).select("msg_id", "qname", "ts_ns")


_add("new_domains_stream", _two_runs, _FOLD.format(where="true"))
ORACLE_SQL["new_domains_stream"] = ORACLE_SQL["new_domains_stream"].replace(") , n AS", "), n AS")


def _rotated(d: DataFrame) -> DataFrame:
    path = pipeline.scratch(d.sparkSession, "rotated")
    sinks.write_rotated(d, path, 500)
    return d.sparkSession.read.schema(d.schema).json(path).select(*d.columns)


_add("rotate_output", _rotated, f"SELECT {_ALL} FROM dns_log")



def _rotated_by_size(d: DataFrame) -> DataFrame:
    path = pipeline.scratch(d.sparkSession, "rotated")
    sinks.write_rotated(d.select("msg_id", "ts_ns", "qname"), path, bytes_per_file=1 << 12, keep=20)
    return d.sparkSession.read.schema("msg_id long, ts_ns long, qname string, hour long, file long").json(path).select("msg_id", "ts_ns", "qname", "hour", "file")


_add(
    "rotate_by_size",
    _rotated_by_size,
    """SELECT * FROM (WITH sized AS (SELECT msg_id, ts_ns, qname, ts_ns // 3600000000000 AS hour,
                strlen('{"msg_id":' || msg_id || ',"ts_ns":' || ts_ns || ',"qname":"' || qname || '"}') + 1 AS size FROM dns_log),
              filed AS (SELECT msg_id, ts_ns, qname, hour, CAST(sum(size) OVER (PARTITION BY hour ORDER BY ts_ns, msg_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) // 4096 AS file FROM sized),
              kept AS (SELECT DISTINCT hour, file FROM filed ORDER BY hour DESC, file DESC LIMIT 20)
       SELECT msg_id, ts_ns, qname, hour, file FROM filed JOIN kept USING (hour, file))""",
)
# formats, payloads, sinks
_add("to_text", formats.to_text, "SELECT msg_id, line FROM lines", "lines")
_add("to_text_sections", lambda d: formats.to_text(score.ml_features(score.suspicious(normalize.add_tags(lookup.add_tld(pairing.measure_latency(d), _psl(d)), ["edge", "v4"]))), "id qname publixsuffix-tld atags atags:1 atags:7 suspicious-score ml-labels ml-ratio-digits geoip-city reducer-occurrences latency"), f"SELECT s.msg_id, concat_ws(' ', s.dns_id, {_QNAME.replace('qname', 's.qname')}, tld, 'edge,v4', 'v4', '-', CAST(suspicious_score AS INT), len(string_split(s.qname, '.')), printf('%.3f', round({_cnt('0-9').replace('qname', 's.qname')} / strlen(s.qname), 3)), '-', '-', printf('%.9f', latency)) AS line FROM scored s JOIN tld t ON s.msg_id = t.msg_id", "scored", "tld")
_add("to_text_raw", lambda d: formats.to_text(d, "{dns} qname {->} rcode timestamp-unixms"), f"SELECT msg_id, concat_ws(' ', 'dns', {_QNAME}, '->', rcode, ts_ns // 1000000) AS line FROM dns_log")
_JSON = f"""SELECT msg_id, CAST(to_json(struct_pack(
  network := struct_pack(family := family, protocol := protocol, "query-ip" := query_ip, "query-port" := query_port, "response-ip" := response_ip,
    "response-port" := response_port, "ip-defragmented" := false, "tcp-reassembled" := false),
  dns := struct_pack(length := length, id := dns_id, opcode := opcode, rcode := rcode, qname := qname, qclass := qclass, qdcount := qdcount,
    ancount := len(answers), nscount := len(ns), arcount := len(ar), qtype := qtype,
    flags := struct_pack(qr := dns_type = 'REPLY', tc := flag_tc, aa := flag_aa, ra := flag_ra, ad := flag_ad, rd := flag_rd, cd := flag_cd),
    "resource-records" := struct_pack("an" := answers, ns := ns, ar := ar), "malformed-packet" := malformed),
  edns := struct_pack("udp-size" := edns_udp_size, rcode := edns_rcode, version := edns_version, "dnssec-ok" := edns_do, options := options),
  dnstap := struct_pack(operation := operation, identity := identity, version := '-', "timestamp-rfc3339ns" := {_RFC}, latency := latency, extra := '-',
    "policy-rule" := '-', "policy-type" := '-', "policy-match" := '-', "policy-action" := '-', "policy-value" := '-', "peer-name" := '-', "query-zone" := '-')
)) AS VARCHAR) AS line FROM rich"""
_add("to_json", lambda d: formats.to_json(S.nest(X.with_records(d))), _JSON, "rich")
_add("to_flat_json", lambda d: formats.to_flat_json(X.with_records(d)), f"SELECT msg_id, {_FLAT_JSON} AS line FROM rich", "rich")


def _decoded(d: DataFrame) -> DataFrame:
    """The log with everything that its packets say, by decoding them."""
    said = ("dns_id", "qname", "qtype", "rcode", "malformed", "flag_aa", "flag_rd")  # by the log
    own = [c for c in d.columns if c not in said and c != "msg_id"]
    packets = X.payloads(d, keep=(*own, *said)).withColumn("__log", F.struct(*said))
    found = decode.decode_payload(packets, keep=(*own, "__log")).drop("qr", *said)
    return found.select("*", "__log.*").drop("__log")


_add("decoded_flat_json", lambda d: formats.to_flat_json(_decoded(d)), f"SELECT msg_id, {_flat_json(ancount='ancount', arcount='arcount')} AS line FROM packets", "packets")
_add("to_template", lambda d: formats.to_template(S.nest(X.with_answers(d)), "{{ dns.qname }} asked by {{ network.query-ip }}: {{ dns.rcode }} [{{ dns.resource-records.an.*.rdata }}]"), "SELECT l.msg_id, l.qname || ' asked by ' || query_ip || ': ' || rcode || ' [' || coalesce(rdata, '') || ']' AS line FROM dns_log l LEFT JOIN answers a ON l.msg_id = a.msg_id", "answers")
_BLOCKS = """{% if dm.DNS.Type == "QUERY" %}query{% elif dns.rcode == "NOERROR" and dns.length > 100 %}long answer{% else %}answer{% endif %} \
{{ dm.NetworkInfo.QueryIP }} {{ dm.DNS.Flags.RD | yesno:"rd ,-" }} {{ dns.qname | upper }} {{ dm.DNS.DNSRRs.AnCount }}\
{% for rr in dm.DNS.DNSRRs.Answers %} {{ forloop.Counter }}={{ rr.Name }}/{{ rr.TTL }}/{{ rr.Rdata }}{% endfor %}"""
_add(
    "to_template_blocks",
    lambda d: formats.to_template(S.nest(X.with_answers(d)), _BLOCKS),
    """SELECT l.msg_id, CASE WHEN dns_type = 'QUERY' THEN 'query' WHEN rcode = 'NOERROR' AND length > 100 THEN 'long answer' ELSE 'answer' END
         || ' ' || query_ip || ' ' || CASE WHEN flag_rd THEN 'rd ' ELSE '-' END || ' ' || upper(l.qname) || ' '
         || CASE WHEN rdata IS NULL THEN '0' ELSE '1 1=' || a.name || '/' || a.ttl || '/' || rdata END AS line
       FROM dns_log l LEFT JOIN answers a ON l.msg_id = a.msg_id""",
    "answers",
)
_add("text_clean_null", lambda d: formats.replace_nul(d.select("msg_id", F.concat("qname", F.lit("\0"), "rcode").alias("line")), by="?"), "SELECT msg_id, qname || '?' || rcode AS line FROM dns_log")


def _written(mode: str) -> Callable[[DataFrame], DataFrame]:
    def make(d: DataFrame) -> DataFrame:
        path = pipeline.scratch(d.sparkSession, "sink")
        sinks.write_log(d, path, mode, "gzip")
        return d.sparkSession.read.text(path).withColumnRenamed("value", "line")

    return make


_add("sink_text", _written("text"), "SELECT line FROM lines", "lines")
_add("sink_json", lambda d: _written("json")(d).select(F.from_json("line", d.schema).alias("r")).select("r.*"), f"SELECT {_ALL} FROM dns_log")
_add("sink_flat_json", lambda d: _written("flat-json")(X.with_records(d)), f"SELECT {_FLAT_JSON} AS line FROM rich", "rich")


def _noop(d: DataFrame) -> DataFrame:
    """The rows that a discarding sink has counted."""
    rows, seen = pipeline.observed(d, "noop")
    sinks.write_noop(rows)
    return d.sparkSession.createDataFrame([(seen.get["rows"],)], "discarded long")


_add("sink_noop", _noop, "SELECT count(*) AS discarded FROM dns_log")
_add("kafka_records", lambda d: payloads.kafka_records(d), "SELECT identity AS key, line AS value FROM lines", "lines")
_add("clickhouse_rows", payloads.clickhouse_rows, "SELECT identity, query_ip AS queryip, qname, operation, family, protocol, qtype, rcode, CAST(ts_ns AS VARCHAR) AS timensec, CAST(ts_ns // 1000000000 AS VARCHAR) AS timestamp FROM dns_log")
_add("influx_points", payloads.influx_points, r"""SELECT msg_id, 'dns,Identity=' || identity || ',Qname=' || regexp_replace(qname, '([ ,=])', '\\\1', 'g') || ',QueryIP=' || query_ip || ' Family="' || family || '",Operation="' || operation || '",Protocol="' || protocol || '",Qtype="' || qtype || '",Rcode="' || rcode || '" ' || ts_ns AS point FROM dns_log""")
_HOUR = "ts_ns // 3600000000000"
_add("es_bulk", lambda d: payloads.es_bulk(X.with_records(d), 1 << 18).select("identity", "hour", "bulk", "n", F.sha1(F.col("body").cast("binary")).alias("body_sha1")), f"SELECT identity, hour, bulk, count(*) AS n, sha1(string_agg(item, '' ORDER BY ts_ns, msg_id)) AS body_sha1 FROM (SELECT *, CAST((sum(strlen(item)) OVER (PARTITION BY identity, hour ORDER BY ts_ns, msg_id ROWS UNBOUNDED PRECEDING) - strlen(item)) AS BIGINT) // 262144 AS bulk FROM (SELECT identity, ts_ns, msg_id, {_HOUR} AS hour, '{{\"create\":{{}}}}' || chr(10) || {_FLAT_JSON} || chr(10) AS item FROM rich)) GROUP BY 1, 2, 3", "rich")
_add("loki_streams", lambda d: payloads.loki_streams(d, batch_bytes=1 << 16).select("labels", "hour", "batch", "n", F.sha1(F.col("entries").cast("binary")).alias("entries_sha1")), f"""SELECT labels, hour, batch, count(*) AS n, sha1(string_agg(ts_ns || ' ' || line, chr(10) ORDER BY ts_ns, msg_id)) AS entries_sha1 FROM (SELECT *, CAST((sum(strlen(line)) OVER (PARTITION BY labels, hour ORDER BY ts_ns, msg_id ROWS UNBOUNDED PRECEDING) - strlen(line)) AS BIGINT) // 65536 AS batch FROM (SELECT '{{identity="' || identity || '", job="dnslens"}}' AS labels, {_HOUR} AS hour, ts_ns, msg_id, line FROM lines)) GROUP BY 1, 2, 3""", "lines")
_RULES = [
    {"source_labels": ["__dns_rcode"], "target_label": "rcode"},
    {"source_labels": ["__dns_rcode"], "target_label": "__rcode"},
    {"action": "lowercase", "source_labels": ["__network_protocol"], "target_label": "protocol"},
    {"action": "drop", "source_labels": ["__dns_qtype", "__network_protocol"], "regex": "(PTR|MX);UDP"},
    {"action": "labeldrop", "regex": "job"},
]
_add(
    "loki_relabel",
    lambda d: payloads.loki_streams(d, batch_bytes=1 << 16, rules=_RULES).select("labels", "hour", "batch", "n", F.sha1(F.col("entries").cast("binary")).alias("entries_sha1")),
    f"""SELECT * FROM (WITH labelled AS (
          SELECT '{{identity="' || d.identity || '", protocol="' || lower(d.protocol) || '", rcode="' || d.rcode || '"}}' AS labels,
                 d.ts_ns // 3600000000000 AS hour, d.ts_ns, d.msg_id, l.line
          FROM dns_log d JOIN lines l ON d.msg_id = l.msg_id
          WHERE NOT (d.qtype IN ('PTR', 'MX') AND d.protocol = 'UDP')),
        sized AS (SELECT *, sum(strlen(line)) OVER (PARTITION BY labels, hour ORDER BY ts_ns, msg_id ROWS UNBOUNDED PRECEDING) - strlen(line) AS before FROM labelled)
        SELECT labels, hour, CAST(before AS BIGINT) // 65536 AS batch, count(*) AS n,
               sha1(string_agg(ts_ns || ' ' || line, chr(10) ORDER BY ts_ns, msg_id)) AS entries_sha1
        FROM sized GROUP BY 1, 2, 3)""",
    "lines",
)
_add("scalyr_events", payloads.scalyr_events, f"SELECT msg_id, identity, {_HOUR} AS hour, (row_number() OVER (PARTITION BY identity, {_HOUR} ORDER BY ts_ns, msg_id) - 1) // 400 AS request, CAST(ts_ns AS VARCHAR) AS ts, 3 AS sev, CAST(to_json(struct_pack(parser := 'dns', message := line)) AS VARCHAR) AS attrs FROM lines", "lines")
_add("fluentd_records", lambda d: payloads.fluentd_records(X.with_records(d)), f"SELECT msg_id, 'dns.message' AS tag, ts_ns // 1000000000 AS time, {_FLAT_JSON} AS record FROM rich", "rich")
_add("redis_publish", payloads.redis_publish, """SELECT msg_id, 'PUBLISH "dns" "' || replace(line, '"', '\\"') || '"' AS command FROM lines""", "lines")
_add("statsd_lines", lambda d: payloads.statsd_lines(metrics.statsd_stats(d)), f"SELECT 'dnslens_' || identity || '_' || metric || ':' || value || '|c' AS line FROM ({_STATSD})")
_add("exposition_lines", lambda d: payloads.exposition_lines(metrics.metric_totals(d)), f"""SELECT 'dnslens_' || metric || '{{stream_id="' || stream_id || '"}} ' || value AS line FROM (UNPIVOT (SELECT identity AS stream_id, {_TOTALS} FROM dns_log GROUP BY ALL) ON COLUMNS(* EXCLUDE (stream_id)) INTO NAME metric VALUE value)""")

# routing
_add("route_fanin", lambda d: pipeline.fan_in(d.where("dns_type = 'QUERY'").select("msg_id", "qname"), d.where("dns_type = 'REPLY'").select("msg_id", "qname", "rcode")), "SELECT msg_id, qname, CASE WHEN dns_type = 'REPLY' THEN rcode END AS rcode FROM dns_log")
_add("route_fanout", lambda d: pipeline.fan_in(*(b.withColumn("route", F.lit(n)) for n, b in pipeline.fan_out(d, {"plain": lambda x: x.select("msg_id", "qname"), "lower": lambda x: normalize.qname_lowercase(x).select("msg_id", "qname")}).items())), "SELECT msg_id, qname, 'plain' AS route FROM dns_log UNION ALL SELECT msg_id, lower(qname), 'lower' FROM dns_log")


def _dropped(d: DataFrame) -> DataFrame:
    kept, dropped = pipeline.routes(d, F.nullif("rcode", F.lit("-")) == "NOERROR")
    return pipeline.fan_in(kept.select("msg_id", F.lit("forwarded").alias("route")), dropped.select("msg_id", F.lit("dropped").alias("route")))


_add("route_dropped", _dropped, "SELECT msg_id, CASE WHEN rcode = 'NOERROR' THEN 'forwarded' ELSE 'dropped' END AS route FROM dns_log")
_SLOW = "SELECT msg_id, replace(lower(qname), ' ', '\\032') AS qname, rcode, round(latency, 9) AS latency, branch FROM (SELECT *, 'slow' AS branch FROM lat WHERE operation = 'CLIENT_RESPONSE' AND latency > 0.2 UNION ALL SELECT *, 'errors' FROM lat WHERE operation = 'CLIENT_RESPONSE' AND rcode NOT IN ('NOERROR', 'NXDOMAIN'))"
_add("slow_and_errors", lambda d: pipeline.slow_and_errors(d).select("msg_id", "qname", "rcode", F.round("latency", 9).alias("latency"), "branch"), _SLOW, "lat")
_add("flagship", lambda d: metrics.top_n(pipeline.slow_and_errors(d), "qname"), "SELECT * FROM (SELECT identity AS stream_id, replace(lower(qname), ' ', '\\032') AS key, count(*) AS hit, CAST(row_number() OVER (PARTITION BY identity ORDER BY count(*) DESC, replace(lower(qname), ' ', '\\032')) AS INT) AS rank FROM (SELECT * FROM lat WHERE operation = 'CLIENT_RESPONSE' AND latency > 0.2 UNION ALL SELECT * FROM lat WHERE operation = 'CLIENT_RESPONSE' AND rcode NOT IN ('NOERROR', 'NXDOMAIN')) GROUP BY 1, 2) WHERE rank <= 10", "lat")
