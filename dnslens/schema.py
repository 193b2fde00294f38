"""The message record: flat columns of the DNS log, the nested form, and the code tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(strings: str = "", longs: str = "", booleans: str = "") -> list[T.StructField]:
    return [T.StructField(n, t) for names, t in ((strings, _S), (longs, _L), (booleans, _B)) for n in names.split()]


RECORD = T.StructType(_struct("name rdatatype class") + _struct(longs="ttl") + _struct("rdata"))
OPTION = T.StructType(_struct(longs="code") + _struct("name data"))

#: The flat log that SQL-shaped operators work on.
DNS_LOG = T.StructType(
    _struct(longs="msg_id ts_ns") + _struct("identity operation dns_type rcode query_ip query_port response_ip response_port family protocol") + _struct(longs="dns_id") + _struct("qname qtype") + _struct(longs="length", booleans="flag_aa flag_rd malformed")
)

# Names of classes, record types, response codes and EDNS options as the DNS registries give them.
CLASSES = {1: "IN", 2: "CS", 3: "CH", 4: "HS", 254: "NONE", 255: "ANY"}
RDATATYPES = {
    0: "NONE", 1: "A", 2: "NS", 3: "MD", 4: "MF", 5: "CNAME", 6: "SOA", 7: "MB", 8: "MG", 9: "MR", 10: "NULL", 11: "WKS",
    12: "PTR", 13: "HINFO", 14: "MINFO", 15: "MX", 16: "TXT", 17: "RP", 18: "AFSDB", 19: "X25", 20: "ISDN", 21: "RT",
    22: "NSAP", 23: "NSAP_PTR", 24: "SIG", 25: "KEY", 26: "PX", 27: "GPOS", 28: "AAAA", 29: "LOC", 30: "NXT", 33: "SRV",
    35: "NAPTR", 36: "KX", 37: "CERT", 38: "A6", 39: "DNAME", 41: "OPT", 42: "APL", 43: "DS", 44: "SSHFP",
    45: "IPSECKEY", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 49: "DHCID", 50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA",
    53: "SMIMEA", 55: "HIP", 56: "NINFO", 59: "CDS", 60: "CDNSKEY", 61: "OPENPGPKEY", 62: "CSYNC", 64: "SVCB",
    65: "HTTPS", 99: "SPF", 103: "UNSPEC", 108: "EUI48", 109: "EUI64", 249: "TKEY", 250: "TSIG", 251: "IXFR",
    252: "AXFR", 253: "MAILB", 254: "MAILA", 255: "ANY", 256: "URI", 257: "CAA", 258: "AVC", 259: "AMTRELAY",
    32768: "TA", 32769: "DLV",
}
RCODES = {
    0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED", 6: "YXDOMAIN", 7: "YXRRSET",
    8: "NXRRSET", 9: "NOTAUTH", 10: "NOTZONE", 11: "DSOTYPENI", 16: "BADSIG", 17: "BADKEY", 18: "BADTIME",
    19: "BADMODE", 20: "BADNAME", 21: "BADALG", 22: "BADTRUNC", 23: "BADCOOKIE",
}
OPTIONS = {3: "NSID", 8: "CSUBNET", 9: "EXPIRE", 10: "COOKIE", 11: "KEEPALIVE", 12: "PADDING", 15: "ERRORS"}
EXTENDED_ERRORS = (
    "Other", "Unsupported DNSKEY Algorithm", "Unsupported DS Digest Type", "Stale Answer", "Forged Answer",
    "DNSSEC Indeterminate", "DNSSEC Bogus", "Signature Expired", "Signature Not Yet Valid", "DNSKEY Missing",
    "RRSIGs Missing", "No Zone Key Bit Set", "NSEC Missing", "Cached Error", "Not Ready", "Blocked", "Censored",
    "Filtered", "Prohibited", "Stale NXDOMAIN Answer", "Not Authoritative", "Not Supported", "No Reachable Authority",
    "Network Error", "Invalid Data",
)
# Short names of operations.
OPERATION_CODES = {
    "AUTH_QUERY": "AQ",
    "AUTH_RESPONSE": "AR",
    "RESOLVER_QUERY": "RQ",
    "RESOLVER_RESPONSE": "RR",
    "CLIENT_QUERY": "CQ",
    "CLIENT_RESPONSE": "CR",
    "FORWARDER_QUERY": "FQ",
    "FORWARDER_RESPONSE": "FR",
    "STUB_QUERY": "SQ",
    "STUB_RESPONSE": "SR",
    "TOOL_QUERY": "TQ",
    "TOOL_RESPONSE": "TR",
    "UPDATE_QUERY": "UQ",
    "UPDATE_RESPONSE": "UR",
    "DNSQueryType": "Q",
    "DNSResponseType": "R",
}
# Short names of types and families, and the operations of PowerDNS message types.
TYPE_CODES = {"QUERY": "Q", "REPLY": "R"}
FAMILY_CODES = {"INET6": "6", "INET": "4", "IPv6": "6", "IPv4": "4"}
#: Short response codes; NOTIMP and its other spelling both mean 4.
RCODE_CODES = {name: str(code) for code, name in RCODES.items()} | {"NOIMP": "4"}
POWERDNS_OPERATIONS = {"DNSQueryType": "CLIENT_QUERY", "DNSResponseType": "CLIENT_RESPONSE", "DNSOutgoingQueryType": "RESOLVER_QUERY", "DNSIncomingResponseType": "RESOLVER_RESPONSE"}


def lookup(table: dict, key: Column, default: Column | str = "UNKNOWN") -> Column:
    """The value of key in a literal table."""
    made = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(made[key], default if isinstance(default, Column) else F.lit(default))


#: Keys of the flat view that come from flat columns, and the others' values while unset.
# Keys of the flat view, and what they hold where nothing is known.
FLAT_KEYS = {
    "dns.flags.aa": "flag_aa", "dns.flags.rd": "flag_rd", "dns.id": "dns_id", "dns.length": "length",
    "dns.malformed-packet": "malformed", "dns.qname": "qname", "dns.qtype": "qtype", "dns.rcode": "rcode",
    "dnstap.identity": "identity", "dnstap.operation": "operation", "network.family": "family",
    "network.protocol": "protocol", "network.query-ip": "query_ip", "network.query-port": "query_port",
    "network.response-ip": "response_ip", "network.response-port": "response_port",
}
FLAT_UNSET = {
    "dns.flags.ad": False, "dns.flags.cd": False, "dns.flags.qr": None, "dns.flags.ra": False, "dns.flags.tc": False,
    "dns.ancount": 0, "dns.arcount": 0, "dns.nscount": 0, "dns.opcode": 0, "dns.qclass": "-", "dns.qdcount": 0,
    "dns.resource-records.ar": "-", "dns.resource-records.ns": "-", "dnstap.extra": "-", "dnstap.latency": 0.0,
    "dnstap.peer-name": "-", "dnstap.policy-action": "-", "dnstap.policy-match": "-", "dnstap.policy-rule": "-",
    "dnstap.policy-type": "-", "dnstap.policy-value": "-", "dnstap.query-zone": "-", "dnstap.version": "-",
    "edns.dnssec-ok": 0, "edns.options": "-", "edns.rcode": 0, "edns.udp-size": 0, "edns.version": 0,
    "network.ip-defragmented": False, "network.tcp-reassembled": False,
}
#: The flat columns of those keys, and of the lists of records and options; a row without the column holds what is unset.
FLAT_OPTIONAL = {
    "dns.flags.ad": "flag_ad", "dns.flags.cd": "flag_cd", "dns.flags.ra": "flag_ra", "dns.flags.tc": "flag_tc",
    "dns.ancount": "ancount", "dns.arcount": "arcount", "dns.nscount": "nscount", "dns.opcode": "opcode", "dns.qclass": "qclass", "dns.qdcount": "qdcount",
    "dnstap.extra": "extra", "dnstap.latency": "latency", "dnstap.peer-name": "peer_name", "dnstap.policy-action": "policy_action",
    "dnstap.policy-match": "policy_match", "dnstap.policy-rule": "policy_rule", "dnstap.policy-type": "policy_type", "dnstap.policy-value": "policy_value",
    "dnstap.query-zone": "query_zone", "dnstap.version": "version",
    "edns.dnssec-ok": "edns_do", "edns.rcode": "edns_rcode", "edns.udp-size": "edns_udp_size", "edns.version": "edns_version",
    "network.ip-defragmented": "ip_defragmented", "network.tcp-reassembled": "tcp_reassembled",
}
LISTS = {"dns.resource-records.an": ("answers", "an"), "dns.resource-records.ar": ("ar",), "dns.resource-records.ns": ("ns",), "edns.options": ("options",)}
#: Fields of the records and options in those lists, in the order of their keys.
LIST_FIELDS = {"dns.resource-records": ("class", "name", "rdata", "rdatatype", "ttl"), "edns.options": ("code", "data", "name")}
# Optional sections, their fields, and the flat columns that hold them.
SECTIONS = {
    "geoip": {"as-number": "geo_asn", "as-owner": "geo_owner", "city": "geo_city", "continent": "geo_continent", "country-isocode": "geo_country"},
    "suspicious": {
        "score": "suspicious_score", "malformed-pkt": "suspicious_malformed", "large-pkt": "suspicious_large_packet",
        "long-domain": "suspicious_long_domain", "slow-domain": "suspicious_slow", "unallowed-chars": "suspicious_chars",
        "uncommon-qtypes": "suspicious_uncommon_qtype", "excessive-number-labels": "suspicious_labels",
    },
    "publicsuffix": {"tld": "tld", "etld+1": "etld_plus_one", "managed-icann": "managed_icann"},
    "extracted": {"dns_payload": "dns_payload"},
    "reducer": {"occurrences": "occurrences", "cumulative-length": "cumulative_length"},
    "filtering": {"sample-rate": "sample_rate"},
    "ml": {
        "entropy": "ml_entropy", "length": "ml_length", "labels": "ml_labels", "digits": "ml_digits", "lowers": "ml_lowers",
        "uppers": "ml_uppers", "specials": "ml_specials", "others": "ml_others", "ratio-digits": "ml_ratio_digits",
        "ratio-letters": "ml_ratio_letters", "ratio-specials": "ml_ratio_specials", "ratio-others": "ml_ratio_others",
        "consecutive-chars": "ml_consecutive_chars", "consecutive-vowels": "ml_consecutive_vowels",
        "consecutive-digits": "ml_consecutive_digits", "consecutive-consonants": "ml_consecutive_consonants",
        "size": "ml_size", "occurrences": "ml_occurrences", "uncommon-qtypes": "ml_uncommon_qtype",
    },
    "atags": {"tags": "tags"},
}


def sections(df: DataFrame) -> dict[str, dict[str, str]]:
    """The optional sections of which df has columns, with those fields alone."""
    have = {name: {k: c for k, c in fields.items() if c in df.columns} for name, fields in SECTIONS.items()}
    return {name: fields for name, fields in have.items() if fields}


def list_column(df: DataFrame, key: str) -> str | None:
    """The column that holds a list of the flat view, if df has one."""
    return next((c for c in LISTS[key] if c in df.columns), None)


def list_fields(key: str) -> tuple[str, ...]:
    return LIST_FIELDS[key if key in LIST_FIELDS else key.rsplit(".", 1)[0]]


def value(df: DataFrame, key: str) -> Column:
    """The value of a key of FLAT_UNSET: its column's where there is one and it isn't null, a count of its list, or unset."""
    if key == "dns.flags.qr":
        return F.col("dns_type") == "REPLY"
    unset = F.lit(FLAT_UNSET[key])
    if isinstance(FLAT_UNSET[key], int) and not isinstance(FLAT_UNSET[key], bool):
        unset = unset.cast("long")
    if (column := FLAT_OPTIONAL.get(key)) in df.columns:
        return F.coalesce(F.col(column), unset)
    section = {"dns.ancount": "an", "dns.nscount": "ns", "dns.arcount": "ar"}.get(key)
    if section and (held := list_column(df, f"dns.resource-records.{section}")):
        return F.coalesce(F.size(held), F.lit(0)).cast("long")
    return unset


def nest(df: DataFrame) -> DataFrame:
    """The flat log as nested sections under the names that rules and JSON use: msg_id, network, dns, edns, dnstap.

    Columns that enrichments add become sections of their own (SECTIONS); without them there is no such section.
    """
    from dnslens.functions.text import rfc3339

    c = lambda name, alias: F.col(name).alias(alias)
    v = lambda key: value(df, key).alias(key.rsplit(".", 1)[1])

    def held(key: str, kind: T.StructType) -> Column:
        none, column = F.array().cast(T.ArrayType(kind)), list_column(df, key)
        return (F.coalesce(F.col(column), none) if column else none).alias(key.rsplit(".", 1)[1])

    flags = F.struct(v("dns.flags.qr"), v("dns.flags.tc"), c("flag_aa", "aa"), v("dns.flags.ra"), v("dns.flags.ad"), c("flag_rd", "rd"), v("dns.flags.cd"))
    records = F.struct(*(held(f"dns.resource-records.{k}", RECORD) for k in ("an", "ns", "ar")))
    counts = [v(f"dns.{k}") for k in ("qdcount", "ancount", "nscount", "arcount")]
    policy = [v(f"dnstap.policy-{k}") for k in ("rule", "type", "match", "action", "value")]
    return df.select(
        "msg_id",
        F.struct("family", "protocol", c("query_ip", "query-ip"), c("query_port", "query-port"), c("response_ip", "response-ip"), c("response_port", "response-port"), v("network.ip-defragmented"), v("network.tcp-reassembled")).alias("network"),
        F.struct("length", c("dns_id", "id"), v("dns.opcode"), "rcode", "qname", v("dns.qclass"), *counts, "qtype", flags.alias("flags"), records.alias("resource-records"), c("malformed", "malformed-packet")).alias("dns"),
        F.struct(v("edns.udp-size"), v("edns.rcode"), v("edns.version"), v("edns.dnssec-ok"), held("edns.options", OPTION)).alias("edns"),
        F.struct("operation", "identity", v("dnstap.version"), rfc3339(F.col("ts_ns")).alias("timestamp-rfc3339ns"), v("dnstap.latency"), v("dnstap.extra"), *policy, v("dnstap.peer-name"), v("dnstap.query-zone")).alias("dnstap"),
        *(F.struct(*(c(column, k) for k, column in fields.items())).alias(name) for name, fields in sections(df).items()),
    )
