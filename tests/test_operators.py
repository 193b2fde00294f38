"""Behaviour of single operators on small rows."""

import pytest
from pyspark.sql import functions as F

from dnslens import fixtures as X
from dnslens import schema as S
from dnslens.functions import formats
from dnslens.functions.ip import in_networks
from dnslens.operators import filters, lookup, normalize, pairing, predicates, privacy, score, state
from dnslens.plans import pipeline
from dnslens.sources import decode

BASE = {"msg_id": 0, "ts_ns": 0, "identity": "ns0", "operation": "CLIENT_QUERY", "dns_type": "QUERY", "rcode": "-", "query_ip": "192.0.2.1", "query_port": "1234", "response_ip": "198.51.100.1", "response_port": "53", "family": "IPv4", "protocol": "UDP", "dns_id": 1, "qname": "www.example.com", "qtype": "A", "length": 40, "flag_aa": False, "flag_rd": True, "malformed": False}


def log(spark, *rows):
    return spark.createDataFrame([tuple((BASE | {"msg_id": i} | r)[f.name] for f in S.DNS_LOG) for i, r in enumerate(rows)], S.DNS_LOG)


def ids(df):
    return sorted(r.msg_id for r in df.select("msg_id").collect())


def test_networks_of_both_families(spark):
    cidrs = ["192.168.1.10", "192.0.2.1", "192.3.2.0/21", "192.168.1.0/24", "2001:db8:85a3::8a2e:370:7334", "2001:0dbd:85a3:0000::/64", "nonsense"]
    ips = ["192.168.0.1", "192.168.1.10", "192.3.2.1", "192.0.2.3", "2001:db8:85a3::8a2e:370:7334", "2041::7334", "2001:0dbd:85a3::0001", "x", None]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "msg_id long, ip string")
    assert ids(df.where(in_networks(F.col("ip"), cidrs))) == [1, 2, 4, 6]


def test_rdata_filter_with_both_families(spark):
    rows = [["192.168.0.1"], ["192.168.1.10"], ["2001:0dbd:85a3::0001"], []]
    df = spark.createDataFrame([(i, [("n", "AAAA" if ":" in ip else "A", "IN", 1, ip) for ip in r]) for i, r in enumerate(rows)], "msg_id long, answers array<struct<name:string,rdatatype:string,class:string,ttl:long,rdata:string>>")
    cidrs = ["192.168.1.0/24", "2001:0dbd:85a3:0000::/64"]
    assert ids(filters.keep_rdata_ip(df, cidrs)) == [1, 2] and ids(filters.keep_rdata_ip(df, cidrs, dropped=True)) == [0, 3]


def test_domain_regexes(spark):
    df = log(spark, *({"qname": q} for q in ("test.google.com.ru", "test.github.com.malware.ru", "mail.google.com")))
    assert ids(filters.keep_domain_regex(df, [r"(mail|sheets)\.google\.com$", r"test\.github\.com$", r".+\.google\.com$"])) == [2]


def test_name_list_is_lower_case_and_name_is_not(spark):
    df = log(spark, {"qname": "www.github.com"}, {"qname": "WWW.github.com"})
    assert ids(filters.drop_fqdn(df, ["WWW.GitHub.com"])) == [1]


def test_kept_and_dropped_are_complements(spark):
    df = log(spark, *({"rcode": r} for r in ("-", "NOERROR", "NXDOMAIN")))
    assert ids(filters.drop_rcodes(df, ["NXDOMAIN"])) + ids(filters.drop_rcodes(df, ["NXDOMAIN"], dropped=True)) == [0, 1, 2]


def test_downsample_modes(spark):
    df = log(spark, *({"ts_ns": i} for i in range(10)))
    assert ids(filters.downsample(df, 5)) == [0, 1, 2, 3, 5, 6, 7, 8] and ids(filters.downsample(df, 5, "keep_nth")) == [4, 9]
    assert len(ids(filters.hash_sample(df, 3))) + len(ids(filters.hash_sample(df, 3, mode="keep_nth"))) == 10


def test_matching_rules(spark):
    nested = S.nest(log(spark, {"dns_id": 5}, {"dns_id": 2}))
    assert ids(predicates.match(nested, {"dns.id": {"greater-than": 3}})) == [0]
    assert ids(predicates.match(nested, {"dns.id": {"greater-than": 1, "lower-than": 3}})) == [1]
    assert ids(predicates.match(nested, {})) == [] and ids(predicates.match(nested, None, {})) == [0, 1]
    assert ids(predicates.match(nested, {"dns.resource-records.an.0.ttl": 1})) == []
    for bad in ({"dns.id": {"greater-than": "0"}}, {"dns.nothing": 1}, {"dns.qname": 3}, {"dns.flags.qr": 1.5 > 1, "dns.id": True}):
        with pytest.raises(ValueError):
            predicates.match(nested, bad)


def test_match_source_from_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("^www\\.\n\n")
    nested = S.nest(log(spark, {}, {"qname": "mail.example.com"}))
    assert ids(predicates.match(nested, {"dns.qname": {"match-source": str(tmp_path / "list.txt"), "source-kind": "regexp_list"}})) == [0]


def test_suffixes(spark):
    psl = X.psl(spark)
    names = ["www.amazon.fr", "www.Google.Com", "www.amazon.fr.", "books.amazon.co.uk", "play.googleapis.com", "a.b.ck", "x.www.ck", "com", "localhost"]
    df = log(spark, *({"qname": q} for q in names))
    rows = {r.qname: r for r in lookup.add_tld_plus_one(lookup.add_tld(df, psl), psl).collect()}
    assert [rows[n].tld for n in names] == ["fr", "com", "fr", "co.uk", "-", "b.ck", "ck", "com", "-"]
    assert [rows[n].etld_plus_one for n in names] == ["amazon.fr", "google.com", "amazon.fr", "amazon.co.uk", "play.googleapis.com", "a.b.ck", "www.ck", "-", "-"]
    assert not rows["play.googleapis.com"].managed_icann


def test_nonprintable(spark):
    df = log(spark, {"qname": "invalid\tinvalid . com"})
    assert normalize.replace_nonprintable(df).first().qname == "invalid\\009invalid\\032.\\032com"


def test_masks_and_hashes(spark):
    df = log(spark, {"query_ip": "192.168.1.2"}, {"query_ip": "fe80::6111:626:c1b2:2353"}, {"query_ip": "x"})
    assert [r.query_ip for r in privacy.anonymize_ip(df).orderBy("msg_id").collect()] == ["192.168.0.0", "fe80::", "x"]
    assert len(privacy.hash_ip(df, "query_ip", "sha512").first().query_ip) == 128 and privacy.hash_ip(df, "query_ip", "none").first().query_ip == "192.168.1.2"


def test_latency_rule(spark):
    t = 1704486841216166066
    q, r = {"dns_type": "QUERY"}, {"dns_type": "REPLY", "operation": "CLIENT_RESPONSE"}
    df = log(spark, q | {"ts_ns": t}, r | {"ts_ns": t + 11795545}, r | {"ts_ns": t + 20000000}, q | {"ts_ns": t, "dns_id": 2}, r | {"ts_ns": t + 2_000_000_000, "dns_id": 2})
    assert [round(x.latency, 9) for x in pairing.measure_latency(df).orderBy("msg_id").collect()] == [0, 0.011795545, 0, 0, 0]
    late = pairing.unanswered(df).where("rcode = 'TIMEOUT'").collect()
    assert [x.msg_id for x in late] == [3]


def test_new_domains_fold(spark):
    s = 1_000_000_000
    df = log(spark, *({"ts_ns": x * s} for x in (0, 5, 9, 10, 15, 20)), {"qname": "a.shop", "ts_ns": 0})
    assert ids(state.new_domains(df, 10, ["shop$"])) == [0, 3, 5]
    assert ids(state.new_domains(df, 10, known=df.where("msg_id = 6"))) == [0, 3, 5]


def test_reduce(spark):
    df = log(spark, {"ts_ns": 1}, {"ts_ns": 0, "length": 2}, {"ts_ns": 3_000_000_000})
    assert sorted((r.msg_id, r.occurrences, r.cumulative_length) for r in state.reduce_traffic(df).collect()) == [(1, 2, 42), (2, 1, 40)]


def test_relabel(spark):
    flat = spark.createDataFrame([(1, {"old_field": "a", "foo_field": "b", "other_field": "c"})], "msg_id long, flat map<string,string>")
    out = normalize.relabel_remove(normalize.relabel_rename(flat, [("^old_", "new_field")]), ["^foo_"]).first().flat
    assert out == {"new_field": "a", "other_field": "c"}


def test_suspicious_whitelist_and_ml_of_empty_name(spark):
    df = log(spark, {"qname": "a==.ip6.arpa", "malformed": True}, {"qname": ""}, {"qname": "dns.example"})
    scores = [r.suspicious_score for r in score.suspicious(df).orderBy("msg_id").collect()]
    assert scores == [0.0, 0.0, 0.0]
    rows = score.ml_features(df).orderBy("msg_id").collect()
    assert rows[1].ml_ratio_digits == 1.0 and rows[2].ml_labels == 2 and rows[1].ml_consecutive_chars == 0


def test_geo_by_subnet(spark):
    df = log(spark, {"query_ip": "1.1.1.1"}).withColumn("options", F.array(F.struct(F.lit(8).alias("code"), F.lit("203.0.113.0/24").alias("data"))))
    assert lookup.geoip(df, X.geo_ranges(spark), lookup_ecs=True).first().geo_country == "CN"
    assert lookup.geoip(df, X.geo_ranges(spark)).first().geo_country == "-"


def test_text_directives(spark):
    df = log(spark, {"qname": 'a "b" c', "ts_ns": 1_500_000_000})
    assert formats.to_text(df, "timestamp {x} qname atags").first().line == r'1970-01-01T00:00:01.5Z x "a \"b\" c" -'
    with pytest.raises(ValueError):
        formats.to_text(df, "nothing")


def test_rewrite_checks(spark):
    df = log(spark, {})
    assert normalize.rewrite(df, {"identity": "x", "malformed": "y"}).first().identity == "x"
    for bad in ({"nothing": 1}, {"identity": 1}):
        with pytest.raises(ValueError):
            normalize.rewrite(df, bad)


def test_chain_order(spark):
    seen = []
    steps = {n: lambda d, n=n: seen.append(n) or d for n in ("geoip", "latency", "suspicious", "privacy")}
    pipeline.chain(log(spark, {}), steps)
    pipeline.chain(log(spark, {}), steps, "reference")
    assert seen == ["latency", "suspicious", "geoip", "privacy", "privacy", "suspicious", "latency", "geoip"]


@pytest.mark.parametrize(
    ("name", "raw"),
    [("short", b"\0" * 5), ("pointer on", b"\0\1\0\0\0\1\0\0\0\0\0\0\xc0\x0c\0\1\0\1"), ("bad label", b"\0\1\0\0\0\1\0\0\0\0\0\0\x50a\0\0\1\0\1"), ("cut question", b"\0\1\0\0\0\1\0\0\0\0\0\0\1a\0\0")],
)
def test_malformed_packets(name, raw):
    assert decode.decode(raw)["malformed"], name


def test_rdata_and_options():
    p = X.encode_message(7, True, 0, (True, True), "a.example", 15, None)
    head, body = p[:12], p[12:]
    mx = b"\xc0\x0c\0\x0f\0\1\0\0\0\x3c\0\x07\0\x0a\2mx\xc0\x0c"
    txt = b"\xc0\x0c\0\x10\0\1\0\0\0\x3c\0\x04\3abc"
    out = decode.decode(head[:6] + b"\0\2" + head[8:10] + b"\0\0" + body[: len(body)] + mx + txt)
    assert [(r["rdatatype"], r["rdata"]) for r in out["an"]] == [("MX", "10 mx.a.example"), ("TXT", "abc")] and not out["malformed"]
    assert decode.option_text(15, b"\0\x12no") == "18 Prohibited no" and decode.option_text(8, b"\0\2\x20\0\x20\1\x0d\xb8") == "[2001:db8::]/32"


def test_optional_sections_are_there_with_their_columns_only(spark):
    import json

    plain = log(spark, {"qname": "www.example.com"})
    rich = normalize.add_tags(score.suspicious(lookup.geoip(plain, X.geo_ranges(spark))), ["edge", "v4"])
    flat = normalize.flatten(rich).first().flat
    assert (flat["geoip.city"], flat["suspicious.score"], flat["atags.tags.0"], flat["atags.tags.1"]) == ("Berlin", "0.0", "edge", "v4")
    assert normalize.flatten(normalize.add_tags(plain, [])).first().flat["atags.tags"] == "-"
    assert not [k for k in normalize.flatten(plain).first().flat if k.split(".")[0] in S.SECTIONS]
    nested = json.loads(formats.to_json(S.nest(rich)).first().line)
    assert nested["geoip"]["country-isocode"] == "DE" and nested["atags"] == {"tags": ["edge", "v4"]} and nested["suspicious"]["long-domain"] is False
    assert not S.SECTIONS.keys() & json.loads(formats.to_json(S.nest(plain)).first().line).keys()
    assert json.loads(formats.to_flat_json(rich).first().line)["geoip.as-owner"] == "Example Mid"
    assert ids(predicates.match(S.nest(rich), {"atags.tags": "v4"})) == [0] and ids(predicates.match(S.nest(rich), {"suspicious.score": {"greater-than": 1}})) == []


def test_range_lookup_of_both_families(spark):
    cidrs = ["192.0.2.0/24", "192.0.0.0/16", "2001:db8::/32", "2001:db8:1::/48", "::/0", "nonsense"]
    ranges = spark.createDataFrame([(c,) for c in cidrs], "cidr string")
    ips = ["192.0.2.7", "192.0.9.1", "10.0.0.1", "2001:db8::5", "2001:0db8:1::5", "2001:db9::1", "::", "x", None]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "msg_id long, ip string")
    got = [r.cidr for r in lookup.ip_range_lookup(df, "ip", ranges).orderBy("msg_id").collect()]
    assert got == ["192.0.2.0/24", "192.0.0.0/16", None, "2001:db8::/32", "2001:db8:1::/48", "::/0", "::/0", None, None]


def test_template_blocks(spark):
    from dnslens.functions import templates

    d = log(spark, {"qname": "a<b>.example.com"}, {"dns_type": "REPLY", "rcode": "NOERROR"})
    record = "array(named_struct('name', 'n', 'rdatatype', 'A', 'class', 'IN', 'ttl', 60L, 'rdata', '192.0.2.1'), named_struct('name', 'm', 'rdatatype', 'A', 'class', 'IN', 'ttl', 5L, 'rdata', '192.0.2.2'))"
    d = d.withColumn("answers", F.expr(f"if(dns_type = 'REPLY', {record}, null)"))

    def lines(template, **how):
        return [r.line for r in formats.to_template(S.nest(d), template, **how).orderBy("msg_id").collect()]

    assert lines("{{ dns.qname }}")[0] == "a&lt;b&gt;.example.com"
    assert lines("{{ dns.qname }}", autoescape=False)[0] == lines("{{ dns.qname | safe }}")[0] == "a<b>.example.com"
    assert lines("{% for r in dm.DNS.DNSRRs.Answers %}{{ forloop.Counter }}{{ r.Name }}{{ r.TTL }};{% endfor %}") == ["", "1n60;2m5;"]
    assert lines("{% for r in no.list %}{{ r }}{% endfor %}x{# not shown #}") == ["x", "x"]
    assert lines("{% for r in dns.resource-records.an %}{% if r.ttl < 10 or not r.name %}{{ r.rdata }}{% endif %}{% endfor %}") == ["", "192.0.2.2"]
    assert lines('{% if dm.DNS.Type == "QUERY" %}q{% elif dns.length >= 40 and dns.flags.rd %}r{% else %}-{% endif %}') == ["q", "r"]
    assert lines('{{ dns.flags.qr | yesno:"r,q" }}{{ no.field }}{{ no.field | default:"none" | upper }}{{ dns.resource-records.an.*.rdata | join:"+" }}') == ["qNONE", "rNONE192.0.2.1+192.0.2.2"]
    assert lines("{{ dm.DNS.DNSRRs.AnCount }} {{ dns.qname | length }} {{ dns.length | add:2 }} {{ dnstap.latency }} {{ dns.flags.qr }}")[1] == "2 15 42 0.000000 True"
    for wrong in ("{% if dns.id %}", "{{ dns.id | nothing }}", "{% jump %}"):
        with pytest.raises(ValueError):
            templates.template_line(S.nest(d), wrong)


def test_relabelling_of_streams(spark):
    from dnslens.functions import payloads

    d = log(spark, {"rcode": "NOERROR"})

    def labels(*rules, mode="text"):
        return [r.labels for r in payloads.loki_streams(d, rules=list(rules), mode=mode).collect()]

    rcode = {"source_labels": ["__dns_rcode"], "target_label": "rcode"}
    for mode in ("text", "json", "flat-json"):
        assert labels(rcode, mode=mode) == ['{identity="ns0", job="dnslens", rcode="NOERROR"}']
    assert labels(rcode | {"target_label": "__rcode"}) == ['{identity="ns0", job="dnslens"}']
    assert labels({"action": "labeldrop", "regex": "job"}) == ['{identity="ns0"}']
    assert labels({"action": "labelkeep", "regex": "__.*"}) == []
    assert labels(rcode | {"action": "keep", "regex": "NO"}) == labels(rcode | {"action": "drop", "regex": "NO.*"}) == []
    assert labels({"action": "labelmap", "regex": "__network_(fam|proto).*"}, {"action": "labelkeep", "regex": "fam|proto"}) == ['{fam="IPv4", proto="UDP"}']
    assert labels({"source_labels": ["job", "identity"], "regex": "(.*);(.*)", "target_label": "$2", "replacement": "${1}!"})[0] == '{identity="ns0", job="dnslens", ns0="dnslens!"}'
    assert labels(rcode | {"replacement": ""}, rcode | {"target_label": "job", "replacement": ""}) == ['{identity="ns0"}']
    import hashlib

    want = int.from_bytes(hashlib.md5(b"ns0").digest()[8:]) % 7
    assert labels({"action": "hashmod", "source_labels": ["identity"], "target_label": "part", "modulus": 7}) == [f'{{identity="ns0", job="dnslens", part="{want}"}}']


def test_bulk_bodies_as_gzip(spark):
    import gzip

    from dnslens.functions import payloads

    d = log(spark, {}, {"qname": "é.example.com"})
    plain, packed = payloads.es_bulk(d).collect(), payloads.es_bulk(d, compression="gzip").collect()
    assert [gzip.decompress(bytes(r.body)).decode() for r in packed] == [r.body for r in plain]


def test_rotation_by_size_keeps_the_last_files(spark, tmp_path):
    from dnslens.plans import sinks

    d = log(spark, *({"ts_ns": i * 10**9} for i in range(40)))
    sinks.write_rotated(d, str(tmp_path / "all"), bytes_per_file=2000)
    sinks.write_rotated(d, str(tmp_path / "last"), bytes_per_file=2000, keep=2)
    files = sorted(int(p.parent.name.split("=")[1]) for p in (tmp_path / "all").rglob("*.gz"))
    assert len(files) > 3 and files == list(range(len(files)))
    assert sorted(int(p.parent.name.split("=")[1]) for p in (tmp_path / "last").rglob("*.gz")) == files[-2:]
    assert ids(spark.read.json(str(tmp_path / "all"))) == list(range(40))


def test_sets_of_both_families(spark):
    from dnslens.functions.ip import networks

    ips = ["192.0.2.9", "192.0.3.9", "2001:db8::7", "2001:DB8:0:0::7", "2001:db9::7", "x", None]
    d = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "msg_id long, ip string")
    nets = networks(spark, ["192.0.2.0/24", "192.0.2.8/29", "2001:db8::/64", "nonsense"])
    assert ids(lookup.ip_in_set(d, "ip", nets)) == [0, 2, 3]
    assert ids(lookup.ip_in_set(d, "ip", nets, "left_anti")) == [1, 4, 5, 6]
    assert lookup.ip_in_set(d, "ip", nets).columns == d.columns


def _pcap(*frames):
    import struct

    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return out + b"".join(struct.pack("<IIII", k, 0, len(f), len(f)) + f for k, f in enumerate(frames))


def _v4(ident, part, payload, proto=17):
    import struct

    return b"\0" * 12 + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), ident, part, 64, proto, 0) + bytes([192, 0, 2, 1, 192, 0, 2, 2]) + payload


def _messages(spark, *frames):
    from dnslens.sources import capture

    files = spark.createDataFrame([("f", bytearray(_pcap(*frames)))], "path string, content binary")
    rows = capture.messages(capture.packets(files)).select("payload", "tcp_reassembled", "ip_defragmented").collect()
    return sorted((bytes(r.payload), r.tcp_reassembled, r.ip_defragmented) for r in rows)


def test_fragments_are_put_together(spark):
    import struct

    body = bytes(range(60))
    udp = struct.pack(">HHHH", 4000, 53, 68, 0) + body
    first, second, last = _v4(7, 0x2000, udp[:24]), _v4(7, 0x2000 | 3, udp[24:48]), _v4(7, 6, udp[48:])
    assert _messages(spark, first, second, last) == [(body, False, True)]
    assert _messages(spark, last, first, _v4(8, 0x2000, udp[:24]), second, second) == [(body, False, True)]  # any order; id 8 never ends
    assert _messages(spark, first, last) == []
    assert _messages(spark, _v4(9, 0, udp)) == [(body, False, False)]
    head = lambda part: struct.pack(">BBHI", 17, 0, part, 5)
    six = lambda part, payload: b"\0" * 12 + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, 8 + len(payload), 44, 64) + bytes(32) + head(part) + payload
    assert _messages(spark, six(1, udp[:24]), six(24, udp[24:])) == [(body, False, True)]


def test_flows_with_gaps_and_repeats(spark):
    import struct

    def segment(seq, body):
        return _v4(0, 0, struct.pack(">HHIIBBHHH", 4000, 53, seq, 0, 5 << 4, 16, 1024, 0, 0) + body, 6)

    one, two, three = (len(b).to_bytes(2) + b for b in (b"a" * 20, b"b" * 30, b"c" * 10))
    stream = one + two
    assert _messages(spark, segment(1, stream[:10]), segment(11, stream[10:])) == [(b"a" * 20, True, False), (b"b" * 30, False, False)]
    overlap = [segment(1, stream[:30]), segment(20, stream[19:]), segment(1, stream[:30])]
    assert _messages(spark, *overlap) == [(b"a" * 20, False, False), (b"b" * 30, True, False)]
    lost = [segment(1, one), segment(1 + len(one), two[:5]), segment(1 + len(stream), three)]
    assert _messages(spark, *lost) == [(b"a" * 20, False, False), (b"c" * 10, False, False)]


def test_longest_prefix_against_brute_force(spark):
    """Random networks of all lengths of both families, nested and apart, and addresses at their edges."""
    import ipaddress
    import random

    rng = random.Random(4)
    nets = ["0.0.0.0/0", "::/0", "::1/128", "255.255.255.255", "ffff::/16", "8000::/1", "1.2.3.0/255.255.255.0", "x", "1.2.3.4/33"]
    for _ in range(150):
        nets.append(f"10.{rng.choice([0, 128])}.{rng.choice([0, 1, 128])}.{rng.randrange(256)}/{rng.randrange(8, 33)}")
        nets.append(f"2001:db8:{rng.choice(['0', '8000', 'ffff'])}:{rng.choice(['0', 'f000'])}::{rng.randrange(9)}/{rng.randrange(12, 129)}")
    ips = ["x", None, "", "::ffff:10.0.0.1", "1.2.3.4", "1.2.3", "::1"]
    for n in nets:
        try:
            net = ipaddress.ip_network(n, strict=False)
        except ValueError:
            continue
        ips += [str(net.network_address), str(net.broadcast_address)]
        ips += [str(type(net.network_address)(x)) for x in (int(net.network_address) - 1, int(net.broadcast_address) + 1) if 0 <= x < 2**net.max_prefixlen]

    def best(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return None
        hits = []
        for n in nets:
            try:
                net = ipaddress.ip_network(n, strict=False)
            except ValueError:
                continue
            if a.version == net.version and a in net:
                hits.append((net.prefixlen, n))
        return max(hits)[1] if hits else None

    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "msg_id long, ip string")
    ranges = spark.createDataFrame([(n,) for n in nets], "cidr string")
    got = {r.msg_id: r.cidr for r in lookup.ip_range_lookup(df, "ip", ranges).dropDuplicates(["msg_id"]).collect()}
    assert got == {i: best(ip) for i, ip in enumerate(ips)}


def test_client_subnets_of_both_families(spark):
    texts = ["[2001:db8::]/32", "2001:db8::1/48", "10.0.0.0/8", "[::ffff:1.2.3.4]/128", "1:2:3:4:5:6:7:8/128", "::/0", "1:2:3/48", ":::/1", "1::2::3/9", "1:2:3:4:5:6:7:8:9/1", "12345::/1", "1.2.3.400/8", "::1.2.3.400/8", "-", "g::/1"]
    df = spark.createDataFrame([(i, [(10, "1.1.1.1/8"), (8, t), (8, "9.9.9.9/8")]) for i, t in enumerate(texts)], "i int, options array<struct<code:int,data:string>>")
    got = [r[0] for r in df.orderBy("i").select(lookup.client_subnet(F.col("options"))).collect()]
    assert got == ["2001:db8::", "2001:db8::1", "10.0.0.0", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "::", *["9.9.9.9"] * 9]


def _captured(spark, folder, split, **how):
    from dnslens.sources import capture

    rows = capture.capture_files(spark, str(folder), split_bytes=split, **how)
    return sorted((r.path, r.ts_ns, r.protocol, r.src_ip, r.src_port, bytes(r.payload), r.tcp_reassembled, r.ip_defragmented) for r in rows.collect())


def test_capture_files_are_cut_anywhere(spark, tmp_path):
    """Cut into many parts, a file gives what one read gives: also where bodies look like record heads, and a datagram's parts fall apart."""
    import random
    import struct

    rng, frames = random.Random(3), []
    lure = struct.pack("<IIII", 5, 0, 60, 60) + bytes(60)  # a plausible record inside a body
    for k in range(400):
        body = rng.choice([rng.randbytes(rng.randrange(12, 300)), lure * rng.randrange(1, 20), bytes(rng.randrange(12, 2000))])
        udp = struct.pack(">HHHH", 4000 + k, 53, 8 + len(body), 0) + body
        if k % 7 == 0:
            frames += [_v4(k, 0x2000, udp[:8]), _v4(k, 1, udp[8:])]
        elif k % 5 == 0:
            frames.append(_v4(k, 0, struct.pack(">HHIIBBHHH", 4000 + k, 53, 1, 0, 5 << 4, 16, 1024, 0, 0) + len(body).to_bytes(2) + body, 6))
        else:
            frames.append(_v4(k, 0, udp))
    (tmp_path / "a.pcap").write_bytes(_pcap(*frames))
    (tmp_path / "b.pcap").write_bytes(_pcap(*frames[:3]) + b"cut off")
    (tmp_path / "c.pcap").write_bytes(b"no capture")
    whole = _captured(spark, tmp_path, 1 << 30)
    assert len([r for r in whole if r[0].endswith("a.pcap")]) == 400
    assert _captured(spark, tmp_path, (tmp_path / "a.pcap").stat().st_size // 8) == whole == _captured(spark, tmp_path, 999)


def test_sequence_numbers_wrap(spark):
    """A flow goes on past the end of the sequence numbers, and segments may come out of order and twice there."""
    import struct

    tcp = lambda seq, body: _v4(1, 0, struct.pack(">HHIIBBHHH", 4000, 53, seq % (1 << 32), 0, 5 << 4, 16, 1024, 0, 0) + body, 6)
    body = b"".join(len(m).to_bytes(2) + m for m in (b"a" * 40, b"b" * 50, b"c" * 60))
    start, cuts = (1 << 32) - 70, [0, 30, 60, 90, 120, len(body)]
    parts = [tcp(start + a, body[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    want = sorted([(b"a" * 40, True, False), (b"b" * 50, True, False), (b"c" * 60, True, False)])
    assert _messages(spark, *parts) == want
    assert _messages(spark, parts[0], parts[2], parts[1], parts[2], parts[4], parts[3]) == want


def test_capture_stream_reads_new_files_once(spark, tmp_path):
    import os
    import struct

    from dnslens.sources import capture_source

    spark.dataSource.register(capture_source.CaptureSource)
    (tmp_path / "in").mkdir()
    frame = lambda port: _v4(1, 0, struct.pack(">HHHH", port, 53, 20, 0) + bytes(12))
    seen = []

    def run():
        stream = spark.readStream.format("dns_capture").options(path=f"{tmp_path}/in", splitBytes=64).load()
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(lambda df, _: seen.extend(r.src_port for r in df.collect())).start().awaitTermination()

    for k, name in enumerate(("b", "a", "c")):
        (tmp_path / "in" / name).write_bytes(_pcap(*(frame(1000 * (k + 1) + i) for i in range(5))))
        os.utime(tmp_path / "in" / name, ns=(10**18 + k, 10**18 + k))
        if k != 1:
            run()
    assert sorted(map(int, seen)) == [1000 * (k + 1) + i for k in range(3) for i in range(5)]


def test_rules_of_flatten_equal_rules_on_its_map(spark):
    """Rules matched when the plan is built give what rules on the finished map give, numbered keys and clashing names included."""
    d = normalize.add_tags(X.with_records(X.dns_log(spark, "/root/testdata/sf0.001")).limit(300), ["edge", "v4"])
    removals = [["^dns\\.flags", "an\\.0\\.(ttl|class)"], ["tags"], []]
    renames = [
        [("^dns\\.q(name|type)$", "question"), ("question|rcode$", "all")],
        [("\\.rdata$", "answers"), ("^answers$", "dns.qname")],
        [("an\\.1\\.name", "second"), ("second|first", "third"), ("nothing at all", "x")],
        [("tags", "dns.rcode"), ("edns\\.options", "options")],
        [("^network\\.", "dns.resource-records.an.0.name")],
    ]
    for remove in removals:
        for rename in renames:
            want = normalize.relabel_rename(normalize.relabel_remove(normalize.flatten(d), remove), rename)
            got = normalize.flatten(d, remove, rename)
            rows = [{r.msg_id: r.flat for r in x.collect()} for x in (got, want)]
            assert rows[0] == rows[1], (remove, rename)


def test_flat_json_is_json_whatever_a_record_holds(spark):
    import json

    text = 'a "b" \\ \n \x01 \x7f é 日 </x>'
    d = log(spark, {"qname": text}).withColumn("answers", F.array_repeat(F.struct(F.lit(text).alias("name"), F.lit("A").alias("rdatatype"), F.lit("IN").alias("class"), F.lit(5).alias("ttl"), F.lit(None).cast("string").alias("rdata")), 12))
    line = formats.to_flat_json(d).first().line
    made = json.loads(line)
    assert list(made) == sorted(made) and made["dns.qname"] == made["dns.resource-records.an.11.name"] == text and made["dns.ancount"] == 12
    assert made["dns.resource-records.an.3.ttl"] == 5 and made["dns.resource-records.an.3.rdata"] == "-" and made["edns.options"] == "-"


def test_long_lists_of_networks_are_joined(spark):
    """The same rows by a condition and by a join, kept or dropped, with addresses that are none."""
    d = log(spark, *({"query_ip": ip} for ip in ("10.0.7.1", "10.9.0.1", "2001:db8::1", "x", None)))
    few = ["10.0.7.0/24", "2001:db8::/64"]
    many = [*few, *(f"172.16.{k}.0/24" for k in range(150))]
    for rule in (filters.keep_query_ip, filters.drop_query_ip):
        for dropped in (False, True):
            assert ids(rule(d, many, dropped)) == ids(rule(d, few, dropped))
    assert ids(filters.keep_query_ip(d, many)) == [0, 2]


def test_frame_streams_are_cut_anywhere(spark, tmp_path):
    """Numbers in messages look like heads that jump over many frames; every cut gives the frames of one read."""
    import random
    import struct

    from dnslens.sources import capture, capture_source

    rng = random.Random(8)
    lures = [struct.pack(">I", n) + bytes([t]) for n in range(60, 4000, 7) for t in capture_source.TAGS]
    out = [b"\0\0\0\0\0\0\0\x04\0\0\0\x02"]
    for _ in range(300):
        payload = b"".join(rng.choice(lures) for _ in range(rng.randrange(1, 12)))
        message = b"\x08\x05\x52" + bytes([len(payload)]) + payload
        frame = b"\x0a\x03ns1\x72" + bytes([len(message)]) + message + b"\x78\x01"
        out.append(len(frame).to_bytes(4) + frame)
    out.append(b"\0\0\0\0\0\0\0\x04\0\0\0\x03")
    raw, path = b"".join(out), tmp_path / "a.fstrm"
    path.write_bytes(raw)
    want = list(capture.split_frames(raw))
    for split in (len(raw), 4096, 1000, 101):
        parts = [capture_source.Part(str(path), lo, min(lo + split, len(raw)), len(raw)) for lo in range(0, len(raw), split)]
        assert [f for p in parts for f in capture_source.records(p, "fstrm", 53)] == want
    assert capture.fstrm_files(spark, str(tmp_path), 1000).count() == 300


def test_captures_are_cut_anywhere(tmp_path):
    """Bytes of messages look like heads whose length leads to a true head far away; every cut gives the packets of one read."""
    import struct

    from dnslens.sources import capture, capture_source

    def record(k, payload):
        frame = _v4(k, 0, struct.pack(">HHHH", 1024 + k, 53, 8 + len(payload), 0) + payload)
        return struct.pack("<IIII", 1_700_000_000, k, len(frame), len(frame)) + frame

    plain = len(record(0, bytes(40)))
    lure = lambda far: struct.pack("<IIII", 1_700_000_001, 5, far, far)
    payloads = [bytes(8) + lure(16 + 200 * plain) + bytes(16) if k % 3 == 0 else bytes(40) for k in range(900)]
    # the length from a lure's end (16 bytes before a frame's) to the head of a record 200 further on
    raw = struct.pack("<IHHIIII", 0xA1B23C4D, 2, 4, 0, 0, 1 << 16, 1) + b"".join(record(k, p) for k, p in enumerate(payloads))
    raw += record(900, bytes(40))[:30]  # cut off
    path = tmp_path / "a.pcap"
    path.write_bytes(raw)
    want = list(capture.split_packets(raw[:-30], 53))
    assert len(want) == 900
    for split in (len(raw), 5000, 1000, 101):
        parts = [capture_source.Part(str(path), lo, min(lo + split, len(raw)), len(raw)) for lo in range(0, len(raw), split)]
        assert [r for p in parts for r in capture_source.records(p, "pcap", 53)] == want


def test_sections_are_exploded_in_one_pass(spark):
    """Rows are read, and packets decoded, once for all sections, and null and empty lists have no records."""
    record = "array<struct<name:string,rdatatype:string,class:string,ttl:long,rdata:string>>"
    one = [("a", "A", "IN", 1, "192.0.2.1")]
    df = spark.createDataFrame([(1, one, None, one * 2), (2, [], one, None), (3, None, None, [])], f"msg_id long, an {record}, ns {record}, ar {record}")
    out = normalize.explode_records(df, {"an": "an", "ns": "ns", "ar": "ar"})
    assert sorted((r.msg_id, r.section, r.idx) for r in out.collect()) == [(1, "an", 0), (1, "ar", 0), (1, "ar", 1), (2, "ns", 0)]
    plan = normalize.explode_records(decode.decode_payload(spark.range(1).selectExpr("id AS msg_id", "binary('') AS payload")), {"an": "an", "ns": "ns", "ar": "ar"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_packets_of_a_batch_are_decoded_alike(spark):
    """What a task remembers of questions and options changes no packet; columns are kept; short and null payloads are malformed."""
    made = [X.encode_message(i, i % 2 == 0, 0, (False, True), f"n{i % 3}.example", 1, (60, bytes(4)) if i % 2 == 0 else None, i % 5 == 0) for i in range(40)]
    made += [made[1][:12] + b"\0OPTx", made[1][:10] + b"\0\1\0OPTx" + b"\0\0\x29\0\0\0\0\0\0\0\1x", b"", None, made[2][:11]]
    df = spark.createDataFrame([(i, p, i * 2) for i, p in enumerate(made)], "msg_id long, payload binary, twice long")
    got = {r.msg_id: r.asDict(True) for r in decode.decode_payload(df.coalesce(1), keep=("twice",)).collect()}
    assert len(got) == len(made)
    for i, p in enumerate(made):
        assert got[i] == {"msg_id": i, **decode.decode(p or b""), "twice": i * 2}
    assert [got[i]["malformed"] for i in range(42, 45)] == [True] * 3 and got[1]["options"][0]["data"] == "1.58.30.0/24" and got[2]["an"][0]["rdata"] == "0.0.0.0"


def test_packets_are_made_without_python(spark):
    """The log's packets by expressions are those of encode_message."""
    log = X.dns_log(spark, "/root/testdata/sf0.001")
    types, codes = {v: k for k, v in S.RDATATYPES.items()}, {v: k for k, v in S.RCODES.items()}
    made = X.payloads(log, keep=("qname",))
    assert "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString() and made.columns == ["msg_id", "payload", "qname"]
    packets = {r.msg_id: r.payload for r in made.collect()}
    for r in X.with_answers(log).collect():
        answer = (r.answers[0].ttl, bytes(map(int, r.answers[0].rdata.split(".")))) if r.answers else None
        assert packets[r.msg_id] == X.encode_message(r.dns_id, r.dns_type == "REPLY", codes.get(r.rcode, 0), (r.flag_aa, r.flag_rd), r.qname, types[r.qtype], answer, r.malformed)


def test_decoded_packets_keep_their_rows(spark, sf):
    """What packets say meets the log's other columns without a join."""
    from dnslens import queries as Q

    plan = Q.QUERIES["decoded_flat_json"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_only_labels_that_a_rule_reads_are_made(spark):
    """Of the flat view's fields those that no rule reads aren't made; rules see what they saw of the whole view."""
    from dnslens.functions import payloads

    log = X.with_records(X.dns_log(spark, "/root/testdata/sf0.001")).limit(40)
    named = [{"source_labels": ["__dns_rcode"], "target_label": "rcode"}, {"action": "dropequal", "source_labels": ["rcode"], "target_label": "__dns_qtype"}]
    assert {k for r in log.select(payloads._hidden(log, named).alias("m")).collect() for k in r.m} == {"__dns_rcode", "__dns_qtype"}
    whole = F.transform_keys(normalize.flat_map(log), lambda k, v: F.concat(F.lit("__"), F.replace(k, F.lit("."), F.lit("_"))))
    for rules in (named, [{"action": "labelmap", "regex": "__dns_(q.*|resource-records_an_0_.*)"}], [{"source_labels": ["__edns_options_0_name"], "target_label": "option"}], [{"target_label": "a", "replacement": "b"}, {"action": "labelkeep", "regex": "a|job"}]):
        made = [F.map_filter(payloads.relabel(F.map_concat(F.create_map(F.lit("job"), F.lit("j")), m), rules), lambda k, v: ~k.startswith("__")) for m in (payloads._hidden(log, rules), whole)]
        rows = log.select(*(x.alias(n) for n, x in zip("xy", made, strict=True))).collect()
        assert rows and all(r.x == r.y for r in rows)


def test_only_different_addresses_are_read(spark):
    """No test of an address is moved from the different ones to all rows, before or after the join."""
    df = spark.range(0, 1000, 1, 4).select(F.concat(F.lit("2001:db8::"), F.hex(F.col("id") % 5)).alias("ip"))
    found = lookup.ip_in_set(df, "ip", spark.createDataFrame([("2001:db8::/127",)], "cidr string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ip_bytes" not in plan and "regexp" not in plan
    assert found.count() == 400
