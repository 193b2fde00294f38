"""Lookups: public suffixes, address ranges, places.

Suffix rules and ranges are reference tables: they are small, but Spark decides by their size whether to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens.functions.ip import ip_bytes, network_bits, v4_number
from dnslens.plans.shared import stored


def suffixes(df: DataFrame, psl: DataFrame, name: Column, icann_only: bool = False) -> DataFrame:
    """__name, __suffix, __icann of every different name: the longest rule that fits; exceptions win and lose a label.

    Names are reduced to distinct ones first, so a hot name is looked up once.
    """
    names = df.select(name.alias("__name")).where("__name is not null").distinct()
    labels = F.split("__name", r"\.")
    tails = names.select("__name", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("__tail"))
    wild = F.when(F.instr("__tail", ".") > 0, F.expr("substring(__tail, instr(__tail, '.') + 1)"))
    rules = psl.where("icann") if icann_only else psl
    plain, star = rules.where("kind <> 'wildcard'"), rules.where("kind = 'wildcard'")
    found = tails.join(plain, F.col("__tail") == F.col("rule")).select("__name", F.when(F.col("kind") == "exception", F.expr("substring(__tail, instr(__tail, '.') + 1)")).otherwise(F.col("__tail")).alias("__suffix"), (F.col("kind") == "exception").alias("__first"), "icann")
    found = found.unionByName(tails.withColumn("__wild", wild).join(star, F.col("__wild") == F.col("rule")).select("__name", F.col("__tail").alias("__suffix"), F.lit(False).alias("__first"), "icann"))
    best = found.groupBy("__name").agg(F.max_by(F.struct("__suffix", "icann"), F.struct("__first", F.length("__suffix"))).alias("b"))
    return best.select("__name", F.col("b.__suffix").alias("__suffix"), F.col("b.icann").alias("__icann"))


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\.$", "")


def add_tld(df: DataFrame, psl: DataFrame) -> DataFrame:
    """tld and managed_icann of the name in lower case without a final dot; a private suffix gives - and false."""
    found = suffixes(df, psl, _clean(F.col("qname")))
    out = df.withColumn("__k", _clean(F.col("qname"))).join(found, F.col("__k") == F.col("__name"), "left")
    icann = F.coalesce("__icann", F.lit(False))
    return out.withColumns({"tld": F.when(icann, F.col("__suffix")).otherwise("-"), "managed_icann": icann}).drop("__k", "__name", "__suffix", "__icann")


def registrable(df: DataFrame, psl: DataFrame, name: Column, alias: str) -> DataFrame:
    """alias: the suffix and one label more, null if there is none."""
    found = suffixes(df, psl, name)
    out = df.withColumn("__k", name).join(found, F.col("__k") == F.col("__name"), "left")
    n = F.size(F.split("__suffix", r"\.")) + 1
    domain = F.when(F.size(F.split("__k", r"\.")) >= n, F.expr("substring_index(__k, '.', -(size(split(__suffix, '[.]')) + 1))"))
    return out.withColumn(alias, domain).drop("__k", "__name", "__suffix", "__icann")


def add_tld_plus_one(df: DataFrame, psl: DataFrame) -> DataFrame:
    """etld_plus_one of the cleaned name, for public and private suffixes; - if there is none."""
    return registrable(df, psl, _clean(F.col("qname")), "etld_plus_one").fillna("-", ["etld_plus_one"])


def network_table(ranges: DataFrame) -> DataFrame:
    """cidr, family, hi, lo, bits of the different networks of a table: the 128 bits of the network's address (IPv4 in the low 32).

    Texts that are no network are skipped; host bits are cleared.
    """
    return ranges.select("cidr").distinct().withColumn("n", network_bits("cidr")).where("n IS NOT NULL").select("cidr", "n.*")


def _masked(family: Column, hi: Column, lo: Column, bits: Column) -> Column:
    """family, bits and the address without what follows its first `bits` bits, as one struct to join on."""
    first = F.lit(64) - F.least(bits, F.lit(64))
    last = F.when(family == 4, F.lit(32) - bits).otherwise(F.lit(128) - F.greatest(bits, F.lit(64)))
    high = F.when(family == 4, F.lit(0)).otherwise(_cleared(hi, first))
    return F.struct(family.alias("family"), bits.alias("bits"), high.cast("long").alias("hi"), _cleared(lo, last).alias("lo"))


def _cleared(x: Column, n: Column) -> Column:
    """A 64-bit number whose n lowest bits are cleared, for n from 0 to 64."""
    half = F.call_function("shiftleft", F.call_function("shiftright", x, F.least(n, F.lit(63))), F.least(n, F.lit(63)))
    return F.when(n >= 64, F.lit(0).cast("long")).otherwise(half)


def _places(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """__ip, cidr: the network with the longest prefix of each address of ips (one column, __ip) that is in one.

    Addresses are cut to each prefix length that the table has for their family (162 at most: one small row), and joined
    with networks by equality of the cut address: a shuffled join where the table is large. Only IPv6 texts are read in Python.
    Of two texts of one network the last in order counts. Addresses are stored before and after: tests of an address would else be
    moved ahead of distinct(), and across the join with the places, to every row.
    """
    ips = stored(ips, "addresses")
    nets = network_table(ranges)
    lengths = nets.groupBy("family").agg(F.collect_set("bits").alias("__lengths"))
    keyed = nets.select("cidr", _masked(F.col("family"), F.col("hi"), F.col("lo"), F.col("bits")).alias("__key"))
    four = ips.withColumn("__n", v4_number(F.col("__ip"))).where("__n IS NOT NULL").select("__ip", F.lit(4).alias("family"), F.lit(0).cast("long").alias("hi"), F.col("__n").alias("lo"))
    bits = F.hex(ip_bytes(F.col("__ip")))
    six = ips.where(F.col("__ip").contains(":")).withColumn("__h", bits).where("__h IS NOT NULL").select("__ip", F.lit(6).alias("family"), _half(F.col("__h"), 1).alias("hi"), _half(F.col("__h"), 17).alias("lo"))
    cut = four.unionByName(six).join(F.broadcast(lengths), "family").withColumn("bits", F.explode("__lengths"))  # two rows
    cut = cut.select("__ip", "bits", _masked(F.col("family"), F.col("hi"), F.col("lo"), F.col("bits")).alias("__key"))
    found = cut.join(keyed, "__key")
    return stored(found.groupBy("__ip").agg(F.max_by("cidr", F.struct("bits", "cidr")).alias("cidr")), "places")


def _half(h: Column, at: int) -> Column:
    """16 hexadecimal digits as a signed 64-bit number."""
    part = lambda k: F.conv(F.substring(h, at + k, 8), 16, 10).cast("long")
    return F.shiftleft(part(0), 32).bitwiseOR(part(8))


def ip_range_lookup(df: DataFrame, column: str, ranges: DataFrame) -> DataFrame:
    """The most specific network of each address of either family, with the range's columns (null if none).

    Only different addresses are looked up.
    """
    found = _places(df.select(F.col(column).alias("__ip")).distinct(), ranges)
    return df.join(found.join(ranges, "cidr"), F.col(column) == F.col("__ip"), "left").drop("__ip")


def ip_in_set(df: DataFrame, column: str, networks: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose address is (left_semi) or isn't (left_anti) in a table of networks (cidr) of either family.

    An invalid or null address is in none. Different addresses are looked up once; each has one most specific network.
    """
    found = _places(df.select(F.col(column).alias("__ip")).distinct(), networks).select("__ip")
    return df.join(found, F.col(column) == F.col("__ip"), how)


#: An IPv6 address in groups of hexadecimal digits, with at most one `::`, or a last part in IPv4's form.
_V6 = r"(?i)^(?!.*::.*::)(?!.*:::)(?!:[^:])(?!.*[^:]:$)(?:[0-9a-f]{0,4}:){2,8}(?:[0-9a-f]{0,4}|\d{1,3}(?:\.\d{1,3}){3})$"


def client_subnet(options: Column) -> Column:
    """The address of the first client subnet (option 8) that has a valid one, of either family and with or without brackets; else null."""
    address = lambda o: F.regexp_replace(F.substring_index(o["data"], "/", 1), r"[\[\]]", "")
    groups = lambda a: F.size(F.array_remove(F.split(a, ":"), "")) + F.when(a.contains("."), 1).otherwise(0)
    whole = lambda a: F.when(a.contains("::"), groups(a) <= 7).otherwise(groups(a) == 8)
    tail = lambda a: ~a.contains(".") | v4_number(F.substring_index(a, ":", -1)).isNotNull()
    valid = lambda a: v4_number(a).isNotNull() | (a.rlike(_V6) & whole(a) & tail(a))
    return F.get(F.filter(F.transform(F.filter(options, lambda o: o["code"] == 8), address), valid), 0)


def geoip(df: DataFrame, ranges: DataFrame, lookup_ecs: bool = False) -> DataFrame:
    """geo_country, geo_continent, geo_city, geo_asn, geo_owner of the client (or of the first valid client subnet)."""
    ip = F.col("query_ip")
    if lookup_ecs:
        ip = F.coalesce(client_subnet(F.col("options")), ip)
    out = ip_range_lookup(df.withColumn("__geo", ip), "__geo", ranges)
    for new, old in (("geo_country", "country"), ("geo_continent", "continent"), ("geo_city", "city"), ("geo_asn", "asn"), ("geo_owner", "as_owner")):
        out = out.withColumn(new, F.coalesce(F.col(old).cast("string"), F.lit("-")))
    return out.drop("__geo", "cidr", "country", "continent", "city", "asn", "as_owner")


def search(df: DataFrame, x: str) -> DataFrame:
    """key, hit: the domains of client x if there is such a client, else the clients of domain x."""
    clients = df.where(F.col("query_ip") == x).groupBy(F.col("qname").alias("key")).agg(F.count("*").alias("hit"))
    domains = df.where(F.col("qname") == x).groupBy(F.col("query_ip").alias("key")).agg(F.count("*").alias("hit"))
    any_client = df.where(F.col("query_ip") == x).select(F.lit(1).alias("one")).limit(1)
    return clients.unionByName(domains.join(any_client, how="left_anti"))
