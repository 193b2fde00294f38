"""Projections: names, short codes, tags, constants, flat view, relabeling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnslens import schema as S


def qname_lowercase(df: DataFrame) -> DataFrame:
    return df.withColumn("qname", F.lower("qname"))


def rr_lowercase(df: DataFrame, column: str = "answers") -> DataFrame:
    """Record names in lower case; rdata too where it is a name."""
    names = ["CNAME", "SOA", "NS", "MX", "PTR", "SRV"]
    rdata = lambda r: F.when(r["rdatatype"].isin(names), F.lower(r["rdata"])).otherwise(r["rdata"])
    return df.withColumn(column, F.transform(column, lambda r: F.struct(F.lower(r["name"]).alias("name"), r["rdatatype"].alias("rdatatype"), r["class"].alias("class"), r["ttl"].alias("ttl"), rdata(r).alias("rdata"))))


def replace_nonprintable(df: DataFrame, column: str = "qname") -> DataFrame:
    r"""White space and what can't be printed becomes \DDD, the code point in three digits."""
    odd = lambda c: F.when(c.rlike(r"[\p{C}\p{Z}]"), F.format_string("\\%03d", F.ascii(c))).otherwise(c)
    return df.withColumn(column, F.when(F.col(column).rlike(r"[\p{C}\p{Z}]"), F.array_join(F.transform(F.split(column, ""), odd), "")).otherwise(F.col(column)))


def quiet_text(df: DataFrame) -> DataFrame:
    """Short codes for operation, type, family and rcode. For output only: filters and metrics test the long names."""
    out = df
    for name, table in (("operation", S.OPERATION_CODES), ("dns_type", S.TYPE_CODES), ("family", S.FAMILY_CODES), ("rcode", S.RCODE_CODES)):
        out = out.withColumn(name, S.lookup(table, F.col(name), F.col(name)))
    return out


def add_tags(df: DataFrame, tags: list[str]) -> DataFrame:
    old = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in df.columns else F.array().cast("array<string>")
    return df.withColumn("tags", F.concat(old, F.array(*map(F.lit, tags))))


def extract_payload(df: DataFrame, column: str = "payload") -> DataFrame:
    return df.withColumn("dns_payload", F.base64(column))


def rewrite(df: DataFrame, values: dict[str, str | int]) -> DataFrame:
    """Fields set to constants. An unknown field or a value of another kind is an error; other kinds of fields stay."""
    out = df
    for name, value in values.items():
        if name not in df.columns:
            raise ValueError(f"no field {name}")
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType) != isinstance(value, str) and isinstance(kind, (T.StringType, T.IntegralType)):
            raise ValueError(f"{name}: {value!r} doesn't fit {kind.simpleString()}")
        if isinstance(kind, (T.StringType, T.IntegralType)):
            out = out.withColumn(name, F.lit(value).cast(kind))
    return out


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def _numbered(key: str, column: str, fields: tuple[str, ...]) -> Column:
    """Entries `key.0.field` of a list of records; `key` with - if it has none."""
    entry = lambda r, i: F.array(*(F.struct(F.concat(F.lit(f"{key}."), i.cast("string"), F.lit(f".{f}")).alias("key"), _text(r[f]).alias("value")) for f in fields))
    return F.when(F.coalesce(F.size(column), F.lit(0)) > 0, F.flatten(F.transform(column, entry))).otherwise(_unset(key))


def _unset(key: str) -> Column:
    return F.array(F.struct(F.lit(key).alias("key"), F.lit("-").alias("value")))


def flat_parts(df: DataFrame) -> tuple[dict[str, Column], list[Column]]:
    """The flat view: the keys that every row has, and arrays of the entries whose keys have numbers."""
    from dnslens.functions.text import number_text, rfc3339

    pairs = {k: _text(S.value(df, k)) for k in S.FLAT_UNSET if k not in S.LISTS}
    pairs |= {k: _text(F.col(c)) for k, c in S.FLAT_KEYS.items()} | {"dnstap.timestamp-rfc3339ns": rfc3339(F.col("ts_ns"))}
    pairs["dnstap.latency"] = number_text(S.value(df, "dnstap.latency")) if "latency" in df.columns else F.lit("0")
    more = S.sections(df)
    tags = more.pop("atags", None)
    pairs |= {f"{name}.{k}": _text(F.col(c)) for name, fields in more.items() for k, c in fields.items()}
    lists = {key: S.list_column(df, key) for key in S.LISTS}
    pairs |= {key: F.lit("-") for key, column in lists.items() if column is None}
    entries = [_numbered(key, column, S.list_fields(key)) for key, column in lists.items() if column]
    if tags:
        tag = lambda t, i: F.struct(F.concat(F.lit("atags.tags."), i.cast("string")).alias("key"), t.alias("value"))
        entries.append(F.when(F.coalesce(F.size("tags"), F.lit(0)) > 0, F.transform("tags", tag)).otherwise(_unset("atags.tags")))
    return pairs, entries


def map_of_parts(pairs: dict[str, Column], entries: list[Column]) -> Column:
    """One map, whose keys are checked once."""
    keys, values = F.array(*map(F.lit, sorted(pairs))), F.array(*(pairs[k] for k in sorted(pairs)))
    get = lambda field: [F.transform(e, lambda x: x[field]) for e in entries]
    return F.map_from_arrays(F.concat(keys, *get("key")), F.concat(values, *get("value")))


def flat_map(df: DataFrame) -> Column:
    """The record of a flat row as a map of dotted keys to text; records, options and tags get numbered keys."""
    return map_of_parts(*flat_parts(df))


def flatten(df: DataFrame, remove: list[str] | None = None, rename: list[tuple[str, str]] | None = None) -> DataFrame:
    """msg_id, flat. remove and rename are rules as in relabel_remove and relabel_rename, in this order.

    Given here, rules are matched with the keys that every row has when the plan is built; only numbered keys are matched row by row.
    """
    pairs, entries = flat_parts(df)
    if not remove and not rename:
        return df.select("msg_id", map_of_parts(pairs, entries).alias("flat"))
    rows = df.withColumn("__entries", F.concat(*entries) if entries else F.array().cast("array<struct<key:string,value:string>>"))
    entry = F.col("__entries")
    java = df.sparkSession._jvm.java.util.regex.Pattern  # what rlike matches by
    for pattern in remove or []:
        rule = java.compile(pattern)
        pairs = {k: v for k, v in pairs.items() if not rule.matcher(k).find()}
        rows = rows.withColumn("__entries", F.filter("__entries", _not_like(pattern)))
    for number, (pattern, name) in enumerate(rename or []):
        rule = java.compile(pattern)
        mine = [k for k in sorted(pairs) if rule.matcher(k).find()]
        hits = f"__hits{number}"
        rows = rows.withColumn(hits, F.filter("__entries", _key_like(pattern)))
        own = F.array(*(F.struct(F.lit(k).alias("key"), pairs[k].alias("value")) for k in mine))
        both = F.transform(F.array_sort(F.concat(own, hits) if mine else F.col(hits)), lambda e: e["value"])
        plain = pairs[mine[0]] if len(mine) == 1 else F.concat(F.lit("["), F.concat_ws(",", *(pairs[k] for k in mine)), F.lit("]"))
        found = F.size(hits) > 0
        joined = F.when(found, F.when(F.size(both) == 1, F.get(both, 0)).otherwise(F.concat(F.lit("["), F.array_join(both, ","), F.lit("]"))))
        old = pairs.get(name)
        pairs = {k: v for k, v in pairs.items() if k not in mine}
        rest = F.filter("__entries", _not_like(pattern, name))
        if mine:
            pairs[name] = joined.otherwise(plain)
            rows = rows.withColumn("__entries", rest)
        elif old is not None:
            pairs[name] = joined.otherwise(old)
            rows = rows.withColumn("__entries", F.when(found, rest).otherwise(entry))
        else:
            rows = rows.withColumn("__entries", F.when(found, F.concat(rest, F.array(F.struct(F.lit(name).alias("key"), joined.alias("value"))))).otherwise(entry))
    return rows.select("msg_id", map_of_parts(pairs, [entry]).alias("flat"))


def _not_like(pattern: str, name: str | None = None):
    return lambda e: ~e["key"].rlike(pattern) & (F.lit(True) if name is None else e["key"] != name)


def _key_like(pattern: str):
    return lambda e: e["key"].rlike(pattern)


def _unlike(pattern: str, name: str | None = None):
    return lambda k, v: ~k.rlike(pattern) & (F.lit(True) if name is None else k != name)


def relabel_remove(flat: DataFrame, patterns: list[str]) -> DataFrame:
    """Keys that a pattern finds (anywhere in them) go."""
    out = flat
    for p in patterns:
        out = out.withColumn("flat", F.map_filter("flat", _unlike(p)))
    return out


def _rename(pattern: str, name: str):
    def rule(m: Column) -> Column:
        hits = F.transform(F.array_sort(F.filter(F.map_entries(m), _key_like(pattern))), lambda e: e["value"])
        joined = lambda v: F.when(F.size(v) == 1, F.get(v, 0)).otherwise(F.concat(F.lit("["), F.array_join(v, ","), F.lit("]")))
        renamed = lambda v: F.when(F.size(v) > 0, F.map_concat(F.map_filter(m, _unlike(pattern, name)), F.create_map(F.lit(name), joined(v)))).otherwise(m)
        return F.get(F.transform(F.array(hits), renamed), 0)

    return rule


def relabel_rename(flat: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Keys that a pattern finds get a new name; values that meet under one name are joined in key order as a list.

    Works inside the row's map: no shuffle. Each rule names the map in a lambda, and its hits, so that both are made once.
    """
    out = flat
    for pattern, name in rules:
        out = out.withColumn("flat", F.get(F.transform(F.array("flat"), _rename(pattern, name)), 0))
    return out


def explode_records(df: DataFrame, sections: dict[str, str] | None = None) -> DataFrame:
    """One row per resource record: msg_id, section, idx, and the record's fields. The rows of df are read once for all sections."""
    parts = (sections or {"an": "answers"}).items()
    if len(parts) == 1:
        ((section, column),) = parts
        return df.select("msg_id", F.lit(section).alias("section"), F.posexplode(column).alias("idx", "r")).select("msg_id", "section", F.col("idx").cast("long").alias("idx"), "r.*")
    lists = [F.struct(F.lit(section).alias("section"), F.col(column).alias("records")) for section, column in parts]
    rows = df.select("msg_id", F.inline(F.array(*lists)))
    return rows.select("msg_id", "section", F.posexplode("records").alias("idx", "r")).select("msg_id", "section", F.col("idx").cast("long").alias("idx"), "r.*")


def fix_operation(df: DataFrame) -> DataFrame:
    """Opcode 5 makes an operation an update; only replies keep an rcode."""
    out = df.withColumn("operation", F.when(F.col("opcode") == 5, F.when(F.col("dns_type") == "REPLY", "UPDATE_RESPONSE").otherwise("UPDATE_QUERY")).otherwise(F.col("operation")))
    return out.withColumn("rcode", F.when(F.col("dns_type") == "REPLY", F.col("rcode")).otherwise("-"))
