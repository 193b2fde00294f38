"""DNS packets: the header by Column expressions, everything else in Arrow batches.

A packet that ends early or breaks a rule is malformed and keeps what was read before.
"""

from __future__ import annotations

import ipaddress
import itertools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dnslens import schema as S

RECORD = "struct<name:string,rdatatype:string,class:string,ttl:long,rdata:string>"
DECODED = f"msg_id long, dns_id long, qr boolean, opcode long, rcode string, qname string, qtype string, qclass string, an array<{RECORD}>, ns array<{RECORD}>, ar array<{RECORD}>, edns_udp_size long, edns_rcode long, edns_version long, edns_do long, options array<struct<code:long,name:string,data:string>>, malformed boolean, flag_aa boolean, flag_tc boolean, flag_rd boolean, flag_ra boolean, flag_ad boolean, flag_cd boolean, qdcount long, ancount long, nscount long, arcount long"
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_ARROW["array<" + RECORD + ">"] = pa.list_(pa.struct([("name", pa.string()), ("rdatatype", pa.string()), ("class", pa.string()), ("ttl", pa.int64()), ("rdata", pa.string())]))
_ARROW["array<struct<code:long,name:string,data:string>>"] = pa.list_(pa.struct([("code", pa.int64()), ("name", pa.string()), ("data", pa.string())]))
#: The columns of DECODED after msg_id.
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split(" ") for x in DECODED.split(", ")[1:])])
#: Packets that are decoded at once.
ROWS = 4096
#: Header bits of the flags.
_FLAG_BITS = {"flag_aa": 10, "flag_tc": 9, "flag_rd": 8, "flag_ra": 7, "flag_ad": 5, "flag_cd": 4}


def _bits(at: int, n: int = 1) -> Column:
    return F.conv(F.hex(F.substring("payload", at, n)), 16, 10).cast("long")


def decode_header(df: DataFrame) -> DataFrame:
    """The 12 bytes of the header, without Python."""
    flags = _bits(3, 2)
    bit = lambda k: F.shiftright(flags, k).bitwiseAND(F.lit(1)) == 1
    return df.select(
        "msg_id", _bits(1, 2).alias("dns_id"), bit(15).alias("qr"), F.shiftright(flags, 11).bitwiseAND(F.lit(15)).alias("opcode"), bit(10).alias("aa"), bit(9).alias("tc"), bit(8).alias("rd"), bit(7).alias("ra"), bit(6).alias("z"), bit(5).alias("ad"), bit(4).alias("cd"),
        S.lookup(S.RCODES, flags.bitwiseAND(F.lit(15)).cast("int")).alias("rcode"), _bits(5, 2).alias("qdcount"), _bits(7, 2).alias("ancount"), _bits(9, 2).alias("nscount"), _bits(11, 2).alias("arcount"), (F.octet_length("payload") < 12).alias("malformed"),
    )


class Malformed(ValueError):
    pass


def read_name(p: bytes, at: int) -> tuple[str, int]:
    """A name and where it ends. Pointers must lead backwards; a name has at most 254 characters."""
    labels, end, floor, size = [], None, at, 0
    while True:
        if at >= len(p):
            raise Malformed("name cut off")
        n = p[at]
        if n == 0:
            return ".".join(labels), at + 1 if end is None else end
        if n >= 192:
            if at + 1 >= len(p):
                raise Malformed("pointer cut off")
            to = (n & 63) << 8 | p[at + 1]
            end = at + 2 if end is None else end
            if to >= floor:
                raise Malformed("pointer leads on")
            at = floor = to
        elif n < 64 and at + 1 + n <= len(p):
            labels.append(p[at + 1 : at + 1 + n].decode("utf-8", "replace"))
            size += n + 1
            if size > 254:
                raise Malformed("long name")
            at += 1 + n
        else:
            raise Malformed("bad label")


def _take(p: bytes, at: int, form: str) -> tuple:
    if at + struct.calcsize(form) > len(p):
        raise Malformed("cut off")
    return struct.unpack_from(form, p, at)


def rdata_text(kind: str, p: bytes, at: int, n: int) -> str:
    """The text of a record's data; - for kinds without one."""
    raw = p[at : at + n]
    if kind in ("A", "AAAA"):
        if n != (4 if kind == "A" else 16):
            raise Malformed("bad address")
        return str(ipaddress.ip_address(raw))
    if kind in ("CNAME", "NS", "PTR"):
        return read_name(p, at)[0]
    if kind == "MX":
        return f"{_take(p, at, '>H')[0]} {read_name(p, at + 2)[0]}"
    if kind == "SRV":
        return " ".join([*map(str, _take(p, at, ">HHH")), read_name(p, at + 6)[0]])
    if kind == "TXT":
        out, k = [], 0
        while k < n:
            if k + 1 + raw[k] > n:
                raise Malformed("text cut off")
            out.append(raw[k + 1 : k + 1 + raw[k]].decode("utf-8", "replace"))
            k += 1 + raw[k]
        return "".join(out)
    if kind == "SOA":
        m, k = read_name(p, at)
        r, k = read_name(p, k)
        return " ".join([m, r, *map(str, _take(p, k, ">IIIII"))])
    if kind in ("SVCB", "HTTPS"):
        priority = _take(p, at, ">H")[0]
        target, k = read_name(p, at + 2)
        return " ".join([str(priority), target or ".", *_service(p[k : at + n])])
    return "-"


def _service(raw: bytes) -> list[str]:
    """Parameters of a service binding."""
    names = {0: "mandatory", 1: "alpn", 2: "no-default-alpn", 3: "port", 4: "ipv4hint", 5: "ech", 6: "ipv6hint"}
    out, k = [], 0
    while k < len(raw):
        key, n = _take(raw, k, ">HH")
        v = raw[k + 4 : k + 4 + n]
        if len(v) < n:
            raise Malformed("parameter cut off")
        k += 4 + n
        name = names.get(key, f"key{key}")
        if key == 1:
            ids, j = [], 0
            while j < n:
                ids.append(v[j + 1 : j + 1 + v[j]].decode("utf-8", "replace"))
                j += 1 + v[j]
            out.append(f'{name}="{",".join(ids)}"')
        elif key == 3 and n == 2:
            out.append(f'{name}="{int.from_bytes(v)}"')
        elif key in (4, 6):
            step = 4 if key == 4 else 16
            out.append(f'{name}="{",".join(str(ipaddress.ip_address(v[j : j + step])) for j in range(0, n - step + 1, step))}"')
        else:
            out.append(f'{name}="{v.hex()}"' if n else name)
    return out


def option_text(code: int, v: bytes) -> str:
    """The text of an EDNS option: a client subnet as address/length, an extended error by name, others -."""
    if code == 8:
        family, length, _ = _take(v, 0, ">HBB")
        if family not in (1, 2):
            raise Malformed("subnet family")
        raw = v[4:].ljust(4 if family == 1 else 16, b"\0")
        if len(raw) != (4 if family == 1 else 16):
            raise Malformed("long subnet")
        return f"{ipaddress.ip_address(raw)}/{length}" if family == 1 else f"[{ipaddress.ip_address(raw)}]/{length}"
    if code == 15:
        number = _take(v, 0, ">H")[0]
        name = S.EXTENDED_ERRORS[number] if number < len(S.EXTENDED_ERRORS) else "-"
        return f"{number} {name} {v[2:].decode('utf-8', 'replace') or '-'}"
    return "-"


#: Different questions and option lists that a task remembers, at most.
REMEMBERED = 1 << 15
_HEAD, _RECORD, _QUESTION = struct.Struct(">HHHHHH"), struct.Struct(">HHIH"), struct.Struct(">HH")


def _question(raw: bytes) -> tuple[str, str, str] | None:
    """Name, type and class of a question without a pointer; None for others."""
    at = 0
    while (n := raw[at]) and at + n + 1 < len(raw) - 4:
        if n >= 64:
            return None
        at += n + 1
    if n or at != len(raw) - 5 or at > 254:
        return None
    kind, cls = _QUESTION.unpack_from(raw, at + 1)
    return read_name(raw, 0)[0], S.RDATATYPES.get(kind, "UNKNOWN"), S.CLASSES.get(cls, "UNKNOWN")


def _options(p: bytes, at: int, end: int, out: list[tuple]) -> None:
    """Adds the options of an EDNS record to out."""
    while at < end:
        code, length = _take(p, at, ">HH")
        if at + 4 + length > end:
            raise Malformed("option cut off")
        out.append((code, S.OPTIONS.get(code, "UNKNOWN"), option_text(code, p[at + 4 : at + 4 + length])))
        at += 4 + length


def _sections(p: bytes, known: dict) -> tuple:
    """qname, qtype, qclass, an, ns, ar, EDNS (size, rcode, version, do), options, malformed of a packet.

    known: questions and options that were read before, by their bytes; what they hold doesn't depend on the rest of the packet.
    """
    asked, held, edns, options = ("-", "-", "-"), ([], [], []), None, []
    try:
        if len(p) < 12:
            raise Malformed("cut off")
        _, flags, qd, *counts = _HEAD.unpack_from(p)
        at = 12
        for _ in range(qd):
            end = p.find(b"\0", at) + 5
            raw = p[at:end] if 5 <= end <= len(p) else b""
            found = known.get(raw)
            if found is None and raw and (found := _question(raw)):
                if len(known) >= REMEMBERED:
                    known.clear()
                known[raw] = found
            if found:
                asked, at = found, end
            else:
                name, at = read_name(p, at)
                kind, cls = _take(p, at, ">HH")
                at += 4
                asked = (name, S.RDATATYPES.get(kind, "UNKNOWN"), S.CLASSES.get(cls, "UNKNOWN"))
        first = asked[0] if qd == 1 and found else None  # what a pointer to the question's name means
        for records, n in zip(held, counts, strict=True):
            for _ in range(n):
                if first is not None and p[at : at + 2] == b"\xc0\x0c":
                    name, at = first, at + 2
                else:
                    name, at = read_name(p, at)
                if at + 10 > len(p):
                    raise Malformed("cut off")
                kind, cls, ttl, size = _RECORD.unpack_from(p, at)
                at += 10
                if at + size > len(p):
                    raise Malformed("record cut off")
                if kind == 41:
                    if edns or name:
                        raise Malformed("second OPT, or one with a name")
                    edns = (cls, ttl >> 24 << 4 | flags & 15, ttl >> 16 & 255, ttl >> 15 & 1)
                    raw = (41, p[at : at + size])
                    if (found := known.get(raw)) is None:
                        _options(p, at, at + size, options)
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[raw] = options
                    else:
                        options = found
                else:
                    word = S.RDATATYPES.get(kind, "UNKNOWN")
                    text = "%d.%d.%d.%d" % (*p[at : at + 4],) if kind == 1 and size == 4 else rdata_text(word, p, at, size)
                    records.append((name, word, S.CLASSES.get(cls, "UNKNOWN"), ttl, text))
                at += size
    except (Malformed, IndexError, ValueError):
        return *asked, *held, edns or (0, 0, 0, 0), options, True
    return *asked, *held, edns or (0, 0, 0, 0), options, False


def _lists(rows: tuple, kind: pa.DataType) -> pa.Array:
    """Lists of tuples as lists of structs."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    fields = list(zip(*itertools.chain.from_iterable(rows), strict=True)) or [[]] * kind.value_type.num_fields
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(fields, kind.value_type, strict=True)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(ends), values, type=kind)


def _decoded(payloads: pa.Array, schema: pa.Schema, known: dict) -> list[pa.Array]:
    """The columns of DECODED after msg_id."""
    raw = payloads.to_pylist()
    raw = [x or b"" for x in raw] if payloads.null_count else raw
    head = np.frombuffer(b"".join(x[:12].ljust(12, b"\0") for x in raw), ">u2").reshape(-1, 6).astype(np.int64)
    whole = np.array([len(x) >= 12 for x in raw], bool)
    head[~whole] = 0
    bit = {name: (head[:, 1] >> k & 1).astype(bool) for name, k in (_FLAG_BITS | {"qr": 15}).items()}
    codes = [S.RCODES.get(k, "UNKNOWN") for k in range(16)]
    cols = dict(zip(("qname", "qtype", "qclass", "an", "ns", "ar", "edns", "options", "malformed"), zip(*(_sections(x, known) for x in raw), strict=True), strict=True))
    cols |= dict(zip(("edns_udp_size", "edns_rcode", "edns_version", "edns_do"), zip(*cols["edns"], strict=True), strict=True)) | bit
    cols |= {"dns_id": head[:, 0], "opcode": head[:, 1] >> 11 & 15, "rcode": [codes[k] if w else "-" for k, w in zip((head[:, 1] & 15).tolist(), whole.tolist(), strict=True)]}
    cols |= {name: head[:, k] for k, name in enumerate(("qdcount", "ancount", "nscount", "arcount"), 2)}
    return [_lists(cols[f.name], f.type) if pa.types.is_list(f.type) else pa.array(cols[f.name], f.type) for f in schema]


def decode(p: bytes) -> dict:
    """All that a packet holds, as the columns of DECODED."""
    return pa.RecordBatch.from_arrays(_decoded(pa.array([p], pa.binary()), _SCHEMA, {}), schema=_SCHEMA).to_pylist()[0]


def decode_payload(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """msg_id and DECODED of each payload, and the columns of df to keep."""
    kind = StructType([*StructType.fromDDL(DECODED).fields, *(df.schema[c] for c in keep)])

    def run(batches):
        known: dict = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                columns = [b.column("msg_id"), *_decoded(b.column("payload"), _SCHEMA, known), *(b.column(c) for c in keep)]
                yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return df.select("msg_id", "payload", *keep).mapInArrow(run, kind)
