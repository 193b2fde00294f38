"""Text templates as one Column: values with filters, conditions and loops over lists of the nested record.

    {{ dns.qname | upper }} {% if dns.rcode == "NOERROR" %}ok{% else %}failed{% endif %}
    {% for rr in dns.resource-records.an %}{{ forloop.Counter }} {{ rr.rdata }}{% endfor %}

Field names are compared without case, hyphens and underscores, so `dm.NetworkInfo.QueryIP` and `network.query-ip` are the
same field. A field that isn't there is empty and false. Text is escaped for HTML unless it is `safe` or autoescape is off.
The template becomes built-in functions when the plan is built: a row costs no parsing and no Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Other names of sections and fields.
ALIASES = {
    "networkinfo": "network",
    "dnsrrs": "resourcerecords",
    "answers": "an",
    "nameservers": "ns",
    "records": "ar",
    "timestamp": "timestamprfc3339ns",
}
#: Counts of the lists of records.
COUNTS = {"ancount": "an", "nscount": "ns", "arcount": "ar"}


class Value(NamedTuple):
    column: Column
    kind: T.DataType
    safe: bool = False


NOTHING = Value(None, T.NullType())


def _is(v: Value, *kinds: type) -> bool:
    return isinstance(v.kind, kinds)


def as_text(v: Value) -> Column:
    """Numbers with a point get six decimals, booleans are True and False, lists are joined by commas, nothing is empty."""
    if _is(v, T.NullType):
        return F.lit("")
    if _is(v, T.DoubleType, T.FloatType):
        out = F.format_string("%.6f", v.column)
    elif _is(v, T.BooleanType):
        out = F.initcap(v.column.cast("string"))
    elif _is(v, T.ArrayType):
        out = F.array_join(v.column.cast("array<string>"), ",")
    elif _is(v, T.StructType):
        out = F.to_json(v.column)
    else:
        out = v.column.cast("string")
    return F.coalesce(out, F.lit(""))


def as_truth(v: Value) -> Column:
    """Zero, empty texts and lists, and nothing are false."""
    if _is(v, T.NullType):
        return F.lit(False)
    if _is(v, T.BooleanType):
        out = v.column
    elif _is(v, T.NumericType):
        out = v.column != 0
    elif _is(v, T.ArrayType):
        out = F.size(v.column) > 0
    else:
        out = as_text(v) != ""
    return F.coalesce(out, F.lit(False))


def _bare(name: str) -> str:
    name = re.sub("[-_]", "", name.lower())
    return ALIASES.get(name, name)


def _field(v: Value, name: str) -> Value:
    if not _is(v, T.StructType):
        return NOTHING
    names = {_bare(n): n for n in v.kind.names}
    if (found := names.get(_bare(name))) is not None:
        return Value(v.column.getField(found), v.kind[found].dataType)
    if (listed := names.get(COUNTS.get(_bare(name)))) is not None:
        return Value(F.size(v.column.getField(listed)), T.LongType())
    if _bare(name) == "type" and "flags" in names:  # the kind of message, which the record has as a flag
        return Value(F.when(v.column.getField("flags").getField("qr"), F.lit("REPLY")).otherwise(F.lit("QUERY")), T.StringType())
    return NOTHING


def _walk(v: Value, names: list[str]) -> Value:
    for k, name in enumerate(names):
        if not _is(v, T.ArrayType):
            v = _field(v, name)
        elif name.isdigit():
            v = Value(F.get(v.column, int(name)), v.kind.elementType)
        elif name == "*":
            kinds: list[T.DataType] = []
            element = v.kind.elementType

            def rest(x: Column) -> Column:
                got = _walk(Value(x, element), names[k + 1 :])
                kinds.append(got.kind)
                return F.lit(None) if isinstance(got.kind, T.NullType) else got.column

            out = F.transform(v.column, rest)
            return Value(out, T.ArrayType(kinds[0]))
        else:
            return NOTHING
    return v


def _size(v: Value) -> Column:
    return F.coalesce(F.size(v.column) if _is(v, T.ArrayType) else F.length(as_text(v)), F.lit(0))


def _text(make: Callable[[Column, str], Column]) -> Callable:
    return lambda v, arg: Value(make(as_text(v), arg), T.StringType(), v.safe)


def _yesno(v: Value, arg: str) -> Value:
    words = (arg or "yes,no,maybe").split(",")
    unknown = words[2] if len(words) > 2 else words[1]
    if _is(v, T.NullType):
        return Value(F.lit(unknown), T.StringType())
    return Value(F.when(v.column.isNull(), F.lit(unknown)).when(as_truth(v), F.lit(words[0])).otherwise(F.lit(words[1])), T.StringType())


def _edge(v: Value, last: bool) -> Value:
    if _is(v, T.ArrayType):
        return Value(F.try_element_at(v.column, F.lit(-1 if last else 1)), v.kind.elementType)
    return Value(F.right(as_text(v), F.lit(1)) if last else F.left(as_text(v), F.lit(1)), T.StringType(), v.safe)


def _add(v: Value, arg: str) -> Value:
    if _is(v, T.NumericType):
        return Value(v.column + F.lit(float(arg) if "." in arg else int(arg)), T.DoubleType() if "." in arg else v.kind)
    return Value(F.concat(as_text(v), F.lit(arg)), T.StringType(), v.safe)


def _escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


FILTERS: dict[str, Callable[[Value, str], Value]] = {
    "upper": _text(lambda t, a: F.upper(t)),
    "lower": _text(lambda t, a: F.lower(t)),
    "capfirst": _text(lambda t, a: F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 1 << 30))),
    "title": _text(lambda t, a: F.initcap(t)),
    "cut": _text(lambda t, a: F.replace(t, F.lit(a), F.lit(""))),
    "truncatechars": _text(lambda t, a: F.when(F.length(t) > int(a), F.concat(F.left(t, F.lit(max(0, int(a) - 3))), F.lit("..."))).otherwise(t)),
    "ljust": _text(lambda t, a: F.when(F.length(t) < int(a), F.rpad(t, int(a), " ")).otherwise(t)),
    "rjust": _text(lambda t, a: F.when(F.length(t) < int(a), F.lpad(t, int(a), " ")).otherwise(t)),
    "floatformat": lambda v, a: Value(F.format_string(f"%.{int(a or 1)}f", as_text(v).try_cast("double")), T.StringType()),
    "length": lambda v, a: Value(_size(v), T.LongType()),
    "first": lambda v, a: _edge(v, False),
    "last": lambda v, a: _edge(v, True),
    "join": lambda v, a: Value(F.array_join(v.column.cast("array<string>"), a) if _is(v, T.ArrayType) else as_text(v), T.StringType()),
    "default": lambda v, a: Value(F.when(as_truth(v), as_text(v)).otherwise(F.lit(a)), T.StringType()),
    "default_if_none": lambda v, a: Value(F.lit(a), T.StringType()) if _is(v, T.NullType) else Value(F.when(v.column.isNull(), F.lit(a)).otherwise(as_text(v)), T.StringType()),
    "yesno": _yesno,
    "add": _add,
    "safe": lambda v, a: v._replace(safe=True),
    "escape": lambda v, a: Value(_escape(as_text(v)), T.StringType(), True),
}

_PIECES = re.compile(r"\{\{(?P<value>.*?)\}\}|\{%(?P<tag>.*?)%\}|\{#.*?#\}", re.S)
_WORDS = re.compile(r'"[^"]*"|\'[^\']*\'|[=!<>]=|[<>|:]|[\w.*+-]+')
_COMPARE = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def _operand(words: list[str], names: dict[str, Value]) -> Value:
    """A literal or field with its filters; takes its words from the front of the list."""
    if not words:
        raise ValueError("a value is missing")
    word = words.pop(0)
    if word[0] in "\"'":
        out = Value(F.lit(word[1:-1]), T.StringType(), True)
    elif re.fullmatch(r"[+-]?\d+", word):
        out = Value(F.lit(int(word)), T.LongType())
    elif re.fullmatch(r"[+-]?\d+\.\d+", word):
        out = Value(F.lit(float(word)), T.DoubleType())
    elif word.lower() in ("true", "false"):
        out = Value(F.lit(word.lower() == "true"), T.BooleanType())
    else:
        head, *rest = word.split(".")
        if head == "dm" and rest:
            head, *rest = rest
        out = _walk(names[head], rest) if head in names else _walk(_field(names[""], head), rest)
    while words and words[0] == "|":
        name, arg = words[1], ""
        del words[:2]
        if words and words[0] == ":":
            arg = words[1].strip("\"'")
            del words[:2]
        if name not in FILTERS:
            raise ValueError(f"unknown filter {name}")
        out = FILTERS[name](out, arg)
    return out


def _comparison(words: list[str], names: dict[str, Value]) -> Column:
    if words and words[0] == "not":
        words.pop(0)
        return ~_comparison(words, names)
    left = _operand(words, names)
    if not words or words[0] not in _COMPARE:
        return as_truth(left)
    compare = _COMPARE[words.pop(0)]
    right = _operand(words, names)
    if _is(left, T.NumericType) and _is(right, T.NumericType) or _is(left, T.BooleanType) and _is(right, T.BooleanType):
        return F.coalesce(compare(left.column, right.column), F.lit(False))
    return compare(as_text(left), as_text(right))


def _condition(words: list[str], names: dict[str, Value]) -> Column:
    """`and` binds more closely than `or`."""
    any_of, all_of = [], [_comparison(words, names)]
    while words:
        joint = words.pop(0)
        if joint not in ("and", "or"):
            raise ValueError(f"{joint}: not and, not or")
        if joint == "or":
            any_of.append(all_of)
            all_of = []
        all_of.append(_comparison(words, names))
    out = F.lit(False)
    for group in [*any_of, all_of]:
        each = F.lit(True)
        for c in group:
            each = each & c
        out = out | each
    return out


def _body(pieces: list, names: dict[str, Value], escaped: bool, ends: tuple[str, ...]) -> tuple[Column, list[str]]:
    """Text of the pieces up to one of the closing tags, and that tag; takes its pieces from the front of the list."""
    parts = [F.lit("")]
    while pieces:
        kind, text = pieces.pop(0)
        words = _WORDS.findall(text) if kind != "text" else []
        if kind == "text":
            parts.append(F.lit(text))
        elif kind == "value":
            got = _operand(words, names)
            plain = not escaped or got.safe or not _is(got, T.StringType, T.ArrayType, T.StructType)
            parts.append(as_text(got) if plain else _escape(as_text(got)))
        elif words and words[0] in ends:
            return F.concat(*parts), words
        elif words and words[0] == "if":
            cases, tag = [], words
            while tag[0] in ("if", "elif"):
                test = _condition(tag[1:], names)
                inner, tag = _body(pieces, names, escaped, ("elif", "else", "endif"))
                cases.append((test, inner))
            other = _body(pieces, names, escaped, ("endif",))[0] if tag[0] == "else" else F.lit("")
            for test, inner in reversed(cases):
                other = F.when(test, inner).otherwise(other)
            parts.append(other)
        elif len(words) >= 4 and words[0] == "for" and words[2] == "in":
            parts.append(_loop(pieces, words[1], _operand(words[3:], names), names, escaped))
        else:
            raise ValueError(f"unknown tag {text.strip()}")
    if ends:
        raise ValueError(f"{ends[-1]} is missing")
    return F.concat(*parts), []


def _loop(pieces: list, name: str, over: Value, names: dict[str, Value], escaped: bool) -> Column:
    here = list(pieces)

    def each(x: Column, i: Column) -> Column:
        at = F.struct((i + 1).alias("Counter"), i.alias("Counter0"), (i == 0).alias("First"))
        kind = T.StructType().add("Counter", T.IntegerType()).add("Counter0", T.IntegerType()).add("First", T.BooleanType())
        element = over.kind.elementType if _is(over, T.ArrayType) else T.NullType()
        own = {**names, name: Value(x, element) if _is(over, T.ArrayType) else NOTHING, "forloop": Value(at, kind)}
        pieces[:] = here
        return _body(pieces, own, escaped, ("endfor",))[0]

    if not _is(over, T.ArrayType):  # nothing to go through: only the place of endfor counts
        each(F.lit(None), F.lit(0))
        return F.lit("")
    return F.coalesce(F.array_join(F.transform(over.column, each), ""), F.lit(""))


def template_line(nested: DataFrame, template: str, autoescape: bool = True) -> Column:
    """The text of a row of the nested record. Unknown tags and filters are errors when the plan is built."""
    pieces, at = [], 0
    for m in _PIECES.finditer(template):
        pieces += [("text", template[at : m.start()])] if m.start() > at else []
        if m.lastgroup:
            pieces.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    pieces += [("text", template[at:])] if at < len(template) else []
    row = F.struct(*(F.col(f"`{c}`") for c in nested.columns))
    return _body(pieces, {"": Value(row, nested.schema)}, autoescape, ())[0]
