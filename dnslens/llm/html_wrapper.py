"""HTML extraction by union-free wrappers, inferred for each host.

A page is a stream of block tags and text slots. Runs that repeat fold into `( ... )+`. The streams of a host are aligned
one after another with the wrapper so far: what both have stays, what only one has becomes an optional group `( ... )?`,
and a group meets its own repetition. Every page of a host goes into its wrapper: tasks fold their pages first and send
one wrapper per host, which are merged in two steps, so a host of any size reaches a task as a few short expressions.

The wrapper's text slots decide what is content. A slot is met in the expression below its open containers, after a leaf
tag (its address); a page's text belongs to the slot of its address, and text without a slot isn't content. Slots in menus,
headers, footers, sidebars, notices, adverts, forms and comments aren't content, slots in an article or main container are.
Of the others those are template whose text is the same on DISTINCT different pages, and content those that are mostly
neither short nor linked (in a repeated group less length is asked for). Where a page has content in an article or main
container, only that is taken.

Null html gives an empty text; pages without a url share one wrapper; repeated rows are separate rows; broken and cut-off
markup is read as far as it goes; a page of any length is read whole. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import json
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.llm.common import store

RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAF = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr dt dd option blockquote pre figcaption caption".split())
BOILER_TAGS = frozenset("head nav footer aside form menu select button dialog".split())
MAIN_TAGS = frozenset(("article", "main"))
BOILER_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted reader related replies reply respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_WORDS = frozenset("article content entry main post story".split())
#: Words that tell even above and at an article what it is: a comment, a teaser or an advert.
STRONG_WORDS = frozenset("ad ads advert advertisement advertising comment comments promo promoted reader related replies reply respond sponsor sponsored".split())
#: Leaves that belong to the text around them, however short.
NEAR = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Pairs of items that are aligned by comparing all; longer rows are first cut where both have an item once.
PAIRS = 250_000
#: Tasks' wrappers of one host are merged in so many groups first.
GROUPS = 256
#: A text that is the same on so many different pages is constant.
DISTINCT = 3
#: A text slot in a row: this and its address.
TEXT = "#"


def tokens(page: str):
    """("open", tag, symbol), ("close", tag, ""), ("text", text, ""); comments, scripts and styles are left out."""
    for m in _TOKEN.finditer(page):
        if m["text"]:
            yield "text", m["text"], ""
        elif m["name"]:
            name = m["name"].lower()
            if m["close"]:
                yield "close", name, ""
            else:
                marks = [re.sub(r"\d+", "", next((x for x in a[1:] if x), "")) for a in _ATTR.findall(m["attrs"])] if m["attrs"] else []
                yield "open", name, ".".join([name, *marks])


def events(page: str):
    """("tag", symbol, address), ("text", text, address), ("link", 1 or 0, address).

    An address is the row of open containers and, behind `>`, the last leaf since one of them opened or closed. Containers
    that a page never closes stay open to its end; closing tags without an opening one are ignored.
    """
    stack: list[tuple[str, str]] = []
    path, address = "", ">"
    for kind, name, symbol in tokens(page):
        if kind == "text":
            yield "text", name, address
        elif name == "a":
            yield "link", int(kind == "open"), address
        elif name == "br":
            yield "text", " ", address
        elif name in INLINE:
            continue
        elif name in LEAF or name in VOID:
            if kind == "open":
                address = f"{path}>{symbol}"
            yield "tag", (symbol if kind == "open" else ""), address
        elif kind == "open":
            stack.append((name, symbol))
            path = "/".join(s for _, s in stack)
            address = f"{path}>"
            yield "tag", symbol, address
        else:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                del stack[at:]
                path = "/".join(s for _, s in stack)
                address = f"{path}>"
                yield "tag", f"/{name}", address
            else:
                yield "tag", "", address


def text_slots(items: tuple, repeated: bool = False) -> dict[str, bool]:
    """The addresses of an expression's text slots, and whether one is in a repeated group."""
    found: dict[str, bool] = {}
    for x in items:
        if not isinstance(x, str):
            for address, again in text_slots(x[1], repeated or x[0] == "+").items():
                found[address] = found.get(address, False) or again
        elif x[0] == TEXT:
            found[x[1:]] = found.get(x[1:], False) or repeated
    return found


def fold(row: list) -> tuple:
    """Folds runs that repeat, of any length; a leaf with its text is a run of one."""
    out: list = []
    for x in row:
        out.append(x)
        if x[0] == TEXT and len(out) > 1 and isinstance(out[-2], str) and out[-2].split(".")[0] in LEAF:
            out[-2:] = [("+", (out[-2], x))]
        changed = True
        while changed:
            changed = False
            last, size = out[-1], len(out)
            for n in range(1, size):
                before = out[-n - 1]
                if before == last:
                    if n == 1 and last[0] == "+":
                        del out[-1:]
                    elif size >= 2 * n and out[-2 * n : -n] == out[-n:]:
                        out[-2 * n :] = [("+", tuple(out[-n:]))]
                    else:
                        continue
                elif before[0] == "+" and len(before[1]) == n and before[1][-1] == last and before[1] == tuple(out[-n:]):
                    del out[-n:]
                else:
                    continue
                changed = True
                break
    return tuple(out)


def _optional(run) -> list:
    """A run that may be left out; what is optional in it stays so by itself."""
    out: list = []
    held: list = []
    for x in [*run, None]:
        if x is None or x[0] == "?" and not isinstance(x, str):
            out += [("?", tuple(held))] if held else []
            out += [x] if x else []
            held = []
        else:
            held.append(x)
    return out


def merge(w: tuple, s: tuple) -> tuple:
    """The wrapper that covers both: aligned so that as much as possible matches, the rest optional."""
    if w == s or not s:
        return w
    if not w:
        return s
    lo = 0
    while lo < min(len(w), len(s)) and w[lo] == s[lo]:
        lo += 1
    hi = 0
    while hi < min(len(w), len(s)) - lo and w[-hi - 1] == s[-hi - 1]:
        hi += 1
    middle, other = w[lo : len(w) - hi], s[lo : len(s) - hi]
    between = _align(middle, other) if middle and other else _optional(middle or other)
    return (*w[:lo], *between, *w[len(w) - hi :])


def _anchors(w: tuple, s: tuple) -> list[tuple[int, int]]:
    """Places of items that both have once, as many as come in the same order in both."""
    once = [{x: i for i, x in enumerate(r) if r.count(x) == 1} if len(r) < 2000 else {x: r.index(x) for x, n in Counter(r).items() if n == 1} for r in (w, s)]
    tails: list[int] = []
    best: list[tuple] = []
    for x, i in once[0].items():  # the longest ascending row of places in s
        if (j := once[1].get(x)) is not None:
            k = bisect.bisect_left(tails, j)
            tails[k:], best[k:] = [j, *tails[k + 1 :]], [(i, j, best[k - 1] if k else None), *best[k + 1 :]]
    out, at = [], best[-1] if best else None
    while at:
        out.append(at[:2])
        at = at[2]
    return out[::-1]


def _align(w: tuple, s: tuple) -> list:
    n, m = len(w), len(s)
    if n * m > PAIRS:
        if not (cuts := _anchors(w, s)):
            return [*_optional(w), *_optional(s)]
        out: list = []
        i = j = 0
        for a, b in [*cuts, (n, m)]:
            out += merge(w[i:a], s[j:b]) if w[i:a] and s[j:b] else _optional(w[i:a] or s[j:b])
            out += w[a : a + 1]
            i, j = a + 1, b + 1
        return out
    group = lambda x, k: x[0] == k and not isinstance(x, str)
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    move: list[list] = [[None] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            best, how = -1.0, None
            if i < n:
                best, how = score[i + 1][j], ("w", 1, 0)
            if j < m and score[i][j + 1] > best:
                best, how = score[i][j + 1], ("s", 0, 1)
            if i < n and j < m:
                a, b = w[i], s[j]
                if a == b:
                    if 1 + score[i + 1][j + 1] > best:
                        best, how = 1 + score[i + 1][j + 1], ("same", 1, 1)
                elif group(a, "+") and group(b, "+") and a[1][0] == b[1][0]:
                    if 0.9 + score[i + 1][j + 1] > best:
                        best, how = 0.9 + score[i + 1][j + 1], ("both", 1, 1)
                for x, y, at, left in ((a, s, j, True), (b, w, i, False)):
                    if not isinstance(x, str) and y[at : at + len(x[1])] == x[1]:
                        k = len(x[1])
                        di, dj = (1, k) if left else (k, 1)
                        if k + score[i + di][j + dj] > best:
                            best, how = k + score[i + di][j + dj], (x, di, dj)
            score[i][j], move[i][j] = max(best, 0.0), how
    out = []
    i = j = 0
    alone: dict[str, list] = {"w": [], "s": []}

    def settle() -> None:
        for side in ("w", "s"):
            out.extend(_optional(alone[side]))
            alone[side] = []

    while i < n or j < m:
        how, di, dj = move[i][j]
        if how in ("w", "s"):
            alone[how].append(w[i] if how == "w" else s[j])
        else:
            settle()
            if how == "same":
                out.append(w[i])
            elif how == "both":
                out.append(("+", merge(w[i][1], s[j][1])))
            else:
                out.append(how)
        i, j = i + di, j + dj
    settle()
    return out


def show(w: tuple) -> str:
    """The wrapper as a regular expression over tags and text slots."""
    return " ".join(f"( {show(x[1])} ){x[0]}" if not isinstance(x, str) else TEXT if x[0] == TEXT else x for x in w)


def _frozen(x):
    return x if isinstance(x, str) else tuple(map(_frozen, x))


class Wrapper:
    """items: the expression. slots: by address of text slots hashes of up to DISTINCT different pages, texts, words, linked words, and the hash of the text if it never changes.

    Pages are different if their texts outside of menus, adverts and the like are: copies of an article count once.
    """

    def __init__(self, items: tuple = (), slots: dict | None = None):
        self.items, self.slots = items, slots or {}
        self.known: set = set()

    def add(self, page: str) -> None:
        row, mine, linked = [], {}, 0
        for kind, x, path in events(page):
            if kind == "tag":
                if x:
                    row.append(x)
            elif kind == "link":
                linked = x
            elif text := x.strip():
                if not row or row[-1] != TEXT + path:
                    row.append(TEXT + path)
                got = mine.setdefault(path, [[], 0, 0, 0, xxhash.xxh64()])
                n = text.count(" ") + 1
                got[1], got[2], got[3] = got[1] + 1, got[2] + n, got[3] + n * linked
                got[4].update(text.encode("utf-8", "surrogatepass") + b"\0")
        for x in mine.values():
            x[4] = x[4].intdigest()
        page_hash = xxhash.xxh64_intdigest(json.dumps(sorted((p, x[4]) for p, x in mine.items() if _place(p) != "boiler")))
        for x in mine.values():
            x[0] = [page_hash]
        skeleton = fold(row)
        if skeleton not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known.add(skeleton)
            self.items = merge(self.items, skeleton)
        self._count(mine)

    def _count(self, slots: dict) -> None:
        for path, x in slots.items():
            if path in self.slots:
                a = self.slots[path]
                self.slots[path] = [sorted({*a[0], *x[0]})[:DISTINCT], *(p + q for p, q in zip(a[1:4], x[1:4], strict=True)), a[4] if a[4] == x[4] else None]
            else:
                self.slots[path] = list(x)

    def join(self, other: Wrapper) -> None:
        self.items = merge(self.items, other.items)
        self._count(other.slots)

    def dump(self) -> str:
        return json.dumps([self.items, self.slots])

    @classmethod
    def load(cls, text: str) -> Wrapper:
        items, slots = json.loads(text)
        return cls(_frozen(items), slots)

    def content(self) -> list[str]:
        """The addresses of the expression's slots that are content."""
        slots = {a: repeated for a, repeated in text_slots(self.items).items() if a in self.slots}
        found = {a for a, repeated in slots.items() if self._is_content(_place(a), repeated, self.slots[a])}
        around = {a.split(">")[0] for a in found}
        return [a for a in slots if a in found or a.split(">")[0] in around and self._is_near(a, self.slots[a])]

    @staticmethod
    def _is_near(address: str, x: list) -> bool:
        """A heading or paragraph, however short, in a container that has content; not if it is the same on several pages."""
        pages, _, words, linked, same = x
        leaf = address.split(">")[1].split(".")[0]
        return leaf in NEAR and not _place(address) and linked < 0.5 * words and not (len(pages) >= DISTINCT and same is not None)

    @staticmethod
    def _is_content(place: str, repeated: bool, x: list) -> bool:
        pages, texts, words, linked, same = x
        if place or len(pages) >= DISTINCT and same is not None:
            return place == "main"
        return linked < 0.5 * words and (words >= 5 * texts or repeated and words >= 3 * texts)


@functools.lru_cache(maxsize=100_000)
def _place(address: str) -> str:
    """boiler, main, or nothing that its containers tell."""
    found, symbols = "", [s for s in address.replace(">", "/").split("/") if s]
    last = max((i for i, s in enumerate(symbols) if s.split(".")[0] in MAIN_TAGS), default=-1)
    for i, symbol in enumerate(symbols):
        name, *marks = symbol.split(".")
        if name in ("html", "body"):
            continue
        words = {w for mark in marks for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", mark).lower())}
        telling = words & (STRONG_WORDS if i <= last else BOILER_WORDS)
        if name in BOILER_TAGS or telling or name == "header" and not found:
            return "boiler"
        if name in MAIN_TAGS or words & MAIN_WORDS:
            found = "main"
    return found


def main_text(page: str | None, content: frozenset) -> str:
    """The blocks of a page at content slots, joined by line feeds."""
    blocks, held = [], []
    found = list(events(page or ""))
    main = {a for kind, x, a in found if kind == "text" and x.strip() and a in content and _place(a) == "main"}
    taken = main or content
    for kind, x, address in found:
        if kind == "tag":
            blocks.append(held)
            held = []
        elif kind == "text" and address in taken:
            held.append(entities.unescape(x))
    blocks.append(held)
    return "\n".join(t for b in blocks if b and (t := " ".join("".join(b).split())))


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (its expression), content (addresses of its content slots), n_pages."""

    def local(batches):
        def rows(found: dict):
            return pa.record_batch([pa.array(list(found), pa.string()), pa.array([w.dump() for w, _ in found.values()], pa.string()), pa.array([n for _, n in found.values()], pa.int64())], names=["host", "state", "n_pages"])

        found: dict[str, list] = {}
        for b in batches:
            for host, page in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                w = found.setdefault(host, [Wrapper(), 0])
                w[0].add(page.as_py() or "")
                w[1] += 1
            if len(found) > 5000:
                yield rows(found)
                found = {}
        yield rows(found)

    def joined(t: pd.DataFrame) -> Wrapper:
        w = Wrapper()
        for state in sorted(t["state"]):
            w.join(Wrapper.load(state))
        return w

    def some(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [t["host"].iloc[0]], "state": [joined(t).dump()], "n_pages": [int(t["n_pages"].sum())]})

    def whole(t: pd.DataFrame) -> pd.DataFrame:
        w = joined(t)
        return pd.DataFrame({"host": [t["host"].iloc[0]], "wrapper": [show(w.items)], "content": [w.content()], "n_pages": [int(t["n_pages"].sum())]})

    parts = _with_host(pages).select("host", "html").mapInArrow(local, "host string, state string, n_pages long").withColumn("part", F.spark_partition_id() % GROUPS)
    fewer = parts.groupBy("host", "part").applyInPandas(some, "host string, state string, n_pages long")
    return fewer.groupBy("host").applyInPandas(whole, "host string, wrapper string, content array<string>, n_pages long")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, host. Wrappers go to the pages where Spark finds them small enough to."""
    found = store(wrappers(pages).select("host", "content"), "wrappers")

    def run(batches):
        known: dict[str, frozenset] = {}
        for b in batches:
            texts = []
            for page, host, content in zip(b.column("html"), b.column("host").to_pylist(), b.column("content"), strict=True):
                if host not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[host] = frozenset(content.as_py() or ())
                texts.append(main_text(page.as_py(), known[host]))
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), b.column("host")], names=["page_id", "url", "text", "n_chars", "host"])

    return _with_host(pages).join(found, "host", "left").select("page_id", "url", "html", "host", "content").mapInArrow(run, "page_id long, url string, text string, n_chars long, host string")
