"""Encoding with a public tokenizer, piece by piece through a bounded memory of known pieces.

Both vocabularies first cut a text into runs of letters, of digits and of other marks (and of white space, where that
counts); no id spans two pieces, so a text's ids are those of its pieces in a row. Texts are cut in numpy, over many
texts at once; pieces are looked up by a hash and then compared code point by code point; the tokenizers library encodes
each new piece. What kind a code point is, and its lower case, is asked of the tokenizer itself.

Whole parts go to the library where cutting them here could differ: white space outside ASCII, special tokens, text
that its normaliser would compose anew, and code points that it turns into several.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from dnslens.llm.common import mix, powers, text_buffer

_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Kinds of code points.
SPACE, LETTER, DIGIT, MARK, ODD, UNKNOWN = range(6)
_SHORT = tuple(np.array([ord(c) for c in s], np.uint32) for s in ("s", "t", "m", "d", "re", "ve", "ll"))
#: Pieces remembered by a worker process.
MEMORY = 300_000
#: New pieces that are encoded as one text.
JOINED = 64
#: Bytes of text in work at once, and bytes from which a text is cut into parts (between a word and the space after it).
CHUNK, PART = 1 << 18, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table:
    """From 64-bit hashes to numbers, by open addressing in numpy."""

    def __init__(self, slots: int = 1 << 20):
        self.hashes, self.numbers, self.mask = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.uint64(slots - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        at = (h & self.mask).astype(np.int64)
        got = self.hashes[at]
        out = np.where(got == h, self.numbers[at], np.int32(-1))
        left = np.flatnonzero((got != h) & (got != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(self.mask)
            got = self.hashes[at[left]]
            hit = got == h[left]
            out[left[hit]] = self.numbers[at[left[hit]]]
            left = left[~hit & (got != 0)]
        return out

    def add(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Different hashes that aren't in the table."""
        at = (h & self.mask).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.hashes[at[left]] == 0]
            self.hashes[at[free]] = h[free]
            done = free[self.hashes[at[free]] == h[free]]
            self.numbers[at[done]] = numbers[done]
            left = left[self.hashes[at[left]] != h[left]]
            at[left] = (at[left] + 1) & int(self.mask)


def _grown(x: np.ndarray, need: int) -> np.ndarray:
    return x if len(x) >= need else np.concatenate([x, np.zeros(max(need - len(x), len(x)), x.dtype)])


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of size[0] numbers, then those of the next."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """path: of a tokenizer file. drop_space: white space never makes ids, text is lowered and digits stand alone. plain:
    special tokens' strings inside texts are plain text."""

    #: Which bytes, after a visible ASCII character, may begin a new part of a long text.
    cuts = _IS_SPACE

    def __init__(self, path: str, drop_space: bool, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.drop_space = drop_space
        self.model.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.low = np.arange(0x110000, dtype=np.uint32)
        self._ask(np.array([c for c in range(128) if chr(c) not in " \t\n\r\x0b\x0c"]))
        self.kind[[ord(c) for c in " \t\n\r\x0b\x0c"]] = SPACE
        self.between = self._find_between()
        self._reset()

    def _reset(self) -> None:
        self.table, self.known = _Table(), 0
        self.hashes, self.uses = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)
        self.ids, self.first, self.size = np.zeros(1 << 18, np.uint32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.codes, self.begin, self.length = np.zeros(1 << 18, np.uint32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.n_ids = self.n_codes = 0

    def _ask(self, codes: np.ndarray) -> None:
        """Learns kind and lower case of code points from the tokenizer."""
        split = self.model.pre_tokenizer.pre_tokenize_str
        for c in codes.tolist():
            low = self.model.normalizer.normalize_str(chr(c)) if self.model.normalizer else chr(c)
            if len(low) != 1:
                self.kind[c] = ODD
            else:
                self.low[c] = ord(low)
                self.kind[c] = LETTER if len(split("a" + low)) == 1 else MARK if len(split("." + low)) == 1 else DIGIT

    def _forget(self) -> None:
        """Keeps the half of the pieces that was used most."""
        keep = np.sort(np.argpartition(-self.uses[: self.known], MEMORY // 2)[: MEMORY // 2])
        hashes, uses, size, length = self.hashes[keep], self.uses[keep] // 2, self.size[keep], self.length[keep]
        ids, codes = self.ids[_spread(self.first[keep], size)], self.codes[_spread(self.begin[keep], length)]
        self._reset()
        self._store(hashes, ids, size, codes, length, uses)

    def _store(self, hashes, ids, size, codes, length, uses=0) -> None:
        lo, hi = self.known, self.known + len(hashes)
        for name in ("hashes", "uses", "first", "size", "begin", "length"):
            setattr(self, name, _grown(getattr(self, name), hi))
        self.ids, self.codes = _grown(self.ids, self.n_ids + len(ids)), _grown(self.codes, self.n_codes + len(codes))
        self.ids[self.n_ids : self.n_ids + len(ids)], self.codes[self.n_codes : self.n_codes + len(codes)] = ids, codes
        self.hashes[lo:hi], self.uses[lo:hi], self.size[lo:hi], self.length[lo:hi] = hashes, uses, size, length
        self.first[lo:hi], self.begin[lo:hi] = self.n_ids + np.cumsum(size) - size, self.n_codes + np.cumsum(length) - length
        self.table.add(hashes, np.arange(lo, hi, dtype=np.int32))
        self.known, self.n_ids, self.n_codes = hi, self.n_ids + len(ids), self.n_codes + len(codes)

    def _find_between(self) -> tuple[str, int]:
        """What stands between pieces that are encoded as one text, and its id: a line feed, or a rare word."""
        if not self.drop_space:
            return "\n", self.model.token_to_id("\u010a")
        for i in range(self.model.get_vocab_size() - 1, 0, -1):
            word = (self.model.id_to_token(i) or "").removesuffix("</w>")
            if word.isascii() and word.isalpha() and self.model.encode(word, add_special_tokens=False).ids == [i]:
                return f" {word} ", i
        return "", -1

    def _learn(self, hashes: np.ndarray, codes: np.ndarray, length: np.ndarray) -> None:
        """Different new hashes with the code points of their pieces, JOINED pieces encoded as one text."""
        text, end = codes.tobytes().decode("utf-32-le"), np.cumsum(length)
        pieces = [text[a:b] for a, b in zip((end - length).tolist(), end.tolist(), strict=True)]
        between, its_id = self.between
        alone = (self.kind[codes[end - 1]] == SPACE) | (its_id < 0)
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        n = int((~alone).sum())
        groups = [order[i : min(i + JOINED, n)] for i in range(0, n, JOINED)] + [order[i : i + 1] for i in range(n, len(order))]
        flat, size = [], []
        for at, e in zip(groups, self.model.encode_batch_fast([between.join([pieces[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(ids == its_id) if len(at) > 1 else np.zeros(0, np.int64)
            if len(cut) == len(at) - 1:
                flat.append(np.delete(ids, cut))
                size.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
            else:  # a piece that is the word between
                for i in at.tolist():
                    flat.append(np.array(self.model.encode(pieces[i], add_special_tokens=False).ids, np.uint32))
                    size.append(np.array([len(flat[-1])]))
        self._store(hashes[order], np.concatenate(flat), np.concatenate(size), codes[_spread((end - length)[order], length[order])], length[order])

    def _pieces(self, code: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece of the parts between offsets."""
        n = len(code)
        start = np.ones(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:n])
        if self.drop_space:
            start[:n] |= kind == DIGIT
        start[offsets] = True
        # an apostrophe alone and the letters of a short form are one piece
        quote = np.flatnonzero((code[:-1] == 39) & start[:-2] & start[1:-1] & (kind[1:] == LETTER)) if n > 1 else np.zeros(0, np.int64)
        at_begin = np.zeros(n + 1, bool)
        at_begin[offsets] = True
        quote = quote[~at_begin[quote + 1]]
        if not self.drop_space and len(quote):
            quote = quote[at_begin[quote] | (code[quote - 1] != 32)]
        if len(quote):
            end = np.append(np.flatnonzero(start), n)
            stop = end[np.searchsorted(end, quote + 2)]
            todo = np.ones(len(quote), bool)
            for short in _SHORT:
                fits = todo & (quote + len(short) < stop)
                for k, c in enumerate(short):
                    fits[fits] = code[quote[fits] + 1 + k] == c
                start[quote[fits] + 1] = False
                start[quote[fits] + 1 + len(short)] = True
                todo &= ~fits
        if self.drop_space:
            starts = np.flatnonzero(start)
            ends, starts = starts[1:], starts[:-1]
            keep = kind[starts] != SPACE
            return starts[keep], ends[keep]
        # of white space before a word the last character stands alone, or with the word if it is a space
        space = kind == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~at_begin[1:n]) if n > 1 else np.zeros(0, np.int64)
        start[last] = True
        start[last[code[last] == 32] + 1] = False
        starts = np.flatnonzero(start)
        return starts[:-1], starts[1:]

    def _numbers(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece, and which pieces are another one with the same hash."""
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(mix((code + np.uint64(1)) * _BASE) * powers(_BASE, len(code)), out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * powers(_BASE_INV, len(code) + 1)[starts])
        h[h == 0] = 1
        found = self.table.find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            hashes, one = np.unique(h[new], return_index=True)
            one = new[one]
            self._learn(hashes, code[_spread(starts[one], (ends - starts)[one])], (ends - starts)[one])
            found[new] = self.table.find(h[new])
        length = ends - starts
        other = self.length[found] != length
        size = np.where(other, 0, length)
        same = self.codes[_spread(self.begin[found], size)] == code[_spread(starts, size)]
        if not same.all():
            other[np.searchsorted(np.cumsum(size), np.flatnonzero(~same), "right")] = True
        return found, other

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each part between byte offsets."""
        n = len(offsets) - 1
        whole = np.zeros(n, bool)
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            whole |= [any(s.encode() in raw[a:b] for s in self.special) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ascii_ = raw.isascii()
        if ascii_:
            code, at = data.astype(np.uint32), offsets
            control = (data >= 0x1C) & (data <= 0x1F)
            if control.any():
                whole[np.searchsorted(offsets, np.flatnonzero(control), "right") - 1] = True
        else:
            code = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
            at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if not (part := raw[a:b]).isascii() or whole[k]:
                    text = part.decode()
                    whole[k] |= bool(_ODD.search(text)) or self.drop_space and not unicodedata.is_normalized("NFC", text)
                elif any(c in part for c in b"\x1c\x1d\x1e\x1f"):
                    whole[k] = True
        kind = self.kind[code]
        if not ascii_:
            if len(new := np.unique(code[kind == UNKNOWN])):
                self._ask(new)
                kind = self.kind[code]
            odd = np.flatnonzero(kind == ODD)
            whole[np.searchsorted(at, odd, "right") - 1] = True
        if self.drop_space:
            code = self.low[code]
        starts, ends = self._pieces(code, kind, at)
        numbers, other = self._numbers(code, starts, ends)
        if other.any():
            whole[np.searchsorted(at, starts[other], "right") - 1] = True
        self.uses[: self.known] += np.bincount(numbers, minlength=self.known)
        size = self.size[numbers]
        ids = self.ids[_spread(self.first[numbers], size)]
        cut = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, at)]
        out = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.array(self.model.encode(raw[offsets[k] : offsets[k + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        if self.known > MEMORY:
            self._forget()
        return out

    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids (uint32) of each whole text of a string column (null: empty)."""
        data, offsets = text_buffer(column)
        held: list[np.ndarray] = []
        for parts, docs in _chunks(data, offsets, self.cuts):
            lo = parts[0]
            got = self._encode(data[lo : parts[-1]], parts - lo)
            for ids, last in zip(got, docs, strict=True):
                if last:
                    yield np.concatenate([*held, ids]) if held else ids
                    held = []
                else:
                    held.append(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text of a list."""
        return list(self.encode_column(pa.array(texts, pa.large_string())))


def _chunks(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray = _IS_SPACE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte offsets of parts, some CHUNK at a time, and for each part whether it ends its document."""
    parts, last = [int(offsets[0])], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while b - a > PART:
            text = data[a + PART : b]
            after = np.zeros(0, np.int64)
            for lo in range(0, len(text) - 1, PART):  # a space after a visible ASCII character
                x = text[lo : lo + PART + 1]
                after = np.flatnonzero(cuts[x[1:]] & (x[:-1] > 32) & (x[:-1] < 127))
                if len(after):
                    a = a + PART + lo + int(after[0]) + 1
                    break
            if not len(after):
                break
            parts.append(a)
            last.append(False)
            if parts[-1] - parts[0] >= CHUNK:
                yield np.array(parts), np.array(last)
                parts, last = [a], []
        parts.append(b)
        last.append(True)
        if parts[-1] - parts[0] >= CHUNK:
            yield np.array(parts), np.array(last)
            parts, last = [b], []
    if last:
        yield np.array(parts), np.array(last)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, drop_space: bool, plain: bool = False) -> Encoder:
    """The process's encoder of a file: what it has learned serves the next task of a reused worker."""
    return remembered(Encoder, path, drop_space, plain)


def remembered(kind: type[Encoder], *args) -> Encoder:
    """The process's only instance of an encoder."""
    if (kind, *args) not in _ENCODERS:
        _ENCODERS[kind, *args] = kind(*args)
    return _ENCODERS[kind, *args]
