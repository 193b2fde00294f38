"""Sentencepiece models behind the piece memory of `tokens`: units that no id spans are encoded once and looked up after.

`MappedBpe` serialises a sentencepiece BPE model straight from a byte-level rank file: each token's bytes are mapped to
one character a byte, its score is the negative rank, and normalisation is the identity; the pattern's matches are encoded
one by one, and ids are decoded by the inverse mapping. `PieceModel` is a model file that writes spaces as U+2581.
"""

from __future__ import annotations

import base64
import struct

import numpy as np

from dnslens.llm.tokens import DIGIT, LETTER, MARK, MEMORY, SPACE, Encoder, _spread

#: Units encoded in one call of the library.
TOGETHER = 4096


class UnitEncoder(Encoder):
    """An encoder whose units are found by `_pieces` and encoded by `_ids_of`; no part goes to the library whole."""

    def _ids_of(self, units: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _learn(self, hashes: np.ndarray, codes: np.ndarray, length: np.ndarray) -> None:
        text, end = codes.tobytes().decode("utf-32-le"), np.cumsum(length)
        units = [text[a:b] for a, b in zip((end - length).tolist(), end.tolist(), strict=True)]
        for lo in range(0, len(units), TOGETHER):
            hi = min(lo + TOGETHER, len(units))
            found = self._ids_of(units[lo:hi])
            first = int(end[lo] - length[lo])
            ids = np.fromiter((i for x in found for i in x), np.uint32)
            self._store(hashes[lo:hi], ids, np.array([len(x) for x in found]), codes[first : end[hi - 1]], length[lo:hi])

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        raw = data.tobytes()
        if raw.isascii():
            code, at = data.astype(np.uint32), offsets
        else:
            code = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
            at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        starts, ends = self._pieces(code, self.kind[code], at)
        numbers, other = self._numbers(code, starts, ends)
        self.uses[: self.known] += np.bincount(numbers, minlength=self.known)
        size, first = self.size[numbers], self.first[numbers]
        ids = self.ids[_spread(first, size)]
        if other.any():  # different units of one hash: those that came second are encoded each time
            cut, rows = np.concatenate([[0], np.cumsum(size)]), []
            for k in range(len(starts)):
                rows.append(ids[cut[k] : cut[k + 1]] if not other[k] else np.array(self._ids_of([code[starts[k] : ends[k]].tobytes().decode("utf-32-le")])[0], np.uint32))
            ids, size = np.concatenate(rows), np.array([len(r) for r in rows])
        cut = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, at)]
        if self.known > MEMORY:
            self._forget()
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


class _Bytes:
    """The bytes of each id, in one buffer."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_spread(self.first[ids], self.size[ids])]


def byte_characters() -> list[str]:
    """A visible character for each byte: printable bytes stand for themselves, the others count up from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return out


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol buffers message: a length-delimited value, a varint, or a 32-bit float."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


#: Numbers of the public sentencepiece message format (fixed values): kinds of pieces, and the BPE model.
NORMAL_PIECE, UNKNOWN_PIECE, BPE_MODEL = 1, 2, 2


def serialise(pieces: list[str]) -> bytes:
    """A sentencepiece BPE model whose ids are places in `pieces`: the earlier, the sooner merged; the unknown piece is last."""
    rows = [_field(1, p.encode()) + _field(2, -float(rank)) + _field(3, NORMAL_PIECE) for rank, p in enumerate(pieces)]
    rows.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN_PIECE))
    trainer = _field(3, BPE_MODEL) + _field(4, len(rows)) + _field(40, len(pieces))
    identity = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, r) for r in rows) + _field(2, trainer) + _field(3, identity)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which must count up from 0 and hold every single byte."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    tokens = [ranks[i] for i in range(len(ranks))]
    if {bytes([b]) for b in range(256)} - set(tokens):
        raise ValueError(f"not every byte has a rank: {path}")
    return tokens


class MappedBpe(UnitEncoder):
    """Byte-level BPE by a rank file, as the tiktoken library encodes: a match that is a token as a whole is that token,
    others merge the adjacent pair of least rank, the leftmost of equals."""

    drop_space = False

    def __init__(self, path: str):
        import sentencepiece

        tokens = read_ranks(path)
        self.map = dict(enumerate(byte_characters()))
        self.back = {ord(c): b for b, c in self.map.items()}
        mapped = [t.decode("latin-1").translate(self.map) for t in tokens]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(mapped))
        self.bytes = _Bytes([bytes(self.back[ord(c)] for c in self.model.id_to_piece(i)) for i in range(len(tokens))])
        found = self.model.encode(mapped, num_threads=1)
        self.whole = {p: [i] for i, (p, ids) in enumerate(zip(mapped, found, strict=True)) if ids != [i]}  # tokens that merges don't reach
        self.kind = kinds()
        self._reset()

    def _ids_of(self, units: list[str]) -> list[list[int]]:
        mapped = [u.encode().decode("latin-1").translate(self.map) for u in units]
        found = self.model.encode(mapped, num_threads=1)
        return [self.whole.get(m, ids) for m, ids in zip(mapped, found, strict=True)] if self.whole else found

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the pieces of ids, mapped back."""
        return self.bytes.join(ids).tobytes()


def kinds() -> np.ndarray:
    """What the pattern's classes make of each code point, asked of the regular expressions of the tiktoken library (Unicode
    tables differ between libraries)."""
    import tiktoken

    out = np.full(0x110000, MARK, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", SPACE)):
        matches = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        out[np.frombuffer(bytes(matches.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


#: Kinds of code points of PieceModel: the space mark, those that pieces join, those that stand alone.
GAP, JOINED_UP, ALONE = range(3)


class PieceModel(UnitEncoder):
    """A sentencepiece BPE file with byte fallback, for texts to which the leading space has been added already.

    A unit is a run of spaces with what follows it up to the next space; code points that no piece joins to others are units
    too. That holds as long as no piece has a space mark after another character, which is checked.
    """

    cuts = np.arange(256) == 32

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        # a repeated message field is merged: the file's normaliser, but without the added prefix
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model + _field(3, _field(3, 0)))
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = _Bytes([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        usable = [p for i, p in enumerate(names) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        if any("▁" in p.lstrip("▁") for p in usable):
            raise ValueError(f"pieces of {path} go over spaces")
        self.kind = np.full(0x110000, ALONE, np.uint8)
        self.kind[[ord(c) for c in {c for p in usable if len(p) > 1 for c in p}]] = JOINED_UP
        self.kind[32] = GAP
        self._reset()

    def _ids_of(self, units: list[str]) -> list[list[int]]:
        return self.model.encode(units, num_threads=1)

    def _pieces(self, code: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(code)
        start = np.zeros(n + 1, bool)
        start[:n] = kind == ALONE
        start[1:] |= start[:n]
        start[1:n] |= (kind[1:] == GAP) & (kind[:-1] != GAP)
        start[offsets] = True
        starts = np.flatnonzero(start)
        return starts[:-1], starts[1:]
