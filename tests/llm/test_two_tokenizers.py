"""Byte-level BPE through a serialised model, and the alignment of two tokenizers, against the libraries and brute force."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from dnslens.llm import byte_bpe, queries, token_alignment
from dnslens.llm.piece_models import MappedBpe, PieceModel, byte_characters

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
POOL = "aAbé日本   \n\n\t'sdlveret1²Ⅷ!?.,-_ 　\u0085\x00\x1c🎉👩‍👧▁́क़ſ"
SPECIAL = "x <|endoftext|> y <s> </s> <unk> <0x41>"
LONG = "été " * 40_000 + "x" * 150_000 + " " * 70_000 + "z"
SCHEMA = "doc_id long, text string, ids string, block long, pair string"
ROWS = [(1, "It's a test,  it is", "k", 1, "p"), (None, "It's a test,  it is", None, None, None), (2, None, "k", 1, "p"), (3, "", "k", 1, "p"), (4, " ", "k", 1, "p"), (5, "a▁b", "k", 1, "p"), (6, SPECIAL, "k", 1, "p"), (7, LONG, "k", 1, "p"), (7, LONG, "k", 1, "p"), (8, "\n\n x\t\t", "k", 1, "p")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def tiktoken_model():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n):
    rng = random.Random(7)
    some = ["".join(rng.choice(POOL) for _ in range(rng.randrange(60))) for _ in range(n)]
    return some + ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(0x3000)])) for _ in range(30)) for _ in range(n // 4)]


def test_mapped_bpe_equals_tiktoken(tiktoken_model):
    """Also of code points that are newer than one of the libraries."""
    model, texts = MappedBpe(RANKS), [*noise(4000), LONG, "", SPECIAL]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == tiktoken_model.encode_ordinary(text) and model.decode(ids) == text.encode()


def test_tokens_out_of_reach_of_merges(tmp_path):
    """A match that is a token as a whole is that token even where merges stop before it."""
    tokens = [*(bytes([b]) for b in range(256)), b"ab", b"abcd"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    model = MappedBpe(str(path))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for text in ("abcd", "abcd abcd", "abcde", "xabcd 1"):
        assert model.encode([text])[0].tolist() == want.encode_ordinary(text)
    assert model.encode(["abcd"])[0].tolist() == [257]


def test_units_of_one_hash(monkeypatch, tiktoken_model):
    """Units are told apart by their characters, whatever their hashes."""
    monkeypatch.setattr("dnslens.llm.tokens.mix", lambda h: np.asarray(h) % np.uint64(3))
    texts = noise(100)
    assert [x.tolist() for x in MappedBpe(RANKS).encode(texts)] == [tiktoken_model.encode_ordinary(x) for x in texts]


def test_memory_forgets(monkeypatch, tiktoken_model):
    monkeypatch.setattr("dnslens.llm.piece_models.MEMORY", 50)
    monkeypatch.setattr("dnslens.llm.tokens.MEMORY", 50)
    model, texts = MappedBpe(RANKS), noise(500)
    got = [ids.tolist() for lo in range(0, len(texts), 20) for ids in model.encode(texts[lo : lo + 20])]
    assert got == [tiktoken_model.encode_ordinary(x) for x in texts] and model.known < 2000


def test_piece_model_equals_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    want, texts = sentencepiece.SentencePieceProcessor(model_file=path), [x.replace("▁", "_") for x in [*noise(4000), LONG, SPECIAL]]
    for text, ids in zip(texts, PieceModel(path).encode([" " + x if x else x for x in texts]), strict=True):
        assert ids.tolist() == want.encode(text)


def test_op12(spark, sf, odd, tiktoken_model):
    assert sorted(map(str, odd_digests(odd, tiktoken_model))) == sorted(map(str, (tuple(r) for r in digests(byte_bpe.encode(odd)))))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op12_mapped_bpe(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(odd_digests(docs, tiktoken_model))
    assert byte_bpe.encode(odd.limit(0)).count() == 0
    again = byte_bpe.decode(byte_bpe.encode(docs, decoded=False)).join(docs, "doc_id").where("decoded != CAST(coalesce(text, '') AS binary)")
    assert again.count() == 0


def digests(encoded):
    return [(r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded).hexdigest()) for r in encoded.collect()]


def odd_digests(docs, model):
    out = []
    for r in docs.select("doc_id", "text").collect():
        ids = model.encode_ordinary(r.text or "")
        out.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    return out


class Brute:
    """Alignment by walking over all tokens."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.back = {c: i for i, c in enumerate(byte_characters())}

    def spans(self, text):
        """(id, start, end) of A's and of B's tokens; none if either isn't space+text."""
        a = [(i, bytes(self.back[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i in (self.b.encode(text) if text else []) for p in [self.b.id_to_piece(i)]]
        if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
            return [], []
        return [self._placed(x) for x in (a, b)]

    @staticmethod
    def _placed(tokens):
        at, out = 0, []
        for i, x in tokens:
            out.append((i, at, at := at + len(x)))
        return out

    def links(self, a, b):
        first, out = 0, []
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                out.append((i, b[k][0]))
                k += 1
        return out

    def groups(self, a, b):
        ends, out, i, j = sorted({e for *_, e in a} & {e for *_, e in b}), [], 0, 0
        for end in ends:
            x, y = [], []
            while i < len(a) and a[i][2] <= end:
                x.append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][2] <= end:
                y.append(str(b[j][0]))
                j += 1
            out.append(",".join(x) + "|" + ",".join(y))
        return out

    def rows(self, docs):
        spans = [(d, *self.spans(x or "")) for d, x in docs]
        linked = [self.links(a, b) for _, a, b in spans]
        count, highest = Counter(p for x in linked for p in x), Counter()
        for (_, b), n in count.items():
            highest[b] = max(highest[b], n)
        return [(d, len(a), len(b), len(g := self.groups(a, b)), len(x), ";".join(g), sum(count[p] == highest[p[1]] for p in x), sum(count[p] for p in x)) for (d, a, b), x in zip(spans, linked, strict=True)]


@pytest.fixture(scope="module")
def brute():
    return Brute()


@pytest.mark.parametrize(("block", "unit", "window"), [(token_alignment.BLOCK, token_alignment.UNIT, token_alignment.WINDOW), (1, 1, 5)])
def test_alignment_of_odd_rows(spark, odd, brute, monkeypatch, block, unit, window):
    """With blocks of one document and windows of a few tokens as well."""
    monkeypatch.setattr(token_alignment, "UNIT", unit)
    rows = odd if window > 5 else odd.where("length(text) < 1000 OR text IS NULL")
    run = token_alignment.windows
    monkeypatch.setattr(token_alignment, "windows", lambda a, b: run(a, b, window))
    got = token_alignment.align(rows, block=block)
    assert got.schema.simpleString() == "struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups:string,n_best:bigint,count_sum:bigint>"
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute.rows([(r.doc_id, r.text) for r in rows.collect()])))
    assert token_alignment.align(odd.limit(0)).count() == 0


def test_windows_end_together():
    rng = np.random.default_rng(3)
    a = rng.integers(1, 9, 2000)
    b = rng.integers(1, 9, 4000)
    cut = int(np.searchsorted(np.cumsum(b), a.sum()))
    b = np.append(b[:cut], a.sum() - b[:cut].sum())
    found = list(token_alignment.windows(a, b, 4))
    assert sum(x.stop - x.start for x, _ in found) == len(a) and sum(y.stop - y.start for _, y in found) == len(b)
    assert all(a[x].sum() == b[y].sum() for x, y in found) and len(found) > 50


def test_op11(spark, sf, brute):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [(*r[:5], hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "", *r[6:]) for r in brute.rows(map(tuple, docs))]
    got = queries.op11_interval_coalescing(spark, sf).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
    assert sorted(map(tuple, got)) == sorted(want)
