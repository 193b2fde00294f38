"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from dnslens.llm import decontaminate, exact_dedup, html_wrapper, language_id, near_copies, packing, queries, ring_shards, simhash, substring_dedup, token_planes, tokens, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [(1, "a  b\tc", "en", "s", 1, "k"), (2, "a b c", None, None, None, None), (None, "a b c", "en", "s", 1, "k"), (3, None, None, "s", 1, "k"), (4, "", "en", "s", 1, "k"), (5, " ", "en", "s", 1, "k"), (6, LONG, "en", "s", 1, "k"), (6, LONG, "en", "s", 1, "k"), (7, "1234 ++", "en", "s", 1, "k")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and a column whose name clashes with an operator's own."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize(("bits", "held"), [(64, 1 << 20), (2, 1 << 20), (64, 1)])
def test_exact_dedup(spark, odd, docs, bits, held):
    """Two key bits force chains of different texts under one key; with one byte held, no text is combined in its task."""
    rows = odd.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(100 + r.doc_id, r.text, "x") for r in docs.values()], "doc_id long, text string, key string"))
    want = defaultdict(list)
    for r in rows.collect():
        want[norm(r.text)].append(r.doc_id)
    got = exact_dedup.exact_groups(rows, capacity=8192, key_bits=bits, held=held).collect()
    sha = {hashlib.sha256(k.encode()).digest(): v for k, v in want.items()}
    assert len(got) == rows.count() == len({r.row_id for r in got})
    for r in got:
        ids = sha[bytes(r.sha)]
        assert r.group_size == len(ids) and r.keep_id == min(i for i in ids if i is not None)
    assert sum(r.kept for r in got) == len(want)
    assert (max(r.slot for r in got) > 20) == (bits == 2) and len({r.bucket for r in got}) >= (20 if bits == 64 else 4)
    kept = exact_dedup.keep_first(rows)
    assert kept.columns == rows.columns and kept.count() == len(want)


def test_equal_digests_chain(spark, monkeypatch):
    """Texts are told apart by their bytes, whatever their keys and digests."""
    rows = [(doc, key, n, doc, 10 + doc, text) for doc, key, n, text in [(1, 5, 2, b"a"), (2, 5, 1, b"b"), (3, 5, 4, b"a")]]
    batch = pa.RecordBatch.from_pylist([dict(zip(("group_id", "key", "n", "doc_id", "row_id", "norm"), r, strict=True)) | {"bucket": 0} for r in rows])
    monkeypatch.setattr(exact_dedup.hashlib, "sha256", lambda b: hashlib.md5(b""))
    got = pa.Table.from_batches(list(exact_dedup._owner([batch]))).to_pylist()
    assert [(r["slot"], r["keep_id"], r["group_size"], r["groups"]) for r in got] == [(0, 1, 6, [1, 3]), (1, 2, 1, [2])]


def test_directory_doubles_only_where_needed(spark):
    keys = [(i << 58, 10) for i in range(4)] + [(-1, 3), (-1, 30), (-(1 << 62), 3)]
    directory = exact_dedup.build_directory(spark.createDataFrame(keys, "key long, n_bytes long"), 10)
    found = exact_dedup.find(np.array([k for k, _ in keys], np.int64), directory.depth, directory.entries).tolist()
    assert directory.depth == 6 and len(set(found[:4])) == 4 and found[4] == found[5] and found[4] != found[0]
    assert len(set(directory.entries[16:32].tolist())) == 1 and len(directory.entries) == 64
    far = exact_dedup.build_directory(spark.createDataFrame([(0, 8), (1, 8)], "key long, n_bytes long"), 10)
    assert far.depth == exact_dedup.DEEPEST


def fingerprint(text):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in prints}


def test_simhash(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op6_covering_simhash(spark, sf).collect()}
    prints = {i: int(r.fingerprint, 16) for i, r in got.items()}
    assert all(prints[i] == fingerprint(docs[i].text) for i in list(docs)[:60])
    assert {i: r.component_id for i, r in got.items()} == components(prints)


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks()
    rng = np.random.default_rng(0)
    for _ in range(3000):
        gone = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not m & gone for m in masks)


def test_near_pairs_of_large_buckets():
    rng = np.random.default_rng(1)
    center = int(rng.integers(1 << 62))
    fps = np.unique(np.array([center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6))) for _ in range(1500)], np.uint64))
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def unite(a, b):
        assert (int(fps[a]) ^ int(fps[b])).bit_count() <= 3
        root[find(b)] = find(a)

    simhash._near_pairs(fps, list(range(64)), 3, unite)
    brute = components(dict(enumerate(int(x) for x in fps)))
    assert len({find(i) for i in range(len(fps))}) == len(set(brute.values()))


def jaccard_heads(texts, similarity=0.8):
    """Of each component of five-word Jaccard similarity the smallest id, by brute force."""
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i for i in texts if root[i] == i}


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(words), n, replace=False).tolist():
        out[at] = f"x{rng.integers(1 << 40)}"
    return " ".join(out)


def test_near_copies_at_four_fifths(spark):
    """Pairs on both sides of 0.8, a chain, and a group large enough for turns; near copies differ in more than 3 bits."""
    rng = np.random.default_rng(5)
    texts = {}
    for k in range(40):
        base = [f"k{k}w{i}" for i in range(150)]
        for c in range(3):
            texts[10 * k + c] = edited(rng, base, int(rng.integers(0, 5)))
    base = [f"g{i}" for i in range(300)]
    for c in range(120):
        texts[1000 + c] = edited(rng, base, int(rng.integers(0, 7)))
    texts |= {2000: "a b c", 2001: "A  b c", 2002: "", 2003: " ", 2004: "a b d"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = jaccard_heads(texts)
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == want
    by_bits = components({i: fingerprint(t) for i, t in texts.items()})
    assert len(want) < len(set(by_bits.values()))


def test_near_dedup_stage_drops_pairs_at_four_fifths(spark, sf, docs):
    import corpus_pipeline as P

    known = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id for r in dict(P.STAGES)["near_dedup"](spark, known, sf).collect()}
    assert got == jaccard_heads({i: r.text for i, r in docs.items()})


def test_near_copies_with_one_id_or_none(spark, none):
    words = [f"w{i}" for i in range(100)]
    text = " ".join(words)
    rows = [(1, text), (1, text + " end"), (None, text + " other end"), (5, text), (2, "quite other words that stand alone"), (5, "five has words of its own as well"), (None, "and yet other words that stand alone")]
    rows += [(3, "a row that is there twice")] * 2
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x"))).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((i or 0, t) for i, t in [rows[0], *rows[4:8]])
    assert near_copies.keep_one(none).count() == 0


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0, 500}


def brute_repeats(rows, window):
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [9, 35])
def test_substring_dedup(spark, odd, window):
    rng = np.random.default_rng(2)
    shared = [f"s{i}" for i in range(60)]
    rows = [(r[0], r[1]) for r in ROWS]
    for i in range(40):
        w = [f"u{x}" for x in rng.integers(0, 4 if i % 5 == 0 else 5000, 80)]
        at, size = int(rng.integers(0, 80)), int(rng.integers(0, 60))
        rows.append((100 + i, " ".join([*w[:at], *shared[:size], *w[at:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks, found = substring_dedup.parse(df, window)
    found = found.collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=repr)
    assert got == brute_repeats(rows, window)
    made = {b.block: substring_dedup.Block(b.block, b.doc_ids, b.n_words, bytes(b.body), window, 8) for b in blocks.collect()}
    texts = {i: WORD.findall((t or "").encode()) for i, t in rows if i is not None}
    for r in found:  # factors are what their references hold, and cover what goes
        covered, done = 0, 0
        for start, length, block, place in zip(*(r.factors[k::4] for k in range(4)), strict=True):
            assert start >= done and made[block].words(place, length).split() == texts[r.doc_id][start : start + length]
            covered, done = covered + length, start + length
        assert covered == r.n_removed


def test_words_under_one_hash_are_compared(spark):
    """A request whose words aren't those of its reference is noticed."""
    text = " ".join(f"a{i}" for i in range(50))
    blocks = substring_dedup._store_blocks(substring_dedup.reference_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")), 100)
    number = blocks.first().block
    for words, want in ((b"a3 a4", 0), (b"a3 x4", 1)):
        asked = spark.createDataFrame([(number, 3, 2, words)], "block long, place long, length long, words binary")
        assert substring_dedup._differing(blocks, asked) == want


def test_other_seeds_hash_otherwise():
    packed = substring_dedup.zstandard.ZstdCompressor().compress(b"a b c d e f g h i j k l")
    a, b = (substring_dedup.Block(0, [1], [12], packed, 9, 4, seed) for seed in (0, 1))
    assert not set(a.window_hashes.tolist()) & set(b.window_hashes.tolist()) and a.words(1, 3) == b.words(1, 3) == b"b c d"


def test_remove_repeats_cuts_text(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"x  y {passage} z"), (2, f"{passage} q"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()} == {1: "x y z", 2: "q", 3: None}


def encoder_of(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path(name))


@pytest.mark.parametrize(("name", "drop"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_piece_by_piece_encoding(docs, monkeypatch, name, drop):
    """As the library encodes whole texts, with little memory too, and where two pieces have one hash."""
    whole, own = encoder_of(name), tokens.Encoder(tokens.default_path(name), drop)
    odd = ["", " ", "a  b", "a\u00a0 b\n\n c ", "\n\n x", "it's  a\tb", "a   b", "x <|endoftext|> y", "<|startoftext|>a", "é é É", "\x1c a", " lead", "'S 's x's 'd've", "Σ İ", "12 3²", "日本 🙂!!"]
    odd.append(("word " * 30_000 + "é" * 70_000 + " ") * 2)
    rng, marks = np.random.default_rng(8), ["a", "B", "'", "'s", "'re", "'LL", " ", "  ", "\n", "\t", "1", "23", ".", "!!", "é", "e\u0301", "\u00a0", "<|", "🙂", "ß", "_"]
    odd += ["".join(rng.choice(marks, rng.integers(0, 25))) for _ in range(2000)]
    texts = odd + [r.text or "" for r in docs.values()][:80]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text[:60]
    monkeypatch.setattr(tokens, "MEMORY", 500)
    for text in texts[:900]:
        assert own.encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids, text[:60]
    monkeypatch.setattr(tokens, "mix", lambda h: h & np.uint64(255))
    own._reset()
    for text, ids in zip(texts[-80:], own.encode(texts[-80:]), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text[:60]


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_planes(planes):
    for ids in ([], [0], [49407, 2, 0, 65535], list(range(70_000, 70_009))):
        x = np.array(ids, np.uint32)
        assert token_planes.from_planes(token_planes.to_planes(x, planes), len(x), planes).tolist() == ids


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_shard_files(spark, odd, tmp_path, planes):
    manifest = token_planes.write_shards(odd, str(tmp_path), planes=planes)
    whole = encoder_of("word_bpe_49k.json")
    want, start = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_planes.read_shards(manifest).collect()), key=lambda r: r[1])
    assert got == want and not list(tmp_path.glob("*.tmp"))


def check_packing(rows, texts):
    whole = encoder_of("byte_bpe_50k.json")
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    cover, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        cover[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        assert [a for a, _ in sorted(cover[i])] == np.cumsum([0, *(n for _, n in sorted(cover[i]))])[:-1].tolist() and sum(n for _, n in cover[i]) == len(x)
    for pieces in sequences.values():
        size = sum(n for _, n in pieces)
        assert [a for a, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1].tolist() and size <= 1024 and size.bit_count() == 1


def test_packing(spark, sf, docs, odd):
    check_packing(queries.op10_hilbert_packing(spark, sf).collect(), {i: r.text for i, r in docs.items()})
    some = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(some).collect(), {r.doc_id: r.text for r in some.collect()})


def test_hilbert_curve_is_a_walk():
    points = np.array(list(itertools.product(range(4), repeat=3)))
    order = points[np.argsort(packing.hilbert_keys(points, 2))]
    assert sorted(packing.hilbert_keys(points, 2).tolist()) == list(range(64)) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_ring_shards(spark, sf, docs, odd):
    rows = queries.op8_ring_shards(spark, sf).collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(docs) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(24))
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert sorted(r.slot for r in ring_shards.shard(odd, 2).where("shard = 0").collect()) == [0, 1, 2, 3, 4]


def test_ring_moves_few_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = ({r.doc_id: r.shard for r in ring_shards.shard(docs, n).collect()} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) < 0.6 * len(a)


def brute_leak(doc, item, least=12, similarity=0.8):
    """Whether some diagonal has a long enough region that is similar enough and holds seven equal words in a row."""
    a, b = (re.findall(r"[^\W_]+", x.lower()) for x in (doc or "", item or ""))
    need = min(least, len(b))
    for shift in range(-len(b) + 1, len(a)):
        same = [a[i + shift] == b[i] for i in range(max(0, -shift), min(len(b), len(a) - shift))]
        for i in range(len(same)):
            hits = 0
            for j in range(i, len(same)):
                hits += same[j]
                if same[i] and same[j] and j + 1 - i >= need and hits >= similarity * (j + 1 - i):
                    return True
    return False


def test_masks_fit_any_twelve_words_of_which_two_differ():
    for gone in itertools.combinations(range(12), 2):
        assert any(all(m[i - p] == "0" for i in gone if p <= i < p + len(m)) for m in decontaminate.MASKS for p in range(13 - len(m))), gone


@pytest.mark.parametrize("n", range(10, 25))
def test_masks_fit_every_length(n):
    """Whole items of 10 and 11 words begin and end with equal words; a region of 12 or more may be part of a longer one."""
    ones = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    fits = [sum(1 << p + i for i in m) for m, mask in zip(ones, decontaminate.MASKS, strict=True) for p in range(n - len(mask) + 1)]
    for gone in itertools.combinations(range(n) if n > 11 else range(1, n - 1), n // 5):
        bits = sum(1 << i for i in gone)
        assert any(not f & bits for f in fits), gone


def test_leaks_with_every_change_allowed(spark):
    """Every placement of changes in items of 10, 11 and 15 words is found."""
    docs, items = [], []
    for n in (10, 11, 15):
        item = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        docs += [(n * 1000 + k, "a b " + " ".join("x" if i in gone else w for i, w in enumerate(item)) + " c") for k, gone in enumerate(itertools.combinations(range(1, n - 1), n // 5))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(df, bench).collect()} == {d for d, _ in docs}


def test_component_rounds_are_few_stages(spark):
    """Each of the driver's stages keeps memory there: a round of the stars has three shuffles and no broadcast."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    spark.sparkContext.setJobGroup("rounds", "stars")
    try:
        got = {r.node: r.root for r in simhash.components(edges).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
    tracker = spark.sparkContext.statusTracker()
    ran = {s for j in tracker.getJobIdsForGroup("rounds") for s in tracker.getJobInfo(j).stageIds if (i := tracker.getStageInfo(s)) and i.numCompletedTasks}
    assert len(ran) <= 60


def test_language_training_keeps_no_array_a_text(spark):
    """Arrays of its own for each text would stay with the driver after training."""
    runs = language_id._Runs()
    for i in range(3):
        runs.add(np.arange(i, i + 4, dtype=np.uint32), np.full(4, 0.25, np.float32), i, True)
    assert [runs[i][0].tolist() for i in range(3)] == [[0, 1, 2, 3], [1, 2, 3, 4], [2, 3, 4, 5]]
    assert runs[2][1].tolist() == [0.25] * 4 and len(runs) == 3 and len(runs.buckets) == 12


def test_every_fifth_word_changed(spark):
    item = [f"w{i}" for i in range(40)]
    text = " ".join("x" if i % 5 == 4 else w for i, w in enumerate(item))
    df = spark.createDataFrame([(1, f"before {text} after"), (2, "quite other words")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()] == [1]


def test_samples_take_a_copied_text_once(spark):
    docs = spark.createDataFrame([(i, "same words", "en") for i in range(50)] + [(100, "other words", "en")], "doc_id long, text string, lang string")
    assert sorted(language_id.labelled_sample(docs)[0]) == ["other words", "same words"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels, 100)[:2] == (["same words", "same words"], [0, 1])


def test_repeated_words_and_items(spark, monkeypatch):
    """A text of one word over and over, in small steps; the same item twice."""
    monkeypatch.setattr(decontaminate, "STEP", 64)
    index = decontaminate.ItemIndex([(1, "x x x x"), (2, "x " * 30), (3, "y")])
    words, first = decontaminate.plain_words(*decontaminate.text_buffer(pa.array(["x " * 500, "y"]), lower=True))
    assert {(d, i) for d, i, *_ in index.hits(words, first)} == {(0, 0), (0, 1), (1, 2)}
    df = spark.createDataFrame([(1, "a b c d")] * 2, "doc_id long, text string")
    rows = decontaminate.leaks(df, spark.createDataFrame([(7, "a b c"), (7, "a b c")], "item_id long, text string")).collect()
    assert sorted((r.kind, r.doc_id, r.item_id) for r in rows) == [("document", 1, 7), ("document", 1, 7), ("item", 1, 7)]


def linked(rows):
    """All pairs that have a passage in common."""
    docs, items = defaultdict(set), defaultdict(set)
    for r in rows:
        (docs if r.kind == "document" else items)[r.passage].add(r.doc_id if r.kind == "document" else r.item_id)
    return {(d, i) for p in docs for d in docs[p] for i in items[p]}


def test_leaks_of_a_shared_sentence_are_no_pairs(spark):
    """300 documents and 300 items with one sentence in common: a row for each of them, and no link lost."""
    prompt = " ".join(f"prompt{k}" for k in range(14))
    docs = spark.createDataFrame([(d, f"d{d} before {prompt} after{d} d{d}") for d in range(300)] + [(999, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"i{i} here {prompt} there{i} i{i}") for i in range(300)], "item_id long, text string")
    rows = decontaminate.leaks(docs, items).collect()
    assert len(rows) <= 600 and linked(rows) == {(d, i) for d in range(300) for i in range(300)}
    assert all(r.n_words == 14 and r.similarity == 1.0 for r in rows)
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()] == [999]


def test_decontamination(spark):
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(10_000))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([4, 8, 15, 30, 60])] + [(9, None), (10, "")]
    docs = []
    for k in range(60):
        body = [word() for _ in range(50)]
        item = (items[k % 5][1] or "").split()
        if k % 3:
            for at in range(5, len(item), 9 if k % 2 else 1000):
                item[at] = "changed"
            body[20:20] = [w.upper() + "," for w in item]
        docs.append((k, " ".join(body)))
    docs += [(100, None), (101, ""), (None, items[3][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in docs for i, x in items if x and brute_leak(t, x)}
    for block in (20_000, 2):
        rows = decontaminate.leaks(df, bench, block_items=block).collect()
        assert linked(rows) == want and {(r.doc_id, r.item_id) for r in rows} <= want
        left = decontaminate.drop_leaks(df, bench, block)
        assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_language_id(spark, sf):
    sf = sf.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.op1_language_id(spark, sf).collect() if r.held_out]
    assert len(held) > 150 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def test_language_id_of_odd_rows(spark, odd, none):
    model = language_id.fit(odd)
    got = language_id.predict(odd, model).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 7)} == {"und"}
    assert language_id.predict(odd, language_id.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert language_id.keep_known(odd).columns == odd.columns


def test_long_texts_lose_no_subwords(monkeypatch):
    text = " ".join(f"w{i}x" for i in range(3000))
    whole = np.bincount(language_id.subwords(text), minlength=1 << 15)
    monkeypatch.setattr(language_id, "PART", 100)
    assert (np.bincount(language_id.subwords(text), minlength=1 << 15) == whole).all()


def test_every_language_is_learned(spark):
    """More than 64 languages, each of words of its own."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(80):
        words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(5)]
        rows += [(100 * k + i, " ".join(rng.choice(words, 8)), f"l{k}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.languages == sorted({r[2] for r in rows})
    lang = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in language_id.predict(df, model).collect()]) > 0.9


def test_toxicity(spark, sf):
    sf = sf.replace("0.001", "0.1")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op4_toxicity_cnn(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    y, s = np.array([toxic[r.doc_id] for r in held]), np.array([r.score for r in held])
    order = s.argsort().argsort() + 1
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.9 and ((s >= 0.5) == y).mean() > 0.93


def test_toxicity_of_odd_rows(spark, sf, odd, none):
    """A real model on nulls, empty, long and repeated texts, and on an empty table."""
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, language_id.fit(docs, 200), per_class=60)
    got = sorted(((r.doc_id or 0, r.score) for r in toxicity.score(odd, model).collect()))
    assert len(got) == len(ROWS) and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert by[3] == by[4] == by[5] and len([1 for i, s in got if i == 6 and s == by[6]]) == 2
    assert toxicity.score(none, model).count() == 0


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([(1, 1, None)], "doc_id long, quality long, toxic long")
    model = toxicity.fit(odd, none, language_id.fit(odd))
    assert {r.score for r in toxicity.score(odd, model).collect()} == {0.0}


PAGE = "<html><head><title>T</title><script>x='</p>'</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>{ad}<article><h1>Head &amp; line</h1><p>First <b>bold</b>\n text.<p>Second &eacute;&nbsp;x{more}<aside>Side</aside></article><div class='comments'><p>Nice read!</p></div><form>Mail <input></form><footer>&copy; me</footer></body></html>"


def test_html(spark):
    pages = [(1, "http://a.example/1", PAGE.format(ad="<div class='ad'>Buy</div>", more="")), (2, "http://a.example/2", PAGE.format(ad="", more="<p>Third")), (3, "http://b.example/3", "<div class=menu>Home</div><div><p>Some plain prose without any article around it.</div>"), (4, None, None), (5, "x", ""), (6, "http://a.example/6", PAGE.format(ad="", more="")[:-60]), (6, "http://a.example/6", "<p>a &am")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("x"))
    got = [(r.page_id, r.text) for r in html_wrapper.extract(df).collect()]
    one = "Head & line\nFirst bold text.\nSecond é x"
    assert sorted(got) == sorted([(1, one), (2, one + "\nThird"), (3, "Some plain prose without any article around it."), (4, ""), (5, ""), (6, one), (6, "")])
    wrapper = {r.host: r.wrapper for r in html_wrapper.wrappers(df).collect()}["a.example"]
    assert ")?" in wrapper and "( li # )+" in wrapper


def test_html_host_of_two_templates(spark):
    """An article on one page doesn't empty the pages of its host that have none."""
    plain = "<div class=menu>Home</div><div><p>Number {} has plain prose without any container around it.</div>"
    pages = [(1, "http://a.example/1", PAGE.format(ad="", more="")), *((i, f"http://a.example/{i}", plain.format(i)) for i in range(2, 6))]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "Head & line\nFirst bold text.\nSecond é x"} | {i: f"Number {i} has plain prose without any container around it." for i in range(2, 6)}


def test_html_bodies_that_open_alike_or_are_copies(spark):
    """A long common opening doesn't make a body constant, nor do copies of one page; a notice on different pages is."""
    opening = "Our own correspondent reports from the capital, where on this day as on any other"
    page = "<div class=menu>Home</div><div id=x><p>{}</div><div id=y><p>One and the same standing line on every page.</div>"
    bodies = [f"{opening} story number {i} was told." for i in range(6)]
    pages = [(i, f"http://a.example/{i}", page.format(b)) for i, b in enumerate(bodies)]
    pages += [(10 + i, "http://b.example/1", page.format(bodies[0]).replace("Home", f"Home {i}")) for i in range(5)]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert {i: got[i] for i in range(6)} == dict(enumerate(bodies)) and all(got[10 + i].startswith(bodies[0]) for i in range(5))


def brute_main(page):
    """The article's blocks of a page of the test tables, by the library's own parser."""
    import html.parser

    class Reader(html.parser.HTMLParser):
        blocks, depth, skip = None, 0, 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "title"):
                self.skip += 1
            elif tag == "article":
                self.depth += 1
            if tag not in ("b", "i", "a", "br", "em", "strong", "span"):
                self.blocks.append([])
            if tag == "br":
                self.blocks[-1].append(" ")

        def handle_endtag(self, tag):
            if tag in ("script", "style", "title"):
                self.skip -= 1
            elif tag == "article":
                self.depth -= 1
            if tag not in ("b", "i", "a", "br", "em", "strong", "span"):
                self.blocks.append([])

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.blocks[-1].append(data)

    reader = Reader(convert_charrefs=True)
    reader.blocks = [[]]
    reader.feed(page or "")
    reader.close()
    return "\n".join(t for b in reader.blocks if (t := " ".join("".join(b).split())))


def test_html_of_all_pages(spark, sf):
    sf = sf.replace("0.001", "0.01")
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op2_html_wrapper(spark, sf).collect()}
    assert set(got) == set(pages) and all(r.n_chars == len(r.text) for r in got.values())
    assert {i: r.text for i, r in got.items()} == {i: brute_main(h) for i, h in pages.items()}


def test_only_slots_of_the_expression_are_content(monkeypatch):
    page = "<div class=menu>Home</div><div><p>Number {} has plain prose without any container around it.</div>"
    made = []
    for stub in (False, True):
        if stub:
            monkeypatch.setattr(html_wrapper, "merge", lambda w, s: w)
        w = html_wrapper.Wrapper()
        for i in range(3):
            w.add(page.format(i))
        made.append(html_wrapper.main_text(page.format(1), frozenset(w.content())))
    assert made == ["Number 1 has plain prose without any container around it.", ""]


def test_every_page_is_in_its_wrapper():
    """Random, unbalanced and long pages: each of their texts has a slot, whichever way rows are aligned."""
    rng = np.random.default_rng(4)
    parts = ["<div>", "</div>", "<div class=x>", "<p>", "</p>", "text ", "<ul>", "<li>", "</ul>", "<hr>", "<td>", "<section>", "</section>", "<h1>"]
    for most, pairs in ((12, html_wrapper.PAIRS), (60, 50), (600, 1000)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(html_wrapper, "PAIRS", pairs)
            pages = ["".join(rng.choice(parts, rng.integers(1, most))) for _ in range(25 if most < 1000 else 3)]
            w = html_wrapper.Wrapper()
            for page in pages:
                w.add(page)
            slots = html_wrapper.text_slots(w.items)
            for page in pages:
                assert {a for kind, x, a in html_wrapper.events(page) if kind == "text" and x.strip()} <= set(slots)


def test_long_runs_fold():
    row = [f"t{i}" for i in range(40)]
    assert html_wrapper.fold(row * 3) == (("+", tuple(row)),)


def test_wrappers_merge():
    a, b = html_wrapper.fold(["p", "#", "p", "#", "hr"]), html_wrapper.fold(["p", "#", "div", "#", "hr"])
    assert html_wrapper.show(html_wrapper.merge(a, b)) == "( p # )+ ( div # )? hr"
    assert html_wrapper.merge(html_wrapper.merge(a, b), a) == html_wrapper.merge(a, b)


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    made = [exact_dedup.exact_groups(none), simhash.near_groups(none), substring_dedup.repeated_spans(none), token_planes.token_table(none), packing.pack(none), ring_shards.shard(none), decontaminate.leaks(none, bench), html_wrapper.extract(pages), language_id.keep_known(none)]
    assert [df.count() for df in made] == [0] * len(made)


def test_odd_rows_everywhere(spark, odd):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(odd, bench).collect()} == {1, 2, None}
    assert simhash.near_groups(odd).count() == len(ROWS)
    assert packing.pack(odd).agg(F.sum("length")).first()[0] > 30_000


def test_stages_tell_rows_of_one_id_apart(spark):
    """Null and repeated ids, columns with odd names: only the rows that are copies or leaks go."""
    item = " ".join(f"b{i}" for i in range(20))
    rows = [(None, item), (None, "one clean text"), (5, item), (5, "another clean text"), (7, "one  clean text"), (7, "one clean text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "row_", "__id", "__d", "row_id", "sha", "key")})
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = decontaminate.drop_leaks(df, bench)
    assert clean.columns == df.columns and sorted(((r.doc_id or 0, r.text) for r in clean.collect())) == sorted((i or 0, t) for i, t in rows if t != item)
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(5, "another clean text"), (5, item), (7, "one  clean text")]
    assert near_copies.keep_one(df).columns == df.columns


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as P

    table = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(P.STAGES)
    known = stages["language_id"](spark, table, sf)
    assert known.count() >= len(docs) - 2
    plain = stages["exact_dedup"](spark, known, sf)
    left = {r.doc_id: r.text for r in plain.collect()}
    first: dict = {}
    for r in sorted(known.collect(), key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert set(left) == set(first.values()) and plain.columns == table.columns
    near = stages["near_dedup"](spark, plain, sf)
    kept = jaccard_heads(left)
    assert {r.doc_id for r in near.collect()} == kept
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stages["decontamination"](spark, near, sf).collect()}
    grams = lambda t: {tuple(w[i : i + 12]) for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(len(w) - 11)}
    leaked = set().union(*map(grams, items))
    assert all(not grams(left[i]) & leaked for i in clean) and len(clean) > 0.9 * len(kept)
    check_packing(stages["packing"](spark, near.where(F.col("doc_id").isin(*list(clean))), sf).collect(), {i: left[i] for i in clean})


def test_prefix_pairs_find_every_similar_pair(spark):
    from dnslens.llm import near_copies as N

    rng = np.random.default_rng(3)
    base, texts = [f"w{i}" for i in range(90)], []
    for k in range(120):
        words = list(base)
        for i in rng.choice(len(words), k % 7, replace=False):
            words[i] = f"x{k}-{i}"
        texts.append(" ".join(words + [f"own{k}"] * (k % 3) + [f"long{k}-{i}" for i in range(40 * (k % 5 == 0))]))
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(["", "a b", *texts])], "row long, doc_id long, text string")
    sets = [set(s.view(np.int64).tolist()) for s in N.shingle_sets(pa.array(["", "a b", *texts]))]
    chosen = spark.createDataFrame([(i, i % 11, i, len(s)) for i, s in enumerate(sets)], "node long, root long, row_id long, size long")
    similar = {(a, b) for b in range(len(sets)) for a in range(b) if a % 11 != b % 11 and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    bodies, large = N._bodies(rows, "row", chosen.drop("root")).cache(), chosen.select("node", "root")
    found = {(r.a, r.b) for r in N._prefix_pairs(large, bodies, 0.8).collect()}
    assert len(similar) > 100 and similar <= found and all(a % 11 != b % 11 for a, b in found)
    assert len(found) < len(sets) ** 2 / 4
    pairs = spark.createDataFrame(sorted(found), "a long, b long")
    assert {(r.a, r.b) for r in N._checked(N._of_like_size(pairs, bodies, 0.8), bodies, 0.8).collect()} == similar
    counts = N._cell_counts(bodies)
    assert len(counts) == N.CELLS and counts.sum() == sum(map(len, sets))
    assert N._prefix_pairs(large.where("false"), bodies, 0.8).count() == 0


def test_heads_meet_nodes_of_like_size_only(spark):
    from dnslens.llm import near_copies as N

    rows = [(i, size, key, i % 3) for i, size in enumerate([10, 11, 12, 100, 101, 10, 0, 90]) for key in range(6)]
    known = spark.createDataFrame(rows, "node long, size long, key long, root long")
    sizes, found = {r[0]: r[1] for r in rows}, set()
    for turn in range(3):
        found |= {(r.a, r.b) for r in N._met(known, turn, 0.8).collect()}
    assert found and all(a < b and a % 3 != b % 3 and min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]) for a, b in found)


def test_no_language_is_lost_to_copies(spark):
    """Eight languages of equal size, some of which are copies of a few texts: all are learned, and the sample keeps its bounds."""
    rows = [(f"l{k}", f"{chr(97 + k) * 3} word{j % (3 if k % 2 else 3000)} {chr(97 + k)}") for k in range(8) for j in range(3000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    texts, labels = language_id.labelled_sample(df, 100)
    assert set(labels) == {f"l{k}" for k in range(8)} and max(Counter(labels).values()) == 100 and Counter(labels)["l1"] == 3
    texts, labels = language_id.labelled_sample(df, 100, sample_bytes=8 * 200)
    assert set(labels) == {f"l{k}" for k in range(8)} and sum(map(len, texts)) < 8 * 250
    assert len(set(language_id.labelled_sample(df, 100, most=5)[1])) == 5
    big = df.limit(0).unionByName(spark.createDataFrame([("x", "long " * 1000)], "lang string, text string"))
    assert language_id.labelled_sample(big, 100, sample_bytes=10)[1] == ["x"]


def test_toxic_sample_of_repeated_ids(spark):
    """Many texts under one labelled id make one row of the sample."""
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    texts, toxic, _ = toxicity.labelled_sample(docs, labels, 100)
    assert len(texts) == 2 and sorted(toxic) == [0, 1]


def _texts(spark, *pages):
    df = spark.createDataFrame([(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_wrapper.extract(df).orderBy("page_id").collect()]


def test_words_above_an_article_do_not_hide_it(spark):
    page = lambda k, body="single right-sidebar", art="share-enabled": f"<html class='nav'><body class=\"{body}\"><div class='has-sidebar'><article class=\"{art}\"><h1>Storm {k}</h1><p>Words of the story number {k} are these here.</p><div class='share'>Share it now on all of these</div></article></div><div class='comments'><article class='comment'><p>A reader wrote number {k} of the many comments.</p></article></div></body></html>"
    want = [f"Storm {k}\nWords of the story number {k} are these here." for k in range(4)]
    assert _texts(spark, *(page(k) for k in range(4))) == want
    assert _texts(spark, *(page(k, art="post") for k in range(4))) == want


def test_single_quotes_are_quotes(spark):
    for q in "'\"":
        page = lambda k: f"<body><ul class={q}menu{q}><li>Go to the home page of number {k} now</ul><p>Words of the story number {k} are these here, all of them."
        assert _texts(spark, *(page(k) for k in range(4))) == [f"Words of the story number {k} are these here, all of them." for k in range(4)]


def test_short_headings_and_paragraphs_stay(spark):
    """Outside article and main: a heading or paragraph of few words beside long ones."""
    page = lambda k: f"<body><div id='x'><h1>Storm {k}</h1><p>Words of the story number {k} are these here, all of them.</p><p>So it{k} is.</p></div>"
    assert _texts(spark, *(page(k) for k in range(4))) == [f"Storm {k}\nWords of the story number {k} are these here, all of them.\nSo it{k} is." for k in range(4)]


def test_op7_of_all_documents(spark, sf, docs):
    """The query against the library, document after document."""
    import public_tokenizers
    from tokenizers import Tokenizer

    model, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d in sorted(docs):
        ids = [*model.encode(docs[d].text or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op7_bit_planes(spark, sf).collect())) == want


def test_pipeline_run_on_odd_rows(spark, sf, tmp_path):
    """The whole run over nulls, empty, repeated and copied rows, and over no rows: every kept document's ids are in the pieces."""
    import corpus_pipeline as P

    base = spark.read.parquet(f"{sf}/documents.parquet")
    some = base.orderBy("doc_id").limit(60)
    odd_rows = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (1, None, None, None, None), (9001, "12 34", "en", "s", 5)], base.schema)
    for name, table in (("odd", some.unionByName(some.limit(20)).unionByName(odd_rows)), ("none", base.limit(0))):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        rows = P.run(spark, folder).collect()
        if name == "none":
            assert rows == []
            continue
        found = {r.doc_id for r in rows}
        assert found <= {r.doc_id for r in some.collect()} and len(found) > 30  # what has no letters was rejected
        size = Counter()
        for r in rows:
            size[r.doc_id] += r.length
        assert all(size[r.doc_id] == r.doc_tokens for r in rows)  # of repeated rows one was kept


def test_op8_ring_by_brute_force(spark, sf, docs):
    """Every document walks the ring by itself: first those that find room at home, arc by arc, then the overflow clockwise."""
    shards, nodes = 24, ring_shards.ring(24, 128)
    hashed = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.xxhash64(F.col("doc_id").cast("long")).alias("h")).collect()
    homes = defaultdict(list)
    for r in hashed:
        place = (r.h % (1 << 64)) >> 32
        arc = next((k for k, (p, _) in enumerate(nodes) if p >= place), 0)
        homes[arc].append((r.h, r.doc_id))
    room = [len(hashed) // shards + (s < len(hashed) % shards) for s in range(shards)]
    used, want, waiting = [0] * shards, {}, []

    def settle(doc, s):
        want[doc] = (s, used[s])
        used[s] += 1

    for arc in range(len(nodes)):
        for _, doc in sorted(homes[arc]):
            if used[nodes[arc][1]] < room[nodes[arc][1]]:
                settle(doc, nodes[arc][1])
            else:
                waiting.append((arc, doc))
    for arc, doc in waiting:
        while used[nodes[arc % len(nodes)][1]] >= room[nodes[arc % len(nodes)][1]]:
            arc += 1
        settle(doc, nodes[arc % len(nodes)][1])
    rows = queries.op8_ring_shards(spark, sf).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == want and len(rows) == len(docs)
    assert all((r.size, r.text_crc32) == (len((docs[r.doc_id].text or "").encode()) + 8, zlib.crc32((docs[r.doc_id].text or "").encode())) for r in rows)
