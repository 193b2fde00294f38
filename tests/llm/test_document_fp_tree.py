"""Ranked search over FP-trees against brute force and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from dnslens.llm import document_fp_tree as fp
from dnslens.llm import queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UP = str.maketrans(fp.UPPER, fp.LOWER)


def terms_of(text):
    return TERM.findall((text or "").translate(UP))


def brute(docs, items, k=20):
    """All scores, in whole numbers; rows of (item_id, rank, doc_id, score)."""
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, total = len(counts), sum(x for *_, x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, size in counts:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÀB", "x²", "日本", "K"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randrange(1, 40))) for _ in range(n)]
    texts += [texts[0]] * 30 + [texts[0] + " w3"] * 10 + ["W1 w1,w1;W2", "", "...", None, "été K k"]
    return [(None if i % 97 == 5 else i % 400, t) for i, t in enumerate(texts)]


ITEMS = [(1, "w0 w1 w1 W2"), (1, "w40"), (2, None), (3, ""), (None, "w5 w50"), (4, "absent"), (5, "été, K日 x²"), (6, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize(("tree", "piece"), [(fp.TREE_DOCS, fp.SLICE), (64, 16)])
def test_search_is_exact(spark, monkeypatch, tree, piece):
    """Also over many small trees, and with every text cut in parts."""
    monkeypatch.setattr(fp, "TREE_DOCS", tree)
    monkeypatch.setattr(fp._parts, "__defaults__", (piece,))
    docs = corpus(1, 600)
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item int, terms string").repartition(3)
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")
    assert rows(fp.search(frame, items)) == brute(docs, ITEMS)
    assert rows(fp.search(frame, items, k=3, item_bytes=40)) == brute(docs, ITEMS, 3)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert rows(fp.search(docs, items)) == rows(fp.search(some, items)) == rows(fp.search(docs, some.withColumnRenamed("doc_id", "item_id"))) == []


def _tree(docs):
    vocabulary = sorted({t for d in docs for t in terms_of(d)})
    words = fp.Vocabulary(vocabulary)
    n, doc, term, tf = fp._vectors(pa.array(docs), words)
    df = np.bincount(term, minlength=len(vocabulary))
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    by = np.lexsort((rank[term], doc))
    return fp.Tree(doc[by], rank[term][by], tf[by], fp.lengths(n, len(docs), int(n.sum()))), {t: int(r) for t, r in zip(vocabulary, rank, strict=True)}, n


def test_paths_are_shared():
    """Documents with the same beginning share its nodes; each node knows the greatest tf and least m below it."""
    tree, rank, n = _tree(["a b c", "a b d d", "a b", "a b c c c x y", "z z z z"])
    assert len(tree.lo) == 6 and tree.levels == [0, 1, 3, 5, 6]  # root; a b and z; c and d; x y
    shared = tree.parent == 0
    assert tree.m_min[0] == tree.m.min() and (tree.m_min[shared] >= tree.m_min[0]).all()
    at = np.flatnonzero(tree.link_term == rank["c"])
    assert len(at) == 1 and tree.link_tf[at[0]] == 3
    assert len(np.flatnonzero(tree.link_term == rank["a"])) == 1


def test_bounds_cut_subtrees(monkeypatch):
    """Most documents are never scored exactly, and the best are right."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=30)) for _ in range(2000)]
    docs += ["w290 w291 w292 w293 w294"] * 3
    tree, rank, _ = _tree(docs)
    scored = []
    run = tree._tf
    tree._tf = lambda d, r: scored.append(len(d)) or run(d, r)
    best = fp.Best(3).within(np.arange(len(docs)), np.zeros(len(docs), bool))
    its = np.sort(np.array([rank[f"w{i}"] for i in range(290, 295)]))
    tree.search(its, np.full(5, 1000), best)
    assert best.doc.tolist() == [2000, 2001, 2002] and sum(scored) < 100


def test_terms_of_one_hash(monkeypatch):
    monkeypatch.setattr(fp, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    n, doc, term, tf = fp._vectors(pa.array(["ab cd ef ab", "zz cd"]), fp.Vocabulary(["ab", "cd", "ef"]))
    assert n.tolist() == [4, 2] and list(zip(doc.tolist(), term.tolist(), tf.tolist(), strict=True)) == [(0, 0, 2), (0, 1, 1), (0, 2, 1), (1, 1, 1)]


def test_op13_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    want = con.sql("select item_id, rank, doc_id, score from (" + queries.ORACLE_SQL["op13_fp_tree"] + ")").fetchall()
    assert rows(queries.op13_fp_tree(spark, sf)) == sorted(want, key=str) and len(want) == 800
