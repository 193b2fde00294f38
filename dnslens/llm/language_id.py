"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy, with calibrated rejection.

A text is the mean of the embeddings of its character 2-, 3- and 4-grams (lower case, white space runs as one space),
hashed to a fixed number of rows. Training rows are a bounded sample, at most `per_language` texts of each language
and SAMPLE_BYTES in all; every text is scored as a whole. A temperature, fitted on a part of the sample that training doesn't see, calibrates the
scores, and the rejection threshold is SLACK times the score that all but `reject_share` of that part reach.

`und` (score 0) if the text is null or has no letter. With no labelled rows every text is `und`. Of equal scores the language
that sorts first is predicted. Repeated rows are separate rows (a copied text is learned once); an empty table gives an empty
result; very long texts are read in parts that overlap, so none of their subwords is lost; other columns don't matter.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslens.llm.common import texts_of

BUCKETS, WIDTH, UNKNOWN = 1 << 15, 16, "und"
#: Languages that are learned at most, and bytes of the texts that they are learned from (and one text more for each).
LANGUAGES, SAMPLE_BYTES = 1000, 128 << 20
#: Characters in work at once.
PART = 1 << 18
#: A text is rejected under this share of the score that nearly all calibration texts reach.
SLACK = 0.6
_MULTIPLIERS = tuple(np.uint32(m) for m in (2654435761, 2246822519, 3266489917, 668265263))


def subword_parts(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the character 2-, 3- and 4-grams of a text, of those that begin in each PART characters."""
    whole = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for lo in range(0, len(whole), PART):
        code = whole[lo : lo + PART + 3]
        out, mixed = [], code * _MULTIPLIERS[0]
        for n in (1, 2, 3):
            mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * _MULTIPLIERS[1] + code[n:] * _MULTIPLIERS[n]
            gram = mixed[:PART]
            out.append((gram ^ (gram >> np.uint32(13))) * _MULTIPLIERS[2] >> np.uint32(17))
        yield np.concatenate(out)


def subwords(text: str) -> np.ndarray:
    """All of them."""
    return np.concatenate(list(subword_parts(text)))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages: embeddings times the softmax's matrix
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, text: str | None) -> np.ndarray | None:
        """Calibrated probabilities; None if there is nothing to go by."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return None
        total, n = np.zeros(len(self.languages)), 0
        for b in subword_parts(text):
            total, n = total + self.weights[b].sum(0, dtype=np.float64), n + len(b)
        z = (total / n + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


class _Runs:
    """Runs of words as buckets and their shares, in two growing arrays: thousands of small ones would stay with the driver."""

    def __init__(self):
        self.buckets, self.shares, self.ends, self.labels, self.whole = array("H"), array("f"), [0], [], []

    def add(self, buckets: np.ndarray, shares: np.ndarray, label: int, whole: bool) -> None:
        self.buckets.frombytes(buckets.astype(np.uint16).tobytes())
        self.shares.frombytes(shares.tobytes())
        self.ends.append(len(self.buckets))
        self.labels.append(label)
        self.whole.append(whole)

    def __len__(self) -> int:
        return len(self.labels)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.ends[i], self.ends[i + 1])
        return np.frombuffer(self.buckets, np.uint16)[at], np.frombuffer(self.shares, np.float32)[at]


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.5, reject_share: float = 0.001, seed: int = 1) -> LanguageModel:
    """Fits embeddings and softmax by SGD over whole texts and short runs of their words; then temperature and threshold."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(languages)}
    rows, held = _Runs(), _Runs()
    for i, (t, label) in enumerate(zip(texts, labels, strict=True)):
        if not any(map(str.isalpha, t)):
            continue
        words, runs = t.split(), [t]
        for n in (4, 12):
            at = int(rng.integers(0, max(1, len(words) - n + 1)))
            runs.append(" ".join(words[at : at + n]))
        for run in runs:
            b, c = np.unique(subwords(run), return_counts=True)
            (held if i % 8 == 0 else rows).add(b, (c / c.sum()).astype(np.float32), number[label], run is t)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    matrix, bias = rng.normal(0, 0.3, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            (b, share), y = rows[i], rows.labels[i]
            now = rate * (1 - done / steps)
            done += 1
            hidden = share @ table[b]
            g = _softmax(hidden @ matrix + bias)
            g[y] -= 1
            back = matrix @ g
            matrix -= now * np.outer(hidden, g)
            bias -= now * 0.1 * g
            table[b] -= now * 20 * share[:, None] * back
    weights = table @ matrix
    held = held or rows
    z = np.array([share @ weights[b] + bias for b, share in map(held.__getitem__, range(len(held)))])
    y = np.array(held.labels)
    losses = [(-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean(), t) for t in np.geomspace(0.05, 20, 60)] if len(y) else [(0.0, 1.0)]
    temperature = float(min(losses)[1])
    right = _softmax(z / temperature) if len(y) else np.zeros((0, len(languages)))
    best = right.max(1)[(right.argmax(1) == y) & np.array(held.whole, bool)] if len(y) else np.zeros(0)
    threshold = float(min(0.5, SLACK * np.quantile(best, reject_share))) if len(best) else 0.0
    return LanguageModel(languages, weights.astype(np.float32), bias, temperature, threshold)


def labelled_sample(docs: DataFrame, per_language: int = 1500, where: Column | None = None, most: int = LANGUAGES, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts: of each language those with the least hashes, about per_language different ones.

    Shares are of a language's different texts, so copies crowd none out. `most` languages are learned (those with the most
    different texts; the model has 128 KB for each), and of each as many texts as its part of sample_bytes holds, but at least one.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = (rows if where is None else rows.where(where)).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    h = F.xxhash64("text", F.lit(3))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(h, 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(most)  # at most `most` rows
    share = counts.select("lang", F.least(F.lit(1.0), 1.1 * per_language / F.col("n")).alias("share"))
    u = F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))
    few = rows.join(F.broadcast(share), "lang").where(u < F.col("share")).select("lang", "text").distinct()
    before = Window.partitionBy("lang").orderBy(h, "text").rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumns({"size": F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)), "place": F.count("*").over(before)})
    room = sample_bytes // max(1, counts.count())
    got = few.where((F.col("size") < room) & (F.col("place") < per_language)).select("lang", "text").toArrow()
    order = sorted(zip(got.column("text").to_pylist(), got.column("lang").to_pylist(), strict=True))
    return [x[0] for x in order], [x[1] for x in order]


def fit(docs: DataFrame, per_language: int = 1500, where: Column | None = None) -> LanguageModel:
    return train(*labelled_sample(docs, per_language, where))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected (no letters, or a score under the threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages: 128 KB each

    def run(batches):
        m = shared.value
        for b in batches:
            names, scores, rejected = [], [], []
            for t in b.column("text"):
                p = m.scores(t.as_py())
                names.append(UNKNOWN if p is None else m.languages[int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
                rejected.append(p is None or scores[-1] < m.threshold)
            yield pa.record_batch([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return texts_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, per_language: int = 1500) -> DataFrame:
    """docs without those that language ID rejects; all columns stay. Decided row by row: no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language))
    schema = docs.schema

    def run(batches):
        m = shared.value
        for b in batches:
            keep = []
            for t in b.column("text").cast(pa.string()):
                p = m.scores(t.as_py())
                keep.append(p is not None and float(p.max()) >= m.threshold)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


