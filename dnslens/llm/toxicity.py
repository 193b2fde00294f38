"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

Words are hashed to rows of an embedding table; filters of widths 1, 2 and 3 slide over them; the largest value of each
filter goes through a linear layer. Training uses a bounded sample of labelled documents (`per_class` of each class);
every text is scored as a whole, in pieces that overlap by the widest filter less one. For each language - as found in
the text by `language_id`, never as given - the threshold with the best F1 on a part of the sample that training doesn't see
becomes score 0.5.

Null and empty texts are scored like a text without any feature. With no labelled rows every score is 0. A null label
isn't learned from; a doc_id with several labels counts by each. Repeated rows are scored alike, each as a row of its own; an
empty table gives an empty result; where a filter's largest value occurs twice, training moves the first place. Other
columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens.llm import language_id
from dnslens.llm.common import slices, text_buffer, texts_of, without_marks, word_hashes, word_spans

ROWS, WIDTH, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 12
#: Words in fewer training documents than this stand for nothing.
LEAST_DOCS = 4
SMOOTH = 4.0
#: A language's own threshold counts as much as the common one from so many toxic held-out rows on.
STEADY = 40
PIECE = 1 << 15


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words of lower-case texts in a buffer, and each text's first. Punctuation doesn't count. Row 0 is for rare words."""
    soft = without_marks(data)
    starts, ends, first = word_spans(soft, offsets)
    return ((word_hashes(soft, starts, ends) >> np.uint64(40)) % np.uint64(ROWS - 1) + np.uint64(1)).astype(np.int32), first


@dataclass
class ToxicityModel:
    table: np.ndarray
    filters: list[np.ndarray]  # for each width: (width * WIDTH) x FILTERS
    offsets: list[np.ndarray]
    out: np.ndarray
    bias: float
    shifts: dict[str, float] = field(default_factory=dict)  # by language: the logit that becomes score 0.5
    languages: language_id.LanguageModel | None = None

    def features(self, rows: np.ndarray, with_places: bool = False):
        """The largest value of each filter over a document (0 at least), and where it is."""
        n = WIDTHS[-1] - 1
        rows = np.concatenate([rows, np.zeros(max(0, n + 1 - len(rows)), np.int32)])
        best, place = np.zeros(len(self.out), np.float32), np.full(len(self.out), -1)
        for lo in range(0, max(1, len(rows) - n), PIECE):
            e = self.table[rows[lo : lo + PIECE + n]]
            for k, w in enumerate(WIDTHS):
                last = len(e) - w + 1
                z = e[:last] @ self.filters[k][:WIDTH]
                for j in range(1, w):
                    z += e[j : last + j] @ self.filters[k][j * WIDTH : (j + 1) * WIDTH]
                z += self.offsets[k]
                top = z.argmax(0)
                value = z[top, np.arange(FILTERS)]
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                more = value > best[cols]
                best[cols] = np.where(more, value, best[cols])
                place[cols] = np.where(more, top + lo, place[cols])
        return (best, place, rows) if with_places else best

    def logit(self, rows: np.ndarray) -> float:
        return float(self.features(rows) @ self.out + self.bias)

    def score(self, rows: np.ndarray, language: str) -> float:
        z = self.logit(rows) - self.shifts.get(language, self.shifts.get("", 0.0))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: list[np.ndarray], labels: list[int], languages: list[str], prevalence: float = 0.5, epochs: int = 6, rate: float = 0.03, seed: int = 1) -> ToxicityModel | None:
    """Fits the network by Adagrad on single documents, keeps the best epoch by held-out rows, then sets a threshold for each language.

    prevalence: the share of toxic rows outside the sample, by which thresholds weigh errors.
    """
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    n, k = len(WIDTHS) * FILTERS, len(WIDTHS)
    order = rng.permutation(len(docs))
    held, learned = order[: len(docs) // 5], order[len(docs) // 5 :]
    with_word = np.zeros((2, ROWS))
    for i in learned:
        with_word[labels[i], np.unique(docs[i])] += 1
    common = with_word.sum(0)
    share = np.array([sum(1 for i in learned if labels[i] == c) for c in (0, 1)]) / max(1, len(learned))
    odds = np.log((with_word[1] / max(share[1], 1e-6) + 2 * SMOOTH) / (with_word[0] / max(share[0], 1e-6) + 2 * SMOOTH))
    table = rng.normal(0, 0.05, (ROWS, WIDTH)).astype(np.float32)
    table[:, 0] = odds  # embeddings start from how often their words are toxic, which filters start by looking at
    table[common < LEAST_DOCS] = 0
    m = ToxicityModel(table, [rng.normal(0, 0.1, (w * WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.02, n).astype(np.float32), 0.0)
    for f in m.filters:
        f[::WIDTH] += 0.5 / (len(f) // WIDTH)
    m.out += 2.0 / n
    seen = [np.full_like(x, 1e-1) for x in (m.table, *m.filters, *m.offsets, m.out)]
    weight = {1: 0.5 * len(labels) / max(1, sum(labels)), 0: 0.5 * len(labels) / max(1, len(labels) - sum(labels))}
    bias_seen = 1e-2
    y, lang = np.array([labels[i] for i in held]), np.array([languages[i] for i in held])
    best_loss, best_model, z = np.inf, None, np.zeros(len(held))

    def step(x: np.ndarray, s: np.ndarray, at, g: np.ndarray) -> None:
        s[at] += g * g
        x[at] -= rate * g / np.sqrt(s[at])

    for _ in range(epochs):
        for i in rng.permutation(learned):
            best, place, rows = m.features(docs[i], True)
            g = np.float32(weight[labels[i]] * (1 / (1 + np.exp(-np.clip(best @ m.out + m.bias, -30, 30))) - labels[i]))
            if abs(g) < 1e-2:
                continue
            back = g * m.out
            step(m.out, seen[-1], slice(None), g * best)
            bias_seen += g * g
            m.bias -= float(rate * g / np.sqrt(bias_seen))
            for c, w in enumerate(WIDTHS):
                for f in np.flatnonzero((place[c * FILTERS : (c + 1) * FILTERS] >= 0) & (np.abs(back[c * FILTERS : (c + 1) * FILTERS]) > 1e-4)).tolist():
                    d = back[c * FILTERS + f]
                    at = rows[place[c * FILTERS + f] :][:w]
                    window = m.table[at].reshape(-1)
                    down = (d * m.filters[c][:, f]).reshape(w, WIDTH) * (common[at] >= LEAST_DOCS)[:, None].astype(np.float32)
                    step(m.filters[c], seen[1 + c], (slice(None), f), d * window)
                    step(m.offsets[c], seen[1 + k + c], f, d)
                    step(m.table, seen[0], at, down)
        now = np.array([m.logit(docs[i]) for i in held])
        if len(held) and (loss := float(np.mean([weight[c] * np.logaddexp(0, -v if c else v) for v, c in zip(now, y, strict=True)]))) < best_loss:
            best_loss, z, best_model = loss, now, ([m.table.copy(), [x.copy() for x in m.filters], [x.copy() for x in m.offsets], m.out.copy(), m.bias])
    if best_model:
        m.table, m.filters, m.offsets, m.out, m.bias = best_model
    for name in ["", *sorted(set(languages))]:
        at = (lang == name) if name else np.ones(len(z), bool)
        if len(set(y[at])) == 2:
            toxic, own = int(y[at].sum()), _threshold(z[at], y[at], prevalence)
            m.shifts[name] = (own * toxic + m.shifts[""] * STEADY) / (toxic + STEADY) if name else own
    return m


def _threshold(z: np.ndarray, y: np.ndarray, prevalence: float) -> float:
    """The middle of the cuts with the best F1 at the given prevalence."""
    by = np.argsort(z)
    z, y = z[by], y[by]
    hit = (1 - np.cumsum(y) / max(1, y.sum())) * prevalence
    wrong = (1 - np.cumsum(1 - y) / max(1, (1 - y).sum())) * (1 - prevalence)
    f1 = (2 * hit / (hit + wrong + prevalence))[:-1]
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    i = best[len(best) // 2]
    return float((z[i] + z[i + 1]) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, where: Column | None = None) -> tuple[list[str], list[int], float]:
    """A bounded sample of labelled texts: of each class a share of its rows, by a hash, that makes about per_class.

    The chosen ids (bounded as well) are what the documents are read by; of texts that share an id one is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known if where is None else known.where(where)
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return [], [], 0.5
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11) / F.lit(float(1 << 53))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))))
    chosen = known.where(u < share[F.col("toxic")]).distinct()
    found = texts_of(docs).where("text is not null").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = one.select("text", "toxic").distinct().toArrow()
    order = sorted(zip(got.column("text").to_pylist(), got.column("toxic").to_pylist(), strict=True))
    return [x[0] for x in order], [x[1] for x in order], counts[1] / (counts[0] + counts[1])


def fit(docs: DataFrame, labels: DataFrame, languages: language_id.LanguageModel, per_class: int = 2000, where: Column | None = None) -> ToxicityModel | None:
    texts, toxic, prevalence = labelled_sample(docs, labels, per_class, where)
    words, first = word_rows(*text_buffer(pa.array(texts, pa.string()), lower=True))
    rows = [words[lo:hi] for lo, hi in zip(first[:-1], first[1:], strict=True)]
    found = [_language(languages, t) for t in texts]
    model = train(rows, toxic, found, prevalence)
    if model:
        model.languages = languages
    return model


def _language(languages: language_id.LanguageModel, text: str | None) -> str:
    p = languages.scores(text)
    return language_id.UNKNOWN if p is None else languages.languages[int(p.argmax())]


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """One row per document: doc_id, score, language (as found in the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the tables' fixed size: about 6 MB

    def run(batches):
        m = shared.value
        for b in batches:
            data, offsets = text_buffer(b.column("text"), lower=True)
            scores, found = [], []
            for lo, hi in slices(offsets) if m else []:
                rows, first = word_rows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for k in range(hi - lo):
                    found.append(_language(m.languages, b.column("text")[lo + k].as_py()))
                    scores.append(m.score(rows[first[k] : first[k + 1]], found[-1]))
            scores, found = (scores, found) if m else ([0.0] * b.num_rows, [None] * b.num_rows)
            yield pa.record_batch([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, pa.string())], names=["doc_id", "score", "language"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double, language string")
