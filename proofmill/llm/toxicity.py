"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade >= k | x) = sigmoid(w . x - theta_k): one weight vector for all ordered
thresholds theta_1 < theta_2 < ... The features are log counts of words, and of
the starts of longer words, which their inflections and compounds share. They
are chosen by how far their means in toxic and other texts lie apart. The result
is the expected severity, the sum of P(grade >= k) over k, and the median grade,
the number of thresholds that P reaches a half of; so every grade is reached by
some score.

Labels say only whether a text is toxic. Grades come from cross-fitting: the
labelled rows are halved, a plain logistic model of either half judges the
other, and the toxic rows are cut at the ``tiers`` (shares) of those scores. No
row's grade depends on a model that has seen it.

The model is fitted on about ``sample_rows`` labelled rows of either class, of
which near copies (equal least hashes of three-word runs) count once; thresholds
are then shifted to the share of toxic rows among all labels. Every text is
scored whole. Rows are put in order before sums are taken, so a rerun gives the
same model.

Defined cases: a null or wordless text has no features and the severity of the
thresholds alone; a null label is no label; a label without its document, or
for a repeated document, counts as often as it joins; of near copies with
different labels the toxic one counts; without toxic or without clean labels
nothing is learned and the severity is 0; repeated rows each get their row; other
columns are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm import files, scratch

#: Letters of a word's starts.
STARTS = (4, 5, 6)
#: ASCII letters and all other bytes of UTF-8 letters stay; the rest parts words.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Words whose features a task keeps.
MEMO_WORDS = 500_000


def likeness(text: str | None) -> int | None:
    """The least hash of a text's three-word runs, which near copies mostly share."""
    w = words(text)
    return min((zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=None)


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


def terms_of(word: bytes) -> list[bytes]:
    """The word, and for a longer one its starts (as ``start*``)."""
    letters = word.decode("utf-8", "replace")
    return [word, *[letters[:k].encode("utf-8", "surrogatepass") + b"*" for k in STARTS if len(letters) > k]]


class Terms(dict):
    """Words to the features among their terms; ``known`` None takes all."""

    def __init__(self, known: dict[bytes, int] | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> tuple:
        found = terms_of(word)
        found = tuple(found) if self.known is None else tuple(self.known[t] for t in found if t in self.known)
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = found
        return found

    def counts(self, text: str | None) -> Counter:
        return Counter([t for found in filter(None, map(self.__getitem__, words(text))) for t in found])


@dataclass
class Model:
    """Features with their place, the weights in that order, and the thresholds."""

    features: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def scorer(self):
        """text -> w . x"""
        terms, weights = Terms(self.features), self.weights.tolist()
        return lambda text: sum([weights[f] * np.log1p(n) for f, n in sorted(terms.counts(text).items())])

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1 up, a row a text."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


@dataclass
class Rows:
    """Sparse rows: features and values of row i stand from indptr[i] to indptr[i + 1]."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.indptr) - 1

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self)), np.diff(self.indptr)), w[self.indices] * self.values, len(self))

    def some(self, chosen: np.ndarray) -> Rows:
        keep = np.repeat(chosen, np.diff(self.indptr))
        return Rows(np.concatenate([[0], np.cumsum(np.diff(self.indptr)[chosen])]), self.indices[keep], self.values[keep])


def loss(p: np.ndarray, rows: Rows, grades: np.ndarray, n_features: int, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the grades with a penalty on weights, and its gradient.

    ``p`` holds the weights, the first threshold and the logs of the gaps between thresholds.
    """
    at, k = np.repeat(np.arange(len(rows)), np.diff(rows.indptr)), len(p) - n_features
    w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
    theta = p[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
    low, high = grades - 1, grades  # the thresholds below and above each grade
    score = rows.scores(w)
    up = np.where(low >= 0, 1 / (1 + np.exp(np.clip(theta[np.maximum(low, 0)] - score, -50, 50))), 1.0)
    down = np.where(high < k, 1 / (1 + np.exp(np.clip(theta[np.minimum(high, k - 1)] - score, -50, 50))), 0.0)
    prob = np.maximum(up - down, 1e-12)
    d_up, d_down = up * (1 - up) / prob, down * (1 - down) / prob
    d_score = -(d_up - d_down) / len(rows)
    d_theta = np.bincount(np.maximum(low, 0), np.where(low >= 0, d_up, 0.0), k) - np.bincount(np.minimum(high, k - 1), np.where(high < k, d_down, 0.0), k)
    tail = np.cumsum((d_theta / len(rows))[::-1])[::-1]
    gradient = np.concatenate([np.bincount(rows.indices, d_score[at] * rows.values, n_features) + l2 * w, [tail[0]], tail[1:] * gaps])
    return float(-np.log(prob).mean() + l2 / 2 * (w * w).sum()), gradient


def fit_ordinal(rows: Rows, grades: np.ndarray, n_features: int, n_grades: int, l2: float = 1e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by maximum likelihood of the observed grades (Adam, full batches)."""
    p = np.zeros(n_features + n_grades - 1)
    p[n_features] = 0.5
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        _, gradient = loss(p, rows, grades, n_features, l2)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient * gradient
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:n_features], p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))])


def cross_grades(rows: Rows, toxic: np.ndarray, half: np.ndarray, n_features: int, tiers: tuple[float, ...]) -> np.ndarray:
    """0 for clean rows; for toxic ones 1 plus the tiers that the other half's model puts their score above.

    Where a half lacks a class there is no model of it, and all toxic rows have grade 1.
    """
    scores = np.zeros(len(rows))
    for side in (True, False):
        seen = half == side
        if len(set(toxic[seen])) < 2:
            return toxic.copy()
        w, theta = fit_ordinal(rows.some(seen), toxic[seen], n_features, 2)
        scores[~seen] = rows.some(~seen).scores(w) - theta[0]
    cuts = np.quantile(scores[toxic == 1], tiers)
    return np.where(toxic == 1, 1 + (scores[:, None] > cuts[None, :]).sum(1), 0)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, n_features: int = 1000, tiers: tuple[float, ...] = (1 / 3, 2 / 3), least_held: int = 3, least_t: float = 4.0) -> Model:
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = Model({}, np.zeros(0), np.full(len(tiers) + 1, 500.0))
    if len(sizes) < 2:
        return none

    def liken(batches):
        for batch in batches:
            yield batch.append_column("likeness", pa.array([likeness(t) for t in batch.column("text").to_pylist()], pa.int64()))

    parts = [scratch.sampled(known.where(F.col("toxic") == y), sample_rows, "id") for y in (0, 1)]
    chosen = scratch.stored(parts[0].unionAll(parts[1]), "toxic-labels")  # about twice sample_rows pairs at most
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id").select("text", "toxic")
    rows = rows.mapInArrow(liken, "text string, toxic int, likeness long").groupBy("likeness").agg(F.max(F.struct("toxic", "text")).alias("r"))
    rows = scratch.stored(rows.select("likeness", "r.text", "r.toxic"), "toxic-sample")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return none

    def count(batches):
        """Of each term: texts that hold it, the sums of its log counts, and of their squares."""
        terms, seen = Terms(), {}
        for text, toxic in files.column(batches, "text", "toxic"):
            for t, c in terms.counts(text).items():
                x, s = float(np.log1p(c)), seen.setdefault(t, [0, 0.0, 0.0, 0.0])
                s[0] += toxic
                s[1 + toxic] += x
                s[3] += x * x
        items = list(seen.items())
        for i in range(0, len(items), 10_000):
            some = items[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in some], pa.binary()), *[pa.array([s[j] for _, s in some], kind) for j, kind in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.float64()))]], names=["term", "held", "clean", "toxic", "squares"])

    counted = rows.mapInArrow(count, "term binary, held long, clean double, toxic double, squares double").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("held", "clean", "toxic", "squares")])
    every = n[0] + n[1]
    variance = (F.col("squares") + 0.5) / every - ((F.col("clean") + F.col("toxic")) / every) ** 2
    t = F.round((F.col("toxic") / n[1] - F.col("clean") / n[0]) / F.sqrt(variance * (1 / n[1] + 1 / n[0])), 6)
    chosen_terms = counted.where((F.col("held") >= least_held) & (t >= least_t)).orderBy(t.desc(), "term").limit(n_features).collect()
    index = {bytes(r.term): i for i, r in enumerate(chosen_terms)}

    def vectors(batches):
        terms = Terms(index)
        for batch in batches:
            found = [sorted(terms.counts(text).items()) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("likeness"), batch.column("toxic"), pa.array([[f for f, _ in c] for c in found], pa.list_(pa.int32())), pa.array([[x for _, x in c] for c in found], pa.list_(pa.int32()))], names=["likeness", "toxic", "ids", "counts"])

    got = sorted(rows.mapInArrow(vectors, "likeness long, toxic int, ids array<int>, counts array<int>").collect(), key=lambda r: -1 if r.likeness is None else r.likeness)
    sparse = Rows(np.concatenate([[0], np.cumsum([len(r.ids) for r in got])]).astype(np.int64), np.array([i for r in got for i in r.ids], np.int64), np.log1p(np.array([c for r in got for c in r.counts], float)))
    half = np.array([zlib.crc32(str(r.likeness).encode()) % 2 == 0 for r in got])
    size = max(1, len(index))
    grades = cross_grades(sparse, np.array([r.toxic for r in got]), half, size, tiers)
    w, theta = fit_ordinal(sparse, grades, size, len(tiers) + 2)
    theta = theta + np.log((sizes[0] / n[0]) / (sizes[1] / n[1]))  # back to the share among all labels
    return Model(index, w, theta)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, grade, expected_severity, p_toxic and toxic (of grade 1 or more) of every row."""

    def predict(batches):
        of = model.scorer()
        for batch in batches:
            above = model.above(np.array([of(t) for t in batch.column("text").to_pylist()], float))
            grades = (above >= 0.5).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(grades.astype(np.int32)), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(grades > 0)],
                names=[id_col, "grade", "expected_severity", "p_toxic", "toxic"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, f"`{id_col}` long, grade int, expected_severity double, p_toxic double, toxic boolean")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
