"""Toxicity by cumulative-link ordinal regression.

P(grade <= j) = 1 / (1 + exp(w.x - t_j)): one weight vector for all thresholds t_0 < t_1 < ..., so that
evidence moves a text along one scale. Features are signed and sparse: which of the words that speak for
toxicity a text has, and how large a share of its words speaks against it. The labels say only toxic or
not; how severe a toxic training text is comes from held-out evidence: folds of the sample are scored by
a model of the other folds, and a toxic text that those find more toxic than they find the median toxic
text is severe (grade 2), else mild (grade 1). The output is the expected grade and the most likely one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_and_text, slices, text_bytes
from .shingles import shingle_hashes, word_hashes

#: The fit's bound: about so many toxic and other labelled rows (chosen by a hash of doc_id), and words with a weight on either side.
TOXIC_ROWS, OTHER_ROWS, MAX_WORDS = 3000, 6000, 1000
#: A word is a feature where its shares in toxic and other texts differ by this many standard errors.
LEAST_Z = 5.0
#: At least this many training texts of the side that a word speaks for have it.
LEAST_TEXTS = 3
GRADES, FOLDS = 3, 3
#: A text all of whose words speak against toxicity has so much of that feature.
SHARE = 20.0
SCORED = "doc_id long, expected_severity double, grade int, toxic boolean"
WORDS = "doc_id long, toxic boolean, passage long, n_words long, words array<long>"
#: Letters (a-z and all bytes of other scripts) make words; all else separates.
_BETWEEN = np.array([not (97 <= b <= 122 or b >= 128) for b in range(256)])


@dataclass
class Model:
    words: np.ndarray  # ascending 64-bit hashes
    weights: np.ndarray
    against: np.ndarray  # whether a word counts by its share of the text
    thresholds: np.ndarray  # ascending, GRADES - 1


@dataclass
class Sparse:
    """Rows of sparse features as coordinates."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.column], minlength=self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * g[self.row], minlength=self.shape[1])

    def rows(self, keep: np.ndarray) -> Sparse:
        place = np.cumsum(keep) - 1
        has = keep[self.row]
        return Sparse(place[self.row[has]], self.column[has], self.value[has], (int(keep.sum()), self.shape[1]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the distinct word hashes, the number of words, and the smallest shingle hash, which near copies mostly share."""
    for batch in slices(batches):
        data, starts = text_bytes(batch.column("text"))
        h, at = word_hashes(data, starts, _BETWEEN)
        s, s_at = shingle_hashes(*word_hashes(data, starts))
        words = [np.unique(h[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
        passage = [int(s[a:b].min().view(np.int64)) if b > a else None for a, b in zip(s_at[:-1], s_at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(passage, pa.int64()), pa.array(np.diff(at)), pa.array(words, pa.list_(pa.int64()))], [f.split()[0] for f in WORDS.split(", ")])


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """WORDS of at most about TOXIC_ROWS + OTHER_ROWS labelled rows, chosen by a hash of doc_id; near copies count once. Texts stay in their tasks."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    n = lab.agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("other")).first()
    rate = lambda most, have: int(min(1.0, most / max(have, 1)) * 10**9) + 1
    place = F.pmod(F.xxhash64("doc_id"), F.lit(10**9))
    lab = lab.filter(place < F.when(F.col("toxic"), rate(TOXIC_ROWS, n.bad)).otherwise(rate(OTHER_ROWS, n.other))).groupBy("doc_id").agg(F.bool_or("toxic").alias("toxic"))
    rows = id_and_text(docs).join(F.broadcast(lab), "doc_id").select("doc_id", "text", "toxic").mapInArrow(_words, WORDS)  # lab has the sample's bound
    row = F.struct(*[f.split()[0] for f in WORDS.split(", ")])
    return rows.filter("passage IS NOT NULL").groupBy("passage").agg(F.min_by(row, F.struct("doc_id", "n_words")).alias("row")).select("row.*")


def fit_ordinal(x: Sparse, grade: np.ndarray, grades: int = GRADES, steps: int = 800, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ascending thresholds by gradient descent (with momentum) on the mean cumulative log-loss.

    Each threshold is a binary problem, grade > j, and all have the same weights; thresholds are the running sum of
    a first one and non-negative gaps."""
    n, k = x.shape[0], grades - 1
    above = (grade[:, None] > np.arange(k)[None, :]).astype(float)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    weight = np.where(above > 0, 0.5 / share, 0.5 / (1 - share))  # both sides of a threshold weigh alike
    w, t = np.zeros(x.shape[1]), np.linspace(0.5, 1.5, k)
    vw, vt = np.zeros_like(w), np.zeros_like(t)
    for _ in range(steps):
        g = weight * (_sigmoid(x.times(w)[:, None] - t[None, :]) - above) / n
        vw = 0.9 * vw - rate * (x.transposed_times(g.sum(1)) + decay * w)
        vt = 0.9 * vt + rate * g.sum(0)
        w, t = w + vw, np.maximum.accumulate(t + vt)
    return w, t


def held_out_grades(x: Sparse, toxic: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """0 for clean rows; for toxic ones 2 if a model of the other folds scores them above its median toxic row, else 1."""
    held = np.zeros(len(toxic))
    for f in range(FOLDS):
        rest = fold != f
        if toxic[rest].any() and not toxic[rest].all():
            w, t = fit_ordinal(x.rows(rest), toxic[rest].astype(int), 2, 300)
            held[~rest] = x.rows(~rest).times(w) - t[0]
    middle = np.median(held[toxic]) if toxic.any() else 0.0
    return np.where(toxic, 1 + (held > middle), 0)


def features(rows: list, words: np.ndarray, against: np.ndarray) -> Sparse:
    """``rows``: (n_words, hashes of words that are among ``words``)."""
    size = np.array([len(r[1]) for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    column = np.searchsorted(words, np.array([w for r in rows for w in r[1]], np.int64).view(np.uint64))
    total = np.maximum([r[0] for r in rows], 1)
    return Sparse(row, column, np.where(against[column], SHARE / total[row], 1.0), (len(rows), len(words)))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, from a bounded sample of the labelled documents; None without both labels.

    The driver gets at most 2 * MAX_WORDS words, and which of them each sampled text has."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.write(sample(docs, labels), "toxicity-sample")
        n1, n0 = rows.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
        if not n1 or not n0:
            return None
        df = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("fine"))
        p = (F.col("bad") + F.col("fine")) / (n1 + n0)
        z = (F.col("bad") / n1 - F.col("fine") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
        df = df.withColumn("z", z)
        speaks = lambda side, most: df.filter((F.col(side) >= LEAST_TEXTS) & (most >= LEAST_Z)).orderBy(most.desc(), "word").limit(MAX_WORDS).select("word", "z").collect()
        chosen = sorted((np.int64(r.word).view(np.uint64), r.z < 0) for r in speaks("bad", F.col("z")) + speaks("fine", -F.col("z")))
        words, against = np.array([w for w, _ in chosen], np.uint64), np.array([a for _, a in chosen], bool)
        has = F.filter("words", lambda w: w.isin([int(x) for x in words.view(np.int64)])) if len(words) else F.array().cast("array<long>")
        got = sorted(rows.select("doc_id", "toxic", "n_words", has.alias("has"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).alias("fold")).collect(), key=lambda r: r.doc_id)
    toxic, fold = np.array([r.toxic for r in got], bool), np.array([r.fold for r in got])
    x = features([(r.n_words, r.has) for r in got], words, against)
    w, t = fit_ordinal(x, held_out_grades(x, toxic, fold))
    return Model(words, w, against, t)


def scores(texts: list[str], model: Model) -> np.ndarray:
    """w.x for each text."""
    data, starts = text_bytes(pa.array(texts, pa.string()))
    h, at = word_hashes(data, starts, _BETWEEN)
    low = np.zeros(1 << 16, bool)
    low[(model.words & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(low[(h & np.uint64(0xFFFF)).astype(np.int64)])
    k = np.minimum(np.searchsorted(model.words, h[maybe]), max(len(model.words) - 1, 0))
    hit = model.words[k] == h[maybe] if len(model.words) else np.zeros(0, bool)
    text = np.searchsorted(at, maybe[hit], side="right") - 1
    pairs = np.unique(np.stack([text, k[hit]], 1), axis=0)
    value = np.where(model.against[pairs[:, 1]], SHARE / np.maximum(np.diff(at), 1)[pairs[:, 0]], 1.0)
    return np.bincount(pairs[:, 0], weights=value * model.weights[pairs[:, 1]], minlength=len(texts))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, expected_severity (0 to GRADES - 1), grade (the most likely), toxic (grade above 0 more likely than not).

    Null text counts as empty; without a model all is clean (severity 0); a null doc_id stays null; repeated rows each get
    theirs; other columns are ignored; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * MAX_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches):
            n = batch.num_rows
            above = np.zeros((n, GRADES - 1)) if m is None else _sigmoid(scores(batch.column("text").to_pylist(), m)[:, None] - m.thresholds[None, :])
            each = -np.diff(np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(above.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)], [f.split()[0] for f in SCORED.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCORED)
