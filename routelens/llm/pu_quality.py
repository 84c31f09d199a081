"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good documents; unlabelled text is all that may be
learnt from, whatever its label, and so has the mixture's own share of good
documents. The class prior is estimated by
the best bin: the least ratio of the tails of unlabelled to positive scores of a
first classifier, over halves that it wasn't fitted on. A small network then
minimises the non-negative unbiased risk
``prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive))``.

Inputs are statistics of the whole text only: shares of character classes, word
lengths, repetition of neighbouring words, line shape. The fit learns from at most
``FIT_TEXTS`` distinct positive and ``FIT_TEXTS`` distinct unlabelled texts, those with the
smallest hashes; each counts as often as rows have it, so the mixture's shares stay what they are however
many copies a text has. Texts stay in their tasks: only their statistics come to the driver. Every row is scored.

Null texts count as empty and are scored as such. Without a trusted positive every score is 0.5. Repeated rows repeat, and count
again in the fit; a doc_id with several labels is a positive if any of them says so, conflicting ones included. A null
doc_id is never learnt from and isn't held out. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import POWERS, U64, mapped, mix, prefix_hash, slices, spread, table, texts_of

#: Most distinct texts of either kind that the fit reads.
FIT_TEXTS = 6000
OUT = "doc_id long, held_out boolean, score double, predicted int"
FEATURES = (
    "log_length", "upper", "digit", "space", "newline", "common_mark", "exclaim", "odd_mark", "other",
    "word_length", "word_length_spread", "repeat_1", "repeat_2", "one_char_words", "marked_words", "line_length", "same_char",
)


def _classes() -> np.ndarray:
    """Class of each code point below 0x3000: 0 lower, 1 upper, 2 digit, 3 space, 4 newline, 5 common mark, 6 exclamation, 7 odd mark, 8 other letter."""
    out = np.full(0x3000, 7, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        if c == "\n":
            out[i] = 4
        elif c.isspace():
            out[i] = 3
        elif c.islower():
            out[i] = 0
        elif c.isupper():
            out[i] = 1
        elif c.isdigit():
            out[i] = 2
        elif c in ".,;:'\"()-?’“”«»¿¡–—":
            out[i] = 5
        elif c == "!":
            out[i] = 6
        elif c.isalpha():
            out[i] = 8
    return out


CLASSES = _classes()


def features(texts: list[str]) -> np.ndarray:
    """A row of statistics for each whole text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in slices([len(t) + 1 for t in texts]):
        out[a:b] = _features(texts[a:b])
    return out


def _features(texts: list[str]) -> np.ndarray:
    # A newline closes each text, so that no word or run goes on into the next.
    units = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(sizes) - sizes
    kind = np.where(units < 0x3000, CLASSES[np.minimum(units, 0x2FFF)], 8).astype(np.uint8)
    length = np.maximum(sizes - 1, 1).astype(float)
    count = lambda mask: np.add.reduceat(mask, begins, dtype=np.int64).astype(float)
    shares = [count(kind == k) for k in range(9)]
    shares[4] = shares[4] - 1
    letters = np.maximum(shares[0] + shares[1] + shares[8], 1)
    same = np.zeros(len(units), bool)
    same[1:] = (units[1:] == units[:-1]) & (kind[1:] != 4)
    solid = (kind != 3) & (kind != 4)
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(begins, first, side="right") - 1
    size = (last - first).astype(float)
    per = lambda w: np.bincount(doc, weights=w, minlength=len(texts))
    words = np.bincount(doc, minlength=len(texts)).astype(float)
    some = np.maximum(words, 1)
    h = prefix_hash(units)
    with np.errstate(over="ignore"):
        hashes = mix((h[last] - h[first]) * POWERS.upto(len(h))[1][first])
    repeat = []
    for lag in (1, 2):
        again = np.zeros(len(first))
        again[lag:] = (hashes[lag:] == hashes[:-lag]) & (doc[lag:] == doc[:-lag])
        repeat.append(per(again) / some)
    mean = per(size) / some
    spread_ = np.sqrt(np.maximum(per(size * size) / some - mean**2, 0))
    marked = np.isin(kind[last - 1], (6, 7)).astype(float) if len(last) else np.zeros(0)
    lines = shares[4] + 1
    return np.column_stack([
        np.log1p(sizes - 1), shares[1] / letters, shares[2] / length, shares[3] / length, shares[4] / length, shares[5] / length, shares[6] / length, shares[7] / length, shares[8] / length,
        np.minimum(mean, 40), np.minimum(spread_, 40), *repeat, per((size == 1).astype(float)) / some, per(marked) / some, np.log1p(length / lines), count(same) / length,
    ])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """A network of one hidden layer over standardised statistics; constant without weights."""

    weights: tuple[np.ndarray, ...] = ()
    prior: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), 0.5)
        return _sigmoid(self._margin(x)[0])

    def _margin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean, scale, w1, b1, w2, b2 = self.weights
        z = np.clip((x - mean) / scale, -6, 6)
        hidden = np.tanh(z @ w1 + b1)
        return hidden @ w2 + b2[0], z, hidden


@dataclass
class Sample:
    """Statistics of distinct texts, and how many rows have each."""

    x: np.ndarray
    rows: np.ndarray

    def part(self, begin: int) -> Sample:
        """Every other text, or all of one."""
        return Sample(self.x[begin::2], self.rows[begin::2]) if len(self.x) > 1 else self

    @property
    def share(self) -> np.ndarray:
        return self.rows / self.rows.sum()

    @property
    def size(self) -> float:
        """How many texts of equal weight tell as much."""
        return float(self.rows.sum() ** 2 / (self.rows.astype(float) ** 2).sum())


def risk(model: Model, positive: Sample, other: Sample, prior: float) -> tuple[float, float]:
    """The two parts of the risk under the sigmoid loss: of positives, and of negatives as the unlabelled tell it (below 0 by overfitting alone)."""
    sp, su = model.score(positive.x), model.score(other.x)
    return float(prior * ((1 - sp) @ positive.share)), float(su @ other.share - prior * (sp @ positive.share))


def gradient(model: Model, positive: Sample, other: Sample, prior: float | None) -> list[np.ndarray]:
    """Slopes of what a step lowers: the risk, or minus its negative part where that is below 0; without a prior, the logistic loss of positive against other."""
    (gp, zp, hp), (gu, zu, hu) = model._margin(positive.x), model._margin(other.x)
    sp, su, wp, wu = _sigmoid(gp), _sigmoid(gu), positive.share, other.share
    dp, du = sp * (1 - sp) * wp, su * (1 - su) * wu  # slopes of the sigmoid loss
    if prior is None:
        dp, du = (sp - 1) * wp, su * wu
    elif su @ wu - prior * (sp @ wp) >= 0:
        dp, du = -2 * prior * dp, du
    else:
        dp, du = prior * dp, -du
    grads = [0.0] * 4
    for d, z, h in ((dp, zp, hp), (du, zu, hu)):
        back = (d[:, None] * model.weights[4]) * (1 - h * h)
        for i, g in enumerate((z.T @ back, back.sum(0), h.T @ d, np.array([d.sum()]))):
            grads[i] = grads[i] + g
    return grads


def _fit(positive: Sample, other: Sample, prior: float | None, epochs: int = 400, width: int = 24) -> Model:
    """Minimise the non-negative risk; without a prior, the plain risk of positive against other."""
    rng = np.random.default_rng(11)
    both = np.concatenate([positive.x, other.x])
    scale = both.std(0)
    shape = both.shape[1]
    params = [rng.normal(0, 1 / np.sqrt(shape), (shape, width)), np.zeros(width), rng.normal(0, 1 / np.sqrt(width), width), np.zeros(1)]
    model = Model((both.mean(0), np.where(scale > 1e-9, scale, 1), *params))
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        grads = gradient(model, positive, other, prior)
        for i, p in enumerate(params):
            g = grads[i] + 1e-4 * p
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p -= 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
    return model


def _tails(scores: np.ndarray, share: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Share of the rows that score at least each cut."""
    order = np.argsort(scores, kind="stable")
    below = np.concatenate([[0.0], np.cumsum(share[order])])
    return 1 - below[np.searchsorted(scores[order], cuts)]


def estimate_prior(positive: Sample, other: Sample, confidence: float = 0.1) -> float:
    """Share of positives in the unlabelled text, by the best bin of held-back scores."""
    first = _fit(positive.part(0), other.part(0), None, epochs=200)
    own, rest = positive.part(1), other.part(1)
    sp, su = first.score(own.x), first.score(rest.x)
    cuts = np.unique(np.concatenate([sp, su]))
    tail_p, tail_u = _tails(sp, own.share, cuts), _tails(su, rest.share, cuts)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(own.size) + 1 / np.sqrt(rest.size))
    enough = tail_p > 1e-12
    best = np.argmin(((tail_u + slack) / np.maximum(tail_p, 1e-9))[enough])
    return float(np.clip((tail_u[enough] / tail_p[enough])[best], 0.02, 0.98))


def fit(positive: Sample, other: Sample) -> Model:
    """A model from trusted positive and unlabelled texts."""
    if not len(positive.x) or not len(other.x):
        return Model()
    prior = estimate_prior(positive, other)
    model = _fit(positive, other, prior)
    model.prior = prior
    return model


def _learnable(df: DataFrame) -> DataFrame:
    return df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def training_samples(docs: DataFrame, labels: DataFrame, texts: int = FIT_TEXTS) -> tuple[Sample, Sample]:
    """Distinct texts of positives, and of all rows that may be learnt from, at most ``texts`` each, with the rows that have them."""
    good = _learnable(labels).where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(1))
    own = _learnable(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("h", F.xxhash64("text"))
    # Ids and hashes first, so that no text is shuffled; copies are one row before anything is cut.
    keys = own.select("doc_id", "h").join(good, "doc_id", "left").groupBy("h").agg(F.count("good").alias("good"), F.count(F.lit(1)).alias("n"))
    first = [{r.h: r.w for r in part.orderBy("h").limit(texts).collect()} for part in (keys.where("good > 0").select("h", F.col("good").alias("w")), keys.select("h", F.col("n").alias("w")))]
    both = sorted({*first[0], *first[1]})
    if not both:
        return (Sample(np.zeros((0, len(FEATURES))), np.zeros(0)),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = features(texts_of(batch["text"]))
                yield pa.RecordBatch.from_arrays([batch["h"], pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), x.ravel())], ["h", "x"])

    chosen = own.sparkSession.createDataFrame([(h,) for h in both], "h long")
    distinct = own.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("text").alias("text"))
    found = {r.h: r.x for r in mapped(distinct.select("h", "text"), run, "h long, x array<double>").collect()}
    return tuple(Sample(np.array([found[h] for h in sorted(part)]).reshape(-1, len(FEATURES)), np.array([part[h] for h in sorted(part)], float)) for part in first)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = model.score(features(texts_of(batch["text"])))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    return spread(docs.select("doc_id", "text")).transform(mapped, run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every whole document by a model of the learnable rows."""
    docs = table(spark, sf_dir, "documents")
    model = fit(*training_samples(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))  # a null doc_id isn't held out
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
