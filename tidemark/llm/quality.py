"""Text quality by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else is unlabelled
web text that holds good and bad documents alike.  The share of good ones in it
(the class prior) is estimated from how many unlabelled documents score as high
as the positives do, and a logistic model over features of the whole text then
minimises the non-negative unbiased risk (Kiryo et al., NeurIPS 2017):

    prior * E+[loss(f)] + max(0, Eu[loss(-f)] - prior * E+[loss(-f)])

No document labelled bad, no language, source or id takes part.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import bounded_batches

#: Documents of either kind that the fit looks at: a sample by hash of the id.
SAMPLE = 6000
THRESHOLD = 0.3


def _byte_groups() -> np.ndarray:
    """Rows of 256 flags: which bytes count for a feature."""
    groups = [range(65, 91), range(97, 123), range(128, 256), [32], b".", b",", b"!?", b"|", b"#$%&*^~<>", [*range(9), *range(11, 32), 127]]
    out = np.zeros((len(groups), 256))
    for k, g in enumerate(groups):
        out[k, list(g)] = 1
    return out


_GROUPS = _byte_groups()
_LOWER = frozenset(range(97, 123))


def features(text: bytes) -> np.ndarray:
    """Shares of kinds of characters and words, repetition, and length, of a whole text."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = _GROUPS @ counts / max(n, 1)
    words = text.split()
    w = max(len(words), 1)
    distinct = set(words)
    follows = sum(a == b for a, b in zip(words, words[1:], strict=False)) / w
    pairs = len(set(zip(words, words[1:], strict=False))) / w
    shouted = sum(x[0] not in _LOWER and x.isupper() for x in words) / w
    ends = sum(1 for x in words if x[-1] in b"!#$%&*|@^~<>") / w
    letters = shares[0] + shares[1] + shares[2]
    packed = len(zlib.compress(text, 1)) / (n + 20)
    more = [shares[0] / (letters + 1e-9) if n else 0.0, letters, follows, pairs, len(distinct) / w, shouted, ends, n / w / 16, packed]
    small = np.log(np.concatenate([shares, more]) + 1e-2)
    return np.concatenate([shares, more, small, [np.log1p(n), np.log1p(w), float(n == 0), float(n > 0 and not words)]])


@dataclass
class Model:
    """A logistic model of standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam from zero."""
    x, a, b = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = gradient(x)
        a, b = 0.9 * a + 0.1 * g, 0.99 * b + 0.01 * g * g
        x = x - rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-9)
    return x


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of the two tails above any score.

    Above a high score nearly all unlabelled documents are positives, so that
    tail's size compared with the positives' tells the share; a margin for
    chance is added to each ratio before the least one is taken.
    """
    cuts = np.quantile(positive, np.linspace(0.0, 0.95, 96))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = 1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled))
    best = np.argmin((u + margin) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, decay: float = 3e-3, steps: int = 400) -> Model:
    """The model of least non-negative risk. Without positives, or without unlabelled texts, every score is 1/2."""
    width = positive.shape[1] if positive.size else unlabelled.shape[1] if unlabelled.size else len(features(b""))
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    one = np.ones((1, 1))
    p, u = (np.hstack([np.clip((x - mean) / scale, -4, 4), np.repeat(one, len(x), axis=0)]) for x in (positive, unlabelled))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    if prior is None:
        both = np.vstack([p, u])
        y = np.concatenate([np.full(len(p), 1.0), np.zeros(len(u))])
        weight = np.concatenate([np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))])
        naive = _descend(lambda w: both.T @ (weight * (sigmoid(both @ w) - y)) + decay * w, p.shape[1], steps // 2)
        prior = class_prior(p @ naive, u @ naive)

    def gradient(w: np.ndarray) -> np.ndarray:
        fp, fu = p @ w, u @ w
        # d log(1 + exp(-z)) = -sigmoid(-z), d log(1 + exp(z)) = sigmoid(z)
        rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        negative = u.T @ sigmoid(fu) / len(u) - prior * (p.T @ sigmoid(fp)) / len(p)
        if rest < 0:  # the estimate of the negatives' risk went below zero: step back there
            return -negative
        return -prior * (p.T @ sigmoid(-fp)) / len(p) + negative + decay * w

    w = _descend(gradient, p.shape[1], steps)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def fit(docs: DataFrame, labels: DataFrame, trains: Column, sample: int = SAMPLE) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), on rows where ``trains`` (of doc_id) holds.

    At most ``sample`` positives and about as many unlabelled documents, both
    chosen by hash of the id (the same ones whenever it runs), are looked at;
    their features come to the driver.  Null texts count as empty, rows without
    id and labels without quality are left out, repeated rows count as often as
    they come; without positives or documents every score is 1/2.
    """

    @F.pandas_udf("array<double>")
    def measured(text: pd.Series) -> pd.Series:
        return pd.Series([features((x or "").encode()).tolist() for x in text])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(trains & F.col("doc_id").isNotNull())
    good = labels.select(F.col("doc_id").cast("long"), "quality").where(trains & (F.col("quality") == 1))
    order = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_003))

    def part(df: DataFrame, of: int) -> DataFrame:
        return df.where(order < F.lit(max(1, round(1_000_003 * min(1.0, sample / max(of, 1))))))

    def seen(df: DataFrame) -> pd.DataFrame:
        ties = df.select(measured("text").alias("x"), order.alias("o"), "doc_id", F.xxhash64("text").alias("h"))
        return ties.orderBy("o", "doc_id", "h").limit(2 * sample).toPandas()

    chosen = part(good, good.count()).select("doc_id").distinct().orderBy(order, "doc_id").limit(sample)
    positive = seen(docs.join(F.broadcast(chosen), "doc_id"))
    unlabelled = seen(part(docs, docs.count()))
    p, u = (np.array(x["x"].tolist()) for x in (positive, unlabelled))
    return fit_pu(p, u)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) of each whole text; null and empty texts alike get the empty text's."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        x = np.array([features((t or "").encode()) for t in text])
        return pd.Series(model.scores(x) if len(x) else [], dtype=float)

    bounded_batches(docs.sparkSession)
    return docs.withColumn("score", score(F.col("text").cast("string")))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their own columns; null and empty texts alike get the empty text's score, rows without id are judged by their text."""
    own = docs.columns
    marked = scored(docs.select(F.struct(*(f"`{c}`" for c in own)).alias("row"), F.col("text")), model)
    return marked.where(F.col("score") >= threshold).select("row.*")
