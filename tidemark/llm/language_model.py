"""Language-model scores by a log-bilinear model trained with noise contrast.

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end.
Counts of all training tokens are taken by Spark.  The model predicts a token's
class from the classes of the two tokens before it: the most frequent words are
classes of their own, all others share classes by their ending, within which a
word has its add-one share.  The score of class w after class c, before which
came d, is (r1_c + r2_d) . q_w + b_w (Mnih and Hinton, ICML 2007, with a matrix
product by position folded into the vectors).

Training by noise-contrastive estimation (Mnih and Teh, ICML 2012) has two
steps, both over all training tokens.  How often each pair of neighbouring
classes occurs, a table of at most CLASSES * (CLASSES + 1) numbers summed over
the corpus, starts r1, q and b, with the noise in expectation.  Then each task
takes gradient steps over its own tokens with both contexts and drawn noise, and
the tasks' vectors are averaged by their tokens.  For scoring, the sum over
classes of exp(score) is a product of two matrices, so that one matrix product
normalises all pairs of contexts at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut, map_arrow, raw_texts

#: Words that are classes of their own, the end among them, and classes by ending.
SINGLE, ENDINGS = 1024, 512
CLASSES = SINGLE + ENDINGS
#: A word with a share of at least 1 / FREQUENT of the training tokens is frequent: there are FREQUENT such words at most.
FREQUENT = 1 << 20
#: The end token; no word is empty.
END = b""
DIM, NOISE, STEPS, RATE = 24, 8, 150, 0.05
#: Tokens of a gradient step over the texts, noise classes drawn for it, and its rate.
AT_ONCE, DRAWN, FINE_RATE = 4096, 48, 0.01
#: Unigram tokens added to each context.
PRIOR = 30.0


def _words(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def word_counts(train: DataFrame, at_once: int = 400_000) -> DataFrame:
    """(word, c): how often each token occurs in the texts of ``train``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in raw_texts(batch):
                seen.update(_words(text))
                if len(seen) > at_once:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return map_arrow(train, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def train_pairs(pairs: np.ndarray, dim: int = DIM, noise: int = NOISE, steps: int = STEPS, rate: float = RATE, seed: int = 0) -> list[np.ndarray]:
    """[r, q, b] from pair counts (contexts x classes), by noise-contrastive estimation.

    Noise classes come from the (add-one) unigram distribution, ``noise`` of
    them for each true one; their expectation is taken over all classes in one
    matrix product rather than by drawing.
    """
    rng = np.random.default_rng(seed)
    contexts, classes = pairs.shape
    unigram = pairs.sum(axis=0) + 1.0
    unigram /= unigram.sum()
    pairs = pairs + PRIOR * unigram  # rare contexts lean on the unigram
    p = pairs / pairs.sum()
    shift = np.log(noise * unigram)
    of_context = p.sum(axis=1, keepdims=True) * noise * unigram
    params = [rng.normal(0, 0.1, (contexts, dim)), rng.normal(0, 0.1, (classes, dim)), np.log(unigram)]
    params = [x.astype(np.float32) for x in params]
    p, of_context, shift = (x.astype(np.float32) for x in (p, of_context, shift))
    # each context and each class takes steps of its own scale: Adam
    first, second = ([np.zeros_like(x) for x in params] for _ in range(2))
    for step in range(1, steps + 1):
        r, q, b = params
        s = 1 / (1 + np.exp(np.clip(shift - (r @ q.T + b), -30, 30)))
        g = of_context * s - p * (1 - s)
        for k, grad in enumerate((g @ q + 1e-8 * r, g.T @ r + 1e-8 * q, g.sum(axis=0))):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.98 * second[k] + 0.02 * grad * grad
            now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            params[k] = params[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-10)
    return params


def train_texts(params: list[np.ndarray], log_noise: np.ndarray, texts: Iterator[np.ndarray], seed: int = 0) -> tuple[list[np.ndarray], int]:
    """Gradient steps over texts (arrays of classes) from ``params`` [r1, r2, q, b]; the new parameters and the number of tokens.

    ``log_noise`` is the log of the noise distribution.  Each step draws DRAWN
    noise classes, which stand for NOISE of them at each token.
    """
    rng = np.random.default_rng(seed)
    params = [x.astype(np.float32) for x in params]
    begin, classes, dim = len(params[0]) - 1, *params[2].shape
    cumulated = np.cumsum(np.exp(log_noise))
    shift = (np.log(NOISE) + log_noise).astype(np.float32)
    first, second = ([np.zeros_like(x) for x in params] for _ in range(2))
    step = tokens = 0

    def summed(at: np.ndarray, grad: np.ndarray, size: int) -> np.ndarray:
        flat = (at[:, None] * dim + np.arange(dim)).ravel()
        return np.bincount(flat, grad.ravel(), size * dim).reshape(size, dim).astype(np.float32)

    def take(one: np.ndarray, two: np.ndarray, w: np.ndarray) -> None:
        nonlocal step
        step += 1
        r1, r2, q, b = params
        m = np.minimum(np.searchsorted(cumulated, rng.random(DRAWN) * cumulated[-1]), classes - 1)
        h, q_w, q_m = r1[one] + r2[two], q[w], q[m]
        true = 1 / (1 + np.exp(np.clip((h * q_w).sum(axis=1) + b[w] - shift[w], -30, 30)))
        drawn = (-NOISE / DRAWN) / (1 + np.exp(np.clip(shift[m] - (h @ q_m.T + b[m]), -30, 30)))
        of_h = true[:, None] * q_w + drawn @ q_m
        of_q = summed(w, true[:, None] * h, classes) + summed(m, drawn.T @ h, classes)
        of_b = np.bincount(w, true, classes) + np.bincount(m, drawn.sum(axis=0), classes)
        grads = [summed(one, of_h, begin + 1), summed(two, of_h, begin + 1), of_q, of_b.astype(np.float32)]
        now = FINE_RATE / np.sqrt(1 + step / 200)
        for k, grad in enumerate(grads):
            grad /= len(w)
            first[k] += 0.1 * (grad - first[k])
            second[k] += 0.01 * (grad * grad - second[k])
            params[k] += now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)

    held: list[np.ndarray] = []
    waiting = 0

    def all_taken() -> None:
        one, two, w = np.concatenate(held, axis=1)
        for k in range(0, len(w), AT_ONCE):
            take(one[k : k + AT_ONCE], two[k : k + AT_ONCE], w[k : k + AT_ONCE])
        held.clear()

    for text in texts:
        text = text.astype(np.int64)
        before = np.concatenate([[begin, begin], text])
        held.append(np.stack([before[1:-1], before[:-2], text]))
        tokens, waiting = tokens + len(text), waiting + len(text)
        if waiting >= AT_ONCE:
            all_taken()
            waiting = 0
    if held:
        all_taken()
    return params, tokens


class Scorer:
    """log10 P(class | the class before, the one before that); its tables are made where they are used."""

    def __init__(self, params: list[np.ndarray], room: np.ndarray):
        self.params, self.room = params, room
        self._tables: tuple | None = None

    def __getstate__(self) -> tuple:
        return self.params, self.room

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def log_p(self, text: np.ndarray) -> np.ndarray:
        """For each token of a text, given as classes."""
        if self._tables is None:
            r1, r2, q, b = self.params
            near, far = r1 @ q.T + b, r2 @ q.T
            near -= near.max(axis=1, keepdims=True)
            far -= far.max(axis=1, keepdims=True)
            self._tables = near, far, np.log(np.maximum(np.exp(near) @ np.exp(far).T, np.float32(1e-37)))
        near, far, total = self._tables
        before = np.concatenate([[len(near) - 1, len(near) - 1], text])
        one, two = before[1:-1], before[:-2]
        return (near[one, text].astype(float) + far[two, text] - total[one, two]) / np.log(10)


class _Lexicon:
    """Frequent words with their counts, and the class of any word."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = [w.encode() for w in words], counts  # most frequent first
        self._index: dict[bytes, int] = {}

    def __getstate__(self) -> tuple:
        return self.words, self.counts

    def __setstate__(self, state: tuple) -> None:
        self.__init__([], [])
        self.words, self.counts = state

    def ready(self) -> dict[bytes, int]:
        if not self._index and self.words:
            self._index = {w: k for k, w in enumerate(self.words)}
            rest = [k if k < SINGLE else SINGLE + zlib.crc32(w[-2:]) % ENDINGS for k, w in enumerate(self.words)]
            self.classes, self.log_c = np.array(rest, np.int64), np.log10(np.array(self.counts, float) + 1)
        elif not self.words:
            self.classes, self.log_c = np.zeros(0, np.int64), np.zeros(0)
        return self._index

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Indexes (-1 where rare), classes, and the rare words."""
        index = self.ready()
        i = np.array([index.get(w, -1) for w in words], np.int64)
        rare_at = np.flatnonzero(i < 0)
        classes = self.classes[i] if len(self.classes) else np.zeros(len(i), np.int64)
        rare = [words[k] for k in rare_at.tolist()]
        classes[rare_at] = [SINGLE + zlib.crc32(w[-2:]) % ENDINGS for w in rare]
        return i, classes, rare


def _pair_counts(coded: DataFrame) -> DataFrame:
    """(code, n): how often class ``code % CLASSES`` follows class ``code // CLASSES`` (CLASSES: a text's begin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 1) * CLASSES, np.int64)
        for batch in batches:
            codes = []
            for text in _coded(batch):
                c = text.astype(np.int64)
                codes.append(np.concatenate([[CLASSES], c[:-1]]) * CLASSES + c)
            if codes:
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                total[code] += n
        code = np.flatnonzero(total)
        for k in range(0, len(code), 50_000):
            part = code[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["code", "n"])

    return map_arrow(coded, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _coded(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(x, "<u2") for x in batch.column("classes").to_pylist())


def _classes(train: DataFrame, shared) -> DataFrame:
    """(classes): each text's classes as unsigned 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            found = [lexicon.look_up(_words(text))[1].astype("<u2").tobytes() for text in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["classes"])

    return map_arrow(train, run, "classes binary")


def _averaged(coded: DataFrame, params: list[np.ndarray], log_noise: np.ndarray) -> list[np.ndarray]:
    """``train_texts`` in each task from the same ``params``; the average of the tasks' parameters by tokens."""
    shared = coded.sparkSession.sparkContext.broadcast((params, log_noise))
    sizes = [x.size for x in params]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, tokens = train_texts(*shared.value, (text for batch in batches for text in _coded(batch)), TaskContext.get().partitionId())
        if tokens:
            values = np.concatenate([x.ravel() for x in found]).astype(float) * tokens
            values = np.append(values, tokens)
            for k in range(0, len(values), 50_000):
                part = values[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part))), pa.array(part)], ["at", "x"])

    found = map_arrow(coded, run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    if not found.num_rows:
        return params
    values = np.zeros(sum(sizes) + 1)
    values[found.column("at").to_numpy()] = found.column("x").to_numpy()
    parts = np.split(values[:-1] / values[-1], np.cumsum(sizes)[:-1])
    return [x.reshape(old.shape).astype(np.float32) for x, old in zip(parts, params, strict=True)]


class Fitted:
    """What training leaves: (word, c) of all training tokens as a table, their number and that of distinct ones, lexicon and scorer."""

    def __init__(self, counts: DataFrame, total: int, distinct: int, lexicon: _Lexicon, shared, scorer: Scorer):
        self.counts, self.total, self.distinct, self.lexicon, self.shared, self.scorer = counts, total, distinct, lexicon, shared, scorer


def fit(train: DataFrame) -> Fitted:
    """Learn from the ``text`` of all rows; null texts count as empty."""
    spark = train.sparkSession
    counts = cut(word_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = counts.where(F.col("c") * FREQUENT >= total).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    lexicon = _Lexicon(frequent.column("word").to_pylist(), frequent.column("c").to_pylist())
    shared = spark.sparkContext.broadcast(lexicon)

    ending = (F.crc32(F.expr("substring(cast(word AS binary), -2, 2)")) % ENDINGS).alias("ending")
    own = spark.createDataFrame([(w.decode(),) for w in lexicon.words[:SINGLE]], "word string")
    by_ending = counts.join(F.broadcast(own), "word", "left_anti").groupBy(ending).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    room = np.zeros(CLASSES)
    for row in by_ending:
        room[SINGLE + row["ending"]] = np.log10(row["c"] + row["v"] + 1)

    coded = cut(_classes(train, shared))
    found = _pair_counts(coded).toArrow()
    pairs = np.zeros((CLASSES + 1) * CLASSES)
    pairs[found.column("code").to_numpy()] = found.column("n").to_numpy()
    pairs = pairs.reshape(CLASSES + 1, CLASSES)
    log_noise = np.log((pairs.sum(axis=0) + 1) / (pairs.sum() + CLASSES))
    r, q, b = train_pairs(pairs)
    params = _averaged(coded, [r, np.zeros_like(r), q, b], log_noise)
    return Fitted(counts, total, distinct, lexicon, shared, Scorer(params, room))


def score(docs: DataFrame, held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    ``held_out`` is a boolean column; all other rows train.  ``base_score`` is
    the add-one unigram's log10 probability of the text, ``score`` the model's.
    Null texts count as empty: their only token is the end.  Without training
    texts every token has the same class probabilities and the base is 0.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out"))
    return scored(docs, fit(docs.where("NOT held_out").select("text")))


def scored(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """The rows of ``score`` for (doc_id, text, held_out) by what ``fit`` learnt."""
    counts, total, distinct, shared = fitted.counts, fitted.total, fitted.distinct, fitted.shared
    least = min(fitted.lexicon.counts, default=0)
    model = docs.sparkSession.sparkContext.broadcast(fitted.scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, scorer = shared.value, model.value
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list[tuple] = []
            for text in raw_texts(batch):
                words = _words(text)
                i, c, rare = lexicon.look_up(words)
                known = i[i >= 0]
                log_c = lexicon.log_c[known]
                shares = log_c[lexicon.classes[known] >= SINGLE].sum() - scorer.room[c].sum()
                p = scorer.log_p(c).sum()
                few = Counter(rare)
                out.append((uid, len(words), len(known), log_c.sum(), p + shares, [w.decode() for w in few], list(few.values())))
                uid += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "held_out", "uid", "n", "known", "base", "model", "words", "times"])

    parts = cut(map_arrow(docs, run, "doc_id long, held_out boolean, uid long, n long, known long, base double, model double, words array<string>, times array<long>"))
    # words that aren't frequent meet their counts in a join; none of them is a hot key
    rare = parts.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("t"))
    few = counts.where(F.col("c") < least) if least else counts
    rest = (
        rare.join(few, "word")
        .groupBy("uid")
        .agg(F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("more"), F.sum("t").alias("more_known"))
    )
    more, more_known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0).cast("long"))
    return (
        parts.drop("words", "times")
        .join(rest, "uid", "left")
        .select(
            "doc_id",
            "held_out",
            F.col("n").alias("n_tokens"),
            (F.col("known") + more_known).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + more - F.col("n") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
            (F.col("model") + more).alias("score"),
        )
    )
