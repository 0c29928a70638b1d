"""Toxicity by subword bags: character n-gram embeddings averaged into a linear softmax.

A word is the bag of the byte n-grams of its lower-cased spelling with a space at each
end; its vector is the mean of theirs, a text's vector the mean of its words'. The
embeddings and the softmax are trained together in numpy, in one task, on a bounded
sample. A misspelling shares most n-grams with the word it comes from.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, train_in_task, training_sample
from .textops import _ODD, _PLAIN, _Powers, buffers, is_white, mix, slices, word_hashes, words

ORDERS = (3, 5)
BUCKETS = 1 << 17
DIMENSIONS = 4
BATCH = 200
UPDATES = 225
RATE = 3.0
# Clean and toxic training rows, and their bytes, at most.
CLASS_ROWS = (6000, 3000)
CLASS_BYTES = (20_000_000, 10_000_000)
THRESHOLD = 0.5
# Texts scored at a time, as each byte takes about sixty in arrays: little beside an executor's heap.
SLICE_BYTES = 1 << 17
# One training row in so many is kept from the fit and calibrates its log-odds.
CALIBRATION_FOLDS = 5
SEED = 7


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with white space as a space and a space before, between and after the rows."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    body = np.where(is_white(data), np.uint8(32), data)
    body = np.where((body >= 65) & (body <= 90), body + np.uint8(32), body).astype(np.uint8)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(data)) + rows + 1] = body
    return out, offsets + np.arange(n + 1) + 1


def _grams(data: np.ndarray, buckets: int):
    """For each order: the bucket of the n-gram that starts at each byte."""
    up, down = _Powers.get(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_PLAIN[data] * up, out=total[1:])
    for order in ORDERS:
        h = (total[order:] - total[:-order]) * down[: max(len(data) - order + 1, 0)]
        yield order, (mix(h + np.uint64(order * _ODD % (1 << 64))) & np.uint64(buckets - 1)).astype(np.int32)


class _Batch:
    """Sparse means of one batch: words to n-gram buckets, texts to words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, buckets: int):
        n = len(offsets) - 1
        spaced, at = _spaced(data, offsets)
        starts, ends, rows = words(spaced, np.concatenate(([0], at[1:])))
        h = word_hashes(spaced, starts, ends)
        _, first, word = np.unique(h, return_index=True, return_inverse=True)
        pair, counts = np.unique(rows * max(len(first), 1) + word, return_counts=True)
        self.text = (pair // max(len(first), 1)).astype(np.int32)
        self.word = (pair % max(len(first), 1)).astype(np.int32)
        lengths = np.bincount(rows, minlength=n)
        self.weight = (counts / np.maximum(lengths, 1)[self.text]).astype(np.float32)[:, None]
        lo, hi = starts[first] - 1, ends[first] + 1
        gram, owner = [], []
        for order, bucket in _grams(spaced, buckets):
            each = np.maximum(hi - lo - order + 1, 0)
            own = np.repeat(np.arange(len(first), dtype=np.int32), each)
            gram.append(bucket[np.repeat(lo, each) + np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)])
            owner.append(own)
        owner = np.concatenate(owner)
        # Kept: each word's buckets one after the other and their number; the rest is remade when needed.
        self.gram = np.concatenate(gram)[np.argsort(owner, kind="stable")]
        self.grams = np.bincount(owner, minlength=len(first)).astype(np.int32)
        self.n, self.words, self.labels = n, len(first), labels

    @staticmethod
    def _sum(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        """Sums of the rows of each index; ``index`` ascends."""
        out = np.zeros((n, values.shape[1]), np.float32)
        starts = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))[: len(index)]
        if len(starts):
            out[index[starts]] = np.add.reduceat(values, starts, axis=0)
        return out

    def texts(self, table: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(self.words), self.grams)
        vectors = self._sum(table[self.gram], owner, self.words) / np.maximum(self.grams, 1)[:, None]
        return self._sum(vectors.astype(np.float32)[self.word] * self.weight, self.text, self.n)

    def gradient(self, upstream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, gradient of their embeddings) from the gradient of the texts' vectors."""
        by_word = np.argsort(self.word, kind="stable")
        vectors = self._sum((upstream[self.text] * self.weight)[by_word], self.word[by_word], self.words)
        vectors = (vectors / np.maximum(self.grams, 1)[:, None]).astype(np.float32)
        by_gram = np.argsort(self.gram, kind="stable")
        owner, gram = np.repeat(np.arange(self.words), self.grams)[by_gram], self.gram[by_gram]
        starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))[: len(gram)]
        if not len(starts):
            return gram, np.zeros((0, upstream.shape[1]), np.float32)
        return gram[starts], np.add.reduceat(vectors[owner], starts, axis=0)


def train(
    texts: pa.ChunkedArray | pa.Array,
    labels: list[int],
    buckets: int = BUCKETS,
    dimensions: int = DIMENSIONS,
    updates: int = UPDATES,
    batch: int = BATCH,
    first_rate: float = RATE,
) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): the trained embeddings seen through the softmax.

    The softmax is linear in the averages, so a text's log-odds are the average of its
    n-grams' log-odds and only one number a bucket has to travel to the tasks. With one
    class or no rows, every text gets the same log-odds of that class.
    """
    share = (sum(labels) + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return np.zeros(buckets, np.float32), bias
    wanted = np.asarray(labels)
    apart = np.arange(len(wanted)) % CALIBRATION_FOLDS == 0
    if len(set(wanted[~apart])) < 2 or len(set(wanted[apart])) < 2:
        apart[:] = False
    rest, rest_wanted = texts.filter(pa.array(apart)), wanted[apart]
    texts, wanted = texts.filter(pa.array(~apart)), wanted[~apart]
    batches = []
    for a in range(0, len(wanted), batch):
        b = min(a + batch, len(wanted))
        data, offsets = buffers(texts.slice(a, b - a))
        batches.append(_Batch(data[offsets[0] : offsets[-1]], offsets - offsets[0], wanted[a:b], buckets))
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1, 1, (buckets, dimensions)).astype(np.float32) / (10 * dimensions)
    weights = rng.normal(0, 1, (dimensions, 2)).astype(np.float32)
    offset = np.array([0, bias], np.float32)
    past, past_w, past_o = np.full((buckets, 1), 1e-9, np.float32), np.full_like(weights, 1e-6), np.full(2, 1e-6)
    epochs = -(-updates // len(batches))
    for epoch in range(epochs):
        rate = first_rate * (1 - epoch / epochs)
        for i in rng.permutation(len(batches)):
            own = batches[i]
            x = own.texts(table)
            logits = x @ weights + offset
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(own.n), own.labels] -= 1
            error = (error / own.n).astype(np.float32)
            at, slope = own.gradient(error @ weights.T)
            past[at] += (slope**2).mean(axis=1, keepdims=True)
            table[at] -= rate * slope / np.sqrt(past[at])
            slope_w, slope_o = x.T @ error, error.sum(axis=0)
            past_w += slope_w**2
            past_o += slope_o**2
            weights -= 0.2 * rate * slope_w / np.sqrt(past_w)
            offset -= (0.2 * rate * slope_o / np.sqrt(past_o)).astype(np.float32)
    scores, bias = table @ (weights[:, 1] - weights[:, 0]), float(offset[1] - offset[0])
    if len(rest_wanted):
        scale, shift = _calibrate(log_odds(rest, scores, bias), rest_wanted)
        scores, bias = scores * np.float32(scale), bias * scale + shift
    return scores, bias


def _calibrate(odds: np.ndarray, labels: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """(scale, shift) of log-odds that fit ``labels`` best; Newton steps of a two-weight logistic fit."""
    x = np.stack([odds / max(np.abs(odds).max(), 1e-9), np.ones(len(odds))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - 1e-3 * w
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
    scale = float(w[0] / max(np.abs(odds).max(), 1e-9))
    return (scale, float(w[1])) if scale > 0 else (1.0, 0.0)


def log_odds(texts: pa.Array, scores: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of every whole text."""
    data, offsets = buffers(texts)
    out = np.full(len(offsets) - 1, bias, np.float64)
    for i, j in slices(offsets, SLICE_BYTES):
        spaced, at = _spaced(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        starts, ends, rows = words(spaced, np.concatenate(([0], at[1:])))
        total, grams = np.zeros(len(starts)), np.zeros(len(starts))
        for order, bucket in _grams(spaced, len(scores)):
            running = np.concatenate(([0.0], np.cumsum(scores[bucket], dtype=np.float64)))
            each = np.maximum(ends - starts + 3 - order, 0)
            first = np.minimum(starts - 1, len(running) - 1)  # past the end only where ``each`` is 0
            total += running[first + each] - running[first]
            grams += each
        mean = np.bincount(rows, total / np.maximum(grams, 1), minlength=j - i)
        out[i:j] += mean / np.maximum(np.bincount(rows, minlength=j - i), 1)
    return out


def _scorer(scores: np.ndarray, bias: float, column: str):
    def run(batches):
        for batch in batches:
            odds = log_odds(batch.column("text"), scores, bias)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], ["doc_id", column]
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, class_rows: tuple = CLASS_ROWS, class_bytes: tuple = CLASS_BYTES):
    """(bucket scores, bias) from the labels outside the held-out fold; runs jobs."""
    return train_in_task(training_sample(docs, labels, "toxic", class_rows, class_bytes), train)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null, empty or blank text has no words and gets the model's bias. Repeated rows get
    equal scores; other columns are not read; an empty table gives no rows.
    """
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    scored = narrow.mapInArrow(_scorer(*model, "score"), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more, all columns as they are."""
    cut = float(np.log(threshold / (1 - threshold)))
    scores, bias = model
    schema = docs.schema
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(log_odds(batch.column(place), scores, bias) < cut))

    return docs.mapInArrow(run, schema)
