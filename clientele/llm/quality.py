"""Quality scores: random-indexing word vectors pooled per text, and a two-layer network.

Every token slot (a hash of the token) has a fixed sparse random index vector. One pass
over all documents adds to each slot the index vectors of its neighbours; slots and
dimensions are parameters, so tables have a fixed size however large the corpus. A text is
the mean of its tokens' vectors and of their squares. The network is trained in numpy, in
one task, on a bounded sample; a temperature fitted on rows kept apart calibrates it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, train_in_task, training_sample
from .textops import buffers, slices, word_hashes
from .tokens import units

SLOTS = 1 << 14
DIMENSIONS = 24
NONZERO = 4
WINDOW = 2
HIDDEN_UNITS = 32
CLASS_ROWS = (6000, 6000)
CLASS_BYTES = (16_000_000, 16_000_000)
THRESHOLD = 0.3
STEPS = 600
SEED = 5


def index_vectors(slots: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the few components of each slot's index vector that are not 0."""
    rng = np.random.default_rng(SEED)
    places = rng.permuted(np.tile(np.arange(dimensions), (slots, 1)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], (slots, NONZERO))


def token_slots(data: np.ndarray, offsets: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of every token: runs of letters and of marks as they are written, other words whole."""
    _, starts, ends, rows, _ = units(data, offsets)
    return (word_hashes(data, starts, ends) % np.uint64(slots)).astype(np.int64), rows


def _gather(slots: int, dimensions: int):
    def run(batches):
        places, signs = index_vectors(slots, dimensions)
        total, seen = np.zeros(slots * dimensions), np.zeros(slots, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets, 1 << 20):
                slot, row = token_slots(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], slots)
                seen += np.bincount(slot, minlength=slots)
                for step in range(1, WINDOW + 1):
                    near = row[step:] == row[:-step]
                    a, b = slot[:-step][near], slot[step:][near]
                    for one, other in ((a, b), (b, a)):
                        base = one * dimensions
                        for n in range(NONZERO):
                            total += np.bincount(
                                base + places[other, n], signs[other, n], minlength=slots * dimensions
                            )
        used = np.flatnonzero(seen)
        columns = [pa.array(used)] + [pa.array(seen[used])]
        table = total.reshape(slots, dimensions)[used]
        columns += [pa.array(table[:, d].copy()) for d in range(dimensions)]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "n", *[f"d{d}" for d in range(dimensions)]])

    return run


def word_vectors(docs: DataFrame, slots: int = SLOTS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """(slots, dimensions): unit context vectors, each with half of the slot's own index vector; runs a job.

    All documents count. A slot that no token has is 0. The result has a fixed size.
    """
    names = [f"d{d}" for d in range(dimensions)]
    texts = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"))
    gathered = texts.mapInArrow(
        _gather(slots, dimensions), "slot long, n long, " + ", ".join(f"{c} double" for c in names)
    )
    # Whole counts add up exactly, so the order of the sums does not matter.
    sums = gathered.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((slots, dimensions), np.float32)
    if sums.num_rows:
        at = sums["slot"].to_numpy()
        context = np.stack([sums[c].to_numpy() for c in names], axis=1)
        places, signs = index_vectors(slots, dimensions)
        own = np.zeros((slots, dimensions))
        np.put_along_axis(own, places, signs, axis=1)
        out[at] = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-12)
        out[at] += 0.5 * own[at] / np.sqrt(NONZERO)
    return out


def pooled(texts: pa.Array | pa.ChunkedArray, vectors: np.ndarray) -> np.ndarray:
    """The features of each whole text; zeros for a text without tokens."""
    data, offsets = buffers(texts)
    slots, dimensions = vectors.shape
    table = np.concatenate([vectors, vectors**2], axis=1)
    out = np.zeros((len(offsets) - 1, 2 * dimensions), np.float32)
    for i, j in slices(offsets, 1 << 20):
        slot, row = token_slots(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], slots)
        if not len(slot):
            continue
        # How often each slot comes in each row, then one product a row and slot.
        pair, count = np.unique(row * np.int64(slots) + slot, return_counts=True)
        starts = np.flatnonzero(np.concatenate(([True], pair[1:] // slots != pair[:-1] // slots)))
        total = np.add.reduceat(table[pair % slots] * count[:, None].astype(np.float32), starts, axis=0)
        rows = pair[starts] // slots
        out[i + rows] = total / np.bincount(row, minlength=j - i)[rows][:, None]
    return out


class Network:
    """Two layers over standardised features; ``temperature`` divides the log-odds."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, units: int = HIDDEN_UNITS, steps: int = STEPS):
        self.mean, self.scale = np.zeros(features.shape[1]), np.ones(features.shape[1])
        if len(features):
            self.mean, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-6
        share = (labels.sum() + 1) / (len(labels) + 2)
        rng = np.random.default_rng(SEED)
        d = features.shape[1]
        self.weights = [
            rng.normal(0, d**-0.5, (d, units)),
            np.zeros(units),
            rng.normal(0, units**-0.5, units) if 0 < labels.sum() < len(labels) else np.zeros(units),
            np.array([np.log(share / (1 - share))]),
        ]
        self.temperature = 1.0
        if 0 < labels.sum() < len(labels):
            apart = np.arange(len(labels)) % 5 == 0
            self._train(features[~apart], labels[~apart], steps, rng)
            self._calibrate(features[apart], labels[apart])

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        hidden = np.maximum((features - self.mean) / self.scale @ self.weights[0] + self.weights[1], 0)
        return (hidden @ self.weights[2] + self.weights[3][0]) / self.temperature

    def _train(self, features, labels, steps, rng, batch=256, rate=0.01, decay=1e-4):
        x = (features - self.mean) / self.scale
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            own, wanted = x[pick], labels[pick]
            before = own @ self.weights[0] + self.weights[1]
            hidden = np.maximum(before, 0)
            odds = np.clip(hidden @ self.weights[2] + self.weights[3][0], -30, 30)
            error = (1 / (1 + np.exp(-odds)) - wanted) / batch
            back = np.outer(error, self.weights[2]) * (before > 0)
            slopes = [own.T @ back + decay * self.weights[0], back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]
            for w, slope, m, v in zip(self.weights, slopes, first, second):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope**2 - v)
                w -= rate * (1 - step / (steps + 1)) * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _calibrate(self, features, labels):
        """The temperature, of a fixed grid, with the least log loss on rows that were not trained on."""
        odds = self.log_odds(features)

        def loss(t: float) -> float:
            z = odds / t
            return float(np.mean(np.logaddexp(0, z) - labels * z))

        if len(labels):
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    class_rows: tuple = CLASS_ROWS,
    class_bytes: tuple = CLASS_BYTES,
    slots: int = SLOTS,
    dimensions: int = DIMENSIONS,
) -> tuple[np.ndarray, Network]:
    """(word vectors of all documents, network trained outside the held-out fold); runs jobs."""
    vectors = word_vectors(docs, slots, dimensions)

    def train(texts, wanted):
        return vars(Network(pooled(texts, vectors).astype(np.float64), np.asarray(wanted, np.float64)))

    network = Network.__new__(Network)
    vars(network).update(train_in_task(training_sample(docs, labels, "quality", class_rows, class_bytes), train))
    return vectors, network


def score(docs: DataFrame, model: tuple[np.ndarray, Network], threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null, empty or blank text has zero features and gets the network's score of them.
    Repeated rows get equal scores, but for rounding in the last digit; other columns are not read; an empty table gives no
    rows. Without labels of both classes every text gets the share of label 1.
    """
    vectors, network = model
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # slots x dimensions, a fixed size

    def run(batches):
        for batch in batches:
            odds = network.log_odds(pooled(batch.column("text"), shared.value).astype(np.float64))
            scores = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
