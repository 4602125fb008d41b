"""Quality classifier: random indexing, pooling, and a two-layer network.

Random indexing: every word and every word shape falls by its hash into one of
``BUCKETS`` fixed rows.  A row's index vector is sparse, ternary and fixed; its
context vector is the sum of the index vectors of its neighbours at all places
of all texts.  The sums are integers, so neither the order of merging nor a
retried task changes them.  A text is the mean of its words' and of its shapes'
context vectors.  A two-layer numpy network is fitted to at most
``MAX_TRAIN_ROWS`` distinct labelled rows (those of least hash); its logits are divided
by a temperature fitted to rows that the network has not seen.

The model is BUCKETS x DIMENSIONS numbers, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, materialise
from .wordhash import hash_words, slices

BUCKETS, DIMENSIONS, NONZERO = 1 << 14, 32, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 30, 256, 3e-3, 1e-4
#: Bound of the labelled rows that the network is fitted to.
MAX_TRAIN_ROWS = 20_000
_SLOTS = 1 << 16
THRESHOLD = 0.3

_rng = np.random.default_rng(20_011)
_DIM = _rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO))
_SIGN = _rng.integers(0, 2, (BUCKETS, NONZERO)) * 2 - 1


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, offsets, shapes = hash_words(column, lower=False, shapes=True)
    shift = np.uint64(64 - int(BUCKETS).bit_length() + 1)
    return (words >> shift).astype(np.int64), (shapes >> shift).astype(np.int64), offsets


def _add_contexts(total: np.ndarray, target: np.ndarray, neighbour: np.ndarray) -> None:
    for k in range(NONZERO):
        key = target * DIMENSIONS + _DIM[neighbour, k]
        total += np.bincount(key, _SIGN[neighbour, k], BUCKETS * DIMENSIONS)


def context_sums(documents: DataFrame) -> np.ndarray:
    """Context vectors [bucket, dimension] summed over all rows of documents(text)."""
    names = [f"v{k}" for k in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in slices(batches):
            words, shapes, offsets = _buckets(batch.column("text"))
            if not len(words):
                continue
            inner = np.ones(len(words), bool)
            inner[offsets[:-1][offsets[:-1] < len(words)]] = False
            right = np.flatnonzero(inner)  # words with one before them
            for own in (words, shapes):
                _add_contexts(total, own, shapes)
                for other in {id(own): own, id(shapes): shapes}.values():
                    _add_contexts(total, own[right], other[right - 1])
                    _add_contexts(total, own[right - 1], other[right])
        matrix = total.reshape(BUCKETS, DIMENSIONS).astype(np.int64)
        rows = np.flatnonzero(matrix.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[pa.array(matrix[rows, k]) for k in range(DIMENSIONS)]], names=["bucket", *names])

    found = documents.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((BUCKETS, DIMENSIONS))
    out[found["bucket"].to_numpy()] = np.stack([found[n].to_numpy() for n in names], 1).reshape(-1, DIMENSIONS)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors of unit length (zero where nothing was seen)."""
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.maximum(length, 1)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Means of the words' and of the shapes' vectors, and the log of the word count, of each text."""
    words, shapes, offsets = _buckets(column)
    n = np.diff(offsets)
    out = np.zeros((len(n), 2 * DIMENSIONS + 1), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        for k, own in enumerate((words, shapes)):
            sums = np.add.reduceat(vectors[own], offsets[:-1][full], axis=0, dtype=np.float64)
            out[full, k * DIMENSIONS : (k + 1) * DIMENSIONS] = sums / n[full, None]
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    """logit = tanh((x - mean) / scale @ w1 + b1) @ w2 + b2, over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Every fifth row calibrates; without rows of both labels the score is the share of label 1 (none: a half)."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rng = np.random.default_rng(5)
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    calibrate = np.arange(len(x)) % 5 == 4
    fitted = ~calibrate
    if len(set(y[fitted].tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        net.w2, net.b2 = np.zeros(HIDDEN), float(np.log(share / (1 - share)))
        return net
    z, t = (x[fitted] - mean) / scale, y[fitted]
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    params[3][0] = np.log(t.mean() / (1 - t.mean()))
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            rows = order[at : at + BATCH]
            h = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -500, 500))) - t[rows]) / len(rows)
            dh = np.outer(error, params[2]) * (1 - h * h)
            grads = [z[rows].T @ dh + DECAY * params[0], dh.sum(0), h.T @ error + DECAY * params[2], error.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(set(y[calibrate].tolist())) == 2:
        logits, t = net.logits(x[calibrate]), y[calibrate]
        grid = np.exp(np.linspace(np.log(0.25), np.log(16), 121))
        loss = [np.mean(np.logaddexp(0, logits / s) - t * logits / s) for s in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def _bounded(rows: DataFrame) -> DataFrame:
    """MAX_TRAIN_ROWS of the distinct rows, or all if there are no more: those of least hash.

    A histogram of the hashes tells the slot in which the limit is met; only rows up to
    that slot are ranked, so that the rank is exact and no more than one slot too many are.
    """
    rows = rows.distinct()
    slot = F.pmod(F.xxhash64(*rows.columns), F.lit(_SLOTS))
    found = rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).toArrow()
    n = np.zeros(_SLOTS, np.int64)
    n[found["slot"].to_numpy()] = found["n"].to_numpy()
    last = int(np.searchsorted(np.cumsum(n), MAX_TRAIN_ROWS, "left"))
    return rows.where(slot <= last).orderBy(slot, F.xxhash64(*rows.columns, F.lit(1)), *rows.columns).limit(MAX_TRAIN_ROWS)


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (score >= THRESHOLD) of every row.

    documents(doc_id, text) are all scored; only ``labels`` (doc_id, quality)
    teach, rows with a null quality or an unknown doc_id do not.  A doc_id with
    several texts or labels teaches each distinct one.  Null text is empty; empty
    texts get a score like any other, very long ones the mean of all their words.
    Repeated rows get a row each, and the same score; other columns are ignored; an
    empty table gives no rows.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    vectors = spark.sparkContext.broadcast(word_vectors(context_sums(documents)))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pooled(batch.column("text"), vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    embedded = materialise(documents.select("doc_id", "text").mapInArrow(embed, "doc_id long, x binary"), "pooled")
    known = labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = _bounded(materialise(embedded.join(known, "doc_id"), "labelled")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").toArrow()
    width = 2 * DIMENSIONS + 1
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, width)
    net = fit(x, rows["quality"].to_numpy())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, width)
                s = net.scores(x.astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return embedded.mapInArrow(score, "doc_id long, score double, predicted int")
