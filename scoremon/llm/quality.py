"""Quality classifier: n-gram indicators scaled by log-count ratios, linear hinge-loss model.

Naive Bayes support vectors: every text is a set of n-gram indicators.  Each indicator is
scaled by the logarithm of the ratio of its smoothed frequencies in good and bad documents,
and a linear model with squared hinge loss is fitted on the scaled indicators by dual
coordinate descent.  The n-grams are word unigrams and unigrams to trigrams of word shapes
(character classes, runs shortened, whether the word repeats the previous one), so that the
form of a text counts as well as its words.

The model is fitted in one task on at most ``SAMPLE`` labelled documents, chosen by the
smallest hashes of their ids, and at most ``SAMPLE_BYTES`` of their packed indicators, which
the tasks that read the texts make; everything else is a stateless pass over the whole texts.
Margins become probabilities by a logistic curve fitted on a held-back part of the sample.

Defined cases: null and empty texts score as texts without indicators; without labels of
both kinds every score is the share of good labels (0.5 without labels); documents labelled
twice count twice; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scoremon.llm import kernel
from scoremon.llm.common import slices

#: Bound of the sample of labelled documents that the model is fitted on.
SAMPLE = 8_000
#: Bound of the packed indicators of that sample, 4 bytes each.
SAMPLE_BYTES = 128 << 20
DIMENSIONS = 1 << 18
CHUNK_BYTES = 1 << 20
CUT = 0.7
U = np.uint64

# Shape classes: lower, upper, digit, beyond ASCII, space and one class per ASCII sign.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x61:0x7B] = ord("a")
SHAPE[0x41:0x5B] = ord("A")
SHAPE[0x30:0x3A] = ord("0")
SHAPE[0x80:] = ord("a")


def indicators(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document number, dimension) pairs, in order of documents."""
    data, offsets = kernel.raw(column)
    docs = len(offsets) - 1
    doc, starts, ends = kernel.words(data, offsets, kernel.SPACE)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = kernel.range_hash(kernel.prefix_sums(kernel.LOWER[data]), starts, ends)
    # Shape: runs of one class count once.
    classes = SHAPE[data]
    new = np.ones(len(data), bool)
    new[1:] = classes[1:] != classes[:-1]
    new[starts] = True
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    keep = new & (np.cumsum(inside[:-1]) > 0)
    short = classes[keep]
    place = np.cumsum(keep)
    head = place[starts] - 1
    tail = place[ends - 1]
    shape = kernel.range_hash(kernel.prefix_sums(short), head, tail)
    same = np.zeros(len(doc), bool)
    same[1:] = (plain[1:] == plain[:-1]) & (doc[1:] == doc[:-1])
    shape = np.where(same, shape ^ kernel.WEIGHTS[40], shape)
    grams, owners = [plain * kernel.WEIGHTS[30], shape * kernel.WEIGHTS[31]], [doc, doc]
    for n in (2, 3):
        m = len(doc) - n + 1
        if m > 0:
            g = sum((shape[j : m + j] * kernel.WEIGHTS[32 + 4 * n + j] for j in range(n)), np.zeros(m, U))
            whole = doc[:m] == doc[n - 1 :]
            grams.append(g[whole])
            owners.append(doc[:m][whole])
    dim = (kernel.mix(np.concatenate(grams)) >> U(64 - 18)).astype(np.int64)
    pair = np.unique(np.concatenate(owners) * DIMENSIONS + dim)
    return pair // DIMENSIONS, pair % DIMENSIONS


@dataclass
class Model:
    """Weight per dimension (log ratio times fitted weight), bias and logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, column: pa.Array) -> np.ndarray:
        doc, dim = indicators(column)
        total = np.bincount(doc, self.weights[dim], minlength=len(column)).astype(float)
        norm = np.sqrt(np.maximum(np.bincount(doc, minlength=len(column)), 1))
        margin = total / norm + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def constant(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(DIMENSIONS), 0.0, 1.0, float(np.log(share / (1 - share))))


def descend(rows, heads, x, y, cost, epochs: int, seed: int, chosen=None) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-loss linear support vector problem.

    ``rows`` holds the dimensions of all examples, example i from ``heads[i]``; its values
    are ``x``.  The bias is the weight of a constant indicator.  ``chosen`` names the
    examples of ``y`` and ``cost``, all by default; nothing is copied for them.
    """
    rng = np.random.default_rng(seed)
    n = len(y)
    w, b = np.zeros(DIMENSIONS), 0.0
    alpha = np.zeros(n)
    use = range(n) if chosen is None else chosen
    parts = [(rows[heads[i] : heads[i + 1]], x[heads[i] : heads[i + 1]]) for i in use]
    diagonal = 0.5 / cost
    q = np.array([v @ v for _, v in parts]) + 1.0 + diagonal
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            d, v = parts[i]
            g = y[i] * (w[d] @ v + b) - 1.0 + diagonal[i] * alpha[i]
            step = max(alpha[i] - g / q[i], 0.0) - alpha[i]
            if step:
                worst = max(worst, abs(g))
                alpha[i] += step
                w[d] += step * y[i] * v
                b += step * y[i]
        if worst < 0.01:
            break
    return w, b


def texts_as_indicators(column: pa.Array) -> list[bytes]:
    """Sorted distinct dimensions of every text, as packed 32-bit numbers."""
    doc, dim = indicators(column)
    heads = np.searchsorted(doc, np.arange(len(column) + 1))
    dim = dim.astype(np.int32)
    return [dim[a:b].tobytes() for a, b in zip(heads[:-1], heads[1:], strict=True)]


def fit(examples: list[np.ndarray], labels: list[int], epochs: int = 12) -> Model:
    """Model of a bounded sample; a fifth of it, by position, only fits the logistic curve.

    An example is the array of its distinct dimensions.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    dims = np.concatenate(examples)
    heads = np.concatenate([[0], np.cumsum([len(d) for d in examples])])
    fold = np.arange(len(y)) % 5 == 4
    for held in (fold, np.zeros(len(y), bool)):
        chosen = np.flatnonzero(~held)
        if len(set(y[chosen].tolist())) < 2:
            continue
        counts = np.ones((2, DIMENSIONS))
        for i in chosen:
            counts[y[i], examples[i]] += 1.0
        bad, good = counts
        ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
        narrow = ratio.astype(np.float32)
        x = narrow[dims]
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            x[a:b] /= np.float32(np.sqrt(max(b - a, 1)))
        # Both kinds carry the same weight in all.
        share = np.where(y == 1, len(y) / (2.0 * (y == 1).sum()), len(y) / (2.0 * (y == 0).sum()))
        w, bias = descend(dims, heads, x, 2.0 * y[chosen] - 1.0, share[chosen], epochs, 1, chosen)
        if held.any():
            margin = bias + np.array([w[dims[a:b]] @ x[a:b] for a, b in zip(heads[:-1], heads[1:], strict=True)])
            slope, shift = logistic(margin[held], y[held])
    return Model(w * ratio, bias, slope, shift)


def logistic(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of P(good) over the margin, by Newton steps with a weak prior."""
    up, down = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - goal) + 1e-3 * (theta - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that no label may be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", CHUNK_BYTES):
        doc_id, text, label = (batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "text", "label"))
        yield pa.RecordBatch.from_arrays(
            [doc_id, label, pa.array(texts_as_indicators(text), pa.binary())], names=["doc_id", "label", "dims"]
        )


def sample(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, label, dims) of at most ``bound`` labelled documents outside the held-out part.

    The ids with the smallest hashes are taken before any text is read, and the bound holds
    again after the join, where an id may stand for any number of rows.
    """
    ids = (
        labels.select("doc_id", F.col(column).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(
        "doc_id", "text", F.col("label").cast("int").alias("label")
    )
    packed = found.mapInArrow(_packed, "doc_id long, label int, dims binary")
    return packed.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "dims").limit(bound)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Model of the rows of all batches, in the order of their hashes up to ``SAMPLE_BYTES``."""
    rows = []
    for batch in batches:
        rows += zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
    kept, size = [], 0
    for row in rows:
        size += len(row[2])
        if kept and size > SAMPLE_BYTES:
            break
        kept.append(row)
    kept.sort(key=lambda r: (r[0] * 0x9E3779B1 % (1 << 32), *r))
    model = fit([np.frombuffer(r[2], np.int32) for r in kept], [r[1] for r in kept])
    yield pa.RecordBatch.from_arrays([
        pa.array([model.weights.tobytes()], pa.binary()),
        pa.array([[model.bias, model.slope, model.shift]], pa.list_(pa.float64())),
    ], names=["weights", "rest"])


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", bound: int = SAMPLE) -> Model:
    """Fit on a bounded sample in one task; only the model, of fixed size, comes back."""
    rows = sample(docs, labels, column, bound).repartition(1).sortWithinPartitions(
        F.xxhash64("doc_id"), "doc_id", "label", "dims"
    ).mapInArrow(_fit_task, "weights binary, rest array<double>").collect()
    if not rows:
        return constant(0.5)
    weights, (bias, slope, shift) = rows[0]
    return Model(np.frombuffer(weights, float).copy(), bias, slope, shift)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [n for n in docs.columns if n != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            columns = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            text = batch.column(batch.schema.get_field_index("text"))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(shared.value.score(text))], names=[*kept, name]
            )

    schema = StructType([f for f in docs.schema if f.name in kept] + [StructField(name, DoubleType())])
    return docs.select(*kept).mapInArrow(run, schema)
