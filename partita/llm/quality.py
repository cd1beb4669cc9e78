"""Quality by ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed text features and ordered thresholds
``t1 < t2 < ...``: the probability that a document's grade is above k is the
logistic function of ``f(x) - t_k``. So all grades share what makes text good,
and the thresholds only say how much of it each grade takes. From the tail
probabilities come the expected grade and the selection.

Features are byte trigrams and whole words of the text, hashed, as shares of
the text, and buckets of its length, of its share of distinct words, and of its
share of distinct lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import fitted, held_out, mix64, texts

BUCKETS = 1 << 18
_MASK = np.uint64(BUCKETS - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The bound on the fitted sample: the first rated rows in the order of a hash of their identifier.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 10_000_000
#: What share of a document's weight its shape features carry beside the text's.
_SHAPE = 0.25


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one whole text."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    pieces, values = [], []
    if len(data) >= 3:
        grams = mix64(data[:-2] | data[1:-1] << np.uint64(8) | data[2:] << np.uint64(16)) & _MASK
        pieces.append(grams.astype(np.int64))
        values.append(np.full(len(grams), 1.0 / len(grams)))
    said = text.split()
    if said:
        words = np.fromiter(map(len, said), np.int64, len(said))
        distinct = len(set(said)) / len(said)
        lines = text.split(b"\n")
        shape = [1, min(15, int(np.log2(len(said) + 1))), 2, int(distinct * 10), 3, int(len(set(lines)) / len(lines) * 10), 4, min(15, int(words.mean()))]
        if len(said) < 12:
            shape += [5, len(said)]
    else:
        shape = [0, 0]
    pair = np.array(shape, np.uint64).reshape(-1, 2)
    pieces.append((mix64((pair[:, 0] + np.uint64(1)) * _STEP + pair[:, 1]) & _MASK).astype(np.int64))
    values.append(np.full(len(pair), _SHAPE))
    return np.concatenate(pieces), np.concatenate(values)


@dataclass
class Model:
    weight: np.ndarray
    thresholds: np.ndarray

    def tails(self, batch: list[bytes]) -> np.ndarray:
        """Row by row, the probabilities that the grade is above 0, 1, ..."""
        f = np.empty(len(batch))
        for k, text in enumerate(batch):
            at, value = features(text)
            f[k] = self.weight[at] @ value
        return 1 / (1 + np.exp(-np.clip(f[:, None] - self.thresholds[None, :], -60, 60)))


def likelihood(f: np.ndarray, theta: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of grades ``y``, and its derivatives by ``f`` and by the thresholds."""
    k, edge = np.arange(len(y)), np.zeros((len(y), 1))
    cum = 1 / (1 + np.exp(-np.clip(f[:, None] - theta[None, :], -60, 60)))
    # P(y = k) = tail_k - tail_{k+1}, with tail_0 = 1 and tail_K = 0.
    tail, slope = np.hstack([edge + 1, cum, edge]), np.hstack([edge, cum * (1 - cum), edge])
    prob = np.maximum(tail[k, y] - tail[k, y + 1], 1e-9)
    d_f = -(slope[k, y] - slope[k, y + 1]) / prob / len(y)
    d_theta = np.array([((np.where(y == j + 1, 1.0, 0.0) - np.where(y == j, 1.0, 0.0)) * slope[:, j + 1] / prob).sum() / len(y) for j in range(len(theta))])
    return float(-np.log(prob).mean()), d_f, d_theta


def fit(sample: list[bytes], grade: list[int], grades: int, epochs: int = 60, rate: float = 2.0, decay: float = 1e-6) -> Model:
    """Weights and thresholds by full-batch Adagrad on the negative log-likelihood; deterministic."""
    y = np.array(grade, np.int64)
    shares = [(np.sum(y > k) + 0.5) / (len(y) + 1.0) for k in range(grades - 1)]
    start = np.maximum.accumulate(np.array([np.log((1 - s) / s) for s in shares]) + 1e-3 * np.arange(grades - 1))
    weight = np.zeros(BUCKETS)
    if not len(y):
        return Model(weight, start)
    cells = [features(t) for t in sample]
    at = np.concatenate([c[0] for c in cells])
    value = np.concatenate([c[1] for c in cells])
    rows = np.concatenate([[0], np.cumsum([len(c[0]) for c in cells])])
    lengths = np.diff(rows)
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-3))
    acc_w, acc_f, acc_g = np.full(BUCKETS, 1e-8), 1e-8, np.full(len(gaps), 1e-8)
    for epoch in range(epochs):
        step = rate * (1 - 0.9 * epoch / epochs)
        theta = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        _, d_f, d_theta = likelihood(np.add.reduceat(weight[at] * value, rows[:-1]), theta, y)
        grad = np.bincount(at, np.repeat(d_f, lengths) * value, BUCKETS) + decay * weight
        acc_w += grad**2
        weight -= step * grad / np.sqrt(acc_w)
        acc_f += d_theta.sum() ** 2
        first -= 0.1 * step * d_theta.sum() / np.sqrt(acc_f)
        for j in range(len(gaps)):
            g = d_theta[j + 1 :].sum() * np.exp(gaps[j])
            acc_g[j] += g**2
            gaps[j] -= 0.1 * step * g / np.sqrt(acc_g[j])
    return Model(weight, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def quality(docs: DataFrame, ratings: DataFrame, grade, grades: int, select_above: int = 0, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, expected_grade, tail_prob, selected`` for every row of ``docs``.

    ``grade`` is a column of ``ratings`` with grades 0 to ``grades - 1``;
    ``tail_prob`` is the probability of a grade above ``select_above`` and a
    document is selected if it reaches ``threshold``. The model is fitted on a
    bounded sample (``SAMPLE_ROWS``, ``SAMPLE_BYTES``) of rated rows that
    aren't held out. Null texts are empty and scored as such. Grades that are
    null or out of range are ignored, of several grades of one identifier the
    least counts; with no ratings all documents get the same score. Other
    columns are ignored.
    """
    marks = ratings.select(F.col(id_col).cast("long").alias("i"), grade.cast("int").alias("y")).where(f"y between 0 and {grades - 1}").groupBy("i").agg(F.min("y").alias("y"))
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, marks, id_col, text_col, lambda sample, given: fit(sample, given, grades), SAMPLE_ROWS, SAMPLE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = model.value.tails(texts(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tails.sum(axis=1)), pa.array(tails[:, select_above])], ["doc_id", "held_out", "expected_grade", "tail_prob"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = narrow.mapInArrow(run, "doc_id long, held_out boolean, expected_grade double, tail_prob double")
    return scored.withColumn("selected", F.col("tail_prob") >= threshold)
