"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (of UTF-8 bytes, with a mark at
either end), each n-gram a hashed bucket with an embedding. The embeddings of a
window of a few words are averaged and go through a linear softmax with two
classes; a document is as toxic as its worst window, so that one insult in a
long text isn't averaged away. Embeddings and softmax are trained jointly in
numpy by Adagrad. A misspelling never seen shares most of its n-grams with
words that were, and so most of its average.

Scoring needs only each bucket's difference of class logits, one number for
each bucket, and sums it over all windows with array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from partita.llm.common import fitted, held_out, mix64, texts, with_text

BUCKETS, DIM = 1 << 18, 8
SIZES = (3, 4, 5)
WINDOW = 2
#: The bound on the fitted sample: the first labelled rows in the order of a hash of their identifier.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 10_000_000

#: ASCII letters and digits stay, lowered, and so do all bytes of longer characters; the rest parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_CHUNK = 1 << 21
_BYTE = mix64(np.arange(7, 263, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Bags:
    """N-grams of a run of documents: bucket of each, first n-gram of each word, first word of each document."""

    grams: np.ndarray
    words: np.ndarray
    docs: np.ndarray


def bags(group: list[bytes]) -> Bags:
    raw = (b" " + b"  ".join(group) + b" ").translate(_FOLD)
    data = np.frombuffer(raw, np.uint8)
    space = data == 32
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    coded = _BYTE[data]
    # An n-gram at i belongs to the word around it if no byte inside it is a space.
    where, bucket = [], []
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            continue
        good = ~space[1 : m + 1]
        for k in range(2, n - 1):
            good &= ~space[k : m + k]
        at = np.flatnonzero(good)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + coded[at + k]
        where.append(at)
        bucket.append((mix64(h) & np.uint64(BUCKETS - 1)).astype(np.int32))
    where, bucket = np.concatenate(where) if where else np.empty(0, int), np.concatenate(bucket) if bucket else np.empty(0, np.int32)
    order = np.argsort(where, kind="stable")
    grams = bucket[order]
    words = np.searchsorted(where[order], np.append(start - 1, len(data)))
    first = np.cumsum([1] + [len(t) + 2 for t in group])
    return Bags(grams, words, np.searchsorted(start, first))


def window_starts(b: Bags) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window's first and last word, and the document it belongs to."""
    n = np.diff(b.docs)
    count = np.where(n > 0, np.maximum(1, n - WINDOW + 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    first = np.repeat(b.docs[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    return first, np.minimum(first + WINDOW, b.docs[1:][doc]), doc


def worst_windows(b: Bags, logit: np.ndarray, windows: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document with words: its number, and the mean logit and place of its worst window."""
    first, last, doc = windows or window_starts(b)
    if not len(first):
        return np.empty(0, int), np.empty(0), np.empty((0, 2), int)
    sums = np.concatenate([[0.0], np.cumsum(logit[b.grams], dtype=np.float64)])
    low, high = b.words[first], b.words[last]
    mean = (sums[high] - sums[low]) / np.maximum(1, high - low)
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    top = np.maximum.reduceat(mean, cuts)
    # The first window that reaches the maximum.
    best = np.flatnonzero(mean == np.repeat(top, np.diff(np.append(cuts, len(doc)))))
    best = best[np.searchsorted(best, cuts)]
    return doc[cuts], top, np.stack([low[best], high[best]], 1)


@dataclass
class Model:
    """Per bucket the difference of the two class logits, and the bias."""

    logit: np.ndarray
    bias: float

    def scores(self, group: list[bytes]) -> np.ndarray:
        out = np.full(len(group), self.bias)
        at = 0
        while at < len(group):
            upto, size = at, 0
            while upto < len(group) and (size == 0 or size + len(group[upto]) < _CHUNK):
                size += len(group[upto])
                upto += 1
            doc, top, _ = worst_windows(bags(group[at:upto]), self.logit)
            out[at + doc] += top
            at = upto
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def fit(sample: list[bytes], label: list[int], epochs: int = 40, rate: float = 0.15, decay: float = 1e-5) -> Model:
    """Embeddings and softmax trained jointly; deterministic."""
    y = np.array(label, np.float64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 2.0)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(7)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft = rng.normal(0, 0.5, (DIM, 2))
    bias = 0.0
    emb_g, soft_g, bias_g = np.full(BUCKETS, 1e-8), np.full((DIM, 2), 1e-8), 1e-8
    # Both classes weigh the same.
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    order = rng.permutation(len(y))
    groups = [order[i : i + 200] for i in range(0, len(y), 200)]
    packed = [(b, window_starts(b)) for g in groups for b in [bags([sample[k] for k in g])]]
    for epoch in range(epochs):
        step = rate * (1 - 0.9 * epoch / epochs)
        for g, (b, windows) in zip(groups, packed, strict=True):
            direction = soft[:, 1] - soft[:, 0]
            logit = (emb @ direction).astype(np.float32)
            if epoch < 4:  # the whole document at first, since no window stands out yet
                lengths = b.words[b.docs]
                low, high = lengths[:-1], lengths[1:]
                doc = np.flatnonzero(high > low)
                sums = np.concatenate([[0.0], np.cumsum(logit[b.grams], dtype=np.float64)])
                place = np.stack([low[doc], high[doc]], 1)
                top = (sums[high[doc]] - sums[low[doc]]) / (high[doc] - low[doc])
            else:
                doc, top, place = worst_windows(b, logit, windows)
            p = 1 / (1 + np.exp(-np.clip(top + bias, -60, 60)))
            wrong = (p - y[g][doc]) * weight[g][doc]
            length = place[:, 1] - place[:, 0]
            at = np.repeat(place[:, 0] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
            per = np.bincount(b.grams[at], np.repeat(wrong / np.maximum(1, length), length), BUCKETS)
            rows = np.flatnonzero(per)
            d_dir = per[rows] @ emb[rows]
            gain = per[rows]
            emb_g[rows] += (gain * np.abs(direction).max()) ** 2  # one step size a row, by its largest component
            emb[rows] -= step * ((gain / np.sqrt(emb_g[rows]))[:, None] * direction + decay * emb[rows])
            grad = np.stack([-d_dir, d_dir], 1)
            soft_g += grad**2
            soft -= 0.3 * step * grad / np.sqrt(soft_g)
            bias_g += wrong.sum() ** 2
            bias -= step * wrong.sum() / np.sqrt(bias_g)
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, whole_rows: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    The model is fitted on a bounded sample (``SAMPLE_ROWS``, ``SAMPLE_BYTES``)
    of labelled rows that aren't held out; scoring sees the text only, whole.
    Null texts are empty; texts without words get the score of the bias.
    Repeated rows get equal scores; a null identifier is held out or not as an
    empty string is. Labels other than 0 and 1 are ignored, of contrary labels
    of one identifier the larger counts; without labels of both classes every
    text gets the smoothed share of label 1, 0.25 without any label, so that
    nothing is rejected on no evidence. Other columns are ignored; with
    ``whole_rows`` the input row comes along, as the struct ``row``.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, marks, id_col, text_col, fit, SAMPLE_ROWS, SAMPLE_BYTES))

    given, kinds = with_text(docs, id_col, text_col, whole_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.value.scores(texts(batch.columns[-1])), pa.float64())], [*batch.schema.names[:-1], "score"])

    scored = given.mapInArrow(run, StructType([*kinds, StructField("score", DoubleType())]))
    own = [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("score"), (F.col("score") >= threshold).cast("int").alias("predicted")]
    return scored.select(*own, *(["row"] if whole_rows else []))
