"""Quality by supervised subword embeddings.

Every word and every character n-gram of a word (with its borders) has a vector in a hashed
table. A document is the mean of the vectors of all of them, and a softmax over the classes is
laid on top; vectors and softmax are learnt together by stochastic gradient descent. Two
classes need only the difference of their outputs, which is a mean of one number for each
bucket: scoring a text is reading and averaging these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.blocks import binaries, ready
from papyra.llm.grams import char_grams, is_blank, labelled_sample, one_task, prior_shift, row_ends, rows_of, slices_of, usable_labels, words

LEAST, MOST = 3, 5
BUCKETS = 1 << 18
BUCKET_SHIFT = np.uint64(64 - 18)
REPEATED = np.uint64(0x5851F42D4C957F2D)
SIZE = 16
PER_CLASS = 2000
EPOCHS = 5
RATE = 0.1
SEED = 20
THRESHOLD = 0.3


def features(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, pair of words, and n-gram inside a word or at one of its borders.

    A word that follows itself makes the same pair whichever word it is.
    """
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashes, starts = words(points, edges)
    own = rows_of(starts, edges)
    next_to = np.flatnonzero(own[1:] == own[:-1])
    first, second = hashes[next_to], hashes[next_to + 1]
    with np.errstate(over="ignore"):
        pairs = np.where(first == second, REPEATED, first * np.uint64(0x9E3779B97F4A7C15) ^ second)
    row, bucket = [own, own[next_to]], [hashes, pairs]
    blanks = np.concatenate([[0], np.cumsum(is_blank(points))])
    ends, row_of = row_ends(edges), np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    for n, h in char_grams(points, LEAST, MOST):
        # a blank may only stand first or last
        inner = (blanks[n - 1 : n - 1 + len(h)] == blanks[1 : 1 + len(h)]) & (np.arange(n, len(points) + 1) <= ends[: len(h)])
        row.append(row_of[: len(h)][inner]), bucket.append(h[inner])
    return np.concatenate(row), (np.concatenate(bucket) >> BUCKET_SHIFT).astype(np.int64)


def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each bucket and the intercept, from ``(label, text)``."""
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    labels = []
    for batch in batches:
        labels.append(batch.column(0).to_numpy())
        for lo, hi, points, edges in slices_of(batch.column(1)):
            row, bucket = features(points, edges)
            pair, count = np.unique((row << 18) | bucket, return_counts=True)
            at = np.searchsorted(pair >> 18, np.arange(hi - lo + 1))
            for a, b in zip(at, at[1:], strict=False):
                docs.append(((pair[a:b] & (BUCKETS - 1)).astype(np.int32), (count[a:b] / max(1, count[a:b].sum())).astype(np.float32)))
    y = np.concatenate(labels) if labels else np.empty(0, np.int64)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    out, bias = np.zeros((2, SIZE), np.float32), np.zeros(2, np.float32)
    if 0 < y.sum() < len(y):
        steps, done = EPOCHS * len(y), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(y)):
                rate = np.float32(RATE * (1 - done / steps))
                done += 1
                at, share = docs[i]
                mean = share @ vectors[at]
                logits = out @ mean + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[y[i]] -= 1
                # n features move their mean by 1 / n of a step, hence the factor of their number
                back = (rate * (out.T @ p)).astype(np.float32)
                out -= rate * np.outer(p, mean)
                bias -= rate * p
                vectors[at] -= np.minimum(share * len(at), 8)[:, None] * back
    else:  # one class only: its smoothed share
        share = (y.sum() + 1) / (len(y) + 2)
        vectors[:] = 0
        bias[1] = np.log(share / (1 - share))
    table = vectors @ (out[1] - out[0])
    yield pa.record_batch({"table": binaries([table.astype(np.float32).tobytes()]), "bias": pa.array([float(bias[1] - bias[0])], pa.float64())})


def scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value
        for batch in batches:
            for lo, hi, points, edges in slices_of(batch.column(1)):
                row, bucket = features(points, edges)
                total = np.bincount(row, table[bucket], hi - lo)
                margin = total / np.maximum(np.bincount(row, minlength=hi - lo), 1) + bias
                score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.record_batch({"doc_id": batch.column(0).slice(lo, hi - lo), "score": pa.array(score, pa.float64())})

    return run


def quality(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, score, predicted`` for every row, by the whole text.

    ``learn`` maps an id column to whether the label of that id may be learnt from; at most
    ``per_class`` texts of each class are. Null and empty texts have no features and get the
    score of the intercept. Without usable labels, or with one class only, every text gets the
    smoothed share of that class (0.5 without any). Repeated rows are scored one by one. Other
    columns are not read.
    """
    spark = ready(docs)
    marks = usable_labels(labels, label, learn)
    sample = labelled_sample(docs, marks, per_class, key, text)
    fitted = one_task(sample, fit, "table binary, bias double")
    table, bias = (np.frombuffer(fitted[0][0], np.float32), fitted[0][1] + prior_shift(marks, per_class)) if fitted else (np.zeros(BUCKETS, np.float32), 0.0)
    model = spark.sparkContext.broadcast((table, bias))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(scorer(model), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
