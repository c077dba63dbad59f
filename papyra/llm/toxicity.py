"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its character n-grams of ``LEAST`` to ``MOST`` characters in lower case. Over
the labelled sample, ``r = log((p + a) / |p|) - log((q + a) / |q|)`` compares in how many toxic and other
texts an n-gram occurs; the ``FEATURES`` n-grams with the most telling ratios are kept, a text's
features are the ratios of those it holds, and a logistic regression learns their weights.
Scoring looks every n-gram of the whole text up in a table of fixed size that is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.blocks import binaries, forget_stores, ready
from papyra.llm.grams import char_grams, labelled_sample, one_task, prior_shift, row_ends, rows_of, slices_of, usable_labels

LEAST, MOST = 3, 6
PER_CLASS = 3000
FEATURES = 1 << 15
SLOTS = 1 << 18
SLOT_SHIFT = np.uint64(64 - 18)
COUNT_BITS = 22
TEXT_BYTES = 1 << 18  # of text that is cut into n-grams at once
PAIRS = 1 << 18  # pairs of text and feature that a step of the fit looks at at once
KEYS_HELD = 1 << 21  # counts of n-grams that wait for being added up
SMOOTHING = 1.0
RIDGE = 1e-3
STEPS = 300
THRESHOLD = 0.3


def sets(points: np.ndarray, edges: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs of the n-grams whose slot holds their hash, or is marked."""
    row, gram, ends = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], None
    shift = np.uint64(64 - (len(slots) - 1).bit_length())
    for k, h in char_grams(points, LEAST, MOST):
        there = slots[(h >> shift).astype(np.int64)]
        at = np.flatnonzero(there if there.dtype == bool else there == h)
        ends = row_ends(edges) if ends is None else ends
        at = at[at + k <= ends[at]]
        row.append(rows_of(at, edges)), gram.append(h[at])
    row, gram = np.concatenate(row), np.concatenate(gram)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def buckets(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of all n-grams."""
    parts, shift, ends = [np.empty(0, np.uint64)], np.uint64(64 - COUNT_BITS), row_ends(edges)
    row = np.repeat(np.arange(len(edges) - 1, dtype=np.uint64), np.diff(edges)) << np.uint64(COUNT_BITS)
    for k, h in char_grams(points, LEAST, MOST):
        at = np.flatnonzero(np.arange(k, len(points) + 1) <= ends[: len(h)])
        parts.append(row[at] | (h[at] >> shift))
    pair = np.unique(np.concatenate(parts))
    return (pair >> np.uint64(COUNT_BITS)).astype(np.int64), (pair & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)


def log_ratio(inside: np.ndarray, outside: np.ndarray, n_in: int, n_out: int) -> np.ndarray:
    return np.log((inside + SMOOTHING) / (n_in + 2 * SMOOTHING)) - np.log((outside + SMOOTHING) / (n_out + 2 * SMOOTHING))


def counted(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes with the sums of both their counts."""
    keys, inside, outside = (np.concatenate(x) for x in zip(*parts))
    keys, column = np.unique(keys, return_inverse=True)
    return keys, np.bincount(column, inside, len(keys)), np.bincount(column, outside, len(keys))


def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and weights of the table, and the intercept, from ``(label, text)``.

    Texts are kept as they come and cut again in each pass, so only the n-grams of a slice and those kept at last stand in memory.
    """
    forget_stores()
    held = [(batch.column(0).to_numpy(), batch.column(1)) for batch in batches]

    def cut() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for own, texts in held:
            for lo, hi, points, edges in slices_of(texts, TEXT_BYTES):
                yield own[lo:hi], points, edges

    counts = np.zeros((2, 1 << COUNT_BITS), np.int32)
    for own, points, edges in cut():
        row, bucket = buckets(points, edges)
        for c in (0, 1):
            np.add.at(counts[c], bucket[own[row] == c], 1)
    y = np.concatenate([own for own, _ in held]) if held else np.empty(0, np.int32)
    n = [int((y == 0).sum()), int((y == 1).sum())]
    worth = np.zeros(1 << COUNT_BITS)
    often = np.flatnonzero(counts.sum(0) > 2)
    worth[often] = np.abs(log_ratio(counts[1, often], counts[0, often], n[1], n[0]))
    floor = np.partition(worth, len(worth) - 2 * FEATURES)[-2 * FEATURES]
    some = worth > max(floor, 0.1)
    del counts, worth

    parts, waiting = [(np.empty(0, np.uint64), np.empty(0), np.empty(0))], 0
    for own, points, edges in cut():
        row, gram = sets(points, edges, some)
        one = own[row] == 1
        parts.append(counted([(gram, one, ~one)]))
        waiting += len(parts[-1][0])
        if waiting > KEYS_HELD:
            parts, waiting = [counted(parts)], 0
    keys, inside, outside = counted(parts)
    del parts, some
    ratio = log_ratio(inside, outside, n[1], n[0])
    # one key for each slot, the most telling one
    order = np.argsort(-np.abs(ratio) * (inside + outside > 2), kind="stable")
    _, at = np.unique(keys[order] >> SLOT_SHIFT, return_index=True)
    kept = np.zeros(len(keys), bool)
    kept[order[at[at < FEATURES]]] = True
    kept &= inside + outside > 2
    keys, ratio = keys[kept], ratio[kept]

    slots = np.zeros(SLOTS, np.uint64)
    slots[(keys >> SLOT_SHIFT).astype(np.int64)] = keys
    rows, columns, first = [np.empty(0, np.int32)], [np.empty(0, np.int32)], 0
    for own, points, edges in cut():
        row, gram = sets(points, edges, slots)
        use = np.isin(gram, keys)  # an empty slot looks like the hash 0
        rows.append((row[use] + first).astype(np.int32)), columns.append(np.searchsorted(keys, gram[use]).astype(np.int32))
        first += len(own)
    weights, bias = regress(np.concatenate(rows), np.concatenate(columns), ratio, y)
    yield pa.record_batch({"keys": binaries([keys.tobytes()]), "weights": binaries([(weights * ratio).astype(np.float32).tobytes()]), "bias": pa.array([bias], pa.float64())})


def regress(row: np.ndarray, column: np.ndarray, ratio: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression of ``y`` on rows of scaled features, by gradient steps with momentum (Adam)."""
    n, size = len(y), len(ratio)
    w, bias = np.zeros(size + 1), 0.0
    if not n or not (0 < y.sum() < n):  # one class only: its smoothed share
        share = (y.sum() + SMOOTHING) / (n + 2 * SMOOTHING)
        return w[:-1], float(np.log(share / (1 - share)))
    # rows come in order; a stretch of them at a time, so that the numbers of all pairs never stand in memory at once
    borders = np.searchsorted(row, np.arange(n + 1))
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(borders, borders[cuts[-1]] + PAIRS, "right")) - 1))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        drawn, pull, error = ratio * w[:-1], np.zeros(size), np.zeros(n)
        for lo, hi in zip(cuts, cuts[1:]):
            there, of = column[borders[lo] : borders[hi]], row[borders[lo] : borders[hi]] - lo
            margin = np.bincount(of, drawn[there], hi - lo) + w[-1]
            error[lo:hi] = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[lo:hi]) / n
            np.add.at(pull, there, ratio[there] * error[lo:hi][of])
        grad = np.append(pull + RIDGE / n * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_stores()
        keys, weights, bias = model.value
        slots, table = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.float32)
        where = (keys >> SLOT_SHIFT).astype(np.int64)
        slots[where], table[where] = keys, weights
        for batch in batches:
            names = batch.schema.names
            for lo, hi, points, edges in slices_of(batch.column(len(names) - 1), TEXT_BYTES):
                row, gram = sets(points, edges, slots)
                margin = np.bincount(row, table[(gram >> SLOT_SHIFT).astype(np.int64)], hi - lo) + bias
                score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.record_batch([*(batch.column(i).slice(lo, hi - lo) for i in range(len(names) - 1)), pa.array(score, pa.float64())], names=[*names[:-1], "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """The classifier: keys, weights and intercept. Learns from at most ``per_class`` texts of each class."""
    marks = usable_labels(labels, label, learn)
    sample = labelled_sample(docs, marks, per_class).withColumn("text", F.lower("text"))
    fitted = one_task(sample, fit, "keys binary, weights binary, bias double")
    if not fitted:
        return np.empty(0, np.uint64), np.empty(0, np.float32), 0.0
    keys, weights, bias = fitted[0]
    return np.frombuffer(keys, np.uint64), np.frombuffer(weights, np.float32), bias + prior_shift(marks, per_class)


def toxicity(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, score, predicted`` for every row, by the whole text.

    ``learn`` maps an id column to whether the label of that id may be learnt from. Null and empty
    texts hold no n-gram and get the score of the intercept. Without usable labels, or with one
    class only, every text gets the smoothed share of that class (0.5 without any). Repeated
    rows are scored one by one. Other columns are not read.
    """
    spark = ready(docs)
    model = spark.sparkContext.broadcast(train(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels, learn, label, per_class))
    rows = docs.select(F.col(key).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(scorer(model), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, learn, text: str = "text") -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns."""
    spark = ready(docs)
    model = spark.sparkContext.broadcast(train(docs, labels, learn))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.lower(F.coalesce(F.col(text), F.lit(""))).alias("scored_text"))
    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(docs.columns))
    scored = rows.mapInArrow(scorer(model), f"{fields}, score double").filter(F.col("score") < THRESHOLD)
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
