"""Character and word n-grams of whole slices of texts as 64-bit hashes, and labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.blocks import SLICE_BYTES, mix, powers, slices, utf8

BLANKS = np.zeros(128, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of some rows in one array, with row offsets in it."""
    part = data[offsets[0] : offsets[-1]]
    points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) == len(part):
        return points, offsets - offsets[0]
    seen = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    return points, seen[offsets - offsets[0]]


def is_blank(points: np.ndarray) -> np.ndarray:
    return BLANKS[np.minimum(points, 127)]


def char_grams(points: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each n from ``least`` to ``most``: n, and the hash of the n-gram at every place, also across rows.

    The leading bits of a hash are its best ones. Blanks of any kind count as a space.
    """
    values = np.where(is_blank(points), np.uint32(32), points).astype(np.uint64)
    n = len(points)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, min(most, n) + 1):
            h = h[: n - k + 1] * np.uint64(0x9E3779B97F4A7C15) + values[k - 1 :]
            if k >= least:
                yield k, (h + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)


def row_ends(edges: np.ndarray) -> np.ndarray:
    """For every place, where its row ends."""
    return np.repeat(edges[1:], np.diff(edges))


def rows_of(at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, at, "right") - 1


def words(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without blanks), case kept, and where they start."""
    n = len(points)
    solid = ~is_blank(points)
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = edges[1:-1]
    opens[inner[inner < n]] = solid[inner[inner < n]]
    closes[inner[inner > 0] - 1] = solid[inner[inner > 0] - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts]), starts


def usable_labels(labels: DataFrame, label: str, learn, key: str = "doc_id") -> DataFrame:
    """``(id, label)`` for which ``learn(id)`` holds; ids with contradictory labels are left out."""
    marks = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & learn(F.col("id")))
    return marks.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("id", "label")


def labelled_sample(docs: DataFrame, marks: DataFrame, per_class: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(label, text, id)`` of at most ``per_class`` labelled documents of each class.

    The first by the hash of the id are taken, so the sample does not depend on partitions; of
    repeated documents each row counts.
    """
    first = [marks.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    chosen = first[0].union(first[1])  # 2 * per_class rows at most
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    return rows.select("label", "text", "id")


def prior_shift(marks: DataFrame, per_class: int) -> float:
    """What to add to the log odds of a classifier learnt from such a sample, as its classes are cut differently."""
    counts = dict(marks.groupBy("label").count().collect())
    if len(counts) < 2:
        return 0.0
    odds = counts[1] / counts[0] / (min(counts[1], per_class) / min(counts[0], per_class))
    return float(np.log(odds))


def one_task(sample: DataFrame, fit, schema: str) -> list:
    """Fit in a single task on a sample of bounded size, in the order of ids."""
    return sample.repartition(1).sortWithinPartitions("id", "text").select("label", "text").mapInArrow(fit, schema).collect()


def slices_of(batch_column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a text column with their code points and row offsets."""
    data, offsets = utf8(batch_column)
    for lo, hi in slices(offsets, limit):
        yield lo, hi, *code_points(data, offsets[lo : hi + 1])
