"""Exact top-k inner products by norm buckets.

Vectors are sorted by length and packed into buckets of ``BUCKET`` vectors with similar
lengths. Queries go against them in waves of at most ``WAVE`` queries, a broadcast of fixed
size. A first look at the longest bucket gives every query a valid lower bound of its k-th
score; from then on a bucket with longest vector ``l`` can only help a query ``q`` with bound
``s`` through vectors whose cosine to ``q`` is at least the local threshold ``s / (|q| l)``:

* above 1 the bucket is skipped;
* a high threshold leaves narrow feasible ranges for the coordinates of a unit vector, so the
  bucket's sorted coordinate lists are intersected for the query's largest coordinates
  (coordinate pruning);
* a low one leaves the prefix of vectors long enough to reach the bound (length pruning).

Which of the two a bucket uses from which threshold on is tuned in the bucket on some of its
queries. Candidates are always verified by the exact integer product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.blocks import binaries, ready, shards
from papyra.session import materialize

BUCKET = 2048
WAVE = 1 << 15
QUERY_BLOCK = 256
FOCUS = 4
TRIALS = 16
SLACK = 1e-9
SMALLEST = np.iinfo(np.int64).min


def scaled(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``(id, vec, size, length)`` with whole-number components; unusable vectors are left out."""
    usable = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    vec = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & usable).select(F.col(key).cast("long").alias("id"), vec.alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select("id", "vec", F.size("vec").alias("size"), F.sqrt(square).alias("length"))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by size and falling length to buckets of matrices."""
    ids, rows, sizes, lengths, waiting = [], [], [], [], 0

    def out():
        for i in range(0, len(ids), BUCKET):
            part = slice(i, i + BUCKET)
            width = sizes[part][0]
            matrix = np.asarray(rows[part], np.int64).reshape(-1, width)
            yield pa.record_batch({
                "size": pa.array([width], pa.int32()), "longest": pa.array([max(lengths[part])], pa.float64()),
                "ids": binaries([np.asarray(ids[part], np.int64).tobytes()]), "vectors": binaries([matrix.tobytes()]),
            })

    for batch in batches:
        flat, where = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
        where = where - where[0]
        for i, (key, size, length) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if sizes and (size != sizes[-1] or len(ids) == BUCKET):
                yield from out()
                ids, rows, sizes, lengths = [], [], [], []
            ids.append(key), rows.append(flat[where[i] : where[i + 1]]), sizes.append(size), lengths.append(length)
    if ids:
        yield from out()


BUCKETS = "size int, longest double, ids binary, vectors binary"


class Best:
    """The k best (score, smallest id) of each query of a wave so far."""

    def __init__(self, count: int, k: int, floor: np.ndarray):
        self.k, self.floor, self.found = k, floor.copy(), [[] for _ in range(count)]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.floor[q]
        scores, ids = scores[keep], ids[keep]
        if not len(scores):
            return
        if len(scores) > self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
        best = sorted([*self.found[q], *zip((-scores).tolist(), ids.tolist(), strict=True)])[: self.k]
        self.found[q] = best
        if len(best) == self.k:
            self.floor[q] = max(self.floor[q], -best[-1][0])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; by floats where no sum can leave their exact range."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if reach < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def feasible(unit: np.ndarray, lists: np.ndarray, order: np.ndarray, t: float) -> np.ndarray:
    """Rows whose focus coordinates allow a cosine of ``t`` or more to ``unit``."""
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    room = np.sqrt(max(0.0, 1 - t * t) * np.clip(1 - unit[focus] ** 2, 0, None)) + SLACK
    lo = [np.searchsorted(lists[f], t * unit[f] - w, "left") for f, w in zip(focus, room, strict=True)]
    # where the best direction of the cap is inside it, the upper end is 1
    hi = [np.searchsorted(lists[f], 1 + SLACK if abs(unit[f]) >= t and unit[f] > 0 else t * unit[f] + w, "right") for f, w in zip(focus, room, strict=True)]
    lo = [0 if abs(unit[f]) >= t and unit[f] < 0 else x for f, x in zip(focus, lo, strict=True)]
    hits = np.zeros(lists.shape[1], np.int8)
    for f, a, b in zip(focus, lo, hi, strict=True):
        hits[order[f, a:b]] += 1
    return np.flatnonzero(hits == len(focus))


def search_bucket(ids, rows, query_ids, queries, lengths, best: Best, own: bool = True) -> None:
    """Bring the results of a wave up to date with one bucket (rows by falling length)."""
    size = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
    longest = size[0] if len(size) else 0.0
    # k better scores than the floor may be missing still; a floor of SMALLEST prunes nothing
    bound = np.where(best.floor == SMALLEST, -np.inf, best.floor.astype(np.float64))
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(lengths > 0, bound / lengths, np.where(bound > 0, np.inf, -np.inf))
        local = np.where(reach > 0, reach / longest if longest > 0 else np.inf, -1.0)
    active = np.flatnonzero(local <= 1 + SLACK)
    if not len(active):
        return
    cut = 2.0
    high = active[local[active] > 0.3]
    lists = order = unit = None
    if len(high):
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.where(size[:, None] > 0, rows / size[:, None], 0.0)
        order = np.argsort(unit, axis=0, kind="stable").T
        lists = np.take_along_axis(unit.T, order, axis=1)
        # the smallest tried threshold from which on ranges leave under an eighth of the prefix
        for q in high[np.argsort(-local[high])][:: max(1, len(high) // TRIALS)]:
            prefix = np.searchsorted(-size, -reach[q] * (1 - SLACK) + SLACK, "right")
            if len(feasible(queries[q] / lengths[q], lists, order, min(1.0, local[q] * (1 - SLACK)))) * 8 > prefix:
                break
            cut = local[q]
    by_angle = active[local[active] >= cut]
    for q in by_angle:
        rest = feasible(queries[q] / lengths[q], lists, order, min(1.0, local[q] * (1 - SLACK)))
        rest = rest[ids[rest] != query_ids[q]]
        best.add(q, products(queries[q : q + 1], rows[rest])[0], ids[rest])
    by_length = active[local[active] < cut]
    by_length = by_length[np.argsort(reach[by_length], kind="stable")]
    for i in range(0, len(by_length), QUERY_BLOCK):
        block = by_length[i : i + QUERY_BLOCK]
        least = reach[block[0]]
        prefix = len(rows) if least <= 0 else int(np.searchsorted(-size, -least * (1 - SLACK) + SLACK, "right"))
        scores = products(queries[block], rows[:prefix])
        for j, q in enumerate(block):
            other = ids[:prefix] != query_ids[q]
            best.add(q, scores[j][other], ids[:prefix][other])


def searcher(wave, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waves = {size: (q_ids, q, np.sqrt((q.astype(np.float64) ** 2).sum(1)), Best(len(q_ids), k, floor)) for size, (q_ids, q, floor) in wave.value.items()}
        for batch in batches:
            for row in batch.to_pylist():
                if row["size"] in waves:
                    ids = np.frombuffer(row["ids"], np.int64)
                    rows = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["size"])
                    search_bucket(ids, rows, *waves[row["size"]])
        for q_ids, _, _, best in waves.values():
            found = [(int(q), i, -s) for q, rows in zip(q_ids, best.found, strict=True) for s, i in rows]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return run


FOUND = "query_id bigint, vec_id bigint, score bigint"


def search_wave(buckets: DataFrame, wave: dict, k: int) -> DataFrame:
    spark = buckets.sparkSession
    return buckets.mapInArrow(searcher(spark.sparkContext.broadcast(wave), k), FOUND)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """The ``k`` best inner products of every query: ``query_id, rank, vec_id, score``.

    Components become ``floor(scale * x)``. Ties go to the smaller id; a query does not meet
    rows of its own id. Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part; vectors meet only vectors with as many components. If an id
    repeats among the queries, its smallest vector asks; repeated rows among the candidates
    count one by one. Empty tables give no rows. Other columns are not read.
    """
    spark = ready(vectors)
    n = shards(spark)
    rows = scaled(vectors, key, vector, scale).repartitionByRange(n, "size", F.col("length").desc(), "id")
    rows = rows.sortWithinPartitions("size", F.col("length").desc(), "id")
    buckets = materialize(rows.select("id", "vec", "size", "length").mapInArrow(pack, BUCKETS), "buckets")
    top = buckets.groupBy("size").agg(F.max("longest").alias("longest"))
    top = materialize(buckets.join(top, ["size", "longest"], "left_semi"), "longest")
    asked = scaled(queries, key, vector, scale).groupBy("id").agg(F.min("vec").alias("vec"))
    asked = materialize(asked.withColumn("wave", F.pmod(F.xxhash64("id"), F.lit(_waves(asked)))), "queries")
    results = []
    for number in sorted(r[0] for r in asked.select("wave").distinct().collect()):
        part = asked.filter(F.col("wave") == number).select("id", "vec").collect()  # about WAVE rows
        wave = {}
        for size in {len(r["vec"]) for r in part}:
            same = [r for r in part if len(r["vec"]) == size]
            wave[size] = (np.array([r["id"] for r in same], np.int64), np.array([r["vec"] for r in same], np.int64).reshape(len(same), size), np.full(len(same), SMALLEST))
        first = search_wave(top, wave, k).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("scores"))
        floors = dict(first.filter(F.size("scores") >= k).select("query_id", F.col("scores")[k - 1]).collect())
        wave = {s: (i, q, np.array([floors.get(int(x), SMALLEST) for x in i], np.int64)) for s, (i, q, _) in wave.items()}
        results.append(search_wave(buckets, wave, k))
    found = reduce(DataFrame.union, results) if results else spark.createDataFrame([], FOUND)
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _waves(asked: DataFrame) -> int:
    return asked.count() // WAVE + 1
