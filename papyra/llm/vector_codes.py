"""Vector codes: product quantisation trained by Lloyd rounds with adaptive distance bounds.

Vectors become whole numbers and are cut into parts; each part position has a codebook. What
a round knows is kept in blocks of vectors, written to the shared folder: for each part its ``b`` closest
entries with a lower bound each, in ascending order, and one outer bound for all other entries. When the entries have
moved, a bound shrinks by its entry's way (the outer one by the longest way), and the distance
to the own entry is computed anew, exactly:

* if it is below all bounds, the part keeps its entry and nothing else is looked at;
* entries of the list whose bound it reaches are verified by whole-number distances;
* if it still reaches the outer bound, all entries are compared.

``b`` is adapted after each round to what the round has needed: it shrinks to the places of the list that almost all
parts stayed within, and grows where many parts had to look at all entries. Bounds are rounded down
and never decide between entries: equal or nearly equal distances are always computed as whole numbers, so ties
go to the lower index and results do not depend on ``b``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.blocks import binaries, ready
from papyra.llm.topk import products
from papyra.session import materialize, new_path

PARTS = 4
ENTRIES = 256  # a code's index has two hexadecimal digits
ROUNDS = 4
BLOCK = 1024
WIDEST, NARROWEST, START = 64, 4, 16  # of b
SETTLED = 0.98  # share of parts that the next list should serve
REACH = 2.0**54  # of a squared distance, so that it and an index fit 64 bits
UP, DOWN = 1 + 1e-9, 1 - 1e-9


# -- one block in a task -------------------------------------------------------------------------


def squares(vectors: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all entries."""
    return (vectors * vectors).sum(1)[:, None] - 2 * products(vectors, book) + (book * book).sum(1)[None, :]


def closest(vectors: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By comparing all entries: the ``b`` closest with their bounds, the outer bound, and the least squared distance."""
    k = len(book)
    key = squares(vectors, book) * k + np.arange(k)
    if b < k:
        key = np.partition(key, b, axis=1)[:, : b + 1]
    key.sort(axis=1)
    entry, far = key % k, np.sqrt((key // k).astype(np.float64)) * DOWN
    outer = far[:, b] if b < k else np.full(len(key), np.inf)
    return entry[:, :b], far[:, :b], outer, key[:, 0] // k


def reassign(vectors, book, entry, low, outer, way, b: int):
    """Lists and bounds after the entries moved by ``way``; also the squared distances and the list places needed (-1: all entries)."""
    low, outer = low - way[entry], outer - way.max(initial=0.0)
    gap = vectors - book[entry[:, 0]]
    error = (gap * gap).sum(1)
    low[:, 0] = np.sqrt(error.astype(np.float64)) * DOWN
    reach = np.sqrt(error.astype(np.float64)) * UP
    near = low <= reach[:, None]
    near[:, 0] = False
    best = entry[:, 0].copy()
    row, place = np.nonzero(near)
    if len(row):
        candidate = entry[row, place]
        gap = vectors[row] - book[candidate]
        square = (gap * gap).sum(1)
        low[row, place] = np.sqrt(square.astype(np.float64)) * DOWN
        key = np.full(len(vectors), np.iinfo(np.int64).max)
        np.minimum.at(key, row, square * len(book) + candidate)
        key = np.minimum(key, error * len(book) + best)
        error, best = key // len(book), key % len(book)
    needed = np.where(near.any(1), near.shape[1] - np.argmax(near[:, ::-1], axis=1), 1)
    order = np.argsort(np.where((entry == best[:, None]) & np.isfinite(low), -1.0, low), axis=1, kind="stable")
    entry, low = np.take_along_axis(entry, order, 1), np.take_along_axis(low, order, 1)
    # to b places: what is cut off counts as an outside entry; an empty place has no entry to be looked at
    have = entry.shape[1]
    if b < have:
        outer = np.minimum(outer, low[:, b])
    else:
        entry = np.pad(entry, ((0, 0), (0, b - have)))
        low = np.pad(low, ((0, 0), (0, b - have)), constant_values=np.inf)
    entry, low = entry[:, :b].copy(), low[:, :b].copy()
    lost = np.flatnonzero(np.minimum(outer, np.inf) <= np.sqrt(error.astype(np.float64)) * UP)
    if len(lost):
        entry[lost], low[lost], outer[lost], error[lost] = closest(vectors[lost], book, b)
        needed[lost] = -1
    return entry, low, outer, error, needed


def squeeze(bounds: np.ndarray) -> tuple[bytes, float]:
    """Bounds in 16 bits each, rounded down, and their unit."""
    bounds = np.maximum(bounds, 0)
    top = bounds[np.isfinite(bounds)].max(initial=0.0)
    unit = float(top) / 2.0**15 or 1.0
    small = (bounds / unit).astype(np.float16)
    small = np.where(small.astype(np.float64) * unit > bounds, np.nextafter(small, np.float16(0)), small)
    return small.tobytes(), unit


def exact_enough(vectors: np.ndarray) -> None:
    reach = float(np.abs(vectors).max(initial=0))
    if 4 * reach * reach * max(vectors.shape[1], 1) * ENTRIES >= REACH * ENTRIES:
        raise OverflowError(f"a component of {reach:.0f} is too large for exact 64-bit distances")


def one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def block_row(ids, labels, vectors: np.ndarray, lists: list[tuple], needed: np.ndarray) -> pa.RecordBatch:
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not len(vectors) or np.iinfo(t).min <= vectors.min(initial=0) and vectors.max(initial=0) <= np.iinfo(t).max)
    entry = np.stack([x[0] for x in lists]).astype(np.uint8)
    bounds, unit = squeeze(np.stack([np.concatenate([x[1], x[2][:, None]], axis=1) for x in lists]))
    return pa.record_batch({
        "ids": one_list(ids), "labels": one_list(labels), "vectors": binaries([vectors.astype(kind).tobytes()]), "item": pa.array([kind().itemsize], pa.int32()),
        "b": pa.array([entry.shape[2]], pa.int32()), "entries": binaries([entry.tobytes()]), "bounds": binaries([bounds]), "unit": pa.array([unit], pa.float64()),
        "needed": pa.array([needed.tolist()], pa.list_(pa.int64())),
    })


def vectors_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["vectors"], f"i{row['item']}").reshape(len(row["ids"]), -1).astype(np.int64)


def lists_of(row: dict, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, b = len(row["ids"]), row["b"]
    entry = np.frombuffer(row["entries"], np.uint8).reshape(parts, n, b).astype(np.int64)
    bounds = np.frombuffer(row["bounds"], np.float16).reshape(parts, n, b + 1).astype(np.float64) * row["unit"]
    return entry, bounds[:, :, :b], bounds[:, :, b]


def part_of(vectors: np.ndarray, p: int, parts: int) -> np.ndarray:
    width = vectors.shape[1] // parts
    return vectors[:, p * width : (p + 1) * width]


def first_lists(books, parts: int, b: int):
    """(id, label, vector) rows to blocks, every part compared with all entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                yield of_rows(table.slice(0, BLOCK))
                held = table.slice(BLOCK).to_batches()
        if sum(map(len, held)):
            yield of_rows(pa.Table.from_batches(held).combine_chunks())

    def of_rows(table: pa.Table) -> pa.RecordBatch:
        ids, labels, column = (table.column(i).combine_chunks() for i in range(3))
        vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), -1)
        exact_enough(vectors)
        lists = [closest(part_of(vectors, p, parts), books.value[p], b) for p in range(parts)]
        return block_row(ids, labels, vectors, lists, np.zeros(WIDEST + 2, np.int64))

    return run


def next_lists(books, ways, parts: int, b: int):
    """Blocks to blocks after the entries have moved; ``needed`` counts parts by the place of the list they needed (0: all entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                vectors, (entry, low, outer) = vectors_of(row), lists_of(row, parts)
                lists = [reassign(part_of(vectors, p, parts), books.value[p], entry[p], low[p], outer[p], ways.value[p], b) for p in range(parts)]
                needed = sum(np.bincount(np.maximum(x[4], 0), minlength=WIDEST + 2) for x in lists)
                yield block_row(batch.column(0)[i].values, batch.column(1)[i].values, vectors, lists, needed)

    return run


def last_codes(books, ways, parts: int, b: int):
    """Blocks to (id, label, code, error) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                vectors, (entry, low, outer) = vectors_of(row), lists_of(row, parts)
                found = [reassign(part_of(vectors, p, parts), books.value[p], entry[p], low[p], outer[p], ways.value[p], b) for p in range(parts)]
                codes = np.stack([x[0][:, 0] for x in found], axis=1).astype(np.uint8)
                error = sum(x[3] for x in found)
                yield pa.record_batch({"id": batch.column(0)[i].values, "label": batch.column(1)[i].values, "code": pa.array([c.tobytes().hex() for c in codes], pa.string()), "error": pa.array(error, pa.int64())})

    return run


def entry_sums(parts: int, entries: int, width: int):
    """Per task, part and entry: how many parts chose it, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                vectors = vectors_of(row)
                own = np.frombuffer(row["entries"], np.uint8).reshape(parts, len(vectors), row["b"])[:, :, 0]
                for p in range(parts):
                    count[p] += np.bincount(own[p], minlength=entries)
                    np.add.at(total[p], own[p], part_of(vectors, p, parts))
        part, entry = np.nonzero(count)
        yield pa.record_batch({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(count[part, entry], pa.int64()), "sums": pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))})

    return run


# -- the rounds --------------------------------------------------------------------------------------


class Store:
    """The blocks of one round at a time in the shared folder; the round before goes once the next is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def put(self, blocks: DataFrame) -> DataFrame:
        path = new_path(self.spark, "lists")
        blocks.write.parquet(path)
        self.drop()
        self.path = path
        return self.spark.read.schema(blocks.schema).parquet(path)

    def drop(self) -> None:
        if self.path is not None:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def moved(blocks: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks after a round, and how far each entry went (rounded up)."""
    parts, entries, width = books.shape
    sums = blocks.select("ids", "vectors", "item", "b", "entries").mapInArrow(entry_sums(parts, entries, width), "part int, entry int, n bigint, sums array<bigint>")
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    new = books.copy()
    for part, entry, n, *s in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # parts * entries rows
        new[part, entry] = np.array(s, np.int64) // n
    gap = (new - books).astype(np.float64)
    return new, np.sqrt((gap * gap).sum(2)) * UP


def adapted(blocks: DataFrame, b: int, entries: int) -> int:
    """The length of the next lists from what the last round needed."""
    counts = np.array(blocks.agg(*[F.sum(F.col("needed")[i]).alias(f"n{i}") for i in range(WIDEST + 2)]).first(), np.int64)
    if counts.sum() and counts[0] > (1 - SETTLED) * counts.sum():
        return min(2 * b, WIDEST, entries)
    place = int(np.searchsorted(np.cumsum(counts[1:]), SETTLED * counts[1:].sum())) + 1
    return min(max(place + 1, NARROWEST), b, entries)


def whole_numbers(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """``(id, label, vec)`` of the usable vectors."""
    usable = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    vec = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = vectors.filter(F.col(vector).isNotNull() & usable)
    return rows.select(F.col(key).alias("id"), F.col(label).alias("label"), vec.alias("vec"))


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 1024, b: int = START) -> DataFrame:
    """Codes of all vectors by codebooks trained on them: ``vec_id, code, error, label_error, codebooks_sha256``.

    Components become ``floor(scale * x)``; a vector that is null or holds null or non-finite components is left out. Codebooks
    start as the parts of the ``entries`` smallest ids (nulls last, then by the vector). Each of ``rounds`` rounds
    assigns every part to the nearest entry (ties to the lower index) and moves entries to the floored means of their parts; unused
    entries stay. The final assignment gives ``code``, two hexadecimal digits a part, ``error``, the
    squared distances summed over the parts, and ``label_error``, the errors summed over rows with an equal label (nulls
    together). Repeated rows and ids, and null ids, are rows like any other. A table's width is its most frequent number
    of components (ties to the smaller) that is a multiple of ``parts``; vectors of another width are returned with null code and error. An empty table gives no rows.
    Components of more than about 2 ** 24 after scaling are refused, as distances would not be exact. Other columns are not read.
    """
    spark = ready(vectors)
    rows = whole_numbers(vectors, key, vector, label, scale)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    width = rows.filter((F.size("vec") > 0) & (F.size("vec") % parts == 0)).groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return finished(rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")), "")
    fitting = F.size("vec") == width["width"]
    seeds = rows.filter(fitting).orderBy(F.col("id").asc_nulls_last(), "vec").limit(min(entries, ENTRIES)).select("vec").collect()
    start = np.array([r["vec"] for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    books, ways, b, store = start, np.zeros(start.shape[:2]), min(b, len(seeds)), Store(spark)
    share = spark.sparkContext.broadcast
    schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, vectors binary, item int, b int, entries binary, bounds binary, unit double, needed array<bigint>"
    blocks = store.put(rows.filter(fitting).mapInArrow(first_lists(share(books), parts, b), schema))
    for number in range(rounds):
        books, ways = moved(blocks, books)
        if number + 1 < rounds:
            blocks = store.put(blocks.mapInArrow(next_lists(share(books), share(ways), parts, b), schema))
            b = adapted(blocks, b, len(seeds))
    out = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    coded = materialize(blocks.mapInArrow(last_codes(share(books), share(ways), parts, b), out), "codes")
    store.drop()
    other = rows.filter(~fitting).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return finished(coded.union(other), hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest())


def finished(coded: DataFrame, digest: str) -> DataFrame:
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
