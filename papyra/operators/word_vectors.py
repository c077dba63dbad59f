"""Skip-gram word vectors whose vocabulary stays a table: no driver and no task holds it whole.

Texts go into blocks of bounded size with a word list of their own. A block learns on a copy of the
vectors of its words, and then a word's vectors are averaged over the blocks that hold it, as `pyspark.ml` does
over its partitions. A word starts from numbers made of its hash, so the first round moves no vectors at all. Words that don't
belong are drawn from the block's own words (negative sampling), so no tree over the vocabulary is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.rows import unnest_structs
from papyra.session import materialize, ship_package

BLOCK_WORDS = 1 << 19
BLOCK_NUMBERS = 1 << 24  # words of a block times numbers of a vector, at most
STEP = 512  # words that learn at a time
NEGATIVE = 5  # words that don't belong, for each that does
DRAWN = 64  # words drawn for a step, shared by its words
RATE, LAST_RATE = 0.025, 1e-4
LONGEST = 0.25  # the longest way that a vector may go in a step
BLOCKS = "block bigint, names array<struct<place:int,word:string,n:bigint>>, places binary, sizes binary"


def _block(values: list[pa.Array], sizes: list[np.ndarray], number: int) -> pa.RecordBatch:
    coded = pa.concat_arrays(values).dictionary_encode()
    places = coded.indices.to_numpy().astype(np.int32)
    known = len(coded.dictionary)
    names = pa.StructArray.from_arrays(
        [pa.array(np.arange(known, dtype=np.int32)), coded.dictionary.cast(pa.string()), pa.array(np.bincount(places, minlength=known).astype(np.int64))], ["place", "word", "n"]
    )
    return pa.record_batch({
        "block": pa.array([number], pa.int64()), "names": pa.ListArray.from_arrays(pa.array([0, known], pa.int32()), names),
        "places": pa.array([places.tobytes()], pa.binary()), "sizes": pa.array([np.concatenate(sizes).astype(np.int32).tobytes()], pa.binary()),
    })


def _blocks(words: int):
    """Rows of words to blocks of ``words`` words; a text that doesn't fit goes on in the next block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, room = TaskContext.get().partitionId() << 32, words
        values, sizes = [], []
        for batch in batches:
            lists = batch.column(0)
            edges, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            at = 0
            while at < len(flat):
                stop = min(at + room, len(flat))
                lengths = np.diff(np.clip(edges, at, stop))
                values.append(flat.slice(at, stop - at)), sizes.append(lengths[lengths > 0])
                room, at = room - (stop - at), stop
                if not room:
                    yield _block(values, sizes, number)
                    number, room, values, sizes = number + 1, words, [], []
        if values:
            yield _block(values, sizes, number)

    return run


def first_vectors(seeds: np.ndarray, size: int) -> np.ndarray:
    """Numbers between -0.5 and 0.5 over ``size``, made of a word's hash alone."""
    x = seeds.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (((x >> np.uint64(40)).astype(np.float32) / (1 << 24)) - 0.5) / size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _move(vectors: np.ndarray, at: np.ndarray, moves: np.ndarray) -> None:
    """Add up the moves of each place, none longer than ``LONGEST``."""
    order = np.argsort(at, kind="stable")
    there = at[order]
    first = np.flatnonzero(np.r_[True, there[1:] != there[:-1]])
    total = np.add.reduceat(moves[order], first)
    length = np.sqrt(np.einsum("ij,ij->i", total, total))
    vectors[there[first]] += total * np.minimum(1, LONGEST / np.maximum(length, 1e-12))[:, None]


def learn(words: np.ndarray, text: np.ndarray, inner: np.ndarray, outer: np.ndarray, window: int, rates: tuple[float, float], seed: int) -> None:
    """One pass over the words of a block, as numbers, with the text that each belongs to; changes both vectors in place.

    Every two neighbours meet once in each direction that the width drawn for the centre word allows.
    """
    random = np.random.default_rng(seed)
    share = np.bincount(words, minlength=len(inner)) ** 0.75
    share = np.cumsum(share) / share.sum()
    reach = random.integers(1, window + 1, len(words))
    for start in range(0, len(words), STEP):
        rate = rates[0] + (rates[1] - rates[0]) * start / len(words)
        low, stop = max(start - window, 0), min(start + STEP, len(words))
        own, texts, wide = words[low:stop], text[low:stop], reach[low:stop]
        fresh = np.arange(low, stop) >= start  # the later one of two neighbours is new in this step
        v, u = inner[own], outer[own]
        dv, du, met = np.zeros_like(v), np.zeros_like(u), np.zeros(len(own), np.float32)
        for far in range(1, min(window, len(own) - 1) + 1):
            a, b = slice(0, len(own) - far), slice(far, len(own))
            near = (texts[a] == texts[b]) & fresh[b]
            for centre, other in ((a, b), (b, a)):
                meets = near & (wide[centre] >= far)
                pull = (meets * _sigmoid(-np.einsum("ij,ij->i", v[centre], u[other])))[:, None]
                dv[centre] += pull * u[other]
                du[other] += pull * v[centre]
                met[centre] += meets
        drawn = np.minimum(np.searchsorted(share, random.random(DRAWN), "right"), len(inner) - 1)
        strange = outer[drawn]
        push = -_sigmoid(v @ strange.T) * (met * (NEGATIVE / DRAWN))[:, None]
        dv += push @ strange
        _move(inner, own, rate * dv)
        _move(outer, np.concatenate([own, drawn]), rate * np.concatenate([du, push.T @ v]))


def _learnt(size: int, window: int, rates: tuple[float, float], seed: int):
    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        of = lambda name: np.frombuffer(block[name][0].as_buffer(), np.int32)
        spots, places, sizes = asked["place"].to_numpy(), of("places"), of("sizes")
        number = np.full(int(places.max()) + 1, -1, np.int64)
        number[spots] = np.arange(len(spots))
        words, text = number[places], np.repeat(np.arange(len(sizes)), sizes)
        words, text = words[words >= 0], text[words >= 0]
        flat = lambda name: asked[name].combine_chunks().flatten().to_numpy().astype(np.float32).reshape(-1, size)
        if "inner" in asked.column_names:
            inner, outer = flat("inner").copy(), flat("outer").copy()
        else:
            inner = first_vectors(asked["seed"].to_numpy(), size)
            outer = np.zeros_like(inner)
        learn(words, text, inner, outer, window, rates, seed + int(block["block"][0].as_py()) % (1 << 62))
        listed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), size).cast(pa.list_(pa.float32()))
        return pa.table({"word": asked["word"], "inner": listed(inner), "outer": listed(outer)})

    return run


def fit(texts: DataFrame, words: str, size: int = 100, window: int = 5, min_count: int = 3, iterations: int = 1, seed: int = 1) -> DataFrame:
    """``(word, vector)`` of every word that occurs ``min_count`` times and more in the arrays ``words``."""
    spark = texts.sparkSession
    ship_package(spark)
    cut = texts.select(F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w.isNotNull()).alias("words"))
    blocks = materialize(cut.mapInArrow(_blocks(max(min(BLOCK_WORDS, BLOCK_NUMBERS // size), 1)), BLOCKS), "blocks")
    parts = max(2 * blocks.count(), 1)  # few blocks share a task
    own = unnest_structs(blocks.select("block", "names"), ["block"], "names")
    known = own.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count).select("word")
    # rows out of arrays are many more than the optimizer expects
    asked = own.hint("merge").join(known, "word").select("block", "place", "word")
    asked = materialize(asked, "asked") if iterations > 1 else asked
    vectors = None
    for i in range(iterations):
        rates = tuple(max(RATE * (1 - done / iterations), LAST_RATE) for done in (i, i + 1))
        rows = asked.withColumn("seed", F.xxhash64("word")) if vectors is None else asked.hint("merge").join(vectors, "word")
        # columns of their own, as both sides come from the blocks
        sides = [df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(parts, "block").groupBy("block") for df in (blocks.drop("names"), rows)]
        moved = sides[0].cogroup(sides[1]).applyInArrow(_learnt(size, window, rates, seed + i), "word string, inner array<float>, outer array<float>")
        kept = ["inner"] if i == iterations - 1 else ["inner", "outer"]
        means = moved.groupBy("word").agg(*[F.avg(F.col(c)[k]).alias(f"{c}{k}") for c in kept for k in range(size)])
        vectors = materialize(means.select("word", *[F.array(*[F.col(f"{c}{k}") for k in range(size)]).alias(c) for c in kept]), "vectors")
    return vectors.select("word", F.col("inner").alias("vector"))


def closest(vectors: DataFrame, word: str, n: int = 10) -> DataFrame:
    """``(word, similarity)`` of the ``n`` words of the largest cosine with a word's vector; none for an unknown word."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    other = vectors.filter(F.col("word") == word).select("vector").scalar()
    rows = vectors.filter(F.col("word") != word).withColumn("_other", other)
    norms = F.sqrt(dot(F.col("vector"), F.col("vector")) * dot(F.col("_other"), F.col("_other")))
    cosine = F.when(norms > 0, dot(F.col("vector"), F.col("_other")) / norms).otherwise(0.0)
    return rows.filter(F.col("_other").isNotNull()).select("word", cosine.alias("similarity")).orderBy(F.desc("similarity"), "word").limit(n)
