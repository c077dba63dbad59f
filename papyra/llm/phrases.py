"""Phrase collocations by direct-address tiles of frequency-ranked ids.

1. Texts become blocks of one language with a word list of their own (``blocks``), so a word travels
   once a block and not once an occurrence. Word counts are sums over the blocks' lists.
2. Words that are frequent enough are numbered by falling frequency. A block gets the numbers of its own words.
3. The square of (unit, next word) numbers is cut into tiles of ``TILE`` x ``TILE`` cells. A block deals its
   occurrences, summed up by cell, to buckets of tiles. What arrives for a bucket is added up in a dense array for each tile that
   has many cells in use (``bincount``), and as sorted coordinates (COO) for all others.
4. Frequent pairs are numbered by falling frequency themselves, come back to the blocks that hold them,
   and are the units of the next level: (pair, next word). A frequent phrase has frequent parts, so nothing is missed.

Tiles of the most frequent words may get cells from every block; such tiles are dealt into several parts whose sums are added
afterwards, by a bound that follows from the ranks alone. Scores are exact decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.rows import unnest
from papyra.llm.blocks import binaries, mix, planes, ready, unplanes
from papyra.operators.ordered import row_index
from papyra.session import materialize

LEAST = 10
TOP = 2000
COVERED = 50  # of 100: a longer phrase with such a share of the occurrences takes the shorter one's place
SCALE = 1_000_000
TILE = 256
DENSE = TILE * TILE // 8  # cells in use from which a tile is a dense array
BLOCK_TOKENS = 1 << 19
OPEN_TOKENS = 1 << 21  # in all open blocks of a task
TEXT_BYTES = 1 << 20  # of a text split at once
BUCKET_OCCURRENCES = 1 << 20
PART_CELLS = 1 << 28  # of a tile, dealt to one task
ROW_CELLS = 4096
MERGE_CELLS = 1 << 19
BATCH_BYTES = 16 << 20
UNKNOWN = "und"

#: A-Z to lower case, the piece ends to line feeds, tabs to blanks.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


# -- blocks -------------------------------------------------------------------------------------


class Codes(dict):
    """Numbers words as they come; 0 is the end of a piece and 1 nothing."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def encoded(text: str, codes: Codes) -> list[np.ndarray]:
    """The codes of a text's words and piece ends, as one array per megabyte."""
    data, at, out = text.encode().translate(FOLD), 0, []
    while at < len(data):
        to = at + TEXT_BYTES
        if to < len(data):
            cut = max(data.rfind(b" ", at, to), data.rfind(b"\n", at, to))
            if cut <= at:  # a word of a megabyte
                ends = [x for x in (data.find(b" ", to), data.find(b"\n", to)) if x >= 0]
                cut = min(ends, default=len(data))
            to = cut
        part = data[at:to].replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(codes.__getitem__, part), np.int32, len(part))
        out.append(found[found != 1])
        at = to
    return out


class Block:
    def __init__(self):
        self.codes, self.parts, self.size = Codes(), [], 0

    def add(self, text: str) -> int:
        new = [*encoded(text, self.codes), np.zeros(1, np.int32)]
        self.parts += new
        grown = sum(map(len, new))
        self.size += grown
        return grown

    def row(self, lang: str, number: int) -> pa.RecordBatch:
        tokens = np.concatenate(self.parts)
        counts = np.bincount(tokens, minlength=len(self.codes))[2:]
        words = pa.array(list(self.codes)[2:], pa.binary()).cast(pa.string())
        wrap = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.record_batch({
            "block": pa.array([number], pa.int64()), "lang": pa.array([lang]), "words": wrap(words),
            "counts": wrap(pa.array(counts, pa.int64())), "size": pa.array([int(counts.sum())], pa.int64()), "tokens": binaries([planes(tokens)]),
        })


BLOCKS = "block bigint, lang string, words array<string>, counts array<bigint>, size bigint, tokens binary"


def blocker(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, Block] = {}
        number, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, text = lang.as_py(), text.as_py()
                block = blocks.setdefault(lang, Block())
                held += block.add(text)
                if block.size >= limit or held > OPEN_TOKENS:
                    lang = lang if block.size >= limit else max(blocks, key=lambda x: blocks[x].size)
                    full = blocks.pop(lang)
                    held -= full.size
                    yield full.row(lang, number)
                    number += 1
        for lang, block in blocks.items():
            yield block.row(lang, number)
            number += 1

    return run


# -- numbers of words and pairs -----------------------------------------------------------------


def ranked(counted: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Number the rows of a language from 0 by falling ``n``."""
    rows = materialize(counted.withColumn("_rare", -F.col("n")).withColumn("_tie", F.xxhash64(*keys)), "counted")
    return materialize(row_index(rows, ["lang"], ["_rare", "_tie"], name).drop("_rare", "_tie"), "ranked")


def number_words(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's tokens and the numbers of its frequent words: units and next words (-1: none)."""
    if not len(left):
        return UNITS_ARROW.empty_table()
    tokens = unplanes(left["tokens"][0].as_py(), np.int32)
    of = np.full(int(tokens.max(initial=0)) + 1, -1, np.int64)
    of[right["place"].to_numpy() + 2] = right["id"].to_numpy()
    units = of[tokens]
    return unit_row(left["block"][0].as_py(), left["lang"][0].as_py(), units, np.append(units[1:], -1))


UNITS = "block bigint, lang string, units binary, nexts binary"
UNITS_ARROW = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("units", pa.binary()), ("nexts", pa.binary())])


def unit_row(block: int, lang: str, units: np.ndarray, nexts: np.ndarray) -> pa.Table:
    # a place whose next word counts is followed by that word's own place, so neighbours stay neighbours
    keep = (units >= 0) | (nexts >= 0)
    return pa.table({"block": pa.array([block], pa.int64()), "lang": pa.array([lang]), "units": binaries([shrunk(units[keep])]), "nexts": binaries([shrunk(nexts[keep])])})


def shrunk(numbers: np.ndarray) -> bytes:
    """Numbers from -1 on, byte by byte, without leading bytes that are zero in all of them."""
    data = planes((numbers + 1).astype(np.uint64))
    n, zero = len(numbers), 0
    while n and zero < 7 and data.count(0, (7 - zero) * n, (8 - zero) * n) == n:
        zero += 1
    return bytes([8 - zero]) + data[: (8 - zero) * n]


def grown(data: bytes) -> np.ndarray:
    n = (len(data) - 1) // data[0]
    return unplanes(data[1:] + bytes(n * (8 - data[0])), np.uint64).astype(np.int64) - 1


def number_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's units and its frequent pairs: the pairs as units, and the words after them."""
    if not len(left):
        return UNITS_ARROW.empty_table()
    units, nexts = (grown(left[c][0].as_py()) for c in ("units", "nexts"))
    held = [(*unpacked(t, c), grown(k)) for t, c, k in zip(*(right[c].to_pylist() for c in ("tiles", "cells", "numbers")), strict=True)]
    held.append((np.empty(0, np.uint64), np.empty(0, np.uint16), np.empty(0, np.int64)))
    tile, cell, number = (np.concatenate(x) for x in zip(*held, strict=True))
    some = np.flatnonzero((units >= 0) & (nexts >= 0))
    mine, own = place_of(units[some], nexts[some])
    # find each occurrence among the frequent ones: first by tile, then by cell
    tiles, at = np.unique(tile, return_inverse=True)
    spot = np.searchsorted(tiles, mine)
    known = spot < len(tiles)
    known[known] = tiles[spot[known]] == mine[known]
    some, own, spot = some[known], own[known], spot[known]
    key = (at.astype(np.int64) << 16) | cell
    order = np.argsort(key)
    key, number = key[order], number[order]
    wanted = (spot.astype(np.int64) << 16) | own
    spot = np.searchsorted(key, wanted)
    known = spot < len(key)
    known[known] = key[spot[known]] == wanted[known]
    pairs = np.full(len(units), -1, np.int64)
    pairs[some[known]] = number[spot[known]]
    # the word after a pair counts where it makes a frequent pair with the second word
    after = np.append(np.where(pairs[1:] >= 0, nexts[1:], -1), -1) if len(units) else units
    return unit_row(left["block"][0].as_py(), left["lang"][0].as_py(), np.where(after >= 0, pairs, -1), after)


# -- tiles ---------------------------------------------------------------------------------------------


def place_of(unit: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tile and cell of a pair of numbers."""
    tile = ((unit // TILE).astype(np.uint64) << np.uint64(32)) | (word // TILE).astype(np.uint64)
    return tile, (unit % TILE * TILE + word % TILE).astype(np.uint16)


def numbers_at(tile: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, column = (tile >> np.uint64(32)).astype(np.int64), (tile & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return row * TILE + cell // TILE, column * TILE + cell % TILE


def packed(tile: np.ndarray, cell: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Cells in ascending order of their tiles, in a form that compresses well."""
    return planes(np.diff(tile, prepend=np.uint64(0))), cell.tobytes(), planes(n.astype(np.uint32))


def unpacked(tile: bytes, cell: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unplanes(tile, np.uint64), dtype=np.uint64), np.frombuffer(cell, np.uint16)


def summed(tile: np.ndarray, cell: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted coordinates with their sums."""
    order = np.lexsort((cell, tile))
    tile, cell = tile[order], cell[order]
    new = np.ones(len(tile), bool)
    new[1:] = (tile[1:] != tile[:-1]) | (cell[1:] != cell[:-1])
    at = np.flatnonzero(new)
    total = np.diff(np.append(at, len(tile))) if n is None else np.add.reduceat(n[order], at) if len(at) else n[:0]
    return tile[at], cell[at], total


def parts_of(tile: np.ndarray, blocks: int, occurrences: int, limit: int) -> np.ndarray:
    """Into how many parts a tile is dealt.

    It gets TILE * TILE cells a block at most, and by the ranks a row or column of tiles has at most
    1 / (its number + 1) of all occurrences.
    """
    place = np.maximum(tile >> np.uint64(32), tile & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.ceil(np.minimum(float(blocks) * TILE * TILE, occurrences / (place + 1)) / limit).astype(np.int64)


DEALT = "lang string, bucket bigint, part bigint, block bigint, tiles binary, cells binary, counts binary"


def dealer(buckets: int, blocks: int, occurrences: int, limit: int):
    """Blocks of units to the cells they use, in rows of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block, lang = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                units, nexts = (grown(batch.column(c)[i].as_py()) for c in (2, 3))
                some = (units >= 0) & (nexts >= 0)
                spread = int(mix(np.array([block], np.uint64))[0] >> np.uint64(1))
                tile, cell, n = summed(*place_of(units[some], nexts[some]), None)
                if not len(tile):
                    continue
                bucket = (mix(tile) % np.uint64(buckets)).astype(np.int64)
                part = spread % np.maximum(parts_of(tile, blocks, occurrences, limit), 1)
                order = np.lexsort((part, bucket))
                tile, cell, n, bucket, part = tile[order], cell[order], n[order], bucket[order], part[order]
                edge = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])))
                starts = [s for a, b in zip(edge, np.append(edge[1:], len(tile)), strict=True) for s in range(a, b, ROW_CELLS)]
                ends = [*starts[1:], len(tile)]
                rows = [packed(tile[a:b], cell[a:b], n[a:b]) for a, b in zip(starts, ends, strict=True)]
                tiles, cells, counts = (binaries(list(x)) for x in zip(*rows, strict=True))
                yield pa.record_batch({
                    "lang": pa.array([lang] * len(starts), pa.string()), "bucket": pa.array(bucket[starts], pa.int64()), "part": pa.array(part[starts], pa.int64()),
                    "block": pa.array([block] * len(starts), pa.int64()), "tiles": tiles, "cells": cells, "counts": counts,
                })

    return run


class Tiles:
    """The cells of one bucket so far: dense arrays of crowded tiles, sorted coordinates of the others."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.sparse = (np.empty(0, np.uint64), np.empty(0, np.uint16), np.empty(0, np.int64))
        self.waiting, self.count = [], 0

    def add(self, tile: np.ndarray, cell: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((tile, cell, n.astype(np.int64)))
        self.count += len(tile)
        if self.count >= MERGE_CELLS:
            self.merge()

    def merge(self) -> None:
        tile, cell, n = summed(*[np.concatenate(x) for x in zip(self.sparse, *self.waiting, strict=True)])
        self.waiting, self.count = [], 0
        edge = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(tile) else np.empty(0, np.int64)
        rest = np.ones(len(tile), bool)
        ends = np.append(edge[1:], len(tile))
        crowded = (ends - edge >= DENSE) | np.isin(tile[edge], np.array(list(self.dense), np.uint64))
        for a, b in zip(edge[crowded].tolist(), ends[crowded].tolist(), strict=True):
            added = np.bincount(cell[a:b], n[a:b], TILE * TILE).astype(np.int64)
            self.dense[int(tile[a])] = self.dense.get(int(tile[a]), 0) + added
            rest[a:b] = False
        self.sparse = (tile[rest], cell[rest], n[rest])

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.merge()
        yield self.sparse
        for tile, array in self.dense.items():
            cell = np.flatnonzero(array)
            yield np.full(len(cell), tile, np.uint64), cell.astype(np.uint16), array[cell]


def adder(least: int, blocks: int, occurrences: int, limit: int):
    """Rows sorted by bucket to counts of pairs; those of tiles in one part only if frequent enough (``whole``)."""

    def counted(key: tuple, tiles: Tiles) -> Iterator[pa.RecordBatch]:
        for tile, cell, n in tiles.cells():
            whole = parts_of(tile, blocks, occurrences, limit) <= 1
            keep = ~whole | (n >= least)
            tile, cell, n, whole = tile[keep], cell[keep], n[keep], whole[keep]
            unit, word = numbers_at(tile, cell.astype(np.int64))
            for a in range(0, len(n), 1 << 16):
                s = slice(a, a + (1 << 16))
                size = len(n[s])
                yield pa.record_batch({
                    "lang": pa.array([key[0]] * size, pa.string()), "bucket": pa.array([key[1]] * size, pa.int64()),
                    "unit": pa.array(unit[s], pa.int64()), "word": pa.array(word[s], pa.int64()), "n": pa.array(n[s], pa.int64()), "whole": pa.array(whole[s]),
                })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tiles = None, None
        for batch in batches:
            langs, buckets, parts = (batch.column(c).to_pylist() for c in range(3))
            for i, now in enumerate(zip(langs, buckets, parts, strict=True)):
                if now != key:
                    if key is not None:
                        yield from counted(key, tiles)
                    key, tiles = now, Tiles()
                tile, cell, n = (batch.column(c)[i].as_py() for c in (3, 4, 5))
                tiles.add(*unpacked(tile, cell), unplanes(n, np.uint32))
        if key is not None:
            yield from counted(key, tiles)

    return run


def replies(left: pa.Table, right: pa.Table) -> pa.Table:
    """Dealt rows of a bucket and its frequent pairs: to each row's block, the frequent pairs it holds, with their numbers."""
    tile, cell = place_of(right["unit"].to_numpy(), right["word"].to_numpy())
    tiles, at = np.unique(tile, return_inverse=True)
    key = (at.astype(np.int64) << 16) | cell
    order = np.argsort(key)
    key, numbers = key[order], right["id"].to_numpy()[order]
    out = []
    for i in range(len(left)):
        tile, cell = unpacked(left["tiles"][i].as_py(), left["cells"][i].as_py())
        spot = np.searchsorted(tiles, tile)
        known = np.flatnonzero(spot < len(tiles))
        known = known[tiles[spot[known]] == tile[known]]
        wanted = (spot[known].astype(np.int64) << 16) | cell[known]
        found = np.searchsorted(key, wanted)
        hit = found < len(key)
        hit[hit] = key[found[hit]] == wanted[hit]
        if hit.any():
            out.append((left["block"][i].as_py(), planes(np.diff(tile[known[hit]], prepend=np.uint64(0))), cell[known[hit]].tobytes(), shrunk(numbers[found[hit]])))
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.table({"block": pa.array(columns[0], pa.int64()), "tiles": binaries(columns[1]), "cells": binaries(columns[2]), "numbers": binaries(columns[3])})


def frequent_pairs(units: DataFrame, blocks: int, occurrences: int, least: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """What the blocks of units deal out, and ``(lang, bucket, unit, word, n)`` of the frequent pairs of a unit and the next word."""
    buckets = occurrences // BUCKET_OCCURRENCES + 1
    dealt = materialize(units.mapInArrow(dealer(buckets, blocks, occurrences, limit), DEALT), "tiles")
    keys = ["lang", "bucket", "part"]
    rows = dealt.select(*keys, "tiles", "cells", "counts").repartition(*keys).sortWithinPartitions(*keys)
    counted = rows.mapInArrow(adder(least, blocks, occurrences, limit), "lang string, bucket bigint, unit bigint, word bigint, n bigint, whole boolean")
    counted = materialize(counted, "cells")
    of_parts = counted.filter(~F.col("whole")).groupBy("lang", "bucket", "unit", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return dealt, counted.filter("whole").drop("whole").unionByName(of_parts)


# -- the whole -----------------------------------------------------------------------------------------


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, covered: int = COVERED, block_tokens: int = BLOCK_TOKENS, part_cells: int = PART_CELLS) -> DataFrame:
    """The ``top`` phrases of two or three words of every language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are split into pieces at ``.,;:!?`` and the controls 10 to 13, pieces into words at blanks and tabs; only A-Z become lower
    case. ``a`` counts a phrase's contiguous occurrences inside pieces (overlaps included), at least ``least``; ``n`` all words. Of a phrase's cuts into two parts with
    ``l`` and ``r`` occurrences the one with the lowest ``floor(10**6 * a * a / (l * r))`` counts, ties to the
    shorter first part. A phrase inside a longer one with at least ``covered`` percent of its occurrences is left out. Order: score and
    ``a`` falling, then the phrase by its bytes. A null language is ``und``; null and empty texts have no words; repeated rows count each time. Tables without
    a frequent phrase give no rows. Other columns are not read. ``block_tokens`` and ``part_cells`` change the sharing of the work only.
    """
    spark = ready(docs)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    texts = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = materialize(texts.mapInArrow(blocker(block_tokens), BLOCKS), "blocks")
    sizes = materialize(blocks.groupBy("lang").agg(F.sum("size").alias("all")), "sizes")
    many, occurrences = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()

    own = unnest(blocks.select("block", "lang", "words", "counts"), ["block", "lang"], F.arrays_zip("words", "counts"), "item", "place")
    own = own.select("block", "lang", "place", F.col("item.words").alias("word"), F.col("item.counts").alias("n"))
    counted = own.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    words = ranked(counted, "id", ["word"])
    places = own.select("block", "lang", "word", "place").join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "place", "id")
    # new names of their own, as the two sides come from one table
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    by_block = lambda df: fresh(df).groupBy("block")
    tokens = blocks.select("block", "lang", "tokens")
    units = materialize(by_block(tokens).cogroup(by_block(places)).applyInArrow(number_words, UNITS), "units")

    dealt, pairs = frequent_pairs(units, many, occurrences, least, part_cells)
    pairs = ranked(pairs, "id", ["unit", "word"])
    keys = ["lang", "bucket", "part"]
    asked = pairs.select("lang", "bucket", "unit", "word", "id").join(dealt.select(*keys).distinct(), ["lang", "bucket"])
    answer = dealt.select(*keys, "block", "tiles", "cells").groupBy(*keys).cogroup(fresh(asked).groupBy(*keys))
    answer = materialize(answer.applyInArrow(replies, "block bigint, tiles binary, cells binary, numbers binary"), "replies")
    longer = materialize(by_block(units).cogroup(by_block(answer)).applyInArrow(number_pairs, UNITS), "longer")
    _, triples = frequent_pairs(longer, many, occurrences, least, part_cells)
    triples = materialize(triples.select("lang", F.col("unit").alias("pair"), "word", "n"), "triples")
    return best(words, pairs, triples, sizes, top, covered)


def best(words: DataFrame, pairs: DataFrame, triples: DataFrame, sizes: DataFrame, top: int, covered: int) -> DataFrame:
    """Scores, coverage and ranks from the counts of words, pairs and triples."""
    word = lambda name: words.select("lang", F.col("id").alias(name), F.col("word").alias(f"{name}_text"), F.col("n").alias(f"{name}_n"))
    twos = pairs.select("lang", F.col("id").alias("pair"), F.col("unit").alias("w1"), F.col("word").alias("w2"), F.col("n").alias("pair_n"))
    named = twos.join(word("w1"), ["lang", "w1"]).join(word("w2"), ["lang", "w2"])
    named = materialize(named, "named")
    second = named.select("lang", F.col("pair").alias("next"), F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("pair_n").alias("next_n"), F.col("w2_text").alias("w3_text"), F.col("w2_n").alias("w3_n"))
    threes = triples.withColumnRenamed("word", "w3").join(named, ["lang", "pair"]).join(second, ["lang", "w2", "w3"])
    threes = materialize(threes, "threes")
    holders = threes.select("lang", "pair", "n").union(threes.select("lang", "next", "n"))
    holders = holders.groupBy("lang", "pair").agg(F.max("n").alias("longer"))

    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = lambda a, l, r: F.expr(f"({wide(a)} * {wide(a)} * {SCALE}) div ({wide(l)} * {wide(r)})")  # noqa: E731, E741
    of_two = named.join(holders, ["lang", "pair"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("pair_n") * covered))
    of_two = of_two.select("lang", F.concat_ws(" ", "w1_text", "w2_text").alias("phrase"), F.col("pair_n").alias("a"), F.col("w1_n").alias("l"), F.col("w2_n").alias("r"))
    of_two = of_two.withColumn("score", score("a", "l", "r"))
    cut = lambda k, l, r: F.struct(score("n", l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E731, E741
    of_three = threes.withColumn("cut", F.least(cut(1, "w1_n", "next_n"), cut(2, "pair_n", "w3_n")))
    of_three = of_three.select("lang", F.concat_ws(" ", "w1_text", "w2_text", "w3_text").alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    shown = of_two.unionByName(of_three).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return shown.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all").alias("n"), "score")
