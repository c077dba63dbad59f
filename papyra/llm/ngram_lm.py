"""An n-gram language model in an Elias-Fano trie, built and queried by Spark tasks.

Level 1 is the vocabulary: the 64-bit hashes of all training words, cut into ranges ("shards"), each an
Elias-Fano sequence with the exact counts beside it; a word's number is its place. Level k has
the n-grams of k words. A context is the number of a node of level k - 1; a shard of a level holds

* its contexts, an Elias-Fano sequence,
* monotone pointers to where the successors of each context begin, another one,
* the successors, a third one: each list is made to ascend from the last value of the list before,
  so a successor is searched relative to its context,
* per successor a smoothed probability and a count, each quantised to 8 bits on a log scale.

With c the count of an n-gram and C that of its context, ``p(w | context) = c / (C + MU) + MU / (C + MU) *
p(w | shorter context)``, down to add-one unigrams. Shards are files in the shared folder, which
tasks map into memory; which shard holds an n-gram follows from a hash of context and word, so
frequent contexts are spread. Tasks add up n-grams before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm import elias_fano as ef
from papyra.llm.blocks import binaries, mix, planes, ready, shards, shared_folder, slices, unplanes, utf8, word_hashes
from papyra.session import materialize

ORDER = 3
MU = 4.0
END = np.uint64(0xE3779B97F4A7C159)
SLICE = 1 << 22
WAITING = 1_500_000  # n-grams, repeats included, that wait in a task
COUNT_STEP = 0.04  # of a quantised natural logarithm of a count
LEAST_LOG = -20.4  # of a quantised natural logarithm of a probability; 255 steps lead up to 0
PROBABILITY = np.exp(LEAST_LOG * (1 - np.arange(256) / 255.0))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some rows with an end after each row, and row offsets."""
    words, edge = word_hashes(data, offsets)
    rows = len(edge) - 1
    edge = edge + np.arange(rows + 1)
    out = np.empty(edge[-1], np.uint64)
    inside = np.ones(len(out), bool)
    inside[edge[1:] - 1] = False
    out[inside], out[~inside] = words, END
    return out, edge


def shard_of(h: np.ndarray, count: int) -> np.ndarray:
    """Ranges of the leading 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def pair_order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The order of pairs of numbers, by one key where it fits into 64 bits."""
    width = int(second.max(initial=0)).bit_length()
    if width + int(first.max(initial=0)).bit_length() > 64:
        return np.lexsort((second, first))
    key = first.astype(np.uint64)  # a copy
    key <<= np.uint64(width)
    key |= second.view(np.uint64)
    return np.argsort(key)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an ascending array, and for each place the number of its value."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new], np.cumsum(new) - 1


def summed(first: np.ndarray, second: np.ndarray | None, count: np.ndarray):
    """Equal keys (one or two columns) added up, in ascending order."""
    order = np.argsort(first, kind="stable") if second is None else pair_order(first, second)
    first, count = first[order], count[order]
    second = None if second is None else second[order]
    new = np.ones(len(first), bool)
    new[1:] = first[1:] != first[:-1]
    if second is not None:
        new[1:] |= second[1:] != second[:-1]
    at = np.flatnonzero(new)
    return first[at], None if second is None else second[at], np.add.reduceat(count, at) if len(at) else count


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.append(np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]))
    return keys[at], np.diff(np.append(at, len(keys))).astype(np.uint64)


def dealt(where: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their shard, and where each of ``count`` shards begins among them, with an end."""
    small = where.astype(np.uint16) if count <= 1 << 16 else where  # numpy sorts short numbers by radix
    return np.argsort(small, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(where, minlength=count))])


def narrow(a: np.ndarray) -> bytes:
    """Numbers as planes of no more bytes than the largest one needs, behind their size."""
    top = int(a.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + planes(a.astype(kind))


def widened(data: bytes) -> np.ndarray:
    return unplanes(data[1:], f"u{data[0]}").astype(np.uint64)


COUNTED = "shard int, first binary, second binary, counts binary"


def blocks_of(first, second, count, where, shards: int) -> pa.RecordBatch:
    """Sorted keys and counts as one row for each shard."""
    order, edge = dealt(where, shards)
    first, count = first[order], count[order]
    second = np.empty(0, np.uint64) if second is None else second[order]
    rows = []
    for s in np.flatnonzero(np.diff(edge)).tolist():
        a, b = edge[s : s + 2]
        rows.append((s, narrow(np.diff(first[a:b], prepend=np.uint64(0))), narrow(second[a:b]), narrow(count[a:b])))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.record_batch([pa.array(columns[0], pa.int32()), *(binaries(list(c)) for c in columns[1:])], names=["shard", "first", "second", "counts"])


def joined(table: pa.Table):
    """All keys and counts of a shard, added up."""
    first = np.concatenate([np.cumsum(widened(x.as_py()), dtype=np.uint64) for x in table["first"]])
    second = np.concatenate([widened(x.as_py()) for x in table["second"]])
    count = np.concatenate([widened(x.as_py()) for x in table["counts"]])
    return summed(first, second if len(second) else None, count)


def counter(levels, count: int):
    """Adds up the n-grams of the next level over one task; the words themselves if there is no level yet.

    An n-gram of a node and a word is one number where both fit into 64 bits, which sorts without an order beside it.
    """
    width = 0 if levels is None else levels.words.bit_length()
    whole = levels is None or width + int(levels.bases[levels.order][-1]).bit_length() <= 64

    def keys_of(words: np.ndarray, edge: np.ndarray) -> tuple:
        if levels is None:
            return words, None
        node, word = levels.contexts(words, edge)
        if whole:
            node <<= np.uint64(width)
            node |= word
            return node, None
        return node, word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, known, size = [], None, 0

        def added() -> tuple:
            first, second = (None if c[0] is None else np.concatenate(c) for c in zip(*waiting, strict=True))
            if whole:
                first, n = tallied(first)
            else:
                first, second, n = summed(first, second, np.ones(len(first), np.uint64))
            if known is None:
                return first, second, n
            both = zip(known, (first, second, n), strict=True)
            return summed(*(None if a is None else np.concatenate([a, b]) for a, b in both))

        def block(first, second, n) -> pa.RecordBatch:
            if whole and width:
                first, second = first >> np.uint64(width), first & np.uint64((1 << width) - 1)
            return blocks_of(first, second, n, place(first, second, count), count)

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in slices(offsets, SLICE, 1 << 20):
                waiting.append(keys_of(*tokens(data, offsets[lo : hi + 1])))
                size += len(waiting[-1][0])
                if size > WAITING:
                    known, waiting = added(), []
                    size = len(known[0])
                    if size > WAITING // 2:  # hardly anything repeats: hand it on
                        yield block(*known)
                        known, size = None, 0
        if waiting:
            known = added()
        if known is not None and len(known[0]):
            yield block(*known)

    return run


def place(first: np.ndarray, second: np.ndarray | None, count: int) -> np.ndarray:
    return shard_of(first if second is None else spread(first, second), count)


def spread(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


MADE = "shard int, nodes long, tokens long"


def made(table: pa.Table, nodes: int, total: int) -> pa.Table:
    return pa.table({"shard": table["shard"][:1], "nodes": pa.array([nodes], pa.int64()), "tokens": pa.array([total], pa.int64())})


def write_words(folder: str, count: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        words, _, n = joined(table)
        base = (shard << 32) // count << 32  # no word of this shard is below
        ef.save(f"{folder}/1-{shard:06d}", {"counts": n, **ef.named(ef.build(words - np.uint64(base), (1 << 64) - base if shard == count - 1 else ((shard + 1 << 32) // count + 1 << 32) - base), "words.")})
        return made(table, len(words), int(n.sum()))

    return run


def write_level(levels, folder: str, order: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        node, word, n = joined(table)
        context, start = np.unique(node, return_index=True)
        size = np.diff(np.append(start, len(node)))
        # each list ascends from the last value of the list before
        last = word[np.append(start[1:], len(word)) - 1] + np.uint64(1)
        base = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.uint64)
        values = np.repeat(base, size) + word + np.uint64(1)
        whole = np.repeat(levels.counts(context, order - 1), size)
        log = np.log(n / (whole + MU))
        probability = np.clip(np.rint((log - LEAST_LOG) / -LEAST_LOG * 255), 0, 255).astype(np.uint8)
        counts = np.clip(np.rint(np.log(n) / COUNT_STEP), 0, 65535).astype(np.uint16)
        ef.save(f"{folder}/{order}-{shard:06d}", {
            "probability": probability, "counts": counts,
            **ef.named(ef.build(context, int(context[-1]) + 1), "contexts."),
            **ef.named(ef.build(np.append(start, len(node)), len(node) + 1), "pointers."),
            **ef.named(ef.build(values, int(values[-1]) + 1), "successors."),
        })
        return made(table, len(node), int(n.sum()))

    return run


class Levels:
    """The levels built so far, by folder and by the number of the first node of each shard.

    Tasks open the files at their first use, mapped into memory.
    """

    def __init__(self, folder: str, count: int):
        self.folder, self.count, self.bases, self.total, self.order = folder, count, {}, 0, 0

    def add(self, rows: list) -> None:
        """``rows`` of ``MADE``, one for each shard that has nodes."""
        sizes = {r["shard"]: r["nodes"] for r in rows}
        self.order += 1
        self.bases[self.order] = np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(self.count)])]).astype(np.int64)
        if self.order == 1:
            self.total = sum(r["tokens"] for r in rows)

    @property
    def words(self) -> int:
        return int(self.bases[1][-1])

    def shard(self, order: int, shard: int) -> tuple[dict[str, np.ndarray], dict[str, ef.EliasFano]]:
        return ef.cached_open(f"{self.folder}/{order}-{shard:06d}")

    def by_shard(self, order: int, where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order_of, edge = dealt(where, self.count)
        for s in np.flatnonzero(np.diff(edge)).tolist():
            if self.bases[order][s + 1] > self.bases[order][s]:
                yield s, order_of[edge[s] : edge[s + 1]]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers of distinct words in the vocabulary, -1 for unknown ones."""
        out = np.full(len(words), -1, np.int64)
        for s, at in self.by_shard(1, shard_of(words, self.count)):
            found = self.shard(1, s)[1]["words"].find(words[at] - np.uint64((s << 32) // self.count << 32))
            out[at] = np.where(found >= 0, found + self.bases[1][s], -1)
        return out

    def counts(self, nodes: np.ndarray, order: int) -> np.ndarray:
        """Counts of some nodes of a level: exact for words, quantised above."""
        out = np.zeros(len(nodes))
        nodes = nodes.astype(np.int64)
        for s, at in self.by_shard(order, np.searchsorted(self.bases[order], nodes, "right") - 1):
            own = self.shard(order, s)[0]["counts"][nodes[at] - self.bases[order][s]]
            out[at] = own if order == 1 else np.exp(own * COUNT_STEP)
        return out

    def nodes(self, order: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers of (context, word) in a level, -1 if absent, and their quantised probabilities; contexts ascend."""
        out, p = np.full(len(context), -1, np.int64), np.zeros(len(context))
        context, word = context.astype(np.uint64), word.astype(np.uint64)
        for s, at in self.by_shard(order, shard_of(spread(context, word), self.count)):
            arrays, sequences = self.shard(order, s)
            pointers, successors = sequences["pointers"], sequences["successors"]
            own, back = runs(context[at])
            place = sequences["contexts"].find(own)
            seen = place[back] >= 0
            at, back = at[seen], back[seen]
            if not len(at):
                continue
            known = np.maximum(place, 0)
            lo, hi = (x.astype(np.int64) for x in pointers.ranges(known))
            base = np.where(lo > 0, successors.access(np.maximum(lo - 1, 0)), np.uint64(0))
            found = successors.find(base[back] + word[at] + np.uint64(1))
            good = (found >= 0) & (found < hi[back])
            out[at[good]] = found[good] + self.bases[order][s]
            p[at[good]] = PROBABILITY[arrays["probability"][found[good]]]
        return out, p

    def contexts(self, words: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, word) of every n-gram one word longer than the last level, in training rows."""
        own, back = np.unique(words, return_inverse=True)
        number = self.numbers(own)[back]
        node = number.copy()
        row = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        for k in range(2, self.order + 1):
            node = self.longer(k, node, number, row)[0]
        ok = np.flatnonzero((node[:-1] >= 0) & (row[1:] == row[:-1]))
        return node[ok].astype(np.uint64), number[ok + 1].astype(np.uint64)

    def longer(self, order: int, node: np.ndarray, number: np.ndarray, row: np.ndarray, smooth: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From the nodes that end at each token to those of one word more, where they exist.

        Also, for the places that have a context: which they are, the probabilities there, and if ``smooth``
        is set the weight of the shorter context.
        """
        out, before = np.full(len(node), -1, np.int64), np.full(len(node), -1, np.int64)
        same = row[1:] == row[:-1]
        before[1:] = np.where(same, node[:-1], -1)
        at = np.flatnonzero(before >= 0)
        if not len(at):
            return out, at, np.zeros(0), np.zeros(0)
        # equal n-grams are looked up once; an unknown word is 0 here
        order_of = pair_order(before[at], number[at] + 1)
        a, b = before[at][order_of], number[at][order_of]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        back = np.empty(len(a), np.int64)
        back[order_of] = np.cumsum(new) - 1
        a, b = a[new], b[new]
        known = np.flatnonzero(b >= 0)
        found, p = np.full(len(a), -1, np.int64), np.zeros(len(a))
        found[known], p[known] = self.nodes(order, a[known], b[known])
        out[at] = found[back]
        if not smooth:
            return out, at, p, p
        context, where = runs(a)
        rest = MU / (self.counts(context, order - 1) + MU)
        return out, at, p[back], rest[where][back]

    def scores(self, words: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its training count, the base's and the model's log10 probability."""
        own, back = np.unique(words, return_inverse=True)
        number = self.numbers(own)
        count = np.zeros(len(own))
        known = number >= 0
        count[known] = self.counts(number[known], 1)
        unigram = (count + 1) / (self.total + self.words + 1)
        count, p, number = count[back], unigram[back], number[back]
        base = np.log10(p)
        node, row = number, np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        for k in range(2, self.order + 1):
            node, at, q, rest = self.longer(k, node, number, row, True)
            p[at] = q + rest * p[at]
        return count, base, np.log10(np.minimum(p, 1.0))


def train(docs: DataFrame, text: str = "text", order: int = ORDER, folder: str | None = None) -> Levels:
    """Build the trie of all rows of ``docs``; returns where its levels are.

    Null and empty texts consist of an end. An empty table makes an empty model.
    """
    spark = ready(docs)
    folder, count = folder or shared_folder(spark, "ngrams"), shards(spark)
    levels = Levels(folder, count)
    texts = docs.select(F.col(text))
    for k in range(1, order + 1):
        counted = texts.mapInArrow(counter(levels if k > 1 else None, count), COUNTED)
        write = write_words(folder, count) if k == 1 else write_level(levels, folder, k)
        rows = materialize(counted.groupBy("shard").applyInArrow(write, MADE), f"level{k}").collect()  # one row a shard
        levels.add(rows)
    return levels


def scorer(levels: Levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets, SLICE, 1 << 20):
                words, edge = tokens(data, offsets[lo : hi + 1])
                count, base, model = levels.scores(words, edge)
                sums = partial(np.add.reduceat, indices=edge[:-1])
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(lo, hi - lo), "n_tokens": pa.array(np.diff(edge), pa.int64()),
                    "n_known": pa.array(sums((count > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(hi - lo, levels.total), pa.int64()),
                    "base_score": pa.array(sums(base), pa.float64()), "score": pa.array(sums(model), pa.float64()),
                })

    return run


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Train on the rows for which ``learn`` holds and score all: ``doc_id, n_tokens, n_known, train_tokens,
    base_score, score``.

    Words are runs without blanks, with A-Z in lower case; every text ends with an end token. Null
    texts count as empty: their one token is the end. Without training rows the counts are 0 and
    both scores those of a vocabulary of nothing, 0 for every token. Repeated rows are learnt and
    scored one by one. Other columns are not read.
    """
    ready(docs)
    levels = train(docs.filter(learn).select(F.col(text).alias("text")), "text", order)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scorer(levels), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> float:
    """Of all tokens of a scored table; not a number if it has none."""
    total, n = scored.agg(F.sum("score"), F.sum("n_tokens")).first()
    return 10 ** (-total / n) if n else math.nan
