"""Flat token-id files with 64-bit document offsets, written and read by Spark tasks.

A part of the corpus, in ascending order of the document id, becomes three files:

* ``<part>.ids``: the token ids of all its documents, unsigned and little-endian, 16 bits wide if
  the vocabulary allows and else 32;
* ``<part>.offsets``: n + 1 unsigned 64-bit offsets, counted in tokens from the start of the part;
* ``<part>.docs``: n signed 64-bit document ids; a missing id is the smallest value.

The manifest has one row per part; the base of a part in the whole corpus is the prefix sum of the
tokens of the parts before it. Readers map the files into memory.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.blocks import map_file, ready, shards, shared_folder, write_file
from papyra.session import materialize, shared_dir

NO_ID = np.iinfo(np.int64).min
CACHE = 300_000
CACHED_CHARS = 40
FLUSH = 1 << 22


class WordIds(dict):
    """Ids of stretches without blanks, made by the tokenizer when first asked for.

    Stretches of Latin letters and signs are split by the tokenizer's own pattern here, and its
    model gets the pieces without another pass through normalizer and splitter; everything
    else goes through the whole tokenizer. Entries live in two generations: when the young one is
    full it becomes the old one, so frequent stretches stay and memory is bounded.
    """

    def __init__(self, tokenizer, width: str):
        super().__init__({"": b""})
        self.tokenizer, self.tokens, self.code, self.old = tokenizer, tokenizer.model.tokenize, {"u2": "H", "u4": "I"}[width], {}
        made = json.loads(tokenizer.to_str())
        # in any case of letters, so that lower case never makes a token that the text does not hold;
        # every text may hold a token that is looked for after normalizing
        added = ["" if t["normalized"] else re.escape(t["content"]) for t in made["added_tokens"]]
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE).search
        parts = made["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split")).findall
        printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = [b for b in range(256) if b not in printed]
        # byte-level vocabularies write bytes that cannot be printed as characters from 256 on
        self.letters = {b: 256 + i for i, b in enumerate(rest)}
        trial = ["ab", "ça1.", "x,", "ab###", "ñandú.", "a_b"]
        if any(self.by_parts(w) != self.slow(w) for w in trial) or self.slow("Çb") != self.slow("çb"):
            raise ValueError("this tokenizer's pieces depend on more than its splitter")

    def slow(self, word: str) -> bytes:
        return array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def by_parts(self, word: str) -> bytes:
        parts = self.split(word)
        if len(parts) != 1:
            return b"".join([self[p] for p in parts])
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokens(word)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isascii() and word.isalpha() and word.islower():
                ids = array(self.code, [t.id for t in self.tokens(word)]).tobytes()
            elif SPECIAL(word) or word != word.lower():
                ids = self.slow(word)
            else:
                ids = self.by_parts(word)
        if len(word) <= CACHED_CHARS:
            if len(self) > CACHE:
                self.old = dict(self)
                self.clear()
                self[""] = b""
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text. Nothing is ever joined across a blank, so they are those of its stretches.

        A text that holds an added token goes through the whole tokenizer, which looks for them first.
        """
        if self.added(text):
            return self.slow(text)
        if text.isascii() or not FOREIGN(text):
            text = text.lower()
            if not SIGNS(text):  # a full stop or comma by itself is a piece of its own
                text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ").replace(",\n", " , ")
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


# Latin characters alone change case one by one and are composed already
FOREIGN = re.compile("[^\x00-\u024f]|\u0130").search
# what the tokenizer's normalizer or contraction rules look at: white space of any kind and quotes
SPECIAL = re.compile("[\\s'\\x1c-\\x1f\\x85\\xa0]|[^\x00-\u024f]").search
SIGNS = re.compile(r"(?:[^\w\s]|_)[.,](?=\s)").search


@lru_cache(maxsize=1)
def word_ids(path: str, width: str) -> WordIds:
    """One store for each worker process, kept from task to task."""
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path), width)


def width_of(path: str) -> str:
    from tokenizers import Tokenizer

    return "u2" if Tokenizer.from_file(path).get_vocab_size(True) <= 1 << 16 else "u4"


def writer(folder: str, tokenizer: str, end_id: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer, width).encode
        end = np.array([end_id], f"<{width}").tobytes()
        parts, docs, sizes = [], [], []
        for batch in batches:
            docs.append(batch.column(0).fill_null(NO_ID).to_numpy().astype("<i8"))
            for text in batch.column(1).to_pylist():
                ids = encode(text)
                parts += (ids, end)
                sizes.append(len(ids) + len(end))
            if len(parts) > 1:
                parts = [b"".join(parts)]
        if not docs:
            return
        part = TaskContext.get().partitionId()
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) // np.dtype(width).itemsize)])
        name = f"{folder}/{part:06d}"
        write_file(f"{name}.ids", parts)
        write_file(f"{name}.offsets", [offsets.astype("<u8").tobytes()])
        write_file(f"{name}.docs", [d.tobytes() for d in docs])
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "docs": pa.array([len(sizes)], pa.int64()), "tokens": pa.array([int(offsets[-1])], pa.int64())})

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Encode and write all documents; returns the manifest ``part, docs, tokens, base, width, folder``.

    ``tokenizer`` names a file of the tokenizers library whose pre-tokenizer drops white space.
    Null and empty texts are documents with the end id alone. Documents go in ascending order of
    the id, null ids first; rows that share an id are ordered by text. Other columns are not read.
    An empty table gives an empty manifest and no files.
    """
    spark = ready(docs)
    folder = folder or shared_folder(spark, "tokens")
    width = width_of(tokenizer)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    parts = materialize(rows.mapInArrow(writer(folder, tokenizer, end_id, width), "part int, docs long, tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per part
    base = F.sum("tokens").over(before) - F.col("tokens")
    return parts.select("part", "docs", "tokens", base.alias("base"), F.lit(width).alias("width"), F.lit(folder).alias("folder"))


def reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the parts in a manifest, out of mapped files."""
    for batch in batches:
        for row in batch.to_pylist():
            name, dtype = f"{row['folder']}/{row['part']:06d}", np.dtype(f"<{row['width']}")
            ids, offsets, docs = map_file(f"{name}.ids").view(dtype), map_file(f"{name}.offsets").view("<u8").astype(np.int64), map_file(f"{name}.docs").view("<i8")
            if len(docs) != row["docs"] or len(ids) != row["tokens"]:
                raise ValueError(f"{name} does not match its manifest")
            lo = 0
            while lo < len(docs):
                hi = max(lo + 1, min(len(docs), int(np.searchsorted(offsets, offsets[lo] + FLUSH, "right")) - 1))
                own = np.array(docs[lo:hi])
                start = offsets[lo : hi + 1]
                yield pa.record_batch({
                    "doc_id": pa.array(own, pa.int64(), mask=own == NO_ID),
                    "start": pa.array(start[:-1] + row["base"], pa.int64()),
                    "ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((start - start[0]) * 4), pa.py_buffer(np.asarray(ids[start[0] : start[-1]], "<u4"))]).cast(pa.binary()),
                })
                lo = hi


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document: its place in the corpus and its ids as 32-bit little-endian bytes."""
    spark = ready(manifest)
    spread = manifest.repartition(shards(spark), "part")
    return spread.mapInArrow(reader, "doc_id long, start long, ids binary")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in reader(batches):
        ids = [x.as_buffer() for x in part.column(2)]
        yield pa.record_batch({
            "doc_id": part.column(0), "start": part.column(1),
            "n_tokens": pa.array([x.size // 4 for x in ids], pa.int64()), "ids_crc32": pa.array([crc32(x) for x in ids], pa.int64()),
        })


def check_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the files, without moving the ids."""
    spark = ready(manifest)
    return manifest.repartition(shards(spark), "part").mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
