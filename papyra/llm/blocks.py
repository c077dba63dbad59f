"""Vectorised access to Arrow text columns inside Spark tasks, and shared files.

Texts are handled as one byte buffer per slice of rows, so numpy works on whole slices and
memory stays proportional to ``SLICE_BYTES`` (or to the longest single text).
"""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from papyra.session import new_path, ship_package

SLICE_BYTES = 1 << 20
STORES: list = []  # cached functions whose results are large and can be made again
POWER = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def forget_stores() -> None:
    """Give up what tasks of other operators left in a Python worker that Spark uses again."""
    if any(store.cache_info().currsize for store in STORES):
        for store in STORES:
            store.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text or binary column; nulls count as empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and ``rows`` rows each (one row at least)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(POWER), -1, 1 << 64))
    first = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([first, np.cumprod(np.full(n, p, np.uint64))]) for p in (POWER, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``n`` + 1 of each."""
    return _powers(max(SLICE_BYTES, 1 << max(n, 1).bit_length()))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some rows, with A-Z in lower case, and word offsets per row.

    Words are the runs of bytes other than blank and the controls 9 to 13. The hash of a word
    is a polynomial in its bytes, read off a running sum over the slice.
    """
    base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    edges = offsets - base
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    part = data[base : base + n]
    solid = ~BLANK[part]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    inner = edges[1:-1][edges[1:-1] < n]
    opens[inner] = solid[inner]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    last = edges[1:-1][edges[1:-1] > 0] - 1
    closes[last] = solid[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = powers(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((LOWER[part].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        words = (sums[ends] - sums[starts]) * inverse[starts]
        words = mix(words + (ends - starts).astype(np.uint64) * MIX2)
    return words, np.searchsorted(starts, edges)


def array_of(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def planes(a: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, which lets the shuffle's compression drop empty ones."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T.copy().view(kind).ravel()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows that wait in one Arrow batch, as texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def ready(df: DataFrame) -> SparkSession:
    """The session of a table, with this package on its workers and bounded Arrow batches."""
    spark = df.sparkSession
    ship_package(spark)
    small_batches(spark)
    return spark


def shards(spark: SparkSession) -> int:
    """As many shards as the session has shuffle partitions, so that they grow with the input's settings."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, label: str) -> str:
    return new_path(spark, label)


# -- files of our own formats in the shared folder -------------------------------------------------


def is_local(uri: str) -> bool:
    return urlparse(uri).scheme in ("", "file")


def local_path(uri: str) -> str:
    return unquote(urlparse(uri).path) if urlparse(uri).scheme == "file" else uri


def write_file(uri: str, parts: list[bytes | memoryview]) -> None:
    """Write a file under a name of its own and move it into place, so a retried task does no harm."""
    if is_local(uri):
        path = local_path(uri)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        with open(draft, "wb") as out:
            for part in parts:
                out.write(part)
        os.replace(draft, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    store.move(draft, path)


def map_file(uri: str) -> np.ndarray:
    """The bytes of a file: mapped into memory where the shared folder is mounted, read elsewhere."""
    if is_local(uri):
        path = local_path(uri)
        return np.memmap(path, np.uint8, "r").view(np.ndarray) if os.path.getsize(path) else np.empty(0, np.uint8)  # a plain array is cut faster
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read(), np.uint8)
