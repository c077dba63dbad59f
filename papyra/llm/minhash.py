"""Near-duplicate groups by consistent weighted sampling of TF-IDF shingles.

1. One pass counts in how many documents each of ``SKETCH`` shingle buckets occurs. The sum
   has a fixed size, whatever the corpus; what a bucket holds besides its own shingle is a
   fixed share of the documents, so the error of a document frequency does not grow.
2. A second pass draws ``BANDS * ROWS`` improved consistent weighted samples (gamma-distributed
   ``r`` and ``c``, uniform ``beta``) from the weighted shingles of every text.
3. Equal texts form a class, keyed by digest. Classes that agree in a band share a bucket.
   All members of a bucket are compared with each other, in units of bounded size.
4. Pairs are verified by the weighted Jaccard similarity of their whole shingle sets, in the unit
   of their first shared band. A unit returns numbers of links and a star for each of its groups
   instead of the pairs, so rows do not grow with the square of a group, and the stars are closed to groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.blocks import array_of, binaries, mix, ready, slices, utf8, word_hashes
from papyra.llm.components import components
from papyra.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 15, 4
SKETCH_BITS = 20
SKETCH = 1 << SKETCH_BITS
BLOCK = 1 << 14
ID_BITS = 52  # of a shingle; the rest of a 64-bit sort key holds the row
QUANTILES = 4096
UNIT_MEMBERS = 256  # compared at once, and their shingles
UNIT_SHINGLES = 1 << 22
COLUMNS = 2048


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, in ascending order, with their counts and row offsets.

    A text of fewer than ``size`` words is one shingle; a text without words has none.
    """
    words, edge = word_hashes(data, offsets)
    rows = len(edge) - 1
    count = np.diff(edge)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    total = int(made.sum())
    row = np.repeat(np.arange(rows), made)
    first = np.cumsum(made) - made
    start = np.arange(total) - np.repeat(first, made) + np.repeat(edge[:-1], made)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    with np.errstate(over="ignore"):
        h = np.zeros(total, np.uint64)
        length = np.minimum(count, size)[row]
        for j in range(size):
            h = h * np.uint64(0x100000001B3) + np.where(length > j, padded[start + j], np.uint64(0))
        h = mix(h + length.astype(np.uint64))
    key = (row.astype(np.uint64) << np.uint64(ID_BITS)) | (h >> np.uint64(64 - ID_BITS))
    key.sort()
    new = np.ones(total, bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, total))
    key = key[at]
    ids = key & np.uint64((1 << ID_BITS) - 1)
    return ids, tf, np.searchsorted(key >> np.uint64(ID_BITS), np.arange(rows + 1).astype(np.uint64))


def bucket_of(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(ID_BITS - SKETCH_BITS)).astype(np.int64)


def sketch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per shingle bucket in one task, as blocks of counts; block -1 counts the documents."""
    counts, documents = np.zeros(SKETCH, np.int64), 0
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        documents += len(batch)
        for lo, hi in slices(offsets):
            ids, _, _ = shingles(data, offsets[lo : hi + 1])
            counts += np.bincount(bucket_of(ids), minlength=SKETCH)
    if documents:
        least = np.min_scalar_type(int(counts.max()))
        parts = [counts[i : i + BLOCK].astype(least).tobytes() for i in range(0, SKETCH, BLOCK)]
        yield pa.record_batch(
            {"block": pa.array([-1, *range(len(parts))], pa.int32()), "width": pa.array([8, *[least.itemsize] * len(parts)], pa.int32()), "counts": binaries([np.int64(documents).tobytes(), *parts])}
        )


def add_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), f"u{w.as_py()}").astype(np.int64) for c, w in zip(table["counts"], table["width"], strict=True))
    return pa.table({"block": table["block"][:1], "counts": binaries([total.tobytes()])})


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """The number of documents and the documents per shingle bucket, over the whole table."""
    parts = docs.select(F.lower(text)).mapInArrow(sketch_counts, "block int, width int, counts binary")
    sums = parts.groupBy("block").applyInArrow(add_blocks, "block int, counts binary").collect()  # of fixed size
    counts, documents = np.zeros(SKETCH, np.int64), 0
    for block, data in sums:
        if block < 0:
            documents = int(np.frombuffer(data, np.int64)[0])
        else:
            counts[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(data, np.int64)
    return documents, counts


def inverse_frequencies(documents: int, counts: np.ndarray) -> np.ndarray:
    """1 + ln(N / df) / ln(N), between 1 and 2 and per bucket: rare shingles weigh up to twice as much.

    The bounded form keeps edited copies of a much copied text above the similarity: their
    common shingles are frequent by their own doing.
    """
    n = max(documents, 2)
    return (1 + np.log(n / np.clip(counts, 1, n)) / math.log(n)).astype(np.float32)


def gamma_quantiles() -> np.ndarray:
    """Midpoint quantiles of the gamma distribution with shape 2 and scale 1."""
    goal = (np.arange(QUANTILES) + 0.5) / QUANTILES
    lo, hi = np.zeros(QUANTILES), np.full(QUANTILES, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < goal
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def weighted_samples(ids: np.ndarray, weight: np.ndarray, edge: np.ndarray, k: int) -> np.ndarray:
    """``k`` consistent weighted samples per row, as 64-bit values; rows without shingles get zeros."""
    quantile = gamma_quantiles()
    table_r, table_c = quantile.astype(np.float32), np.log(quantile).astype(np.float32)
    full = np.flatnonzero(np.diff(edge))
    out = np.zeros((len(edge) - 1, k), np.uint64)
    if not len(full):
        return out
    starts, sizes = edge[full], np.diff(edge)[full]
    log_weight = np.log(weight).astype(np.float32)
    low = np.uint64(QUANTILES - 1)
    for j in range(k):
        with np.errstate(over="ignore"):
            u = (ids + np.uint64(j + 1) * MIX_STEP) * ODD
            u ^= u >> np.uint64(32)
            u *= ODD2
            u ^= u >> np.uint64(29)
        r = table_r[(u & low).astype(np.intp)]
        c = table_c[((u >> np.uint64(12)) & low).astype(np.intp)]
        beta = ((u >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_weight / r + beta)
        value = c - r * (t - beta + 1)
        least = np.minimum.reduceat(value, starts)
        hit = np.flatnonzero(value == np.repeat(least, sizes))
        pick = hit[np.searchsorted(hit, starts)]
        with np.errstate(over="ignore"):
            out[full, j] = mix(ids[pick] * ODD2 + t[pick].astype(np.int64).astype(np.uint64) + np.uint64(j))
    return out


MIX_STEP = np.uint64(0xD1342543DE82EF95)
ODD = np.uint64(0xFF51AFD7ED558CCD)
ODD2 = np.uint64(0xC4CEB9FE1A85EC53)


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band and row of the table; the band's number is part of it."""
    out = np.empty((len(samples), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(samples), b + 1, np.uint64)
            for j in range(rows):
                h = mix(h * ODD + samples[:, b * rows + j])
            out[:, b] = h
    return out


def signer(idf, bands: int, rows: int):
    """(digest, text) batches to (digest, band keys); texts without words get no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                ids, tf, edge = shingles(data, offsets[lo : hi + 1])
                samples = weighted_samples(ids, tf * table[bucket_of(ids)], edge, bands * rows)
                some = np.diff(edge) > 0
                keys = band_keys(samples, bands, rows)[some].view(np.int64)
                where = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
                yield pa.record_batch({"key": batch.column(0).slice(lo, hi - lo), "bands": array_of(keys.ravel(), where, pa.int64()), "size": pa.array(np.add.reduceat(np.append(tf, 0), edge[:-1]) * some, pa.int64())})

    return run


def packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, text) to (digest, shingles): the leading 32 bits of each shingle, repeated by its count."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for lo, hi in slices(offsets):
            ids, tf, edge = shingles(data, offsets[lo : hi + 1])
            lead = (ids >> np.uint64(ID_BITS - 32)).astype(np.uint32)
            parts = [np.repeat(lead[a:b], tf[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.record_batch({"key": batch.column(0).slice(lo, hi - lo), "shingles": binaries(parts)})


def weighted_jaccard(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """Similarity of two sorted multisets of shingles under tf-idf weights."""
    (x, m), (y, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shift = np.uint32(32 - SKETCH_BITS)
    common = float((np.minimum(m[i], n[j]) * idf[both >> shift]).sum(dtype=np.float64))
    total = float((m * idf[x >> shift]).sum(dtype=np.float64) + (n * idf[y >> shift]).sum(dtype=np.float64))
    return common / (total - common) if total else 0.0


def overlaps(packs: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs of sorted multisets of shingles."""
    k = len(packs)
    row = np.repeat(np.arange(k), [len(x) for x in packs])
    ids = np.concatenate(packs)
    # the n-th copy of a shingle in a text is an element of its own, so the smaller count is an intersection
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    copy = np.arange(len(ids)) - np.repeat(at, np.diff(np.append(at, len(ids))))
    weight = idf[ids >> np.uint32(32 - SKETCH_BITS)].astype(np.float64)
    total = np.bincount(row, weight, k)
    order = np.lexsort((copy, ids))
    ids, copy, row, weight = ids[order], copy[order], row[order], weight[order]
    new[1:] = (ids[1:] != ids[:-1]) | (copy[1:] != copy[:-1])
    at = np.flatnonzero(new)
    held = np.diff(np.append(at, len(ids)))
    shared = np.repeat(held > 1, held)
    column, row, weight = np.repeat(np.cumsum(held > 1) - 1, held)[shared], row[shared], weight[shared]
    common = np.zeros((k, k))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        block = np.zeros((k, COLUMNS))
        block[row[a:b], column[a:b] - lo] = np.sqrt(weight[a:b])
        common += block @ block.T
    np.fill_diagonal(common, total)  # of the elements of one text alone, nothing was added
    union = total[:, None] + total[None, :] - common
    return np.divide(common, union, out=np.zeros((k, k)), where=union > 0)


def verifier(idf, similarity: float):
    """All members of a unit to its links: per linked member the smallest one it reaches inside the unit and its number of links.

    A pair counts in the unit of its first shared band only, so in one unit of all.
    """

    def run(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks()
        k, band = len(unit), unit["band"][0].as_py()
        keys, part = unit["key"].to_pylist(), unit["part"].to_numpy()
        bands = np.array(unit["bands"].to_pylist(), np.int64).reshape(k, -1)
        pair = bands[:, None, band] == bands[None, :, band]
        for earlier in range(band):
            pair &= bands[:, None, earlier] != bands[None, :, earlier]
        np.fill_diagonal(pair, False)
        if unit["low"][0].as_py() != unit["high"][0].as_py():
            pair &= part[:, None] != part[None, :]  # pairs of one part belong to the unit of that part
        some = np.flatnonzero(pair.any(axis=1))
        out = []
        if len(some):
            packs = [np.frombuffer(unit["shingles"][int(i)].as_buffer(), np.uint32) for i in some]
            link = pair[np.ix_(some, some)] & (overlaps(packs, idf.value) >= similarity)
            degree, left = link.sum(axis=1), set(np.flatnonzero(link.any(axis=1)).tolist())
            while left:
                group, edge = set(), {left.pop()}
                while edge:
                    group |= edge
                    edge = set(np.flatnonzero(link[sorted(edge)].any(axis=0)).tolist()) & left
                    left -= edge
                least = min(keys[some[i]] for i in group)
                out += [(keys[some[i]], least, int(degree[i])) for i in group]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({"key": pa.array(columns[0], pa.binary()), "least": pa.array(columns[1], pa.binary()), "links": pa.array(columns[2], pa.int64())})

    return run


def candidate_units(classes: DataFrame) -> DataFrame:
    """``(key, bands, band, bucket, low, high, part)`` from ``(key, bands, size)``: buckets dealt into units of bounded size.

    The members of a bucket go into parts by hash; each pair of parts is a unit and has all members of both,
    so every two members meet. Buckets with the very same members are one, that of the first band.
    """
    members = materialize(classes.select("key", "size", F.posexplode("bands").alias("band", "bucket")), "bands")
    held = members.groupBy("bucket").agg(
        F.min("band").alias("band"), F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("size"),
        F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
    )
    parts = F.ceil(F.greatest(F.col("n") / UNIT_MEMBERS, F.col("size") / UNIT_SHINGLES) * 2).cast("int").alias("parts")
    # a bucket of up to one unit's size is one part
    parts = F.when((F.col("n") <= UNIT_MEMBERS) & (F.col("size") <= UNIT_SHINGLES), 1).otherwise(parts).alias("parts")
    held = held.filter("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket", "size")).alias("first"))
    held = materialize(held.select("first.bucket", "n", "first.size").select("bucket", parts), "buckets")
    own = F.pmod(F.xxhash64("key", F.lit(2)), F.col("parts")).cast("int").alias("part")
    shared = members.join(held, "bucket").select("key", "band", "bucket", "parts", own)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    units = shared.select("key", "band", "bucket", "part", other)
    units = units.select("key", "band", "bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part")
    return units


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: its text's class, its group, and the links of its class.

    Columns: ``doc_id``, ``class_key`` (md5 of the text), ``class_id`` (smallest doc_id with this
    very text), ``group_key`` (smallest digest of the group), ``group_id`` (its smallest doc_id),
    ``links`` (the other texts that share a band with this one and are verified to be similar). Words are split at blanks and compared in lower case. Null texts
    count as empty; equal texts form a class also where they are empty or have no words, but
    texts without words link to nothing else. Rows may repeat; every row is returned. A null
    id is larger than any other when the smallest is chosen. Other columns are not read.
    """
    spark = ready(docs)
    whole = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = whole.select("doc_id", F.unhex(F.md5("text")).alias("key"), F.lower("text").alias("text"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(*document_frequencies(whole)))
    sizes = materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("class_id")), "classes")
    signed = keyed.select("key", "text").mapInArrow(signer(idf, bands, rows), "key binary, bands array<bigint>, size bigint")
    # copies have equal bands, so the first of a key is as good as any
    classes = signed.filter(F.size("bands") > 0).groupBy("key").agg(F.first("bands").alias("bands"), F.first("size").alias("size"))
    classes = materialize(classes, "signatures")
    units = materialize(candidate_units(classes), "units")
    used = units.select("key").distinct()
    # one row of each class: joining by its id as well spreads the copies of a text
    used = materialize(sizes.join(used, "key", "left_semi").select("key", F.col("class_id").alias("doc_id")), "used")
    same = keyed["doc_id"].eqNullSafe(used["doc_id"]) & (keyed["key"] == used["key"])
    texts = keyed.join(used.hint("merge"), same, "left_semi").select("key", "text")  # alike at every size
    packed = texts.mapInArrow(packer, "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
    packed = materialize(packed.join(classes.select("key", "bands"), "key"), "packed")
    whole_units = units.join(packed.hint("merge"), "key").groupBy("bucket", "low", "high")
    found = whole_units.applyInArrow(verifier(idf, similarity), "key binary, least binary, links bigint")
    found = materialize(found, "links")
    roots = components(found.filter("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")))
    degree = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = sizes.join(roots.withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left")
    named = named.select("key", "class_id", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = materialize(named, "named")
    group = materialize(named.groupBy("root").agg(F.min("class_id").alias("group_id")), "groups")
    named = materialize(named.join(group, "root"), "members")
    digest = lambda c: F.lower(F.hex(c))
    return keyed.select("doc_id", "key").join(named, "key").select(
        "doc_id", digest("key").alias("class_key"), "class_id", digest("root").alias("group_key"), "group_id", "links"
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates: of each group the row with the smallest id stays.

    Where several rows of a group have that id, one with the smallest digest stays; a null id
    counts only where no row of the group has one.
    """
    found = near_duplicates(docs, key, text).filter(F.col("doc_id").eqNullSafe(F.col("group_id")))
    kept = found.groupBy("group_key").agg(F.min("class_key").alias("kept_key"), F.first("group_id").alias("kept_id"))
    kept = materialize(kept.drop("group_key"), "kept")
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(key).alias("_id"), digest.alias("_digest"))
    left = rows.join(kept, rows["_id"].eqNullSafe(kept["kept_id"]) & (rows["_digest"] == kept["kept_key"]), "left_semi")
    return left.dropDuplicates(["_digest"]).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
