"""SimHash near duplicates by multi-index hashing.

A fingerprint has 64 bits, cut into three segments. Two fingerprints that differ in at most
four bits differ in at most one bit inside one of the first two segments, or agree in the third:
otherwise they would differ in 2 + 2 + 1 bits. So every fingerprint is filed once in each segment's
table (its home), and asks the tables of the first two segments also for the keys with one bit
set besides (of two keys that are one bit apart, the one without the bit asks). What meets in a
bucket is verified by the complete distance.

Links leave a task as stars: each member of a group with the smallest one, so a family of n close
fingerprints gives n rows, not their pairs. Buckets with more than ``HOMES`` homes or ``ASKERS`` askers are
dealt into units of bounded size that together hold every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.rows import unnest_structs
from papyra.llm.blocks import ready
from papyra.llm.components import components
from papyra.session import materialize

SHINGLE = 4
SEED = 42
BITS = 64
DISTANCE = 4
#: Segments as (place, bits, bits that may differ).
SEGMENTS = [(0, 21, 1), (21, 21, 1), (42, 22, 0)]
HOMES = 1 << 14
ASKERS = 1 << 16
SHINGLES_AT_ONCE = 1 << 15
PAIRS_AT_ONCE = 1 << 21


# -- fingerprints --------------------------------------------------------------------------


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.encode().lower().split()  # bytes: only A-Z, and only blank and the controls 9 to 13
    if not words:
        return 0
    if len(words) < size:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*[islice(words, i, None) for i in range(size)], strict=False))
    total, count = np.zeros(BITS, np.int64), 0
    while part := [xxhash.xxh64_intdigest(g, SEED) for g in islice(grams, SHINGLES_AT_ONCE)]:
        h = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(h, axis=1, bitorder="little").sum(0, dtype=np.int64)
        count += len(part)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def printer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, fingerprint as a signed number)."""
    for batch in batches:
        found = np.array([fingerprint(t.as_py() or "") for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.record_batch({"doc_id": batch.column(0), "print": pa.array(found, pa.int64())})


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, print)``: the SimHash of every whole text as a signed 64-bit number; null texts count as empty."""
    ready(docs)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(printer, f"doc_id {kind}, print bigint")


# -- the tables -----------------------------------------------------------------------------


def entries(prints: DataFrame) -> DataFrame:
    """``(bucket, print, home)``: a fingerprint's homes, and the buckets it asks."""

    def filing(number: int, place: int, bits: int, near: int):
        key = F.shiftrightunsigned("print", place).bitwiseAND(F.lit((1 << bits) - 1))
        entry = lambda k, home: F.struct(k.bitwiseOR(F.lit(number << 32)).alias("bucket"), F.lit(home).alias("home"))
        own = F.array(entry(key, True))
        if not near:
            return own
        flips = F.array(*[F.lit(1 << b).cast("long") for b in range(bits)])
        unset = F.filter(flips, lambda m: key.bitwiseAND(m) == 0)
        return F.concat(own, F.transform(unset, lambda m: entry(key.bitwiseOR(m), False)))

    rows = unnest_structs(prints, ["print"], F.concat(*[filing(i, *s) for i, s in enumerate(SEGMENTS)]))
    return rows.select("bucket", "print", "home")


def dealt(filed: DataFrame, homes: int, askers: int) -> DataFrame:
    """``(unit, print, home, crossed)``: buckets as units of bounded size, every pair of a bucket in one of them.

    A large bucket's homes and askers go into parts; a unit has two parts of homes, or one of homes and one of
    askers, which is compared across only.
    """
    sizes = filed.groupBy("bucket").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("askers"))
    large = materialize(sizes.filter((F.col("homes") > 0) & ((F.col("homes") > homes) | (F.col("askers") > askers))), "large")
    marked = filed.join(large, "bucket", "left")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(-1).alias("b"), F.lit(False).alias("crossed")))
    h, k = F.ceil(F.col("homes") * 2 / homes).cast("int"), F.ceil(F.col("askers") / askers).cast("int")
    own = lambda parts: F.pmod(F.xxhash64("print"), parts).cast("int")
    unit = lambda a, b, crossed: F.struct(a.alias("a"), b.alias("b"), F.lit(crossed).alias("crossed"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    of_home = F.concat(F.transform(upto(h), lambda j: unit(F.least(own(h), j), F.greatest(own(h), j), False)), F.transform(upto(k), lambda j: unit(own(h), j, True)))
    of_asker = F.transform(upto(h), lambda i: unit(i, own(k), True))
    units = F.when(F.col("homes").isNull(), whole).when(F.col("home"), of_home).otherwise(of_asker)
    rows = unnest_structs(marked, ["bucket", "print", "home"], units)
    return rows.select(F.xxhash64("bucket", "a", "b", "crossed").alias("unit"), "print", "home", "crossed")


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit to links: every member of a group in a stretch of units, with the smallest one."""
    held = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        held = [x[last:] for x in rows]  # the last unit may go on in the next batch
        yield from unit_links(*[x[:last] for x in rows])
    if held is not None:
        yield from unit_links(*held)


def unit_links(unit: np.ndarray, prints: np.ndarray, home: np.ndarray, crossed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stars of the links of whole units; about ``PAIRS_AT_ONCE`` comparisons at a time."""
    if not len(unit):
        return
    order = np.lexsort((~home, unit))  # homes first
    unit, prints, home, crossed = unit[order], prints[order].view(np.uint64), home[order], crossed[order]
    start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    size = np.diff(np.append(start, len(unit)))
    homes = np.add.reduceat(home.astype(np.int64), start)
    some = (homes > 0) & (size > 1)
    start, size, homes = start[some], size[some], homes[some]
    # a home is compared with the members after it, or where two parts are crossed, with the askers
    row = np.repeat(start, homes) + np.arange(int(homes.sum())) - np.repeat(np.cumsum(homes) - homes, homes)
    after = np.where(crossed[row], np.repeat(start + homes, homes), row + 1)
    others = np.repeat(start + size, homes) - after
    done = np.cumsum(others)
    members, roots = np.empty(0, np.int64), np.empty(0, np.int64)
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] - others[lo] + PAIRS_AT_ONCE, "right")))
        n = others[lo:hi]
        a = np.repeat(row[lo:hi], n)
        b = np.repeat(after[lo:hi], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        close = (np.bitwise_count(prints[a] ^ prints[b]) <= DISTANCE) & (prints[a] != prints[b])
        if close.any():
            a, b = prints[a[close]].view(np.int64), prints[b[close]].view(np.int64)
            members, roots = groups(np.concatenate([members, a]), np.concatenate([roots, b]))
        lo = hi
    if len(members):
        yield pa.record_batch({"a": pa.array(members, pa.int64()), "b": pa.array(roots, pa.int64())})


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of the groups that links make, each with the smallest one of its group, which is left out."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label, new)  # the old root follows its members
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def links(prints: DataFrame, homes: int = HOMES, askers: int = ASKERS) -> DataFrame:
    """``(a, b)``: links enough to connect all distinct fingerprints (column ``print``) at most ``DISTANCE`` bits apart."""
    units = dealt(entries(prints), homes, askers).repartition("unit").sortWithinPartitions("unit")
    return units.mapInArrow(stars, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", homes: int = HOMES, askers: int = ASKERS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    The fingerprint is the SimHash of the four-word shingles, repeats included, as 16 hexadecimal digits;
    a text of fewer words is one shingle. Null, empty and blank texts have the fingerprint zero, which
    links like any other. Words are cut at blanks and the controls 9 to 13; only A-Z become lower case. ``component_id`` is the
    smallest id that can be reached over links, null where all of them are null. Rows may
    repeat, and each is returned. An empty table gives no rows. Other columns are not read.
    """
    printed = materialize(fingerprints(docs, key, text), "fingerprints")
    distinct = materialize(printed.groupBy("print").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = components(materialize(links(distinct, homes, askers), "stars"))
    named = distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(named.join(least, "root").select("print", "component_id"), "members")
    shown = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return printed.join(named, "print").select("doc_id", shown, "component_id")
