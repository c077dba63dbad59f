"""Benchmark passages inside documents, within an edit distance, by pigeonhole pieces.

An item of n characters may differ by ``k = floor(share * n)`` edits. Cut into k + 1 pieces, at
least one piece occurs unchanged wherever the item does, so an automaton over all pieces finds
every place that needs a look. There the smallest edit distance of the whole item to any
substring nearby is computed by Myers' bit-parallel recurrence.

Items of fewer than ``SHORT_CHARS`` characters have no budget: they count where they occur exactly and
between word borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.blocks import ready
from papyra.session import materialize

EDIT_SHARE = 0.08
SHORT_CHARS = 40
UNSPACED = 0x2E80  # from here on, scripts without blanks between words (CJK, kana) are common
BLOCK_CHARS = 8_000_000


def plain(column) -> F.Column:
    """Lower case, with everything but letters and digits as single blanks; null stays null."""
    return F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "))


def budget(item: str, share: float) -> int:
    return int(len(item) * share) if len(item) >= SHORT_CHARS else 0


def at_borders(text: str, start: int, end: int) -> bool:
    """Whether a stretch of plain text begins and ends between words: at a blank or an end, or beside a letter of an unspaced script."""
    def free(inner: str, outer: str) -> bool:
        return outer in ("", " ") or ord(inner) >= UNSPACED or ord(outer) >= UNSPACED

    return free(text[start], text[start - 1 : start]) and free(text[end - 1], text[end : end + 1])


def pieces(item: str, share: float) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their places in the item."""
    n, parts = len(item), budget(item, share) + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def nearest(where: dict[str, int], length: int, text: str, limit: int) -> tuple[int, int]:
    """Smallest distance of the pattern to a substring of ``text`` and the end of the first such
    substring; a distance over ``limit`` means none."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best, end = full, 0, length, limit + 1, -1
    for i, c in enumerate(text):
        eq = where.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        hp = minus | (~(d | plus) & full)
        hn = plus & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        plus = hn | (~(d | hp) & full)
        minus = hp & d
        if score < best:
            best, end = score, i + 1
    return best, end


def near_places(text: str, hits: list[int], length: int, k: int) -> list[tuple[int, int]]:
    """Windows of the text that hold every occurrence whose item would start near a hit."""
    out: list[tuple[int, int]] = []
    for at in sorted(set(hits)):
        lo, hi = max(0, at - k), min(len(text), at + length + k)
        if out and lo <= out[-1][1] - length and hi - out[-1][0] <= 4 * (length + 2 * k):
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def matcher(items: list[tuple[int, str]], share: float):
    """(doc_id, plain text, digest of the text) batches to one row per document and item found in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if not items:
            return
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(items):
            for at, piece in pieces(item, share):
                owners.setdefault(piece, []).append((n, at + len(piece)))
        automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            automaton.add_word(piece, own)
        automaton.make_automaton()
        tables: dict[int, dict[str, int]] = {}
        for batch in batches:
            out = []
            for doc, text, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text:
                    continue
                hits: dict[int, list[int]] = {}
                for end, own in automaton.iter(text):
                    for n, at in own:
                        hits.setdefault(n, []).append(end + 1 - at)
                for n, starts in hits.items():
                    item = items[n][1]
                    k, size = budget(item, share), len(item)
                    if size < SHORT_CHARS:
                        start = next((s for s in starts if at_borders(text, s, s + size)), None)
                        if start is not None:
                            out.append((doc, items[n][0], 0, start + size, size, digest))
                        continue
                    where = tables.setdefault(n, masks(item))
                    best = (k + 1, -1)
                    for lo, hi in near_places(text, starts, size, k):
                        if hi - lo < size - k:
                            continue
                        distance, end = nearest(where, size, text[lo:hi], k)
                        if distance < best[0]:
                            best = (distance, lo + end)
                        if distance == 0:
                            break
                    if best[0] <= k:
                        out.append((doc, items[n][0], best[0], best[1], size, digest))
            *columns, digests = list(zip(*out, strict=True)) or [()] * 6
            numbers = {n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "item_id", "distance", "end", "item_chars"), columns, strict=True)}
            yield pa.record_batch(numbers | {"digest": pa.array(digests, pa.string())})

    return run


MATCHES = "doc_id bigint, item_id bigint, distance bigint, end bigint, item_chars bigint, digest string"


def matches(docs: DataFrame, benchmark: DataFrame, key: str, text: str, share: float) -> DataFrame:
    """The rows of ``contaminated`` with ``digest``, the md5 of the document's text."""
    ready(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain(F.col("text")).alias("item"))
    items = materialize(items.filter(F.length("item") > 0), "items")
    chars = items.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), plain(F.col(text)).alias("text"), F.md5(text).alias("digest"))
    found = None
    for number in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).collect()
        block = rows.mapInArrow(matcher(sorted((r["item_id"], r["item"]) for r in part), share), MATCHES)
        found = block if found is None else found.union(block)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", share: float = EDIT_SHARE) -> DataFrame:
    """One row per document and benchmark item that occurs in it within ``share`` of its length in edits.

    Columns: ``doc_id``, ``item_id``, ``distance`` (the smallest), ``end`` (where the first such place
    ends in the plain text), ``item_chars``. Both sides are compared in plain form: lower case,
    letters and digits, single blanks. Items of fewer than ``SHORT_CHARS`` plain characters count
    where they occur exactly, between word borders (next to a letter of a script without blanks, anywhere). Null
    items and those without a letter or digit are left out; null and empty texts match nothing. Items with equal texts are found separately. Repeated document rows give repeated
    results. The benchmark goes to the tasks in blocks of about ``BLOCK_CHARS`` characters,
    each of which costs one pass over the documents; other columns are not read.
    """
    return matches(docs, benchmark, key, text, share).drop("digest")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", share: float = EDIT_SHARE) -> DataFrame:
    """The documents that hold no benchmark item; of rows that share an id, or have none, each is judged by its own text."""
    bad = materialize(matches(docs, benchmark, key, text, share).select("doc_id", "digest").distinct(), "contaminated")
    same = docs[key].cast("long").eqNullSafe(bad["doc_id"]) & (F.md5(docs[text]) == bad["digest"])
    return docs.join(bad, same, "left_anti")
