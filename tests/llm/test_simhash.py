"""SimHash groups against brute force over all fingerprints."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from papyra.llm import simhash
from papyra.llm.components import components
from papyra.session import materialize
from tests.llm.test_operators import SF, nothing, odd, texts_of  # noqa: F401


def plain_fingerprint(text: str) -> int:
    words = [w for w in text.encode().lower().replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if w]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(prints) -> dict:
    prints = np.array(sorted(set(prints)), np.uint64)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= 4):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {int(p): find(i) for i, p in enumerate(prints)}


def expected(rows):
    printed = [(i, plain_fingerprint(t)) for i, t in rows]
    group = least_reachable(p for _, p in printed)
    least = {}
    for i, p in printed:
        if i is not None:
            least[group[p]] = min(least.get(group[p], i), i)
    return sorted(((i, f"{p:016x}", least.get(group[p])) for i, p in printed), key=str)


def found(df, **sizes):
    return sorted((tuple(r) for r in simhash.near_duplicates(df, **sizes).collect()), key=str)


def test_all_odd_cases(odd, nothing):  # noqa: F811
    assert found(odd) == expected(texts_of(odd))
    assert simhash.near_duplicates(odd).columns == ["doc_id", "fingerprint", "component_id"]
    assert found(nothing) == []
    alone = odd.filter(F.col("doc_id").isNull())
    assert {r[2] for r in found(alone)} == {None}


@pytest.mark.parametrize("sizes", [{}, {"homes": 4, "askers": 8}])
def test_documents(spark, sizes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs, **sizes) == expected(texts_of(docs))


def family(seed: int, n: int, flips: int) -> set[int]:
    rng = np.random.default_rng(seed)
    base, out = int(rng.integers(0, 1 << 63)), set()
    while len(out) < n:
        x = base
        for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
            x ^= 1 << int(b)
        out.add(x)
    return out


@pytest.mark.parametrize("sizes", [{}, {"homes": 30, "askers": 100}])
def test_large_families_lose_no_link_and_give_few_rows(spark, sizes):
    rng = np.random.default_rng(5)
    prints = family(1, 900, 6) | family(2, 200, 9) | {int(x) for x in rng.integers(0, 1 << 63, 700)} | {0, 1, (1 << 64) - 1, 1 << 63}
    rows = [(int(x),) for x in np.array(sorted(prints), np.uint64).view(np.int64)]
    stars = materialize(simhash.links(spark.createDataFrame(rows, "print long"), **sizes), "stars")
    want = least_reachable(prints)
    roots = {r["node"] & (1 << 64) - 1: r["root"] for r in components(stars).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(want[p], set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    if not sizes:  # stars, not pairs: about a row a member and segment
        assert stars.count() < 24 * len(prints)


def test_a_very_long_text_is_read_whole():
    head = " ".join(f"w{i}" for i in range(120_000))
    assert simhash.fingerprint(head) == plain_fingerprint(head)
    assert simhash.fingerprint("ÄB  äb\x0bCD") == plain_fingerprint("ÄB äb CD")
    assert simhash.fingerprint("") == simhash.fingerprint(" \t\r\n\x0c") == 0
