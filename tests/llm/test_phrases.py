"""Collocations against plain counting, odd tables included, and the SQL twin."""

from __future__ import annotations

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from papyra.llm import phrases, queries
from tests.llm.test_operators import nothing, odd  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(rows, least=10, top=2000, covered=50):
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            longer = [b for q, b in f.items() if len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))] if len(p) == 2 else []
            if any(100 * b >= covered * a for b in longer):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, words[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r) for r in phrases.collocations(df, **how).collect())


def test_odd_rows_and_nothing(odd, nothing):  # noqa: F811
    rows = [(r["lang"], r["text"]) for r in odd.select("lang", "text").collect()]
    short = [(lang, text) for lang, text in rows if text is None or len(text) < 1000]
    few = odd.filter("text IS NULL OR length(text) < 1000")
    assert found(few, least=2) == plain(short, least=2)
    assert found(odd) == plain(rows)  # two texts of 30,000 words with no phrase ten times
    assert found(nothing) == []
    assert found(few.filter("text IS NULL")) == []


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string, phrase string, n long, a string, block int")


@pytest.mark.parametrize("how", [{}, {"block_tokens": 50, "part_cells": 300}])
def test_pieces_cuts_ties_and_coverage(spark, monkeypatch, how):
    rng = random.Random(4)
    vocabulary = ["New", "york", "CITY", "of", "the", "a", "Ä", "日本", "x\x0by", "b\tc", "d;e", "\x1c", "\x00", "f\r\ng", "...", "h  i", "u v", "end."]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))
        text += " fixed phrase here" * (i % 3) + ", a a a a"
        rows.append((rng.choice(["en", "en", None, "und", ""]), text, "p", 1, "x", 3))
    rows += rows[:50] + [("en", None, None, None, None, None), (None, "", None, None, None, None)]
    assert found(table(spark, rows), **how) == plain([r[:2] for r in rows])
    assert found(table(spark, rows), top=7, least=25, **how) == plain([r[:2] for r in rows], top=7, least=25)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{i % 5000}" + "." * (i % 11 == 0) for i in range(200_000)) + " " + "q" * 3_000_000 + "! after"
    whole, cut = phrases.Codes(), phrases.Codes()
    monkeypatch.setattr(phrases, "TEXT_BYTES", 1 << 30)
    want = np.concatenate(phrases.encoded(text, whole))
    monkeypatch.setattr(phrases, "TEXT_BYTES", 1000)
    got = np.concatenate(phrases.encoded(text, cut))
    assert whole == cut and (want == got).all()


def test_dense_and_sparse_tiles_count_alike(monkeypatch):
    rng = np.random.default_rng(1)
    unit = np.concatenate([rng.integers(0, 300, 40_000), rng.integers(0, 1 << 40, 3_000), np.full(3_000, (1 << 40) - 7)])
    word = np.concatenate([rng.integers(0, 300, 40_000), rng.integers(0, 1 << 31, 3_000), np.full(3_000, (1 << 40) - 9)])
    monkeypatch.setattr(phrases, "MERGE_CELLS", 5_000)
    tiles = phrases.Tiles()
    order = rng.permutation(len(unit))
    for part in np.array_split(order, 37):
        tiles.add(*phrases.summed(*phrases.place_of(unit[part], word[part]), None))
    got = {}
    for tile, cell, n in tiles.cells():
        u, w = phrases.numbers_at(tile, cell.astype(np.int64))
        got |= dict(zip(zip(u.tolist(), w.tolist(), strict=True), n.tolist(), strict=True))
    assert tiles.dense and got == collections.Counter(zip(unit.tolist(), word.tolist(), strict=True))


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_037_000_500  # its square passes 2 ** 63
    words = spark.createDataFrame([("en", 0, "a", big + 11), ("en", 1, "b", big + 7)], "lang string, id long, word string, n long")
    pairs = spark.createDataFrame([("en", 0, 0, 1, big)], "lang string, id long, unit long, word long, n long")
    triples = spark.createDataFrame([], "lang string, pair long, word long, n long")
    sizes = spark.createDataFrame([("en", 4 * big)], "lang string, all long")
    row = phrases.best(words, pairs, triples, sizes, 10, 50).first()
    assert row["score"] == 10**6 * big * big // ((big + 11) * (big + 7)) and row["n"] == 4 * big


def test_sql_twin(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    twin = con.sql(queries.SQL["op11_phrases"])
    want = sorted(twin.fetchall())
    assert sorted(tuple(r) for r in queries.op11(spark, SF).select(*twin.columns).collect()) == want and want
