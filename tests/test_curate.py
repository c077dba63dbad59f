from __future__ import annotations

import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from papyra.operators import curate

TEXTS = ["a\nb\n\na", "b\n c \n", "x\nb", "a\nb\n\na", None, "  \n", "c\nd\ne", "b", "d\nz"]


def first_occurrences(texts):
    seen, out = set(), {}
    for i, text in enumerate(texts):
        kept = []
        for part in (text or "").split("\n"):
            part = part.strip()
            if part and part not in seen:
                seen.add(part)
                kept.append(part)
        if kept:
            out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("key", ["long", "negative", "text"])
def test_paragraph_dedup(spark, key):
    ids = {"long": lambda i: i, "negative": lambda i: i - 5, "text": lambda i: f"doc-{i:03d}"}[key]
    rows = spark.createDataFrame([(ids(i), t) for i, t in enumerate(TEXTS)], f"id {'string' if key == 'text' else 'bigint'}, text string")
    got = {r.id: r.text for r in curate.dedup_paragraphs(rows.repartition(3), "id", "text").collect()}
    assert got == {ids(i): t for i, t in first_occurrences(TEXTS).items()}


def test_doc_dedup_keeps_the_smallest_key(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    assert sorted(r.id for r in curate.dedup_docs(rows, "id", "text").collect()) == [0, 1, 2, 4, 5, 6, 7, 8]


def plain_paragraphs(rows):
    """First occurrences by key (null last) and text digest; repeated rows once."""
    seen, out = set(), []
    place = lambda r: (r[0] is None, r[0] if r[0] is not None else 0, xxhash.xxh64_intdigest(hashlib.sha256((r[1] or "").encode()).hexdigest().encode(), 42) + (1 << 63) & (1 << 64) - 1)
    for key, text in sorted(set(rows), key=place):
        kept = [p for p in dict.fromkeys(p.strip() for p in (text or "").split("\n")) if p and p not in seen]
        seen |= set(kept)
        if kept:
            out.append((key, "\n".join(kept)))
    return sorted(out, key=str)


ODD_ROWS = [(None, "x\ny"), (1, "x\nz"), (1, "w"), (None, "only here"), (0, "A"), (1, "A"), (1, "B"), (1, "B"), (None, None), (2, None), (2, ""), (None, "x\ny"), (-(1 << 63), "q\nw"), ((1 << 63) - 1, "q\nlast\nx"), (None, "last\nnone")]


@pytest.mark.parametrize("copies", [1, 3])
def test_paragraphs_of_null_and_repeated_ids(spark, copies):
    rows = ODD_ROWS * copies + [(None if i % 3 == 0 else i % 40, f"p{i % 11}\np{i % 13}\nq{i}") for i in range(400)]
    table = spark.createDataFrame(rows, "id long, text string")
    assert sorted((tuple(r) for r in curate.dedup_paragraphs(table.repartition(5), "id", "text").collect()), key=str) == plain_paragraphs(rows)
    named = spark.createDataFrame([(None if i is None else f"{i + (1 << 63):020d}", t) for i, t in rows], "id string, text string")
    want = [(None if i is None else f"{i + (1 << 63):020d}", t) for i, t in plain_paragraphs(rows)]
    assert sorted((tuple(r) for r in curate.dedup_paragraphs(named, "id", "text").collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_documents_of_null_and_repeated_ids(spark, kind):
    rows = [(None if i is None else i if kind == "long" else f"{i + (1 << 63):020d}", t, n) for n, (i, t) in enumerate(ODD_ROWS * 2)]
    got = curate.dedup_docs(spark.createDataFrame(rows, f"id {kind}, text string, n int"), "id", "text").collect()
    least = {}
    for i, t, _ in rows:
        if t not in least or i is not None and (least[t] is None or i < least[t]):
            least[t] = i
    assert sorted(((r.id, r.text) for r in got), key=str) == sorted(((i, t) for t, i in least.items()), key=str)


def test_hot_paragraph(spark):
    rows = spark.range(3000).withColumn("text", F.concat(F.lit("menu\n"), F.col("id") % 1000, F.lit("\nfooter")))
    out = curate.dedup_paragraphs(rows, "id", "text")
    assert out.count() == 1000
    assert out.filter("id = 0").first().text == "menu\n0\nfooter"
    assert out.filter("id = 7").first().text == "7"


def test_row_filters(spark):
    rows = spark.createDataFrame([("Essex is fine",), ("sussex",), ("ok",), (None,), ("nul\x00",), ("<div>",)], "text string")
    assert [r.text for r in curate.filter_bad_rows(rows, "text").collect()] == ["ok"]
    lines = spark.createDataFrame([("short\n" + "x" * 40 + "\n\n" + " " * 50 + "\n" + "y" * 2049,)], "text string")
    assert curate.filter_lines(lines, "text").first().text == "x" * 40


def test_line_filter_runs_after_dedup(spark):
    body = " ".join(["word"] * 90)
    rows = spark.createDataFrame([(1, body + "\na"), (2, body + "\nb"), (3, body + "\na"), (4, "few words")], "id int, text string")
    assert curate.curate_docs(rows, "id", "text").count() == 2
    assert curate.curate_docs(rows, "id", "text", final_dedup=True).count() == 1


def test_novelty_and_urls(spark):
    new = spark.createDataFrame(
        [("u1", ["s" * 150, "Xem thêm", "t" * 60]), ("u2", ["s" * 300]), ("u3", ["short"])], "url string, sentences array<string>"
    )
    known = spark.createDataFrame([("u2",), ("u2",)], "url string")
    got = curate.novel_pages(new, known, "url", "sentences").collect()
    assert [(r.url, r.content) for r in got] == [("u1", "s" * 150 + "\n" + "t" * 60)]
    urls = spark.createDataFrame([("http://a.org/2024/x",), ("http://b.org/2024/tag/x",), ("http://c.org/2023/x",)], "url string")
    assert [r.url for r in curate.filter_urls(urls, "url", ["c.org"], ["/tag/"], "2024").collect()] == ["http://a.org/2024/x"]


def test_splits_do_not_depend_on_partitions(spark):
    rows = spark.range(5000)
    one = curate.split_by_hash(rows.repartition(2), "id", {"train": 80, "valid": 10, "test": 10})
    two = curate.split_by_hash(rows.repartition(9), "id", {"train": 80, "valid": 10, "test": 10})
    assert one.exceptAll(two).count() == 0
    shares = {r.split: r["count"] / 5000 for r in one.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["test"] - 0.1) < 0.02
