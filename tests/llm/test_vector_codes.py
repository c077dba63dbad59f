"""Vector codes against plain rounds over all distances, and the SQL twin."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from papyra.llm import queries, vector_codes

SF = "/root/testdata/sf0.01"


def plain(rows, entries=256, rounds=4):
    kept = [(i, np.array([math.floor(1024 * x) for x in v], np.int64), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    vectors = np.array([r[1] for r in kept])
    books, codes, errors = [], [], 0
    for x in np.split(vectors, 4, axis=1):
        book = x[:entries].copy()
        for turn in range(rounds + 1):
            square = ((x[:, None, :] - book[None]) ** 2).sum(2)
            own = square.argmin(1)
            for j in set(own.tolist()) if turn < rounds else ():
                book[j] = x[own == j].sum(0) // (own == j).sum()
        books.append(book), codes.append(own)
        errors = errors + square.min(1)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    total = {}
    for r, e in zip(kept, errors, strict=True):
        total[r[2]] = total.get(r[2], 0) + int(e)
    return sorted(((r[0], "".join(f"{c[i]:02x}" for c in codes), int(errors[i]), total[r[2]], digest) for i, r in enumerate(kept)), key=str)


def coded(df, **sizes):
    return sorted((tuple(r) for r in vector_codes.vector_codes(df, **sizes).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("b", [1, 16, 64])
def test_equals_plain_rounds_for_any_list_length(spark, b):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert coded(df, b=b) == plain([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])


ODD = "vec_id long, embedding array<double>, label int, id long, vec array<int>, code string, error int, _label int"


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(700):
        v = [float(x) for x in rng.integers(-2, 3, 8) / 1024]  # few values: many ties
        v = None if i % 31 == 0 else [None, *v[1:]] if i % 31 == 1 else [float("nan"), *v[1:]] if i % 31 == 2 else [float("inf"), *v[1:]] if i % 31 == 3 else v
        rows.append((None if i % 17 == 0 else i // 2, v, None if i % 3 == 0 else i % 5, 1, [1], "x", 2, 3))
    rows += rows[:90]
    assert coded(spark.createDataFrame(rows, ODD), b=4) == plain([r[:3] for r in rows])
    few = rows[4:9]  # fewer vectors than entries
    assert coded(spark.createDataFrame(few, ODD)) == plain([r[:3] for r in few])


def test_empty_other_widths_and_large_components(spark):
    assert coded(spark.createDataFrame([], ODD)) == []
    rows = [(i, [i / 7, 1.0, 2.0, 3.0], None, 1, [1], "x", 2, 3) for i in range(5)] + [(9, [], 1, 1, [1], "x", 2, 3), (10, [1.0, 2.0], 1, 1, [1], "x", 2, 3)]
    found = coded(spark.createDataFrame(rows, ODD))
    assert [r[:3] for r in found if r[0] > 8] == [(10, None, None), (9, None, None)] or {r[:3] for r in found if r[0] > 8} == {(9, None, None), (10, None, None)}
    assert [r[:2] for r in found if r[0] < 9] == [r[:2] for r in plain([r[:3] for r in rows[:5]])]
    none = spark.createDataFrame([(1, [], 1, 1, [1], "x", 2, 3)], ODD)
    assert [r[1] for r in coded(none)] == [None]
    with pytest.raises(Exception, match="too large"):
        coded(spark.createDataFrame([(1, [1e9] * 8, 1, 1, [1], "x", 2, 3)], ODD))


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(11)
    vectors, book = rng.integers(-900, 900, (400, 16)), rng.integers(-900, 900, (256, 16))
    state, needed = vector_codes.closest(vectors, book, 12), []
    for turn in range(4):
        new = book + rng.integers(-60 // (turn + 1), 60 // (turn + 1) + 1, book.shape)
        way = np.sqrt(((new - book) ** 2).sum(1)) * vector_codes.UP
        b = (12, 20, 6, 6)[turn]
        *state, need = vector_codes.reassign(vectors, new, state[0], state[1], state[2], way, b)
        book = new
        true = vector_codes.squares(vectors, book)
        entry, low, outer, error = state
        assert (error == true.min(1)).all() and (entry[:, 0] == true.argmin(1)).all()
        inside = np.isfinite(low)
        rows = np.nonzero(inside)[0]
        assert (low[inside] <= np.sqrt(true[rows, entry[inside]])).all()
        outside = np.ones(true.shape, bool)
        outside[rows, entry[inside]] = False
        assert (outer <= np.sqrt(np.where(outside, true, np.iinfo(np.int64).max).min(1))).all()
        needed.append((need < 0).mean())
    assert needed[-1] < 1  # some parts were settled by their bounds
    small, unit = vector_codes.squeeze(np.array([[0.0, 1.2345, 777.77, np.inf, -3.0]]))
    back = np.frombuffer(small, np.float16).astype(float) * unit
    assert (back <= [0.0, 1.2345, 777.77, np.inf, 0.0]).all() and back[3] == np.inf and back[2] > 776


def test_sql_twin(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    twin = con.sql(queries.SQL["op13_vector_codes"])
    want = sorted(twin.fetchall(), key=str)
    got = queries.op13(spark, SF).select(*twin.columns).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
