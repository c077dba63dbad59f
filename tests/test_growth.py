"""Steps whose cost has to grow no faster than their input, on small odd tables."""

from __future__ import annotations

import duckdb
import pytest

from papyra.functions import text as tx
from papyra.functions import shapes
from papyra.operators import features, metrics, postings, search
from papyra.plans import load_all
from pyspark.sql import functions as F
from tests import oracle


@pytest.fixture()
def against_sql(spark, folder):
    """Compare a query with its SQL over tables given as rows."""

    def compare(name: str, **tables) -> int:
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
            con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
        entry = load_all()[name]
        df, cur = entry.run(spark, folder), con.execute(entry.sql)
        got = oracle.canonical(df.columns, df.collect())
        assert got == oracle.canonical([d[0] for d in cur.description], cur.fetchall())
        return len(got)

    return compare


TEXTS = [
    (1, "Tôi là giảng viên quyền, nghiêng! òa Qua gìn giữ đường"), (2, ""), (3, None), (4, "~~"), (5, "the the THE a\x02a~iêu\x01"),
    (6, "khuya uyên oai y"), (7, " "), (8, "ôÔ aia"),
]
DOCUMENTS = (TEXTS, "doc_id long, text string")


@pytest.mark.parametrize("name", ["d16_vowel_sequence", "d17_vowel_candidates"])
def test_vowel_units_of_odd_texts(against_sql, name):
    assert against_sql(name, documents=DOCUMENTS)


def test_a_syllable_is_cut_once():
    from papyra.functions import vowels

    cut = []
    known = vowels._Remembered(lambda s: cut.append(s) or vowels.syllable_units(s))
    assert [known[s] for s in ("quyền", "nghiêng", "quyền")] == [["qu", "yề", "n"], ["ngh", "iê", "ng"], ["qu", "yề", "n"]]
    assert cut == ["quyền", "nghiêng"]


def test_vowel_groups_are_counted_before_they_are_rows(spark):
    row = spark.range(1).select(tx.vowel_group_counts(F.lit("đi đi Đi xx")).alias("n")).first()
    assert sorted(map(tuple, row.n)) == [("D", 1), ("d", 2), ("i", 3)]


REPEATED = ([*TEXTS, (1, "the la the 12 USA the"), (None, "la the x"), (None, "the 3:30 x"), (9, "la x the")], "doc_id long, text string")


@pytest.mark.parametrize("name", ["e4_vocabulary_counts", "e4b_vocabulary", "e6_tfidf", "d11_word_shape", "j1_inverted_index"])
def test_terms_of_repeated_and_missing_keys(against_sql, name):
    assert against_sql(name, documents=REPEATED)


def test_terms_travel_once_a_batch(spark):
    """A word of every row is one row of a batch, not one row for each of them."""
    docs = spark.range(1000).repartition(2).select("id", F.array(F.lit("the"), F.lit("the"), F.concat(F.lit("w"), F.col("id") % 3)).alias("w"))
    found = postings.postings(docs, "id", "w")
    assert found.count() <= 2 * 4
    assert sorted(map(tuple, postings.totals(found).collect())) == [("the", 2000, 1000), ("w0", 334, 334), ("w1", 333, 333), ("w2", 333, 333)]
    for made in (features.tfidf(docs, "id", "w"), features.term_counts(docs, "id", "w"), search.build_index(docs.withColumn("t", F.array_join("w", " ")), "id", "t")):
        assert "hashpartitioning(id" not in made._jdf.queryExecution().executedPlan().toString()


def test_concepts_do_not_travel(spark):
    """Rows reach the place of their key before a broadcast dictionary makes them many."""
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (1, ["c", "a"])], "k long, w array<string>")
    words = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z"), ("c", "cc")], "word string, concept string")
    out = features.expand_concepts(rows, ["k"], "w", F.broadcast(words))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, sorted(r.concepts)) for r in out.collect()) == [(1, ["x", "x", "y", "y", "z"]), (2, ["z"])]
    assert "REPARTITION_BY_COL" in plan and plan.count("hashpartitioning(k") == 1


def test_only_wanted_shapes_are_tested(spark):
    tokens = ["the", "Anna", "USA", "12,5", "a.b.c", "x@y.de", "3:30", "86%", "", None, "Ł_ł", "–"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string")
    kept = ["email", "url", "date", "time", "number"]
    shape = shapes.word_shape(F.col("t"))
    plain = F.when(shape.isin(kept), F.concat(F.lit("<"), shape, F.lit(">"))).when(shape == "percentage", F.lit("<percent>")).otherwise(F.lower("t"))
    few = shapes.word_shape(F.col("t"), wanted={"lower", "capitalized"})
    same = F.when(shape.isin("lower", "capitalized"), shape).otherwise(F.lit(""))
    assert rows.filter(~shapes.placeholder(F.col("t")).eqNullSafe(plain) | (few != same)).count() == 0
    assert str(few).count("rlike") < str(shape).count("rlike")


def test_letters_are_compared_by_place(spark):
    rows = spark.createDataFrame([("a😀 é", "a😀 e"), ("ab", "a"), ("", "x"), (None, "x"), ("x", None)], "g string, p string")
    assert metrics.char_accuracy(rows, "g", "p").first()[0] == 3 / 5


def test_totals_leave_a_task_without_keys(spark):
    """The vocabulary asks for counts only: no list of keys is made and sent for them."""
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", None]), (2, ["c"]), (None, ["b"]), (3, None), (4, [])], "id long, w array<string>")
    counted = postings.postings(docs, "id", "w", listed=False)
    assert counted.columns == ["term", "tf", "df"]
    both = [sorted(map(str, postings.totals(p).collect())) for p in (counted, postings.postings(docs, "id", "w"))]
    assert both[0] == both[1] and len(both[0]) == 4
