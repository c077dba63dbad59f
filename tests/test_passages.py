"""Documents that hold a passage as a substring, by words and by parts of words."""

from __future__ import annotations

from papyra.plans.retrieval import stored_index
from papyra.plans.scoring import contained_passages
from papyra.operators import features

TEXTS = ["concat satisfied cats", "a cat sat here", "nothing", "the cat", "", None]
PASSAGES = ["cat sat", "cat", "t satisfied c", "oth", "?!", "dog", "", None]


def test_passages_may_begin_and_end_inside_words(spark, folder):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(PASSAGES)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {(r.qid, r.doc_id) for r in contained_passages(spark, folder, stored_index(spark, folder)).collect()}
    wanted = {(q, d) for q, p in enumerate(PASSAGES) for d, t in enumerate(TEXTS) if p and t and p in t and any(map(str.isalnum, p))}
    assert got == wanted


def test_tfidf_of_a_word_in_every_document(spark):
    rows = spark.createDataFrame([(i, ["the", f"w{i % 3}"]) for i in range(30)], "k long, w array<string>")
    got = {(r.term, round(r.weight, 6)) for r in features.tfidf(rows, "k", "w").collect()}
    assert {t for t, _ in got} == {"the", "w0", "w1", "w2"} and ("the", 0.0) in got
