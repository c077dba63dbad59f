import pytest
from pyspark.sql import functions as F

from papyra.operators import features, models

PLAIN = dict(unknown=1, pad=1, base=1)


def plain(df, vocab, length, concepts):
    """Every concept of every token as a row."""
    both = df.withColumn("_tokens", F.concat("a", "b"))
    related = features.expand_concepts(both, ["k"], "_tokens", concepts)
    out = features.to_index_sequence(both, "k", "_tokens", vocab, 2 * length, out="_a", **PLAIN)
    out = out.join(related, "k", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    out = features.to_index_sequence(out, "k", "concepts", features.vocabulary(related, "k", "concepts"), 2 * length, out="_b", **PLAIN)
    n = vocab.count()
    return out.select("k", F.concat("_a", F.transform("_b", lambda i: F.when(i > 1, i + n).otherwise(i))).alias("features"))


@pytest.fixture()
def pairs(spark):
    word = lambda i, k: None if (i + k) % 31 == 0 else f"{'abc'[(i * k) % 3]}{(i * i + k) % 11}"
    rows = [(k, [word(i, k) for i in range(k * 3 % 50)], [word(i, k + 1) for i in range(k % 7)]) for k in range(40)]
    rows += [(50, ["none"] * 30 + ["a1", "b1"], ["c2"] * 3), (51, ["none"] * 30, []), (52, [], []), (53, None, ["a1"])]
    return spark.createDataFrame(rows, "k long, a array<string>, b array<string>")


@pytest.fixture()
def concepts(spark):
    found = [(f"{c}{i}", f"{'xyz'[(i + j) % 3]}{i % 4}") for c in "abc" for i in range(9) for j in range(i % 3)]
    return spark.createDataFrame([*found, ("a1", "a12"), ("b2", None), (None, "x"), ("c2", "x0"), ("c2", "x0")], "word string, concept string")


def test_concepts_of_pairs_are_those_of_all_tokens(spark, pairs, concepts):
    df = pairs.union(spark.createDataFrame([(None, ["a5"] * 9, ["a1"])], pairs.schema))
    vocab = features.vocabulary(df, "k", "a")
    got = models.pair_features(df, "k", "a", "b", vocab, 3, "concept", concepts).select("k", "features")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain(df, vocab, 3, concepts).collect()))


def test_rows_of_a_repeated_key_are_one(spark, pairs, concepts):
    """Their concepts stand in the order of their places, each as often as its tokens; copies do not multiply them."""
    df = pairs.union(spark.createDataFrame([(50, ["b4", "a5"], ["a1"])], pairs.schema))
    known, found = features.concept_ids(df.withColumn("w", F.concat("a", "b")), "k", "w", concepts, 5)
    names = {r.term_id: r.term for r in known.collect()}
    listed = {r.k: r.concepts for r in features.expand_concepts(df.withColumn("w", F.concat("a", "b")), ["k"], "w", concepts).collect()}
    assert {r.k: [names[i] for i in r.ids] for r in found.collect()} == {k: c[:5] for k, c in listed.items()}


def test_only_tokens_that_can_matter_become_rows(spark, pairs, concepts, monkeypatch):
    made, real = [], features.unnest

    def counted(*args, **kw):
        made.append(real(*args, **kw))
        return made[-1]

    vocab = features.vocabulary(pairs, "k", "a")
    monkeypatch.setattr(features, "unnest", counted)
    models.pair_features(pairs, "k", "a", "b", vocab, 1, "concept", concepts).collect()
    tokens = sum(len(r.a or []) + len(r.b) for r in pairs.collect() if r.a is not None)
    assert sum(m.count() for m in made) < tokens
