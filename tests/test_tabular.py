from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.operators import metrics, models


def test_scores_are_made_once_for_an_area(spark):
    """Ranges, their sizes and the ranks are all taken from the written counts."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf(T.DoubleType())
    def score(i):
        seen.add(1)
        return float(i % 50)

    rows = spark.range(200, numPartitions=2).select((F.col("id") % 3 == 0).cast("int").alias("y"), score("id").alias("s"))
    got = metrics.auc(rows, "y", "s").first().auc
    assert seen.value == 200
    y = [(i % 50, i % 3 == 0) for i in range(200)]
    up, down = [s for s, p in y if p], [s for s, p in y if not p]
    assert abs(got - sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down)) < 1e-9


def test_models_of_several_kinds_are_those_fitted_alone(spark):
    rows = spark.range(300).select(
        (F.col("id") % 7 < 3).cast("int").alias("y"), F.concat(F.lit("c"), F.col("id") % 5).alias("c"), (F.col("id") % 11).cast("double").alias("x")
    )
    kinds = ["logistic", "perceptron"]
    together = models.fit_tabulars(rows, "y", ["c"], kinds, iterations=5)
    for kind, model in zip(kinds, together, strict=True):
        alone = models.fit_tabular(rows, "y", ["c"], kind, iterations=5)
        a, b = (models.score_column(rows, m).orderBy("x", "c").select("score").collect() for m in (alone, model))
        assert all(abs(p.score - q.score) < 1e-9 for p, q in zip(a, b, strict=True))
