"""Ordered helpers on skewed data: one key, or one value, holds most of the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from papyra.operators import dialog, features, metrics, ordered, series


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 6000
    key = np.where(rng.random(n) < 0.6, 1, rng.integers(2, 40, n))
    t = np.where(rng.random(n) < 0.3, 500, rng.integers(0, 2000, n))
    frame = pd.DataFrame({"k": key, "t": t, "id": rng.permutation(n), "v": np.round(rng.random(n) * 50)})
    frame.loc[frame.id % 11 == 0, "v"] = np.nan
    rows = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    rows = rows.withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    return rows.repartition(7).cache(), frame


def test_row_index(skewed):
    rows, _ = skewed
    got = ordered.row_index(rows, ["k"], ["t", "id"]).toPandas()
    assert len(got) == 6000
    for _, group in got.groupby("k", dropna=False):
        assert (group.sort_values(["t", "id"])["_rn"].to_numpy() == np.arange(len(group))).all()


def test_row_index_over_the_whole_table(skewed):
    rows, _ = skewed
    got = ordered.row_index(rows, [], ["t", "id"]).toPandas().sort_values(["t", "id"])
    assert (got["_rn"].to_numpy() == np.arange(6000)).all()


def test_hot_value_is_cut_by_the_second_column(skewed):
    rows, _ = skewed
    sizes = ordered.with_order_bucket(rows, ["t", "id"]).groupBy("_range").count().toPandas()["count"]
    assert sizes.max() < 6000 * 0.15  # a third of the rows share one first value


def test_neighbours_reach_over_chunks(skewed):
    rows, _ = skewed
    near = ordered.with_neighbours(rows, ["k"], ["t", "id"], before=3, after=2, chunk=16)
    window = ordered.neighbourhood(["k"])
    got = ordered.at_home(
        near.withColumn("a", F.lag("id", 3).over(window)).withColumn("b", F.lead("id", 2).over(window))
    ).toPandas()
    assert len(got) == 6000
    for _, group in got.groupby("k", dropna=False):
        group = group.sort_values(["t", "id"])
        assert group["id"].shift(3).equals(group["a"].astype("float64"))
        assert group["id"].shift(-2).equals(group["b"].astype("float64"))


def test_carry_forward(skewed):
    rows, _ = skewed
    got = ordered.carry_forward(rows, ["k"], ["t", "id"], ["v"]).toPandas()
    source = rows.toPandas()
    merged = got.merge(source, on="id", suffixes=("", "_raw"))
    for _, group in merged.groupby("k", dropna=False):
        group = group.sort_values(["t", "id"])
        assert group["v_raw"].ffill().reset_index(drop=True).equals(group["v"].reset_index(drop=True))


def test_value_ranks_and_flags(skewed):
    rows, _ = skewed
    got = series.extreme_flag(rows, "v", 0.9).toPandas()
    assert len(got) == 6000
    wanted = got["v"].rank(pct=True)
    assert np.allclose(got["rank"].astype(float), wanted, equal_nan=True)


def test_auc(skewed):
    rows, frame = skewed
    scored = rows.filter("v is not null").withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    local = scored.toPandas()
    positive, negative = local[local.y == 1].v.to_numpy(), local[local.y == 0].v.to_numpy()
    pairs = (positive[:, None] > negative).sum() + 0.5 * (positive[:, None] == negative).sum()
    assert metrics.auc(scored, "y", "v").first().auc == pytest.approx(pairs / (len(positive) * len(negative)))


def test_rolling_and_lead(skewed):
    rows, _ = skewed
    full = rows.withColumn("v", F.coalesce("v", F.lit(0.0)))
    local = full.toPandas()
    got = {r.id: (list(r.x), list(r.y)) for r in series.rolling_samples(full, "k", "t", "v", 4, 2, tie="id").collect()}
    lead = {r.id: (list(r.x), r.y_raw) for r in series.lead_features(full, "k", "t", "v", ["v"], 3, tie="id").collect()}
    wanted, wanted_lead = {}, {}
    for _, group in local.groupby("k", dropna=False):
        group = group.sort_values(["t", "id"])
        ids, v = group["id"].tolist(), group["v"].tolist()
        for i in range(len(v)):
            if i >= 3 and i + 2 < len(v):
                wanted[ids[i]] = (v[i - 3 : i + 1], v[i + 1 : i + 3])
            if i + 3 < len(v):
                wanted_lead[ids[i]] = (v[i : i + 3], v[i + 3])
    assert got == wanted
    assert lead == wanted_lead


def test_lm_windows(spark):
    lengths = [0, 1, 5, 0, 13, 2, 40, 3]
    rows = spark.createDataFrame([(i, list(range(i * 100, i * 100 + n))) for i, n in enumerate(lengths)], "k int, ids array<int>")
    stream = [x for i, n in enumerate(lengths) for x in range(i * 100, i * 100 + n)]
    got = {r.window: list(r.ids) for r in features.lm_windows(rows, "k", "ids", 4).collect()}
    wanted = {at // 4: stream[at : at + 5] for at in range(0, len(stream) - 4, 4)}
    assert got == wanted


def test_act_history(spark):
    rows = spark.createDataFrame(
        [("d", str(t), [f"a{t}"] if t != 4 else ["x", "y"]) for t in (0, 1, 2, 4, 10, 11)], "dialogue_id string, turn_id string, acts array<string>"
    )
    got = {r.turn_id: r.prev_acts for r in dialog.act_history(rows).collect()}
    assert got == {"0": "", "1": "a0", "2": "a0 a1", "4": "a0 a1 a2", "10": "a1 a2 x y", "11": "a2 x y a10"}


def test_dedup_impute(spark):
    rows = spark.sql(
        """select * from values (1, timestamp'2024-01-01 22:10:00', 5.0, 2), (1, timestamp'2024-01-01 22:20:00', 4.0, 1),
        (1, timestamp'2024-01-02 01:00:00', 7.0, 3), (2, timestamp'2024-01-01 00:00:00', 1.0, 4) as t(k, ts, v, id)"""
    )
    got = [(r.k, r.step.hour, r.v) for r in series.dedup_impute(rows, "k", "ts", "v", "id", 3600).orderBy("k", "step").collect()]
    assert got == [(1, 22, 4.0), (1, 23, 4.0), (1, 0, 4.0), (1, 1, 7.0), (2, 0, 1.0)]


def test_text_order_columns(spark, skewed):
    rows, _ = skewed
    named = rows.withColumn("name", F.concat(F.when(F.col("k") == 1, "doc-").otherwise("é-"), F.lpad("id", 5, "0"), F.lit("x")))
    got = ordered.row_index(named, ["k"], ["name"]).toPandas()
    assert len(got) == 6000
    for _, group in got.groupby("k", dropna=False):
        ordered_names = sorted(group["name"], key=lambda s: s.encode())
        assert group.sort_values("_rn")["name"].tolist() == ordered_names
    by_tie = ordered.row_index(named, [], ["t", "name"]).toPandas()
    wanted = sorted(zip(by_tie["t"], by_tie["name"]), key=lambda x: (x[0], x[1].encode()))
    assert list(zip(by_tie.sort_values("_rn")["t"], by_tie.sort_values("_rn")["name"])) == wanted


def test_text_with_a_common_prefix_is_cut_into_ranges(spark):
    rows = spark.range(5000).select(F.concat(F.lit("https://example.org/page/"), F.lpad("id", 6, "0")).alias("url"), "id")
    sizes = ordered.with_order_bucket(rows, ["url"]).groupBy("_range").count().toPandas()["count"]
    assert len(sizes) == 16 and sizes.max() < 5000 / 4
    got = ordered.row_index(rows, [], ["url"]).toPandas()
    assert (got["_rn"] == got["id"]).all()


def test_hot_text_is_cut_by_the_second_column(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("w"), F.lpad("id", 5, "0"))).alias("t"), "id")
    sizes = ordered.with_order_bucket(rows, ["t", "id"]).groupBy("_range").count().toPandas()["count"]
    assert sizes.max() < 5000 * 0.15
