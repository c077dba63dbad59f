"""Time series and tabular preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.operators import ordered


def lead_features(
    df: DataFrame, key: str, ts: str, target: str, columns: list[str], lead: int = 3, tie: str | None = None
) -> DataFrame:
    """Columns of the next ``lead`` rows as ``x``, the target ``lead`` rows ahead as ``y`` / 1000."""
    order = [ts] if tie is None else [ts, tie]
    near = ordered.with_neighbours(df, [key], order, before=0, after=lead)
    window = ordered.neighbourhood([key])
    out = near.withColumn("y_raw", F.lead(target, lead).over(window))
    now = F.array(*columns)
    parts = [now] + [F.lead(now, k).over(window) for k in range(1, lead)]
    for k, part in enumerate(parts):
        out = out.withColumn(f"_x{k}", part)
    out = ordered.at_home(out).filter("y_raw is not null")
    x = F.concat(*[f"_x{k}" for k in range(lead)])
    return out.select(key, *order, x.alias("x"), "y_raw", (F.col("y_raw") / 1000).alias("y"))


def rolling_samples(
    df: DataFrame, key: str, ts: str, value: str, lookback: int, horizon: int, tie: str | None = None
) -> DataFrame:
    """Arrays of the last ``lookback`` and the next ``horizon`` values; full windows only."""
    order = [ts] if tie is None else [ts, tie]
    near = ordered.with_neighbours(df, [key], order, before=lookback - 1, after=horizon)
    window = ordered.neighbourhood([key])
    out = near.withColumn("x", F.collect_list(value).over(window.rowsBetween(-(lookback - 1), 0))).withColumn(
        "y", F.collect_list(value).over(window.rowsBetween(1, horizon))
    )
    return ordered.at_home(out).filter((F.size("x") == lookback) & (F.size("y") == horizon)).select(key, *order, "x", "y")


def dedup_impute(df: DataFrame, key: str, ts: str, value: str, tie: str, seconds: int) -> DataFrame:
    """One value per key and step of ``seconds``; missing steps repeat the latest value.

    Of several rows in a step the one with the smallest ``tie`` counts. Steps are laid out
    day by day, so that no row ever holds the whole calendar of a key.
    """
    step = F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)
    single = df.groupBy(key, step.alias("step")).agg(F.min_by(value, tie).alias(value))
    limits = single.groupBy(key).agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    days = limits.select(key, "lo", "hi", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("day"))
    midnight = F.unix_timestamp(F.col("day").cast("timestamp"))
    from_s = F.greatest(midnight, F.unix_timestamp("lo"))
    first = F.ceil(from_s / seconds) * seconds
    last = F.least(midnight + 86399, F.unix_timestamp("hi"))
    steps = F.when(first <= last, F.sequence(first, last, F.lit(seconds).cast("long")))
    calendar = days.select(key, F.explode(steps).alias("_s")).select(key, F.timestamp_seconds("_s").alias("step"))
    full = calendar.join(single, [key, "step"], "left")
    return ordered.carry_forward(full, [key], ["step"], [value])


def date_features(df: DataFrame, ts: str) -> DataFrame:
    t = F.col(ts)
    parts = {
        "minute": F.minute(t), "hour": F.hour(t), "day": F.dayofmonth(t), "day_of_week": F.weekday(t),
        "day_of_year": F.dayofyear(t), "week_of_year": F.weekofyear(t), "month": F.month(t), "year": F.year(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
    }
    return df.select("*", *[c.alias(n) for n, c in parts.items()])


def fit_scale(train: DataFrame, others: list[DataFrame], columns: list[str]) -> list[DataFrame]:
    """Standardise every frame with the mean and deviation of the training frame."""
    parts = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    stats = train.agg(F.struct(*parts)).scalar()
    scaled = [((F.col(c) - stats[f"{c}_mean"]) / stats[f"{c}_std"]).alias(f"{c}_scaled") for c in columns]
    return [frame.select("*", *scaled) for frame in [train, *others]]


def unscale(train: DataFrame, column: str, scaled: Column) -> Column:
    """Scaled values back in the units of the training column."""
    return scaled * train.agg(F.stddev_pop(column)).scalar() + train.agg(F.avg(column)).scalar()


def time_split(df: DataFrame, ts: str, ratios: dict[str, float]) -> DataFrame:
    """Label rows by their place in time: the first share is the first split, and so on."""
    numbered = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    ranks = ordered.value_ranks(numbered, "_t")
    total = df.agg(F.count(F.lit(1))).scalar()
    share = F.col("below") / F.greatest(total - 1, F.lit(1))
    upper, label, names = 0.0, F, list(ratios)
    for name in names[:-1]:
        upper += ratios[name]
        label = label.when(share < upper, F.lit(name))
    label = F.when(share.isNotNull(), label.otherwise(F.lit(names[-1])) if len(names) > 1 else F.lit(names[0]))
    return numbered.join(ranks, "_t", "left").withColumn("split", label).drop("_t", "ties", "below")


def extreme_flag(df: DataFrame, value: str, q: float = 0.9) -> DataFrame:
    """Percentile rank (ties share their mean rank) and 1 where it reaches ``q``."""
    ranks = ordered.value_ranks(df, value)
    total = df.agg(F.count(value)).scalar()
    rank = (F.col("below") + (F.col("ties") + 1) / 2) / total
    return df.join(ranks, value, "left").withColumn("rank", rank).withColumn("extreme", (rank >= q).cast("int")).drop("ties", "below")


def join_series(frames: list[DataFrame], on: list[str]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, on)
    return out


def date_of(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


def slice_year(df: DataFrame, ts: str, year: int) -> DataFrame:
    """Rows of one year, as a range on the column so that file statistics can prune."""
    lo, hi = F.lit(f"{year}-01-01").cast("timestamp"), F.lit(f"{year + 1}-01-01").cast("timestamp")
    return df.filter((F.col(ts) >= lo) & (F.col(ts) < hi))


def weight_clip_threshold(
    df: DataFrame, label: str, score: str, positive_weight: float = 9.0, threshold: float = 0.5
) -> DataFrame:
    """Class weight, clipped score, and the 0/1 call after a sigmoid."""
    s = F.col(score)
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(positive_weight)).otherwise(F.lit(1.0))).withColumn(
        "clipped", F.greatest(s, F.lit(0.0))
    ).withColumn("call", (1 / (1 + F.exp(-s)) >= threshold).cast("int"))
