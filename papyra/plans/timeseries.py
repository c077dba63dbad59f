"""Queries for series and tabular preparation over events, orders and lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import curate, series
from papyra.plans.registry import query, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")




def _joined(values):
    return F.array_join(F.transform(values, lambda v: F.format_string("%.2f", v)), " ")


JOINED = "array_to_string(list_transform({0}, lambda v: printf('%.2f', v)), ' ')"


@query(
    "i1_lead_features",
    f"""with w as (select user_id, ts, event_id, value, event_id % 10 * 1.0 as vol, lead(value, 1) over o as v1, lead(event_id % 10 * 1.0, 1) over o as u1,
    lead(value, 2) over o as v2, lead(event_id % 10 * 1.0, 2) over o as u2, lead(value, 3) over o as y from events
    window o as (partition by user_id order by ts, event_id))
    select user_id, event_id, {JOINED.format('[value, vol, v1, u1, v2, u2]')} as x, y as y_raw, round(y / 1000, 6) as y from w where y is not null""",
)
def lead_features(spark, sf_dir):
    events = _events(spark, sf_dir).withColumn("vol", (F.col("event_id") % 10).cast("double"))
    out = series.lead_features(events, "user_id", "ts", "value", ["value", "vol"], 3, tie="event_id")
    return out.select("user_id", "event_id", _joined("x").alias("x"), "y_raw", F.round("y", 6).alias("y"))


@query(
    "i2_rolling_samples",
    f"""with w as (select user_id, event_id, list(value) over (o rows between 6 preceding and current row) as x,
    list(value) over (o rows between 1 following and 2 following) as y from events window o as (partition by user_id order by ts, event_id))
    select user_id, event_id, {JOINED.format('x')} as x, {JOINED.format('y')} as y from w where len(x) = 7 and len(y) = 2""",
)
def rolling_samples(spark, sf_dir):
    out = series.rolling_samples(_events(spark, sf_dir), "user_id", "ts", "value", 7, 2, tie="event_id")
    return out.select("user_id", "event_id", _joined("x").alias("x"), _joined("y").alias("y"))


@query(
    "i3_dedup_impute",
    """with s as (select event_type, time_bucket(interval '1 hour', ts) as step, min_by(value, event_id) as value from events group by 1, 2),
    l as (select event_type, min(step) as lo, max(step) as hi from s group by 1),
    c as (select event_type, unnest(generate_series(lo, hi, interval '1 hour')) as step from l),
    j as (select c.event_type, c.step, s.value from c left join s on c.event_type = s.event_type and c.step = s.step)
    select event_type, step, last_value(value ignore nulls) over (partition by event_type order by step rows between unbounded preceding and current row) as value from j""",
)
def dedup_impute(spark, sf_dir):
    return series.dedup_impute(_events(spark, sf_dir), "event_type", "ts", "value", "event_id", 3600).select(
        "event_type", "step", "value"
    )


@query(
    "i4_date_features",
    """select event_id, minute(ts) as minute, hour(ts) as hour, day(ts) as day, isodow(ts) - 1 as day_of_week, dayofyear(ts) as day_of_year,
    weekofyear(ts) as week_of_year, month(ts) as month, year(ts) as year, cast(isodow(ts) >= 6 as int) as is_weekend from events""",
)
def date_features(spark, sf_dir):
    return series.date_features(_events(spark, sf_dir).select("event_id", "ts"), "ts").drop("ts")


@query(
    "i5_fit_scale",
    """with s as (select avg(value) as m, stddev_pop(value) as d from events where event_id % 5 <> 0)
    select event_id, round((value - m) / d, 6) as value_scaled, round(value, 4) as back from events, s""",
)
def fit_scale(spark, sf_dir):
    events = _events(spark, sf_dir)
    train, test = events.filter("event_id % 5 <> 0"), events.filter("event_id % 5 = 0")
    scaled = curate.union_all(series.fit_scale(train, [test], ["value"]))
    back = series.unscale(train, "value", F.col("value_scaled"))
    return scaled.select("event_id", F.round("value_scaled", 6).alias("value_scaled"), F.round(back, 4).alias("back"))


@query(
    "i6_ordered_split",
    """select o_orderkey, case when percent_rank() over (order by o_orderdate) < 0.8 then 'train'
    when percent_rank() over (order by o_orderdate) < 0.9 then 'valid' else 'test' end as split from orders""",
)
def ordered_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    out = series.time_split(orders, "o_orderdate", {"train": 0.8, "valid": 0.1, "test": 0.1})
    return out.select("o_orderkey", "split")


@query(
    "i7_extreme_flag",
    """with r as (select event_id, (rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0)
    / (select count(*) from events) as rank from events)
    select event_id, round(rank, 6) as rank, cast(rank >= 0.9 as int) as extreme from r""",
)
def extreme_flag(spark, sf_dir):
    out = series.extreme_flag(_events(spark, sf_dir), "value", 0.9)
    return out.select("event_id", F.round("rank", 6).alias("rank"), "extreme")


@query(
    "i8_column_join",
    """with a as (select cast(o_orderdate as date) as day, count(*) as orders, round(sum(o_totalprice), 2) as total from orders group by 1),
    b as (select cast(l_shipdate as date) as day, count(*) as lines from lineitem group by 1),
    c as (select cast(l_shipdate as date) as day, round(avg(l_quantity), 4) as quantity from lineitem group by 1)
    select day, orders, total, lines, quantity from a join b using (day) join c using (day)""",
)
def column_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    dated = orders.withColumn("day", series.date_of(F.year(d), F.month(d), F.dayofmonth(d)))
    a = dated.groupBy("day").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    b = lines.groupBy("day").agg(F.count(F.lit(1)).alias("lines"))
    c = lines.groupBy("day").agg(F.round(F.avg("l_quantity"), 4).alias("quantity"))
    return series.join_series([a, b, c], ["day"])


@query("i9_year_slice", "select o_orderkey, o_totalprice from orders where year(o_orderdate) = 1998")
def year_slice(spark, sf_dir):
    return series.slice_year(table(spark, sf_dir, "orders"), "o_orderdate", 1998).select("o_orderkey", "o_totalprice")


@query(
    "i10_weight_clip_threshold",
    """with e as (select event_id, cast(event_type = 'error' as int) as y, value - 20 as s from events)
    select event_id, case when y = 1 then 9.0 else 1.0 end as weight, round(greatest(s, 0), 4) as clipped,
    cast(1 / (1 + exp(-s)) >= 0.5 as int) as call from e""",
)
def weight_clip_threshold(spark, sf_dir):
    rows = _events(spark, sf_dir).select(
        "event_id", (F.col("event_type") == "error").cast("int").alias("y"), (F.col("value") - 20).alias("s")
    )
    out = series.weight_clip_threshold(rows, "y", "s")
    return out.select("event_id", "weight", F.round("clipped", 4).alias("clipped"), "call")
