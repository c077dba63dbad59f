"""Order-dependent building blocks that never put one key, or the whole table, into one task.

A window without keys, or over one very large key, would sort everything in a single
task. The functions here cut the order column into ranges by its own approximate
quantiles, count the rows per range, and add a running total of those few counts to a
row number (or sum) taken inside each range. Results are exact: quantiles only decide
where the cuts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Sampled text values per range; only the evenness of the ranges depends on it.
ROWS_PER_RANGE = 16


def _ranges(df: DataFrame) -> int:
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, 1 << (wanted - 1).bit_length())


def _position(bounds: Column, value: Column, ranges: int) -> Column:
    """Number of bounds below the value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(ranges.bit_length() - 2, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at),
    )


def _bounds(df: DataFrame, order: list[str], ranges: int) -> Column:
    """Values that cut the first column of ``order`` into ranges of about equal size.

    Numbers and times are cut by approximate quantiles. Text is cut at whole values: those of a
    bounded number of rows, the first by the hash of their order columns, so every evaluation
    takes the same ones, and rows that are alike count once.
    """
    column = order[0]
    if not isinstance(df.schema[column].dataType, T.StringType):
        shares = [i / ranges for i in range(1, ranges)]
        return df.agg(F.percentile_approx(F.col(column), shares, 4 * ranges)).scalar()
    rows = df.filter(F.col(column).isNotNull()).select(*order).distinct()
    picked = rows.orderBy(F.xxhash64(*order), *order).limit(ROWS_PER_RANGE * ranges)
    listed = picked.agg(F.sort_array(F.collect_list(column)).alias("_values"))
    at = F.sequence(F.lit(1), F.lit(ranges - 1))
    return listed.select(F.transform(at, lambda i: F.get("_values", F.floor(i * F.size("_values") / ranges).cast("int")))).scalar()


def with_order_bucket(df: DataFrame, order: list[str], name: str = "_range") -> DataFrame:
    """Add a range number that grows with the order columns (one, or two with a tie-break).

    Rows equal to a bound share one first value, so such a range, which may hold a very
    frequent value, is cut further by the second column.
    """
    ranges = _ranges(df)
    value = F.col(order[0])
    out = df.withColumn("_bounds", _bounds(df, order, ranges))
    out = out.withColumn(name, _position(F.col("_bounds"), value, ranges).cast("long"))
    if len(order) > 1:
        on_bound = F.coalesce(F.get("_bounds", F.col(name).cast("int")) == value, F.lit(False))
        second = _position(F.col("_second"), F.col(order[1]), ranges)
        out = out.withColumn("_second", _bounds(df, order[1:], ranges)).withColumn(
            name, F.col(name) * (ranges + 1) + F.when(on_bound, second + 1).otherwise(0)
        ).drop("_second")
    return out.drop("_bounds")


def _before(keys: list[str], order: str):
    window = W.partitionBy(*keys) if keys else W.partitionBy()
    return window.orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add the key as one struct, which joins and groups null keys like any other."""
    return df.withColumn("_key", F.struct(*keys) if keys else F.lit(0))


def row_index(df: DataFrame, keys: list[str], order: list[str], name: str = "_rn") -> DataFrame:
    """Exact 0-based row number within ``keys`` by ``order``."""
    cut = _keyed(with_order_bucket(df, order), keys)
    sizes = cut.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_key", "_range", F.coalesce(F.sum("_n").over(_before(["_key"], "_range")), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(W.partitionBy("_key", "_range").orderBy(*order))
    return (
        cut.join(offsets, ["_key", "_range"])
        .withColumn(name, F.col("_offset") + inside - 1)
        .drop("_key", "_range", "_offset")
    )


def running_total(df: DataFrame, order: list[str], amount: str, name: str = "_before") -> DataFrame:
    """Sum of ``amount`` over all earlier rows of the whole table."""
    cut = with_order_bucket(df, order)
    sizes = cut.groupBy("_range").agg(F.sum(amount).alias("_n"))
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_n").over(_before([], "_range")), F.lit(0)).alias("_offset")
    )
    inside = F.sum(amount).over(
        W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        cut.join(offsets, "_range")
        .withColumn(name, F.col("_offset") + F.coalesce(inside, F.lit(0)))
        .drop("_range", "_offset")
    )


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """``(value, ties, below)``: rows with the value and rows with a smaller one, nulls apart."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("ties"))
    return running_total(counted, [value], "ties", "below")


def with_neighbours(
    df: DataFrame, keys: list[str], order: list[str], before: int, after: int, chunk: int = 100_000
) -> DataFrame:
    """Rows in chunks of bounded size, each chunk holding copies of the rows next to it.

    Adds ``_rn``, ``_chunk`` and ``_home``. A window over ``neighbourhood(keys)`` sees up
    to ``before`` earlier and ``after`` later rows; ``at_home`` then drops the copies.
    """
    chunk = max(chunk, before + after)
    rows = row_index(df, keys, order).withColumn("_home", F.floor(F.col("_rn") / chunk))
    place = F.col("_rn") % chunk
    copies = F.array_compact(
        F.array(
            F.col("_home"),
            F.when(place >= chunk - before, F.col("_home") + 1),
            F.when((place < after) & (F.col("_home") > 0), F.col("_home") - 1),
        )
    )
    return rows.withColumn("_chunk", F.explode(copies))


def neighbourhood(keys: list[str]):
    return W.partitionBy(*keys, "_chunk").orderBy("_rn")


def at_home(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home", "_rn")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Fill nulls with the latest earlier value of the same key."""
    cut = _keyed(with_order_bucket(df, order), keys)
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    lasts = cut.groupBy("_key", "_range").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_last_{c}") for c in columns]
    )
    carried = lasts.select(
        "_key",
        "_range",
        *[F.last(f"_last_{c}", True).over(_before(["_key"], "_range")).alias(f"_carry_{c}") for c in columns],
    )
    inside = W.partitionBy("_key", "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = cut.join(carried, ["_key", "_range"])
    for c in columns:
        out = out.withColumn(f"_fill_{c}", F.coalesce(F.last(c, True).over(inside), F.col(f"_carry_{c}")))
    drops = ["_key", "_range", *columns, *[f"_carry_{c}" for c in columns]]
    out = out.drop(*drops)
    for c in columns:
        out = out.withColumnRenamed(f"_fill_{c}", c)
    return out
