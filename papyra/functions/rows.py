"""Array columns to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, values: Column | str, name: str, pos: str | None = None) -> DataFrame:
    """One row per element, with its 0-based place if ``pos`` is given.

    A plain ``explode`` makes the optimizer add a filter on the size of the array, and an
    array that is costly to compute is then computed twice. The outer form is not touched.
    """
    place = pos or "_place"
    out = df.select(*keep, F.posexplode_outer(values).alias(place, name)).filter(F.col(place).isNotNull())
    return out if pos else out.drop(place)


def unnest_structs(df: DataFrame, keep: list, values: Column | str) -> DataFrame:
    """One row per struct element, its fields as columns."""
    names = [k if isinstance(k, str) else None for k in keep]
    if None in names:
        raise ValueError("keep takes column names")
    return unnest(df, keep, values, "_item").select(*names, "_item.*")
