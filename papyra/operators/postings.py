"""Terms of a table with the rows that hold them, gathered where the rows lie.

The tokens of an Arrow batch are grouped by term before anything is shuffled: a term travels once a
batch, with the keys of its rows behind it, instead of once a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.rows import unnest_structs


def postings(df: DataFrame, key: str, tokens: Column | str, unique: bool = False, listed: bool = True) -> DataFrame:
    """``(term, tf, df, keys, ns)``: a term, once for each batch that has it, its occurrences, its rows, their keys and counts.

    A key lies in one batch only, so ``tf`` and ``df`` add up over batches. Rows of a repeated key are put
    together first; ``unique`` says that there are none. Where ``listed`` is false, no keys and counts stand
    behind a term, for those who want totals only.
    """
    rows = df.select(key, (F.col(tokens) if isinstance(tokens, str) else tokens).alias("_tokens"))
    if not unique and df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).count():
        rows = rows.groupBy(key).agg(F.flatten(F.collect_list("_tokens")).alias("_tokens"))
    kind = rows.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("df", T.LongType()),
            T.StructField("keys", T.ArrayType(kind)), T.StructField("ns", T.ArrayType(T.LongType())),
        ]
    )
    if not listed:
        schema = T.StructType(schema.fields[:3])
    return rows.mapInArrow(_gather(schema.names), schema)


def _gather(names: list[str]) -> Callable:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.columns
            terms = lists.flatten().dictionary_encode(null_encoding="encode")
            if not len(terms):
                continue
            place = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            cells, counts = np.unique(terms.indices.to_numpy(zero_copy_only=False) * np.int64(len(keys)) + place, return_counts=True)
            term, row = np.divmod(cells, len(keys))
            first = np.flatnonzero(np.diff(term, prepend=-1))
            ends = pa.array(np.append(first, len(cells)), pa.int32())
            out = [
                terms.dictionary.take(pa.array(term[first])), pa.array(np.add.reduceat(counts, first), pa.int64()),
                pa.array(np.diff(np.append(first, len(cells))), pa.int64()),
            ]
            if len(names) > len(out):
                out += [pa.ListArray.from_arrays(ends, keys.take(pa.array(row))), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return gather


def rows_of(found: DataFrame, key: str, keep: list[str], n: str = "n") -> DataFrame:
    """One row for each key behind a term, with its count as ``n``."""
    return unnest_structs(found, keep, F.arrays_zip(F.col("keys").alias(key), F.col("ns").alias(n)))


def totals(found: DataFrame) -> DataFrame:
    """``(term, tf, df)`` over all batches."""
    return found.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
