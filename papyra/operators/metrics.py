"""Scores of predictions and summaries of experiments, as aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.rows import unnest, unnest_structs
from papyra.functions.text import let
from papyra.operators import ordered
from papyra.session import materialize


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f_measure(p: Column, r: Column, beta: float = 1.0) -> Column:
    square = beta * beta
    return F.when(p + r > 0, (1 + square) * p * r / (square * p + r)).otherwise(F.lit(0.0))


# --- classes ------------------------------------------------------------------------
def masked_pairs(df: DataFrame, gold: str, predicted: str, pad: float = -1.0) -> DataFrame:
    """Position-wise pairs up to the first padding value of the gold array."""
    at = F.array_position(gold, F.lit(pad))
    n = F.when(at > 0, at - 1).otherwise(F.size(gold)).cast("int")
    pairs = F.arrays_zip(F.slice(gold, F.lit(1), n).alias("label"), F.slice(predicted, F.lit(1), n).alias("prediction"))
    return unnest_structs(df, [], pairs)


def confusion(df: DataFrame, y: str, z: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("label"), F.col(z).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def label_scores(df: DataFrame, y: str, z: str, beta: float = 1.0) -> DataFrame:
    """``(label, support, precision, recall, f)`` from one count of label pairs."""
    cells = confusion(df, y, z)
    sides = F.explode(
        F.array(
            F.struct(F.col("label").alias("l"), F.col("n").alias("gold"), F.lit(0).cast("long").alias("guess")),
            F.struct(F.col("prediction").alias("l"), F.lit(0).cast("long").alias("gold"), F.col("n").alias("guess")),
        )
    )
    hit = F.when((F.col("label") == F.col("prediction")) & (F.col("s.gold") > 0), F.col("n")).otherwise(0)
    sums = cells.select("label", "prediction", "n", sides.alias("s")).groupBy(F.col("s.l").alias("class")).agg(
        F.sum(hit).alias("tp"), F.sum("s.gold").alias("support"), F.sum("s.guess").alias("guessed")
    )
    p, r = ratio(F.col("tp"), F.col("guessed")), ratio(F.col("tp"), F.col("support"))
    return sums.select(
        F.col("class").alias("label"), "support", p.alias("precision"), r.alias("recall"), f_measure(p, r, beta).alias("f")
    )


def multiclass_scores(df: DataFrame, y: str, z: str, beta: float = 1.0) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F."""
    rows = label_scores(df, y, z, beta)
    total = F.sum("support")
    weighted = [(F.sum(F.col(c) * F.col("support")) / total).alias(f"weighted_{c}") for c in ("precision", "recall", "f")]
    return rows.agg((F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"), *weighted)


def multilabel_scores(df: DataFrame, ys: str, zs: str) -> DataFrame:
    """One row: subset accuracy, mean overlap, mean F1 and micro scores of label sets."""
    both = F.size(F.array_intersect(ys, zs))
    either = F.size(F.array_union(ys, zs))
    sizes = F.size(ys) + F.size(zs)
    exact = (both == F.size(ys)) & (both == F.size(zs))
    sums = df.agg(
        F.avg(exact.cast("int")).alias("subset_accuracy"),
        F.avg(ratio(both, either)).alias("accuracy"),
        F.avg(ratio(2 * both, sizes)).alias("f1"),
        F.sum(both).alias("_tp"), F.sum(F.size(ys)).alias("_gold"), F.sum(F.size(zs)).alias("_guess"),
    )
    p, r = ratio(F.col("_tp"), F.col("_guess")), ratio(F.col("_tp"), F.col("_gold"))
    return sums.select(
        "subset_accuracy", "accuracy", "f1", p.alias("micro_precision"), r.alias("micro_recall"),
        f_measure(p, r).alias("micro_f1"),
    )


def multilabel_label_scores(df: DataFrame, ys: str, zs: str) -> DataFrame:
    cells = unnest(df, [ys, zs], F.array_union(ys, zs), "label").select(
        "label", F.array_contains(ys, F.col("label")).cast("int").alias("g"), F.array_contains(zs, F.col("label")).cast("int").alias("p")
    )
    sums = cells.groupBy("label").agg(
        F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("g").alias("gold"), F.sum("p").alias("guess")
    )
    p, r = ratio(F.col("tp"), F.col("guess")), ratio(F.col("tp"), F.col("gold"))
    return sums.select("label", p.alias("precision"), r.alias("recall"), f_measure(p, r).alias("f"))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve by the rank-sum formula.

    Equal scores are counted together first, then ranked by running totals over score
    ranges, so there is no global sort window. The counts are written once: they are gone through
    several times, and a score may be costly.
    """
    values = df.groupBy(F.col(score).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("long")).alias("_pos")
    )
    ranked = ordered.running_total(materialize(values, "scores"), ["_s"], "_n", "_below")
    sums = ranked.agg(
        F.sum(F.col("_pos") * (F.col("_below") + (F.col("_n") + 1) / 2)).alias("r"),
        F.sum("_pos").cast("double").alias("p"),
        F.sum(F.col("_n") - F.col("_pos")).cast("double").alias("q"),
    )
    p, q = F.col("p"), F.col("q")
    return sums.select(((F.col("r") - p * (p + 1) / 2) / (p * q)).alias("auc"))


# --- sequences -------------------------------------------------------------------------
def spans(tags: Column) -> Column:
    """Entity spans ``(start, end, type)`` of B/I/O tags; an ``I-`` of a new type opens one."""

    def kind(tag: Column) -> Column:
        return F.regexp_extract(tag, r"\A[BI]-(.*)\z", 1)

    def opens(tag: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(tags, i - 1)).otherwise(F.lit("O"))
        return (tag != "O") & (tag.startswith("B-") | (kind(before) != kind(tag)))

    def build(starts: Column) -> Column:
        n = F.size(tags)
        index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

        def span(p: Column) -> Column:
            later = F.filter(index, lambda j: (j > p) & ((F.get(tags, j) == "O") | F.get(starts, j)))
            return F.struct(
                p.alias("start"), F.coalesce(F.array_min(later), n).alias("end"), kind(F.get(tags, p)).alias("type")
            )

        return F.transform(F.filter(index, lambda i: F.get(starts, i)), span)

    return let(F.transform(tags, opens), build)


def entity_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Phrase precision, recall and F1 per type and over all, with token accuracy."""
    rows = df.select(
        spans(F.col(gold)).alias("g"), spans(F.col(predicted)).alias("p"),
        F.size(gold).alias("tokens"),
        F.size(F.filter(F.zip_with(gold, predicted, lambda a, b: a == b), lambda x: x)).alias("same"),
    )
    events = F.concat(
        F.transform("g", lambda s: F.struct(s["type"].alias("type"), F.lit("gold").alias("side"))),
        F.transform("p", lambda s: F.struct(s["type"].alias("type"), F.lit("guess").alias("side"))),
        F.transform(F.array_intersect("g", "p"), lambda s: F.struct(s["type"].alias("type"), F.lit("hit").alias("side"))),
    )
    sides = unnest_structs(rows, [], events)

    def count(side: str) -> Column:
        return F.sum((F.col("side") == side).cast("int")).alias(side)

    by_type = sides.groupBy("type").agg(count("gold"), count("guess"), count("hit"))
    overall = by_type.agg(*[F.sum(c).alias(c) for c in ("gold", "guess", "hit")]).select(F.lit("ALL").alias("type"), "*")
    accuracy = rows.agg(F.sum("same") / F.sum("tokens")).scalar()
    p, r = ratio(F.col("hit"), F.col("guess")), ratio(F.col("hit"), F.col("gold"))
    return by_type.unionByName(overall).select(
        "type", "gold", "guess", "hit", p.alias("precision"), r.alias("recall"), f_measure(p, r).alias("f1"),
        F.when(F.col("type") == "ALL", accuracy).alias("token_accuracy"),
    )


def token_recall(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Share of the tokens of each gold label that were given it."""
    pairs = unnest_structs(df, [], F.arrays_zip(F.col(gold).alias("label"), F.col(predicted).alias("p")))
    return pairs.groupBy("label").agg(
        F.count(F.lit(1)).alias("tokens"), F.avg((F.col("label") == F.col("p")).cast("int")).alias("recall")
    )


def attachment_scores(
    gold: DataFrame, predicted: DataFrame, keys: tuple[str, str] = ("sent_id", "id"), punctuation: str | None = None
) -> DataFrame:
    """UAS and LAS of edge tables; a ``punctuation`` tag leaves those tokens out."""
    rows = gold if punctuation is None else gold.filter(F.col("pos") != punctuation)
    pair = rows.select(*keys, "head", "label").join(
        predicted.select(*keys, F.col("head").alias("_h"), F.col("label").alias("_l")), list(keys)
    )
    head = F.col("head") == F.col("_h")
    return pair.agg(
        F.count(F.lit(1)).alias("tokens"),
        F.avg(head.cast("int")).alias("uas"),
        F.avg((head & (F.col("label") == F.col("_l"))).cast("int")).alias("las"),
    )


def head_of_offset(offset: Column, token: Column, length: Column) -> Column:
    """Head id from a predicted offset; one that leaves the sentence points to the root."""
    head = token + offset
    return F.when((offset == 0) | (head < 1) | (head > length), F.lit(0)).otherwise(head)


def char_accuracy(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Share of the non-blank gold letters that the prediction has at the same place."""
    compared = df.select(_same_letters(F.col(gold), F.col(predicted)).alias("c"))
    return compared.agg((F.sum("c.hits") / F.sum("c.letters")).alias("char_accuracy"))


@F.arrow_udf(T.StructType([T.StructField("hits", T.LongType()), T.StructField("letters", T.LongType())]))
def _same_letters(gold: pa.Array, predicted: pa.Array) -> pa.Array:
    """Non-blank letters of each gold text, and those that the other text has at the same place."""
    hits, letters = [], []
    for g, p in zip(gold.to_pylist(), predicted.to_pylist()):
        if g is None or p is None:
            hits.append(None)
            letters.append(None)
            continue
        a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (g, p))
        n, solid = min(len(a), len(b)), a != ord(" ")
        hits.append(int(np.count_nonzero((a[:n] == b[:n]) & solid[:n])))
        letters.append(int(np.count_nonzero(solid)))
    return pa.StructArray.from_arrays([pa.array(hits, pa.int64()), pa.array(letters, pa.int64())], ["hits", "letters"])


def token_accuracy(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    same = F.size(F.filter(F.zip_with(gold, predicted, lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))))
    return df.agg((F.sum(same) / F.sum(F.size(gold))).alias("token_accuracy"))


# --- rankings and forecasts -------------------------------------------------------------
def mrr(rankings: DataFrame, gold: DataFrame, k: int = 5, qid: str = "qid", key: str = "doc_id", rank: str = "rank") -> DataFrame:
    """Mean reciprocal rank over the queries that have a relevant document, cut at ``k``."""
    hits = rankings.filter(F.col(rank) <= k).join(gold.select(qid, key).distinct(), [qid, key])
    first = hits.groupBy(qid).agg(F.min(rank).alias("_first"))
    asked = gold.select(qid).distinct().join(first, qid, "left")
    return asked.agg(
        F.count(F.lit(1)).alias("queries"), F.count("_first").alias("found"),
        F.avg(F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr"),
    )


def forecast_errors(df: DataFrame, y: str, z: str) -> DataFrame:
    gap = F.abs(F.col(y) - F.col(z))
    return df.agg(
        F.avg(gap * gap).alias("mse"), F.avg(gap).alias("mae"),
        F.avg(100 * gap / (F.abs(F.col(y)) + F.abs(F.col(z)) + F.lit(1e-10))).alias("smape"),
    )


# --- experiments ---------------------------------------------------------------------------
def aggregate_runs(df: DataFrame, keys: list[str], metrics: list[str], arrays: dict[str, int] | None = None) -> DataFrame:
    """Mean and deviation of metrics per setting, rounded to four places and sorted.

    ``arrays`` names array columns and how many of their elements become metrics.
    """
    for name, n in (arrays or {}).items():
        for i in range(n):
            df = df.withColumn(f"{name}_{i}", F.get(name, F.lit(i)))
        metrics = [*metrics, *[f"{name}_{i}" for i in range(n)]]
    aggs = [F.round(F.avg(m), 4).alias(f"{m}_mean") for m in metrics]
    aggs += [F.round(F.stddev(m), 4).alias(f"{m}_std") for m in metrics]
    return df.groupBy(*keys).agg(*aggs).orderBy(*keys)


def best_k_runs(df: DataFrame, keys: list[str], score: str, tie: str, k: int = 3) -> DataFrame:
    """Mean and deviation over the best ``k`` runs of each setting."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), tie))
    best = df.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    return best.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def length_histogram(df: DataFrame, tokens: str) -> DataFrame:
    return df.groupBy(F.size(tokens).alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length")


def corpus_profile(df: DataFrame, tokens: str, short: int = 80, tiny: int = 2) -> DataFrame:
    """One row: rows, mean length, distinct tokens, shares of short and tiny rows."""
    n = F.size(tokens)
    base = df.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(n).alias("mean_length"), F.max(n).alias("longest"),
        F.avg((n <= short).cast("int")).alias("share_short"), F.sum((n <= tiny).cast("int")).alias("tiny"),
    )
    distinct = unnest(df, [], tokens, "t").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return base.withColumn("vocabulary", distinct.agg(F.count(F.lit(1))).scalar())


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)


def rarity_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight of a label: the inverse of its relative frequency."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total / F.col("n"))
