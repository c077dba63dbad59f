"""Writers: DataFrames and streams to files, tables and topics, always from the executors."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_corpus(df: DataFrame, path: str, parts: int) -> None:
    """Gzip JSON lines in ``parts`` files."""
    df.repartition(parts).write.mode("overwrite").option("compression", "gzip").json(path)


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines; ``single`` asks for one file, which one task then writes, whatever its size."""
    if single:
        df = df.repartition(1)
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", str(header).lower()).csv(path)


def write_conll_eval(df: DataFrame, gold: str, predicted: str, path: str) -> None:
    """``gold predicted`` lines, a blank line after each sentence; a sentence is one row."""
    lines = F.zip_with(F.col(gold), F.col(predicted), lambda g, p: F.concat_ws(" ", g, p))
    df.select(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_submission(
    texts: DataFrame, predictions: DataFrame, path: str, key: str = "id", by: str = "lang"
) -> None:
    """Predictions joined back to their rows by id, one folder of CSV per language."""
    joined = texts.join(predictions, key)
    joined.write.mode("overwrite").partitionBy(by).option("header", "true").csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_known_urls(df: DataFrame, target: str, jdbc: dict[str, str] | None = None, url: str = "url") -> None:
    """Append urls shorter than 256 letters to a database table or a parquet table."""
    rows = df.filter(F.length(url) < 256)
    if jdbc is not None:
        rows.write.format("jdbc").options(dbtable=target, **jdbc).mode("append").save()
    else:
        rows.write.mode("append").parquet(target)


def message_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))


def write_kafka(df: DataFrame, servers: str, topic: str, key: str, value: str, checkpoint: str | None = None):
    """Send ``(key, value)`` records; returns the query for a stream."""
    rows = message_rows(df, key, value)
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    if not df.isStreaming:
        rows.write.format("kafka").options(**options).save()
        return None
    return rows.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()


def write_index(postings: DataFrame, path: str, term: str = "term", buckets: int = 64) -> None:
    """Postings laid out by term bucket, so that a look-up reads a few folders only.

    Rebalancing gathers a bucket into few files and splits one that a very frequent term
    has made large.
    """
    rows = postings.withColumn("bucket", F.pmod(F.xxhash64(term), F.lit(buckets)))
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """``word v1 … vn`` lines of ``(word, vector)`` rows."""
    values = F.transform("vector", lambda v: v.cast("string"))
    vectors.select(F.concat_ws(" ", "word", values).alias("value")).write.mode("overwrite").text(path)
