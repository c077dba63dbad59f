"""Structured Streaming jobs over log lines, messages and crawled pages.

Every job takes a streaming DataFrame from any source. ``*_to_table`` runs a job over the
data available now and gives back its result table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.operators import curate
from papyra.session import new_path, ship_package


#: How late an event may be in a sliding job; the state holds the panes of about that time.
DELAY = "1 day"


# --- running a stream ----------------------------------------------------------------
def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table as a file stream; the table may be one file or a folder of files.

    A file stream takes a plain path for a folder, a pattern for whatever it matches.
    """
    ship_package(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


def append_to_table(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    path = new_path(spark, "sink")
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", new_path(spark, "state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def complete_to_table(stream: DataFrame, finish=None) -> DataFrame:
    """Run an aggregating stream; ``finish`` shapes each complete result before it is written."""
    return _latest_result(stream, "complete", finish)


def _latest_result(stream: DataFrame, mode: str, finish) -> DataFrame:
    spark = stream.sparkSession
    path, last = new_path(spark, "sink"), {}

    def write(batch: DataFrame, batch_id: int) -> None:
        result = finish(batch) if finish else batch
        result.write.mode("overwrite").parquet(f"{path}/{batch_id}")
        last.update(path=f"{path}/{batch_id}", schema=result.schema)

    run_batches(stream, write, mode)
    if not last:  # no input: an empty result
        nothing = spark.createDataFrame([], stream.schema)
        return finish(nothing) if finish else nothing
    return spark.read.schema(last["schema"]).parquet(last["path"])


def update_to_table(stream: DataFrame, keys: list[str], finish=None, progress: list | None = None) -> DataFrame:
    """Run an aggregating stream in update mode: each batch writes the groups it changed, the last value of a group holds.

    With a watermark Spark gives up the state of groups that can't change any more, so the state does
    not grow with the stream, and no batch writes what it has not touched. Batches are folders of
    their own, so one that is run again replaces itself. ``progress`` gets the stream's progress reports.
    """
    spark = stream.sparkSession
    path, others = new_path(spark, "sink"), [c for c in stream.columns if c not in keys]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    reports = run_batches(stream, write, "update")
    if progress is not None:
        progress += reports
    try:
        changes = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, _batch bigint").parquet(path)
    except AnalysisException:  # no input, no folder
        changes = spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0))
    last = changes.groupBy(F.struct(*keys).alias("_keys")).agg(F.max_by(F.struct(*others), "_batch").alias("_last"))
    result = last.select("_keys.*", "_last.*").select(*stream.columns)
    return finish(result) if finish else result


def run_batches(stream: DataFrame, write, mode: str = "append", checkpoint: str | None = None) -> list:
    """Run a stream over what is there now; gives back its progress reports."""
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint or new_path(stream.sparkSession, "state"))
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return list(query.recentProgress)


# --- log analytics --------------------------------------------------------------------
def parse_stream(lines: DataFrame, value: str = "value") -> DataFrame:
    """Log lines to fields; lines of another form keep nulls."""
    return lines.select(tx.parse_log(F.col(value)).alias("l")).select("l.*")


def hourly_status(logs: DataFrame, watermark: str | None = None) -> DataFrame:
    """Requests per hour and status; with a watermark the state of old hours is dropped."""
    rows = logs.withWatermark("ts", watermark) if watermark else logs
    counts = rows.groupBy(F.window("ts", "1 hour").alias("w"), "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "status", "n")


def pane_counts(rows: DataFrame, keys: list[str], slide: int, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Counts per pane of ``slide`` seconds, the only state that sliding windows need.

    In a stream, panes that ended more than ``delay`` before the latest event are closed: their state goes,
    and later events for them are dropped.
    """
    if delay and rows.isStreaming:
        rows = rows.withWatermark(ts, delay)
    counts = rows.groupBy(F.window(ts, f"{slide} seconds").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("pane"), *keys, "n")


def slide_windows(panes: DataFrame, keys: list[str], length: int, slide: int) -> DataFrame:
    """Sliding-window counts from pane counts, ``length`` being a multiple of ``slide``.

    Only the pre-aggregated panes are repeated, not every event ``length / slide`` times.
    """
    if length % slide:
        raise ValueError("the window length must be a multiple of the slide")
    steps = F.sequence(F.lit(0), F.lit(length // slide - 1))
    seconds = F.unix_timestamp("pane")
    starts = panes.select(*keys, "n", seconds.alias("_s"), F.explode(steps).alias("_k"))
    start = F.timestamp_seconds(F.col("_s") - F.col("_k") * slide).alias("start")
    return starts.groupBy(start, *keys).agg(F.sum("n").alias("n"))


def top_urls(logs: DataFrame, length: int = 300, slide: int = 1, delay: str = DELAY, progress: list | None = None) -> DataFrame:
    """Requests per url in sliding windows, most requested first."""
    return _sliding_top(logs.filter(F.col("url").isNotNull()), "url", length, slide, delay, progress)


def hashtags(messages: DataFrame, text: str, ts: str = "ts") -> DataFrame:
    words = messages.select(F.col(ts).alias("ts"), F.explode(F.split(text, r"\s+")).alias("tag"))
    return words.filter(F.col("tag").startswith("#"))


def top_hashtags(messages: DataFrame, text: str, length: int = 300, slide: int = 1, ts: str = "ts", delay: str = DELAY) -> DataFrame:
    return _sliding_top(hashtags(messages, text, ts), "tag", length, slide, delay)


def _sliding_top(rows: DataFrame, key: str, length: int, slide: int, delay: str, progress: list | None = None) -> DataFrame:
    def finish(panes: DataFrame) -> DataFrame:
        return slide_windows(panes, [key], length, slide).orderBy("start", F.desc("n"), key)

    panes = pane_counts(rows, [key], slide, delay=delay)
    return update_to_table(panes, ["pane", key], finish, progress) if rows.isStreaming else finish(panes)


def status_class(status: Column) -> Column:
    code = F.coalesce(status, F.lit(0))
    return (
        F.when((code >= 200) & (code < 300), "Success").when((code >= 500) & (code < 600), "Failure").otherwise("Other")
    )


def error_alarm(
    logs: DataFrame, length: int = 300, slide: int = 1, min_total: int = 100, ratio: float = 0.5, delay: str = DELAY
) -> DataFrame:
    """Windows with more than ``min_total`` answers whose failure/success ratio is too high."""
    classed = logs.withColumn("class", status_class(F.col("status")))

    def finish(panes: DataFrame) -> DataFrame:
        counts = slide_windows(panes, ["class"], length, slide).groupBy("start").agg(
            *[F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(c.lower()) for c in ("Success", "Failure")]
        )
        total, ok = F.col("success") + F.col("failure"), F.col("success")
        alarm = (ok == 0) | (F.col("failure") / F.when(ok > 0, ok) > ratio)
        return counts.filter((total > min_total) & alarm)

    panes = pane_counts(classed, ["class"], slide, delay=delay)
    return update_to_table(panes, ["pane", "class"], finish) if logs.isStreaming else finish(panes)


def agent_counts(logs: DataFrame) -> DataFrame:
    """Requests per agent and micro-batch, in SQL over a view of the batch."""
    spark = logs.sparkSession
    path = new_path(spark, "agents")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.createOrReplaceTempView("requests")
        counts = batch.sparkSession.sql("select agent, count(*) as total from requests group by agent")
        counts.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    run_batches(logs, write)
    schema = "agent string, total bigint, batch int"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


# --- messages and pages ----------------------------------------------------------------
def running_mean_length(messages: DataFrame, text: str) -> DataFrame:
    """Messages, letters and whole-number mean length over the stream so far."""
    totals = messages.agg(F.count(text).alias("messages"), F.sum(F.length(text)).alias("letters"))
    return totals.withColumn("mean", F.floor(F.col("letters") / F.col("messages")))


def save_batches(stream: DataFrame, path: str, stop_after: int | None = None, checkpoint: str | None = None) -> int:
    """Each non-empty micro-batch to its own folder; the query ends once over ``stop_after`` rows are saved.

    The batch that comes after that is refused before it is committed, so a later run with the
    same ``checkpoint`` goes on with its rows.
    """
    total = {"rows": 0, "ended": False}

    def write(batch: DataFrame, batch_id: int) -> None:
        if stop_after is not None and total["rows"] > stop_after:
            total["ended"] = True
            raise StopIteration("enough rows are saved")
        batch.persist()
        rows = batch.count()
        if rows:
            batch.write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
            total["rows"] += rows
        batch.unpersist()

    try:
        run_batches(stream, write, checkpoint=checkpoint)
    except StreamingQueryException:
        if not total["ended"]:
            raise
    return total["rows"]


def preview(stream: DataFrame, rows: int = 10) -> DataFrame:
    """The first rows of every micro-batch."""
    spark = stream.sparkSession
    path = new_path(spark, "preview")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.limit(rows).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    run_batches(stream, write)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def with_route(messages: DataFrame, text: str, keywords: list[str], threshold: float = 0.3) -> DataFrame:
    positive = tx.keyword_score(F.col(text), keywords) >= threshold
    return messages.withColumn("route", F.when(positive, "positive").otherwise("negative"))


def route_messages(messages: DataFrame, text: str, keywords: list[str], path: str, threshold: float = 0.3) -> None:
    """Messages split by the keyword rule into two folders."""
    query = (
        with_route(messages, text, keywords, threshold)
        .writeStream.format("parquet")
        .partitionBy("route")
        .option("checkpointLocation", new_path(messages.sparkSession, "state"))
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def accepted_pages(pages: DataFrame, content: str, min_chars: int = 500) -> DataFrame:
    """Long pages without markup left in them."""
    return curate.accept_pages(pages, content, min_chars, curate.CRAWL_MARKUP)
