"""Streaming queries: the tables as file streams, run over the data available now."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.plans.modeling import KEYS, SCORE_SQL
from papyra.plans.registry import query, table
from papyra.plans.textual import log_lines
from papyra.session import new_path
from papyra.streaming import streams

LOG_SQL = """logs as (select date_trunc('second', ts) as ts, '/' || event_type || '/' || (event_id % 7) as url,
    case event_type when 'error' then 500 else 200 end as status, 'agent/' || (user_id % 5) as agent from events)"""


def _logs(spark, sf_dir):
    """Access-log stream made of the events, parsed again."""
    events = streams.table_stream(spark, sf_dir, "events")
    return streams.parse_stream(events.select(log_lines(events).alias("value")))


@query("k1_hourly_status", f"with {LOG_SQL} select date_trunc('hour', ts) as start, status, count(*) as n from logs group by 1, 2")
def hourly_status(spark, sf_dir):
    hours = streams.hourly_status(_logs(spark, sf_dir), streams.DELAY)
    return streams.update_to_table(hours, ["start", "status"], lambda b: b.orderBy("start"))


def _sliding_sql(key: str, source: str, minutes: int, slide: int) -> str:
    """Sliding counts from panes of ``slide`` minutes."""
    return f"""panes as (select time_bucket(interval '{slide} minutes', ts) as pane, {key}, count(*) as n from {source} group by 1, 2),
    slid as (select pane - to_minutes({slide} * k) as start, {key}, sum(n) as n from panes, range(0, {minutes // slide}) as r(k) group by 1, 2)"""


@query("k2_top_urls", f"with {LOG_SQL}, {_sliding_sql('url', 'logs', 60, 15)} select start, url, n from slid")
def top_urls(spark, sf_dir):
    return streams.top_urls(_logs(spark, sf_dir), length=3600, slide=900)


TAG_STREAM_SQL = r"""msgs as (select make_timestamp(1704067200000000 + (conv_id * 10 + turn) * 60000000) as ts,
    unnest(string_split_regex('#' || role || ' ' || regexp_replace(text, '\bthe\b', '#the', 'g'), '\s+')) as tag from conversations),
    tags as (select ts, tag from msgs where starts_with(tag, '#'))"""


@query("k3_top_hashtags", f"with {TAG_STREAM_SQL}, {_sliding_sql('tag', 'tags', 60, 15)} select start, tag, n from slid")
def top_hashtags(spark, sf_dir):
    turns = streams.table_stream(spark, sf_dir, "conversations")
    seconds = F.lit(1704067200) + (F.col("conv_id") * 10 + F.col("turn")) * 60
    text = F.concat(F.lit("#"), F.col("role"), F.lit(" "), F.regexp_replace("text", r"\bthe\b", "#the"))
    messages = turns.select(F.timestamp_seconds(seconds).alias("ts"), text.alias("text"))
    return streams.top_hashtags(messages, "text", length=3600, slide=900)


@query(
    "k4_error_alarm",
    f"""with {LOG_SQL}, cls as (select ts, case when status between 200 and 299 then 'success' when status between 500 and 599 then 'failure' else 'other' end as class from logs),
    {_sliding_sql('class', 'cls', 120, 30)}, s as (select start, coalesce(sum(n) filter (class = 'success'), 0) as success,
    coalesce(sum(n) filter (class = 'failure'), 0) as failure from slid group by 1)
    select start, success, failure from s where success + failure > 20 and (success = 0 or failure / success > 0.25)""",
)
def error_alarm(spark, sf_dir):
    return streams.error_alarm(_logs(spark, sf_dir), length=7200, slide=1800, min_total=20, ratio=0.25)


@query("k5_agent_counts", f"with {LOG_SQL} select agent, count(*) as total from logs group by 1")
def agent_counts(spark, sf_dir):
    counts = streams.agent_counts(_logs(spark, sf_dir))
    return counts.groupBy("agent").agg(F.sum("total").alias("total"))


@query(
    "k6_running_mean_length",
    "select count(text) as messages, sum(length(text)) as letters, sum(length(text)) // count(text) as mean from conversations",
)
def running_mean_length(spark, sf_dir):
    messages = streams.table_stream(spark, sf_dir, "conversations")
    return streams.complete_to_table(streams.running_mean_length(messages, "text"))


@query("k7_save_batches", "select conv_id, turn, length(text) as n from conversations")
def save_batches(spark, sf_dir):
    messages = streams.table_stream(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    path = new_path(spark, "batches")
    schema = "conv_id bigint, turn bigint, n int"
    if not streams.save_batches(messages, path, stop_after=None):  # no rows, no folder
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


@query("k8_print_stream")
def print_stream(spark, sf_dir):
    return streams.preview(streams.table_stream(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 10)


@query(
    "k9_message_routing",
    f"""select case when {SCORE_SQL} >= 0.3 then 'positive' else 'negative' end as route, conv_id, turn from conversations""",
)
def message_routing(spark, sf_dir):
    messages = streams.table_stream(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    path = new_path(spark, "routes")
    streams.route_messages(messages, "text", KEYS, path)
    schema = "conv_id bigint, turn bigint, text string, route string"
    return spark.read.schema(schema).parquet(path).select("route", "conv_id", "turn")


@query(
    "k10_accepted_pages",
    """select doc_id, length(text) as n from documents where length(text) >= 500 and not contains(text, 'div')
    and not contains(text, 'class=') and not contains(text, 'script')""",
)
def accepted_pages(spark, sf_dir):
    pages = streams.table_stream(spark, sf_dir, "documents").select("doc_id", "text")
    return streams.append_to_table(streams.accepted_pages(pages, "text").select("doc_id", F.length("text").alias("n")))


@query(
    "k1b_hourly_status_batch",
    f"with {LOG_SQL} select date_trunc('hour', ts) as start, status, count(*) as n from logs group by 1, 2",
)
def hourly_status_batch(spark, sf_dir):
    """The same job over a table instead of a stream."""
    events = table(spark, sf_dir, "events")
    return streams.hourly_status(streams.parse_stream(events.select(log_lines(events).alias("value"))))
