from __future__ import annotations

import os
import shutil
import time

from pyspark.sql import functions as F

from papyra.operators import search
from papyra.plans import load_all
from papyra.streaming import streams


def logs(spark, folder, parts=4):
    """Requests in several files, one micro-batch each."""
    rows = spark.range(400).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("ts"),
        F.concat(F.lit("/p"), F.col("id") % 3).alias("url"),
        F.when(F.col("id") % 4 == 0, 500).otherwise(200).alias("status"),
        F.concat(F.lit("a"), F.col("id") % 2).alias("agent"),
    )
    rows.repartition(parts).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return rows, stream


def same(a, b):
    return sorted(map(tuple, a.select(sorted(a.columns)).collect())) == sorted(map(tuple, b.select(sorted(b.columns)).collect()))


def test_hourly_status_over_batches(spark, folder):
    rows, stream = logs(spark, folder)
    assert same(streams.complete_to_table(streams.hourly_status(stream)), streams.hourly_status(rows))


def test_append_with_watermark(spark, folder):
    rows, stream = logs(spark, folder, parts=1)
    closed = streams.append_to_table(streams.hourly_status(stream, watermark="10 minutes"))
    whole = streams.hourly_status(rows)
    assert 0 <= closed.count() <= whole.count()


def test_tables_of_one_file_and_of_many(spark, folder):
    rows = spark.sql("select id as conv_id, id % 3 as turn, 'user' as role, concat('a good div ', id) as text from range(40)")
    rows.coalesce(1).write.parquet(f"{folder}/whole")
    part = next(p for p in os.listdir(f"{folder}/whole") if p.endswith(".parquet"))
    os.makedirs(f"{folder}/one")
    shutil.copy(f"{folder}/whole/{part}", f"{folder}/one/conversations.parquet")
    rows.repartition(3).write.parquet(f"{folder}/many/conversations.parquet")
    rows.limit(5).write.parquet(f"{folder}/many/conversations.parquet.old")
    for kind in ("one", "many"):
        assert same(streams.append_to_table(streams.table_stream(spark, f"{folder}/{kind}", "conversations")), rows)
    queries = load_all()
    assert queries["k7_save_batches"].run(spark, f"{folder}/many").count() == 40
    assert queries["k8_print_stream"].run(spark, f"{folder}/many").count() == 10
    assert queries["k6_running_mean_length"].run(spark, f"{folder}/many").first().messages == 40
    assert queries["k9_message_routing"].run(spark, f"{folder}/many").count() == 40


def test_save_batches_and_preview_without_rows(spark, folder):
    rows = spark.sql("select id as conv_id, id as turn, 'user' as role, 'a' as text from range(0)")
    rows.write.parquet(f"{folder}/conversations.parquet")
    queries = load_all()
    assert queries["k7_save_batches"].run(spark, folder).count() == 0
    assert queries["k8_print_stream"].run(spark, folder).count() == 0
    assert queries["k6_running_mean_length"].run(spark, folder).first().messages == 0


def test_sliding_windows_equal_spark_windows(spark, folder):
    rows, stream = logs(spark, folder)
    got = streams.top_urls(stream, length=300, slide=60)
    w = F.window("ts", "300 seconds", "60 seconds")
    wanted = rows.groupBy(w.alias("w"), "url").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "url", "n")
    assert same(got, wanted)
    assert same(streams.top_urls(rows, length=300, slide=60), wanted)


def test_state_of_sliding_counts_stays_bounded(spark, folder):
    day = 24 * 3600
    rows = spark.range(3 * 24 * 12).select(
        F.timestamp_seconds(F.lit(1_700_006_400) + F.col("id") * 300).alias("ts"), F.concat(F.lit("/p"), F.col("id") % 3).alias("url")
    )
    for part in range(24):  # three days in files of three hours, in order
        rows.filter(F.floor((F.unix_timestamp("ts") - 1_700_006_400) / (day / 8)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)  # files are taken by their age
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    progress = []
    got = streams.top_urls(stream, length=3600, slide=900, delay="2 hours", progress=progress)
    assert same(got, streams.top_urls(rows, length=3600, slide=900))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    whole = streams.pane_counts(rows, ["url"], 900).count()
    assert len(held) >= 24 and whole == 3 * 24 * 4 * 3
    assert max(held) <= 3 * 4 * (2 + 3 + 3)  # the delay, a file, and the file before whose end sets the watermark
    assert max(held[12:]) == max(held[4:12])


def test_update_sink_without_input(spark, folder):
    rows, _ = logs(spark, folder)
    rows.limit(0).write.parquet(f"{folder}/none")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/none")
    assert streams.top_urls(stream, 300, 60).count() == 0


def test_hashtags(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:00:30' as ts, 'x #a b #c #a' as text")
    got = streams.top_hashtags(rows, "text", length=120, slide=60).collect()
    assert [(r.tag, r.n) for r in got] == [("#a", 2), ("#c", 1)] * 2


def test_alarm(spark, folder):
    rows, stream = logs(spark, folder)
    assert same(
        streams.error_alarm(stream, 300, 60, min_total=20, ratio=0.2), streams.error_alarm(rows, 300, 60, min_total=20, ratio=0.2)
    )
    only_errors = rows.withColumn("status", F.lit(503))
    assert streams.error_alarm(only_errors, 300, 60, min_total=20, ratio=0.5).count() > 0
    assert streams.error_alarm(rows.withColumn("status", F.lit(0)), 300, 60, min_total=0).count() == 0


def test_agent_counts_per_batch(spark, folder):
    _, stream = logs(spark, folder)
    counts = streams.agent_counts(stream).collect()
    assert {r.batch for r in counts} == {0, 1, 2, 3}
    assert sum(r.total for r in counts) == 400


def test_save_batches_stops(spark, folder):
    _, stream = logs(spark, folder)
    assert streams.save_batches(stream, f"{folder}/all", stop_after=None) == 400
    saved = streams.save_batches(stream, f"{folder}/some", stop_after=150, checkpoint=f"{folder}/state")
    assert 150 < saved < 400
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/some").count() == saved
    # the next run with the same checkpoint saves the rest
    assert streams.save_batches(stream, f"{folder}/some", checkpoint=f"{folder}/state") == 400 - saved
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/some").count() == 400


def test_preview_and_mean(spark, folder):
    _, stream = logs(spark, folder)
    assert streams.preview(stream, 5).count() == 20
    row = streams.complete_to_table(streams.running_mean_length(stream, "url")).first()
    assert (row.messages, row.letters, row["mean"]) == (400, 1200, 3)


def test_routes(spark, folder):
    spark.createDataFrame([("say good day",), ("nothing",)], "text string").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("text string").parquet(f"{folder}/in")
    streams.route_messages(stream, "text", ["good", "bad"], f"{folder}/out", threshold=0.3)
    got = spark.read.parquet(f"{folder}/out").collect()
    assert {(r.text, r.route) for r in got} == {("say good day", "positive"), ("nothing", "negative")}


# --- retrieval --------------------------------------------------------------------------------
def test_search_against_all_documents(spark):
    docs = spark.createDataFrame(
        [(1, "a b c"), (2, "a b b"), (3, "b c d d"), (4, "a"), (5, "x y")], "doc_id int, text string"
    )
    index = search.build_index(docs, "doc_id", "text")
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "zzz"]), (3, ["y", "x"]), (4, [])], "qid int, terms array<string>")
    got = {(r.qid, r.doc_id): r.rank for r in search.and_search(index, queries, 5).collect()}
    assert got == {(1, 2): 1, (1, 1): 2, (3, 5): 1}
    relaxed = search.relaxed_search(index, queries, 5).collect()
    assert {(r.qid, r.doc_id) for r in relaxed if r.relaxed} == {(2, 1), (2, 2), (2, 4)}


def test_equal_queries_are_asked_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b b"), (3, "b c")], "doc_id int, text string")
    index = search.build_index(docs, "doc_id", "text")
    queries = spark.createDataFrame(
        [(i, ["a", "b"] if i % 2 else ["b", "a", "b"]) for i in range(20)] + [(20, ["c"]), (21, None)], "qid int, terms array<string>"
    )
    asked, matches = [], search.and_matches
    monkeypatch.setattr(search, "and_matches", lambda index, sets, *names: asked.append(sets.count()) or matches(index, sets, *names))
    got = search.and_search(index, queries, 5).collect()
    assert asked == [2]
    assert {(r.qid, r.doc_id): r["rank"] for r in got} == {(i, d): k for i in range(20) for d, k in ((2, 1), (1, 2))} | {(20, 3): 1, (20, 1): 2}
    assert len(got) == 42 and len({r.score for r in got if r.qid < 20}) == 2
