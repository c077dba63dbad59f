"""Queries for dialog analytics over the conversation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.operators import dialog
from papyra.plans.registry import query, table
from papyra.plans.textual import WORDS

WORD_ARRAY = WORDS.format("text")
ACTS_SQL = f"""acts as (select conv_id, turn, list_sort(list_distinct(list_transform({WORD_ARRAY}, lambda w: lower(substr(w, 1, 1))))) as a from conversations)"""


def _acts(text):
    """Distinct first letters of the words stand for dialog acts."""
    first = F.transform(tx.words(text), lambda w: F.lower(F.substr(w, F.lit(1), F.lit(1))))
    return F.array_sort(F.array_distinct(first))


def _dialogs(spark, sf_dir):
    """Nested dialogs, at most 64 turns to a row."""
    turns = table(spark, sf_dir, "conversations")
    frame = F.struct(
        F.col("role").alias("service"),
        F.array().cast("array<struct<act:string,slot:string,values:array<string>>>").alias("actions"),
        F.array().cast("array<struct<slot:string,start:int,exclusive_end:int>>").alias("slots"),
        F.struct(
            F.concat(F.lit("find_"), F.col("role")).alias("active_intent"),
            _acts(F.col("text")).alias("requested_slots"),
            F.create_map(F.lit("n"), F.array(F.length("text").cast("string"))).alias("slot_values"),
        ).alias("state"),
    )
    turn = F.struct(
        F.col("turn").cast("string").alias("turn_id"), F.col("role").alias("speaker"), F.col("text").alias("utterance"),
        F.array(frame).alias("frames"),
    )
    part = F.floor(F.col("turn") / 64).alias("part")
    grouped = turns.groupBy("conv_id", part).agg(F.collect_list(turn).alias("turns"))
    name = F.concat(F.when(F.col("conv_id") % 2 == 0, "SNG").otherwise("MUL"), F.col("conv_id").cast("string"))
    services = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("user"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))
    return grouped.select(name.alias("dialogue_id"), services.alias("services"), "turns")


NAME_SQL = "case when conv_id % 2 = 0 then 'SNG' else 'MUL' end || conv_id"


@query("h1_flatten_turns", f"select {NAME_SQL} as dialogue_id, cast(turn as varchar) as turn_id, text as utterance from conversations")
def flatten_turns(spark, sf_dir):
    return dialog.flatten_turns(_dialogs(spark, sf_dir))


def _act_table(spark, sf_dir):
    """Acts of the turns that have at least two."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("dialogue_id"), F.col("turn").cast("string").alias("turn_id"),
        _acts(F.col("text")).alias("acts"),
    )
    return turns.filter(F.size("acts") >= 2)


def _turn_table(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("dialogue_id"), F.col("turn").cast("string").alias("turn_id"),
        F.col("text").alias("utterance"),
    )


@query(
    "h2_join_acts",
    f"""with {ACTS_SQL} select cast(c.conv_id as varchar) as dialogue_id, cast(c.turn as varchar) as turn_id, text as utterance,
    array_to_string(a, ' ') as acts from conversations c join acts using (conv_id, turn) where len(a) >= 2""",
)
def join_acts(spark, sf_dir):
    joined = dialog.join_acts(_turn_table(spark, sf_dir), _act_table(spark, sf_dir))
    return joined.withColumn("acts", F.array_join("acts", " "))


@query(
    "h3_act_history",
    f"""with {ACTS_SQL}, t as (select conv_id, turn, array_to_string(a, ' ') as a from acts where len(a) >= 2)
    select cast(conv_id as varchar) as dialogue_id, cast(turn as varchar) as turn_id, a as acts,
    concat_ws(' ', lag(a, 3) over w, lag(a, 2) over w, lag(a, 1) over w) as prev_acts from t
    window w as (partition by conv_id order by turn)""",
)
def act_history(spark, sf_dir):
    out = dialog.act_history(dialog.join_acts(_turn_table(spark, sf_dir), _act_table(spark, sf_dir)))
    return out.select("dialogue_id", "turn_id", F.array_join("acts", " ").alias("acts"), "prev_acts")


@query(
    "h4_domain_frames",
    f"""with {ACTS_SQL} select 'SNG' || conv_id as dialogue_id, cast(turn as varchar) as turn_id, role as speaker, 'find_' || role as intent,
    array_to_string(a, ' ') as requested from conversations join acts using (conv_id, turn)
    where conv_id % 2 = 0 and conv_id % 3 <> 0 and role = 'assistant'""",
)
def domain_frames(spark, sf_dir):
    frames = dialog.domain_frames(_dialogs(spark, sf_dir), "assistant")
    return frames.withColumn("requested", F.array_join("requested", " "))


@query(
    "h5_dialog_states",
    f"""select {NAME_SQL} as dialogue_id, cast(turn as varchar) as turn_id,
    case when role = 'user' or (role = 'assistant' and conv_id % 3 <> 0) then 'find_' || role || ':' || length(text) else '' end as states from conversations""",
)
def dialog_states(spark, sf_dir):
    states = dialog.dialog_states(_dialogs(spark, sf_dir))
    line = F.transform(
        "states",
        lambda s: F.concat_ws(":", s["state"]["active_intent"], F.get(F.try_element_at(s["state"]["slot_values"], F.lit("n")), F.lit(0))),
    )
    return states.select("dialogue_id", "turn_id", F.array_join(line, " ").alias("states"))


@query(
    "h6_slot_types",
    f"""select distinct lower(substr(w, 1, 2)) as slot from (select unnest({WORD_ARRAY}) as w from conversations)
    where not contains(lower(substr(w, 1, 2)), ':')""",
)
def slot_types(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(tx.words(F.col("text")).alias("w"))
    slots = turns.select(
        F.transform("w", lambda w: F.concat_ws(": ", F.lower(F.substr(w, F.lit(1), F.lit(2))), w)).alias("slots")
    )
    return dialog.slot_types(slots, "slots").filter("slot <> ''")


@query(
    "h7_span_table",
    """select conv_id, turn, 'inform' as act, 'role' as slot, role as value, 0 as start, length(role) as "end" from conversations
    union all select conv_id, turn, 'request', 'size', cast(length(text) as varchar), null, null from conversations""",
)
def span_table(spark, sf_dir):
    spans = F.array(
        F.array(F.lit("inform"), F.lit("role"), F.col("role"), F.lit("0"), F.length("role").cast("string")),
        F.array(F.lit("request"), F.lit("size"), F.length("text").cast("string"), F.lit("?"), F.lit("?")),
    )
    turns = table(spark, sf_dir, "conversations").withColumn("spans", spans)
    return dialog.span_table(turns, "conv_id", "turn", "spans")
