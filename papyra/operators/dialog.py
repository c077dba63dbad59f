"""Dialog analytics over nested turns and flat act tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.functions.rows import unnest
from papyra.operators import ordered

FRAME = (
    "struct<service:string,actions:array<struct<act:string,slot:string,values:array<string>>>,"
    "slots:array<struct<slot:string,start:int,exclusive_end:int>>,"
    "state:struct<active_intent:string,requested_slots:array<string>,slot_values:map<string,array<string>>>>"
)
DIALOG_SCHEMA = (
    "dialogue_id string, services array<string>, "
    f"turns array<struct<turn_id:string,speaker:string,utterance:string,frames:array<{FRAME}>>>"
)


def flatten_turns(dialogs: DataFrame) -> DataFrame:
    """``(dialogue_id, turn_id, utterance)``."""
    return dialogs.select("dialogue_id", F.explode("turns").alias("t")).select(
        "dialogue_id", "t.turn_id", "t.utterance"
    )


def join_acts(turns: DataFrame, acts: DataFrame) -> DataFrame:
    """Turns that have acts, with the acts, in dialog and turn order."""
    keys = ["dialogue_id", "turn_id"]
    return turns.join(acts, keys).orderBy("dialogue_id", F.col("turn_id").cast("int"))


def act_history(df: DataFrame, n: int = 3, dialog: str = "dialogue_id", turn: str = "turn_id", acts: str = "acts") -> DataFrame:
    """Add the acts of the ``n`` previous turns, oldest first, as one blank-separated string."""
    rows = df.withColumn("_turn", F.col(turn).cast("int"))
    near = ordered.with_neighbours(rows, [dialog], ["_turn"], before=n, after=0)
    window = ordered.neighbourhood([dialog])
    joined = F.array_join(acts, " ")
    out = near.withColumn("prev_acts", F.concat_ws(" ", *[F.lag(joined, k).over(window) for k in range(n, 0, -1)]))
    return ordered.at_home(out).drop("_turn")


def domain_frames(dialogs: DataFrame, domain: str, prefix: str = "SNG") -> DataFrame:
    """Frames of one service in single-domain dialogs that use it."""
    kept = dialogs.filter(
        F.col("dialogue_id").startswith(prefix) & F.exists("services", lambda s: s.contains(domain))
    )
    frames = kept.select("dialogue_id", F.explode("turns").alias("t")).select(
        "dialogue_id", "t.turn_id", "t.speaker", F.explode("t.frames").alias("f")
    )
    return frames.filter(F.col("f.service").contains(domain)).select(
        "dialogue_id", "turn_id", "speaker", F.col("f.state.active_intent").alias("intent"),
        F.col("f.state.requested_slots").alias("requested"),
    )


def dialog_states(dialogs: DataFrame) -> DataFrame:
    """Per turn, the states of the frames whose service the dialog lists."""
    rows = dialogs.select("dialogue_id", "services", F.explode("turns").alias("t"))
    kept = F.filter(F.col("t.frames"), lambda f: F.array_contains("services", f["service"]))
    return rows.select(
        "dialogue_id", "t.turn_id",
        F.transform(kept, lambda f: F.struct(f["service"].alias("service"), f["state"].alias("state"))).alias("states"),
    )


def slot_types(df: DataFrame, slots: str) -> DataFrame:
    """Distinct slot names of ``k: v`` arrays."""
    return unnest(df, [], F.map_keys(tx.group_slots(F.col(slots))), "slot").distinct()


def span_table(df: DataFrame, dialog: str, turn: str, spans: str) -> DataFrame:
    """One row per span ``[act, slot, value, start, end]``; bad numbers become null."""
    rows = df.select(dialog, turn, F.explode(spans).alias("s"))
    names = ["act", "slot", "value"]
    return rows.select(
        dialog, turn, *[F.get("s", F.lit(i)).alias(n) for i, n in enumerate(names)],
        F.get("s", F.lit(3)).try_cast("int").alias("start"), F.get("s", F.lit(4)).try_cast("int").alias("end"),
    )
