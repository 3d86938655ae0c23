"""Transcripts for readers: every logical record with the calls and results of the message that stands for it, and the dialogue among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.functions.text import WHITE
from skeinlake.operators.replay import logical_messages

TOOLS = "array<struct<position:long,kind:string,name:string,text:string,id:string>>"


def activity(raw: DataFrame, activities: DataFrame) -> DataFrame:
    """(session_id, logical_ordinal, raw_ordinal, record_kind, side, prose, event_ts, replay_count, tools).

    ``raw`` has messages with their identities, as ``replay`` takes them; ``activities`` (session_id, raw_ordinal, position,
    kind, name, text, id). A record shows the activities of its representative only, so replays show none twice.
    """
    told = F.array_sort(F.collect_list(F.struct(F.col("position").cast("long").alias("position"), "kind", "name", "text", "id"))).cast(TOOLS)
    nested = activities.groupBy("session_id", "raw_ordinal").agg(told.alias("tools"))
    times = raw.select("session_id", F.col("ordinal").alias("raw_ordinal"), F.col("ts").alias("event_ts"))
    records = logical_messages(raw).select("session_id", "logical_ordinal", F.col("first_ordinal").alias("raw_ordinal"), "record_kind", "side", F.col("text").alias("prose"), F.col("members").alias("replay_count"))
    key = ["session_id", "raw_ordinal"]
    both = records.join(times, key).join(nested, key, "left")
    return both.select(
        "session_id", "logical_ordinal", "raw_ordinal", "record_kind", "side", "prose", "event_ts", "replay_count", F.coalesce("tools", F.array().cast(TOOLS)).alias("tools")
    )


def dialogue(records: DataFrame) -> DataFrame:
    """The turns of ``activity``: what users and assistants say, each on their own side, and not blank."""
    user = (F.col("record_kind") == "real_user") & (F.col("side") == "user")
    assistant = (F.col("record_kind") == "assistant_dialogue_prose") & (F.col("side") == "assistant")
    return records.filter((user | assistant) & (F.btrim("prose", F.lit(WHITE)) != ""))
