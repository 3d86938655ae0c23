"""Continuity of sessions: where they were compacted or checkpointed, and what users made of that history.

Evidence comes from records that name such an event, never from prose. Everything that happens to a session's history is a row
of a log, in order: ``sync`` brings the evidence of the session's present source (events, which replace those
before), ``reset`` empties what is shown and starts a generation, ``rebuild`` shows the evidence again, ``archive`` and
``restore`` only change the status. The log is folded by aggregation; nothing of it is rewritten, so the evidence of
resets and older syncs stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One event as its source gives it.
EVENT = "struct<kind:string,ordinal:long,record_id:string,record_uuid:string,ts:long,identity:string,detail:string>"
LOG = f"session_id long, seq long, action string, support string, events array<{EVENT}>"


def _clean(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _json(text: Column) -> Column:
    """A text as JSON, null as null."""
    return F.when(text.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1))


def _number(n: Column) -> Column:
    return F.coalesce(n.cast("string"), F.lit("null"))


def normalised(e: Column) -> Column:
    """An event with its defaults: unknown kinds are compactions, ordinals below 0 are 0, blank texts are none."""
    identity = F.when(e["identity"].isin("uuid", "record-id", "message-id"), e["identity"]).otherwise("none")
    return F.struct(
        F.when(e["kind"] == "checkpoint", "checkpoint").otherwise("compaction").alias("kind"),
        F.greatest(F.coalesce(e["ordinal"], F.lit(0)), F.lit(0)).cast("long").alias("ordinal"),
        _clean(e["record_id"]).alias("record_id"),
        _clean(e["record_uuid"]).alias("record_uuid"),
        e["ts"].alias("ts"),
        identity.alias("identity"),
        _clean(e["detail"]).alias("detail"),
    )


def event_key(e: Column) -> Column:
    """All stable fields of a normalised event: two events at one place stay two."""
    parts = [_json(e["kind"]), _number(e["ordinal"]), _json(e["record_id"]), _json(e["record_uuid"]), _number(e["ts"]), _json(e["detail"])]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def evidence(log: DataFrame) -> DataFrame:
    """(session_id, event_key, kind, ...): the distinct events of each session's last sync."""
    last = log.filter("action = 'sync'").groupBy("session_id").agg(F.max_by("events", "seq").alias("events"))
    each = last.select("session_id", F.explode("events").alias("e")).select("session_id", normalised(F.col("e")).alias("e"))
    keyed = each.select("session_id", event_key(F.col("e")).alias("event_key"), "e")
    # events of one key differ in how they are identified at most
    return keyed.groupBy("session_id", "event_key").agg(F.min("e").alias("e")).select("session_id", "event_key", "e.*")


def states(log: DataFrame) -> DataFrame:
    """(session_id, support, status, archived, reset_generation, reset_at): what the log comes to; reset_at is a seq or null."""
    at = lambda *actions: F.max(F.when(F.col("action").isin(*actions), F.col("seq")))
    told = F.when(F.size("events") > 0, "supported").when(F.col("support").isin("supported", "unsupported"), F.col("support")).otherwise("unknown")
    per = log.groupBy("session_id").agg(
        F.max_by(F.when(F.col("action") == "sync", told), F.when(F.col("action") == "sync", F.col("seq"))).alias("support"),
        F.count_if(F.col("action") == "reset").alias("reset_generation"),
        at("reset").alias("reset"), at("rebuild").alias("rebuilt"), at("archive").alias("put"), at("restore").alias("taken"),
    )
    archived = F.col("put").isNotNull() & (F.col("put") > F.coalesce("taken", F.lit(-1)))
    open_reset = F.when(F.col("reset") > F.coalesce("rebuilt", F.lit(-1)), F.col("reset"))
    status = F.when(archived, "archived").when(open_reset.isNotNull(), "reset").otherwise("active")
    return per.select("session_id", F.coalesce("support", F.lit("unknown")).alias("support"), status.alias("status"), archived.alias("archived"), "reset_generation", open_reset.alias("reset_at"))


def history(log: DataFrame) -> DataFrame:
    """Evidence as it is shown, with its place in the session: nothing after a reset, until a rebuild."""
    from pyspark.sql import Window

    shown = states(log).filter("reset_at IS NULL").select("session_id", F.col("reset_generation").alias("generation"))
    order = Window.partitionBy("session_id").orderBy("ordinal", F.col("ts").asc_nulls_last(), "event_key")
    return evidence(log).join(shown, "session_id").withColumn("position", F.row_number().over(order) - 1)
