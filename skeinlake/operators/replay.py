"""Replays: logical messages, their representatives and the construction metrics.

Two raw messages are the same logical message only if both carry a provable
identity (a kind, an id and a time) and these agree; equal text never suffices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIALOGUE = ("real_user", "assistant_dialogue_prose")


def provable() -> Column:
    return (F.col("identity_kind") != "none") & F.col("identity_id").isNotNull() & F.col("ts").isNotNull()


def with_logical_key(raw: DataFrame) -> DataFrame:
    """Adds logical_key: identity where provable, else the row's own place."""
    identity = F.to_json(F.array(F.col("identity_kind"), F.col("identity_id"), F.col("ts").cast("string")))
    own = F.concat(F.lit("raw:"), F.col("ordinal").cast("string"))
    return raw.withColumn("logical_key", F.when(provable(), identity).otherwise(own))


def logical_messages(raw: DataFrame) -> DataFrame:
    """One row per logical message: the first by ordinal stands for it."""
    keyed = with_logical_key(raw)
    grouped = keyed.groupBy("session_id", "logical_key").agg(
        F.min("ordinal").alias("first_ordinal"),
        F.count(F.lit(1)).alias("members"),
        F.min_by(F.struct("record_kind", "side", "text", "tools"), "ordinal").alias("r"),
    )
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("first_ordinal")).cast("long") - 1
    return grouped.select(
        "session_id", "logical_key", place.alias("logical_ordinal"), "first_ordinal", "members", "r.record_kind", "r.side", "r.text", "r.tools"
    )


def disagreements(raw: DataFrame) -> DataFrame:
    """Logical messages whose members don't say the same thing."""
    signature = F.sha2(F.to_json(F.struct("record_kind", "side", "text")), 256)
    return (
        with_logical_key(raw)
        .groupBy("session_id", "logical_key")
        .agg(F.countDistinct(signature).alias("signatures"))
        .filter("signatures > 1")
    )


def construction_metrics(raw: DataFrame) -> DataFrame:
    """The eleven counters of a session; they obey Q = R - L, D = U + A, D <= LP <= L <= R."""
    prose = F.trim(F.coalesce("text", F.lit(""))) != ""
    unknown = ~provable()
    first = raw.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("raw"),
        F.sum("tools").cast("long").alias("raw_tools"),
        F.count_if(prose).alias("raw_prose"),
        F.count_if(unknown).alias("unknown_identity"),
    )
    logical = logical_messages(raw)
    side = lambda s: F.count_if(F.col("record_kind").isin(*DIALOGUE) & (F.col("side") == s) & prose)
    second = logical.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("logical"),
        F.sum("tools").cast("long").alias("logical_tools"),
        F.count_if(prose).alias("logical_prose"),
        side("user").alias("user"),
        side("assistant").alias("assistant"),
    )
    both = first.join(second, "session_id")
    return both.withColumn("dialogue", F.col("user") + F.col("assistant")).withColumn("replay", F.col("raw") - F.col("logical"))


def broken_invariants(metrics: DataFrame) -> DataFrame:
    """Sessions whose counters contradict each other."""
    fine = (
        (F.col("replay") == F.col("raw") - F.col("logical"))
        & (F.col("dialogue") == F.col("user") + F.col("assistant"))
        & (F.col("dialogue") <= F.col("logical_prose"))
        & (F.col("logical_prose") <= F.col("logical"))
        & (F.col("logical") <= F.col("raw"))
        & (F.col("raw_tools") >= F.col("logical_tools"))
        & (F.col("raw_prose") >= F.col("logical_prose"))
    )
    return metrics.filter(~fine)


def broken_ordinals(raw: DataFrame) -> DataFrame:
    """Sessions whose ordinals don't run 0, 1, 2 ... without gaps or repeats."""
    checks = raw.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ordinal").alias("distinct"), F.max("ordinal").alias("last"), F.min("ordinal").alias("first")
    )
    return checks.filter((F.col("n") != F.col("distinct")) | (F.col("first") != 0) | (F.col("last") + 1 != F.col("n")))


def elect(candidates: DataFrame, key: list[str]) -> DataFrame:
    """The copy of a session that wins: most semantic bytes, then root order, then path."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("bytes").desc(), "root", "path"))
    return candidates.withColumn("place", place).filter("place = 1").drop("place")


def plan_actions(current: DataFrame, elected: DataFrame, key: list[str], complete: Column) -> DataFrame:
    """What to do with each session: publish, unchanged, repair, retain or orphan.

    Both sides have (key..., generation, valid). A session that is gone becomes an
    orphan only after a complete walk.
    """
    c = current.select(*key, F.col("generation").alias("old"), F.col("valid").alias("was_valid"))
    e = elected.select(*key, F.col("generation").alias("new"))
    action = (
        F.when(F.col("old").isNull(), "publish")
        .when(F.col("new").isNull(), F.when(complete, "orphan").otherwise("retain"))
        .when(F.col("old") != F.col("new"), "publish")
        .when(~F.col("was_valid"), "repair")
        .otherwise("unchanged")
    )
    return c.join(e, key, "full_outer").select(*key, action.alias("action"))


def prefix_skip(msgs: DataFrame, order: Column) -> DataFrame:
    """Messages left after each session's opening run of texts already seen in an earlier session.

    ``order`` is the sessions' order. A message is skipped while every message up
    to it was first seen in a session before.
    """
    firsts = msgs.withColumn("__o", order).groupBy("text").agg(F.min("__o").alias("__first"))
    seen = msgs.withColumn("__o", order).join(firsts, "text")
    w = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    opening = F.min(F.when(F.col("__first") < F.col("__o"), 1).otherwise(0)).over(w)
    return seen.withColumn("__skip", opening).filter("__skip = 0").drop("__o", "__first", "__skip")
