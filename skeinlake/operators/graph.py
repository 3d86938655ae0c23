"""Lineage claims, chains of sessions and tag decisions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or one of our own if unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-skeinlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared scratch folder and read back."""
    path = f"{scratch_dir(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """As a side that joins by a shuffle: in rounds over all sessions, each broadcast would go through the driver."""
    return df.hint("merge")


def claim_status(sessions: DataFrame, claims: DataFrame) -> DataFrame:
    """(child, parent, status): unresolved, self_invalid, cycle_invalid or resolved.

    Every session has one parent claim at most. Pointers are doubled until they are
    longer than any path without a cycle can be; whatever they still point at then
    lies on a cycle, and only the edges of those members are invalid.
    """
    known = sessions.select(F.col("session_id").alias("__k"))
    base = claims.select("child", "parent").join(shuffled(known), F.col("parent") == F.col("__k"), "left")
    status = F.when(F.col("child") == F.col("parent"), "self_invalid").when(F.col("__k").isNull(), "unresolved")
    flagged = checkpoint(base.select("child", "parent", status.alias("status")))
    reach = flagged.filter(F.col("status").isNull()).select("child", F.col("parent").alias("at"))
    reach = checkpoint(reach)
    rounds = reach.count().bit_length()
    for _ in range(rounds):
        if reach.isEmpty():
            break
        ahead = reach.select(F.col("child").alias("__c"), F.col("at").alias("__a"))
        reach = checkpoint(reach.join(shuffled(ahead), reach["at"] == ahead["__c"]).select("child", F.col("__a").alias("at")))
    cyclic = reach.select(F.col("at").alias("__cy")).distinct()
    joined = flagged.join(shuffled(cyclic), F.col("child") == F.col("__cy"), "left")
    final = F.coalesce("status", F.when(F.col("__cy").isNotNull(), "cycle_invalid"), F.lit("resolved"))
    return joined.select("child", "parent", final.alias("status"))


def chains(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(session_id, chain): the smallest session reachable over resolved edges, for linked sessions.

    Each round takes the smallest label around and then the label's own label, so
    long chains shrink by half or more.
    """
    both = checkpoint(
        edges.select(F.col("child").alias("a"), F.col("parent").alias("b"))
        .unionByName(edges.select(F.col("parent").alias("a"), F.col("child").alias("b")))
        .distinct()
    )
    label = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label"))
    before = None
    for _ in range(most_rounds):
        label = checkpoint(label)
        state = label.agg(F.bit_xor(F.xxhash64("a", "label")), F.count(F.lit(1))).first()
        if state == before:
            break
        before = state
        other = label.select(F.col("a").alias("b"), F.col("label").alias("other"))
        around = both.join(shuffled(other), "b").groupBy("a").agg(F.min("other").alias("m"))
        low = label.join(shuffled(around), "a").select("a", F.least("label", "m").alias("label"))
        jump = low.select(F.col("a").alias("label"), F.col("label").alias("up"))
        label = low.join(shuffled(jump), "label", "left").select("a", F.least("label", F.coalesce("up", "label")).alias("label"))
    else:
        raise RuntimeError(f"chains don't settle in {most_rounds} rounds")
    return label.select(F.col("a").alias("session_id"), F.col("label").alias("chain"))


def chain_summary(members: DataFrame, sess: DataFrame) -> DataFrame:
    """Per chain of two or more: members, first and last activity, tokens, newest session."""
    return (
        members.join(sess, "session_id")
        .groupBy("chain")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min("last_activity").alias("first_activity"),
            F.max("last_activity").alias("last_activity"),
            F.sum("tok_total").alias("tok_total"),
            F.max_by("session_id", F.struct("last_activity", "session_id")).alias("head"),
        )
        .filter("members > 1")
    )


def stable_chains(members: DataFrame, resolved: DataFrame, sess: DataFrame) -> DataFrame:
    """(chain, stable_key, harness, root, members, first_activity, last_activity, tok_total, head) of chains of two or more.

    The key names the root, so it outlives rebuilds, new members and other ids: of the members that follow none (all of them, should each
    follow one) the one with the smallest native id. The head is the newest session, ties by native id; sessions without a time come
    last. ``members`` (session_id, chain), ``resolved`` (child), ``sess`` (session_id, harness, native_id, last_activity, tok_total).
    """
    follows = resolved.select(F.col("child").alias("session_id"), F.lit(1).alias("__follows")).distinct()
    told = sess.select("session_id", "harness", "native_id", "last_activity", "tok_total")
    rows = members.join(shuffled(told), "session_id").join(shuffled(follows), "session_id", "left")
    newest = F.struct(F.col("last_activity").isNull(), -F.col("last_activity"), "native_id")
    made = rows.groupBy("chain").agg(
        F.min(F.struct(F.coalesce("__follows", F.lit(0)), "native_id", "harness")).alias("r"), F.count(F.lit(1)).alias("members"), F.min("last_activity").alias("first_activity"),
        F.max("last_activity").alias("last_activity"), F.sum("tok_total").alias("tok_total"), F.min_by("session_id", newest).alias("head"),
    )
    # fixed value: how the key begins
    key = F.concat(F.lit("lineage-v1:"), F.col("r.harness"), F.lit(":"), F.col("r.native_id"))
    return made.filter("members > 1").select("chain", key.alias("stable_key"), "r.harness", F.col("r.native_id").alias("root"), "members", "first_activity", "last_activity", "tok_total", "head")


def chain_mismatches(chains: DataFrame, sess: DataFrame) -> DataFrame:
    """(chain, members, held): chains that don't hold as many sessions as they say, those that sessions name but aren't there included.

    ``sess`` has chain, null where a session stands alone.
    """
    held = sess.filter("chain IS NOT NULL").groupBy("chain").agg(F.count(F.lit(1)).alias("held"))
    both = chains.select("chain", "members").join(held, "chain", "full_outer")
    none = F.lit(0).cast("long")
    return both.select("chain", F.coalesce("members", none).alias("members"), F.coalesce("held", none).alias("held")).filter("members <> held")


def final_merges(spark: SparkSession, decisions: DataFrame) -> DataFrame:
    """(tag, target, depth): where each merged tag ends up, eight merges deep at most.

    Three times each pointer takes over its target's own pointer, so eight hops take three joins.
    """
    place = F.row_number().over(Window.partitionBy("from_tag").orderBy(F.col("created_at").desc(), F.col("id").desc()))
    newest = decisions.withColumn("__rn", place).filter("__rn = 1 AND action = 'merge'")
    walk = checkpoint(newest.select(F.col("from_tag").alias("tag"), F.col("to_tag").alias("target"), F.lit(1).alias("depth")))
    for _ in range(3):
        on = walk.select(F.col("tag").alias("__t"), F.col("target").alias("__to"), F.col("depth").alias("__d"))
        further = walk.join(on, walk["target"] == F.col("__t"), "left")
        walk = checkpoint(further.select("tag", F.coalesce("__to", "target").alias("target"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth")))
    return walk


def display_tags(spark: SparkSession, tags: DataFrame, decisions: DataFrame) -> DataFrame:
    """(session_id, tag, parent) as shown: newest decision, merges, demotions, nesting.

    A tag demoted to a facet leaves the list, demoted to anything else it is hidden;
    nesting names a parent one level up.
    """
    place = F.row_number().over(Window.partitionBy("from_tag").orderBy(F.col("created_at").desc(), F.col("id").desc()))
    newest = decisions.withColumn("__rn", place).filter("__rn = 1")
    merged = final_merges(spark, decisions).select(F.col("tag").alias("__t"), "target")
    shown = tags.join(merged, tags["tag"] == F.col("__t"), "left").select("session_id", F.coalesce("target", "tag").alias("tag"))
    demoted = newest.filter("action = 'demote'").select(F.col("from_tag").alias("tag"))
    nested = newest.filter("action = 'nest'").select(F.col("from_tag").alias("tag"), F.col("to_tag").alias("parent"))
    return shown.join(demoted, "tag", "left_anti").join(nested, "tag", "left").select("session_id", "tag", "parent").distinct()


def collapse(sess: DataFrame) -> DataFrame:
    """(kind, chain, head, members, tok_total, msg_count, first_activity, last_activity): one row per chain, at its newest member, and one per other session.

    ``sess`` has session_id, chain (or null), last_activity, tok_total, msg_count; the list is newest
    first, sessions of equal activity by id.
    """
    unit = F.coalesce(F.concat(F.lit("c"), F.col("chain").cast("string")), F.concat(F.lit("s"), F.col("session_id").cast("string")))
    newest = F.struct(F.coalesce("last_activity", F.lit(-1)), "session_id")
    rows = sess.groupBy(unit.alias("unit")).agg(
        F.first("chain").alias("chain"), F.max_by("session_id", newest).alias("head"), F.count(F.lit(1)).alias("members"), F.sum("tok_total").alias("tok_total"),
        F.sum("msg_count").alias("msg_count"), F.min("last_activity").alias("first_activity"), F.max("last_activity").alias("last_activity"),
    )
    return rows.withColumn("kind", F.when(F.col("chain").isNull(), "session").otherwise("chain")).drop("unit")
