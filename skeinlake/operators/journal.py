"""Decisions that can be taken back: a journal of what stood before, and undoing only what still stands.

``fold`` plays a log of decisions and undos, target by target: an undo puts back what stood before its decision, unless a
newer decision stands there. ``consolidate`` merges tags by proposals and journals all rows it touches; ``undo`` puts
those rows back exactly, unless a later merge that stands holds one of its tags.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECISION = "struct<seq:long,id:string,action:string,value:string,of:string>"
ENTRY = "struct<id:string,before:string,after:string,undone:boolean,is_undo:boolean>"


def _step(state: Column, d: Column) -> Column:
    """One decision or undo on a target: what stands, the entries so far, and the outcomes."""
    entry = F.try_element_at(F.filter(state["entries"], lambda e: e["id"] == d["of"]), F.lit(1))
    undoing = d["action"] == "undo"
    refused = (
        F.when(undoing & (entry.isNull() | entry["undone"]), "undo unavailable")
        .when(undoing & entry["is_undo"], "event cannot be undone")
        .when(undoing & ~entry["after"].eqNullSafe(state["now"]), "newer user decision exists")
    )
    after = F.when(undoing, entry["before"]).otherwise(d["value"])
    made = F.struct(d["id"].alias("id"), state["now"].alias("before"), after.alias("after"), F.lit(False).alias("undone"), undoing.alias("is_undo"))
    marked = F.transform(
        state["entries"], lambda e: F.struct(e["id"].alias("id"), e["before"].alias("before"), e["after"].alias("after"), (e["undone"] | (undoing & (e["id"] == d["of"]))).alias("undone"), e["is_undo"].alias("is_undo"))
    )
    outcome = lambda why: F.struct(d["seq"].alias("seq"), d["id"].alias("id"), why.alias("refused"), state["now"].alias("before"), F.when(why.isNull(), after).otherwise(state["now"]).alias("after"))
    told = F.concat(state["told"], F.array(outcome(refused)))
    kept = F.struct(state["now"].alias("now"), state["entries"].alias("entries"), told.alias("told"))
    moved = F.struct(after.alias("now"), F.concat(marked, F.array(made)).alias("entries"), told.alias("told"))
    return F.when(refused.isNotNull(), kept).otherwise(moved)


def fold(log: DataFrame) -> DataFrame:
    """(kind, target, seq, id, refused, before, after) of every row of a log.

    ``log`` holds (kind, target, seq, id, action, value, of): action ``set`` with a value (null removes), or ``undo`` of
    the decision with id ``of``. A target's decisions are few, as people make them.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "id", "action", "value", "of"))).cast(f"array<{DECISION}>")
    told = "array<struct<seq:long,id:string,refused:string,before:string,after:string>>"
    start = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast(f"array<{ENTRY}>").alias("entries"), F.array().cast(told).alias("told"))
    per = log.groupBy("kind", "target").agg(rows.alias("rows"))
    return per.select("kind", "target", F.explode(F.aggregate("rows", start, _step)["told"]).alias("t")).select("kind", "target", "t.*")


def standing(folded: DataFrame) -> DataFrame:
    """(kind, target, value): what stands in the end; targets that hold nothing are left out."""
    last = folded.groupBy("kind", "target").agg(F.max_by("after", "seq").alias("value"))
    return last.filter("value IS NOT NULL")


# --- merging tags -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Tags:
    """tags (name, promoted_at), links (session_id, tag), candidates (name, session_id), syntheses (tag, body)."""

    tags: DataFrame
    links: DataFrame
    candidates: DataFrame
    syntheses: DataFrame


@dataclass(frozen=True)
class Journal:
    """events (event, into, sources, reverted) and what their tags held before: rows (event, kind, name, session_id, promoted_at)."""

    events: DataFrame
    rows: DataFrame


def safe_proposals(proposals: DataFrame, tags: DataFrame) -> DataFrame:
    """(event, into, sources) of the proposals (event, into, sources) that can be applied together.

    All names must exist, a name never merges into itself, and each takes part in one proposal only: the first. The proposals of one
    batch, an answer's worth, are folded together.
    """
    each = proposals.select("event", "into", F.array_remove(F.array_distinct("sources"), F.col("into")).alias("sources")).filter("size(sources) > 0")
    named = each.select("event", F.explode(F.concat(F.array("into"), "sources")).alias("name"))
    broken = named.join(tags.select("name"), "name", "left_anti").select("event").distinct()
    whole = each.join(broken, "event", "left_anti")
    kept = "array<struct<event:long,into:string,sources:array<string>>>"
    rows = whole.agg(F.array_sort(F.collect_list(F.struct(F.col("event").cast("long").alias("event"), "into", "sources"))).alias("r"))

    def take(state: Column, p: Column) -> Column:
        names = F.concat(F.array(p["into"]), p["sources"])
        free = ~F.arrays_overlap(state["used"], names)
        return F.when(free, F.struct(F.concat(state["kept"], F.array(p)).alias("kept"), F.concat(state["used"], names).alias("used"))).otherwise(state)

    start = F.struct(F.array().cast(kept).alias("kept"), F.array().cast("array<string>").alias("used"))
    return rows.select(F.explode(F.aggregate("r", start, take)["kept"]).alias("p")).select("p.*")


def _mapped(df: DataFrame, name: str, moves: DataFrame) -> DataFrame:
    """Rows with the names of merged tags replaced, each row once."""
    columns = df.columns
    return df.join(moves, df[name] == F.col("__from"), "left").withColumn(name, F.coalesce("__into", name)).select(*columns).distinct()


def consolidate(state: Tags, proposals: DataFrame) -> tuple[Tags, Journal]:
    """Merge tags: links and candidates of the sources become the target's, sources go, syntheses of both are made anew."""
    events = safe_proposals(proposals, state.tags)
    moves = events.select(F.explode("sources").alias("__from"), F.col("into").alias("__into"))
    held = events.select("event", F.explode(F.concat(F.array("into"), "sources")).alias("name"))
    none, no_time = F.lit(None).cast("long"), F.lit(None).cast("long")
    before = (
        held.join(state.tags, "name").select("event", F.lit("tag").alias("kind"), "name", none.alias("session_id"), "promoted_at")
        .unionByName(held.join(state.links.withColumnRenamed("tag", "name"), "name").select("event", F.lit("link").alias("kind"), "name", "session_id", no_time.alias("promoted_at")))
        .unionByName(held.join(state.candidates, "name").select("event", F.lit("candidate").alias("kind"), "name", "session_id", no_time.alias("promoted_at")))
    )
    gone = moves.select(F.col("__from").alias("name"))
    made = Tags(
        state.tags.join(gone, "name", "left_anti"),
        _mapped(state.links, "tag", moves),
        _mapped(state.candidates, "name", moves),
        state.syntheses.join(held.select(F.col("name").alias("tag")), "tag", "left_anti"),
    )
    return made, Journal(events.withColumn("reverted", F.lit(False)), before)


def blocked(journal: Journal, event: int) -> str | None:
    """Why a merge can't be undone, or None."""
    own = journal.events.filter((F.col("event") == event) & ~F.col("reverted"))
    if own.isEmpty():
        return "undo unavailable"
    names = lambda df: df.select(F.explode(F.concat(F.array("into"), "sources")).alias("name"))
    later = journal.events.filter((F.col("event") > event) & ~F.col("reverted"))
    return None if names(own).join(names(later), "name", "left_semi").isEmpty() else "newer user decision exists"


def undo(state: Tags, journal: Journal, event: int) -> tuple[Tags, Journal]:
    """Put back exactly what one merge's tags held before it. Raises where that isn't allowed."""
    if why := blocked(journal, event):
        raise ValueError(why)
    names = journal.events.filter(F.col("event") == event).select(F.explode(F.concat(F.array("into"), "sources")).alias("name"))
    was = journal.rows.filter(F.col("event") == event)
    kind = lambda k: was.filter(F.col("kind") == k)
    as_tag = names.withColumnRenamed("name", "tag")
    made = Tags(
        state.tags.join(names, "name", "left_anti").unionByName(kind("tag").select("name", "promoted_at")),
        state.links.join(as_tag, "tag", "left_anti").unionByName(kind("link").select("session_id", F.col("name").alias("tag"))),
        state.candidates.join(names, "name", "left_anti").unionByName(kind("candidate").select("name", "session_id")),
        state.syntheses.join(as_tag, "tag", "left_anti"),
    )
    return made, Journal(journal.events.withColumn("reverted", F.col("reverted") | (F.col("event") == event)), journal.rows)


def history(journal: Journal) -> DataFrame:
    """Merges, newest first, numbered."""
    return journal.events.withColumn("position", F.row_number().over(Window.orderBy(F.desc("event"))))  # as many as users made
