"""The log of searches: who asked, what for, what came back, and what the search couldn't see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFS = "array<struct<harness:string,native_id:string,ordinals:array<long>>>"


def caller(env: Column, interactive: Column) -> Column:
    """struct(harness, native_id, agent) from an environment (a map): a name given outright, a harness's own session, a person, or unknown."""
    get = lambda name: F.try_element_at(env, F.lit(name))
    agent = get("AI_AGENT").alias("agent")
    given = F.regexp_extract(F.coalesce(get("CALLER"), F.lit("")), r"^([a-z0-9-]+):(.+)$", 1)
    named = lambda harness, native: F.struct(harness.alias("harness"), native.alias("native_id"), agent)
    none = F.lit(None).cast("string")
    return (
        F.when(given != "", named(given, F.regexp_extract(get("CALLER"), r"^([a-z0-9-]+):(.+)$", 2)))
        .when(F.coalesce(get("CODEX_THREAD_ID"), F.lit("")) != "", named(F.lit("codex"), get("CODEX_THREAD_ID")))
        .when(F.coalesce(get("CLAUDE_CODE_SESSION_ID"), F.lit("")) != "", named(F.lit("claude"), get("CLAUDE_CODE_SESSION_ID")))
        .when(get("CLAUDECODE") == "1", named(F.lit("claude"), none))
        .otherwise(named(F.when(interactive, "human").otherwise("unknown"), none))
    )


def refs_of(hits: DataFrame) -> DataFrame:
    """(search, total, returned, refs) of hits (search, place, harness, native_id, ordinal): one reference for a session, in the order of its best hit."""
    per = hits.groupBy("search", "harness", "native_id").agg(F.min("place").alias("place"), F.array_sort(F.collect_set(F.col("ordinal").cast("long"))).alias("ordinals"))
    listed = F.array_sort(F.collect_list(F.struct("place", "harness", "native_id", "ordinals")))
    refs = F.transform(listed, lambda r: F.struct(r["harness"].alias("harness"), r["native_id"].alias("native_id"), r["ordinals"].alias("ordinals"))).cast(REFS)
    return per.groupBy("search").agg(F.count(F.lit(1)).alias("returned"), refs.alias("refs"))


def uncovered(scope: Column, total: Column, returned: Column, newest: Column, now: Column) -> Column:
    """struct(index_age_min, filtered_by, truncated): what a search can't have seen; fields that say nothing are null.

    ``scope`` is a map from filters to values, null where a filter isn't set; times are milliseconds.
    """
    narrowed = F.array_sort(F.map_keys(F.map_filter(scope, lambda _, v: v.isNotNull())))
    age = F.when(newest.isNotNull(), F.floor((now - newest) / 60_000 + 0.5).cast("long"))
    return F.struct(age.alias("index_age_min"), F.when(F.size(narrowed) > 0, narrowed).alias("filtered_by"), F.when(total > returned, total - returned).alias("truncated"))


def log(searches: DataFrame, hits: DataFrame, newest: Column) -> DataFrame:
    """(id, at, surface, caller, query, total, returned, refs, uncovered) of searches (id, at, surface, env, interactive, query, scope, total)."""
    found = refs_of(hits).withColumnRenamed("search", "id")
    both = searches.join(found, "id", "left").withColumn("returned", F.coalesce("returned", F.lit(0).cast("long")))
    blind = uncovered(F.col("scope"), F.col("total"), F.col("returned"), newest, F.col("at"))
    who = caller(F.col("env"), F.col("interactive"))
    return both.select("id", "at", "surface", who.alias("caller"), "query", "total", "returned", F.coalesce("refs", F.array().cast(REFS)).alias("refs"), blind.alias("uncovered"))


def asked(logged: DataFrame, limit: int = 30, by: tuple[str, str] | None = None, agents: bool = False) -> DataFrame:
    """The latest searches, of all, of one caller, or of agents only."""
    rows = logged
    if by is not None:
        rows = rows.filter((F.col("caller.harness") == by[0]) & (F.col("caller.native_id") == by[1]))
    elif agents:
        rows = rows.filter(~F.col("caller.harness").isin("human", "unknown"))
    return rows.orderBy(F.desc("at"), F.desc("id")).limit(limit)
