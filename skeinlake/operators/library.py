"""The library's law of scopes, and what a search of it matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions import text as fx

MATCHES = {"title": "title", "summary": "overview", "related": "topics"}


def in_scope(
    sessions: DataFrame, view: str = "attended", harness: str | None = None, model: str | None = None, since: int | None = None,
    until: int | None = None, path: str | None = None, keys: DataFrame | None = None,
) -> DataFrame:
    """Sessions (session_id, origin, corrected, harness, models, updated, cwd) of a scope; a correction of the origin counts.

    view: direct (started by a person), everything, or else all but workers. Both ends of the
    time are inside. ``keys`` (session_id) is a collection.
    """
    origin = F.coalesce("corrected", "origin")
    law: list[Column] = []
    if view == "direct":
        law.append(origin == "human_started")
    elif view != "everything":
        law.append(origin != "worker")
    if harness is not None:
        law.append(F.col("harness") == harness)
    if model is not None:
        law.append(F.array_contains("models", model))
    if since is not None:
        law.append(F.col("updated") >= since)
    if until is not None:
        law.append(F.col("updated") <= until)
    if path is not None:
        law.append(F.contains(F.coalesce("cwd", F.lit("")), F.lit(path)))
    for condition in law:
        sessions = sessions.filter(condition)
    return sessions if keys is None else sessions.join(keys.select("session_id").distinct(), "session_id", "left_semi")


def find(sessions: DataFrame, passages: DataFrame, needle: str, match: str = "dialogue", role: str | None = None) -> DataFrame:
    """(session_id, ordinal, match): literal matches, case folded, in dialogue passages or in a session's title, summary or related topics."""
    if len(needle) > 4096:
        raise ValueError("query exceeds 4096 characters")
    low = F.lit(needle.lower())
    if match == "dialogue":
        roles = [role] if role else ["user", "assistant"]
        hits = passages.filter(F.col("role").isin(roles) & F.contains(F.lower("text"), low))
        return hits.join(sessions.select("session_id"), "session_id", "left_semi").select("session_id", "ordinal", F.lit(match).alias("match"))
    held = F.contains(F.lower(F.coalesce(MATCHES[match], F.lit(""))), low)
    return sessions.filter(held).select("session_id", F.lit(None).cast("long").alias("ordinal"), F.lit(match).alias("match"))


def artifacts(mentions: DataFrame, sessions: DataFrame, name: str) -> DataFrame:
    """(path, sessions, mentions, newest): artifacts whose path holds ``name``, as sessions of a scope mention them."""
    rows = mentions.filter(F.contains(F.lower("path"), F.lit(name.lower()))).join(sessions.select("session_id", "updated"), "session_id")
    return rows.groupBy("path").agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("mentions"), F.max("updated").alias("newest"))


def topic_name(text: Column) -> Column:
    """What topics are compared by: letters and numbers, lower case, compatibility forms composed; null if nothing is left."""
    plain = F.trim(F.regexp_replace(fx.nfkc(F.lower(text)), r"[^\p{L}\p{N}]+", " "))
    return F.nullif(plain, F.lit(""))


def topic_collections(claims: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(id, title, sessions, refs, hidden): collections of the topics that two sessions at least claim, or that exist already.

    ``claims`` has (session, at, text, refs); a session's last claim of a topic counts, the first claim names it. Collections that
    fewer claim now stay, hidden.
    """
    named = claims.withColumn("name", topic_name(F.col("text"))).filter("name IS NOT NULL")
    keyed = named.withColumn("id", F.concat(F.lit("topic:"), F.substring(F.sha2("name", 256), 1, 24)))
    last = keyed.groupBy("id", "session").agg(F.max_by("refs", "at").alias("refs"))
    titles = keyed.groupBy("id").agg(F.min_by("text", F.struct("at", "session", "text")).alias("title"))
    per = last.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("session", "refs"))).alias("m"))
    both = per.join(titles, "id")
    if existing is not None:
        both = both.join(existing.select("id", F.lit(True).alias("known")), "id", "left")
    few = F.size("m") < 2
    kept = both.filter(~few | F.coalesce("known", F.lit(False))) if existing is not None else both.filter(~few)
    return kept.select("id", "title", F.col("m.session").alias("sessions"), F.flatten("m.refs").alias("refs"), few.alias("hidden"))


#: Characters of a limitation that are shown.
TOLD = 1024


def latest_observations(observations: DataFrame) -> DataFrame:
    """The newest observation (source_id, locator, at, id, ...) of every place; ties by the larger id."""
    newest = Window.partitionBy("source_id", "locator").orderBy(F.desc_nulls_last("at"), F.desc("id"))
    return observations.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def _set(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def limitations(sources: DataFrame, observations: DataFrame) -> DataFrame:
    """(kind, id, text, cut): why the library doesn't cover all, one row per source or observation with an issue.

    A source (id, harness, enabled, reachable, capability, error) has one if it is excluded, out of reach, unsupported or in error. The latest
    observation of a place (id, source_id, locator, at, admission, indexed, gaps) has one if it is kept but not indexed, or has gaps,
    and isn't excluded. A flag that is null is none. Texts over ``TOLD`` characters are ``cut``.
    """
    error = F.nullif(F.col("error"), F.lit(""))
    issue = ~_set("enabled") | ~_set("reachable") | F.coalesce(F.col("capability") == "unsupported", F.lit(False)) | error.isNotNull()
    why = F.concat(F.col("harness"), F.lit(": "), F.coalesce(error, F.when(~_set("enabled"), "excluded").otherwise("unavailable or unsupported")))
    of_sources = sources.filter(issue).select(F.lit("source").alias("kind"), F.col("id").cast("string").alias("id"), why.alias("text"))
    gaps = F.coalesce("gaps", F.array().cast("array<string>"))
    open_ = (F.coalesce("admission", F.lit("")) != "excluded") & (~_set("indexed") | (F.size(gaps) > 0))
    what = F.concat(F.col("id").cast("string"), F.lit(": "), F.when(F.size(gaps) > 0, F.array_join(gaps, "; ")).otherwise("retained but not indexed"))
    of_places = latest_observations(observations).filter(open_).select(F.lit("observation").alias("kind"), F.col("id").cast("string").alias("id"), what.alias("text"))
    both = of_sources.unionByName(of_places)
    cut = F.length("text") > TOLD
    return both.select("kind", "id", F.when(cut, F.concat(F.substring("text", 1, TOLD), F.lit("…"))).otherwise(F.col("text")).alias("text"), cut.alias("cut"))


def coverage_totals(sources: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: sources, observations, indexed, excluded, source_issues, observation_issues, partial.

    Without any source the archive isn't covered: that is partial, too.
    """
    told = limitations(sources, observations).agg(F.count_if(F.col("kind") == "source").alias("source_issues"), F.count_if(F.col("kind") == "observation").alias("observation_issues"))
    places = latest_observations(observations).agg(F.count(F.lit(1)).alias("observations"), F.count_if(_set("indexed")).alias("indexed"), F.count_if(F.col("admission") == "excluded").alias("excluded"))
    one = sources.agg(F.count(F.lit(1)).alias("sources")).join(F.broadcast(places)).join(F.broadcast(told))  # three single rows
    return one.withColumn("partial", (F.col("source_issues") + F.col("observation_issues") > 0) | (F.col("sources") == 0))
