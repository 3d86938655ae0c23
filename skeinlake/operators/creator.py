"""Who started a session: launch metadata first, then the opener, then the voice of what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions import authorship as au
from skeinlake.functions import text as fx

#: Launch details of workers and of scripts.
WORKER_DETAIL = "(agentId|isSidechain|subagents-path|thread_spawn|rlm-child|parent_id|subagent|external-agent-transcript|subagent-path)"
SCRIPTED_DETAIL = "(sdk|codex:source:exec)"
APPROVAL_REVIEW = "^The following is the Codex agent history (whose request action you are assessing|added since your last approval assessment)"
TEMPLATE_SESSIONS = 3
TEMPLATE_LENGTH = 60


def classified(msgs: DataFrame, typos=None) -> DataFrame:
    """User-side messages with rule, author, human and brief scores."""
    rule = au.author_rule(F.col("text"))
    human, brief = au.voice(F.col("text"), typos)
    user = msgs.filter(F.col("role") == "user").withColumn("rule", rule)
    return user.withColumns({"author": au.author(F.col("rule")), "human": human, "brief": brief})


def openers(user: DataFrame) -> DataFrame:
    """(session_id, ordinal, rule, human, brief, opener): the first record that is no plumbing."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ordinal"))
    first = user.filter("author <> 'harness'").withColumn("__rn", place).filter("__rn = 1")
    return first.select("session_id", "ordinal", "rule", "author", "human", "brief", fx.opener_key(F.col("text")).alias("opener"))


def templated(first: DataFrame, sessions: int = TEMPLATE_SESSIONS, length: int = TEMPLATE_LENGTH) -> DataFrame:
    """(opener, n): openers that several sessions share, so scripts wrote them."""
    usable = first.filter((F.col("author") != "agent") & (F.length("opener") >= length))
    counted = usable.groupBy("opener").agg(F.countDistinct("session_id").alias("n"))
    return counted.filter(F.col("n") >= sessions)


def verdicts(msgs: DataFrame, launch: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(session_id, started_by, confidence) for every session of ``launch`` (session_id, origin, detail).

    With ``known`` (word) misspellings count in the voice of messages; without, none do.
    """
    if known is None:
        msgs = msgs.withColumn("typos", F.lit(0))
    else:
        msgs = msgs.join(typos(msgs.filter(F.col("role") == "user"), known), ["session_id", "ordinal"], "left").withColumn("typos", F.coalesce("typos", F.lit(0)))
    user = classified(msgs, F.col("typos"))
    first = openers(user)
    scripts = templated(first).select(F.col("opener").alias("__o"))
    f = first.select(
        "session_id", F.col("ordinal").alias("f_ordinal"), F.col("rule").alias("f_rule"), F.col("author").alias("f_author"),
        F.col("human").alias("f_human"), F.col("brief").alias("f_brief"), "opener",
    )
    later = user.join(f.select("session_id", "f_ordinal"), "session_id", "left")
    voiced = (F.col("author") == "human") & (F.col("ordinal") > F.col("f_ordinal")) & ((F.col("human") >= F.col("brief") + 2) | ((F.col("typos") >= 1) & (F.col("human") > F.col("brief"))))
    counts = later.groupBy("session_id").agg(
        F.count_if(F.col("author") == "human").alias("human_turns"),
        F.count_if(voiced).alias("follow_ups"),
        F.max(F.trim("text").rlike(APPROVAL_REVIEW)).alias("review"),
    )
    s = launch.join(counts, "session_id", "left").join(f, "session_id", "left").join(scripts, F.col("opener") == F.col("__o"), "left")
    s = s.withColumns({"follow_ups": F.coalesce("follow_ups", F.lit(0)), "human_turns": F.coalesce("human_turns", F.lit(0)), "detail": F.coalesce("detail", F.lit(""))})
    lead = F.col("f_human") - F.col("f_brief")
    launched = (F.col("detail") != "") & (F.col("origin") == "human")
    follow = F.col("follow_ups")

    def verdict(who: str, how: float):
        return F.struct(F.lit(who).alias("started_by"), F.lit(how).alias("confidence"))

    rule = (
        F.when(F.col("detail").rlike(WORKER_DETAIL), verdict("agent", 0.97))
        .when(F.col("detail").rlike(SCRIPTED_DETAIL) & ~F.col("detail").contains("direct-cli") & (follow < 2), verdict("agent", 0.85))
        .when(F.col("f_rule").isNull() & F.coalesce("review", F.lit(False)), verdict("agent", 0.97))
        .when(F.col("f_rule").isNull() & (F.col("origin") == "human"), verdict("unknown", 0.4))
        .when(F.col("f_rule").isNull(), verdict("unknown", 0.2))
        .when((F.col("f_author") == "agent") & launched & (follow >= 2), verdict("human", 0.7))
        .when(F.col("f_author") == "agent", verdict("agent", 0.9))
        .when(F.col("__o").isNotNull() & (follow == 0), verdict("agent", 0.85))
        .when((lead >= 1) & (F.col("human_turns") >= 2), verdict("human", 0.95))
        .when(lead >= 1, verdict("human", 0.85))
        .when(follow >= 2, verdict("human", 0.85))
        .when(follow >= 1, verdict("human", 0.7))
        .when(F.col("f_rule") != "human:typed", verdict("human", 0.8))
        .when(lead <= -4, verdict("agent", 0.9))
        .when(lead <= -2, verdict("agent", 0.75))
        .otherwise(verdict("unknown", 0.5))
    )
    return s.select("session_id", rule.alias("v")).select("session_id", "v.started_by", "v.confidence")


def effective(sess: DataFrame, corrections: DataFrame, evidence: DataFrame) -> DataFrame:
    """(key, creator): a correction, else what the evidence knows, else 'empty', else the raw origin.

    Sides join on ``key``; ``sess`` has (key, origin, turns), the others (key, creator).
    """
    c = corrections.select("key", F.col("creator").alias("__c"))
    e = evidence.select("key", F.col("creator").alias("__e"))
    known = F.when(F.col("__e") != "unknown", F.col("__e"))
    empty = F.when(F.col("turns") == 0, F.lit("empty"))
    joined = sess.join(c, "key", "left").join(e, "key", "left")
    return joined.select("key", F.coalesce("__c", known, empty, "__e", "origin").alias("creator"))


def learned_vocabulary(msgs: DataFrame, least: int = 4) -> DataFrame:
    """(word, n): words of 5 to 18 letters that recur in assistant prose."""
    words = F.regexp_extract_all(F.lower(F.substring("text", 1, 3000)), F.lit(r"(?<![A-Za-z0-9_])[a-z]{5,18}(?![A-Za-z0-9_])"), F.lit(0))
    told = msgs.filter(F.col("role") == "assistant").select(F.explode(words).alias("word"))
    return told.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


#: Endings that an inflected word may have, and what its base has in their place.
ENDINGS = [
    ("s", ""), ("es", ""), ("ies", "y"), ("ied", "y"), ("ier", "y"), ("iest", "y"), ("ed", ""), ("d", ""),
    ("ing", ""), ("ing", "e"), ("er", ""), ("r", ""), ("est", ""), ("st", ""), ("ly", ""),
]
DOUBLING = "(ed|ing|er|est)$"


def _bases(word: Column) -> Column:
    """What an inflected word may derive from; three letters at least are left of it."""
    plain = [F.when(F.endswith(word, F.lit(e)) & (F.length(word) - len(e) >= 3), F.concat(F.substring(word, F.lit(1), F.length(word) - len(e)), F.lit(put))) for e, put in ENDINGS]
    # "running": the doubled letter goes with the ending
    stem = F.regexp_replace(word, DOUBLING, "")
    doubled = F.when(word.rlike(DOUBLING) & (F.length(stem) >= 3) & stem.rlike(r"(.)\1$"), F.substring(stem, F.lit(1), F.length(stem) - 1))
    return F.filter(F.array(*plain, doubled), lambda b: b.isNotNull())


def _keys(word: Column) -> Column:
    """The word and all that a deletion makes of it: words one edit apart share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def typos(msgs: DataFrame, known: DataFrame) -> DataFrame:
    """(session_id, ordinal, typos): misspelt words of each message that has some.

    A misspelling is a lower-case word that ``known`` (word) hasn't, nor a base of it, and that is one
    deletion, insertion, replacement or swap of neighbours away from a known word. Distinct
    words meet the known ones by what deletions make of both, so no word is compared with all.
    """
    words = known.select("word").distinct()
    raw = F.split(F.substring("text", 1, 4000), r"\s+")
    clean = F.transform(raw, lambda w: F.regexp_replace(F.regexp_replace(w, "^[(\"'`]+", ""), "[)\"'`.,;:!?]+$", ""))
    told = msgs.select("session_id", "ordinal", F.explode(clean).alias("word")).filter(F.col("word").rlike("^[a-z]{5,18}$"))
    counted = told.groupBy("session_id", "ordinal", "word").agg(F.count(F.lit(1)).alias("n"))
    unknown = counted.select("word").distinct().join(words, "word", "left_anti")
    derived = unknown.select("word", F.explode(_bases(F.col("word"))).alias("base")).join(words.withColumnRenamed("word", "base"), "base", "left_semi")
    strange = unknown.join(derived.select("word").distinct(), "word", "left_anti")
    left = strange.select("word", F.explode(_keys(F.col("word"))).alias("key"))
    right = words.select(F.col("word").alias("other"), F.explode(_keys(F.col("word"))).alias("key"))
    near = left.join(right, "key").select("word", "other").distinct()
    # a swap of neighbours is two replacements of the same letters
    w, o = F.col("word"), F.col("other")
    at = F.array_min(F.filter(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(w, i, F.lit(1)) != F.substring(o, i, F.lit(1))))
    swapped = F.concat(F.substring(w, F.lit(1), at - 1), F.substring(w, at + 1, F.lit(1)), F.substring(w, at, F.lit(1)), F.substring(w, at + 2, F.length(w)))
    close = (F.levenshtein(w, o) <= 1) | ((F.length(w) == F.length(o)) & F.coalesce(swapped == o, F.lit(False)))
    wrong = near.filter(close).select("word").distinct()
    return counted.join(wrong, "word").groupBy("session_id", "ordinal").agg(F.sum("n").alias("typos"))
