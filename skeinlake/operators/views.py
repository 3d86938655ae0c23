"""What a reader sees of a session or a tag: surfaces, pages, catalogues, read modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands for a speaker, and how much of a tool's first line is shown.
GLYPHS = {"user": "◆", "assistant": "◇"}
STUB = 100


def surface(sess: DataFrame, tags: DataFrame) -> DataFrame:
    """(session_id, harness, title, path, models, tags, chain_members, tok_user, tok_assistant): what is told of each session.

    ``sess`` has project, cwd and chain beside these; the project names the path, or else the
    folder; a session without a chain is its only member.
    """
    sizes = sess.filter("chain IS NOT NULL").groupBy(F.col("chain").alias("__c")).agg(F.count(F.lit(1)).alias("__members"))
    named = tags.groupBy("session_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    rows = sess.join(sizes, F.col("chain") == F.col("__c"), "left").join(named, "session_id", "left")
    return rows.select(
        "session_id", "harness", "title", F.coalesce("project", "cwd").alias("path"), "models", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("__members", F.lit(1)).alias("chain_members"), "tok_user", "tok_assistant",
    )


def tag_page(sess: DataFrame, tags: DataFrame, topics: DataFrame, favourites: DataFrame, name: str) -> DataFrame:
    """(session_id, harness, topic, last_activity, model, favorite): the sessions of one tag, with the first model and the short summary's topic."""
    tagged = tags.filter(F.col("name") == name).select("session_id").distinct()
    liked = favourites.select("session_id").distinct().withColumn("__liked", F.lit(True))
    rows = sess.join(tagged, "session_id").join(topics.select("session_id", "topic"), "session_id", "left").join(liked, "session_id", "left")
    return rows.select("session_id", "harness", "topic", "last_activity", F.try_element_at("models", F.lit(1)).alias("model"), F.coalesce("__liked", F.lit(False)).alias("favorite"))


def tag_catalogue(tags: DataFrame, known: DataFrame, bodies: DataFrame) -> DataFrame:
    """(name, body, n): every known tag with its synthesis, if it has one, and how many sessions carry it."""
    counts = tags.groupBy("name").agg(F.count(F.lit(1)).alias("__n"))
    rows = known.select("name").distinct().join(counts, "name", "left").join(bodies.select("name", "body"), "name", "left")
    return rows.select("name", "body", F.coalesce("__n", F.lit(0)).alias("n"))


def read(msgs: DataFrame, mode: str = "prose") -> DataFrame:
    """(session_id, ordinal, shown): the lines of a transcript in one of three modes.

    ``msgs`` has role, text, tool_text and has_tool. prose: dialogue only; stubs: also one line for
    what is only a tool; full: everything, with roles and places.
    """
    glyph = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in GLYPHS.items() for x in kv]), F.col("role")), F.lit("·"))
    inset = lambda c: F.concat(F.lit("  "), F.replace(c, F.lit("\n"), F.lit("\n  ")))
    said = F.coalesce(F.length("text") > 0, F.lit(False))
    spoken = F.concat(glyph, F.lit(" "), inset(F.col("text")))
    if mode == "prose":
        shown = F.when(~F.col("role").isin("system", "tool") & said, spoken)
    elif mode == "stubs":
        first = F.substring(F.substring_index("tool_text", "\n", 1), 1, STUB)
        stub = F.concat(glyph, F.lit(" [tool] "), F.when(F.length("tool_text") > 0, first).otherwise("(tool activity)"))
        shown = F.when(F.col("role") == "system", None).when(F.col("has_tool") & ~said, stub).when(said, spoken)
    elif mode == "full":
        head = F.concat(glyph, F.lit(" "), "role", F.lit(" #"), F.col("ordinal").cast("string"))
        told = F.when(said, F.concat(F.lit("\n"), inset(F.col("text"))))
        tool = F.when(F.length("tool_text") > 0, F.concat(F.lit("\n  [tool] "), inset(F.col("tool_text"))))
        shown = F.concat(head, F.coalesce(told, F.lit("")), F.coalesce(tool, F.lit("")))
    else:
        raise ValueError(f"no such mode: {mode}")
    return msgs.select("session_id", "ordinal", shown.alias("shown")).filter("shown IS NOT NULL")
