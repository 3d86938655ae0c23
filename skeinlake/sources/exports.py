"""Exports of chat services: trees of messages, event streams, Markdown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHATGPT = (
    "array<struct<id: string, title: string, current_node: string, mapping: map<string, struct<parent: string, "
    "message: struct<id: string, author: struct<role: string>, create_time: double, content: struct<content_type: string, parts: array<string>>>>>>>"
)
CLAUDE = "array<struct<uuid: string, name: string, chat_messages: array<struct<uuid: string, sender: string, text: string, content: string, created_at: string>>>>"


class BranchCycle(ValueError):
    """A tree of messages leads back to itself."""


def chatgpt(documents: DataFrame) -> DataFrame:
    """(id, title, ordinal, role, text, at_ms) of the current branch of each conversation.

    ``documents`` has the export's JSON in ``value``. The branch is walked from the
    current node to the root through the map of nodes, one conversation a row.
    """
    one = documents.select(F.explode(F.from_json("value", CHATGPT)).alias("c")).select("c.*")
    nodes = F.size("mapping")
    start = F.struct(F.col("current_node").alias("at"), F.array().cast("array<string>").alias("way"))

    def up(s, _):
        parent = F.try_element_at("mapping", s["at"])["parent"]
        return F.when(s["at"].isNull(), s).otherwise(F.struct(parent.alias("at"), F.concat(F.array(s["at"]), s["way"]).alias("way")))

    walked = one.withColumn("w", F.aggregate(F.sequence(F.lit(1), F.greatest(nodes, F.lit(1))), start, up))
    told = walked.withColumn("w", F.when(F.col("w.at").isNull(), F.col("w.way")).otherwise(F.raise_error(F.lit("Invalid branch cycle")).cast("array<string>")))
    texts = F.filter(F.transform("w", lambda n: F.try_element_at("mapping", n)["message"]), lambda m: m.isNotNull())
    rows = told.select("id", "title", F.posexplode(texts).alias("ordinal", "m"))
    return rows.select(
        "id", "title", "ordinal", F.col("m.author.role").alias("role"), F.array_join("m.content.parts", "\n").alias("text"), (F.col("m.create_time") * 1000).cast("long").alias("at_ms")
    )


def claude(documents: DataFrame) -> DataFrame:
    """(id, title, ordinal, role, text, at) of an export with flat lists of messages."""
    one = documents.select(F.explode(F.from_json("value", CLAUDE)).alias("c")).select("c.*")
    rows = one.select(F.col("uuid").alias("id"), F.col("name").alias("title"), F.posexplode("chat_messages").alias("ordinal", "m"))
    return rows.select("id", "title", "ordinal", F.col("m.sender").alias("role"), F.coalesce("m.text", "m.content").alias("text"), F.col("m.created_at").alias("at"))


def cursor_markdown(documents: DataFrame) -> DataFrame:
    """(path, title, ordinal, role, text) of Markdown with **User** and **Cursor** turns."""
    text = F.regexp_replace("value", r"\r\n", "\n")
    marks = r"(?m)^\*\*(User|Cursor)\*\*\s*\n"
    roles = F.regexp_extract_all(text, F.lit(marks), F.lit(1))
    bodies = F.split(text, marks, -1)
    pairs = F.arrays_zip(roles.alias("role"), F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))).alias("text"))
    title = F.regexp_extract(text, r"(?m)^# (.+)", 1)
    rows = documents.select("path", title.alias("title"), F.posexplode(pairs).alias("ordinal", "m"))
    clean = F.regexp_replace("m.text", r"\n---\s*$", "")
    return rows.select("path", "title", "ordinal", F.when(F.col("m.role") == "User", "user").otherwise("assistant").alias("role"), clean.alias("text"))


def gemini_stream(lines: DataFrame) -> DataFrame:
    """(path, id, ordinal, text) of what is left after upserts, resets and exclusive rewinds.

    ``lines`` has path, line_no, line. Each event acts on what those before it left,
    so the events of a file are folded in order; an upsert keeps its message's place.
    """
    schema = "id string, content string, `$rewindTo` string, `$set` struct<messages: array<struct<id: string, content: string>>>"
    e = F.from_json("line", schema)
    events = lines.select("path", "line_no", e["id"].alias("id"), e["content"].alias("text"), e["$rewindTo"].alias("rewind"), e["$set"]["messages"].alias("reset"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, str | None] = {}
        for r in rows.sort_values("line_no").itertuples():
            if r.rewind is not None:
                ids = list(held)
                for gone in ids[ids.index(r.rewind) :] if r.rewind in held else ids:
                    del held[gone]
            elif r.id is not None:
                held[r.id] = r.text
            elif r.reset is not None:
                held = {m["id"]: m["content"] for m in r.reset}
        told = [(rows["path"].iloc[0], k, i, v) for i, (k, v) in enumerate(held.items())]
        return pd.DataFrame(told, columns=["path", "id", "ordinal", "text"])

    return events.groupBy("path").applyInPandas(fold, "path string, id string, ordinal int, text string")
