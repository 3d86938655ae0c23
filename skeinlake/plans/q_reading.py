"""Transcripts for readers, selections, topics and the log of searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlake.functions import text as fx
from skeinlake.operators import library, searchlog, transcript
from skeinlake.plans.q_sessions import MSGS, RAW, msgs, raw
from skeinlake.plans.registry import query, table

TRANSCRIPT = f"""{RAW},
acts AS (SELECT session_id, ordinal, i AS position, CASE i % 2 WHEN 0 THEN 'call' ELSE 'result' END AS kind, 'run' || i AS name, md5(text) AS text FROM (SELECT *, unnest(range(0, strlen(text) % 3)) AS i FROM raw WHERE side = 'assistant')),
nested AS (SELECT session_id, ordinal, string_agg(kind || ':' || name || ':' || text, ',' ORDER BY position) AS tools FROM acts GROUP BY ALL),
p AS (SELECT l.session_id, row_number() OVER (PARTITION BY l.session_id ORDER BY first_ordinal) - 1 AS logical_ordinal, first_ordinal AS raw_ordinal, record_kind, side, text, members AS replay_count, coalesce(n.tools, '') AS tools FROM logical l LEFT JOIN nested n ON n.session_id = l.session_id AND n.ordinal = first_ordinal)"""


def _projection(spark, sf_dir):
    r = raw(spark, sf_dir)
    n = F.octet_length("text") % 3
    each = r.filter("side = 'assistant'").select("session_id", F.col("ordinal").alias("raw_ordinal"), "text", F.explode(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < n)).alias("position"))
    acts = each.select(
        "session_id", "raw_ordinal", "position", F.when(F.col("position") % 2 == 0, "call").otherwise("result").alias("kind"), F.concat(F.lit("run"), F.col("position").cast("string")).alias("name"),
        F.md5("text").alias("text"), F.lit(None).cast("string").alias("id"),
    )
    return transcript.activity(r, acts)


def _shown(records):
    tools = F.array_join(F.transform("tools", lambda t: F.concat_ws(":", t["kind"], t["name"], t["text"])), ",")
    return records.select("session_id", "logical_ordinal", "raw_ordinal", "record_kind", "side", F.md5("prose").alias("digest"), "replay_count", tools.alias("tools"))


@query("transcript_activity", f"WITH {TRANSCRIPT} SELECT session_id, logical_ordinal, raw_ordinal, record_kind, side, md5(text) AS digest, replay_count, tools FROM p")
def transcript_activity(spark, sf_dir):
    """Every logical record with the calls and results of its representative."""
    return _shown(_projection(spark, sf_dir))


@query("transcript_dialogue", f"WITH {TRANSCRIPT} SELECT session_id, logical_ordinal, raw_ordinal, record_kind, side, md5(text) AS digest, replay_count, tools FROM p WHERE ((record_kind = 'real_user' AND side = 'user') OR (record_kind = 'assistant_dialogue_prose' AND side = 'assistant')) AND rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def transcript_dialogue(spark, sf_dir):
    """The turns among them."""
    return _shown(transcript.dialogue(_projection(spark, sf_dir)))


@query("selection_bytes", """WITH t AS (SELECT doc_id, '😀' || text AS text, doc_id % 7 AS a, doc_id % 7 + doc_id % 50 AS b FROM documents)
SELECT doc_id, CASE WHEN a <> 1 AND b <> 1 AND b <= length(text) + 1 THEN CASE WHEN a = 0 THEN 0 ELSE strlen(substr(text, 1, a - 1)) END END AS "start", CASE WHEN a <> 1 AND b <> 1 AND b <= length(text) + 1 THEN CASE WHEN b = 0 THEN 0 ELSE strlen(substr(text, 1, b - 1)) END END AS "end" FROM t""")
def selection_bytes(spark, sf_dir):
    """Selections that begin at, in and behind a pair of surrogates, in bytes."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("😀"), "text").alias("text"), (F.col("doc_id") % 7).cast("int").alias("a"), (F.col("doc_id") % 7 + F.col("doc_id") % 50).cast("int").alias("b"))
    s = fx.selection_bytes(F.col("text"), F.col("a"), F.col("b"))
    return t.select("doc_id", s["start"].alias("start"), s["end"].alias("end"))


@query("topic_collections", f"""WITH {MSGS}, w AS (SELECT session_id, ordinal, trim(regexp_replace(nfc_normalize(lower(string_split(text, ' ')[1])), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS name FROM msgs WHERE role = 'user'),
n AS (SELECT name, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE newest) AS refs FROM (SELECT *, ordinal = max(ordinal) OVER (PARTITION BY name, session_id) AS newest FROM w WHERE name <> '') GROUP BY 1)
SELECT 'topic:' || substr(sha256(name), 1, 24) AS id, sessions, refs FROM n WHERE sessions >= 2""")
def topic_collections(spark, sf_dir):
    """Topics that two sessions at least share: the first word of what users say, here written in full width every other time."""
    m = msgs(spark, sf_dir).filter("role = 'user'")
    word = F.element_at(F.split("text", " "), 1)
    letters = "".join(map(chr, range(0x21, 0x7F)))
    wide = F.translate(word, letters, "".join(chr(ord(c) + 0xFEE0) for c in letters))
    claims = m.select(F.col("session_id").alias("session"), F.col("ordinal").alias("at"), F.when(F.col("session_id") % 2 == 0, wide).otherwise(word).alias("text"), F.array(F.col("ordinal")).alias("refs"))
    found = library.topic_collections(claims)
    return found.select("id", F.size("sessions").cast("long").alias("sessions"), F.size("refs").cast("long").alias("refs"))


@query("search_log", f"""WITH {MSGS}, q AS (SELECT session_id AS id, max(ordinal) AS latest FROM msgs GROUP BY 1), hits AS (SELECT session_id, ordinal FROM msgs WHERE contains(text, 'the '))
SELECT id, CASE id % 5 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 2 THEN 'claude' WHEN 3 THEN 'human' ELSE 'prime' END AS harness, CASE id % 5 WHEN 0 THEN 't' || id WHEN 1 THEN 'c' || id WHEN 4 THEN 'root:' || id END AS native_id,
(SELECT count(*) FROM hits WHERE session_id = id) + 1 AS total, CASE WHEN (SELECT count(*) FROM hits WHERE session_id = id) > 0 THEN 1 ELSE 0 END AS returned, (SELECT string_agg(ordinal::VARCHAR, ',' ORDER BY ordinal) FROM hits WHERE session_id = id) AS ordinals,
CASE WHEN id % 2 = 0 THEN 'source' END AS filtered_by, 60 - latest AS index_age_min, (SELECT count(*) FROM hits WHERE session_id = id) + 1 - CASE WHEN (SELECT count(*) FROM hits WHERE session_id = id) > 0 THEN 1 ELSE 0 END AS truncated FROM q""")
def search_log(spark, sf_dir):
    """A search logged for each session, by callers of all kinds."""
    m = msgs(spark, sf_dir)
    k = F.col("id")
    found = m.filter(F.contains("text", F.lit("the ")))
    hits = found.select(F.col("session_id").alias("search"), F.col("ordinal").alias("place"), "harness", "native_id", "ordinal")
    totals = found.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    n = k.cast("string")
    env = (
        F.when(k % 5 == 0, F.create_map(F.lit("CODEX_THREAD_ID"), F.concat(F.lit("t"), n)))
        .when(k % 5 == 1, F.create_map(F.lit("CLAUDE_CODE_SESSION_ID"), F.concat(F.lit("c"), n), F.lit("CLAUDECODE"), F.lit("1")))
        .when(k % 5 == 2, F.create_map(F.lit("CLAUDECODE"), F.lit("1")))
        .when(k % 5 == 4, F.create_map(F.lit("CALLER"), F.concat(F.lit("prime:root:"), n), F.lit("CODEX_THREAD_ID"), F.lit("x")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    asked = m.groupBy(F.col("session_id").alias("id")).agg(F.max("ordinal").alias("last")).join(totals, "id", "left")
    asked = asked.select(
        "id", ((60 - F.col("last")) * 60_000).alias("at"), F.lit("cli-search").alias("surface"), env.alias("env"), (k % 5 == 3).alias("interactive"), F.lit("the").alias("query"),
        F.create_map(F.lit("source"), F.when(k % 2 == 0, "claude"), F.lit("since"), F.lit(None).cast("string")).alias("scope"), (F.coalesce("n", F.lit(0)) + 1).alias("total"),
    )
    logged = searchlog.log(asked, hits, F.lit(0).cast("long"))
    one = F.try_element_at("refs", F.lit(1))
    return logged.select(
        "id", "caller.harness", "caller.native_id", "total", "returned", F.array_join(one["ordinals"].cast("array<string>"), ",").alias("ordinals"),
        F.array_join("uncovered.filtered_by", ",").alias("filtered_by"), "uncovered.index_age_min", "uncovered.truncated",
    )
