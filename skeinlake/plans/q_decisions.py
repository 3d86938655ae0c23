"""Decisions, their journal, and merges of tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlake.operators import journal
from skeinlake.plans.q_sessions import MSGS, msgs
from skeinlake.plans.registry import query, table

TAGS = f"""{MSGS},
links AS (SELECT DISTINCT session_id, 't' || (ordinal * session_id % 9) AS tag FROM msgs WHERE ordinal % 2 = 0),
cands AS (SELECT DISTINCT 't' || (session_id % 9) AS name, session_id FROM msgs WHERE ordinal % 3 = 1),
names AS (SELECT tag AS name, min(session_id) AS promoted_at FROM links GROUP BY 1),
moves(f, t) AS (VALUES ('t2', 't1'), ('t3', 't1'), ('t5', 't4'))"""


def _tags(spark, sf_dir):
    m = msgs(spark, sf_dir)
    k, t = F.col("session_id"), F.lit("t")
    links = m.filter("ordinal % 2 = 0").select("session_id", F.concat(t, (F.col("ordinal") * k % 9).cast("string")).alias("tag")).distinct()
    candidates = m.filter("ordinal % 3 = 1").select(F.concat(t, (k % 9).cast("string")).alias("name"), "session_id").distinct()
    tags = links.groupBy(F.col("tag").alias("name")).agg(F.min("session_id").alias("promoted_at"))
    bodies = tags.select(F.col("name").alias("tag"), F.concat(F.lit("about "), "name").alias("body"))
    return journal.Tags(tags, links, candidates, bodies)


def _proposals(spark):
    """Two that stand; one that takes a tag twice, one of a tag that isn't there, one of itself."""
    rows = [(1, "t1", ["t2", "t3", "t2"]), (2, "t4", ["t5", "t4"]), (3, "t6", ["t2"]), (4, "t7", ["nowhere"]), (5, "t8", ["t8"])]
    return spark.createDataFrame(rows, "event long, into string, sources array<string>")


def _rows(state):
    kinds = (
        state.tags.select(F.lit("tag").alias("kind"), "name", F.col("promoted_at").alias("value")),
        state.links.select(F.lit("link").alias("kind"), F.col("tag").alias("name"), F.col("session_id").alias("value")),
        state.candidates.select(F.lit("candidate").alias("kind"), "name", F.col("session_id").alias("value")),
    )
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("tag_consolidation", f"""WITH {TAGS} SELECT 'tag' AS kind, name, promoted_at AS value FROM names WHERE name NOT IN (SELECT f FROM moves)
UNION ALL SELECT DISTINCT 'link', coalesce(t, tag), session_id FROM links LEFT JOIN moves ON tag = f UNION ALL SELECT DISTINCT 'candidate', coalesce(t, name), session_id FROM cands LEFT JOIN moves ON name = f
UNION ALL SELECT 'synthesis', name, NULL FROM names WHERE name NOT IN (SELECT f FROM moves UNION SELECT t FROM moves)""")
def tag_consolidation(spark, sf_dir):
    """Tags, links, candidates and syntheses after a batch of merges."""
    made, _ = journal.consolidate(_tags(spark, sf_dir), _proposals(spark))
    return _rows(made).unionByName(made.syntheses.select(F.lit("synthesis").alias("kind"), F.col("tag").alias("name"), F.lit(None).cast("long").alias("value")))


@query("tag_consolidation_undone", f"""WITH {TAGS} SELECT 'tag' AS kind, name, promoted_at AS value FROM names WHERE name <> 't5'
UNION ALL SELECT DISTINCT 'link', CASE WHEN tag = 't5' THEN 't4' ELSE tag END, session_id FROM links UNION ALL SELECT DISTINCT 'candidate', CASE WHEN name = 't5' THEN 't4' ELSE name END, session_id FROM cands""")
def tag_consolidation_undone(spark, sf_dir):
    """The same after the first merge was taken back: its tags hold what they held, the other merge stands."""
    made, log = journal.consolidate(_tags(spark, sf_dir), _proposals(spark))
    return _rows(journal.undo(made, log, 1)[0])


@query("decision_journal", """WITH d AS (SELECT conv_id, turn, md5(text) AS value, max(turn) OVER (PARTITION BY conv_id) AS last, lag(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT 'favorite' AS kind, 'c' || conv_id AS target, turn AS seq, NULL AS refused, before, value AS after FROM d
UNION ALL SELECT 'favorite', 'c' || conv_id, turn + 1000, CASE WHEN conv_id % 3 = 0 AND turn > 0 THEN 'newer user decision exists' WHEN conv_id % 3 = 2 THEN 'undo unavailable' END, value, CASE WHEN conv_id % 3 = 1 OR (conv_id % 3 = 0 AND turn = 0) THEN before ELSE value END FROM d WHERE turn = last""")
def decision_journal(spark, sf_dir):
    """Decisions on each conversation; in the end one undo: of the first, of the last, or of none that there is."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    k, none = F.col("conv_id"), F.lit(None).cast("string")
    target = F.concat(F.lit("c"), k.cast("string"))
    name = lambda turn: F.concat_ws(":", k.cast("string"), turn.cast("string"))
    sets = c.select(F.lit("favorite").alias("kind"), target.alias("target"), F.col("turn").alias("seq"), name(F.col("turn")).alias("id"), F.lit("set").alias("action"), F.md5("text").alias("value"), none.alias("of"))
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    of = F.when(k % 3 == 0, name(F.lit(0))).when(k % 3 == 1, name(F.col("last"))).otherwise("nothing")
    undos = ends.select(F.lit("favorite").alias("kind"), target.alias("target"), (F.col("last") + 1000).alias("seq"), F.concat(F.lit("undo "), k.cast("string")).alias("id"), F.lit("undo").alias("action"), none.alias("value"), of.alias("of"))
    return journal.fold(sets.unionByName(undos)).select("kind", "target", "seq", "refused", "before", "after")
