"""Every condition of the filter law over all sessions, scalar checks, and an export with flat messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlake.functions import text as fx
from skeinlake.operators import filters
from skeinlake.plans.q_sessions import SESS, sess
from skeinlake.plans.registry import query, table
from skeinlake.sources import exports

WIDE = f"""{SESS}, w AS (SELECT sess.*, CASE WHEN session_id % 4 <> 0 THEN ['m' || (session_id % 3), 'm' || (session_id % 5)] END AS models,
  CASE WHEN session_id % 2 = 0 THEN '/p/' || (session_id % 6) END AS project, '/p/' || (session_id % 7) AS original_project, '/p/' || (session_id % 5) || '/src' AS cwd, '/store/' || (session_id % 9) AS source_path,
  CASE session_id % 3 WHEN 0 THEN 'dialogue_history' WHEN 1 THEN 'metadata_shell' ELSE 'current_context_projection' END AS artifact_kind,
  CASE session_id % 3 WHEN 1 THEN 'current' WHEN 2 THEN 'snapshot_only' ELSE 'legacy_unverified' END AS source_validation,
  CASE WHEN session_id % 3 <> 0 THEN session_id - session_id % 4 END AS chain, CASE WHEN session_id % 8 = 7 THEN 'orphaned' ELSE 'valid' END AS status,
  CASE WHEN session_id % 5 < 2 THEN 's' END AS summary, CASE session_id % 6 WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' END AS job,
  CASE session_id % 4 WHEN 0 THEN 'agent' WHEN 1 THEN 'human' WHEN 2 THEN 'mixed' END AS origin FROM sess)"""


def _wide(spark, sf_dir):
    k = F.col("session_id")
    named = lambda before, n: F.concat(F.lit(before), (k % n).cast("string"))
    return sess(spark, sf_dir).withColumns(
        {
            "models": F.when(k % 4 != 0, F.array(named("m", 3), named("m", 5))),
            "project": F.when(k % 2 == 0, named("/p/", 6)),
            "original_project": named("/p/", 7),
            "cwd": F.concat(named("/p/", 5), F.lit("/src")),
            "source_path": named("/store/", 9),
            "artifact_kind": F.when(k % 3 == 0, "dialogue_history").when(k % 3 == 1, "metadata_shell").otherwise("current_context_projection"),
            "source_validation": F.when(k % 3 == 1, "current").when(k % 3 == 2, "snapshot_only").otherwise("legacy_unverified"),
            "chain": F.when(k % 3 != 0, k - k % 4),
            "status": F.when(k % 8 == 7, "orphaned").otherwise("valid"),
            "summary": F.when(k % 5 < 2, "s"),
            "job": F.when(k % 6 == 1, "pending").when(k % 6 == 2, "failed"),
            "origin": F.when(k % 4 == 0, "agent").when(k % 4 == 1, "human").when(k % 4 == 2, "mixed"),
        }
    )


CHOSEN = {
    "models": (dict(models=["m2", "m4"]), "list_has_any(models, ['m2', 'm4'])"),
    "projects": (dict(projects=["/p/2", "/p/6"]), "project IN ('/p/2', '/p/6') OR original_project IN ('/p/2', '/p/6')"),
    "paths": (dict(paths=["/p/3/src", "/store/4"]), "cwd IN ('/p/3/src', '/store/4') OR source_path IN ('/p/3/src', '/store/4')"),
    "kinds": (dict(artifact_kinds=["dialogue_history"], validations=["legacy_unverified", "current"]), "artifact_kind = 'dialogue_history' AND source_validation IN ('legacy_unverified', 'current')"),
    "chain": (dict(chain=4), "chain = 4"),
    "chained": (dict(chain="chained"), "chain IS NOT NULL"),
    "standalone": (dict(chain="standalone"), "chain IS NULL"),
    "origins": (dict(origins=["mixed", "human"]), "origin IN ('mixed', 'human')"),
    "no_agents": (dict(hide_agents=True, since=1), "(origin IS NULL OR origin <> 'agent') AND last_activity >= 1"),
    "indexed": (dict(states=["indexed"], until=9), "status = 'valid' AND last_activity < 9"),
    "orphaned": (dict(states=["orphaned"]), "status = 'orphaned'"),
    "summarized": (dict(states=["summarized"]), "summary IS NOT NULL"),
    "unsummarized": (dict(states=["unsummarized"], harnesses=["claude", "kilo"]), "summary IS NULL AND harness IN ('claude', 'kilo')"),
    "open_jobs": (dict(states=["pending", "failed"]), "job IN ('pending', 'failed')"),
}


@query("filter_conditions", f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT '{k}' AS filter, session_id FROM w WHERE {sql}" for k, (_, sql) in CHOSEN.items()))
def filter_conditions(spark, sf_dir):
    """Each condition by itself or with another, over all sessions."""
    rows, found = _wide(spark, sf_dir), None
    for name, (chosen, _) in CHOSEN.items():
        one = filters.apply(rows, filters.SessionFilter(**chosen)).select(F.lit(name).alias("filter"), "session_id")
        found = one if found is None else found.unionByName(one)
    return found


@query("filter_layer_tags", f"""WITH {WIDE}, l AS (SELECT session_id, 'f' || (session_id % 2) AS facet, 't' || (session_id % 5) AS tag, CASE WHEN session_id % 3 = 0 THEN 'p' || (session_id % 2) END AS parent FROM w)
SELECT session_id FROM l WHERE (facet = 'f0' AND (tag = 't3' OR parent = 't3')) OR (facet = 'f0' AND (tag = 'p0' OR parent = 'p0')) OR (facet = 'f1' AND (tag = 't1' OR parent = 't1'))""")
def filter_layer_tags(spark, sf_dir):
    """Tags under facets, or their parents; the terms are put together as a user picks them."""
    s, k = _wide(spark, sf_dir), F.col("session_id")
    named = lambda before, n: F.concat(F.lit(before), (k % n).cast("string"))
    layer = s.select("session_id", named("f", 2).alias("facet"), named("t", 5).alias("tag"), F.when(k % 3 == 0, named("p", 2)).alias("parent"))
    chosen = filters.add_term(filters.SessionFilter(), "facet", "f0")
    for tag in ("t3", "p0", "t9"):
        chosen = filters.add_term(chosen, "tag", tag)
    chosen = filters.remove_term(chosen, "tag", "t9")
    chosen = filters.SessionFilter(layer_tags=[*chosen.layer_tags, ("f1", "t1")])
    return filters.apply(s, chosen, layer_tags=layer).select("session_id")


@query("price_of_orders", """SELECT o_orderkey, round((o_custkey * 3.0 + o_orderkey * 15.0) / 1000000, 8) AS usd FROM orders""")
def price_of_orders(spark, sf_dir):
    usd = fx.price_usd(F.col("o_custkey"), F.col("o_orderkey"), 3.0, 15.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", usd.alias("usd"))


@query("scalar_checks", """WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '2024-03-0' || (event_id % 9 + 1) || 'T01:02:03Z' WHEN 1 THEN (1700000000000 + event_id)::VARCHAR WHEN 2 THEN 'never' WHEN 3 THEN '12345678901234567' ELSE '  ' END AS t,
  CASE WHEN event_id % 3 = 0 THEN '0a1b2c3d-0000-4000-8000-' || lpad(event_id::VARCHAR, 12, '0') ELSE md5(props) END AS u FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_ms(t::TIMESTAMP) WHEN 1 THEN t::BIGINT WHEN 3 THEN t::BIGINT END AS at, event_id % 3 = 0 AS is_id, CASE WHEN trim(t) = '' THEN NULL ELSE trim(t) END AS trimmed FROM x""")
def scalar_checks(spark, sf_dir):
    """Times as ISO text, digits (more than sixteen too) or neither; UUIDs or not; blanks to null."""
    k = F.col("event_id")
    t = (
        F.when(k % 5 == 0, F.concat(F.lit("2024-03-0"), (k % 9 + 1).cast("string"), F.lit("T01:02:03Z")))
        .when(k % 5 == 1, (k + 1_700_000_000_000).cast("string"))
        .when(k % 5 == 2, "never").when(k % 5 == 3, "12345678901234567").otherwise("  ")
    )
    u = F.when(k % 3 == 0, F.concat(F.lit("0a1b2c3d-0000-4000-8000-"), F.lpad(k.cast("string"), 12, "0"))).otherwise(F.md5("props"))
    rows = table(spark, sf_dir, "events").select("event_id", t.alias("t"), u.alias("u"))
    return rows.select("event_id", fx.parse_time_ms(F.col("t")).alias("at"), fx.is_uuid(F.col("u")).alias("is_id"), fx.trim_to_null(F.col("t")).alias("trimmed"))


@query("claude_export", """SELECT 'c' || conv_id AS id, 'title ' || conv_id AS title, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ordinal, CASE role WHEN 'user' THEN 'human' ELSE role END AS role, md5(text) AS digest FROM conversations""")
def claude_export(spark, sf_dir):
    """Conversations as documents with flat lists of messages, every second text under another name."""
    c = table(spark, sf_dir, "conversations")
    plain = F.when(F.col("turn") % 2 == 0, F.col("text"))
    other = F.when(F.col("turn") % 2 == 1, F.col("text"))
    message = F.struct("turn", F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), plain.alias("text"), other.alias("content"), F.lit("2024-01-01").alias("created_at"))
    told = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("chat_messages"))
    own = F.col("conv_id").cast("string")
    whole = F.struct(F.concat(F.lit("c"), own).alias("uuid"), F.concat(F.lit("title "), own).alias("name"), "chat_messages")
    rows = exports.claude(told.select(F.to_json(F.array(whole)).alias("value")))
    return rows.select("id", "title", "ordinal", "role", F.md5("text").alias("digest"))
