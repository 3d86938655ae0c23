"""Views over sessions: roll-ups, collapsed chains, scopes, answers, misspellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlake.functions import text as fx
from skeinlake.operators import creator, graph, library, reports, topics, views
from skeinlake.plans.q_sessions import MSGS, SESS, msgs, sess
from skeinlake.plans.registry import query, table

SHOWN = """shown AS (
  SELECT l_orderkey AS session_id, l_linenumber AS episode, 't' || (l_partkey % 40) AS tag, CASE WHEN l_partkey % 40 < 20 THEN 'p' || (l_partkey % 5) END AS parent FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'facet:' || l_returnflag, NULL FROM lineitem)"""


@query("detail_tag_rollup", f"""WITH {SHOWN}, fe AS (SELECT DISTINCT session_id, episode FROM shown WHERE tag = 'facet:R'),
members AS (SELECT DISTINCT s.tag, s.parent FROM shown s JOIN fe USING (session_id, episode) WHERE s.tag NOT LIKE 'facet:%'),
visible AS (SELECT DISTINCT session_id, tag, parent FROM shown)
SELECT r.label, NULL::VARCHAR AS parent, count(DISTINCT v.session_id) AS n FROM (SELECT DISTINCT coalesce(parent, tag) AS label FROM members) r JOIN visible v ON v.tag = r.label OR v.parent = r.label GROUP BY r.label
UNION ALL SELECT m.tag, m.parent, count(DISTINCT v.session_id) FROM members m JOIN visible v ON v.tag = m.tag WHERE m.parent IS NOT NULL GROUP BY m.parent, m.tag""")
def detail_tag_rollup(spark, sf_dir):
    """Orders as sessions, their lines as episodes, parts as tags, the return flag as facet."""
    k = F.col("l_partkey") % 40
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("episode"), k.alias("k"), "l_partkey", "l_returnflag")
    own = F.struct(F.concat(F.lit("t"), F.col("k").cast("string")).alias("tag"), F.when(F.col("k") < 20, F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string"))).alias("parent"))
    facet = F.struct(F.concat(F.lit("facet:"), "l_returnflag").alias("tag"), F.lit(None).cast("string").alias("parent"))
    shown = lines.select("session_id", "episode", F.explode(F.array(own, facet)).alias("x")).select("session_id", "episode", "x.tag", "x.parent")
    return reports.detail_tags(shown, "R")


@query("chain_collapse", f"""WITH {SESS}, c AS (SELECT *, CASE WHEN session_id % 3 <> 0 THEN session_id - session_id % 4 END AS chain FROM sess)
SELECT CASE WHEN chain IS NULL THEN 'session' ELSE 'chain' END AS kind, chain, arg_max(session_id, last_activity * 10000000 + session_id) AS head, count(*) AS members, sum(tok_total)::BIGINT AS tok_total, sum(msg_count)::BIGINT AS msg_count, min(last_activity) AS first_activity, max(last_activity) AS last_activity
FROM c GROUP BY chain, CASE WHEN chain IS NULL THEN session_id END""")
def chain_collapse(spark, sf_dir):
    chain = F.when(F.col("session_id") % 3 != 0, F.col("session_id") - F.col("session_id") % 4)
    return graph.collapse(sess(spark, sf_dir).withColumn("chain", chain))


SPANS = f"""{MSGS}, last AS (SELECT session_id, max(ordinal) AS m FROM msgs GROUP BY 1),
old AS (SELECT session_id, e AS episode, e * 3 AS s, least(e * 3 + 2, m) AS t FROM (SELECT session_id, m, unnest(range(0, m // 3 + 1)) AS e FROM last)),
new AS (SELECT session_id, e AS episode, CASE WHEN e = 0 THEN 0 ELSE e * 3 - 1 + (session_id % 2) END AS s, least(e * 3 + 1 + (session_id % 2), m) AS t FROM (SELECT session_id, m, unnest(range(0, m // 3 + 1)) AS e FROM last) WHERE (CASE WHEN e = 0 THEN 0 ELSE e * 3 - 1 + (session_id % 2) END) <= m)"""


def _spans(spark, sf_dir):
    """Episodes of three turns, and a later segmentation whose cuts lie one turn earlier in half of the sessions."""
    last = msgs(spark, sf_dir).groupBy("session_id").agg(F.max("ordinal").alias("m"))
    each = last.select("session_id", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / 3).cast("long"))).alias("episode"))
    e, odd = F.col("episode"), F.col("session_id") % 2
    old = each.select("session_id", "episode", (e * 3).alias("start"), F.least(e * 3 + 2, F.col("m")).alias("end"))
    start = F.when(e == 0, 0).otherwise(e * 3 - 1 + odd)
    new = each.filter(start <= F.col("m")).select("session_id", "episode", start.alias("start"), F.least(e * 3 + 1 + odd, F.col("m")).alias("end"))
    return old, new


@query("surviving_labels", f"""WITH {SPANS} SELECT n.session_id, n.episode, n.s AS "start", n.t AS "end", CASE WHEN o.session_id IS NOT NULL THEN 'label ' || o.episode END AS label FROM new n LEFT JOIN old o ON o.session_id = n.session_id AND o.s = n.s AND o.t = n.t""")
def surviving_labels(spark, sf_dir):
    old, new = _spans(spark, sf_dir)
    return topics.surviving_labels(new, old.withColumn("label", F.concat(F.lit("label "), F.col("episode").cast("string"))))


@query("surviving_tags", f"""WITH {SPANS}, tags AS (SELECT session_id, episode, 't' || (episode % 4) AS tag, CASE WHEN episode % 3 = 0 THEN 'md' ELSE 'model' END AS source FROM old)
SELECT session_id, episode, tag, source FROM tags WHERE source <> 'model'
UNION ALL SELECT DISTINCT t.session_id, n.episode, t.tag, t.source FROM tags t JOIN old o USING (session_id, episode) JOIN new n ON n.session_id = o.session_id AND n.s = o.s AND n.t = o.t WHERE t.source = 'model'""")
def surviving_tags(spark, sf_dir):
    old, new = _spans(spark, sf_dir)
    tags = old.select("session_id", "episode", F.concat(F.lit("t"), (F.col("episode") % 4).cast("string")).alias("tag"), F.when(F.col("episode") % 3 == 0, "md").otherwise("model").alias("source"))
    return topics.surviving_tags(tags, old, new)


LIBRARY = f"""{SESS}, lib AS (SELECT session_id, harness, CASE session_id % 3 WHEN 0 THEN 'human_started' WHEN 1 THEN 'worker' ELSE 'unknown' END AS origin, CASE WHEN session_id % 8 = 1 THEN 'human_started' END AS corrected,
  last_activity AS updated, '/w/' || (session_id % 5) AS cwd FROM sess),
t AS (SELECT session_id, arg_min(text, ordinal) AS title, arg_max(text, ordinal) AS overview FROM msgs GROUP BY 1)"""


def _library(spark, sf_dir):
    k = F.col("session_id")
    m = msgs(spark, sf_dir)
    told = m.groupBy("session_id").agg(F.min_by("text", "ordinal").alias("title"), F.max_by("text", "ordinal").alias("overview"))
    s = sess(spark, sf_dir).select(
        "session_id", "harness", F.when(k % 3 == 0, "human_started").when(k % 3 == 1, "worker").otherwise("unknown").alias("origin"),
        F.when(k % 8 == 1, "human_started").alias("corrected"), F.col("last_activity").alias("updated"), F.concat(F.lit("/w/"), (k % 5).cast("string")).alias("cwd"),
    )
    return s.join(told, "session_id").withColumns({"topics": F.col("title"), "models": F.array("harness")}), m


@query("library_scopes", f"""WITH {LIBRARY}, o AS (SELECT *, coalesce(corrected, origin) AS who FROM lib)
SELECT 'direct' AS scope, session_id FROM o WHERE who = 'human_started' UNION ALL SELECT 'attended', session_id FROM o WHERE who <> 'worker'
UNION ALL SELECT 'narrow', session_id FROM o WHERE harness = 'kimi' AND updated BETWEEN 2 AND 9 AND contains(cwd, '/w/3') UNION ALL SELECT 'model', session_id FROM o WHERE who <> 'worker' AND harness = 'codex'""")
def library_scopes(spark, sf_dir):
    s, _ = _library(spark, sf_dir)
    scopes = {
        "direct": library.in_scope(s, "direct"), "attended": library.in_scope(s), "model": library.in_scope(s, model="codex"),
        "narrow": library.in_scope(s, "everything", harness="kimi", since=2, until=9, path="/w/3"),
    }
    found = None
    for name, rows in scopes.items():
        one = rows.select(F.lit(name).alias("scope"), "session_id")
        found = one if found is None else found.unionByName(one)
    return found


@query("library_matches", f"""WITH {LIBRARY}, o AS (SELECT lib.session_id, title, overview FROM lib JOIN t USING (session_id) WHERE coalesce(corrected, origin) <> 'worker')
SELECT m.session_id, m.ordinal, 'dialogue' AS match FROM msgs m JOIN o USING (session_id) WHERE role IN ('user', 'assistant') AND contains(lower(text), 'the ')
UNION ALL SELECT session_id, NULL, 'title' FROM o WHERE contains(lower(title), 'the ') UNION ALL SELECT session_id, NULL, 'summary' FROM o WHERE contains(lower(overview), 'the ') UNION ALL SELECT session_id, NULL, 'related' FROM o WHERE contains(lower(title), 'the ')""")
def library_matches(spark, sf_dir):
    """One needle in the four scopes of matching."""
    s, m = _library(spark, sf_dir)
    scope = library.in_scope(s)
    found = None
    for match in ("dialogue", "title", "summary", "related"):
        one = library.find(scope, m, "The ", match).withColumn("ordinal", F.col("ordinal").cast("long"))
        found = one if found is None else found.unionByName(one)
    return found


@query("json_answers", """SELECT doc_id, CASE WHEN length(text) % 5 <> 4 THEN 'd' || md5(text) END AS digest FROM documents""")
def json_answers(spark, sf_dir):
    """Answers made of each text: fenced, bare, amid prose, a list, and none."""
    k = F.length("text") % 5
    body = F.concat(F.lit('{"d": "d'), F.md5("text"), F.lit('"}'))
    raw = (
        F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone {not this}")))
        .when(k == 1, F.concat(F.lit("  "), body, F.lit("\n")))
        .when(k == 2, F.concat(F.lit("Sure! "), body, F.lit(" - as asked")))
        .when(k == 3, F.concat(F.lit('A list: [1, "d'), F.md5("text"), F.lit('"] so far')))
        .otherwise(F.concat(F.lit("no answer, "), F.md5("text")))
    )
    a = table(spark, sf_dir, "documents").select("doc_id", fx.json_answer(raw).alias("a"))
    return a.select("doc_id", F.coalesce(F.get_json_object("a", "$.d"), F.get_json_object("a", "$[1]")).alias("digest"))


@query("tier2_answers", """SELECT doc_id, CASE WHEN length(text) % 4 = 3 THEN 'prose only ' || md5(text) ELSE 'about ' || md5(text) END AS body, CASE length(text) % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS anchors, length(text) % 4 <> 0 AS malformed FROM documents""")
def tier2_answers(spark, sf_dir):
    """Answers made of each text: whole, with a broken anchor, without topics, and prose."""
    k = F.length("text") % 4
    head = F.concat(F.lit('Well: {"body": " about '), F.md5("text"), F.lit(' ", "topics": ['))
    raw = (
        F.when(k == 0, F.concat(head, F.lit('{"topic": "a", "from": 0, "to": 3, "body": "x"}, {"topic": " b ", "from": 4, "to": 4}]}')))
        .when(k == 1, F.concat(head, F.lit('{"topic": "a", "from": 5, "to": 3}, {"topic": "b", "from": 1, "to": 2}, {"topic": " ", "from": 1, "to": 2}]}')))
        .when(k == 2, F.concat(head, F.lit("]}")))
        .otherwise(F.concat(F.lit(" prose only "), F.md5("text"), F.lit(" ")))
    )
    a = table(spark, sf_dir, "documents").select("doc_id", fx.tier2_answer(raw).alias("a"))
    return a.select("doc_id", "a.body", F.size("a.anchors").alias("anchors"), "a.malformed")


@query("paragraph_breaks", """WITH b AS (SELECT doc_id, text, length(text) AS n, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(12288) AS white, chr(10) || chr(10) AS gap FROM documents)
SELECT doc_id, md5(CASE WHEN n <= 60 THEN text WHEN n <= 100 THEN rtrim(substr(text, 1, 60), white) || gap || substr(text, 61) WHEN n <= 300 THEN rtrim(substr(text, 1, 100), white) || gap || substr(text, 101)
  ELSE rtrim(substr(text, 1, 100), white) || gap || rtrim(substr(text, 101, 200), white) || gap || substr(text, 301) END) AS digest FROM b""")
def paragraph_breaks(spark, sf_dir):
    """Breaks at 100 and 300, one that goes back and one far behind the end."""
    shown = fx.paragraphize(F.col("text"), F.array(F.lit(0), F.lit(100), F.lit(60), F.lit(300), F.lit(100_000_000)))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(shown).alias("digest"))


@query("typo_counts", f"""WITH {MSGS}, known AS (SELECT word FROM (SELECT unnest(regexp_extract_all(lower(substr(text, 1, 3000)), '\\b[a-z]{{5,18}}\\b')) AS word FROM msgs WHERE role = 'assistant') GROUP BY 1 HAVING count(*) >= 4),
tok AS (SELECT session_id, ordinal, regexp_replace(regexp_replace(w, '^[("''`]+', ''), '[)"''`.,;:!?]+$', '') AS word FROM (SELECT session_id, ordinal, unnest(regexp_split_to_array(substr(text, 1, 4000), '\\s+')) AS w FROM msgs WHERE role = 'user')),
cand AS (SELECT session_id, ordinal, word FROM tok WHERE regexp_full_match(word, '[a-z]{{5,18}}') AND word NOT IN (SELECT word FROM known)),
u AS (SELECT DISTINCT word FROM cand),
base AS (SELECT word, unnest([regexp_replace(word, 's$', ''), regexp_replace(word, 'es$', ''), regexp_replace(word, 'ies$', 'y'), regexp_replace(word, 'ied$', 'y'), regexp_replace(word, 'ier$', 'y'), regexp_replace(word, 'iest$', 'y'), regexp_replace(word, 'ed$', ''), regexp_replace(word, 'd$', ''),
  regexp_replace(word, 'ing$', ''), regexp_replace(word, 'ing$', 'e'), regexp_replace(word, 'er$', ''), regexp_replace(word, 'r$', ''), regexp_replace(word, 'est$', ''), regexp_replace(word, 'st$', ''), regexp_replace(word, 'ly$', ''),
  CASE WHEN len(regexp_replace(word, '(ed|ing|er|est)$', '')) >= 3 AND len(regexp_replace(word, '(ed|ing|er|est)$', '')) < len(word) AND right(regexp_replace(word, '(ed|ing|er|est)$', ''), 1) = substr(regexp_replace(word, '(ed|ing|er|est)$', ''), len(regexp_replace(word, '(ed|ing|er|est)$', '')) - 1, 1) THEN left(regexp_replace(word, '(ed|ing|er|est)$', ''), len(regexp_replace(word, '(ed|ing|er|est)$', '')) - 1) END]) AS b FROM u),
strange AS (SELECT word FROM u WHERE word NOT IN (SELECT word FROM base WHERE b IN (SELECT word FROM known))),
wrong AS (SELECT DISTINCT s.word FROM strange s, known k WHERE abs(len(s.word) - len(k.word)) <= 1 AND damerau_levenshtein(s.word, k.word) <= 1)
SELECT session_id, ordinal, count(*) AS typos FROM cand JOIN wrong USING (word) GROUP BY 1, 2""")
def typo_counts(spark, sf_dir):
    """Misspellings of users, by the words that assistants use."""
    m = msgs(spark, sf_dir)
    return creator.typos(m.filter(F.col("role") == "user"), creator.learned_vocabulary(m))


FACTS = f"""{SESS}, s AS (SELECT sess.*, CASE WHEN session_id % 3 <> 0 THEN session_id - session_id % 4 END AS chain, CASE WHEN session_id % 4 = 1 THEN 'p' || (session_id % 6) END AS project, '/w/' || (session_id % 5) AS cwd FROM sess),
tags AS (SELECT DISTINCT session_id, 't' || (ordinal * session_id % 9) AS name FROM msgs WHERE ordinal % 2 = 0)"""


def _facts(spark, sf_dir):
    k = F.col("session_id")
    s = sess(spark, sf_dir).withColumns({
        "chain": F.when(k % 3 != 0, k - k % 4), "project": F.when(k % 4 == 1, F.concat(F.lit("p"), (k % 6).cast("string"))),
        "cwd": F.concat(F.lit("/w/"), (k % 5).cast("string")), "title": F.col("native_id"), "models": F.array("harness", F.lit("other")),
    })
    m = msgs(spark, sf_dir).filter("ordinal % 2 = 0")
    return s, m.select("session_id", F.concat(F.lit("t"), (F.col("ordinal") * k % 9).cast("string")).alias("name")).distinct()


@query("session_surface", f"""WITH {FACTS}, c AS (SELECT chain, count(*) AS n FROM s WHERE chain IS NOT NULL GROUP BY 1), g AS (SELECT session_id, string_agg(name, ',' ORDER BY name) AS tags FROM tags GROUP BY 1)
SELECT s.session_id, s.harness, s.native_id AS title, coalesce(project, cwd) AS path, coalesce(g.tags, '') AS tags, coalesce(c.n, 1) AS chain_members, tok_user, tok_assistant FROM s LEFT JOIN c USING (chain) LEFT JOIN g USING (session_id)""")
def session_surface(spark, sf_dir):
    s, tags = _facts(spark, sf_dir)
    shown = views.surface(s, tags)
    return shown.withColumn("tags", F.array_join("tags", ",")).drop("models")


@query("tag_page", f"""WITH {FACTS}, t AS (SELECT session_id, arg_min(text, ordinal) AS topic FROM msgs WHERE session_id % 2 = 0 GROUP BY 1)
SELECT s.session_id, s.harness, md5(t.topic) AS topic, s.last_activity, s.harness AS model, s.session_id % 5 = 0 AS favorite FROM s LEFT JOIN t USING (session_id) WHERE s.session_id IN (SELECT session_id FROM tags WHERE name = 't4')""")
def tag_page(spark, sf_dir):
    s, tags = _facts(spark, sf_dir)
    topic = msgs(spark, sf_dir).filter("session_id % 2 = 0").groupBy("session_id").agg(F.min_by("text", "ordinal").alias("topic"))
    page = views.tag_page(s, tags, topic, s.filter("session_id % 5 = 0"), "t4")
    return page.withColumn("topic", F.md5("topic"))


@query("tag_catalogue", f"""WITH {FACTS}, known AS (SELECT DISTINCT name FROM tags UNION SELECT 'unused'), n AS (SELECT name, count(*) AS n FROM tags GROUP BY 1)
SELECT name, CASE WHEN name = 't1' THEN 'about t1' END AS body, coalesce(n, 0) AS n FROM known LEFT JOIN n USING (name)""")
def tag_catalogue(spark, sf_dir):
    _, tags = _facts(spark, sf_dir)
    names = tags.select("name").distinct()
    known = names.select(F.explode(F.array("name", F.lit("unused"))).alias("name"))
    bodies = names.filter("name = 't1'").select("name", F.concat(F.lit("about "), "name").alias("body"))
    return views.tag_catalogue(tags, known, bodies)


@query("read_modes", f"""WITH {MSGS}, m AS (SELECT session_id, ordinal, role, CASE WHEN ordinal % 4 <> 3 THEN text END AS text, ordinal % 4 = 3 AS has_tool, CASE WHEN ordinal % 4 = 3 THEN text END AS tool_text, CASE role WHEN 'user' THEN '◆' WHEN 'assistant' THEN '◇' ELSE '·' END AS g FROM msgs),
x AS (SELECT *, substr(string_split(tool_text, chr(10))[1], 1, 100) AS one, '  ' || replace(text, chr(10), chr(10) || '  ') AS inset, '  ' || replace(tool_text, chr(10), chr(10) || '  ') AS tool FROM m)
SELECT 'prose' AS mode, session_id, ordinal, md5(g || ' ' || inset) AS digest FROM x WHERE role NOT IN ('system', 'tool') AND length(text) > 0
UNION ALL SELECT 'stubs', session_id, ordinal, md5(CASE WHEN has_tool THEN g || ' [tool] ' || CASE WHEN length(tool_text) > 0 THEN one ELSE '(tool activity)' END ELSE g || ' ' || inset END) FROM x WHERE role <> 'system' AND (has_tool OR length(text) > 0)
UNION ALL SELECT 'full', session_id, ordinal, md5(g || ' ' || role || ' #' || ordinal || CASE WHEN length(text) > 0 THEN chr(10) || inset ELSE '' END || CASE WHEN length(tool_text) > 0 THEN chr(10) || '  [tool] ' || tool ELSE '' END) FROM x""")
def read_modes(spark, sf_dir):
    """Every transcript in all three modes; every fourth message stands for a tool's."""
    tool = F.col("ordinal") % 4 == 3
    m = msgs(spark, sf_dir).withColumns({"tool_text": F.when(tool, F.col("text")), "has_tool": tool, "text": F.when(~tool, F.col("text"))})
    found = None
    for mode in ("prose", "stubs", "full"):
        one = views.read(m, mode).select(F.lit(mode).alias("mode"), "session_id", "ordinal", F.md5("shown").alias("digest"))
        found = one if found is None else found.unionByName(one)
    return found
