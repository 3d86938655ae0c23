"""A project across its folders: which belong to it or lie near, its sessions, what is said in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlake.functions import authorship
from skeinlake.operators import lineage, search
from skeinlake.plans.q_relations import RESOLVED
from skeinlake.plans.q_sessions import SESS, msgs, sess
from skeinlake.plans.registry import query, table

#: Folders of each name, in a folder of their own below a collection: roots, role folders, worktrees, names alike, parents.
NEARBY = f"""h AS (SELECT page_id, replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.', '-') AS name FROM pages),
paths AS (SELECT name, CASE page_id % 10 WHEN 0 THEN '/home/u/code/g-' || name || '/' || name WHEN 1 THEN '/home/u/code/g-' || name || '/' || name || '/src/'
  WHEN 2 THEN '/home/u/code/g-' || name || '/' || name || '-wt-x' WHEN 3 THEN '/srv/g-' || name || '-' || name WHEN 4 THEN '/home/u/code/g-' || name || '/' || name || '-two/lib'
  WHEN 5 THEN '/srv/' || name || '-two' WHEN 6 THEN '/srv/old/' || string_split(name, '-')[1] WHEN 7 THEN '/home/u/code/g-' || name || '/'
  WHEN 8 THEN '/home/u/code' ELSE '/srv/new/' || name || '/src' END AS cwd FROM h),
n AS (SELECT name FROM paths GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 1),
t AS (SELECT name AS base, 'g-' || name AS parent, '/home/u/code/g-' || name || '/' || name AS root FROM n), {RESOLVED}"""


def _folders(spark, sf_dir):
    """(cwd): folders made from the hosts of the pages, and the most frequent host's name as a target inside a worktree."""
    name, k = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), r"\.", "-"), F.col("page_id") % 10
    own = F.concat(F.lit("/home/u/code/g-"), "name")
    at = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    n = F.col("name")
    folder = (
        F.when(k == 0, at(own, "/", n)).when(k == 1, at(own, "/", n, "/src/")).when(k == 2, at(own, "/", n, "-wt-x")).when(k == 3, at("/srv/g-", n, "-", n))
        .when(k == 4, at(own, "/", n, "-two/lib")).when(k == 5, at("/srv/", n, "-two")).when(k == 6, at("/srv/old/", F.element_at(F.split(n, "-"), 1)))
        .when(k == 7, at(own, "/")).when(k == 8, F.lit("/home/u/code")).otherwise(at("/srv/new/", n, "/src"))
    )
    paths = table(spark, sf_dir, "pages").select("page_id", name.alias("name")).select("name", folder.alias("cwd"))
    most = paths.groupBy("name").count().orderBy(F.desc("count"), "name").first()
    top = most["name"] if most else "none"
    return paths.select("cwd").distinct(), f"/home/u/code/g-{top}/{top}/worktrees/a/src"


@query("lineage_nearby", f"""WITH {NEARBY},
rest AS (SELECT DISTINCT c AS cwd FROM cwds WHERE c NOT IN (SELECT CASE WHEN length(cwd) > 1 THEN rtrim(cwd, '/') ELSE cwd END FROM included)),
r AS (SELECT cwd, string_split(cwd, '/')[-1] AS b, starts_with(root, cwd || '/') AS above, len(string_split(cwd, '/')) - 1 AS depth, coalesce(kids.n, 0) AS n, base FROM rest, t LEFT JOIN kids ON kids.up = cwd)
SELECT cwd, reason FROM (SELECT cwd, CASE WHEN above THEN CASE WHEN depth >= 3 AND n < 8 THEN 'parent' END WHEN length(b) >= 4 AND b NOT IN ('source', 'src', 'code', 'lib', 'core', 'docs', 'tests') AND (b = base OR starts_with(b, base || '-') OR starts_with(base, b || '-')) THEN 'similar' END AS reason FROM r) WHERE reason IS NOT NULL
UNION ALL SELECT cwd, reason FROM included""")
def lineage_nearby(spark, sf_dir):
    """The folders of a project and those that lie near it."""
    folders, target = _folders(spark, sf_dir)
    held = lineage.resolve(folders, target)
    return held.unionByName(lineage.nearby(folders, held, target))


#: Sessions in folders of five projects; every fourth is an agent's, some have no start.
PROJECT = f"""{SESS},
f AS (SELECT s.*, '/home/u/code/site' || (session_id % 5) || CASE session_id % 3 WHEN 0 THEN '-wt-fix' WHEN 1 THEN '/src' ELSE '' END AS cwd,
  CASE session_id % 4 WHEN 0 THEN 'agent' ELSE 'human' END AS raw_origin, CASE WHEN user_turns = 0 THEN 'empty' ELSE 'human' END AS origin,
  CASE WHEN session_id % 6 <> 0 THEN session_id * 1000 END AS start FROM sess s),
p AS (SELECT session_id, cwd, CASE session_id % 3 WHEN 0 THEN 'worktree' WHEN 1 THEN 'inside' ELSE 'exact' END AS reason, coalesce(start, last_activity) AS begun, raw_origin = 'agent' AS hidden
  FROM f WHERE session_id % 5 = 1 AND origin <> 'empty' AND coalesce(start, last_activity) < 90000)"""


def _project(spark, sf_dir):
    k = F.col("session_id")
    tail = F.when(k % 3 == 0, "-wt-fix").when(k % 3 == 1, "/src").otherwise("")
    rows = sess(spark, sf_dir).select(
        "session_id", F.concat(F.lit("/home/u/code/site"), (k % 5).cast("string"), tail).alias("cwd"), F.when(k % 6 != 0, k * 1000).alias("start"),
        F.col("last_activity").cast("long").alias("last"), F.when(k % 4 == 0, "agent").otherwise("human").alias("raw_origin"), F.when(F.col("user_turns") == 0, "empty").otherwise("human").alias("origin"),
    )
    held = lineage.resolve(rows.select("cwd").distinct(), "/home/u/code/site1/.claude/worktrees/w/docs")
    return lineage.project_sessions(rows, held, until=90000)


@query("lineage_sessions", f"WITH {PROJECT} SELECT session_id, cwd, reason, begun, hidden FROM p")
def lineage_sessions(spark, sf_dir):
    """The sessions of one project that begin in time, with those of agents marked."""
    return _project(spark, sf_dir).select("session_id", "cwd", "reason", "begun", "hidden")


@query("lineage_hidden_agents", f"WITH {PROJECT} SELECT cwd, count(*) FILTER (WHERE NOT hidden) AS shown, count(*) FILTER (WHERE hidden) AS hidden FROM p GROUP BY 1")
def lineage_hidden_agents(spark, sf_dir):
    """How many sessions of each folder are shown, and how many hidden."""
    return _project(spark, sf_dir).groupBy("cwd").agg(F.count_if(~F.col("hidden")).alias("shown"), F.count_if("hidden").alias("hidden"))


_INJECTED = " OR ".join("regexp_matches(x, '{}')".format(p.replace("'", "''")) for p in authorship.INJECTED)
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"


@query("lineage_dialogue", f"""WITH {PROJECT},
d AS (SELECT session_id, ordinal, side, trim(CASE (session_id + ordinal) % 5 WHEN 0 THEN chr(10) || '<system-reminder>' || text WHEN 1 THEN '<command-name>/go</command-name>' || chr(10) || '<command-args>' || chr(10) || substr(text, 1, 20) || '</command-args>'
  WHEN 2 THEN '[Request interrupted by user' || text WHEN 3 THEN chr(9) || text || chr(10) ELSE text END, {_BLANK}) AS x FROM msgs WHERE side IS NOT NULL AND trim(text, {_BLANK}) <> '')
SELECT session_id, ordinal, side, md5(said) AS digest FROM (SELECT session_id, ordinal, side, CASE WHEN side = 'assistant' THEN x WHEN starts_with(x, '<command-name>') THEN CASE WHEN trim(regexp_extract(x, '<command-args>((?s:.*?))</command-args>', 1), {_BLANK}) <> '' THEN '/go ' || trim(regexp_extract(x, '<command-args>((?s:.*?))</command-args>', 1), {_BLANK}) END
  WHEN NOT ({_INJECTED}) THEN x END AS said FROM d JOIN p USING (session_id) WHERE NOT hidden) WHERE said <> ''""")
def lineage_dialogue(spark, sf_dir):
    """What people and assistants say in them; what a harness wrote on the user's side is left out."""
    k, text = (F.col("session_id") + F.col("ordinal")) % 5, F.col("text")
    command = F.concat(F.lit("<command-name>/go</command-name>\n<command-args>\n"), F.substring(text, 1, 20), F.lit("</command-args>"))
    shaped = (
        F.when(k == 0, F.concat(F.lit("\n<system-reminder>"), text)).when(k == 1, command).when(k == 2, F.concat(F.lit("[Request interrupted by user"), text))
        .when(k == 3, F.concat(F.lit("\t"), text, F.lit("\n"))).otherwise(text)
    )
    turns = search.documents(msgs(spark, sf_dir)).withColumn("text", shaped)
    return lineage.project_dialogue(_project(spark, sf_dir), turns).select("session_id", "ordinal", "side", F.md5("text").alias("digest"))
