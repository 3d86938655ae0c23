"""Joins, set operations, graphs, tags and corpora over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinlake.functions import text as fx
from skeinlake.operators import filters, graph, lineage
from skeinlake.plans.q_sessions import MSGS, SESS, msgs, sess
from skeinlake.plans.registry import query, table


@query("inner_multi_key", """SELECT o_orderkey, c_mktsegment, n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY ALL""")
def inner_multi_key(spark, sf_dir):
    line, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    joined = line.filter("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4)
    return joined.groupBy("o_orderkey", "c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("lines"), revenue.alias("revenue"))


@query("left_join_aggregate", """SELECT c_custkey, coalesce(n, 0) AS orders, last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey""")
def left_join_aggregate(spark, sf_dir):
    per = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    joined = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), "last")


@query("semi_anti_filters", """SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') THEN 'urgent' ELSE 'calm' END AS kind
FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < -900)""")
def semi_anti_filters(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    poor = table(spark, sf_dir, "supplier").filter("s_acctbal < -900")
    left = c.join(poor, F.col("s_nationkey") == F.col("c_nationkey"), "left_anti").select("c_custkey")
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    on = F.col("o_custkey") == F.col("c_custkey")
    yes = left.join(urgent, on, "left_semi").withColumn("kind", F.lit("urgent"))
    return yes.unionByName(left.join(urgent, on, "left_anti").withColumn("kind", F.lit("calm")))


@query("null_safe_diff", """WITH a AS (SELECT p_partkey % 500 AS k, CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS b FROM part), d AS (SELECT DISTINCT k, b FROM a WHERE k % 2 = 0)
SELECT DISTINCT a.k, a.b FROM a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.k = a.k AND d.b IS NOT DISTINCT FROM a.b)""")
def null_safe_diff(spark, sf_dir):
    b = F.when(F.col("p_size") > 40, F.lit(None)).otherwise(F.col("p_brand"))
    a = table(spark, sf_dir, "part").select((F.col("p_partkey") % 500).alias("k"), b.alias("b")).distinct()
    d = a.filter("k % 2 = 0").select(F.col("k").alias("dk"), F.col("b").alias("db"))
    return a.join(d, (F.col("k") == F.col("dk")) & F.col("b").eqNullSafe(F.col("db")), "left_anti")


@query("tuple_in_semi", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (SELECT * FROM (VALUES ('A', 'F'), ('N', 'F')) v(a, b))""")
def tuple_in_semi(spark, sf_dir):
    wanted = spark.createDataFrame([("A", "F"), ("N", "F")], "l_returnflag string, l_linestatus string")
    return table(spark, sf_dir, "lineitem").join(F.broadcast(wanted), ["l_returnflag", "l_linestatus"], "left_semi").select("l_orderkey", "l_linenumber")


@query("using_join", "SELECT k, x.n AS suppliers, y.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) x JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) y USING (k)")
def using_join(spark, sf_dir):
    x = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    y = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return x.join(y, "k")


@query("union_distinct", "SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def union_distinct(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    return c.unionByName(table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))).distinct()


@query("conditional_exists", """WITH plan AS (SELECT o_custkey FROM orders WHERE o_orderkey % 1000 = 1)
SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM plan) OR EXISTS (SELECT 1 FROM plan WHERE o_custkey = c_custkey)""")
def conditional_exists(spark, sf_dir):
    """All customers without any plan; else those in the plan."""
    c = table(spark, sf_dir, "customer")
    plan = table(spark, sf_dir, "orders").filter("o_orderkey % 1000 = 1").select("o_custkey").distinct()
    marked = c.join(plan, F.col("c_custkey") == F.col("o_custkey"), "left").join(F.broadcast(plan.agg(F.count(F.lit(1)).alias("planned"))))
    return marked.filter((F.col("planned") == 0) | F.col("o_custkey").isNotNull()).agg(F.count(F.lit(1)).alias("n"))


@query("range_span_join", f"""WITH {MSGS}, sp AS (SELECT session_id, min(ordinal) + 1 AS lo, min(ordinal) + 3 AS hi FROM msgs GROUP BY 1)
SELECT sp.session_id, min(m.ordinal) AS first_turn, count(*) AS n FROM sp JOIN msgs m ON m.session_id = sp.session_id AND m.ordinal BETWEEN lo AND hi GROUP BY 1""")
def range_span_join(spark, sf_dir):
    """The first turn inside a span of its session."""
    m = msgs(spark, sf_dir)
    spans = m.groupBy("session_id").agg((F.min("ordinal") + 1).alias("lo"), (F.min("ordinal") + 3).alias("hi"))
    inside = m.join(spans, "session_id").filter(F.col("ordinal").between(F.col("lo"), F.col("hi")))
    return inside.groupBy("session_id").agg(F.min("ordinal").alias("first_turn"), F.count(F.lit(1)).alias("n"))


@query("model_top6", """SELECT model, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name || ' claude-opus-20250101'), ' ')) AS raw FROM part), LATERAL (SELECT CASE WHEN trim(raw) = '' THEN 'unknown' ELSE regexp_replace(regexp_replace(raw, '^claude-', ''), '(?i)-(?:20\\d{6}|latest)$', '') END AS model) GROUP BY 1 ORDER BY n DESC, model LIMIT 6""")
def model_top6(spark, sf_dir):
    """Exploded, shortened names, the six most frequent."""
    raw = F.explode(F.split(F.lower(F.concat("p_name", F.lit(" claude-opus-20250101"))), " "))
    names = table(spark, sf_dir, "part").select(raw.alias("raw"))
    return names.groupBy(fx.short_model_name(F.col("raw")).alias("model")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "model").limit(6)


@query("facet_counts", """SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(DISTINCT o_custkey) AS sessions FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""")
def facet_counts(spark, sf_dir):
    from skeinlake.operators import reports

    rows = table(spark, sf_dir, "orders")
    return reports.facet_counts(rows, ["o_orderstatus", "o_orderpriority"], "o_custkey", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("states_rollup", """SELECT count(*) AS documents, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS labelled, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled, count(*) FILTER (WHERE l.toxic = 1) AS toxic, count(*) FILTER (WHERE l.quality = 1) AS good
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def states_rollup(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("documents"), F.count("has").alias("labelled"), F.count_if(F.col("has").isNull()).alias("unlabelled"),
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 1).alias("good"),
    )


@query("grouped_labels", """SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(DISTINCT lang) AS n FROM documents GROUP BY source HAVING count(DISTINCT lang) >= 2""")
def grouped_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy("source")
    out = docs.agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.countDistinct("lang").alias("n"))
    return out.filter("n >= 2")


@query("top3_labels_per_source", """SELECT source, string_agg(lang, ',' ORDER BY n DESC, lang) AS top FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM documents GROUP BY 1, 2) WHERE rn <= 3 GROUP BY source""")
def top3_labels_per_source(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "lang"))
    top = counts.withColumn("rn", place).filter("rn <= 3").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rn", "lang"))).alias("l"))
    return top.select("source", F.array_join(F.transform("l", lambda x: x["lang"]), ",").alias("top"))


def _claims(spark, sf_dir):
    """Every customer claims a parent by its nation; some claims are wrong on purpose."""
    k = F.col("c_custkey")
    parent = F.when(k % 10 == 0, k).when(k % 10 == 1, -k).when(k % 10 == 2, k + 1).when(k % 10 == 3, k - 1).otherwise(k - 4)
    return table(spark, sf_dir, "customer").select(k.alias("child"), parent.alias("parent"))


CLAIMS = "claims AS (SELECT c_custkey AS child, CASE c_custkey % 10 WHEN 0 THEN c_custkey WHEN 1 THEN -c_custkey WHEN 2 THEN c_custkey + 1 WHEN 3 THEN c_custkey - 1 ELSE c_custkey - 4 END AS parent FROM customer)"
STATUS = f"""{CLAIMS}, walk AS (
  SELECT child, parent AS pos, 1 AS d FROM claims WHERE child <> parent AND parent IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT w.child, c.parent, d + 1 FROM walk w JOIN claims c ON c.child = w.pos WHERE w.pos <> w.child AND c.child <> c.parent AND c.parent IN (SELECT c_custkey FROM customer) AND d < 60),
cyc AS (SELECT DISTINCT child FROM walk WHERE pos = child),
st AS (SELECT child, parent, CASE WHEN child = parent THEN 'self_invalid' WHEN parent NOT IN (SELECT c_custkey FROM customer) THEN 'unresolved' WHEN child IN (SELECT child FROM cyc) THEN 'cycle_invalid' ELSE 'resolved' END AS status FROM claims)"""


@query("lineage_claim_status", f"WITH RECURSIVE {STATUS} SELECT child, parent, status FROM st")
def lineage_claim_status(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    return graph.claim_status(known, _claims(spark, sf_dir))


@query("chain_components", f"""WITH RECURSIVE {STATUS}, ed AS (SELECT child AS a, parent AS b FROM st WHERE status = 'resolved' UNION SELECT parent, child FROM st WHERE status = 'resolved'),
reach AS (SELECT a, a AS r FROM ed UNION SELECT reach.a, ed.b FROM reach JOIN ed ON ed.a = reach.r)
SELECT a AS session_id, min(r) AS chain FROM reach GROUP BY a""")
def chain_components(spark, sf_dir):
    status = lineage_claim_status(spark, sf_dir)
    return graph.chains(status.filter("status = 'resolved'").select("child", "parent"))


STABLE = f"""{STATUS}, ed AS (SELECT child AS a, parent AS b FROM st WHERE status = 'resolved' UNION SELECT parent, child FROM st WHERE status = 'resolved'),
reach AS (SELECT a, a AS r FROM ed UNION SELECT reach.a, ed.b FROM reach JOIN ed ON ed.a = reach.r),
mem AS (SELECT a AS id, min(r) AS chain FROM reach GROUP BY a),
cs AS (SELECT m.id, m.chain, 'n' || (c_nationkey * 100000 + c_custkey) AS native, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS act, c_custkey % 10 AS tok, m.id NOT IN (SELECT child FROM st WHERE status = 'resolved') AS top FROM mem m JOIN customer ON c_custkey = m.id),
keys AS (SELECT chain, 'lineage-v1:claude:' || coalesce(min(native) FILTER (WHERE top), min(native)) AS stable_key, count(*) AS members, min(act) AS first_activity, max(act) AS last_activity, sum(tok)::BIGINT AS tok_total FROM cs GROUP BY 1 HAVING count(*) > 1),
heads AS (SELECT chain, id AS head FROM (SELECT chain, id, row_number() OVER (PARTITION BY chain ORDER BY act DESC NULLS LAST, native) AS rn FROM cs) WHERE rn = 1)"""


def _chained(spark, sf_dir):
    """Customers as sessions, their chains and those chains with stable keys."""
    resolved = graph.checkpoint(lineage_claim_status(spark, sf_dir).filter("status = 'resolved'").select("child", "parent"))
    members = graph.chains(resolved)
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("session_id"), F.lit("claude").alias("harness"), F.concat(F.lit("n"), (n.cast("long") * 100000 + k).cast("string")).alias("native_id"), F.when(k % 7 != 0, n).alias("last_activity"), (k % 10).alias("tok_total")
    )
    return rows, members, graph.stable_chains(members, resolved, rows)


@query("chain_stable_keys", f"WITH RECURSIVE {STABLE} SELECT chain, stable_key, members, first_activity, last_activity, tok_total, head FROM keys JOIN heads USING (chain)")
def chain_stable_keys(spark, sf_dir):
    """Every chain by the key of its root, with its newest session."""
    return _chained(spark, sf_dir)[2].drop("harness", "root")


@query("filter_chain_key", f"WITH RECURSIVE {STABLE} SELECT id AS session_id, native AS native_id FROM cs JOIN keys USING (chain) WHERE stable_key = (SELECT stable_key FROM keys ORDER BY members DESC, stable_key LIMIT 1)")
def filter_chain_key(spark, sf_dir):
    """The sessions of the largest chain, chosen by its stable key."""
    rows, members, keyed = _chained(spark, sf_dir)
    largest = keyed.orderBy(F.desc("members"), "stable_key").first()
    chosen = filters.SessionFilter(chain_key=largest["stable_key"] if largest else "")
    return filters.apply(rows.join(graph.shuffled(members), "session_id", "left"), chosen, chains=keyed).select("session_id", "native_id")


@query("chain_summary", f"""WITH {SESS}, m AS (SELECT session_id, session_id - session_id % 4 AS chain FROM sess)
SELECT chain, count(*) AS members, min(last_activity) AS first_activity, max(last_activity) AS last_activity, sum(tok_total)::BIGINT AS tok_total, arg_max(session_id, last_activity * 1000000 + session_id) AS head FROM m JOIN sess USING (session_id) GROUP BY 1 HAVING count(*) > 1""")
def chain_summary(spark, sf_dir):
    s = sess(spark, sf_dir)
    members = s.select("session_id", (F.col("session_id") - F.col("session_id") % 4).alias("chain"))
    return graph.chain_summary(members, s)


DECISIONS = """dec AS (SELECT p_partkey AS id, 't' || (p_partkey % 600) AS from_tag, 't' || ((p_partkey * 7) % 600) AS to_tag, CASE WHEN p_size % 4 = 0 THEN 'demote' WHEN p_size % 4 = 1 THEN 'nest' ELSE 'merge' END AS action, p_size AS created_at FROM part),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_tag ORDER BY created_at DESC, id DESC) AS rn FROM dec) WHERE rn = 1),
walk AS (SELECT from_tag AS tag, to_tag AS target, 1 AS depth FROM newest WHERE action = 'merge' UNION ALL SELECT w.tag, n.to_tag, w.depth + 1 FROM walk w JOIN newest n ON n.from_tag = w.target AND n.action = 'merge' WHERE w.depth < 8),
fin AS (SELECT tag, target, depth FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY depth DESC) AS rn FROM walk) WHERE rn = 1)"""


def _decisions(spark, sf_dir):
    k = F.col("p_partkey")
    s = F.col("p_size") % 4
    tag = lambda c: F.concat(F.lit("t"), c.cast("string"))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), tag(k % 600).alias("from_tag"), tag(k * 7 % 600).alias("to_tag"), F.when(s == 0, "demote").when(s == 1, "nest").otherwise("merge").alias("action"), F.col("p_size").alias("created_at")
    )


@query("merge_chain_final", f"WITH RECURSIVE {DECISIONS} SELECT tag, target, depth FROM fin")
def merge_chain_final(spark, sf_dir):
    return graph.final_merges(spark, _decisions(spark, sf_dir))


@query("display_tags", f"""WITH RECURSIVE {DECISIONS}, tags AS (SELECT o_orderkey AS session_id, 't' || (o_orderkey % 600) AS tag FROM orders),
sh AS (SELECT session_id, coalesce(target, tags.tag) AS tag FROM tags LEFT JOIN fin ON fin.tag = tags.tag)
SELECT DISTINCT session_id, sh.tag, n.to_tag AS parent FROM sh LEFT JOIN newest n ON n.from_tag = sh.tag AND n.action = 'nest' WHERE sh.tag NOT IN (SELECT from_tag FROM newest WHERE action = 'demote')""")
def display_tags(spark, sf_dir):
    tags = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.concat(F.lit("t"), (F.col("o_orderkey") % 600).cast("string")).alias("tag"))
    return graph.display_tags(spark, tags, _decisions(spark, sf_dir))


@query("corpus_diff", f"""WITH {MSGS}, b AS (SELECT session_id, md5(string_agg(text, '|' ORDER BY ordinal)) AS c FROM msgs WHERE ordinal < 4 AND session_id % 7 <> 0 GROUP BY 1),
a AS (SELECT session_id, md5(string_agg(text, '|' ORDER BY ordinal)) AS c FROM msgs WHERE session_id % 5 <> 0 GROUP BY 1)
SELECT coalesce(a.session_id, b.session_id) AS session_id, CASE WHEN b.c IS NULL THEN 'added' WHEN a.c IS NULL THEN 'removed' WHEN a.c <> b.c THEN 'changed' ELSE 'kept' END AS change FROM a FULL JOIN b USING (session_id)""")
def corpus_diff(spark, sf_dir):
    """Two snapshots of a corpus: the earlier one had only the first four turns."""

    def snapshot(rows):
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "|")
        return rows.groupBy("session_id").agg(F.md5(parts).alias("c"))

    m = msgs(spark, sf_dir)
    return lineage.snapshot_diff(snapshot(m.filter("ordinal < 4 AND session_id % 7 <> 0")), snapshot(m.filter("session_id % 5 <> 0")), ["session_id"], "c")


@query("corpus_catalogue", """SELECT source, count(*) AS snapshots, max(doc_id) AS latest, arg_max(n_chars, doc_id) AS latest_size FROM documents GROUP BY 1""")
def corpus_catalogue(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("snapshots"), F.max("doc_id").alias("latest"), F.max_by("n_chars", "doc_id").alias("latest_size"))


PATHS = "p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+:/', ''), '/+$', '') AS path FROM pages)"


def _paths(spark, sf_dir):
    path = fx.trim_slash(F.regexp_replace("url", "^[a-z]+:/", ""))
    return table(spark, sf_dir, "pages").select(path.alias("cwd")).distinct()


@query("ancestor_expand", f"""WITH {PATHS}, s AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
a AS (SELECT path, parts, unnest(range(1, len(parts))) AS n FROM s)
SELECT path, '/' || array_to_string(parts[1:n], '/') AS folder FROM a UNION ALL SELECT path, '/' FROM p""")
def ancestor_expand(spark, sf_dir):
    return _paths(spark, sf_dir).select(F.col("cwd").alias("path"), F.explode(fx.ancestors(F.col("cwd"))).alias("folder"))


@query("directory_children", f"""WITH {PATHS}, s AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p), a AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM s),
d AS (SELECT DISTINCT '/' || array_to_string(parts[1:n], '/') AS dir, CASE WHEN n = 1 THEN '/' ELSE '/' || array_to_string(parts[1:n - 1], '/') END AS folder FROM a)
SELECT folder, count(*) AS children FROM d GROUP BY 1""")
def directory_children(spark, sf_dir):
    return lineage.child_counts(_paths(spark, sf_dir))


@query("cwd_statistics", """SELECT source AS cwd, count(*) AS sessions, min(doc_id) AS first, max(doc_id) AS last, count(*) FILTER (WHERE lang = 'en') AS en FROM documents GROUP BY 1""")
def cwd_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("cwd"), F.col("lang").alias("harness"), F.col("doc_id").alias("start"), F.col("doc_id").alias("last"))
    stats = lineage.cwd_stats(rows)
    return stats.select("cwd", "sessions", "first", "last", F.coalesce(F.try_element_at("harnesses", F.lit("en")), F.lit(0)).alias("en"))


#: Of folders (``paths``) and a target (``t``: root, base, parent) those that belong to it: itself, below it, or by the name of a folder on the way.
RESOLVED = r"""cwds AS (SELECT DISTINCT cwd, CASE WHEN length(cwd) > 1 THEN rtrim(cwd, '/') ELSE cwd END AS c FROM paths),
way AS (SELECT cwd, c, i, array_to_string(string_split(c, '/')[1:i], '/') AS dir FROM (SELECT *, unnest(range(2, len(string_split(c, '/')) + 1)) AS i FROM cwds)),
ups AS (SELECT *, CASE WHEN i = 2 THEN '/' ELSE array_to_string(string_split(dir, '/')[1:-2], '/') END AS up, string_split(dir, '/')[-1] AS b FROM way),
kids AS (SELECT up, count(DISTINCT dir) AS n FROM ups GROUP BY 1),
alias AS (SELECT cwd, c, i, root, CASE WHEN dir = root OR starts_with(dir, root || '/') OR starts_with(root, dir || '/') THEN NULL
  WHEN b = base AND (string_split(ups.up, '/')[-1] = parent OR n >= 8 OR regexp_matches(ups.up, '/\.(codex|claude)/worktrees/[^/]+$')) THEN 'moved'
  WHEN b = parent || '-' || base OR string_split(ups.up, '/')[-1] || '-' || b = base THEN 'renamed'
  WHEN regexp_extract(b, '^(.+?)(-wt-.+|-worktree(-.+)?|\.worktrees?)$', 1) = base THEN 'worktree' END AS reason FROM ups JOIN kids ON kids.up = ups.up, t),
included AS (SELECT cwd, reason FROM (SELECT cwd, CASE WHEN any_value(c) = any_value(root) THEN 'exact' WHEN starts_with(any_value(c), any_value(root) || '/') THEN 'inside' ELSE arg_max(reason, i) FILTER (WHERE reason IS NOT NULL) END AS reason FROM alias GROUP BY cwd) WHERE reason IS NOT NULL)"""


@query("project_lineage", rf"""WITH h AS (SELECT replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.', '-') AS name, regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) AS rest FROM pages),
paths AS (SELECT name, '/home/u/code/' || CASE length(rest) % 4 WHEN 0 THEN name || '/src' WHEN 1 THEN name || '-wt-x' WHEN 2 THEN 'code-' || name ELSE name || '/' || rest END AS cwd FROM h),
n AS (SELECT name FROM paths GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 1),
t AS (SELECT name AS base, 'code' AS parent, '/home/u/code/' || name AS root FROM n), {RESOLVED}
SELECT cwd, reason FROM included""")
def project_lineage(spark, sf_dir):
    """Folders that belong to one project, for folders made from the hosts and paths of the pages' addresses; the target lies in a worktree."""
    name = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), r"\.", "-")
    inside = F.regexp_extract("url", "^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    folder = (
        F.when(F.length(inside) % 4 == 0, F.concat(name, F.lit("/src")))
        .when(F.length(inside) % 4 == 1, F.concat(name, F.lit("-wt-x")))
        .when(F.length(inside) % 4 == 2, F.concat(F.lit("code-"), name))
        .otherwise(F.concat(name, F.lit("/"), inside))
    )
    paths = table(spark, sf_dir, "pages").select(F.concat(F.lit("/home/u/code/"), folder).alias("cwd"), name.alias("name"))
    most = paths.groupBy("name").count().orderBy(F.desc("count"), "name").first()
    target = f"/home/u/code/{most.name if most else 'none'}/.worktrees/a/src"
    return lineage.resolve(paths.select("cwd").distinct(), target)


@query("project_roots", """SELECT page_id, '/home/u/code/site' || (page_id % 5) AS root FROM pages""")
def project_roots(spark, sf_dir):
    """Worktrees and role folders resolve to the project they belong to."""
    base = F.concat(F.lit("/home/u/code/site"), (F.col("page_id") % 5).cast("string"))
    tail = F.when(F.col("page_id") % 3 == 0, "/.claude/worktrees/w1/deep").when(F.col("page_id") % 3 == 1, "-wt-fix").otherwise("/src/docs")
    return table(spark, sf_dir, "pages").select("page_id", lineage.project_root(F.concat(base, tail)).alias("root"))
