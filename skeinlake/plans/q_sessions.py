"""Sessions, listings, paging and analytics over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlake.functions import text as fx
from skeinlake.operators import filters, replay, search, sessions
from skeinlake.plans.registry import query, table

#: Messages and sessions, as the operators derive them.
MSGS = """
msgs AS (
  SELECT conv_id AS session_id,
    ['claude','codex','prime','kimi','hermes','kilo','zcode'][(conv_id % 7 + 1)::INT] AS harness,
    'c' || conv_id AS native_id, turn AS ordinal, role,
    CASE role WHEN 'user' THEN 'real_user' WHEN 'assistant' THEN 'assistant_dialogue_prose' WHEN 'system' THEN 'developer_system' ELSE 'utility' END AS record_kind,
    CASE WHEN role IN ('user','assistant') THEN role END AS side, text,
    ceil(coalesce(length(text), 0) / 4.0)::BIGINT AS tokens
  FROM conversations)"""
SESS = f"""{MSGS},
sess AS (
  SELECT session_id, harness, native_id, count(*) AS msg_count,
    count(*) FILTER (WHERE side = 'user') AS user_turns, count(*) FILTER (WHERE side = 'assistant') AS assistant_turns,
    coalesce(sum(tokens) FILTER (WHERE side = 'user'), 0)::BIGINT AS tok_user,
    coalesce(sum(tokens) FILTER (WHERE side = 'assistant'), 0)::BIGINT AS tok_assistant,
    sum(tokens)::BIGINT AS tok_total, max(ordinal) AS last_activity
  FROM msgs GROUP BY ALL)"""


def msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.messages(table(spark, sf_dir, "conversations"))


def sess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(msgs(spark, sf_dir))


@query("session_aggregates", f"WITH {SESS} SELECT *, round(CASE WHEN user_turns + assistant_turns > 0 THEN user_turns / (user_turns + assistant_turns) ELSE 0.0 END, 6) AS engagement FROM sess")
def session_aggregates(spark, sf_dir):
    return sess(spark, sf_dir).withColumn("engagement", F.round("engagement", 6))


@query("session_list_percentile", f"""WITH {SESS} SELECT session_id, tok_total, round(percent_rank() OVER (ORDER BY tok_total), 6) AS percentile FROM sess""")
def session_list_percentile(spark, sf_dir):
    ranked = sessions.percentile(sess(spark, sf_dir).select("session_id", "tok_total"), "tok_total")
    return ranked.withColumn("percentile", F.round("percentile", 6))


@query("order_price_percentile", """SELECT o_orderkey, round(percent_rank() OVER (ORDER BY round(o_totalprice)), 6) AS percentile FROM orders""")
def order_price_percentile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice").alias("v"))
    return sessions.percentile(orders, "v").select("o_orderkey", F.round("percentile", 6).alias("percentile"))


@query("session_list_keyset", f"""WITH {SESS} SELECT session_id, last_activity, tok_total FROM sess WHERE (last_activity, session_id) < (6, 60) ORDER BY last_activity DESC, session_id DESC LIMIT 301""")
def session_list_keyset(spark, sf_dir):
    """The page of the newest sessions behind the cursor (6, 60), with one row more."""
    after = (F.col("last_activity") < 6) | ((F.col("last_activity") == 6) & (F.col("session_id") < 60))
    rows = sess(spark, sf_dir).filter(after).select("session_id", "last_activity", "tok_total")
    return rows.orderBy(F.col("last_activity").desc(), F.col("session_id").desc()).limit(301)


@query("session_list_offset", f"""WITH {SESS} SELECT session_id, tok_total FROM sess ORDER BY tok_total DESC, session_id LIMIT 20 OFFSET 20""")
def session_list_offset(spark, sf_dir):
    return sess(spark, sf_dir).select("session_id", "tok_total").orderBy(F.col("tok_total").desc(), "session_id").offset(20).limit(20)


@query("select_all_keys", f"""WITH {SESS} SELECT DISTINCT harness, native_id FROM sess WHERE user_turns > 1""")
def select_all_keys(spark, sf_dir):
    return sess(spark, sf_dir).filter("user_turns > 1").select("harness", "native_id").distinct()


@query("size_histogram", f"""WITH {SESS}, b AS (SELECT * FROM (VALUES ('lt8k'), ('8k-32k'), ('32k-96k'), ('96k+')) v(bucket)),
c AS (SELECT CASE WHEN tok_total < 8000 THEN 'lt8k' WHEN tok_total < 32000 THEN '8k-32k' WHEN tok_total < 96000 THEN '32k-96k' ELSE '96k+' END AS bucket, count(*) AS n FROM sess GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)""")
def size_histogram(spark, sf_dir):
    return sessions.token_histogram(sess(spark, sf_dir))


@query("document_size_histogram", """SELECT CASE WHEN t < 250 THEN 'a' WHEN t < 1000 THEN 'b' WHEN t < 4000 THEN 'c' ELSE 'd' END AS bucket, count(*) AS n, sum(t)::BIGINT AS tokens
FROM (SELECT ceil(coalesce(length(text), 0) / 4.0)::BIGINT AS t FROM documents) GROUP BY 1""")
def document_size_histogram(spark, sf_dir):
    t = F.col("t")
    docs = table(spark, sf_dir, "documents").select(fx.estimate_tokens(F.col("text")).alias("t"))
    bucket = F.when(t < 250, "a").when(t < 1000, "b").when(t < 4000, "c").otherwise("d")
    return docs.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("tokens"))


@query("harness_counts", f"""WITH {SESS} SELECT harness, count(*) AS n, sum(tok_total)::BIGINT AS tokens, max(last_activity) AS newest FROM sess GROUP BY harness""")
def harness_counts(spark, sf_dir):
    return sess(spark, sf_dir).groupBy("harness").agg(F.count(F.lit(1)).alias("n"), F.sum("tok_total").alias("tokens"), F.max("last_activity").alias("newest"))


@query("lens_counts_zero_filled", f"""WITH {SESS}, dim AS (SELECT * FROM (VALUES ('human'), ('agent'), ('mixed'), ('unknown')) v(lens)),
c AS (SELECT CASE WHEN user_turns = 0 THEN 'agent' WHEN user_turns >= 3 THEN 'human' ELSE 'mixed' END AS lens, count(*) AS n FROM sess GROUP BY 1)
SELECT lens, coalesce(n, 0) AS n FROM dim LEFT JOIN c USING (lens)""")
def lens_counts_zero_filled(spark, sf_dir):
    """Sessions by who talks, every lens listed even without sessions."""
    lens = F.when(F.col("user_turns") == 0, "agent").when(F.col("user_turns") >= 3, "human").otherwise("mixed")
    counts = sess(spark, sf_dir).groupBy(lens.alias("lens")).agg(F.count(F.lit(1)).alias("n"))
    dim = spark.createDataFrame([(x,) for x in ("human", "agent", "mixed", "unknown")], "lens string")
    return F.broadcast(dim).join(counts, "lens", "left").select("lens", F.coalesce("n", F.lit(0)).alias("n"))


@query("title_election", f"""WITH {MSGS} SELECT session_id, rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240)) AS title
FROM (SELECT session_id, text, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS rn FROM msgs WHERE record_kind = 'real_user' AND trim(text) <> '') WHERE rn = 1""")
def title_election(spark, sf_dir):
    return sessions.session_titles(msgs(spark, sf_dir))


@query("title_override_election", """WITH c AS (
  SELECT source AS k, text AS title, 'fallback' AS kind, doc_id AS position FROM documents
  UNION ALL SELECT source, 'explicit ' || lang, 'explicit', doc_id FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT source, 'override ' || lang, 'override', doc_id FROM documents WHERE doc_id % 40 = 0)
SELECT k, rtrim(substr(trim(regexp_replace(title, '\\s+', ' ', 'g')), 1, 240)) AS title, kind AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE kind WHEN 'override' THEN 0 WHEN 'explicit' THEN 1 ELSE 2 END, position) AS rn FROM c WHERE trim(title) <> '') WHERE rn = 1""")
def title_override_election(spark, sf_dir):
    """Titles of sources from their documents: override, then explicit, then the first text."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("k"), "doc_id", "text", "lang")
    rows = docs.select("k", F.col("text").alias("title"), F.lit("fallback").alias("source"), F.col("doc_id").alias("position"))
    for kind, every in (("explicit", 3), ("override", 40)):
        some = docs.filter(F.col("doc_id") % every == 0)
        rows = rows.unionByName(some.select("k", F.concat(F.lit(f"{kind} "), "lang").alias("title"), F.lit(kind).alias("source"), F.col("doc_id").alias("position")))
    return sessions.elect_title(rows, ["k"])


@query("context_window", f"""WITH {MSGS}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS pl FROM msgs),
h AS (SELECT session_id, ordinal AS hit, pl AS c FROM p WHERE role = 'assistant' AND contains(lower(text), 'the '))
SELECT p.session_id, p.ordinal, h.hit, p.role FROM p JOIN h ON p.session_id = h.session_id AND abs(p.pl - h.c) <= 1""")
def context_window(spark, sf_dir):
    m = msgs(spark, sf_dir)
    hits = search.literal_search(m.filter(F.col("role") == "assistant"), "the ").select("session_id", "ordinal")
    return sessions.context_window(m, hits, 1).select("session_id", "ordinal", "hit", "role")


@query("running_char_budget", f"""WITH {MSGS}, r AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY session_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM msgs)
SELECT session_id, ordinal, length(substr(text, 1, (1600 - used)::INT)) AS kept, md5(substr(text, 1, (1600 - used)::INT)) AS digest FROM r WHERE used < 1600""")
def running_char_budget(spark, sf_dir):
    kept = sessions.running_budget(msgs(spark, sf_dir), 1600)
    return kept.select("session_id", "ordinal", F.length("text").cast("long").alias("kept"), F.md5("text").alias("digest"))


@query("span_fold_islands", f"""WITH {MSGS}, f AS (SELECT *, length(text) < 150 AS e FROM msgs),
c AS (SELECT *, CASE WHEN e AND lag(e) OVER w THEN 0 ELSE 1 END AS ch FROM f WINDOW w AS (PARTITION BY session_id ORDER BY ordinal)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY session_id ORDER BY ordinal) AS g FROM c)
SELECT session_id, min(ordinal) AS start, max(ordinal) AS "end", bool_or(e)::INT AS folded,
  CASE WHEN bool_or(e) THEN '[' || min(ordinal) || '-' || max(ordinal) || '] ' || array_to_string(list_sort(list_distinct(list(role))), ',') || ' x' || count(*) ELSE md5(min(text)) END AS body
FROM g GROUP BY session_id, g""")
def span_fold_islands(spark, sf_dir):
    folded = sessions.fold_spans(msgs(spark, sf_dir), F.length("text") < 150)
    body = F.when(F.col("folded"), F.col("body")).otherwise(F.md5("body"))
    return folded.select("session_id", "start", "end", F.col("folded").cast("int").alias("folded"), body.alias("body"))


@query("last_reply", f"""WITH {MSGS}, t AS (SELECT *, sum(CASE WHEN side = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ordinal) AS ut FROM msgs WHERE side IS NOT NULL)
SELECT session_id, ut::BIGINT AS user_turn, min(ordinal) AS ordinal, max(ordinal) FILTER (WHERE side = 'assistant') AS reply_ordinal,
  md5(arg_max(text, ordinal) FILTER (WHERE side = 'assistant')) AS reply FROM t WHERE ut > 0 GROUP BY session_id, ut""")
def last_reply(spark, sf_dir):
    return sessions.last_replies(msgs(spark, sf_dir)).withColumn("reply", F.md5("reply"))


@query("top_documents_per_session", f"""WITH {MSGS} SELECT session_id, ordinal, place FROM (SELECT session_id, ordinal, row_number() OVER (PARTITION BY session_id ORDER BY -tokens, ordinal) AS place FROM msgs) WHERE place <= 3""")
def top_documents_per_session(spark, sf_dir):
    scored = msgs(spark, sf_dir).select("session_id", "ordinal", (-F.col("tokens")).alias("score"))
    return search.top_documents(scored).select("session_id", "ordinal", F.col("place").cast("long").alias("place"))


@query("even_sample", f"""WITH {MSGS}, p AS (SELECT session_id, ordinal, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM msgs),
w AS (SELECT DISTINCT session_id, CASE WHEN n <= 4 THEN k ELSE floor(k * (n - 1) / 3.0)::BIGINT END AS i FROM p, (VALUES (0), (1), (2), (3)) v(k))
SELECT session_id, ordinal FROM p JOIN w USING (session_id, i)""")
def even_sample(spark, sf_dir):
    """Four turns of each session, evenly spread, first and last included."""
    w = Window.partitionBy("session_id")
    placed = msgs(spark, sf_dir).select(
        "session_id", "ordinal", (F.row_number().over(w.orderBy("ordinal")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n")
    )
    wanted = F.array(*[F.floor(F.lit(k) * (F.col("n") - 1) / 3) for k in range(4)])
    return placed.filter((F.col("n") <= 4) | F.array_contains(wanted, F.col("i").cast("long"))).select("session_id", "ordinal")


FILTERED = """f AS (SELECT * FROM sess WHERE harness IN ('claude','codex','kimi') AND last_activity >= 2 AND last_activity < 7 AND user_turns > 0)"""


@query("filter_algebra", f"""WITH {SESS}, {FILTERED} SELECT session_id, harness, last_activity FROM f""")
def filter_algebra(spark, sf_dir):
    chosen = filters.SessionFilter(harnesses=["claude", "codex", "kimi"], since=2, until=7, visible_only=True)
    rows = sess(spark, sf_dir).withColumn("visible", F.col("user_turns") > 0)
    return filters.apply(rows, chosen).select("session_id", "harness", "last_activity")


@query("filter_total", f"""WITH {SESS}, {FILTERED} SELECT count(*) AS total FROM f""")
def filter_total(spark, sf_dir):
    return filter_algebra(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))


@query("filter_favorites_tags", f"""WITH {SESS}, fav AS (SELECT harness, native_id FROM sess WHERE session_id % 4 = 0),
tag AS (SELECT session_id, 'tag' || (ordinal % 3) AS tag FROM msgs WHERE role = 'user')
SELECT session_id FROM sess s WHERE EXISTS (SELECT 1 FROM tag t WHERE t.session_id = s.session_id AND t.tag IN ('tag1'))
  AND NOT EXISTS (SELECT 1 FROM fav f WHERE f.harness = s.harness AND f.native_id = s.native_id)""")
def filter_favorites_tags(spark, sf_dir):
    m, s = msgs(spark, sf_dir), sess(spark, sf_dir)
    favorites = s.filter("session_id % 4 = 0").select("harness", "native_id")
    tags = m.filter("role = 'user'").select("session_id", F.concat(F.lit("tag"), (F.col("ordinal") % 3).cast("string")).alias("tag"))
    chosen = filters.SessionFilter(tags=["tag1"], favorite=False)
    return filters.apply(s, chosen, tags=tags, favorites=favorites).select("session_id")


RAW = f"""{MSGS},
raw AS (
  SELECT session_id, ordinal, record_kind, side, text, 'uuid' AS identity_kind, 'm' || session_id || '-' || ordinal AS identity_id, ordinal * 1000 AS ts,
    CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS tools FROM msgs
  UNION ALL
  SELECT session_id, ordinal + 100, record_kind, side, text, CASE WHEN ordinal % 3 = 2 THEN 'none' ELSE 'uuid' END, 'm' || session_id || '-' || ordinal, ordinal * 1000,
    CASE WHEN role = 'assistant' THEN 1 ELSE 0 END FROM msgs WHERE session_id % 5 = 0),
keyed AS (SELECT *, CASE WHEN identity_kind <> 'none' THEN identity_id || '@' || ts ELSE 'raw:' || ordinal END AS lk FROM raw),
logical AS (
  SELECT session_id, lk, min(ordinal) AS first_ordinal, count(*) AS members, arg_min(record_kind, ordinal) AS record_kind, arg_min(side, ordinal) AS side,
    arg_min(text, ordinal) AS text, arg_min(tools, ordinal) AS tools FROM keyed GROUP BY session_id, lk)"""


def raw(spark, sf_dir) -> DataFrame:
    """Messages, those of every fifth session replayed at the end; every third replay lost its identity."""
    m = msgs(spark, sf_dir)
    tools = F.when(F.col("role") == "assistant", 1).otherwise(0)
    ident = F.concat(F.lit("m"), F.col("session_id").cast("string"), F.lit("-"), F.col("ordinal").cast("string"))
    base = m.select("session_id", "ordinal", "record_kind", "side", "text", F.lit("uuid").alias("identity_kind"), ident.alias("identity_id"), (F.col("ordinal") * 1000).alias("ts"), tools.alias("tools"))
    again = base.filter("session_id % 5 = 0").withColumns(
        {"identity_kind": F.when(F.col("ordinal") % 3 == 2, "none").otherwise("uuid"), "ordinal": F.col("ordinal") + 100}
    )
    return base.unionByName(again)


@query("logical_messages", f"""WITH {RAW} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY first_ordinal) - 1 AS logical_ordinal, first_ordinal, members, record_kind, side FROM logical""")
def logical_messages(spark, sf_dir):
    return replay.logical_messages(raw(spark, sf_dir)).select("session_id", "logical_ordinal", "first_ordinal", "members", "record_kind", "side")


METRICS = f"""{RAW},
m1 AS (SELECT session_id, count(*) AS raw, sum(tools)::BIGINT AS raw_tools, count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') AS raw_prose, count(*) FILTER (WHERE identity_kind = 'none') AS unknown_identity FROM raw GROUP BY 1),
m2 AS (SELECT session_id, count(*) AS logical, sum(tools)::BIGINT AS logical_tools, count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') AS logical_prose,
  count(*) FILTER (WHERE record_kind IN ('real_user', 'assistant_dialogue_prose') AND side = 'user' AND trim(text) <> '') AS "user",
  count(*) FILTER (WHERE record_kind IN ('real_user', 'assistant_dialogue_prose') AND side = 'assistant' AND trim(text) <> '') AS assistant FROM logical GROUP BY 1)"""


@query("construction_metrics", f"""WITH {METRICS} SELECT *, "user" + assistant AS dialogue, raw - logical AS replay FROM m1 JOIN m2 USING (session_id)""")
def construction_metrics(spark, sf_dir):
    return replay.construction_metrics(raw(spark, sf_dir))


@query("replay_agreement", f"""WITH {RAW} SELECT session_id, count(*) AS broken FROM (SELECT session_id, lk FROM (SELECT session_id, lk, CASE WHEN session_id % 10 = 0 AND ordinal >= 100 THEN 'x' ELSE '' END || record_kind || coalesce(side, '') || text AS sig FROM keyed) GROUP BY 1, 2 HAVING count(DISTINCT sig) > 1) GROUP BY 1""")
def replay_agreement(spark, sf_dir):
    """Sessions whose replays say something else than the first telling, here made so for every tenth."""
    changed = F.when((F.col("session_id") % 10 == 0) & (F.col("ordinal") >= 100), F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    bad = replay.disagreements(raw(spark, sf_dir).withColumn("text", changed))
    return bad.groupBy("session_id").agg(F.count(F.lit(1)).alias("broken"))


@query("ordinal_gaps", f"""WITH {RAW} SELECT session_id, count(*) AS n, max(ordinal) AS last FROM raw GROUP BY 1 HAVING min(ordinal) <> 0 OR max(ordinal) + 1 <> count(*) OR count(*) <> count(DISTINCT ordinal)""")
def ordinal_gaps(spark, sf_dir):
    return replay.broken_ordinals(raw(spark, sf_dir)).select("session_id", "n", "last")


@query("candidate_election", """SELECT source AS native_id, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, lang, doc_id) AS rn FROM documents) WHERE rn = 1""")
def candidate_election(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("native_id"), "doc_id", F.col("n_chars").alias("bytes"), F.col("lang").alias("root"), F.col("doc_id").alias("path"))
    return replay.elect(rows, ["native_id"]).select("native_id", "doc_id", F.col("bytes").alias("n_chars"))


PLAN_SQL = """WITH cur AS (SELECT o_orderkey AS k, o_orderpriority AS g, o_orderkey % 7 <> 0 AS v FROM orders WHERE o_orderkey % 5 <> 0),
el AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'new' ELSE o_orderpriority END AS g FROM orders WHERE o_orderkey % 3 <> 0)
SELECT coalesce(cur.k, el.k) AS k, CASE WHEN cur.k IS NULL THEN 'publish' WHEN el.k IS NULL THEN 'orphan' WHEN cur.g <> el.g THEN 'publish' WHEN NOT v THEN 'repair' ELSE 'unchanged' END AS action
FROM cur FULL JOIN el ON cur.k = el.k"""


@query("action_plan", PLAN_SQL)
def action_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cur = o.filter(k % 5 != 0).select(k.alias("k"), F.col("o_orderpriority").alias("generation"), (k % 7 != 0).alias("valid"))
    el = o.filter(k % 3 != 0).select(k.alias("k"), F.when(k % 11 == 0, "new").otherwise(F.col("o_orderpriority")).alias("generation"))
    return replay.plan_actions(cur, el, ["k"], F.lit(True))


@query("replay_prefix_skip", f"""WITH {MSGS}, r AS (SELECT session_id, ordinal, text FROM msgs UNION ALL SELECT session_id + 1000000, ordinal, CASE WHEN ordinal < 2 THEN text ELSE text || '!' END FROM msgs WHERE session_id % 4 = 0),
fs AS (SELECT text, min(session_id) AS first FROM r GROUP BY 1),
s AS (SELECT r.*, min(CASE WHEN first < session_id THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ordinal) AS sk FROM r JOIN fs USING (text))
SELECT session_id, ordinal FROM s WHERE sk = 0""")
def replay_prefix_skip(spark, sf_dir):
    m = msgs(spark, sf_dir).select("session_id", "ordinal", "text")
    resumed = m.filter("session_id % 4 = 0").select(
        (F.col("session_id") + 1_000_000).alias("session_id"), "ordinal", F.when(F.col("ordinal") < 2, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("text")
    )
    return replay.prefix_skip(m.unionByName(resumed), F.col("session_id")).select("session_id", "ordinal")
