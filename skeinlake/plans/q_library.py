"""Passages, artifacts, citations, exports and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlake.operators import library, packing, passages
from skeinlake.plans.q_sessions import MSGS, SESS, msgs, sess
from skeinlake.plans.registry import query, table


def _held(spark, sf_dir):
    return passages.passages(msgs(spark, sf_dir), F.lit("obs1"))


@query("passage_refs", f"""WITH {MSGS} SELECT session_id, ordinal, strlen(text) AS end_byte, sha256(text) AS text_hash,
  'p1:' || rtrim(replace(replace(base64(encode('{{"v":1,"harness":"' || harness || '","native_id":"' || native_id || '","observation":"obs1","record":"' || ordinal || '","channel":"prose","start":0,"end":' || strlen(text) || ',"hash":"' || sha256(text) || '"}}')), '+', '-'), '/', '_'), '=') AS ref FROM msgs""")
def passage_refs(spark, sf_dir):
    return _held(spark, sf_dir).select("session_id", "ordinal", "end_byte", "text_hash", "ref")


@query("passage_resolve", f"""WITH {MSGS} SELECT session_id, ordinal, CASE WHEN session_id % 3 = 0 THEN 'unavailable' WHEN session_id % 3 = 1 THEN 'pinned' ELSE 'current' END AS status FROM msgs""")
def passage_resolve(spark, sf_dir):
    """References to passages of which a third changed, a third is older and a third is current."""
    held = _held(spark, sf_dir)
    altered = held.withColumn("text", F.when(F.col("session_id") % 3 == 0, F.reverse("text")).otherwise(F.col("text")))
    current = held.filter("session_id % 3 = 2").select("harness", "native_id", "observation").distinct()
    palindromes = F.reverse("text") == F.col("text")
    found = passages.resolve(held.select("ref"), altered, current)
    named = found.join(held.filter(~palindromes).select("ref", "session_id", "ordinal"), "ref")
    return named.select("session_id", "ordinal", "status")


@query("utf8_subranges", f"""WITH {MSGS} SELECT session_id, ordinal, md5(substr(text, 4)) AS tail FROM msgs WHERE regexp_matches(substr(text, 1, 3), '^[\\x00-\\x7F]*$') AND length(text) >= 3""")
def utf8_subranges(spark, sf_dir):
    """Texts without their first three bytes, where these are whole characters."""
    from skeinlake.functions import text as fx

    m = msgs(spark, sf_dir).filter(F.substring("text", 1, 3).rlike(r"^[\x00-\x7F]*$") & (F.length("text") >= 3))
    tail = fx.utf8_slice(F.col("text"), F.lit(3), F.octet_length("text"))
    return m.select("session_id", "ordinal", F.md5(tail).alias("tail"))


@query("evidence_segments")
def evidence_segments(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.encode("text", "UTF-8").alias("content"))
    return passages.segments(files, 1000)


@query("segment_evolution", """SELECT doc_id AS name, CASE doc_id % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'appended' WHEN 2 THEN 'rewritten' ELSE 'new' END AS change FROM documents WHERE doc_id % 8 <> 7
UNION ALL SELECT doc_id, 'gone' FROM documents WHERE doc_id % 8 = 7""")
def segment_evolution(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.encode("text", "UTF-8").alias("content"), "text")
    k = F.col("name") % 4
    text = F.when(k == 1, F.concat("text", F.lit("\nmore"))).when(k == 2, F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    after = d.filter("name % 8 <> 7").select("name", F.encode(text, "UTF-8").alias("content"))
    return passages.evolution(d.filter("name % 8 = 7 OR name % 4 <> 3").select("name", "content"), after)


@query("artifact_mentions", r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(url, '[A-Za-z0-9_./@+~-]+')) AS tok FROM pages),
s AS (SELECT DISTINCT page_id, tok, list_filter(string_split(tok, '/'), lambda x: x <> '') AS parts FROM t WHERE contains(tok, '/'))
SELECT page_id AS key, tok AS path FROM s WHERE (len(parts) > 0 AND regexp_matches(parts[-1], '\.[A-Za-z0-9_-]+$')) OR (starts_with(tok, '/') AND len(parts) >= 2)""")
def artifact_mentions(spark, sf_dir):
    """What looks like a path in the pages' addresses."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.lit("assistant").alias("role"), F.lit("prose").alias("channel"), F.col("url").alias("text"))
    return passages.artifacts(rows).select("key", "path")


@query("artifact_origin", """SELECT doc_id AS key, '/w/' || source || '.txt' AS path, CASE doc_id % 4 WHEN 0 THEN 'creation_observed' WHEN 1 THEN 'worked_on' ELSE 'creation_requested' END AS kind, CASE WHEN doc_id % 4 = 2 THEN 'candidate' ELSE 'observed' END AS certainty FROM documents WHERE doc_id % 4 < 3""")
def artifact_origin(spark, sf_dir):
    """Tool results of four kinds; only an explicit creation is an origin, the fourth kind says nothing."""
    k = F.col("doc_id") % 4
    path = F.concat(F.lit("/w/"), "source", F.lit(".txt"))
    body = F.to_json(
        F.struct(
            path.alias("path"), (k < 2).alias("success"), (k == 0).alias("created"), F.when(k == 0, False).alias("existed_before"),
            F.when(k == 1, "edit").when(k == 2, "write").otherwise("read").alias("action"),
        )
    )
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.lit("tool").alias("role"), F.lit("tool:0").alias("channel"), body.alias("text"))
    return passages.artifacts(rows).filter("kind <> 'mentioned'")


@query("citation_validation", """WITH a AS (SELECT conv_id AS key, conv_id AS id, turn AS ordinal FROM conversations WHERE turn < 3), ev AS (SELECT conv_id AS id, min(turn) AS lo, min(turn) + 1 AS hi FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1)
SELECT a.key, a.id, a.ordinal, bool_or(coalesce(a.ordinal BETWEEN lo AND hi, false))::INT AS valid FROM a LEFT JOIN ev USING (id) GROUP BY ALL""")
def citation_validation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    mark = F.concat(F.lit("see ["), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.lit("] and again ["), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.lit("]"))
    answers = c.filter("turn < 3").select(F.col("conv_id").alias("key"), mark.alias("text"))
    evidence = c.filter("conv_id % 2 = 0").groupBy(F.col("conv_id").alias("id")).agg(F.min("turn").alias("lo"), (F.min("turn") + 1).alias("hi"))
    return passages.check_citations(answers, evidence).withColumn("valid", F.col("valid").cast("int"))


@query("coverage_summary", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id % 10, event_id % 100 ORDER BY epoch_us(ts) DESC, event_id DESC) AS rn FROM events)
SELECT user_id % 10 AS source, count(*) AS units, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS ok, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type IN ('signup')) AS gaps, sum(floor(value))::BIGINT AS bytes FROM l WHERE rn = 1 GROUP BY 1""")
def coverage_summary(spark, sf_dir):
    t = F.col("event_type")
    status = F.when(t.isin("view", "click"), "ok").when(t == "error", "error").when(t == "signup", "disabled").otherwise("other")
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("source"), (F.col("event_id") % 100).alias("locator"), F.col("ts").alias("at"), F.col("event_id").alias("id"), status.alias("status"), F.floor("value").alias("bytes")
    )
    return passages.coverage(rows)


COVERED = """src AS (SELECT s_suppkey AS id, 'h' || s_nationkey AS harness, s_suppkey % 3 <> 0 AS enabled, CASE s_suppkey % 4 WHEN 1 THEN NULL ELSE s_suppkey % 4 <> 2 END AS reachable, CASE s_suppkey % 5 WHEN 0 THEN 'unsupported' WHEN 1 THEN NULL ELSE 'full' END AS capability, CASE s_suppkey % 7 WHEN 3 THEN 'no access ' || repeat('x', (s_suppkey * 30)::INT) WHEN 4 THEN '' END AS error FROM supplier),
obs AS (SELECT event_id AS id, user_id % 10 AS source_id, event_id % 300 AS locator, ts AS seen, CASE event_id % 6 WHEN 0 THEN 'excluded' WHEN 1 THEN NULL ELSE 'kept' END AS admission, event_type <> 'error' AS indexed, CASE WHEN event_type = 'click' THEN ['gap ' || event_id, 'late'] WHEN event_type = 'view' THEN [] END AS gaps FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, locator ORDER BY seen DESC, id DESC) AS rn FROM obs) WHERE rn = 1),
lim AS (SELECT 'source' AS kind, id::VARCHAR AS id, harness || ': ' || CASE WHEN coalesce(error, '') <> '' THEN error WHEN NOT enabled THEN 'excluded' ELSE 'unavailable or unsupported' END AS text FROM src WHERE NOT enabled OR NOT coalesce(reachable, false) OR coalesce(capability, '') = 'unsupported' OR coalesce(error, '') <> ''
  UNION ALL SELECT 'observation', id::VARCHAR, id || ': ' || CASE WHEN coalesce(len(gaps), 0) > 0 THEN array_to_string(gaps, '; ') ELSE 'retained but not indexed' END FROM latest WHERE coalesce(admission, '') <> 'excluded' AND (NOT indexed OR coalesce(len(gaps), 0) > 0))"""


def _covered(spark, sf_dir):
    k = F.col("s_suppkey")
    sources = table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.concat(F.lit("h"), F.col("s_nationkey").cast("string")).alias("harness"), (k % 3 != 0).alias("enabled"), F.when(k % 4 != 1, k % 4 != 2).alias("reachable"),
        F.when(k % 5 == 0, "unsupported").when(k % 5 != 1, "full").alias("capability"), F.when(k % 7 == 3, F.concat(F.lit("no access "), F.repeat(F.lit("x"), (k * 30).cast("int")))).when(k % 7 == 4, "").alias("error"),
    )
    e, t = F.col("event_id"), F.col("event_type")
    observations = table(spark, sf_dir, "events").select(
        e.alias("id"), (F.col("user_id") % 10).alias("source_id"), (e % 300).alias("locator"), F.col("ts").alias("at"), F.when(e % 6 == 0, "excluded").when(e % 6 != 1, "kept").alias("admission"), (t != "error").alias("indexed"),
        F.when(t == "click", F.array(F.concat(F.lit("gap "), e.cast("string")), F.lit("late"))).when(t == "view", F.array().cast("array<string>")).alias("gaps"),
    )
    return sources, observations


@query("coverage_limitations", f"""WITH {COVERED} SELECT kind, id, CASE WHEN length(text) > 1024 THEN substr(text, 1, 1024) || '…' ELSE text END AS text, length(text) > 1024 AS cut FROM lim""")
def coverage_limitations(spark, sf_dir):
    """Why sources and places aren't covered, each with its own words."""
    return library.limitations(*_covered(spark, sf_dir))


@query("coverage_totals", f"""WITH {COVERED} SELECT (SELECT count(*) FROM src) AS sources, (SELECT count(*) FROM latest) AS observations, (SELECT count(*) FROM latest WHERE indexed) AS indexed, (SELECT count(*) FROM latest WHERE admission = 'excluded') AS excluded,
(SELECT count(*) FROM lim WHERE kind = 'source') AS source_issues, (SELECT count(*) FROM lim WHERE kind = 'observation') AS observation_issues, (SELECT count(*) FROM lim) > 0 AS "partial" """)
def coverage_totals(spark, sf_dir):
    """How much is covered, in one row."""
    return library.coverage_totals(*_covered(spark, sf_dir))


@query("correction_overlay", """SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'junk' ELSE d.source END AS source, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)""")
def correction_overlay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    fixes = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit("junk").alias("source"))
    return passages.overlay(docs, fixes, ["doc_id"], ["source"])


@query("variant_planning", f"""WITH {MSGS} SELECT session_id AS base, CASE session_id % 4 WHEN 0 THEN 'same' WHEN 1 THEN CASE WHEN count(*) > 1 THEN 'prefix' ELSE 'same' END WHEN 2 THEN 'extension' ELSE 'variant' END AS relation FROM msgs GROUP BY session_id""")
def variant_planning(spark, sf_dir):
    """Copies of sessions: the same, cut short, gone on, or gone another way."""
    rows = msgs(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.md5("text").alias("h")))).alias("p"))
    items = F.transform("p", lambda x: x["h"])
    k = F.col("session_id") % 4
    copy = (
        F.when(k == 1, F.slice(items, 1, F.greatest(F.lit(1), F.size(items) - 1)))
        .when(k == 2, F.concat(items, F.array(F.lit("more"))))
        .when(k == 3, F.concat(F.array(F.lit("other")), items))
        .otherwise(items)
    )
    chains = rows.select(F.col("session_id").alias("base"), F.col("session_id").alias("copy"), items.alias("base_items"), copy.alias("copy_items"))
    return passages.prefix_variants(chains).select("base", "relation")


@query("context_export", f"""WITH RECURSIVE {MSGS}, r AS (SELECT session_id, ordinal, strlen(text) AS bytes, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS rn FROM msgs),
f AS (SELECT session_id, ordinal, rn, bytes <= 1000 AS included, CASE WHEN bytes <= 1000 THEN bytes ELSE 0 END AS used FROM r WHERE rn = 1
  UNION ALL SELECT r.session_id, r.ordinal, r.rn, f.used + r.bytes <= 1000, f.used + CASE WHEN f.used + r.bytes <= 1000 THEN r.bytes ELSE 0 END FROM f JOIN r ON r.session_id = f.session_id AND r.rn = f.rn + 1)
SELECT session_id, ordinal, included FROM f""")
def context_export(spark, sf_dir):
    """Which turns of each session go in a context of 1,000 bytes."""
    rows = msgs(spark, sf_dir).select("session_id", "ordinal", F.octet_length("text").alias("bytes"))
    return passages.export_context(rows, ["session_id"], "ordinal", 1000)


@query("head_tail_cap", f"""WITH {MSGS}, r AS (SELECT session_id, tokens, sum(tokens) OVER (PARTITION BY session_id) AS total, sum(tokens) OVER (PARTITION BY session_id ORDER BY ordinal) AS up FROM msgs)
SELECT session_id, CASE WHEN total <= 300 THEN 'whole' WHEN up <= 150 THEN 'head' WHEN total - up + tokens <= 150 THEN 'tail' ELSE 'omitted' END AS part, sum(tokens)::BIGINT AS tokens, count(*) AS turns FROM r GROUP BY 1, 2""")
def head_tail_cap(spark, sf_dir):
    return packing.head_tail(msgs(spark, sf_dir), 300)


TURNS = f"""{MSGS}, t AS (SELECT session_id, ordinal, side, text, ceil((length(side) + 2 + length(text)) / 4.0)::BIGINT AS tokens FROM msgs WHERE side IS NOT NULL),
a AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id)::BIGINT AS total, sum(tokens) OVER (PARTITION BY session_id ORDER BY ordinal)::BIGINT AS up FROM t),
e AS (SELECT *, length(side) + 2 AS s, total - up + tokens AS down FROM a),
h AS (SELECT *, CASE WHEN up <= 200 THEN text WHEN 4 * (200 - up + tokens) - s > 0 THEN substr(text, 1, 4 * (200 - up + tokens) - s) END AS head, CASE WHEN down <= 201 THEN text WHEN 4 * (201 - down + tokens) - s > 0 THEN right(text, 4 * (201 - down + tokens) - s) END AS tail FROM e),
m AS (SELECT session_id, ordinal, side, s, text, CASE WHEN total <= 401 THEN text WHEN head IS NOT NULL AND tail IS NOT NULL THEN
  CASE WHEN ceil((s + length(head) + 21 + length(tail)) / 4.0) <= 401 THEN head || chr(10) || '[…middle omitted…]' || chr(10) || tail WHEN ceil((s + length(head) + 1 + length(tail)) / 4.0) <= 401 THEN head || chr(10) || tail ELSE substr(head, 1, 800 - s) || right(tail, 800 - s) END
  ELSE coalesce(head, tail) END AS shown FROM h WHERE total <= 401 OR head IS NOT NULL OR tail IS NOT NULL),
n AS (SELECT *, ceil((s + length(shown)) / 4.0)::BIGINT AS n FROM m),
o AS (SELECT *, sum(n) OVER (PARTITION BY session_id) - 401 - coalesce(sum(n) OVER (PARTITION BY session_id ORDER BY ordinal DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM n),
c AS (SELECT session_id, ordinal, side, s, text, CASE WHEN over <= 0 THEN shown WHEN 4 * (n - over) - s > 0 THEN right(shown, (4 * (n - over) - s)::BIGINT) END AS shown FROM o)"""


@query("capped_turns", f"""WITH {TURNS} SELECT session_id, ordinal, md5(shown) AS digest, ceil((s + length(shown)) / 4.0)::BIGINT AS tokens, shown <> text AS cut FROM c WHERE shown IS NOT NULL""")
def capped_turns(spark, sf_dir):
    """Dialogues within 401 tokens: turns at the cap are cut, a turn in the middle keeps both ends."""
    t = msgs(spark, sf_dir).filter("side IS NOT NULL")
    return packing.capped_turns(t, 401).select("session_id", "ordinal", F.md5("text").alias("digest"), "tokens", "cut")


@query("capped_omissions", f"""WITH {TURNS}, k AS (SELECT session_id, count(*) AS kept, count(*) FILTER (WHERE shown <> text) AS cut, sum(length(replace(shown, chr(10) || '[…middle omitted…]' || chr(10), '')))::BIGINT AS held FROM c WHERE shown IS NOT NULL GROUP BY 1),
w AS (SELECT session_id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM t GROUP BY 1)
SELECT session_id, turns, coalesce(kept, 0) AS kept, coalesce(cut, 0) AS cut, turns - coalesce(kept, 0) AS omitted, chars - coalesce(held, 0) AS omitted_chars FROM w LEFT JOIN k USING (session_id)""")
def capped_omissions(spark, sf_dir):
    """What the cap left out of each dialogue."""
    t = msgs(spark, sf_dir).filter("side IS NOT NULL")
    return packing.omissions(t, packing.capped_turns(t, 401))


@query("batch_packing", f"""WITH RECURSIVE {SESS}, r AS (SELECT harness, session_id, session_id // 100000 AS shard, least(tok_total, 4000) AS tokens, row_number() OVER (PARTITION BY harness, session_id // 100000 ORDER BY session_id) AS rn FROM sess),
f AS (SELECT harness, shard, session_id, rn, 0 AS batch, 1 AS items, tokens::BIGINT AS used FROM r WHERE rn = 1
  UNION ALL SELECT r.harness, r.shard, r.session_id, r.rn, f.batch + CASE WHEN f.items + 1 > 20 OR f.used + r.tokens > 4000 THEN 1 ELSE 0 END, CASE WHEN f.items + 1 > 20 OR f.used + r.tokens > 4000 THEN 1 ELSE f.items + 1 END, CASE WHEN f.items + 1 > 20 OR f.used + r.tokens > 4000 THEN r.tokens ELSE f.used + r.tokens END
  FROM f JOIN r ON r.harness = f.harness AND r.shard = f.shard AND r.rn = f.rn + 1)
SELECT harness, session_id, batch FROM f""")
def batch_packing(spark, sf_dir):
    """Sessions dealt to batches of at most 20 sessions and 4,000 tokens, each harness and each range of 100,000 ids apart."""
    s = sess(spark, sf_dir).select("harness", "session_id", F.col("tok_total").alias("tokens"))
    return packing.pack(packing.ranged(s, "session_id", 100_000), ["harness", "shard"], ["session_id"], 20, 4000).drop("shard")


@query("batch_plan", f"""WITH RECURSIVE {SESS}, p AS (SELECT session_id, tok_total AS tin, 500 AS tout, tok_total * 3.0::DOUBLE / 1000000 AS din, 500 * 15.0::DOUBLE / 1000000 AS dout FROM sess WHERE tok_total <= 3000),
r AS (SELECT *, round(din + dout, 8) AS dall, session_id // 64 AS shard, row_number() OVER (PARTITION BY session_id // 64 ORDER BY session_id) AS rn FROM p),
f AS (SELECT shard, session_id, rn, 0 AS batch, tin::BIGINT AS a, tout::BIGINT AS b, din AS c, dout AS d, dall AS e FROM r WHERE rn = 1
  UNION ALL SELECT shard, session_id, rn, batch + flush, CASE WHEN flush = 1 THEN tin ELSE a + tin END, CASE WHEN flush = 1 THEN tout ELSE b + tout END, CASE WHEN flush = 1 THEN din ELSE c + din END, CASE WHEN flush = 1 THEN dout ELSE d + dout END, CASE WHEN flush = 1 THEN dall ELSE e + dall END
  FROM (SELECT r.*, f.batch, f.a, f.b, f.c, f.d, f.e, CASE WHEN f.a + r.tin > 3000 OR f.b + r.tout > 5000 OR f.c + r.din > 0.008 OR f.d + r.dout > 0.05 OR f.e + r.dall > 0.045 THEN 1 ELSE 0 END AS flush FROM f JOIN r ON r.shard = f.shard AND r.rn = f.rn + 1))
SELECT shard, session_id, batch FROM f""")
def batch_plan(spark, sf_dir):
    """Sessions dealt to batches within five caps of tokens and dollars, in ranges of 64 ids."""
    s = sess(spark, sf_dir).filter("tok_total <= 3000").select("session_id", F.col("tok_total").alias("input_tokens"))
    caps = dict(zip(packing.CAPS, (3000, 5000, 0.008, 0.05, 0.045)))
    return packing.pack_within(packing.priced(packing.ranged(s, "session_id", 64), 500, 3.0, 15.0), ["shard"], ["session_id"], caps)


@query("export_ladder", r"""WITH s AS (SELECT source AS scope, sum(ceil(length(text) / 4.0))::BIGINT AS "full", sum(ceil(length(CASE WHEN regexp_extract(trim(text), '^((?:[^.!?]*[.!?]){1,2})', 1) <> '' THEN trim(regexp_extract(trim(text), '^((?:[^.!?]*[.!?]){1,2})', 1)) ELSE trim(text) END) / 4.0))::BIGINT AS short FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
f AS (SELECT source AS scope, sum(ceil(length(text) / 4.0))::BIGINT AS fixed FROM documents WHERE doc_id % 5 = 1 GROUP BY 1)
SELECT scope, coalesce("full", 0) AS "full", coalesce(short, 0) AS short, coalesce(fixed, 0) AS fixed, CASE WHEN coalesce("full", 0) + coalesce(fixed, 0) <= 20000 THEN 'full' WHEN coalesce(short, 0) + coalesce(fixed, 0) <= 20000 THEN 'two_sentences' WHEN coalesce(fixed, 0) <= 20000 THEN 'drop_oldest' ELSE 'error' END AS step FROM s FULL JOIN f USING (scope)""")
def export_ladder(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), "text", "doc_id")
    return packing.export_preview(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 5 = 1"), 20000)
