"""Time: eras, sessionisation, buckets, feeds and health over ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinlake.functions import text as fx
from skeinlake.operators import lineage, reports
from skeinlake.plans.registry import query, table
from skeinlake.streaming import sessionize

#: The moment the reports look back from: the end of the events' month.
NOW_MS = 1_706_659_200_000


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


E = "e AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms FROM events)"


@query("era_sessionization", f"""WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, epoch_ms(o_orderdate::TIMESTAMP) AS start_ms, epoch_ms(o_orderdate::TIMESTAMP) + (o_orderkey % 40) * 86400000 AS end_ms FROM orders),
r AS (SELECT *, max(end_ms) OVER (PARTITION BY k ORDER BY start_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach >= 2592000000 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start_ms, id) AS era FROM r)
SELECT k, era::BIGINT AS era, count(*) AS orders, min(start_ms) AS from_ms, max(end_ms) AS to_ms FROM n GROUP BY k, era""")
def era_sessionization(spark, sf_dir):
    """Customers' eras: thirty idle days after the latest reach of all orders so far start a new one."""
    start = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), start.alias("start_ms"))
    spans = o.withColumn("end_ms", F.col("start_ms") + (F.col("id") % 40) * lineage.DAY_MS)
    eras = lineage.eras(spans, ["k"], 30 * lineage.DAY_MS)
    return eras.groupBy("k", "era").agg(F.count(F.lit(1)).alias("orders"), F.min("start_ms").alias("from_ms"), F.max("end_ms").alias("to_ms"))


@query("event_sessions_window", f"""WITH {E}, l AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS p FROM e),
n AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM l)
SELECT user_id, min(ms) AS start_ms, max(ms) + 1800000 AS end_ms, count(*) AS n, round(sum(value), 4) AS total FROM n GROUP BY user_id, s""")
def event_sessions_window(spark, sf_dir):
    """Sessions by thirty idle minutes, with the same function as the stream uses."""
    found = sessionize.event_sessions(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select("user_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n", F.round("total", 4).alias("total"))


@query("ingest_hourly_buckets", f"""WITH {E}, b AS (SELECT unnest(range(0, 12))::INT AS bucket),
c AS (SELECT greatest(0, least(11, floor((ms - {NOW_MS - 86_400_000}) / 7200000.0)))::INT AS bucket, count(*) AS sessions, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS scanned,
  sum(CASE WHEN event_type <> 'error' THEN (event_id % 50) * 100 ELSE 0 END)::BIGINT AS scan_ms FROM e WHERE ms >= {NOW_MS - 86_400_000} GROUP BY 1)
SELECT bucket, coalesce(sessions, 0) AS sessions, coalesce(scanned, 0) AS scanned, coalesce(scan_ms, 0) AS scan_ms FROM b LEFT JOIN c USING (bucket)""")
def ingest_hourly_buckets(spark, sf_dir):
    runs = _events(spark, sf_dir).select(
        F.col("ms").alias("finished_ms"), (F.col("ms") - (F.col("event_id") % 50) * 100).alias("started_ms"), F.lit(1).alias("seen"), (F.col("event_type") != "error").alias("reachable")
    )
    return reports.two_hour_buckets(runs, NOW_MS)


@query("latest_run_per_source", f"""WITH {E} SELECT event_type, event_id, ms FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ms DESC, event_id DESC) AS rn FROM e) WHERE rn = 1""")
def latest_run_per_source(spark, sf_dir):
    return reports.latest_per(_events(spark, sf_dir), ["event_type"], ["ms", "event_id"]).select("event_type", "event_id", "ms")


@query("source_freshness", f"WITH {E} SELECT event_type, max(ms) AS last_ms, max(ms) FILTER (WHERE value > 50) AS last_large_ms, count(*) AS n FROM e GROUP BY 1")
def source_freshness(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(
        F.max("ms").alias("last_ms"), F.max(F.when(F.col("value") > 50, F.col("ms"))).alias("last_large_ms"), F.count(F.lit(1)).alias("n")
    )


@query("event_feed_top6", f"""WITH {E}, u AS (SELECT * FROM (SELECT event_id, event_type, ms FROM e WHERE event_type = 'error' ORDER BY ms DESC, event_id DESC LIMIT 8) UNION ALL SELECT * FROM (SELECT event_id, event_type, ms FROM e WHERE event_type = 'purchase' ORDER BY ms DESC, event_id DESC LIMIT 8))
SELECT * FROM u ORDER BY ms DESC, event_id DESC LIMIT 6""")
def event_feed_top6(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "event_type", "ms")
    return reports.feed([e.filter(F.col("event_type") == t) for t in ("error", "purchase")], 8, 6, ["ms", "event_id"])


@query("date_clusters", """WITH d AS (SELECT event_id, ts::DATE AS d FROM events)
SELECT event_id, CASE WHEN d = DATE '2024-01-25' THEN 'today' WHEN d = DATE '2024-01-24' THEN 'yesterday' WHEN d >= date_trunc('week', DATE '2024-01-25') AND d < DATE '2024-01-24' THEN 'this-week' ELSE 'month:' || strftime(d, '%Y-%m') END AS cluster FROM d""")
def date_clusters(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", fx.date_cluster(F.to_date("ts"), F.lit("2024-01-25").cast("date")).alias("cluster"))


@query("cluster_headers", """WITH d AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events),
l AS (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day DESC) AS p FROM d)
SELECT user_id, day, CASE WHEN p IS NULL OR substr(p, 1, 7) <> substr(day, 1, 7) OR date_diff('day', day::DATE, p::DATE) > 1 THEN 1 ELSE 0 END AS header FROM l""")
def cluster_headers(spark, sf_dir):
    """Days of each user, newest first, with a header where a run of days ends."""
    days = _events(spark, sf_dir).select("user_id", fx.iso_day(F.col("ms")).alias("day")).distinct()
    before = F.lag("day").over(Window.partitionBy("user_id").orderBy(F.col("day").desc()))
    fresh = before.isNull() | (F.substring(before, 1, 7) != F.substring("day", 1, 7)) | (F.date_diff(before.cast("date"), F.col("day").cast("date")) > 1)
    return days.select("user_id", "day", F.when(fresh, 1).otherwise(0).alias("header"))


@query("promoted_tags", "SELECT event_type || '-' || (user_id % 20) AS tag, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 3 ORDER BY n DESC, tag LIMIT 7")
def promoted_tags(spark, sf_dir):
    """The seven most used tags that at least three users share."""
    tag = F.concat("event_type", F.lit("-"), (F.col("user_id") % 20).cast("string"))
    counts = _events(spark, sf_dir).groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return counts.filter("users >= 3").orderBy(F.col("n").desc(), "tag").limit(7)


@query("dominant_facet", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1")
def dominant_facet(spark, sf_dir):
    return reports.dominant(_events(spark, sf_dir), "user_id", "event_type")


@query("json_props", "SELECT (props->>'k')::BIGINT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return _events(spark, sf_dir).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("job_queue_rollup", f"""WITH {E}, j AS (SELECT user_id, ms, CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'done' END AS st FROM e WHERE event_id % 7 = user_id % 7)
SELECT user_id, ['running','failed','pending','done'][(min(CASE st WHEN 'running' THEN 0 WHEN 'failed' THEN 1 WHEN 'pending' THEN 2 ELSE 3 END) + 1)::INT] AS status, count(*) AS attempts, count(*) FILTER (WHERE st = 'failed') AS failures, max(ms) AS last FROM j GROUP BY 1""")
def job_queue_rollup(spark, sf_dir):
    t = F.col("event_type")
    status = F.when(t == "click", "running").when(t == "error", "failed").when(t == "view", "pending").otherwise("done")
    jobs = _events(spark, sf_dir).filter("event_id % 7 = user_id % 7").select("user_id", status.alias("status"), F.col("ms").alias("at"))
    return reports.job_rollup(jobs, ["user_id"])


@query("attempt_ordinals", f"WITH {E} SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id) AS attempt, least(3600000, power(2, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id) - 1) * 30000)::BIGINT AS wait_ms FROM e WHERE event_type = 'error'")
def attempt_ordinals(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ms", "event_id")
    rows = _events(spark, sf_dir).filter("event_type = 'error'").select("event_id", F.row_number().over(w).cast("long").alias("attempt"))
    return rows.withColumn("wait_ms", fx.backoff_ms(F.col("attempt")))


@query("doctor_severity", f"""WITH {E}, s AS (SELECT user_id, {NOW_MS} - max(ms) AS age, {NOW_MS} - coalesce(max(ms) FILTER (WHERE event_type = 'purchase'), 0) AS cage, count(*) FILTER (WHERE event_type = 'error') AS f, user_id % 2 = 0 AS churn FROM e GROUP BY user_id)
SELECT user_id, ['ok','notice','warning','critical'][greatest(CASE WHEN age >= 21600000 THEN 2 WHEN age >= 5400000 THEN 1 ELSE 0 END, CASE WHEN churn AND cage < 86400000 THEN 0 WHEN cage >= 86400000 THEN 2 ELSE 0 END, CASE WHEN f >= 10 THEN 3 WHEN f > 0 THEN 1 ELSE 0 END) + 1] AS severity FROM s""")
def doctor_severity(spark, sf_dir):
    s = _events(spark, sf_dir).groupBy("user_id").agg(
        F.max("ms").alias("last"), F.max(F.when(F.col("event_type") == "purchase", F.col("ms"))).alias("complete"), F.count_if(F.col("event_type") == "error").alias("f")
    )
    rank = reports.severity(F.lit(NOW_MS) - F.col("last"), F.lit(NOW_MS) - F.coalesce("complete", F.lit(0)), F.col("user_id") % 2 == 0, F.col("f"))
    return s.select("user_id", reports.severity_name(rank).alias("severity"))


@query("expected_cost", f"""WITH {E}, l AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ms DESC, event_id DESC) AS rn FROM e WHERE event_id % 2 = 0),
a AS (SELECT event_type, avg(value) AS average FROM l WHERE rn <= 30 GROUP BY 1), r AS (SELECT event_type, count(*) AS remaining FROM e WHERE event_id % 2 = 1 GROUP BY 1)
SELECT event_type, round(average, 6) AS average, remaining, round(average * remaining, 4) AS estimate FROM a JOIN r USING (event_type)""")
def expected_cost(spark, sf_dir):
    e = _events(spark, sf_dir)
    found = reports.expected_cost(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "event_type", "value", ["ms", "event_id"])
    return found.select("event_type", F.round("average", 6).alias("average"), "remaining", F.round("estimate", 4).alias("estimate"))


@query("summarizer_telemetry", f"""WITH {E} SELECT event_type, count(*) FILTER (WHERE ms >= {NOW_MS - 86_400_000 * 5}) AS done_recent, count(*) FILTER (WHERE value > 90) AS failures, arg_max(user_id, (ms, event_id)) AS last_user FROM e GROUP BY 1""")
def summarizer_telemetry(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(
        F.count_if(F.col("ms") >= NOW_MS - 86_400_000 * 5).alias("done_recent"), F.count_if(F.col("value") > 90).alias("failures"), F.max_by("user_id", F.struct("ms", "event_id")).alias("last_user")
    )


@query("staleness_growth", """WITH s AS (SELECT user_id, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-20') AS th, count(*) AS nw, CASE WHEN user_id % 4 = 0 THEN 'legacy' ELSE 'dialogue_turn_count_v1' END AS basis FROM events GROUP BY 1)
SELECT user_id, th AS turns_then, nw AS turns_now, round((nw - th) * 100.0 / greatest(th, 1), 4) AS growth FROM s WHERE basis = 'dialogue_turn_count_v1' AND (nw - th) * 100.0 / greatest(th, 1) >= 50""")
def staleness_growth(spark, sf_dir):
    now = _events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("ts") < F.lit("2024-01-20").cast("timestamp")).alias("turns_then"), F.count(F.lit(1)).alias("turns_now"))
    basis = F.when(F.col("user_id") % 4 == 0, "legacy").otherwise("dialogue_turn_count_v1")
    stale = lineage.staleness(now.withColumn("basis", basis), 50.0)
    return stale.select("user_id", "turns_then", "turns_now", F.round("growth", 4).alias("growth"))
