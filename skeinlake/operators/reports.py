"""Dashboard aggregates: time buckets, feeds, roll-ups, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_hour_buckets(runs: DataFrame, now_ms: int) -> DataFrame:
    """(bucket, sessions, scanned, scan_ms): twelve two-hour buckets of the last day, all listed.

    ``runs`` has finished_ms, started_ms, seen, reachable.
    """
    day_ago = now_ms - 86_400_000
    recent = runs.filter(F.col("finished_ms") >= day_ago)
    bucket = F.greatest(F.lit(0), F.least(F.lit(11), F.floor((F.col("finished_ms") - day_ago) / 7_200_000))).cast("int")
    good = F.col("reachable")
    sums = recent.groupBy(bucket.alias("bucket")).agg(
        F.sum("seen").cast("long").alias("sessions"),
        F.sum(F.when(good, F.col("seen")).otherwise(0)).cast("long").alias("scanned"),
        F.sum(F.when(good, F.greatest(F.lit(0), F.col("finished_ms") - F.col("started_ms"))).otherwise(0)).cast("long").alias("scan_ms"),
    )
    dim = runs.sparkSession.range(12).select(F.col("id").cast("int").alias("bucket"))
    return F.broadcast(dim).join(sums, "bucket", "left").fillna(0, ["sessions", "scanned", "scan_ms"])


def latest_per(frame: DataFrame, key: list[str], order: list[str], most: int = 1) -> DataFrame:
    """The newest rows of each key, by ``order`` descending."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))
    return frame.withColumn("place", place.cast("long")).filter(F.col("place") <= most)


def feed(frames: list[DataFrame], each: int, total: int, order: list[str]) -> DataFrame:
    """The newest ``each`` rows of every frame, and of those the newest ``total``."""
    by = [F.col(c).desc() for c in order]
    rows = None
    for frame in frames:
        top = frame.orderBy(*by).limit(each)
        rows = top if rows is None else rows.unionByName(top)
    return rows.orderBy(*by).limit(total)


def dominant(frame: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key; ties go to the smaller one."""
    counts = frame.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(value).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias(value), (-F.col("b.minus")).alias("n"))


def facet_counts(members: DataFrame, facets: list[str], session: str, chosen: dict[str, str]) -> DataFrame:
    """(facet, value, sessions) where each facet is counted under the other facets' choices only."""
    out = None
    for facet in facets:
        keep = F.lit(True)
        for other, value in chosen.items():
            if other != facet:
                keep = keep & (F.col(other) == value)
        one = members.filter(keep).groupBy(F.col(facet).alias("value")).agg(F.countDistinct(session).alias("sessions"))
        one = one.select(F.lit(facet).alias("facet"), "value", "sessions")
        out = one if out is None else out.unionByName(one)
    return out


def job_rollup(jobs: DataFrame, key: list[str]) -> DataFrame:
    """Per key the status that counts most: running, failed, pending, then done."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "failed", 1).when(F.col("status") == "pending", 2).otherwise(3)
    names = F.array(*[F.lit(s) for s in ("running", "failed", "pending", "done")])
    return jobs.groupBy(*key).agg(
        F.element_at(names, F.min(rank) + 1).alias("status"),
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.max("at").alias("last"),
    )


SEVERITY = ["ok", "notice", "warning", "critical"]


def severity(age_ms: Column, complete_age_ms: Column, churned: Column, failures: Column) -> Column:
    """How bad a source looks: stale after 90 minutes, worse after 6 hours.

    A walk that only churned is healthy until a day without a complete one.
    """
    stale = F.when(age_ms >= 6 * 3_600_000, 2).when(age_ms >= 90 * 60_000, 1).otherwise(0)
    walk = F.when(churned & (complete_age_ms < 24 * 3_600_000), 0).when(complete_age_ms >= 24 * 3_600_000, 2).otherwise(0)
    jobs = F.when(failures >= 10, 3).when(failures > 0, 1).otherwise(0)
    return F.greatest(stale, walk, jobs)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), rank + 1)


def expected_cost(done: DataFrame, todo: DataFrame, kind: str, cost: str, at: list[str], recent: int = 30) -> DataFrame:
    """(kind, average, remaining, estimate): average of the newest runs times what is left."""
    last = latest_per(done, [kind], at, recent)
    average = last.groupBy(kind).agg(F.avg(cost).alias("average"))
    left = todo.groupBy(kind).agg(F.count(F.lit(1)).alias("remaining"))
    return average.join(left, kind).withColumn("estimate", F.col("average") * F.col("remaining"))


def detail_tags(shown: DataFrame, facet: str, prefix: str = "facet:") -> DataFrame:
    """(label, parent, n): tags that share an episode with the facet, rolled up to their parents, and below them the nested ones.

    ``shown`` has session_id, episode, tag, parent. Membership is by episode, counts are by session.
    """
    inside = shown.filter(F.col("tag") == prefix + facet).select("session_id", "episode").distinct()
    plain = shown.filter(~F.startswith("tag", F.lit(prefix)))
    members = plain.join(inside, ["session_id", "episode"], "left_semi").select("tag", "parent").distinct()
    visible = shown.select("session_id", "tag", "parent").distinct()
    labels = visible.select("session_id", F.explode(F.array_compact(F.array_distinct(F.array("tag", "parent")))).alias("label")).distinct()
    roots = members.select(F.coalesce("parent", "tag").alias("label")).distinct()
    top = labels.join(roots, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", F.lit(None).cast("string").alias("parent"), "n")
    nested = members.filter("parent IS NOT NULL")
    below = visible.select("session_id", "tag").distinct().join(nested, "tag").groupBy("parent", "tag").agg(F.count(F.lit(1)).alias("n"))
    return top.unionByName(below.select(F.col("tag").alias("label"), "parent", "n"))
