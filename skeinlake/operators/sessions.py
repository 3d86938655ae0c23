"""Sessions and messages, and what is counted per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions import text as fx

HARNESSES = ["claude", "codex", "prime", "kimi", "hermes", "kilo", "zcode"]
KINDS = {"user": "real_user", "assistant": "assistant_dialogue_prose", "system": "developer_system"}


def messages(conversations: DataFrame) -> DataFrame:
    """Conversation turns as messages: one row per turn with kind, side and tokens."""
    kind = F.lit("utility")
    for role, name in KINDS.items():
        kind = F.when(F.col("role") == role, name).otherwise(kind)
    names = F.array(*[F.lit(h) for h in HARNESSES])
    return conversations.select(
        F.col("conv_id").alias("session_id"),
        F.element_at(names, (F.col("conv_id") % len(HARNESSES) + 1).cast("int")).alias("harness"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("native_id"),
        F.col("turn").alias("ordinal"),
        F.col("role"),
        kind.alias("record_kind"),
        F.when(F.col("role").isin("user", "assistant"), F.col("role")).alias("side"),
        F.col("text"),
        fx.estimate_tokens(F.col("text")).alias("tokens"),
    )


def sessions(msgs: DataFrame) -> DataFrame:
    """One row per session: dialogue counts, token split, engagement, last activity."""

    def when(side: str, value: Column) -> Column:
        return F.sum(F.when(F.col("side") == side, value).otherwise(0)).cast("long")

    one = F.lit(1)
    return (
        msgs.groupBy("session_id", "harness", "native_id")
        .agg(
            F.count(one).alias("msg_count"),
            when("user", one).alias("user_turns"),
            when("assistant", one).alias("assistant_turns"),
            when("user", F.col("tokens")).alias("tok_user"),
            when("assistant", F.col("tokens")).alias("tok_assistant"),
            F.sum("tokens").alias("tok_total"),
            F.max("ordinal").alias("last_activity"),
        )
        .withColumn("engagement", fx.engagement_ratio(F.col("user_turns"), F.col("assistant_turns")))
    )


def session_titles(msgs: DataFrame) -> DataFrame:
    """(session_id, title): the first real user message that isn't blank, as a display title."""
    usable = msgs.filter((F.col("record_kind") == "real_user") & (F.trim("text") != ""))
    return usable.groupBy("session_id").agg(fx.display_title(F.min_by("text", "ordinal")).alias("title"))


def elect_title(candidates: DataFrame, key: list[str]) -> DataFrame:
    """The winning title of each key: an override, then explicit before fallback, then order.

    ``candidates`` has (key..., title, source, position) with source one of
    override, explicit, fallback.
    """
    priority = F.when(F.col("source") == "override", 0).when(F.col("source") == "explicit", 1).otherwise(2)
    usable = candidates.filter(F.trim("title") != "")
    return usable.groupBy(*key).agg(F.min_by(F.struct("title", "source"), F.struct(priority, "position")).alias("w")).select(
        *key, fx.display_title(F.col("w.title")).alias("title"), F.col("w.source").alias("source")
    )


def percentile(frame: DataFrame, value: str, name: str = "percentile") -> DataFrame:
    """Share of the other rows with a smaller ``value``: rank of the first tie over n - 1.

    Counted per distinct value, and summed up in ranges of about as many rows each; what
    comes before a range is one row of a small table. Nulls come first.
    """
    ranges = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / ranges for i in range(1, ranges)] or [0.5]
    found = frame.agg(F.percentile_approx(value, cuts, 20 * ranges).alias("q")).first().q
    bounds = sorted(set(found or []))
    index = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(value))), F.lit(0)) if bounds else F.lit(0)
    per_value = frame.groupBy(value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__range", index)
    sizes = per_value.groupBy("__range").agg(F.sum("__n").alias("__size"))
    first = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__size").over(first), F.lit(0)).alias("__first"), F.sum("__size").over(Window.partitionBy()).alias("__all"))
    before = Window.partitionBy("__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per_value.join(F.broadcast(offsets), "__range").withColumn("__below", F.col("__first") + F.coalesce(F.sum("__n").over(before), F.lit(0)))
    ratio = F.when(F.col("__all") > 1, F.col("__below") / (F.col("__all") - 1)).otherwise(F.lit(0.0))
    return frame.join(ranked.select(F.col(value).alias("__v"), ratio.alias(name)), F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def token_histogram(sess: DataFrame) -> DataFrame:
    """How many sessions fall in each size class of tokens."""
    t = F.col("tok_total")
    label = F.when(t < 8000, "lt8k").when(t < 32000, "8k-32k").when(t < 96000, "32k-96k").otherwise("96k+")
    dim = sess.sparkSession.createDataFrame([(k,) for k in ("lt8k", "8k-32k", "32k-96k", "96k+")], "bucket string")
    counts = sess.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def context_window(msgs: DataFrame, hits: DataFrame, around: int) -> DataFrame:
    """Messages within ``around`` places of a hit, places counted inside the session.

    ``hits`` has (session_id, ordinal); each row of the result names its hit.
    """
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ordinal"))
    placed = msgs.withColumn("__place", place)
    centre = placed.join(hits.select("session_id", F.col("ordinal")), ["session_id", "ordinal"], "left_semi").select(
        "session_id", F.col("ordinal").alias("hit"), F.col("__place").alias("__centre")
    )
    near = placed.join(centre, "session_id").filter(F.abs(F.col("__place") - F.col("__centre")) <= around)
    return near.drop("__place", "__centre")


def running_budget(msgs: DataFrame, budget: int) -> DataFrame:
    """Messages of each session in order until ``budget`` characters are used; the last one is cut."""
    before = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    kept = msgs.withColumn("__used", used).filter(F.col("__used") < budget)
    return kept.withColumn("text", F.substring(F.col("text"), F.lit(1), (F.lit(budget) - F.col("__used")).cast("int"))).drop("__used")


def fold_spans(msgs: DataFrame, empty: Column) -> DataFrame:
    """Runs of consecutive empty messages folded to one row '[first-last] roles xN'."""
    w = Window.partitionBy("session_id").orderBy("ordinal")
    flagged = msgs.withColumn("__e", empty)
    changed = F.when(F.lag("__e").over(w).eqNullSafe(F.col("__e")) & F.col("__e"), 0).otherwise(1)
    grouped = flagged.withColumn("__g", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.when(
        F.first("__e"),
        F.concat(
            F.lit("["), F.min("ordinal").cast("string"), F.lit("-"), F.max("ordinal").cast("string"), F.lit("] "),
            F.array_join(F.array_sort(F.collect_set("role")), ","), F.lit(" x"), F.count(F.lit(1)).cast("string"),
        ),
    ).otherwise(F.first("text"))
    return grouped.groupBy("session_id", "__g").agg(
        F.min("ordinal").alias("start"), F.max("ordinal").alias("end"), F.first("__e").alias("folded"), body.alias("body")
    ).drop("__g")


def last_replies(msgs: DataFrame) -> DataFrame:
    """For each user message the last assistant message before the next user message."""
    w = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.sum(F.when(F.col("side") == "user", 1).otherwise(0)).over(w)
    grouped = msgs.filter(F.col("side").isNotNull()).withColumn("user_turn", turn).filter("user_turn > 0")
    reply = F.col("side") == "assistant"
    return grouped.groupBy("session_id", "user_turn").agg(
        F.min("ordinal").alias("ordinal"),
        F.max(F.when(reply, F.col("ordinal"))).alias("reply_ordinal"),
        F.max_by(F.when(reply, F.col("text")), F.when(reply, F.col("ordinal"))).alias("reply"),
    )
