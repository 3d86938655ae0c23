"""Topics inside sessions: units, TF-IDF vectors, boundaries, episodes, shapes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions import text as fx
from skeinlake.operators.graph import checkpoint

WINDOW = 3
MIN_UNITS = 3
MAX_EPISODES = 40
THRESHOLD = 3
COMMON = 0.2
#: Units whose words one task counts.
UNITS_PER_TASK = 1000
#: Fixed value: phrases that announce another topic.
CUE = r"(?i)^(new topic|different (question|topic)|unrelated|switching|changing gears|ok next|next up|next:|now let'?s|also,? (can|could|what)|btw\b|random q)"


def units(msgs: DataFrame, longest: tuple[int, int] | None = None) -> DataFrame:
    """(session_id, unit, ordinal, human, context): a user turn and the prose that answers it.

    With ``longest`` a context takes so many characters of a user's text and of another at most, without it all of them.
    """
    w = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.sum(F.when(F.col("side") == "user", 1).otherwise(0)).over(w)
    told = msgs.filter(F.col("side").isNotNull()).withColumn("unit", turn).filter("unit > 0")
    grouped = told.groupBy("session_id", "unit").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text", "side"))).alias("p"))
    texts = F.col("p.text")
    if longest is not None:
        texts = F.transform("p", lambda x: F.substring(x["text"], 1, F.when(x["side"] == "user", longest[0]).otherwise(longest[1])))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("unit")) - 1
    first = F.col("p")[0]
    return grouped.select("session_id", place.alias("unit"), first["ordinal"].alias("ordinal"), first["text"].alias("human"), F.array_join(texts, "\n").alias("context"))


def tasks_of(unit: DataFrame) -> tuple[int, int]:
    """How many units there are, and to how many tasks their words are dealt, so that a task's words don't grow with the table.

    Deal behind a join, as Spark takes the other side's partitions for one before it.
    """
    n = unit.count()
    return n, max(int(unit.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // UNITS_PER_TASK))


def document_frequency(unit: DataFrame) -> DataFrame:
    """(word, df): units that hold the word."""
    words = unit.select(F.explode(F.array_distinct(fx.topic_words(F.col("context")))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequency(tf: DataFrame, df: DataFrame, n: int, tasks: int) -> DataFrame:
    """Rows of ``tf`` (with word) and ``idf``, ln((n + 1) / (df + 1)), without the words that more than a fifth of the units hold.

    Those are few, at most five times the words of a unit, and go first, so that no word's rows weigh down a task.
    """
    common = F.broadcast(df.filter(F.col("df") > n * COMMON).select("word"))
    rest = tf.join(common, "word", "left_anti").repartition(tasks, "word")
    idf = F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1))
    return rest.join(df.filter(F.col("df") <= n * COMMON), "word", "left").select(*tf.columns, idf.alias("idf"))


def _weight(tf: Column) -> Column:
    return (1 + F.log(tf)) * F.col("idf")


def tfidf(terms: DataFrame, df: DataFrame, n: int, tasks: int, keys: list[str]) -> DataFrame:
    """(keys..., word, weight) from rows (keys..., word): (1 + ln tf) ln((n + 1) / (df + 1)).

    Words that more than a fifth of the units hold are left out. Terms that are dealt by one of the keys stay where they are to be counted;
    ``df`` is read twice.
    """
    tf = terms.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("tf"))
    return inverse_frequency(tf, df, n, tasks).select(*keys, "word", _weight(F.col("tf")).alias("weight"))


def neighbour_similarity(unit: DataFrame) -> DataFrame:
    """(session_id, unit, similarity) of the units before and from each gap, WINDOW on each side.

    A gap needs two units on each side. Words are counted once for each unit, and only what is left of them is spread to the gaps around.
    """
    n, tasks = tasks_of(unit)
    sizes = unit.groupBy("session_id").agg(F.count(F.lit(1)).alias("units"))
    dealt = unit.select("session_id", "unit", "context").join(sizes, "session_id").repartition(tasks, "session_id")
    words = dealt.select("session_id", "unit", "units", F.explode(fx.topic_words(F.col("context"))).alias("word"))
    tf = checkpoint(words.groupBy("session_id", "unit", "units", "word").agg(F.count(F.lit(1)).alias("tf")))
    df = checkpoint(tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    # a session of fewer units than a gap needs has none
    told = inverse_frequency(tf.filter("units >= 4"), df, n, tasks).repartition(tasks, "session_id")
    around = F.explode(F.sequence(F.lit(1 - WINDOW), F.lit(WINDOW))).alias("d")
    spread = told.select("*", around).withColumn("gap", F.col("unit") + F.col("d")).filter((F.col("gap") >= 2) & (F.col("units") - F.col("gap") >= 2))
    side = lambda before: F.sum(F.when((F.col("d") > 0) == before, F.col("tf")))
    pairs = spread.groupBy("session_id", "gap", "word", "idf").agg(side(True).alias("a"), side(False).alias("b"))
    none = F.lit(0.0)
    pairs = pairs.select("session_id", "gap", F.coalesce(_weight(F.col("a")), none).alias("a"), F.coalesce(_weight(F.col("b")), none).alias("b"))
    sums = pairs.groupBy("session_id", "gap").agg(
        F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("na"), F.sum(F.col("b") * F.col("b")).alias("nb")
    )
    cosine = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / F.sqrt(F.col("na") * F.col("nb"))).otherwise(F.lit(0.0))
    gaps = unit.join(sizes, "session_id").filter((F.col("unit") >= 2) & (F.col("units") - F.col("unit") >= 2)).select("session_id", "unit")
    found = sums.select("session_id", F.col("gap").alias("unit"), cosine.alias("similarity"))
    return gaps.join(found, ["session_id", "unit"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def boundary_scores(unit: DataFrame, gap_ms: Column | None = None, compacted: Column | None = None) -> DataFrame:
    """(session_id, unit, score) of every gap: compaction, idle time, topic shift, cue."""
    gap_ms = F.lit(0) if gap_ms is None else gap_ms
    compacted = F.lit(False) if compacted is None else compacted
    sim = neighbour_similarity(unit)
    joined = unit.filter("unit >= 1").join(sim, ["session_id", "unit"], "left")
    score = (
        F.when(compacted, 3).otherwise(0)
        + F.when(gap_ms >= 2 * 3_600_000, 3).when(gap_ms >= 45 * 60_000, 2).otherwise(0)
        + F.when(F.col("similarity") < 0.06, 2).when(F.col("similarity") < 0.12, 1).otherwise(0)
        + F.when(F.trim("human").rlike(CUE), 1).otherwise(0)
    )
    return joined.select("session_id", "unit", score.alias("score"))


def episodes(unit: DataFrame, scores: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(session_id, episode, first_unit, last_unit): strongest cuts first, MIN_UNITS apart.

    Which cuts stand depends on those taken before, so each session is cut by a
    small function; a session's cuts fit in memory.
    """

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["units"].iloc[0])
        wanted = rows[rows["score"] >= threshold].sort_values(["score", "unit"], ascending=[False, True])
        taken = [0, n]
        for at in wanted["unit"]:
            if len(taken) > MAX_EPISODES:
                break
            if min(abs(at - t) for t in taken) >= MIN_UNITS:
                taken.append(int(at))
        taken.sort()
        return pd.DataFrame(
            [(rows["session_id"].iloc[0], i, a, b - 1) for i, (a, b) in enumerate(zip(taken, taken[1:], strict=False))],
            columns=["session_id", "episode", "first_unit", "last_unit"],
        )

    sizes = unit.groupBy("session_id").agg(F.count(F.lit(1)).alias("units"))
    rows = sizes.join(scores, "session_id", "left").withColumns({"unit": F.coalesce("unit", F.lit(0)), "score": F.coalesce("score", F.lit(0))})
    return rows.repartition(tasks_of(unit)[1], "session_id").groupBy("session_id").applyInPandas(cut, "session_id long, episode int, first_unit int, last_unit int")


def keywords(unit: DataFrame, episode: DataFrame, most: int = 4) -> DataFrame:
    """(session_id, episode, rank, word): best words of each episode; the user's count double more."""
    n, tasks = tasks_of(unit)
    inside = unit.join(episode, "session_id").filter((F.col("unit") >= F.col("first_unit")) & (F.col("unit") <= F.col("last_unit"))).repartition(tasks, "session_id")
    words = F.flatten(F.array(fx.topic_words(F.col("human")), fx.topic_words(F.col("human")), fx.topic_words(F.col("context"))))
    told = inside.select("session_id", "episode", F.explode(words).alias("word"))
    weights = tfidf(told, checkpoint(document_frequency(unit)), n, tasks, ["session_id", "episode"]).repartition(tasks, "session_id")
    place = F.row_number().over(Window.partitionBy("session_id", "episode").orderBy(F.col("weight").desc(), "word"))
    return weights.withColumn("rank", place).filter(F.col("rank") <= most).select("session_id", "episode", "rank", "word")


def shape(started_by: Column, human_turns: Column, tool_calls: Column, tokens: Column, compactions: Column, n_episodes: Column) -> Column:
    """worker, tiny, marathon, wanderer or conversation; the first that fits."""
    per_turn = tool_calls / F.greatest(F.lit(1), human_turns)
    return (
        F.when(started_by == "agent", "worker")
        .when(human_turns < 10, "tiny")
        .when((tool_calls >= 300) | (tokens >= 20_000_000) | (compactions >= 2), "marathon")
        .when((per_turn < 3) | (n_episodes >= 3), "wanderer")
        .otherwise("conversation")
    )


def surviving_labels(episodes: DataFrame, before: DataFrame) -> DataFrame:
    """``episodes`` (session_id, episode, start, end) with the labels that the same spans had in ``before`` (and label)."""
    return episodes.join(before.select("session_id", "start", "end", "label"), ["session_id", "start", "end"], "left")


def surviving_tags(tags: DataFrame, before: DataFrame, episodes: DataFrame) -> DataFrame:
    """Tags (session_id, episode, tag, source) after a new segmentation.

    Tags of a model follow their span: they get its new number, or go with it. Others, and
    those of the whole session (episode below 0), stay as they are.
    """
    follows = (F.col("source") == "model") & (F.col("episode") >= 0)
    span = before.select("session_id", "episode", "start", "end")
    now = episodes.select("session_id", "start", "end", F.col("episode").alias("number"))
    moved = tags.filter(follows).join(span, ["session_id", "episode"]).join(now, ["session_id", "start", "end"])
    moved = moved.select("session_id", F.col("number").alias("episode"), "tag", "source").distinct()
    return tags.filter(~follows).select("session_id", "episode", "tag", "source").unionByName(moved)
