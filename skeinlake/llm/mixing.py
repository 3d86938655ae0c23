"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the output. Its repetition rate is the share
of the output it should fill divided by what it holds. A document of that
source is written k times, k drawn from the Poisson distribution of that rate by
inverting its cumulative distribution at a number hashed from the seed and the
document's id: the draw is the same on every run and needs no coordination.
The copies then get random positions in one global order.

Edge cases: a null source is a source of its own; a null text has no bytes (a
source without any bytes keeps each of its documents once); rows that share a
doc_id draw the same k, and stand side by side ordered by a hash of their text; rows without an id draw by their text; texts of
any length are single values; an empty table gives an empty result; columns named
like those added here are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A Poisson draw of a larger rate is the sum of draws of equal parts below this.
RATE_PART = 200.0
#: Sources up to which their table is broadcast.
MAX_BROADCAST_SOURCES = 20_000
#: Bytes of text that one range of the global order should hold, and the fewest ranges.
RANGE_BYTES = 32 << 20
MIN_RANGES = 1024


def source_rates(
    docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5
) -> DataFrame:
    """One row per source: source, n_docs, n_bytes, share, rate.

    Without ``weights`` the target share of a source is its bytes to the power
    ``temperature``, normalised. The output has as many bytes as the input.
    """
    sizes = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("n_bytes"),
    )
    if weights is None:
        wanted = sizes.withColumn("w", F.pow(F.col("n_bytes").cast("double"), F.lit(temperature)))
    else:
        rows = [(k, float(v)) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(rows, "__s string, w double")
        wanted = sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("__s")), "left")
        wanted = wanted.drop("__s").withColumn("w", F.coalesce("w", F.lit(0.0)))
    sums = wanted.agg(F.sum("w").alias("sum_w"), F.sum("n_bytes").alias("all_bytes"))
    share = F.when(F.col("sum_w") > 0, F.col("w") / F.col("sum_w")).otherwise(F.lit(0.0))
    return wanted.join(F.broadcast(sums)).select(
        "source",
        "n_docs",
        "n_bytes",
        share.alias("share"),
        F.when(F.col("n_bytes") > 0, share * F.col("all_bytes") / F.col("n_bytes"))
        .otherwise(F.lit(1.0))
        .alias("rate"),
    )


def _name() -> Column:
    """What a document's draws and places come from: its id, or its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), F.md5(F.coalesce("text", F.lit("")))))


def _cumulative(rate: Column) -> Column:
    """P(K <= k) for k = 0, 1, ... until doubles can't tell it from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.exp(-rate)
    start = F.struct(zero.alias("p"), F.array(zero).alias("upto"))

    def add(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k.cast("double")
        total = F.element_at(s["upto"], -1) + p
        return F.struct(p.alias("p"), F.concat(s["upto"], F.array(total)).alias("upto"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add)["upto"]


def replicate(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    temperature: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """Every document as often as its draw says: adds copy (1, 2 ...) and rate."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE_PART)).cast("int")
    rates = (
        source_rates(docs, weights, temperature)
        .select(F.col("source").alias("__s"), F.col("rate").alias("__rate"), parts.alias("__parts"))
        .withColumn("__upto", _cumulative(F.col("__rate") / F.col("__parts")))
    )
    rates, _ = common.small_side(rates, MAX_BROADCAST_SOURCES, "rates")

    def draw(total: Column, part: Column) -> Column:
        at = common.hex52(str(seed), _name(), part.cast("string"))
        unit = at.cast("double") / float(1 << 52)
        return total + F.size(F.filter(F.col("__upto"), lambda c: c <= unit))

    count = F.aggregate(F.sequence(F.lit(0), F.col("__parts") - 1), F.lit(0), draw)
    return (
        docs.drop("copy", "rate")
        .join(rates, F.col("source").eqNullSafe(F.col("__s")))
        .withColumn("__k", count)
        .filter("__k > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__k"))))
        .withColumn("rate", F.col("__rate"))
        .drop("__s", "__rate", "__parts", "__upto", "__k")
    )


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    temperature: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """``replicate`` and a global shuffle: adds ``position``, 0, 1, 2 ... in shuffled order.

    The hashed key of a copy says where it stands; rows of one range of the key
    go to one task, so all columns are shuffled once.
    """
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0
    ranges = max(MIN_RANGES, math.ceil(total / RANGE_BYTES))
    key = common.hex52(
        f"{seed}-order", _name(), F.col("copy").cast("string")
    )
    keyed = (
        replicate(docs, weights, temperature, seed)
        .withColumn("__key", key)
        .withColumn("__range", F.floor(F.col("__key") * (ranges / float(1 << 52))).cast("int"))
        .withColumn("__all", F.lit(0))
    )
    order = [F.col("__key"), F.col("doc_id").asc_nulls_first(), F.col("copy"), F.xxhash64("text")]
    return common.gapless_rank(keyed, "position", ["__all"], "__range", order).drop("__key", "__all")
