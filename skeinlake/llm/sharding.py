"""Sharding by jump consistent hashing.

Jump consistent hashing (Lamping and Veach, 2014) maps a 64-bit key to one of
``n`` shards without a ring table: a linear congruential generator seeded with
the key draws the shard counts at which the key would move; the last one below
``n`` is its shard. Going from ``n`` to ``n + 1`` shards moves a key only into
the new shard.

Edge cases: a null key counts as key 0; a null text has size 1 and the CRC-32
of no bytes; rows with equal keys share a shard and get slots of their own, by a
hash of their text; rows equal in key and text are interchangeable; texts of any
length are single values; an empty table gives an empty result; other columns stay
as they are, except that the columns added here replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: the generator's multiplier in the published algorithm.
MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF
LOW16 = 0xFFFF
#: Steps of the first fold; a key needs about ln(n), so more are hardly ever left.
FIRST_STEPS = 64
#: Ranges of a shard in which slots are counted apart: the fewest, and the bytes of text that one should hold.
MIN_RANGES = 128
RANGE_BYTES = 32 << 20


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64 on unsigned 32-bit halves.

    Longs would overflow, which ANSI mode forbids; products of 16 and 32 bits
    never do.
    """
    m_hi, m_lo = F.lit(MULTIPLIER >> 32), F.lit(MULTIPLIER & LOW32)
    lo1, lo0 = F.shiftright(lo, 16), lo.bitwiseAND(LOW16)
    hi1, hi0 = F.shiftright(hi, 16), hi.bitwiseAND(LOW16)

    def low_product(upper: Column, lower: Column, by: Column) -> Column:
        return lower * by + F.shiftleft((upper * by).bitwiseAND(LOW16), 16)

    part0, part1 = lo0 * m_lo, lo1 * m_lo
    low = part0.bitwiseAND(LOW32) + F.shiftleft(part1.bitwiseAND(LOW16), 16) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(part0, 32) + F.shiftright(part1, 16)
    high = carry + low_product(hi1, hi0, m_lo) + low_product(lo1, lo0, m_hi)
    return high.bitwiseAND(LOW32), low.bitwiseAND(LOW32)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a long key (its bits read as unsigned)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next_state(s["hi"], s["lo"])
        jump = (s["next"] + 1).cast("double") * (
            F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")
        )
        moved = F.struct(
            s["next"].alias("at"),
            F.floor(jump).cast("long").alias("next"),
            hi.alias("hi"),
            lo.alias("lo"),
        )
        return F.when(s["next"] < shards, moved).otherwise(s)

    def fold(start: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    start = F.struct(
        F.lit(-1).cast("long").alias("at"),
        F.lit(0).cast("long").alias("next"),
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(LOW32).alias("lo"),
    )
    end = fold(start, min(shards, FIRST_STEPS))
    if shards > FIRST_STEPS:
        end = F.when(end["next"] < shards, fold(end, shards)).otherwise(end)
    return end["at"].cast("int")


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard to every row.

    ``slot`` counts 0, 1, 2 ... inside each shard in the order of a hash of key and text, so
    that ranges of it hold about as much each, whatever the keys; their number follows the bytes.
    """
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))).first()[0] or 0
    ranges = max(MIN_RANGES, -(-total // (shards * RANGE_BYTES)))
    body = F.coalesce(F.col(text), F.lit(""))
    place = common.hex52("slot", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(body))
    placed = (
        docs.withColumns(
            {
                "size": F.octet_length(body).cast("long") + 1,
                "text_crc32": F.crc32(F.encode(body, "UTF-8")),
                "law": F.lit("key"),
                "shard": jump_hash(F.col(key), shards),
                "grown_shard": jump_hash(F.col(key), shards + 1),
                "__place": place,
            }
        )
    ).withColumn("__range", F.floor(F.col("__place") * (ranges / float(1 << 52))).cast("int"))
    order = [F.col("__place"), F.col(key).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    return common.gapless_rank(placed, "slot", ["shard"], "__range", order).drop("__place")
