"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

A first reading writes each text's length and the hash of its first code points. Lengths that occur once settle
their texts; of the rest, so do beginnings that occur once for their length. A second reading takes the SHA-256
of whole texts only where length and beginning are shared, and equal digests are equal texts. Texts are never
shuffled, nor joined: which lengths and beginnings are shared is told by a bit map of a fixed number of
bits, a few for each key, which is broadcast in rows of 4 KB. Keys that fall on one bit only cause a text to be hashed that was alone.

Groups are summed up before any shuffle, as one row for each task and digest. Digests of the largest groups (a thousandth of
all rows or more, so a thousand at most) are broadcast back to their rows; the others meet their rows in
a join by digest.

Edge cases: a null text counts as empty, so the two are equal; no other change is made (case, blanks and
compositions count). Of equal texts the row with the largest id stays, and a null id is smaller than all others; of
rows equal in both one stays and the others go. A text of any length is one value. An empty table gives an empty
result. Other columns are ignored by ``groups`` and kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points that the second step hashes.
HEAD = 64
#: Bits of a map for each key, and the least and most of a map: one of 4 KB, and 128 MB.
BITS_PER_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 30
#: Groups of this share of all rows are broadcast, so there are 1000 at most.
HOT_SHARE = 1000


def _place(bits: int, *key: Column) -> Column:
    """A number from 1 to ``bits`` for a key."""
    return F.pmod(F.xxhash64(*key), F.lit(bits)) + 1


def bit_map(keys: DataFrame, rows: int, *key: str) -> tuple[DataFrame, int]:
    """(bucket, map) with the bits of all keys set, and the number of bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * rows).bit_length()))
    at = keys.select(_place(bits, *[F.col(k) for k in key]).alias("__at"))
    made = at.groupBy(F.bitmap_bucket_number("__at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__at")).alias("__map"))
    return made, bits


def marked(df: DataFrame, name: str, key: list[Column], made: tuple[DataFrame, int]) -> DataFrame:
    """Add ``name``: whether the key's bit is set; true for all keys in the map, and for few others."""
    bits_of, bits = made
    at = _place(bits, *key)
    byte = F.substring("__map", F.floor(F.bitmap_bit_position(at) / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    found = F.getbit(value, F.pmod(F.bitmap_bit_position(at), F.lit(8)).cast("int")) == 1
    there = df.withColumn("__bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bits_of), "__bucket", "left")
    return there.withColumn(name, F.coalesce(found, F.lit(False))).drop("__bucket", "__map")


def _shared(heads: DataFrame) -> tuple[DataFrame, int]:
    """The bit map of (length, beginning) that several rows have, by way of the lengths that several rows have."""
    lengths = heads.groupBy("length").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lengths = common.materialise(lengths, "exact-lengths")
    by_length = bit_map(lengths, lengths.count(), "length")
    left = marked(heads, "__met", [F.col("length")], by_length).filter("__met")
    begun = left.groupBy("length", "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    begun = common.materialise(begun, "exact-heads")
    return bit_map(begun, begun.count(), "length", "head")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_digests: bool = False) -> DataFrame:
    """(row, id, keep_id, group_size, kept, digest) of every row, where ``row`` numbers the rows of this result.

    ``digest`` is the SHA-256 of texts whose beginning is shared; with ``all_digests`` of all texts.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), body.alias("body"))
    length, head = F.octet_length("body"), F.xxhash64(F.substring("body", 1, HEAD))
    heads = common.materialise(texts.select(length.alias("length"), head.alias("head")), "exact-rows")
    seen = marked(texts.withColumns({"length": length, "head": head}), "met", [F.col("length"), F.col("head")], _shared(heads))
    digest = F.sha2(F.encode("body", "UTF-8"), 256)
    read = seen.select(
        F.monotonically_increasing_id().alias("row"), "id", "met", (digest if all_digests else F.when(F.col("met"), digest)).alias("digest")
    )
    return _settled(common.materialise(read, "exact-digests"))


def _settled(read: DataFrame) -> DataFrame:
    """Rows with their group; ``read`` holds (row, id, met, digest)."""
    columns = ["row", "id", "keep_id", "group_size", "kept", "digest"]
    best = F.max(F.struct(F.col("id").isNotNull(), "id", "row"))
    made = read.filter("met").groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    made = made.select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size").filter("group_size > 1")
    made = common.materialise(made, "exact-groups")
    hot = read.count() // HOT_SHARE
    large = F.broadcast(made.filter(F.col("group_size") > hot)).withColumn("__large", F.lit(True))
    first = read.filter("met").join(large, "digest", "left")
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True))
    one = F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")
    # a text that is alone keeps its own id, which may be null as a group's may
    keep = F.when(F.col("keep_row").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id")
    alone = read.filter("NOT met").select("row", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    held = first.filter("__large").select("row", "id", "keep_id", "group_size", kept.alias("kept"), "digest")
    rest = first.filter("__large IS NULL").select("row", "id", "digest").join(made.filter(F.col("group_size") <= hot), "digest", "left")
    rest = rest.select("row", "id", keep, one, kept.alias("kept"), "digest")
    return alone.unionByName(held).unionByName(rest).select(*columns)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, all columns kept.

    The rows are written once with numbers of their own, so that two readings name the same rows.
    """
    mine = "__row"
    numbered = common.materialise(docs.withColumn(mine, F.monotonically_increasing_id()), "exact-numbered")
    # ids carry the row's number along: the largest id wins, and the number tells equal ones apart
    carried = numbered.select(F.struct(F.col(id_col).alias("of"), F.col(mine).alias("at")).alias("__id"), F.col(text_col).alias("__text"))
    gone = groups(carried, "__id", "__text").filter("NOT kept").select(F.col("id.at").alias(mine))
    side, _ = common.small_side(gone, 500_000, "exact-gone")
    return numbered.join(side, mine, "left_anti").drop(mine)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    found = groups(docs, all_digests=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
