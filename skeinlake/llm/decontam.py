"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item is contained in a document if at least a share ``threshold``
of the item's distinct word shingles occur in it. Items are partitioned by size into powers of two,
and the partition fixes the length of an item's sketch, its smallest hashes (bottom-k
MinHash). The share of the sketch found in a document estimates the item's containment.
An item of n shingles that is contained misses at most ``n - ceil(threshold * n)`` of
them, so a document that misses more of the sketch than that is no candidate, and no
document that holds the item is lost: the estimate only errs to one side. Documents are not
sketched, so those of any length can be searched without their size drowning the signal.
Candidates are verified by counting exact shared shingles (strings, not hashes).

Words are runs of letters, marks and digits, lower-cased. Items with fewer than
five words are one shingle, the whole sequence.

Edge cases: null and empty texts have no shingles and never match; rows with a
null doc_id take no part in the search and are kept by ``decontaminate``; rows
that share a doc_id are searched together as one document; repeated items are
reported once per item_id; equal hashes of a sketch count once; a text of any length is searched in
one task; empty tables give an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

WORDS = 5
THRESHOLD = 0.8
#: Rows of an item table (sketches, shingles or found pairs) up to which it is broadcast.
MAX_BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.filter(F.split(F.coalesce(spaced, F.lit("")), " "), lambda w: w != "")


def _windows(n_words: Column, length: Column | int) -> Column:
    """Starts of the shingles of that length, none if there are fewer words."""
    count = n_words - length + 1
    return F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def shingle_text(length: int) -> Column:
    """Shingles of column __w as strings."""
    return F.transform(
        _windows(F.size("__w"), length), lambda i: F.concat_ws(" ", F.slice("__w", i, length))
    )


def shingle_hash(length: int) -> Column:
    return F.transform(
        _windows(F.size("__w"), length),
        lambda i: F.xxhash64(F.lit(length), *[F.element_at("__w", i + k) for k in range(length)]),
    )


def item_shingles(items: DataFrame, words_per_shingle: int = WORDS) -> DataFrame:
    """Distinct (item_id, length, shingle, hash, n_shingles) of the benchmark."""
    split = items.select("item_id", words(F.col("text")).alias("__w")).filter(
        F.col("item_id").isNotNull() & (F.size("__w") > 0)
    )
    length = F.least(F.size("__w"), F.lit(words_per_shingle))
    made = F.transform(
        _windows(F.size("__w"), length),
        lambda i: F.struct(
            F.concat_ws(" ", F.slice("__w", i, length)).alias("shingle"),
            F.slice("__w", i, length).alias("parts"),
        ),
    )
    rows = split.select("item_id", length.alias("length"), F.explode(made).alias("s"))

    def hashed(n: int) -> Column:
        return F.xxhash64(F.lit(n), *[F.element_at("s.parts", k + 1) for k in range(n)])

    by_length = F.lit(None).cast("long")
    for n in range(1, words_per_shingle + 1):
        by_length = F.when(F.col("length") == n, hashed(n)).otherwise(by_length)
    distinct = rows.select(
        "item_id", "length", F.col("s.shingle").alias("shingle"), by_length.alias("hash")
    ).distinct()
    per_item = distinct.groupBy("item_id", "length").agg(F.count(F.lit(1)).alias("n_shingles"))
    # rows of one item_id may differ in length; the longest shingle length counts
    best = per_item.groupBy("item_id").agg(F.max("length").alias("length"))
    per_item = per_item.join(best, ["item_id", "length"])
    return distinct.join(per_item, ["item_id", "length"])


def needed(n_shingles: Column, threshold: float) -> Column:
    """How many shingles must be shared."""
    return F.ceil(n_shingles * F.lit(threshold) - 1e-9).cast("long")


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, length, hash, size_class, least): what documents are searched for.

    Size classes are powers of two; all items of a class get sketches of one length, twice what
    its largest items may miss. ``least`` hashes of the sketch are in every document with the item.
    """
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n_shingles"))).cast("long")
    length = F.least(F.col("n_shingles"), 2 * (upper - needed(upper, threshold)) + 1)
    order = Window.partitionBy("item_id").orderBy("hash")
    kept = shingles.withColumn("__at", F.row_number().over(order)).filter(F.col("__at") <= length)
    missing = F.col("n_shingles") - needed(F.col("n_shingles"), threshold)
    kept = kept.select("item_id", "length", "hash", "n_shingles").distinct()
    sizes = kept.groupBy("item_id").agg(F.count(F.lit(1)).alias("__hashes"))
    least = F.greatest(F.lit(1), F.col("__hashes") - missing)
    return kept.join(sizes, "item_id").select("item_id", "length", "hash", upper.alias("size_class"), least.alias("least"))


def search(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words_per_shingle: int = WORDS
) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_shared, containment) at or above the threshold."""
    shingles = common.materialise(item_shingles(items, words_per_shingle), "item-shingles")
    sketch, _ = common.small_side(sketches(shingles, threshold), MAX_BROADCAST_ROWS, "item-sketches")
    rows = shingles.count()
    lengths = sorted(r.length for r in shingles.select("length").distinct().collect())
    sides = F.broadcast(shingles) if rows <= MAX_BROADCAST_ROWS else shingles

    split = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", words(F.col("text")).alias("__w"))

    def exploded(frame: DataFrame, made) -> DataFrame:
        arrays = [made(n) for n in lengths] or [made(words_per_shingle)]
        return frame.select("doc_id", F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("__s"))

    hits = exploded(split, shingle_hash)
    met = hits.join(sketch, F.col("__s") == F.col("hash")).select("doc_id", "item_id", "hash", "least").distinct()
    found = met.groupBy("doc_id", "item_id", "least").agg(F.count(F.lit(1)).alias("__found"))
    found = found.filter(F.col("__found") >= F.col("least")).select("doc_id").distinct()
    candidates, _ = common.small_side(found, MAX_BROADCAST_ROWS, "candidates")
    again = exploded(
        split.join(candidates, "doc_id", "left_semi"), lambda n: F.array_distinct(shingle_text(n))
    )
    shared = again.join(sides, F.col("__s") == F.col("shingle")).select(
        "doc_id", "item_id", "n_shingles", "shingle"
    )
    return (
        shared.groupBy("doc_id", "item_id", "n_shingles")
        .agg(F.countDistinct("shingle").alias("n_shared"))
        .filter(F.col("n_shared") >= needed(F.col("n_shingles"), threshold))
        .select(
            "doc_id",
            "item_id",
            "n_shingles",
            "n_shared",
            (F.col("n_shared") / F.col("n_shingles")).alias("containment"),
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no test item."""
    dirty = search(docs, items, threshold).select(F.col("doc_id").alias("__dirty")).distinct()
    dirty, _ = common.small_side(dirty, MAX_BROADCAST_ROWS, "dirty")
    return docs.join(dirty, F.col("doc_id") == F.col("__dirty"), "left_anti")
