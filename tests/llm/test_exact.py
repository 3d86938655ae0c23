"""Exact duplicates against brute force, and on odd input."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skeinlake.llm import exact, queries
from tests.oracle import assert_same, connect

DOCS = "doc_id bigint, text string, source string"


def brute(data):
    """The multiset of (doc_id, keep_id, group_size, kept, sha256): one row of each group stays."""
    by = defaultdict(list)
    for r in data:
        by[r[1] or ""].append(r[0])
    want = []
    for text, ids in by.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        left = [keep]
        for i in ids:
            kept = i == keep and bool(left)
            if kept:
                left.pop()
            want.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(want, key=repr)


def odd_rows():
    long = "word " * 200_000
    data = [(1, "same", "a"), (2, "same", "b"), (2, "same", "c"), (None, "same", "a"), (3, "same ", "a"), (4, "Same", "a"), (5, "sáme", "a"), (6, "sáme", "a")]
    data += [(7, None, "a"), (8, "", None), (None, None, None), (9, " ", "a"), (10, long, "a"), (11, long + "x", "a"), (12, long, "b"), (-1, "only one, id below zero", "a")]
    # equal in length and beginning, not in the whole; and many rows of one text
    data += [(20 + i, "b" * exact.HEAD + f"{i % 7:03d}", "a") for i in range(30)]
    data += [(100 + i, "hot text", "h") for i in range(3000)] + [(None, "nobody's", "a"), (None, "nobody's", "a")]
    return data


@pytest.mark.parametrize("share", [1000, 3, 1])
def test_groups_like_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(exact, "HOT_SHARE", share)
    data = odd_rows()
    frame = spark.createDataFrame(data, DOCS).repartition(5).withColumns({c: F.lit("clash") for c in ("row", "digest", "kept", "length", "head", "met", "id")})
    got = sorted((tuple(r) for r in exact.digests(frame).collect()), key=repr)
    assert got == brute(data)


def test_deduplicate_keeps_whole_rows(spark):
    data = odd_rows()
    frame = spark.createDataFrame(data, DOCS).withColumn("row", F.lit(7)).withColumn("id", F.lit("x"))
    kept = exact.deduplicate(frame)
    assert kept.columns == frame.columns
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)
    assert got == sorted(((keep, t) for keep, t in {(r[1], t) for r, t in ((b, t) for b, t in zip(brute_keyed(data), texts(data)))}), key=repr)
    assert exact.deduplicate(frame.limit(0)).count() == 0


def texts(data):
    return [r[1] or "" for r in data]


def brute_keyed(data):
    best = {}
    for r in data:
        t = r[1] or ""
        if t not in best or (r[0] is not None, r[0] or 0) > (best[t] is not None, best[t] or 0):
            best[t] = r[0]
    return [(r[0], best[r[1] or ""]) for r in data]


def test_only_shared_beginnings_are_read_whole(spark):
    data = [(i, f"{'x' * i} ends") for i in range(50)] + [(60, "x" * 10 + " ends")]
    frame = spark.createDataFrame(data, "doc_id bigint, text string")
    read = {r.id: r.digest is not None for r in exact.groups(frame).collect()}
    assert read[10] and read[60] and sum(read.values()) < 6


def test_bit_map_holds_all_its_keys(spark):
    keys = spark.range(5000).select((F.col("id") * 7919).alias("k"))
    made = exact.bit_map(keys, 5000, "k")
    assert exact.marked(keys, "there", [F.col("k")], made).filter("NOT there").count() == 0
    others = spark.range(5000).select((F.col("id") * 7919 + 3).alias("k"))
    assert exact.marked(others, "there", [F.col("k")], made).filter("there").count() < 700


def test_empty_table(spark):
    assert exact.digests(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_like_its_statement(spark, sf):
    name = "op12_exact_dedup"
    assert_same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])
