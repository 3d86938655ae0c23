"""Hard negatives against brute force, and on odd input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlake.llm import common, negatives, queries
from tests.oracle import assert_same, connect

SCHEMA = "vec_id bigint, embedding array<double>, label int"
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


def brute(data):
    rows = [(v, [math.floor(256 * x) for x in e], c) for v, e, c in data if v is not None and c is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    anchors = {}
    for v, e, c in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if v % 50 == 0:
            anchors.setdefault(v, (e, c))
    out = []
    for a, (u, c) in anchors.items():
        scored = [(-min(max(sum(p * q for p, q in zip(u, e)), LONG_MIN), LONG_MAX), v, k) for v, e, k in rows if v != a and len(e) == len(u)]
        best = sorted(r[:2] for r in scored if r[2] == c)[:5]
        for ps, p in best:
            fits = sorted(r[:2] for r in scored if r[2] != c and 50 * -ps <= 100 * -r[0] <= 95 * -ps)[:3]
            out += [(a, p, i + 1, v, -ps, -s) for i, (s, v) in enumerate(fits)]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def random_rows(seed, n, d=6, labels=4):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=d)], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("first", "chunk", "members"), [(65_536, 16 << 20, 128), (40, 16 << 20, 3), (40, 200, 2)])
def test_negatives_like_brute_force(spark, monkeypatch, first, chunk, members):
    monkeypatch.setattr(negatives, "FIRST_SLICE", first)
    monkeypatch.setattr(negatives, "GROWTH", 4)
    monkeypatch.setattr(negatives, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(negatives, "MEMBERS", members)
    data = random_rows(first, 420)
    data += [(i, data[3][1], 1) for i in range(420, 560)]  # one vector very often, with ties on both sides
    want = brute(data)
    assert got(negatives.mine(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 50 == 0)) == want and len(want) > 50


def odd_rows():
    data = random_rows(1, 200, 3, 3)
    data += [(200, None, 1), (250, [1.0, None, 2.0], 1), (300, [1.0, float("nan"), 2.0], 1), (350, [1.0, float("inf"), 2.0], 1), (None, [1.0, 1.0, 1.0], 1), (400, [1.0, 1.0, 1.0], None)]
    data += [(450, [0.0, 0.0, 0.0], 0), (500, [1.0, 2.0], 0), (501, [1.5, 2.0], 0), (502, [1.0, 1.0], 1), (550, [], 0), (551, [], 0), (552, [], 1), (600, [2.0] * 9, 2)]
    data += [(50, [3.0, 1.0, 2.0], 0), (50, [3.0, 1.0, 2.0], 0), (7, [1.0, 1.0, 2.0], 2), (-50, [1.0, 2.0, 1.0], 0), (650, [-0.001] * 3, 1)]
    return data


def test_odd_input(spark):
    data = odd_rows()
    frame = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("clash") for c in ("v", "d", "rank", "score", "level", "cluster", "part", "window")})
    want = brute(data)
    assert got(negatives.mine(frame, F.col("vec_id") % 50 == 0)) == want
    assert {550, 450} <= {r[0] for r in want}  # scores of 0 fit a window of 0 to 0
    assert negatives.mine(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine(frame.filter("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) * 1e7 for x in rng.normal(size=4)], int(i % 3)) for i in range(120)] + [(200, [1e15] * 4, 0), (201, [1e15] * 4, 0), (202, [1e15] * 4, 1)]
    assert got(negatives.mine(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 50 == 0)) == brute(data)


def walked(vectors, labels):
    u = vectors[:40]
    picked = negatives.centres(u, 8)
    near = (u @ picked.T).argmax(axis=1)
    ids = np.arange(len(vectors))
    some = [negatives.Cluster(ids[:40][near == c], labels[:40][near == c], u[near == c], picked[c], np.full((near == c).sum(), -np.inf)) for c in np.unique(near)]
    walk = negatives.Walk(some)
    walk.over(ids, labels, vectors)
    for c, best in zip(walk.clusters, walk.best):
        for a, found in zip(c.ids, best):
            scores = vectors @ vectors[a]
            want = sorted((-int(scores[i]), int(i)) for i in ids if labels[i] == labels[a] and i != a)[:5]
            assert found == want
    return walk.evaluated / (40 * len(vectors))


def test_walks_end_early_where_vectors_cluster(monkeypatch):
    """Rows around a few directions: most are never reached; without structure nearly all are."""
    monkeypatch.setattr(negatives, "STEP", 32)
    rng = np.random.default_rng(3)
    directions = rng.normal(size=(8, 16)) * 1000
    labels = rng.integers(0, 3, 4000)
    near = np.floor(directions[np.arange(4000) % 8] + rng.normal(size=(4000, 16)) * 60)
    assert walked(near, labels) < 0.3
    assert walked(np.floor(rng.normal(size=(4000, 16)) * 1000), labels) > 0.5


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query_like_its_statement(spark, sf):
    name = "op11_hard_negatives"
    assert_same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])
