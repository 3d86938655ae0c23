"""Exact top-k inner-product search by pivot-table elimination.

Inner products become distances by one more coordinate: with M at least every
norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) lie so that
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x. The pivot table holds the distances of every vector to a
set of pivots, computed once and written to the shared folder; by the triangle inequality
max |d(q', p) - d(x', p)| over the pivots p bounds d(q', x') from below, and so bounds the inner
product from above. The candidates of a query are evaluated in the order of their bounds
until the next bound is below the k-th best product found, which is exact.

Vectors are dealt to blocks by their nearest pivot (and a hash, where that is too many). A first
pass searches a few blocks for each query, those whose best bound is highest, and so finds a k-th best
product of its own. A second pass takes a query to the other blocks only where the block's bound, from the
ranges of its distances, reaches that product; where no bound excludes a block, every query
meets it, as on vectors without structure. Queries and rows of a block meet in a cogroup; the best k
of each are merged per query. Pivots are fitted on a bounded sample; every row is searched.

Edge cases: vectors that are null or hold null or non-finite components take no
part; only vectors of equal length are compared; ties go to the smaller id; a
query finds rows with its own values, but not its own id; rows with a null id
take no part; rows that repeat an id are candidates one by one, and the last rank
goes to either; an empty table gives an empty result; products beyond a long
saturate; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

K = 5
SCALE = 256
PIVOTS = 32
PIVOT_SAMPLE = 1000
#: Queries and rows that one block should hold.
QUERIES_PER_BLOCK = 1024
ROWS_PER_BLOCK = 8192
#: Blocks of the first pass for each query.
FIRST_BLOCKS = 2
#: Candidates evaluated between two looks at the bounds.
STEP = 512
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): components times SCALE, rounded down, of the vectors that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")
    )


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, table.column("d")[0].as_py())


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Members of the sample far from each other: farthest first."""
    if not len(sample):
        return sample
    picked = [int(np.argmax((sample * sample).sum(axis=1)))]
    away = ((sample - sample[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < min(count, len(sample)) and away.max() > 0:
        picked.append(int(np.argmax(away)))
        away = np.minimum(away, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def distances(rows: np.ndarray, radius: float, pivots: np.ndarray, lifted: bool) -> np.ndarray:
    """Distances to the lifted pivots, of lifted rows or of queries (whose last coordinate is 0)."""
    norms, p_norm = (rows * rows).sum(axis=1), (pivots * pivots).sum(axis=1)
    lift = np.sqrt(np.maximum(radius - norms, 0)) if lifted else np.zeros(len(rows))
    p_lift = np.sqrt(np.maximum(radius - p_norm, 0))
    return np.sqrt(np.maximum(norms[:, None] + p_norm - 2 * rows @ pivots.T + (lift[:, None] - p_lift) ** 2, 0))


def search_block(
    q_ids: np.ndarray, q: np.ndarray, d_q: np.ndarray, least: np.ndarray, x_ids: np.ndarray, x: np.ndarray, d_x: np.ndarray, radius: float, k: int
) -> tuple[list[tuple[int, int, int]], int]:
    """(query, id, score) of the best k of one block of candidates for each query, and the products evaluated.

    ``least`` is a product that each query has k times already, or less; candidates below it don't count.
    """
    order = np.argsort(x_ids, kind="stable")
    x_ids, x, d_x = x_ids[order], x[order], d_x[order]
    top_norm = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, q.shape[1])
    exact = top_norm < EXACT
    q_norm = (q * q).sum(axis=1)
    # slack for rounding in the bounds
    slack = 1e-9 * (radius + q_norm.max(initial=0)) + 1.0
    found, evaluated = [], 0
    for i in range(len(q)):
        bound = np.zeros(len(x))
        for p in range(d_x.shape[1]):
            np.maximum(bound, np.abs(d_x[:, p] - d_q[i, p]), out=bound)
        upper = (q_norm[i] + radius - bound * bound) / 2 + slack
        best: list[tuple[int, int]] = []
        near = np.argsort(-upper, kind="stable")
        for at in range(0, len(near), STEP):
            rows = near[at : at + STEP]
            kth = best[-1][0] if len(best) == k and best[-1][0] > LONG_MIN else -math.inf
            if upper[rows[0]] < max(least[i], kth):
                break
            rows = rows[x_ids[rows] != q_ids[i]]
            evaluated += len(rows)
            if exact:
                scores = (x[rows] @ q[i]).astype(np.int64)
                if len(scores) > 4 * k:
                    keep = scores >= np.partition(scores, -k)[-k]
                    rows, scores = rows[keep], scores[keep]
                pairs = zip(scores.tolist(), x_ids[rows].tolist(), strict=True)
            else:
                wide = [int(a) for a in q[i]]
                sums = [sum(int(a) * b for a, b in zip(r, wide, strict=True)) for r in x[rows]]
                pairs = zip((min(max(s, LONG_MIN), LONG_MAX) for s in sums), x_ids[rows].tolist(), strict=True)
            best = sorted([*best, *pairs], key=lambda b: (-b[0], b[1]))[:k]
        found += [(int(q_ids[i]), v, s) for s, v in best]
    return found, evaluated


def pivot_table(rows: DataFrame, n: int) -> tuple[DataFrame, dict[int, tuple[np.ndarray, float]]]:
    """(vec_id, v, d, block, far, own): distances to the pivots, lifted and as a query, and the block; pivots and M^2 by length."""
    sample: dict[int, list] = {}
    for r in common.lowest_by_hash(rows, ["vec_id"], n, PIVOT_SAMPLE).collect():
        sample.setdefault(r.d, []).append(r.v)
    # lengths are few; one that the sample missed gets one of its rows as its pivot
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    known = {}
    for r in rows.groupBy("d").agg(F.max(norm).alias("radius"), F.first("v").alias("v")).collect():
        known[r.d] = choose_pivots(np.array(sample.get(r.d, [r.v]), np.float64)), float(r.radius)
    held = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for d in np.unique(table.column("d").to_numpy()):
                some = table.filter(pa.compute.equal(table.column("d"), int(d))).combine_chunks()
                pivots, radius = held.value[int(d)]
                x = _matrix(some)
                far, own = distances(x, radius, pivots, True), distances(x, radius, pivots, False)
                as_list = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))
                made = [some.column("vec_id"), some.column("v"), some.column("d"), pa.array(far.argmin(axis=1).astype(np.int32)), as_list(far), as_list(own)]
                yield from pa.table(made, names=["vec_id", "v", "d", "block", "far", "own"]).to_batches()

    made = rows.mapInArrow(run, "vec_id long, v array<double>, d int, block int, far array<double>, own array<double>")
    return common.materialise(made, "pivot-table"), known


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query."""
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = products(vectors, is_query, k).filter("score IS NOT NULL").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def products(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, vec_id, score, evaluated): the best of each block; rows without a score tell how many products a task evaluated."""
    rows = whole(vectors).withColumn("d", F.size("v"))
    n = rows.count()
    table, known = pivot_table(rows, n)
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)).cast("int")
    # blocks of too many rows are split by hash; so are the queries of a block
    sizes = table.groupBy("d", "block").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.select("d", "block", F.ceil(F.col("n") / ROWS_PER_BLOCK).cast("int").alias("parts"))
    table = table.join(F.broadcast(parts), ["d", "block"]).withColumn("part", spread % F.col("parts")).drop("parts")
    queries = table.filter(is_query).select(F.col("vec_id"), "v", "d", "own")
    if not known:
        return table.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(None).cast("long").alias("score"), F.lit(0).cast("long").alias("evaluated"))
    lows = [F.min(F.element_at("far", p + 1)).alias(f"lo{p}") for p in range(PIVOTS)]
    highs = [F.max(F.element_at("far", p + 1)).alias(f"hi{p}") for p in range(PIVOTS)]
    safe = table.withColumn("far", F.transform(F.sequence(F.lit(1), F.lit(PIVOTS)), lambda i: F.try_element_at("far", i)))
    blocks = safe.groupBy("d", "block", "part").agg(*lows, *highs).collect()  # one row for ROWS_PER_BLOCK vectors or so
    ranges = {}
    for r in sorted(blocks, key=lambda r: (r.d, r.block, r.part)):
        m = len(known[r.d][0])
        ranges.setdefault(r.d, []).append(((r.block, r.part), [r[f"lo{p}"] for p in range(m)], [r[f"hi{p}"] for p in range(m)]))
    ranges = {d: ([x[0] for x in v], np.array([x[1] for x in v]), np.array([x[2] for x in v])) for d, v in ranges.items()}
    held = table.sparkSession.sparkContext.broadcast((known, ranges))

    def routes(first: bool):
        """Queries with the blocks they go to: the first ones, or the rest that can hold a better product."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, ranges = held.value
            for batch in batches:
                taken, block, part, least = [], [], [], []
                for i in range(len(batch)):
                    q, own = np.array(batch.column(1)[i].as_py()), np.array(batch.column(3)[i].as_py())
                    d = batch.column(2)[i].as_py()
                    names, low, high = ranges[d]
                    away = np.maximum(np.maximum(low - own, own - high), 0).max(axis=1)
                    norm = (q * q).sum()
                    upper = (norm + known[d][1] - away * away) / 2 + 1e-9 * (known[d][1] + norm) + 1.0
                    order = np.argsort(-upper, kind="stable")
                    floor = -math.inf if first else batch.column(4)[i].as_py()
                    to = order[:FIRST_BLOCKS] if first else [j for j in order[FIRST_BLOCKS:] if upper[j] >= floor]
                    taken += [i] * len(to)
                    block += [names[j][0] for j in to]
                    part += [names[j][1] for j in to]
                    least += [floor] * len(to)
                at = pa.array(taken, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), batch.column(3).take(at), pa.array(least, pa.float64()), pa.array(block, pa.int32()), pa.array(part, pa.int32())],
                    names=["vec_id", "v", "d", "own", "least", "block", "part"],
                )

        return run

    def meet(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, int | None]] = []
        evaluated = 0
        if q.num_rows and x.num_rows:
            pivots, radius = held.value[0][q.column("d")[0].as_py()]
            column = lambda t, c: np.array(t.column(c).combine_chunks().flatten()).reshape(t.num_rows, len(pivots))
            out, evaluated = search_block(
                q.column("vec_id").to_numpy(), _matrix(q), column(q, "own"), q.column("least").to_numpy(),
                x.column("vec_id").to_numpy(), _matrix(x), column(x, "far"), radius, k,
            )
        out = [(a, b, s, 0) for a, b, s in out] + [(None, None, None, evaluated)]
        kinds = ["query_id", "vec_id", "score", "evaluated"]
        return pa.table({c: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(kinds)})

    schema = "query_id long, vec_id long, score long, evaluated long"
    routed = "vec_id long, v array<double>, d int, own array<double>, least double, block int, part int"
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-queries.count() // QUERIES_PER_BLOCK)))).cast("int")

    def passed(some: DataFrame, first: bool) -> DataFrame:
        went = common.materialise(some.mapInArrow(routes(first), routed).withColumn("salt", salt), "topk-routes")
        # a block goes only to the groups of queries that come to it
        wanted = went.select("d", "block", "part", F.col("salt").alias("of")).distinct()
        right = table.select("vec_id", "v", "d", "far", "block", "part").join(wanted, ["d", "block", "part"])
        return went.groupBy("d", "block", "part", "salt").cogroup(right.groupBy("d", "block", "part", "of")).applyInArrow(meet, schema)

    first = common.materialise(passed(queries, True), "topk-first")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    # saturated products tie with all that are lower still
    kth = first.filter(F.col("score") > LONG_MIN).withColumn("at", F.row_number().over(place)).filter(F.col("at") == k)
    floor = kth.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least")).dropDuplicates(["vec_id"])
    again = queries.join(floor, "vec_id", "left").select("vec_id", "v", "d", "own", F.coalesce("least", F.lit(-math.inf)).alias("least"))
    return first.unionByName(passed(again, False))
