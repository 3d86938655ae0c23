"""Hard negatives by lists that anchors share, walked to a certified end.

Anchors are clustered by direction. For a row x, a cluster with centre c and half-angle t (the widest angle between c and
one of its anchors), every anchor u of the cluster has

    u.x <= |u| |x| cos(max(0, angle(x, c) - t)),

so a cluster sorts rows by |x| cos(...) once, and each of its anchors walks that one list until |u| times the next
row's value is below what it still looks for. That end is certified: no row behind it can matter. Members of a cluster
walk together, as one matrix product for a stretch of the list.

First the best rows of the same label, the positives, are walked for; the walk ends below the k-th best. Their
scores give each anchor its windows, from ``LOW`` to ``HIGH`` hundredths of a positive's score, and the second walk takes the best
rows of another label inside each window; it ends below the lowest score that any window still looks for.

Rows stay where they are: each task keeps lists of the rows that it reads, and anchors go to the tasks in chunks of
a bounded number of bytes, one after the other. Rows are read in slices by hash, each about 16 times as large as those before
it; what one slice finds is the floor that the next one's walks end at, so a task hands on few rows for each anchor however
many tasks there are. Centres are fitted on a bounded sample of anchors; every anchor and every row takes part.

Edge cases: rows with a null id, a null label, a null vector or null or non-finite components take no part. Only vectors of
equal length, of which there are few, meet; components beyond a long saturate, as do scores; a vector of zeros has score 0 with all. Ties go to the smaller id. A row is never compared with its own
id; rows that repeat an id are candidates one by one, and of anchors that do the one with the smallest label and vector is
taken. An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common, topk

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Anchors that the centres are fitted on, and those wanted in a cluster; larger clusters are split.
SAMPLE = 4096
MEMBERS = 128
ROUNDS = 6
#: Bytes of anchors that are broadcast at once.
CHUNK_BYTES = 16 << 20
#: Rows of the first slice, how much larger the slices after it are, and rows that a task gathers to one list.
FIRST_SLICE = 65_536
GROWTH = 16
LIST_ROWS = 16_384
#: Rows of a list between two looks at the bounds.
STEP = 512
NOTHING = -math.inf


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v, d) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * topk.SCALE).cast("double"))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("v"), F.size(x).alias("d"))


def centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors that the sample's directions gather around."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    picked = topk.choose_pivots(unit, count)
    for _ in range(ROUNDS):
        nearest = (unit @ picked.T).argmax(axis=1)
        sums = np.zeros_like(picked)
        np.add.at(sums, nearest, unit)
        size = np.linalg.norm(sums, axis=1)
        picked = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], picked)
    return picked


def _angles(rows: np.ndarray, norms: np.ndarray, units: np.ndarray) -> np.ndarray:
    cosine = (rows @ units.T) / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosine, -1, 1))


@dataclass
class Cluster:
    """Anchors of one length around a centre, and what each has found."""

    ids: np.ndarray
    labels: np.ndarray
    u: np.ndarray
    centre: np.ndarray
    #: Floors that came with the anchors: of the k-th best positive, or windows (low, high, floor) of negatives.
    floor: np.ndarray
    windows: list[list[tuple[int, int, float]]] | None = None
    norms: np.ndarray = field(init=False)
    half: float = field(init=False)

    def __post_init__(self):
        self.norms = np.linalg.norm(self.u, axis=1)
        there = self.norms > 0
        self.half = float(_angles(self.u[there], self.norms[there], self.centre[None]).max(initial=0))


def _products(x: np.ndarray, u: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return x @ u.T
    whole = np.vectorize(int, otypes=[object])
    wide = whole(x).dot(whole(u).T) if x.shape[1] else np.zeros((len(x), len(u)), object)
    return np.vectorize(lambda s: min(max(int(s), topk.LONG_MIN), topk.LONG_MAX), otypes=[object])(wide)


def _below(score: int) -> float:
    """The score as a double, or the next one below where it is too large for that."""
    x = float(score)
    return x if abs(score) < topk.EXACT else math.nextafter(x, -math.inf)


class Walk:
    """Walks of all anchors of some clusters over one list of rows after another."""

    def __init__(self, clusters: list[Cluster]):
        self.clusters = clusters
        self.floors = [c.floor.copy() for c in clusters]
        self.best: list[list] = [[[] if c.windows is None else [[] for _ in w] for w in (c.windows or [None] * len(c.ids))] for c in clusters]
        self.evaluated = 0

    def over(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        norms = np.linalg.norm(x, axis=1)
        most = float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
        some = [k for k, c in enumerate(self.clusters) if c.u.shape[1] == x.shape[1]]
        if not some or not len(x):
            return
        angles = _angles(x, norms, np.stack([self.clusters[k].centre for k in some]))
        for k, angle in zip(some, angles.T):
            c = self.clusters[k]
            exact = most * float(np.abs(c.u).max(initial=0)) < topk.EXACT
            # slack for rounding: of the angle near 0 and pi, and of the product
            value = norms * (np.cos(np.maximum(0, angle - c.half - 1e-6)) + 1e-9)
            order = np.argsort(-value, kind="stable")
            active = np.arange(len(c.ids))
            for at in range(0, len(order), STEP):
                active = active[c.norms[active] * value[order[at]] + 1e-6 >= self.floors[k][active]]
                if not len(active):
                    break
                rows = order[at : at + STEP]
                scores = _products(x[rows], c.u[active], exact)
                self.evaluated += scores.size
                same = labels[rows][:, None] == c.labels[active]
                other = ids[rows][:, None] != c.ids[active]
                if c.windows is None:
                    self._positives(k, active, ids[rows], scores, same & other)
                else:
                    self._negatives(k, active, ids[rows], scores, ~same & other)

    def _positives(self, k: int, active: np.ndarray, ids: np.ndarray, scores: np.ndarray, mask: np.ndarray) -> None:
        floors = self.floors[k]
        least = floors[active]
        if scores.dtype != object and len(scores) > 4 * POSITIVES:
            masked = np.where(mask, scores, NOTHING)
            least = np.maximum(least, np.partition(masked, -POSITIVES, axis=0)[-POSITIVES])
        hits = mask & (scores >= least).astype(bool)
        for j in np.flatnonzero(hits.any(axis=0)).tolist():
            at = np.flatnonzero(hits[:, j])
            found = self.best[k][active[j]]
            found.extend(zip((-int(s) for s in scores[at, j]), ids[at].tolist()))
            found.sort()
            del found[POSITIVES:]
            if len(found) == POSITIVES:
                floors[active[j]] = max(floors[active[j]], _below(-found[-1][0]))

    def _negatives(self, k: int, active: np.ndarray, ids: np.ndarray, scores: np.ndarray, mask: np.ndarray) -> None:
        c, floors = self.clusters[k], self.floors[k]
        highest = np.array([max((_above(h) for _, h, _ in c.windows[j]), default=NOTHING) for j in active])
        hits = mask & (scores >= floors[active]).astype(bool) & (scores <= highest).astype(bool)
        for j in np.flatnonzero(hits.any(axis=0)).tolist():
            a = active[j]
            at = np.flatnonzero(hits[:, j])
            near = sorted(zip((-int(s) for s in scores[at, j]), ids[at].tolist()))
            left = math.inf
            for (low, high, floor), found in zip(c.windows[a], self.best[k][a]):
                if len(found) == NEGATIVES:
                    floor = max(floor, _below(-found[-1][0]))
                found.extend(r for r in near if low <= -r[0] <= high and -r[0] >= floor)
                found.sort()
                del found[NEGATIVES:]
                left = min(left, max(floor, _below(-found[-1][0])) if len(found) == NEGATIVES else max(floor, _below(low)))
            floors[a] = max(floors[a], left)


def _above(score: int) -> float:
    x = float(score)
    return x if abs(score) < topk.EXACT else math.nextafter(x, math.inf)


def windows_of(scores: list[int]) -> list[tuple[int, int]]:
    """(low, high) of the scores that negatives may have, for each positive's score."""
    return [(-((-LOW * s) // 100), (HIGH * s) // 100) for s in scores]


FOUND = "anchor_id long, window long, vec_id long, score long"


def _searching(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(held.value)
        gathered: dict[int, list[pa.RecordBatch]] = {}

        def flush(d: int) -> None:
            table = pa.Table.from_batches(gathered.pop(d)).combine_chunks()
            v = table.column("v").combine_chunks()
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), d)
            walk.over(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), x)

        for batch in batches:
            kinds = batch.column("d").to_numpy()
            for d in np.unique(kinds).tolist():
                gathered.setdefault(d, []).append(batch.filter(pa.array(kinds == d)))
                if sum(map(len, gathered[d])) >= LIST_ROWS:
                    flush(d)
        for d in list(gathered):
            flush(d)
        out = []
        for c, best in zip(walk.clusters, walk.best):
            for j, found in enumerate(best):
                if c.windows is None:
                    out += [(int(c.ids[j]), None, v, -s) for s, v in found]
                else:
                    out += [(int(c.ids[j]), w, v, -s) for w, some in enumerate(found) for s, v in some]
        kinds = pa.schema([(n, pa.int64()) for n in ("anchor_id", "window", "vec_id", "score")])
        yield from pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], schema=kinds).to_batches(max_chunksize=10_000)

    return run


def _clustered(anchors: DataFrame, n: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Anchors with cluster and chunk, and the centres by length."""
    sample: dict[int, list] = {}
    for r in common.lowest_by_hash(anchors, ["vec_id"], n, SAMPLE).collect():
        sample.setdefault(r.d, []).append(r.v)
    taken = sum(map(len, sample.values()))
    known = {}
    for r in anchors.groupBy("d").agg(F.first("v").alias("v")).collect():  # lengths are few
        mine = sample.get(r.d, [r.v])
        some = np.array(mine, np.float64).reshape(len(mine), r.d)
        known[r.d] = centres(some, max(1, min(len(some) // 4, math.ceil(n * len(some) / max(1, taken) / MEMBERS))))
    held = anchors.sparkSession.sparkContext.broadcast(known)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("d").to_numpy()
            cluster = np.zeros(len(batch), np.int32)
            for d in np.unique(kinds).tolist():
                at = np.flatnonzero(kinds == d)
                x = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                cluster[at] = (x @ held.value[d].T).argmax(axis=1)
            yield batch.append_column("cluster", pa.array(cluster))

    near = common.materialise(anchors.mapInArrow(nearest, "vec_id long, label long, v array<double>, d int, cluster int"), "mining-anchors")
    return near, known


def _chunks(near: DataFrame) -> DataFrame:
    """Anchors with the part of their cluster and the chunk that takes it: parts of one cluster follow each other."""
    sizes = sorted(near.groupBy("d", "cluster").count().collect())  # SAMPLE / 4 rows for each length at most
    rows, filled, chunk = [], 0, 0
    for d, cluster, n in sizes:
        parts = -(-n // (4 * MEMBERS))
        for part in range(parts):
            size = n / parts * 8 * max(1, d)
            if filled and filled + size > CHUNK_BYTES:
                chunk, filled = chunk + 1, 0
            filled += size
            rows.append((d, cluster, parts, part, chunk))
    of = near.sparkSession.createDataFrame(rows, "d int, cluster int, parts int, part int, chunk int")
    parts = F.broadcast(of.select("d", "cluster", "parts").distinct())
    dealt = near.join(parts, ["d", "cluster"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    return dealt.join(F.broadcast(of.drop("parts")), ["d", "cluster", "part"])


def _clusters(anchors: list, known: dict[int, np.ndarray], floors: dict, windows: dict | None) -> list[Cluster]:
    by: dict[tuple, list] = {}
    for r in anchors:
        by.setdefault((r.d, r.cluster, r.part), []).append(r)
    made = []
    for (d, cluster, _), some in sorted(by.items()):
        ids = np.array([r.vec_id for r in some])
        u = np.array([r.v for r in some], np.float64).reshape(len(some), d)
        if windows is None:
            mine, floor = None, np.array([floors.get(r.vec_id, NOTHING) for r in some])
        else:
            mine = [[(low, high, floors.get((r.vec_id, w), NOTHING)) for w, (low, high) in enumerate(windows.get(r.vec_id, []))] for r in some]
            floor = np.array([min((max(_below(low), f) for low, _, f in m), default=math.inf) for m in mine])
        made.append(Cluster(ids, np.array([r.label for r in some]), u, known[d][cluster], floor, mine))
    return made


def _best(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def _walks(slices: list[DataFrame], anchors: list, known: dict, k: int, windows: dict | None) -> DataFrame:
    """The best rows of one chunk of anchors, slice after slice."""
    spark = slices[0].sparkSession
    found, floors = None, {}
    for i, rows in enumerate(slices):
        held = spark.sparkContext.broadcast(_clusters(anchors, known, floors, windows))
        some = rows.mapInArrow(_searching(held), FOUND)
        found = common.materialise(_best(some if found is None else some.unionByName(found.drop("rank")), k), "mining-found")
        if i + 1 < len(slices):
            for r in found.filter(F.col("rank") == k).collect():  # one row for an anchor, or for a window of it
                floors[r.anchor_id if windows is None else (r.anchor_id, r.window)] = _below(r.score)
    return found


def _sliced(rows: DataFrame) -> list[DataFrame]:
    """Rows dealt to slices by hash, each written to a folder of its own."""
    rows = common.materialise(rows, "mining-rows")
    n = rows.count()
    shares, share = [], min(1.0, FIRST_SLICE / max(1, n))
    while share < 1:
        shares.append(share)
        share *= GROWTH
    if not shares:
        return [rows]
    u = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) / float(1 << 30)
    level = sum(((u >= s).cast("int") for s in shares), F.lit(0))
    path = f"{common.scratch_dir(rows.sparkSession)}/mining-slices-{uuid.uuid4().hex}"
    rows.withColumn("level", level).write.partitionBy("level").parquet(path)
    kept = rows.sparkSession.read.schema("vec_id long, label long, v array<double>, d int, level int").parquet(path)
    return [kept.filter(F.col("level") == i).drop("level") for i in range(len(shares) + 1)]


def mine(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors' best positives.

    ``is_anchor`` is a condition on vec_id.
    """
    slices = _sliced(usable(rows))
    every = slices[0]
    for s in slices[1:]:
        every = every.unionByName(s)
    one = every.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v", "d")).alias("a")).select("vec_id", "a.*")
    anchors = common.materialise(one, "mining-anchors")
    near, known = _clustered(anchors, anchors.count())
    dealt = common.materialise(_chunks(near), "mining-chunks")
    positives, negatives = [], []
    for chunk in range((dealt.agg(F.max("chunk")).first()[0] or 0) + 1):
        some = dealt.filter(F.col("chunk") == chunk).collect()  # CHUNK_BYTES
        found = _walks(slices, some, known, POSITIVES, None)
        scores: dict[int, list[int]] = {}
        for r in found.select("anchor_id", "score").distinct().orderBy("anchor_id", F.desc("score")).collect():
            scores.setdefault(r.anchor_id, []).append(r.score)
        windows = {a: windows_of(s) for a, s in scores.items()}
        # a window is named by its positives' score
        at = F.dense_rank().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"))).cast("long") - 1
        positives.append(found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), at.alias("window")))
        fits = _walks(slices, some, known, NEGATIVES, windows)
        negatives.append(fits.select("anchor_id", "window", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"))
    left, right = positives[0], negatives[0]
    for p, q in zip(positives[1:], negatives[1:]):
        left, right = left.unionByName(p), right.unionByName(q)
    return left.join(right, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
