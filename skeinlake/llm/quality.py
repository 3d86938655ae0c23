"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

The terms of a text are pairs of neighbouring character classes (lower case,
upper case, digit, space, line break, each punctuation mark, anything else),
counted over the whole text, its words, hashed to a fixed number of terms, and three measures
of repetition: words that repeat
the word before, words seen before, and lines seen before. Term weights are
log-scaled counts times inverse document frequency; their singular vectors
(latent semantic analysis) give each text a short vector. The labelled vectors
are broadcast, every document is compared with all of them by blocked matrix
products of unit vectors (exact cosines), and its nearest neighbours vote with
their similarity.

The fit uses at most ``per_class`` labelled rows of each class, those with the
smallest hash of their id, and so is bounded in size; scoring covers every row.

Edge cases: null and empty texts have no terms and get the share of good labels
as score; labels that are null or whose document is missing are not used; without
any label the score is 0.5; a null doc_id is not held out; repeated rows are
scored alike; neighbours as near as the last one all vote; a text of any length is
one value in one task; other columns are left alone (names that start with two
underscores are reserved); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

PER_CLASS = 1500
DIMENSIONS = 48
NEIGHBOURS = 15
#: Power of the similarity in a vote.
SHARPNESS = 8
#: What the repetition measures weigh beside the character pairs, which have length 1.
REPETITION_WEIGHT = 1.5
BLOCK = 256


def _classes() -> tuple[np.ndarray, int]:
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[ord(" ")], table[ord("\n")] = 4, 5
    table[128:] = 6
    n = 7
    for c in range(33, 127):
        if not chr(c).isalnum():
            table[c] = n
            n += 1
    return table, n


CLASS_OF, N_CLASSES = _classes()
N_PAIRS = N_CLASSES * N_CLASSES
#: Terms that words are hashed to.
N_WORDS = 1024
N_TERMS = N_PAIRS + N_WORDS + 3
#: What words weigh beside the character pairs, which have length 1.
WORD_WEIGHT = 0.5


def terms(text: str | None) -> np.ndarray:
    """Counts of the character pairs and of the hashed words, then the three shares of repetition."""
    out = np.zeros(N_TERMS, np.float32)
    raw = (text or "").encode()
    if not raw:
        return out
    kinds = CLASS_OF[np.frombuffer(raw, np.uint8)]
    pairs = kinds[:-1].astype(np.uint16) * N_CLASSES + kinds[1:]
    out[:N_PAIRS] = np.bincount(pairs, minlength=N_PAIRS)
    out[int(kinds[0]) * (N_CLASSES + 1)] += len(raw) == 1
    words = raw.split()
    seen = Counter(words)
    at = np.fromiter((zlib.crc32(w.lower()) % N_WORDS for w in seen), np.int64, len(seen))
    np.add.at(out, N_PAIRS + at, np.fromiter(seen.values(), np.float32, len(seen)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if len(words) > 1:
        out[-3] = sum(map(eq, words, words[1:])) / (len(words) - 1)
        out[-2] = max(0.0, 1 - len(seen) / len(words) - 0.5)
    if len(lines) > 1:
        out[-1] = 1 - len(set(lines)) / len(lines)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    prior: float

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        counted = np.log1p(counts[:, :-3]) * self.idf
        pairs, words = _unit(counted[:, :N_PAIRS]), _unit(counted[:, N_PAIRS:]) * WORD_WEIGHT
        return np.hstack([pairs, words, np.sqrt(counts[:, -3:]) * REPETITION_WEIGHT]).astype(np.float32)

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(self.weigh(counts) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Shares of similarity-weighted votes for quality 1."""
        out = np.full(len(counts), self.prior)
        for at in range(0, len(counts) if len(self.vectors) else 0, BLOCK):
            near = self.embed(counts[at : at + BLOCK]) @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            last = np.partition(near, near.shape[1] - k, axis=1)[:, [near.shape[1] - k]]
            row, column = np.nonzero(near >= last)
            weight = np.clip(near[row, column], 0, 1).astype(np.float64) ** SHARPNESS
            total = np.bincount(row, weight, len(near))
            share = np.bincount(row, weight * self.votes[column], len(near)) / np.where(total > 0, total, 1)
            out[at : at + BLOCK] = np.where(total > 1e-9, share, self.prior)
        return np.clip(out, 0.0, 1.0)


def leading_axes(weighed: np.ndarray, count: int) -> np.ndarray:
    """The right singular vectors of the largest singular values, by subspace iteration from a fixed start."""
    start = np.random.default_rng(5).normal(size=(weighed.shape[1], min(count + 16, *weighed.shape)))
    q = np.linalg.qr(start)[0]
    parts = [slice(at, at + BLOCK) for at in range(0, len(weighed), BLOCK)]  # only one is held in doubles at a time
    for _ in range(8):
        q = np.linalg.qr(sum(w.T @ (w @ q) for w in (weighed[p].astype(np.float64) for p in parts)))[0]
    inside = np.concatenate([weighed[p].astype(np.float64) @ q for p in parts])
    _, turned = np.linalg.eigh(inside.T @ inside)
    return q @ turned[:, ::-1][:, :count]


def bucket(doc_id: Column, modulus: int = 3) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket(doc_id) == 1, F.lit(False))


def _counted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [terms(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["quality", "terms"])

    return docs.select("quality", "text").mapInArrow(run, "quality int, terms binary")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, dimensions: int = DIMENSIONS) -> Model:
    """Learn from labelled rows that aren't held out, ``per_class`` of each label at most."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("quality"))
    sizes = dict(usable.groupBy("quality").count().collect())
    picked = None
    for label in sorted(sizes):
        one = common.lowest_by_hash(usable.filter(F.col("quality") == label), ["doc_id"], sizes[label], per_class)
        picked = one if picked is None else picked.unionByName(one)
    if picked is None:
        return Model(np.zeros(N_TERMS - 3), np.zeros((N_TERMS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # an id may have many texts, and many of them equal: as many distinct ones as were asked for
    rows = _counted(texts).groupBy("quality", "terms").agg(F.lit(1)).select("quality", "terms")
    order = Window.partitionBy("quality").orderBy(F.xxhash64("terms"), "terms")
    rows = rows.withColumn("__at", F.row_number().over(order)).filter(F.col("__at") <= per_class).collect()
    prior = sizes.get(1, 0) / sum(sizes.values())
    if not rows:
        return Model(np.zeros(N_TERMS - 3), np.zeros((N_TERMS, 1)), np.zeros((0, 1)), np.zeros(0), prior)
    rows.sort(key=lambda r: (r.quality, r.terms))
    # the driver holds the counts once, as they came, and the weighed rows once; all else goes by blocks
    blocks = [range(at, min(at + BLOCK, len(rows))) for at in range(0, len(rows), BLOCK)]
    counts = lambda block: np.stack([np.frombuffer(rows[i].terms, np.float32) for i in block])
    seen = sum((counts(b)[:, :-3] > 0).sum(axis=0) for b in blocks)
    model = Model(np.log((1 + len(rows)) / (1 + seen)) + 0.1, np.eye(N_TERMS, 1), np.zeros((0, 1)), np.array([r.quality for r in rows], float), prior)
    weighed = np.empty((len(rows), N_TERMS), np.float32)
    for b in blocks:
        weighed[b.start : b.stop] = model.weigh(counts(b))
    rows.clear()
    model.axes = leading_axes(weighed, min(dimensions, len(weighed))).astype(np.float32)
    model.vectors = _unit(weighed @ model.axes)
    return model


def _scorer(docs: DataFrame, model: Model):
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        for batch in text:
            parts = []
            for at in range(0, len(batch), BLOCK):
                counts = np.stack([terms(t.as_py()) for t in batch[at : at + BLOCK]])
                parts.append(model.score(counts))
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    score = _scorer(docs, fit(docs, labels, per_class))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that the classifier accepts."""
    score = _scorer(docs, fit(docs, labels, per_class))
    return docs.withColumn("__score", score("text")).filter("__score >= 0.5").drop("__score")
