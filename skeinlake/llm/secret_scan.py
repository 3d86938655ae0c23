"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of characters that keys and tokens are made of, long enough
and with a digit in it, or a shorter quoted value that is assigned to something. A
forest of decision trees judges each by its length, the likelihood of its
character transitions and of its kinds of characters, how much of it dictionary
words cover, where the document comes from (its path; the source here) and the
words beside it.

The forest learns from labelled findings, ``per_class`` distinct feature vectors of each
label at most, those with the smallest hash, drawn by how often they occur (damped by the
logarithm, so that copies of one finding don't take all places). Findings may be given; else ``weak_label`` derives them
from where a finding stands, which no feature tells: a value that is assigned to a name for secrets is one; a value that is assigned to,
or follows, a word for digests and versions is none, nor is one that stands in prose, assigned to nothing. What is assigned to
other names stays unlabelled, and so does what looks like a key of a known service but has no such name: about those the forest
decides. The name that a value is assigned to, the sign between them and quotes are no features; neighbouring words are the
others. The dictionary and the transitions come from the word counts of all documents.

Edge cases: null and empty texts have no candidates; a null doc_id or source is
carried along; rows that repeat give their findings again; overlapping candidates
don't occur, as matching goes on after each match; without findings of both labels
each finding gets the share of secrets among the labels, or 0.5 without labels; texts of any length
are scanned whole; equal findings get equal scores; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LONG = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
ASSIGNED = r"[A-Za-z_][A-Za-z0-9_\-]*[\"']?\s?[:=]\s?[\"'][^\"'\s]{8,}[\"']"
QUOTED = r"(?:(?<=[:=][\"'])|(?<=[:=]\s[\"']))[^\"'\s]{8,}(?=[\"'])"
CANDIDATE = re.compile(f"{QUOTED}|{LONG}")
#: Names that secrets are assigned to, in part.
SECRET_NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key", "auth", "credential")
ASSIGNMENT = re.compile(r"([A-Za-z_][A-Za-z0-9_\-]*)[\"']?\s?[:=]\s?[\"']?$")
#: How keys of known services look, alone or at the end of a longer run.
KEY = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|sk-[A-Za-z0-9_\-]{20,}"
    r"|[sr]k_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}|glpat-[A-Za-z0-9_\-]{20,})(?![A-Za-z0-9])"
)
#: Words before what is no secret.
PLAIN_NAMES = frozenset("commit sha sha1 sha256 md5 hash digest checksum revision rev uuid guid etag version build".split())
#: Words of the dictionary, at most.
DICTIONARY = 5000
PER_CLASS = 2000
TREES = 25
DEPTH = 7
LEAF = 4
CUTS = 16
#: Indicators that words beside a value, and sources, are hashed to; words on either side.
WORD_BINS, SOURCE_BINS = 16, 16
BESIDE = 2
N_FEATURES = 13 + WORD_BINS + SOURCE_BINS
THRESHOLD = 0.5
ALPHABET = 38


def _symbol(c: str) -> int:
    c = c.lower()
    if "a" <= c <= "z":
        return ord(c) - 97
    return 26 + ord(c) - 48 if "0" <= c <= "9" else 37 if c in "_-" else 36


@dataclass
class Lexicon:
    words: frozenset
    #: Log2 chances of the next symbol after each symbol.
    moves: np.ndarray

    @staticmethod
    def learn(counts: list[tuple[str, int]]) -> Lexicon:
        moves = np.ones((ALPHABET, ALPHABET))
        for word, n in counts:
            at = [_symbol(c) for c in word]
            np.add.at(moves, (at[:-1], at[1:]), n)
        return Lexicon(frozenset(w for w, _ in counts if len(w) > 2), np.log2(moves / moves.sum(axis=1, keepdims=True)))

    def coverage(self, value: str) -> float:
        """Share of the value inside dictionary words of three letters or more, longest first."""
        low, at, covered = value.lower(), 0, 0
        while at < len(low):
            size = next((n for n in range(min(16, len(low) - at), 2, -1) if low[at : at + n] in self.words), 0)
            covered += size
            at += size or 1
        return covered / len(low)


def lexicon(docs: DataFrame) -> Lexicon:
    """The most frequent words of all documents."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0))
    counts = docs.filter(F.col("text").isNotNull()).select(F.explode(found).alias("w")).groupBy("w").count()
    top = common.most_frequent(common.materialise(counts, "secret-words"), "count", DICTIONARY).collect()
    return Lexicon.learn(sorted((r.w, r["count"]) for r in top))


def assigned_name(before: str) -> str | None:
    """The name that what follows is assigned to, if it is."""
    found = ASSIGNMENT.search(before)
    return found[1].lower() if found else None


def weak_label(value: str, before: str) -> int | None:
    """1: a secret, 0: none, by where the value stands; None if that doesn't tell."""
    name = assigned_name(before)
    if name and any(s in name for s in SECRET_NAMES):
        return 1
    words = re.findall(r"[A-Za-z0-9_]+", before)
    near = name or (words[-1].lower() if words else "")
    if near in PLAIN_NAMES:
        return 0
    return None if name or KEY.search(value) else 0


def beside(before: str, after: str) -> list[str]:
    """The words next to a value, without the name that it is assigned to."""
    held = ASSIGNMENT.sub("", before)
    return [w.lower() for w in [*WORD.findall(held)[-BESIDE:], *WORD.findall(after)[:BESIDE]]]


WORD = re.compile(r"[^\W\d_]{2,}")


def features(value: str, before: str, after: str, source: str | None, known: Lexicon) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    share = Counter(kinds)
    seen = Counter(value)
    at = [_symbol(c) for c in value]
    move = float(np.mean(known.moves[at[:-1], at[1:]])) if n > 1 else 0.0
    near = beside(before, after)
    words, sources = [0.0] * WORD_BINS, [0.0] * SOURCE_BINS
    for w in near:
        words[zlib.crc32(w.encode()) % WORD_BINS] = 1.0
    sources[zlib.crc32((source or "").encode()) % SOURCE_BINS] = 1.0
    return [
        n,
        share["d"] / n,
        share["u"] / n,
        share["l"] / n,
        share["o"] / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        -sum(c / n * math.log2(c / n) for c in seen.values()),
        len(seen) / n,
        move,
        known.coverage(value),
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        float(np.mean([known.coverage(w) for w in near])) if near else 0.0,
        len(near),
        *words,
        *sources,
    ]


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, source, start, end, sha256, features, weak) of every candidate.

    Offsets are in code points, the end is exclusive. Values aren't kept, only their digest.
    """
    known = docs.sparkSession.sparkContext.broadcast(lexicon(docs))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        words = known.value
        for batch in batches:
            rows, taken = [], []
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                for m in CANDIDATE.finditer(text):
                    value = m[0]
                    before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 30]
                    name = assigned_name(before)
                    if name is None and not any(c.isdigit() for c in value):
                        continue
                    taken.append(i)
                    rows.append(
                        (
                            m.start(),
                            m.end(),
                            hashlib.sha256(value.encode()).hexdigest(),
                            features(value, before, after, batch.column(1)[i].as_py(), words),
                            weak_label(value, before),
                        )
                    )
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.int32()]
            picked = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(picked), batch.column(1).take(picked)]
                + [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "source", "start", "end", "sha256", "features", "weak"],
            )

    likely = docs.filter(F.col("text").rlike(LONG) | F.col("text").rlike(ASSIGNED)).select("doc_id", "source", "text")
    schema = f"doc_id {kinds['doc_id']}, source {kinds['source']}, start int, end int, sha256 string, features array<double>, weak int"
    return likely.mapInArrow(run, schema)


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), cut, left child, right child, share of secrets."""

    trees: list[tuple[np.ndarray, ...]]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.prior)
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                inner = f >= 0
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def _impurity(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    p = positive / np.maximum(total, 1)
    return total * p * (1 - p)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """One tree: at each node the best cut among a random part of the features."""
    nodes: list[list] = []

    def build(rows: np.ndarray, depth: int) -> int:
        own = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if depth == DEPTH or len(rows) < 2 * LEAF or y[rows].min() == y[rows].max():
            return own
        best = (1e-12, -1, 0.0)
        whole = _impurity(y[rows].sum(), np.array(len(rows)))
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
            cuts = np.unique(np.quantile(x[rows, f], np.linspace(0, 1, CUTS + 2)[1:-1]))
            low = x[rows, f][:, None] <= cuts
            n_low, pos_low = low.sum(axis=0), (low * y[rows][:, None]).sum(axis=0)
            gain = whole - _impurity(pos_low, n_low) - _impurity(y[rows].sum() - pos_low, len(rows) - n_low)
            gain[(n_low < LEAF) | (len(rows) - n_low < LEAF)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), int(f), float(cuts[i]))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[own][:3] = [best[1], best[2], build(rows[low], depth + 1)]
            nodes[own][3] = build(rows[~low], depth + 1)
        return own

    build(np.arange(len(y)), 0)
    return tuple(np.array(c) for c in zip(*nodes, strict=True))


def sample(vectors: DataFrame, limit: int) -> list:
    """``limit`` of the distinct (features, count), or all if there are fewer."""
    known = vectors.count()
    rows = common.lowest_by_hash(vectors, ["features"], known, limit).collect()
    if len(rows) < min(limit, known):  # the thinning left too few
        rows = vectors.orderBy(F.xxhash64("features"), "features").limit(limit).collect()
    return rows


def train(labelled: DataFrame, per_class: int = PER_CLASS) -> Forest:
    """A forest from rows (features, label)."""
    vectors = common.materialise(labelled.groupBy("label", "features").count(), "secret-vectors")
    sizes = dict(vectors.groupBy("label").agg(F.sum("count")).collect())
    total = sum(sizes.get(k, 0) for k in (0, 1))
    prior = sizes.get(1, 0) / total if total else 0.5
    if not sizes.get(0) or not sizes.get(1):
        return Forest([], prior)
    found, weights, labels, places = [], [], [], 0
    for label in (0, 1):
        rows = sample(vectors.filter(F.col("label") == label).select("features", "count"), per_class)
        weight = np.array([1 + math.log2(r["count"]) for r in rows])
        share = min(per_class, sizes[label])
        found += [r.features for r in rows]
        weights.append(weight / weight.sum() * share)
        labels.append(np.full(len(rows), float(label)))
        places += share
    x, y, p = np.array(found), np.concatenate(labels), np.concatenate(weights) / places
    trees = []
    for t in range(TREES):
        rng = np.random.default_rng(t)
        drawn = rng.choice(len(y), places, p=p / p.sum())
        trees.append(grow(x[drawn], y[drawn], rng))
    return Forest(trees, prior)


def weak_labels(found: DataFrame) -> DataFrame:
    return found.filter(F.col("weak").isNotNull()).select("doc_id", "features", F.col("weak").alias("label"))


def judge(found: DataFrame, forest: Forest) -> DataFrame:
    """``found`` with the forest's score of each finding."""
    held = found.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def score(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in rows:
            x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), N_FEATURES)
            yield pa.array(held.value.score(x), pa.float64())

    return found.withColumn("score", score("features"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, start, end, length, sha256, score) of what the forest takes for secrets."""
    found = common.materialise(findings(docs), "secret-findings")
    forest = train(weak_labels(found) if labelled is None else labelled, per_class)
    return (
        judge(found, forest)
        .filter(F.col("score") >= THRESHOLD)
        .select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("length"), "sha256", "score")
    )
