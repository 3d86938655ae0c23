"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Classes of words: the end mark, the ``OWN`` most frequent words (a class each), the
other words of a broadcast list, and rare words, which include all unseen ones. The
model (Mnih and Hinton, 2007) predicts the class of the next token from the classes
of the two before it and from the topic of the text so far:

    predicted = A r(c1) + B r(c2) + C r(z)        score(c) = predicted . q(c) + b(c)

normalised over all classes. The topic z is the likeliest of a few, judged by the short words
before the token; topics are clusters of short words that occur in the same documents, which tells
languages and registers apart. A word of the broadcast list has, in its class, its share
of the tokens of its topic, mixed with its share of all. Of a rare word's class, the part that
words seen once have in it goes to unseen words (one event, as in the base score; Good and
Turing's estimate), the rest to the known ones by their counts. So the probabilities
of all words, the unseen one included, sum to 1 after every text.

What is gathered from the corpus covers every training document: the count of each
word, which short words meet in a document, the count of each class after each context
(a table of bounded size whose counts are those of all tokens) and of each listed word by topic.
Counts are split among shards, more of them for more tokens, each a part of all; each shard takes noise-contrastive
steps from the same parameters, which go over every one of its tokens in each round (see ``BATCHES``), and the shards'
parameters are averaged after each round. The counts of listed words are broadcast; the rest of
the vocabulary has no bound and is joined.

Edge cases: null and empty texts are the end mark alone; a null doc_id counts as
training data; rows that repeat are counted and scored each by itself; equal counts are
listed together or not at all; a text of any length is scored in one task; without
training data every word is unseen; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words with a class of their own, at most; the end mark, the other listed words and rare words have one each.
OWN = 93
CLASSES = OWN + 3
MID, RARE = OWN + 1, OWN + 2
TOPICS = 6
#: Short words that judge the topic: the hash buckets they fall in, and their bytes at most.
BUCKETS = 256
SHORT = 4
SIZE = 16
#: What a listed word's share of its topic weighs beside its share of all.
BY_TOPIC = 0.85
#: Words whose counts are broadcast, at most; the other counts are joined.
FREQUENT = 50_000
#: Training tokens to a shard, and the fewest and most shards.
SHARD_TOKENS, SHARDS, MOST_SHARDS = 20_000_000, 8, 256
ROUNDS = 4
#: Batches to which a shard's tokens are dealt in a round; with their counts, equal tokens are one row.
BATCHES = 180
#: Contexts of a batch that are gone over at a time.
CONTEXTS_AT_ONCE = 4096
#: Noise to a token.
NOISE = 48
RATE = 0.15
#: Words a task counts before it hands its counts on.
FLUSH = 400_000
#: Documents that a task holds as words at a time.
ROWS_AT_ONCE = 200
#: Classes without words.
NEVER = -60.0
END = ""


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def bucket_of(word: bytes) -> int:
    """The bucket of a short word, or BUCKETS."""
    return zlib.crc32(word) % BUCKETS if len(word) <= SHORT else BUCKETS


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, c, pair) over all documents given; the end mark is the empty token.

    Rows with a ``pair`` count the documents that hold short words of both of its buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        meet = np.zeros((BUCKETS, BUCKETS), np.int64)

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.nulls(len(held), pa.int32()), pa.array(list(held.values()), pa.int64())],
                names=["token", "pair", "n"],
            )
            held.clear()
            return made

        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, len(b), ROWS_AT_ONCE)):
            held[END.encode()] += len(batch)
            present = np.zeros((len(batch), BUCKETS + 1), np.float32)
            for i, text in enumerate(batch.column(0)):
                found = words_of(text.as_py())
                held.update(found)
                present[i, [bucket_of(w) for w in set(found) if len(w) <= SHORT]] = 1
                if len(held) > FLUSH:
                    yield out()
            meet += (present[:, :BUCKETS].T @ present[:, :BUCKETS]).astype(np.int64)
        yield out()
        pairs = np.flatnonzero(meet)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(pairs), pa.binary()), pa.array(pairs.astype(np.int32)), pa.array(meet.ravel()[pairs])],
            names=["token", "pair", "n"],
        )

    counted = docs.select("text").mapInArrow(run, "token binary, pair int, n long")
    return counted.groupBy("token", "pair").agg(F.sum("n").alias("c"))


def find_topics(meet: np.ndarray) -> np.ndarray:
    """Log chances of each bucket (and of none, 0) under each topic, from counts of documents with both buckets.

    Positive mutual information, its leading axes, k-means from centres far from each other.
    """
    alone = np.diag(meet).astype(float)
    n = max(1.0, alone.max(initial=0.0))
    expected = np.outer(alone, alone) / n
    shared = np.log(np.where(meet > 0, meet, 1) / np.where((meet > 0) & (expected > 0), expected, 1))
    shared = np.maximum(np.where(meet > 0, shared, 0), 0) * (np.minimum.outer(alone, alone) >= 3)
    np.fill_diagonal(shared, 0)
    value, axis = np.linalg.eigh(shared)
    top = axis[:, ::-1][:, : TOPICS + 2] * np.sqrt(np.abs(value[::-1][: TOPICS + 2]))
    length = np.linalg.norm(top, axis=1, keepdims=True)
    top = np.where(length > 1e-9, top / np.where(length > 1e-9, length, 1), 0)
    weight = np.sqrt(alone)
    centres = top[[int(np.argmax(weight))]]
    while len(centres) < TOPICS:
        away = ((top[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, top[int(np.argmax(away * weight))]])
    for _ in range(30):
        nearest = ((top[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(TOPICS):
            if (own := weight * (nearest == g)).sum() > 0:
                centres[g] = (top * own[:, None]).sum(axis=0) / own.sum()
    by_topic = np.stack([meet[:, nearest == g].sum(axis=1) for g in range(TOPICS)], axis=1) + 0.5
    return np.vstack([np.log(by_topic / by_topic.sum(axis=0)), np.zeros((1, TOPICS))])


@dataclass
class Vocabulary:
    """What scoring needs to know of all words without a join."""

    total: int
    distinct: int
    ends: int
    #: Listed words, the most frequent first, and their counts.
    listed: dict[bytes, int]
    counts: np.ndarray
    #: Tokens of words that aren't listed, and of those seen once.
    rare: int
    once: int
    #: By bucket and topic, for judging the topic.
    signs: np.ndarray

    def entry(self, word: bytes) -> int:
        """The number of a word in the list (or -1), plus 1, and its bucket, in one number."""
        return (self.listed.get(word, -1) + 1) * (BUCKETS + 1) + bucket_of(word)

    def unseen(self) -> float:
        """The share of unseen words in the class of rare ones.

        By Good and Turing's estimate, words seen c times hold as much as those seen c + 1 times do
        now: the unseen ones as much as those seen once, the rare ones up to the first listed count.
        """
        edge = self.counts[self.counts == self.counts.min()].sum() if len(self.counts) else 0
        return (self.once + 0.5) / (self.rare + edge + 1) if self.rare else 1.0


def vocabulary(counts: DataFrame) -> Vocabulary:
    words = counts.filter("pair IS NULL")
    sums = words.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when((F.col("c") == 1) & (F.length("token") > 0), 1))).first()
    top = common.most_frequent(words.filter((F.length("token") > 0) & (F.col("c") > 1)), "c", FREQUENT).collect()
    top.sort(key=lambda r: (-r.c, bytes(r.token)))
    ends = words.filter(F.length("token") == 0).agg(F.sum("c")).first()[0] or 0
    meet = np.zeros(BUCKETS * BUCKETS, np.int64)
    for r in counts.filter("pair IS NOT NULL").collect():  # BUCKETS squared at most
        meet[r.pair] = r.c
    listed = np.array([r.c for r in top], float)
    return Vocabulary(
        sums[0] or 0, sums[1], ends, {bytes(r.token): i for i, r in enumerate(top)}, listed,
        int((sums[0] or 0) - listed.sum() - ends), sums[2] or 0, find_topics(meet.reshape(BUCKETS, BUCKETS)),
    )


class Encoder:
    """Texts as classes, places in the list and topics; remembers the words it has seen."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.known: dict[bytes, int] = {}

    def encode(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token, the end mark too: class, number in the list, topic of the text before it."""
        if len(self.known) > FLUSH:
            self.known.clear()
        for word in found:
            if word not in self.known:
                self.known[word] = self.words.entry(word)
        entries = np.fromiter((*map(self.known.__getitem__, found), BUCKETS), np.int64, len(found) + 1)
        at, bucket = entries // (BUCKETS + 1) - 1, entries % (BUCKETS + 1)
        classes = np.where(at < 0, RARE, np.where(at < OWN, at + 1, MID))
        classes[-1] = 0
        topic = np.zeros(len(entries), np.int64)
        if found:
            topic[1:] = np.cumsum(self.words.signs[bucket[:-1]], axis=0, dtype=np.float32).argmax(axis=1)
        return classes, at, topic


def contexts(classes: np.ndarray, topic: np.ndarray) -> np.ndarray:
    """(c2 * CLASSES + c1) * TOPICS + z of each token; a text starts as if after two end marks."""
    c1 = np.r_[0, classes[:-1]]
    c2 = np.r_[0, 0, classes[:-2]][: len(classes)]
    return (c2 * CLASSES + c1) * TOPICS + topic


def class_counts(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(code, n): how often a class follows a context, code = context * CLASSES + class;

    and, with codes below 0, how often a listed word comes in a topic, code = -1 - (number * TOPICS + z).
    """
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        total = np.zeros(CLASSES**3 * TOPICS, np.int32)
        listed = np.zeros(max(1, len(held.value.listed)) * TOPICS, np.int64)
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, len(b), ROWS_AT_ONCE)):
            made = [encoder.encode(words_of(t.as_py())) for t in batch.column(0)]
            if not made:
                continue
            codes = np.concatenate([contexts(c, z) * CLASSES + c for c, _, z in made])
            np.add.at(total, codes, 1)
            at, z = np.concatenate([m[1] for m in made]), np.concatenate([m[2] for m in made])
            np.add.at(listed, at[at >= 0] * TOPICS + z[at >= 0], 1)
        for counts, sign in ((total, 1), (listed, -1)):
            seen = np.flatnonzero(counts)
            for at in range(0, len(seen), FLUSH):
                some = seen[at : at + FLUSH]
                code = some if sign > 0 else -1 - some
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(counts[some].astype(np.int64))], names=["code", "n"])

    made = docs.select("text").mapInArrow(run, "code long, n long")
    return made.groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class LogBilinear:
    context: np.ndarray
    topic: np.ndarray
    first: np.ndarray
    second: np.ndarray
    third: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(unigram: np.ndarray) -> LogBilinear:
        rng = np.random.default_rng(7)
        small = lambda *shape: rng.normal(0, 0.1, shape)
        eye = np.eye(SIZE)
        bias = np.where(unigram > 0, np.log(np.where(unigram > 0, unigram, 1)), NEVER)
        return LogBilinear(small(CLASSES, SIZE), small(TOPICS, SIZE), eye * 0.7, eye * 0.3, eye * 0.7, small(CLASSES, SIZE), bias)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.topic, self.first, self.second, self.third, self.target, self.bias]

    def log_probabilities(self, context: np.ndarray) -> np.ndarray:
        """Natural logs over all classes, a row for each context, normalised."""
        z, c1, c2 = context % TOPICS, context // TOPICS % CLASSES, context // TOPICS // CLASSES
        h = self.context[c1] @ self.first.T + self.context[c2] @ self.second.T + self.topic[z] @ self.third.T
        scores = h @ self.target.T + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    def learn(self, codes: np.ndarray, n: np.ndarray, unigram: np.ndarray, seed: int) -> None:
        """Noise-contrastive steps over every token, ``n`` of each of the ascending ``codes``.

        A batch gets its part of each count, so that the batches have every token once. Noise isn't drawn: each class counts as often as it is
        expected among ``NOISE`` draws.
        """
        # the batch that gets the first token beyond equal parts
        first = np.random.default_rng(seed).integers(0, BATCHES, len(codes)).astype(np.int32)
        whole, rest = n // BATCHES, (n % BATCHES).astype(np.int32)
        contexts, start = np.unique(codes // CLASSES, return_index=True)
        of = np.repeat(np.arange(len(contexts)), np.diff(np.r_[start, len(codes)]))
        squares = [np.full_like(p, 1e-2) for p in self.parts()]
        for turn in range(BATCHES):
            place = first + np.int32(turn)
            place[place >= BATCHES] -= BATCHES
            part = whole + (place < rest)
            some = np.flatnonzero(part)
            if not len(some):
                continue
            ends = np.r_[np.searchsorted(of[some], np.arange(0, len(contexts), CONTEXTS_AT_ONCE)), len(some)]
            grads = [np.zeros_like(p) for p in self.parts()]
            for rows in (some[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True) if i < j):
                for total, g in zip(grads, self.gradients(codes[rows], part[rows], unigram), strict=True):
                    total += g
            for p, g, s in zip(self.parts(), grads, squares, strict=True):
                g = g / part.sum()
                s += g * g
                p += RATE * g / np.sqrt(s)

    def gradients(self, codes: np.ndarray, n: np.ndarray, unigram: np.ndarray) -> list[np.ndarray]:
        """Upward slopes of the noise-contrastive objective by each parameter, over ``n`` tokens of each of the ascending ``codes``."""
        context, at = np.unique(codes // CLASSES, return_inverse=True)
        z, c1, c2 = context % TOPICS, context // TOPICS % CLASSES, context // TOPICS // CLASSES
        n, noise, eye = n.astype(np.float32), (NOISE * unigram).astype(np.float32), np.eye(CLASSES, dtype=np.float32)
        tokens = np.bincount(at, n, len(context)).astype(np.float32)
        held = [p.astype(np.float32) for p in self.parts()]
        r1, r2, r3, (first, second, third, target, bias) = held[0][c1], held[0][c2], held[1][z], held[2:]
        h = r1 @ first.T + r2 @ second.T + r3 @ third.T
        odds = h @ target.T + bias - np.log(np.maximum(unigram, 1e-30) * NOISE).astype(np.float32)
        is_noise = 1 / (1 + np.exp(np.clip(odds, -30, 30)))
        up = (tokens[:, None] * noise) * (is_noise - 1)
        up[at, codes % CLASSES] += n * is_noise[at, codes % CLASSES]
        d_h = up @ target
        return [
            eye[c1].T @ (d_h @ first) + eye[c2].T @ (d_h @ second),
            eye[z, :TOPICS].T @ (d_h @ third),
            d_h.T @ r1,
            d_h.T @ r2,
            d_h.T @ r3,
            up.T @ h,
            up.sum(axis=0),
        ]


def train(counted: DataFrame, words: Vocabulary) -> LogBilinear:
    """Rounds of local steps in each shard, then the average of the shards' parameters."""
    shards = min(MOST_SHARDS, max(SHARDS, -(-words.total // SHARD_TOKENS)))
    # every shard gets its part of each count, the rest by hash, so that each sees what follows a context as all do
    of, first = F.lit(shards), F.pmod(F.xxhash64("code"), F.lit(shards))
    part = lambda i: F.floor(F.col("n") / of).cast("long") + (F.pmod(i + first, of) < F.col("n") % of).cast("long")
    each = F.filter(F.transform(F.sequence(F.lit(0), of - 1), lambda i: F.struct(i.alias("shard"), part(i).alias("n"))), lambda p: p["n"] > 0)
    parts = counted.filter("code >= 0").select("code", F.explode(each).alias("p")).select("code", "p.n", F.col("p.shard").cast("int").alias("shard"))
    triples = common.materialise(parts, "lm-contexts")
    by_class = triples.groupBy((F.col("code") % CLASSES).cast("int").alias("k")).agg(F.sum("n").alias("n")).collect()
    unigram = np.zeros(CLASSES)
    unigram[[0, RARE]] = 0.5  # these always have a word
    unigram[1 : 1 + min(OWN, len(words.listed))] = 0.5
    unigram[MID] = 0.5 * (len(words.listed) > OWN)
    for r in by_class:
        unigram[r.k] += r.n
    unigram /= unigram.sum()
    model = LogBilinear.start(unigram)
    context = triples.sparkSession.sparkContext

    def local_pass(held, turn: int):
        def run(table: pa.Table) -> pa.Table:
            codes, n = table.column("code").to_numpy(), table.column("n").to_numpy()
            order = np.argsort(codes)
            shard = table.column("shard")[0].as_py()
            own = LogBilinear(*[p.copy() for p in held.value.parts()])
            own.learn(codes[order], n[order], unigram, 1000 * turn + shard)
            raw = np.concatenate([p.ravel() for p in own.parts()]).tobytes()
            return pa.table({"shard": [shard], "weight": [float(n.sum())], "raw": [raw]})

        return run

    for turn in range(ROUNDS):
        run = local_pass(context.broadcast(model), turn)
        made = triples.groupBy("shard").applyInArrow(run, "shard long, weight double, raw binary").collect()
        if not made:
            break
        made.sort(key=lambda r: r.shard)
        weight = np.array([r.weight for r in made])
        mean = np.average(np.stack([np.frombuffer(r.raw) for r in made]), axis=0, weights=weight)
        at, parts = 0, []
        for p in model.parts():
            parts.append(mean[at : at + p.size].reshape(p.shape))
            at += p.size
        model = LogBilinear(*parts)
    return model


def in_class(counted: DataFrame, words: Vocabulary) -> np.ndarray:
    """Log10 shares of the listed words in their class, by number and topic; those with a class of their own have all of it."""
    n = len(words.listed)
    if n <= OWN:
        return np.zeros((n, TOPICS), np.float32)
    by_topic = np.zeros(n * TOPICS)
    for r in counted.filter("code < 0").collect():  # FREQUENT times TOPICS at most
        by_topic[-1 - r.code] = r.n
    by_topic = by_topic.reshape(n, TOPICS)[OWN:]
    everywhere = (words.counts[OWN:] / words.counts[OWN:].sum())[:, None]
    sums = by_topic.sum(axis=0)
    share = np.where(sums > 0, BY_TOPIC * by_topic / np.where(sums > 0, sums, 1) + (1 - BY_TOPIC) * everywhere, everywhere)
    return np.vstack([np.zeros((OWN, TOPICS)), np.log10(share)]).astype(np.float32)


def class_table(model: LogBilinear) -> np.ndarray:
    """Log10 probabilities of all classes after all contexts."""
    context = np.arange(CLASSES**2 * TOPICS)
    return np.concatenate([model.log_probabilities(c).astype(np.float32) for c in np.array_split(context, CLASSES)]) / np.float32(np.log(10))


def _scored(docs: DataFrame, words: Vocabulary, model: LogBilinear, shares: np.ndarray) -> DataFrame:
    """Per document what the broadcast tells, and its rare words as (token, n)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((words, model, shares))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, net, shares = held.value
        row = TaskContext.get().partitionId() << 40
        table = class_table(net).ravel()
        encoder = Encoder(own)
        log_counts = np.r_[np.log10(own.counts + 1), 0.0]  # -1: not listed
        shares = np.vstack([shares, np.zeros((1, TOPICS), np.float32)])
        end_part = math.log10(own.ends + 1)
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, len(b), ROWS_AT_ONCE)):
            if not len(batch):
                continue
            found = [words_of(t.as_py()) for t in batch.column(1)]
            made = [encoder.encode(w) for w in found]
            sizes = np.array([len(m[0]) for m in made])
            first = np.cumsum(sizes) - sizes
            codes = np.concatenate([contexts(c, z) * CLASSES + c for c, _, z in made])
            at, z = np.concatenate([m[1] for m in made]), np.concatenate([m[2] for m in made])
            model_part = np.add.reduceat(table[codes].astype(float) + shares[at, z], first)
            counts_part = np.add.reduceat(log_counts[at], first) + end_part
            known = np.add.reduceat((at >= 0).astype(np.int64), first) + (own.ends > 0)
            rare, times, ends = [], [], [0]
            for text, (_, number, _) in zip(found, made, strict=True):
                seen = Counter([text[i] for i in np.flatnonzero(number[:-1] < 0)])
                rare.extend(seen)
                times.extend(seen.values())
                ends.append(len(rare))
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["token", "n"])
            ids = np.arange(row, row + len(batch))
            row += len(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids), batch.column(0), pa.array(sizes), pa.array(known),
                    pa.array(counts_part), pa.array(model_part), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                ],
                names=["row", "doc_id", "n_tokens", "known", "counts_part", "model_part", "rare"],
            )

    schema = f"row long, doc_id {kind}, n_tokens long, known long, counts_part double, model_part double, rare array<struct<token:binary,n:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document."""
    training = docs.filter(~is_held_out(F.col("doc_id")))
    counts = common.materialise(word_counts(training), "lm-counts")
    words = vocabulary(counts)
    counted = common.materialise(class_counts(training, words), "lm-classes")
    model = train(counted, words)
    scored = common.materialise(_scored(docs, words, model, in_class(counted, words)), "lm-scored")
    # the rare words of all documents meet their counts
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.n")
    met = rare.join(counts.filter("pair IS NULL").select("token", "c"), "token", "left")
    seen, n = F.col("c").isNotNull(), F.col("n")
    known_share = math.log10(max(1 - words.unseen(), 1e-300) / max(1, words.rare))
    sums = met.groupBy("row").agg(
        F.sum(F.when(seen, n * F.log10(F.col("c") + 1)).otherwise(0.0)).alias("rare_part"),
        F.sum(n * F.when(seen, F.log10("c") + known_share).otherwise(F.lit(math.log10(words.unseen())))).alias("rare_model"),
        F.sum(F.when(seen, n).otherwise(0)).alias("rare_known"),
    )
    whole = scored.drop("rare").join(sums, "row", "left")
    none = F.lit(0.0)
    smooth = F.lit(float(np.log10(words.total + words.distinct + 1)))
    return whole.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("counts_part") + F.coalesce("rare_part", none) - F.col("n_tokens") * smooth).alias("base_score"),
        (F.col("model_part") + F.coalesce("rare_model", none)).alias("score"),
    )
