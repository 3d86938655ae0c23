"""Near-duplicate groups by SimHash and a Gray-order hierarchical index.

A document's fingerprint has 64 bits: bit b is 1 if it is set in over half the
hashes of the document's word shingles (repeats count). Documents whose
fingerprints differ in at most ``bits`` bits are linked, and linked documents
form groups.

Finding the links takes two steps. Fingerprints that differ in 3 bits or fewer
agree on at least one of 4 blocks of 16 bits (5 bits: 6 blocks), so each distinct
fingerprint is dealt to 4 groups by the value of a block; a group that is still
too large is dealt again by blocks of the bits not yet fixed, and so on; one that more bits don't
split, as its members are all near to each other, is cut to parts, of which any two meet in a task. That
loses no link and bounds every group. Inside a task the members of a group are sorted by
Gray rank, so that neighbours share bits, and a tree is built over them: a node
holds the bits on which all its members agree, and children only the bits that
their parent does not hold. A query runs down the tree adding up differences and
leaves a whole node as soon as they exceed the limit. Each task joins its links
to a forest; a distributed star contraction joins the forests.

``deduplicate`` keeps one document of each group of near-copies. It collapses equal
texts, finds candidates with the same index over fingerprints of distinct words
(nearest at the similarity asked for), each link confirmed by a second fingerprint,
and verifies them on five-word shingles.

Edge cases: null and empty texts have fingerprint zero and are linked with each
other like any other; texts with fewer words than a shingle are one shingle; a
null doc_id never names a group unless nothing else is in it; rows that share a
doc_id each get a row; a text of any length is one value in one task; an empty table
gives an empty result; other columns are ignored. ``deduplicate``: equal texts, null
ones and those without words included, are copies whatever their ids, texts without
words are no near-copies of others; of rows equal in doc_id and text the least by its
other columns stays; column names that start with two underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
BITS = 3
#: Near-copies share that part of their shingles of so many words.
SIMILARITY = 0.8
SHINGLE = 5
#: Members of a group beyond which it is dealt again.
GROUP_LIMIT = 2048
#: Children of a tree node, and pairs of query and member looked at in one go.
FANOUT = 8
#: Dealt codes that one task takes, about.
ROWS_PER_TASK = 100_000
#: Rows of a table of ids up to which it is broadcast rather than texts shuffled.
MAX_BROADCAST_ROWS = 500_000
PAIRS_AT_ONCE = 1_000_000
HASHES_AT_ONCE = 1 << 16
#: Bits that may differ between near-copies in the fingerprint of their words, and in the second one.
WORD_BITS = 7
SECOND_BITS = 10
#: Words whose hashes a task remembers.
REMEMBERED = 100_000
ALL_BITS = (1 << 64) - 1


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    found = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    size = min(words, len(found))
    count = len(found) - size + 1
    totals = np.zeros(64, np.int64)
    for at in range(0, count, HASHES_AT_ONCE):
        cut = slice(at, min(at + HASHES_AT_ONCE, count))
        last = slice(cut.start + size - 1, cut.stop + size - 1)
        hashes = np.fromiter(
            (digest(joined[a : b - 1], SEED) for a, b in zip(starts[cut], ends[last], strict=True)),
            np.uint64,
            cut.stop - cut.start,
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(totals * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Where each code stands in the Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def contract(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the given links."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
    return label


class GrayIndex:
    """A tree over codes that are dealt to groups; only members of a group are compared.

    ``group`` must be non-decreasing and ``codes`` in Gray order inside a group.
    Level 0 has the codes; a node of a higher level has up to FANOUT nodes of
    one group below it.
    """

    def __init__(self, group: np.ndarray, codes: np.ndarray, second: np.ndarray | None = None):
        self.codes = codes
        #: Codes that must be near as well.
        self.second = second
        n = len(codes)
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.sizes = np.diff(np.r_[head, n])
        self.group_of = np.repeat(np.arange(len(head)), self.sizes)
        both, either = codes, codes
        owner = self.group_of
        self.known = [np.full(n, ALL_BITS, np.uint64)]
        self.pattern = [codes]
        self.first_child: list[np.ndarray] = []
        while len(owner) > len(head):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
            nodes = np.flatnonzero(place % FANOUT == 0)
            both = np.bitwise_and.reduceat(both, nodes)
            either = np.bitwise_or.reduceat(either, nodes)
            owner = owner[nodes]
            known = ~(both ^ either)
            self.first_child.append(np.r_[nodes, len(self.pattern[-1])])
            self.known.append(known)
            self.pattern.append(both & known)

    def links(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that join all codes within ``bits`` of each other, as a forest of indices."""
        lefts, rights = [], []
        cost = np.cumsum(self.sizes[self.group_of])
        at = 0
        while at < len(self.codes):
            done = cost[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(cost, done + PAIRS_AT_ONCE, side="right")))
            left, right = self._search(np.arange(at, stop), bits)
            nodes, inverse = np.unique(np.r_[left, right], return_inverse=True)
            label = contract(len(nodes), inverse[: len(left)], inverse[len(left) :])
            lefts.append(nodes)
            rights.append(nodes[label] if len(nodes) else nodes)
            at = stop
        left = np.concatenate(lefts) if lefts else np.zeros(0, np.int64)
        right = np.concatenate(rights) if rights else left
        label = contract(len(self.codes), left, right)
        child = np.flatnonzero(label != np.arange(len(label)))
        return child, label[child]

    def _search(self, query: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        node = self.group_of[query]
        above = self.known[-1][node]
        apart = np.bitwise_count((self.codes[query] ^ self.pattern[-1][node]) & above)
        for level in range(len(self.first_child) - 1, -1, -1):
            first = self.first_child[level]
            count = first[node + 1] - first[node]
            query, apart, above = (np.repeat(x, count) for x in (query, apart, above))
            inside = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
            node = np.repeat(first[node], count) + inside
            own = self.known[level][node]
            apart = apart + np.bitwise_count((self.codes[query] ^ self.pattern[level][node]) & own & ~above)
            near = apart <= bits
            query, node, apart, above = query[near], node[near], apart[near], own[near]
        later = node > query
        if self.second is not None:
            later &= np.bitwise_count(self.second[query] ^ self.second[node]) <= SECOND_BITS
        return query[later], node[later]


def _split_bits(mask: int, bits: int) -> list[int]:
    """``mask`` extended by each of ``bits`` + 1 blocks of the bits it lacks."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(i * len(free) / (bits + 1)) for i in range(bits + 2)]
    return [mask | sum(1 << b for b in free[cuts[i] : cuts[i + 1]]) for i in range(bits + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _tiled(stuck: DataFrame, limit: int, own: list[str]) -> DataFrame:
    """Members of groups that more bits don't split, dealt to tiles that hold two parts each.

    A part has half of ``limit`` members, and any two parts meet in one tile, so no pair is lost; a member comes once for each other part.
    """
    parts = F.ceil(F.col("n") / (limit / 2)).cast("int")
    cut = stuck.withColumn("parts", F.greatest(parts, F.lit(2))).withColumn("part", F.pmod(F.xxhash64(*own), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("part"))
    met = cut.select("mask", "value", *own, "part", "parts", F.explode(others).alias("other"))
    tile = F.least("part", "other").cast("long") * F.col("parts") + F.greatest("part", "other") + 1
    return met.select("mask", "value", tile.alias("tile"), *own)


def deal(codes: DataFrame, bits: int = BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """(mask, value, tile) and the columns of ``codes``: the groups in which links are looked for.

    A group that is too large is dealt again by more bits as long as that pays: each member goes to ``bits`` + 1
    groups, so those must be smaller by as much. Where they aren't, as codes are equal or all near to each other (one page's
    many variants), the group is cut to tiles instead. So the rows of a round are no more than those before, and rounds end.
    """
    spark, own, fan = codes.sparkSession, codes.columns, bits + 1
    top = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(_signed(m)).alias("value")) for m in _split_bits(0, bits)])
    size = F.lit(codes.count()).cast("long")
    open_groups = codes.select(*own, F.explode(top).alias("g")).select("g.mask", "g.value", size.alias("was"), *own)
    masks, settled = _split_bits(0, bits), None
    while True:
        open_groups = common.materialise(open_groups, "simhash-groups")
        large = open_groups.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"), F.max("was").alias("__was")).filter(F.col("n") > limit)
        large = common.materialise(large.select("mask", "value", "n", (F.col("n") * fan > F.col("__was")).alias("stuck")), "simhash-large")
        none = large.isEmpty()
        whole = open_groups if none else open_groups.join(large, ["mask", "value"], "left_anti")
        small = whole.select("mask", "value", F.lit(0).cast("long").alias("tile"), *own)
        settled = small if settled is None else settled.unionByName(small)
        if none:
            return settled
        held = open_groups.join(large, ["mask", "value"])
        settled = settled.unionByName(_tiled(held.filter("stuck"), limit, own))
        finer = [(_signed(m), _signed(x)) for m in set(masks) for x in _split_bits(m, bits)]
        masks = [x & ALL_BITS for _, x in finer]
        children = F.broadcast(spark.createDataFrame(finer, "mask long, child long"))
        open_groups = (
            held.filter("NOT stuck")
            .join(children, "mask")
            .select(F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("value"), F.col("n").alias("was"), *own)
        )


def links(codes: DataFrame, bits: int = BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """(u, v), u > v: enough links between distinct codes to join each group.

    ``codes`` has fp, or fp, a second code and the number of the node they stand for;
    links name nodes, or else the codes themselves.
    """
    paired = len(codes.columns) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        mask, value, tile, code = (rows.column(i).to_numpy().view(np.uint64) for i in range(4))
        order = np.lexsort((gray_rank(code), tile, value, mask))
        mask, value, tile, code = mask[order], value[order], tile[order], code[order]
        group = np.cumsum(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]) | (tile[1:] != tile[:-1])])
        second = rows.column(4).to_numpy().view(np.uint64)[order] if paired else None
        names = rows.column(5).to_numpy()[order] if paired else code.view(np.int64)
        child, root = GrayIndex(group, code, second).links(bits)
        a, b = names[child], names[root]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"]
        )

    dealt = deal(codes, bits, limit)
    parts = common.partitions(dealt.count(), ROWS_PER_TASK, codes.sparkSession)
    return dealt.repartition(parts, "mask", "value", "tile").mapInArrow(run, "u long, v long").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (u, v), for nodes with edges.

    Alternates the two star operations of Kiveris et al. (2014): hang larger
    neighbours on the smallest one, then all smaller ones with oneself. Every
    round is written to the shared folder.
    """
    edges = common.materialise(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        larger = edges.join(low, edges.v == low.c).select("u", F.col("m").alias("v")).filter("u <> v").distinct()
        larger = common.materialise(larger, "large-star")
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        smaller = larger.join(least, "u").select(F.explode(pair).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = common.materialise(smaller, "small-star")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def groups(docs: DataFrame, words: int = 3, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every document."""
    prints = common.materialise(fingerprints(docs, words), "fingerprints")
    per_print = common.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(per_print.select("fp"), bits))
    rooted = common.materialise(
        per_print.join(roots, per_print.fp == roots.node, "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    least = common.materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component")
    named = common.materialise(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def word_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp, second): two fingerprints of the distinct words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        known: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            out = np.zeros((len(batch), 2), np.uint64)
            for i, text in enumerate(batch.column(2)):
                found = set((text.as_py() or "").encode().lower().split())
                if not found:
                    continue
                if len(known) > REMEMBERED:
                    known.clear()
                for w in found:
                    if w not in known:
                        known[w] = digest(w, SEED), digest(w, SEED + 1)
                hashes = np.array([known[w] for w in found], "<u8")
                totals = np.zeros(128, np.int64)
                for at in range(0, len(hashes), HASHES_AT_ONCE):
                    raw = hashes[at : at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 16)
                    totals += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[i] = np.packbits(totals * 2 > len(hashes), bitorder="little").view("<u8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out[:, 0].view(np.int64)), pa.array(out[:, 1].view(np.int64))],
                names=["doc_id", "digest", "fp", "second"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", _digest().alias("digest"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, digest binary, fp long, second long")


def _digest() -> Column:
    return F.coalesce(F.unhex(F.md5("text")), F.lit(b""))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _shingle_hashes(text: Column) -> Column:
    """Distinct hashes of the five-word shingles of a text; fewer words are one shingle.

    The words are the variable of a function, so that they are cut once and not for each shingle.
    """

    def hashes(words: Column) -> Column:
        n = F.least(F.size(words), F.lit(SHINGLE))
        starts = F.when(n > 0, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, n))))

    return F.element_at(F.transform(F.array(_words(text)), hashes), 1)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) of texts that share so many shingles."""
    left = sets.select(F.col("t").alias("u"), F.col("a"))
    right = sets.select(F.col("t").alias("v"), F.col("a").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    enough = (shared > 0) & (shared >= similarity * (F.size("a") + F.size("b") - shared) - 1e-9)
    return pairs.join(left, "u").join(right, "v").filter(enough).select("u", "v")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(t, comp, n, apart, h, pos): the rarest shingles of each text that others of its component have too.

    ``pos`` counts from 1 in the order of rarity, ``apart`` is the share of shingles of no other
    text. Similar texts share one of the first n - similarity * n + 1 shingles.
    """
    each = sets.select("t", "comp", F.size("a").alias("n"), F.explode("a").alias("h"))
    often = each.groupBy("comp", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    rare = F.array_sort(F.collect_list(F.struct("c", "h")))
    held = each.join(often, ["comp", "h"]).groupBy("t", "comp", "n").agg(rare.alias("s"))
    own = F.col("n") - F.size("s")
    first = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9).cast("int") + 1 - own
    cut = held.withColumn("first", first).filter("first > 0").select(
        "t", "comp", "n", own.alias("own"), (own / F.col("n")).alias("apart"), F.posexplode(F.slice("s", 1, F.col("first")))
    )
    return cut.select("t", "comp", "n", "apart", F.col("col.h").alias("h"), (F.col("own") + F.col("pos") + 1).alias("pos"))


def similar_links(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v), u > v: links that join all texts of a component that are so similar.

    ``sets`` has (t, comp, a): the number of a text, its component, its distinct shingles. Only
    texts that share a rare shingle (see ``_prefixes``) are compared: first each with the head of
    the shingle's texts, the one with the fewest shingles of its own, as the source of many copies
    is; then all that are not joined by now and whose places of the shingle leave room for enough
    others. The shorter text of such a pair has it among its first n - 2s / (1 + s) n + 1. No
    similar pair of different labels is left out.
    """
    entries = common.materialise(_prefixes(sets, similarity), "prefixes")
    both = 2 * similarity / (1 + similarity)

    def room(n: str, pos: str, m: str, other: str) -> Column:
        """Whether texts of n and m shingles that first share those at these places can share enough."""
        left = 1 + F.least(F.col(n) - F.col(pos), F.col(m) - F.col(other))
        return left >= both / 2 * (F.col(n) + F.col(m)) - 1e-9

    head = F.min(F.struct("apart", "t", "n", "pos")).alias("head")
    heads = entries.groupBy("comp", "h").agg(head, F.count(F.lit(1)).alias("c")).filter("c > 1")
    heads = heads.select("comp", "h", F.col("head.t").alias("v"), F.col("head.n").alias("m"), F.col("head.pos").alias("at"))
    near = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9
    to_heads = entries.join(heads, ["comp", "h"]).filter((F.col("t") != F.col("v")) & near & room("n", "pos", "m", "at"))
    to_heads = to_heads.select(F.greatest("t", "v").alias("u"), F.least("t", "v").alias("v")).distinct()
    joined = common.materialise(_similar(to_heads, sets, similarity), "to-heads")
    label = components(joined).select(F.col("node").alias("t"), F.col("root").alias("label"))
    entries = entries.drop("apart").join(label, "t", "left").withColumn("label", F.coalesce("label", "t"))
    entries = common.materialise(entries, "labelled")
    several = entries.groupBy("comp", "h").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b")
    open_ones = common.materialise(entries.join(several.select("comp", "h"), ["comp", "h"]), "open-buckets")
    short = open_ones.filter(F.col("pos") <= F.col("n") - F.ceil(both * F.col("n") - 1e-9) + 1)
    short = short.select("comp", "h", F.col("t").alias("x"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("label").alias("own"))
    longer = (F.col("n") > F.col("m")) | (F.col("n") == F.col("m")) & (F.col("t") > F.col("x"))
    on = (F.col("label") != F.col("own")) & longer & (F.col("m") >= similarity * F.col("n") - 1e-9) & room("n", "pos", "m", "at")
    pairs = open_ones.alias("l").join(short.alias("r"), (F.col("l.comp") == F.col("r.comp")) & (F.col("l.h") == F.col("r.h")) & on)
    pairs = pairs.select(F.greatest("t", "x").alias("u"), F.least("t", "x").alias("v")).distinct()
    return joined.unionByName(_similar(pairs, sets, similarity)).distinct()


def copies(docs: DataFrame, bits: int = WORD_BITS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of the texts that repeat another one, and of the rows that occur several times.

    Of equal texts the one of the smallest id stays, and so of texts that are linked: those near
    in both fingerprints, directly or through others, that share so many five-word shingles.
    """
    prints = common.materialise(word_prints(docs), "word-prints")
    texts = prints.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("second").alias("second"), F.count(F.lit(1)).alias("n")
    )
    texts = common.materialise(texts.withColumn("t", F.monotonically_increasing_id()), "texts")
    codes = common.materialise(texts.groupBy("fp", "second").agg(F.min("t").alias("node"), F.count(F.lit(1)).alias("n")), "codes")
    roots = components(links(codes.select("fp", "second", "node"), bits))
    placed = codes.join(roots, "node", "left").select("fp", "second", "n", F.coalesce("root", "node").alias("comp"))
    placed = common.materialise(placed, "placed")
    several = placed.groupBy("comp").agg(F.sum("n").alias("n")).filter("n > 1").select("comp")
    candidates = texts.join(placed.join(several, "comp").select("fp", "second", "comp"), ["fp", "second"])
    candidates, _ = common.small_side(candidates.select("t", "comp", "doc_id", "digest"), MAX_BROADCAST_ROWS, "candidates")
    named = docs.select(F.col("doc_id").alias("__id"), _digest().alias("__digest"), "text")
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__digest") == F.col("digest"))
    sets = named.join(candidates, same).select("t", "comp", _shingle_hashes(F.col("text")).alias("a"))
    sets = common.materialise(sets.groupBy("t", "comp").agg(F.first("a").alias("a")), "shingles")
    linked = common.materialise(components(similar_links(sets, similarity)), "linked")
    linked = linked.unionByName(linked.select(F.col("root").alias("node"), "root")).distinct()
    members = linked.join(texts.select(F.col("t").alias("node"), "doc_id", "digest"), "node")
    members = common.materialise(members, "members")
    stays = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "node")).alias("s"))
    near = members.join(stays, "root").filter("node <> s.node").select("digest")
    repeated = texts.filter("n > 1").select("digest", F.col("doc_id").alias("first"))
    equal = prints.select("doc_id", "digest").join(repeated, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    equal = equal.select("doc_id", "digest")
    gone = equal.unionByName(texts.join(near, "digest").select("doc_id", "digest")).distinct()
    several = prints.join(repeated.drop("first"), "digest", "left_semi").groupBy("doc_id", "digest").count()
    return gone, several.filter("count > 1").select("doc_id", "digest")


def deduplicate(docs: DataFrame, bits: int = WORD_BITS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without those that repeat one of a smaller id."""
    gone, several = (
        common.small_side(x.select(F.col("doc_id").alias("__copy"), F.col("digest").alias("__of")), MAX_BROADCAST_ROWS, tag)
        for x, tag in zip(copies(docs, bits, similarity), ("gone", "several"), strict=True)
    )
    same = F.col("doc_id").eqNullSafe(F.col("__copy")) & (_digest() == F.col("__of"))
    kept = docs.join(gone[0], same, "left_anti")
    if not several[1]:
        return kept
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = kept.join(several[0], same, "left_semi").groupBy("doc_id", _digest().alias("__of"))
    once = once.agg(F.first("text").alias("text"), F.min(F.struct(*rest)).alias("__rest") if rest else F.lit(0).alias("__rest"))
    once = once.select("doc_id", "text", *[F.col(f"__rest.{c}").alias(c) for c in rest])
    return kept.join(several[0], same, "left_anti").unionByName(once)
