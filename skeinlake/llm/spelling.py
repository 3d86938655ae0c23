"""Spelling variants: words at one edit, found with a bit-sliced position index.

Words are counted in the JVM. The index of a block of words has one bit set for every (position, letter): the words
that have this letter there, 64 words to a machine word. A query's letters are read from left to right, and recurrences
move four such sets along together, each for all words of the block at once:

    none   = none & at(i)                                    no error so far
    changed = changed & at(i) | none & ~at(i)                one letter replaced
    longer  = (longer | none) & at(i + 1)                    the word has a letter more, so positions shift by one
    shorter = shorter & at(i - 1) | none                     the word has a letter less

where at(p) is the set of (p, the query's letter i). What is left at the query's end, cut to the words of the right
length, are its near words. Queries of one length walk together, as rows of a matrix.

Blocks hold words that can be near. Of two words at one edit the shorter one, of s letters, begins or ends with the same
s // 2 letters as the other. So each word goes to four groups: for s its own length and one less, by
beginning and by end. Pairs that share both are left to the beginnings, so each pair is found once in each direction. Groups
that are small share a block; of a group of more than ``HOT`` words, parts are dealt to tasks of their own and
every word of the group asks each part, so that no task holds it whole and nothing is left out. A query's answers in a block are summed
up there (how many, and the best one), so pairs are never emitted.

Forms point to words of at least twice the count, so following them ends; roots are found by doubling the pointers.

Edge cases: a null text holds no words; a null id counts as an empty string in the rule that deletes letters; repeated rows count
each. Words of any length take part. Ties go to the word that comes first in code-point order. An
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed by the contract: letters of a word, what is lower-cased, and the rule that deletes a letter.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELETE_EVERY = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form has so many times the count of its word.
FORM_TIMES = 2
#: Words of a block, more or less; groups of more words than HOT are dealt out in parts of about HOT.
BLOCK = 2048
HOT = 8192
#: Queries that walk together, and bytes of an index that are kept rather than made anew for each walk.
TILE = 512
KEPT_BYTES = 64 << 20


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all whole texts after the rule that deletes letters, counted."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run")
    runs = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("of"), run)
    lowered = runs.select("of", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    # a deletion can't make a word longer
    long = lowered.filter(F.length("run") >= LEAST_LENGTH)
    h = F.crc32(F.encode(F.concat("of", F.lit(":"), "run"), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % DELETE_EVERY == 0, cut).otherwise(F.col("run")).alias("word")
    counts = long.select(word).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def _halves(word: Column) -> Column:
    """The four groups of a word: (s, side, half)."""
    size = F.length(word)

    def one(less: int, side: int) -> Column:
        s = size - less
        h = F.floor(s / 2).cast("int")
        half = F.substring(word, F.lit(1), h) if side == 0 else F.substring(word, size - h + 1, h)
        return F.struct(s.alias("s"), F.lit(side).alias("side"), F.xxhash64(s, F.lit(side), half).alias("key"))

    return F.array(*[one(less, side) for less in (0, 1) for side in (0, 1)])


def dealt(vocabulary: DataFrame) -> DataFrame:
    """(s, side, key, part, held, asks, word, n): words as members of an index and as queries."""
    spread = vocabulary.select("word", "n", F.explode(_halves(F.col("word"))).alias("g")).select("word", "n", "g.*")
    sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > HOT)
    # one row for HOT words and more
    hot = common.materialise(sizes.select("key", F.ceil(F.col("size") / HOT).cast("int").alias("parts")), "spelling-hot")
    side = F.broadcast(hot) if hot.count() <= 100_000 else hot
    known = spread.join(side, "key", "left")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    yes, no = F.lit(True), F.lit(False)
    roles = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("part"), yes.alias("held"), yes.alias("asks")))).otherwise(
        F.concat(
            F.array(F.struct(own.alias("part"), yes.alias("held"), no.alias("asks"))),
            F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda p: F.struct(p.alias("part"), no.alias("held"), yes.alias("asks"))),
        )
    )
    return known.select("s", "side", "key", F.explode(roles).alias("r"), "word", "n").select("s", "side", "key", "r.*", "word", "n")


class Index:
    """Bits of (position, letter) over a block of words, which are numbered from the largest count down, ties in code-point order."""

    def __init__(self, words: list[str], counts: list[int], units: list[tuple]):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words, self.counts = [words[i] for i in order], [counts[i] for i in order]
        self.length = max(map(len, words))
        self.letters = {c: k for k, c in enumerate(sorted(set("".join(words))))}
        codes = np.full((len(words), self.length), len(self.letters), np.int16)
        for row, w in zip(codes, self.words):
            row[: len(w)] = [self.letters[c] for c in w]
        self.codes = codes
        self.width = -(-len(words) // 64)
        sizes = np.array([len(w) for w in self.words])
        self.of_length = {int(m): self._bits((sizes == m)[None])[0] for m in np.unique(sizes)}
        self.unit = self._sets([units[i] for i in order])
        self.begun = self._sets([_begin(w, units[i]) for w, i in zip(self.words, order)])
        self.kept: dict[int, np.ndarray] = {}

    def _bits(self, rows: np.ndarray) -> np.ndarray:
        packed = np.packbits(rows, axis=1, bitorder="little")
        out = np.zeros((len(rows), self.width * 8), np.uint8)
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def _sets(self, names: list) -> dict:
        """The set of words of each name; one set of none for others."""
        known = {x: k for k, x in enumerate(dict.fromkeys(names))}
        ids = np.array([known[x] for x in names])
        found = np.zeros((len(known) + 1, self.width), np.uint64)
        for a in range(0, len(known), 256):
            some = np.arange(a, min(a + 256, len(known)))
            found[some] = self._bits(ids[None] == some[:, None])
        return {"known": known, "bits": found}

    @staticmethod
    def _named(sets: dict, names: list) -> np.ndarray:
        return sets["bits"][[sets["known"].get(x, -1) for x in names]]

    def at(self, position: int) -> np.ndarray:
        """A row of bits for each letter, and a last one without any, for letters that no word has."""
        found = self.kept.get(position)
        if found is None:
            if 0 <= position < self.length:
                rows = np.zeros((len(self.letters) + 1, len(self.words)), bool)
                rows[self.codes[:, position], np.arange(len(self.words))] = True
                rows[-1] = False
                found = self._bits(rows)
            else:
                found = np.zeros((len(self.letters) + 1, self.width), np.uint64)
            if (len(self.kept) + 1) * found.nbytes <= KEPT_BYTES:
                self.kept[position] = found
        return found

    def near(self, queries: list[str], units: list[tuple]) -> np.ndarray:
        """Bits of the words near to each of some queries of one length."""
        m = len(queries[0])
        letters = np.array([[self.letters.get(c, len(self.letters)) for c in q] for q in queries])
        all_bits = self._bits(np.ones((1, len(self.words)), bool))
        none = np.repeat(all_bits, len(queries), axis=0)
        changed, longer, shorter = (np.zeros_like(none) for _ in range(3))
        for i in range(m):
            here, behind, before = (self.at(p)[letters[:, i]] for p in (i, i + 1, i - 1))
            longer = (longer | none) & behind
            shorter = (shorter & before) | none
            changed = (changed & here) | (none & ~here)
            none &= here
        lengths = lambda n: self.of_length.get(n, np.zeros(self.width, np.uint64))
        # words of the longer length meet each other in the groups of that length
        short = np.array([u[0] == m for u in units])[:, None]
        longer |= none
        found = np.where(short, (changed & lengths(m)) | (longer & lengths(m + 1)), shorter & lengths(m - 1))
        found &= self._named(self.unit, units)
        ends = np.array([u[1] == 1 for u in units])
        if ends.any():
            twice = self._named(self.begun, [_begin(q, u) for q, u in zip(queries, units)])
            found &= ~np.where(ends[:, None], twice, np.uint64(0))
        return found


def _unit(word: str, s: int, side: int, part: int) -> tuple:
    h = s // 2
    return s, side, word[:h] if side == 0 else word[len(word) - h :], part


def _begin(word: str, unit: tuple) -> tuple:
    return unit, word[: unit[0] // 2]


def first_bits(rows: np.ndarray) -> np.ndarray:
    """The number of the first bit of each row that has any."""
    word = (rows != 0).argmax(axis=1)
    value = rows[np.arange(len(rows)), word]
    low = value & (~value + np.uint64(1))
    return word * 64 + np.bitwise_count(low - np.uint64(1)).astype(np.int64)


def _answers(index: Index, queries: list[tuple[str, tuple]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, n_near, best count, best word) of the queries that have near words in a block."""
    by_length: dict[int, list] = {}
    for q in queries:
        by_length.setdefault(len(q[0]), []).append(q)
    for some in by_length.values():
        for a in range(0, len(some), TILE):
            tile = some[a : a + TILE]
            found = index.near([q for q, _ in tile], [u for _, u in tile])
            n = np.bitwise_count(found).sum(axis=1)
            for j, b in zip(np.flatnonzero(n).tolist(), first_bits(found[n > 0]).tolist()):
                yield tile[j][0], int(n[j]), index.counts[b], index.words[b]


FOUND = "word string, n_near long, best_n long, best string"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by unit, those that an index holds first."""
    held: list[tuple] = []
    asks: list[tuple] = []
    out: list[tuple] = []
    index: list[Index] = []

    def answer() -> None:
        if held and asks:
            if not index:
                index.append(Index(*map(list, zip(*held))))
            out.extend(_answers(index[0], asks))
        asks.clear()

    def batch() -> pa.RecordBatch:
        made = pa.table({c: [r[k] for r in out] for k, c in enumerate(("word", "n_near", "best_n", "best"))}, schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]))
        out.clear()
        return made.combine_chunks().to_batches()[0]

    last = None
    for rows in batches:
        columns = [rows.column(c).to_pylist() for c in ("s", "side", "key", "part", "held", "asks", "word", "n")]
        for s, side, key, part, holds, asking, word, n in zip(*columns):
            if (key, part) != last:
                last = key, part
                if len(held) >= BLOCK or index:  # an index that is made takes no more words
                    answer()
                    held.clear(), index.clear()
            if len(asks) >= 2 * BLOCK and not holds:
                answer()
            unit = _unit(word, s, side, part)
            if holds:
                held.append((word, n, unit))
            if asking:
                asks.append((word, unit))
            if len(out) >= 4096:
                yield batch()
    answer()
    if out:
        yield batch()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): of words that have any near word, their number and the best."""
    spark = vocabulary.sparkSession
    rows = dealt(vocabulary)
    order = ["s", "side", "key", "part", "asks"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows that are held come before those that only ask: false sorts first in both kinds of unit
    sorted_rows = rows.repartition(tasks, "s", "side", "key", "part").sortWithinPartitions(*order)
    found = sorted_rows.mapInArrow(_search, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return summed.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    vocabulary = common.materialise(words(docs), "spelling-words")
    near = near_words(vocabulary)
    is_form = F.col("best_n") >= FORM_TIMES * F.col("n")
    known = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    known = common.materialise(known, "spelling-forms")
    ends = roots(known)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "form", "word").alias("root"), "n", "n_near", "form_n")


def roots(known: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by doubling: each step looks twice as far, so few are needed."""
    links = known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        links = common.materialise(links, "spelling-roots")
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = common.materialise(moved, "spelling-moved")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")
