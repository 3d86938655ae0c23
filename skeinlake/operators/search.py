"""Ranked and literal search over messages.

``bm25`` scans the documents, cutting each text once; ``operators/textindex.py`` keeps postings
that follow their documents. Query and text are cut by one rule: case and diacritics are
folded, code and path atoms stay whole, and words are stemmed. Phrases are ranked as units.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions import porter
from skeinlake.functions.text import WHITE
from skeinlake.operators.graph import checkpoint

#: Fixed value: what a term is made of, besides letters and digits.
TERM = r"[\p{L}\p{N}_+./-]+"
#: Letters of the Latin blocks and what is left of them without diacritics; marks that stand alone go.
ACCENTED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
FOLDED = {a: b for a, b in ACCENTED if a != b and a == a.lower()}
MARKS = "".join(map(chr, range(0x300, 0x370)))
K1 = 1.2
B = 0.75
#: How stems of a query may be written, by stem; a stem that isn't named is found in all its forms.
Forms = Mapping[str, Sequence[str]]
#: The weight of a term that more than half of the documents hold.
FLOOR_IDF = 1e-6


class InvalidQuery(ValueError):
    """The query text or cursor can't be used; the caller can try another."""


def atoms(text: str) -> list[str]:
    """The atoms of a literal query: whitespace-bounded words and balanced "..." phrases."""
    found = [m[1].strip() if m[1] is not None else m[0] for m in re.finditer(r'(?<!\S)"([^"]+)"(?!\S)|\S+', text)]
    found = [a for a in found if a]
    if not found:
        raise InvalidQuery("Search query must not be blank")
    return found


def fold(text: str) -> str:
    return text.lower().translate(str.maketrans(FOLDED) | dict.fromkeys(map(ord, MARKS)))


def terms_of(atom: str) -> list[str]:
    """The terms of a query's atom, cut as texts are."""
    return ["".join(run) for run in _runs(fold(atom))]


def stems_of(wanted: Sequence[str]) -> list[tuple[str, ...]]:
    """The distinct phrases of a query as stems; an atom without terms is left out."""
    found = [p for p in dict.fromkeys(tuple(map(porter.stem, terms_of(a))) for a in wanted) if p]
    if not found:
        raise InvalidQuery("Search query has no searchable text")
    return found


def _runs(text: str) -> list[list[str]]:
    runs: list[list[str]] = []
    inside = False
    for c in text:
        belongs = c in "_+./-" or unicodedata.category(c)[0] in "LN"
        if belongs and inside:
            runs[-1].append(c)
        elif belongs:
            runs.append([c])
        inside = belongs
    return runs


def terms(text: Column) -> Column:
    plain = F.translate(F.lower(text), "".join(FOLDED) + MARKS, "".join(FOLDED.values()))
    return F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))


def stems(text: Column, forms: Forms | None = None) -> Column:
    """The terms of a text as stems, in their places; empty where a stem of ``forms`` is written in another way."""
    return porter.stemmed(terms(text), forms)


def _counted(text: Column, wanted: Sequence[Sequence[str]], forms: Forms | None = None) -> Column:
    """struct(dl, tf0, tf1 ...): terms of the text, and how often it holds each sequence of stems.

    The terms are the variable of a function, so that they are cut once.
    """

    def count(t: Column, phrase: Sequence[str]) -> Column:
        if len(phrase) == 1:
            return F.size(F.filter(t, lambda x: x == phrase[0]))
        last = F.size(t) - (len(phrase) - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))

        def here(i: Column) -> Column:
            found = F.element_at(t, i) == phrase[0]
            for k in range(1, len(phrase)):
                found = found & (F.element_at(t, i + k) == phrase[k])
            return found

        return F.size(F.filter(starts, here))

    def all_counts(t: Column) -> Column:
        return F.struct(F.size(t).alias("dl"), *[count(t, w).alias(f"tf{i}") for i, w in enumerate(wanted)])

    return F.element_at(F.transform(F.array(stems(text, forms)), all_counts), 1)


def documents(msgs: DataFrame) -> DataFrame:
    """Messages that can be found: dialogue with text that isn't blank."""
    return msgs.filter(F.col("side").isNotNull() & (F.btrim("text", F.lit(WHITE)) != ""))


def united(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """(session_id, ordinal, scope, text): dialogue and the titles of sessions as one set of documents, to be ranked by one law.

    ``docs`` are ``documents``; ``titles`` has session_id and title, those that are blank are left out. A title has ordinal -1. Weights of terms
    come from both scopes, so scores of the two can be compared.
    """
    named = titles.filter(F.btrim("title", F.lit(WHITE)) != "")
    said = docs.select("session_id", F.col("ordinal").cast("long").alias("ordinal"), F.lit("dialogue").alias("scope"), "text")
    return said.unionByName(named.select("session_id", F.lit(-1).cast("long").alias("ordinal"), F.lit("title").alias("scope"), F.col("title").alias("text")))


def in_scope(scored: DataFrame, scope: str | None = None) -> DataFrame:
    """Of scored ``united`` documents those of one scope: dialogue or title; of both without one. Adds ``scope``.

    A title by itself makes no message a hit.
    """
    told = scored.withColumn("scope", F.when(F.col("ordinal") < 0, "title").otherwise("dialogue"))
    return told if scope is None else told.filter(F.col("scope") == scope)


def postings(docs: DataFrame) -> DataFrame:
    """(session_id, ordinal, term, tf, positions, dl) of every document, terms as they are written."""
    return listed_postings(docs.select("session_id", "ordinal", terms(F.col("text")).alias("__t")))


def listed_postings(listed: DataFrame) -> DataFrame:
    """Postings of documents whose terms are listed in ``__t``."""
    each = listed.select("session_id", "ordinal", F.size("__t").alias("dl"), F.posexplode("__t").alias("pos", "term"))
    return each.groupBy("session_id", "ordinal", "term", "dl").agg(
        F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions")
    )


def index_stats(post: DataFrame) -> DataFrame:
    """(term, df, cf): documents with the term, and occurrences."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def bm25(docs: DataFrame, wanted: Sequence[str], forms: Forms | None = None) -> DataFrame:
    """(session_id, ordinal, score) of documents that hold all atoms of the query; lower is better.

    An atom of several terms is a phrase and counts where they stand side by side. Words are found by their stems; ``forms``
    narrows a stem to the forms that are meant.
    """
    phrases = stems_of(wanted)
    held = docs.select("session_id", "ordinal", _counted(F.col("text"), phrases, forms).alias("__c")).select("session_id", "ordinal", "__c.*")
    held = checkpoint(held)  # ids and counts, read for the totals and again for the scores, so that texts are cut once
    dfs = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))]
    totals = held.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"), *dfs)
    return scored(held, totals, len(phrases))


def scored(held: DataFrame, totals: DataFrame, n: int) -> DataFrame:
    """Scores from (session_id, ordinal, dl, tf0 ...) and one row (n_docs, avgdl, df0 ...)."""
    score, every = F.lit(0.0), F.lit(True)
    for i in range(n):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        every = every & (tf > 0)
        idf = F.greatest(F.lit(FLOOR_IDF), F.log((F.col("n_docs") - df + 0.5) / (df + 0.5)))
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return held.filter(every).join(F.broadcast(totals)).select("session_id", "ordinal", score.alias("score"))


def phrase_matches(docs: DataFrame, phrase: str, forms: Forms | None = None) -> DataFrame:
    """Documents that hold the phrase's terms side by side, with how often."""
    hits = _counted(F.col("text"), stems_of([phrase]), forms)["tf0"]
    return docs.select("session_id", "ordinal", hits.alias("hits")).filter("hits > 0")


def ranked_sessions(scored: DataFrame, sess: DataFrame) -> DataFrame:
    """Sessions with the best score of their documents."""
    best = scored.groupBy("session_id").agg(F.min("score").alias("rank"), F.count(F.lit(1)).alias("n_hits"))
    return best.join(sess.select("session_id", "last_activity"), "session_id")


def search_order() -> list[Column]:
    return [F.col("rank").asc(), F.coalesce("last_activity", F.lit(-1)).desc(), F.col("session_id").desc()]


@dataclass(frozen=True)
class Cursor:
    """Where a page ended, bound to the query it belongs to."""

    rank: float
    activity: int
    session_id: int
    query: str

    @staticmethod
    def fingerprint(query: str, filters: dict) -> str:
        return hashlib.sha256(json.dumps([query, filters], sort_keys=True).encode()).hexdigest()[:16]

    def encode(self) -> str:
        raw = json.dumps([self.rank, self.activity, self.session_id, self.query]).encode()
        return base64.urlsafe_b64encode(raw).decode().rstrip("=")

    @staticmethod
    def decode(raw: str, query: str) -> Cursor:
        try:
            found = Cursor(*json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4))))
        except Exception as e:
            raise InvalidQuery("cursor can't be read") from e
        if found.query != query:
            raise InvalidQuery("cursor belongs to another query")
        return found

    def after(self) -> Column:
        """Rows behind the cursor in search order."""
        act = F.coalesce("last_activity", F.lit(-1))
        return (
            (F.col("rank") > self.rank)
            | ((F.col("rank") == self.rank) & (act < self.activity))
            | ((F.col("rank") == self.rank) & (act == self.activity) & (F.col("session_id") < self.session_id))
        )


def page(ranked: DataFrame, size: int, cursor: Cursor | None = None) -> DataFrame:
    """The next ``size`` rows in search order, plus one that tells whether more follow."""
    if not 1 <= size <= 300:
        raise InvalidQuery("page size must be 1 to 300")
    rows = ranked if cursor is None else ranked.filter(cursor.after())
    return rows.orderBy(*search_order()).limit(size + 1)


def literal_search(docs: DataFrame, needle: str) -> DataFrame:
    """Documents that contain the needle, case folded."""
    return docs.filter(F.contains(F.lower("text"), F.lit(needle.lower())))


def snippets(docs: DataFrame, wanted: Sequence[str], before: int = 56, after: int = 80, span: int = 180) -> DataFrame:
    """Windows around hits: (session_id, ordinal, n, start, end, snippet).

    Hits are grouped while they fit in ``span`` characters; a window adds text on
    both sides, with ellipses where it cuts.
    """
    pattern = "(?i)" + "|".join(re.escape(w).replace("/", "/") for w in sorted(wanted, key=len, reverse=True))
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.split("text", pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def place(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    pairs = F.filter(F.arrays_zip(found.alias("hit"), gaps.alias("gap")), lambda x: x["hit"].isNotNull())
    hits = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), place)["out"]

    def group(acc: Column, h: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = last.isNotNull() & (h["end"] - last["start"] <= span)
        joined = F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), h["end"].alias("end")))
        )
        return F.when(fits, joined).otherwise(F.concat(acc, F.array(h)))

    windows = F.aggregate(hits, none, group)
    rows = docs.filter(F.col("text").rlike(pattern)).select("session_id", "ordinal", "text", F.posexplode(windows).alias("n", "w"))
    low = F.greatest(F.lit(0), F.col("w.start") - before)
    high = F.least(F.length("text"), F.col("w.end") + after)
    piece = F.substring(F.col("text"), low + 1, high - low)
    cut = F.concat(F.when(low > 0, "…").otherwise(""), piece, F.when(high < F.length("text"), "…").otherwise(""))
    return rows.select("session_id", "ordinal", "n", F.col("w.start").alias("start"), F.col("w.end").alias("end"), cut.alias("snippet"))


def top_documents(scored: DataFrame, per_session: int = 3) -> DataFrame:
    """The best documents of each session."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("score", "ordinal"))
    return scored.withColumn("place", place).filter(F.col("place") <= per_session)


def index_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """What an index lacks and what it has too much: rows (session_id, ordinal, text, drift)."""
    cols = ["session_id", "ordinal", "text"]
    missing = expected.select(*cols).exceptAll(actual.select(*cols)).withColumn("drift", F.lit("missing"))
    extra = actual.select(*cols).exceptAll(expected.select(*cols)).withColumn("drift", F.lit("extra"))
    return missing.unionByName(extra)
