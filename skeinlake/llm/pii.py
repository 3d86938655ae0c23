"""Personal data: detection by pattern, then information-theoretic sanitisation.

Detection finds e-mail addresses, IP addresses, card numbers and phone numbers.
Each distinct value found is a protected entity. Words that stand near an entity
may give it away even when it is masked, so corpus statistics estimate how
strongly each nearby term reveals it: the pointwise mutual information of term
and entity over context windows, against the information content of the entity
itself. With p(t) the chance that a random window holds the term,

    PMI(e; t) = log2(p(t | e) / p(t))        IC(e) = -log2 p(e)
    disclosure(e; t) = PMI(e; t) / IC(e)

A disclosure of 1 means that seeing the term is as good as seeing the entity.
Protected, besides each value, is what values share: the domain of an address, the
network of an IP, the issuer of a card, the area of a phone number. A term counts by
what it tells of either.
Terms at or above ``remove_at`` are removed, those at or above ``generalise_at``
are replaced by what kind of word they are. Term counts cover every word of
every document, and so do contexts and joint occurrences: each copy of a text and
each document with the same words around an entity counts, once for each entity. A document is no witness
about itself: of the joint occurrences one is left out, so a term met once tells nothing,
and two or three tell a little less than many.

Edge cases: null texts count as empty; empty texts have no spans; rows are
independent of their doc_id, so null or repeated ids get a row each; equal texts
get equal spans; an empty table gives an empty result; other columns are ignored.
Offsets are in code points, ends are exclusive. A text of any length is one value in
one task; equal disclosures are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: What each kind of personal data looks like. Possessive
#: quantifiers and the look-behinds only keep the matcher from trying starts
#: that cannot succeed; \G admits a start right after the match before.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = ["email", "ip", "card", "phone"]
#: What is left in place of a span.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

TERM = r"[\p{L}\p{N}]{3,}"
WINDOW_CHARS = 80
#: Terms in two windows of that size, about; turns term counts into window chances.
WINDOW_TERMS = 20
GENERALISE_AT = 0.8
REMOVE_AT = 0.95
MAX_BROADCAST_ROWS = 200_000


def _luhn(digits: Column) -> Column:
    """The Luhn check on a string of digits."""
    reverse = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.element_at(F.split(reverse, ""), i).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))


def _located(text: Column, kind: str, pattern: str, rank: int, hint: Column) -> Column:
    """Array of struct(start, rank, end, value): matches with their places.

    The pieces between matches give the offsets: a match starts after all
    pieces and matches before it.
    """
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("value"), gaps.alias("gap"))

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        item = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["value"].alias("value")
        )
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(item)).alias("out"))

    matched = F.filter(pairs, lambda x: x["value"].isNotNull())
    placed = F.aggregate(matched, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]
    kept = F.filter(placed, lambda x: _valid(kind, x["value"]))
    return F.when(hint & text.rlike(pattern), kept).otherwise(none)


def base_spans(text: Column) -> Column:
    """All pattern matches as array<struct<start, rank, end, value>>, in order."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(
        F.concat(
            _located(text, "email", EMAIL, 0, F.contains(text, F.lit("@"))),
            _located(text, "ip", IP, 1, F.contains(text, F.lit("."))),
            _located(text, "card", CARD, 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")),
            _located(text, "phone", PHONE, 3, F.contains(text, F.lit("+"))),
        )
    )


def _terms_near(text: Column, start: Column, spans: Column) -> Column:
    """Terms of the stretch of WINDOW_CHARS code points from ``start``, with places.

    Terms that touch a detected span are left out. A term cut by the edge of the
    window is kept as the part inside only if the window starts or ends there,
    so both edges are trimmed to whole terms first.
    """
    piece = F.substring(text, start + 1, F.lit(WINDOW_CHARS))
    found = F.regexp_extract_all(piece, F.lit(TERM), F.lit(0))
    gaps = F.split(piece, TERM, -1)
    none = F.array().cast("array<struct<term:string,start:int,end:int>>")

    def add(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        item = F.struct(F.lower(x["value"]).alias("term"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(item)).alias("out"))

    pairs = F.filter(
        F.arrays_zip(found.alias("value"), gaps.alias("gap")), lambda x: x["value"].isNotNull()
    )
    placed = F.aggregate(pairs, F.struct(start.alias("at"), none.alias("out")), add)["out"]
    limit = start + F.length(piece)
    whole = F.filter(
        placed,
        lambda t: ((t["start"] > start) | (start == 0))
        & ((t["end"] < limit) | (limit == F.length(text))),
    )
    return F.filter(
        whole, lambda t: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    )


def _entities(s: Column) -> Column:
    """What a span protects: its value and what it shares with others of its kind."""
    digits = F.regexp_replace(s["value"], "[^0-9]", "")
    shared = F.when(s["rank"] == 0, F.substring_index(F.lower(s["value"]), "@", -1)).when(s["rank"] == 1, F.substring_index(s["value"], ".", 2))
    shared = shared.when(s["rank"] == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    rank = s["rank"].cast("string")
    return F.array(F.concat_ws(":", rank, s["value"]), F.concat_ws(":", rank, F.lit("shared"), shared))


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, __spans, and, where there are spans, __key and __near.

    ``__key`` is the digest of the text; ``__near`` holds for each span the
    entities it protects and the terms around it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("__text"), base_spans(F.col("text")).alias("__spans"))
    near = F.transform(
        "__spans",
        lambda s: F.struct(
            _entities(s).alias("entities"),
            F.array_distinct(
                F.concat(
                    _terms_near(
                        F.col("__text"), F.greatest(F.lit(0), s["start"] - WINDOW_CHARS), F.col("__spans")
                    ),
                    _terms_near(F.col("__text"), s["end"], F.col("__spans")),
                )
            ).alias("terms"),
        ),
    )
    some = F.size("__spans") > 0
    return found.select(
        "doc_id",
        "__spans",
        F.when(some, F.sha2("__text", 256)).alias("__key"),
        F.when(some, near).alias("__near"),
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): how often each term occurs in all documents."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))
    return (
        docs.filter(F.col("text").isNotNull())
        .select(F.explode(found).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def disclosure(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, joint, contexts, n, disclosure) for pairs that meet more than once.

    A context is a document that holds the entity, a joint occurrence one with the term beside it;
    equal texts count as often as they occur.
    """
    texts = found.filter(F.col("__key").isNotNull()).groupBy("__key").agg(
        F.count(F.lit(1)).alias("copies"), F.first("__near").alias("__near")
    )
    entities = F.array_distinct(F.flatten(F.transform("__near", lambda c: c["entities"])))
    per_entity = texts.select("copies", F.explode(entities).alias("entity"))
    per_entity = per_entity.groupBy("entity").agg(F.sum("copies").alias("contexts"))

    def pairs(c: Column) -> Column:
        beside = lambda e: F.transform(c["terms"], lambda t: F.struct(e.alias("entity"), t["term"].alias("term")))
        return F.flatten(F.transform(c["entities"], beside))

    met = texts.select("copies", F.explode(F.array_distinct(F.flatten(F.transform("__near", pairs)))).alias("p"))
    joint = met.groupBy("p.entity", "p.term").agg(F.sum("copies").alias("joint")).filter("joint > 1")
    joint, _ = common.small_side(joint, MAX_BROADCAST_ROWS, "pii-joint")
    counts = common.materialise(term_counts(docs), "pii-terms")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__total"))
    windows = F.greatest(F.lit(2.0), F.col("__total") / F.lit(float(WINDOW_TERMS)))
    p_term = F.least(F.lit(1.0), F.col("n") / windows)
    p_entity = F.least(F.lit(0.5), F.col("contexts") / windows)
    pmi = F.log2((F.col("joint") - 1) / F.col("contexts") / p_term)
    return (
        joint.join(per_entity, "entity")
        .join(counts, "term")
        .join(F.broadcast(total))
        .select("entity", "term", "joint", "contexts", "n", (pmi / -F.log2(p_entity)).alias("disclosure"))
    )


def revealing_terms(
    docs: DataFrame,
    found: DataFrame,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
) -> DataFrame:
    """(__key, __terms): for each text with such terms, where they are and what to do.

    ``__terms`` is array<struct<start, end, action>>, action 'remove' or 'generalise'.
    """
    strong = disclosure(docs, found).filter(F.col("disclosure") >= generalise_at)
    near = (
        found.filter(F.col("__key").isNotNull())
        .select("__key", "__near")
        .dropDuplicates(["__key"])
        .select("__key", F.explode("__near").alias("c"))
        .select("__key", F.col("c.entities").alias("entities"), F.explode("c.terms").alias("t"))
        .select("__key", F.explode("entities").alias("entity"), "t")
        .select("__key", "entity", "t.term", "t.start", "t.end")
    )
    action = F.when(F.max("disclosure") >= remove_at, F.lit("remove")).otherwise(F.lit("generalise"))
    flagged = (
        near.join(strong.select("entity", "term", "disclosure"), ["entity", "term"])
        .groupBy("__key", "start", "end")
        .agg(action.alias("action"))
        .groupBy("__key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("__terms"))
    )
    return common.small_side(flagged, MAX_BROADCAST_ROWS // 10, "pii-flagged")[0]


def _with_terms(frame: DataFrame, flagged: DataFrame) -> DataFrame:
    """``frame`` with __terms; rows without a key are not sent through the join."""
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    held = frame.filter(F.col("__key").isNotNull()).join(flagged, "__key", "left")
    held = held.withColumn("__terms", F.coalesce("__terms", none))
    rest = frame.filter(F.col("__key").isNull()).withColumn("__terms", none)
    return held.unionByName(rest)


def spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base, terms.

    ``base`` is array<struct<start, rank, end, value>>, ``terms`` is
    array<struct<start, end, action>>.
    """
    found = common.materialise(detect(docs), "pii-found")
    both = _with_terms(found.select("doc_id", "__key", "__spans"), revealing_terms(docs, found))
    return both.select("doc_id", F.col("__spans").alias("base"), F.col("__terms").alias("terms"))


def sanitise_documents(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` sanitised; other columns stay."""
    found = common.materialise(detect(docs), "pii-found")
    flagged = revealing_terms(docs, found)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__spans", base_spans(F.col("text"))).withColumn(
        "__key", F.when(F.size("__spans") > 0, F.sha2(text, 256))
    )
    both = _with_terms(keyed, flagged)
    clean = F.when(F.col("text").isNotNull(), sanitise(F.col("text"), F.col("__spans"), F.col("__terms")))
    return both.withColumn("text", clean).select(*docs.columns)


def sanitise(text: Column, base: Column, terms: Column) -> Column:
    """The text with detected spans masked and revealing terms removed or generalised.

    Where spans overlap, the one that starts first (then the base span) wins.
    """
    masks = F.array(*[F.lit(MASKS[k]) for k in KINDS])
    cuts = F.array_sort(
        F.concat(
            F.transform(
                base,
                lambda s: F.struct(
                    s["start"].alias("start"),
                    s["rank"].alias("rank"),
                    s["end"].alias("end"),
                    F.element_at(masks, s["rank"] + 1).alias("mask"),
                ),
            ),
            F.transform(
                terms,
                lambda s: F.struct(
                    s["start"].alias("start"),
                    F.lit(len(KINDS)).alias("rank"),
                    s["end"].alias("end"),
                    F.when(s["action"] == "remove", F.lit(""))
                    .when(
                        F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike("^[0-9]+$"),
                        F.lit("[NUMBER]"),
                    )
                    .otherwise(F.lit("[WORD]"))
                    .alias("mask"),
                ),
            ),
        )
    )

    def add(s: Column, c: Column) -> Column:
        kept = F.substring(text, s["at"] + 1, c["start"] - s["at"])
        moved = F.struct(c["end"].alias("at"), F.concat(s["out"], kept, c["mask"]).alias("out"))
        return F.when(c["start"] >= s["at"], moved).otherwise(s)

    end = F.aggregate(cuts, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    rest = F.substring(text, end["at"] + 1, F.length(text))
    return F.when(F.size(cuts) == 0, text).otherwise(F.concat(end["out"], rest))


def _listed(items: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.array_join(
        F.transform(
            items,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans, one row per document."""
    found = spans(docs)

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    plain = F.transform(
        "base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    )
    added = F.transform(
        "terms",
        lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end")),
    )
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_listed(plain), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat(plain, added))).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )
