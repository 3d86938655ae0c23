"""Passages: text addressed by bytes, references to it, and what was done with files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions import text as fx

REF_FIELDS = "v int, harness string, native_id string, observation string, record string, channel string, start long, end long, hash string"
SEGMENT_BYTES = 1 << 20


def passages(msgs: DataFrame, observation: Column) -> DataFrame:
    """Every message as one passage over all its bytes, with a reference that holds its digest."""
    cols = {
        "observation": observation,
        "record": F.col("ordinal").cast("string"),
        "channel": F.lit("prose"),
        "start_byte": F.lit(0).cast("long"),
        "end_byte": F.octet_length("text").cast("long"),
        "text_hash": F.sha2("text", 256),
    }
    rows = msgs.withColumns(cols)
    ref = F.struct(
        F.lit(1).alias("v"), "harness", "native_id", "observation", "record", "channel",
        F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), F.col("text_hash").alias("hash"),
    )
    return rows.withColumn("ref", fx.passage_ref(ref))


def resolve(refs: DataFrame, held: DataFrame, current: DataFrame) -> DataFrame:
    """(ref, status, text): current, pinned (an older observation) or unavailable.

    A reference to part of a passage is cut from it and must have the digest it names.
    ``refs`` has ref; ``held`` passages; ``current`` (harness, native_id, observation).
    """
    r = refs.select("ref", fx.parse_passage_ref(F.col("ref"), REF_FIELDS).alias("r"))
    p = held.select("harness", "native_id", "observation", "record", "channel", F.col("text").alias("__t"), F.col("start_byte").alias("__s"))
    key = ["harness", "native_id", "observation", "record", "channel"]
    joined = r.select("ref", *[F.col(f"r.{c}").alias(c) for c in [*key, "start", "end", "hash"]]).join(p, key, "left")
    now = current.select(*key[:3], F.lit(True).alias("__now"))
    joined = joined.join(now, key[:3], "left")
    piece = fx.utf8_slice(F.col("__t"), (F.col("start") - F.col("__s")).cast("int"), (F.col("end") - F.col("__s")).cast("int"))
    fine = piece.isNotNull() & (F.sha2(piece, 256) == F.col("hash"))
    status = F.when(~F.coalesce(fine, F.lit(False)), "unavailable").when(F.col("__now"), "current").otherwise("pinned")
    return joined.select("ref", status.alias("status"), F.when(F.coalesce(fine, F.lit(False)), piece).alias("text"))


def export_context(wanted: DataFrame, key: list[str], order: str, budget: int) -> DataFrame:
    """(key..., order, included): passages taken in order while they fit; one too large is skipped.

    A later smaller one may still fit, so this isn't a prefix; each key is one small group.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields if f.name in {*key, order}) + ", included boolean"

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        used, kept = 0, []
        for n in rows["bytes"]:
            fits = used + n <= budget
            used += n if fits else 0
            kept.append(bool(fits))
        return rows.assign(included=kept)[[f for f in [*key, order, "included"]]]

    names = [f.name for f in wanted.schema.fields if f.name in {*key, order}]
    return wanted.select(*names, "bytes").groupBy(*key).applyInPandas(lambda rows: take(rows)[[*names, "included"]], schema)


def segments(files: DataFrame, size: int = SEGMENT_BYTES) -> DataFrame:
    """(name, segment, bytes, hash) of the content cut to pieces of ``size`` bytes."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int")
    rows = files.select("name", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("segment"))
    part = F.substring("content", F.col("segment") * size + 1, F.lit(size))
    return rows.select("name", "segment", F.octet_length(part).cast("long").alias("bytes"), F.sha2(part, 256).alias("hash"))


def evolution(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change): new, gone, same, appended (the old content is a prefix) or rewritten."""
    b = before.select("name", F.octet_length("content").alias("n"), F.sha2("content", 256).alias("h"), F.lit(1).alias("__b"))
    a = after.select("name", "content", F.lit(1).alias("__a"))
    prefix = F.sha2(F.substring(F.col("content"), F.lit(1), F.col("n")), 256)
    change = (
        F.when(F.col("__b").isNull(), "new")
        .when(F.col("__a").isNull(), "gone")
        .when(F.sha2("content", 256) == F.col("h"), "same")
        .when((F.octet_length("content") > F.col("n")) & (prefix == F.col("h")), "appended")
        .otherwise("rewritten")
    )
    return b.join(a, "name", "full_outer").select("name", change.alias("change"))


def artifacts(records: DataFrame) -> DataFrame:
    """(key, path, kind, certainty): what records say about files.

    ``records`` has key, role, channel, text. Mentions are observations, or claims
    if the assistant makes them. Only a structured tool result that tells of a new
    file and of its absence before shows that something was created.
    """
    said = records.select("key", "role", F.explode(F.array_distinct(fx.path_mentions(F.col("text")))).alias("path"), "text")
    mentioned = said.select("key", "path", F.lit("mentioned").alias("kind"), F.when(F.col("role") == "assistant", "claim").otherwise("observed").alias("certainty"))
    asked = said.filter((F.col("role") == "user") & F.col("text").rlike(r"(?i)\b(create|write|generate|save)\b"))
    asked = asked.select("key", "path", F.lit("creation_requested").alias("kind"), F.lit("candidate").alias("certainty"))
    tool = records.filter((F.col("role") == "tool") | F.startswith("channel", F.lit("tool")))
    o = F.from_json("text", "path string, file_path string, success boolean, created boolean, existed_before boolean, action string")
    told = tool.select("key", "channel", o.alias("o")).withColumn("path", F.coalesce("o.path", "o.file_path")).filter("path IS NOT NULL")
    ok = F.coalesce(F.col("o.success"), F.lit(False))
    kind = (
        F.when(ok & F.col("o.created") & ~F.col("o.existed_before"), "creation_observed")
        .when(ok & F.col("o.action").isin("write", "edit", "patch"), "worked_on")
        .when(F.col("o.action").isin("write", "create") | F.col("channel").rlike("(?i):(Write|write_file|create_file)$"), "creation_requested")
    )
    certainty = F.when(F.col("kind") == "creation_requested", "candidate").otherwise("observed")
    result = told.select("key", "path", kind.alias("kind")).filter("kind IS NOT NULL").withColumn("certainty", certainty)
    return mentioned.unionByName(asked).unionByName(result).distinct()


def citations(text: Column) -> Column:
    """array<struct<id, ordinal>> of [id] and [id:ordinal] marks."""
    raw = F.regexp_extract_all(text, F.lit(r"\[(\d+(?::\d+)?)\]"), F.lit(1))
    one = lambda m: F.struct(F.split(m, ":")[0].cast("long").alias("id"), F.try_element_at(F.split(m, ":"), F.lit(2)).cast("long").alias("ordinal"))
    return F.transform(F.array_distinct(raw), one)


def check_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(key, id, ordinal, valid): citations that some evidence range of the session covers.

    ``answers`` has key, text; ``evidence`` has id, lo, hi.
    """
    cited = answers.select("key", F.explode(citations(F.col("text"))).alias("c")).select("key", "c.id", "c.ordinal")
    joined = cited.join(evidence, "id", "left")
    inside = F.col("lo").isNotNull() & (F.col("ordinal").isNull() | F.col("ordinal").between(F.col("lo"), F.col("hi")))
    return joined.groupBy("key", "id", "ordinal").agg(F.max(F.coalesce(inside, F.lit(False))).alias("valid"))


def coverage(observations: DataFrame) -> DataFrame:
    """Totals over the latest observation of each (source, locator)."""
    place = F.row_number().over(Window.partitionBy("source", "locator").orderBy(F.col("at").desc(), F.col("id").desc()))
    latest = observations.withColumn("__rn", place).filter("__rn = 1")
    return latest.groupBy("source").agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status").isin("disabled", "unreachable", "unsupported")).alias("gaps"),
        F.sum("bytes").cast("long").alias("bytes"),
    )


def overlay(rows: DataFrame, fixes: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """``rows`` with the fields that a correction names."""
    renamed = fixes.select(*key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = rows.join(renamed, key, "left")
    fixed = joined.withColumns({f: F.coalesce(f"__{f}", f) for f in fields})
    return fixed.drop(*[f"__{f}" for f in fields])


def prefix_variants(chains: DataFrame) -> DataFrame:
    """(copy, base, relation) for copies of a session: prefix, extension, same or variant.

    ``chains`` has base_items and copy_items, the ordered digests of both.
    """
    b, c = F.col("base_items"), F.col("copy_items")
    n = F.least(F.size(b), F.size(c))
    agree = F.slice(b, 1, n) == F.slice(c, 1, n)
    relation = (
        F.when(~agree, "variant").when(F.size(c) == F.size(b), "same").when(F.size(c) < F.size(b), "prefix").otherwise("extension")
    )
    return chains.select("copy", "base", relation.alias("relation"))
