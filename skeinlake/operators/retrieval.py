"""What an assistant may fetch from the archive: spans, summaries and lists with ranges to cite, pages of a session, slices of long records.

A tool answers a table of calls at once. Every answer has ``text`` to read and ``evidence``, the ranges of messages that a citation may
name; an answer without either range is an error told in words. Texts are redacted.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlake.functions import text as fx

#: Messages that one span may hold, and sessions that one list may.
MOST_MESSAGES, MOST_LISTED = 40, 20
#: Bytes of a record that are shown in a page of records, and of a slice of it.
SHOWN_BYTES, SLICE_BYTES = 8192, 65536
EVIDENCE = "array<struct<session_id:bigint,from_ordinal:bigint,to_ordinal:bigint>>"
UNSUMMARISED = "(unsummarized)"


def _range(session: Column, low: Column | None = None, high: Column | None = None) -> Column:
    none = F.lit(None).cast("bigint")
    return F.struct(session.cast("bigint").alias("session_id"), (none if low is None else low.cast("bigint")).alias("from_ordinal"), (none if high is None else high.cast("bigint")).alias("to_ordinal"))


def read_spans(calls: DataFrame, msgs: DataFrame) -> DataFrame:
    """(call, text, evidence) of ``calls`` (call, session_id, from, to), both ends inside; each message is its own evidence.

    What users and assistants say is read; of ``msgs`` (session_id, ordinal, role, text) an ordinal has one row. A call is refused if an
    end is missing or below zero, if they are the wrong way round, or if over ``MOST_MESSAGES`` ordinals lie between. Ordinals are
    asked for one by one, so a call meets no more of a long session than it may read.
    """
    low, high = F.col("from"), F.col("to")
    ordered = F.coalesce((low >= 0) & (high >= low), F.lit(False))
    # taken apart from the first end, as the sum of two large ones overflows
    wrong = F.when(~ordered, "(read_span error: invalid ordinal range)").when(high - low > MOST_MESSAGES - 1, f"(read_span error: maximum {MOST_MESSAGES} messages)")
    judged = calls.select("call", "session_id", "from", "to").withColumn("wrong", wrong)
    asked = judged.filter("wrong IS NULL").select("call", "session_id", F.explode(F.sequence("from", "to")).alias("ordinal"))
    said = msgs.filter(F.col("role").isin("user", "assistant") & F.col("text").isNotNull()).select("session_id", "ordinal", "role", "text")
    found = asked.join(said, ["session_id", "ordinal"])
    at = F.concat(F.lit("["), F.col("session_id").cast("string"), F.lit(":"), F.col("ordinal").cast("string"), F.lit("] "))
    line = F.concat(at, F.col("role"), F.lit(": "), fx.redact(F.col("text")))
    lines = found.groupBy("call").agg(F.array_sort(F.collect_list(F.struct("ordinal", "session_id", line.alias("line")))).alias("lines"))
    text = F.coalesce("wrong", F.array_join("lines.line", "\n"), F.lit("(session/span not found or empty)"))
    ranges = F.transform("lines", lambda x: _range(x["session_id"], x["ordinal"], x["ordinal"]))
    return judged.join(lines, "call", "left").select("call", text.alias("text"), F.coalesce(ranges, F.array().cast(EVIDENCE)).cast(EVIDENCE).alias("evidence"))


def get_summaries(calls: DataFrame, sessions: DataFrame, topics: DataFrame, bodies: DataFrame, anchors: DataFrame) -> DataFrame:
    """(call, text, evidence) of ``calls`` (call, session_id): topic, summary and its anchors; the session and each anchor are evidence.

    ``sessions`` (session_id, harness, native_id), ``topics`` (session_id, topic), ``bodies`` (session_id, body) with one row for
    a session, ``anchors`` (session_id, place, topic, from_ordinal, to_ordinal, body). Without a body there are no anchors.
    """
    sid = F.col("session_id").cast("string")
    span = F.concat(F.lit("["), sid, F.lit(":"), F.col("from_ordinal").cast("string"), F.lit("-"), F.col("to_ordinal").cast("string"), F.lit("] "))
    told = F.concat(span, fx.redact(F.col("topic")), F.when(F.col("body").isNotNull(), F.concat(F.lit(" — "), fx.redact(F.col("body")))).otherwise(""))
    of_asked = anchors.join(calls.select("session_id").distinct(), "session_id", "left_semi")
    nested = of_asked.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "from_ordinal", "to_ordinal", told.alias("line")))).alias("anchors"))
    both = calls.select("call", "session_id").join(sessions.select("session_id", "harness", "native_id", F.lit(True).alias("known")), "session_id", "left")
    both = both.join(topics.select("session_id", "topic"), "session_id", "left").join(bodies.select("session_id", "body"), "session_id", "left").join(nested, "session_id", "left")
    anchored = F.when(F.col("body").isNotNull(), F.col("anchors"))
    lines = F.concat(
        F.array(
            F.concat(F.lit("["), sid, F.lit("] "), F.col("harness"), F.lit("/"), F.col("native_id")),
            F.concat(F.lit("topic: "), F.coalesce(fx.redact(F.col("topic")), F.lit(UNSUMMARISED))),
            F.when(F.coalesce(F.col("body"), F.lit("")) != "", F.concat(F.lit("summary: "), fx.redact(F.col("body")))).otherwise("summary: (tier-2 unavailable)"),
        ),
        F.coalesce(F.transform(anchored, lambda a: a["line"]), F.array().cast("array<string>")),
    )
    ranges = F.concat(
        F.array(_range(F.col("session_id"))),
        F.coalesce(F.transform(anchored, lambda a: _range(F.col("session_id"), a["from_ordinal"], a["to_ordinal"])), F.array().cast(EVIDENCE)),
    )
    text = F.when(F.col("known"), F.array_join(lines, "\n")).otherwise("(session not found)")
    return both.select("call", text.alias("text"), F.when(F.col("known"), ranges).otherwise(F.array().cast(EVIDENCE)).cast(EVIDENCE).alias("evidence"))


def list_sessions(sessions: DataFrame, topics: DataFrame, harness: str | None = None, limit: int = 5) -> DataFrame:
    """(session_id, text, evidence): the newest sessions, ``MOST_LISTED`` at most; ties by the smaller id, those without a time last."""
    rows = sessions if harness is None else sessions.filter(F.col("harness") == harness)
    newest = rows.select("session_id", "last_activity").orderBy(F.desc_nulls_last("last_activity"), "session_id").limit(min(max(limit, 1), MOST_LISTED))
    text = F.concat(F.lit("["), F.col("session_id").cast("string"), F.lit("] "), F.coalesce(fx.redact(F.col("topic")), F.lit(UNSUMMARISED)))
    return newest.join(topics.select("session_id", "topic"), "session_id", "left").select("session_id", text.alias("text"), F.array(_range(F.col("session_id"))).cast(EVIDENCE).alias("evidence"))


def fence(tool: Column, text: Column, name: str = "ARCHIVE_DATA") -> Column:
    """A tool's answer between marks that say where untrusted text begins and ends; what looks like one of them inside is made harmless."""
    begin, end = f"<<<{name}>>>", f"<<<END_{name}>>>"
    safe = F.replace(F.replace(text, F.lit(begin), F.lit("[escaped archive-data delimiter]")), F.lit(end), F.lit("[escaped end delimiter]"))
    safe = F.replace(safe, F.lit("</tool_result>"), F.lit("&lt;/tool_result&gt;"))
    return F.concat(F.lit('<tool_result tool="'), tool, F.lit(f'" trust="untrusted-data">\n{begin}\n'), safe, F.lit(f"\n{end}\n</tool_result>"))


@dataclass(frozen=True)
class Place:
    """How far a reader came in a page that ``signature`` names; it fits no other page, nor a later revision."""

    offset: int
    signature: str

    @staticmethod
    def signed(*parts: object) -> str:
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()

    def encode(self) -> str:
        return base64.urlsafe_b64encode(json.dumps({"offset": self.offset, "signature": self.signature}).encode()).decode().rstrip("=")

    @staticmethod
    def decode(cursor: str | None, signature: str) -> int:
        """The offset that a cursor holds; zero without one."""
        if cursor is None:
            return 0
        try:
            found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
            offset, own = found["offset"], found["signature"]
        except Exception as e:
            raise ValueError("cursor can't be read") from e
        if own != signature or isinstance(offset, bool) or not isinstance(offset, int) or offset < 0:
            raise ValueError("cursor belongs to another page or revision")
        return offset


def read_page(passages: DataFrame, session_id: int, revision: str, limit: int = 100, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """Dialogue passages (session_id, role, ordinal, ref) of a session in order, and the cursor of the next page, none behind the last."""
    if limit < 1:
        raise ValueError("limit must be a positive integer")
    limit = min(limit, 500)
    signature = Place.signed("read", session_id, revision)
    offset = Place.decode(cursor, signature)
    rows = passages.filter((F.col("session_id") == session_id) & F.col("role").isin("user", "assistant")).orderBy("ordinal", "ref").offset(offset).limit(limit + 1)
    more = rows.count() > limit
    return rows.limit(limit), Place(offset + limit, signature).encode() if more else None


def catalogue(records: DataFrame) -> DataFrame:
    """(id, bytes, record) of ``records`` (id, data): a record over ``SHOWN_BYTES`` is null here and read by ``slices``."""
    size = F.octet_length("data").cast("long")
    return records.select("id", size.alias("bytes"), F.when(size <= SHOWN_BYTES, F.col("data")).alias("record"))


def slices(records: DataFrame, size: int = SLICE_BYTES // 2) -> DataFrame:
    """(id, offset, total_bytes, data, last): the exact bytes of every record in slices, as base64.

    Slices cut characters where they lie on a border; together they are the record. An empty record has one empty slice, a
    null record none. The size is ``SLICE_BYTES`` at most.
    """
    if size < 1:
        raise ValueError("size must be a positive integer")
    size = min(size, SLICE_BYTES)
    total = F.octet_length("data")
    last = F.greatest(F.lit(0), F.floor((total - 1) / size)).cast("int")
    rows = records.filter("data IS NOT NULL").select("id", F.encode("data", "UTF-8").alias("raw"), total.cast("long").alias("total_bytes"), last.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    piece = F.substring(F.col("raw"), F.col("i") * size + 1, F.lit(size))
    # base64 breaks lines after 76 characters
    plain = F.translate(F.base64(piece), "\r\n", "")
    return rows.select("id", (F.col("i") * size).cast("long").alias("offset"), "total_bytes", plain.alias("data"), (F.col("i") == F.col("n")).alias("last"))
