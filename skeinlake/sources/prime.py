"""Prime's archives: sessions, the children that they start, and what else lies beside them.

An archive has the folders sessions, session-artifacts and tmux-panes; an official child lies at
session-artifacts/<any>/sub-<any>/<file>.jsonl. A session begins with a header; a child's header names its parent by a path, absolute or
relative to the child, which is resolved against the headers of the archive. Takes lines as ``jsonl.complete_lines``
gives them; numbers where a text is expected count as their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinlake.functions.text import WHITE
from skeinlake.sources.jsonl import UUID

BLOCKS = (
    "array<struct<type: string, text: string, name: string, toolName: string, arguments: string, input: string, id: string, toolUseId: string, "
    "tool_use_id: string, content: string, result: string, output: string>>"
)
#: Types of records and of blocks.
CALLS = ["toolCall", "tool_call", "tool_use"]
RESULTS = ["toolResult", "tool_result"]
REASONING = ["thinking", "reasoning", "think"]
TELEMETRY = ["model_change", "service_tier_change", "thinking_level_change", "agent_status", "session_state", "child_usage", "subagent_usage"]
POLICIES = ["policy", "native_policy", "system_policy"]
#: Characters of a tool's text, and of a title.
TOOL_TEXT, TITLE = 8000, 120


def local_path(path: Column) -> Column:
    return F.regexp_replace(path, "^[a-z]+:/+", "/")


def normalised(path: Column) -> Column:
    """An absolute path without empty steps, ``.`` and ``..``."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def resolved(child: Column, parent: Column) -> Column:
    """Where a child's header says that its parent lies."""
    beside = F.concat(F.regexp_replace(child, "[^/]*$", ""), parent)
    return normalised(F.when(F.startswith(parent, F.lit("/")), parent).otherwise(beside))


def layout(path: Column, root: str) -> Column:
    """root, child, artifact or external; ``path`` is absolute."""
    parts = F.split(F.substring(path, len(root.rstrip("/")) + 2, 1 << 20), "/")
    child = (F.size(parts) == 4) & (F.try_element_at(parts, F.lit(2)) != "") & F.try_element_at(parts, F.lit(3)).rlike(r"^sub-[^/\\]+$")
    return F.when(parts[0] == "tmux-panes", "external").when(parts[0] == "session-artifacts", F.when(child, "child").otherwise("artifact")).otherwise("root")


def _text(path: str) -> Column:
    return F.nullif(F.btrim(F.get_json_object("line", path), F.lit(WHITE)), F.lit(""))


def _millis(raw: Column) -> Column:
    """Epoch milliseconds of a number of seconds or milliseconds, or of a date and time."""
    number = raw.try_cast("double")
    of_number = F.round(F.when(number < 1e10, number * 1000).otherwise(number)).cast("long")
    return F.when(number.isNotNull(), of_number).otherwise(F.unix_millis(F.try_to_timestamp(raw)))


def parsed(lines: DataFrame, root: str) -> DataFrame:
    """Lines with their absolute path, layout, whether they are JSON and an object, and their type."""
    at = local_path(F.col("path"))
    valid = F.try_parse_json("line").isNotNull()
    return lines.select(at.alias("path"), layout(at, local_path_of(root)).alias("layout"), "line_no", "line", valid.alias("valid"), (valid & F.ltrim("line").startswith("{")).alias("is_object")).withColumn(
        "type", F.when(F.col("is_object"), _text("$.type"))
    )


def local_path_of(root: str) -> str:
    return "/" + root.split(":", 1)[-1].lstrip("/")


def headers(rows: DataFrame) -> DataFrame:
    """(path, id, depth, parent_session) of the files that begin with a whole header."""
    depth = F.get_json_object("line", "$.rlmDepth")
    whole = F.when(depth.rlike(r"^\d{1,9}(\.0+)?$"), depth.cast("double").cast("int"))
    found = rows.filter("line_no = 0 AND type = 'session'").select("path", _text("$.id").alias("id"), whole.alias("depth"), _text("$.parentSession").alias("parent_session"))
    return found.filter("id IS NOT NULL AND depth IS NOT NULL")


def admission(rows: DataFrame) -> DataFrame:
    """(path, layout, native_id, parent, admitted, reason, origin, origin_detail) of every file."""
    head = headers(rows)
    names = F.when(F.col("type") == "session", F.coalesce(_text("$.id"), F.lit("")))
    files = rows.groupBy("path", "layout").agg(
        F.count_if(~F.col("valid")).alias("broken"), F.max(F.when(F.col("line_no") == 0, F.col("type"))).alias("first"), F.size(F.collect_set(names)).alias("names")
    )
    named = files.join(head, "path", "left").withColumn("at", resolved(F.col("path"), F.col("parent_session")))
    parents = head.select(F.col("path").alias("at"), F.col("id").alias("parent"))
    both = named.join(parents, "at", "left")
    kind, depth = F.col("layout"), F.col("depth")
    reason = (
        F.when(kind == "external", "auxiliary_agent_artifact")
        .when(kind == "artifact", F.when((F.col("broken") == 0) & (F.coalesce("first", F.lit("")) != "session"), "auxiliary_agent_artifact").otherwise("no_session_envelope"))
        .when(F.col("id").isNull(), "no_session_envelope")
        .when((kind == "root") & (depth > 0), "unsupported_unit_shape")
        .when((kind == "child") & ((depth <= 0) | F.col("parent_session").isNull() | F.col("parent").isNull()), "no_session_envelope")
        .when(F.col("broken") > 0, "malformed_complete_record")
        .when(F.col("names") > 1, "identity_mismatch")
    )
    own = F.coalesce("id", F.regexp_extract("path", r"([^/]+?)(?:\.jsonl)?$", 1))
    detail = F.when(kind == "child", F.concat(F.lit("prime:rlm-child:depth-"), depth.cast("string"))).when(F.col("parent_session").isNotNull(), "prime:root-fork").otherwise("prime:root-session")
    taken = reason.isNull()
    return both.select(
        "path", "layout", own.alias("native_id"), F.when(taken & (kind == "child"), F.col("parent")).alias("parent"), taken.alias("admitted"), reason.alias("reason"),
        F.when(taken, F.when(kind == "child", "agent").otherwise("human")).alias("origin"), F.when(taken, detail).alias("origin_detail"),
    )


def _bounded(text: Column) -> Column:
    return F.nullif(F.substring(text, 1, TOOL_TEXT), F.lit(""))


def _trimmed(text: Column) -> Column:
    return F.nullif(F.btrim(text, F.lit(WHITE)), F.lit(""))


def records(rows: DataFrame) -> DataFrame:
    """(path, ordinal, line_no, role, record_kind, side, prose, tools, ts, record_id, identity) of all lines that are records.

    ``tools`` are (kind, name, text, id). A string is prose of users and systems, and a result of tools; others
    speak in blocks.
    """
    kind, role_told = F.col("type"), F.get_json_object("line", "$.message.role")
    message = (kind == "message") & F.get_json_object("line", "$.message").startswith("{")
    role = F.when(role_told.isin("user", "assistant"), role_told).when(role_told.isin("system", "developer"), "system").otherwise("tool")
    content = F.get_json_object("line", "$.message.content")
    listed = F.get_json_object("line", "$.message.content[0]").isNotNull()
    blocks = F.coalesce(F.when(listed, F.from_json(content, BLOCKS)), F.array().cast(BLOCKS))
    of = lambda kinds: lambda b: F.coalesce(b["type"].isin(*kinds), F.lit(False))
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    no = F.lit(None).cast("string")
    tools = F.transform(
        F.filter(blocks, of(CALLS + RESULTS)),
        lambda b: F.struct(
            F.when(b["type"].isin(*CALLS), "call").otherwise("result").alias("kind"), F.coalesce(b["name"], b["toolName"]).alias("name"),
            _bounded(F.when(b["type"].isin(*CALLS), F.coalesce(b["arguments"], b["input"])).otherwise(F.coalesce(b["content"], b["result"], b["output"]))).alias("text"),
            F.when(b["type"].isin(*CALLS), F.coalesce(b["id"], b["toolUseId"])).otherwise(F.coalesce(b["toolUseId"], b["tool_use_id"], b["id"])).alias("id"),
        ),
    )
    one = F.array(F.struct(F.lit("result").alias("kind"), no.alias("name"), content.alias("text"), no.alias("id")))
    said = F.when(message, _trimmed(F.when(listed, F.array_join(texts, "\n")).when(role.isin("user", "system"), content)))
    did = F.when(message & ~listed & (role == "tool") & content.isNotNull(), one).when(message, tools)
    thinks = message & F.exists(blocks, of(REASONING))
    source = F.coalesce(_text("$.prose"), _text("$.content"), _text("$.message"))
    status = F.nullif(F.concat_ws(" · ", _text("$.status.taskState"), _text("$.status.summary")), F.lit(""))
    relation = F.coalesce(_text("$.details.fromRelationship"), _text("$.fromRelationship"))
    outbound = F.coalesce(_text("$.details.toRelationship") == "child", F.lit(False)) | F.coalesce(_text("$.direction") == "outbound", F.lit(False))
    inbound = F.coalesce((_text("$.customType") == "agent_message") & ~outbound & relation.isin("parent", "sibling"), F.lit(False))
    has_tools = F.coalesce(F.size("did") > 0, F.lit(False))
    record_kind = (
        F.when(~F.col("is_object") | kind.isNull(), "unclassified")
        .when(kind.isin(*TELEMETRY), "telemetry")
        .when(kind == "compaction", "automatic_utility")
        .when(kind == "custom_message", F.when(inbound, "real_user").otherwise("control_context"))
        .when(kind.isin(*POLICIES), "developer_system")
        .when(~F.col("is_message") & (kind != "message") & kind.rlike("(?i)context|lifecycle|control"), "control_context")
        .when(~F.col("is_message"), "unclassified")
        .when((F.col("spoke") == "user") & F.col("said").isNotNull(), "real_user")
        .when((F.col("spoke") == "assistant") & F.col("said").isNotNull(), "assistant_dialogue_prose")
        .when(has_tools | (F.col("spoke") == "tool"), "tool")
        .when(F.col("spoke") == "system", "developer_system")
        .when(F.col("thinks"), "control_context")
        .otherwise("unclassified")
    )
    prose = (
        F.when(F.col("is_message"), F.col("said"))
        .when(~F.col("is_object") | (kind == "message"), no)
        .when(kind == "agent_status", F.coalesce(_text("$.prose"), status))
        .when(kind.isin(*TELEMETRY), _text("$.prose"))
        .when(kind == "compaction", _text("$.summary"))
        .when(kind == "custom_message", _text("$.content"))
        .otherwise(source)
    )
    system = kind.isin(*TELEMETRY, *POLICIES, "compaction") | (F.col("record_kind") == "control_context")
    as_role = F.when(F.col("is_message"), F.col("spoke")).when((kind == "custom_message") & (F.col("record_kind") == "real_user"), "user").when(F.coalesce(system, F.lit(False)), "system").otherwise("tool")
    side = F.when(F.col("record_kind") == "real_user", "user").when(F.col("record_kind") == "assistant_dialogue_prose", "assistant")
    at = F.when(F.col("is_message"), F.get_json_object("line", "$.message.timestamp")).when(kind != "message", F.get_json_object("line", "$.timestamp"))
    own = _text("$.id")
    identity = F.when(own.rlike(UUID), "uuid").when(own.isNotNull(), "record-id").otherwise("none")
    told = rows.filter(F.col("valid") & (F.col("type").isNull() | ~F.col("type").isin("session", "session_info"))).withColumns(
        {"is_message": F.coalesce(message, F.lit(False)), "spoke": role, "said": said, "did": did, "thinks": F.coalesce(thinks, F.lit(False))}
    )
    made = told.withColumn("record_kind", record_kind)
    place = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1
    return made.select(
        "path", place.alias("ordinal"), "line_no", as_role.alias("role"), "record_kind", side.alias("side"), prose.alias("prose"), F.col("did").alias("tools"),
        _millis(at).alias("ts"), own.alias("record_id"), identity.alias("identity"),
    )


def _title(text: Column) -> Column:
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > TITLE, F.concat(F.substring(one, 1, TITLE - 1), F.lit("…"))).otherwise(one)


def sessions(rows: DataFrame) -> DataFrame:
    """(path, native_id, parent, origin, origin_detail, cwd, title, start_ts, end_ts, models, visible, artifact_kind) of the admitted files."""
    first = rows.groupBy("path").agg(
        F.max_by(F.when(F.col("type") == "session", _text("$.cwd")), F.when((F.col("type") == "session") & _text("$.cwd").isNotNull(), F.col("line_no"))).alias("cwd"),
        F.max_by(_text("$.name"), F.when((F.col("type") == "session_info") & _text("$.name").isNotNull(), F.col("line_no"))).alias("named"),
        F.array_sort(F.collect_set(F.coalesce(F.when(F.col("type") == "message", _text("$.message.model")), F.when(F.col("type") == "model_change", _text("$.modelId"))))).alias("models"),
    )
    told = records(rows).groupBy("path").agg(
        F.min_by("prose", F.when((F.col("record_kind") == "real_user") & F.col("prose").isNotNull(), F.col("ordinal"))).alias("asked"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.bool_or(F.col("side").isNotNull()).alias("visible"), F.bool_or(F.col("record_kind") != "telemetry").alias("bearing"),
    )
    taken = admission(rows).filter("admitted").drop("admitted", "reason", "layout")
    both = taken.join(first, "path").join(told, "path", "left")
    shape = F.when(F.coalesce("bearing", F.lit(False)), "dialogue_history").otherwise("metadata_shell")
    title = _title(F.coalesce("named", "asked"))
    return both.select(
        "path", "native_id", "parent", "origin", "origin_detail", "cwd", title.alias("title"), "start_ts", "end_ts", "models", F.coalesce("visible", F.lit(False)).alias("visible"), shape.alias("artifact_kind")
    )


def continuity_events(rows: DataFrame) -> DataFrame:
    """(path, events): compactions as ``operators.continuity`` takes them."""
    own, none = _text("$.id"), F.lit(None).cast("string")
    uuid = F.when(own.rlike(UUID), own)
    identity = F.when(uuid.isNotNull(), "uuid").when(own.isNotNull(), "record-id").otherwise("none")
    detail = F.when(_text("$.summary").isNotNull(), "prime:compaction-summary-present").otherwise("prime:compaction")
    event = F.struct(
        F.lit("compaction").alias("kind"), F.col("line_no").cast("long").alias("ordinal"), own.alias("record_id"), F.coalesce(uuid, none).alias("record_uuid"),
        _millis(F.get_json_object("line", "$.timestamp")).alias("ts"), identity.alias("identity"), detail.alias("detail"),
    )
    return rows.filter("type = 'compaction'").select("path", event.alias("e")).groupBy("path").agg(F.array_sort(F.collect_list("e")).alias("events"))
