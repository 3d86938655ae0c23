"""Sessions and messages from the tables that harnesses keep in SQLite, read by ``sqlite.SqliteSource``.

Kilo, OpenCode and ZCode keep messages in parts, whose JSON says what they are; rows count in the order of their tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlake.functions.text import WHITE
from skeinlake.sources.jsonl import UUID
from skeinlake.sources.sqlite import SqliteSource

#: Columns of the tables; ``source_rowid`` and ``source_path`` come from the source.
SCHEMAS = {
    "session": "source_path string, source_rowid long, id string, parent_id string, directory string, title string, time_created string, time_updated string, task_type string",
    "message": "source_path string, source_rowid long, id string, session_id string, time_created string, data string",
    "part": "source_path string, source_rowid long, id string, message_id string, time_created string, data string",
    "sessions": "source_path string, id string, parent_session_id string, title string",
    "messages": "source_path string, id string, session_id string, role string, content string, tool_calls string, tool_call_id string, platform_message_id string, timestamp string",
}
#: Parts that are tools, and those that tell of control.
KILO_TOOLS = ["tool", "tool-invocation", "tool-call", "tool-result", "tool-output"]
CONTROL = "(?i)reasoning|thinking|control"
#: Fixed value: records of an agent's transcript that are kept besides those with text.
PROTOCOL = "(?i)stream|protocol|delta|turn_|model_"
TOOL_TEXT = 8000


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of ``SCHEMAS`` from all SQLite files below a path."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("table", table).schema(SCHEMAS[table]).load(path)


def _millis(at: Column) -> Column:
    """A number of milliseconds, or a date and time."""
    number = at.try_cast("double")
    return F.when(number.isNotNull(), F.round(number).cast("long")).otherwise(F.unix_millis(F.try_to_timestamp(at)))


def _seconds_or_millis(at: Column) -> Column:
    """Epoch milliseconds of a number that may count seconds."""
    number = at.cast("double")
    return F.when(number < 1e11, F.round(number * 1000)).otherwise(number).cast("long")


def _said(text: Column) -> Column:
    return F.nullif(F.btrim(text, F.lit(WHITE)), F.lit(""))


def _hermes_kind(role: Column, prose: Column, tools: Column) -> Column:
    return (
        F.when((role == "user") & prose.isNotNull(), "real_user")
        .when((role == "assistant") & prose.isNotNull(), "assistant_dialogue_prose")
        .when(tools | (role == "tool"), "tool")
        .when(role.isin("system", "developer"), "developer_system")
        .otherwise("unclassified")
    )


def hermes(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(native_id, parent, title, ordinal, record_id, role, record_kind, prose, ts) from tables sessions and messages.

    Messages are ordered by time and id; a message's own id of the platform comes before the table's.
    """
    role = F.coalesce(F.lower(F.trim("role")), F.lit("unknown"))
    prose = F.when(role != "tool", _said(F.col("content")))
    tools = F.coalesce(F.trim("tool_calls").rlike(r"^\[\s*\S*[^\]\s]"), F.lit(False)) | F.col("tool_call_id").isNotNull()
    own = F.coalesce(F.nullif(F.trim("platform_message_id"), F.lit("")), F.col("id").cast("string"))
    # ids of a table are numbers, whatever type they are read as
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("timestamp").cast("double"), F.col("id").try_cast("long"), "id")) - 1
    rows = messages.select(
        F.col("session_id").alias("native_id"), place.alias("ordinal"), own.alias("record_id"), role.alias("role"),
        _hermes_kind(role, prose, tools).alias("record_kind"), prose.alias("prose"), _seconds_or_millis(F.col("timestamp")).alias("ts"),
    )
    heads = sessions.select(F.col("id").alias("native_id"), F.col("parent_session_id").alias("parent"), "title")
    return rows.join(heads, "native_id")


def _field(path: str) -> Column:
    return F.nullif(F.btrim(F.get_json_object("data", path), F.lit(WHITE)), F.lit(""))


def _raw(*paths: str) -> Column:
    """The first of some fields that holds something, as JSON in the order it was written."""
    held = [F.nullif(F.get_json_object("data", p), F.lit("")) for p in paths]
    # __v is the part as a variant, which knows texts from other values
    text = [F.schema_of_variant(F.try_variant_get("__v", p, "variant")) == "STRING" for p in paths]
    told = [F.when(F.coalesce(t, F.lit(False)), F.regexp_extract(F.to_json(F.array(h)), r"(?s)^\[(.*)\]$", 1)).otherwise(h) for t, h in zip(text, held)]
    return F.coalesce(*told)


def _tool(kinds: list[str]) -> Column:
    """struct(kind, name, text, id) of a part that is a tool or, for harnesses that have them, a file; else null."""
    result = _raw("$.state.output", "$.state.result", "$.state.error")
    pairs = [("status", _raw("$.state.status", "$.status")), ("input", _raw("$.state.input", "$.input")), ("output", F.coalesce(result, _raw("$.output")))]
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in pairs]), F.lit("}"))
    ended = _field("$.type").isin("tool-result", "tool-output") | result.isNotNull()
    tool = F.struct(
        F.when(ended, "result").otherwise("call").alias("kind"), F.coalesce(_field("$.tool"), _field("$.name")).alias("name"), F.substring(body, 1, TOOL_TEXT).alias("text"),
        F.coalesce(_field("$.callID"), _field("$.id"), F.col("id")).alias("id"),
    )
    file = F.struct(F.lit("attachment").alias("kind"), F.coalesce(_field("$.filename"), F.lit("attachment")).alias("name"), F.substring("data", 1, TOOL_TEXT).alias("text"), F.col("id").alias("id"))
    found = F.when(_field("$.type").isin(*[k for k in kinds if k != "file"]), tool)
    return found.when(_field("$.type") == "file", file) if "file" in kinds else found


def in_parts(session: DataFrame, message: DataFrame, part: DataFrame, tools: list[str], message_control: bool = False) -> DataFrame:
    """(native_id, parent, title, cwd, ordinal, record_id, role, record_kind, side, prose, tools, ts) of messages in parts."""
    kind, tool = _field("$.type"), _tool(tools)
    text = F.when(kind == "text", F.get_json_object("data", "$.text"))
    controls = F.coalesce(kind.rlike(CONTROL), F.lit(False)) & text.isNull() & tool.isNull()
    place = F.col("source_rowid").alias("at")
    read = part.withColumn("__v", F.try_parse_json("data")).select("source_path", "message_id", F.struct(place, text.alias("x")).alias("text"), F.struct(place, tool.alias("x")).alias("tool"), controls.alias("control"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(f"{c}.x").isNotNull(), F.col(c)))), lambda e: e["x"])
    parts = read.groupBy("source_path", "message_id").agg(F.array_join(listed("text"), "\n").alias("text"), listed("tool").alias("tools"), F.bool_or("control").alias("control"))
    rows = message.join(parts.withColumnRenamed("message_id", "id"), ["source_path", "id"], "left")
    role = F.coalesce(F.lower(_field("$.role")), F.lit("unknown"))
    prose = _said(F.coalesce("text", F.lit("")))
    control = F.coalesce("control", F.lit(False))
    if message_control:
        control = control | F.coalesce(kind.rlike(CONTROL), F.lit(False))
    record_kind = (
        F.when((role == "user") & prose.isNotNull(), "real_user")
        .when((role == "assistant") & prose.isNotNull(), "assistant_dialogue_prose")
        .when(role.isin("system", "developer"), "developer_system")
        .when(F.coalesce(F.size("tools") > 0, F.lit(False)), "tool")
        .when(control, "control_context")
        .otherwise("unclassified")
    )
    order = F.row_number().over(Window.partitionBy("source_path", "session_id").orderBy("source_rowid")) - 1
    told = rows.select(
        "source_path", F.col("session_id").alias("native_id"), order.alias("ordinal"), F.nullif(F.trim("id"), F.lit("")).alias("record_id"), role.alias("role"),
        record_kind.alias("record_kind"), prose.alias("prose"), F.coalesce("tools", F.array().cast(TOOLS)).alias("tools"), _millis(F.col("time_created")).alias("ts"),
    ).withColumn("side", _side())
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    heads = session.select("source_path", F.col("id").alias("native_id"), blank("parent_id").alias("parent"), blank("title").alias("title"), blank("directory").alias("cwd"))
    return told.join(heads, ["source_path", "native_id"])


TOOLS = "array<struct<kind:string,name:string,text:string,id:string>>"


def _side() -> Column:
    return F.when(F.col("record_kind") == "real_user", "user").when(F.col("record_kind") == "assistant_dialogue_prose", "assistant")


def kilo(session: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    """Kilo's messages; a message whose own type tells of reasoning or control is control. OpenCode's tables are read alike."""
    return in_parts(session, message, part, KILO_TOOLS, message_control=True)


def placeholder_title(title: Column) -> Column:
    """Whether a title is what a harness puts before anything was said: a new session and a time."""
    at = F.regexp_extract(F.trim(title), "^New session - (.+)$", 1)
    return F.coalesce((at != "") & F.try_to_timestamp(at).isNotNull(), F.lit(False))


def zcode(session: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    """ZCode's messages from its database; files are attachments."""
    return in_parts(session, message, part, ["tool", "file"])


def zcode_origin(session: DataFrame) -> DataFrame:
    """(native_id, origin): children of other sessions are agents."""
    child = F.col("parent_id").isNotNull() | F.coalesce(F.trim("task_type") == "subagent_child", F.lit(False))
    return session.select(F.col("id").alias("native_id"), F.when(child, "agent").otherwise("human").alias("origin"))


def zcode_transcripts(lines: DataFrame) -> DataFrame:
    """(path, native_id, parent, ordinal, line_no, record_id, role, record_kind, side, prose, tools, ts) of agents' transcripts in JSON lines.

    A transcript has one session id, or it isn't one. Of a run of streamed deltas the last stands for all. The
    folder above the agent's names the parent session.
    """
    get = lambda p: F.nullif(F.btrim(F.get_json_object("line", p), F.lit(WHITE)), F.lit(""))
    rows = lines.select("path", "line_no", get("$.type").alias("type"), get("$.sessionId").alias("sid"), get("$.id").alias("record_id"), get("$.payload.input").alias("asked"), get("$.payload.response").alias("answered"), F.get_json_object("line", "$.timestamp").alias("stamp"))
    ids = rows.groupBy("path").agg(F.collect_set("sid").alias("ids")).filter(F.size("ids") == 1).select("path", F.col("ids")[0].alias("native_id"))
    order = Window.partitionBy("path").orderBy("line_no")
    typed = rows.filter("type IS NOT NULL").withColumn("next", F.lead("type").over(order))
    streamed = F.col("type") == "model_streaming"
    kept = typed.filter(F.when(streamed, F.coalesce(F.col("next") != "model_streaming", F.lit(True))).otherwise(F.col("type").rlike(PROTOCOL)))
    begun, done = F.col("type") == "turn_started", F.col("type") == "turn_complete"
    prose = F.when(begun, F.col("asked")).when(done, F.col("answered"))
    record_kind = F.when(begun & prose.isNotNull(), "real_user").when(done & prose.isNotNull(), "assistant_dialogue_prose").otherwise("control_context")
    above = F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1)
    made = kept.join(ids, "path").select(
        "path", "native_id", F.when(above.startswith("sess_"), above).alias("parent"), (F.row_number().over(order) - 1).alias("ordinal"), "line_no", "record_id",
        F.when(begun, "user").when(done, "assistant").otherwise("system").alias("role"), record_kind.alias("record_kind"), prose.alias("prose"), F.array().cast(TOOLS).alias("tools"), _millis(F.col("stamp")).alias("ts"),
    )
    return made.withColumn("side", _side())


# --- several sources of one session ----------------------------------------------------------


def semantic_bytes(records: DataFrame, *unit: str) -> DataFrame:
    """(unit, semantic_bytes): the size of what a source tells of a session, as JSON of its records."""
    json_of = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1))
    tools = F.transform(
        F.col("tools"),
        lambda t, i: F.struct(i.alias("activityOrdinal"), t["kind"].alias("activityKind"), t["name"].alias("toolName"), t["text"].alias("toolText"), t["id"].alias("sourceActivityId")),
    )
    parts = [json_of("record_kind"), json_of("side"), json_of("prose"), F.coalesce(F.col("ts").cast("string"), F.lit("null")), json_of("record_id"), F.to_json(tools, {"ignoreNullFields": "false"})]
    one = F.octet_length(F.concat_ws(",", *parts)) + 2
    return records.groupBy(*unit).agg((F.sum(one) + F.count(F.lit(1)) + 1).alias("semantic_bytes"))


def elected(candidates: DataFrame) -> DataFrame:
    """The candidate (native_id, source, place, semantic_bytes) of each session that tells most; ties go to the first place, then source."""
    best = Window.partitionBy("native_id").orderBy(F.col("semantic_bytes").desc(), "place", "source")
    return candidates.withColumn("__rn", F.row_number().over(best)).filter("__rn = 1").drop("__rn")


def aligned(one: DataFrame, other: DataFrame) -> DataFrame:
    """(native_id, record_id, status) of the records with an id in two sources: same, contradicting, only_first, only_second."""
    told = lambda df, n: df.filter("record_id IS NOT NULL").groupBy("native_id", "record_id").agg(F.min_by(F.struct("record_kind", "prose"), "ordinal").alias(n))
    both = told(one, "a").join(told(other, "b"), ["native_id", "record_id"], "full")
    status = F.when(F.col("b").isNull(), "only_first").when(F.col("a").isNull(), "only_second").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("contradicting")
    return both.select("native_id", "record_id", status.alias("status"))
