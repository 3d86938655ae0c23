"""Transcripts in JSON Lines: complete lines with their places, kinds of records, admission.

Files are read as text, never with an inferred schema: a line is a record only if
a line break ends it, and where it starts must stay known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Why a file is not taken in.
REJECTIONS = ["no_session_envelope", "auxiliary_workflow", "auxiliary_agent_artifact", "malformed_complete_record", "unsupported_unit_shape", "identity_mismatch"]
#: What is read of a record in the style of Claude's transcripts.
RECORD = (
    "type string, subtype string, uuid string, parentUuid string, sessionId string, agentId string, isSidechain boolean, "
    "isCompactSummary boolean, timestamp string, cwd string, customTitle string, aiTitle string, message struct<role: string, model: string>"
)
BLOCKS = "array<struct<type: string, text: string, id: string, name: string, input: string, tool_use_id: string, content: string>>"


def complete_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, byte_offset, line) of every line that a line break ends.

    The last line of a file may be torn: then the lines and their breaks are one
    byte more than the file has. Files are told apart by path, so each is ordered
    by itself.
    """
    # a task of its own for the listing of each folder costs more than the listing
    key, few = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    before = spark.conf.get(key)
    spark.conf.set(key, min(few, int(before)))
    try:
        raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    finally:
        spark.conf.set(key, before)
    placed = raw.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    ).withColumn("bytes", F.octet_length("line") + 1)
    order = Window.partitionBy("path").orderBy("block", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumns(
        {"line_no": F.row_number().over(order).cast("long") - 1, "end": F.sum("bytes").over(upto)}
    ).withColumn("byte_offset", F.col("end") - F.col("bytes"))
    return rows.filter(F.col("end") <= F.col("size")).select("path", "line_no", "byte_offset", "line")


def native_id(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.jsonl)?$", 1)


def prose(content: Column) -> Column:
    """The text of a message's content: a string, or the text blocks of an array."""
    blocks = F.from_json(content, BLOCKS)
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    joined = F.when(F.size(texts) > 0, F.array_join(texts, "\n"))
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), joined).otherwise(content)


def activities(content: Column) -> Column:
    """array<struct<kind, name, text, id>> of tool calls and results."""
    blocks = F.from_json(content, BLOCKS)
    tools = F.filter(blocks, lambda b: b["type"].isin("tool_use", "tool_result"))
    made = F.transform(
        tools,
        lambda b: F.struct(
            F.when(b["type"] == "tool_use", "call").otherwise("result").alias("kind"),
            b["name"].alias("name"),
            F.coalesce(b["input"], b["content"]).alias("text"),
            F.coalesce(b["id"], b["tool_use_id"]).alias("id"),
        ),
    )
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), made)


def records(lines: DataFrame) -> DataFrame:
    """Parsed records: place, identity, role, prose, tools, kind; ``valid`` is false for broken JSON."""
    content = F.get_json_object("line", "$.message.content")
    parsed = lines.select(
        "path", "line_no", "byte_offset", F.try_parse_json("line").isNotNull().alias("valid"), F.from_json("line", RECORD).alias("r"), content.alias("__c")
    )
    flat = parsed.select("path", "line_no", "byte_offset", "valid", "r.*", "__c").withColumns(
        {"prose": prose(F.col("__c")), "tools": activities(F.col("__c")), "thinking": F.coalesce(F.col("__c").rlike('"type"\\s*:\\s*"thinking"'), F.lit(False))}
    )
    role = F.coalesce(F.col("message.role"), F.col("type"))
    said = F.trim(F.coalesce("prose", F.lit(""))) != ""
    kind = (
        F.when(role == "system", "developer_system")
        .when(F.coalesce("isCompactSummary", F.lit(False)), "control_context")
        .when((role == "user") & said, "real_user")
        .when((role == "assistant") & said, "assistant_dialogue_prose")
        .when(F.coalesce(F.size("tools"), F.lit(0)) > 0, "tool")
        .when(F.col("thinking"), "control_context")
        .otherwise("unclassified")
    )
    return flat.withColumns({"role": role, "record_kind": kind}).drop("__c", "thinking", "message")


def admission(rec: DataFrame) -> DataFrame:
    """(path, native_id, admitted, reason): which files are sessions, and why the others aren't."""
    own = native_id(F.col("path"))
    envelope = F.col("type").isin("user", "assistant") & F.col("sessionId").isNotNull()
    per = rec.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("valid")).alias("broken"),
        F.count_if(F.col("type") == "workflow").alias("workflow"),
        F.count_if(envelope).alias("envelopes"),
        F.count("sessionId").alias("named"),
        F.count_if(F.col("sessionId") == own).alias("own"),
        F.count_if(F.coalesce("isSidechain", F.lit(False))).alias("side"),
        F.countDistinct("sessionId").alias("ids"),
    )
    worker = native_id(F.col("path")).rlike("(?i)^agent-[a-z0-9][a-z0-9-]*$") & (F.col("ids") == 1) & (F.col("side") == F.col("n"))
    ours = (F.col("own") > 0) & (F.col("own") >= 0.95 * F.col("named"))
    reason = (
        F.when(F.col("broken") > 0, "malformed_complete_record")
        .when(F.col("workflow") == F.col("n"), "auxiliary_workflow")
        .when((F.col("named") > 0) & ~worker & ~ours, "identity_mismatch")
        .when(F.col("envelopes") == 0, "no_session_envelope")
    )
    return per.select("path", own.alias("native_id"), reason.isNull().alias("admitted"), reason.alias("reason"))


def titles(rec: DataFrame) -> DataFrame:
    """Title candidates (path, title, source, position): last custom, last generated, first real user."""
    custom = rec.filter("customTitle IS NOT NULL").select("path", F.col("customTitle").alias("title"), F.lit("explicit").alias("source"), (-F.col("line_no")).alias("position"))
    made = rec.filter("aiTitle IS NOT NULL").select("path", F.col("aiTitle").alias("title"), F.lit("explicit").alias("source"), (1_000_000_000 - F.col("line_no")).alias("position"))
    first = rec.filter("record_kind = 'real_user'").select("path", F.col("prose").alias("title"), F.lit("fallback").alias("source"), F.col("line_no").alias("position"))
    return custom.unionByName(made).unionByName(first)


def origin(rec: DataFrame) -> DataFrame:
    """(path, origin, reasons): votes of the records; both kinds of votes make it mixed."""
    agent = F.coalesce("isSidechain", F.lit(False)) | F.col("agentId").isNotNull()
    vote = F.when(agent, "agent").when(F.col("record_kind") == "real_user", "human")
    why = F.when(F.coalesce("isSidechain", F.lit(False)), "isSidechain").when(F.col("agentId").isNotNull(), "agentId").when(F.col("record_kind") == "real_user", "real-user")
    per = rec.groupBy("path").agg(F.collect_set(vote).alias("v"), F.array_join(F.array_sort(F.collect_set(why)), ",").alias("reasons"))
    return per.select("path", F.when(F.size("v") > 1, "mixed").when(F.size("v") == 1, F.col("v")[0]).otherwise("unknown").alias("origin"), "reasons")


def continuity(rec: DataFrame) -> DataFrame:
    """(path, line_no, event, uuid): where a session was compacted."""
    rows = rec.filter("type = 'system' AND subtype = 'compact_boundary'")
    return rows.select("path", "line_no", F.lit("compact_boundary").alias("event"), "uuid")


def continuity_events(lines: DataFrame) -> DataFrame:
    """(path, events): events of compaction as ``operators.continuity`` takes them; only records that say so count."""
    field = lambda name: F.get_json_object("line", f"$.{name}")
    rows = lines.filter((field("type") == "system") & (field("subtype") == "compact_boundary"))
    ts = F.unix_millis(F.try_to_timestamp(field("timestamp"))).alias("ts")
    uuid, message = field("uuid"), field("message.id")
    identity = F.when(uuid.isNotNull(), "uuid").when(message.isNotNull(), "message-id").otherwise("none").alias("identity")
    detail = F.when(F.startswith(field("compactMetadata"), F.lit("{")), field("compactMetadata")).alias("detail")
    event = F.struct(F.lit("compaction").alias("kind"), F.col("line_no").cast("long").alias("ordinal"), message.alias("record_id"), uuid.alias("record_uuid"), ts, identity, detail)
    return rows.select("path", event.alias("e")).groupBy("path").agg(F.array_sort(F.collect_list("e")).alias("events"))


def turns(rec: DataFrame) -> DataFrame:
    """Adds ``turn``: how many turn contexts came before in the file."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rec.withColumn("turn", F.sum(F.when(F.col("type") == "turn_context", 1).otherwise(0)).over(w))


def change_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(path, token): changes when a file does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    token = F.sha2(F.concat_ws(":", "path", F.unix_millis("modificationTime").cast("string"), F.col("length").cast("string")), 256)
    return files.select("path", token.alias("token"))
