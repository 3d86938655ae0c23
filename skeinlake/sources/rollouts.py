"""Transcripts of other harnesses in JSON Lines: rollouts (Codex) and contexts (Kimi).

Both take lines with their places, as ``jsonl.complete_lines`` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UUID = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\.jsonl$"
#: What is read of a rollout's line; content stays JSON.
ROLLOUT = (
    "timestamp string, type string, payload struct<type: string, id: string, role: string, name: string, arguments: string, input: string, output: string, "
    "call_id: string, cwd: string, source: string, forked_from_id: string, parent_thread_id: string, model: string, context_kind: string, content: string, "
    "metadata: struct<kind: string, source: string>, item: struct<type: string, id: string, response_item_id: string, responseItemId: string, content: string, text: string>, "
    "item_type: string, item_id: string, response_item_id: string>"
)
BLOCKS = "array<struct<type: string, text: string, content: string, name: string, id: string, call_id: string>>"
#: Kinds of context that a harness speaks in the user's name.
INJECTED = ["agents_instructions", "environment_context", "project_context", "injected_context", "turn_abort"]
CONTROL_TEXT = (
    r"(?s)^# AGENTS\.md instructions for [^\n]+(?:\n.*)?$|^<(?:environment_context|project_context|developer_instructions)>.*"
    r"</(?:environment_context|project_context|developer_instructions)>$|^<turn_aborted>(?:.*</turn_aborted>)?$"
)


def _is_array(content: Column) -> Column:
    return F.startswith(F.ltrim(content), F.lit("["))


def _is_output(block: Column) -> Column:
    return F.coalesce(block["type"], F.lit("")).isin("tool_result", "tool_output", "function_call_output", "custom_tool_call_output")


def block_text(content: Column) -> Column:
    """A string, or the texts of an array's blocks that aren't outputs of tools."""
    texts = F.transform(F.filter(F.from_json(content, BLOCKS), lambda b: b["text"].isNotNull() & ~_is_output(b)), lambda b: b["text"])
    return F.when(~_is_array(content), content).when(F.size(texts) > 0, F.array_join(texts, "\n"))


def _named(*columns: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def rollout_lines(lines: DataFrame) -> DataFrame:
    """(path, line_no, turn, at, type, p): parsed lines; ``turn`` counts the turns begun so far, from 0."""
    parsed = lines.select("path", "line_no", F.from_json("line", ROLLOUT).alias("r"))
    rows = parsed.select("path", "line_no", F.col("r.timestamp").alias("at"), F.col("r.type").alias("type"), F.col("r.payload").alias("p"))
    begins = (F.col("type") == "turn_context") | ((F.col("type") == "event_msg") & (F.col("p.type") == "task_started"))
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("turn", F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(order) - 1)


def rollout_records(rows: DataFrame) -> DataFrame:
    """(path, line_no, turn, record_kind, response_role, prose, tool_text, response_id) of the lines that are records."""
    p = F.col("p")
    answer = F.col("type") == "response_item"
    message = answer & (p["type"] == "message")
    call = answer & p["type"].isin("function_call", "custom_tool_call")
    result = answer & p["type"].isin("function_call_output", "custom_tool_call_output")
    context = F.col("type").isin("turn_context", "world_state") | (answer & (p["type"] == "reasoning"))
    prose = F.when(message, block_text(p["content"]))
    outputs = F.filter(F.from_json(p["content"], BLOCKS), _is_output)
    has_tool = message & _is_array(p["content"]) & (F.size(outputs) > 0)
    said = F.coalesce(F.trim(prose) != "", F.lit(False))
    role = F.when(message & p["role"].isin("user", "assistant", "developer", "system"), p["role"])
    injected = F.coalesce(_named(p["context_kind"], p["metadata"]["kind"], p["metadata"]["source"]).isin(INJECTED), F.lit(False))
    injected = injected | F.coalesce(F.trim(prose).rlike(CONTROL_TEXT), F.lit(False))
    kind = (
        F.when(context, "control_context")
        .when(call | result, "tool")
        .when(role.isin("developer", "system"), "developer_system")
        .when((role == "user") & injected, "control_context")
        .when(F.coalesce(has_tool, F.lit(False)) & ~said, "tool")
        .when((role == "user") & said, "real_user")
        .when((role == "assistant") & said, "assistant_dialogue_prose")
        .when(message, "unclassified")
    )
    tool_text = F.when(call, F.coalesce(p["arguments"], p["input"])).when(result, p["output"])
    tool_text = tool_text.when(has_tool, F.array_join(F.transform(outputs, lambda b: F.coalesce(b["text"], b["content"])), "\n"))
    made = rows.withColumn("record_kind", kind).filter("record_kind IS NOT NULL")
    return made.select(
        "path", "line_no", "turn", "record_kind", role.alias("response_role"), prose.alias("prose"), tool_text.alias("tool_text"), F.when(answer, _named(p["id"])).alias("response_id")
    )


def completions(rows: DataFrame) -> DataFrame:
    """(path, line_no, turn, response_role, prose, response_id): items that events report as completed."""
    item = F.col("p.item")
    kind = F.lower(F.regexp_replace(F.coalesce(item["type"], F.col("p.item_type")), "_", ""))
    role = F.when(kind == "usermessage", "user").when(kind == "agentmessage", "assistant")
    own = _named(item["response_item_id"], item["responseItemId"], F.col("p.response_item_id"), F.col("p.item_id"), item["id"])
    done = rows.filter((F.col("type") == "event_msg") & (F.col("p.type") == "item_completed"))
    text = block_text(F.coalesce(item["content"], item["text"], F.col("p.content")))
    return done.select("path", "line_no", "turn", role.alias("response_role"), text.alias("prose"), own.alias("response_id")).filter("response_role IS NOT NULL")


def associated(records: DataFrame, done: DataFrame) -> DataFrame:
    """(path, line_no) of the records that a completion is about.

    Completions are taken in their order. One with a known response id means the first record of that id and role, taken or
    not. Others mean the last record before them, in their turn, of their role and with their text, that no
    completion has taken by then: a stack, folded per turn, role and text, from which records go as well when they are named.
    """
    key = ["path", "response_id", "response_role"]
    by_id = records.filter("response_id IS NOT NULL").groupBy(*key).agg(F.min("line_no").alias("meant"))
    both = done.join(by_id, key, "left")
    found = both.filter("meant IS NOT NULL").select("path", F.col("meant").alias("line_no")).distinct()
    # a record leaves its stack with the first completion that names it
    named = both.filter("meant IS NOT NULL").groupBy("path", F.col("meant").alias("record")).agg(F.min("line_no").alias("line_no"))
    free = records.filter("prose IS NOT NULL AND response_role IS NOT NULL")
    group = ["path", "turn", "response_role", F.sha2("prose", 256).alias("digest")]
    none = F.lit(None).cast("bigint")
    pushes = free.select(*group, "line_no", F.lit(0).alias("what"), F.col("line_no").alias("record"))
    leaves = free.select(*group, F.col("line_no").alias("record")).join(named, ["path", "record"])
    # one that was named before it came never enters
    early = named.filter("line_no < record").select("path", F.col("record"))
    pushes = pushes.join(early, ["path", "record"], "left_anti").select(*pushes.columns)
    gone = leaves.select("path", "turn", "response_role", "digest", "line_no", F.lit(1).alias("what"), "record")
    pops = both.filter("meant IS NULL AND turn >= 0 AND prose IS NOT NULL").select(*group, "line_no", F.lit(2).alias("what"), none.alias("record"))
    events = pushes.unionByName(gone).unionByName(pops)
    told = events.groupBy("path", "turn", "response_role", "digest").agg(F.array_sort(F.collect_list(F.struct("line_no", "what", "record"))).alias("e"))
    empty = F.array().cast("array<bigint>")

    def step(s: Column, e: Column) -> Column:
        left = F.size(s["stack"])
        pushed = F.struct(F.concat(s["stack"], F.array(e["record"])).alias("stack"), s["taken"].alias("taken"))
        named_one = F.struct(F.array_remove(s["stack"], e["record"]).alias("stack"), s["taken"].alias("taken"))
        popped = F.struct(
            F.slice(s["stack"], 1, F.greatest(left - 1, F.lit(0))).alias("stack"), F.concat(s["taken"], F.array(F.try_element_at(s["stack"], F.lit(-1)))).alias("taken")
        )
        return F.when(e["what"] == 0, pushed).when(e["what"] == 1, named_one).when(left > 0, popped).otherwise(s)

    start = F.struct(empty.alias("stack"), empty.alias("taken"))
    taken = told.select("path", F.explode(F.aggregate("e", start, step)["taken"]).alias("line_no"))
    return found.unionByName(taken).distinct()


def rollout_admission(rows: DataFrame) -> DataFrame:
    """(path, native_id, reason): which rollouts are sessions.

    Several ids are fine if the others are the ones that headers say they were forked from.
    """
    meta = F.col("type") == "session_meta"
    own, parent = F.when(meta, _named(F.col("p.id"))), F.when(meta, _named(F.col("p.forked_from_id")))
    per = rows.groupBy("path").agg(
        F.collect_set(own).alias("ids"), F.collect_set(parent).alias("parents"), F.min_by(own, F.when(own.isNotNull(), F.col("line_no"))).alias("first"),
        F.count_if(meta).alias("metas"), F.count_if(F.col("type") == "response_item").alias("answers"),
    )
    named = F.nullif(F.regexp_extract("path", UUID, 1), F.lit(""))
    others = F.array_except("ids", F.array("first"))
    forked = (F.size("ids") > 1) & (F.size(F.array_except(others, F.col("parents"))) == 0)
    reason = (
        F.when((F.size("ids") > 1) & ~forked, "identity_mismatch")
        .when(F.col("first").isNotNull() & named.isNotNull() & (F.lower("first") != F.lower(named)), "identity_mismatch")
        .when((F.size("ids") == 0) & (named.isNull() | (F.col("answers") == 0)), "no_session_envelope")
    )
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.jsonl)?$", 1)
    return per.select("path", F.coalesce("first", named, stem).alias("native_id"), reason.alias("reason"))


def index_titles(lines: DataFrame) -> DataFrame:
    """(id, title): the last title that isn't blank for each id of an index of sessions."""
    r = F.from_json("line", "id string, thread_name string")
    named = lines.select(r.alias("r"), "path", "line_no").filter((F.trim("r.id") != "") & (F.trim("r.thread_name") != ""))
    return named.groupBy(F.col("r.id").alias("id")).agg(F.max_by("r.thread_name", F.struct("path", "line_no")).alias("title"))


def context_records(lines: DataFrame) -> DataFrame:
    """(path, line_no, record_id, record_kind, side, prose, checkpoint) of Kimi's contexts."""
    r = F.from_json("line", "role string, id string, content string, tool_calls string, tool_call_id string")
    rows = lines.select("path", "line_no", r.alias("r")).select("path", "line_no", "r.*")
    blocks = F.from_json("content", BLOCKS)
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    whole = F.when(_is_array(F.col("content")), F.array_join(texts, "\n")).otherwise(F.col("content"))
    prose = F.nullif(F.regexp_replace(whole, r"^\s+|\s+$", ""), F.lit(""))
    thinks = _is_array(F.col("content")) & F.exists(blocks, lambda b: F.coalesce(b["type"], F.lit("")).isin("think", "thinking", "reasoning"))
    tools = F.coalesce(F.col("tool_calls").rlike(r"^\[\s*\{"), F.lit(False))
    role = F.coalesce("role", F.lit("unknown"))
    kind = (
        F.when(role == "_system_prompt", "developer_system")
        .when(role == "_usage", "telemetry")
        .when(role == "_checkpoint", "control_context")
        .when((role == "user") & prose.isNotNull(), "real_user")
        .when((role == "assistant") & prose.isNotNull(), "assistant_dialogue_prose")
        .when((role == "tool") | tools, "tool")
        .when((role == "assistant") & F.coalesce(thinks, F.lit(False)), "control_context")
        .when(role.isin("system", "developer"), "developer_system")
        .otherwise("unclassified")
    )
    made = rows.withColumns({"record_kind": kind, "said": prose, "checkpoint": role == "_checkpoint"})
    side = F.when(F.col("record_kind") == "real_user", "user").when(F.col("record_kind") == "assistant_dialogue_prose", "assistant")
    shown = F.when(F.col("record_kind").isin("real_user", "assistant_dialogue_prose", "developer_system", "unclassified"), F.col("said"))
    return made.select("path", "line_no", F.col("id").alias("record_id"), "record_kind", side.alias("side"), shown.alias("prose"), "checkpoint")


def context_events(records: DataFrame) -> DataFrame:
    """(path, events): the checkpoints of contexts as ``operators.continuity`` takes them."""
    none = F.lit(None).cast("string")
    identity = F.when(F.col("record_id").isNotNull(), "record-id").otherwise("none").alias("identity")
    event = F.struct(
        F.lit("checkpoint").alias("kind"), F.col("line_no").cast("long").alias("ordinal"), F.col("record_id"), none.alias("record_uuid"), none.cast("long").alias("ts"), identity,
        F.lit("kimi:_checkpoint").alias("detail"),
    )
    return records.filter("checkpoint").select("path", event.alias("e")).groupBy("path").agg(F.array_sort(F.collect_list("e")).alias("events"))


def context_identity(path: Column) -> Column:
    """struct(native_id, parent): of a context's path; null if it isn't one. Sub-agents name their parent."""
    child = r"([^/]+)/subagents/([^/]+)/context\.jsonl$"
    parent, own = F.regexp_extract(path, child, 1), F.regexp_extract(path, child, 2)
    direct = F.regexp_extract(path, r"([^/]+)/context\.jsonl$", 1)
    below = F.struct(F.concat(parent, F.lit("/subagent/"), own).alias("native_id"), parent.alias("parent"))
    return F.when(parent != "", below).when(direct != "", F.struct(direct.alias("native_id"), F.lit(None).cast("string").alias("parent")))
