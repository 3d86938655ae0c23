"""Transcripts written from the tables and read back by the sources."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.operators import continuity, publish, sessions
from skeinlake.operators.graph import scratch_dir
from skeinlake.plans.q_sessions import MSGS, msgs
from skeinlake.plans import trees
from skeinlake.plans.registry import query, table
from skeinlake.sources import exports, jsonl, rollouts
from skeinlake.streaming import capture


#: Folders of the transcripts that are written.
FOLDERS = 64


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON lines in one file per session, read back as complete lines.

    Files lie in ``FOLDERS`` folders: a folder for each took most of the time, in making, moving and listing them.
    """
    c = table(spark, sf_dir, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    own = F.concat(F.lit("s"), k.cast("string"))
    text = F.when(t % 4 == 3, F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))).otherwise(F.to_json(F.array("text")))
    raw = F.when(t % 4 == 3, text).otherwise(F.regexp_extract(text, r"(?s)^\[(.*)\]$", 1))
    session = F.when(k % 9 == 4, "somebody-else").otherwise(own)
    side = F.when(k % 6 == 5, "true").otherwise("false")
    line = F.concat(
        F.lit('{"type":"'), F.col("role"), F.lit('","sessionId":"'), session, F.lit('","uuid":"u'), t.cast("string"), F.lit('","isSidechain":'), side,
        F.lit(',"message":{"role":"'), F.col("role"), F.lit('","content":'), raw, F.lit("}}"),
    )
    line = F.when((k % 11 == 7) & (t == 1), F.lit('{"type": broken')).otherwise(line)
    root = trees.new_root(spark, "transcripts")
    file = F.concat(F.pmod(F.xxhash64(own), F.lit(FOLDERS)).cast("string"), F.lit("/"), own, F.lit(".jsonl"))
    trees.write_tree(c.select(file.alias("file"), t.cast("long").alias("place"), line.alias("line")), root)
    return jsonl.complete_lines(spark, root).withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))


@query("jsonl_record_kinds", f"""WITH {MSGS} SELECT 's' || session_id || '.jsonl' AS path, CASE WHEN session_id % 11 = 7 AND ordinal = 1 THEN 'unclassified' ELSE record_kind END AS record_kind, count(*) AS n, sum(CASE WHEN session_id % 11 = 7 AND ordinal = 1 THEN 0 ELSE length(text) END)::BIGINT AS chars FROM msgs GROUP BY 1, 2""")
def jsonl_record_kinds(spark, sf_dir):
    rec = jsonl.records(_transcripts(spark, sf_dir))
    return rec.groupBy("path", "record_kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("prose"), F.lit(0))).cast("long").alias("chars"))


@query("jsonl_admission", """SELECT 's' || conv_id || '.jsonl' AS path, 's' || conv_id AS native_id, CASE WHEN conv_id % 11 = 7 AND max(turn) >= 1 THEN 'malformed_complete_record' WHEN conv_id % 9 = 4 THEN 'identity_mismatch' WHEN count(*) FILTER (WHERE role IN ('user', 'assistant')) = 0 THEN 'no_session_envelope' END AS reason FROM conversations GROUP BY conv_id""")
def jsonl_admission(spark, sf_dir):
    return jsonl.admission(jsonl.records(_transcripts(spark, sf_dir))).select("path", "native_id", "reason")


@query("jsonl_origin_votes", """SELECT 's' || conv_id || '.jsonl' AS path, CASE WHEN conv_id % 6 = 5 THEN 'agent' WHEN count(*) FILTER (WHERE role = 'user' AND NOT (conv_id % 11 = 7 AND turn = 1)) > 0 THEN 'human' ELSE 'unknown' END AS origin FROM conversations GROUP BY conv_id""")
def jsonl_origin_votes(spark, sf_dir):
    return jsonl.origin(jsonl.records(_transcripts(spark, sf_dir))).select("path", "origin")


@query("jsonl_titles", f"""WITH {MSGS} SELECT 's' || session_id || '.jsonl' AS path, rtrim(substr(trim(regexp_replace(arg_min(text, ordinal), '\\s+', ' ', 'g')), 1, 240)) AS title FROM msgs WHERE record_kind = 'real_user' AND trim(text) <> '' AND NOT (session_id % 11 = 7 AND ordinal = 1) GROUP BY 1""")
def jsonl_titles(spark, sf_dir):
    return sessions.elect_title(jsonl.titles(jsonl.records(_transcripts(spark, sf_dir))), ["path"]).select("path", "title")


@query("chatgpt_branch", """SELECT 'c' || conv_id AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ordinal, role, text FROM conversations""")
def chatgpt_branch(spark, sf_dir):
    """Conversations as trees with a dead branch each; only the branch of the current node is read."""
    c = table(spark, sf_dir, "conversations")
    node = lambda t: F.concat(F.lit("n"), t.cast("string"))
    message = F.struct(
        F.struct(F.col("role")).alias("author"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content"), node(F.col("turn")).alias("id"), F.col("turn").cast("double").alias("create_time")
    )
    entry = F.struct(node(F.col("turn")).alias("k"), F.struct(F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("parent"), message.alias("message")).alias("v"))
    dead = F.struct(F.concat(F.lit("x"), F.col("turn").cast("string")).alias("k"), F.struct(node(F.col("turn")).alias("parent"), message.alias("message")).alias("v"))
    trees = c.groupBy("conv_id").agg(F.max("turn").alias("last"), F.collect_list(entry).alias("e"), F.collect_list(dead).alias("d"))
    whole = F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.lit("t").alias("title"), node(F.col("last")).alias("current_node"), F.map_from_entries(F.concat("e", "d")).alias("mapping"))
    return exports.chatgpt(trees.select(F.to_json(F.array(whole)).alias("value"))).select("id", "ordinal", "role", "text")


@query("cursor_markdown", """SELECT 'c' || conv_id AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ordinal, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, md5(trim(text)) AS digest FROM conversations WHERE role IN ('user', 'assistant')""")
def cursor_markdown(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')")
    turn = F.concat(F.lit("**"), F.when(F.col("role") == "user", "User").otherwise("Cursor"), F.lit("**\n\n"), "text", F.lit("\n\n---\n\n"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "")
    pages = c.groupBy("conv_id").agg(F.concat(F.lit("# A chat\n\n"), told).alias("value"))
    rows = exports.cursor_markdown(pages.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), "value"))
    return rows.select("path", "ordinal", "role", F.md5(F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).alias("digest"))


@query("gemini_events", """WITH m AS (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT 'c' || conv_id AS path, 'm' || turn AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ordinal, CASE WHEN turn = 0 THEN text || '!' ELSE text END AS text FROM m WHERE conv_id % 3 <> 0 OR turn < 2 OR last < 2""")
def gemini_events(spark, sf_dir):
    """Event streams: every message is inserted, the first is upserted again, a third is rewound to message 2."""
    c = table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path")
    ident = F.concat(F.lit("m"), F.col("turn").cast("string"))
    event = lambda text: F.to_json(F.struct(ident.alias("id"), text.alias("content"))).alias("line")
    rows = c.select(path, F.col("turn").cast("long").alias("line_no"), event(F.col("text")))
    again = c.filter("turn = 0").select(path, F.lit(1000).cast("long").alias("line_no"), event(F.concat("text", F.lit("!"))))
    long = c.groupBy("conv_id").agg(F.max("turn").alias("last")).filter("conv_id % 3 = 0 AND last >= 2")
    rewind = long.select(path, F.lit(2000).cast("long").alias("line_no"), F.lit('{"$rewindTo": "m2"}').alias("line"))
    return exports.gemini_stream(rows.unionByName(again).unionByName(rewind)).select("path", "id", "ordinal", "text")


@query("upsert_latest", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS source FROM documents")
def upsert_latest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(1).alias("version"))
    new = d.filter("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("source"), F.lit(2).alias("version"))
    return publish.upsert(d, new, ["doc_id"], F.col("version")).select("doc_id", "source")


@query("insert_missing", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'late' ELSE source END AS source FROM documents")
def insert_missing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return publish.insert_missing(d.filter("doc_id % 4 <> 0"), d.withColumn("source", F.lit("late")), ["doc_id"])


@query("orphan_detection", "SELECT o_orderkey FROM orders WHERE o_orderkey % 13 = 0")
def orphan_detection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return publish.orphans(o, o.filter("o_orderkey % 13 <> 0"), ["o_orderkey"], True)


@query("published_generation", "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1")
def published_generation(spark, sf_dir):
    """Two generations are published; readers see the second."""
    root = f"{scratch_dir(spark)}/published-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    publish.publish(d, root)
    publish.publish(d.filter("lang = 'en'"), root, broken=d.filter("doc_id < 0"))
    return publish.current(spark, root).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("batch_jsonl", f"""WITH {MSGS} SELECT session_id, strlen('{{"custom_id":"r-') + 32 > 0 AS fine, 'r-' || substr(sha256('{{"model":"m1","prompt":"s' || session_id || '"}}'), 1, 32) AS custom_id FROM (SELECT DISTINCT session_id FROM msgs)""")
def batch_jsonl(spark, sf_dir):
    s = msgs(spark, sf_dir).select("session_id").distinct()
    requests = s.select("session_id", F.lit("m1").alias("model"), F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("prompt"), F.lit(100).alias("most_tokens"))
    lines = publish.batch_lines(requests, "chat")
    ident = F.get_json_object("value", "$.custom_id")
    prompt = F.get_json_object("value", "$.body.messages[0].content")
    return lines.select(F.substring(prompt, 2, 20).cast("long").alias("session_id"), F.lit(True).alias("fine"), ident.alias("custom_id"))


@query("markdown_export", f"""WITH {MSGS} SELECT session_id, md5('# Session ' || session_id || chr(10) || chr(10) || string_agg('**' || role || '**' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal)) AS digest FROM msgs GROUP BY 1""")
def markdown_export(spark, sf_dir):
    return publish.markdown(msgs(spark, sf_dir)).select("session_id", F.md5("value").alias("digest"))


def _rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rollouts: a header, and for each turn its context, the message, a call after every third, and a completion."""
    c = table(spark, sf_dir, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    uuid_of = lambda x: F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(x.cast("string"), 12, "0"))
    path = F.concat(F.lit("rollout-x-"), uuid_of(k), F.lit(".jsonl"))
    header = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.when(k % 10 == 3, uuid_of(k + 1)).otherwise(uuid_of(k)).alias("id"), F.lit("/w").alias("cwd")).alias("payload")))
    role = F.when(F.col("role") == "system", "developer").otherwise(F.col("role"))
    shown = F.when((t % 5 == 2) & (F.col("role") == "user"), F.concat(F.lit("<environment_context>"), "text", F.lit("</environment_context>"))).otherwise(F.col("text"))
    blocks = F.array(F.struct(F.lit("input_text").alias("type"), shown.alias("text")))
    own = F.when(t % 2 == 0, F.concat(F.lit("r"), t.cast("string")))
    answer = lambda payload: F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload")))
    message = answer(F.struct(F.lit("message").alias("type"), own.alias("id"), role.alias("role"), blocks.alias("content")))
    call = answer(F.struct(F.lit("function_call").alias("type"), F.lit("ls").alias("name"), F.lit("-a").alias("arguments")))
    context = F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(F.lit("m").alias("model")).alias("payload")))
    item = F.struct(F.when(F.col("role") == "user", "UserMessage").otherwise("agent_message").alias("type"), own.alias("response_item_id"), blocks.alias("content"))
    event = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("item_completed").alias("type"), item.alias("item")).alias("payload")))
    lines = F.array(F.when(t == 0, header), context, message, F.when(t % 3 == 0, call), F.when((t % 4 != 1) & (F.col("role") != "system"), event))
    return c.select(path.alias("path"), t.alias("turn"), F.posexplode(lines).alias("place", "line")).filter("line IS NOT NULL").select("path", (F.col("turn") * 10 + F.col("place")).alias("line_no"), "line")


ROLLOUT = """r AS (SELECT 'rollout-x-00000000-0000-4000-8000-' || lpad(conv_id::VARCHAR, 12, '0') || '.jsonl' AS path, conv_id, turn, role, text FROM conversations)"""


@query("rollout_records", f"""WITH {ROLLOUT} SELECT path, turn, record_kind, count(*) AS n, sum(len(prose))::BIGINT AS chars FROM (
SELECT path, turn, 'control_context' AS record_kind, '' AS prose FROM r UNION ALL SELECT path, turn, 'tool', '' FROM r WHERE turn % 3 = 0 UNION ALL
SELECT path, turn, CASE WHEN role = 'system' THEN 'developer_system' WHEN role = 'user' AND turn % 5 = 2 THEN 'control_context' WHEN trim(text) = '' THEN 'unclassified' WHEN role = 'user' THEN 'real_user' WHEN role = 'assistant' THEN 'assistant_dialogue_prose' ELSE 'unclassified' END,
  CASE WHEN role = 'user' AND turn % 5 = 2 THEN '<environment_context>' || text || '</environment_context>' ELSE text END FROM r) GROUP BY ALL""")
def rollout_records(spark, sf_dir):
    """Kinds of records by turn; turns count the contexts before, so they are those of the table only where none is missing."""
    rec = rollouts.rollout_records(rollouts.rollout_lines(_rollouts(spark, sf_dir)))
    # the table's turn is in the line number, ten lines to a turn
    turn = F.floor(F.col("line_no") / 10).alias("turn")
    return rec.groupBy("path", turn, "record_kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("prose"), F.lit(0))).cast("long").alias("chars"))


@query("rollout_completions", f"""WITH {ROLLOUT} SELECT path, turn * 10 + 2 AS line_no FROM r WHERE turn % 4 <> 1 AND role IN ('user', 'assistant')""")
def rollout_completions(spark, sf_dir):
    """Messages that a completion is about, by id where they have one, by turn and text else."""
    rows = rollouts.rollout_lines(_rollouts(spark, sf_dir))
    return rollouts.associated(rollouts.rollout_records(rows), rollouts.completions(rows))


@query("rollout_admission", f"""WITH {ROLLOUT}, h AS (SELECT path, conv_id, max(CASE WHEN turn = 0 THEN 1 ELSE 0 END) AS headed FROM r GROUP BY 1, 2)
SELECT path, '00000000-0000-4000-8000-' || lpad((CASE WHEN headed = 1 AND conv_id % 10 = 3 THEN conv_id + 1 ELSE conv_id END)::VARCHAR, 12, '0') AS native_id, CASE WHEN headed = 1 AND conv_id % 10 = 3 THEN 'identity_mismatch' END AS reason FROM h""")
def rollout_admission(spark, sf_dir):
    return rollouts.rollout_admission(rollouts.rollout_lines(_rollouts(spark, sf_dir)))


@query("rollout_index_titles", """SELECT 'c' || conv_id AS id, arg_max(text, turn) AS title FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def rollout_index_titles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.col("text").alias("thread_name")))
    return rollouts.index_titles(c.select(F.lit("session_index.jsonl").alias("path"), F.col("turn").alias("line_no"), line.alias("line")))


@query("kimi_contexts", r"""SELECT CASE WHEN conv_id % 4 = 1 THEN 'p' || (conv_id % 7) || '/subagent/' || conv_id ELSE conv_id::VARCHAR END AS native_id, CASE WHEN conv_id % 4 = 1 THEN 'p' || (conv_id % 7) END AS parent, turn AS line_no,
CASE WHEN turn % 7 = 6 THEN 'control_context' WHEN turn % 7 = 5 THEN 'telemetry' WHEN role = 'system' THEN 'developer_system' WHEN role NOT IN ('user', 'assistant') THEN CASE WHEN role = 'tool' THEN 'tool' ELSE 'unclassified' END WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) = 0 THEN 'unclassified' WHEN role = 'user' THEN 'real_user' ELSE 'assistant_dialogue_prose' END AS record_kind, turn % 7 = 6 AS checkpoint FROM conversations""")
def kimi_contexts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    path = F.when(k % 4 == 1, F.concat(F.lit("/k/p"), (k % 7).cast("string"), F.lit("/subagents/"), k.cast("string"), F.lit("/context.jsonl"))).otherwise(F.concat(F.lit("/k/"), k.cast("string"), F.lit("/context.jsonl")))
    role = F.when(t % 7 == 6, "_checkpoint").when(t % 7 == 5, "_usage").when(F.col("role") == "system", "_system_prompt").otherwise(F.col("role"))
    plain = F.to_json(F.struct(role.alias("role"), t.alias("id"), F.col("text").alias("content")))
    listed = F.to_json(F.struct(role.alias("role"), t.alias("id"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")))
    rec = rollouts.context_records(c.select(path.alias("path"), t.alias("line_no"), F.when(t % 2 == 0, plain).otherwise(listed).alias("line")))
    who = rollouts.context_identity(F.col("path"))
    return rec.select(who["native_id"].alias("native_id"), who["parent"].alias("parent"), "line_no", "record_kind", "checkpoint")


def _write_files(rows: DataFrame, folder: str, early: bool) -> None:
    """Files of lines (file, late, line) in order; early ones break off within the first late line."""

    def write(group: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        listed = sorted(zip(*(group.column(c).to_pylist() for c in ("late", "conv_id", "turn", "line")), strict=True))
        kept = [x[3] + "\n" for x in listed if not (early and x[0])]
        torn = next((x[3][:5] for x in listed if x[0]), "") if early else ""
        name = group.column("file")[0].as_py()
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(("".join(kept) + torn).encode())
        return pa.table({"file": pa.array([name], pa.string())})

    rows.groupBy("file").applyInArrow(write, "file string").write.format("noop").mode("overwrite").save()


@query("capture_sweeps", """WITH l AS (SELECT conv_id // 50 AS f, turn >= 3 AS late, conv_id, turn, md5(text) || ' ' || conv_id || ' ' || turn AS line FROM conversations)
SELECT 'f' || f || '.jsonl' AS file, (sum(strlen(line) + 1) OVER (PARTITION BY f ORDER BY late, conv_id, turn) - strlen(line) - 1)::BIGINT AS byte_offset, line, CASE WHEN late THEN 2 ELSE 1 END::BIGINT AS sweep FROM l""")
def capture_sweeps(spark, sf_dir):
    """Files that grow between two sweeps; the first ends within a line. A third sweep finds nothing new."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat_ws(" ", F.md5("text"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    file = F.concat(F.lit("f"), F.floor(F.col("conv_id") / 50).cast("string"), F.lit(".jsonl"))
    rows = c.select(file.alias("file"), (F.col("turn") >= 3).alias("late"), "conv_id", "turn", line.alias("line"))
    root = f"{scratch_dir(spark)}/capture-{uuid.uuid4().hex}"
    root = root if "://" in root else f"file://{root}"
    for early in (True, False, False):
        _write_files(rows, f"{root}/in", early)
        capture.sweep(spark, f"{root}/in", f"{root}/out", f"{root}/state")
    found = capture.captured(spark, f"{root}/out")
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "byte_offset", "line", "sweep")


@query("capture_rewrites", """WITH l AS (SELECT conv_id // 50 AS f, conv_id, turn, CASE conv_id // 50 % 4 WHEN 0 THEN md5(text) WHEN 1 THEN upper(md5(text)) WHEN 2 THEN md5(text) || '+' ELSE substr(md5(text), 2) END || ' ' || conv_id || ' ' || turn AS line FROM conversations)
SELECT 'f' || f || '.jsonl' AS file, CASE WHEN f % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS generation, (sum(strlen(line) + 1) OVER (PARTITION BY f ORDER BY conv_id, turn) - strlen(line) - 1)::BIGINT AS byte_offset, line FROM l""")
def capture_rewrites(spark, sf_dir):
    """Files written anew between two sweeps: as they were, at the same length, longer and shorter."""
    c = table(spark, sf_dir, "conversations")
    k = F.floor(F.col("conv_id") / 50) % 4
    rest = F.concat(F.lit(" "), F.col("conv_id").cast("string"), F.lit(" "), F.col("turn").cast("string"))
    digest = F.md5("text")
    anew = F.when(k == 0, digest).when(k == 1, F.upper(digest)).when(k == 2, F.concat(digest, F.lit("+"))).otherwise(F.substring(digest, 2, 31))
    file = F.concat(F.lit("f"), F.floor(F.col("conv_id") / 50).cast("string"), F.lit(".jsonl"))
    root = f"{scratch_dir(spark)}/rewritten-{uuid.uuid4().hex}"
    root = root if "://" in root else f"file://{root}"
    for head in (digest, anew):
        rows = c.select(file.alias("file"), F.lit(False).alias("late"), "conv_id", "turn", F.concat(head, rest).alias("line"))
        _write_files(rows, f"{root}/in", False)
        capture.sweep_until_still(spark, f"{root}/in", f"{root}/out", f"{root}/state")
    found = capture.captured(spark, f"{root}/out")
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "generation", "byte_offset", "line")


ACTIONS = """log AS (SELECT conv_id AS session_id, turn AS seq, CASE WHEN turn % 3 = 0 OR turn = 1 THEN 'sync' ELSE ['reset', 'rebuild', 'archive', 'restore'][(strlen(text) % 4 + 1)::INT] END AS action, text FROM conversations),
synced AS (SELECT session_id, max(seq) AS seq FROM log WHERE action = 'sync' GROUP BY 1),
ev AS (SELECT session_id, unnest(range(0, strlen(text) % 4)) AS i, text FROM log JOIN synced USING (session_id, seq)),
evd AS (SELECT DISTINCT session_id, CASE WHEN i % 2 = 0 THEN 'checkpoint' ELSE 'compaction' END AS kind, greatest(i - 1, 0)::BIGINT AS ordinal, CASE WHEN i > 1 THEN 'r"' || i END AS record_id, CASE WHEN i <> 2 THEN i * 100 END::BIGINT AS ts, md5(text) AS detail FROM ev),
keyed AS (SELECT *, '["' || kind || '",' || ordinal || ',' || coalesce('"r\\"' || substr(record_id, 3) || '"', 'null') || ',null,' || coalesce(ts::VARCHAR, 'null') || ',"' || detail || '"]' AS event_key FROM evd),
st AS (SELECT session_id, count(*) FILTER (WHERE action = 'reset') AS reset_generation, max(seq) FILTER (WHERE action = 'reset') AS r, max(seq) FILTER (WHERE action = 'rebuild') AS b, max(seq) FILTER (WHERE action = 'archive') AS a, max(seq) FILTER (WHERE action = 'restore') AS t, arg_max(strlen(text) % 4 > 0, seq) FILTER (WHERE action = 'sync') AS has_events FROM log GROUP BY 1)"""


def _continuity_log(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.octet_length("text")
    action = F.when((F.col("turn") % 3 == 0) | (F.col("turn") == 1), "sync").otherwise(F.element_at(F.array(*map(F.lit, ("reset", "rebuild", "archive", "restore"))), n % 4 + 1))
    none = F.lit(None).cast("string")

    def event(i):
        return F.struct(
            F.when(i % 2 == 0, "checkpoint").otherwise("?").alias("kind"), (i - 1).cast("long").alias("ordinal"), F.when(i > 1, F.concat(F.lit('r"'), i.cast("string"))).otherwise(" ").alias("record_id"),
            none.alias("record_uuid"), F.when(i != 2, (i * 100).cast("long")).alias("ts"), F.lit("uuid").alias("identity"), F.concat(F.lit(" "), F.md5("text")).alias("detail"),
        )

    # each event twice, as a replay gives it
    count = n % 4
    made = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) * 2 - 1), lambda i: event(i % F.greatest(count, F.lit(1))))).otherwise(F.array().cast(f"array<{continuity.EVENT}>"))
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), action.alias("action"), F.lit("unsupported").alias("support"), made.alias("events"))


@query("continuity_states", f"""WITH {ACTIONS} SELECT session_id, CASE WHEN has_events THEN 'supported' WHEN has_events IS NULL THEN 'unknown' ELSE 'unsupported' END AS support,
CASE WHEN a > coalesce(t, -1) THEN 'archived' WHEN r > coalesce(b, -1) THEN 'reset' ELSE 'active' END AS status, coalesce(a > coalesce(t, -1), false) AS archived, reset_generation, CASE WHEN r > coalesce(b, -1) THEN r END AS reset_at FROM st""")
def continuity_states(spark, sf_dir):
    """What a log of syncs, resets, rebuilds and archivings comes to for each session."""
    return continuity.states(_continuity_log(spark, sf_dir))


@query("continuity_history", f"""WITH {ACTIONS} SELECT session_id, event_key, kind, ordinal, record_id, ts, detail, reset_generation AS generation, row_number() OVER (PARTITION BY session_id ORDER BY ordinal, ts NULLS LAST, event_key) - 1 AS position
FROM keyed JOIN st USING (session_id) WHERE NOT coalesce(r > coalesce(b, -1), false)""")
def continuity_history(spark, sf_dir):
    """The events that are shown, each once, in order."""
    return continuity.history(_continuity_log(spark, sf_dir)).select("session_id", "event_key", "kind", "ordinal", "record_id", "ts", "detail", "generation", "position")
