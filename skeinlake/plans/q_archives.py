"""Archives of harnesses written from the tables, as their harnesses lay them out, and read back by the sources."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.plans.registry import query, table
from skeinlake.plans.trees import new_root, write_tree
from skeinlake.sources import databases, jsonl, prime


def _json(*fields: tuple[str, Column]) -> Column:
    """A JSON object of fields whose values are JSON already; null ones are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def prime_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an archive with a file for each conversation: sessions, children that name them, and files that are neither."""
    c = table(spark, sf_dir, "conversations")
    k, t, text = F.col("conv_id"), F.col("turn"), F.lit("text")
    n, parent = k.cast("string"), (k - 1).cast("string")
    file = (
        F.when(k % 8 == 1, F.concat(F.lit("session-artifacts/of-"), parent, F.lit("/sub-"), n, F.lit("/run.jsonl")))
        .when(k % 8 == 2, F.concat(F.lit("tmux-panes/p/"), n, F.lit(".jsonl")))
        .when(k % 8 == 3, F.concat(F.lit("session-artifacts/of-"), parent, F.lit("/deep/sub-"), n, F.lit("/run.jsonl")))
        .when(k % 8 == 4, F.concat(F.lit("session-artifacts/of-"), parent, F.lit("/sub-"), n, F.lit("/run.jsonl")))
        .otherwise(F.concat(F.lit("sessions/s"), n, F.lit(".jsonl")))
    )
    beside = F.when(k % 8 == 1, F.concat(F.lit('"../.././../sessions//s'), parent, F.lit('.jsonl"'))).when(k % 8 == 4, F.lit('"../gone.jsonl"')).when(k % 8 == 5, F.lit('"s0.jsonl"'))
    head = _json(("type", F.lit('"session"')), ("id", F.concat(F.lit('"id'), n, F.lit('"'))), ("cwd", F.lit('" /w "')), ("rlmDepth", F.when((k % 8).isin(1, 4, 6), "1").otherwise("0")), ("parentSession", beside))
    said = F.when(t % 3 == 0, _quoted(F.col("text"))).otherwise(F.concat(F.lit('[{"type":"thinking","thinking":"x"},{"type":"text","text":'), _quoted(F.col("text")), F.lit("}]")))
    tool = F.concat(F.lit('[{"type":"toolCall","id":"c","name":"run","arguments":{"n":'), t.cast("string"), F.lit("}}]"))
    stamp = F.when(t % 2 == 0, t.cast("string")).otherwise(F.concat(F.lit('"1970-01-01T00:00:'), F.lpad((t % 60).cast("string"), 2, "0"), F.lit('Z"')))
    inner = lambda content: _json(("type", F.lit('"message"')), ("id", F.concat(F.lit('"r'), t.cast("string"), F.lit('"'))), ("message", _json(("role", _quoted(F.col("role"))), ("timestamp", stamp), ("content", content))))
    custom = _json(
        ("type", F.lit('"custom_message"')), ("customType", F.lit('"agent_message"')), ("content", _quoted(F.col("text"))),
        ("details", F.concat(F.lit('{"fromRelationship":"'), F.when(t % 2 == 0, "parent").otherwise("child"), F.lit('"}'))),
    )
    line = (
        F.when(k % 8 == 2, F.lit('{"type":"pane"}'))
        .when((k % 8 == 7) & (t == 2), F.lit('{"type":'))
        .when((k % 8 == 1) & (t % 5 == 0), custom)
        .when(t % 5 == 4, inner(tool))
        .otherwise(inner(said))
    )
    heads = c.select(file.alias("file"), F.lit(-1).cast("long").alias("place"), head.alias("line"), k.alias("k")).filter("k % 8 <> 2").drop("k").distinct()
    root = new_root(spark, "prime")
    write_tree(heads.unionByName(c.select(file.alias("file"), t.cast("long").alias("place"), line.alias("line"))), root)
    return prime.parsed(jsonl.complete_lines(spark, root), root)


PRIME = """f AS (SELECT conv_id AS k, max(turn) AS last FROM conversations GROUP BY 1),
a AS (SELECT k, 'id' || k AS native_id, CASE WHEN k % 8 = 2 THEN 'auxiliary_agent_artifact' WHEN k % 8 = 3 OR k % 8 = 4 THEN 'no_session_envelope' WHEN k % 8 = 1 AND k - 1 NOT IN (SELECT k FROM f) THEN 'no_session_envelope' WHEN k % 8 = 6 THEN 'unsupported_unit_shape' WHEN k % 8 = 7 AND last >= 2 THEN 'malformed_complete_record' END AS reason FROM f)"""


@query("prime_admission", f"""WITH {PRIME} SELECT CASE WHEN k % 8 = 2 THEN k::VARCHAR ELSE native_id END AS native_id, CASE WHEN reason IS NULL AND k % 8 = 1 THEN 'id' || (k - 1) END AS parent, reason,
CASE WHEN reason IS NULL THEN CASE WHEN k % 8 = 1 THEN 'prime:rlm-child:depth-1' WHEN k % 8 = 5 THEN 'prime:root-fork' ELSE 'prime:root-session' END END AS origin_detail FROM a""")
def prime_admission(spark, sf_dir):
    """Which files are sessions; children find their parents across files."""
    return prime.admission(prime_archive(spark, sf_dir)).select("native_id", "parent", "reason", "origin_detail")


@query("prime_records", f"""WITH {PRIME}, r AS (SELECT k, turn AS t, role, text, rtrim(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), ' ' || chr(9) || chr(10) || chr(13)) AS said FROM conversations JOIN a ON conv_id = k WHERE reason IS NULL),
q AS (SELECT *, CASE WHEN k % 8 = 1 AND t % 5 = 0 THEN 'custom' WHEN t % 5 = 4 THEN 'call' WHEN t % 3 = 0 AND role = 'assistant' THEN 'mute' WHEN t % 3 = 0 THEN 'string' ELSE 'blocks' END AS shape FROM r),
s AS (SELECT *, CASE WHEN shape = 'custom' THEN CASE WHEN t % 2 = 0 THEN 'real_user' ELSE 'control_context' END WHEN shape = 'call' THEN 'tool' WHEN shape = 'mute' OR said = '' THEN CASE WHEN role = 'system' THEN 'developer_system' WHEN shape = 'mute' OR shape = 'string' THEN 'unclassified' ELSE 'control_context' END WHEN role = 'user' THEN 'real_user' WHEN role = 'assistant' THEN 'assistant_dialogue_prose' ELSE 'developer_system' END AS record_kind FROM q)
SELECT 'id' || k AS native_id, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS ordinal, record_kind, CASE record_kind WHEN 'real_user' THEN 'user' WHEN 'assistant_dialogue_prose' THEN 'assistant' END AS side,
md5(CASE WHEN shape IN ('call', 'mute') OR said = '' THEN NULL ELSE said END) AS digest, CASE WHEN shape = 'call' THEN '{{"n":' || t || '}}' END AS arguments, CASE WHEN shape = 'custom' THEN NULL WHEN t % 2 = 0 THEN t * 1000 ELSE t % 60 * 1000 END AS ts FROM s""")
def prime_records(spark, sf_dir):
    """The records of the admitted files: prose as a string or in blocks, calls, messages of parents."""
    rows = prime_archive(spark, sf_dir)
    taken = prime.admission(rows).filter("admitted").select("path", "native_id")
    found = prime.records(rows).join(taken, "path")
    return found.select("native_id", "ordinal", "record_kind", "side", F.md5("prose").alias("digest"), F.try_element_at("tools", F.lit(1))["text"].alias("arguments"), "ts")


# --- archives in SQLite ---------------------------------------------------------------------------


def write_databases(rows: DataFrame, root: str) -> None:
    """SQLite files from rows (file, tbl, place, body), where body is a JSON array of a row's values by ``COLUMNS``."""
    columns = COLUMNS

    def write(group: pa.Table) -> pa.Table:
        import json
        import sqlite3

        from pyarrow import fs

        name = group.column("file")[0].as_py()
        db = sqlite3.connect(":memory:")
        for table_name, names in columns.items():
            db.execute(f"CREATE TABLE {table_name} ({', '.join(names)})")
        told = sorted(zip(*(group.column(c).to_pylist() for c in ("tbl", "place", "body")), strict=True))
        for table_name, _, body in told:
            values = json.loads(body)
            db.execute(f"INSERT INTO {table_name} VALUES ({', '.join('?' * len(values))})", values)
        db.commit()
        store, path = fs.FileSystem.from_uri(f"{root}/{name}")
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(db.serialize())
        return pa.table({"file": pa.array([name], pa.string())})

    rows.select("file", "tbl", "place", "body").groupBy("file").applyInArrow(write, "file string").write.format("noop").mode("overwrite").save()


COLUMNS = {
    "session": ["id TEXT", "parent_id TEXT", "directory TEXT", "title TEXT", "time_created INTEGER", "time_updated INTEGER", "task_type TEXT"],
    "message": ["id TEXT", "session_id TEXT", "time_created INTEGER", "data TEXT"],
    "part": ["id TEXT", "message_id TEXT", "time_created INTEGER", "data TEXT"],
    "sessions": ["id TEXT", "parent_session_id TEXT", "title TEXT"],
    "messages": ["id INTEGER PRIMARY KEY", "session_id TEXT", "role TEXT", "content TEXT", "platform_message_id TEXT", "timestamp REAL"],
}


def _values(*cols: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(c, F.lit("null")) for c in cols]), F.lit("]"))


def _row(tbl: str, file: Column, place: Column, *cols: Column) -> list[Column]:
    return [file.alias("file"), F.lit(tbl).alias("tbl"), place.cast("long").alias("place"), _values(*cols).alias("body")]


HERMES = """CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) = 0 THEN CASE role WHEN 'system' THEN 'developer_system' WHEN 'tool' THEN 'tool' ELSE 'unclassified' END WHEN role = 'user' THEN 'real_user' WHEN role = 'assistant' THEN 'assistant_dialogue_prose' WHEN role = 'system' THEN 'developer_system' WHEN role = 'tool' THEN 'tool' ELSE 'unclassified' END"""


@query("hermes_messages", f"""SELECT 's' || conv_id AS native_id, CASE WHEN conv_id % 5 = 0 THEN 's' || (conv_id + 1) END AS parent, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ordinal, CASE WHEN turn % 3 = 0 THEN 'p' || turn ELSE (conv_id * 1000 + turn)::VARCHAR END AS record_id, {HERMES} AS record_kind, 1700000000000 + turn * 1000 AS ts FROM conversations""")
def hermes_messages(spark, sf_dir):
    """Sessions and messages of SQLite files."""
    c = table(spark, sf_dir, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    own = F.concat(F.lit('"s'), k.cast("string"), F.lit('"'))
    file = F.concat(F.lit("hermes/h"), F.floor(k / 50).cast("string"), F.lit(".db"))
    parent = F.when(k % 5 == 0, F.concat(F.lit('"s'), (k + 1).cast("string"), F.lit('"')))
    heads = c.select("conv_id").distinct().select(*_row("sessions", file, k, own, parent, F.lit('"t"')))
    platform = F.when(t % 3 == 0, F.concat(F.lit('"p'), t.cast("string"), F.lit('"')))
    rows = c.select(*_row("messages", file, k * 1000 + t, (k * 1000 + t).cast("string"), own, _quoted(F.upper("role")), _quoted(F.col("text")), platform, (F.lit(1_700_000_000) + t).cast("string")))
    root = new_root(spark, "hermes")
    write_databases(heads.unionByName(rows), root)
    read = lambda name: databases.read_table(spark, root, name)
    return databases.hermes(read("sessions"), read("messages")).select("native_id", "parent", "ordinal", "record_id", "record_kind", "ts")


TRIM = "rtrim(ltrim({}, ' ' || chr(9) || chr(10) || chr(13)), ' ' || chr(9) || chr(10) || chr(13))"


@query("kilo_messages", f"""WITH c AS (SELECT *, turn % 6 AS s, {TRIM.format("text")} AS said, {TRIM.format("text || chr(10) || 'and'")} AS more FROM conversations),
p AS (SELECT *, CASE s WHEN 0 THEN nullif(more, '') WHEN 1 THEN {TRIM.format("text || chr(10) || 'added'")} END AS prose FROM c)
SELECT 's' || conv_id AS native_id, '/w/' || conv_id AS cwd, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ordinal,
CASE WHEN s = 5 AND conv_id % 2 = 1 THEN 'unclassified' WHEN role = 'user' AND prose IS NOT NULL THEN 'real_user' WHEN role = 'assistant' AND prose IS NOT NULL THEN 'assistant_dialogue_prose' WHEN role = 'system' THEN 'developer_system'
  WHEN s = 2 THEN 'tool' WHEN s = 3 OR (s = 4 AND conv_id % 2 = 0) THEN 'control_context' ELSE 'unclassified' END AS record_kind, md5(prose) AS digest,
CASE WHEN s = 2 THEN CASE WHEN conv_id % 2 = 0 THEN 'call:run:{{"status":"on","input":{{"n":' || turn || '}}}}' ELSE 'result:run:{{"status":"on","input":{{"n":' || turn || '}},"output":"done"}}' END END AS tool FROM p""")
def kilo_messages(spark, sf_dir):
    """Messages in parts, through SQLite files: two texts, a marked one, a tool, reasoning, what nobody knows, nothing, and broken JSON.

    Parts count in the order of their table, though their times run backwards.
    """
    c = table(spark, sf_dir, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    own = F.concat(F.lit("s"), k.cast("string"))
    mid = F.concat(own, F.lit("m"), t.cast("string"))
    file = F.concat(F.lit("kilo/k"), F.floor(k / 50).cast("string"), F.lit(".db"))
    heads = c.select("conv_id").distinct().select(*_row("session", file, k, _quoted(own), F.lit("null"), _quoted(F.concat(F.lit("/w/"), k.cast("string"))), F.lit('"t"'), F.lit("1"), F.lit("2"), F.lit("null")))
    told = F.to_json(F.struct(F.upper("role").alias("role"), F.when((t % 6 == 4) & (k % 2 == 0), F.lit("control-note")).alias("type")))
    data = F.when((t % 6 == 5) & (k % 2 == 1), F.lit('{"role":')).otherwise(told)
    messages = c.select(*_row("message", file, k * 1000 + t, _quoted(mid), _quoted(own), (F.lit(1_700_000_000_000) - t).cast("string"), _quoted(data)))
    text = lambda x, *more: F.to_json(F.struct(F.lit("text").alias("type"), x.alias("text"), *more))
    state = F.concat(F.lit('{"type":"tool-call","tool":"run","callID":"c","state":{"status":"on","input":{"n":'), t.cast("string"), F.lit("}"), F.when(k % 2 == 1, F.lit(',"output":"done"')).otherwise(""), F.lit("}}"))
    pieces = (
        F.when(t % 6 == 0, F.array(text(F.col("text")), text(F.lit("and"))))
        .when(t % 6 == 1, F.array(text(F.col("text")), text(F.lit("added"), F.lit(True).alias("synthetic"))))
        .when(t % 6 == 2, F.array(state))
        .when(t % 6 == 3, F.array(F.lit('{"type":"Reasoning","text":"hm"}')))
        .when(t % 6 == 4, F.array(F.lit('{"type":"step-start"}')))
    )
    parts = c.select("conv_id", "turn", mid.alias("mid"), F.posexplode(pieces).alias("i", "data"))
    place = (k * 1000 + t) * 10 + F.col("i")
    parts = parts.select(*_row("part", file, place, _quoted(F.concat("mid", F.lit("p"), F.col("i").cast("string"))), _quoted(F.col("mid")), (F.lit(9) - F.col("i")).cast("string"), _quoted(F.col("data"))))
    root = new_root(spark, "kilo")
    write_databases(heads.unionByName(messages).unionByName(parts), root)
    read = lambda name: databases.read_table(spark, root, name)
    found = databases.kilo(read("session"), read("message"), read("part"))
    tool = F.try_element_at("tools", F.lit(1))
    return found.select("native_id", "cwd", "ordinal", "record_kind", F.md5("prose").alias("digest"), F.when(tool.isNotNull(), F.concat_ws(":", tool["kind"], tool["name"], tool["text"])).alias("tool"))


def zcode_archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records from a database and from transcripts; every third session is in both, with records that differ and that one lacks."""
    c = table(spark, sf_dir, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    own, mid = F.concat(F.lit("s"), k.cast("string")), F.concat(F.lit("m"), t.cast("string"))
    file = F.concat(F.lit("z"), F.floor(k / 50).cast("string"), F.lit("/db/db.sqlite"))
    stored = c.filter(k % 3 < 2)
    heads = stored.select("conv_id").distinct().select(*_row("session", file, k, _quoted(own), F.lit("null"), F.lit("null"), F.lit("null"), F.lit("1"), F.lit("2"), F.lit("null")))
    key = F.concat(own, mid)  # an id of a message holds in its database
    messages = stored.select(*_row("message", file, k * 1000 + t, _quoted(key), _quoted(own), t.cast("string"), _quoted(F.to_json(F.struct("role")))))
    parts = stored.select(*_row("part", file, k * 1000 + t, _quoted(F.concat(mid, F.lit("p"))), _quoted(key), t.cast("string"), _quoted(F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))))
    root = new_root(spark, "zcode")
    write_databases(heads.unionByName(messages).unionByName(parts), root)
    told = c.filter((k % 3 > 0) & ~((k % 3 == 1) & (t % 4 == 3)))
    where = F.concat(F.lit("cli/agents/sess_p"), k.cast("string"), F.lit("/a/transcript.jsonl"))
    said = F.when((k % 3 == 1) & (t % 4 == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    line = lambda kind, name, payload: _json(("type", kind), ("sessionId", _quoted(own)), ("id", name), ("timestamp", t.cast("string")), ("payload", payload))
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    payload = F.when(user, _json(("input", _quoted(said)))).when(answer, _json(("response", _quoted(said)))).otherwise(F.lit('{"model":{"modelId":"m"}}'))
    main = line(F.when(user, F.lit('"turn_started"')).when(answer, F.lit('"turn_complete"')).otherwise(F.lit('"model_request"')), _quoted(key), payload)
    streams = [line(F.lit('"model_streaming"'), F.concat(F.lit(f'"d{i}-'), t.cast("string"), F.lit('"')), F.lit("{}")) for i in range(3)]
    lines = F.when(answer, F.array(*streams, main)).otherwise(F.array(main))
    rows = told.select(where.alias("file"), (t * 10).alias("base"), F.posexplode(lines).alias("i", "line")).select("file", (F.col("base") + F.col("i")).cast("long").alias("place"), "line")
    write_tree(rows, root)
    read = lambda name: databases.read_table(spark, root, name)
    return databases.zcode(read("session"), read("message"), read("part")), databases.zcode_transcripts(jsonl.complete_lines(spark, f"{root}/cli/agents"))


ZCODE = f"""c AS (SELECT conv_id AS k, turn AS t, role, 's' || conv_id || 'm' || turn AS id, {TRIM.format("text")} AS said, {TRIM.format("text || '!'")} AS loud FROM conversations),
db AS (SELECT k, t, id, CASE WHEN role = 'user' AND said <> '' THEN 'real_user' WHEN role = 'assistant' AND said <> '' THEN 'assistant_dialogue_prose' WHEN role = 'system' THEN 'developer_system' ELSE 'unclassified' END AS kind, nullif(said, '') AS prose FROM c WHERE k % 3 < 2),
x AS (SELECT k, t, id, role, CASE WHEN role IN ('user', 'assistant') THEN CASE WHEN k % 3 = 1 AND t % 4 = 1 THEN loud ELSE nullif(said, '') END END AS prose FROM c WHERE k % 3 > 0 AND NOT (k % 3 = 1 AND t % 4 = 3)),
ext AS (SELECT k, t, id, CASE WHEN prose IS NULL THEN 'control_context' WHEN role = 'user' THEN 'real_user' ELSE 'assistant_dialogue_prose' END AS kind, prose FROM x
  UNION ALL SELECT k, t, 'd2-' || t, 'control_context', NULL FROM x WHERE role = 'assistant')"""


@query("zcode_election", f"""WITH {ZCODE}, u AS (SELECT 'database' AS source, 0 AS place, * FROM db UNION ALL SELECT 'transcript', 1, * FROM ext),
s AS (SELECT k, source, place, sum(strlen(concat_ws(',', '"' || kind || '"', CASE kind WHEN 'real_user' THEN '"user"' WHEN 'assistant_dialogue_prose' THEN '"assistant"' ELSE 'null' END, coalesce(to_json(prose)::VARCHAR, 'null'), t::VARCHAR, to_json(id)::VARCHAR, '[]')) + 2) + count(*) + 1 AS semantic_bytes FROM u GROUP BY ALL)
SELECT 's' || k AS native_id, source, semantic_bytes::BIGINT AS semantic_bytes FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY semantic_bytes DESC, place) = 1""")
def zcode_election(spark, sf_dir):
    """Which of its sources tells more of each session; they are never joined together."""
    stored, told = zcode_archive(spark, sf_dir)
    sizes = lambda df, name, place: databases.semantic_bytes(df, "native_id").select("native_id", F.lit(name).alias("source"), F.lit(place).alias("place"), "semantic_bytes")
    return databases.elected(sizes(stored, "database", 0).unionByName(sizes(told, "transcript", 1))).select("native_id", "source", "semantic_bytes")


@query("zcode_alignment", f"""WITH {ZCODE}, a AS (SELECT * FROM db WHERE k % 3 = 1), b AS (SELECT * FROM ext WHERE k % 3 = 1)
SELECT 's' || coalesce(a.k, b.k) AS native_id, coalesce(a.id, b.id) AS record_id, CASE WHEN b.id IS NULL THEN 'only_first' WHEN a.id IS NULL THEN 'only_second' WHEN a.kind = b.kind AND a.prose IS NOT DISTINCT FROM b.prose THEN 'same' ELSE 'contradicting' END AS status FROM a FULL JOIN b ON a.k = b.k AND a.id = b.id""")
def zcode_alignment(spark, sf_dir):
    """Records of the sessions that both sources hold, by their ids: the same, contradicting, or in one only."""
    stored, told = zcode_archive(spark, sf_dir)
    both = F.substring("native_id", 2, 20).cast("long") % 3 == 1
    return databases.aligned(stored.filter(both), told.filter(both))
