"""Archives of harnesses in small files of their own."""

import json

import pytest

from skeinlake.sources import jsonl, prime


def tree(root, files):
    for name, rows in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def head(name, **more):
    return {"type": "session", "version": 3, "id": name, "rlmDepth": 0, **more}


def inner(role, name, at, content, **more):
    return {"type": "message", "id": name, "message": {"role": role, "content": content, **({} if at is None else {"timestamp": at})}, **more}


def text(t):
    return [{"type": "text", "text": t}]


@pytest.fixture
def read(spark, tmp_path):
    def run(**files):
        root = tmp_path / "archive"
        tree(root, files.pop("at", files))
        rows = prime.parsed(jsonl.complete_lines(spark, f"file://{root}"), f"file://{root}")
        admitted = {r.path.removeprefix(f"{root}/"): r for r in prime.admission(rows).collect()}
        records = {}
        for r in prime.records(rows).orderBy("path", "ordinal").collect():
            records.setdefault(r.path.removeprefix(f"{root}/"), []).append(r)
        return admitted, records, {r.native_id: r for r in prime.sessions(rows).collect()}, rows

    return run


def test_children_find_their_parents_by_path(read, tmp_path):
    root = tmp_path / "archive"
    child = lambda parent, depth=1: [head("child", rlmDepth=depth, parentSession=parent)]
    admitted, _, sessions, _ = read(at={
        "sessions/p.jsonl": [head("parent")],
        "sessions/fork.jsonl": [head("fork", parentSession="p.jsonl"), inner("user", "u", 1, text("go on"))],
        "sessions/stray.jsonl": [head("stray", rlmDepth=1, parentSession="p.jsonl")],
        "session-artifacts/a/sub-1/x.jsonl": child(f"{root}/sessions/p.jsonl"),
        "session-artifacts/a/sub-2/x.jsonl": child("../../.././../archive/sub/../sessions//p.jsonl", 2),
        "session-artifacts/a/sub-3/x.jsonl": child("../nobody.jsonl"),
        "session-artifacts/a/sub-4/x.jsonl": child(f"{root}/sessions/p.jsonl", 0),
        "session-artifacts/a/sub-5/deep/x.jsonl": [{"type": "worker_event"}],
        "session-artifacts/a/other/x.jsonl": child(f"{root}/sessions/p.jsonl"),
        "tmux-panes/f/sessions/e.jsonl": [head("external")],
        "sessions/broken.jsonl": [head("broken"), "{oops"],
        "sessions/two.jsonl": [head("one"), head("two")],
        "sessions/none.jsonl": [{"type": "message"}, head("late")],
        "sessions/odd.jsonl": [head("odd", rlmDepth="x")],
    })
    assert {k: (r.native_id if r.admitted else r.reason) for k, r in admitted.items()} == {
        "sessions/p.jsonl": "parent", "sessions/fork.jsonl": "fork", "sessions/stray.jsonl": "unsupported_unit_shape",
        "session-artifacts/a/sub-1/x.jsonl": "child", "session-artifacts/a/sub-2/x.jsonl": "child",
        "session-artifacts/a/sub-3/x.jsonl": "no_session_envelope", "session-artifacts/a/sub-4/x.jsonl": "no_session_envelope",
        "session-artifacts/a/sub-5/deep/x.jsonl": "auxiliary_agent_artifact", "session-artifacts/a/other/x.jsonl": "no_session_envelope",
        "tmux-panes/f/sessions/e.jsonl": "auxiliary_agent_artifact", "sessions/broken.jsonl": "malformed_complete_record",
        "sessions/two.jsonl": "identity_mismatch", "sessions/none.jsonl": "no_session_envelope", "sessions/odd.jsonl": "no_session_envelope",
    }
    one, two = (admitted[f"session-artifacts/a/sub-{i}/x.jsonl"] for i in (1, 2))
    assert (one.parent, one.origin, one.origin_detail) == ("parent", "agent", "prime:rlm-child:depth-1")
    assert (two.parent, two.origin_detail) == ("parent", "prime:rlm-child:depth-2")
    fork = sessions["fork"]
    assert (fork.parent, fork.origin, fork.origin_detail, fork.title, fork.visible) == (None, "human", "prime:root-fork", "go on", True)
    assert (sessions["parent"].artifact_kind, sessions["parent"].visible, sessions["parent"].title) == ("metadata_shell", False, None)


def test_kinds_of_records(read):
    _, records, sessions, rows = read(at={"sessions/s.jsonl": [
        head("s", cwd=" /w/x "),
        inner("user", "u", 401, text("do it")),
        {"type": "agent_status", "id": "s1", "timestamp": 402, "status": {"taskState": "running", "summary": " well "}},
        inner("assistant", "c", 403, [{"type": "toolCall", "id": "c1", "name": "run", "arguments": {"a": True}}]),
        inner("tool", "r", 404, [{"type": "toolResult", "toolUseId": "c1", "content": "done"}]),
        inner("tool", "r2", 405, "as a string"),
        inner("assistant", "a", 406, [*text("well"), {"type": "tool_use", "id": "c2", "toolName": "run2", "input": {"b": 2}}]),
        inner("assistant", "h", 407, [{"type": "thinking", "thinking": "hm"}]),
        inner("assistant", "m", 408, "a string of an assistant"),
        {"type": "custom_message", "id": "p", "timestamp": 501, "customType": "agent_message", "content": "from above", "details": {"fromRelationship": "parent"}},
        {"type": "custom_message", "id": "q", "customType": "agent_message", "content": "to a child", "details": {"fromRelationship": "parent", "toRelationship": "child"}},
        {"type": "model_change", "id": "m", "modelId": "m-1", "prose": "changed"},
        {"type": "compaction", "id": "0a1b2c3d-0000-4000-8000-000000000001", "timestamp": 9, "summary": "short"},
        {"type": "native_policy", "message": "rules"},
        {"type": "lifecycle_end", "content": "bye"},
        {"type": "whatever", "prose": "?"},
        {"type": "session_info", "name": "  A   title "},
        "7",
        inner("developer", "d", "1970-01-01T00:00:01Z", "be kind"),
    ]})
    got = [(r.role, r.record_kind, r.prose, [tuple(x) for x in r.tools or []]) for r in records["sessions/s.jsonl"]]
    assert got == [
        ("user", "real_user", "do it", []),
        ("system", "telemetry", "running · well", []),
        ("assistant", "tool", None, [("call", "run", '{"a":true}', "c1")]),
        ("tool", "tool", None, [("result", None, "done", "c1")]),
        ("tool", "tool", None, [("result", None, "as a string", None)]),
        ("assistant", "assistant_dialogue_prose", "well", [("call", "run2", '{"b":2}', "c2")]),
        ("assistant", "control_context", None, []),
        ("assistant", "unclassified", None, []),
        ("user", "real_user", "from above", []),
        ("system", "control_context", "to a child", []),
        ("system", "telemetry", "changed", []),
        ("system", "automatic_utility", "short", []),
        ("system", "developer_system", "rules", []),
        ("system", "control_context", "bye", []),
        ("tool", "unclassified", "?", []),
        ("tool", "unclassified", None, []),
        ("system", "developer_system", "be kind", []),
    ]
    assert [r.ts for r in records["sessions/s.jsonl"]][-1] == 1000 and records["sessions/s.jsonl"][11].identity == "uuid"
    s = sessions["s"]
    assert (s.cwd, s.title, s.models, s.start_ts, s.end_ts, s.visible) == ("/w/x", "A title", ["m-1"], 1000, 501000, True)
    events = prime.continuity_events(rows).first().events
    assert [(e.ordinal, e.ts, e.identity, e.detail) for e in events] == [(12, 9000, "uuid", "prime:compaction-summary-present")]


def test_times_come_from_within(read):
    _, records, sessions, _ = read(at={"sessions/t.jsonl": [
        head("t"),
        {"type": "control_context", "id": "r1", "timestamp": 702, "prose": "c"},
        inner("user", "r2", 701, text("back")),
        inner("assistant", "r3", None, text("timeless"), timestamp=999),
    ]})
    assert [(r.ts, r.line_no, r.ordinal) for r in records["sessions/t.jsonl"]] == [(702000, 1, 0), (701000, 2, 1), (None, 3, 2)]
    assert (sessions["t"].start_ts, sessions["t"].end_ts) == (701000, 702000)


# --- databases and transcripts of agents -----------------------------------------------------------------------


def zcode_db(path, wal=False):
    import sqlite3

    db = sqlite3.connect(path)
    if wal:
        db.execute("PRAGMA journal_mode=WAL")
        db.execute("PRAGMA wal_autocheckpoint=0")
    db.execute("CREATE TABLE session (id TEXT, parent_id TEXT, directory TEXT, title TEXT, task_type TEXT)")
    db.execute("CREATE TABLE message (id TEXT, session_id TEXT, time_created INTEGER, data TEXT)")
    db.execute("CREATE TABLE part (id TEXT, message_id TEXT, data TEXT)")
    db.executemany("INSERT INTO session VALUES (?, ?, ?, ?, ?)", [("s", None, " /w ", "", "interactive"), ("kid", "s", None, "t", None), ("sub", " ", None, None, "subagent_child")])
    rows = [("m1", "s", 5, {"role": "User"}), ("m2", "s", 4, {"role": "assistant"}), ("m3", "s", 3, {"role": "assistant"}), ("m4", "s", 2, {"role": "user"}), ("m5", "s", 1, "{")]
    db.executemany("INSERT INTO message VALUES (?, ?, ?, ?)", [(*r[:3], r[3] if isinstance(r[3], str) else json.dumps(r[3])) for r in rows])
    state = {"status": "completed", "input": {"b": 1, "a": "x"}, "output": "out"}
    parts = [("p2", "m1", {"type": "text", "text": "second "}), ("p1", "m1", {"type": "text", "text": "first"}), ("p3", "m2", {"type": "tool", "tool": "run", "callID": "c", "state": state}), ("p4", "m3", {"type": "reasoning"}), ("p5", "m4", {"type": "file", "filename": "f.txt"}), ("p6", "m5", {"type": "other"})]
    db.executemany("INSERT INTO part VALUES (?, ?, ?)", [(*r[:2], json.dumps(r[2])) for r in parts])
    db.commit()
    return db


@pytest.mark.parametrize("how", ["local", "wal", "bytes"])
def test_messages_of_a_database(spark, tmp_path, monkeypatch, how):
    from skeinlake.sources import databases, sqlite

    db = zcode_db(tmp_path / "z.sqlite", how == "wal")
    if how == "bytes":
        db.close()
        pages = bytearray((tmp_path / "z.sqlite").read_bytes())
        pages[18:20] = b"\x02\x02"  # as a database with a log is marked
        (tmp_path / "z.sqlite").write_bytes(pages)
        monkeypatch.setattr(sqlite.os.path, "exists", lambda p: False)
        assert [r[0] for r in sqlite.opened(f"file://{tmp_path}/z.sqlite").execute("SELECT id FROM part ORDER BY rowid")] == ["p2", "p1", "p3", "p4", "p5", "p6"]
        (tmp_path / "z.sqlite-wal").write_bytes(b"x")
        with pytest.raises(ValueError, match="write-ahead"):
            sqlite.opened(f"file://{tmp_path}/z.sqlite")
        return
    read = lambda name: databases.read_table(spark, f"file://{tmp_path}", name)
    got = databases.zcode(read("session"), read("message"), read("part")).orderBy("ordinal").collect()
    assert [(r.record_id, r.record_kind, r.prose, r.cwd, r.ts) for r in got] == [
        ("m1", "real_user", "second \nfirst", "/w", 5), ("m2", "tool", None, "/w", 4), ("m3", "control_context", None, "/w", 3), ("m4", "tool", None, "/w", 2), ("m5", "unclassified", None, "/w", 1),
    ]
    assert tuple(got[1].tools[0]) == ("result", "run", '{"status":"completed","input":{"b":1,"a":"x"},"output":"out"}', "c")
    assert (got[3].tools[0].kind, got[3].tools[0].name) == ("attachment", "f.txt")
    assert {r.native_id: r.origin for r in databases.zcode_origin(read("session")).collect()} == {"s": "human", "kid": "agent", "sub": "agent"}
    db.close()


def test_transcripts_of_agents(spark, tmp_path):
    from skeinlake.sources import databases

    row = lambda kind, name=None, sid="s", **payload: {"type": kind, "sessionId": sid, "id": name, "timestamp": "1970-01-01T00:00:02Z", "payload": payload}
    tree(tmp_path, {
        "agents/sess_p/a/transcript.jsonl": [
            row("turn_started", "1", input=" ask "), row("model_streaming", "2"), {"sessionId": "s"}, row("model_streaming", "3"), row("tool_ran", "4"), row("model_streaming", "5"),
            row("turn_complete", "6", response=""), row("model_request", "7"), row("model_streaming", "8"),
        ],
        "agents/other/a/transcript.jsonl": [row("turn_started", "1", sid="o", input="x")],
        "agents/sess_q/a/transcript.jsonl": [row("turn_started", "1"), row("turn_started", "2", sid="else")],
    })
    got = databases.zcode_transcripts(jsonl.complete_lines(spark, f"file://{tmp_path}")).orderBy("native_id", "ordinal").collect()
    assert [(r.native_id, r.parent, r.record_id, r.record_kind, r.prose) for r in got] == [
        ("o", None, "1", "real_user", "x"), ("s", "sess_p", "1", "real_user", "ask"), ("s", "sess_p", "3", "control_context", None), ("s", "sess_p", "5", "control_context", None),
        ("s", "sess_p", "6", "control_context", None), ("s", "sess_p", "7", "control_context", None), ("s", "sess_p", "8", "control_context", None),
    ]
    assert {r.ts for r in got} == {2000}


def test_placeholder_titles(spark):
    from pyspark.sql import functions as F

    from skeinlake.sources import databases

    titles = ["New session - 2026-01-02T03:04:05Z", "New session - tomorrow", "New session", None, "x New session - 2026-01-02T03:04:05Z"]
    frame = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r.p for r in frame.select(databases.placeholder_title(F.col("t")).alias("p")).collect()] == [True, False, False, False, False]


def test_completions_are_taken_in_order(spark):
    """An earlier completion without an id takes the record that a later one names; then no second record is marked."""
    from skeinlake.sources import rollouts

    records = spark.createDataFrame([("f", 1, 0, "assistant", "same", "r1"), ("f", 2, 0, "assistant", "same", "r2")], "path string, line_no long, turn long, response_role string, prose string, response_id string")
    done = lambda *rows: spark.createDataFrame(rows, records.schema)
    got = lambda d: sorted(r.line_no for r in rollouts.associated(records, d).collect())
    assert got(done(("f", 3, 0, "assistant", "same", None), ("f", 4, 0, "assistant", "other", "r2"))) == [2]
    assert got(done(("f", 3, 0, "assistant", "other", "r2"), ("f", 4, 0, "assistant", "same", None))) == [1, 2]
    assert got(done(("f", 3, 0, "assistant", "same", None), ("f", 4, 0, "assistant", "same", None), ("f", 5, 0, "assistant", "same", None))) == [1, 2]
    assert got(done(("f", 3, 0, "assistant", "same", "unknown"))) == [2]
    assert got(done(("f", 0, 0, "assistant", "x", "r2"), ("f", 3, 0, "assistant", "same", None))) == [1, 2]


def test_transcripts_share_folders(spark):
    """Sessions don't have a folder each, and reading leaves the session's settings as they were."""
    from skeinlake.plans import q_sources

    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    lines = q_sources._transcripts(spark, "/root/testdata/sf0.01")
    folders = {f.rsplit("/", 2)[1] for f in lines.inputFiles()}
    assert len(folders) <= q_sources.FOLDERS < lines.select("path").distinct().count()
    assert spark.conf.get(key) == before
