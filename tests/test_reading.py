"""Selections, topics, transcripts and the log of searches on small frames."""

import pytest
from pyspark.sql import functions as F

from skeinlake.functions import text as fx
from skeinlake.operators import library, searchlog, transcript


@pytest.mark.parametrize(
    "text, start, end, found",
    [("abc", 1, 2, (1, 2)), ("é😀x", 0, 3, (0, 6)), ("é😀x", 1, 3, (2, 6)), ("é😀x", 2, 3, None), ("é😀x", 0, 2, None), ("é😀x", 3, 4, (6, 7)), ("ab", 1, 3, None), ("ab", 2, 1, None), ("ab", -1, 1, None), ("", 0, 0, (0, 0)), ("😀", 2, 2, (4, 4))],
)
def test_selections_in_bytes(spark, text, start, end, found):
    frame = spark.createDataFrame([(text, start, end)], "t string, a int, b int")
    got = frame.select(fx.selection_bytes(F.col("t"), F.col("a"), F.col("b")).alias("s")).first().s
    assert (tuple(got) if got else None) == found


def test_topics_meet_in_all_their_forms(spark):
    claims = [("s1", 1, "Fine-tuning", ["a"]), ("s2", 1, "ﬁne  tuning!", ["b"]), ("s3", 1, "Ｆｉｎｅ Tuning", ["c"]), ("s3", 2, "FINE TUNING", ["d"]), ("s1", 1, "alone", ["e"]), ("s1", 2, "…", ["f"]), ("s4", 1, None, ["g"])]
    frame = spark.createDataFrame(claims, "session string, at int, text string, refs array<string>")
    (one,) = library.topic_collections(frame).collect()
    assert (one.title, one.sessions, one.refs, one.hidden) == ("Fine-tuning", ["s1", "s2", "s3"], ["a", "b", "d"], False)
    ids = library.topic_collections(frame, spark.createDataFrame([], "id string"))
    alone = frame.filter("text = 'alone'").select(F.concat(F.lit("topic:"), F.substring(F.sha2(library.topic_name(F.col("text")), 256), 1, 24)).alias("id"))
    assert ids.count() == 1 and {(r.title, r.hidden) for r in library.topic_collections(frame, alone).collect()} == {("Fine-tuning", False), ("alone", True)}


def test_tools_are_nested_under_representatives(spark):
    columns = "session_id int, ordinal int, record_kind string, side string, text string, identity_kind string, identity_id string, ts bigint, tools int"
    rows = [(1, 0, "real_user", "user", "ask", "uuid", "a", 1, 0), (1, 1, "assistant_dialogue_prose", "assistant", "well", "uuid", "b", 2, 2), (1, 2, "tool", None, None, "none", None, None, 1), (1, 3, "assistant_dialogue_prose", "assistant", "well", "uuid", "b", 2, 2), (1, 4, "real_user", "user", "  ", "uuid", "c", 3, 0), (1, 5, "real_user", "assistant", "odd", "uuid", "d", 4, 0)]
    acts = [(1, 1, 1, "result", "run", "r", "x"), (1, 1, 0, "call", "run", "c", "x"), (1, 3, 0, "call", "run", "again", "x"), (1, 2, 0, "call", "go", None, None)]
    raw, told = spark.createDataFrame(rows, columns), spark.createDataFrame(acts, "session_id int, raw_ordinal int, position int, kind string, name string, text string, id string")
    records = transcript.activity(raw, told)
    got = [(r.logical_ordinal, r.raw_ordinal, r.replay_count, [t.text for t in r.tools], r.event_ts) for r in records.orderBy("logical_ordinal").collect()]
    assert got == [(0, 0, 1, [], 1), (1, 1, 2, ["c", "r"], 2), (2, 2, 1, [None], None), (3, 4, 1, [], 3), (4, 5, 1, [], 4)]
    assert [r.logical_ordinal for r in transcript.dialogue(records).orderBy("logical_ordinal").collect()] == [0, 1]


@pytest.mark.parametrize(
    "env, interactive, found",
    [
        ({"CODEX_THREAD_ID": "t", "AI_AGENT": "codex"}, False, ("codex", "t", "codex")),
        ({"CLAUDE_CODE_SESSION_ID": "c", "CLAUDECODE": "1"}, False, ("claude", "c", None)),
        ({"CLAUDECODE": "1"}, True, ("claude", None, None)),
        ({"CALLER": "prime:root-7", "CLAUDE_CODE_SESSION_ID": "x"}, False, ("prime", "root-7", None)),
        ({"CALLER": "Nobody"}, False, ("unknown", None, None)),
        ({}, True, ("human", None, None)),
    ],
)
def test_callers(spark, env, interactive, found):
    frame = spark.createDataFrame([(env, interactive)], "env map<string,string>, interactive boolean")
    assert tuple(frame.select(searchlog.caller(F.col("env"), F.col("interactive")).alias("c")).first().c) == found


def test_log_of_searches(spark):
    schema = "id int, at long, surface string, env map<string,string>, interactive boolean, query string, scope map<string,string>, total long"
    searches = [(1, 600_000, "cli", {"CODEX_THREAD_ID": "t"}, False, "walls", {"source": "claude", "since": None}, 5), (2, 700_000, "cli", {}, True, "none", {}, 0)]
    hits = [(1, 2, "claude", "b", 4), (1, 1, "claude", "a", 3), (1, 3, "claude", "b", 1), (1, 4, "claude", "b", 4)]
    log = searchlog.log(spark.createDataFrame(searches, schema), spark.createDataFrame(hits, "search int, place int, harness string, native_id string, ordinal int"), F.lit(0).cast("long"))
    one, two = log.orderBy("id").collect()
    assert (one.returned, [tuple(r) for r in one.refs], tuple(one.uncovered)) == (2, [("claude", "a", [3]), ("claude", "b", [1, 4])], (10, ["source"], 3))
    assert (two.returned, two.refs, tuple(two.uncovered)) == (0, [], (12, None, None))
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(searchlog.asked(log)) == [2, 1] and ids(searchlog.asked(log, agents=True)) == [1] == ids(searchlog.asked(log, by=("codex", "t"))) and ids(searchlog.asked(log, 1)) == [2]
