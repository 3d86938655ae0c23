"""Operators on small frames: ties, cycles, torn files, greedy rules, streams."""

import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinlake.functions import porter
from skeinlake.operators import continuity, creator, filters, graph, lineage, packing, passages, publish, replay, search, sessions, textindex, topics
from skeinlake.sources import exports, jsonl, rollouts
from skeinlake.sources.sqlite import SqliteSource
from skeinlake.streaming import capture, sessionize


def as_map(frame, key, value):
    return {r[key]: r[value] for r in frame.collect()}


def test_percentile_ties_and_singletons(spark):
    f = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 40)], "id int, total int")
    assert as_map(sessions.percentile(f, "total"), "id", "percentile") == {1: 0.0, 2: 1 / 3, 3: 1 / 3, 4: 1.0}
    assert as_map(sessions.percentile(f.filter("id = 1"), "total"), "id", "percentile") == {1: 0.0}


@pytest.mark.parametrize(
    "text, found",
    [('a-b "c d" e', ["a-b", "c d", "e"]), ('say "hi', ["say", '"hi']), ('x"y z"', ['x"y', 'z"']), ("C++ x_y dir/f.ext", ["C++", "x_y", "dir/f.ext"])],
)
def test_literal_atoms(text, found):
    assert search.atoms(text) == found


@pytest.mark.parametrize("text", ["/etc/hosts", "--flag C++ x_y", "Élan déjà-vu", "a.b/c (d) -e", "naïve ÅNGSTRÖM ß", "_+./-", "日本 ½ x²"])
def test_query_and_text_are_cut_alike(spark, text):
    frame = spark.createDataFrame([(text,)], "text string")
    assert frame.select(search.terms(F.col("text")).alias("t")).first().t == search.terms_of(text)


def test_phrases_are_ranked_as_units(spark, tmp_path):
    texts = ["to be or not to be", "be to", "to be", "see /etc/hosts now", "see etc hosts", "Déjà vu", "", "be not"]
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "session_id long, ordinal int, text string")
    textindex.refresh(docs, f"file://{tmp_path}/index", 3)

    def found(query):
        scan = {r.session_id: r.score for r in search.bm25(docs, search.atoms(query)).collect()}
        stored = {r.session_id: r.score for r in textindex.bm25(spark, f"file://{tmp_path}/index", search.atoms(query)).collect()}
        assert scan.keys() == stored.keys() and all(scan[k] == pytest.approx(stored[k]) for k in scan)
        return sorted(scan)

    assert found('"to be"') == [0, 2] and found("to be") == [0, 1, 2] and found('"to be" not') == [0]
    assert found("/etc/hosts") == [3] and found("deja") == [5] and found("nobody") == []
    with pytest.raises(search.InvalidQuery):
        search.bm25(docs, ["()"])


def test_words_are_found_in_all_their_forms(spark):
    texts = ["she was running", "a run", "runs and runs", "the runner", "rune", "Generalizations of oscillators", "general oscillation"]
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "session_id long, ordinal int, text string")
    found = lambda q: sorted(r.session_id for r in search.bm25(docs, search.atoms(q)).collect())
    assert found("run") == found("Running") == [0, 1, 2] and found("oscillate") == [5, 6] and found('"generally oscillator"') == [6]


def test_a_stem_is_narrowed_to_written_forms(spark, tmp_path):
    texts = ["a run over", "running over", "runs over", "run ran over"]
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "session_id long, ordinal int, text string")
    forms = {"run": ("run", "runs")}
    assert sorted(r.session_id for r in search.bm25(docs, ["Runs"], forms).collect()) == [0, 2, 3]
    assert sorted(r.session_id for r in search.phrase_matches(docs, "run over", forms).collect()) == [0, 2]
    assert search.phrase_matches(docs, "run over").count() == 3
    path = f"file://{tmp_path}/index"
    textindex.refresh(docs, path, 2)
    for wanted, narrowed, every in ((["run"], [0, 2, 3], [0, 1, 2, 3]), (["run over"], [0, 2], [0, 1, 2])):
        assert sorted(r.session_id for r in textindex.bm25(spark, path, wanted, forms=forms).collect()) == narrowed
        assert sorted(r.session_id for r in textindex.bm25(spark, path, wanted).collect()) == every


def test_stems_of_published_pairs():
    pairs = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
    conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
    relational relat conditional condit rational ration digitizer digit vietnamization vietnam operator oper decisiveness decis hopefulness hope
    sensibiliti sensibl triplicate triplic formative form electrical electr goodness good revival reviv allowance allow inference infer airliner airlin
    adjustable adjust defensible defens replacement replac adjustment adjust dependent depend adoption adopt effective effect bowdlerize bowdler
    probate probat rate rate cease ceas controll control roll roll by by yes ye say sai""".split()
    assert [porter.stem(a) for a in pairs[::2]] == pairs[1::2]


def test_stems_of_lists(spark):
    frame = spark.createDataFrame([(["running", "runs", None],), (None,), ([],), (["x" * 70 + "ing"],)], "w array<string>")
    assert [r.s for r in frame.select(porter.stemmed(F.col("w")).alias("s")).collect()] == [["run", "run", None], None, [], ["x" * 70 + "ing"]]


def test_index_follows_its_documents(spark, tmp_path):
    """After each change an index with its segments holds what an index made anew would."""
    path = f"file://{tmp_path}/index"
    frame = lambda rows: spark.createDataFrame(rows, "session_id long, ordinal int, text string")
    states = [
        [(i, k, f"word{i % 3} runs over hills {k}") for i in range(6) for k in range(2)],
        [(i, k, f"word{i % 3} runs over hills {k}" if i != 2 else "running dogs") for i in range(1, 6) for k in range(2)],
        [(i, k, f"word{i % 3} runs over hills {k}") for i in range(6) for k in range(2)],  # back again, after a change and a loss
        [],
        [(9, 0, "dogs run")],
    ]

    def content(at):
        post = textindex.postings(spark, path, at).select("session_id", "ordinal", "term", "tf", "positions", "dl")
        return sorted(map(repr, (tuple(r) for r in post.collect())))

    for n, rows in enumerate(states, 1):
        made = textindex.refresh(frame(rows), path, 4)
        assert made.generation == n and (made.n_docs, made.sum_dl) == (len(rows), sum(len(t.split()) for _, _, t in rows))
        new = f"file://{tmp_path}/new{n}"
        fresh = textindex.refresh(frame(rows), new, 4)
        post = textindex.postings(spark, new, fresh).select("session_id", "ordinal", "term", "tf", "positions", "dl")
        assert content(made) == sorted(map(repr, (tuple(r) for r in post.collect())))
        for q in ("run", '"run over"', "dogs"):
            one, other = ({(r.session_id, r.ordinal): round(r.score, 9) for r in textindex.bm25(spark, p, search.atoms(q)).collect()} for p in (path, new))
            assert one == other
        check = textindex.validate(frame(rows), path).first()
        assert (check.expected, check.actual, check.missing, check.extra, check.duplicates, check.stray) == (len(rows), len(rows), 0, 0, 0, 0)
    assert textindex.refresh(frame(states[-1]), path) == made
    before = content(None)
    merged = textindex.merge(spark, path)
    assert len(merged.segments) == 1 and content(None) == before == content(made)
    assert textindex.validate(frame(states[0]), path).first().missing == 12


def test_index_groups_the_words_of_a_document_in_its_row(spark, tmp_path, monkeypatch):
    """Words are not shuffled to be grouped by document (F15): of an index the postings alone are."""
    texts = ["Runs run a RUN over a", "", "hills"]
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "session_id long, ordinal int, text string")
    plans, write = [], textindex._write_postings
    monkeypatch.setattr(textindex, "_write_postings", lambda post, *a: (plans.append(post._jdf.queryExecution().executedPlan().toString()), write(post, *a)))
    textindex.refresh(docs, f"file://{tmp_path}/index", 2)
    assert len(plans) == 1 and "Exchange" not in plans[0]
    post = textindex.postings(spark, f"file://{tmp_path}/index").collect()
    found = sorted((r.session_id, r.term, r.form or "", r.tf, r.positions, r.dl) for r in post)
    assert found == [
        (0, "a", "", 2, [2, 5], 6), (0, "over", "", 1, [4], 6), (0, "run", "", 2, [1, 3], 6), (0, "run", "runs", 1, [0], 6), (2, "hill", "hills", 1, [0], 1),
    ]


def test_a_worker_groups_a_bounded_number_of_words_at_once(monkeypatch):
    """What a batch holds doesn't tell how much of it is grouped at once (F18)."""
    monkeypatch.setattr(textindex, "WORDS", 4)
    lists = [["runs", "run", "runs"], None, [], ["a"] * 9 + ["hills"], ["run"], ["hills", "b"], None]
    batches = [pa.array(lists, pa.list_(pa.string())), pa.array([], pa.list_(pa.string())), pa.array([None], pa.list_(pa.string()))]
    pieces = list(textindex.grouped(batches))
    assert len(pieces) > 3 and all(sum(len(p["positions"]) for x in piece.to_pylist() for p in x) <= 4 + 10 for piece in pieces)

    def expected(words):
        places = {}
        for k, w in enumerate(words or []):
            places.setdefault(w, []).append(k)
        return sorted(((porter.stem(w), None if porter.stem(w) == w else w, at) for w, at in places.items()), key=repr)

    found = [sorted(((p["term"], p["form"], p["positions"]) for p in x), key=repr) for piece in pieces for x in piece.to_pylist()]
    assert found == [expected(words) for words in [*lists, None]]


def test_index_reads_the_folders_of_its_stems(spark, tmp_path):
    docs = spark.createDataFrame([(i, 0, f"w{i} run") for i in range(200)], "session_id long, ordinal int, text string")
    path = f"file://{tmp_path}/index"
    textindex.refresh(docs, path, 16)
    plan = textindex.postings(spark, path, words=["run"])._jdf.queryExecution().toString()
    assert "folder#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,run)" in plan


def test_blank_query_and_foreign_cursor():
    with pytest.raises(search.InvalidQuery):
        search.atoms("  ")
    raw = search.Cursor(-1.5, 3, 7, "q1").encode()
    assert search.Cursor.decode(raw, "q1") == search.Cursor(-1.5, 3, 7, "q1")
    with pytest.raises(search.InvalidQuery):
        search.Cursor.decode(raw, "q2")
    with pytest.raises(search.InvalidQuery):
        search.Cursor.decode("%%%", "q1")


def test_snippets_group_and_cut(spark):
    text = "x" * 100 + " with a with " + "y" * 300 + " with"
    f = spark.createDataFrame([(1, 0, text)], "session_id int, ordinal int, text string")
    got = search.snippets(f, ["with"]).orderBy("n").collect()
    assert [(r.n, text[r.start : r.end]) for r in got] == [(0, "with a with"), (1, "with")]
    assert got[0].snippet.startswith("…x") and got[0].snippet.endswith("y…")
    assert not got[1].snippet.endswith("…")


RAW = "session_id int, ordinal int, record_kind string, side string, text string, identity_kind string, identity_id string, ts bigint, tools int"


def test_replays_need_identity_not_text(spark):
    rows = [
        (1, 0, "real_user", "user", "hi", "uuid", "a", 5, 0),
        (1, 1, "real_user", "user", "hi", "uuid", "a", 5, 0),
        (1, 2, "real_user", "user", "hi", "none", "a", 5, 0),
        (1, 3, "real_user", "user", "hi", "uuid", "a", None, 0),
        (1, 4, "tool", None, None, "uuid", "b", 6, 2),
    ]
    raw = spark.createDataFrame(rows, RAW)
    m = replay.construction_metrics(raw).first()
    assert (m.raw, m.logical, m.replay, m.unknown_identity, m.user, m.assistant, m.raw_tools) == (5, 4, 1, 2, 3, 0, 2)
    assert replay.broken_invariants(replay.construction_metrics(raw)).isEmpty()
    assert replay.disagreements(raw).isEmpty()
    other = raw.withColumn("text", F.when(F.col("ordinal") == 1, "ho").otherwise(F.col("text")))
    assert replay.disagreements(other).count() == 1
    assert replay.broken_ordinals(raw.filter("ordinal <> 2")).count() == 1


def test_actions_and_incomplete_walks(spark):
    cur = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "a", False), (4, "a", True)], "k int, generation string, valid boolean")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (5, "a")], "k int, generation string")
    want = {1: "unchanged", 2: "publish", 3: "repair", 4: "orphan", 5: "publish"}
    assert as_map(replay.plan_actions(cur, new, ["k"], F.lit(True)), "k", "action") == want
    assert as_map(replay.plan_actions(cur, new, ["k"], F.lit(False)), "k", "action") == want | {4: "retain"}


def test_claims_and_chains(spark):
    known = spark.createDataFrame([(i,) for i in range(1, 10)], "session_id int")
    claims = spark.createDataFrame([(2, 1), (3, 2), (4, 4), (5, 99), (6, 7), (7, 8), (8, 6), (9, 6)], "child int, parent int")
    status = graph.claim_status(known, claims)
    want = {2: "resolved", 3: "resolved", 4: "self_invalid", 5: "unresolved", 6: "cycle_invalid", 7: "cycle_invalid", 8: "cycle_invalid", 9: "resolved"}
    assert as_map(status, "child", "status") == want
    chain = graph.chains(status.filter("status = 'resolved'").select("child", "parent"))
    assert as_map(chain, "session_id", "chain") == {1: 1, 2: 1, 3: 1, 6: 6, 9: 6}


def test_tags_merge_nest_demote(spark):
    d = spark.createDataFrame(
        [(1, "a", "b", "merge", 1), (2, "b", "c", "merge", 1), (3, "x", "facet:y", "demote", 1), (4, "c", "top", "nest", 2), (5, "a", "z", "merge", 0)],
        "id int, from_tag string, to_tag string, action string, created_at int",
    )
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (3, "q")], "session_id int, tag string")
    got = {(r.session_id, r.tag, r.parent) for r in graph.display_tags(spark, tags, d).collect()}
    assert got == {(1, "c", "top"), (3, "q", None)}


def test_eras_use_the_furthest_reach(spark):
    f = spark.createDataFrame([(1, 0, 100), (2, 10, 20), (3, 105, 106), (4, 200, 201)], "id int, start_ms int, end_ms int").withColumn("k", F.lit(1))
    assert as_map(lineage.eras(f, ["k"], 10), "id", "era") == {1: 1, 2: 1, 3: 1, 4: 2}


def test_lineage_reasons(spark):
    stats = spark.createDataFrame([(c,) for c in ("/h/u/code/app", "/h/u/code/app/x", "/h/u/code/app-wt-fix", "/h/u/code/code-app", "/h/u/zeta", "/else/app")], "cwd string")
    got = as_map(lineage.resolve(stats, "/h/u/code/app", also=["/h/u/zeta"]), "cwd", "reason")
    assert got == {"/h/u/code/app": "exact", "/h/u/code/app/x": "inside", "/h/u/code/app-wt-fix": "worktree", "/h/u/code/code-app": "renamed", "/h/u/zeta": "also"}


def test_creator_order_of_rules(spark):
    msgs = spark.createDataFrame(
        [(1, 0, "user", "pls fix it?"), (2, 0, "user", "[from parent] do"), (3, 0, "user", "<system-reminder>"), (4, 0, "user", "what now?"), (5, 0, "user", "Implement lane A. Repo: x. " + "word " * 200)],
        "session_id int, ordinal int, role string, text string",
    )
    launch = spark.createDataFrame([(1, "human", "cli"), (2, "unknown", None), (3, "human", None), (4, "human", "isSidechain"), (5, "human", "cli")], "session_id int, origin string, detail string")
    got = {r.session_id: (r.started_by, r.confidence) for r in creator.verdicts(msgs, launch).collect()}
    assert got == {1: ("human", 0.85), 2: ("agent", 0.9), 3: ("unknown", 0.4), 4: ("agent", 0.97), 5: ("agent", 0.9)}


def test_greedy_segments_keep_three_units(spark):
    unit = spark.createDataFrame([(1, i) for i in range(10)], "session_id bigint, unit int")
    scores = spark.createDataFrame([(1, 3, 4), (1, 4, 9), (1, 7, 3), (1, 8, 9)], "session_id bigint, unit int, score int")
    got = [(r.first_unit, r.last_unit) for r in topics.episodes(unit, scores).orderBy("episode").collect()]
    assert got == [(0, 3), (4, 6), (7, 9)]


def test_rounds_over_all_sessions_broadcast_nothing(spark):
    """What is broadcast goes through the driver, round by round."""
    known = spark.createDataFrame([(i,) for i in range(1, 9)], "session_id bigint")
    claims = spark.createDataFrame([(2, 1), (3, 2), (5, 4), (6, 7), (7, 6), (8, 8), (4, 99)], "child bigint, parent bigint")
    status = graph.claim_status(known, claims)
    resolved = graph.checkpoint(status.filter("status = 'resolved'").select("child", "parent"))
    members = graph.chains(resolved)
    sess = known.select("session_id", F.lit("h").alias("harness"), F.concat(F.lit("n"), "session_id").alias("native_id"), F.lit(1).alias("last_activity"), F.lit(1).alias("tok_total"))
    keyed = graph.stable_chains(members, resolved, sess)
    assert sorted((r.chain, r.stable_key, r.members) for r in keyed.collect()) == [(1, "lineage-v1:h:n1", 3), (4, "lineage-v1:h:n4", 2)]
    assert not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in (status, members, keyed))


def test_words_of_more_units_meet_in_more_tasks(spark, monkeypatch):
    """A task counts the words of so many units, however many there are; the similarities stay the same."""
    rows = [(s, u, u, "", f"alpha{u // 3} beta{u} gamma{s} delta{u % 2} alpha{u // 3}") for s in range(8) for u in range(7)]
    unit = spark.createDataFrame(rows, "session_id bigint, unit int, ordinal int, human string, context string")
    told = lambda: {(r.session_id, r.unit): round(r.similarity, 9) for r in topics.neighbour_similarity(unit).collect()}
    want = told()
    monkeypatch.setattr(topics, "UNITS_PER_TASK", 3)
    assert told() == want and len(want) == 8 * 4 and any(want.values())
    episode = topics.episodes(unit, topics.boundary_scores(unit))
    for df in (topics.neighbour_similarity(unit), topics.keywords(unit, episode)):
        assert re.search(r"hashpartitioning\(session_id#\d+L?, 19\)", df._jdf.queryExecution().executedPlan().toString())


def test_shape_order(spark):
    f = spark.createDataFrame([("agent", 99, 0), ("human", 9, 999), ("human", 20, 300), ("human", 20, 10), ("human", 20, 80)], "s string, h int, t int")
    shape = topics.shape(F.col("s"), F.col("h"), F.col("t"), F.lit(0), F.lit(0), F.lit(1))
    assert [r[0] for r in f.select(shape).collect()] == ["worker", "tiny", "marathon", "wanderer", "conversation"]


def test_context_skips_what_does_not_fit(spark):
    f = spark.createDataFrame([(1, 0, 60), (1, 1, 50), (1, 2, 40), (1, 3, 1)], "k int, o int, bytes int")
    assert as_map(passages.export_context(f, ["k"], "o", 100), "o", "included") == {0: True, 1: False, 2: True, 3: False}


def test_packing_caps(spark):
    f = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 5, 5, 20, 1, 1, 1])], "s int, i int, tokens int")
    got = as_map(packing.pack(f, ["s"], ["i"], 3, 10), "i", "batch")
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3, 6: 3}


def test_favourites_are_never_cut(spark):
    s = spark.createDataFrame([("a", "One. Two. " + "x" * 4000), ("b", "y")], "scope string, text string")
    f = spark.createDataFrame([("a", "z" * 40), ("b", "z" * 4000)], "scope string, text string")
    assert as_map(packing.export_preview(s, f, 100), "scope", "step") == {"a": "two_sentences", "b": "error"}


def test_filters_agree_and_reject(spark):
    rows = spark.createDataFrame([(1, "claude", "c1", 5, ["m1"], None), (2, "codex", "c2", 7, None, "agent"), (3, "claude", "c3", 9, ["m2"], "human")], "session_id int, harness string, native_id string, last_activity int, models array<string>, origin string")
    pick = lambda **kw: [r.session_id for r in filters.apply(rows, filters.SessionFilter(**kw)).orderBy("session_id").collect()]
    assert pick(models=["m1"]) == [1]
    assert pick(since=5, until=9) == [1, 2]
    assert pick(hide_agents=True) == [1, 3]
    layer = spark.createDataFrame([(1, "f", "t", "p"), (3, "f", "u", None)], "session_id int, facet string, tag string, parent string")
    assert [r.session_id for r in filters.apply(rows, filters.SessionFilter(layer_tags=[("f", "p")]), layer_tags=layer).collect()] == [1]
    with pytest.raises(ValueError):
        filters.SessionFilter(since=3, until=3)
    chosen = filters.add_term(filters.add_term(filters.SessionFilter(), "facet", "code"), "tag", "x")
    assert chosen.layer_tags == [("code", "x")] and filters.add_term(chosen, "facet", "ops").layer_tags is None
    assert filters.remove_term(chosen, "tag", "x").layer_tags is None


def test_torn_tail_and_offsets(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"type":"user"}\n{"broken\n{"torn')
    (tmp_path / "b.jsonl").write_bytes("é\n".encode())
    (tmp_path / "c.jsonl").write_bytes(b"")
    rows = jsonl.complete_lines(spark, str(tmp_path)).orderBy("path", "line_no").collect()
    assert [(r.path[-7:], r.line_no, r.byte_offset) for r in rows] == [("a.jsonl", 0, 0), ("a.jsonl", 1, 16), ("b.jsonl", 0, 0)]
    bad = jsonl.records(jsonl.complete_lines(spark, str(tmp_path))).filter("NOT valid AND path LIKE '%a.jsonl'").collect()
    assert [r.byte_offset for r in bad] == [16]


def test_content_blocks(spark):
    content = [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"p": 1}}, {"type": "text", "text": "b"}]
    lines = [json.dumps({"type": "assistant", "sessionId": "s", "message": {"role": "assistant", "content": c}}) for c in (content, content[1:2], "plain", [{"type": "thinking", "thinking": "x"}])]
    f = spark.createDataFrame([("p", i, 0, x) for i, x in enumerate(lines)], "path string, line_no int, byte_offset int, line string")
    got = jsonl.records(f).orderBy("line_no").collect()
    assert [r.prose for r in got] == ["a\nb", None, "plain", None]
    assert [r.record_kind for r in got] == ["assistant_dialogue_prose", "tool", "assistant_dialogue_prose", "control_context"]
    assert got[0].tools[0].name == "Read" and got[0].tools[0].kind == "call"


def test_chatgpt_cycle(spark):
    node = lambda p: {"parent": p, "message": None}
    tree = [{"id": "c", "title": "t", "current_node": "a", "mapping": {"a": node("b"), "b": node("a")}}]
    with pytest.raises(Exception, match="cycle"):
        exports.chatgpt(spark.createDataFrame([(json.dumps(tree),)], "value string")).collect()


def test_gemini_rewind_and_reset(spark):
    events = [{"id": "a", "content": "1"}, {"id": "b", "content": "2"}, {"id": "a", "content": "3"}, {"$rewindTo": "b"}, {"id": "c", "content": "4"}]
    f = spark.createDataFrame([("p", i, json.dumps(e)) for i, e in enumerate(events)], "path string, line_no int, line string")
    assert [(r.id, r.text) for r in exports.gemini_stream(f).orderBy("ordinal").collect()] == [("a", "3"), ("c", "4")]
    reset = [*events, {"$set": {"messages": [{"id": "z", "content": "9"}]}}, {"$rewindTo": "nobody"}, {"id": "y", "content": "8"}]
    f = spark.createDataFrame([("p", i, json.dumps(e)) for i, e in enumerate(reset)], "path string, line_no int, line string")
    assert [(r.id, r.text) for r in exports.gemini_stream(f).collect()] == [("y", "8")]


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE messages (id TEXT, n INTEGER)")
        db.executemany("INSERT INTO messages VALUES (?, ?)", [("a", 1), ("b", None)])
    spark.dataSource.register(SqliteSource)
    got = spark.read.format("sqlite").option("table", "messages").schema("id string, n bigint, absent string").load(path).collect()
    assert [tuple(r) for r in got] == [("a", 1, None), ("b", None, None)]


def test_publish_flips_only_whole_generations(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    publish.publish(spark.range(3), root)
    with pytest.raises(ValueError):
        publish.publish(spark.range(9), root, broken=spark.range(1))
    assert publish.current(spark, root).count() == 3
    publish.publish(spark.range(5), root)
    assert publish.current(spark, root).count() == 5


def test_capture_takes_what_is_appended(spark, tmp_path):
    src, out, state = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    src.mkdir()

    def told():
        capture.sweep(spark, f"file://{src}", out, state)
        rows = capture.captured(spark, out).orderBy("path", "byte_offset").collect()
        return [(r.path.rsplit("/", 1)[1], r.byte_offset, r.line) for r in rows]

    first = [("a.jsonl", 0, "one"), ("a.jsonl", 4, "zwei é")]
    (src / "a.jsonl").write_text("one\nzwei é\ntor")
    assert told() == first and told() == first
    with (src / "a.jsonl").open("a") as f:
        f.write("n, three\n" + "x" * 3_000_000 + "\n")
    (src / "b.jsonl").write_text("\n1\n")
    more = [*first, ("a.jsonl", 12, "torn, three"), ("a.jsonl", 24, "x" * 3_000_000), ("b.jsonl", 0, ""), ("b.jsonl", 1, "1")]
    assert told() == more
    offsets, number = capture.offsets_of(spark, state)
    assert number == 3 and {r.path.rsplit("/", 1)[1]: r.taken for r in offsets.collect()} == {"a.jsonl": 3_000_025, "b.jsonl": 3}
    # a sweep that broke off before its offsets is done again under its number
    capture.new_lines(capture.pending(capture.listing(spark, f"file://{src}"), offsets.limit(0))).write.parquet(f"{out}/sweep=4")
    assert told() == more
    (src / "b.jsonl").write_text("9\n")
    assert told() == [*more[:4], ("b.jsonl", 0, "9")]


def test_capture_tells_rewritten_files(spark, tmp_path, monkeypatch):
    """A file written anew starts a generation at any length; its old lines stay; places are compacted."""
    monkeypatch.setattr(capture, "WHOLE_EVERY", 3)
    src, out, state = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    src.mkdir()

    def told(text, thorough=False):
        if text is not None:
            (src / "a.jsonl").write_text(text)
        capture.sweep(spark, f"file://{src}", out, state, thorough)
        rows = capture.captured(spark, out).orderBy("byte_offset").collect()
        return [(r.generation, r.line) for r in rows]

    assert told("one\ntwo\n") == [(0, "one"), (0, "two")]
    assert told("ONE\nTWO\n") == [(1, "ONE"), (1, "TWO")]
    assert told("alpha\nbeta\ngamma\n") == [(2, "alpha"), (2, "beta"), (2, "gamma")]
    assert told(None) == told("alpha\nbeta\ngamma\nto") == [(2, "alpha"), (2, "beta"), (2, "gamma")]
    assert told("alpha\nbeta\ngamma\ntorn\n")[-1] == (2, "torn")
    assert told("x\n") == told("") == told("x\n") == [(3, "x")]
    big = ["head " * 2000, "middle " * 2000, "tail " * 2000]
    assert [g for g, _ in told("\n".join(big) + "\n")] == [4] * 3
    big[1] = big[1].upper()
    # the same beginning and end: only a thorough sweep sees it
    assert told("\n".join(big) + "\n")[1] == (4, "middle " * 2000)
    (src / "a.jsonl").touch()
    assert told("\n".join(big) + "\n", thorough=True)[1] == (5, "MIDDLE " * 2000)
    offsets, number = capture.offsets_of(spark, state)
    assert number == 12 and offsets.count() == 1
    assert len({r.generation for r in capture.lines_of(spark, out).collect()}) == 6
    (src / "a.jsonl").unlink()
    (src / "b.jsonl").write_text("1\n")
    assert capture.sweep_until_still(spark, f"file://{src}", out, state) == capture.Sweep(13, 0)
    files = capture.availability(capture.listing(spark, f"file://{src}"), capture.offsets_of(spark, state)[0])
    assert {r.path.rsplit("/", 1)[1]: r.status for r in files.collect()} == {"a.jsonl": "snapshot_only", "b.jsonl": "current"}
    assert capture.captured(spark, out).count() == 4


def test_windows_cut_lines_at_any_place(monkeypatch):
    import io
    import zlib

    text = b"a\n\n" + b"long" * 20 + b"\nb\ntorn"
    for window in range(1, 30):
        monkeypatch.setattr(capture, "WINDOW", window)
        for start in (0, 2):
            found, end, crc = [], start, zlib.crc32(text[:start])
            for offsets, lines, end, crc in capture.complete_lines(io.BytesIO(text), start, len(text), crc):
                found += zip(offsets, lines)
            assert found == [x for x in [(0, b"a"), (2, b""), (3, b"long" * 20), (84, b"b")] if x[0] >= start]
            assert end == 86 and crc == zlib.crc32(text[:86]) == capture.checksum(io.BytesIO(text), 86)


def continuity_log(spark, *rows):
    event = lambda kind, n, i, ts, detail=None, uuid=None: (kind, n, i, uuid, ts, "record-id", detail)
    data = [(1, seq, action, "unknown", [event(*e) for e in events]) for seq, (action, *events) in enumerate(rows)]
    return spark.createDataFrame(data, continuity.LOG)


def test_continuity_is_ordered_deduplicated_and_refreshed(spark):
    first = ("sync", ("checkpoint", 20, "z", 300, "z"), ("compaction", 10, "a", 100, "a"), ("compaction", 10, "a", 100, "a"), ("checkpoint", 5, "null-ts", None, "null"), ("compaction", 10, "a", None, " "))
    log = continuity_log(spark, first)
    rows = continuity.history(log).orderBy("position").collect()
    assert [(r.ordinal, r.ts) for r in rows] == [(5, None), (10, 100), (10, None), (20, 300)]
    assert rows[1].event_key == '["compaction",10,"a",null,100,"a"]' and rows[2].detail is None
    again = continuity_log(spark, first, ("sync", ("other", -7, "new \"x\"", 700)))
    only = continuity.history(again).first()
    assert (only.kind, only.ordinal, only.event_key) == ("compaction", 0, '["compaction",0,"new \\"x\\"",null,700,null]')


def test_continuity_reset_rebuild_archive(spark):
    two = ("sync", ("compaction", 2, "c", 200), ("checkpoint", 4, "k", 400))

    def after(*actions):
        log = continuity_log(spark, two, *[a if isinstance(a, tuple) else (a,) for a in actions])
        s = continuity.states(log).first()
        return s.status, s.reset_generation, [r.record_id for r in continuity.history(log).orderBy("position").collect()], continuity.evidence(log).count()

    assert after() == ("active", 0, ["c", "k"], 2)
    assert after("reset") == after("reset", two) == ("reset", 1, [], 2)
    assert after("reset", two, "rebuild") == ("active", 1, ["c", "k"], 2)
    assert after("reset", "rebuild", "reset") == ("reset", 2, [], 2)
    assert after("archive") == ("archived", 0, ["c", "k"], 2) and after("archive", "restore") == ("active", 0, ["c", "k"], 2)
    assert after("reset", "archive") == ("archived", 1, [], 2)
    assert after(("sync",)) == ("active", 0, [], 0)


def test_continuity_of_records(spark):
    lines = [
        ("a", 0, '{"type":"system","subtype":"compact_boundary","uuid":"u1","timestamp":"2026-01-02T03:04:05Z","compactMetadata":{"trigger":"auto"}}'),
        ("a", 1, '{"type":"user","message":{"role":"user","content":"system compact_boundary, it was compacted"}}'),
        ("a", 2, '{"type":"system","subtype":"other"}'),
        ("a", 3, '{"type":"system","subtype":"compact_boundary","compactMetadata":7}'),
    ]
    frame = spark.createDataFrame(lines, "path string, line_no int, line string")
    got = jsonl.continuity_events(frame).first().events
    assert [(e.ordinal, e.record_uuid, e.ts, e.identity, e.detail) for e in got] == [(0, "u1", 1767323045000, "uuid", '{"trigger":"auto"}'), (3, None, None, "none", None)]
    kimi = rollouts.context_events(rollouts.context_records(spark.createDataFrame([("c", 0, '{"role":"_checkpoint","id":"7"}'), ("c", 1, '{"role":"user","content":"_checkpoint"}')], "path string, line_no int, line string")))
    assert [(e.kind, e.record_id, e.identity, e.detail) for e in kimi.first().events] == [("checkpoint", "7", "record-id", "kimi:_checkpoint")]


def test_capture_follows(spark, tmp_path):
    import time

    src, out, state = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    src.mkdir()
    (src / "a.jsonl").write_text("1\n")
    query = capture.follow(spark, f"file://{src}", out, state, f"file://{tmp_path}/ck", "1 second")
    try:
        until = time.time() + 60
        while capture.offsets_of(spark, state)[1] < 1 and time.time() < until:
            time.sleep(0.5)
        with (src / "a.jsonl").open("a") as f:
            f.write("2\n")
        while capture.captured(spark, out).count() < 2 and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert [r.line for r in capture.captured(spark, out).orderBy("byte_offset").collect()] == ["1", "2"]


def test_sessions_stream_like_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = sessionize.event_sessions(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), late="0 seconds")
    sessionize.write(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    told = spark.read.parquet(f"{tmp_path}/out")
    batch = sessionize.event_sessions(e)
    # sessions that the watermark hasn't passed are still open
    assert told.exceptAll(batch).isEmpty() and 0 < batch.count() - told.count() < 50
