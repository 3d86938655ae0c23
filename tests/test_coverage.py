"""What a library doesn't cover, chains by stable keys, titles and dialogue in one ranking."""

from skeinlake.operators import filters, graph, library, search

SOURCES = "id string, harness string, enabled boolean, reachable boolean, capability string, error string"
PLACES = "id string, source_id string, locator string, at long, admission string, indexed boolean, gaps array<string>"


def test_limitations(spark):
    sources = [
        ("a", "h", True, True, "full", None), ("b", "h", False, True, "full", None), ("c", "h", True, False, "full", ""), ("d", "h", True, True, "unsupported", None),
        ("e", "h", False, False, None, "denied"), ("f", "h", None, True, "full", None), ("g", "h", True, True, None, "y" * 2000),
    ]
    places = [
        ("1", "a", "x", 5, None, True, None), ("2", "a", "x", 9, None, True, ["late", "cut"]), ("3", "a", "y", 5, "kept", False, []), ("4", "a", "z", 5, "excluded", False, ["g"]),
        ("5", "a", "w", 5, None, True, []), ("6", "a", "w", 4, None, False, ["old"]), ("7", "b", "x", 5, None, None, None), ("8", "a", "v", 5, None, False, None), ("9", "a", "v", 5, None, True, None),
    ]
    s, o = spark.createDataFrame(sources, SOURCES), spark.createDataFrame(places, PLACES)
    got = {(r.kind, r.id): r.text for r in library.limitations(s, o).collect()}
    assert got == {
        ("source", "b"): "h: excluded", ("source", "c"): "h: unavailable or unsupported", ("source", "d"): "h: unavailable or unsupported", ("source", "e"): "h: denied", ("source", "f"): "h: excluded",
        ("source", "g"): "h: " + "y" * (library.TOLD - 3) + "…", ("observation", "2"): "2: late; cut", ("observation", "3"): "3: retained but not indexed", ("observation", "7"): "7: retained but not indexed",
    }
    assert {r.id for r in library.limitations(s, o).filter("cut").collect()} == {"g"}
    told = library.coverage_totals(s, o).first()
    assert (told.sources, told.observations, told.indexed, told.excluded, told.source_issues, told.observation_issues, told.partial) == (7, 6, 3, 1, 6, 3, True)
    fine = library.coverage_totals(s.filter("id = 'a'"), o.filter("id = '5'")).first()
    assert not fine.partial and library.coverage_totals(s.limit(0), o.limit(0)).first().partial


SESSIONS = "session_id long, harness string, native_id string, last_activity long, tok_total long"


def test_stable_keys_outlive_rebuilds(spark):
    sess = spark.createDataFrame([(1, "h", "c", 5, 1), (2, "h", "b", None, 1), (3, "h", "a", 5, 1), (4, "h", "z", 9, 1), (5, "h", "y", None, None)], SESSIONS)
    resolved = spark.createDataFrame([(3, 1), (2, 1), (5, 4)], "child long, parent long")
    made = graph.stable_chains(graph.chains(resolved), resolved, sess)
    got = {r.stable_key: (r.chain, r.members, r.first_activity, r.last_activity, r.tok_total, r.head) for r in made.collect()}
    assert got == {"lineage-v1:h:c": (1, 3, 5, 5, 3, 3), "lineage-v1:h:z": (4, 2, 9, 9, 1, 4)}
    # other ids, another member: the same keys
    moved = spark.createDataFrame([(11, "h", "c", 5, 1), (12, "h", "b", None, 1), (10, "h", "a", 7, 1), (14, "h", "z", 9, 1), (15, "h", "y", 1, 1), (9, "h", "0", 1, 1)], SESSIONS)
    claims = spark.createDataFrame([(10, 11), (12, 11), (15, 14), (9, 15)], "child long, parent long")
    again = graph.stable_chains(graph.chains(claims), claims, moved)
    assert {r.stable_key: r.members for r in again.collect()} == {"lineage-v1:h:c": 3, "lineage-v1:h:z": 3}
    held = sess.join(graph.chains(resolved), "session_id", "left")
    chosen = filters.apply(held, filters.SessionFilter(chain_key="lineage-v1:h:z"), chains=made)
    assert {r.session_id for r in chosen.collect()} == {4, 5}
    assert filters.apply(held, filters.SessionFilter(chain_key="none"), chains=made).count() == 0
    assert graph.chain_mismatches(made, held).count() == 0
    assert {(r.chain, r.members, r.held) for r in graph.chain_mismatches(made.filter("chain = 1"), held.filter("session_id <> 2")).collect()} == {(1, 3, 2), (4, 0, 2)}


def test_a_title_is_no_message(spark):
    docs = spark.createDataFrame([(1, 0, "user", "plain words here"), (2, 0, "user", "a rare find"), (2, 1, "user", "plain words again")], "session_id long, ordinal long, side string, text string")
    titles = spark.createDataFrame([(1, "rare title"), (2, " \n"), (3, None), (4, "words")], "session_id long, title string")
    both = search.united(search.documents(docs), titles)
    assert {(r.session_id, r.ordinal, r.scope) for r in both.collect()} == {(1, 0, "dialogue"), (2, 0, "dialogue"), (2, 1, "dialogue"), (1, -1, "title"), (4, -1, "title")}
    scored = search.bm25(both, ["rare"])
    found = lambda scope=None: {(r.session_id, r.ordinal, r.scope) for r in search.in_scope(scored, scope).collect()}
    assert found() == {(1, -1, "title"), (2, 0, "dialogue")} and found("dialogue") == {(2, 0, "dialogue")} and found("title") == {(1, -1, "title")}
    # the shorter document ranks first, whatever its scope
    assert search.in_scope(scored).orderBy("score").first().scope == "title"
