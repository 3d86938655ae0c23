"""Lineage of folders: what belongs to a project, what lies near, and what is loaded of its sessions."""

from pyspark.sql import functions as F

from skeinlake.functions import authorship
from skeinlake.operators import lineage


def reasons(spark, paths, target, **options):
    stats = spark.createDataFrame([(p,) for p in paths], "cwd string")
    held = lineage.resolve(stats, target, **options)
    near = lineage.nearby(stats, held, target, exclude=options.get("exclude", []))
    return {r.cwd: r.reason for r in held.collect()}, {r.cwd: r.reason for r in near.collect()}


def test_prefixes_and_small_parents_are_near_only(spark):
    many = [f"/v/data/code/p{i}" for i in range(9)]
    held, near = reasons(spark, [*many, "/v/data/code", "/v/data/code/lab", "/u/dev/code/lab/tidal-forces"], "/v/data/code/lab/tidal-forces-OLD")
    assert held == {} and near == {"/v/data/code/lab": "parent", "/u/dev/code/lab/tidal-forces": "similar"}


def test_launch_pads_roles_and_short_names_are_not_near(spark):
    held, near = reasons(spark, ["/u", "/u/dev", "/u/dev/code", "/u/dev/code/abc", "/x/abc-two", "/x/src", "/u/dev/code/abc/", "/x/ab", "/"], "/u/dev/code/abc")
    assert held == {"/u/dev/code/abc": "exact", "/u/dev/code/abc/": "exact"}
    assert near == {"/u/dev/code": "parent", "/x/abc-two": "similar"}


def test_a_role_goes_by_parent_and_name(spark):
    """At the fourth level a folder named after a role stays; its project's name has its parent before it."""
    held, near = reasons(spark, ["/u/x/team/web", "/y/team-web-old", "/y/web-old"], "/u/x/team/web")
    assert held == {"/u/x/team/web": "exact"} and near == {"/y/team-web-old": "similar"}


def test_exclusion(spark):
    """An excluded folder takes those below it out of the project; of what is near it takes only itself."""
    paths = ["/u/dev/code/kinetic", "/v/data/code/kinetic", "/v/data/code/kinetic/lib", "/w/kinetic-tiles", "/w/kinetic-tiles/a/kinetic-x"]
    held, near = reasons(spark, paths, "/v/data/code/kinetic", exclude=["/u/dev/code/kinetic", "/w/kinetic-tiles/"])
    assert held == {"/v/data/code/kinetic": "exact", "/v/data/code/kinetic/lib": "inside"}
    assert near == {"/w/kinetic-tiles/a/kinetic-x": "similar"}
    held, _ = reasons(spark, paths, "/v/data/code/kinetic", also=["/w/kinetic-tiles/"])
    assert held["/w/kinetic-tiles"] == held["/w/kinetic-tiles/a/kinetic-x"] == "also"


SESSIONS = "session_id long, cwd string, start long, last long, raw_origin string, origin string"


def test_sessions_of_a_project(spark):
    rows = [
        (1, "/p", 10, 20, "human", "human"), (2, "/p", None, 30, "agent", "human"), (3, "/p", None, None, None, None), (4, "/p", 50, 60, "human", "empty"),
        (5, "/q", 10, 20, "human", "human"), (6, None, 10, 20, "human", "human"), (7, "/p", 40, None, "human", "agent"),
    ]
    sessions = spark.createDataFrame(rows, SESSIONS)
    held = spark.createDataFrame([("/p", "exact")], "cwd string, reason string")
    shown = lambda **o: {(r.session_id, r.begun, r.hidden) for r in lineage.project_sessions(sessions, held, **o).collect()}
    assert shown() == {(1, 10, False), (2, 30, True), (3, 0, False), (7, 40, False)}
    assert shown(agents=True) == {(1, 10, False), (2, 30, False), (3, 0, False), (7, 40, False)}
    assert shown(since=10, until=40) == {(1, 10, False), (2, 30, True)}
    assert lineage.project_sessions(sessions.limit(0), held).count() == 0


def test_dialogue_of_what_is_shown(spark):
    sessions = spark.createDataFrame([(1, False), (2, True)], "session_id long, hidden boolean")
    turns = [
        (1, 0, "user", "\n<system-reminder>no"), (1, 1, "user", "  yes \n"), (1, 2, "assistant", "\t<skill> stays\n"), (1, 3, "assistant", " \n"),
        (1, 4, "user", "<command-name>\n/spec</command-name>\n<command-args>\nbuild\nit </command-args>"), (1, 5, "user", None), (2, 0, "user", "hidden"), (3, 0, "user", "other"),
    ]
    frame = spark.createDataFrame(turns, "session_id long, ordinal long, side string, text string")
    got = {r.ordinal: r.text for r in lineage.project_dialogue(sessions, frame).collect()}
    assert got == {1: "yes", 2: "<skill> stays", 4: "/spec build\nit"}


def test_human_text_strips_every_kind_of_blank(spark):
    frame = spark.createDataFrame([(" ## Context Usage 5%",), ("\r\n hi　",), ("<send_reply>blue</send_reply>",)], "x string")
    assert [r[0] for r in frame.select(authorship.human_text(F.col("x"))).collect()] == [None, "hi", "<send_reply>blue</send_reply>"]
