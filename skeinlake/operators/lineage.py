"""Projects over time and place: eras, folder statistics, the lineage of a folder with its sessions and their dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlake.functions import text as fx
from skeinlake.functions.authorship import human_text

DAY_MS = 86_400_000
COLLECTION_CHILDREN = 8
#: Folders named after a role rather than a project, and worktree names.
GENERIC = [
    "source", "src", "app", "apps", "web", "main", "repo", "code", "frontend", "backend", "server", "client", "docs", "packages", "worktrees",
    "test", "tests", "lib", "core", "site", "project", "workspace",
]
WORKTREE = r"^(.+?)(?:-wt-.+|-worktree(?:-.+)?|\.worktrees?)$"


def eras(spans: DataFrame, group: list[str], gap_ms: int) -> DataFrame:
    """Adds ``era``: a new one starts when nothing of the group reached within ``gap_ms`` of the start.

    ``spans`` has start_ms, end_ms; reach is the latest end so far, not the last row's.
    """
    w = Window.partitionBy(*group).orderBy("start_ms", "id")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start_ms") - reach >= gap_ms), 1).otherwise(0)
    return spans.withColumn("__new", fresh).withColumn("era", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def cwd_stats(sess: DataFrame) -> DataFrame:
    """Per folder: sessions, first and last activity, sessions by harness."""
    per = sess.groupBy("cwd", "harness").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("last").alias("last"))
    return per.groupBy("cwd").agg(
        F.sum("n").alias("sessions"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("harness", "n")))).alias("harnesses"),
    )


def child_counts(paths: DataFrame, path: str = "cwd") -> DataFrame:
    """(folder, children): how many different entries lie right below each folder on the way to any path."""
    clean = fx.trim_slash(F.col(path))
    up = paths.select(clean.alias("__p")).distinct()
    way = up.select(F.explode(F.concat(F.array("__p"), fx.ancestors(F.col("__p")))).alias("dir")).filter("dir <> '/'").distinct()
    return way.groupBy(fx.parent_path(F.col("dir")).alias("folder")).agg(F.count(F.lit(1)).alias("children"))


def project_root(path: Column) -> Column:
    """The folder that names the project: worktrees resolve to their repository, roles to their parent."""
    root = fx.trim_slash(path)
    codex = F.regexp_extract(root, r"^(.*/\.codex/worktrees/[^/]+/[^/]+)(?:/.*)?$", 1)
    tree = F.regexp_extract(root, r"^(.+?)/(?:\.claude/worktrees|\.worktrees|worktrees)/[^/]+(?:/.*)?$", 1)
    root = F.when(codex != "", codex).when(tree != "", tree).otherwise(root)
    sibling = F.regexp_extract(fx.base_name(root), WORKTREE, 1)
    root = F.when(sibling != "", F.concat(F.regexp_replace(root, "/[^/]*$", "/"), sibling)).otherwise(root)
    generic = F.array(*[F.lit(g) for g in GENERIC])
    parts = F.split(root, "/")
    # how many trailing folders go: only generic ones, never above the fifth level
    kept = F.aggregate(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)),
        F.struct(F.size(parts).alias("n"), F.lit(True).alias("go")),
        lambda s, i: F.when(
            s["go"] & (i > 5) & F.array_contains(generic, F.element_at(parts, i)), F.struct((i - 1).alias("n"), F.lit(True).alias("go"))
        ).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("go"))),
    )["n"]
    return F.array_join(F.slice(parts, 1, kept), "/")


def _target(spark: SparkSession, target: str) -> tuple[str, str, str]:
    """The root that a target belongs to, its parent's name and its own."""
    root = spark.range(1).select(project_root(F.lit(target))).first()[0] or "/"
    parent, base = ["", *root.split("/")][-2:]
    return root, parent, base


def _trimmed(paths: list[str]) -> list[str]:
    return [p.rstrip("/") if len(p) > 1 else p for p in paths]


def resolve(stats: DataFrame, target: str, also: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(cwd, reason): folders that belong to the project that ``target`` lies in.

    exact, inside, also; or, for any folder on the way to a cwd, moved (same name
    where projects live), renamed (parent and name joined by a dash) or worktree.
    """
    t, parent, base = _target(stats.sparkSession, target)
    generic = base in GENERIC
    cwd = fx.trim_slash(F.col("cwd"))
    out = F.lit(False)
    for e in _trimmed(exclude):
        out = out | (cwd == e) | fx.is_under(cwd, F.lit(e))
    added = F.lit(False)
    for a in _trimmed(also):
        added = added | (cwd == a) | fx.is_under(cwd, F.lit(a))
    direct = F.when(cwd == t, "exact").when(fx.is_under(cwd, F.lit(t)), "inside").when(added, "also")
    counts = child_counts(stats)
    way = stats.filter(~out).select("cwd", direct.alias("direct"), F.posexplode(F.concat(F.array(cwd), fx.ancestors(cwd))).alias("depth", "dir"))
    way = way.join(counts, fx.parent_path(F.col("dir")) == F.col("folder"), "left")
    b, up = fx.base_name(F.col("dir")), fx.parent_path(F.col("dir"))
    pb = fx.base_name(up)
    lives = (pb == parent) | (F.coalesce("children", F.lit(0)) >= COLLECTION_CHILDREN) | up.rlike(r"/\.(?:codex|claude)/worktrees/[^/]+$")
    outside = (F.col("dir") != t) & ~fx.is_under(F.col("dir"), F.lit(t)) & ~fx.is_under(F.lit(t), F.col("dir"))
    alias = (
        F.when(outside & (b == base) & ((pb == parent) if generic else lives), "moved")
        .when(outside & ((b == f"{parent}-{base}") | (F.concat_ws("-", pb, b) == base)), "renamed")
        .when(outside & (F.regexp_extract(b, WORKTREE, 1) == base), "worktree")
    )
    found = way.groupBy("cwd").agg(F.first("direct").alias("direct"), F.min_by(alias, F.when(alias.isNotNull(), F.col("depth"))).alias("alias"))
    return found.select("cwd", F.coalesce("direct", "alias").alias("reason")).filter("reason IS NOT NULL")


def nearby(stats: DataFrame, included: DataFrame, target: str, exclude: list[str] = ()) -> DataFrame:
    """(cwd, reason): folders that ``resolve`` left out (``included`` is what it took) but a reader may want to add.

    parent: the root lies below it, at the third level or deeper, and it is no collection. similar: its name and the project's begin
    alike up to a dash; names of a role or of under four letters don't count. A project named after a role goes by parent and
    name. Only the very folders of ``exclude`` are left out, not those below. Paths come without a slash at their end.
    """
    root, parent, base = _target(stats.sparkSession, target)
    name = f"{parent}-{base}" if base in GENERIC else base
    cwd = fx.trim_slash(F.col("cwd"))
    rest = stats.select(cwd.alias("cwd")).distinct().join(included.select(cwd.alias("cwd")), "cwd", "left_anti")
    if exclude:
        rest = rest.filter(~F.col("cwd").isin(_trimmed(exclude)))
    counts = child_counts(stats).select(F.col("folder").alias("cwd"), "children")
    above = fx.is_under(F.lit(root), F.col("cwd"))
    depth = F.size(F.split("cwd", "/")) - 1
    own = fx.base_name(F.col("cwd"))
    alike = (own == name) | F.startswith(own, F.lit(f"{name}-")) | F.startswith(F.lit(name), F.concat(own, F.lit("-")))
    reason = (
        F.when(above & (depth >= 3) & (F.coalesce("children", F.lit(0)) < COLLECTION_CHILDREN), "parent")
        .when(~above & (F.length(own) >= 4) & ~own.isin(GENERIC) & alike, "similar")
    )
    return rest.join(counts, "cwd", "left").select("cwd", reason.alias("reason")).filter("reason IS NOT NULL")


def project_sessions(sessions: DataFrame, included: DataFrame, since: int | None = None, until: int | None = None, agents: bool = False) -> DataFrame:
    """(session_id, cwd, reason, begun, last, origin, hidden): a project's sessions that begin from ``since`` to before ``until``.

    ``sessions`` has session_id, cwd, start, last, raw_origin, origin; those of other folders, and empty ones, are left out. A session without
    a start begins with its last activity, and without both at zero. What ingest calls an agent's is ``hidden`` unless ``agents``,
    whatever was concluded about its creator since: it is counted, not shown.
    """
    begun = F.coalesce("start", "last", F.lit(0))
    rows = sessions.filter(F.col("origin").isNull() | (F.col("origin") != "empty")).withColumn("begun", begun)
    if since is not None:
        rows = rows.filter(F.col("begun") >= since)
    if until is not None:
        rows = rows.filter(F.col("begun") < until)
    hidden = F.lit(False) if agents else F.coalesce(F.col("raw_origin") == "agent", F.lit(False))
    return rows.join(included.select("cwd", "reason"), "cwd").select("session_id", "cwd", "reason", "begun", "last", "origin", hidden.alias("hidden"))


def project_dialogue(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """(session_id, ordinal, side, text): what is said in the sessions that ``project_sessions`` shows.

    ``turns`` (session_id, ordinal, side, text) is searchable dialogue. Of the user's side only a person's own words stay; turns
    that have none go.
    """
    text = F.when(F.col("side") == "user", human_text(F.col("text"))).otherwise(F.nullif(F.btrim("text", F.lit(fx.WHITE)), F.lit("")))
    shown = sessions.filter("NOT hidden").select("session_id")
    said = turns.join(shown, "session_id", "left_semi").select("session_id", "ordinal", "side", text.alias("text"))
    return said.filter("text IS NOT NULL")


def staleness(current: DataFrame, percent: float = 25.0) -> DataFrame:
    """Summaries whose dialogue grew by ``percent`` or more since; other bases don't go stale."""
    growth = (F.col("turns_now") - F.col("turns_then")) * 100.0 / F.greatest(F.col("turns_then"), F.lit(1))
    return current.withColumn("growth", growth).filter((F.col("basis") == "dialogue_turn_count_v1") & (growth >= percent))


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key..., change): added, removed, changed or kept."""
    b = before.select(*key, F.col(content).alias("__b"), F.lit(1).alias("__in_b"))
    a = after.select(*key, F.col(content).alias("__a"), F.lit(1).alias("__in_a"))
    change = (
        F.when(F.col("__in_b").isNull(), "added")
        .when(F.col("__in_a").isNull(), "removed")
        .when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
        .otherwise("kept")
    )
    return b.join(a, key, "full_outer").select(*key, change.alias("change"))
