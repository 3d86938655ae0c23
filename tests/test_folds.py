"""Queries that SQL can't say, against plain Python over the whole table."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skeinlake import plans
from skeinlake.functions import text as fx
from skeinlake.operators import search, topics
from skeinlake.plans.q_sessions import msgs
from skeinlake.plans.q_text import long_sessions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def unit(spark):
    return topics.units(long_sessions(msgs(spark, SF))).cache()


def cut(n, scores):
    """Strongest first, three units from every cut and from both ends, 40 at most."""
    cuts = {0, n}
    for at, score in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
        if score >= 3 and len(cuts) <= topics.MAX_EPISODES and all(abs(at - c) >= 3 for c in cuts):
            cuts.add(at)
    ends = sorted(cuts)
    return [(i, a, b - 1) for i, (a, b) in enumerate(zip(ends, ends[1:]))]


def test_greedy_segments(spark, unit):
    scores = topics.boundary_scores(unit, gap_ms=F.when(F.col("unit") % 3 == 0, 3_600_000).otherwise(0))
    held = defaultdict(dict)
    for r in scores.collect():
        held[r.session_id][r.unit] = r.score
    want = {r.session_id: cut(r.n, held[r.session_id]) for r in unit.groupBy("session_id").agg(F.count("*").alias("n")).collect()}
    got = defaultdict(list)
    for r in plans.queries()["greedy_segments"](spark, SF).orderBy("session_id", "episode").collect():
        got[r.session_id].append((r.episode, r.first_unit, r.last_unit))
    assert got == want and any(len(v) > 1 for v in want.values())


def test_episode_keywords(spark, unit):
    stop = set(fx.STOPWORDS)
    words = lambda t: [w for w in re.findall("[a-z][a-z0-9_-]{2,24}", t.lower()) if w not in stop]
    rows = unit.collect()
    df = Counter(w for r in rows for w in set(words(r.context)))
    scores = defaultdict(dict)
    for r in topics.boundary_scores(unit).collect():
        scores[r.session_id][r.unit] = r.score
    sizes = Counter(r.session_id for r in rows)
    want, weights = {}, {}
    for s, n in sizes.items():
        for e, a, b in cut(n, scores[s]):
            tf = Counter(w for r in rows if r.session_id == s and a <= r.unit <= b for w in words(r.human) * 2 + words(r.context))
            weight = {w: (1 + math.log(c)) * math.log((len(rows) + 1) / (df[w] + 1)) for w, c in tf.items() if df[w] <= len(rows) * 0.2}
            weights[s, e] = weight
            for i, w in enumerate(sorted(weight, key=lambda w: (-round(weight[w], 9), w))[:4]):
                want[s, e, i + 1] = round(weight[w], 6)
    found = plans.queries()["episode_keywords"](spark, SF).collect()
    got = {(r.session_id, r.episode, r["rank"]): round(weights[r.session_id, r.episode][r.word], 6) for r in found}
    assert got == want and len(want) > 8


def test_snippet_windows(spark):
    got = defaultdict(list)
    for r in plans.queries()["snippet_windows"](spark, SF).orderBy("session_id", "ordinal", "n").collect():
        got[r.session_id, r.ordinal].append((r.start, r.end, r.snippet))
    want = {}
    for r in search.documents(msgs(spark, SF)).collect():
        groups = []
        for m in re.finditer("the of|with", r.text, re.I):
            if groups and m.end() - groups[-1][0] <= 180:
                groups[-1][1] = m.end()
            else:
                groups.append([m.start(), m.end()])
        shown = []
        for a, b in groups:
            low, high = max(0, a - 56), min(len(r.text), b + 80)
            shown.append((a, b, ("…" if low else "") + r.text[low:high] + ("…" if high < len(r.text) else "")))
        if shown:
            want[r.session_id, r.ordinal] = shown
    assert got == want and len(want) > 5


def test_project_lineage_takes_the_whole_project(spark):
    """The target lies in a worktree of the most frequent host's folder; folders by that name are found, others aren't."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    host = lambda u: re.match("[a-z]+://([^/?#]+)", u)[1].replace(".", "-")
    rest = lambda u: re.match("[a-z]+://[^/?#]+/?([^?#]*)", u)[1]
    names = Counter(host(p.url) for p in pages)
    most = min(names, key=lambda n: (-names[n], n))
    folder = {0: lambda n, i: n + "/src", 1: lambda n, i: n + "-wt-x", 2: lambda n, i: "code-" + n, 3: lambda n, i: n + "/" + i}
    want = {}
    for p in pages:
        n, i = host(p.url), rest(p.url)
        k = len(i) % 4
        path = "/home/u/code/" + folder[k](n, i)
        if n == most:
            want[path.rstrip("/")] = {0: "inside", 1: "worktree", 2: "renamed", 3: "inside" if i else "exact"}[k]
    got = {r.cwd.rstrip("/"): r.reason for r in plans.queries()["project_lineage"](spark, SF).collect()}
    assert got == want
