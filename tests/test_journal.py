"""Decisions and their undoing against a plain fold, merges of tags and taking them back."""

import random

import pytest

from skeinlake.operators import journal


def plain(log):
    """Decisions one after the other, as a service would take them."""
    now, entries, out = {}, {}, []
    for kind, target, seq, name, action, value, of in sorted(log, key=lambda r: r[2]):
        key, why = (kind, target), None
        before = now.get(key)
        after = value
        if action == "undo":
            e = entries.get((key, of))
            if e is None or e["undone"]:
                why = "undo unavailable"
            elif e["is_undo"]:
                why = "event cannot be undone"
            elif e["after"] != before:
                why = "newer user decision exists"
            else:
                after = e["before"]
        if why is None:
            if action == "undo":
                entries[key, of]["undone"] = True
            entries[key, name] = {"before": before, "after": after, "undone": False, "is_undo": action == "undo"}
            now[key] = after
        out.append((kind, target, seq, name, why, before, before if why else after))
    return sorted(out, key=lambda r: (r[0], r[1], r[2])), {k: v for k, v in now.items() if v is not None}


def test_fold_like_a_service(spark):
    rng = random.Random(5)
    log = []
    for seq in range(400):
        kind, target = rng.choice(["favorite", "classification"]), f"s{rng.randrange(9)}"
        earlier = [r[3] for r in log if r[:2] == (kind, target)]
        if earlier and rng.random() < 0.5:
            log.append((kind, target, seq, f"e{seq}", "undo", None, rng.choice([*earlier[-3:], "nothing"])))
        else:
            log.append((kind, target, seq, f"e{seq}", "set", rng.choice(["a", "b", None]), None))
    frame = spark.createDataFrame(log, "kind string, target string, seq long, id string, action string, value string, of string").repartition(3)
    folded = journal.fold(frame)
    want, standing = plain(log)
    assert sorted((tuple(r) for r in folded.collect()), key=lambda r: (r[0], r[1], r[2])) == want
    assert {r[4] for r in want} == {None, "undo unavailable", "event cannot be undone", "newer user decision exists"}
    assert {(r.kind, r.target): r.value for r in journal.standing(folded).collect()} == standing


def state(spark):
    return journal.Tags(
        spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4)], "name string, promoted_at long"),
        spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "d")], "session_id long, tag string"),
        spark.createDataFrame([("b", 7), ("a", 7), ("c", 8)], "name string, session_id long"),
        spark.createDataFrame([("a", "x"), ("d", "y")], "tag string, body string"),
    )


def content(s, syntheses=True):
    frames = [s.tags.select("name", "promoted_at"), s.links.select("session_id", "tag"), s.candidates.select("name", "session_id")] + [s.syntheses.select("tag", "body")] * syntheses
    return [sorted((tuple(r) for r in f.collect()), key=repr) for f in frames]


def merges(spark, *rows):
    return spark.createDataFrame(rows, "event long, into string, sources array<string>")


def test_merge_and_exact_undo(spark):
    first = state(spark)
    made, log = journal.consolidate(first, merges(spark, (1, "a", ["b", "c", "b", "a"])))
    assert content(made) == [[("a", 1), ("d", 4)], [(1, "a"), (2, "a"), (3, "a"), (4, "d")], [("a", 7), ("a", 8)], [("d", "y")]]
    back, after = journal.undo(made, log, 1)
    assert content(back, False) == content(first, False) and content(back)[3] == [("d", "y")]
    with pytest.raises(ValueError, match="unavailable"):
        journal.undo(back, after, 1)


def test_newer_merge_blocks_an_undo(spark):
    one, log1 = journal.consolidate(state(spark), merges(spark, (1, "a", ["b"])))
    two, log2 = journal.consolidate(one, merges(spark, (2, "d", ["a"])))
    log = journal.Journal(log1.events.unionByName(log2.events), log1.rows.unionByName(log2.rows))
    with pytest.raises(ValueError, match="newer"):
        journal.undo(two, log, 1)
    back, log = journal.undo(two, log, 2)
    assert content(back, False) == content(one, False)
    assert content(journal.undo(back, log, 1)[0], False) == content(state(spark), False)
    assert [(r.event, r.reverted) for r in journal.history(log).orderBy("position").collect()] == [(2, True), (1, False)]


def test_only_safe_proposals_are_applied(spark):
    asked = merges(spark, (1, "a", ["a"]), (2, "a", ["nowhere"]), (3, "nowhere", ["a"]), (4, "b", ["c", "c"]), (5, "c", ["d"]), (6, "d", []), (7, "d", ["a", "d"]))
    got = journal.safe_proposals(asked, state(spark).tags)
    assert sorted((r.event, r.into, r.sources) for r in got.collect()) == [(4, "b", ["c"]), (7, "d", ["a"])]
    none, log = journal.consolidate(state(spark), asked.limit(0))
    assert content(none) == content(state(spark)) and log.events.count() == 0
