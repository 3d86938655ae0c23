"""Caps of dialogues and of batches against plain folds."""

import random

import pytest

from skeinlake.operators import packing

MARKER = "\n[…middle omitted…]\n"


def tokens(side, text):
    return -(-len(f"{side}: {text}") // 4)


def fit(side, text, budget, front):
    n = max(0, min(len(text), 4 * budget - len(side) - 2))
    return text[:n] if front else text[len(text) - n :] if n else ""


def plain_cap(turns, cap):
    if sum(tokens(s, t) for _, s, t in turns) <= cap:
        return turns
    half, kept = cap // 2, {}
    for front, budget, walk in ((True, half, turns), (False, cap - half, turns[::-1])):
        for o, s, t in walk:
            if budget <= 0:
                break
            n = tokens(s, t)
            piece = t if n <= budget else fit(s, t, budget, front)
            if n <= budget or piece:
                kept.setdefault(o, (s, []))[1].append(piece)
            budget -= n
    out = []
    for o, (s, pieces) in sorted(kept.items()):
        if len(pieces) == 1:
            out.append((o, s, pieces[0]))
            continue
        tries = [MARKER.join(pieces), "\n".join(pieces)]
        merged = next((x for x in tries if tokens(s, x) <= cap), fit(s, pieces[0], cap // 2, True) + fit(s, pieces[1], cap // 2, False))
        out.append((o, s, merged))
    while out and (over := sum(tokens(s, t) for _, s, t in out) - cap) > 0:
        o, s, t = out.pop()
        left = fit(s, t, max(1, tokens(s, t) - over), False)
        if left and left != t:
            out.append((o, s, left))
    return out


def test_capped_turns_like_a_fold(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    sessions = {k: [(i, rng.choice(["user", "assistant"]), text(rng.choice([0, 3, 40, 200]))) for i in range(rng.randrange(1, 9))] for k in range(120)}
    sessions[500] = [(0, "user", "x" * 1000)]
    sessions[501] = [(0, "user", "a" * 90), (1, "assistant", "b" * 800), (2, "user", "c" * 90)]
    frame = spark.createDataFrame([(k, *t) for k, turns in sessions.items() for t in turns], "session_id long, ordinal long, side string, text string")
    for cap in (1, 2, 13, 60, 61, 100):
        capped = packing.capped_turns(frame, cap)
        got, spent = {}, {}
        for r in capped.orderBy("session_id", "ordinal").collect():
            got.setdefault(r.session_id, []).append((r.ordinal, r.side, r.text))
            assert r.tokens == tokens(r.side, r.text)
            spent[r.session_id] = spent.get(r.session_id, 0) + r.tokens
        assert got == {k: w for k, turns in sessions.items() if (w := plain_cap(turns, cap))}
        assert max(spent.values(), default=0) <= cap
    assert any(MARKER in t for turns in got.values() for _, _, t in turns)
    told = {r.session_id: r for r in packing.omissions(frame, capped).collect()}
    assert (told[501].turns, told[501].kept + told[501].omitted) == (3, 3) and told[500].omitted_chars > 500


def test_batches_within_all_caps(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(1, 900)) for i in range(700)]
    priced = packing.priced(packing.ranged(spark.createDataFrame(rows, "id long, input_tokens long"), "id", 250), 200, 3.0, 15.0)
    caps = dict(zip(packing.CAPS, (4000, 2000, 0.011, 0.025, 0.03)))
    got = {r.id: (r.shard, r.batch) for r in packing.pack_within(priced.repartition(7), ["shard"], ["id"], caps).collect()}
    want, used, last = {}, None, None
    for r in sorted(priced.collect(), key=lambda r: r.id):
        own = [r[c] for c in packing.CAPS]
        if r.shard != last:
            batch, used, last = 0, [0] * 5, r.shard
        after = [u + n for u, n in zip(used, own)]
        if any(n > m for n, m in zip(after, caps.values())) and any(used):
            batch, after = batch + 1, own
        used = after
        want[r.id] = r.shard, batch
    assert got == want
    # a range's batches are the same whatever else the table holds
    some = {r.id: (r.shard, r.batch) for r in packing.pack_within(priced.filter("id < 250"), ["shard"], ["id"], caps).collect()}
    assert some == {k: v for k, v in got.items() if k < 250}
    with pytest.raises(Exception, match="explicit cap"):
        packing.pack_within(priced, ["shard"], ["id"], {"input_tokens": 10}).collect()


def test_request_names_are_stable(spark):
    rows = [("claude", "n", [(0, "user", 'a "b"')], "p"), ("claude", "n", [(0, "user", 'a "b"')], "p"), ("claude", "m", [(0, "user", 'a "b"')], "p"), ("claude", "n", [(0, "user", "a")], "p")]
    frame = spark.createDataFrame(rows, "harness string, native_id string, turns array<struct<ordinal:int,side:string,text:string>>, prompt string")
    a, b, c, d = packing.request_ids(frame).collect()
    assert a.custom_id == b.custom_id and len({a.custom_id, c.custom_id, d.custom_id}) == 3 and a.dialogue_hash == c.dialogue_hash != d.dialogue_hash
