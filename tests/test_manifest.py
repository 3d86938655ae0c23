"""Manifests against a plain walk through the results, one by one."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skeinlake.operators import manifest

REQUESTS = "custom_id string, batch long, harness string, native_id string, input_hash string, output_tokens long, total_dollars double"
RESULTS = "seq long, custom_id string, harness string, native_id string, provider string, model string, input_hash string, output_tokens long, output_text string, output_hash string"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def planned(spark, n=60, per=6):
    rows = [(f"b{i}", i // per, "claude", f"n{i}", f"h{i}", 50, 0.25) for i in range(n)]
    return manifest.settle(manifest.plan(spark.createDataFrame(rows, REQUESTS), now=1))


def result(i, seq=0, text="ok", **other):
    row = dict(seq=seq, custom_id=f"b{i}", harness="claude", native_id=f"n{i}", provider="p", model="m", input_hash=f"h{i}", output_tokens=5, output_text=text, output_hash=sha(text))
    return tuple((row | other).values())


def walk(held, results):
    """What becomes of each result if they come one after another; ``held`` maps requests to the hash of what they hold."""
    out = {}
    for r in sorted(results, key=lambda r: (r[0], r[9] or "")):
        seq, cid, harness, native, provider, model, given, tokens, text, digest = r
        i = cid[1:]
        if not (cid.startswith("b") and i.isdigit() and int(i) < 60):
            v = "unknown"
        elif (harness, native) != ("claude", f"n{i}"):
            v = "identity"
        elif (provider, model) != ("p", "m"):
            v = "provider"
        elif given != f"h{i}":
            v = "input"
        elif tokens is None or not 0 <= tokens <= 50:
            v = "tokens"
        elif text is None or sha(text) != digest:
            v = "output"
        elif cid in held:
            v = "replay" if held[cid] == digest else "conflict"
        else:
            held[cid], v = digest, "applied"
        out[seq] = v
    return out


def test_results_like_a_walk(spark):
    rng = random.Random(5)
    m, held = planned(spark), {}
    for delivery in range(3):
        wrong = [{}, {}, {}, {"native_id": "z"}, {"native_id": None}, {"provider": None}, {"model": "q"}, {"input_hash": None}, {"output_tokens": 51}, {"output_tokens": -1}, {"output_tokens": None}, {"output_hash": "0"}, {"output_hash": None}, {"output_text": None}, {"custom_id": "b99"}]
        results = [result(rng.choice([3, rng.randrange(60)]), seq, rng.choice(["a", "b"]), **rng.choice(wrong)) for seq in range(90)]
        judged = manifest.verdicts(m, spark.createDataFrame(results, RESULTS).withColumn("verdict", F.lit("a column of theirs")), "p", "m")
        assert {r.seq: r.verdict for r in judged.collect()} == walk(held, results)
        m = manifest.settle(manifest.apply(m, judged, now=10 + delivery))
        assert {r.custom_id: r.output_hash for r in m[0].filter("status = 'applied'").collect()} == held
    assert 10 < len(held) < 60 and m[0].count() == 60


def test_replays_change_nothing(spark):
    results = spark.createDataFrame([result(i) for i in range(8)] + [result(7)], RESULTS)
    m = planned(spark)
    m = manifest.settle(manifest.apply(m, manifest.verdicts(m, results, "p", "m"), now=5))
    again = manifest.apply(m, manifest.verdicts(m, results, "p", "m"), now=9)
    for a, b in zip(m, again):
        assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    assert {(r.batch, r.status) for r in m[1].filter("batch < 3").collect()} == {(0, "completed"), (1, "running"), (2, "planned")}
    nothing = manifest.apply(m, manifest.verdicts(m, results.limit(0), "p", "m"), now=9)
    assert {tuple(r) for r in nothing[0].collect()} == {tuple(r) for r in m[0].collect()}


def test_failures_and_retries(spark):
    m = planned(spark, 18)
    m = manifest.apply(m, manifest.verdicts(m, spark.createDataFrame([result(0)], RESULTS), "p", "m"), now=2)
    failures = spark.createDataFrame(
        [(0, "b0", "late"), (0, "b1", "late"), (1, None, "down"), (1, None, "away"), (2, "b1", "x"), (2, "b13", " "), (9, None, "x"), (2, "none", "x")], "batch long, custom_id string, error string"
    )
    assert {(r.batch, r.custom_id, r.wrong) for r in manifest.misplaced(m, failures).collect()} == {(2, "b1", "member"), (2, "b13", "error"), (9, None, "batch"), (2, "none", "member")}
    m = manifest.settle(manifest.fail(m, failures, now=3))
    told = {r.batch: r for r in manifest.resume(m).collect()}
    assert [(told[b].status, told[b].error, told[b].applied, told[b].failed, told[b].pending, told[b].dollars) for b in range(3)] == [
        ("failed", "late", 1, 1, 4, 1.25), ("failed", "away", 0, 0, 6, 1.5), ("planned", None, 0, 0, 6, 1.5),
    ]
    assert manifest.state(m) == "failed"
    # a failed batch isn't started again by starting it, only by a retry
    named = spark.createDataFrame([(0,), (2,), (77,)], "batch long")
    m = manifest.settle(manifest.start(m, named, now=4))
    assert {r.batch: r.status for r in m[1].collect()} == {0: "failed", 1: "failed", 2: "running"}
    m = manifest.settle(manifest.retry(m, named, now=5))
    told = {r.batch: r for r in manifest.resume(m).collect()}
    assert [(told[b].status, told[b].error, told[b].failed, told[b].pending) for b in range(3)] == [("running", None, 0, 5), ("failed", "away", 0, 6), ("running", None, 0, 6)]
    # results that come late complete a failed batch
    m = manifest.apply(m, manifest.verdicts(m, spark.createDataFrame([result(i) for i in range(18)], RESULTS), "p", "m"), now=6)
    assert manifest.state(manifest.settle(m)) == "completed"


def test_saved_whole_and_last_counts(spark, tmp_path):
    root = f"file://{tmp_path}/m"
    m = planned(spark, 12)
    manifest.save(m, root)
    manifest.save(manifest.start(m, m[1].select("batch"), now=7), root)
    # a generation that nothing points to, as a lost driver leaves it
    m[0].limit(1).write.parquet(f"{root}/g-lost/requests")
    requests, batches = manifest.load(spark, root)
    assert requests.count() == 12 and {(r.status, r.updated) for r in batches.collect()} == {("running", 7)}
    assert manifest.state((requests, batches)) == "in_progress"


def test_equal_names_nulls_and_empty_tables(spark):
    rows = [("a", 1, "h", "n", "i", 5, 0.1), ("a", 0, "h", "n", "i", 5, 0.1), (None, 0, "h", "n", "i", 5, 0.1), ("c", None, "h", "n", "i", 5, 0.1), ("d", 0, None, None, None, None, None)]
    m = manifest.plan(spark.createDataFrame(rows, REQUESTS).withColumn("status", F.lit("of theirs")), now=1)
    assert {(r.custom_id, r.batch, r.status) for r in m[0].collect()} == {("a", 0, "pending"), ("d", 0, "pending")}
    (left,) = manifest.resume(m).collect()
    assert (left.requests, left.pending, left.dollars) == (2, 2, pytest.approx(0.1))
    empty = manifest.plan(spark.createDataFrame([], REQUESTS), now=1)
    assert manifest.resume(empty).count() == 0 and manifest.state(empty) == "planned"
