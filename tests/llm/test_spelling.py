"""Spelling variants against brute force, and on odd input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlake.llm import queries, spelling
from tests.oracle import assert_same, connect

DOCS = "doc_id bigint, text string"


def brute_words(data):
    found = Counter()
    for d, t in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    rows, form = [], {}
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(rows, key=lambda r: r[0])


def got(frame):
    return sorted((tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def random_words(rng, n, letters="abcé", most=9):
    return ["".join(rng.choice(list(letters), rng.integers(4, most + 1))) for _ in range(n)]


@pytest.mark.parametrize(("block", "hot", "tile"), [(2048, 8192, 512), (7, 8192, 3), (5, 4, 2), (1, 1, 1)])
def test_variants_like_brute_force(spark, monkeypatch, block, hot, tile):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "TILE", tile)
    rng = np.random.default_rng(block)
    counts = {w: int(3 * 2.0 ** rng.integers(0, 8)) for w in random_words(rng, 900) if len(w) >= 5}
    want = brute(counts)
    assert any(r[1] != r[2] for r in want if r[1])
    # settings reach the workers with the function, which is sent by name: so search here, on one task's rows
    vocabulary = spark.createDataFrame(sorted(counts.items()), "word string, n bigint")
    rows = spelling.dealt(vocabulary).orderBy("s", "side", "key", "part", "asks").toArrow()
    found = {}
    for batch in spelling._search(iter(rows.to_batches(max_chunksize=37))):
        for r in batch.to_pylist():
            n, best = found.get(r["word"], (0, (0, "")))
            mine = (-r["best_n"], r["best"])
            found[r["word"]] = n + r["n_near"], min(best, mine) if n else mine
    assert {w: n for w, (n, _) in found.items()} == {r[0]: r[4] for r in want if r[4]}
    assert {w: b for w, (_, (m, b)) in found.items() if -m >= 2 * counts[w]} == {r[0]: r[1] for r in want if r[1]}


def test_query_like_brute_force_on_texts(spark):
    data = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute(brute_words(data))
    assert got(spelling.variants(frame)) == want and sum(r[1] is not None for r in want) > 5


def test_words_on_odd_input(spark):
    long = "x" * 3000
    data = [(None, "Straße Straße straße STRAßE École école ÉCOLE"), (1, None), (2, ""), (3, "12 _ - \u0000"), (3, "a×b÷c " * 3), (3, "ĀbcdefĀ abcdef abcdef"), (4, f"{long} " * 3), (4, f"{long}y " * 4), (5, "naïveté " * 9), (5, "naïveté " * 9)]
    data += [(None, "Straße"), (6, "abcdefg " * 7), (7, "bcdefg " * 6), (8, "abcdef abdef abdef abdef")]
    frame = spark.createDataFrame(data, DOCS).withColumns({c: F.lit(1) for c in ("word", "n", "run", "of", "form")})
    want = brute(brute_words(data))
    assert got(spelling.variants(frame)) == want
    assert any(r[0] == long and r[4] == 1 for r in want)
    assert spelling.variants(frame.limit(0)).count() == 0


def test_equal_words_are_not_near_and_ends_shift():
    words = ["abcde", "bcde", "abcd", "acde", "abcdef", "xabcde", "abxcde", "abcdx", "aabcde", "abcdee", "edcba"]
    unit = lambda w, s, side: spelling._unit(w, s, side, 0)
    found = set()
    for s in (4, 5, 6):
        for side in (0, 1):
            some = [w for w in words if len(w) in (s, s + 1)]
            index = spelling.Index(some, [1] * len(some), [unit(w, s, side) for w in some])
            for w, _, _, _ in spelling._answers(index, [(w, unit(w, s, side)) for w in some]):
                bits = index.near([w], [unit(w, s, side)])[0]
                found |= {(w, index.words[k]) for k in range(len(some)) if int(bits[k // 64]) >> (k % 64) & 1}
    assert found == {(a, b) for a in words for b in words if is_near(a, b)}


def test_hot_beginning_is_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HOT", 50)
    words = [(f"same{a}{b}xyz", 3 + (a == b)) for a in "abcdefghijklmno" for b in "abcdefghijklmno"]
    rows = spelling.dealt(spark.createDataFrame(words, "word string, n bigint"))
    parts = rows.filter("held").groupBy("key", "part").count().agg(F.max("count")).first()[0]
    assert parts < 100 < len(words)
    assert rows.filter("held").count() == 4 * len(words)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_like_its_statement(spark, sf):
    name = "op13_spelling_variants"
    assert_same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])
