"""Budgets: what fits in a prompt, a batch or an export."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.functions import text as fx


def head_tail(msgs: DataFrame, cap: int) -> DataFrame:
    """(session_id, part, tokens, turns): the first and last turns of a session within ``cap`` tokens.

    A session that fits is whole. Else half of the cap is filled from the front and
    the rest from the back; the middle is left out.
    """
    w = Window.partitionBy("session_id").orderBy("ordinal")
    total = F.sum("tokens").over(Window.partitionBy("session_id"))
    up = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = msgs.select("session_id", "ordinal", "tokens", total.alias("total"), up.alias("up"))
    down = F.col("total") - F.col("up") + F.col("tokens")
    half = cap // 2
    part = (
        F.when(F.col("total") <= cap, "whole")
        .when(F.col("up") <= half, "head")
        .when(down <= cap - half, "tail")
        .otherwise("omitted")
    )
    return rows.groupBy("session_id", part.alias("part")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("turns"))


#: Fixed value: what stands between the two ends of a turn that is cut in its middle.
MARKER = "\n[…middle omitted…]\n"


def _turn_tokens(side: Column, length: Column) -> Column:
    """Tokens of a turn of so many code points as it is shown, with its side before it."""
    return F.ceil((F.length(side) + 2 + length) / 4).cast("long")


def _room(side: Column, tokens: Column) -> Column:
    """Code points of text that fit in so many tokens, behind the side."""
    return F.greatest(F.lit(0), 4 * tokens - F.length(side) - 2).cast("int")


def capped_turns(turns: DataFrame, cap: int) -> DataFrame:
    """(session_id, ordinal, side, text, tokens, cut): turns of each session within ``cap`` tokens, the side's label counted.

    A session that fits is whole. Else half of the cap is filled from the front and the rest from the back; the turn at
    either end is cut, not dropped, and one that is cut at both ends keeps both with a marker between, or a line break where the marker doesn't
    fit. What the marker costs is taken from the last turn.
    """
    half = cap // 2
    up_to = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    own = _turn_tokens(F.col("side"), F.length("text"))
    rows = turns.select("session_id", "ordinal", "side", "text").withColumn("tokens", own)
    rows = rows.withColumns({"total": F.sum("tokens").over(Window.partitionBy("session_id")), "up": F.sum("tokens").over(up_to)})
    rows = rows.withColumn("down", F.col("total") - F.col("up") + F.col("tokens"))
    side, text, whole = F.col("side"), F.col("text"), F.col("total") <= cap
    front = _room(side, half - (F.col("up") - F.col("tokens")))
    back = _room(side, (cap - half) - (F.col("down") - F.col("tokens")))
    head = F.when(F.col("up") <= half, text).when(front > 0, F.substring(text, F.lit(1), front))
    tail = F.when(F.col("down") <= cap - half, text).when(back > 0, F.substring(text, F.length("text") - back + 1, back))
    kept = rows.withColumns({"head": head, "tail": tail}).filter(whole | F.col("head").isNotNull() | F.col("tail").isNotNull())
    fits = lambda t: _turn_tokens(side, F.length(t)) <= cap
    marked, broken = F.concat("head", F.lit(MARKER), "tail"), F.concat("head", F.lit("\n"), "tail")
    each = _room(side, F.lit(max(1, cap // 2)))
    ends = F.concat(F.substring(F.col("head"), F.lit(1), each), F.substring(F.col("tail"), F.greatest(F.lit(1), F.length("tail") - each + 1), each))
    merged = F.when(fits(marked), marked).when(fits(broken), broken).otherwise(ends)
    shown = F.when(whole, text).when(F.col("head").isNotNull() & F.col("tail").isNotNull(), merged).otherwise(F.coalesce("head", "tail"))
    made = kept.select("session_id", "ordinal", "side", "text", shown.alias("shown")).withColumn("n", _turn_tokens(side, F.length("shown")))
    after = Window.partitionBy("session_id").orderBy(F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, -1)
    over = F.sum("n").over(Window.partitionBy("session_id")) - cap - F.coalesce(F.sum("n").over(after), F.lit(0))
    made = made.withColumn("over", over)
    left = _room(side, F.col("n") - F.col("over"))
    last = F.when(F.col("over") <= 0, F.col("shown")).when(left > 0, F.substring(F.col("shown"), F.length("shown") - left + 1, left))
    done = made.withColumn("shown", last).filter(F.col("shown").isNotNull())
    return done.select("session_id", "ordinal", "side", F.col("shown").alias("text"), _turn_tokens(side, F.length("shown")).alias("tokens"), (F.col("shown") != F.col("text")).alias("cut"))


def omissions(turns: DataFrame, capped: DataFrame) -> DataFrame:
    """(session_id, turns, kept, cut, omitted, omitted_chars): what a cap left out of each session."""
    before = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))
    now = capped.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("kept"), F.count_if("cut").alias("cut"), F.sum(F.length(F.replace("text", F.lit(MARKER), F.lit("")))).alias("held")
    )
    none = F.lit(0).cast("long")
    both = before.join(now, "session_id", "left").select("session_id", "turns", *[F.coalesce(c, none).alias(c) for c in ("kept", "cut", "held")], "chars")
    return both.select("session_id", "turns", "kept", "cut", (F.col("turns") - F.col("kept")).alias("omitted"), (F.col("chars") - F.col("held")).alias("omitted_chars"))


def ranged(requests: DataFrame, key: str, width: int) -> DataFrame:
    """Adds ``shard``: the range of ``width`` values of a number that a request's falls in.

    No batch spans two ranges, so what a range's batches hold depends neither on other ranges nor on the size of the table.
    """
    return requests.withColumn("shard", F.floor(F.col(key) / width).cast("long"))


def pack_within(requests: DataFrame, shard: list[str], order: list[str], caps: dict[str, float]) -> DataFrame:
    """(shard..., order..., batch): requests dealt in order to batches; the sum of each column in ``caps`` stays within its cap.

    A request that is over a cap by itself is an error. The batch of a request depends on all before it in its shard, so
    shards must be of a size for one task; they are packed apart from each other.
    """
    names = [*shard, *order]
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    columns, most = list(caps), list(caps.values())

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        batch, empty = 0, True
        used = [0] * len(most)
        out = []
        for own in zip(*(rows[c] for c in columns), strict=True):
            if any(n > m for n, m in zip(own, most)):
                raise ValueError(f"a request exceeds an explicit cap of a batch: {dict(zip(columns, own))}")
            after = [u + n for u, n in zip(used, own)]
            if not empty and any(n > m for n, m in zip(after, most)):
                batch, after = batch + 1, list(own)
            used, empty = after, False
            out.append(batch)
        return rows.assign(batch=out)[[*names, "batch"]]

    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", batch int"
    return requests.select(*dict.fromkeys([*names, *columns])).groupBy(*shard).applyInPandas(deal, schema)


def pack(requests: DataFrame, shard: list[str], order: list[str], most_items: int, most_tokens: int) -> DataFrame:
    """``pack_within`` for a number of requests and their ``tokens``; a request of more tokens fills a batch by itself."""
    held = requests.withColumns({"__items": F.lit(1), "__tokens": F.least("tokens", F.lit(most_tokens))})
    return pack_within(held, shard, order, {"__items": most_items, "__tokens": most_tokens})


#: The caps of a batch: tokens and dollars, each for what goes in and what comes out, and dollars in all.
CAPS = ["input_tokens", "output_tokens", "input_dollars", "output_dollars", "total_dollars"]


def priced(requests: DataFrame, output_tokens: int, input_usd: float, output_usd: float) -> DataFrame:
    """Adds ``CAPS`` to requests with ``input_tokens``; prices are dollars for a million tokens, the sum has 8 places."""
    dollars = lambda tokens, usd: tokens.cast("double") * usd / 1_000_000
    out = F.lit(output_tokens).cast("long")
    both = requests.withColumns({"output_tokens": out, "input_dollars": dollars(F.col("input_tokens"), input_usd), "output_dollars": dollars(out, output_usd)})
    return both.withColumn("total_dollars", F.round(F.col("input_dollars") + F.col("output_dollars"), 8))


def request_ids(requests: DataFrame) -> DataFrame:
    """Adds ``dialogue_hash``, ``input_hash`` and ``custom_id`` to requests (harness, native_id, turns, prompt).

    Hashes are SHA-256 of JSON with sorted keys, so equal requests have equal names on every run.
    """
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    turns = F.to_json(F.transform("turns", lambda t: F.struct(t["ordinal"].alias("ordinal"), t["side"].alias("side"), t["text"].alias("text"))))
    key = F.concat(F.lit('{"harness":'), quoted(F.col("harness")), F.lit(',"nativeId":'), quoted(F.col("native_id")), F.lit("}"))
    named = requests.withColumn("dialogue_hash", F.sha2(F.concat(F.lit('{"turns":'), turns, F.lit("}")), 256))
    asked = F.concat(F.lit('{"dialogueHash":"'), F.col("dialogue_hash"), F.lit('","userPrompt":'), quoted(F.col("prompt")), F.lit("}"))
    named = named.withColumn("input_hash", F.sha2(asked, 256))
    name = F.sha2(F.concat(F.lit('{"inputHash":"'), F.col("input_hash"), F.lit('","sessionKey":'), key, F.lit("}")), 256)
    return named.withColumn("custom_id", F.concat(F.lit("batch-"), F.substring(name, 1, 32)))


def export_ladder(full: Column, short: Column, budget: int) -> Column:
    """full, short or over: the first form of an export whose tokens fit."""
    return F.when(full <= budget, "full").when(short <= budget, "short").otherwise("over")


def export_preview(summaries: DataFrame, favourites: DataFrame, budget: int) -> DataFrame:
    """Per scope: tokens with whole summaries, with two sentences each, without any, and what is chosen.

    Favourites are never cut; if they alone exceed the budget the export fails.
    """
    s = summaries.groupBy("scope").agg(
        F.sum(fx.estimate_tokens(F.col("text"))).alias("full"), F.sum(fx.estimate_tokens(fx.first_two_sentences(F.col("text")))).alias("short")
    )
    f = favourites.groupBy("scope").agg(F.sum(fx.estimate_tokens(F.col("text"))).alias("fixed"))
    both = s.join(f, "scope", "full_outer").fillna(0, ["full", "short", "fixed"])
    step = (
        F.when(F.col("full") + F.col("fixed") <= budget, "full")
        .when(F.col("short") + F.col("fixed") <= budget, "two_sentences")
        .when(F.col("fixed") <= budget, "drop_oldest")
        .otherwise("error")
    )
    return both.withColumn("step", step)


def drop_oldest(summaries: DataFrame, room: Column) -> DataFrame:
    """The newest summaries of each scope that fit in its ``room`` tokens."""
    newest = Window.partitionBy("scope").orderBy(F.col("at").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(fx.estimate_tokens(fx.first_two_sentences(F.col("text")))).over(newest)
    return summaries.withColumn("__used", used).filter(F.col("__used") <= room).drop("__used")
