"""Manifests of batches that can be resumed: requests and batches as tables, with results applied once.

``requests``: custom_id, batch, harness, native_id, input_hash, output_tokens (what is reserved), total_dollars, status (pending, applied or
failed), output_hash, output_text, updated. ``batches``: batch, status (planned, running, completed or failed), error, updated.
Every step takes both tables and gives both; nothing is changed in place. ``save`` writes them as one generation that is
published last, so a manifest that is read is whole whatever was lost while it was written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlake.operators import publish
from skeinlake.operators.graph import checkpoint

COLUMNS = ["custom_id", "batch", "harness", "native_id", "input_hash", "output_tokens", "total_dollars", "status", "output_hash", "output_text", "updated"]
Manifest = tuple[DataFrame, DataFrame]


def plan(requests: DataFrame, now: int) -> Manifest:
    """A manifest of packed requests, all pending. Requests of one name are one: the first in order of batch and input stays."""
    w = Window.partitionBy("custom_id").orderBy("batch", "input_hash", "harness", "native_id")
    once = requests.withColumn("__n", F.row_number().over(w)).filter("__n = 1 AND custom_id IS NOT NULL AND batch IS NOT NULL")
    none = F.lit(None).cast("string")
    rows = once.select(
        "custom_id", F.col("batch").cast("long").alias("batch"), "harness", "native_id", "input_hash", F.col("output_tokens").cast("long").alias("output_tokens"),
        F.col("total_dollars").cast("double").alias("total_dollars"), F.lit("pending").alias("status"), none.alias("output_hash"), none.alias("output_text"), F.lit(now).cast("long").alias("updated"),
    )
    batches = rows.select("batch").distinct().select("batch", F.lit("planned").alias("status"), none.alias("error"), F.lit(now).cast("long").alias("updated"))
    return rows, batches


def start(manifest: Manifest, batches: DataFrame, now: int) -> Manifest:
    """Marks the named batches (batch) running. Completed ones stay as they are; a failed one needs ``retry`` and is left alone."""
    rows, state = manifest
    return rows, _moved(state, batches, F.col("status").isin("planned", "running"), "running", now)


def fail(manifest: Manifest, failures: DataFrame, now: int) -> Manifest:
    """Marks batches failed: ``failures`` has (batch, custom_id, error), the id null where a batch failed as a whole.

    Requests that are applied keep their result. An error is wanted, and a request must belong to its batch: rows that break
    either rule are left out (``misplaced`` tells them). Of several errors of a batch the smallest is kept.
    """
    rows, state = manifest
    good = _told(rows, failures).filter("wrong IS NULL")
    hit = good.filter("custom_id IS NOT NULL").select("custom_id", F.lit(True).alias("__hit")).distinct()
    falls = F.coalesce("__hit", F.lit(False)) & (F.col("status") != "applied")
    rows = rows.join(hit, "custom_id", "left").withColumns({"status": F.when(falls, "failed").otherwise(F.col("status")), "updated": F.when(falls, F.lit(now)).otherwise(F.col("updated"))})
    errors = good.groupBy("batch").agg(F.min("error").alias("__error"))
    known = F.col("__error").isNotNull()
    state = state.join(errors, "batch", "left").select(
        "batch", F.when(known, "failed").otherwise(F.col("status")).alias("status"), F.coalesce("__error", "error").alias("error"),
        F.when(known, F.lit(now)).otherwise(F.col("updated")).cast("long").alias("updated"),
    )
    return rows.select(COLUMNS), state


def misplaced(manifest: Manifest, failures: DataFrame) -> DataFrame:
    """(batch, custom_id, error, wrong): failures that ``fail`` leaves out: no error, an unknown batch, no member of it."""
    return _told(manifest[0], failures).filter("wrong IS NOT NULL")


def _told(rows: DataFrame, failures: DataFrame) -> DataFrame:
    members = rows.select("custom_id", F.col("batch").alias("__own"))
    known = rows.select("batch", F.lit(True).alias("__known")).distinct()
    both = failures.select(F.col("batch").cast("long").alias("batch"), "custom_id", "error").join(members, "custom_id", "left").join(known, "batch", "left")
    wrong = (
        F.when(F.coalesce(F.trim("error"), F.lit("")) == "", "error")
        .when(F.col("__known").isNull(), "batch")
        .when(F.col("custom_id").isNotNull() & ~F.col("__own").eqNullSafe(F.col("batch")), "member")
    )
    return both.select("batch", "custom_id", "error", wrong.alias("wrong"))


def retry(manifest: Manifest, batches: DataFrame, now: int) -> Manifest:
    """Failed requests of the named batches (batch) that failed are pending again, and the batches run. Others stay."""
    rows, state = manifest
    named = batches.select(F.col("batch").cast("long").alias("batch")).distinct()
    back = state.filter("status = 'failed'").join(named, "batch", "left_semi").select("batch", F.lit(True).alias("__back"))
    again = F.coalesce("__back", F.lit(False)) & (F.col("status") == "failed")
    rows = rows.join(back, "batch", "left").withColumns({"status": F.when(again, "pending").otherwise(F.col("status")), "updated": F.when(again, F.lit(now)).otherwise(F.col("updated"))})
    state = _moved(state, named, F.col("status") == "failed", "running", now)
    return rows.select(COLUMNS), state


def _moved(state: DataFrame, batches: DataFrame, law: Column, to: str, now: int) -> DataFrame:
    named = batches.select(F.col("batch").cast("long").alias("batch"), F.lit(True).alias("__named")).distinct()
    goes = F.coalesce("__named", F.lit(False)) & law
    return state.join(named, "batch", "left").select(
        "batch", F.when(goes, to).otherwise(F.col("status")).alias("status"), F.when(~goes | (F.col("status") != "failed"), F.col("error")).alias("error"),
        F.when(goes, F.lit(now)).otherwise(F.col("updated")).cast("long").alias("updated"),
    )


def verdicts(manifest: Manifest, results: DataFrame, provider: str, model: str) -> DataFrame:
    """``results`` with their ``verdict``, and the ``batch`` that they belong to.

    ``results``: seq, custom_id, harness, native_id, provider, model, input_hash, output_tokens, output_text, output_hash. A result is judged by the
    first rule that it breaks: unknown (no such request), identity, provider, input, tokens (below zero or over what is reserved),
    output (its hash is not its text's). Of those that break none, the first of a request by ``seq`` (ties: by hash) is applied;
    later ones, and those of requests that are applied already, are a replay if they say the same, else a conflict.
    A request that failed takes a late result, too. Rows with the same ``seq`` and hash are one result.
    """
    own = manifest[0].select(
        "custom_id", "batch", F.col("harness").alias("__h"), F.col("native_id").alias("__n"), F.col("input_hash").alias("__i"), F.col("output_tokens").alias("__t"),
        F.when(F.col("status") == "applied", F.col("output_hash")).alias("__held"),
    )
    given = results.select("seq", "custom_id", "harness", "native_id", "provider", "model", "input_hash", "output_tokens", "output_text", "output_hash")
    both = given.join(own, "custom_id", "left")
    tokens = F.col("output_tokens")
    broken = (
        F.when(F.col("batch").isNull(), "unknown")
        .when(~(F.col("__h").eqNullSafe(F.col("harness")) & F.col("__n").eqNullSafe(F.col("native_id"))), "identity")
        .when(~(F.col("provider").eqNullSafe(F.lit(provider)) & F.col("model").eqNullSafe(F.lit(model))), "provider")
        .when(~F.col("__i").eqNullSafe(F.col("input_hash")), "input")
        .when(tokens.isNull() | (tokens < 0) | (tokens > F.col("__t")), "tokens")
        .when(~F.coalesce(F.sha2("output_text", 256) == F.col("output_hash"), F.lit(False)), "output")
    )
    judged = both.withColumn("__broken", broken)
    first = judged.filter("__broken IS NULL").groupBy("custom_id").agg(F.min(F.struct("seq", "output_hash")).alias("__first"))
    judged = judged.join(first, "custom_id", "left")
    here = F.struct("seq", "output_hash")
    verdict = (
        F.when(F.col("__broken").isNotNull(), F.col("__broken"))
        .when(F.col("__held").isNotNull(), F.when(F.col("__held") == F.col("output_hash"), "replay").otherwise("conflict"))
        .when(here == F.col("__first"), "applied")
        .when(F.col("output_hash") == F.col("__first.output_hash"), "replay")
        .otherwise("conflict")
    )
    return judged.select("seq", "custom_id", "batch", "output_tokens", "output_text", "output_hash", verdict.alias("verdict"))


def apply(manifest: Manifest, judged: DataFrame, now: int) -> Manifest:
    """Takes what ``verdicts`` applied. Applying the same results again changes nothing, times included.

    A batch with all its requests applied is completed, one that took a result runs.
    """
    rows, state = manifest
    # rows that are equal in sequence and text are one result
    taken = judged.filter("verdict = 'applied'").groupBy("custom_id").agg(F.first("output_hash").alias("__hash"), F.first("output_text").alias("__text"))
    new = F.col("__hash").isNotNull() & (F.col("status") != "applied")
    rows = rows.join(taken, "custom_id", "left").withColumn("__new", new)
    rows = rows.withColumns({
        "status": F.when(F.col("__new"), "applied").otherwise(F.col("status")), "output_hash": F.when(F.col("__new"), F.col("__hash")).otherwise(F.col("output_hash")),
        "output_text": F.when(F.col("__new"), F.col("__text")).otherwise(F.col("output_text")), "updated": F.when(F.col("__new"), F.lit(now)).otherwise(F.col("updated")),
    })
    per = rows.groupBy("batch").agg(F.bool_or("__new").alias("__took"), F.bool_and(F.col("status") == "applied").alias("__all"))
    took = F.coalesce("__took", F.lit(False))
    state = state.join(per, "batch", "left").select(
        "batch", F.when(took, F.when(F.col("__all"), "completed").otherwise("running")).otherwise(F.col("status")).alias("status"), "error",
        F.when(took, F.lit(now)).otherwise(F.col("updated")).cast("long").alias("updated"),
    )
    return rows.select(COLUMNS), state


def resume(manifest: Manifest) -> DataFrame:
    """(batch, status, error, requests, applied, failed, pending, dollars, tokens): what is left to do of each batch.

    ``dollars`` and ``tokens`` are those of requests that aren't applied.
    """
    rows, state = manifest
    left = F.col("status") != "applied"
    counts = rows.groupBy("batch").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~left).alias("applied"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "pending").alias("pending"),
        F.round(F.sum(F.when(left, F.col("total_dollars")).otherwise(0.0)), 8).alias("dollars"), F.sum(F.when(left, F.col("output_tokens")).otherwise(0)).alias("tokens"),
    )
    return state.select("batch", "status", "error").join(counts, "batch")


def state(manifest: Manifest) -> str:
    """planned, in_progress, failed or completed: of the manifest as a whole.

    Completed if all batches are (and there is one); failed while one is; planned before the first runs.
    """
    seen = {r["status"] for r in manifest[1].select("status").distinct().collect()}  # four kinds at most
    if "failed" in seen:
        return "failed"
    if seen == {"completed"}:
        return "completed"
    return "planned" if seen <= {"planned"} else "in_progress"


def save(manifest: Manifest, root: str) -> str:
    """Writes both tables as one generation and publishes it."""
    generation = f"g-{uuid.uuid4().hex}"
    for name, frame in zip(("requests", "batches"), manifest, strict=True):
        frame.write.parquet(f"{root}/{generation}/{name}")
    publish.point(manifest[0].sparkSession, root, generation)
    return generation


def load(spark: SparkSession, root: str) -> Manifest:
    """The manifest that was published last; later steps don't read what lies before it."""
    where = f"{root}/{publish.newest(spark, root)}"
    return spark.read.parquet(f"{where}/requests"), spark.read.parquet(f"{where}/batches")


def settle(manifest: Manifest) -> Manifest:
    """Cuts the lineage of both tables, for a long row of steps between two saves."""
    return checkpoint(manifest[0]), checkpoint(manifest[1])
