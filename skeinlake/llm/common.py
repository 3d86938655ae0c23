"""What several operators share: scratch storage, size checks, gapless ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlake.shipping import ship

__all__ = ["gapless_rank", "hex52", "lowest_by_hash", "materialise", "most_frequent", "partitions", "range_bounds", "range_of", "scratch_dir", "ship", "small_side", "table"]

def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own if unset in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-skeinlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    This cuts the lineage, survives the loss of executors, lets later readers
    prune columns and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int, tag: str) -> tuple[DataFrame, int]:
    """``df`` materialised, with a broadcast hint if it has ``max_rows`` rows at most.

    Beyond that the hint is left out and Spark shuffles both sides of the join.
    """
    kept = materialise(df, tag)
    rows = kept.count()
    return (F.broadcast(kept) if rows <= max_rows else kept), rows


def partitions(size: int, per_task: int, spark: SparkSession) -> int:
    """Partitions for so many rows or bytes, the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per_task))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowest_by_hash(df: DataFrame, cols: list[str], rows: int, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest hash of ``cols``, of a frame of ``rows`` rows.

    The hash first thins the rows to about twice as many as are wanted, so that no
    task hands on ``limit`` rows of its own however many tasks there are.
    """
    buckets = 1 << 30
    kept = min(buckets, (2 * limit + 100) * buckets // max(1, rows))
    thin = df.filter(F.pmod(F.xxhash64(*cols), F.lit(buckets)) < kept)
    return thin.orderBy(F.pmod(F.xxhash64(*cols), F.lit(buckets)), *cols).limit(limit)


def most_frequent(counts: DataFrame, col: str, limit: int) -> DataFrame:
    """The rows whose ``col``, a positive count, is so high that ``limit`` rows at most are as high.

    A histogram over sixteenths of powers of two finds the cut, so only rows above
    it leave their tasks. Equal counts stay together, unless more than ``limit`` rows have the
    highest ones; then those with the smallest hash are taken.
    """
    step = F.floor(F.log2(col) * 16).cast("int")
    found = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    cut, held = None, 0
    for row in sorted(found, key=lambda r: -r.step):
        held += row.n
        if held > limit:
            break
        cut = row.step
    if cut is None and found:
        highest = max(r.step for r in found)
        rest = [c for c in counts.columns if c != col]
        return counts.filter(step == highest).orderBy(F.col(col).desc(), F.xxhash64(*rest), *rest).limit(limit)
    return counts.limit(0) if cut is None else counts.filter(step >= cut)


def hex52(*parts: Column | str) -> Column:
    """A uniform number in [0, 2^52) from the MD5 of the joined parts.

    MD5 rather than Spark's own hash, so that other engines can repeat it.
    """
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13), 16, 10).cast("long")


def range_bounds(df: DataFrame, col: str, ranges: int) -> list:
    """Ascending cut points that deal the values of ``col`` into about equal ranges."""
    cuts = [i / ranges for i in range(1, ranges)]
    row = df.agg(F.percentile_approx(col, cuts, 20 * ranges).alias("q")).first()
    return sorted(set(row.q or []))


def range_of(col: Column, bounds: Sequence) -> Column:
    """Index of the range that a value falls in; nulls fall in range 0."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b) for b in bounds])
    return F.coalesce(F.size(F.filter(cuts, lambda b: b < col)), F.lit(0))


def gapless_rank(
    df: DataFrame,
    name: str,
    group: list[str],
    range_col: str,
    order: list[Column],
) -> DataFrame:
    """Add ``name``: positions 0, 1, 2 ... of the rows of each group.

    ``range_col`` must rise with ``order``. Rows are ranked inside
    (group, range), and each range starts where the counts of the ranges before
    it end, so no task gets a whole group. ``range_col`` is dropped.
    """
    counts = df.groupBy(*group, range_col).agg(F.count(F.lit(1)).alias("__n"))
    before = (
        Window.partitionBy(*[F.col(g) for g in group])
        .orderBy(range_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col(range_col).alias("__r"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy(*group, range_col).orderBy(*order)
    on = F.col(range_col) == F.col("__r")
    for i, g in enumerate(group):
        on = on & (F.col(g) == F.col(f"__g{i}"))
    ranked = df.join(offsets, on).withColumn(
        name, F.row_number().over(inside).cast("long") - 1 + F.col("__before")
    )
    return ranked.drop("__r", "__before", range_col, *[f"__g{i}" for i in range(len(group))])
