"""Writing results: generations behind a pointer, keyed upserts, rendered lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def publish(frame: DataFrame, root: str, broken: DataFrame | None = None) -> str:
    """Write a new generation under ``root`` and point readers to it, last of all.

    Readers see the old generation or the new one, never a part. If ``broken`` has
    rows, nothing is published.
    """
    if broken is not None and not broken.isEmpty():
        raise ValueError(f"not published: {broken.count()} rows break the rules, such as {broken.first()}")
    generation = f"g-{uuid.uuid4().hex}"
    frame.write.parquet(f"{root}/{generation}")
    point(frame.sparkSession, root, generation)
    return generation


def point(spark: SparkSession, root: str, generation: str) -> None:
    """Point readers to a generation that is written. Append-only: every publish adds a row, the newest one counts."""
    pointer = spark.createDataFrame([(generation,)], "generation string").withColumn("at", F.current_timestamp())
    pointer.write.mode("append").parquet(f"{root}/_pointer")


def newest(spark: SparkSession, root: str) -> str:
    """The name of the generation that readers see."""
    return spark.read.parquet(f"{root}/_pointer").orderBy(F.col("at").desc()).first()["generation"]


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest published generation."""
    return spark.read.parquet(f"{root}/{newest(spark, root)}")


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: Column) -> DataFrame:
    """Rows of both, of each key the one with the highest version."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(version.desc()))
    return old.unionByName(new).withColumn("__p", place).filter("__p = 1").drop("__p")


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def orphans(known: DataFrame, walked: DataFrame, key: list[str], complete: bool) -> DataFrame:
    """Known rows that a walk didn't find; none unless the walk was complete."""
    missing = known.join(walked.select(*key).distinct(), key, "left_anti")
    return missing if complete else missing.limit(0)


def batch_lines(requests: DataFrame, shape: str) -> DataFrame:
    """One JSON line per request, in the wire shape 'messages' or 'chat'; identifiers are hashes of what is sent."""
    digest = F.sha2(F.to_json(F.struct("model", "prompt")), 256)
    custom = F.concat(F.lit("r-"), F.substring(digest, 1, 32))
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    if shape == "messages":
        body = F.struct(custom.alias("custom_id"), F.struct("model", F.col("most_tokens").alias("max_tokens"), message.alias("messages")).alias("params"))
    elif shape == "chat":
        request = F.struct("model", F.col("most_tokens").alias("max_completion_tokens"), message.alias("messages"))
        body = F.struct(custom.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), request.alias("body"))
    else:
        raise ValueError(f"unknown shape {shape}")
    return requests.select(F.to_json(body).alias("value"))


def markdown(rows: DataFrame) -> DataFrame:
    """One Markdown text per session: a title and its turns in order."""
    turn = F.concat(F.lit("**"), F.col("role"), F.lit("**\n\n"), F.col("text"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", turn.alias("t")))), lambda x: x["t"]), "\n\n")
    return rows.groupBy("session_id").agg(F.concat(F.lit("# Session "), F.first("session_id").cast("string"), F.lit("\n\n"), parts).alias("value"))
