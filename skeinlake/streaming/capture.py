"""Capture: follow a folder of transcripts and take in what is new.

Transcripts grow at their end. A sweep lists the files and leaves those alone whose length and time of change are as
they were. Of the others it first verifies that the bytes taken so far are still there, then reads only those behind them, in
windows of 1 MiB, up to the last line break; a torn line waits for the next sweep. Bytes taken are verified by a digest of the
first and last ``EDGE`` of them, or, with ``thorough``, by a checksum of all of them, which costs reading them. A file
that is shorter, or whose bytes differ, was written anew, at whatever length, and starts a new generation at offset 0; the lines
of older generations stay on disk as an archive. A file that is gone or empty keeps what was taken from it.

The lines of a sweep and the places after it are written under the sweep's number, lines first, so a sweep that broke
off is done again and adds nothing twice. Places are written as changes; every ``WHOLE_EVERY`` sweeps all of them are written, and reading
starts there. A file that changes while a sweep reads it is told by a second listing, and swept once more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Where a file stands: bytes taken, length and time when they were, digest of their edges, checksum of all.
PLACE = "generation long, taken long, length long, changed long, edges string, checksum long"
OFFSETS = f"path string, {PLACE}, sweep long"
LINES = "path string, generation long, byte_offset long, line string"
TAKEN = f"{LINES}, place struct<{', '.join(x.strip().replace(' ', ':') for x in PLACE.split(','))}>"
WINDOW = 1 << 20
EDGE = 4096
WHOLE_EVERY = 16


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, changed) of every file; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.unix_micros("modificationTime").alias("changed"))


def pending(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """Files that are new, or not as they were; ``was`` is their place, null for new ones."""
    was = F.struct("generation", "taken", "length", "changed", "edges", "checksum").alias("was")
    both = files.join(offsets.select(F.col("path").alias("__p"), was), files["path"] == F.col("__p"), "left")
    same = (F.col("was.length") == F.col("length")) & (F.col("was.changed") == F.col("changed"))
    return both.filter(F.col("was").isNull() | ~same).select("path", "length", "changed", "was")


def opened(path: str):
    """An open file of any store that Arrow knows."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file:///") else path.replace("file:/", "file:///", 1))
    return store.open_input_file(at)


def edges(source, taken: int) -> str:
    """A digest of the first and the last bytes of those taken."""
    source.seek(0)
    head = source.read(min(EDGE, taken))
    source.seek(max(0, taken - EDGE))
    return hashlib.sha256(head + source.read(min(EDGE, taken))).hexdigest()


def checksum(source, upto: int) -> int:
    source.seek(0)
    found = 0
    while upto > 0 and (got := source.read(min(WINDOW, upto))):
        found, upto = zlib.crc32(got, found), upto - len(got)
    return found


def still_there(source, length: int, was: dict, thorough: bool) -> bool:
    """Whether the bytes taken from a file are still its beginning."""
    if length < was["taken"] or edges(source, was["taken"]) != was["edges"]:
        return False
    return not thorough or checksum(source, was["taken"]) == was["checksum"]


def complete_lines(source, begin: int, end: int, crc: int) -> Iterator[tuple[list[int], list[bytes], int, int]]:
    """(offsets, lines, where they end, checksum up to there) of each window with a line break; a torn line is kept in pieces."""
    source.seek(begin)
    torn: list[bytes] = []
    left = end - begin
    while left > 0 and (got := source.read(min(WINDOW, left))):
        left -= len(got)
        cut = got.rfind(b"\n") + 1
        if not cut:
            torn.append(got)
            continue
        whole = b"".join([*torn, got[:cut]])
        torn = [got[cut:]] if cut < len(got) else []
        lines = whole.split(b"\n")[:-1]
        offsets = [begin]
        for line in lines:
            offsets.append(offsets[-1] + len(line) + 1)
        begin, crc = offsets.pop(), zlib.crc32(whole, crc)
        yield offsets, lines, begin, crc


def new_lines(todo: DataFrame, thorough: bool = False) -> DataFrame:
    """(path, generation, byte_offset, line, place): complete lines behind what was taken, and one row of each file with its place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for file in batch.to_pylist():
                was, path = file["was"], file["path"]
                with opened(path) as source:
                    fresh = was is not None and not still_there(source, file["length"], was, thorough)
                    generation = 0 if was is None else was["generation"] + fresh
                    taken, crc = (0, 0) if was is None or fresh else (was["taken"], was["checksum"])
                    for offsets, lines, taken, crc in complete_lines(source, taken, file["length"], crc):
                        n = len(lines)
                        text = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
                        schema = schema or _schema()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * n, pa.string()), pa.array([generation] * n, pa.int64()), pa.array(offsets, pa.int64()), text, pa.nulls(n, schema.field("place").type)], schema=schema
                        )
                    place = {"generation": generation, "taken": taken, "length": file["length"], "changed": file["changed"], "edges": edges(source, taken), "checksum": crc}
                yield pa.RecordBatch.from_pylist([{"path": path, "generation": generation, "place": place}], schema=schema or _schema())

    parts = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return todo.repartition(parts, "path").mapInArrow(read, TAKEN)


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [tuple(x.split()) for x in PLACE.split(", ")]
    place = pa.struct([(n, kinds[k]) for n, k in fields])
    return pa.schema([("path", pa.string()), ("generation", pa.int64()), ("byte_offset", pa.int64()), ("line", pa.string()), ("place", place)])


def _places(spark: SparkSession, state: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{OFFSETS}, whole boolean, number long").parquet(state)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def offsets_of(spark: SparkSession, state: str) -> tuple[DataFrame, int]:
    """(path, generation, taken, ...) after the last whole sweep, and its number; nothing and 0 before the first."""
    every = _places(spark, state)
    if every is None:
        return spark.createDataFrame([], OFFSETS), 0
    # the number of a sweep without changes stands in its folder's name only, so a row without a path goes with each
    last = every.agg(F.max("number").alias("last"), F.max(F.when(F.col("whole"), F.col("number"))).alias("whole")).first()
    since = every.filter(F.col("number") >= (last["whole"] or 0)).filter(F.col("path").isNotNull())
    fields = [x.split()[0] for x in PLACE.split(", ")]
    newest = since.groupBy("path").agg(F.max_by(F.struct(*fields, "sweep"), "number").alias("p"))
    return newest.select("path", "p.*"), last["last"] or 0


@dataclass(frozen=True)
class Sweep:
    """Its number, and how many files changed while it read them."""

    number: int
    unsettled: int


def sweep(spark: SparkSession, folder: str, out: str, state: str, thorough: bool = False) -> int:
    """Take in what is new: lines to ``out``/sweep=n, places to ``state``. Returns n."""
    known, last = offsets_of(spark, state)
    number = last + 1
    path = f"{out}/sweep={number}"
    new_lines(pending(listing(spark, folder), known), thorough).write.mode("overwrite").parquet(path)
    moved = spark.read.schema(TAKEN).parquet(path).filter("place IS NOT NULL").select("path", "place.*", F.lit(number).cast("long").alias("sweep"))
    whole = number % WHOLE_EVERY == 0
    fields = moved.columns
    rows = moved.unionByName(known.select(*fields).join(moved.select("path"), "path", "left_anti")) if whole else moved
    mark = spark.createDataFrame([(None,) * len(fields)], OFFSETS)
    rows.unionByName(mark).write.mode("overwrite").parquet(f"{state}/whole={str(whole).lower()}/number={number}")
    return number


def sweep_until_still(spark: SparkSession, folder: str, out: str, state: str, thorough: bool = False) -> Sweep:
    """A sweep, and one more if files changed meanwhile; what changes even then waits for the next."""
    number, unsettled = 0, 0
    for _ in range(2):
        number = sweep(spark, folder, out, state, thorough)
        known, _ = offsets_of(spark, state)
        unsettled = pending(listing(spark, folder), known).count()
        if not unsettled:
            break
    return Sweep(number, unsettled)


def lines_of(spark: SparkSession, out: str) -> DataFrame:
    """(path, generation, byte_offset, line, sweep) of all sweeps and generations, archived ones too."""
    return spark.read.schema(f"{TAKEN}, sweep long").parquet(out).filter("line IS NOT NULL").drop("place")


def captured(spark: SparkSession, out: str) -> DataFrame:
    """The lines of each file's newest generation."""
    taken = spark.read.schema(f"{TAKEN}, sweep long").parquet(out)
    newest = taken.groupBy("path").agg(F.max("generation").alias("generation"))
    return taken.filter("line IS NOT NULL").drop("place").join(newest, ["path", "generation"], "left_semi")


def availability(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """(path, status): files that are gone keep what was taken from them, as a snapshot."""
    there = files.select("path", F.lit(True).alias("there"))
    return offsets.select("path").join(there, "path", "left").select("path", F.when(F.col("there"), "current").otherwise("snapshot_only").alias("status"))


def follow(spark: SparkSession, folder: str, out: str, state: str, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Sweep again and again: a clock stream triggers, the places say what is new."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def take(batch: DataFrame, number: int) -> None:
        sweep_until_still(batch.sparkSession, folder, out, state)

    return clock.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def unchanged(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files (locator, hash, parser) that were taken in before in the same state with the same parser."""
    return found.join(known, ["locator", "hash", "parser"], "left_semi")
