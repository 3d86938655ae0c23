"""Tables of SQLite files as a Spark data source, one task a file.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("table", "messages").schema("id string, ...").load(path)

A column ``source_path`` gets the file's address, ``source_rowid`` the row's number in its table, by which rows
come. Files lie in any store that Arrow knows: those with a local path are opened where they lie, with what their write-ahead log
holds; others are read whole, and must not have such a log. No file is written.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ENDINGS = (".db", ".sqlite")


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


def store_of(path: str):
    """(store, path in it) of an address, or of a plain local path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file:///") else path.replace("file:/", "file:///", 1))


def files_below(path: str) -> list[str]:
    """Addresses of the SQLite files of a folder, or of the file that is named."""
    from pyarrow import fs

    store, at = store_of(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    prefix = path.split(at)[0] if at in path else ""
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(ENDINGS))


def opened(path: str) -> sqlite3.Connection:
    """A connection that only reads."""
    from pyarrow import fs

    store, at = store_of(path)
    if isinstance(store, fs.LocalFileSystem) and os.path.exists(at):
        return sqlite3.connect(f"file:{at}?mode=ro", uri=True)
    if store.get_file_info(f"{at}-wal").size:
        raise ValueError(f"{path} has a write-ahead log, so its pages alone don't tell what it holds")
    with store.open_input_file(at) as source:
        pages = bytearray(source.read())
    if len(pages) >= 20:
        pages[18:20] = b"\x01\x01"  # without a log to look for
    db = sqlite3.connect(":memory:")
    db.deserialize(bytes(pages))
    return db


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[FilePart]:
        return [FilePart(p) for p in files_below(self.options["path"])]

    def read(self, part: FilePart) -> Iterator[tuple]:
        """Rows of the named columns; columns that a file lacks are null, and so is a table."""
        table = self.options["table"].replace('"', "")
        db = opened(part.path)
        try:
            there = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}
            if not there:
                return
            made = {"source_rowid": "rowid", "source_path": "?"}
            wanted = [f.name for f in self.schema.fields]
            columns = ", ".join(made.get(n) or (f'"{n}"' if n in there else "NULL") for n in wanted)
            yield from db.execute(f'SELECT {columns} FROM "{table}" ORDER BY rowid', [part.path] * wanted.count("source_path"))
        finally:
            db.close()


class SqliteSource(DataSource):
    """Read-only access to archives that harnesses keep in SQLite."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)
