"""Token ids in fixed-width bit-packed files.

Documents are encoded with a given tokenizer, an end id is appended, and the ids
are stored in as few bits as the vocabulary needs. Files cover ascending ranges
of doc_id. A file is

    magic (8 bytes) | blocks | footer | length of footer (8 bytes) | magic (8 bytes)

Each block holds BLOCK_IDS ids (the last one of a file fewer), least significant
bit first, and starts on a byte. The footer holds, as little-endian unsigned 64-bit
numbers: bits per id, ids per block, number of documents, number of ids, number of
blocks; then per document a null flag (0 or 1), its id (signed) and its number of
ids; then the offset of each block in the file. So a reader finds any id by one
division and unpacks whole blocks with numpy.

Edge cases: null and empty texts are the end id alone; null doc_ids come first and
read back as null; rows that share a doc_id stand next to each other, ordered by
text; an empty table gives no rows; other columns are ignored. Lost tasks write
the same files again, under a name of their own until they are whole.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"SKEINID1"
BLOCK_IDS = 4096
#: Documents that one file should hold.
DOCS_PER_FILE = 20_000
END_ID = 2
#: Blocks unpacked in one go when a file is read from start to end.
BLOCKS_AT_ONCE = 64
#: Pieces whose ids a worker remembers; beyond that it starts anew.
MOST_PIECES = 1_500_000
#: About how many characters of text are cut together, or the text that reaches beyond.
CHARS_AT_ONCE = 2 << 20
#: Characters for which every regular expression engine agrees what a letter,
#: a number and a space is; other texts go to the tokenizer as they are.
PLAIN = re.compile("[\n\x20-\x7e\xa1-\u024f]*")
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
LETTER, NUMBER, OTHER, SPACE, END = range(5)
#: What closes each text while many are cut together; no plain text holds it.
CLOSE = b"\0"
#: The kind of each character by code point.
KINDS = np.full(0x250, OTHER, np.uint8)
for _kind, _chars in ((LETTER, f"[{LETTERS}]"), (NUMBER, f"[{NUMBERS}]"), (SPACE, "[ \n]"), (END, "\0")):
    KINDS[[c for c in range(len(KINDS)) if re.match(_chars, chr(c))]] = _kind
#: Fixed value: how byte-level BPE writes those bytes that aren't printable.
BYTE_LETTERS = {b: chr(0x100 + i) for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


def cut(data: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes of plain texts, each followed by CLOSE, a piece of its own.

    Pieces are those of byte-level BPE: runs of letters, of numbers or of other characters, each with
    the space before it; white space but for its last character, if a run follows; 's, 't, 'm, 'd, 're,
    've and 'll where a piece begins.
    """
    kind = KINDS[data]
    lead = np.flatnonzero(data >= 0xC2)  # of characters of two bytes, both of which get their kind
    kind[lead] = kind[lead + 1] = KINDS[(data[lead].astype(np.uint16) & 31) << 6 | data[lead + 1] & 63]
    before, now = kind[:-1], kind[1:]
    begins = np.ones(len(data), bool)
    begins[1:] = (now != before) | (now == END)
    follows = (before == SPACE) & (now < SPACE)
    begins[:-1] |= follows
    begins[1:] &= ~(follows & (data[:-1] == ord(" ")))
    quote = np.flatnonzero(begins & (data == ord("'")))
    first, second = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
    one = np.isin(first, list(b"stmd"))
    two = np.isin(first.astype(np.uint16) << 8 | second, [a << 8 | b for a, b in (b"re", b"ve", b"ll")])
    begins[quote[one | two] + 1] = False
    begins[quote[one] + 2] = True
    begins[quote[two] + 3] = True
    return np.flatnonzero(begins)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """A tokenizer that remembers the ids of pieces of text.

    Byte-level BPE cuts a text into pieces and encodes each by itself, so a text's
    ids are those of its pieces, one after the other. Only tokenizers known to work
    that way, and texts without special tokens, take this road; the rest are encoded
    whole.
    """

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        """By the call that leaves out where in the text a token stands, which takes a third of the time."""
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _learn(self, pieces: list[bytes]) -> None:
        """Remember pieces. They are cut already, so the tokenizer's model gets them as they are."""
        for piece in pieces:
            written = piece.decode("latin-1").translate(BYTE_LETTERS)
            self.known[piece] = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _by_piece(self, texts: list[str]) -> list[bytes]:
        """The ids of plain texts. Arrow tells equal pieces apart, so each distinct one is looked up once."""
        raw = b"".join(t.encode() + CLOSE for t in texts)
        data = np.frombuffer(raw, np.uint8)
        bounds = np.append(cut(data), len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        which, (_, ends, held) = coded.indices.to_numpy(), coded.dictionary.buffers()
        held, ends = held.to_pybytes(), np.frombuffer(ends, np.int64, len(coded.dictionary) + 1).tolist()
        distinct = [held[a:b] for a, b in pairwise(ends)]
        new = [p for p in distinct if p not in self.known]
        if len(self.known) + len(new) > MOST_PIECES:
            self.known.clear()
            new = distinct
        self._learn(new)
        self.known[CLOSE] = b""
        found = [self.known[p] for p in distinct]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        counts = sizes[which]
        stops = np.cumsum(counts)
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - stops + counts, counts)
        places += np.arange(len(places))
        ids = np.frombuffer(b"".join(found), "<u4")[places].tobytes()
        ends = 4 * stops[which == distinct.index(CLOSE)]
        return [ids[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out = [None if self._is_plain(t) else self._whole(t) for t in texts]
        plain = [i for i, ids in enumerate(out) if ids is None]
        group = np.cumsum([len(texts[i]) for i in plain]) // CHARS_AT_ONCE
        for _, some in groupby(zip(group.tolist(), plain, strict=True), itemgetter(0)):
            places = [i for _, i in some]
            for i, ids in zip(places, self._by_piece([texts[i] for i in places]), strict=True):
                out[i] = ids
        return out

    def _is_plain(self, text: str) -> bool:
        return bool(self.by_piece and PLAIN.fullmatch(text)) and not any(s in text for s in self.special)


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, least significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", count).astype("<u4")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: count * width].reshape(count, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1).astype("<u4")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file; it appears under its name when it is whole."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = _open(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.width, self.at, self.rest, self.total = width, len(MAGIC), np.zeros(0, "<u4"), 0
        self.nulls: list[int] = []
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.offsets: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.nulls.append(int(doc_id is None))
        self.ids.append(doc_id or 0)
        self.lengths.append(len(ids))
        self.total += len(ids)
        held = np.concatenate([self.rest, ids]) if len(self.rest) else ids
        whole = len(held) // BLOCK_IDS * BLOCK_IDS
        for at in range(0, whole, BLOCK_IDS):
            self._block(held[at : at + BLOCK_IDS])
        self.rest = held[whole:]

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        raw = pack(ids, self.width)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        head = np.array([self.width, BLOCK_IDS, len(self.ids), self.total, len(self.offsets)], "<u8")
        footer = b"".join(
            np.array(x, kind).tobytes()
            for x, kind in ((head, "<u8"), (self.nulls, "<u1"), (self.ids, "<i8"), (self.lengths, "<u8"), (self.offsets, "<u8"))
        )
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    """Reads one file: documents in order, or any range of ids."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        tail = self.file.read_at(16, end - 16)
        if tail[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is not a token file or is cut short")
        size = int.from_bytes(tail[:8], "little")
        raw = self.file.read_at(size, end - 16 - size)
        self.width, self.block, docs, self.total, blocks = np.frombuffer(raw, "<u8", 5).tolist()
        at = 40
        self.null = np.frombuffer(raw, "<u1", docs, at).astype(bool)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at := at + docs)
        self.lengths = np.frombuffer(raw, "<u8", docs, at := at + 8 * docs).astype(np.int64)
        offsets = np.frombuffer(raw, "<u8", blocks, at + 8 * docs).astype(np.int64)
        self.offsets = np.r_[offsets, end - 16 - size]

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are read."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block + 1
        base = int(self.offsets[first])
        raw = self.file.read_at(int(self.offsets[last]) - base, base)
        parts = []
        for b in range(first, last):
            count = min(self.block, self.total - b * self.block)
            parts.append(unpack(raw[self.offsets[b] - base : self.offsets[b + 1] - base], self.width, count))
        held = np.concatenate(parts)
        return held[start - first * self.block : stop - first * self.block]

    def checksums(self) -> Iterator[int]:
        """CRC-32 of each document's ids as unsigned 32-bit numbers, in order."""
        step = self.block * BLOCKS_AT_ONCE
        held, base = self.read(0, min(step, self.total)), 0
        at = 0
        for length in self.lengths.tolist():
            crc, left = 0, length
            while left:
                if at - base >= len(held):
                    base = at
                    held = self.read(base, min(base + step, self.total))
                part = held[at - base : at - base + left]
                crc = zlib.crc32(part.tobytes(), crc)
                at, left = at + len(part), left - len(part)
            yield crc


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents under ``folder``; one row per file: part, path, n_docs, n_ids.

    Cut points of doc_id deal the documents into ranges, one for every ``DOCS_PER_FILE`` of them
    and as many as Spark has shuffle partitions at least; each range becomes one file.
    """
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    parts = common.partitions(docs.count(), DOCS_PER_FILE, spark)
    bounds = common.range_bounds(docs.select("doc_id"), "doc_id", parts)
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        width = bits_for(max(made.size, end_id + 1))
        done: list[tuple] = []
        writer, part = None, None

        def finish() -> None:
            writer.close()
            done.append((part, f"{folder}/{part:06d}.ids", len(writer.ids), writer.total))

        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), made.encode(texts), strict=True)
            for own, doc_id, raw in rows:
                if own != part:
                    if writer:
                        finish()
                    part, writer = own, Writer(f"{folder}/{own:06d}.ids", width)
                writer.add(doc_id, np.concatenate([np.frombuffer(raw, "<u4"), end]))
        if writer:
            finish()
        names = ["part", "path", "n_docs", "n_ids"]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*done, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    ranged = docs.select(common.range_of(F.col("doc_id"), bounds).cast("int").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ranged.repartitionById(len(bounds) + 1, "part").sortWithinPartitions(
        "part", F.col("doc_id").asc_nulls_first(), "text"
    )
    return ordered.mapInArrow(run, "part int, path string, n_docs long, n_ids long")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files themselves."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(path)
                start = first + np.cumsum(reader.lengths) - reader.lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.doc_ids.astype(np.int64), mask=reader.null),
                        pa.array(start.astype(np.int64)),
                        pa.array(reader.lengths),
                        pa.array(list(reader.checksums()), pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = placed.select("path", "first").repartition(max(1, files.count()), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids to a new folder of the shared scratch space and read them back."""
    folder = f"{common.scratch_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    files = common.materialise(write(docs, folder, tokenizer, end_id), "token-index")
    return read(files)
