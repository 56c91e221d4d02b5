"""Token-id files of byte planes.

A file holds the ids of whole documents in ascending order of their ids. Blocks
of ``BLOCK`` ids are transposed: plane ``k`` has byte ``k`` of each id, the most
significant planes are nearly constant and shrink to a few bytes. Each plane is
a zstandard frame. Layout, all numbers little-endian::

    magic 8 bytes
    chunk 0: plane 0, 1, 2, 3   chunk 1: ...
    document table (one frame): n, ids (int64), id present (uint8), token counts (int64)
    chunk index: for each chunk its offset (uint64), ids (uint32), and the length of each plane (4 x uint32)
    trailer: table offset, index offset (uint64), chunks (uint64), magic

A document is found by the table's running total of tokens, which names its
chunks; only these are read.

A file ends with the document that brings it to ``FILE_IDS`` ids or ``FILE_DOCS``
documents, so neither a file nor what a task keeps of it grows with the corpus. Its
name holds the task's attempt, and only the files that a finished task returned are
listed: what an attempt that was lost or late leaves behind is never read, and never
replaces a file that is.

Defined cases: a null or empty text has the end id alone; a null id sorts first;
repeated ids stand next to each other, by checksum of their texts; an empty table
gives no files and no rows; other columns aren't read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import durable, shared_dir

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
PLANES = 4
FILE_IDS, FILE_DOCS = 1 << 24, 1 << 20
#: Documents in one batch of those that are read.
READ_AT_ONCE = 1 << 14
_CHUNK = struct.Struct(f"<QI{PLANES}I")
_TRAILER = struct.Struct("<QQQ8s")


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or a plain path."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


class Writer:
    """Appends ids of one document after another; ``close`` writes table, index and trailer."""

    def __init__(self, out, level: int = 1):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=level)
        self.at, self.n_ids, self.chunks, self.ids, self.counts, self.buffer = 0, 0, [], [], array("q"), bytearray()
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _chunk(self, raw: bytes) -> None:
        planes = np.frombuffer(raw, np.uint8).reshape(-1, PLANES).T
        packed = [self.zip.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
        self.chunks.append((self.at, len(raw) // 4, *map(len, packed)))
        for p in packed:
            self._write(p)

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(raw) // 4)
        self.n_ids += len(raw) // 4
        self.buffer += raw
        while len(self.buffer) >= 4 * BLOCK:
            self._chunk(bytes(self.buffer[: 4 * BLOCK]))
            del self.buffer[: 4 * BLOCK]

    def close(self) -> None:
        if self.buffer:
            self._chunk(bytes(self.buffer))
        table = self.at
        ids = np.array([x or 0 for x in self.ids], "<i8")
        present = np.array([x is not None for x in self.ids], np.uint8)
        self._write(self.zip.compress(struct.pack("<Q", len(ids)) + ids.tobytes() + present.tobytes() + np.array(self.counts, "<i8").tobytes()))
        index = self.at
        for c in self.chunks:
            self._write(_CHUNK.pack(*c))
        self._write(_TRAILER.pack(table, index, len(self.chunks), MAGIC))


class Reader:
    """Reads a file's table and chunks by their places."""

    def __init__(self, source):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.size()
        table, index, n, magic = _TRAILER.unpack(self._read(size - _TRAILER.size, _TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        raw = self._read(index, n * _CHUNK.size)
        self.chunks = [_CHUNK.unpack_from(raw, i * _CHUNK.size) for i in range(n)]
        raw = self.unzip.decompress(self._read(table, index - table))
        (n,) = struct.unpack_from("<Q", raw)
        self.doc_ids = np.frombuffer(raw, "<i8", n, 8)
        self.present = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(bool)
        self.counts = np.frombuffer(raw, "<i8", n, 8 + 9 * n)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *lengths = self.chunks[k]
        raw, planes, used = self._read(at, sum(lengths)), np.empty((PLANES, n), np.uint8), 0
        for p, length in enumerate(lengths):
            planes[p] = np.frombuffer(self.unzip.decompress(raw[used : used + length]), np.uint8)
            used += length
        return np.ascontiguousarray(planes.T).view("<u4").ravel()

    def document(self, row: int) -> np.ndarray:
        """The ids of one document: only its chunks are read."""
        first = int(self.counts[:row].sum())
        last = first + int(self.counts[row])
        if first == last:
            return np.zeros(0, "<u4")
        parts = np.concatenate([self.chunk(k) for k in range(first // BLOCK, (last - 1) // BLOCK + 1)])
        return parts[first - first // BLOCK * BLOCK :][: last - first]

    def documents(self) -> Iterator[np.ndarray]:
        """All documents in order, a chunk in memory at a time."""
        held, k = np.zeros(0, "<u4"), 0
        for n in self.counts.tolist():
            while len(held) < n:
                held, k = np.concatenate([held, self.chunk(k)]), k + 1
            yield held[:n]
            held = held[n:]


def write(docs: DataFrame, path: str, folder: str, end_id: int = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files and returns their list: ``path, first_id, n_docs, n_tokens``; runs once, at once."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.coalesce("text", F.lit(""))).alias("_crc"))
    # ranges of both columns: the rows of one id, or of none, may fill several files
    ordered = ordered.repartitionByRange("doc_id", "_crc").sortWithinPartitions("doc_id", "_crc").drop("_crc")

    def written(batches):
        tail = np.array([end_id], "<u4").tobytes()
        fs, top = place(folder)
        task = TaskContext.get()
        own = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId():010d}"
        writer, number = None, 0

        def closed():
            writer.close()
            out.close()
            row = {"path": [name], "first_id": pa.array([first], pa.int64()), "n_docs": [len(writer.ids)], "n_tokens": [writer.n_ids]}
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), tokens.encoded(b.column(1), path), strict=True):
                if writer is None:
                    fs.create_dir(top, recursive=True)
                    name, first = f"{own}-{number:06d}.idp", doc
                    out = fs.open_output_stream(name, compression=None)
                    writer, number = Writer(out), number + 1
                writer.add(doc, raw + tail)
                if writer.n_ids >= file_ids or len(writer.ids) >= FILE_DOCS:
                    yield closed()
                    writer = None
        if writer:
            yield closed()

    return durable(ordered.mapInArrow(written, "path string, first_id long, n_docs long, n_tokens long"))


def read(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files of ``write``."""
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "start")

    def documents(batches):
        fs, _ = place(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(name) as source:
                    r = Reader(source)
                    found = r.documents()
                    for i in range(0, len(r.counts), READ_AT_ONCE):
                        part = slice(i, i + READ_AT_ONCE)
                        n = r.counts[part].astype(np.int64)
                        crc = np.fromiter((zlib.crc32(x.tobytes()) for x in islice(found, len(n))), np.int64, len(n))
                        starts = start + np.concatenate([[0], np.cumsum(n)[:-1]])
                        start += int(n.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(r.doc_ids[part].astype(np.int64), mask=~r.present[part]), pa.array(starts.astype(np.int64)), pa.array(n), pa.array(crc)],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    # a task a file: a list of paths is so short that adaptive execution would merge all of them if no number were given
    return placed.repartition(max(1, files.count())).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Writes ``docs`` to a new folder in the shared one, then reads the files back."""
    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    return read(write(docs, path, folder, end_id), folder)
