"""Token ids in seekable files: independent zstandard frames, a trailing seek table, checksums.

A file holds the ids of its documents back to back, little-endian, two or four bytes each as its index
says. The stream is cut into zstandard frames of about ``FRAME_IDS`` ids that decompress on their own and
carry zstandard's content checksum; a longer document spans several frames. After them stand

* the document index: a skippable zstandard frame (magic 0x184D2A50) that holds a compressed frame of
  the id width and, per document, id, whether it has one, first id position and number of ids;
* the seek table: a skippable frame (magic 0x184D2A5E) of one entry per preceding frame (compressed size,
  decompressed size, low half of the XXH64 of the content, 32-bit each) and the footer (number of
  entries, descriptor 0x80, magic 0x8F92EAB1), the published seekable format.

Plain zstandard readers skip both and see the ids alone. A reader fetches the footer, the table and the
index, and then only the frames of the documents it was asked for, and checks each frame it reads.

``write_tokens`` orders documents by id (null first; equal ids by their text's hash, then by the row's number) over range partitions, so
that any number of equal ids is spread over files, too,
one file each, named by its partition and a fresh name for each attempt, written under a temporary
name and renamed: a lost task leaves a file that no manifest names. The manifest, one row per file, gives the
ids that come before each file. An empty table writes no file. Null and empty texts consist of the end id. Ids are whole
numbers, null included; other types are refused before any work. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .shared import new_folder, whole_number

FRAME_IDS = 1 << 18
LEVEL = 3
SKIP_INDEX, SKIP_TABLE, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("at", "<u8"), ("n", "<u8")])


class FileWriter:
    """Writes one file to a binary stream; ``close`` adds index and seek table."""

    def __init__(self, out, width: int = 2, frame_ids: int = FRAME_IDS, level: int = LEVEL) -> None:
        self.out, self.width, self.frame_ids = out, width, frame_ids
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.width == 2 and ids.size and int(ids.max()) > 0xFFFF:
            raise ValueError("an id needs more than two bytes: write with width=4")
        self.index.append((doc_id or 0, doc_id is not None, self.total, len(ids)))
        self.total += len(ids)
        if self.held and self.held + len(ids) > self.frame_ids:
            self._frame()
        for at in range(0, len(ids), self.frame_ids):
            part = ids[at : at + self.frame_ids]
            self.waiting.append(part)
            self.held += len(part)
            if self.held >= self.frame_ids:
                self._frame()

    def _frame(self) -> None:
        raw = np.concatenate(self.waiting).astype(f"<u{self.width}").tobytes()
        self._put(self.press.compress(raw), raw)
        self.waiting, self.held = [], 0

    def _put(self, data: bytes, raw: bytes) -> None:
        self.out.write(data)
        self.table.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self._frame()
        raw = struct.pack("<BQ", self.width, self.frame_ids) + np.array(self.index, INDEX).tobytes()
        data = self.press.compress(raw)
        self._put(struct.pack("<II", SKIP_INDEX, len(data)) + data, b"")
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        tail = entries + struct.pack("<IBI", len(self.table), 0x80, FOOTER)
        self.out.write(struct.pack("<II", SKIP_TABLE, len(tail)) + tail)


class FileReader:
    """Reads documents from a seekable binary stream, frame by frame; keeps the last frame only."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.seek(0, io.SEEK_END)
        n, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER or descriptor != 0x80:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(-1, 3)
        self.sizes, self.sums = table[:-1, 1].astype(np.int64), table[:-1, 2]
        self.places = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.open = zstandard.ZstdDecompressor()
        held = self._at(int(self.places[-2]), int(table[-1, 0]))
        if struct.unpack("<II", held[:8]) != (SKIP_INDEX, len(held) - 8):
            raise ValueError("the document index is damaged")
        raw = self.open.decompress(held[8:])
        self.width = raw[0]
        self.index = np.frombuffer(raw[9:], INDEX)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes // self.width)])
        self.last: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))
        self.frames_read = 0

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            raw = self.open.decompress(self._at(int(self.places[k]), int(self.places[k + 1] - self.places[k])))
            if len(raw) != self.sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.last, self.frames_read = (k, np.frombuffer(raw, f"<u{self.width}")), self.frames_read + 1
        return self.last[1]

    def document(self, i: int) -> Iterator[np.ndarray]:
        """The ids of the file's ``i``-th document, in parts of at most a frame."""
        at, end = int(self.index["at"][i]), int(self.index["at"][i] + self.index["n"][i])
        k = int(np.searchsorted(self.starts, at, "right")) - 1
        while at < end:
            first = int(self.starts[k])
            part = self.frame(k)[at - first : end - first]
            yield part
            at, k = at + len(part), k + 1


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, width: int = 2, end_id: int | None = tokens.END_ID) -> DataFrame:
    """Encodes every text, writes the files into ``folder`` and returns the manifest.

    Manifest: ``path``, ``part``, ``n_docs``, ``n_ids``, ``before`` (ids in earlier files). It has one row per
    file, as many as range partitions, which is why it may pass through the driver.
    """
    spark = docs.sparkSession
    vocabulary, folder = vocabulary or tokens.default_vocabulary(), folder or new_folder(spark, "tokens")
    whole_number(docs, id_col)
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    ordered = ordered.repartitionByRange("id", "h", "row").sortWithinPartitions("id", "h", "row").select("id", "text")

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"{where}/{part:06d}-{uuid.uuid4().hex}"
        own, writer, stream = tokens.encoder(vocabulary), None, None
        for rb in rows:
            for doc_id, ids in zip(rb.column(0), own.encode(t.as_py() for t in rb.column(1)), strict=True):
                if writer is None:
                    fs.create_dir(where, recursive=True)
                    stream = fs.open_output_stream(name + ".part")
                    writer = FileWriter(stream, width)
                writer.add(doc_id.as_py(), ids if end_id is None else np.append(ids, np.uint32(end_id)))
        if writer:
            writer.close()
            stream.close()
            fs.move(name + ".part", name + ".tokens")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rsplit('/', 1)[1]}.tokens"], "part": pa.array([part], pa.int32()), "n_docs": [len(writer.index)], "n_ids": [writer.total]})

    files = sorted(ordered.mapInArrow(write, "path string, part int, n_docs long, n_ids long").collect(), key=lambda r: r.part)
    before = np.concatenate([[0], np.cumsum([r.n_ids for r in files], dtype=np.int64)])
    rows = [(r.path, r.part, r.n_docs, r.n_ids, int(b)) for r, b in zip(files, before, strict=False)]
    return spark.createDataFrame(rows, "path string, part int, n_docs long, n_ids long, before long")


def read_tokens(manifest: DataFrame, doc_ids: list[int] | None = None, ids: bool = True) -> DataFrame:
    """Documents from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``.

    With ``doc_ids`` only the frames that hold these documents are read and decompressed.
    """
    spread = manifest.repartition(max(1, manifest.count()))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]
    asked = None if doc_ids is None else np.array(sorted(doc_ids), np.int64)

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            for path, before in zip(rb.column(0).to_pylist(), rb.column(4).to_pylist(), strict=True):
                fs, name = _filesystem(path)
                with fs.open_input_file(name) as source:
                    reader = FileReader(source)
                    wanted = np.arange(len(reader.index)) if asked is None else np.flatnonzero(np.isin(reader.index["doc_id"], asked) & (reader.index["has_id"] == 1))
                    for at in range(0, len(wanted), 1000):
                        out: list[tuple] = []
                        for i in wanted[at : at + 1000]:
                            doc, crc, kept = reader.index[i], 0, []
                            for part in reader.document(int(i)):
                                crc = zlib.crc32(part.astype("<u4"), crc)
                                kept += part.tolist() if ids else ()
                            out.append((int(doc["doc_id"]) if doc["has_id"] else None, before + int(doc["at"]), int(doc["n"]), crc, *[kept] * ids))
                        types = [*[pa.int64()] * 4, *[pa.list_(pa.int64())] * ids]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def folder_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest that ``write_tokens`` saved beside its files with ``save_manifest``."""
    return spark.read.parquet(f"{folder}/manifest")


def save_manifest(manifest: DataFrame, folder: str) -> None:
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
