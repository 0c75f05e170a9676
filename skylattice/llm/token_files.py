"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames, each holding the ids of consecutive documents, then two skippable frames: the
document index and the seek table in the layout of the published seekable format (compressed and decompressed size and
checksum of each frame, frame count, flags, magic number). A reader takes the last bytes, then the index, and
decompresses only the frames of the documents it wants; each frame's checksum is compared.

Ids are stored in two bytes where the vocabulary allows it, in four otherwise. Documents lie in ascending id order
(null ids first, repeated ids next to each other), file after file.

Defined results: null and empty texts have the end id alone; repeated rows are documents of their own, in the order of
their texts' hashes; an empty table makes no file and reads back as no row; a text of any length is one document of one
frame; other columns of the input are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.storage import small_batches
from skylattice.llm.token_memo import SLICE, encoder

#: Fixed values of the seekable format.
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
#: Skippable frame of this library's document index.
SKIPPABLE_INDEX = 0x184D2A5B
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


class TokenFileWriter:
    """Writes documents to ``sink`` (a binary file object) in frames of about ``frame_bytes`` of ids."""

    def __init__(self, sink, width: int, frame_bytes: int = 1 << 17, level: int = 3):
        self.sink, self.width, self.frame_bytes = sink, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []  # id, tokens, frame, whether the id is null
        self.parts: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        self.docs.append((doc_id or 0, len(ids), len(self.frames), int(doc_id is None)))
        self.parts.append(raw)
        self.held += len(raw)
        if self.held >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            raw = b"".join(self.parts)
            packed = self.zstd.compress(raw)
            self.sink.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.parts, self.held = [], 0

    def close(self) -> None:
        self._flush()
        index = np.array(self.docs, dtype="<i8").reshape(-1, 4)
        body = struct.pack("<BQ", self.width, len(index)) + index.T.tobytes()
        body = struct.pack("<Q", len(body)) + self.zstd.compress(body)
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class TokenFileReader:
    """Random access to the documents of one file; reads and decompresses only what is asked for."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, os.SEEK_END)
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("not a seekable token file")
        source.seek(size - 9 - 12 * n)
        self.frames = np.frombuffer(source.read(12 * n), dtype="<u4").reshape(-1, 3)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        source.seek(int(self.at[-1]))
        kind, length = struct.unpack("<II", source.read(8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("the document index is missing")
        raw = source.read(length)
        body = zstandard.ZstdDecompressor().decompress(raw[8:], max_output_size=struct.unpack("<Q", raw[:8])[0])
        self.width, count = struct.unpack("<BQ", body[:9])
        self.ids, self.tokens, self.frame, null = np.frombuffer(body, dtype="<i8", offset=9).reshape(4, count)
        self.null = null != 0
        self.start = np.concatenate([[0], np.cumsum(self.tokens)])
        self._open: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self._open[0] != k:
            packed, size, checksum = (int(x) for x in self.frames[k])
            self.source.seek(int(self.at[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {k} is damaged")
            self._open = (k, raw)
        return self._open[1]

    def document(self, k: int) -> np.ndarray:
        """ids of the ``k``-th document."""
        if not self.tokens[k]:
            return np.zeros(0, dtype=np.uint32)
        first = int(np.searchsorted(self.frame, self.frame[k]))  # of its frame
        at = int(self.start[k] - self.start[first])
        return np.frombuffer(self._frame(int(self.frame[k])), dtype=f"<u{self.width}", count=int(self.tokens[k]), offset=at * self.width).astype(np.uint32)

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """Documents of that id (None: of those without one)."""
        return [self.document(int(k)) for k in np.flatnonzero(self.null if doc_id is None else (self.ids == doc_id) & ~self.null)]


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encodes ``docs`` into files under ``path`` in ascending id order; returns the manifest (file, docs, tokens).

    A task writes to a name of its own and renames at the end; a task that runs again makes the same bytes, so either
    copy may win. Repeated ids are told apart by their texts' hash, so that a frequent id is spread over files too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        enc, task = encoder(tokenizer_path), TaskContext.get().partitionId()
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        fs, folder = pafs.FileSystem.from_uri(path)
        final, mine = f"{folder}/part-{task:06d}.ztok", f"{folder}/.part-{task:06d}-{uuid.uuid4().hex}"
        writer = sink = None
        for batch in batches:
            if writer is None:
                fs.create_dir(folder, recursive=True)
                sink = fs.open_output_stream(mine)
                writer = TokenFileWriter(sink, width)
            for at in range(0, batch.num_rows, SLICE):
                for doc, ids in zip(batch.column(0).slice(at, SLICE).to_pylist(), enc.documents(batch.column(1).slice(at, SLICE), end_id)):
                    writer.add(doc, ids)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(mine, final)
            yield pa.RecordBatch.from_pylist(
                [{"file": f"part-{task:06d}.ztok", "file_docs": len(writer.docs), "file_tokens": int(sum(d[1] for d in writer.docs))}],
                schema=pa.schema([("file", pa.string()), ("file_docs", pa.int64()), ("file_tokens", pa.int64())]),
            )

    return ordered.drop("tie").mapInArrow(run, "file string, file_docs long, file_tokens long")


def read_token_files(spark: SparkSession, path: str, manifest: list) -> DataFrame:
    """One row per document of the files that ``manifest`` (file, file_docs, file_tokens; in file order) lists.

    The manifest is a row per file, so it is small. Each task reads one file at a time, frame by frame.
    """
    base, rows = 0, []
    for file, _, tokens in sorted(manifest):
        rows.append((file, base))
        base += tokens
    schema = "file string, base long"
    if not rows:
        return spark.createDataFrame([], DIGEST)
    table = spark.createDataFrame(rows, schema).repartition(len(rows))

    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{folder}/{file}") as source:
                    reader = TokenFileReader(source)
                    for at in range(0, len(reader.ids), 4096):
                        ks = range(at, min(at + 4096, len(reader.ids)))
                        crc = [zlib.crc32(reader.document(k).astype("<u4").tobytes()) for k in ks]
                        part = slice(at, at + 4096)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.ids[part], mask=reader.null[part]),
                                pa.array(reader.start[:-1][part] + first),
                                pa.array(np.ascontiguousarray(reader.tokens[part])),
                                pa.array(crc, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return table.mapInArrow(run, DIGEST)
