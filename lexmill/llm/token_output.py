"""Token ids as seekable zstandard files, and their reader.

A file is a row of independent zstandard frames, each with the little-endian unsigned
32-bit ids of some consecutive documents, and at its end a skippable frame with the seek
table (sizes of each frame, and the low 32 bits of the XXH64 of its content). A reader
that wants a few documents reads the table, then only the frames that hold them.

Documents are dealt by ranges of doc_id (and of the first characters of the text, so that rows
without id or of one id are dealt too) and sorted, each task tokenises its range and
writes one file under a name of its own; only files named in the index (one row per
document, written by Spark and so only by tasks that succeeded) count, and a task that
runs again leaves nothing but an unused file. Positions over all files come from running
totals of the files' sizes.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm import wordhash as wh
from lexmill.llm.cluster import scratch, small_batches, tasks_for, text_bytes
from lexmill.llm.tokens import BatchEncoder

#: of the public seekable format (fixed values)
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_IDS = 1 << 18
FILE_TEXT = 24 << 20


class FrameWriter:
    """Writes frames to an open binary file and closes it with the seek table."""

    def __init__(self, out, level: int = 3):
        self.out, self.entries, self.zstd = out, [], zstandard.ZstdCompressor(level=level)

    def frame(self, content: bytes) -> int:
        """Adds a frame; gives its number."""
        packed = self.zstd.compress(content)
        self.out.write(packed)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        return len(self.entries) - 1

    def close(self) -> None:
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class FrameReader:
    """Reads single frames of a file by its seek table; a content that doesn't match its checksum is an error."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        width = 12 if flags & 0x80 else 8
        file.seek(size - 9 - n * width)
        table = np.frombuffer(file.read(n * width), "<u4").reshape(n, width // 4)
        self.sizes, self.sums = table[:, 0].astype(np.int64), table[:, 2] if width == 12 else None
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.starts[k]))
        content = self.zstd.decompress(self.file.read(int(self.sizes[k])))
        if self.sums is not None and xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return content


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        encoder, writer, path, waiting, rows, seq = BatchEncoder.of(tokenizer, special=True), None, None, [], [], 0
        part = TaskContext.get().partitionId()

        def flush():
            n = writer.frame(np.concatenate(waiting).astype("<u4").tobytes())
            out = pa.table({"part": pa.array([part] * len(rows), pa.int32()), "path": [path] * len(rows), "frame": pa.array([n] * len(rows), pa.int32()), "at": [r[1] for r in rows], "seq": pa.array([r[2] for r in rows], pa.int64()), "doc_id": pa.array([r[0] for r in rows], pa.int64()), "n_tokens": [r[3] for r in rows]})
            waiting.clear()
            rows.clear()
            return out.to_batches()

        held = 0
        for batch in batches:
            data, off = wh.utf8(batch.column(1))
            for a, b in wh.pieces(off, 1 << 20, 1 << 20):
                ids, bounds = encoder.encode(data[off[a] : off[b]], off[a : b + 1] - off[a], end_id)
                if writer is None:
                    fs, base = pa.fs.FileSystem.from_uri(folder)
                    name = f"ids-{part:05d}-{uuid.uuid4().hex}.zst"
                    fs.create_dir(base, recursive=True)
                    path, writer = f"{folder}/{name}", FrameWriter(fs.open_output_stream(f"{base}/{name}", compression=None))
                for k, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    waiting.append(ids[bounds[k] : bounds[k + 1]])
                    rows.append((doc, held, seq, int(bounds[k + 1] - bounds[k])))
                    held += len(waiting[-1])
                    seq += 1
                    if held >= FRAME_IDS:
                        yield from flush()
                        held = 0
        if rows:
            yield from flush()
        if writer is not None:
            writer.close()

    return run


_INDEX = "part int, path string, frame int, at long, seq long, doc_id long, n_tokens long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs (doc_id, text) in ascending doc_id order below folder; gives the index.

    The index has a row per document: part and path of its file, frame, at (ids before it in
    the frame), seq (documents before it in the file), doc_id, n_tokens, start (ids of all
    documents before it). It is kept in folder/index. Each text is followed by end_id.

    Null or empty text: the end id alone. Null doc_id: first of all. Rows that share a
    doc_id follow each other in the order of their texts. Other columns are ignored. An
    empty table gives an empty index and no file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = text_bytes(docs)[1]
    files = tasks_for(size, FILE_TEXT, spark)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(files, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_writer(f"{folder}/ids", tokenizer, end_id), _INDEX).write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return index.withColumn("before", before).join(totals.select("part", base.alias("base")), "part").withColumn("start", F.col("base") + F.col("before")).drop("before", "base")


def read_tokens(index: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of the documents in the index, from the files; only their frames are read."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("frame", "ascending"), ("at", "ascending")])
        fs, path = pa.fs.FileSystem.from_uri(table.column("path")[0].as_py())
        reader, have, content = FrameReader(fs.open_input_file(path)), None, b""
        sums, ids = [], []
        for frame, at, n in zip(*(table.column(c).to_pylist() for c in ("frame", "at", "n_tokens")), strict=True):
            if frame != have:
                have, content = frame, reader.frame(frame)
            own = content[4 * at : 4 * (at + n)]
            sums.append(zlib.crc32(own))
            if with_ids:
                ids.append(np.frombuffer(own, "<u4").astype(np.int32))
        out = {"doc_id": table.column("doc_id"), "start": table.column("start"), "n_tokens": table.column("n_tokens"), "ids_crc32": pa.array(sums, pa.int64())}
        return pa.table(out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return index.groupBy("path").applyInArrow(run, ddl).select(*names)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the ids of docs and reads them back: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id), with_ids=False)
