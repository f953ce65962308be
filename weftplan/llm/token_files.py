"""Token-id files: independent zstandard frames, a trailing seek table and a checksum for each frame.

A shard is a run of data frames (little-endian unsigned 32-bit ids of whole documents), one index frame (doc ids,
lengths and frame numbers of the shard's documents) and a skippable frame with the seek table: compressed size,
size and XXH64 checksum (low 32 bits) of every frame, then their number and a magic number. A reader needs the
tail, the index frame and the frames of the documents it wants. Shards are numbered in ascending doc_id order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import default_tokenizer, encoded, file_system, fresh_path, materialise

# Fixed values of the public seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")
#: Bytes of ids after which a frame is closed; a longer document has a frame of its own.
FRAME_BYTES = 1 << 18

MANIFEST = "shard int, path string, n_docs long, n_ids long"


class ShardWriter:
    """Writes one shard; ``add`` documents in order, then ``close``. Holds one frame and the index."""

    def __init__(self, sink, level: int = 1):
        import zstandard

        self._sink, self._zstd = sink, zstandard.ZstdCompressor(level=level)
        self._held, self._size, self._table = [], 0, []
        self._ids, self._lengths, self._frames = [], [], []

    def _frame(self, raw: bytes) -> None:
        from xxhash import xxh64_intdigest

        packed = self._zstd.compress(raw)
        self._sink.write(packed)
        self._table.append(ENTRY.pack(len(packed), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._held.append(ids)
        self._size += len(ids)
        self._ids.append(doc_id)
        self._lengths.append(len(ids) // 4)
        self._frames.append(len(self._table))
        if self._size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self._held:
            self._frame(b"".join(self._held))
            self._held, self._size = [], 0

    def close(self) -> tuple[int, int]:
        self._flush()
        index = pa.table({"doc_id": pa.array(self._ids, pa.int64()), "n": pa.array(self._lengths, pa.int64()), "frame": pa.array(self._frames, pa.int64())})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, index.schema) as w:
            w.write_table(index)
        self._frame(out.getvalue().to_pybytes())
        body = b"".join(self._table) + FOOTER.pack(len(self._table), 0x80, SEEKABLE_MAGIC)
        self._sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        return len(self._ids), sum(self._lengths)


class ShardReader:
    """Random access to one shard by document position; every frame that is read is checked."""

    def __init__(self, source):
        size = source.size()
        source.seek(size - FOOTER.size)
        n, _, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a token shard: the seek table is missing")
        at = size - FOOTER.size - n * ENTRY.size
        source.seek(at)
        self._source = source
        self._table = [ENTRY.unpack_from(raw, i * ENTRY.size) for raw in [source.read(n * ENTRY.size)] for i in range(n)]
        self._starts = np.concatenate([[0], np.cumsum([t[0] for t in self._table])]).astype(np.int64)
        if self._starts[-1] + 8 != at:
            raise ValueError("not a token shard: frame sizes do not add up")
        self.index = pa.ipc.open_stream(self.frame(n - 1)).read_all()

    def frame(self, k: int) -> bytes:
        import zstandard
        from xxhash import xxh64_intdigest

        packed, size, check = self._table[k]
        self._source.seek(int(self._starts[k]))
        raw = zstandard.ZstdDecompressor().decompress(self._source.read(packed), max_output_size=size)
        if len(raw) != size or xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, positions: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) of the documents at these positions (all, if none are given); decompresses their frames only."""
        ids, n, frames = (self.index.column(c).to_pylist() for c in ("doc_id", "n", "frame"))
        wanted = range(len(ids)) if positions is None else sorted(set(positions))
        first: dict[int, int] = {}
        for i, f in enumerate(frames):
            first.setdefault(f, i)
        held, raw, at, offset = -1, b"", 0, 0
        for i in wanted:
            if frames[i] != held:
                held, raw = frames[i], self.frame(frames[i])
                at, offset = first[held], 0
            while at < i:
                offset += 4 * n[at]
                at += 1
            yield ids[i], raw[offset : offset + 4 * n[i]]


def write_token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 0, level: int = 1) -> DataFrame:
    """Encode ``docs`` and write shards under ``path`` (a URI all executors reach); returns the manifest.

    Null and empty texts hold the end id only. Null doc_ids come first; rows that share a doc_id follow each other in the
    order in which Spark reads them, which is fixed for a fixed layout of files; a very long text has a frame of its own.
    Extra columns are ignored; an empty table writes no shard. A task names its file by its attempt and reports it
    when it is complete, so only files in the manifest count, whatever attempts were lost.
    """
    spark = docs.sparkSession
    path, tokenizer = path or fresh_path(spark, "tokens"), tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = file_system(path)
        fs.create_dir(base, recursive=True)
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.tokz"
        writer = sink = None
        for part, ids in encoded(batches, tokenizer, keep=450_000):  # some 100 MB of a worker
            if writer is None:
                sink = fs.open_output_stream(f"{base}/{name}")
                writer = ShardWriter(sink, level)
            for doc_id, x in zip(part.column("doc_id").to_pylist(), ids):
                writer.add(doc_id, x + end)
        if writer is not None:
            n_docs, n_ids = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": f"{path}/{name}", "n_docs": n_docs, "n_ids": n_ids}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # rows of one doc_id keep the order in which they are read, and go to as many shards as they need
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    return materialise(rows.mapInArrow(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards; ``start`` counts all ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = file_system(row["path"])
                out, start = [], row["base"]
                with fs.open_input_file(name) as source:
                    for doc_id, ids in ShardReader(source).documents():
                        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                if start - row["base"] != row["n_ids"] or len(out) != row["n_docs"]:
                    raise ValueError(f"{row['path']} does not hold what the manifest says")
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row for each shard: as many as there were partitions
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("base", before).repartition("path")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
