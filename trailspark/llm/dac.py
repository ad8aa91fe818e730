"""Token-id files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id; an id that needs more has its
bit set in the level's continuation bitmap, and its next chunk stands in the next level at the rank of that bit. A
directory of ranks, one a block of 512 bits, finds the rank with one partial popcount, so any id, or any run of
ids, is read without decoding what stands before it.

Image of one file, all little-endian: magic `DAC1`; documents u32, ids u64, levels u8; validity bitmap of the document
ids; document ids i64; document ends u64 (in ids); then for each level its length u64, its chunks u8, and, unless it is
the last, its bitmap (lowest bit first, whole bytes) and its ranks u32, one a block and the total.

Files lie as rows (pid, seq, start, ids, image) of a Parquet table, which gives them an atomic commit and any store that
Spark writes to. They are in ascending document order by (pid, seq).

Edge cases: a null text counts as empty and gives the end id alone. Null document ids come first, kept as nulls; rows
that repeat an id are ordered by the text's first HEAD characters, then its hash, and may lie in several tasks. A long text is one document of a file, however large. An empty table gives no
file. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.operators.scratch import small

from .common import parts
from .tokens import encoder, read_file

MAGIC = b"DAC1"
BLOCK = 512
#: Ids in a file; a document is never cut, so the last one may go beyond.
FILE_IDS = 1 << 20
#: Characters of a text that order the rows of one id: bounds of ranges pass through the driver, so keys stay short.
HEAD = 200
_HEAD = struct.Struct("<4sIQB")


def build(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The image of one file."""
    valid = np.array([d is not None for d in doc_ids], bool)
    parts = [np.packbits(valid, bitorder="little").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.cumsum(lengths, dtype=np.uint64).astype("<u8").tobytes()]
    rest, levels = ids.astype(np.uint32), 0
    while True:
        more = rest > 255
        parts += [struct.pack("<Q", len(rest)), rest.astype(np.uint8).tobytes()]
        levels += 1
        if not more.any():
            break
        bitmap = np.packbits(more, bitorder="little")
        padded = np.concatenate((bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8)))
        counts = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        parts += [bitmap.tobytes(), np.concatenate(([0], np.cumsum(counts))).astype("<u4").tobytes()]
        rest = rest[more] >> np.uint32(8)
    return _HEAD.pack(MAGIC, len(doc_ids), len(ids), levels) + b"".join(parts)


class DacFile:
    """Reads an image: documents, and ids by place."""

    def __init__(self, image: bytes):
        magic, docs, self.n, levels = _HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a DAC image")
        self._image, self._at = image, _HEAD.size
        valid = np.unpackbits(self._take(np.uint8, -(-docs // 8)), bitorder="little")[:docs]
        self.doc_ids = [int(d) if ok else None for d, ok in zip(self._take("<i8", docs), valid, strict=True)]
        self.ends = self._take("<u8", docs).astype(np.int64)
        self.levels = []
        for level in range(levels):
            (size,) = struct.unpack("<Q", self._take(np.uint8, 8).tobytes())
            chunks = self._take(np.uint8, size)
            last = level + 1 == levels
            bitmap = None if last else self._take(np.uint8, -(-size // 8))
            ranks = None if last else self._take("<u4", -(-size // BLOCK) + 1)
            self.levels.append((chunks, bitmap, ranks))

    def _take(self, kind, count: int) -> np.ndarray:
        out = np.frombuffer(self._image, kind, count, self._at)
        self._at += out.nbytes
        return out

    def _rank(self, level: int, place: int) -> int:
        """Set bits before the place."""
        _, bitmap, ranks = self.levels[level]
        block = place // BLOCK
        inside = bitmap[block * BLOCK // 8 : place // 8]
        rank = int(ranks[block]) + int(np.bitwise_count(inside).sum())
        return rank + (int(bitmap[place // 8]) & ((1 << place % 8) - 1)).bit_count() if place % 8 else rank

    def access(self, place: int) -> int:
        """One id."""
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[place]) << (8 * level)
            if bitmap is None or not int(bitmap[place // 8]) >> (place % 8) & 1:
                break
            place = self._rank(level, place)
        return value

    def run(self, start: int, end: int) -> np.ndarray:
        """The ids of places start to end."""
        out = np.zeros(end - start, np.uint32)
        where = np.arange(end - start)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            if bitmap is None or start == end:
                break
            bits = np.unpackbits(bitmap[start // 8 : -(-end // 8)], bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
            start, where = self._rank(level, start), where[bits]
            end = start + len(where)
        return out

    def document(self, number: int) -> np.ndarray:
        return self.run(int(self.ends[number - 1]) if number else 0, int(self.ends[number]))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> None:
    """Encode every text, append end_id, and write the ids as files in ascending order of the document id."""
    content = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Equal rows have numbers of their own, so that ranges can split an id that many rows share.
    order = "doc_id", "head", "hash", "row"
    rows = rows.select("*", F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        blobs: list[bytes] = []
        held = 0

        def file() -> pa.RecordBatch:
            image = build(doc_ids, [len(b) // 4 for b in blobs], np.frombuffer(b"".join(blobs), "<u4"))
            return pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "seq": pa.array([seq], pa.int32()), "start": pa.array([start], pa.int64()), "ids": pa.array([held], pa.int64()), "image": pa.array([image], pa.binary())})

        with encoder(content.value) as tool:
            for part in parts(batches, 256):
                for doc_id, ids in zip(part.column(0).to_pylist(), tool.encode(part.column(1).to_pylist()), strict=True):
                    doc_ids.append(doc_id)
                    blobs.append(ids + last)
                    held += len(ids) // 4 + 1
                    if held >= file_ids:
                        yield file()
                        seq, start, held = seq + 1, start + held, 0
                        doc_ids, blobs = [], []
            if doc_ids:
                yield file()

    ordered.mapInArrow(run, "pid int, seq int, start long, ids long, image binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts the ids of all before it."""
    files = spark.read.schema("pid int, seq int, start long, ids long, image binary").parquet(path)
    # One row a writing task: that number bounds the window; the broadcast is checked.
    totals = files.groupBy("pid").agg(F.sum("ids").alias("total"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("pid", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = files.join(small(bases), "pid").select((F.col("base") + F.col("start")).alias("start"), "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = DacFile(image.as_py())
                ends = file.ends
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                sums = [zlib.crc32(file.document(i).astype("<u4").tobytes()) for i in range(len(ends))]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(starts + first), pa.array(ends - starts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
