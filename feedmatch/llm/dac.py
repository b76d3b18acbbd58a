"""Token ids on disk as directly addressable codes.

Ids are cut into 8-bit chunks. Level 0 holds the lowest chunk of every id,
level 1 the second chunk of those ids that have one, and so on. A bitmap per
level tells which ids go on to the next level, and a rank directory (set bits
before each block of 512) turns a position on one level into its position on
the next, so any id is read with a few lookups and no block is decoded.

The file format is a table of segments. A segment (``segment_tokens`` ids or
one longer document) is one self-describing payload with the doc_ids and
lengths of its documents beside it; segments lie in ascending doc_id order
over ``part``, ``segment``. The table is written by Spark's committer, so a
lost executor costs its own tasks only.

Defined results: a null or empty text is the end id alone; documents with a
null doc_id come first; repeated doc_ids follow each other ordered by the hash
of their text; other columns of the input are ignored; an empty table gives an
empty file table and no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedmatch.llm.tokens import memo

MAGIC = b"DAC1"
BLOCK = 512
SEGMENT_TOKENS = 1 << 18
SEGMENT_SCHEMA = "part int, segment int, part_start long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, payload binary"
_SEGMENT_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()),
                            ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_DOC_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def pack(ids: np.ndarray) -> bytes:
    """The payload for an array of unsigned 32-bit ids."""
    left, levels = ids.astype(np.uint32), []
    while True:
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4") if len(blocks) else blocks
        levels.append((len(left), (left & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            break
        left = left[more] >> 8
    head = MAGIC + struct.pack("<II", len(levels), BLOCK) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(chunks + bits + ranks for _, chunks, bits, ranks in levels)


class Reader:
    """Random access to the ids of one payload."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a DAC payload")
        n_levels, self.block = struct.unpack_from("<II", payload, 4)
        at, self.levels = 12 + 8 * n_levels, []
        for (n,) in struct.iter_unpack("<Q", payload[12:at]):
            n_bits, n_ranks = (n + 7) // 8, -(-n // self.block)
            chunks = np.frombuffer(payload, np.uint8, n, at)
            bits = np.frombuffer(payload, np.uint8, n_bits, at + n)
            ranks = np.frombuffer(payload, "<u4", n_ranks, at + n + n_bits)
            self.levels.append((chunks, bits, ranks))
            at += n + n_bits + 4 * n_ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Ids before position ``i`` of a level that go on to the next."""
        _, bits, ranks = self.levels[level]
        block = min(i // self.block, len(ranks) - 1)
        begin = block * self.block
        inside = bits[begin // 8:i // 8 + 1]
        return int(ranks[block]) + int(np.unpackbits(inside, bitorder="little")[:i - begin].sum()) if len(ranks) else 0

    def __getitem__(self, i: int) -> int:
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not (bits[i // 8] >> (i % 8)) & 1:
                break
            i = self._rank(level, i)
        return value

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` (excluded): one contiguous run on every level."""
        out = np.zeros(end - begin, np.uint32)
        which = np.arange(end - begin)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if begin == end:
                break
            out[which] |= chunks[begin:end].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[begin // 8:(end + 7) // 8], bitorder="little")[begin % 8:][:end - begin].astype(bool)
            if level + 1 == len(self.levels):
                break
            begin = self._rank(level, begin)
            end = begin + int(more.sum())
            which = which[more]
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every whole text and write the segment table to ``path`` in ascending doc_id order."""
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, ids, held = [], [], [], 0
        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), memo(tokenizer).encode(batch.column("text")), strict=True):
                doc_ids.append(name)
                lengths.append(len(raw) // 4 + 1)
                ids += [raw, end]
                held += lengths[-1]
                if held >= segment_tokens:
                    yield segment(part, number, before, held, doc_ids, lengths, ids)
                    number, before = number + 1, before + held
                    doc_ids, lengths, ids, held = [], [], [], 0
        if doc_ids:
            yield segment(part, number, before, held, doc_ids, lengths, ids)

    def segment(part, number, before, held, doc_ids, lengths, ids) -> pa.RecordBatch:
        payload = pack(np.frombuffer(b"".join(ids), "<u4"))
        return pa.RecordBatch.from_pylist([{"part": part, "segment": number, "part_start": before, "n_tokens": held,
                                            "doc_ids": doc_ids, "lengths": lengths, "payload": payload}], schema=_SEGMENT_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(segments, SEGMENT_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a segment table: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # One row per write task: the running sum over parts and the broadcast are bounded by the task count.
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(name)[row] for name in batch.schema.names}
                reader, lengths = Reader(at["payload"].as_py()), np.array(at["lengths"].as_py(), np.int64)
                starts = np.cumsum(lengths) - lengths
                ids = [reader.read(a, b).astype("<u4").tobytes() for a, b in zip(starts.tolist(), (starts + lengths).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([at["doc_ids"].values, pa.array(starts + at["start"].as_py()), pa.array(lengths),
                                                  pa.array(ids, pa.binary())], schema=_DOC_ARROW)

    at = table.join(F.broadcast(offsets), "part")
    return at.select((F.col("offset") + F.col("part_start")).alias("start"), "doc_ids", "lengths", "payload").mapInArrow(documents, DOC_SCHEMA)
