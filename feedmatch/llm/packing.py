"""Sum-of-squares packing of documents into fixed windows.

Each task packs the documents of its partition online. Full windows are cut off
a long document first; the rest of ``s`` ids goes to the fill level ``h`` that
minimises the sum over levels of the squared number of windows at that level:
moving a window from ``h`` to ``h + s`` changes the sum by
``1 - 2 N[h] + 2 N[h + s] + 1`` (no last term when the window gets full), a new
window by ``2 N[s] + 1``. Only the level array and the open windows' pieces are
kept. When the partition ends, the emptiest open windows are cut into the gaps
of the fullest, and the one that remains is cut into sequences of power-of-two
lengths, which need no padding.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; ties between levels go to the fullest level, then to no new
window; an empty table gives no rows; other columns are ignored. A sequence_id
is the task's number times 2**32 plus a counter, so it is the same when a task
is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmatch.llm.tokens import memo

WINDOW = 2048
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

Piece = tuple[int | None, int, int, bytes]  # doc_id, start, doc_tokens, raw ids


class SumOfSquares:
    """Online packing of pieces into windows of ``size`` ids; ``done`` takes each finished sequence."""

    def __init__(self, size: int = WINDOW) -> None:
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.done: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        """Place a piece of 1 to ``size`` ids."""
        s = len(piece[3]) // 4
        if s == self.size:
            self.done.append([piece])
            return
        # cost[h] for h = 1 .. size - s; what gets full leaves the sum
        here, there = self.levels[1:self.size - s + 1], self.levels[1 + s:self.size + 1]
        cost = 2 * (there - here) + 2
        cost[-1] = 1 - 2 * here[-1]
        cost[here == 0] = np.iinfo(np.int64).max
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        fill = best + 1 if here[best] and cost[best] <= 2 * self.levels[s] + 1 else 0
        window = self.open[fill].pop() if fill else []
        self.levels[fill] -= bool(fill)
        window.append(piece)
        if fill + s == self.size:
            self.done.append(window)
        else:
            self.levels[fill + s] += 1
            self.open.setdefault(fill + s, []).append(window)

    def flush(self) -> None:
        """Finish all windows: cut the emptiest into the gaps of the fullest, the last one into powers of two."""
        left = [w for fill in sorted(self.open) for w in self.open[fill]]
        self.open, self.levels[:] = {}, 0
        pieces: list[Piece] = []
        while left or pieces:
            window = left.pop() if left else []
            gap = self.size - sum(len(p[3]) // 4 for p in window)
            while gap and (pieces or left):
                if not pieces:
                    pieces = left.pop(0)
                doc, start, total, raw = pieces.pop()
                window.append((doc, start, total, raw[:4 * gap]))
                if len(raw) > 4 * gap:
                    pieces.append((doc, start + gap, total, raw[4 * gap:]))
                gap -= min(gap, len(raw) // 4)
            if gap:
                self._powers(window)
            else:
                self.done.append(window)

    def _powers(self, window: list[Piece]) -> None:
        rest, left = list(window), sum(len(p[3]) // 4 for p in window)
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            sequence: list[Piece] = []
            while want:
                doc, start, total, raw = rest.pop(0)
                take = min(want, len(raw) // 4)
                sequence.append((doc, start, total, raw[:4 * take]))
                if len(raw) > 4 * take:
                    rest.insert(0, (doc, start + take, total, raw[4 * take:]))
                want -= take
            self.done.append(sequence)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and the piece's ids."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = SumOfSquares(size), TaskContext.get().partitionId() << 32

        def finished() -> pa.RecordBatch:
            nonlocal number
            columns: list[list] = [[] for _ in _ARROW]
            for sequence in packer.done:
                offset = 0
                for doc, start, total, raw in sequence:
                    for column, value in zip(columns, (doc, start, len(raw) // 4, total, number, offset, raw), strict=True):
                        column.append(value)
                    offset += len(raw) // 4
                number += 1
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), memo(tokenizer).encode(batch.column("text")), strict=True):
                raw += end
                total = len(raw) // 4
                for start in range(0, total, size):
                    packer.add((name, start, total, raw[4 * start:4 * (start + size)]))
                if len(packer.done) >= 256:
                    yield finished()
        packer.flush()
        yield finished()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECE_SCHEMA)
