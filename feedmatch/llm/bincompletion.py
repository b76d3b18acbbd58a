"""Best-fit packing by bin completion.

Pieces are packed offline in blocks of at most ``BLOCK_PIECES``. Best-fit
decreasing gives the first incumbent. Where it needs more windows than the
lower bound, branch and bound looks for fewer: the largest unplaced piece opens
the next window, the undominated fillings around it are enumerated fullest
first, and a branch ends as soon as its windows have wasted more than a
solution with one window less can waste. A filling is dominated when some of
its pieces can be exchanged for one larger unplaced piece that still fits (or
several for one of their size), and every filling is when one piece fills the
window exactly. Each better solution becomes the incumbent; the search ends at
the lower bound or after ``STEPS`` steps, after which the incumbent stands: the
step limit bounds time only, every piece is packed in any case.

Documents longer than a window are cut into pieces of its length, the last one
shorter; shorter documents stay whole.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; pieces of equal length take places in the order read; an empty
table gives no rows; other columns are ignored. A sequence_id is the task's
number times 2**32 plus a counter.
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
#: Pieces that a task packs at a time, and bytes of their ids.
BLOCK_PIECES = 16_384
BLOCK_BYTES = 64 << 20
#: Steps of the search in a block.
STEPS = 200_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


class _Sizes:
    """A multiset of sizes with the largest one up to a bound in one step."""

    def __init__(self, sizes: list[int], window: int) -> None:
        self.count = np.bincount(sizes, minlength=window + 1).tolist()
        self.bits = sum(1 << s for s, n in enumerate(self.count) if n)

    def up_to(self, bound: int) -> int:
        """The largest size of at most ``bound``; 0 if there is none."""
        return max((self.bits & ((2 << bound) - 1)).bit_length() - 1, 0) if bound > 0 else 0

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.bits ^= 1 << size

    def put(self, size: int) -> None:
        if not self.count[size]:
            self.bits ^= 1 << size
        self.count[size] += 1


def best_fit_decreasing(sizes: list[int], window: int) -> list[list[int]]:
    """Each size, largest first, into the fullest window that has room."""
    open_, bits, out = {}, 0, []
    for s in sorted(sizes, reverse=True):
        room = bits >> s << s
        gap = (room & -room).bit_length() - 1 if room else window
        if room:
            bin_ = open_[gap].pop()
            if not open_[gap]:
                bits ^= 1 << gap
        else:
            bin_ = []
            out.append(bin_)
        bin_.append(s)
        left = gap - s
        if left:
            if not open_.get(left):
                bits |= 1 << left
            open_.setdefault(left, []).append(bin_)
    return out


def lower_bound(sizes: list[int], window: int) -> int:
    """Windows that any packing needs: the largest of the bounds by which pieces above ``window - k`` stand alone and
    those of at least ``k`` share what the rest leave."""
    count = np.bincount(sizes, minlength=window + 1)
    number, total = np.cumsum(count[::-1])[::-1], np.cumsum((count * np.arange(window + 1))[::-1])[::-1]
    best = -(-int(total[0]) // window)
    half = window // 2
    for k in range(0, half + 1):
        alone = int(number[window - k + 1]) if k else 0
        large = int(number[half + 1]) - alone  # above half a window, up to window - k
        large_sum = int(total[half + 1]) - (int(total[window - k + 1]) if k else 0)
        small_sum = int(total[k]) - int(total[half + 1])
        best = max(best, alone + large + max(0, -(-(small_sum - (large * window - large_sum)) // window)))
    return best


def _dominated(filling: list[int], gap: int, left: _Sizes) -> bool:
    """Whether pieces of a filling can give way to one unplaced piece that fills more, or several to one of their size."""
    for s in filling:
        left.take(s)
    sums = {(0, 0)}  # totals of some pieces; of one, or of two and more
    for s in filling:
        sums |= {(total + s, min(n + 1, 2)) for total, n in sums}
    found = any(n and left.up_to(total + gap) >= total + (n == 1) for total, n in sums)
    for s in filling:
        left.put(s)
    return found


class _Search:
    """Depth-first search over windows, opened by the largest unplaced size."""

    def __init__(self, sizes: list[int], window: int, steps: int) -> None:
        self.window, self.steps, self.left = window, steps, _Sizes(sizes, window)
        self.total, self.incumbent, self.least = sum(sizes), best_fit_decreasing(sizes, window), lower_bound(sizes, window)

    def _fillings(self, room: int, waste: int) -> Iterator[list[int]]:
        """Undominated fillings of ``room`` that leave at most ``waste`` free, fullest first."""
        left = self.left
        if not left.up_to(room):
            if room <= waste:
                yield []
            return
        if left.up_to(room) == room:
            yield [room]
            return
        for gap in range(min(waste, room) + 1):
            for filling in self._exactly(room - gap, room):
                if not _dominated(filling, gap, left):
                    yield filling

    def _exactly(self, total: int, bound: int) -> Iterator[list[int]]:
        """Multisets of unplaced sizes of at most ``bound`` with a given sum, larger sizes first."""
        if not total:
            yield []
            return
        left = self.left
        size = left.up_to(min(total, bound))
        while size and self.steps > 0:
            self.steps -= 1
            left.take(size)  # taken while deeper pieces are chosen, put back before the filling is used
            for rest in self._exactly(total - size, size):
                left.put(size)
                yield [size, *rest]
                left.take(size)
            left.put(size)
            size = left.up_to(size - 1)

    def run(self) -> list[list[int]]:
        """The best packing found."""
        if len(self.incumbent) <= self.least:
            return self.incumbent
        slack = (len(self.incumbent) - 1) * self.window - self.total  # waste of a packing with one window less
        chosen: list[list[int]] = []
        branches = [self._branch(slack)]
        wasted = [0]
        while branches and self.steps > 0 and len(self.incumbent) > self.least:
            if len(chosen) == len(branches):  # undo the window that this level chose before
                for s in chosen.pop():
                    self.left.put(s)
                wasted.pop()
            filling = next(branches[-1], None)
            if filling is None:
                branches.pop()
                continue
            self.steps -= 1
            for s in filling:
                self.left.take(s)
            chosen.append(filling)
            wasted.append(wasted[-1] + self.window - sum(filling))
            if not self.left.bits:
                self.incumbent = [list(f) for f in chosen]
                slack = (len(self.incumbent) - 1) * self.window - self.total
            elif wasted[-1] <= slack:
                branches.append(self._branch(slack - wasted[-1]))
            # else: the next pass of the loop undoes this window
        return self.incumbent

    def _branch(self, waste: int) -> Iterator[list[int]]:
        first = self.left.up_to(self.window)
        self.left.take(first)
        source = self._fillings(self.window - first, waste)
        while True:
            filling = next(source, None)  # computed while the opening piece counts as placed
            self.left.put(first)
            if filling is None:
                return
            yield [first, *filling]
            self.left.take(first)


def complete_bins(sizes: list[int], window: int = WINDOW, steps: int = STEPS) -> list[list[int]]:
    """Sizes of 1 to ``window`` in as few windows as the search finds."""
    return _Search(sizes, window, steps).run() if sizes else []


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = WINDOW, block_pieces: int = BLOCK_PIECES,
                   steps: int = STEPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, sequence_id, offset and the piece's ids."""
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple]] = {}
        pieces = held_bytes = 0

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in _ARROW]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        def finished() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, pieces, held_bytes
            rows: list[tuple] = []
            for own in held.values():
                own.reverse()  # the first read comes off first
            for sequence in complete_bins([s for s, own in held.items() for _ in own], size, steps):
                offset = 0
                for s in sequence:
                    doc, piece, raw = held[s].pop()
                    rows.append((doc, piece, piece * size, s, number, offset, raw))
                    offset += s
                number += 1
                if len(rows) >= 4096:
                    yield table(rows)
                    rows = []
            yield table(rows)
            held, pieces, held_bytes = {}, 0, 0

        for batch in batches:
            full: list[tuple] = []
            for name, raw in zip(batch.column("doc_id").to_pylist(), memo(tokenizer).encode(batch.column("text")), strict=True):
                raw += end
                for piece, lo in enumerate(range(0, len(raw), 4 * size)):
                    ids = raw[lo:lo + 4 * size]
                    if len(ids) == 4 * size:  # fills a window alone
                        full.append((name, piece, piece * size, size, number, 0, ids))
                        number += 1
                    else:
                        held.setdefault(len(ids) // 4, []).append((name, piece, ids))
                        pieces, held_bytes = pieces + 1, held_bytes + len(ids)
                if len(full) >= 2048:
                    yield table(full)
                    full = []
                if pieces >= block_pieces or held_bytes >= BLOCK_BYTES:
                    yield from finished()
            yield table(full)
        yield from finished()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed, PIECE_SCHEMA)
