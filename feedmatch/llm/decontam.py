"""Benchmark decontamination by Wu-Manber search over words.

Symbols are words (A-Z lower-cased, digits, letters and all non-ASCII), blocks
are two consecutive words. A window of ``window`` consecutive item words is a
pattern; an item with fewer words is one pattern of its length. Per pattern
length, the block shift table says how far a position can move when the two
words before it stand nowhere later in any pattern (a whole pattern less a
block when they are in none); at shift zero the suffix bucket of that block
selects patterns, a hash of the words selects further, and the words are
compared. A worker builds the tables of a block once.

Items are searched in blocks of bounded size, one narrow pass over the
documents each. The result of each block but the last is written before the
next block is collected, so driver and tasks hold one block at a time, however
large the benchmark; a benchmark of n blocks writes the documents n - 1 times.

Defined results: null texts have no words; items without words are no pattern;
a null item_id is no item unless ``nameless`` is set, which searches those items too
(one null at the end of ``items`` stands for all of them); repeated items count once; documents keep all their
columns in ``row``, whatever their names; a table without patterns gives every
document no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from feedmatch.llm.scratch import stored

WINDOW = 10
#: Benchmark text searched for in one pass, in bytes; a worker's tables of a block take some eight times as much.
BLOCK_BYTES = 16 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_CLEAN = bytes((b + 32) if 65 <= b <= 90 else b if b >= 128 or b in _WORD else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text."""
    return (text or "").encode().translate(_CLEAN).split()


class WuManber:
    """Patterns of one length ``length`` over items (a number for each, and its words).

    Arrays hold some thirty bytes a pattern and up to 64 places a word: the
    items' text once, a table of shifts by hashed block (blocks that share a place share the smaller shift),
    and the patterns sorted by the place of their last block (the suffix
    bucket) and a hash of all their words. What these select is compared with
    the text word for word.
    """

    def __init__(self, length: int, items: list[tuple[int, list[bytes]]]) -> None:
        self.length = m = length
        self.block = b = min(2, m)
        self.skip = m - b + 1
        self.text = b" ".join(b" ".join(words) for _, words in items) + b" "
        sizes = np.array([len(words) for _, words in items], np.int64)
        words = [w for _, own in items for w in own]
        self.offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]).astype(np.uint32)
        hashed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        del words
        ends = np.cumsum(sizes)
        starts = np.concatenate([np.arange(e - n, e - m + 1) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
        self.mask = (1 << max(12, min(26, int(64 * len(hashed)).bit_length()))) - 1  # few places are shared
        place = ((hashed[:-1] * _PRIME ^ hashed[1:] if b == 2 else hashed) & np.uint64(self.mask)).astype(np.uint32)
        shift = np.full(self.mask + 1, self.skip, np.uint8)
        for end in range(b, m + 1):  # ever smaller shifts
            shift[place[starts + end - b]] = m - end
        self.shift = shift.tobytes()
        suffix = place[starts + m - b]
        whole = np.zeros(len(starts), np.uint64)
        for k in range(m):
            whole = whole * _PRIME + hashed[starts + k]
        item = np.repeat(np.array([i for i, _ in items], np.int64), sizes - m + 1)
        order = np.lexsort((item, whole, suffix))
        starts, suffix, whole, item = (x[order] for x in (starts, suffix, whole, item))
        alike = np.flatnonzero((suffix[1:] == suffix[:-1]) & (whole[1:] == whole[:-1])) + 1
        same = np.zeros(len(starts), bool)
        same[alike] = [self._pattern(starts[k]) == self._pattern(starts[k - 1]) for k in alike.tolist()]
        first = np.flatnonzero(~same)  # one entry per distinct pattern, its items a slice
        self.suffix, self.whole, self.start = suffix[first], whole[first], starts[first].astype(np.uint32)
        self.items, self.slices = item, np.append(first, len(starts))

    def _pattern(self, start: int) -> bytes:
        return self.text[self.offsets[start]:int(self.offsets[start + self.length]) - 1]

    def nbytes(self) -> int:
        """Bytes of the tables."""
        return len(self.text) + len(self.shift) + sum(a.nbytes for a in (self.offsets, self.suffix, self.whole, self.start, self.items, self.slices))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(begin, numbers of the items) of every occurrence, in order."""
        m, two, n, shift, mask, prime = self.length, self.block == 2, len(words), self.shift, self.mask, int(_PRIME)
        end = m
        while end <= n:
            place = hash(words[end - 1])
            if two:
                place ^= hash(words[end - 2]) * prime
            place &= mask
            move = shift[place]
            if not move:
                yield from self._found(place, words, end - m)
                move = 1
            end += move

    def _found(self, place: int, words: list[bytes], begin: int) -> Iterator[tuple[int, list[int]]]:
        lo, hi = np.searchsorted(self.suffix, np.uint32(place), "left"), np.searchsorted(self.suffix, np.uint32(place), "right")
        if lo == hi:
            return
        own, whole = words[begin:begin + self.length], 0
        for w in own:
            whole = (whole * int(_PRIME) + hash(w)) & 0xFFFFFFFFFFFFFFFF
        bucket = self.whole[lo:hi]
        for k in range(lo + int(np.searchsorted(bucket, np.uint64(whole), "left")), lo + int(np.searchsorted(bucket, np.uint64(whole), "right"))):
            if self._pattern(self.start[k]) == b" ".join(own):
                yield begin, self.items[self.slices[k]:self.slices[k + 1]].tolist()


def searchers(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One searcher per pattern length; items count by their place in the list."""
    by_length: dict[int, list[tuple[int, list[bytes]]]] = {}
    for number, (_, text) in enumerate(items):
        words = words_of(text)
        if words:
            by_length.setdefault(min(window, len(words)), []).append((number, words))
    return [WuManber(m, own) for m, own in by_length.items()]


_BUILT: dict[str, tuple[list[WuManber], list[int | None]]] = {}


def _machines(token: str, block, window: int) -> tuple[list[WuManber], list[int | None]]:
    """The worker's searchers of a block and its items' ids, built once a worker; only the latest block is held."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = searchers(block.value, window), [item for item, _ in block.value]
    return _BUILT[token]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, nameless: bool = False) -> DataFrame:
    """row (all columns of a document), n_words, spans (begin, end of hit words), items (sorted item_ids)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    if not nameless:
        items = items.where("item_id IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    span = StructType([StructField("begin", LongType()), StructField("end", LongType())])
    schema = StructType([StructField("row", StructType(docs.schema.fields)), StructField("n_words", LongType()),
                         StructField("spans", ArrayType(span)), StructField("items", ArrayType(LongType()))])
    out = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.lit(0).cast("long").alias("n_words"),
                      F.lit(None).cast(schema["spans"].dataType).alias("spans"), F.lit(None).cast(ArrayType(LongType())).alias("items"))
    for k in range(n_blocks):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()]  # about block_bytes
        held = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_pass(held, window), schema)
        if k < n_blocks - 1:
            out = stored(out, "hits")
            held.destroy()
    return out


def _pass(block, window: int):
    """Search all documents for one block of items and add what is found to the columns."""
    token = uuid.uuid4().hex
    spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, ids = _machines(token, block, window)
        for batch in batches:
            rows = batch.column("row")
            n_words, spans, items = [], [], []
            for text, old_spans, old_items in zip(rows.field("text"), batch.column("spans"), batch.column("items"), strict=True):
                words = words_of(text.as_py())
                found = [(s["begin"], s["end"]) for s in old_spans.as_py() or ()]
                which = set(old_items.as_py() or ())
                for machine in machines:
                    for begin, of in machine.search(words):
                        found.append((begin, begin + machine.length))
                        which.update(ids[i] for i in of)
                n_words.append(len(words))
                spans.append([{"begin": a, "end": b} for a, b in _merge(found)])
                items.append(sorted(which, key=lambda i: (i is None, i)))
            yield pa.RecordBatch.from_arrays([rows, pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.int64()))],
                                             names=["row", "n_words", "spans", "items"])

    return run


def n_hit() -> Column:
    """Hit words of a document."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, nameless: bool = False) -> DataFrame:
    """The documents without any hit."""
    return hits(docs, benchmark, window, nameless=nameless).where(F.size("spans") == 0).select("row.*")
