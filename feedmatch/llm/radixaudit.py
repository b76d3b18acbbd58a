"""Filter interaction audit with radix text tries for the duplicate filter.

Five filters judge every document: A short (under ``MIN_WORDS`` words), B
repetitive (under half of the words distinct), C shouting (over 3 % of the code
points are A-Z), D holds one of ``#$%&*|``, E its text equals that of a smaller
doc_id. A document's failures make a mask of five bits; counts per part (lang)
and mask give what every order of the filters keeps and removes, so the
documents are read for their masks only, whatever the number of orders.

Texts meet in radix tries. Each map task inserts its texts into a compressed
trie whose terminals hold the smallest doc_id and its rows, and hands on one
row per distinct text, so a text that a third of all documents share leaves a
task once. These are range-partitioned by adaptive prefixes: prefixes that hold
over ``HEAVY_SHARE`` of a sample of distinct texts (or a quarter of a part's
share) are lengthened fourfold, level by level, until none does, so documents
that begin alike part further in. The sample (texts of lowest hash, ``SAMPLE_TEXTS`` about) steers balance
only. Each part is inserted into a trie again; walking its terminals gives the
rows that no smaller doc_id equals. All others fail E, which is counted by
subtraction over narrow rows.

Defined results: a null text is empty, a null lang is the empty string; a null
doc_id is neither smaller nor greater than another, so it neither fails E nor
makes others fail; rows that repeat a doc_id and text fail E alike; a document
has a label value if any of its labels has it; other columns are ignored; an
empty table has no parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmatch.llm.scratch import stored

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, UPPER_SHARE = 200, 50, 3
MARKS = b"#$%&*|"
UPPER = bytes(range(65, 91))
#: Text bytes that a map task's trie holds before it is walked and begun anew.
TRIE_BYTES = 48 << 20
#: Text bytes of a part after the map tasks' tries, about.
PART_BYTES = 32 << 20
SAMPLE_TEXTS = 20_000
FIRST_PREFIX = 8
#: A prefix that holds this share of the sample, or a quarter of a part's, is lengthened.
HEAVY_SHARE = 1 / 256


class RadixTrie:
    """A compressed trie over byte strings; terminals hold the smallest id and its rows (lang: count)."""

    def __init__(self) -> None:
        self.root: list = [b"", None, None]  # label, children by first byte, terminal [id, {lang: count}]
        self.bytes = 0

    def insert(self, text: bytes, doc: int, lang: str, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(text):
            children = node[1]
            if children is None:
                children = node[1] = {}
            child = children.get(text[at])
            if child is None:
                child = children[text[at]] = [text[at:], None, None]
                self.bytes += len(text) - at
                node, at = child, len(text)
                break
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, text, at)
            upper = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            children[text[at]] = upper
            node, at = upper, at + same
        held = node[2]
        if held is None or doc < held[0]:
            node[2] = [doc, {lang: count}]
        elif doc == held[0]:
            held[1][lang] = held[1].get(lang, 0) + count

    def terminals(self) -> Iterator[tuple[bytes, int, dict[str, int]]]:
        """Every text with its smallest id and that id's rows."""
        stack = [(b"", self.root)]
        while stack:
            before, (label, children, held) = stack.pop()
            text = before + label
            if held is not None:
                yield text, held[0], held[1]
            if children:
                stack += [(text, child) for child in children.values()]


def _common(label: bytes, text: bytes, at: int) -> int:
    """Bytes that ``label`` and ``text`` from ``at`` on share, by halving."""
    low, high = 1, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def mask_of(text: str) -> int:
    """Failures of A to D as bits 0 to 3."""
    raw = text.encode()
    words = raw.split()  # ASCII white space only
    n = len(words)
    short, repetitive = n < MIN_WORDS, 100 * len(set(words)) < DISTINCT_SHARE * n
    shouting = 100 * (len(raw) - len(raw.translate(None, UPPER))) > UPPER_SHARE * len(text)
    return short | repetitive << 1 | shouting << 2 | (len(raw.translate(None, MARKS)) < len(raw)) << 3


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, lang, h (hash of the text), mask (A to D) of every document."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([mask_of(t.as_py()) for t in batch.column("text")], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("h"), found], names=["doc_id", "lang", "h", "mask"])

    return _rows(docs).withColumn("h", F.xxhash64("text")).mapInArrow(judged, "doc_id long, lang string, h long, mask int")


def _rows(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", empty).alias("lang"), F.coalesce("text", empty).alias("text"))


def _prefixes(docs: DataFrame, every: int, parts: int) -> list[str]:
    """Prefixes too heavy for one part among one in ``every`` distinct text, level by level (at most 256, or 4 * parts, a level)."""
    texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    texts = stored(texts.select("text", F.octet_length("text").alias("size")), "prefix-sample")
    total = texts.agg(F.sum("size")).first()[0] or 0
    heavy: list[str] = []
    last, length = None, FIRST_PREFIX
    while total:
        longer = texts.where(F.length("text") >= length)
        if last is not None:
            longer = longer.where(F.substring("text", 1, length // 4).isin(last))
        own = longer.groupBy(F.substring("text", 1, length).alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        last = [r["p"] for r in own.where((F.col("size") > total * min(HEAVY_SHARE, 1 / (4 * parts))) & (F.col("n") > 1)).collect()]
        if not last:
            break
        heavy += last
        length *= 4
    return sorted(heavy)


def _range_key(heavy: list[str]) -> list[Column]:
    """Number of a text's longest heavy prefix, the next characters, and a tie over the whole next level."""
    number, level = F.lit(-1), F.lit(FIRST_PREFIX)
    by_length: dict[int, dict[str, int]] = {}
    for i, prefix in enumerate(heavy):
        by_length.setdefault(len(prefix), {})[prefix] = i
    for length, own in sorted(by_length.items()):
        table = F.create_map(*(x for prefix, i in own.items() for x in (F.lit(prefix), F.lit(i))))
        at = F.when(F.length("text") >= length, table[F.substring("text", 1, length)])
        number, level = F.coalesce(at, number), F.when(at.isNotNull(), F.lit(4 * length)).otherwise(level)
    following = F.substring(F.col("text"), (level / 4).cast("int") + 1, F.lit(32))
    following = F.when(number < 0, F.substring("text", 1, FIRST_PREFIX)).otherwise(following)
    return [number, following, F.xxhash64(F.substring(F.col("text"), F.lit(1), level))]


def first_rows(docs: DataFrame, part_bytes: int = PART_BYTES, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """doc_id, lang, h, n: the rows that no smaller doc_id equals, counted."""
    rows = _rows(docs).where("doc_id IS NOT NULL")
    found = rows.agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).first()
    parts, every = max(1, -(-(found["size"] or 0) // part_bytes)), max(1, found["n"] // sample_texts)

    def table(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for text, doc, langs in trie.terminals():
            out += [(text.decode(), doc, lang, n) for lang, n in langs.items()]
            held += len(text)
            if held >= 8 << 20:
                yield batch_of(out)
                out, held = [], 0
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                                           pa.array(columns[3], pa.int64())], names=["text", "doc_id", "lang", "n"])

    def merged(limit: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = RadixTrie()
            for batch in batches:
                for text, doc, lang, n in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("doc_id", "lang", "n")), strict=True):
                    trie.insert(text.as_buffer().to_pybytes(), doc, lang, n)
                    if limit and trie.bytes >= limit:
                        yield from table(trie)
                        trie = RadixTrie()
            yield from table(trie)
        return run

    schema = "text string, doc_id long, lang string, n long"
    local = rows.select("text", "doc_id", "lang", F.lit(1).cast("long").alias("n")).mapInArrow(merged(TRIE_BYTES), schema)
    dealt = local.repartitionByRange(parts, *_range_key(_prefixes(rows, every, parts))) if parts > 1 else local.repartition(1)
    return dealt.mapInArrow(merged(None), schema).select("doc_id", "lang", F.xxhash64("text").alias("h"), "n")


def mask_counts(docs: DataFrame, labels: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, mask (five bits), good, toxic, n over all documents."""
    none = F.lit(0).cast("long")
    every = masks(docs).select("doc_id", "lang", "h", "mask", F.lit(1).cast("long").alias("n"), F.when(F.col("doc_id").isNull(), 1).otherwise(0).cast("long").alias("first"))
    first = first_rows(docs, part_bytes).select("doc_id", "lang", "h", F.lit(None).cast("int").alias("mask"), none.alias("n"), F.col("n").alias("first"))
    rows = every.unionByName(first).groupBy("doc_id", "lang", "h").agg(F.max("mask").alias("mask"), F.sum("n").alias("n"), F.sum("first").alias("first"))
    given = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    # rows without a doc_id have no label: their text hashes spread them over the join's tasks
    key = (F.coalesce("doc_id", "h") == F.col("labelled")) & (F.col("doc_id").isNull() == F.col("never"))
    joined = rows.join(given.withColumn("never", F.lit(False)), key, "left")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")),
                              F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("s")
    return joined.select("lang", *flags, split).groupBy("lang", "s.mask", "good", "toxic").agg(F.sum("s.n").alias("n")).where("n > 0")


AUDIT_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
                "toxic_lost long, shapley long")
_AUDIT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in (
    "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))])


def steps_of(part: str, counts: np.ndarray) -> list[tuple]:
    """All orders and steps of a part, from counts[3][32]: documents, good ones and toxic ones by mask."""
    fails = [np.array([m >> f & 1 for m in range(32)], bool) for f in range(5)]
    out, taken = [], [0] * 5
    for order in permutations(range(5)):
        alive = np.ones(32, bool)
        for step, f in enumerate(order, 1):
            here = alive & fails[f]
            alive &= ~fails[f]
            removed, good, toxic = (int(counts[k][here].sum()) for k in range(3))
            taken[f] += removed
            out.append((part, "".join(FILTERS[g] for g in order), step, int(counts[0][alive].sum()), removed,
                        int(counts[0][fails[f]].sum()) - removed, int(counts[0][1 << f]), good, toxic, f))
    return [(*row[:-1], taken[row[-1]]) for row in out]


def audit(docs: DataFrame, labels: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per part, order of the five filters and step."""
    counts = mask_counts(docs, labels, part_bytes)
    # at most 128 short rows a part meet in its list
    parts = counts.groupBy("lang").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("counts"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = np.zeros((3, 32), np.int64)
                for c in row["counts"]:
                    table[:, c["mask"]] += c["n"] * np.array([1, c["good"], c["toxic"]])
                columns = zip(*steps_of(row["lang"], table), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _AUDIT, strict=True)], schema=_AUDIT)

    return parts.mapInArrow(expand, AUDIT_SCHEMA)
