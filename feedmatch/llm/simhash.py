"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: words split at ASCII white space, A-Z lower-cased, shingles of
``shingle`` words (repeats count), XXH64 seed 42 of each; a bit is set if it is
set in over half of the hashes.

Join: of ``max_bits + 1`` blocks of the 64 bits, two fingerprints within
``max_bits`` agree on one at least. For each block the bits are rotated so that
it leads; fingerprints with equal leading blocks are one subtrie. A task walks
pairs of its nodes together from the subtrie's root, adds up the bits in which
the branches differ, drops a pair once they exceed ``max_bits`` and compares
the fingerprints under small pairs directly. Pairs of nodes whose fingerprints
are all connected already are dropped as well, so a dense group costs links,
not pairs, and a task returns a spanning forest. Distinct fingerprints only are
joined; subtries above ``bucket_rows`` are dealt into units of two hashed parts
each, so no task holds a whole hot one.

Defined results: null and empty texts have the zero fingerprint and are linked
like any other; a text of fewer words than a shingle is one shingle; rows that
repeat a doc_id each get a row; a null doc_id takes part, but names no
component unless all its members are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from feedmatch.llm.components import components
from feedmatch.llm.scratch import stored

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Fingerprints of one subtrie that one task takes.
BUCKET_ROWS = 1 << 16
#: Rotated fingerprints of a task, about.
TASK_ROWS = 1 << 20
#: Node pairs that are walked at a time, and pairs of fingerprints under a node pair that are compared at once.
WALK, DIRECT = 50_000, 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:n - 1]]).tolist()
    stops = (ends[len(words) - n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


#: What tells the rows of documents apart; null ids come last.
KEY = ("no_id", "id", "text_1", "text_2")


def _key() -> dict[str, Column]:
    doc_id = F.col("doc_id").cast("long")
    return dict(zip(KEY, (doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), F.xxhash64("text"), F.hash("text")), strict=True))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The key of each row and fp, the fingerprint's bits as a long."""
    schema = pa.schema([("no_id", pa.bool_()), ("id", pa.int64()), ("text_1", pa.int64()), ("text_2", pa.int32()), ("fp", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*map(batch.column, KEY), pa.array(fps.view(np.int64))], schema=schema)

    keyed = docs.select(*(c.alias(name) for name, c in _key().items()), "text")
    return keyed.mapInArrow(rows, "no_id boolean, id long, text_1 long, text_2 int, fp long")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(offset from the highest bit, width) of the blocks."""
    n = max_bits + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j; every node points at its root afterwards."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def trie_forest(keys: np.ndarray, group: np.ndarray, depth: int, max_bits: int) -> np.ndarray:
    """Root position of each key, where keys of a group within ``max_bits`` are connected.

    ``keys``: unsigned 64-bit, sorted within equal ``group`` (itself sorted);
    keys of a group agree on their first ``depth`` bits.
    """
    n = len(keys)
    parent = np.arange(n)
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    last = np.append(new[1:], n)
    near = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(keys[1:] ^ keys[:-1]) <= max_bits))
    _union(parent, near, near + 1)

    def split(lo: np.ndarray, hi: np.ndarray, at: int) -> np.ndarray:
        """Where bit ``at`` turns to one within each range."""
        a, b = lo.copy(), hi.copy()
        while (a < b).any():
            mid = (a + b) // 2
            one = (keys[np.minimum(mid, n - 1)] >> np.uint64(63 - at)) & np.uint64(1) == 1
            go = a < b
            b = np.where(go & one, mid, b)
            a = np.where(go & ~one, mid + 1, a)
        return a

    stack = [(depth, new, last, new, last, np.zeros(len(new), np.int8))]
    while stack:
        at, a0, a1, b0, b1, errors = stack.pop()
        if len(a0) > WALK:
            stack += [(at, *(x[lo:lo + WALK] for x in (a0, a1, b0, b1, errors))) for lo in range(0, len(a0), WALK)]
            continue
        # pairs that hold nothing new: one leaf with itself, or one component throughout
        changes = np.cumsum(np.concatenate([[0], parent[1:] != parent[:-1]]))
        open_ = ~((changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (parent[a0] == parent[b0]))
        a0, a1, b0, b1, errors = (x[open_] for x in (a0, a1, b0, b1, errors))
        small = ((a1 - a0) * (b1 - b0) <= DIRECT) | (at == 64)
        if small.any():
            wide, high = (b1 - b0)[small], ((a1 - a0) * (b1 - b0))[small]
            of = np.repeat(np.arange(len(high)), high)
            step = np.arange(len(of)) - np.repeat(np.cumsum(high) - high, high)
            i, j = a0[small][of] + step // wide[of], b0[small][of] + step % wide[of]
            ok = np.bitwise_count(keys[i] ^ keys[j]) <= max_bits
            _union(parent, i[ok], j[ok])
        a0, a1, b0, b1, errors = (x[~small] for x in (a0, a1, b0, b1, errors))
        if not len(a0):
            continue
        am, bm = split(a0, a1, at), split(b0, b1, at)
        twin = a0 == b0
        more = (errors + 1).astype(np.int8)
        parts = [(a0, am, b0, bm, errors, True), (am, a1, bm, b1, errors, True), (a0, am, bm, b1, more, True), (am, a1, b0, bm, more, ~twin)]
        keep = [(p[1] > p[0]) & (p[3] > p[2]) & (p[4] <= max_bits) & p[5] for p in parts]
        stack.append((at + 1, *(np.concatenate([p[x][k] for p, k in zip(parts, keep, strict=True)]) for x in range(5))))
    return parent


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS, node: str = "fp", n_rows: int = 0) -> DataFrame:
    """A spanning set of links (u, v) between distinct fingerprints ``fp`` within ``max_bits``, named by column ``node``.

    ``n_rows`` (at least the number of rows) sets how many tasks share the work, if the session's partitions are too few.
    """
    spark, blocks = fps.sparkSession, _blocks(max_bits)
    turned = F.array(*(F.struct(F.lit(k).alias("block"), (F.shiftleft("fp", a).bitwiseOR(F.shiftrightunsigned("fp", 64 - a)) if a else F.col("fp")).alias("key"))
                       for k, (a, _) in enumerate(blocks)))
    width = F.element_at(F.array(*(F.lit(w) for _, w in blocks)), F.col("block") + 1)
    rows = fps.select(F.explode(turned).alias("x"), F.col(node).alias("node")).select("x.block", "x.key", "node")
    rows = rows.withColumn("value", F.call_function("shiftrightunsigned", F.col("key"), (64 - width).cast("int")))
    # At most one row per block and value: 2**13 values in 5 blocks at 4 bits.
    hot = rows.groupBy("block", "value").count().where(F.col("count") > bucket_rows)
    hot = hot.select("block", "value", F.ceil(F.col("count") / bucket_rows).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(hot), ["block", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = dealt.select("block", "value", "key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("block", "value", "key", "node", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        block, value, one, two, key = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("block", "value", "one", "two", "key"))
        key, names = key.view(np.uint64), pa.concat_arrays([b.column("node") for b in held])
        order = np.lexsort((key, two, one, value, block))
        block, value, one, two, key = (x[order] for x in (block, value, one, two, key))
        new = (block[1:] != block[:-1]) | (value[1:] != value[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        group = np.concatenate([[0], np.cumsum(new)])
        for k, (_, bits) in enumerate(blocks):
            lo, hi = np.searchsorted(block, [k, k + 1])
            if lo == hi:
                continue
            root = trie_forest(key[lo:hi], group[lo:hi], bits, max_bits)
            tied = np.flatnonzero(root != np.arange(hi - lo))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(order[lo + tied])), names.take(pa.array(order[lo + root[tied]]))], names=["u", "v"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows * len(blocks) // TASK_ROWS))
    kind = fps.schema[node].dataType
    return dealt.repartition(parts, "block", "value", "one", "two").mapInArrow(walk, StructType([StructField("u", kind), StructField("v", kind)]))


def _rooted(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root) of each distinct fingerprint: the smallest row key of its component.

    Fingerprints go by their smallest row key, so the smallest node that can be reached is the component's name already and
    nothing is gathered by component.
    """
    distinct = fps.groupBy("fp").agg(F.min(F.struct(*KEY)).alias("first"))
    found = components(links(distinct, max_bits, node="first", n_rows=fps.count()))
    return distinct.join(found.withColumnRenamed("node", "first"), "first", "left").select("fp", F.coalesce("root", "first").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    of = _rooted(fps, max_bits).select("fp", F.expr("if(root.no_id, null, root.id)").alias("component_id"))
    return fps.join(of, "fp").select(F.expr("if(no_id, null, id)").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document per component: the smallest doc_id, null ids last, then the smallest text hash; of rows equal in both, one."""
    kept = _rooted(stored(fingerprints(docs, shingle), "fingerprints"), max_bits).select("root").distinct()
    names = {name: f"_kept_{name}" for name in KEY}
    kept = kept.select(*(F.col(f"root.{name}").alias(to) for name, to in names.items()))
    rows = docs.withColumns({names[name]: c for name, c in _key().items()}).join(kept, list(names.values()))
    return rows.dropDuplicates(list(names.values())).select(*docs.columns)
