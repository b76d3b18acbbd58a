"""Nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are scaled by the largest norm and get one more component that makes
them unit length, so the largest inner product is the smallest Euclidean
distance. Each of ``TABLES`` tables hashes with ``HASHES`` Gaussian projections
``floor((a.x + b) / WIDTH)``. A query visits, per table, its own bucket and
those whose hashes differ by one, in the order of their estimated success (the
sum of squared distances to the boundaries crossed). Candidates of all tables
are merged and ranked by their exact inner product in double precision.

The number of probes is the smallest that finds ``TARGET`` of the exact
neighbours of at most ``SAMPLE`` queries (lowest hash of vec_id), which are
compared with every row. Where all perturbations of all tables don't reach it,
the buckets are made twice as wide and the sample is compared again, until they
do. Every row is indexed.

Rows are dealt by the hash of vec_id into parts of about ``PART_ROWS``; a part
holds its own tables, so a hot bucket is spread over all parts, and queries
visit each part as a stream. A part whose buckets give a query fewer than ``k``
candidates is searched whole for it, so no query gets fewer than there are.

Defined results: vectors that are null, zero, hold null or non-finite components
or differ from the commonest length take no part, nor do rows without a
vec_id; a vec_id that is repeated counts once as a candidate (its best row) and
is no candidate of its own; ties go to the smaller vec_id; an empty table gives
no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES, HASHES, WIDTH, SEED = 8, 6, 1.5, 7
TARGET, SAMPLE = 0.96, 256
PART_ROWS, MIN_PARTS = 100_000, 12
FOUND_SCHEMA = "query_id long, vec_id long, score double, probe int"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("probe", pa.int32())])
_DELTAS = np.array(list(itertools.product((0, -1, 1), repeat=HASHES)))
FAR = np.iinfo(np.int32).max


class Tables:
    """Projections for vectors of ``dim`` components whose largest norm is ``top``."""

    def __init__(self, dim: int, top: float, width: float = WIDTH) -> None:
        rng = np.random.default_rng(SEED)
        self.top, self.width = top, width
        self.a = rng.normal(size=(TABLES, dim + 1, HASHES))
        self.b = rng.uniform(0, width, size=(TABLES, HASHES))

    def place(self, vectors: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """Whole hashes and the position inside them: rows x tables x hashes."""
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = vectors / (norms if query else self.top)
        more = np.zeros_like(norms) if query else np.sqrt(np.maximum(0, 1 - (norms / self.top) ** 2))
        at = (np.einsum("nd,tdk->ntk", np.hstack([unit, more]), self.a) + self.b) / self.width
        whole = np.floor(at)
        return whole.astype(np.int64), at - whole

    @staticmethod
    def code(hashes: np.ndarray) -> np.ndarray:
        """One number per bucket."""
        return ((hashes + 512) % 1024) @ (1024 ** np.arange(HASHES))

    @staticmethod
    def order(inside: np.ndarray) -> np.ndarray:
        """Per query and table, the perturbations in the order of their estimated success."""
        down, up = inside ** 2, (1 - inside) ** 2
        cost = down @ (_DELTAS == -1).T + up @ (_DELTAS == 1).T
        return np.argsort(cost, axis=-1, kind="stable")


def _best(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, chosen: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best of the chosen rows."""
    chosen = chosen[ids[chosen] != own]
    scores = (vectors[chosen] * query).sum(axis=1)  # row by row: equal vectors get equal scores
    keep = k
    while True:
        if keep < len(chosen):
            at = np.flatnonzero(scores >= np.partition(scores, len(scores) - keep)[len(scores) - keep])
        else:
            at = np.arange(len(chosen))
        at = at[np.lexsort((ids[chosen[at]], -scores[at]))]
        _, first = np.unique(ids[chosen[at]], return_index=True)
        first = np.sort(first)[:k]
        if len(first) == k or keep >= len(chosen):
            return chosen[at[first]], scores[at[first]]
        keep *= 4


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vec (doubles), norm2 of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    bad: Column = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND vec IS NOT NULL").where(F.size("vec") > 0).where(~bad)
    rows = rows.withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).where("norm2 > 0")
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (size["n"] if size else 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
            probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for every row where ``is_query`` (over column vec_id) holds."""
    spark = vectors.sparkSession
    rows = _usable(vectors, vec_id, embedding)
    stats = rows.agg(F.count("*").alias("n"), F.max("norm2").alias("top"), F.max(F.size("vec")).alias("dim")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tables, dim = Tables(stats["dim"], float(stats["top"]) ** 0.5), stats["dim"]
    parts = max(MIN_PARTS, -(-stats["n"] // PART_ROWS))
    data = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "vec_id", "vec")

    def asked(queries: DataFrame) -> DataFrame:
        copies = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "vec_id", "vec")
        return data.union(copies).repartition(parts, "part").sortWithinPartitions("part", "kind", "vec_id")

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def search(limit: int | None, tables: Tables):
        """Answers the queries of each part; without a limit all rows are compared and the probe that finds each is told."""

        def answer(ids, vecs, index, batch) -> pa.RecordBatch:
            queries, names = matrix(batch), batch.column("vec_id").to_numpy()
            whole, inside = tables.place(queries, True)
            order = tables.order(inside)
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, own in enumerate(names.tolist()):
                chosen = np.arange(len(ids))
                if limit is not None:
                    mark = np.zeros(len(ids), bool)
                    for t, (codes, begins, ends, rows_of, _) in enumerate(index):
                        want = tables.code(whole[i, t] + _DELTAS[order[i, t, :limit]])
                        at = np.minimum(np.searchsorted(codes, want), max(0, len(codes) - 1))
                        for at_one in at[codes[at] == want] if len(codes) else ():
                            mark[rows_of[begins[at_one]:ends[at_one]]] = True
                    if mark.sum() - mark[ids == own].sum() >= k:
                        chosen = np.flatnonzero(mark)
                got, scores = _best(queries[i], own, ids, vecs, chosen, k)
                probe = np.full(len(got), FAR)
                if limit is None:
                    for t, (*_, hashes) in enumerate(index):
                        apart = hashes[got] - whole[i, t]
                        codes = np.sort(tables.code(_DELTAS))
                        position = np.empty(len(_DELTAS), np.int64)
                        position[np.searchsorted(codes, tables.code(_DELTAS[order[i, t]]))] = np.arange(len(_DELTAS))
                        near = (np.abs(apart) <= 1).all(axis=1)
                        probe[near] = np.minimum(probe[near], position[np.searchsorted(codes, tables.code(apart[near]))])
                for column, value in zip(out, (np.full(len(got), own), ids[got], scores, probe), strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held, index = None, [], None
            ids, vecs = np.zeros(0, np.int64), np.zeros((0, dim))
            for batch in batches:
                labels = batch.column("part").to_numpy() * 2 + batch.column("kind").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
                for lo, hi in itertools.pairwise(cuts):
                    if lo == hi:
                        continue
                    piece, (at, kind) = batch.slice(lo, hi - lo), divmod(int(labels[lo]), 2)
                    if at != part:
                        part, held, index = at, [], None
                    if kind == 0:
                        held.append((piece.column("vec_id").to_numpy(), matrix(piece)))
                        continue
                    if index is None:
                        ids = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.int64)
                        vecs = np.concatenate([h[1] for h in held]) if held else np.zeros((0, dim))
                        index, hashes = [], tables.place(vecs, False)[0]
                        for t in range(TABLES):
                            code = tables.code(hashes[:, t])
                            rows_of = np.argsort(code, kind="stable")
                            codes, begins = np.unique(code[rows_of], return_index=True)
                            index.append((codes, begins, np.append(begins[1:], len(code)), rows_of, hashes[:, t]))
                    yield answer(ids, vecs, index, piece)

        return run

    def merged(found: DataFrame) -> DataFrame:
        one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("probe").alias("probe"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return one.withColumn("rank", rank).where(F.col("rank") <= k)

    queries = rows.where(is_query).select("vec_id", "vec")
    if probes is None:
        sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
        while True:  # ends: in wide enough buckets all hashes differ by one at most
            need = merged(asked(sample).mapInArrow(search(None, tables), FOUND_SCHEMA)).select("probe").toArrow()["probe"].to_numpy()
            reach = int(np.sort(need)[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) if len(need) else 0
            if reach < FAR:
                break
            tables = Tables(dim, tables.top, 2 * tables.width)
        probes = min(reach + 1, len(_DELTAS))
    return merged(asked(queries).mapInArrow(search(probes, tables), FOUND_SCHEMA)).select("query_id", "rank", "vec_id", "score")
