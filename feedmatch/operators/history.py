"""The seen history as stored tables with an identity filter (SNK-01, SNK-05, JN-02).

Beside the history's rows (a ``KeyedStore`` by job key) lies an index of their
identities (a ``KeyedStore`` by kind and value), and beside that a blocked
Bloom filter over the index: each identity sets four bits in one block of 256,
all in the same row of a small table, so building is one partial aggregation
(``bit_or``) and testing one equi-join on the block.  The anti-join tests a
batch's identities against the filter first; only what may have been seen goes
on to the exact semi-join, and only the index buckets that hold such
identities are opened.  A false positive costs a row in that join, never a
wrong answer.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmatch.operators import dedupe as D
from feedmatch.operators import state as S
from feedmatch.operators.store import BUCKETS, KeyedStore
from feedmatch.session import cut_lineage

#: Filter blocks for each index bucket of a store that is made empty, and identities in a block of 256 bits of one that is not.
EMPTY_BLOCKS = 64
PER_BLOCK = 24
_KEY = ["kind", "value", "job_key"]


def identity_rows(rows: DataFrame) -> DataFrame:
    """Distinct (kind, value, job_key) of ``rows``."""
    return D.identities(rows, "job_key").select("kind", "value", F.col("id").alias("job_key")).distinct()


def _bits() -> list[Column]:
    """One bit of an identity in each of a block's four words."""
    h = F.xxhash64("kind", "value", F.lit("bits"))
    places = [F.pmod(F.shiftright(h, 12 * k), F.lit(64)).cast("int") for k in range(4)]
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), p) for p in places]


class IdentityIndex:
    """The identities of known postings below ``root``: an exact index, and a filter in front of it.

    The filter's size is the index bucket's for life: ``create`` sizes it by the identities it finds.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.exact = KeyedStore(spark, f"{root}/exact", "kind string, value string, job_key string", ("kind", "value"), buckets)
        self.filter = KeyedStore(spark, f"{root}/filter", "part int, block bigint, blocks bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint", ("part",), buckets)

        self._blocks: int | None = None

    @property
    def blocks(self) -> int:
        """Filter blocks of an index bucket, as the store was made."""
        if self._blocks is None:
            self._blocks = self.filter.read(version=0).agg(F.max("blocks")).first()[0] or EMPTY_BLOCKS
        return self._blocks

    def create(self, identities: DataFrame, per_block: int = PER_BLOCK) -> IdentityIndex:
        self.exact.create(identities)
        n = self.exact.count(0)
        self._blocks = max(1, -(-n // (per_block * self.exact.buckets))) if n else None
        self.filter.create(self._filter_of(self.exact.read(version=0), self._blocks or EMPTY_BLOCKS))
        return self

    def _filter_of(self, identities: DataFrame, blocks: int) -> DataFrame:
        bits = [b.alias(f"b{k}") for k, b in enumerate(_bits())]
        return (identities.select(self.exact.bucket().alias("part"), self._block(blocks).alias("block"), *bits)
                          .groupBy("part", "block").agg(*(F.bit_or(f"b{k}").alias(f"b{k}") for k in range(4)))
                          .withColumn("blocks", F.lit(blocks).cast("bigint")))

    @staticmethod
    def _block(blocks: int) -> Column:
        return F.pmod(F.xxhash64("kind", "value", F.lit("block")), F.lit(blocks))

    def possible(self, identities: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of ``identities`` (with kind and value) that the filter cannot rule out, with their index bucket ``part``."""
        ours = identities.withColumns({"part": self.exact.bucket(), "block": self._block(self.blocks)}
                                      | {f"w{k}": b for k, b in enumerate(_bits())})
        met = ours.join(self.filter.read(version=version).drop("blocks"), ["part", "block"])
        for k in range(4):
            met = met.filter(F.col(f"b{k}").bitwiseAND(F.col(f"w{k}")) != 0)
        return met.select(*identities.columns, "part")

    def anti_known(self, postings: DataFrame, id_col: str = "ord", version: int | None = None) -> DataFrame:
        """JN-02: postings none of whose identities is known; index buckets without a possible hit are not opened."""
        maybe = cut_lineage(self.possible(D.identities(postings, id_col), version))
        parts = sorted(r[0] for r in maybe.select("part").distinct().collect())  # at most as many as buckets
        exact = self.exact.read(parts, version).select("kind", "value").distinct()
        hit = maybe.join(exact, ["kind", "value"], "left_semi")
        return postings.join(hit.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")

    def change(self, added: DataFrame, removed: DataFrame | None = None, version: int | None = None) -> None:
        """The next version: without ``removed``, with ``added`` (kind, value, job_key); only touched buckets are written."""
        rows = added.select(*_KEY).withColumn("gone", F.lit(False))
        if removed is not None:
            rows = rows.unionByName(removed.join(added, _KEY, "left_anti").select(*_KEY).withColumn("gone", F.lit(True)))
        rows, blocks = cut_lineage(rows), self.blocks

        def changed(old: DataFrame) -> DataFrame:
            return old.join(rows.filter("gone"), _KEY, "left_anti").unionByName(rows.filter("NOT gone").select(*_KEY)).distinct()

        version = self.exact.version() if version is None else version
        parts = self.exact.rewrite(self.exact.touched(rows), changed, version)
        fresh = self._filter_of(self.exact.read(parts, version + 1), blocks)
        numbers = self.spark.createDataFrame([(p,) for p in parts], "part int")
        # a bucket of the filter holds the blocks of several index buckets: those of untouched ones stay in it
        self.filter.rewrite(self.filter.touched(numbers), lambda old: old.join(F.broadcast(numbers), "part", "left_anti").unionByName(fresh), version)


class SeenHistory:
    """The history below ``root``: its rows by job key, and the index of their identities."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        types = {"first_seen": "timestamp_ntz", "last_seen": "timestamp_ntz", "notified": "int"}
        schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in S.SEEN_COLUMNS)
        self.spark = spark
        self.rows = KeyedStore(spark, f"{root}/rows", schema, ("job_key",), buckets)
        self.index = IdentityIndex(spark, f"{root}/index", buckets)

    def create(self, seen: DataFrame, per_block: int = PER_BLOCK) -> SeenHistory:
        """Version 0 from a snapshot (one row per job_key; an older snapshot may lack columns)."""
        self.rows.create(S.normalise_seen(seen))
        self.index.create(identity_rows(self.rows.read(version=0)), per_block)
        return self

    def anti_seen(self, postings: DataFrame, id_col: str = "ord") -> DataFrame:
        """JN-02 against the stored history."""
        return self.index.anti_known(postings, id_col)

    def upsert(self, new: DataFrame, now: datetime, notified: bool) -> list[int]:
        """SNK-01: merge one row per job_key; returns the rewritten buckets of the rows.

        The index goes first, so a job that dies in between knows too many identities of rows that it is about to store,
        never too few; run again, it completes both.
        """
        new = cut_lineage(new)
        buckets = self.rows.touched(new)
        old = self.rows.read(buckets).join(new.select("job_key"), "job_key", "left_semi")
        self.index.change(identity_rows(S.upsert_seen(old, new, now, notified)), identity_rows(old))
        return self.rows.rewrite(buckets, lambda stored: S.upsert_seen(stored, new, now, notified))
