"""Copy-on-write tables by key bucket (SNK-01, SNK-02, SNK-04).

A store is a folder of versions.  Rows lie in ``data/v=<n>/bucket=<b>``, where
the bucket is a hash of the key; ``manifest/v=<n>`` says which version holds
each bucket and with how many rows.  An update reads and rewrites only the
buckets that its rows fall into and writes a manifest that points at the old
files for all others.  A version exists once its manifest is committed, which
Spark's committer does at once, so a job that dies leaves the version before
it; files of a version without a manifest are never read.  Everything goes
through Spark's readers and writers, so the folder may be in any store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 64
_MANIFEST = "v int, bucket int, held int, rows bigint"


class KeyedStore:
    """A versioned table whose rows lie in ``buckets`` buckets by a hash of ``key``.

    ``buckets`` is the store's for life: size it for the rows that it will hold (a bucket is what an update rewrites).
    Reads and updates go from the latest version, or from the one named, so a job that is run again on the version it
    first saw writes the same next version over its own.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: tuple[str, ...], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema: StructType = spark.createDataFrame([], schema).schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _manifest(self, version: int | None = None) -> DataFrame:
        found = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest")
        return found.filter(F.col("v") == (self.version() if version is None else version)).filter("bucket >= 0")

    def version(self) -> int:
        """The latest committed version."""
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest").agg(F.max("v")).first()[0]

    def held(self, version: int | None = None) -> dict[int, int]:
        """The version whose files hold each bucket (at most ``buckets`` entries)."""
        return {r["bucket"]: r["held"] for r in self._manifest(version).collect()}

    def count(self, version: int | None = None) -> int:
        """SNK-06: rows of a version, from its manifest alone."""
        return self._manifest(version).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def read(self, only: list[int] | None = None, version: int | None = None) -> DataFrame:
        """Rows of a version, of some buckets (all); other buckets' files are not opened."""
        return self._files({b: v for b, v in self.held(version).items() if only is None or b in set(only)})

    def _files(self, held: dict[int, int]) -> DataFrame:
        """Rows of the given buckets, each from the version that holds it."""
        if not held:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def create(self, rows: DataFrame) -> KeyedStore:
        """Version 0: all of ``rows``, which have one row per key."""
        self._commit(rows, 0, {})
        return self

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that the keys of ``rows`` fall into."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def update(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> list[int]:
        """The next version, in which ``merge(old, new)`` replaces the buckets that ``new`` touches; returns those."""
        return self.rewrite(self.touched(new), lambda old: merge(old, new), version)

    def rewrite(self, only: list[int], change: Callable[[DataFrame], DataFrame], version: int | None = None) -> list[int]:
        """The next version, in which ``change(old rows)`` replaces the buckets ``only``; the others keep their files."""
        version = self.version() if version is None else version
        held = self.held(version)
        old = self._files({b: v for b, v in held.items() if b in set(only)})
        self._commit(change(old), version + 1, {b: v for b, v in held.items() if b not in set(only)})
        return only

    def _commit(self, rows: DataFrame, version: int, kept: dict[int, int]) -> None:
        data = f"{self.root}/data/v={version}"
        dealt = rows.select(*self.schema.names).withColumn("bucket", self.bucket()).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(data)  # over what a job that died left
        written = self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(data)
        own = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).select("bucket", F.lit(version).alias("held"), "rows")
        none = self.spark.createDataFrame([(-1, -1, 0)], "bucket int, held int, rows bigint")  # a version without rows exists, too
        own = own.unionByName(none)
        if kept:
            before = self._manifest(version - 1).filter(F.col("bucket").isin(sorted(kept)))
            own = own.unionByName(before.select("bucket", "held", "rows"))
        own.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")
