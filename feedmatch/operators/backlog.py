"""A durable queue of ranked rows (STR-03, SRT-03).

Each append writes its rows once, in segments: ranges of rank, one file folder
each.  A manifest per version says of every segment its first and last rank,
how many rows are left and the rank up to which it has been taken.  Taking the
best ``cap`` rows opens only the segments that can hold them: the manifest
gives a rank below which enough rows lie, and segments that begin behind it
stay closed.  What is taken from a segment is always its front, so taking
rewrites the manifest alone; held rows are never rewritten, whatever their
number.  ``take`` and ``append`` write version n + 1 from version n, so a batch
that is run again gives the same rows.

``rank`` must be a total order over all rows ever appended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from feedmatch.operators.digest import ranked_positions
from feedmatch.session import cut_lineage


class RankedQueue:
    """Rows of ``schema`` below ``root``, in the order of ``rank()``."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, rank: Callable[[], Column]) -> None:
        self.spark, self.root, self.schema, self.rank = spark, root.rstrip("/"), schema, rank
        ranked = spark.createDataFrame([], schema).select(rank().alias("rank"))
        kind = ranked.schema["rank"].dataType.simpleString()
        self.listed = f"batch int, seg int, first {kind}, last {kind}, taken {kind}, left bigint"

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.listed).parquet(f"{self.root}/manifest/v={version}")

    def left(self, version: int) -> int:
        """Rows still held, from the manifest alone."""
        return self._manifest(version).agg(F.coalesce(F.sum("left"), F.lit(0))).first()[0]

    def step(self, version: int, new: DataFrame | None, cap: int) -> DataFrame:
        """Version ``version``: the queue of the version before with ``new`` appended and its best ``cap`` rows taken, which
        are returned with their ``position``."""
        held = self._manifest(version - 1) if version else self.spark.createDataFrame([], self.listed)
        if new is not None:
            held = held.unionByName(self._append(version, new))
        held = cut_lineage(held.filter("left > 0"))  # a row per segment
        # The least rank up to which whole segments hold enough rows; segments that begin behind it are not needed.
        counted = held.withColumn("_n", F.sum("left").over(Window.orderBy("last", "batch", "seg")))
        bound = counted.filter(F.col("_n") >= cap).agg(F.min("last").alias("bound"))
        needed = held.join(F.broadcast(bound), F.col("bound").isNull() | (F.col("first") <= F.col("bound")))
        top = cut_lineage(self._rows(needed).orderBy("_rank").limit(cap)
                              .withColumn("position", F.row_number().over(Window.orderBy("_rank"))))
        used = top.groupBy("_batch", "_seg").agg(F.max("_rank").alias("_upto"), F.count(F.lit(1)).alias("_used"))
        after = held.join(used, (F.col("batch") == F.col("_batch")) & (F.col("seg") == F.col("_seg")), "left").select(
            "batch", "seg", "first", "last", F.coalesce("_upto", "taken").alias("taken"),
            (F.col("left") - F.coalesce("_used", F.lit(0))).alias("left"))
        after.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")
        return top.drop("_rank", "_batch", "_seg")

    def drain(self, version: int, cap: int) -> DataFrame:
        """What the steps after ``version`` take when nothing more is appended: all held rows with their ``step`` (1, 2, ...) and
        ``position`` in it, numbered in one distributed pass."""
        rows = ranked_positions(self._rows(self._manifest(version).filter("left > 0")).drop("_batch", "_seg"), F.col("_rank")).drop("_rank")
        number = F.col("position") - 1
        return rows.withColumns({"step": (F.floor(number / cap) + 1).cast("int"), "position": (number % cap + 1).cast("int")})

    def _append(self, version: int, new: DataFrame) -> DataFrame:
        """Write the rows in ranges of rank; returns their manifest rows."""
        path = f"{self.root}/rows/batch={version}"
        dealt = new.select(*self.schema.names).withColumn("_rank", self.rank()).repartitionByRange("_rank").withColumn("seg", F.spark_partition_id())
        dealt.sortWithinPartitions("_rank").drop("_rank").write.mode("overwrite").partitionBy("seg").parquet(path)
        written = self.spark.read.schema(StructType(list(self.schema.fields)).add("seg", IntegerType())).parquet(path).withColumn("_rank", self.rank())
        segments = written.groupBy("seg").agg(F.min("_rank").alias("first"), F.max("_rank").alias("last"), F.count(F.lit(1)).alias("left"))
        none = F.lit(None).cast(self.spark.createDataFrame([], self.listed).schema["taken"].dataType)
        return segments.select(F.lit(version).alias("batch"), "seg", "first", "last", none.alias("taken"), "left")

    def _rows(self, segments: DataFrame) -> DataFrame:
        """Rows of segments that have not been taken, with _rank, _batch and _seg; other segments are not opened."""
        listed = [(r["batch"], r["seg"]) for r in segments.select("batch", "seg").collect()]
        fields = StructType(list(self.schema.fields)).add("batch", IntegerType()).add("seg", IntegerType())
        if not listed:
            rows = self.spark.createDataFrame([], fields)
        else:
            paths = [f"{self.root}/rows/batch={b}/seg={s}" for b, s in sorted(listed)]
            rows = self.spark.read.schema(fields).option("basePath", f"{self.root}/rows").parquet(*paths)
        taken = segments.select(F.col("batch").alias("_batch"), F.col("seg").alias("_seg"), "taken")
        met = rows.withColumn("_rank", self.rank()).join(F.broadcast(taken), (F.col("batch") == F.col("_batch")) & (F.col("seg") == F.col("_seg")))
        return met.filter(F.col("taken").isNull() | (F.col("_rank") > F.col("taken"))).select(*self.schema.names, "_rank", "_batch", "_seg")
