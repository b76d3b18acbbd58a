"""Segmented prefix sums without a window over a whole group (WIN-04, WIN-05, SRC-15).

A running sum per group is usually a window over the group, which gathers a hot
group in one task.  Here (group, order) ranges are dealt to tasks, whatever the
group: each range sums its own rows, the totals of the ranges of one group are
summed again (at most one row per range and group), and only what is carried
into a range from the ranges before it is joined back.  A range begins inside
at most one group, so there are no more carried rows than ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmatch.session import cut_lineage


def prefix_sums(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the inclusive running sum of each of ``sums`` within its group, and its total as ``<name>_total``.

    ``order`` must be total within a group for a defined result (rows of equal order take turns as they come).
    Null groups are groups of their own; a null summand counts as zero.
    """
    keys = [F.struct(*group).alias("_g"), F.struct(*order).alias("_o")]
    values = {n: F.coalesce(v, F.lit(0)).cast("bigint").alias(f"_{n}") for n, v in sums.items()}
    # Written once: every pass below must see the same ranges, also after an executor is lost.
    dealt = cut_lineage(rows.select("*", *keys, *values.values()).repartitionByRange("_g", "_o").withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_g", "_part").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_g", "_part")
    own = dealt.withColumns({n: F.sum(f"_{n}").over(within) for n in sums} | {f"{n}_total": F.sum(f"_{n}").over(whole) for n in sums})
    # The ranges that share a group: at most two groups of each range reach over its ends.
    totals = dealt.groupBy("_g", "_part").agg(*(F.sum(f"_{n}").alias(n) for n in sums))
    parts = Window.partitionBy("_g")
    before = parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shared = totals.withColumn("_n", F.count(F.lit(1)).over(parts)).select(
        "_g", "_part", "_n", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums),
        *(F.sum(n).over(parts).alias(f"_all_{n}") for n in sums)).filter("_n > 1").drop("_n")
    joined = own.alias("a").join(F.broadcast(shared.alias("b")), (F.col("a._part") == F.col("b._part")) & F.col("a._g").eqNullSafe(F.col("b._g")), "left")
    out = [F.col(f"a.`{c}`") for c in rows.columns]
    out += [(F.col(f"a.{n}") + F.coalesce(f"_before_{n}", F.lit(0))).alias(n) for n in sums]
    out += [F.coalesce(f"_all_{n}", F.col(f"a.{n}_total")).alias(f"{n}_total") for n in sums]
    return joined.select(*out)
