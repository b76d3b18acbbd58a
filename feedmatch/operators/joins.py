"""Join help for hot keys.

Sizes are left to the planner: it broadcasts a side by the byte size of its
files or, with AQE, of its shuffled blocks, and AQE splits the partitions of a
hot key at run time, so nothing is counted before a join.  Where a key is known
to hold a large share of the rows (one company, one fingerprint shared by many
copies), ``salted_join`` spreads it: the rows of the named keys go to ``salt``
buckets, and their few rows of the other side are replicated into each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT_BUCKETS = 64


def salted_join(big: DataFrame, dim: DataFrame, keys: list[str], hot: Column, how: str = "left",
                salt_by: Column | None = None, salt: int = SALT_BUCKETS) -> DataFrame:
    """Join ``big`` to ``dim`` (at most one row per key); ``hot`` tells, from the key columns, which keys are spread.

    ``how`` is one of inner / left / left_semi / left_anti.  ``salt_by`` is a column of ``big`` that spreads the rows of
    one key (default: a hash of all columns).
    """
    spread = salt_by if salt_by is not None else F.xxhash64(*[F.col(c) for c in big.columns])
    salted = big.withColumn("_salt", F.when(hot, F.pmod(spread, F.lit(salt))).otherwise(F.lit(0)).cast("int"))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(dim.withColumn("_salt", F.explode(copies)), [*keys, "_salt"], how).drop("_salt")
