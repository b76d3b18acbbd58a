"""Partition sizing for CPU-heavy text work.

The text rules cost far more CPU per byte than a scan, so an input read as a
handful of splits (one parquet row group holds a whole small file) would run
on a handful of cores.  ``ensure_parallelism`` hash-spreads such an input over
the cluster's cores; an input of at least that many files, as any large table
is, is returned untouched (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS_PER_CORE = 2


def ensure_parallelism(df: DataFrame, *keys: str, per_core: int = SPLITS_PER_CORE) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    target = cores * per_core
    if len(df.inputFiles()) >= target:  # file listing only: planning starts no job
        return df
    # Hash on a stable key (deterministic on task retry); fall back to all columns.
    cols = [F.col(k) for k in keys] if keys else [F.xxhash64(*[F.col(c) for c in df.columns])]
    return df.repartition(target, *cols)
