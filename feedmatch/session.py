"""Session construction and table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from feedmatch.sources.fixtures import TABLES

# Settings the library relies on.  AQE re-plans joins from runtime sizes and
# splits skewed shuffle partitions; UTC makes naive instants agree with the
# oracle; the UI stays off (no server).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Local mode runs executors inside the driver JVM.
    "spark.driver.memory": "16g",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "feedmatch", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Read from the session; only when it is unset (local tests) a scratch folder
    is created and registered.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="feedmatch-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame reliably (survives executor loss) and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder.  What is written there stays until whoever runs the job clears the folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Materialise a DataFrame as a Parquet table and read it back: as durable as a checkpoint, narrower for what reads some of
    its columns, and of a size that the planner knows when it picks joins."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_REGISTERED: dict[tuple[str, str], str] = {}


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the driver's parquet tables as temp views of the same names.

    A view is (re)registered only when it is missing or points at another
    directory, so repeated calls cost no file listing.
    """
    for name in names:
        key = (spark.sparkContext.applicationId, name)
        if _REGISTERED.get(key) == sf_dir and spark.catalog.tableExists(name):
            continue
        try:
            spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").createOrReplaceTempView(name)
        except AnalysisException as e:  # a folder may lack tables that no query at hand needs
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            _REGISTERED[key] = sf_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
