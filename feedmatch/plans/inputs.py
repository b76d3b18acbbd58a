"""Spark DataFrames for the fixture views (FIXTURES.md part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmatch.functions.regex import SPARK
from feedmatch.session import register_tables
from feedmatch.sources import fixtures as fx

EXTRA_TYPE = ("struct<board:string,workplace_type:string,category:string,country:string,"
              "level:string,eligible_regions:array<string>>")


def _sql(spark: SparkSession, sf_dir: str, text: str, tables) -> DataFrame:
    register_tables(spark, sf_dir, tables)
    return spark.sql(text)


_BASE_TABLES = ("documents", "part", "customer", "orders", "labels")


def postings_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised postings (+ reposts); ``extra`` is empty for these sources."""
    df = _sql(spark, sf_dir, fx.postings_sql(SPARK), _BASE_TABLES)
    return df.withColumn("extra", F.lit(None).cast(EXTRA_TYPE))


def register_lines_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, fx.register_lines_sql(SPARK), ("customer",))


def seen_raw_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, fx.seen_sql(SPARK), _BASE_TABLES)


def replies_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, fx.replies_sql(SPARK), ("documents",))
