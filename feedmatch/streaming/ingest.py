"""Incremental ingest (STR-01, STR-03, STR-04).

The daily run becomes a Structured Streaming query over landed files with
``trigger(availableNow=True)``: each run processes what arrived since the last
one and stops.  Repeat downloads of the same key are dropped cheaply with a
watermark on the fetch time and ``dropDuplicatesWithinWatermark``; each
micro-batch is appended by ``foreachBatch`` into a table folder, idempotent
per batch id, so a retried batch does not write twice.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmatch.session import checkpoint_dir


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def instant(naive: Column) -> Column:
    """A naive UTC time as the instant that watermarks need, whatever the session's time zone."""
    days = F.datediff(naive, F.expr(_EPOCH)).cast("bigint")
    minutes = days * 1440 + F.hour(naive) * 60 + F.minute(naive)
    return F.timestamp_micros(minutes * 60_000_000 + (F.extract(F.lit("SECOND"), naive) * 1_000_000).cast("bigint"))


def ingest_dedupe(spark: SparkSession, source_path: str, schema, key: str, time_col: str,
                  out_dir: str, delay: str = "1 day", fmt: str = "parquet") -> DataFrame:
    """Run one availableNow pass from the folder ``source_path`` into ``out_dir``; return the table."""
    reader = spark.readStream.schema(schema).format(fmt)
    stream = (reader.load(source_path)
                   .withColumn("_event_time", instant(F.col(time_col)))
                   .withWatermark("_event_time", delay)
                   .dropDuplicatesWithinWatermark([key]))

    def write(batch: DataFrame, batch_id: int) -> None:
        target = os.path.join(out_dir, f"batch={batch_id}")
        # Idempotent per batch: a retried batch overwrites its own folder only.
        batch.drop("_event_time").write.mode("overwrite").parquet(target)

    state = os.path.join(checkpoint_dir(spark), "streams", os.path.basename(out_dir.rstrip("/")))
    query = (stream.writeStream.foreachBatch(write)
                   .option("checkpointLocation", state)
                   .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out_dir)


def tumbling_counts(df: DataFrame, time_col: str, keys, width: str = "1 day") -> DataFrame:
    """STR-05: counts per tumbling window and key; the same expression runs on a
    batch DataFrame or on a stream (append mode after ``withWatermark``)."""
    # window() takes TIMESTAMP_NTZ as is: boundaries stay on the UTC wall clock
    # whatever the session time zone.
    return (df.groupBy(F.window(F.col(time_col), width).alias("w"), *keys)
              .agg(F.count(F.lit(1)).alias("n"))
              .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "n"))


def windowed_health(responses: DataFrame, time_col: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """STR-05: the health of each source per window of landed responses (source, status, n_records, n_mapped and a naive UTC time).

    The same plan serves a batch and a stream.  On a stream a window is given out once, in append mode, when the watermark
    has passed its end; a response later than that counts nowhere.
    """
    rows = responses.withColumn("_at", instant(F.col(time_col)))
    if responses.isStreaming:
        rows = rows.withWatermark("_at", delay)
    ok = F.col("status") < 400
    of = lambda c: F.sum(F.when(ok, c).otherwise(0)).cast("bigint")
    return (rows.groupBy(F.window("_at", width).alias("w"), "source")
                .agg(F.count(F.lit(1)).alias("responses"), F.count_if(~ok).alias("failed"), of(F.col("n_mapped")).alias("fetched"),
                     of(F.col("n_records") - F.col("n_mapped")).alias("skipped"))
                .select(F.unix_micros("w.start").alias("start_micros"), "source", "responses", "failed", "fetched", "skipped",
                        ((F.col("failed") == 0) & (F.col("skipped") == 0)).alias("healthy")))


def land_windowed_health(spark: SparkSession, landing: str, schema, time_col: str, out: str, **windows) -> DataFrame:
    """One availableNow pass over what landed since the last one; the table of all windows closed so far."""
    health = windowed_health(spark.readStream.schema(schema).parquet(landing), time_col, **windows)
    query = (health.writeStream.outputMode("append").format("parquet").option("path", f"{out}/windows")
                   .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(health.schema).parquet(f"{out}/windows")
