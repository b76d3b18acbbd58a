"""Source health (AGG-04, AGG-05, AGG-06, AGG-10).

Two-level partial aggregation: responses -> (source, board) -> source.  Board
lists are per-source configuration, so their size is bounded by the config,
not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmatch.sources.mapping import SPECS


#: Sources whose HTTP errors are empty pages in compat mode, and those fetched as one feed, whose failure is the source's own.
QUIET_ON_ERROR = tuple(s.name for s in SPECS if s.quiet)
WHOLE_FEEDS = tuple(s.name for s in SPECS if s.failure == "feed")
SCHEMA_MOVED = "no usable records, payload shape may have changed"


def source_health(responses: DataFrame, compat: bool = False) -> DataFrame:
    """``responses(source, board, status, n_records, n_mapped[, n_broken])`` -> one row per source.

    AGG-04: ``records_skipped`` are the unreadable records (``n_broken``; where
    that is not counted, all that were not mapped).  AGG-05: a source with
    records none of which could be mapped has failed.  AGG-06: an HTTP error
    fails the board, or the whole source where it is one feed; with
    ``compat=True`` the quiet sources report errors as empty pages and stay
    healthy, as in quirk Q13.
    """
    if "n_broken" not in responses.columns:
        responses = responses.withColumn("n_broken", F.col("n_records") - F.col("n_mapped"))
    ok = F.col("status") < 400
    quiet = F.col("source").isin(list(QUIET_ON_ERROR)) if compat else F.lit(False)
    counted = lambda c: F.sum(F.when(ok, F.col(c)).otherwise(0)).cast("bigint")
    per_board = responses.groupBy("source", "board").agg(
        F.min(F.when(~ok & ~quiet, F.col("status"))).alias("error_status"),
        counted("n_records").alias("raw"), counted("n_mapped").alias("fetched"), counted("n_broken").alias("skipped"))
    h = per_board.groupBy("source").agg(
        F.sum("fetched").alias("fetched"), F.sum("raw").alias("raw"), F.min("error_status").alias("error_status"),
        F.sort_array(F.collect_list(F.when(F.col("error_status").isNull(), F.col("board")))).alias("ok"),
        F.sort_array(F.collect_list(F.when(F.col("error_status").isNotNull(), F.col("board")))).alias("bad"),
        F.sum("skipped").alias("records_skipped"))
    error = (F.when(F.col("source").isin(list(WHOLE_FEEDS)) & F.col("error_status").isNotNull(),
                    F.concat(F.lit("HTTP "), F.col("error_status").cast("string")))
              .when((F.col("raw") > 0) & (F.col("fetched") == 0), F.lit(SCHEMA_MOVED)).otherwise(F.lit("")))
    h = h.withColumn("error", error).withColumn("failed", F.col("error") != "")
    total = F.size("ok") + F.size("bad")
    detail = F.concat(F.size("ok").cast("string"), F.lit("/"), total.cast("string"), F.lit(" boards OK"),
                      F.when(F.size("bad") > 0, F.concat(F.lit(" — failed: "), F.array_join("bad", ", ")))
                       .otherwise(F.lit("")))
    parts = F.concat_ws(", ", F.concat(F.col("fetched").cast("string"), F.lit(" fetched")),
                        F.when(total > 0, detail),
                        F.when(F.col("records_skipped") > 0,
                               F.concat(F.col("records_skipped").cast("string"), F.lit(" unreadable record(s)"))))
    said = F.when(F.col("failed"), F.concat(F.lit("FAILED ("), F.col("error"), F.lit(")"))).otherwise(parts)
    return h.select(
        F.col("source").alias("name"), "fetched", "failed", "error",
        F.array_join("ok", ",").alias("boards_ok"), F.array_join("bad", ",").alias("boards_failed"),
        "records_skipped",
        (~F.col("failed") & (F.size("bad") == 0) & (F.col("records_skipped") == 0)).alias("healthy"),
        F.concat(F.col("source"), F.lit(": "), said).alias("summary"))


def unhealthy(health: DataFrame) -> DataFrame:
    """AGG-10: the sources a run has to warn about."""
    return health.filter(~F.col("healthy"))


def fail_on_unhealthy(health: DataFrame) -> None:
    """AGG-10: raise if any source is unhealthy (one row per configured source)."""
    said = [r.summary for r in unhealthy(health).orderBy("name").collect()]
    if said:
        raise RuntimeError("unhealthy sources: " + "; ".join(said))
