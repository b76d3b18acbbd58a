"""Landing of payload records by their fate, and the replay of mended ones (SRC-12, SRC-13).

One pass over the payloads writes everything that came out of them, one folder
per fate: ``mapped`` rows hold the posting, ``quarantined`` and ``dropped``
rows the record as it was sent with its position in the payload, and the field
that broke.  A record that is mended, or that a newer spec reads, is replayed
from its quarantine row; nothing is fetched again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmatch.sources.mapping import postings_of, read_fields
from feedmatch.sources.payloads import source_records

PLACE = ("source", "board", "page", "pos")


def land(payloads: DataFrame, out: str) -> None:
    """Write the records of answered ``payloads`` (source, board, page, status, body) to ``out``, partitioned by fate."""
    _write(source_records(payloads.filter("status < 400"), keep=("page",)), out)


def _write(records: DataFrame, out: str) -> None:
    read = read_fields(records)
    kept = [f"_{c}" for c in (*PLACE, "fate", "offending", "record")]
    named = read.withColumns({f"_{c}": F.col(c) for c in (*PLACE, "fate", "offending", "record")})
    posting = postings_of(named, carried=kept)
    fields = [c for c in posting.columns if c not in kept]
    mapped = F.col("_fate") == "mapped"
    (posting.select(*(F.col(f"_{c}").alias(c) for c in PLACE), F.col("_offending").alias("offending"),
                    F.when(~mapped, F.to_json(F.col("_record"))).alias("sent"),
                    F.when(mapped, F.struct(*fields)).alias("posting"), F.col("_fate").alias("fate"))
            .write.mode("overwrite").partitionBy("fate").parquet(out))


def landed_postings(spark: SparkSession, out: str) -> DataFrame:
    """Postings of a landing; only the folder of mapped records is read."""
    return spark.read.parquet(out).filter("fate = 'mapped'").select("posting.*")


def quarantined(spark: SparkSession, out: str, fate: str = "quarantined") -> DataFrame:
    """Place, offending field and sent record (JSON text) of what a landing set aside."""
    return spark.read.parquet(out).filter(F.col("fate") == fate).select(*PLACE, "offending", "sent")


def replay(rows: DataFrame, mend: Callable[[Column], Column], out: str) -> None:
    """Read quarantine rows again, their record mended by ``mend`` (JSON text to JSON text), into a landing of their own."""
    _write(rows.select(*PLACE, F.try_parse_json(mend(F.col("sent"))).alias("record")), out)
