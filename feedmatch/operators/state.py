"""History snapshots: the seen upsert (SNK-01/03/05).

Plain Parquet has no MERGE, so an upsert gives new rows: a full outer join on
the key, of the whole snapshot or, through ``KeyedStore``, of the key buckets
that the new rows touch.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmatch.functions.dates import ts_lit

SEEN_COLUMNS = ("job_key", "source", "source_id", "url", "url_norm", "title", "company", "location",
                "fingerprint", "first_seen", "last_seen", "notified")
# On conflict these take the new value; the rest keep the stored one.
REPLACED = ("url", "url_norm", "location", "fingerprint")
KEPT = ("source", "source_id", "title", "company", "first_seen")


def normalise_seen(seen: DataFrame) -> DataFrame:
    """SNK-05: snapshots written before ``location``/``fingerprint`` existed read as NULL."""
    for c in ("location", "fingerprint", "url_norm"):
        if c not in seen.columns:
            seen = seen.withColumn(c, F.lit(None).cast("string"))
    return seen.select(*SEEN_COLUMNS)


def upsert_seen(seen: DataFrame, new: DataFrame, now: datetime, notified: bool) -> DataFrame:
    """SNK-01: insert new keys; for known keys replace url/url_norm/location/fingerprint,
    set last_seen, raise notified to the max, keep first_seen/title/company/source."""
    seen = normalise_seen(seen)
    stamp = ts_lit(now)
    n = new.select("job_key", "source", "source_id", "url", "url_norm", "title", "company", "location",
                   "fingerprint", stamp.alias("first_seen"), stamp.alias("last_seen"),
                   F.lit(1 if notified else 0).alias("notified"))
    o = seen.select(*[F.col(c).alias(f"o_{c}") if c != "job_key" else F.col(c) for c in SEEN_COLUMNS])

    def merged(joined: DataFrame) -> DataFrame:
        old = F.col("o_source").isNotNull()
        new_ = F.col("source").isNotNull()
        cols = [F.col("job_key")]
        for c in SEEN_COLUMNS[1:]:
            if c == "notified":
                v = F.greatest(F.coalesce(F.col("o_notified"), F.lit(0)), F.coalesce(F.col("notified"), F.lit(0)))
            elif c == "last_seen":
                v = F.when(new_, F.col("last_seen")).otherwise(F.col("o_last_seen"))
            elif c in REPLACED:
                v = F.when(new_, F.col(c)).otherwise(F.col(f"o_{c}"))
            else:
                v = F.when(old, F.col(f"o_{c}")).otherwise(F.col(c))
            cols.append(v.alias(c))
        return joined.select(*cols)

    return merged(n.join(o, "job_key", "full_outer"))


def store_count(seen: DataFrame) -> int:
    """SNK-06: rows of a history snapshot."""
    return seen.count()


FINGERPRINT_VERSION = 2


def backfill_fingerprints(seen: DataFrame) -> DataFrame:
    """SNK-04: recompute fingerprints of rows stored under an older version.

    Uses the stored ``remote`` flag when present, so placeless remote rows keep
    their "Remote" place (the reference's backfill lost it; quirk Q9).
    """
    from feedmatch.operators.dedupe import fingerprint, place_key
    for c in ("location", "fingerprint"):
        if c not in seen.columns:
            seen = seen.withColumn(c, F.lit(None).cast("string"))
    version = F.col("fp_version") if "fp_version" in seen.columns else F.lit(0)
    remote = F.col("remote") == F.lit(True) if "remote" in seen.columns else F.lit(False)
    fresh = fingerprint(F.col("company"), F.col("title"), place_key(F.col("location"), remote))
    stale = version < F.lit(FINGERPRINT_VERSION)
    return seen.withColumns({
        "fingerprint": F.when(stale, fresh).otherwise(F.col("fingerprint")),
        "fp_version": F.lit(FINGERPRINT_VERSION),
    })
