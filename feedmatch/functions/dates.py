"""Instants (FN-15, FN-16)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_lit(value: datetime) -> Column:
    """A naive UTC instant as a TIMESTAMP_NTZ literal (jobs pass ``now``; never current_timestamp)."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def relative_age(posted: Column, now: datetime) -> Column:
    """FN-16: "" when unknown; "just now" under an hour (and for future dates); else
    floor hours "Nh ago" under a day; else floor days "Nd ago"."""
    # Whole days plus seconds of day, on the naive UTC wall clock: no session
    # time zone (or DST) enters the difference.
    p, n = posted.cast("timestamp_ntz"), ts_lit(now)
    sod = lambda c: F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    seconds = (F.datediff(F.to_date(n), F.to_date(p)).cast("bigint") * 86400 + sod(n) - sod(p))
    hours = F.floor(seconds / F.lit(3600))
    return (F.when(posted.isNull(), F.lit(""))
             .when(seconds < 3600, F.lit("just now"))
             .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
             .otherwise(F.concat(F.floor(hours / F.lit(24)).cast("string"), F.lit("d ago"))))


# Basic forms written out, one part at a time: date, time, offset, and a time of hours alone.
_DATE = r"^(\d{4}-\d{2}-\d{2})"
_EXTENDED = ((r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3"), (_DATE + r"([T ]\d{2})(\d{2})(\d{2})", "$1$2:$3:$4"),
             (_DATE + r"([T ]\d{2})(\d{2})(?![\d:])", "$1$2:$3"), (_DATE + r"([T ][\d:]+),", "$1$2."),
             (_DATE + r"([T ][\d:.]+[+-]\d{2})(\d{2})$", "$1$2:$3"), (_DATE + r"([T ][\d:.]+[+-]\d{2})$", "$1$2:00"),
             (_DATE + r"([T ]\d{2})(?=$|[+-])", "$1$2:00"), (_DATE + r"([T ]\d{2}:\d{2})(?=$|[+-])", "$1$2:00"))


def parse_instant(text: Column, number: Column | None = None) -> Column:
    """FN-15: epoch seconds (or milliseconds when |n| > 1e11), else an ISO-8601 string
    with a full date ('Z' accepted), in extended or basic form; naive values are UTC; anything else NULL."""
    iso = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    for basic, extended in _EXTENDED:
        iso = F.regexp_replace(iso, basic, extended)
    parsed = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"),
                    F.coalesce(F.try_to_timestamp(iso), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"))))
    if number is None:
        return parsed.cast("timestamp_ntz")
    # Out of range (or NaN) is NULL, never an overflow that ends the job.
    seconds = F.when(F.abs(number) > F.lit(1e11), number / 1000).otherwise(number)
    sane = F.when((seconds > F.lit(-62135596800.0)) & (seconds < F.lit(253402300800.0)), seconds)
    from_number = F.timestamp_micros(F.floor(sane * 1000000).cast("long"))
    return F.coalesce(from_number, parsed).cast("timestamp_ntz")
