"""Sponsorship excerpt (FN-18) as one Column expression.

The head of the text is always kept. Behind it, each sponsorship term keeps
``EXCERPT_WINDOW`` characters on both sides; windows that touch are one piece.
Terms are found by splitting the rest of the text at them, so offsets are sums
of lengths and no Python runs. The fold carries only the excerpt built so far,
which the budget bounds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedmatch import dims
from feedmatch.functions.text import strip_ws

TERMS = "(?i)(?:" + "|".join(re.escape(t).replace("\\ ", " ") for t in dims.VISA_TERMS) + ")"


def visa_excerpt(text: Column, budget: int = dims.EXCERPT_BUDGET) -> Column:
    """At most ``budget`` characters of ``text`` (plus joiners); NULL gives an empty string."""
    whole = strip_ws(F.coalesce(text, F.lit("")))
    head, pad = min(dims.EXCERPT_HEAD, budget), dims.EXCERPT_WINDOW

    def cut(body: Column) -> Column:
        rest = F.substring(body, F.lit(head + 1), F.length(body))
        steps = F.arrays_zip(F.split(rest, TERMS, -1).alias("gap"), F.regexp_extract_all(rest, F.lit(TERMS), F.lit(0)).alias("term"))
        start = F.struct(F.lit(head).alias("at"), F.lit(head).alias("shown_to"), F.lit(budget - head).alias("left"),
                         F.substring(body, F.lit(1), F.lit(head)).alias("out"))

        def step(acc: Column, s: Column) -> Column:
            begin = acc["at"] + F.length(s["gap"])
            end = begin + F.length(s["term"])
            joined = begin - pad <= acc["shown_to"]
            lo = F.greatest(acc["shown_to"], begin - pad)
            size = F.greatest(F.lit(0), F.least(F.least(F.length(body), end + pad) - lo, acc["left"]))
            piece = F.when(joined, F.lit("")).otherwise(F.lit(dims.EXCERPT_JOIN))
            shown = F.struct(end.alias("at"), F.greatest(acc["shown_to"], F.least(F.length(body), end + pad)).alias("shown_to"),
                             (acc["left"] - size).alias("left"),
                             F.when(size > 0, F.concat(acc["out"], piece, F.substring(body, lo + 1, size))).otherwise(acc["out"]).alias("out"))
            return F.when(s["term"].isNull() | (acc["left"] <= 0), acc).otherwise(shown)

        return F.aggregate(steps, start, step, lambda acc: acc["out"])

    # The one-element array evaluates the stripped text once.
    return F.transform(F.array(whole), lambda b: F.when(F.length(b) <= budget, b).otherwise(cut(b)))[0]
