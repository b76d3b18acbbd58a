"""Landed classifier replies -> verdict cache (FN-19, JN-03, JN-05, SNK-02).

The live model call is not Spark work; rows that need a verdict are exported
(``to_classify``) and replies land as a table.  Parsing is JVM-side: VARIANT
for the envelope, regex for a fenced block, the outermost braces for the
object.  Unusable replies give no verdict and are not cached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmatch import dims
from feedmatch.operators.excerpt import visa_excerpt

_FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def reply_text(reply: Column) -> Column:
    """Space-joined ``text`` of the ``type == "text"`` content blocks, trimmed."""
    blocks = F.try_variant_get(F.try_parse_json(reply), "$.content", "array<variant>")
    texts = F.transform(
        F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"),
        lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
    return F.trim(F.coalesce(F.array_join(texts, " "), F.lit("")))


def parse_verdict(text: Column) -> Column:
    """struct(verdict, reason): verdict in yes/no/unclear else NULL; reason whitespace-collapsed."""
    cand = F.when(text.rlike(_FENCE), F.regexp_extract(text, _FENCE, 1)).otherwise(text)
    start = F.instr(cand, "{")
    back = F.instr(F.reverse(cand), "}")
    end = F.when(back > 0, F.length(cand) - back + 1).otherwise(F.lit(0))
    obj = F.try_parse_json(F.when((start > 0) & (end > start), F.substring(cand, start, end - start + 1)))
    is_obj = F.coalesce(F.schema_of_variant(obj).startswith("OBJECT"), F.lit(False))
    verdict = F.lower(F.trim(F.coalesce(F.try_variant_get(obj, "$.sponsorship", "string"), F.lit(""))))
    reason = F.trim(F.regexp_replace(F.coalesce(F.try_variant_get(obj, "$.reason", "string"), F.lit("")),
                                     r"\s+", " "))
    ok = is_obj & verdict.isin(list(dims.VERDICTS))
    return F.struct(F.when(ok, verdict).alias("verdict"), F.when(ok, reason).alias("reason"))


def _latest(rows: DataFrame) -> DataFrame:
    """One (verdict, reason) per key: usable ones first, then the latest ``checked_at``.

    Without a time the greatest verdict and reason win, so that the choice doesn't depend on the row order.
    """
    timed = [F.col("checked_at")] if "checked_at" in rows.columns else []
    order = F.struct(F.col("verdict").isNotNull().alias("usable"), *timed, "verdict", "reason")
    return (rows.groupBy("job_key").agg(F.max_by(F.struct("verdict", "reason", *timed), order).alias("v"))
                .select("job_key", "v.*"))


def latest_replies(replies: DataFrame) -> DataFrame:
    """The reply of each key, parsed; an unusable one has a NULL verdict."""
    timed = ["checked_at"] if "checked_at" in replies.columns else []
    parsed = replies.select("job_key", parse_verdict(reply_text(F.col("reply"))).alias("v"), *timed)
    return _latest(parsed.select("job_key", "v.verdict", "v.reason", *timed))


def cacheable_verdicts(replies: DataFrame) -> DataFrame:
    """JN-05: usable replies only, one row per key."""
    return latest_replies(replies).filter(F.col("verdict").isNotNull())


def merge_verdicts(cache: DataFrame, replies: DataFrame) -> DataFrame:
    """SNK-02: the stored verdicts with a run's usable replies; the latest ``checked_at`` of a key wins."""
    return _latest(cache.unionByName(cacheable_verdicts(replies).select(*cache.columns)))


def undecided(matches: DataFrame, cache: DataFrame) -> DataFrame:
    """JN-03: the ``matches`` that neither a rule nor the cache decides."""
    return matches.filter(F.col("sponsorship").isNull()).join(cache.select("job_key"), "job_key", "left_anti")


def to_classify(matches: DataFrame, cache: DataFrame, postings: DataFrame) -> DataFrame:
    """EXT-04: one row per undecided key with the text to be judged; ``postings`` hold the descriptions by ``ord``."""
    first = undecided(matches, cache).groupBy("job_key").agg(F.min("ord").alias("ord"))
    texts = postings.select("ord", "title", "company", "location", "description").join(first, "ord")
    return texts.select("job_key", "title", "company", "location", visa_excerpt(F.col("description")).alias("excerpt"))


def apply_verdicts(matches: DataFrame, cache: DataFrame, replies: DataFrame) -> DataFrame:
    """JN-03 + JN-05: ``sponsorship`` from the rules, else the cache, else this run's reply, else "unclear".

    ``verdict_origin`` tells which: rule, cache, reply, unusable (a reply without a verdict) or missing.
    """
    stored = cache.select("job_key", F.col("verdict").alias("_cached"), F.col("reason").alias("_cached_why"))
    landed = latest_replies(replies).select("job_key", F.col("verdict").alias("_said"), F.col("reason").alias("_said_why"),
                                            F.lit(True).alias("_landed"))
    j = matches.join(stored, "job_key", "left").join(landed, "job_key", "left")
    origin = (F.when(F.col("sponsorship").isNotNull(), F.lit("rule")).when(F.col("_cached").isNotNull(), F.lit("cache"))
               .when(F.col("_said").isNotNull(), F.lit("reply")).when(F.col("_landed"), F.lit("unusable"))
               .otherwise(F.lit("missing")))
    j = j.withColumn("verdict_origin", origin)
    of = lambda **by: F.coalesce(*[F.when(F.col("verdict_origin") == k, v) for k, v in by.items()])
    return j.withColumns({
        "sponsorship_reason": of(rule=F.col("sponsorship_reason"), cache=F.col("_cached_why"), reply=F.col("_said_why"),
                                 unusable=F.lit(dims.NO_VERDICT), missing=F.lit(dims.NO_REPLY)),
        "sponsorship": of(rule=F.col("sponsorship"), cache=F.col("_cached"), reply=F.col("_said"),
                          unusable=F.lit(dims.UNCLEAR), missing=F.lit(dims.UNCLEAR)),
    }).drop("_cached", "_cached_why", "_said", "_said_why", "_landed")
