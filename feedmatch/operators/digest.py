"""Ranking, cap and backlog, digest grouping and the byte budget (SRT-*, WIN-02..04,
PRJ-07..11, AGG-07/08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmatch.operators.scan import prefix_sums
from feedmatch.session import cut_lineage


def ranked_positions(rows: DataFrame, rank: Column) -> DataFrame:
    """``rows`` numbered 1..n by ``rank`` in ``position``, without gathering them in one task.

    Rows are range-partitioned by rank and written once; each partition numbers
    its own rows and adds the sizes of the partitions before it, which are as
    many as there are partitions.
    """
    parts = cut_lineage(rows.withColumn("_rank", rank).repartitionByRange(F.col("_rank"))
                            .withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_rank"))
    return (parts.join(F.broadcast(before), "_part")
                 .withColumn("position", F.col("_before") + own).drop("_rank", "_part", "_before"))


def top_n(rows: DataFrame, cap: int, rank: Column, limit: int | None = None) -> tuple[DataFrame, int]:
    """SRT-02: the best ``cap`` rows by ``rank`` (numbered 1..n) and the backlog count.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition keeps
    its own best ``cap`` and only those are merged, so nothing unbounded meets
    in one task.  The numbering window then runs over at most ``cap`` rows.
    A cap <= 0 means no cap (and no backlog), numbered by ``ranked_positions``; a run-level ``limit`` tightens it.
    """
    if limit is not None:
        cap = limit if cap <= 0 else min(cap, limit)
    ranked = rows.withColumn("_rank", rank)
    if cap <= 0:
        return ranked_positions(rows, rank), 0
    total = rows.count()
    top = ranked.orderBy("_rank").limit(cap)
    top = top.withColumn("position", F.row_number().over(Window.orderBy("_rank"))).drop("_rank")
    return top, max(0, total - cap)


def byte_budget(blocks: DataFrame, group: str, order: str, block_col: str, budget: int,
                head_bytes: int, tail_bytes: int) -> DataFrame:
    """WIN-04: per group, keep blocks in order while header + kept blocks + the
    "…and N more not shown." line the next cut would need + tail fit ``budget``
    bytes; the first overflow stops the group.  Returns one row per group:
    ``kept``, ``dropped``, ``body_bytes``.

    Running sums come from ``prefix_sums``, so a group of any size is spread
    over all tasks; what stops a group is one partial aggregation.  Blocks of
    equal order go by their size.
    """
    more = lambda n: F.when(n > 0, F.octet_length(
        F.concat(F.lit("…and "), n.cast("string"), F.lit(" more not shown.\n")))).otherwise(F.lit(0))
    narrow = blocks.select(group, F.col(order).alias("_at"), F.coalesce(F.octet_length(F.col(block_col)), F.lit(0)).alias("_bytes"))
    b = prefix_sums(narrow, [group], [F.col("_at"), F.col("_bytes")], {"cum": F.col("_bytes"), "i": F.lit(1)})
    over = (F.lit(head_bytes) + F.col("cum") + more(F.col("i_total") - F.col("i")) + F.lit(tail_bytes)) > F.lit(budget)
    per = b.groupBy(group).agg(F.max("i_total").alias("n"), F.max("cum_total").alias("bytes"),
                               F.min(F.when(over, F.struct("i", (F.col("cum") - F.col("_bytes")).alias("before")))).alias("stop"))
    kept = F.coalesce(F.col("stop.i") - 1, F.col("n"))
    dropped = F.col("n") - kept
    return per.select(group, kept.cast("bigint").alias("kept"), dropped.cast("bigint").alias("dropped"),
                      (F.lit(head_bytes) + F.coalesce("stop.before", "bytes") + more(dropped) + F.lit(tail_bytes)).cast("bigint").alias("body_bytes"))


def header_line(counts: dict) -> str:
    """The one-line account of a run from its counters, what never made the digest included."""
    held = [f"{counts['backlog']} held for next run"] if counts["backlog"] else []
    place = counts["based_in"].title() or "your country"
    far = [f"{counts['rejected_relocation']} not workable from {place}"] if counts["rejected_relocation"] else []
    return " · ".join([f"{counts['new']} new", *held, f"{counts['already_seen']} already seen", f"{counts['too_old']} too old", *far,
                       f"{counts['rejected']} rejected (US-only / title / seniority / visa)"])


def shown_remote(reasons: Column) -> Column:
    """PRJ-07: whether a match is shown as remote."""
    return F.coalesce((F.col("remote") == F.lit(True)) | F.array_contains(reasons, "remote"), F.lit(False))


def work_mode(reasons: Column, remote: Column) -> Column:
    """PRJ-07: the work mode's label, '' when none is known."""
    return (F.when(F.array_contains(reasons, "hybrid"), F.lit("Hybrid")).when(remote, F.lit("Remote"))
             .when(F.array_contains(reasons, "onsite"), F.lit("On-site")).otherwise(F.lit("")))


def facts(matches: DataFrame, now) -> DataFrame:
    """PRJ-10: the lines printed under each match, as arrays and texts beside its columns."""
    from feedmatch import dims
    from feedmatch.functions.dates import relative_age

    filled = lambda *parts: F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))
    reasons = F.coalesce(F.col("reasons"), F.array().cast("array<string>"))
    level = F.when(F.col("seniority") != dims.UNKNOWN_LEVEL, F.col("seniority"))
    age = relative_age(F.col("posted_at"), now)
    why_not = F.trim(F.coalesce(F.col("sponsorship_reason"), F.lit("")))
    named = F.coalesce(F.nullif(F.col("location"), F.lit("")), F.lit("Location n/a"))
    return matches.withColumns({
        "details": filled(work_mode(reasons, shown_remote(reasons)), F.initcap(level), age, F.col("salary")),
        "facts": filled(named, F.col("source"), level, age, F.col("salary"), F.concat(F.lit("score "), F.col("score").cast("string"))),
        "why": F.coalesce(F.nullif(F.array_join(reasons, ", "), F.lit("")), F.lit("matched prefs")),
        "sponsorship_line": F.when(F.coalesce(F.col("sponsorship"), F.lit("")) == "", F.lit(""))
                             .otherwise(F.concat(F.lit("sponsorship: "), F.col("sponsorship"),
                                                 F.when(why_not != "", F.concat(F.lit(" — "), why_not)).otherwise(F.lit("")))),
    })


def group_digest(top: DataFrame, now) -> DataFrame:
    """WIN-02/03 + PRJ-07/09/11 over the capped digest rows (at most ``cap`` rows, so the
    global windows here are bounded by the cap, never by the data).

    Groups by country bucket: "Other" last, best score first, then name; rows by
    score then lower(title); numbered 1..N across groups.
    """
    from feedmatch import dims
    from feedmatch.functions.dates import relative_age
    from feedmatch.functions.text import segments
    from feedmatch.operators.dedupe import country_bucket

    reasons = F.coalesce(F.col("reasons"), F.array().cast("array<string>"))
    loc_l = F.lower(F.coalesce(F.col("location"), F.lit("")))
    d = top.withColumns({
        "_remote": shown_remote(reasons),
        "country": country_bucket(loc_l, segments(loc_l), shown_remote(reasons)),
    })
    d = d.withColumns({"_group_best": F.max("score").over(Window.partitionBy("country")),
                       "_group_size": F.count(F.lit(1)).over(Window.partitionBy("country"))})
    order = [(F.col("country") == "Other").asc(), F.col("_group_best").desc(), F.col("country").asc(),
             F.col("score").desc(), F.lower(F.col("title")).asc(), F.col("ord").asc()]
    sponsorship = F.coalesce(F.col("sponsorship"), F.lit(""))
    reason = F.trim(F.coalesce(F.col("sponsorship_reason"), F.lit("")))
    with_reason = lambda head: F.when(reason != "", F.concat(F.lit(head + " — "), reason)).otherwise(F.lit(head))
    highlight = F.coalesce(F.col("highlight"), F.lit(""))
    flags = F.create_map(*[F.lit(x) for kv in dims.COUNTRY_FLAGS.items() for x in kv])
    names = F.create_map(*[F.lit(x) for kv in dims.SOURCE_NAMES.items() for x in kv])
    return d.select(
        F.row_number().over(Window.orderBy(*order)).alias("n"),
        "country",
        F.concat(F.coalesce(F.try_element_at(flags, F.col("country")), F.lit(dims.DEFAULT_FLAG)),
                 F.lit(" "), F.col("country")).alias("country_label"),
        F.col("_group_size").alias("group_size"), F.col("_group_best").alias("group_best"),
        "job_key", "title", "score",
        work_mode(reasons, F.col("_remote")).alias("work_mode"),
        relative_age(F.col("posted_at"), now).alias("age"),
        F.when(sponsorship == "yes", with_reason("Visa sponsorship likely"))
         .when(sponsorship == "no", with_reason("Sponsorship unlikely"))
         .when(highlight != "", highlight)
         .when(F.array_contains(reasons, "visa:sponsor-register"), F.lit(dims.HL_REGISTER))
         .otherwise(F.lit("")).alias("visa_note"),
        F.when(highlight.startswith("Open ") & (sponsorship == ""), F.lit("🌍")).otherwise(F.lit("✈")).alias("icon"),
        F.coalesce(F.try_element_at(names, F.col("source")), F.col("source")).alias("source_label"))
