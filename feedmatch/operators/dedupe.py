"""Identities, the seen anti-join and the ordered greedy dedupe (FN-10, PRJ-05/06,
JN-02, WIN-01).

A posting has up to three identities: its key, its normalised URL and its
fingerprint (company | title | place).  Identities are exploded to narrow
``(id, kind, value)`` rows, so every lookup is an equi-join on
``(kind, value)`` -- never a disjunctive (nested-loop) join -- and nothing
text-sized is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmatch import dims
from feedmatch.functions.text import any_phrase_in, fold_identity, normalize_url, segments
from feedmatch.session import cut_lineage


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def country_bucket(location_l: Column, segs: Column, remote: Column) -> Column:
    """PRJ-05: first country in table order whose alias matches, then Europe/Remote/Other."""
    expr = None
    for country, aliases in dims.COUNTRY_ALIASES.items():
        if country in dims.GENERIC_BUCKETS:
            continue
        short = [a for a in aliases if len(a) <= 2]
        long_ = [a for a in aliases if len(a) > 2]
        cond = F.lit(False)
        if short:
            cond = cond | F.arrays_overlap(segs, _arr(short))
        if long_:
            cond = cond | any_phrase_in(location_l, long_)
        label = F.lit(dims.country_label(country))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    europe = [a for a in dict.fromkeys(dims.COUNTRY_ALIASES["europe"] + dims.COUNTRY_ALIASES["eu"])
              if len(a) > 2]
    return (expr.when(any_phrase_in(location_l, europe), F.lit("Europe"))
                .when(F.coalesce(remote, F.lit(False)), F.lit("Remote"))
                .otherwise(F.lit("Other")))


def place_key(location, remote) -> Column:
    """PRJ-06: named segments minus country names and work-mode words, sorted; else the bucket."""
    loc_l = F.lower(F.coalesce(location, F.lit("")))
    segs = segments(loc_l)
    named = F.array_except(F.array_except(segs, _arr(dims.COUNTRY_NAME_TOKENS)),
                           _arr(dims.WORK_MODE_WORDS))
    return F.when(F.size(named) > 0, F.array_join(F.array_sort(named), " ")) \
        .otherwise(country_bucket(loc_l, segs, remote))


def fingerprint(company, title, place) -> Column:
    """FN-10: 128-bit hex identity of folded company | title | place; NULL if either is empty."""
    fc, ft = fold_identity(company), fold_identity(title)
    seed = F.concat_ws("|", fc, ft, fold_identity(place))
    return F.when((fc != "") & (ft != ""), F.substring(F.sha2(seed, 256), 1, 32))


def with_identities(df: DataFrame) -> DataFrame:
    """Add ``job_key``, ``url_norm`` and ``fingerprint`` (remote flag = ``remote IS TRUE``)."""
    return df.withColumns({
        "job_key": F.concat(F.col("source"), F.lit(":"), F.col("source_id")),
        "url_norm": normalize_url(F.col("url")),
        "fingerprint": fingerprint(F.col("company"), F.col("title"),
                                   place_key(F.col("location"), F.col("remote") == F.lit(True))),
    })


def identities(df: DataFrame, id_col: str = "ord", *carried: str) -> DataFrame:
    """Narrow ``(id, kind, value)`` rows, and ``carried`` columns: one per non-empty identity of each posting."""
    kinds = F.array(
        F.struct(F.lit("key").alias("kind"), F.col("job_key").alias("value")),
        F.struct(F.lit("url").alias("kind"), F.col("url_norm").alias("value")),
        F.struct(F.lit("fp").alias("kind"), F.col("fingerprint").alias("value")))
    return (df.select(F.col(id_col).alias("id"), *carried, F.explode(kinds).alias("i"))
              .select("id", "i.kind", "i.value", *carried)
              .filter(F.col("value").isNotNull() & (F.col("value") != "")))


def seen_identities(seen: DataFrame) -> DataFrame:
    """Distinct ``(kind, value)`` of a seen snapshot (needs job_key, url_norm, fingerprint)."""
    return identities(seen.withColumn("_i", F.lit(0)), "_i").select("kind", "value").distinct()


def anti_seen(postings: DataFrame, seen: DataFrame, id_col: str = "ord") -> DataFrame:
    """JN-02: postings none of whose identities occurs in ``seen`` (three-way OR, as equi-joins).

    For a snapshot without an index; ``SeenHistory.anti_seen`` reads of a stored history only what may hit.
    """
    ids = identities(postings, id_col)
    hit = ids.join(seen_identities(seen), ["kind", "value"], "left_semi")
    seen_ids = hit.select(F.col("id").alias(id_col)).distinct()
    return postings.join(seen_ids, id_col, "left_anti")


def greedy_dedupe(rows: DataFrame, rank: Column, id_col: str = "ord") -> DataFrame:
    """WIN-01: keep a row iff no identity of it belongs to a better-ranked *kept* row.

    Equivalent to walking rows best-first and registering only kept rows'
    identities.  Identities that only one row has decide nothing, so rounds run
    over contested ones alone: an undecided row that is the best of all its
    contested identities is kept, rows sharing one with it are dropped, and
    both leave the next round.  Group minima use partial aggregation, the join
    back to them has unique keys on one side, so AQE can split a hot identity.
    Each round is one checkpoint.  ``rank`` must be a total order; a row
    without any identity is kept.
    """
    ids = identities(rows.withColumn("_rank", rank), id_col, "_rank")
    shared = ids.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    contested = ids.join(shared, ["kind", "value"], "left_semi")
    per_row = contested.groupBy("id").agg(F.count(F.lit(1)).alias("n_ids"))
    active = cut_lineage(contested.join(per_row, "id"))
    dropped = None
    while True:  # each round keeps at least the best undecided row, so it ends
        best = active.groupBy("kind", "value").agg(F.min(F.struct("_rank", "id", "n_ids")).alias("w"))
        kept = (best.groupBy(F.col("w.id").alias("id"), F.col("w.n_ids").alias("n_ids"))
                    .agg(F.count(F.lit(1)).alias("n_wins")).filter("n_wins = n_ids").select("id"))
        taken = best.select("kind", "value", F.col("w.id").alias("id")).join(kept, "id", "left_semi") \
            .withColumnRenamed("id", "keeper")
        decided = (active.select("id", "kind", "value").join(taken, ["kind", "value"])
                         .groupBy("id").agg(F.max(F.col("id") != F.col("keeper")).alias("lost")))
        state = cut_lineage(active.join(decided, "id", "left"))
        lost = state.filter("lost").select("id").distinct()
        dropped = lost if dropped is None else dropped.unionByName(lost)
        active = state.filter("lost IS NULL").drop("lost")
        if active.isEmpty():
            break
    return rows.join(dropped.select(F.col("id").alias(id_col)), id_col, "left_anti")
