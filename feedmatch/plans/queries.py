"""

Every query reads the driver's tables (directly or through the fixture views
derived from them), so its work grows with the tables.  Output columns are
plain scalars with explicit aliases, matching the oracle SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedmatch.functions.text import (fold_company, keyword_hits, normalize_url, segments,
                                      strip_html)
from feedmatch.functions.dates import relative_age
from feedmatch.functions.salary import format_salary
from feedmatch.job import deliver_rest, digest_rank, stream_fresh
from feedmatch.operators import dedupe as D
from feedmatch.operators import digest as G
from feedmatch.operators import state as S
from feedmatch.operators import matching as M
from feedmatch.operators.history import IdentityIndex, SeenHistory, identity_rows
from feedmatch.operators.partitioning import ensure_parallelism
from feedmatch.plans.inputs import postings_fx, register_lines_fx, seen_raw_fx
from feedmatch.prefs import EVIDENCE_PREFS, FIXTURE_NOW, FIXTURE_PREFS, STRICT_PREFS, WHOLE_PREFS, Prefs
from feedmatch.session import cut_lineage, new_folder, table, written

# Keywords searched in the raw documents (keyword_hits): frequent function
# words of the four languages plus the profile's own keywords.
DOC_KEYWORDS = ("the", "und", "la", "que", "der", "python", "data", "et", "el", "The", "in the")


#: Key buckets of the stores that queries make.
STORE_BUCKETS = 16


def _job_key() -> F.Column:
    return F.concat(F.col("source"), F.lit(":"), F.col("source_id"))


_PLANS: dict[tuple, DataFrame] = {}


def _memo(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Reuse a built DataFrame *plan* (not its data) per session and input folder.

    Building the funnel's expression tree costs seconds of driver time; the
    rows are still recomputed by every action.
    """
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, name)
    if key not in _PLANS:
        _PLANS[key] = build()
    return _PLANS[key]


def annotated_fx(spark: SparkSession, sf_dir: str, prefs=FIXTURE_PREFS, name: str = "matched", rows: str = "flagged") -> DataFrame:
    """postings_fx annotated by the funnel, as a plan: what selects a few flags computes only those.

    ``rows``: "flagged" has all flags of every posting, "funnel" the reason of every posting and the flags of those that no
    earlier rule rejected, "open" the latter for the postings that date and title leave in only.
    """
    def build():
        register = M.register_names(register_lines_fx(spark, sf_dir))
        p = postings_fx(spark, sf_dir)
        if rows == "open":
            p = M.may_match(p, prefs, FIXTURE_NOW)
        return M.narrow(M.match(p, prefs, FIXTURE_NOW, register, rejected_flags=rows == "flagged"))
    return _memo(spark, sf_dir, f"{name} {rows}", build)


def matched_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``annotated_fx`` materialised, for what filters on its reasons or reads it more than once.

    The annotated frame is checkpointed to the shared checkpoint folder: it
    cuts lineage (a lost executor does not re-run the text rules) and stops
    the optimizer from inlining the whole rule tree into later filters.
    """
    return cut_lineage(annotated_fx(spark, sf_dir, rows="funnel"))


def matches_fx(spark: SparkSession, sf_dir: str, *counters: F.Column) -> tuple[DataFrame, dict]:
    """The matched postings, written once, and the ``counters`` of all postings, observed in the pass that writes them (AGG-02).

    Without counters nobody asks why a posting was dropped, so the text of those that date or title reject is not read.  The
    observation also keeps the filter on the reason from being pushed below the rules, which would run them twice.
    """
    seen = Observation("funnel")
    m = annotated_fx(spark, sf_dir, rows="funnel" if counters else "open")
    m = m.observe(seen, F.count(F.lit(1)).alias("fetched" if counters else "open"), *counters)
    return written(m.filter(F.col("reject_reason").isNull()), "matches"), seen.get


# --- funnel and classifiers --------------------------------------------------------
def funnel_counts(spark, sf_dir):
    m = annotated_fx(spark, sf_dir, rows="funnel")
    return (m.groupBy(F.coalesce("reject_reason", F.lit("matched")).alias("reason"))
             .agg(F.count(F.lit(1)).alias("n")))


def funnel_counts_strict(spark, sf_dir):
    """FLT-02/04/07/11/14/26: the profile whose gates are all on."""
    m = annotated_fx(spark, sf_dir, STRICT_PREFS, "strict", "funnel")
    return (m.groupBy(F.coalesce("reject_reason", F.lit("matched")).alias("reason"))
             .agg(F.count(F.lit(1)).alias("n")))


def relocation_evidence(spark, sf_dir):
    """FLT-25 with evidence required: one row per reason, and the scores without caps and place weights."""
    m = annotated_fx(spark, sf_dir, EVIDENCE_PREFS, "evidence", "funnel")
    return (m.groupBy("reject_reason", F.coalesce("reloc_reason", F.lit("")).alias("reloc_reason"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("bigint").alias("score")))


def rejects_q(spark, sf_dir):
    return M.rejects(matched_fx(spark, sf_dir))


def digest_facts(spark, sf_dir):
    """PRJ-10 of every match."""
    m, _ = matches_fx(spark, sf_dir)
    return G.facts(m, FIXTURE_NOW).select("ord", F.array_join("details", " · ").alias("details"),
                                          F.array_join("facts", " · ").alias("facts"), "why", "sponsorship_line")


def _replies_split(spark, sf_dir):
    """Replies of even documents as the stored verdicts, of odd ones as what this run got; each seventh never came."""
    from feedmatch.operators.verdicts import cacheable_verdicts
    from feedmatch.plans.inputs import replies_fx
    number = F.substring_index("job_key", ":", -1).cast("bigint")
    replies = replies_fx(spark, sf_dir).filter(number % 7 != 0)
    return cacheable_verdicts(replies.filter(number % 2 == 0)), replies.filter(number % 2 == 1)


def verdict_applied(spark, sf_dir):
    """JN-03 + JN-05 over every match (a run applies them to its capped digest)."""
    from feedmatch.operators.verdicts import apply_verdicts
    cache, replies = _replies_split(spark, sf_dir)
    m = matches_fx(spark, sf_dir)[0].withColumn("job_key", _job_key())
    return apply_verdicts(m, cache, replies).select("ord", "job_key", "sponsorship", "sponsorship_reason", "verdict_origin")


def to_classify_q(spark, sf_dir):
    """EXT-04: what neither the rules nor the stored verdicts decide, with its excerpt."""
    from feedmatch.operators.verdicts import to_classify
    cache, _ = _replies_split(spark, sf_dir)
    m = matches_fx(spark, sf_dir)[0].withColumn("job_key", _job_key())
    return to_classify(m, cache, postings_fx(spark, sf_dir))


def seniority_levels(spark, sf_dir):
    p = postings_fx(spark, sf_dir)
    level = M.seniority(F.col("title"))
    return p.select("ord", level.alias("seniority"),
                    M.seniority_allowed(level, FIXTURE_PREFS).alias("allowed"))


def company_fold(spark, sf_dir):
    m = annotated_fx(spark, sf_dir)
    return m.select("ord", "company", "company_norm", "on_register")


def hard_restriction(spark, sf_dir):
    m = annotated_fx(spark, sf_dir)
    return m.select("ord", "restricted")


def move_offer(spark, sf_dir):
    m = annotated_fx(spark, sf_dir)
    return m.select("ord", "offers_move")


def remote_eligibility(spark, sf_dir):
    m = annotated_fx(spark, sf_dir)
    return m.select("ord", "is_remote", "is_hybrid", "geo_ok", "remote_ok", "hybrid_ok", "onsite_ok")


def relocation_assessment(spark, sf_dir):
    m = matched_fx(spark, sf_dir)
    return (m.filter(F.col("reject_reason").isNull() | (F.col("reject_reason") == "rejected_relocation"))
             .select("ord", F.coalesce("reloc_reason", F.lit("")).alias("reloc_reason"),
                     F.coalesce("highlight", F.lit("")).alias("highlight")))


def scored_matches(spark, sf_dir):
    m, _ = matches_fx(spark, sf_dir)
    return (m.select("ord", _job_key().alias("job_key"), "score",
                     F.array_join("reasons", "|").alias("reasons"), "seniority", "highlight",
                     F.coalesce("sponsorship", F.lit("")).alias("sponsorship")))


def keyword_hits_q(spark, sf_dir):
    d = ensure_parallelism(table(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id", F.array_join(keyword_hits(F.lower(F.col("text")), DOC_KEYWORDS), ",")
                    .alias("hits"))


# --- text functions over pages / documents ------------------------------------------
def html_to_text(spark, sf_dir):
    pages = ensure_parallelism(table(spark, sf_dir, "pages"), "page_id")
    return pages.select("page_id", strip_html(F.col("html")).alias("text"))


def url_normalize_dups(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return (pages.select(normalize_url(F.col("url")).alias("url_norm"))
                 .groupBy("url_norm").agg(F.count(F.lit(1)).alias("n")))


def posting_language_confusion(spark, sf_dir):
    d = ensure_parallelism(table(spark, sf_dir, "documents"), "doc_id")
    h = F.lower(strip_html(F.col("text")))
    found = d.select("lang", M.stopwords_found(h, window=None).alias("found"))
    counted = found.select("lang", M.language_counts(F.col("found")).alias("counts"))
    return (counted.select("lang", M.language_of(F.col("counts")).alias("detected"))
                   .groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n")))


# --- identities, seen history and dedupe ---------------------------------------------
def seen_fx(spark, sf_dir):
    return D.with_identities(seen_raw_fx(spark, sf_dir))


def place_key_bucket(spark, sf_dir):
    p = postings_fx(spark, sf_dir)
    loc_l = F.lower(F.coalesce(F.col("location"), F.lit("")))
    remote = F.col("remote") == F.lit(True)
    pk = D.place_key(F.col("location"), remote)
    return p.select("ord", "location",
                    D.country_bucket(loc_l, segments(loc_l), remote).alias("bucket"),
                    pk.alias("place_key"),
                    D.fingerprint(F.col("company"), F.col("title"), pk).alias("fingerprint"))


def seen_antijoin(spark, sf_dir):
    """JN-02 against the history as a store: identity filter first, then the index buckets that may hold a hit."""
    known = IdentityIndex(spark, new_folder(spark, "known"), STORE_BUCKETS).create(identity_rows(seen_fx(spark, sf_dir)))
    p = D.with_identities(postings_fx(spark, sf_dir).select("ord", "source", "source_id", "title", "company", "url", "location", "remote"))
    return known.anti_known(written(p, "identities")).select("ord", "job_key")


def greedy_dedupe_q(spark, sf_dir):
    p = D.with_identities(postings_fx(spark, sf_dir)).select("ord", "job_key", "url_norm", "fingerprint")
    return D.greedy_dedupe(p, F.struct(F.col("ord")), "ord").select("ord", "job_key")


def fresh_matches(spark, sf_dir, matches: DataFrame | None = None) -> DataFrame:
    """Matches minus seen history, deduplicated best-first (JN-02 + WIN-01); only identities and rank go through the rounds."""
    m = matches_fx(spark, sf_dir)[0] if matches is None else matches
    ids = written(D.with_identities(m).select("ord", "score", "title", "job_key", "url_norm", "fingerprint"), "identities")
    return D.greedy_dedupe(D.anti_seen(ids, seen_fx(spark, sf_dir)), digest_rank(), "ord")


def _top(spark, sf_dir, matches: DataFrame) -> tuple[DataFrame, int, int]:
    """The digest's rows (at most ``max_jobs``) with all their columns, the backlog, and how many were fresh."""
    counted = Observation("fresh")
    fresh = written(fresh_matches(spark, sf_dir, matches).observe(counted, F.count(F.lit(1)).alias("n")), "fresh")
    n, cap = counted.get["n"], FIXTURE_PREFS.max_jobs
    best = fresh.withColumn("_rank", digest_rank()).orderBy("_rank").limit(cap).select("ord", "job_key")
    return matches.drop("job_key").join(F.broadcast(best), "ord"), max(0, n - cap), n  # at most max_jobs rows


def digest_grouped(spark, sf_dir):
    top, _, _ = _top(spark, sf_dir, matches_fx(spark, sf_dir)[0])
    return G.group_digest(top, FIXTURE_NOW)


def run_summary(spark, sf_dir):
    """AGG-02/03/07: one row accounting for every fetched posting, and its header line.

    All drop counters are observed in the one pass over the postings that writes the matches, the fresh rows in the pass
    that writes those; ``already_seen`` = matched - fresh after seen and in-batch dedupe (Q4); visa/remote counts are over
    the capped digest rows.
    """
    from feedmatch import dims
    matches, counts = matches_fx(spark, sf_dir, F.count_if(F.col("reject_reason").isNull()).alias("matched"),
                                 *(F.count_if(F.col("reject_reason") == r).alias(r) for r in dims.REASONS))
    top, backlog, n_fresh = _top(spark, sf_dir, matches)
    reasons = F.coalesce(F.col("reasons"), F.array().cast("array<string>"))
    sponsorship = F.coalesce(F.col("sponsorship"), F.lit(""))
    evidence = (F.when(sponsorship == "yes", F.lit(True)).when(sponsorship == "no", F.lit(False))
                 .otherwise(F.exists(reasons, lambda r: r.startswith("visa:") & (r != "visa:restricted"))))
    remote = F.coalesce((F.col("remote") == F.lit(True)) | F.array_contains(reasons, "remote"), F.lit(False))
    shown = top.agg(F.count(F.lit(1)).alias("new"), F.count_if(evidence).alias("visa_count"), F.count_if(remote).alias("remote_count")).first()
    row = counts | shown.asDict() | {
        "already_seen": counts["matched"] - n_fresh, "backlog": backlog, "based_in": FIXTURE_PREFS.home(),
        "rejected": sum(counts[r] for r in dims.HEADLINE_REJECTED)}
    row["header"] = G.header_line(row)
    texts = ("based_in", "header")
    names = ["fetched", "matched", "new", "already_seen", "backlog", *dims.REASONS, "rejected", "visa_count", "remote_count", *texts]
    return spark.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} {'string' if n in texts else 'bigint'}" for n in names))


def backlog_drain(spark, sf_dir):
    """SRT-03 + SNK-03: how successive runs over the same matches drain the backlog, until it is empty.

    Each run delivers the best ``max_jobs`` fresh rows and marks only those as
    seen. What a delivered row displaced collides with the seen row in the next
    run just as it did with the kept one, so the kept rows of every run are
    those of the first: one dedupe, and run = position / cap, rounded up.
    """
    cap = FIXTURE_PREFS.max_jobs
    kept = fresh_matches(spark, sf_dir).select("score", "title", "ord")
    runs = (G.ranked_positions(kept, digest_rank())
             .groupBy(F.ceil(F.col("position") / cap).cast("int").alias("run"))
             .agg(F.count(F.lit(1)).alias("delivered"), F.max("position").alias("_upto")))
    total = runs.agg(F.coalesce(F.max("_upto"), F.lit(0)).alias("_total"))
    return (runs.join(F.broadcast(total), F.col("_upto") <= F.col("_total"))  # one row
                .select("run", "delivered", (F.col("_total") - F.col("_upto")).alias("backlog")))


def digest_topn_backlog(spark, sf_dir):
    fresh = written(fresh_matches(spark, sf_dir), "fresh")
    top, backlog = G.top_n(fresh, FIXTURE_PREFS.max_jobs, digest_rank())
    return top.select("position", "job_key", "score", "title", F.lit(backlog).alias("backlog"))


# --- dates, salary, byte budget -------------------------------------------------------
def relative_age_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", relative_age(F.col("o_orderdate"), FIXTURE_NOW).alias("age"))


def salary_inputs(df: DataFrame) -> DataFrame:
    """Bounds, currency and period derived from part numerics (every shape of FN-13 input)."""
    k = F.col("p_partkey")
    price = F.col("p_retailprice")
    return df.select(
        k,
        F.when(k % 5 == 1, price * 100).when(k % 5 == 2, price * 100).when(k % 5 == 3, F.lit(0.5))
         .when(k % 5 == 4, F.lit(-5.0)).alias("low"),
        F.when(k % 4 == 0, price * 130).when(k % 4 == 2, price * 100)
         .when(k % 4 == 3, F.col("p_size") * 1000.0).alias("high"),
        F.when(k % 3 == 0, F.lit(" usd ")).when(k % 3 == 1, F.lit("")).alias("currency"),
        F.when(k % 6 == 0, F.lit("Yearly")).when(k % 6 == 1, F.lit("monthly"))
         .when(k % 6 == 2, F.lit(" hourly ")).when(k % 6 == 3, F.lit("annual"))
         .when(k % 6 == 4, F.lit("weekly")).alias("period"))


def salary_text(spark, sf_dir):
    s = salary_inputs(table(spark, sf_dir, "part"))
    return s.select("p_partkey", format_salary(F.col("low"), F.col("high"), F.col("currency"),
                                               F.col("period")).alias("salary"))


DIGEST_HEAD = "New matches\n\n"
DIGEST_TAIL = "\n(end of digest)"
DIGEST_BUDGET = 4000


def byte_budget_prefix(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    blocks = c.select("conv_id", "turn",
                      F.concat(F.col("role"), F.lit(": "), F.col("text"), F.lit("\n")).alias("block"))
    return G.byte_budget(blocks, "conv_id", "turn", "block", DIGEST_BUDGET,
                         len(DIGEST_HEAD.encode()), len(DIGEST_TAIL.encode()))


def seen_upsert(spark, sf_dir):
    """SNK-01: this run's matches (one row per key, first in fetch order) marked as delivered in the stored history, whose
    other key buckets keep their files."""
    m = D.with_identities(matches_fx(spark, sf_dir)[0])
    kept = [c for c in S.SEEN_COLUMNS if c in m.columns]
    first = m.groupBy("job_key").agg(F.min_by(F.struct(*kept), F.col("ord")).alias("r")).select("r.*")
    history = SeenHistory(spark, new_folder(spark, "history"), STORE_BUCKETS).create(seen_fx(spark, sf_dir))
    history.upsert(first, FIXTURE_NOW, notified=True)
    return _texts(history.rows.read())


def _texts(snap):
    """A snapshot with its times as texts."""
    return snap.select(*[F.col(c).cast("string").alias(c) if c in ("first_seen", "last_seen", "checked_at") else F.col(c) for c in snap.columns])


def seen_count(spark, sf_dir):
    """SNK-05 + SNK-06: a snapshot of an older form (no location, url_norm or fingerprint) becomes a store; its rows by the manifest."""
    old = seen_raw_fx(spark, sf_dir).withColumn("job_key", _job_key()).drop("location", "remote", "doc_id")
    history = SeenHistory(spark, new_folder(spark, "history"), STORE_BUCKETS).create(old)
    rows = history.rows.read()
    known = rows.agg(F.count_if(F.col("location").isNotNull() | F.col("url_norm").isNotNull() | F.col("fingerprint").isNotNull()).alias("with_new_columns"),
                     F.sum("notified").cast("bigint").alias("notified"))
    return known.select(F.lit(history.rows.count()).cast("bigint").alias("rows"), "notified", "with_new_columns")


def seen_backfill(spark, sf_dir):
    """SNK-04: fingerprints of rows stored under an older version computed anew, the other rows as stored."""
    stored = seen_fx(spark, sf_dir).withColumns({"fp_version": F.when(F.col("doc_id") % 2 == 0, F.lit(1)).otherwise(F.lit(S.FINGERPRINT_VERSION)),
                                                 "fingerprint": F.lit("stored")})
    return S.backfill_fingerprints(stored).select("job_key", "fingerprint", "fp_version")


VERDICTS_AT = ("1999-01-01 00:00:00", "1999-12-31 00:00:00")


def verdict_merge(spark, sf_dir):
    """SNK-02: verdicts of two runs in one store by job key; the second run touches its keys' buckets only."""
    from feedmatch.operators.store import KeyedStore
    from feedmatch.operators.verdicts import cacheable_verdicts, merge_verdicts
    from feedmatch.plans.inputs import replies_fx
    number = F.substring_index("job_key", ":", -1).cast("bigint")
    replies = replies_fx(spark, sf_dir)
    at = lambda k: F.lit(VERDICTS_AT[k]).cast("timestamp_ntz")
    first = cacheable_verdicts(replies.filter(number % 3 != 0).withColumn("checked_at", at(0)))
    # a later run: other answers to each fourth, and those that were missing
    later = replies.filter((number % 3 == 0) | (number % 4 == 0)).withColumns(
        {"checked_at": at(1), "reply": F.regexp_replace("reply", "Posting  mentions", "Second look:")})
    store = KeyedStore(spark, new_folder(spark, "verdicts"), "job_key string, verdict string, reason string, checked_at timestamp_ntz", ("job_key",), STORE_BUCKETS)
    store.create(first)
    store.update(later, merge_verdicts)
    return _texts(store.read())


ENVELOPE_KEYS = ("jobs", "data")


def payloads_from_events(events: DataFrame, *carried: str) -> DataFrame:
    """Drifting payload shapes built from events.props, by event_id % 6."""
    e, props = F.col("event_id"), F.col("props")
    body = (F.when(e % 6 == 0, F.concat(F.lit("["), props, F.lit(', 1, "x", '), props, F.lit("]")))
             .when(e % 6 == 1, F.concat(F.lit('{"jobs": ['), props, F.lit("]}")))
             .when(e % 6 == 2, F.concat(F.lit('{"data": ['), props, F.lit(", null]}")))
             .when(e % 6 == 3, F.concat(F.lit('{"jobs": null, "data": ['), props, F.lit("]}")))
             .when(e % 6 == 4, F.lit('{"results": "not a list"}'))
             .otherwise(F.concat(F.lit("not json "), props)))
    return events.select("event_id", *carried, body.alias("body"))


def json_envelope_records(spark, sf_dir):
    from feedmatch.sources.payloads import field, records
    p = payloads_from_events(table(spark, sf_dir, "events"))
    r = records(p, "body", ENVELOPE_KEYS, keep=("event_id",))
    return r.select("event_id", F.col("pos").cast("bigint").alias("pos"),
                    field(F.col("record"), "k", "bigint").alias("k"))


def visa_excerpt_q(spark, sf_dir):
    from feedmatch.operators.excerpt import visa_excerpt
    d = ensure_parallelism(table(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id", visa_excerpt(F.col("text")).alias("excerpt"))


def responses_from_events(events: DataFrame, with_page: bool = False, *carried: str) -> DataFrame:
    """Landed responses: source/board/status from event columns, body from ``payloads_from_events``."""
    from feedmatch.sources.payloads import envelope_array
    e = F.col("event_id")
    p = payloads_from_events(events, "event_type", *carried)
    arr = F.coalesce(envelope_array(F.col("body"), ENVELOPE_KEYS), F.array().cast("array<variant>"))
    objects = F.filter(arr, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    return p.select(
        F.concat(F.lit("feed"), (e % 3).cast("string")).alias("source"),
        F.col("event_type").alias("board"),
        F.when(e % 97 == 0, F.lit(500)).otherwise(F.lit(200)).alias("status"),
        F.size(objects).alias("n_records"),
        F.size(F.filter(objects, lambda x: F.try_variant_get(x, "$.k", "bigint").isNotNull())).alias("n_mapped"),
        *([(e / 250).cast("bigint").alias("page")] if with_page else []), *carried)


def source_health_q(spark, sf_dir):
    from feedmatch.operators.health import source_health
    return source_health(responses_from_events(table(spark, sf_dir, "events")))


def page_prefix_q(spark, sf_dir):
    from feedmatch.sources.payloads import page_prefix
    ev = table(spark, sf_dir, "events")
    pages = (responses_from_events(ev, with_page=True)
             .groupBy("source", "board", "page")
             .agg(F.max("status").alias("status"), F.sum("n_records").cast("bigint").alias("n_records")))
    kept = page_prefix(pages)
    return kept.groupBy("source", "board").agg(F.count(F.lit(1)).alias("pages_kept"),
                                                F.sum("n_records").cast("bigint").alias("records_kept"))


def page_rules(spark, sf_dir):
    """SRC-15: the paging rule of each source, over pages of 500 events that mostly name a next one."""
    from feedmatch.sources.payloads import page_prefix
    r = responses_from_events(table(spark, sf_dir, "events"), with_page=True)
    named = F.element_at(F.create_map(*[F.lit(x) for x in ("feed0", "himalayas", "feed1", "jobicy", "feed2", "adzuna")]), F.col("source"))
    pages = (r.withColumns({"source": named, "page": (F.col("page") / 2).cast("bigint")})
              .filter("status < 400 OR page % 7 = 6").groupBy("source", "board", "page")
              .agg(F.max("status").alias("status"), F.sum("n_records").cast("bigint").alias("n_records"))
              .withColumn("has_next", (F.col("page") + F.length("board")) % 9 != 8))
    return page_prefix(pages).groupBy("source", "board").agg(F.count(F.lit(1)).alias("pages_kept"), F.max("page").alias("last_page"),
                                                             F.sum("n_records").cast("bigint").alias("records_kept"))


def verdict_cache(spark, sf_dir):
    from feedmatch.operators.verdicts import cacheable_verdicts
    from feedmatch.plans.inputs import replies_fx
    return cacheable_verdicts(replies_fx(spark, sf_dir))


def _shape_records(p: DataFrame) -> dict:
    """postings_fx rows re-serialised as each board's record shape (payloads_fx, FIXTURES B2)."""
    iso = F.date_format(F.col("posted_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    epoch = F.unix_seconds(F.col("posted_at").cast("timestamp"))
    tag = F.get(F.col("tags"), 0)
    title = F.when(F.col("doc_id") % 50 == 0, F.lit(None).cast("string")).otherwise(F.col("title"))
    lo, hi = F.col("doc_id") * 100.0, F.col("doc_id") * 130.0
    st = F.struct
    shapes = {
        "greenhouse": st(F.col("doc_id").alias("id"), title.alias("title"), F.col("url").alias("absolute_url"),
                         st(F.col("location").alias("name")).alias("location"), F.col("description").alias("content"),
                         F.col("company").alias("company_name"), iso.alias("first_published"),
                         F.array(st(tag.alias("name"))).alias("departments")),
        "lever": st(F.col("source_id").alias("id"), title.alias("text"), F.col("url").alias("hostedUrl"),
                    st(F.col("location").alias("location"), tag.alias("team")).alias("categories"),
                    (epoch * 1000).alias("createdAt"), F.col("description").alias("description"),
                    F.when(F.col("remote"), F.lit("remote")).alias("workplaceType")),
        "ashby": st(F.col("source_id").alias("id"), title.alias("title"), F.col("url").alias("jobUrl"),
                    F.col("location").alias("location"), F.col("remote").alias("isRemote"), iso.alias("publishedAt"),
                    F.col("description").alias("descriptionHtml"), F.col("company").alias("organizationName")),
        "remotive": st(F.col("doc_id").alias("id"), F.col("url").alias("url"), title.alias("title"),
                       F.col("company").alias("company_name"), F.col("location").alias("candidate_required_location"),
                       F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("publication_date"),
                       F.col("description").alias("description"), F.col("tags").alias("tags")),
        "arbeitnow": st(F.concat(F.lit("s-"), F.col("source_id")).alias("slug"), F.col("url").alias("url"),
                        title.alias("title"), F.col("company").alias("company_name"), F.col("location").alias("location"),
                        F.col("description").alias("description"),
                        F.when(F.col("doc_id") % 2 == 0, F.col("remote").cast("string")).alias("remote"),
                        F.col("visa_sponsorship").alias("visa_sponsorship"), epoch.alias("created_at"),
                        F.array(F.lit("full time")).alias("job_types")),
        "remoteok": st(F.col("doc_id").alias("id"), title.alias("position"), F.col("url").alias("url"),
                       F.col("company").alias("company"), F.col("location").alias("location"),
                       F.col("description").alias("description"), F.col("tags").alias("tags"), epoch.alias("epoch"),
                       lo.alias("salary_min"), hi.alias("salary_max")),
        "jobicy": st(F.col("doc_id").alias("id"), F.col("url").alias("url"), title.alias("jobTitle"),
                     F.col("company").alias("companyName"), F.col("location").alias("jobGeo"),
                     F.col("description").alias("jobDescription"),
                     F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("pubDate"),
                     lo.alias("salaryMin"), hi.alias("salaryMax"), F.lit("eur").alias("salaryCurrency"),
                     F.lit("yearly").alias("salaryPeriod"), F.col("tags").alias("jobIndustry")),
        "himalayas": st(F.col("url").alias("guid"), title.alias("title"), F.col("company").alias("companyName"),
                        F.col("url").alias("applicationLink"),
                        F.array(st(F.col("location").alias("name"))).alias("locationRestrictions"),
                        F.col("description").alias("description"), epoch.alias("pubDate"),
                        lo.alias("minSalary"), hi.alias("maxSalary"), F.lit("usd").alias("currency")),
        "adzuna": st(F.col("source_id").alias("id"), title.alias("title"), F.col("url").alias("redirect_url"),
                     st(F.col("location").alias("display_name")).alias("location"),
                     st(F.col("company").alias("display_name")).alias("company"),
                     F.col("description").alias("description"), iso.alias("created")),
    }
    return shapes


def payloads_fx(spark, sf_dir, drift: bool = False) -> DataFrame:
    """Postings re-serialised per board shape (source by doc_id % 9), one record a payload.

    With ``drift``, titles of each 35th document are lists, Himalayas calls its
    titles by another name, Lever's board b1-1 and a part of Remote OK answer
    with errors, and boards are two a source.
    """
    from feedmatch.sources.mapping import ORDER, SPECS
    p = ensure_parallelism(postings_fx(spark, sf_dir), "ord")
    shapes, number = _shape_records(p), F.col("doc_id") % len(ORDER)
    shape = F.coalesce(*[F.when(number == i, F.to_json(shapes[name])) for i, name in enumerate(ORDER)])
    board = F.concat(F.lit("b"), number.cast("string"))
    status = F.lit(200)
    if drift:
        title = r'"(title|text|position|jobTitle)":("(?:[^"\\\\]|\\\\.)*")'.replace("\\\\", "\\")
        shape = F.when(F.col("doc_id") % 35 == 0, F.regexp_replace(shape, title, '"$1":[$2]')).otherwise(shape)
        shape = F.when(number == 7, F.regexp_replace(shape, '"title":', '"jobName":')).otherwise(shape)
        half = F.col("doc_id") % 2
        board = F.concat(board, F.lit("-"), half.cast("string"))
        status = F.when((number == 1) & (half == 1), F.lit(503)).when((number == 5) & (half == 0), F.lit(429)).otherwise(status)
    # Each source's own envelope; Remote OK sends a bare list.
    begins = {s.name: "[" if s.name == "remoteok" else f'{{"{s.envelope[0]}": [' for s in SPECS}
    head, tail = (F.create_map(*[F.lit(x) for name, begin in begins.items() for x in (name, pick(begin))])
                  for pick in (lambda begin: begin, lambda begin: "]" if begin == "[" else "]}"))
    p = p.withColumns({"_shape": shape, "_status": status, "_board": board,
                       "source": F.element_at(F.array(*map(F.lit, ORDER)), (number + 1).cast("int"))})
    shape, status, board = F.col("_shape"), F.col("_status"), F.col("_board")
    return p.select("source", board.alias("board"), (F.col("doc_id") / 20).cast("bigint").alias("page"), status.alias("status"),
                    F.concat(F.element_at(head, F.col("source")), shape, F.element_at(tail, F.col("source"))).alias("body"))


def mapped_fx(spark, sf_dir) -> DataFrame:
    from feedmatch.sources.mapping import map_records
    from feedmatch.sources.payloads import source_records
    return map_records(source_records(payloads_fx(spark, sf_dir)))


def map_sources_union(spark, sf_dir):
    """SRC-02..12/18: payloads of all sources parsed by the envelope reader and mapped by the source of each record."""
    return mapped_fx(spark, sf_dir).select(
        "source", "source_id", "title", "company", "url", "location", "remote",
        F.col("posted_at").cast("string").alias("posted_at"), "salary", "job_type",
        F.array_join("tags", ",").alias("tags"), F.array_join("extra.eligible_regions", "|").alias("regions"))


def ingest_to_funnel(spark, sf_dir):
    """Payloads -> postings -> funnel: how many postings of each source meet each end."""
    register = M.register_names(register_lines_fx(spark, sf_dir))
    m = M.match(cut_lineage(mapped_fx(spark, sf_dir)), FIXTURE_PREFS, FIXTURE_NOW, register, rejected_flags=False)
    return (m.groupBy("source", F.coalesce("reject_reason", F.lit("matched")).alias("reason"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("bigint").alias("score")))


def _drifted_responses(spark, sf_dir) -> DataFrame:
    from feedmatch.sources.payloads import responses
    return responses(payloads_fx(spark, sf_dir, drift=True))


def quarantine_counts(spark, sf_dir):
    """SRC-12/13: records of each answered board by what became of them."""
    r = _drifted_responses(spark, sf_dir).filter("status < 400")
    total = lambda c: F.sum(c).cast("bigint")
    return (r.groupBy("source", "board").agg(total("n_records").alias("n_records"), total("n_mapped").alias("n_mapped"),
                                             total("n_broken").alias("n_broken"))
             .withColumn("n_dropped", F.col("n_records") - F.col("n_mapped") - F.col("n_broken")))


#: A title that was sent as a list of one.
LISTED_TITLE = r'"(title|text|position|jobTitle)":\[("(?:[^"\\]|\\.)*")\]'


def quarantine_records(spark, sf_dir):
    """SRC-13: what the drifting payloads set aside, with its place and the field that broke, and what becomes of it when it is
    read again with the title taken out of its list."""
    from feedmatch.sources import quarantine as Q
    landed, again = new_folder(spark, "landed"), new_folder(spark, "replayed")
    Q.land(payloads_fx(spark, sf_dir, drift=True), landed)
    broken = Q.quarantined(spark, landed)
    Q.replay(broken, lambda sent: F.regexp_replace(sent, LISTED_TITLE, '"$1":$2'), again)
    fates = spark.read.parquet(again).select("source", "board", "page", "pos", F.col("fate").alias("replayed"))
    named = broken.select("source", "board", "page", "pos", "offending")
    n = lambda rows, *by: rows.groupBy("source", "board", "page", "pos", *by).agg(F.count(F.lit(1)).alias("n"))
    return (n(named, "offending").select("source", "board", "page", F.col("pos").cast("int").alias("pos"), F.col("offending").alias("what"), "n")
            .unionByName(n(fates, "replayed").select("source", "board", "page", F.col("pos").cast("int").alias("pos"),
                                                     F.concat(F.lit("replayed: "), "replayed").alias("what"), "n")))


def unhealthy_sources(spark, sf_dir):
    """AGG-05/06/10 over drifting payloads."""
    from feedmatch.operators.health import source_health, unhealthy
    return unhealthy(source_health(_drifted_responses(spark, sf_dir))).drop("healthy")


def tumbling_event_counts(spark, sf_dir):
    from feedmatch.streaming.ingest import tumbling_counts
    ev = table(spark, sf_dir, "events")
    return tumbling_counts(ev, "ts", ["event_type"]).select(
        F.col("window_start").cast("string").alias("window_start"), "event_type", "n")


def stream_ingest_dedupe(spark, sf_dir):
    """Landed events as a file stream; keys downloaded again, with the first download or a day later, are dropped within the watermark."""
    from feedmatch.streaming.ingest import ingest_dedupe
    events = table(spark, sf_dir, "events")
    again = events.withColumn("ts", F.expr("ts + INTERVAL 1 HOUR"))
    landing, out = new_folder(spark, "events"), new_folder(spark, "events_dedup")
    for landed in (events.unionByName(again.filter("event_id % 10 = 0")), again.filter("event_id % 10 = 5")):
        landed.write.mode("append").parquet(landing)
        kept = ingest_dedupe(spark, landing, events.schema, "event_id", "ts", out)
    return kept.select("event_id", "user_id", "event_type")


HEALTH_DAYS, HEALTH_BATCHES, HEALTH_DELAY = 8, 4, 2


def windowed_health_q(spark, sf_dir):
    """STR-05: responses land in four batches of eight days, some one or two batches late; windows that the watermark has closed."""
    from feedmatch.streaming.ingest import land_windowed_health
    events = table(spark, sf_dir, "events")
    e, first = F.col("event_id"), events.agg(F.to_date(F.min("ts")).alias("first"))
    days = F.datediff("ts", "first")
    late = F.when(e % 101 == 0, 2).when(e % 11 == 0, 1).otherwise(0)
    batch = F.least(F.lit(HEALTH_BATCHES - 1), F.floor(days / HEALTH_DAYS) + late).cast("int")
    responses = responses_from_events(events.crossJoin(F.broadcast(first)).withColumn("batch", batch), False, "ts", "batch")  # one row
    responses = written(responses.drop("board"), "responses")
    landing, out = new_folder(spark, "responses"), new_folder(spark, "health")
    for k in range(HEALTH_BATCHES):
        responses.filter(F.col("batch") == k).drop("batch").write.mode("append").parquet(landing)
        windows = land_windowed_health(spark, landing, responses.drop("batch").schema, "ts", out, delay=f"{HEALTH_DELAY} days")
    return windows


def register_reader(spark, sf_dir):
    """SRC-16: the register written as a list and as a CSV, read back; a file that isn't there is empty."""
    from feedmatch.sources.payloads import read_register
    root = new_folder(spark, "register")
    lines = register_lines_fx(spark, sf_dir)
    lines.select("line").write.text(f"{root}/list")
    lines.select("line", F.lit("a, second column")).write.option("escape", '"').csv(f"{root}/names.csv")
    read = {"list": f"{root}/list", "csv": f"{root}/names.csv", "missing": f"{root}/none.csv"}
    parts = [M.register_names(read_register(spark, path)).withColumn("origin", F.lit(name)) for name, path in read.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SELECTED = Prefs.from_dict({"sources": {"remotive": False}, "ats_boards": {"lever": ["b1"], "greenhouse": ["b0", "elsewhere"]}})


def selected_sources(spark, sf_dir):
    """SRC-14: payloads laid out by source and board; only the folders of enabled sources and listed boards are read."""
    from feedmatch.sources.mapping import select_sources
    folder = new_folder(spark, "payloads")
    payloads_fx(spark, sf_dir).write.partitionBy("source", "board").parquet(folder)
    return select_sources(spark.read.parquet(folder), SELECTED).groupBy("source", "board").agg(F.count(F.lit(1)).alias("n"))


def run_ledger(spark, sf_dir):
    """SNK-03 + EXT-03: a whole run that delivers its digest to a sink: the committed steps, and what the sink got."""
    from feedmatch.job import run
    out, sent = new_folder(spark, "run"), new_folder(spark, "sent")
    found = run(postings_fx(spark, sf_dir), seen_fx(spark, sf_dir), FIXTURE_PREFS, FIXTURE_NOW, "deliver", out,
                register=M.register_names(register_lines_fx(spark, sf_dir)), sink=lambda d: d.write.parquet(sent))
    got = spark.read.parquet(sent).agg(F.lit("sent").alias("step"), F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("note"))
    return found.ledger.rows().select("step", "rows", "note").unionByName(got)


#: Frequent words of the four languages; with all their pairs a list of over a thousand keywords.
INDEX_WORDS = ("the", "of", "and", "to", "in", "is", "on", "that", "der", "die", "und", "den", "zu", "ein", "von", "ist",
               "le", "la", "les", "de", "et", "que", "un", "en", "el", "los", "con", "por", "del", "una", "se", "al")
INDEX_KEYWORDS = (*INDEX_WORDS, "The", "c++", *(f"{a} {b}" for a in INDEX_WORDS for b in INDEX_WORDS))


def keyword_index_q(spark, sf_dir):
    """FN-07 with over a thousand keywords, in one pass over the words."""
    from feedmatch.functions.text import keyword_index
    d = ensure_parallelism(table(spark, sf_dir, "documents"), "doc_id")
    hits = keyword_index(F.lower(F.coalesce("text", F.lit(""))), INDEX_KEYWORDS)
    return d.select("doc_id", hits.alias("hits")).select("doc_id", F.size("hits").alias("n"), F.array_join("hits", ",").alias("hits"))


def funnel_counts_whole(spark, sf_dir):
    """FLT-16/18 without their windows: residency phrases and languages of whole texts."""
    m = annotated_fx(spark, sf_dir, WHOLE_PREFS, "whole", "funnel")
    return (m.groupBy(F.coalesce("reject_reason", F.lit("matched")).alias("reason"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("bigint").alias("score")))


STREAM_PARTS, STREAM_CAP = 3, 300


def stream_cross_batch(spark, sf_dir):
    """STR-03: postings land on three days, reposts on another day than their original; each day is one batch, and the batches
    after them deliver what is still held, until nothing is."""
    columns = ("ord", "source", "source_id", "title", "company", "url", "location", "remote")
    landed = cut_lineage(postings_fx(spark, sf_dir).select(*columns))
    landing, out = new_folder(spark, "landing"), new_folder(spark, "fresh")
    for day in range(STREAM_PARTS):
        landed.filter(F.col("ord") % STREAM_PARTS == day).write.mode("append").parquet(landing)
        queue = stream_fresh(landing, landed.schema, seen_fx(spark, sf_dir), out, STREAM_CAP, FIXTURE_NOW, buckets=STORE_BUCKETS)
    deliver_rest(queue, out, STREAM_CAP, STREAM_PARTS)
    shown = [F.col("batch").cast("int").alias("batch"), F.col("position").cast("int").alias("position"), "job_key", "ord",
             F.col("held").cast("bigint").alias("held")]
    return spark.read.parquet(f"{out}/delivered").select(*shown).unionByName(spark.read.parquet(f"{out}/rest").select(*shown))


QUERIES = {
    "funnel_counts": funnel_counts,
    "seniority_levels": seniority_levels,
    "company_fold": company_fold,
    "hard_restriction": hard_restriction,
    "move_offer": move_offer,
    "remote_eligibility": remote_eligibility,
    "relocation_assessment": relocation_assessment,
    "scored_matches": scored_matches,
    "keyword_hits": keyword_hits_q,
    "html_to_text": html_to_text,
    "url_normalize_dups": url_normalize_dups,
    "posting_language_confusion": posting_language_confusion,
    "place_key_bucket": place_key_bucket,
    "seen_antijoin": seen_antijoin,
    "greedy_dedupe": greedy_dedupe_q,
    "digest_topn_backlog": digest_topn_backlog,
    "digest_grouped": digest_grouped,
    "run_summary": run_summary,
    "backlog_drain": backlog_drain,
    "relative_age": relative_age_q,
    "salary_text": salary_text,
    "byte_budget_prefix": byte_budget_prefix,
    "seen_upsert": seen_upsert,
    "json_envelope_records": json_envelope_records,
    "visa_excerpt": visa_excerpt_q,
    "stream_ingest_dedupe": stream_ingest_dedupe,
    "source_health": source_health_q,
    "page_prefix": page_prefix_q,
    "verdict_cache": verdict_cache,
    "map_sources_union": map_sources_union,
    "tumbling_event_counts": tumbling_event_counts,
    "funnel_counts_strict": funnel_counts_strict,
    "relocation_evidence": relocation_evidence,
    "rejects": rejects_q,
    "digest_facts": digest_facts,
    "verdict_applied": verdict_applied,
    "to_classify": to_classify_q,
    "ingest_to_funnel": ingest_to_funnel,
    "quarantine_counts": quarantine_counts,
    "unhealthy_sources": unhealthy_sources,
    "stream_cross_batch": stream_cross_batch,
    "quarantine_records": quarantine_records,
    "seen_count": seen_count,
    "windowed_health": windowed_health_q,
    "register_reader": register_reader,
    "selected_sources": selected_sources,
    "run_ledger": run_ledger,
    "keyword_index": keyword_index_q,
    "funnel_counts_whole": funnel_counts_whole,
    "seen_backfill": seen_backfill,
    "verdict_merge": verdict_merge,
    "page_rules": page_rules,
}
