"""The matching funnel, evidence, work mode, relocation and scoring.

``match(postings, prefs, now, register)`` adds one ``reject_reason`` per row
(first failing rule in fixed order, NULL for a match) plus the score and the
display columns.  Everything is a Column expression over one row: no shuffle
except the optional register join.  Rules are ordered cheap-first and the
expensive relocation rules sit behind the earlier reasons inside a lazy CASE,
so they only run on rows that survived everything before them.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmatch import dims
from feedmatch.functions import patterns as P
from feedmatch.functions.regex import any_phrase, trie_alternation
from feedmatch.functions.text import (any_phrase_in, bound, contains_any, fold_company, haystack, initcap_word,
                                      keyword_hits, matches, rx, segments, sentences, strip_ws)
from feedmatch.operators.partitioning import ensure_parallelism
from feedmatch.prefs import Prefs


def ts_lit(value: datetime) -> Column:
    """A naive UTC instant as a TIMESTAMP_NTZ literal (never ``current_timestamp``)."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _in_list(col: Column, values) -> Column:
    values = list(values)
    return col.isin(values) if values else F.lit(False)


# --- seniority (FLT-05/06) -----------------------------------------------------
def seniority(title) -> Column:
    t = F.lower(strip_ws(F.coalesce(title, F.lit(""))))
    expr = F.when(t == "", F.lit(dims.UNKNOWN_LEVEL))
    for level, template in P.SENIORITY:
        expr = expr.when(t.rlike(rx(template)), F.lit(level))
    return expr.otherwise(F.lit(dims.UNKNOWN_LEVEL))


def seniority_allowed(level: Column, prefs: Prefs) -> Column:
    allow = [a.lower().strip() for a in prefs.seniority_allow]
    if not allow:
        return F.lit(True)
    return F.when(level == dims.UNKNOWN_LEVEL, F.lit(prefs.seniority_keep_unknown)) \
        .otherwise(_in_list(level, allow))


# --- evidence (FLT-08/09) ----------------------------------------------------------
def hard_restriction(h: Column) -> Column:
    return matches(F.coalesce(h, F.lit("")), P.HARD_RESTRICTION)


def offers_move(h: Column) -> Column:
    """FLT-09: some move-offer occurrence with no negation in the 30 chars before it.

    Occurrences are the non-overlapping leftmost matches.  ``split`` gives the
    text between them and ``regexp_extract_all`` the matches themselves; a fold
    carries the last 30 characters seen, so each occurrence is judged on
    exactly the text that precedes it.
    """
    move, neg, n = rx(P.MOVE_OFFER), rx(P.NEGATION), P.NEGATION_LOOKBACK
    init = F.struct(F.lit("").alias("tail"), F.lit(False).alias("ok"))

    def step(acc, x):
        window = F.substring(F.concat(acc["tail"], x["p"]), -n, n)
        return F.struct(
            F.substring(F.concat(window, x["m"]), -n, n).alias("tail"),
            (acc["ok"] | ~window.rlike(neg)).alias("ok"))

    def judged(found):
        # (text before occurrence i, occurrence i) pairs, built once per row.
        pairs = F.zip_with(F.slice(F.split(h, move, -1), 1, F.size(found)), found,
                           lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        return F.when(F.size(found) == 0, F.lit(False)).otherwise(F.aggregate(pairs, init, step)["ok"])

    return F.when(~contains_any(h, P.NEEDLES[P.MOVE_OFFER]), F.lit(False)) \
        .otherwise(bound(F.regexp_extract_all(h, F.lit(move), 0), judged))


# --- geography (FLT-12..17) -----------------------------------------------------
def geo_matches(location_l: Column, segs: Column, prefs: Prefs) -> Column:
    tokens = prefs.geo_tokens()
    if not tokens:
        return F.lit(True)
    short = [t for t in tokens if len(t) <= 2]
    long_ = [t for t in tokens if len(t) > 2]
    hit = F.lit(False)
    if short:
        hit = hit | F.arrays_overlap(segs, _arr(short))
    if long_:
        hit = hit | any_phrase_in(location_l, long_)
    return (location_l != "") & hit


def _place_geo(place: Column, prefs: Prefs) -> Column:
    """``geo_matches`` applied to one location segment (its only segment is itself)."""
    tokens = prefs.geo_tokens()
    if not tokens:
        return F.lit(True)
    short = [t for t in tokens if len(t) <= 2]
    long_ = [t for t in tokens if len(t) > 2]
    return _in_list(place, short) | any_phrase_in(place, long_)


def remote_place_allowed(location_l: Column, segs: Column, prefs: Prefs) -> Column:
    """What FLT-16 says of the location alone."""
    ok = F.lit(True)
    if not prefs.us_targeted():
        ok = ok & ~matches(location_l, P.US_ONLY, ("only", "must", "authorized"))
    for p in prefs.active_reject_locations():
        ok = ok & ~location_l.contains(p)
    accept = prefs.accept_locations()
    if not accept:
        return ok
    named = F.array_except(segs, _arr(dims.WORK_MODE_WORDS))
    accept_any = any_phrase(accept)
    place_ok = F.exists(named, lambda pl: _in_list(pl, accept) | matches(pl, accept_any)
                        | _place_geo(pl, prefs))
    return ok & ((location_l == "") | (F.size(named) == 0) | place_ok)


def remote_location_allowed(location_l: Column, segs: Column, h: Column, prefs: Prefs) -> Column:
    """FLT-16: remote eligibility of the location (+ US/Canada-only prose)."""
    ok = remote_place_allowed(location_l, segs, prefs)
    if prefs.us_targeted():
        return ok
    blob = F.concat(location_l, F.lit(" "), h)
    if prefs.us_only_chars is not None:
        blob = F.substring(blob, 1, prefs.us_only_chars)
    return ok & ~matches(blob, P.US_ONLY, ("only", "must", "authorized"))


# --- relocation (FLT-18..25) ------------------------------------------------------
_LETTERS = P.WORD[:-1]
_STOP_RX = (f"(?<!{_LETTERS})"
            f"{trie_alternation(sorted({w for ws in dims.STOPWORDS.values() for w in ws}))}"
            f"(?!{_LETTERS})")


def stopwords_found(h: Column, window: int | None = None) -> Column:
    """The function words of all languages in the first ``window`` characters (None: the whole text), in order.

    A word is a maximal run of the WORD class, so guarding the trie of all
    stopwords with that same class extracts exactly the words Python's
    tokenizer would count, in one pass.
    """
    return F.regexp_extract_all(h if window is None else F.substring(h, 1, window), F.lit(_STOP_RX), 0)


def language_counts(found: Column) -> Column:
    """Per-language counts (declaration order) from ``stopwords_found``."""
    # ``isin`` looks a word up in a hashed set; ``array_contains`` would compare it with the whole vocabulary.
    def count_of(ws):
        return F.size(F.filter(found, lambda w: w.isin(*ws)))
    return F.array(*[count_of(ws) for ws in dims.STOPWORDS.values()])


def language_of(counts: Column) -> Column:
    """FLT-18 decision over ``language_counts``: ties go to the earlier language."""
    langs = list(dims.STOPWORDS)
    c = [F.get(counts, i) for i in range(len(langs))]
    best = F.array_max(counts)
    expr = F.when(c[0] == best, F.lit(langs[0]))
    for i, lang in enumerate(langs[1:], start=1):
        expr = expr.when(c[i] == best, F.when((c[i] >= dims.LANGUAGE_MIN_WORDS)
                                              & (c[i] > c[0] * dims.LANGUAGE_RATIO),
                                              F.lit(lang)).otherwise(F.lit(langs[0])))
    return expr


def posting_language(h: Column) -> Column:
    """FLT-18 in one expression (materialise ``stopwords_found`` first when reused)."""
    return language_of(language_counts(stopwords_found(h)))


def required_language(h: Column, spoken) -> Column:
    candidates = [(lang, names) for lang, names in dims.LANGUAGE_NAMES.items() if lang not in spoken]
    if not candidates:
        return F.lit(None).cast("string")
    req, soft = rx(P.REQUIRED_WORDS), rx(P.SOFT_WORDS)
    names = [n for _, ns in candidates for n in ns]
    strict = F.filter(sentences(h), lambda s: s.rlike(req) & ~s.rlike(soft))
    # A sentence-level hit implies a hit on the whole text: gate the split.
    gate = matches(h, P.REQUIRED_WORDS) & any_phrase_in(h, names)

    def lang_of(s):
        expr = None
        for lang, names in candidates:
            cond = s.rlike(rx(any_phrase(names)))
            expr = F.when(cond, F.lit(lang)) if expr is None else expr.when(cond, F.lit(lang))
        return expr

    found = F.get(F.filter(F.transform(strict, lang_of), lambda x: x.isNotNull()), 0)
    return F.when(gate, found)


def eligible_places(regions: Column, location_l: Column) -> Column:
    from_regions = F.filter(F.transform(regions, lambda r: F.lower(strip_ws(r))), lambda r: r != "")
    from_location = F.array_sort(F.array_except(segments(location_l, P.PLACES_SPLIT),
                                                _arr(dims.WORK_MODE_WORDS)))
    return F.when(F.size(F.coalesce(regions, F.array())) > 0, from_regions).otherwise(from_location)


def place_includes_home(place: Column, prefs: Prefs) -> Column:
    return _in_list(place, dims.OPEN_EVERYWHERE) | any_phrase_in(place, prefs.home_tokens())


def residency_elsewhere(h: Column, prefs: Prefs) -> Column:
    pat, not_place = rx(P.RESIDENCY), rx(P.NOT_A_PLACE)

    def elsewhere(p):
        return (p != "") & ~place_includes_home(p, prefs) & ~(p.rlike(not_place) | p.contains("time"))

    # The text is searched once; which of the pattern's groups holds the place is read from the short matches.
    found = F.regexp_extract_all(h, F.lit(pat), F.lit(0))
    places = F.transform(found, lambda m: strip_ws(F.coalesce(
        *(F.nullif(F.regexp_extract(m, pat, i), F.lit("")) for i in (1, 2, 3)), F.lit(""))))
    return contains_any(h, P.NEEDLES[P.RESIDENCY]) & F.exists(places, elsewhere)


def local_only(h: Column) -> Column:
    sents = sentences(h)
    offer, no_reloc, local = rx(P.RELOCATION_OFFER), rx(P.NO_RELOCATION), rx(P.LOCAL_ONLY)
    offers = F.exists(sents, lambda s: s.rlike(offer) & ~s.rlike(no_reloc))
    # A sentence-level hit implies a hit on the whole text: gate the split.
    return matches(h, P.LOCAL_ONLY) & ~offers & F.exists(sents, lambda s: s.rlike(local))


def evidence_highlight(on_register: Column, flagged: Column, visa_hits: Column) -> Column:
    return (F.when(on_register, F.lit(dims.HL_REGISTER))
            .when(flagged, F.lit(dims.HL_SOURCE_FLAG))
            .when(F.size(visa_hits) > 0,
                  F.concat(F.lit("Mentions "), F.array_join(F.slice(visa_hits, 1, 2), ", ")))
            .otherwise(F.lit(dims.HL_GENERIC)))


def assess(df_cols: dict, prefs: Prefs) -> Column:
    """FLT-25 as one CASE producing struct(reason, highlight)."""
    home = prefs.home()

    def out(reason, highlight):
        r = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
        hl = highlight if isinstance(highlight, Column) else F.lit(highlight).cast("string")
        return F.struct(r.alias("reason"), hl.alias("highlight"))

    if not home:
        return out(None, "")
    h, r_ok = df_cols["haystack"], df_cols["remote_ok"]
    likely, restricted = df_cols["sponsorship_likely"], df_cols["restricted"]
    places = df_cols["places"]
    evidence = evidence_highlight(df_cols["on_register"], df_cols["flagged"], df_cols["visa_hits"])
    spoken = prefs.spoken()
    written = df_cols["written_in"]
    needed = df_cols["needed_lang"]
    open_to_home = (F.size(places) == 0) | F.exists(places, lambda p: place_includes_home(p, prefs))
    worldwide = (F.size(places) == 0) | F.forall(places, lambda p: _in_list(p, dims.OPEN_EVERYWHERE))
    remote_hl = F.when(worldwide, F.lit(dims.HL_WORLDWIDE)).otherwise(F.lit("Open to " + home.title()))
    limit = F.when(F.size(places) > 0, F.array_join(places, ", ")).otherwise(F.lit("another country"))

    expr = F.when(~_in_list(written, spoken),
                  out(F.concat(F.lit("posting written in "), initcap_word(written)), ""))
    expr = expr.when(needed.isNotNull(), out(F.concat(F.lit("requires "), initcap_word(needed)), ""))
    expr = expr.when(df_cols["clearance"], out("citizenship or security clearance required", ""))
    expr = expr.when(r_ok & open_to_home & ~residency_elsewhere(h, prefs), out(None, remote_hl))
    if not prefs.candidate_needs_visa:
        return expr.otherwise(out(None, evidence))
    expr = expr.when(restricted, out("posting rules out visa sponsorship", ""))
    expr = expr.when(local_only(h), out("local candidates only / no relocation", ""))
    expr = expr.when(r_ok & ~likely, out(F.concat(F.lit("remote, but only for people in "), limit), ""))
    if prefs.candidate_require_evidence:
        expr = expr.when(~likely, out("no visa sponsorship or relocation support mentioned", ""))
    return expr.otherwise(out(None, evidence))


# --- scoring (PRJ-01..04) -----------------------------------------------------------
def _capped(n: Column, cap: int) -> Column:
    return n if cap <= 0 else F.least(n, F.lit(cap))


def location_bonus(location_l: Column, prefs: Prefs) -> Column:
    terms = [F.lit(0)]
    for name, weight in prefs.location_weights.items():
        tokens = prefs.weight_tokens(name)
        if tokens:
            terms.append(F.when(any_phrase_in(location_l, tokens), F.lit(int(weight))))
    return F.greatest(*terms) if len(terms) > 1 else F.lit(0)


# --- register (JN-01) ----------------------------------------------------------------
def register_names(lines: DataFrame, col: str = "line") -> DataFrame:
    """SRC-16 + AGG-09: skip blanks and comment lines, fold, drop empties, distinct."""
    c = F.col(col)
    kept = lines.filter((strip_ws(c) != "") & ~F.regexp_replace(c, "^" + P.WS + "+", "").startswith("#"))
    return (kept.select(fold_company(c).alias("company_norm"))
            .filter(F.col("company_norm") != "").distinct())


# --- the whole thing -----------------------------------------------------------------
def _too_old(prefs: Prefs, now: datetime) -> Column:
    if prefs.max_age_days <= 0:
        return F.lit(False)
    cutoff = ts_lit(now - timedelta(days=prefs.max_age_days))
    return F.col("posted_at").isNotNull() & (F.col("posted_at") < cutoff)


def _title_bad(title_l: Column, prefs: Prefs) -> Column:
    bad = any_phrase_in(title_l, prefs.title_exclude)
    return bad | ~any_phrase_in(title_l, prefs.title_include) if prefs.title_include else bad


def may_match(postings: DataFrame, prefs: Prefs, now: datetime) -> DataFrame:
    """The postings that no rule over date, title and location rejects: for who wants matches only, not the reasons of the others.

    A location rejects where it is neither in the target places nor, whatever the text says, open to remote work.
    """
    def placed(loc_l: Column, segs: Column) -> Column:
        ok = F.lit(False)
        if prefs.accept_hybrid or prefs.accept_onsite:
            ok = ok | geo_matches(loc_l, segs, prefs)
        return ok | remote_place_allowed(loc_l, segs, prefs) if prefs.accept_remote else ok

    title, location = F.col("title"), F.lower(F.coalesce(F.col("location"), F.lit("")))
    # Bound, since the planner puts what a location is made of wherever the filter reads it.
    in_place = bound(location, lambda loc_l: bound(segments(loc_l), lambda segs: placed(loc_l, segs)))
    return postings.filter(in_place & ~(_too_old(prefs, now) | _title_bad(F.lower(F.coalesce(title, F.lit(""))), prefs)
                                      | ~seniority_allowed(seniority(title), prefs)))


def match(postings: DataFrame, prefs: Prefs, now: datetime,
          register: DataFrame | None = None, rejected_flags: bool = True) -> DataFrame:
    """Annotate every posting with ``reject_reason`` and, for matches, score + display.

    Output = input columns + haystack-derived flags, ``seniority``,
    ``reject_reason``, ``reloc_reason``, ``highlight``, ``score``, ``reasons``,
    ``sponsorship``, ``sponsorship_reason``, ``company_norm``, ``on_register``.
    Columns are added in a few staged projections: each stage only reads
    columns materialised by an earlier one, so no text rule is evaluated twice.
    Without ``rejected_flags`` a rule only runs on rows that no earlier one
    rejected; the reasons are the same, the flags that rejected rows then lack
    are NULL.
    """
    key = ["ord"] if "ord" in postings.columns else []
    df = ensure_parallelism(postings, *key).withColumn("company_norm", fold_company(F.col("company")))
    if register is not None:
        flagged = register.select("company_norm").withColumn("on_register", F.lit(True))
        df = df.join(flagged, "company_norm", "left")  # broadcast by its size, else AQE splits a hot company
        on_register = F.coalesce(F.col("on_register"), F.lit(False)) & (F.col("company_norm") != "")
    else:
        on_register = F.lit(False)
    too_old, pre, undecided = _too_old(prefs, now), F.col("pre_reason"), F.col("pre_reason").isNull()

    def where(needed: Column, flags: dict[str, Column]) -> dict[str, Column]:
        return flags if rejected_flags else {name: F.when(needed, flag) for name, flag in flags.items()}

    # Stage 1: text built once and reused by every rule below.
    df = df.withColumns({
        "on_register": on_register,
        **where(~too_old, {"haystack": haystack()}),
        "title_l": F.lower(F.coalesce(F.col("title"), F.lit(""))),
        "location_l": F.lower(F.coalesce(F.col("location"), F.lit(""))),
        "seniority": seniority(F.col("title")),
    })
    h, title_l, loc_l = F.col("haystack"), F.col("title_l"), F.col("location_l")
    flagged_src = F.coalesce(F.col("visa_sponsorship"), F.lit(False))

    # Stage 2: the funnel up to work mode (first failure wins), with the evidence and mode flags that it reads.
    df = df.withColumn("pre_reason", F.when(too_old, F.lit("too_old"))
                       .when(any_phrase_in(h, prefs.exclude_keywords), F.lit("excluded_keyword"))
                       .when(_title_bad(title_l, prefs), F.lit("rejected_title"))
                       .when(~seniority_allowed(F.col("seniority"), prefs), F.lit("rejected_seniority")))
    df = df.withColumns(where(undecided, {"include_hits": keyword_hits(h, prefs.include_keywords)}))
    if prefs.include_keywords:
        df = df.withColumn("pre_reason", F.coalesce(pre, F.when(F.size("include_hits") == 0, F.lit("no_keyword"))))
    df = df.withColumns(where(undecided, {
        "segments": segments(loc_l),
        "is_remote": (F.coalesce(F.col("remote"), F.lit(False)) | matches(loc_l, P.REMOTE_HINT)
                      | matches(h, P.REMOTE_HINT)),
        "is_hybrid": matches(h, P.HYBRID_HINT),
        "places": eligible_places(F.col("extra.eligible_regions"), loc_l),
    }))
    segs, restricted, is_remote = F.col("segments"), F.col("restricted"), F.col("is_remote")
    df = df.withColumns(where(undecided, {
        "geo_ok": geo_matches(loc_l, segs, prefs),
        "remote_ok": (is_remote & remote_location_allowed(loc_l, segs, h, prefs))
                     if prefs.accept_remote else F.lit(False),
    }))
    geo, r_ok = F.col("geo_ok"), F.col("remote_ok")
    h_ok = F.col("is_hybrid") & F.lit(prefs.accept_hybrid) & geo
    onsite_geo = F.lit(prefs.accept_onsite) & geo
    location_bad = ~(r_ok | h_ok | onsite_geo)
    if prefs.remote_only:
        location_bad = ~is_remote | location_bad
    df = df.withColumns({
        "hybrid_ok": h_ok,
        "onsite_ok": onsite_geo & ~h_ok & (~is_remote | ~r_ok),
        "_location_bad": location_bad,
    })
    bad_location = F.when(F.col("_location_bad"), F.lit("rejected_location"))

    def sponsorship(df: DataFrame, asked: Column) -> DataFrame:
        df = df.withColumns(where(asked, {"restricted": hard_restriction(h)}))
        df = df.withColumns(where(asked, {
            "visa_hits": F.when(restricted, F.array().cast("array<string>"))
                          .otherwise(keyword_hits(h, prefs.visa_keywords)),
            "offers_move": offers_move(h),
        }))
        return df.withColumn("sponsorship_likely", ~restricted & (
            flagged_src | F.col("on_register") | (F.size("visa_hits") > 0) | F.col("offers_move")))

    # Sponsorship is asked before the location only where it rejects, else of rows that nothing before the relocation rules
    # that read it has rejected.
    if prefs.visa_require:
        df = sponsorship(df, undecided)
        bad_location = F.when(~F.col("sponsorship_likely"), F.lit("rejected_visa")).otherwise(bad_location)
    df = df.withColumn("pre_reason", F.coalesce(pre, bad_location))

    # Stage 3: relocation, only for rows that passed everything else.
    survivor = F.col("pre_reason").isNull()
    if prefs.home():
        df = df.withColumn("_stop", F.when(survivor, stopwords_found(h, prefs.language_chars)))
        df = df.withColumn("_lang_counts", language_counts(F.col("_stop")))
        df = df.withColumn("written_in", language_of(F.col("_lang_counts")))
        read = survivor & _in_list(F.col("written_in"), prefs.spoken())
        df = df.withColumn("needed_lang", F.when(survivor if rejected_flags else read, required_language(h, prefs.spoken())))
        df = df.withColumn("_clearance", F.when(read & F.col("needed_lang").isNull(), matches(h, P.CLEARANCE)))
        open_yet = read & F.col("needed_lang").isNull() & ~F.col("_clearance")
    else:
        df = df.withColumns({"written_in": F.lit("english"),
                             "needed_lang": F.lit(None).cast("string"), "_clearance": F.lit(False)})
        open_yet = survivor
    if not prefs.visa_require:
        df = sponsorship(df, open_yet)
    cols = {"haystack": h, "remote_ok": r_ok, "sponsorship_likely": F.col("sponsorship_likely"),
            "restricted": restricted, "places": F.col("places"), "on_register": F.col("on_register"),
            "flagged": flagged_src, "visa_hits": F.col("visa_hits"),
            "written_in": F.col("written_in"), "needed_lang": F.col("needed_lang"), "clearance": F.col("_clearance")}
    df = df.withColumn("eligibility", F.when(survivor, assess(cols, prefs)))
    df = df.withColumn("reject_reason", F.coalesce(
        F.col("pre_reason"), F.when(F.col("eligibility.reason").isNotNull(), F.lit("rejected_relocation"))))

    # Stage 4: score and reasons (matches only).
    title_hits = keyword_hits(title_l, prefs.include_keywords)
    score = (F.lit(prefs.weight("title_hit")) * _capped(F.size(title_hits), prefs.cap("title_hit"))
             + F.lit(prefs.weight("keyword_hit")) * _capped(F.size("include_hits"), prefs.cap("keyword_hit"))
             + F.when(is_remote, F.lit(prefs.weight("remote"))).otherwise(F.lit(0))
             + F.lit(prefs.weight("visa_hit")) * _capped(F.size("visa_hits"), prefs.cap("visa_hit"))
             + F.when(F.col("on_register"), F.lit(prefs.weight("sponsor_register"))).otherwise(F.lit(0))
             + F.when(restricted, F.lit(prefs.weight("visa_restricted"))).otherwise(F.lit(0))
             + location_bonus(loc_l, prefs))
    visa_reason = (F.when(restricted, F.lit("visa:restricted"))
                   .when(F.size("visa_hits") > 0,
                         F.concat(F.lit("visa:"), F.array_join(F.slice("visa_hits", 1, 3), ",")))
                   .when(flagged_src, F.lit("visa:source-flagged")))
    reasons = F.array_compact(F.array(
        F.when(r_ok, F.lit("remote")),
        F.when(F.col("hybrid_ok"), F.lit("hybrid")),
        F.when(F.col("onsite_ok"), F.lit("onsite")),
        F.when(F.size("include_hits") > 0,
               F.concat(F.lit("keywords:"), F.array_join(F.slice("include_hits", 1, 5), ","))),
        F.when(F.col("on_register"), F.lit("visa:sponsor-register")),
        visa_reason))
    matched = F.col("reject_reason").isNull()
    return (df.withColumns({
                "score": F.when(matched, score.cast("int")),
                "reasons": F.when(matched, reasons),
                "reloc_reason": F.col("eligibility.reason"),
                "highlight": F.when(matched, F.col("eligibility.highlight")),
                "sponsorship": F.when(matched & restricted, F.lit("no")),
                "sponsorship_reason": F.when(matched & restricted, F.lit(dims.RESTRICTED_REASON)),
            })
            .drop("eligibility", "pre_reason", "_location_bad", "_stop", "_lang_counts", "_clearance"))


HEAVY_COLUMNS = ("description", "haystack", "segments", "places", "written_in", "needed_lang")


def narrow(matched: DataFrame) -> DataFrame:
    """The annotated postings without the text-sized columns (for materialising)."""
    return matched.drop(*[c for c in HEAVY_COLUMNS if c in matched.columns])


def rejects(matched: DataFrame) -> DataFrame:
    """SNK-07: the audit of dropped postings, to be written with ``partitionBy("reject_reason")``."""
    return (matched.filter(F.col("reject_reason").isNotNull())
                   .select("ord", F.concat(F.col("source"), F.lit(":"), F.col("source_id")).alias("job_key"),
                           "reject_reason", F.coalesce("reloc_reason", F.lit("")).alias("reloc_reason")))
