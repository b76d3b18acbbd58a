"""DuckDB renderings of the operators, for the correctness oracle.

This is an independent SQL statement of the same rules: RE2 patterns with
consuming word guards, DuckDB list lambdas instead of Spark higher-order
functions.  Each builder returns SQL text; ``matched_ctes`` chains them into
CTEs ending in a relation ``m`` with the columns the Spark operator produces.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from feedmatch import dims
from feedmatch.functions import patterns as P
from feedmatch.functions.regex import DUCKDB, any_phrase, phrase, sql_literal as lit
from feedmatch.prefs import Prefs
from feedmatch.sources import fixtures as fx


def rx(template: str) -> str:
    return lit(P.render(template, DUCKDB))


def rm(col: str, template: str | None) -> str:
    if template is None:
        return "FALSE"
    return f"regexp_matches({col}, {rx(template)})"


def arr(values) -> str:
    values = list(values)
    if not values:
        return "CAST([] AS VARCHAR[])"
    return "[" + ", ".join(lit(v) for v in values) + "]"


def in_list(col: str, values) -> str:
    values = list(values)
    if not values:
        return "FALSE"
    return f"{col} IN ({', '.join(lit(v) for v in values)})"


def ws_strip(col: str) -> str:
    return f"regexp_replace({col}, {lit('^' + P.WS + '+|' + P.WS + '+$')}, '', 'g')"


def strip_html(col: str) -> str:
    c = f"regexp_replace(coalesce({col}, ''), {lit(P.TAG)}, ' ', 'g')"
    for ent, ch in P.HTML_ENTITIES:
        c = f"replace({c}, {lit(ent)}, {lit(ch)})"
    c = f"regexp_replace({c}, {lit(P.WS + '+')}, ' ', 'g')"
    c = f"regexp_replace({c}, {lit(P.SPACE_BEFORE_PUNCT)}, '\\1', 'g')"
    return f"trim({c})"


def normalize_url(col: str) -> str:
    c = f"regexp_replace({ws_strip(col)}, '/+$', '')"
    return f"nullif(lower(split_part({c}, '?', 1)), '')"


def fold_identity(col: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({col}, '')), '[^a-z0-9]+', ' ', 'g'))"


def fold_company(col: str) -> str:
    words = f"string_split({fold_identity(col)}, ' ')"
    glued = (f"array_to_string(list_transform({words}, lambda w, i: CASE WHEN i > 1 AND length(w) = 1 "
             f"AND length({words}[i - 1]) = 1 THEN '' ELSE ' ' END || w), '')")
    tail = "(?: (?:" + "|".join(dims.LEGAL_SUFFIXES) + "))+$"
    return f"trim(regexp_replace({glued}, {lit(tail)}, ''))"


def segments(col: str, split: str = P.LOCATION_SPLIT) -> str:
    parts = f"list_transform(regexp_split_to_array({col}, {lit(split)}), lambda s: {ws_strip('s')})"
    return f"list_distinct(list_filter({parts}, lambda s: s <> ''))"


def hits(col: str, keywords) -> str:
    seen, items = set(), []
    for kw in keywords:
        k = kw.lower().strip()
        if not k or k in seen:
            continue
        seen.add(k)
        items.append(f"CASE WHEN {rm(col, phrase(k))} THEN {lit(kw)} END")
    if not items:
        return "CAST([] AS VARCHAR[])"
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def seniority(col: str) -> str:
    t = f"lower({ws_strip(f'coalesce({col}, {chr(39) * 2})')})"
    whens = " ".join(f"WHEN {rm(t, tpl)} THEN {lit(level)}" for level, tpl in P.SENIORITY)
    return f"(CASE WHEN {t} = '' THEN 'unknown' {whens} ELSE 'unknown' END)"


def offers_move(h: str) -> str:
    move, neg = rx(P.MOVE_OFFER), rx(P.NEGATION)
    n = P.NEGATION_LOOKBACK
    pieces = f"regexp_split_to_array({h}, {move})"
    found = f"regexp_extract_all({h}, {move})"
    start = (f"CAST(1 + list_sum(list_transform({pieces}[1:i], lambda x: length(x))) "
             f"+ coalesce(list_sum(list_transform({found}[1:i - 1], lambda x: length(x))), 0) AS BIGINT)")
    window = f"substr({h}, greatest(1, {start} - {n}), {start} - greatest(1, {start} - {n}))"
    any_ok = (f"list_bool_or(list_transform(range(1, len({found}) + 1), "
              f"lambda i: NOT regexp_matches({window}, {neg})))")
    return f"(CASE WHEN NOT regexp_matches({h}, {move}) THEN FALSE ELSE coalesce({any_ok}, FALSE) END)"


def geo_matches(loc: str, segs: str, prefs: Prefs) -> str:
    tokens = prefs.geo_tokens()
    if not tokens:
        return "TRUE"
    short = [t for t in tokens if len(t) <= 2]
    long_ = [t for t in tokens if len(t) > 2]
    hit = []
    if short:
        hit.append(f"list_has_any({segs}, {arr(short)})")
    if long_:
        hit.append(rm(loc, any_phrase(long_)))
    return f"({loc} <> '' AND ({' OR '.join(hit)}))"


def place_geo(place: str, prefs: Prefs) -> str:
    tokens = prefs.geo_tokens()
    if not tokens:
        return "TRUE"
    short = [t for t in tokens if len(t) <= 2]
    long_ = [t for t in tokens if len(t) > 2]
    return f"({in_list(place, short)} OR {rm(place, any_phrase(long_))})"


def remote_allowed(loc: str, segs: str, h: str, prefs: Prefs) -> str:
    conds = []
    if not prefs.us_targeted():
        blob = f"({loc} || ' ' || {h})" if prefs.us_only_chars is None else f"substr({loc} || ' ' || {h}, 1, {prefs.us_only_chars})"
        conds.append(f"NOT {rm(loc, P.US_ONLY)}")
        conds.append(f"NOT {rm(blob, P.US_ONLY)}")
    for p in prefs.active_reject_locations():
        conds.append(f"NOT contains({loc}, {lit(p)})")
    accept = prefs.accept_locations()
    if accept:
        named = f"list_filter({segs}, lambda s: NOT {in_list('s', dims.WORK_MODE_WORDS)})"
        place_ok = (f"len(list_filter({named}, lambda pl: {in_list('pl', accept)} OR "
                    f"{rm('pl', any_phrase(accept))} OR {place_geo('pl', prefs)})) > 0")
        conds.append(f"({loc} = '' OR len({named}) = 0 OR {place_ok})")
    return "(" + (" AND ".join(conds) if conds else "TRUE") + ")"


def posting_language(h: str, window: int | None) -> dict[str, str]:
    read = h if window is None else f"substr({h}, 1, {window})"
    words = f"regexp_extract_all({read}, {lit(P.WORD)})"
    counts = {lang: f"len(list_filter({words}, lambda w: list_contains({arr(ws)}, w)))"
              for lang, ws in dims.STOPWORDS.items()}
    return counts


def language_case(prefix: str = "") -> str:
    """CASE over precomputed count columns ``{prefix}c_<lang>``."""
    langs = list(dims.STOPWORDS)
    c = {lang: f"{prefix}c_{lang}" for lang in langs}
    best = "greatest(" + ", ".join(c.values()) + ")"
    parts = [f"WHEN {c['english']} = {best} THEN 'english'"]
    for lang in langs[1:]:
        parts.append(f"WHEN {c[lang]} = {best} THEN CASE WHEN {c[lang]} >= {dims.LANGUAGE_MIN_WORDS} "
                     f"AND {c[lang]} > {c['english']} * {dims.LANGUAGE_RATIO} THEN {lit(lang)} "
                     f"ELSE 'english' END")
    return "(CASE " + " ".join(parts) + " END)"


def required_language(h: str, spoken) -> str:
    candidates = [(lang, names) for lang, names in dims.LANGUAGE_NAMES.items() if lang not in spoken]
    if not candidates:
        return "CAST(NULL AS VARCHAR)"
    sents = f"regexp_split_to_array({h}, {lit(P.SENTENCE_SPLIT)})"
    strict = (f"list_filter({sents}, lambda s: {rm('s', P.REQUIRED_WORDS)} "
              f"AND NOT {rm('s', P.SOFT_WORDS)})")
    whens = " ".join(f"WHEN {rm('s', any_phrase(names))} THEN {lit(lang)}" for lang, names in candidates)
    langs = f"list_filter(list_transform({strict}, lambda s: CASE {whens} END), lambda x: x IS NOT NULL)"
    return f"({langs})[1]"


def eligible_places(loc: str, regions: str | None = None) -> str:
    segs = segments(loc, P.PLACES_SPLIT)
    named = f"list_sort(list_filter({segs}, lambda s: NOT {in_list('s', dims.WORK_MODE_WORDS)}))"
    if regions is None:
        return named
    given = f"list_filter(list_transform({regions}, lambda x: lower({ws_strip('x')})), lambda x: x <> '')"
    return f"CASE WHEN len({regions}) > 0 THEN {given} ELSE {named} END"


def includes_home(place: str, prefs: Prefs) -> str:
    tokens = prefs.home_tokens()
    return f"({in_list(place, dims.OPEN_EVERYWHERE)} OR {rm(place, any_phrase(tokens))})"


def residency_elsewhere(h: str, prefs: Prefs) -> str:
    pat = rx(P.RESIDENCY)
    g = [f"regexp_extract_all({h}, {pat}, {i})" for i in (1, 2, 3)]
    places = (f"list_transform(range(1, len({g[0]}) + 1), lambda i: trim(coalesce(nullif({g[0]}[i], ''), "
              f"nullif({g[1]}[i], ''), coalesce({g[2]}[i], ''))))")
    cond = (f"p <> '' AND NOT {includes_home('p', prefs)} AND NOT "
            f"({rm('p', P.NOT_A_PLACE)} OR contains(p, 'time'))")
    return f"(len(list_filter({places}, lambda p: {cond})) > 0)"


def local_only(h: str) -> str:
    sents = f"regexp_split_to_array({h}, {lit(P.SENTENCE_SPLIT)})"
    offers = (f"len(list_filter({sents}, lambda s: {rm('s', P.RELOCATION_OFFER)} "
              f"AND NOT {rm('s', P.NO_RELOCATION)})) > 0")
    local = f"len(list_filter({sents}, lambda s: {rm('s', P.LOCAL_ONLY)})) > 0"
    return f"(NOT ({offers}) AND ({local}))"


def initcap(col: str) -> str:
    return f"(upper(substr({col}, 1, 1)) || lower(substr({col}, 2)))"


def location_bonus(loc: str, prefs: Prefs) -> str:
    terms = ["0"]
    for name, weight in prefs.location_weights.items():
        tokens = prefs.weight_tokens(name)
        if tokens:
            terms.append(f"CASE WHEN {rm(loc, any_phrase(tokens))} THEN {int(weight)} ELSE 0 END")
    return "greatest(" + ", ".join(terms) + ")"


def capped(n: str, cap: int) -> str:
    return n if cap <= 0 else f"least({n}, {cap})"


def ts(value: datetime) -> str:
    return "TIMESTAMP " + lit(value.strftime("%Y-%m-%d %H:%M:%S"))


def register_ctes() -> str:
    lines = fx.register_lines_sql(DUCKDB)
    return (f"reg_lines AS ({lines}),\n"
            f"reg AS (SELECT DISTINCT {fold_company('line')} AS company_norm FROM reg_lines "
            f"WHERE {ws_strip('line')} <> '' AND NOT starts_with(regexp_replace(line, "
            f"{lit('^' + P.WS + '+')}, ''), '#') AND {fold_company('line')} <> '')")


def matched_ctes(prefs: Prefs, now: datetime, postings: str = "postings",
                 with_register: bool = True, regions: str | None = None) -> str:
    """CTE chain from a relation ``postings`` to ``m`` (the annotated rows); ``regions``: its column of stated regions."""
    reg_join = ("LEFT JOIN reg r ON r.company_norm = p.company_norm" if with_register
                else "LEFT JOIN (SELECT NULL::VARCHAR AS company_norm WHERE FALSE) r ON FALSE")
    h = "h"
    cutoff = ts(now - timedelta(days=prefs.max_age_days)) if prefs.max_age_days > 0 else None
    too_old = f"(posted_at IS NOT NULL AND posted_at < {cutoff})" if cutoff else "FALSE"
    title_bad = rm("title_l", any_phrase(prefs.title_exclude))
    if prefs.title_include:
        title_bad = f"({title_bad} OR NOT {rm('title_l', any_phrase(prefs.title_include))})"
    allow = [a.lower().strip() for a in prefs.seniority_allow]
    if allow:
        sen_ok = (f"(CASE WHEN seniority = 'unknown' THEN {str(prefs.seniority_keep_unknown).upper()} "
                  f"ELSE {in_list('seniority', allow)} END)")
    else:
        sen_ok = "TRUE"
    remote_ok = (f"(is_remote AND {remote_allowed('location_l', 'segs', h, prefs)})"
                 if prefs.accept_remote else "FALSE")
    langs = posting_language(h, prefs.language_chars)
    spoken = prefs.spoken()
    home = prefs.home()
    flagged = "coalesce(visa_sponsorship, FALSE)"
    evidence = (f"(CASE WHEN on_register THEN {lit(dims.HL_REGISTER)} "
                f"WHEN {flagged} THEN {lit(dims.HL_SOURCE_FLAG)} "
                f"WHEN len(visa_hits) > 0 THEN 'Mentions ' || array_to_string(visa_hits[1:2], ', ') "
                f"ELSE {lit(dims.HL_GENERIC)} END)")
    if home:
        open_home = f"(len(places) = 0 OR len(list_filter(places, lambda p: {includes_home('p', prefs)})) > 0)"
        worldwide = (f"(len(places) = 0 OR len(list_filter(places, lambda p: NOT "
                     f"{in_list('p', dims.OPEN_EVERYWHERE)})) = 0)")
        remote_hl = f"(CASE WHEN {worldwide} THEN {lit(dims.HL_WORLDWIDE)} ELSE {lit('Open to ' + home.title())} END)"
        limit = "(CASE WHEN len(places) > 0 THEN array_to_string(places, ', ') ELSE 'another country' END)"
        reason = [
            f"WHEN NOT {in_list('written_in', spoken)} THEN 'posting written in ' || {initcap('written_in')}",
            f"WHEN needed IS NOT NULL THEN 'requires ' || {initcap('needed')}",
            f"WHEN {rm(h, P.CLEARANCE)} THEN 'citizenship or security clearance required'",
            f"WHEN remote_ok AND {open_home} AND NOT {residency_elsewhere(h, prefs)} THEN NULL",
        ]
        hl_remote_cond = f"remote_ok AND {open_home} AND NOT {residency_elsewhere(h, prefs)}"
        if prefs.candidate_needs_visa:
            reason += [
                "WHEN restricted THEN 'posting rules out visa sponsorship'",
                f"WHEN {local_only(h)} THEN 'local candidates only / no relocation'",
                f"WHEN remote_ok AND NOT likely THEN 'remote, but only for people in ' || {limit}",
            ]
            if prefs.candidate_require_evidence:
                reason.append("WHEN NOT likely THEN 'no visa sponsorship or relocation support mentioned'")
        reloc = "(CASE " + " ".join(reason) + " ELSE NULL END)"
        hl = (f"(CASE WHEN reloc_reason IS NOT NULL THEN '' WHEN {hl_remote_cond} THEN {remote_hl} "
              f"ELSE {evidence} END)")
        lang_cols = ", ".join(f"{expr} AS c_{lang}" for lang, expr in langs.items())
        lang_stage = (f"m5a AS (SELECT *, {lang_cols}, {required_language(h, spoken)} AS needed, "
                      f"{eligible_places('location_l', regions)} AS places FROM m4 WHERE pre_reason IS NULL),\n"
                      f"m5b AS (SELECT *, {language_case()} AS written_in FROM m5a),\n"
                      f"m5c AS (SELECT *, {reloc} AS reloc_reason FROM m5b),\n"
                      f"m5 AS (SELECT *, {hl} AS highlight FROM m5c),\n")
    else:
        lang_stage = ("m5 AS (SELECT *, CAST(NULL AS VARCHAR) AS reloc_reason, '' AS highlight "
                      "FROM m4 WHERE pre_reason IS NULL),\n")
    include_flag = "TRUE" if prefs.include_keywords else "FALSE"
    score = (f"{prefs.weight('title_hit')} * {capped('len(title_hits)', prefs.cap('title_hit'))}"
             f" + {prefs.weight('keyword_hit')} * {capped('len(include_hits)', prefs.cap('keyword_hit'))}"
             f" + CASE WHEN is_remote THEN {prefs.weight('remote')} ELSE 0 END"
             f" + {prefs.weight('visa_hit')} * {capped('len(visa_hits)', prefs.cap('visa_hit'))}"
             f" + CASE WHEN on_register THEN {prefs.weight('sponsor_register')} ELSE 0 END"
             f" + CASE WHEN restricted THEN {prefs.weight('visa_restricted')} ELSE 0 END"
             f" + {location_bonus('location_l', prefs)}")
    reasons = ("list_filter([CASE WHEN remote_ok THEN 'remote' END, CASE WHEN hybrid_ok THEN 'hybrid' END, "
               "CASE WHEN onsite_ok THEN 'onsite' END, "
               "CASE WHEN len(include_hits) > 0 THEN 'keywords:' || array_to_string(include_hits[1:5], ',') END, "
               "CASE WHEN on_register THEN 'visa:sponsor-register' END, "
               "CASE WHEN restricted THEN 'visa:restricted' "
               "WHEN len(visa_hits) > 0 THEN 'visa:' || array_to_string(visa_hits[1:3], ',') "
               f"WHEN {flagged} THEN 'visa:source-flagged' END], lambda x: x IS NOT NULL)")
    location_bad = "NOT (remote_ok OR hybrid_ok OR onsite_geo)"
    if prefs.remote_only:
        location_bad = f"(NOT is_remote OR {location_bad})"
    return f"""
m0 AS (SELECT p.*, coalesce(r.company_norm IS NOT NULL AND p.company_norm <> '', FALSE) AS on_register
       FROM (SELECT *, {fold_company('company')} AS company_norm FROM {postings}) p {reg_join}),
m1 AS (SELECT *, lower({strip_html(
        "concat_ws(' ', nullif(title, ''), nullif(company, ''), nullif(location, ''), "
        "nullif(description, ''), nullif(array_to_string(tags, ' '), ''), nullif(salary, ''), "
        "nullif(job_type, ''))")}) AS h,
        lower(coalesce(title, '')) AS title_l, lower(coalesce(location, '')) AS location_l FROM m0),
m2 AS (SELECT *, {segments('location_l')} AS segs, {seniority('title')} AS seniority,
        {hits(h, prefs.include_keywords)} AS include_hits, {rm(h, P.HARD_RESTRICTION)} AS restricted,
        (coalesce(remote, FALSE) OR {rm('location_l', P.REMOTE_HINT)} OR {rm(h, P.REMOTE_HINT)}) AS is_remote,
        {rm(h, P.HYBRID_HINT)} AS is_hybrid FROM m1),
m3 AS (SELECT *, CASE WHEN restricted THEN CAST([] AS VARCHAR[]) ELSE {hits(h, prefs.visa_keywords)} END AS visa_hits,
        {geo_matches('location_l', 'segs', prefs)} AS geo_ok, {remote_ok} AS remote_ok FROM m2),
m3b AS (SELECT *, (NOT restricted AND ({flagged} OR on_register OR len(visa_hits) > 0
        OR {offers_move(h)})) AS likely,
        (is_hybrid AND {str(prefs.accept_hybrid).upper()} AND geo_ok) AS hybrid_ok,
        ({str(prefs.accept_onsite).upper()} AND geo_ok) AS onsite_geo FROM m3),
m4 AS (SELECT *, (onsite_geo AND NOT hybrid_ok AND (NOT is_remote OR NOT remote_ok)) AS onsite_ok,
        CASE WHEN {too_old} THEN 'too_old'
             WHEN {rm(h, any_phrase(prefs.exclude_keywords))} THEN 'excluded_keyword'
             WHEN {title_bad} THEN 'rejected_title'
             WHEN NOT {sen_ok} THEN 'rejected_seniority'
             WHEN {include_flag} AND len(include_hits) = 0 THEN 'no_keyword'
             WHEN {str(prefs.visa_require).upper()} AND NOT likely THEN 'rejected_visa'
             WHEN {location_bad} THEN 'rejected_location' END AS pre_reason,
        {hits('title_l', prefs.include_keywords)} AS title_hits FROM m3b),
{lang_stage}m6 AS (
  SELECT * EXCLUDE (reloc_reason, highlight),
         CASE WHEN reloc_reason IS NOT NULL THEN 'rejected_relocation' END AS reject_reason,
         reloc_reason, highlight FROM m5
  UNION ALL BY NAME
  SELECT *, pre_reason AS reject_reason, CAST(NULL AS VARCHAR) AS reloc_reason,
         CAST(NULL AS VARCHAR) AS highlight FROM m4 WHERE pre_reason IS NOT NULL),
m AS (SELECT *,
        CASE WHEN reject_reason IS NULL THEN CAST({score} AS INTEGER) END AS score,
        CASE WHEN reject_reason IS NULL THEN {reasons} END AS reasons,
        CASE WHEN reject_reason IS NULL AND restricted THEN 'no' END AS sponsorship,
        CASE WHEN reject_reason IS NULL AND restricted THEN {lit(dims.RESTRICTED_REASON)} END
          AS sponsorship_reason
      FROM m6)"""


def postings_cte() -> str:
    return f"postings AS ({fx.postings_sql(DUCKDB)})"


def country_bucket(loc: str, segs: str, remote: str) -> str:
    parts = []
    for country, aliases in dims.COUNTRY_ALIASES.items():
        if country in dims.GENERIC_BUCKETS:
            continue
        short = [a for a in aliases if len(a) <= 2]
        long_ = [a for a in aliases if len(a) > 2]
        cond = []
        if short:
            cond.append(f"list_has_any({segs}, {arr(short)})")
        if long_:
            cond.append(rm(loc, any_phrase(long_)))
        parts.append(f"WHEN {' OR '.join(cond)} THEN {lit(dims.country_label(country))}")
    europe = [a for a in dict.fromkeys(dims.COUNTRY_ALIASES["europe"] + dims.COUNTRY_ALIASES["eu"])
              if len(a) > 2]
    parts.append(f"WHEN {rm(loc, any_phrase(europe))} THEN 'Europe'")
    parts.append(f"WHEN coalesce({remote}, FALSE) THEN 'Remote'")
    return "(CASE " + " ".join(parts) + " ELSE 'Other' END)"


def place_key(location: str, remote: str) -> str:
    loc = f"lower(coalesce({location}, ''))"
    segs = segments(loc)
    named = (f"list_filter({segs}, lambda s: NOT {in_list('s', dims.COUNTRY_NAME_TOKENS)} "
             f"AND NOT {in_list('s', dims.WORK_MODE_WORDS)})")
    return (f"(CASE WHEN len({named}) > 0 THEN array_to_string(list_sort({named}), ' ') "
            f"ELSE {country_bucket(loc, segs, remote)} END)")


def fingerprint(company: str, title: str, place: str) -> str:
    fc, ft = fold_identity(company), fold_identity(title)
    seed = f"concat_ws('|', {fc}, {ft}, {fold_identity(place)})"
    return f"(CASE WHEN {fc} <> '' AND {ft} <> '' THEN substr(sha256({seed}), 1, 32) END)"


def identity_cols() -> str:
    """job_key, url_norm, fingerprint over a relation with the raw posting columns."""
    return (f"source || ':' || source_id AS job_key, {normalize_url('url')} AS url_norm, "
            f"{fingerprint('company', 'title', place_key('location', 'remote IS TRUE'))} AS fingerprint")


def identities_sql(rel: str, id_col: str = "ord") -> str:
    return (f"SELECT {id_col} AS id, 'key' AS kind, job_key AS value FROM {rel} "
            f"UNION ALL SELECT {id_col}, 'url', url_norm FROM {rel} WHERE url_norm IS NOT NULL AND url_norm <> '' "
            f"UNION ALL SELECT {id_col}, 'fp', fingerprint FROM {rel} WHERE fingerprint IS NOT NULL")


def index_hits(col: str, keywords) -> str:
    """As ``hits``, for long lists of keywords: words are marked at both ends, then a keyword with marked words is a plain search.

    Keywords that begin or end with another character than a word's go by their pattern.
    """
    marked = f"regexp_replace({col}, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g')"
    shown: dict[str, str] = {}
    for kw in keywords:
        shown.setdefault(kw.lower().strip(), kw)
    shown.pop("", None)
    plain = {k: re.sub(r"\w+", lambda m: f"\x01{m[0]}\x02", k) for k in shown if re.fullmatch(r"\w(?:.*\w)?", k)}
    numbers = {k: i for i, k in enumerate(shown)}
    table = ", ".join(f"{{'i': {numbers[k]}, 'k': {lit(m)}, 'shown': {lit(shown[k])}}}" for k, m in plain.items())
    odd = ", ".join(f"CASE WHEN {rm(col, phrase(k))} THEN {{'i': {numbers[k]}, 'k': '', 'shown': {lit(shown[k])}}} END" for k in shown if k not in plain)
    found = f"list_concat(list_filter([{table}], lambda w: contains(marked, w.k)), list_filter([{odd}], lambda w: w IS NOT NULL))"
    return f"(SELECT list_transform(list_sort({found}), lambda w: w.shown) FROM (SELECT {marked} AS marked))"
