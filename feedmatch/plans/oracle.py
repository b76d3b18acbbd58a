"""Oracle SQL (DuckDB) for each registered query, keyed like ``queries.QUERIES``."""

from __future__ import annotations

import re

from feedmatch import dims
from feedmatch.plans import oracle_sql as O
from feedmatch.plans.queries import DOC_KEYWORDS
from feedmatch.functions import patterns as P
from feedmatch.functions.regex import DUCKDB
from feedmatch.operators.health import SCHEMA_MOVED
from feedmatch.prefs import EVIDENCE_PREFS, FIXTURE_NOW, FIXTURE_PREFS, STRICT_PREFS, WHOLE_PREFS
from feedmatch.sources import fixtures as fx


def _matched(prefs=FIXTURE_PREFS) -> str:
    return f"WITH {O.postings_cte()},\n{O.register_ctes()},\n{O.matched_ctes(prefs, FIXTURE_NOW)}\n"


def funnel_counts() -> str:
    return _matched() + "SELECT coalesce(reject_reason, 'matched') AS reason, count(*) AS n FROM m GROUP BY 1"


def funnel_counts_strict() -> str:
    return _matched(STRICT_PREFS) + "SELECT coalesce(reject_reason, 'matched') AS reason, count(*) AS n FROM m GROUP BY 1"


def relocation_evidence() -> str:
    return _matched(EVIDENCE_PREFS) + ("SELECT reject_reason, coalesce(reloc_reason, '') AS reloc_reason, count(*) AS n, "
                                       "CAST(sum(score) AS BIGINT) AS score FROM m GROUP BY 1, 2")


def rejects() -> str:
    return _matched() + ("SELECT ord, source || ':' || source_id AS job_key, reject_reason, "
                         "coalesce(reloc_reason, '') AS reloc_reason FROM m WHERE reject_reason IS NOT NULL")


def digest_facts() -> str:
    sec = f"(epoch({O.ts(FIXTURE_NOW)}) - epoch(posted_at))"
    hours = f"CAST(floor({sec} / 3600) AS BIGINT)"
    age = (f"CASE WHEN posted_at IS NULL THEN '' WHEN {sec} < 3600 THEN 'just now' WHEN {hours} < 24 THEN CAST({hours} AS VARCHAR) || 'h ago' "
           f"ELSE CAST(CAST(floor({hours} / 24) AS BIGINT) AS VARCHAR) || 'd ago' END")
    has = lambda r: f"list_contains(reasons, {O.lit(r)})"
    mode = f"CASE WHEN {has('hybrid')} THEN 'Hybrid' WHEN {_REMOTE} THEN 'Remote' WHEN {has('onsite')} THEN 'On-site' END"
    line = lambda *parts: f"concat_ws(' · ', {', '.join(f'nullif({x}, {chr(39) * 2})' for x in parts)})"
    level = "CASE WHEN seniority <> 'unknown' THEN seniority END"
    return _matched() + (
        f"SELECT ord, {line(mode, O.initcap(f'({level})'), age, 'salary')} AS details, "
        f"{line("coalesce(nullif(location, ''), 'Location n/a')", 'source', level, age, 'salary', "'score ' || CAST(score AS VARCHAR)")} AS facts, "
        "CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ', ') ELSE 'matched prefs' END AS why, "
        "CASE WHEN sponsorship IS NULL THEN '' ELSE 'sponsorship: ' || sponsorship || ' — ' || sponsorship_reason END AS sponsorship_line "
        "FROM m WHERE reject_reason IS NULL")


def _verdict_ctes() -> str:
    """``mk`` (matches), ``v`` (usable verdicts) and ``landed`` (keys with a reply), by the document's number."""
    return (f", v AS ({verdict_cache()}),\n"
            "mk AS (SELECT *, source || ':' || source_id AS job_key, TRY_CAST(split_part(source_id, ':', -1) AS BIGINT) AS no FROM m "
            "WHERE reject_reason IS NULL),\n"
            "landed AS (SELECT source || ':' || CAST(doc_id AS VARCHAR) AS job_key FROM documents WHERE doc_id % 7 <> 0)\n")


def verdict_applied() -> str:
    return _matched() + _verdict_ctes() + (
        ", o AS (SELECT mk.*, v.verdict, v.reason, CASE WHEN sponsorship IS NOT NULL THEN 'rule' WHEN l.job_key IS NULL THEN 'missing' "
        "WHEN no % 2 = 0 THEN CASE WHEN v.verdict IS NULL THEN 'missing' ELSE 'cache' END "
        "WHEN v.verdict IS NULL THEN 'unusable' ELSE 'reply' END AS verdict_origin "
        "FROM mk LEFT JOIN landed l USING (job_key) LEFT JOIN v USING (job_key))\n"
        "SELECT ord, job_key, verdict_origin, CASE verdict_origin WHEN 'rule' THEN sponsorship WHEN 'missing' THEN 'unclear' "
        "WHEN 'unusable' THEN 'unclear' ELSE verdict END AS sponsorship, CASE verdict_origin WHEN 'rule' THEN sponsorship_reason "
        "WHEN 'missing' THEN 'classifier unavailable' WHEN 'unusable' THEN 'classifier returned no verdict' ELSE reason END AS sponsorship_reason FROM o")


def to_classify() -> str:
    return _matched() + _verdict_ctes() + (
        ", u AS (SELECT * FROM mk WHERE sponsorship IS NULL AND job_key NOT IN (SELECT v.job_key FROM v JOIN landed USING (job_key) "
        "WHERE CAST(split_part(v.job_key, ':', -1) AS BIGINT) % 2 = 0)),\n"
        "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_key ORDER BY ord) AS rn FROM u) WHERE rn = 1),\n"
        f"x AS ({visa_excerpt('f', 'ord', 'description')})\n"
        "SELECT job_key, title, company, location, excerpt FROM f JOIN x USING (ord)")


def seniority_levels() -> str:
    allow = [a.lower() for a in FIXTURE_PREFS.seniority_allow]
    keep = str(FIXTURE_PREFS.seniority_keep_unknown).upper()
    return (f"WITH {O.postings_cte()}, s AS (SELECT ord, {O.seniority('title')} AS seniority FROM postings)\n"
            f"SELECT ord, seniority, CASE WHEN seniority = 'unknown' THEN {keep} "
            f"ELSE {O.in_list('seniority', allow)} END AS allowed FROM s")


def company_fold() -> str:
    return _matched() + "SELECT ord, company, company_norm, on_register FROM m"


def hard_restriction() -> str:
    return _matched() + "SELECT ord, restricted FROM m"


def move_offer() -> str:
    return _matched() + f"SELECT ord, {O.offers_move('h')} AS offers_move FROM m"


def remote_eligibility() -> str:
    return _matched() + "SELECT ord, is_remote, is_hybrid, geo_ok, remote_ok, hybrid_ok, onsite_ok FROM m"


def relocation_assessment() -> str:
    return _matched() + ("SELECT ord, coalesce(reloc_reason, '') AS reloc_reason, "
                         "coalesce(highlight, '') AS highlight FROM m "
                         "WHERE reject_reason IS NULL OR reject_reason = 'rejected_relocation'")


def scored_matches() -> str:
    return _matched() + ("SELECT ord, source || ':' || source_id AS job_key, score, "
                         "array_to_string(reasons, '|') AS reasons, seniority, highlight, "
                         "coalesce(sponsorship, '') AS sponsorship FROM m WHERE reject_reason IS NULL")


def keyword_hits() -> str:
    return (f"SELECT doc_id, array_to_string({O.hits('lower(text)', DOC_KEYWORDS)}, ',') AS hits "
            f"FROM documents")


def html_to_text() -> str:
    return f"SELECT page_id, {O.strip_html('html')} AS text FROM pages"


def url_normalize_dups() -> str:
    return f"SELECT {O.normalize_url('url')} AS url_norm, count(*) AS n FROM pages GROUP BY 1"


def posting_language_confusion() -> str:
    counts = O.posting_language("h", None)
    cols = ", ".join(f"{expr} AS c_{lang}" for lang, expr in counts.items())
    return (f"WITH d AS (SELECT lang, lower({O.strip_html('text')}) AS h FROM documents),\n"
            f"c AS (SELECT lang, {cols} FROM d)\n"
            f"SELECT lang, {O.language_case()} AS detected, count(*) AS n FROM c GROUP BY 1, 2")


def place_key_bucket() -> str:
    pk = O.place_key("location", "remote IS TRUE")
    loc = "lower(coalesce(location, ''))"
    return (f"WITH {O.postings_cte()}\n"
            f"SELECT ord, location, {O.country_bucket(loc, O.segments(loc), 'remote IS TRUE')} AS bucket, "
            f"{pk} AS place_key, {O.fingerprint('company', 'title', pk)} AS fingerprint FROM postings")


def _seen_ctes() -> str:
    return (f"seen_raw AS ({fx.seen_sql(DUCKDB)}),\n"
            f"s AS (SELECT *, {O.identity_cols()} FROM seen_raw),\n"
            f"si AS (SELECT DISTINCT kind, value FROM ({O.identities_sql('s', '0')}))")


def seen_antijoin() -> str:
    return (f"WITH {O.postings_cte()},\n p AS (SELECT *, {O.identity_cols()} FROM postings),\n"
            f"{_seen_ctes()},\n pi AS ({O.identities_sql('p')})\n"
            f"SELECT ord, job_key FROM p WHERE ord NOT IN "
            f"(SELECT pi.id FROM pi JOIN si ON pi.kind = si.kind AND pi.value = si.value)")


def relative_age() -> str:
    sec = f"(epoch({O.ts(FIXTURE_NOW)}) - epoch(o_orderdate))"
    hours = f"CAST(floor({sec} / 3600) AS BIGINT)"
    return (f"SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN '' WHEN {sec} < 3600 THEN 'just now' "
            f"WHEN {hours} < 24 THEN CAST({hours} AS VARCHAR) || 'h ago' "
            f"ELSE CAST(CAST(floor({hours} / 24) AS BIGINT) AS VARCHAR) || 'd ago' END AS age FROM orders")


def salary_text() -> str:
    k = "p_partkey"
    inputs = (f"SELECT {k}, CASE {k} % 5 WHEN 1 THEN p_retailprice * 100 WHEN 2 THEN p_retailprice * 100 "
              f"WHEN 3 THEN 0.5 WHEN 4 THEN -5.0 END AS low, "
              f"CASE {k} % 4 WHEN 0 THEN p_retailprice * 130 WHEN 2 THEN p_retailprice * 100 "
              f"WHEN 3 THEN p_size * 1000.0 END AS high, "
              f"CASE {k} % 3 WHEN 0 THEN ' usd ' WHEN 1 THEN '' END AS currency, "
              f"CASE {k} % 6 WHEN 0 THEN 'Yearly' WHEN 1 THEN 'monthly' WHEN 2 THEN ' hourly ' "
              f"WHEN 3 THEN 'annual' WHEN 4 THEN 'weekly' END AS period FROM part")
    amt = lambda v: f"nullif(CASE WHEN {v} > 0 THEN CAST(floor({v}) AS BIGINT) END, 0)"
    units = " ".join(f"WHEN {O.lit(a)} THEN {O.lit(b)}" for a, b in dims.SALARY_UNITS.items())
    return (f"WITH s AS ({inputs}), a AS (SELECT {k}, {amt('low')} AS lo, {amt('high')} AS hi, "
            f"upper(coalesce(trim(currency), '')) AS code, "
            f"CASE lower(trim(coalesce(period, ''))) {units} END AS unit FROM s), "
            f"t AS (SELECT {k}, lo, hi, unit, trim(code || ' ' || CASE WHEN lo IS NOT NULL AND hi IS NOT NULL "
            f"AND lo <> hi THEN format('{{:,}}', lo) || '–' || format('{{:,}}', hi) "
            f"ELSE format('{{:,}}', coalesce(lo, hi)) END) AS txt FROM a) "
            f"SELECT {k}, CASE WHEN lo IS NULL AND hi IS NULL THEN NULL WHEN unit IS NOT NULL "
            f"THEN txt || ' / ' || unit ELSE txt END AS salary FROM t")


def byte_budget_prefix() -> str:
    from feedmatch.plans.queries import DIGEST_BUDGET, DIGEST_HEAD, DIGEST_TAIL
    hb, tb = len(DIGEST_HEAD.encode()), len(DIGEST_TAIL.encode())
    more = lambda n: (f"CASE WHEN {n} > 0 THEN strlen('…and ' || CAST({n} AS VARCHAR) || "  # noqa: E731
                      f"' more not shown.' || chr(10)) ELSE 0 END")
    return (f"WITH b AS (SELECT conv_id, turn, strlen(role || ': ' || text || chr(10)) AS bytes FROM conversations), "
            f"c AS (SELECT *, sum(bytes) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cum, "
            f"row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, "
            f"count(*) OVER (PARTITION BY conv_id) AS n FROM b), "
            f"f AS (SELECT *, ({hb} + cum + {more('n - i')} + {tb}) <= {DIGEST_BUDGET} AS fits FROM c), "
            f"g AS (SELECT *, min(CASE WHEN NOT fits THEN i END) OVER (PARTITION BY conv_id) AS first_over FROM f), "
            f"h AS (SELECT conv_id, max(n) AS n, count(*) FILTER (WHERE first_over IS NULL OR i < first_over) AS kept, "
            f"coalesce(sum(bytes) FILTER (WHERE first_over IS NULL OR i < first_over), 0) AS kept_bytes "
            f"FROM g GROUP BY conv_id) "
            f"SELECT conv_id, CAST(kept AS BIGINT) AS kept, CAST(n - kept AS BIGINT) AS dropped, "
            f"CAST({hb} + kept_bytes + {more('n - kept')} + {tb} AS BIGINT) AS body_bytes FROM h")


def seen_upsert() -> str:
    now = O.ts(FIXTURE_NOW)
    return (_matched().replace("WITH ", "WITH ", 1)
            + f", mi AS (SELECT *, {O.identity_cols()} FROM m WHERE reject_reason IS NULL),\n"
            f"n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_key ORDER BY ord) AS rn FROM mi) "
            f"WHERE rn = 1),\n{_seen_ctes()}\n"
            f"SELECT coalesce(n.job_key, s.job_key) AS job_key, "
            f"CASE WHEN s.source IS NOT NULL THEN s.source ELSE n.source END AS source, "
            f"CASE WHEN s.source IS NOT NULL THEN s.source_id ELSE n.source_id END AS source_id, "
            f"CASE WHEN n.source IS NOT NULL THEN n.url ELSE s.url END AS url, "
            f"CASE WHEN n.source IS NOT NULL THEN n.url_norm ELSE s.url_norm END AS url_norm, "
            f"CASE WHEN s.source IS NOT NULL THEN s.title ELSE n.title END AS title, "
            f"CASE WHEN s.source IS NOT NULL THEN s.company ELSE n.company END AS company, "
            f"CASE WHEN n.source IS NOT NULL THEN n.location ELSE s.location END AS location, "
            f"CASE WHEN n.source IS NOT NULL THEN n.fingerprint ELSE s.fingerprint END AS fingerprint, "
            f"CAST(CASE WHEN s.source IS NOT NULL THEN s.first_seen ELSE {now} END AS VARCHAR) AS first_seen, "
            f"CAST(CASE WHEN n.source IS NOT NULL THEN {now} ELSE s.last_seen END AS VARCHAR) AS last_seen, "
            f"greatest(coalesce(s.notified, 0), CASE WHEN n.source IS NOT NULL THEN 1 ELSE 0 END) AS notified "
            f"FROM n FULL OUTER JOIN s ON n.job_key = s.job_key")


def json_envelope_records() -> str:
    body = ("CASE event_id % 6 WHEN 0 THEN '[' || props || ', 1, \"x\", ' || props || ']' "
            "WHEN 1 THEN '{\"jobs\": [' || props || ']}' WHEN 2 THEN '{\"data\": [' || props || ', null]}' "
            "WHEN 3 THEN '{\"jobs\": null, \"data\": [' || props || ']}' "
            "WHEN 4 THEN '{\"results\": \"not a list\"}' ELSE 'not json ' || props END")
    return (f"WITH p AS (SELECT event_id, {body} AS body FROM events),\n"
            f"v AS (SELECT event_id, CAST(body AS JSON) AS j FROM p WHERE json_valid(body)),\n"
            f"a AS (SELECT event_id, CASE WHEN json_type(j) = 'ARRAY' THEN j "
            f"WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.jobs') = 'ARRAY' THEN json_extract(j, '$.jobs') "
            f"WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.data') = 'ARRAY' THEN json_extract(j, '$.data') "
            f"END AS arr FROM v),\n"
            f"e AS (SELECT event_id, r.i AS pos, json_extract(arr, '$[' || CAST(r.i AS VARCHAR) || ']') AS rec "
            f"FROM a, range(0, CAST(json_array_length(arr) AS BIGINT)) r(i) WHERE arr IS NOT NULL)\n"
            f"SELECT event_id, CAST(pos AS BIGINT) AS pos, TRY_CAST(json_extract(rec, '$.k') AS BIGINT) AS k "
            f"FROM e WHERE json_type(rec) = 'OBJECT'")


def stream_ingest_dedupe() -> str:
    return ("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER "
            "(PARTITION BY event_id ORDER BY ts) AS rn FROM events) WHERE rn = 1")


def source_health() -> str:
    env = json_envelope_records().split("\ne AS")[0].rstrip().rstrip(",")
    return (env + ",\n"
            "r AS (SELECT p.event_id, 'feed' || CAST(p.event_id % 3 AS VARCHAR) AS source, ev.event_type AS board, "
            "CASE WHEN p.event_id % 97 = 0 THEN 500 ELSE 200 END AS status, "
            "coalesce(len(list_filter(CAST(json_extract(a.arr, '$[*]') AS JSON[]), lambda x: json_type(x) = 'OBJECT')), 0) AS n_records, "
            "coalesce(len(list_filter(CAST(json_extract(a.arr, '$[*]') AS JSON[]), lambda x: json_type(x) = 'OBJECT' "
            "AND TRY_CAST(json_extract(x, '$.k') AS BIGINT) IS NOT NULL)), 0) AS n_mapped "
            "FROM p JOIN events ev ON ev.event_id = p.event_id LEFT JOIN a ON a.event_id = p.event_id),\n"
            "b AS (SELECT source, board, max(status >= 400) AS failed, "
            "sum(CASE WHEN status < 400 THEN n_mapped ELSE 0 END) AS fetched, "
            "sum(CASE WHEN status < 400 THEN n_records - n_mapped ELSE 0 END) AS skipped FROM r GROUP BY 1, 2),\n"
            "h AS (SELECT source, CAST(sum(fetched) AS BIGINT) AS fetched, "
            "list_sort(list(board) FILTER (WHERE NOT failed)) AS ok, "
            "list_sort(list(board) FILTER (WHERE failed)) AS bad, CAST(sum(skipped) AS BIGINT) AS records_skipped "
            "FROM b GROUP BY 1)\n"
            "SELECT source AS name, fetched, FALSE AS failed, '' AS error, array_to_string(coalesce(ok, []), ',') AS boards_ok, "
            "array_to_string(coalesce(bad, []), ',') AS boards_failed, records_skipped, "
            "(len(coalesce(bad, [])) = 0 AND records_skipped = 0) AS healthy, "
            "source || ': ' || concat_ws(', ', CAST(fetched AS VARCHAR) || ' fetched', "
            "CASE WHEN len(coalesce(ok, [])) + len(coalesce(bad, [])) > 0 THEN "
            "CAST(len(coalesce(ok, [])) AS VARCHAR) || '/' || CAST(len(coalesce(ok, [])) + len(coalesce(bad, [])) AS VARCHAR) "
            "|| ' boards OK' || CASE WHEN len(coalesce(bad, [])) > 0 THEN ' — failed: ' || array_to_string(bad, ', ') ELSE '' END END, "
            "CASE WHEN records_skipped > 0 THEN CAST(records_skipped AS VARCHAR) || ' unreadable record(s)' END) AS summary FROM h")


def page_prefix() -> str:
    base = source_health().split(",\nb AS")[0]
    base = base.replace("CASE WHEN p.event_id % 97 = 0 THEN 500 ELSE 200 END AS status, ",
                        "CASE WHEN p.event_id % 97 = 0 THEN 500 ELSE 200 END AS status, "
                        "CAST(floor(p.event_id / 250) AS BIGINT) AS page, ")
    return (base + ",\n"
            "pg AS (SELECT source, board, page, max(status) AS status, CAST(sum(n_records) AS BIGINT) AS n_records "
            "FROM r GROUP BY 1, 2, 3),\n"
            "st AS (SELECT source, board, min(CASE WHEN status >= 400 OR n_records = 0 THEN page END) AS stop "
            "FROM pg GROUP BY 1, 2)\n"
            "SELECT pg.source, pg.board, count(*) AS pages_kept, CAST(sum(pg.n_records) AS BIGINT) AS records_kept "
            "FROM pg JOIN st ON pg.source = st.source AND pg.board = st.board "
            "WHERE st.stop IS NULL OR pg.page < st.stop GROUP BY 1, 2")


def page_rules() -> str:
    base = source_health().split(",\nb AS")[0]
    base = base.replace("CASE WHEN p.event_id % 97 = 0 THEN 500 ELSE 200 END AS status, ",
                        "CASE WHEN p.event_id % 97 = 0 THEN 500 ELSE 200 END AS status, "
                        "CAST(floor(p.event_id / 500) AS BIGINT) AS page, ")
    return (base + ",\n"
            "pg AS (SELECT CASE source WHEN 'feed0' THEN 'himalayas' WHEN 'feed1' THEN 'jobicy' ELSE 'adzuna' END AS source, board, page, "
            "max(status) AS status, CAST(sum(n_records) AS BIGINT) AS n_records FROM r WHERE status < 400 OR page % 7 = 6 GROUP BY 1, 2, 3),\n"
            "w AS (SELECT *, min(CASE WHEN status >= 400 OR n_records = 0 THEN page END) OVER (PARTITION BY source, board) AS stop, "
            "min(CASE WHEN source = 'himalayas' AND n_records < 20 OR source = 'jobicy' AND (page + length(board)) % 9 = 8 THEN page END) "
            "OVER (PARTITION BY source, board) AS final FROM pg)\n"
            "SELECT source, board, count(*) AS pages_kept, max(page) AS last_page, CAST(sum(n_records) AS BIGINT) AS records_kept "
            "FROM w WHERE coalesce(page < stop, TRUE) AND coalesce(page <= final, TRUE) GROUP BY 1, 2")


def verdict_cache() -> str:
    fence = "'(?s)```(?:json)?\\s*(.*?)```'"
    return (f"WITH r AS ({fx.replies_sql(DUCKDB)}),\n"
            "t AS (SELECT job_key, trim(coalesce(array_to_string(list_transform(list_filter("
            "CAST(json_extract(reply, '$.content[*]') AS JSON[]), lambda b: json_extract_string(b, '$.type') = 'text'), "
            "lambda b: coalesce(json_extract_string(b, '$.text'), '')), ' '), '')) AS txt FROM r),\n"
            f"c AS (SELECT job_key, CASE WHEN regexp_matches(txt, {fence}) THEN regexp_extract(txt, {fence}, 1) "
            "ELSE txt END AS cand FROM t),\n"
            "b AS (SELECT job_key, cand, instr(cand, '{') AS st, CASE WHEN instr(reverse(cand), '}') > 0 "
            "THEN length(cand) - instr(reverse(cand), '}') + 1 ELSE 0 END AS en FROM c),\n"
            "o AS (SELECT job_key, CASE WHEN st > 0 AND en > st THEN substr(cand, st, en - st + 1) END AS s FROM b),\n"
            "v AS (SELECT job_key, s, lower(trim(coalesce(json_extract_string(s, '$.sponsorship'), ''))) AS verdict, "
            "trim(regexp_replace(coalesce(json_extract_string(s, '$.reason'), ''), '\\s+', ' ', 'g')) AS reason "
            "FROM o WHERE s IS NOT NULL AND json_valid(s) AND json_type(s) = 'OBJECT')\n"
            "SELECT job_key, verdict, reason FROM v WHERE verdict IN ('yes', 'no', 'unclear')")


def tumbling_event_counts() -> str:
    return ("SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, event_type, count(*) AS n "
            "FROM events GROUP BY 1, 2")


def _kept_ctes(rel: str, rank: str, n: str = "") -> str:
    """``kept``: rows of ``rel`` that a best-first walk keeps, one row a step, taken identities as a list; names end in ``n``."""
    return (f"ranked{n} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {rank}) AS rk FROM {rel}),\n"
            f"numbered{n} AS (SELECT id, dense_rank() OVER (ORDER BY kind, value) AS v FROM ({O.identities_sql(f'ranked{n}', 'rk')})),\n"
            f"lists{n} AS MATERIALIZED (SELECT id AS rk, list(v) AS vs FROM numbered{n} GROUP BY id),\n"
            f"walk{n} AS (SELECT CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS taken, FALSE AS keep UNION ALL "
            "SELECT l.rk, CASE WHEN list_has_any(w.taken, l.vs) THEN w.taken ELSE list_concat(w.taken, l.vs) END, "
            f"NOT list_has_any(w.taken, l.vs) FROM walk{n} w JOIN lists{n} l ON l.rk = w.rk + 1),\n"
            f"kept{n} AS MATERIALIZED (SELECT ranked{n}.* FROM ranked{n} JOIN walk{n} USING (rk) WHERE walk{n}.keep)")


def stream_cross_batch() -> str:
    """Day by day: what neither the history nor an earlier day has is walked and queued; the best of the queue are delivered."""
    from feedmatch.plans.queries import STREAM_CAP, STREAM_PARTS
    sql = (f"WITH RECURSIVE {O.postings_cte()},\n p AS MATERIALIZED (SELECT ord, {O.identity_cols()} FROM postings),\n"
           f"pid AS MATERIALIZED ({O.identities_sql('p')}),\n{_seen_ctes()},\nknown0 AS MATERIALIZED (SELECT * FROM si)")
    for k in range(STREAM_PARTS):
        before = f"SELECT job_key, ord FROM queue{k - 1} WHERE position > {STREAM_CAP} UNION ALL " if k else ""
        sql += (f",\nday{k} AS MATERIALIZED (SELECT * FROM p WHERE ord % {STREAM_PARTS} = {k} AND ord NOT IN "
                f"(SELECT pid.id FROM pid JOIN known{k} USING (kind, value))),\n{_kept_ctes(f'day{k}', 'ord', str(k))},\n"
                f"known{k + 1} AS MATERIALIZED (SELECT kind, value FROM known{k} UNION SELECT kind, value FROM pid JOIN kept{k} ON pid.id = kept{k}.ord),\n"
                f"queue{k} AS MATERIALIZED (SELECT job_key, ord, row_number() OVER (ORDER BY ord) AS position, count(*) OVER () AS n "
                f"FROM ({before}SELECT job_key, ord FROM kept{k}))")
    last, cap = STREAM_PARTS - 1, STREAM_CAP
    days = [f"SELECT {k} AS batch, CAST(position AS INTEGER) AS position, job_key, ord, greatest(n - {cap}, 0) AS held FROM queue{k} WHERE position <= {cap}"
            for k in range(STREAM_PARTS)]
    rest = (f"SELECT CAST({STREAM_PARTS} + (position - {cap} - 1) // {cap} AS INTEGER), CAST((position - {cap} - 1) % {cap} + 1 AS INTEGER), job_key, ord, "
            f"greatest(n - {cap} * (2 + (position - {cap} - 1) // {cap}), 0) FROM queue{last} WHERE position > {cap}")
    return sql + "\n" + " UNION ALL ".join([*days, rest])


def seen_count() -> str:
    return (f"SELECT count(*) AS rows, CAST(sum(notified) AS BIGINT) AS notified, CAST(0 AS BIGINT) AS with_new_columns FROM ({fx.seen_sql(DUCKDB)})")


def seen_backfill() -> str:
    return (f"WITH {_seen_ctes()}\nSELECT job_key, CASE WHEN doc_id % 2 = 0 THEN fingerprint ELSE 'stored' END AS fingerprint, 2 AS fp_version FROM s")


def verdict_merge() -> str:
    from feedmatch.plans.queries import VERDICTS_AT
    return (f"WITH v AS ({verdict_cache()}),\n"
            "n AS (SELECT *, CAST(split_part(job_key, ':', -1) AS BIGINT) AS no FROM v)\n"
            "SELECT job_key, verdict, CASE WHEN no % 3 = 0 OR no % 4 = 0 THEN replace(reason, 'Posting mentions', 'Second look:') ELSE reason END AS reason, "
            f"CASE WHEN no % 3 = 0 OR no % 4 = 0 THEN '{VERDICTS_AT[1]}' ELSE '{VERDICTS_AT[0]}' END AS checked_at FROM n")


def greedy_dedupe() -> str:
    return (f"WITH RECURSIVE {O.postings_cte()},\n p AS (SELECT ord, {O.identity_cols()} FROM postings),\n"
            f"{_kept_ctes('p', 'ord')}\nSELECT ord, job_key FROM kept")


def _fresh() -> str:
    """``m``, ``fresh`` (matches minus seen), ``kept`` of them and ``top``, the digest's rows."""
    return (_matched().replace("WITH ", "WITH RECURSIVE ", 1)
            + f", mi AS MATERIALIZED (SELECT *, {O.identity_cols()} FROM m WHERE reject_reason IS NULL),\n{_seen_ctes()},\n"
            f"mids AS ({O.identities_sql('mi')}),\n"
            "fresh AS (SELECT * FROM mi WHERE ord NOT IN (SELECT mids.id FROM mids JOIN si USING (kind, value))),\n"
            f"{_kept_ctes('fresh', 'score DESC, lower(title), ord')},\n"
            "placed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY rk) AS position FROM kept),\n"
            f"top AS MATERIALIZED (SELECT * FROM placed WHERE position <= {FIXTURE_PREFS.max_jobs})\n")


_BACKLOG = f"(SELECT greatest(count(*) - {FIXTURE_PREFS.max_jobs}, 0) FROM placed)"
_REMOTE = "coalesce(remote, FALSE) OR coalesce(list_contains(reasons, 'remote'), FALSE)"


def digest_topn_backlog() -> str:
    return _fresh() + f"SELECT position, job_key, score, title, {_BACKLOG} AS backlog FROM top"


def backlog_drain() -> str:
    cap = FIXTURE_PREFS.max_jobs
    return _fresh() + (f"SELECT CAST((position + {cap - 1}) // {cap} AS INTEGER) AS run, count(*) AS delivered, "
                       "(SELECT count(*) FROM placed) - max(position) AS backlog FROM placed GROUP BY 1")


def run_summary() -> str:
    counts = ", ".join(f"(SELECT count(*) FROM m WHERE reject_reason = '{r}') AS {r}" for r in dims.REASONS)
    evidence = ("CASE coalesce(sponsorship, '') WHEN 'yes' THEN TRUE WHEN 'no' THEN FALSE ELSE "
                "len(list_filter(reasons, lambda r: starts_with(r, 'visa:') AND r <> 'visa:restricted')) > 0 END")
    matched = "(SELECT count(*) FROM m WHERE reject_reason IS NULL)"
    home = FIXTURE_PREFS.home()
    header = ("concat_ws(' · ', new || ' new', CASE WHEN backlog > 0 THEN backlog || ' held for next run' END, already_seen || ' already seen', "
              f"too_old || ' too old', CASE WHEN rejected_relocation > 0 THEN rejected_relocation || ' not workable from {home}' END, "
              "rejected || ' rejected (US-only / title / seniority / visa)')")
    return _fresh() + (
        f", a AS (SELECT (SELECT count(*) FROM m) AS fetched, {matched} AS matched, (SELECT count(*) FROM top) AS new, "
        f"{matched} - (SELECT count(*) FROM placed) AS already_seen, {_BACKLOG} AS backlog, {counts}, "
        f"(SELECT count(*) FROM m WHERE {O.in_list('reject_reason', dims.HEADLINE_REJECTED)}) AS rejected, "
        f"(SELECT count(*) FROM top WHERE {evidence}) AS visa_count, (SELECT count(*) FROM top WHERE {_REMOTE}) AS remote_count, "
        f"{O.lit(home)} AS based_in)\nSELECT *, {header} AS header FROM a")


def run_ledger() -> str:
    steps = {"matched": ("m", "0"), "top": ("top", _BACKLOG), "to_classify": ("(SELECT DISTINCT job_key FROM top WHERE sponsorship IS NULL)", "0"),
             "digest": ("top", "0"), "rejects": ("m WHERE reject_reason IS NOT NULL", "0"), "verdicts": ("m WHERE FALSE", "0"),
             "begun": ("top", "0"), "delivered": ("top", "0"), "seen": ("(SELECT job_key FROM s UNION SELECT job_key FROM top)", "0"), "sent": ("top", "0")}
    return _fresh() + " UNION ALL ".join(f"SELECT '{name}' AS step, count(*) AS rows, CAST({note} AS BIGINT) AS note FROM {rel}" for name, (rel, note) in steps.items())


def register_reader() -> str:
    return f"WITH {O.register_ctes()}\nSELECT company_norm, o.origin FROM reg, (VALUES ('list'), ('csv')) o(origin)"


def selected_sources() -> str:
    names = {0: "greenhouse", 1: "lever", 4: "arbeitnow", 5: "remoteok", 6: "jobicy", 7: "himalayas", 8: "adzuna"}
    source = "CASE i " + " ".join(f"WHEN {k} THEN {O.lit(n)}" for k, n in names.items()) + " END"
    return (f"WITH {O.postings_cte()}, p AS (SELECT doc_id % 9 AS i FROM postings)\n"
            f"SELECT {source} AS source, 'b' || CAST(i AS VARCHAR) AS board, count(*) AS n FROM p WHERE i IN ({', '.join(map(str, names))}) GROUP BY i")


def keyword_index() -> str:
    from feedmatch.plans.queries import INDEX_KEYWORDS
    return (f"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), h AS (SELECT doc_id, {O.index_hits('t', INDEX_KEYWORDS)} AS hits FROM d)\n"
            "SELECT doc_id, CAST(len(hits) AS INTEGER) AS n, array_to_string(hits, ',') AS hits FROM h")


def funnel_counts_whole() -> str:
    return _matched(WHOLE_PREFS) + "SELECT coalesce(reject_reason, 'matched') AS reason, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM m GROUP BY 1"


def windowed_health() -> str:
    """Windows closed at the end; a response counts unless its window was closed before its batch came."""
    from feedmatch.plans.queries import HEALTH_BATCHES, HEALTH_DAYS, HEALTH_DELAY
    base = source_health().split(",\nb AS")[0].replace("SELECT p.event_id, 'feed'", "SELECT ev.ts, p.event_id, 'feed'")
    late = "CASE WHEN event_id % 101 = 0 THEN 2 WHEN event_id % 11 = 0 THEN 1 ELSE 0 END"
    return (base + ",\n"
            "z AS (SELECT *, date_trunc('day', ts) AS start, date_diff('day', (SELECT min(ts) FROM r), ts) AS days FROM r),\n"
            f"l AS (SELECT *, least({HEALTH_BATCHES - 1}, days // {HEALTH_DAYS} + {late}) AS batch FROM z),\n"
            f"w AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch) - INTERVAL {HEALTH_DELAY} DAY AS mark FROM l GROUP BY batch),\n"
            "k AS (SELECT l.* FROM l LEFT JOIN w ON w.batch = l.batch - 1 WHERE w.mark IS NULL OR start + INTERVAL 1 DAY > w.mark)\n"
            "SELECT epoch_us(start) AS start_micros, source, count(*) AS responses, count(*) FILTER (WHERE status >= 400) AS failed, "
            "CAST(coalesce(sum(n_mapped) FILTER (WHERE status < 400), 0) AS BIGINT) AS fetched, "
            "CAST(coalesce(sum(n_records - n_mapped) FILTER (WHERE status < 400), 0) AS BIGINT) AS skipped, "
            "count(*) FILTER (WHERE status >= 400) = 0 AND coalesce(sum(n_records - n_mapped) FILTER (WHERE status < 400), 0) = 0 AS healthy "
            "FROM k WHERE start + INTERVAL 1 DAY <= (SELECT max(mark) FROM w) GROUP BY start, source")


def digest_grouped() -> str:
    loc = "lower(coalesce(location, ''))"
    case = lambda table: " ".join(f"WHEN {O.lit(k)} THEN {O.lit(v)}" for k, v in table.items())
    noted = lambda head: f"{O.lit(head)} || CASE WHEN {why} <> '' THEN ' — ' || {why} ELSE '' END"
    why, spons, shown = "trim(coalesce(sponsorship_reason, ''))", "coalesce(sponsorship, '')", "coalesce(highlight, '')"
    has = lambda r: f"coalesce(list_contains(reasons, {O.lit(r)}), FALSE)"
    sec = f"(epoch({O.ts(FIXTURE_NOW)}) - epoch(posted_at))"
    hours = f"CAST(floor({sec} / 3600) AS BIGINT)"
    return _fresh() + (
        f", c AS (SELECT *, {O.country_bucket(loc, O.segments(loc), _REMOTE)} AS country FROM top),\n"
        "g AS (SELECT *, max(score) OVER (PARTITION BY country) AS best, count(*) OVER (PARTITION BY country) AS size FROM c)\n"
        "SELECT row_number() OVER (ORDER BY country = 'Other', best DESC, country, score DESC, lower(title), ord) AS n, country, "
        f"CASE country {case(dims.COUNTRY_FLAGS)} ELSE {O.lit(dims.DEFAULT_FLAG)} END || ' ' || country AS country_label, "
        f"size AS group_size, best AS group_best, job_key, title, score, CASE WHEN {has('hybrid')} THEN 'Hybrid' WHEN {_REMOTE} THEN 'Remote' "
        f"WHEN {has('onsite')} THEN 'On-site' ELSE '' END AS work_mode, "
        f"CASE WHEN posted_at IS NULL THEN '' WHEN {sec} < 3600 THEN 'just now' WHEN {hours} < 24 THEN CAST({hours} AS VARCHAR) || 'h ago' "
        f"ELSE CAST(CAST(floor({hours} / 24) AS BIGINT) AS VARCHAR) || 'd ago' END AS age, "
        f"CASE WHEN {spons} = 'yes' THEN {noted('Visa sponsorship likely')} WHEN {spons} = 'no' THEN {noted('Sponsorship unlikely')} "
        f"WHEN {shown} <> '' THEN {shown} WHEN {has('visa:sponsor-register')} THEN {O.lit(dims.HL_REGISTER)} ELSE '' END AS visa_note, "
        f"CASE WHEN starts_with({shown}, 'Open ') AND {spons} = '' THEN '🌍' ELSE '✈' END AS icon, "
        f"CASE source {case(dims.SOURCE_NAMES)} ELSE source END AS source_label FROM g")


def visa_excerpt(rel: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Windows as islands of touching spans, cut where their running length meets the budget."""
    head, pad, budget = dims.EXCERPT_HEAD, dims.EXCERPT_WINDOW, dims.EXCERPT_BUDGET
    term = O.lit("(?i)(?:" + "|".join(re.escape(t).replace("\\ ", " ") for t in dims.VISA_TERMS) + ")")
    return (
        f"WITH b AS (SELECT {key} AS doc_id, {O.ws_strip(f"coalesce({text}, '')")} AS body FROM {rel}), "
        f"r AS (SELECT *, substr(body, {head + 1}) AS rest FROM b WHERE length(body) > {budget}), "
        f"t AS (SELECT doc_id, length(body) AS n, unnest(string_split_regex(rest, {term})) AS gap, "
        f"unnest(regexp_extract_all(rest, {term})) AS term, generate_subscripts(string_split_regex(rest, {term}), 1) AS i FROM r), "
        f"e AS (SELECT *, {head} + sum(length(gap) + coalesce(length(term), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM t), "
        f"w AS (SELECT doc_id, 0 AS lo, {head} AS hi FROM r UNION ALL "
        f"SELECT doc_id, greatest({head}, stop - length(term) - {pad}), least(n, stop + {pad}) FROM e WHERE term IS NOT NULL), "
        "x AS (SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w), "
        "y AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lo, hi "
        "ROWS UNBOUNDED PRECEDING) AS island FROM x), "
        "z AS (SELECT doc_id, island, min(lo) AS lo, max(hi) AS hi FROM y GROUP BY doc_id, island), "
        f"q AS (SELECT *, {budget} - coalesce(sum(hi - lo) OVER (PARTITION BY doc_id ORDER BY island "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM z) "
        f"SELECT doc_id AS {key}, string_agg(substr(body, CAST(lo + 1 AS BIGINT), CAST(least(hi - lo, room) AS BIGINT)), {O.lit(dims.EXCERPT_JOIN)} "
        f"ORDER BY island) AS excerpt FROM q JOIN b USING (doc_id) WHERE room > 0 AND hi > lo GROUP BY doc_id "
        f"UNION ALL SELECT doc_id, body FROM b WHERE length(body) <= {budget}")


def _mapped_ctes() -> str:
    """``mp``: what each board's shape keeps of a posting, stated without the detour over JSON."""
    of = lambda cases, rest="NULL": "CASE i " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + f" ELSE {rest} END"
    names = ("greenhouse", "lever", "ashby", "remotive", "arbeitnow", "remoteok", "jobicy", "himalayas", "adzuna")
    loc, has_remote = "loc", "contains(lower(loc), 'remote')"
    range_ = "format('{:,}', doc_id * 100) || '–' || format('{:,}', doc_id * 130)"
    dollars = "'$' || format('{:,}', doc_id * 100) || '–$' || format('{:,}', doc_id * 130)"
    words = "'engineer|developer|software|devops|python|data'"
    first_tag, all_tags = "coalesce(nullif(tags[1], ''), '')", "array_to_string(tags, ',')"
    parts = (f"list_filter(list_transform(string_split_regex(loc, '[,/;|&]'), lambda x: {O.ws_strip('x')}), lambda x: x <> '')")
    return (
        f"WITH {O.postings_cte()}, p AS (SELECT *, doc_id % 9 AS i, {O.ws_strip("coalesce(location, '')")} AS loc, "
        f"{O.ws_strip('title')} AS t, {O.ws_strip('url')} AS u, {O.ws_strip("coalesce(company, '')")} AS co FROM postings "
        "WHERE doc_id % 50 <> 0),\n"
        f"mp AS (SELECT ord, description, posted_at AS posted, i, visa_sponsorship AS flag, {of({k: O.lit(n) for k, n in enumerate(names)})} AS source, "
        f"{of({0: "'b0:' || doc_id", 1: "'b1:' || source_id", 2: "'b2:' || source_id", 4: "'s-' || source_id", 7: 'u', 8: 'source_id'}, 'CAST(doc_id AS VARCHAR)')} AS source_id, "
        f"t AS title, {of({0: "coalesce(nullif(co, ''), 'b0')", 1: "'b1'", 2: "coalesce(nullif(co, ''), 'b2')"}, 'co')} AS company, u AS url, "
        f"{of({5: "coalesce(nullif(loc, ''), 'Remote')", 6: "coalesce(nullif(loc, ''), 'Anywhere')", 7: "coalesce(nullif(loc, ''), 'Worldwide')", 8: "coalesce(nullif(loc, ''), 'B8')"}, loc)} AS location, "
        f"{of({0: has_remote, 1: f'coalesce(remote, FALSE) OR {has_remote}', 2: f'coalesce(remote, {has_remote})', 4: 'CASE WHEN doc_id % 2 = 0 THEN remote END', 8: f"contains(lower(t || ' ' || coalesce(nullif(loc, ''), 'B8') || ' ' || {O.strip_html("coalesce(description, '')")}), 'remote')"}, 'TRUE')} AS remote, "
        f"strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at, "
        f"{of({5: dollars, 6: f"'EUR ' || {range_} || ' / year'", 7: f"'USD ' || {range_}"})} AS salary, "
        f"{of({4: "'full time'"})} AS job_type, "
        f"{of({0: first_tag, 1: first_tag, 3: all_tags, 5: all_tags, 6: all_tags, 8: "'b8'"}, "''")} AS tags, "
        f"{of({6: f"CASE WHEN len({parts}) > 0 THEN array_to_string({parts}, '|') ELSE 'Anywhere' END", 7: "coalesce(nullif(loc, ''), 'Worldwide')"})} AS regions "
        f"FROM p WHERE t <> '' AND u <> '' AND (i <> 3 OR regexp_matches(lower(t || ' ' || array_to_string(tags, ' ')), {words})))")


def map_sources_union() -> str:
    return _mapped_ctes() + "SELECT * EXCLUDE (ord, description, posted, i, flag) FROM mp"


def ingest_to_funnel() -> str:
    """The funnel over mapped postings: texts are stripped once more, regions come from the shape."""
    html = "coalesce(description, '')"
    twice = html
    for ent, ch in P.HTML_ENTITIES:
        twice = f"replace({twice}, {O.lit(ent)}, {O.lit(ch)})"
    regions = "CASE WHEN regions IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(regions, '|') END"
    return _mapped_ctes() + (
        f", mpost AS (SELECT ord, source, source_id, title, company, url, location, remote, salary, job_type, posted AS posted_at, "
        f"CASE WHEN i = 0 THEN {O.strip_html(twice)} ELSE {O.strip_html(html)} END AS description, "
        "CASE WHEN tags = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(tags, ',') END AS tags, "
        f"CASE WHEN i = 4 THEN flag END AS visa_sponsorship, {regions} AS regions FROM mp),\n"
        f"{O.register_ctes()},\n{O.matched_ctes(FIXTURE_PREFS, FIXTURE_NOW, 'mpost', regions='regions')}\n"
        "SELECT source, coalesce(reject_reason, 'matched') AS reason, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM m GROUP BY 1, 2")


def _drifted() -> str:
    """``r``: each payload's source, board, status and fate, from the document's number."""
    names = ("greenhouse", "lever", "ashby", "remotive", "arbeitnow", "remoteok", "jobicy", "himalayas", "adzuna")
    source = "CASE i " + " ".join(f"WHEN {k} THEN {O.lit(n)}" for k, n in enumerate(names)) + " END"
    words = "'engineer|developer|software|devops|python|data'"
    return (f"WITH {O.postings_cte()}, p AS (SELECT *, doc_id % 9 AS i, doc_id % 2 AS half, {O.ws_strip('title')} AS t, {O.ws_strip('url')} AS u FROM postings),\n"
            f"r AS (SELECT {source} AS source, CAST(floor(doc_id / 20) AS BIGINT) AS page, i, 'b' || CAST(i AS VARCHAR) || '-' || CAST(half AS VARCHAR) AS board, "
            "CASE WHEN i = 1 AND half = 1 THEN 503 WHEN i = 5 AND half = 0 THEN 429 ELSE 200 END AS status, "
            "CASE WHEN doc_id % 35 = 0 AND doc_id % 50 <> 0 AND i <> 7 THEN 'quarantined' WHEN i = 7 OR doc_id % 50 = 0 OR t = '' OR u = '' "
            f"OR (i = 3 AND NOT regexp_matches(lower(t || ' ' || array_to_string(tags, ' ')), {words})) THEN 'dropped' ELSE 'mapped' END AS fate, "
            f"CASE WHEN t = '' OR u = '' OR (i = 3 AND NOT regexp_matches(lower(t || ' ' || array_to_string(tags, ' ')), {words})) THEN 'dropped' ELSE 'mapped' END AS mended FROM p)\n")


def quarantine_records() -> str:
    of = ("source, board, page, 0 AS pos, ", "CAST(count(*) AS BIGINT) AS n FROM r WHERE status < 400 AND fate = 'quarantined' GROUP BY ALL")
    field = "CASE i WHEN 1 THEN 'text' WHEN 5 THEN 'position' WHEN 6 THEN 'jobTitle' ELSE 'title' END"
    return _drifted() + f"SELECT {of[0]}{field} AS what, {of[1]} UNION ALL SELECT {of[0]}'replayed: ' || mended AS what, {of[1]}"


def quarantine_counts() -> str:
    return _drifted() + ("SELECT source, board, count(*) AS n_records, count(*) FILTER (WHERE fate = 'mapped') AS n_mapped, "
                         "count(*) FILTER (WHERE fate = 'quarantined') AS n_broken, count(*) FILTER (WHERE fate = 'dropped') AS n_dropped "
                         "FROM r WHERE status < 400 GROUP BY 1, 2")


def unhealthy_sources() -> str:
    return _drifted() + (
        ", b AS (SELECT source, board, max(status) AS status, count(*) FILTER (WHERE status < 400) AS raw, "
        "count(*) FILTER (WHERE status < 400 AND fate = 'mapped') AS fetched, "
        "count(*) FILTER (WHERE status < 400 AND fate = 'quarantined') AS skipped FROM r GROUP BY 1, 2),\n"
        "h AS (SELECT source, CAST(sum(fetched) AS BIGINT) AS fetched, sum(raw) AS raw, CAST(sum(skipped) AS BIGINT) AS records_skipped, "
        "max(status) AS worst, coalesce(string_agg(board, ',' ORDER BY board) FILTER (WHERE status < 400), '') AS boards_ok, "
        "coalesce(string_agg(board, ',' ORDER BY board) FILTER (WHERE status >= 400), '') AS boards_failed, "
        "count(*) AS n, count(*) FILTER (WHERE status < 400) AS n_ok FROM b GROUP BY 1),\n"
        "e AS (SELECT *, CASE WHEN source NOT IN ('greenhouse', 'lever', 'ashby') AND worst >= 400 THEN 'HTTP ' || CAST(worst AS VARCHAR) "
        f"WHEN raw > 0 AND fetched = 0 THEN {O.lit(SCHEMA_MOVED)} ELSE '' END AS error FROM h)\n"
        "SELECT source AS name, fetched, error <> '' AS failed, error, boards_ok, boards_failed, records_skipped, "
        "source || ': ' || CASE WHEN error <> '' THEN 'FAILED (' || error || ')' ELSE concat_ws(', ', CAST(fetched AS VARCHAR) || ' fetched', "
        "CAST(n_ok AS VARCHAR) || '/' || CAST(n AS VARCHAR) || ' boards OK' || CASE WHEN boards_failed <> '' THEN ' — failed: ' || "
        "replace(boards_failed, ',', ', ') ELSE '' END, CASE WHEN records_skipped > 0 THEN CAST(records_skipped AS VARCHAR) || "
        "' unreadable record(s)' END) END AS summary FROM e WHERE error <> '' OR boards_failed <> '' OR records_skipped > 0")


ORACLE = {
    "map_sources_union": map_sources_union,
    "funnel_counts": funnel_counts,
    "seniority_levels": seniority_levels,
    "company_fold": company_fold,
    "hard_restriction": hard_restriction,
    "move_offer": move_offer,
    "remote_eligibility": remote_eligibility,
    "relocation_assessment": relocation_assessment,
    "scored_matches": scored_matches,
    "keyword_hits": keyword_hits,
    "html_to_text": html_to_text,
    "url_normalize_dups": url_normalize_dups,
    "posting_language_confusion": posting_language_confusion,
    "place_key_bucket": place_key_bucket,
    "seen_antijoin": seen_antijoin,
    "relative_age": relative_age,
    "salary_text": salary_text,
    "byte_budget_prefix": byte_budget_prefix,
    "seen_upsert": seen_upsert,
    "json_envelope_records": json_envelope_records,
    "stream_ingest_dedupe": stream_ingest_dedupe,
    "source_health": source_health,
    "page_prefix": page_prefix,
    "verdict_cache": verdict_cache,
    "tumbling_event_counts": tumbling_event_counts,
    "greedy_dedupe": greedy_dedupe,
    "digest_topn_backlog": digest_topn_backlog,
    "digest_grouped": digest_grouped,
    "run_summary": run_summary,
    "backlog_drain": backlog_drain,
    "visa_excerpt": visa_excerpt,
    "funnel_counts_strict": funnel_counts_strict,
    "relocation_evidence": relocation_evidence,
    "rejects": rejects,
    "digest_facts": digest_facts,
    "verdict_applied": verdict_applied,
    "to_classify": to_classify,
    "ingest_to_funnel": ingest_to_funnel,
    "quarantine_counts": quarantine_counts,
    "unhealthy_sources": unhealthy_sources,
    "stream_cross_batch": stream_cross_batch,
    "quarantine_records": quarantine_records,
    "seen_count": seen_count,
    "windowed_health": windowed_health,
    "register_reader": register_reader,
    "selected_sources": selected_sources,
    "run_ledger": run_ledger,
    "keyword_index": keyword_index,
    "funnel_counts_whole": funnel_counts_whole,
    "seen_backfill": seen_backfill,
    "verdict_merge": verdict_merge,
    "page_rules": page_rules,
}
