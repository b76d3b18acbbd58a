"""Fixture views built from the driver's tables (FIXTURES.md part B).

Each view is emitted as SQL text for either engine from one Python spec, so
the Spark input and the DuckDB oracle input are the same rows.  Nothing is
written anywhere: the views are plain SELECTs over the parquet tables, so
they grow with the tables.
"""

from __future__ import annotations

from feedmatch.functions.regex import DUCKDB, SPARK, sql_literal

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# --- fixture vocabularies: our own wording; each entry reaches another branch of the rules -----
PREFIX = ("Senior ", "Staff ", "Principal ", "Junior ", "", "Head of ", "Lead ", "Medior ",
          "Working Student ", "International ", "Graduate ", "Sr. ", "")
ROLE = ("Python Engineer", "Backend Developer", "Data Engineer II", "Product Manager",
        "Software Architect", "Engineer I", "Consultant")
LEGAL = ("", " B.V.", " GmbH", " N.V.", " Holding Group")
LOCATION = ("Utrecht, Netherlands", "Hamburg, DE", "Lima, Peru", "Worldwide", "Remote", "Remote - Peru", "",
            "USA only", "UK only", "Köln, Deutschland", "Hybrid - Berlin", "Berlin (Remote)", "Europe",
            "Denver, Colorado", "Eindhoven", "Lund, SE", "India", "APAC", "Remote - Germany",
            "Montreal, Canada", "Malta", "Anywhere in Europe", "Cork / Leeds")
EVIDENCE = ("We offer visa sponsorship, and a relocation budget too.", "We do not sponsor work visas.",
            "Visa sponsorship is not available for this position.",
            "Applicants must already hold the right to work in Germany.", "Open to EU citizens only.",
            "A relocation package is part of the offer.", "Sadly there is no relocation package.",
            "Fluent Dutch is required.", "Some Dutch is a plus.", "A security clearance is required.",
            "Local applicants only.", "You must be based in Berlin; we support relocation.",
            "You must be based in Ireland.", "You must be located in a timezone close to UTC.",
            "This is a hybrid role with two office days.", "A fully remote role: work from home.",
            "The EU Blue Card is possible.", "We cannot arrange visas.", "")
TAGS = ("python", "retail", "data")
R_AND_D = "Python backend R&amp;D. "
FX_NOW = "2000-01-01 00:00:00"
SEEN_AT = "1998-06-01 00:00:00"


def _pick(expr: str, values) -> str:
    whens = " ".join(f"WHEN {i} THEN {sql_literal(v)}" for i, v in enumerate(values))
    return f"(CASE {expr} {whens} END)"


def _arr(engine: str, *items: str) -> str:
    return ("array(" if engine == SPARK else "list_value(") + ", ".join(items) + ")"


def ts(engine: str, text: str) -> str:
    return ("TIMESTAMP_NTZ " if engine == SPARK else "TIMESTAMP ") + sql_literal(text)


def _base_sql(engine: str) -> str:
    legal_idx = "(CAST(floor(d.doc_id / 100) AS BIGINT) % 5)"
    return f"""
SELECT
  d.source AS source,
  CAST(d.doc_id AS STRING) AS source_id,
  {_pick('d.doc_id % 13', PREFIX)} || p.p_name || ' ' || {_pick('d.doc_id % 7', ROLE)} AS title,
  CASE WHEN d.doc_id % 37 = 0 THEN '' ELSE c.c_name || {_pick(legal_idx, LEGAL)} END AS company,
  'https://jobs.example.com/' || d.source || '/' || CAST(d.doc_id AS STRING) AS url,
  {_pick('d.doc_id % 23', LOCATION)} AS location,
  '<p>' || {_pick('d.doc_id % 19', EVIDENCE)} || '</p> '
    || CASE WHEN d.doc_id % 3 <> 0 THEN {sql_literal(R_AND_D)} ELSE '' END || d.text AS description,
  {_arr(engine, _pick('d.doc_id % 3', TAGS))} AS tags,
  CASE WHEN d.doc_id % 4 = 0 THEN TRUE WHEN d.doc_id % 4 = 1 THEN FALSE END AS remote,
  CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE o.o_orderdate END AS posted_at,
  CAST(NULL AS STRING) AS salary,
  CAST(NULL AS STRING) AS job_type,
  CASE WHEN l.quality = 1 THEN TRUE WHEN l.quality = 0 THEN FALSE END AS visa_sponsorship,
  d.doc_id * 10 AS ord,
  d.doc_id AS doc_id
FROM (SELECT *, doc_id % (SELECT 1 + max(p_partkey) FROM part) AS part_of,
             doc_id % (SELECT 1 + max(c_custkey) FROM customer) AS customer_of FROM documents) d
LEFT JOIN part p ON p.p_partkey = d.part_of
LEFT JOIN customer c ON c.c_custkey = d.customer_of
LEFT JOIN orders o ON o.o_orderkey = d.doc_id
LEFT JOIN labels l ON l.doc_id = d.doc_id
"""


# Repost variants by doc_id % 17; every residue keeps its original row.
VARIANTS = tuple((r, "orig") for r in range(17)) + (
    (3, "url"), (5, "fp"), (7, "chain_b"), (7, "chain_c"), (9, "key"))


def postings_sql(engine: str = SPARK) -> str:
    """``postings_fx``: base rows plus the reposts that drive dedupe.

    One scan of the base rows, equi-joined on ``doc_id % 17`` to a 22-row
    literal table of variants (broadcast), instead of one scan per variant.
    """
    values = ", ".join(f"({r}, {sql_literal(k)})" for r, k in VARIANTS)
    vtab = f"(VALUES {values}) AS v(residue, kind)"
    did = "CAST(b.doc_id AS STRING)"
    return f"""
WITH base AS ({_base_sql(engine)})
SELECT
  CASE WHEN v.kind IN ('orig', 'key') THEN b.source ELSE 'agg' END AS source,
  CASE WHEN v.kind IN ('orig', 'key') THEN b.source_id
       WHEN v.kind = 'chain_c' THEN 'c' || {did} ELSE 'b' || {did} END AS source_id,
  CASE v.kind WHEN 'url' THEN b.title || ' (m/f)' WHEN 'chain_b' THEN b.title || ' x'
       WHEN 'chain_c' THEN b.title || ' x' WHEN 'key' THEN b.title || ' (repost)'
       ELSE b.title END AS title,
  b.company AS company,
  CASE v.kind WHEN 'url' THEN b.url || '?utm=1'
       WHEN 'fp' THEN 'https://agg.example.com/b/' || {did}
       WHEN 'chain_b' THEN b.url || '/'
       WHEN 'chain_c' THEN 'https://agg.example.com/c/' || {did}
       WHEN 'key' THEN 'https://agg.example.com/k/' || {did}
       ELSE b.url END AS url,
  b.location AS location, b.description AS description, b.tags AS tags, b.remote AS remote,
  b.posted_at AS posted_at, b.salary AS salary, b.job_type AS job_type,
  b.visa_sponsorship AS visa_sponsorship,
  b.ord + CASE v.kind WHEN 'orig' THEN 0 WHEN 'chain_c' THEN 2 ELSE 1 END AS ord,
  b.doc_id AS doc_id
FROM base b JOIN {vtab} ON v.residue = b.doc_id % 17
"""


def register_lines_sql(engine: str = SPARK) -> str:
    """``register_fx`` as raw lines: every tenth customer with a legal form,
    plus one comment line and one blank line."""
    return """
SELECT c_name || ' B.V.' AS line FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT '# official register export' AS line
UNION ALL SELECT '' AS line
"""


def replies_sql(engine: str = SPARK) -> str:
    """``replies_fx(job_key, reply)``: model replies in five shapes by doc_id % 5, wrapped in the
    message envelope ``{"content": [{"type": "text", "text": ...}]}``.

    0 plain JSON, 1 fenced JSON, 2 JSON padded with prose, 3 an invalid verdict, 4 not JSON.
    """
    verdict = _pick("d.doc_id % 3", ("yes", "no", "unclear"))
    obj = ("'{\"sponsorship\": \"' || " + verdict +
           " || '\", \"reason\": \" Posting  mentions   visa ' || CAST(d.doc_id AS STRING) || ' \"}'")
    text = f"""CASE d.doc_id % 5
        WHEN 0 THEN {obj}
        WHEN 1 THEN 'Sure.' || chr(10) || '```json' || chr(10) || {obj} || chr(10) || '```'
        WHEN 2 THEN 'Here is my answer: ' || {obj} || ' Hope that helps.'
        WHEN 3 THEN '{{"sponsorship": "maybe", "reason": "hm"}}'
        ELSE 'I cannot tell from this posting.' END"""
    if engine == SPARK:
        wrap = "to_json(named_struct('content', array(named_struct('type', 'text', 'text', txt))))"
    else:
        wrap = "to_json(struct_pack(content := [struct_pack(type := 'text', text := txt)]))"
    return f"""
SELECT job_key, CAST({wrap} AS STRING) AS reply
FROM (SELECT d.source || ':' || CAST(d.doc_id AS STRING) AS job_key, {text} AS txt
      FROM documents d) r
"""


def seen_sql(engine: str = SPARK) -> str:
    """``seen_fx``: base rows with doc_id % 7 = 2, stored as earlier history.

    Identities (url_norm, fingerprint) are derived by the caller with the same
    functions the pipeline uses; this returns the raw columns.
    """
    return f"""
SELECT source, source_id, url, title, company, location, remote,
       {ts(engine, SEEN_AT)} AS first_seen, {ts(engine, SEEN_AT)} AS last_seen,
       CAST(doc_id % 2 AS INT) AS notified, doc_id
FROM ({_base_sql(engine)}) b WHERE doc_id % 7 = 2
"""
