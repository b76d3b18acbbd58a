"""The sources and the mapping of their records to postings (EXT-01/02, SRC-02..13, SRC-18, FN-12..15).

Fields are read by the compiled specs (one reader per field); what a source
does beside naming its fields is a case of the few rules below, each of which
stands once in the plan.  Every field read is typed and tolerant: a missing or
wrong-typed field is NULL or empty, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmatch.functions.dates import parse_instant
from feedmatch.functions.patterns import REGION_SPLIT
from feedmatch.functions.regex import spark_sql_literal as lit
from feedmatch.functions.salary import format_salary
from feedmatch.functions.text import strip_html, unescape_html
from feedmatch.sources import spec as K
from feedmatch.sources.spec import SourceSpec

# --- fixed values: words of technical roles outside the software category (SRC-06) ----------------
TECHNICAL_WORDS = ("engineer", "developer", "software", "devops", "python", "data")

_REGIONS = "CASE WHEN size({0}) > 0 THEN {0} ELSE array('{1}') END"
_JOBICY_REGIONS = f"filter(transform(split(location, {lit(REGION_SPLIT)}), r -> {K.strip('r')}), r -> r <> '')"

# --- fixed values: the sources, with the field names and fallbacks of each board's payload, in registry order (SRC-17) ----
SPECS = (
    SourceSpec("greenhouse", {
        "source_id": "id", "title": "title", "url": "absolute_url", "company": "company_name", "location": "location.name", "html": "content",
        "tag_names": "departments", "at": "first_published", "at_else": "updated_at"},
        objects=("location",), failure="board", board_ids=True),
    SourceSpec("lever", {
        "source_id": "id", "title": "text", "url": ("hostedUrl", "applyUrl"), "location": "categories.location", "plain": "descriptionPlain",
        "html": "description", "tag_texts": ("categories.team", "categories.department", "categories.commitment"), "workplace": "workplaceType",
        "at": "createdAt", "salary_text": "salaryDescription", "low_text": "salaryRange.min", "high_text": "salaryRange.max",
        "currency": "salaryRange.currency", "job_text": "categories.commitment"},
        objects=("categories",), failure="board", board_ids=True, extra={"board": "board", "workplace_type": "nullif(lower(workplace), '')"}),
    SourceSpec("ashby", {
        "source_id": "id", "title": "title", "url": ("jobUrl", "applyUrl"), "company": "organizationName", "location": "location",
        "plain": "descriptionPlain", "html": "descriptionHtml", "tag_texts": ("department", "team"), "remote_flag": "isRemote",
        "at": "publishedAt", "at_else": "updatedAt", "salary_text": "compensation.compensationTierSummary", "job_text": "employmentType"},
        failure="board", board_ids=True),
    SourceSpec("remotive", {
        "source_id": "id", "title": "title", "url": "url", "company": "company_name", "location": ("candidate_required_location", "job_type"),
        "html": "description", "tag_list": "tags", "at": "publication_date", "category": "category", "salary_text": "salary", "job_text": "job_type"},
        quiet=True, extra={"category": "nullif(category, '')"}),
    SourceSpec("arbeitnow", {
        "source_id": ("slug", "url"), "title": "title", "url": "url", "company": "company_name", "location": "location", "html": "description",
        "tag_list": "tags", "remote_flag": "remote", "at": "created_at", "at_else": "createdAt", "job_list": "job_types",
        "job_text": ("job_types", "job_type"), "visa_flag": "visa_sponsorship"},
        envelope=("data",), quiet=True),
    SourceSpec("remoteok", {
        "source_id": "id", "title": "position", "url": ("url", "apply_url"), "company": "company", "location": "location", "html": "description",
        "tag_list": "tags", "at": "date", "at_else": "epoch", "low": "salary_min", "high": "salary_max"}),
    SourceSpec("jobicy", {
        "source_id": "id", "title": ("jobTitle", "title"), "url": "url", "company": "companyName", "location": "jobGeo",
        "html": ("jobDescription", "jobExcerpt"), "tag_list": "jobIndustry", "at": "pubDate", "low": ("salaryMin", "annualSalaryMin"),
        "high": ("salaryMax", "annualSalaryMax"), "currency": "salaryCurrency", "period": "salaryPeriod", "job_list": "jobType", "level_text": "jobLevel"},
        extra={"eligible_regions": _REGIONS.format(_JOBICY_REGIONS, "Anywhere"),
               "level": "CASE WHEN lower(level_text) <> 'any' THEN nullif(level_text, '') END"}),
    SourceSpec("himalayas", {
        "source_id": ("guid", "id", "slug", "url"), "title": "title", "url": ("applicationLink", "applicationUrl", "url"), "company": "companyName",
        "html": ("description", "excerpt"), "tag_names": "categories", "region_names": "locationRestrictions", "level_names": "seniority",
        "at": "pubDate", "at_else": "publishedAt", "low": "minSalary", "high": "maxSalary", "currency": "currency", "period": "salaryPeriod",
        "job_text": "employmentType"},
        extra={"eligible_regions": _REGIONS.format("region_names", "Worldwide"), "level": "nullif(array_join(level_names, ', '), '')"}),
    SourceSpec("adzuna", {
        "source_id": "id", "title": "title", "url": ("redirect_url", "adref"), "company": "company.display_name", "location": "location.display_name",
        "html": "description", "area": "location.area", "at": "created", "low": "salary_min", "high": "salary_max", "low_text": "salary_min",
        "high_text": "salary_max", "category": "category.label"},
        envelope=("results",), objects=("location", "company"), quiet=True, extra={"country": "board", "category": "nullif(category, '')"}),
)
BY_NAME = {s.name: s for s in SPECS}
ORDER = tuple(BY_NAME)  # the global fetch-order tie-break (SRC-17)
EXTRA_TYPES = {"board": "string", "workplace_type": "string", "category": "string", "country": "string",
               "level": "string", "eligible_regions": "array<string>"}


def _when(rules: dict[str, str], otherwise: str = "NULL") -> str:
    """One rule by source; names may be joined by a bar."""
    whens = " ".join(f"WHEN source IN ({', '.join(lit(n) for n in names.split('|'))}) THEN {sql}" for names, sql in rules.items())
    return f"CASE {whens} ELSE {otherwise} END"


def _remote(*texts: str) -> str:
    return f"contains(lower(concat_ws(' ', {', '.join(texts)})), 'remote')"


def _bound(text: str) -> str:
    return f"coalesce(nullif({text}, ''), '?')"


def _dollars() -> str:
    """Remote OK: both bounds, or whichever is a positive number."""
    amount = [f"nullif(CASE WHEN {n} > 0 THEN floor({n}) END, 0)" for n in ("low", "high")]
    return "nullif(array_join(array_compact(array(" + ", ".join(f"concat('$', format_number({a}, 0))" for a in amount) + ")), '–'), '')"


_AREA = "nullif(array_join(area, ', '), '')"
RULES = {
    "company": _when({"lever": "board", "greenhouse|ashby": "coalesce(nullif(company, ''), board)"}, "company"),
    "location": _when({"remoteok": "coalesce(nullif(location, ''), 'Remote')", "jobicy": "coalesce(nullif(location, ''), 'Anywhere')",
                       "himalayas": "coalesce(nullif(array_join(region_names, ', '), ''), 'Worldwide')",
                       "adzuna": f"coalesce(nullif(location, ''), {_AREA}, upper(board))"}, "location"),
    "tags": _when({"lever|ashby": "tag_texts", "greenhouse|himalayas": "tag_names", "adzuna": "array(board)"}, "tag_list"),
    "remote": _when({"greenhouse": _remote("location"), "lever": f"lower(workplace) = 'remote' OR {_remote('location')}",
                     "ashby": f"coalesce(remote_flag, {_remote('location')})", "arbeitnow": "remote_flag",
                     "adzuna": _remote("title", "location", "array_join(area, ', ')", "html")}, "true"),
    "job_type": "coalesce(nullif(array_join(job_list, ', '), ''), nullif(job_text, ''))",
    "visa_sponsorship": "visa_flag",
    "own_salary": _when({
        "lever": "coalesce(nullif(salary_text, ''), CASE WHEN low_text <> '' OR high_text <> '' THEN "
                 f"trim(concat(currency, ' ', {_bound('low_text')}, '–', {_bound('high_text')})) END)",
        "remoteok": _dollars(),
        "adzuna": f"CASE WHEN coalesce(low, 0) <> 0 OR coalesce(high, 0) <> 0 THEN concat({_bound('low_text')}, '–', {_bound('high_text')}) END"},
        "nullif(salary_text, '')"),
    "extra": "named_struct(" + ", ".join(
        f"'{k}', cast({_when({s.name: s.extra[k] for s in SPECS if k in s.extra})} as {t})" for k, t in EXTRA_TYPES.items()) + ")",
}
#: SRC-12, SRC-06: an id, a title and a url, and wanted by its source.
_TECHNICAL = (f"contains(lower(category), 'software') OR exists(array({', '.join(map(lit, TECHNICAL_WORDS))}), "
              "w -> contains(lower(concat_ws(' ', title, array_join(tag_list, ' '))), w))")
_USABLE = " AND ".join(f"{f} <> ''" for f in K.REQUIRED) + f" AND ({_when({'remotive': _TECHNICAL}, 'true')})"
_FATE = ("CASE WHEN NOT array_contains(array(" + ", ".join(map(lit, ORDER)) + "), source) OR source IS NULL THEN 'dropped' "
         f"WHEN offending IS NOT NULL THEN 'quarantined' WHEN coalesce({_USABLE}, false) THEN 'mapped' ELSE 'dropped' END")


def read_fields(records: DataFrame) -> DataFrame:
    """``records`` (columns source, board, record and others) with every field of the specs, ``offending`` and ``fate``.

    SRC-13: "quarantined" is a record whose id, title or url holds a list or an object, or whose place or company is no
    object where the source sends one: its types broke, and it costs only itself. "dropped" is a readable record that lacks
    one of the required fields, that its source doesn't want, or whose source is unknown; the others are "mapped".
    """
    # A generator evaluates the record's fields once; struct columns would be inlined into every rule.
    read = records.select("*", F.expr(f"inline({K.readers(SPECS)})"))
    return read.withColumn("offending", F.expr(K.offending(SPECS))).withColumn("fate", F.expr(_FATE))


def fates(records: DataFrame) -> DataFrame:
    """``records`` with ``fate`` and ``offending``."""
    return read_fields(records).select(*records.columns, "fate", "offending")


def map_records(records: DataFrame) -> DataFrame:
    """SRC-02..13, 17, 18: postings from records of all sources (columns source, board, page, pos, record), in one pass.

    ``extra`` and ``ord`` (fetch order) have the form that the matching rules take.
    """
    return postings_of(read_fields(records).filter("fate = 'mapped'"))


def postings_of(read: DataFrame, carried: list[str] = ()) -> DataFrame:
    """Postings from the read fields of mapped records, with other columns ``carried`` along."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("source"))
    html = F.when(F.col("source") == "greenhouse", unescape_html(F.col("html"))).otherwise(F.col("html"))
    board_id = f"CASE WHEN source IN ({', '.join(lit(s.name) for s in SPECS if s.board_ids)}) THEN concat(board, ':', source_id) ELSE source_id END"
    formatted = format_salary(F.col("low"), F.col("high"), F.nullif(F.col("currency"), F.lit("")), F.col("period"))
    return read.select(
        *carried, "source", F.struct(rank.alias("source_rank"), "board", "page", "pos").alias("ord"), F.expr(board_id).alias("source_id"), "title", "url",
        *(F.expr(sql).alias(n) for n, sql in RULES.items() if n != "own_salary"),
        F.when(F.col("source").isin("jobicy", "himalayas"), formatted).otherwise(F.expr(RULES["own_salary"])).alias("salary"),
        F.coalesce(*(parse_instant(F.col(f"{at}_text"), F.col(f"{at}_number")) for at in K.INSTANTS)).alias("posted_at"),
        F.coalesce(F.nullif(F.col("plain"), F.lit("")), strip_html(html)).alias("description"))


ATS = tuple(s.name for s in SPECS if s.failure == "board")


def select_sources(payloads: DataFrame, prefs) -> DataFrame:
    """SRC-14: a source is on unless disabled; ATS boards only when listed.

    With payloads laid out as ``partitionBy(source, board)`` this filter prunes
    whole folders at the scan.
    """
    enabled = [n for n in ORDER if prefs.source_is_enabled(n)]
    cond = F.col("source").isin(enabled)
    for ats in ATS:
        boards = list(prefs.boards_for(ats))
        cond = cond & ((F.col("source") != ats) | F.col("board").isin(boards if boards else ["\u0000"]))
    return payloads.filter(cond)
