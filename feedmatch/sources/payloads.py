"""Landed payloads -> records (SRC-01, SRC-12, SRC-13).

Payload bodies are parsed once as VARIANT (``try_parse_json``); anything that
is not JSON, not a list, or not a list under one of the envelope keys yields
no records instead of an error.  Only object elements are records.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def envelope_array(body: Column, keys) -> Column:
    """The record list: the payload itself if it is a list, else the first listed key holding a list."""
    v = F.try_parse_json(body)
    candidates = [F.try_variant_get(v, "$", "array<variant>")]
    candidates += [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in keys]
    return F.coalesce(*candidates)


def records(payloads: DataFrame, body: str, keys, keep=()) -> DataFrame:
    """One row per object element: ``keep`` columns + ``pos`` (position in the list) + ``record``."""
    arr = envelope_array(F.col(body), keys)
    exploded = payloads.select(*keep, F.posexplode(arr).alias("pos", "record"))
    return exploded.filter(F.schema_of_variant(F.col("record")).startswith("OBJECT"))


def source_records(payloads: DataFrame, keep=("page",), outer: bool = False) -> DataFrame:
    """One row per record of ``payloads`` (source, board, body), found by its source's own envelope: source, board, ``keep``, pos
    (in the payload's list) and record.  ``outer`` keeps a row without record for a response that has none (empty, failed or
    not JSON), and gives no pos."""
    from feedmatch.sources.mapping import SPECS
    from feedmatch.sources.spec import envelope

    listed = envelope(SPECS, "body")
    if outer:
        objects = f"filter({listed}, x -> schema_of_variant(x) LIKE 'OBJECT%')"
        return payloads.select("source", "board", *keep, F.explode_outer(F.expr(objects)).alias("record"))
    rows = payloads.select("source", "board", *keep, F.posexplode(F.expr(listed)).alias("pos", "record"))
    return rows.filter(F.schema_of_variant(F.col("record")).startswith("OBJECT"))


def responses(payloads: DataFrame) -> DataFrame:
    """Counts per response: n_records, n_mapped and n_broken, by the fate of each record.

    ``payloads`` need source, board, page, status and body.  A response without
    records keeps its row, with zeros.
    """
    from feedmatch.sources.mapping import fates

    each = fates(source_records(payloads, ("page", "status"), outer=True))
    each = each.select("source", "board", "page", "status", F.expr("CASE WHEN record IS NOT NULL THEN fate END").alias("fate"))
    return (each.groupBy("source", "board", "page", "status")
                .agg(F.count("fate").alias("n_records"), F.count_if(F.col("fate") == "mapped").alias("n_mapped"),
                     F.count_if(F.col("fate") == "quarantined").alias("n_broken")))


def field(record: Column, path: str, dtype: str = "string") -> Column:
    """A typed field of a record, NULL when absent or of another type."""
    return F.try_variant_get(record, f"$.{path}", dtype)


# --- fixed values: sources whose pages name the next one, and the size of a full page where a short one is the last ---
NAMES_NEXT = ("arbeitnow", "jobicy")
FULL_PAGE = {"himalayas": 20}


def page_prefix(pages: DataFrame, group=("source", "board"), page: str = "page") -> DataFrame:
    """SRC-15: per (source, board) the pages that paging would have fetched.

    A failed (HTTP status >= 400) or empty page ends the prefix and isn't part
    of it.  A page that names no next one (column ``has_next``, where there is
    one, for the sources that do) and a page shorter than the source's full
    page end it too, but belong to it.  Ends are counted along the pages by
    ``prefix_sums``: a board of any number of pages is spread over the tasks,
    and neither a join of the pages nor a count before it is needed.
    """
    from feedmatch.operators.scan import prefix_sums

    stop = (F.col("status") >= 400) | (F.col("n_records") == 0)
    last = F.lit(False)
    for source, size in FULL_PAGE.items():
        last = last | ((F.col("source") == source) & (F.col("n_records") < size))
    if "has_next" in pages.columns:
        last = last | (F.col("source").isin(list(NAMES_NEXT)) & ~F.coalesce(F.col("has_next"), F.lit(False)))
    last = last & ~stop
    # rows of one page: those that end the prefix at once come first, those that only end it behind them last
    order = [F.col(page), F.when(stop, 0).when(last, 2).otherwise(1)]
    counted = prefix_sums(pages, list(group), order, {"_stops": stop.cast("int"), "_lasts": last.cast("int")})
    within = (F.col("_stops") == 0) & (F.col("_lasts") - last.cast("int") == 0)
    return counted.filter(within).drop("_stops", "_lasts", "_stops_total", "_lasts_total")


def read_register(spark: SparkSession, path: str | None) -> DataFrame:
    """SRC-16: the lines of a register file: a list (one employer a line), or, by its name, a CSV whose first column counts.

    No path, or one that isn't there, is an empty register.  Blank and comment lines are left to ``register_names``.
    """
    none = spark.createDataFrame([], "line string")
    if not path:
        return none
    try:
        if path.lower().rstrip("/").endswith(".csv"):
            rows = spark.read.schema("line string").option("escape", '"').option("enforceSchema", True).csv(path)
        else:
            rows = spark.read.text(path).withColumnRenamed("value", "line")
        return rows.select("line")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
