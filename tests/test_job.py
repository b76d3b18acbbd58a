"""A run's modes, write order and repeat runs, and the verdict path on small cases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from feedmatch import job
from feedmatch.operators import verdicts as V
from feedmatch.operators.state import SEEN_COLUMNS, store_count
from feedmatch.prefs import FIXTURE_NOW, FIXTURE_PREFS
from tests.conftest import SF_SMALL

SEEN = ", ".join(f"{c} {'timestamp_ntz' if c.endswith('_seen') else 'int' if c == 'notified' else 'string'}" for c in SEEN_COLUMNS)
PREFS = FIXTURE_PREFS.with_(max_jobs=4)


@pytest.fixture(scope="module")
def postings(spark):
    from feedmatch.plans.inputs import postings_fx
    from feedmatch.session import cut_lineage
    return cut_lineage(postings_fx(spark, SF_SMALL))


def test_modes_and_repeat_runs(spark, postings, tmp_path):
    empty = spark.createDataFrame([], SEEN)
    read = job.run(postings, empty, PREFS, FIXTURE_NOW)
    first = [r.job_key for r in read.digest.orderBy("n").collect()]
    assert len(first) == 4 and read.backlog > 0 and not list(tmp_path.iterdir())

    def refuse(_):
        raise OSError("no route")

    with pytest.raises(OSError):
        job.run(postings, empty, PREFS, FIXTURE_NOW, "deliver", str(tmp_path / "a"), sink=refuse)
    assert os.path.exists(tmp_path / "a/digest/_SUCCESS") and not os.path.exists(tmp_path / "a/seen")

    sent = []
    job.run(postings, empty, PREFS, FIXTURE_NOW, "deliver", str(tmp_path / "b"),
            sink=lambda d: sent.extend(r.job_key for r in d.orderBy("n").collect()))
    seen = spark.read.parquet(str(tmp_path / "b/seen"))
    assert sent == first and store_count(seen) == 4
    assert {(r.job_key, r.notified) for r in seen.collect()} == {(k, 1) for k in first}

    after = job.run(postings, seen, PREFS, FIXTURE_NOW, "mark", str(tmp_path / "c"))
    marked = {r.job_key: r.notified for r in spark.read.parquet(str(tmp_path / "c/seen")).collect()}
    assert after.backlog == max(0, read.backlog - 4) and {marked[k] for k in first} == {1}
    assert {k: n for k, n in marked.items() if k not in first} == {r.job_key: 0 for r in after.digest.collect()}
    assert spark.read.parquet(str(tmp_path / "c/rejects")).count() + after.matched.filter("reject_reason IS NULL").count() == postings.count()


def test_refused_arguments(postings):
    for mode, out in (("send", "x"), ("mark", None), ("deliver", "x")):
        with pytest.raises(ValueError):
            job.run(postings, None, PREFS, FIXTURE_NOW, mode, out)


def test_verdict_path(spark):
    say = lambda text: json.dumps({"content": [{"type": "text", "text": text}]})
    matches = spark.createDataFrame(
        [(1, "a", "no", "stated"), (2, "b", None, None), (3, "c", None, None), (4, "d", None, None), (5, "e", None, None),
         (6, "b", None, None)], "ord int, job_key string, sponsorship string, sponsorship_reason string")
    cache = spark.createDataFrame([("a", "yes", "old", 1), ("b", "yes", "kept", 1)], "job_key string, verdict string, reason string, checked_at int")
    replies = spark.createDataFrame(
        [("c", say('{"sponsorship": "no", "reason": "first"}'), 1), ("c", say('{"sponsorship": "yes", "reason": "later"}'), 2),
         ("c", say("nothing"), 3), ("d", say("no idea"), 2)], "job_key string, reply string, checked_at int")
    got = {(r.ord, r.sponsorship, r.sponsorship_reason, r.verdict_origin) for r in V.apply_verdicts(matches, cache, replies).collect()}
    assert got == {(1, "no", "stated", "rule"), (2, "yes", "kept", "cache"), (3, "yes", "later", "reply"),
                   (4, "unclear", "classifier returned no verdict", "unusable"), (5, "unclear", "classifier unavailable", "missing"),
                   (6, "yes", "kept", "cache")}
    merged = {(r.job_key, r.verdict, r.reason) for r in V.merge_verdicts(cache, replies).collect()}
    assert merged == {("a", "yes", "old"), ("b", "yes", "kept"), ("c", "yes", "later")}
    assert {r.job_key for r in V.undecided(matches, cache).collect()} == {"c", "d", "e"}


def test_fate_of_records(spark):
    from feedmatch.sources.mapping import fates
    good = {"id": "1", "text": "Engineer", "hostedUrl": "u", "categories": {"location": "Bonn"}}
    cases = [(good, "mapped"), ({**good, "text": ["x"]}, "quarantined"), ({**good, "id": {"a": 1}}, "quarantined"),
             ({**good, "categories": ["x"]}, "quarantined"), ({**good, "categories": None}, "mapped"),
             ({**good, "text": " "}, "dropped"), ({**good, "id": 7}, "mapped"), ({"other": 1}, "dropped")]
    df = spark.createDataFrame([("lever", "b", json.dumps(c), w) for c, w in cases] + [("unknown", "b", json.dumps(good), "dropped")],
                               "source string, board string, body string, want string")
    rows = fates(df.withColumn("record", F.parse_json("body"))).collect()
    assert [r.fate for r in rows] == [r.want for r in rows]
    assert [r.offending for r in rows] == [None, "text", "id", "categories", None, None, None, None, None]


def test_page_prefix_ends(spark):
    from feedmatch.sources.payloads import page_prefix
    rows = [("himalayas", 0, 200, 20, None), ("himalayas", 1, 200, 19, None), ("himalayas", 2, 200, 20, None),
            ("arbeitnow", 0, 200, 3, True), ("arbeitnow", 1, 200, 3, False), ("arbeitnow", 2, 200, 3, True),
            ("adzuna", 0, 200, 1, None), ("adzuna", 1, 500, 0, None), ("adzuna", 2, 200, 1, None),
            ("remotive", 0, 200, 0, None)]
    df = spark.createDataFrame([(s, "all", p, st, n, x) for s, p, st, n, x in rows],
                               "source string, board string, page int, status int, n_records int, has_next boolean")
    assert {(r.source, r.page) for r in page_prefix(df).collect()} == {
        ("himalayas", 0), ("himalayas", 1), ("arbeitnow", 0), ("arbeitnow", 1), ("adzuna", 0)}


def test_failed_sources(spark):
    from feedmatch.operators.health import fail_on_unhealthy, source_health
    df = spark.createDataFrame(
        [("jobicy", "all", 200, 5, 0, 0), ("remoteok", "all", 503, 0, 0, 0), ("lever", "a", 503, 0, 0, 0), ("lever", "b", 200, 2, 1, 0),
         ("adzuna", "de", 200, 0, 0, 0)], "source string, board string, status int, n_records int, n_mapped int, n_broken int")
    h = {r.name: r for r in source_health(df).collect()}
    assert h["jobicy"].failed and "shape" in h["jobicy"].error and h["remoteok"].error == "HTTP 503"
    assert not h["lever"].failed and not h["lever"].healthy and h["lever"].boards_failed == "a"
    assert h["adzuna"].healthy
    with pytest.raises(RuntimeError):
        fail_on_unhealthy(source_health(df))
