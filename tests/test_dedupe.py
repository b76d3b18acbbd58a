"""WIN-01 against an independent sequential model of the best-first walk."""

import random

from pyspark.sql import functions as F

from feedmatch.operators import dedupe as D
from tests.conftest import SF_SMALL


def sequential_keep(rows):
    """Walk rows best-first; keep a row iff no identity was registered by a kept row."""
    seen = {"key": set(), "url": set(), "fp": set()}
    kept = []
    for r in sorted(rows, key=lambda r: r["rank"]):
        ids = [(k, r[k]) for k in ("key", "url", "fp") if r[k]]
        if any(v in seen[k] for k, v in ids):
            continue
        for k, v in ids:
            seen[k].add(v)
        kept.append(r["id"])
    return set(kept)


def test_chain_keeps_first_and_last(spark):
    rows = [
        {"id": 1, "rank": 1, "key": "a:1", "url": "u1", "fp": "f1"},
        {"id": 2, "rank": 2, "key": "b:1", "url": "u1", "fp": "f2"},   # shares url with 1
        {"id": 3, "rank": 3, "key": "c:1", "url": "u3", "fp": "f2"},   # shares fp with 2
    ]
    df = spark.createDataFrame([(r["id"], r["key"], r["url"], r["fp"]) for r in rows],
                               "ord long, job_key string, url_norm string, fingerprint string")
    kept = {r.ord for r in D.greedy_dedupe(df, F.struct("ord"), "ord").collect()}
    assert kept == {1, 3} == sequential_keep(rows)


def test_random_graphs_match_sequential(spark):
    rnd = random.Random(7)
    for trial in range(3):
        rows = []
        for i in range(300):
            rows.append({"id": i, "rank": rnd.random(),
                         "key": f"k{rnd.randrange(250)}",
                         "url": rnd.choice([None, f"u{rnd.randrange(120)}"]),
                         "fp": rnd.choice([None, f"f{rnd.randrange(120)}"])})
        df = spark.createDataFrame(
            [(r["id"], r["rank"], r["key"], r["url"], r["fp"]) for r in rows],
            "ord long, rk double, job_key string, url_norm string, fingerprint string")
        kept = {r.ord for r in D.greedy_dedupe(df, F.struct("rk", "ord"), "ord").collect()}
        assert kept == sequential_keep(rows)


def test_fixture_dedupe_matches_sequential(spark):
    from feedmatch.plans.queries import greedy_dedupe_q
    from feedmatch.plans.inputs import postings_fx
    p = D.with_identities(postings_fx(spark, SF_SMALL)).select("ord", "job_key", "url_norm", "fingerprint")
    rows = [{"id": r.ord, "rank": r.ord, "key": r.job_key, "url": r.url_norm, "fp": r.fingerprint}
            for r in p.collect()]
    kept = {r.ord for r in greedy_dedupe_q(spark, SF_SMALL).collect()}
    assert kept == sequential_keep(rows)
    assert len(kept) < len(rows)
