"""Prefix sums, stores by key bucket, the identity filter and the ranked queue, against plain Python."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from feedmatch import job
from feedmatch.operators import digest as G
from feedmatch.operators.backlog import RankedQueue
from feedmatch.operators.history import IdentityIndex, SeenHistory
from feedmatch.operators.joins import salted_join
from feedmatch.operators.scan import prefix_sums
from feedmatch.operators.state import SEEN_COLUMNS
from feedmatch.operators.store import KeyedStore
from feedmatch.prefs import FIXTURE_NOW


@pytest.fixture()
def many_parts(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_prefix_sums_over_a_hot_group(spark, many_parts):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), i, rnd.choice([None, 0, 1, 5])) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, at int, v int").repartition(5)
    out = prefix_sums(df, ["g"], [F.col("at")], {"cum": F.col("v"), "i": F.lit(1)})
    got = {(r.g, r.at): (r.cum, r.i, r.cum_total, r.i_total) for r in out.collect()}
    want, cum, n = {}, {}, {}
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        cum[g], n[g] = cum.get(g, 0) + (v or 0), n.get(g, 0) + 1
        want[g, at] = cum[g], n[g]
    assert got == {k: (*v, cum[k[0]], n[k[0]]) for k, v in want.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan and out.filter("g = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert prefix_sums(df.where("false"), ["g"], [F.col("at")], {"cum": F.col("v")}).count() == 0


def _budgeted(blocks, budget, head, tail):
    """kept, dropped and bytes of one group, block by block."""
    more = lambda n: len(f"…and {n} more not shown.\n".encode()) if n else 0
    body, kept = head, 0
    for i, block in enumerate(blocks):
        if body + len(block.encode()) + more(len(blocks) - i - 1) + tail > budget:
            break
        body, kept = body + len(block.encode()), kept + 1
    return kept, len(blocks) - kept, body + more(len(blocks) - kept) + tail


def test_byte_budget_against_a_sequential_walk(spark, many_parts):
    rnd = random.Random(2)
    groups = {g: ["x" * rnd.randint(0, 40) + rnd.choice(["", "é…"]) for _ in range(n)] for g, n in enumerate([1, 3, 50, 3000, 1, 17])}
    rows = [(g, i, b) for g, blocks in groups.items() for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "g int, at int, block string")
    for budget in (30, 400, 5000, 10**6):
        got = {r.g: (r.kept, r.dropped, r.body_bytes) for r in G.byte_budget(df, "g", "at", "block", budget, 7, 5).collect()}
        assert got == {g: _budgeted(blocks, budget, 7, 5) for g, blocks in groups.items()}


def _files(root):
    return {os.path.relpath(os.path.join(d, f), root): hashlib.md5(open(os.path.join(d, f), "rb").read()).hexdigest()
            for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "k string, v int", ("k",), 16)
    store.create(spark.createDataFrame([(f"k{i}", i) for i in range(200)], "k string, v int"))
    before = _files(tmp_path / "data")
    new = spark.createDataFrame([("k7", 70), ("new", 1)], "k string, v int")
    merge = lambda old, more: old.join(more, "k", "left_anti").unionByName(more)
    touched = store.update(new, merge)
    after = _files(tmp_path / "data")
    assert {f: h for f, h in after.items() if f in before} == before and len(touched) <= 2
    assert {f.split("/")[1] for f in after if f not in before} == {f"bucket={b}" for b in touched}
    want = {f"k{i}": i for i in range(200)} | {"k7": 70, "new": 1}
    assert {r.k: r.v for r in store.read().collect()} == want and store.count() == 201 and store.version() == 1
    assert {r.k: r.v for r in store.read(version=0).collect()} == {f"k{i}": i for i in range(200)}
    store.update(new, merge, version=0)  # run again from the version it first saw
    assert store.version() == 1 and {r.k: r.v for r in store.read().collect()} == want
    held = store.held()
    assert {r.k for r in store.read(touched).collect()} == {r.k for r in store.read().filter(store.bucket().isin(touched)).collect()}
    assert {held[b] for b in touched} == {1} and {v for b, v in held.items() if b not in touched} == {0}


def test_empty_store(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "k string, v int", ("k",), 4).create(spark.createDataFrame([], "k string, v int"))
    assert store.count() == 0 and store.version() == 0 and store.read().count() == 0
    store.update(spark.createDataFrame([("a", 1)], "k string, v int"), lambda old, new: old.unionByName(new))
    assert store.count() == 1


SEEN = ", ".join(f"{c} {'timestamp_ntz' if c.endswith('_seen') else 'int' if c == 'notified' else 'string'}" for c in SEEN_COLUMNS)


def _seen_rows(spark, ids):
    rows = [(f"s:{i}", "s", str(i), f"u{i}", f"u{i}", "t", "c", "", f"f{i}", None, None, 0) for i in ids]
    return spark.createDataFrame(rows, SEEN)


@pytest.mark.parametrize("per_block", [24, 10**6])  # a fitting filter, and one so small that nearly everything may be known
def test_history_antijoin_is_exact(spark, tmp_path, per_block):
    history = SeenHistory(spark, str(tmp_path), 8).create(_seen_rows(spark, range(400)), per_block)
    batch = spark.createDataFrame([(1, "s:3", "x1", None), (2, "s:900", "u5", None), (3, "s:901", "x3", "f399"), (4, "s:902", "x4", "f400"),
                                   (5, "s:903", None, ""), *[(10 + i, f"n:{i}", f"n{i}", f"g{i}") for i in range(300)]],
                                  "ord int, job_key string, url_norm string, fingerprint string")
    left = {r.ord for r in history.anti_seen(batch).collect()}
    assert left == {4, 5, *range(10, 310)}
    from feedmatch.operators import dedupe as D
    maybe = history.index.possible(D.identities(batch))
    n = maybe.count()
    assert n < 60 if per_block == 24 else n > 500  # forced false positives
    new = spark.createDataFrame([("s:3", "s", "3", "moved", "moved", "t", "c", "", "f3"), ("s:900", "s", "900", "u900", "u900", "t", "c", "", None)],
                                "job_key string, source string, source_id string, url string, url_norm string, title string, company string, location string, fingerprint string")
    before = _files(tmp_path / "rows/data")
    touched = history.upsert(new, FIXTURE_NOW, notified=True)
    after = _files(tmp_path / "rows/data")
    assert {f: h for f, h in after.items() if f in before} == before and len(touched) <= 2
    again = spark.createDataFrame([(1, "z:1", "u3", None), (2, "z:2", "moved", None), (3, "z:3", None, "f3"), (4, "s:900", None, None)],
                                  "ord int, job_key string, url_norm string, fingerprint string")
    assert {r.ord for r in history.anti_seen(again).collect()} == {1}  # u3 was replaced, the others are known
    assert history.rows.count() == 401


def test_index_of_nothing(spark, tmp_path):
    index = IdentityIndex(spark, str(tmp_path), 4).create(spark.createDataFrame([], "kind string, value string, job_key string"))
    batch = spark.createDataFrame([(1, "a", "u", None)], "ord int, job_key string, url_norm string, fingerprint string")
    assert index.anti_known(batch).count() == 1
    index.change(spark.createDataFrame([("url", "u", "b")], "kind string, value string, job_key string"))
    assert index.anti_known(batch).count() == 0


def test_queue_takes_the_best_and_opens_few_segments(spark, tmp_path, many_parts):
    rnd = random.Random(5)
    schema = spark.createDataFrame([], "ord int, name string").schema
    queue = RankedQueue(spark, str(tmp_path), schema, lambda: F.struct(F.col("ord")))
    held, names = [], rnd.sample(range(10_000), 700)
    for n in range(5):
        fresh = names[n * 100:(n + 1) * 100] if n != 3 else []
        held = sorted(held + fresh)
        frame = spark.createDataFrame([(i, f"n{i}") for i in fresh], schema)
        for _ in range(2):  # run again, it gives the same
            got = [(r.ord, r.position) for r in queue.step(n, frame, 30).orderBy("position").collect()]
            assert got == [(o, k + 1) for k, o in enumerate(held[:30])]
        held = held[30:]
        assert queue.left(n) == len(held)
    segments = queue._manifest(4).filter("left > 0").count()
    opened = queue._rows(queue._manifest(4).filter("left > 0").orderBy("last").limit(2)).select("_batch", "_seg").distinct().count()
    assert segments > 10 and opened <= 2
    rest = [(r.step, r.position, r.ord) for r in queue.drain(4, 30).orderBy("step", "position").collect()]
    assert rest == [(k // 30 + 1, k % 30 + 1, o) for k, o in enumerate(held)]


def test_stream_delivers_every_fresh_row_once(spark, tmp_path):
    columns = "ord int, source string, source_id string, title string, company string, url string, location string, remote boolean"
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    known = _seen_rows(spark, [4]).withColumn("url_norm", F.lit("https://x.test/4"))
    days = [[0, 1, 2, 3, 4], [5], [6, 2], [7], []]  # 4 is in the history, 2 lands twice
    for n, day in enumerate(days[:4]):
        rows = spark.createDataFrame([(i + 100 * n, "s", str(i), f"Title {i}", f"Company {i}", f"https://x.test/{i}", "Bonn", False) for i in day], columns)
        rows.coalesce(1).write.mode("append").parquet(landing)
        queue = job.stream_fresh(landing, rows.schema, known, out, 1, FIXTURE_NOW)
    job.deliver_rest(queue, out, 1, 4)
    got = [(r.batch, r.ord, r.held) for r in spark.read.parquet(f"{out}/delivered").unionByName(spark.read.parquet(f"{out}/rest"), True).orderBy("batch").collect()]
    assert got == [(0, 0, 3), (1, 1, 3), (2, 2, 3), (3, 3, 3), (4, 105, 2), (5, 206, 1), (6, 307, 0)]
    assert {r.job_key for r in SeenHistory(spark, f"{out}/seen").rows.read().collect()} == {"s:4", "s:0", "s:1", "s:2", "s:3"}


def test_salted_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), (None, 2)], "k string, i int")
    dim = spark.createDataFrame([("hot", "H"), ("cold", "C")], "k string, v string")
    got = salted_join(big, dim, ["k"], F.coalesce(F.col("k") == "hot", F.lit(False)), salt=8)
    assert sorted(((r.k or "", r.i, r.v) for r in got.collect())) == sorted([("hot", i, "H") for i in range(300)] + [("cold", 1, "C"), ("", 2, None)])
