"""Entity references, instants, keyword index, ledger, quarantine, register reader and windowed health on small cases."""

import html
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from feedmatch.functions.dates import parse_instant
from feedmatch.functions.text import keyword_hits, keyword_index, unescape_html
from feedmatch.operators.ledger import DeliveryUnknown, Ledger
from feedmatch.prefs import FIXTURE_NOW, FIXTURE_PREFS, Prefs
from tests.conftest import SF_SMALL


def test_references_with_and_without_semicolon(spark):
    rnd = random.Random(1)
    bits = ["&", "amp", "lt", "not", "notin", ";", "copy", " ", "#", "x", "41", "169", "x1F", "&amp", "&notit;", "&copy 2020", "é", "=", "<", "frac12",
            "CounterClockwiseContourIntegral;", "1", "A", "&#", "&#x", "0", "&#128;"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 8))) for _ in range(10_000)] + ["&amp b", "&copy 2020", "&notit;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape_html(F.col("t")).alias("got"))
    assert [r for r in df.collect() if r.got != html.unescape(r.t)] == []


def _instant(text):
    text = text.strip()
    try:
        found = datetime.fromisoformat(text[:-1] + "+00:00" if text.endswith("Z") else text)
    except ValueError:
        return None
    return found if found.tzinfo is None else found.astimezone(timezone.utc).replace(tzinfo=None)


def test_basic_and_extended_instants(spark):
    texts = ["20240102T030405Z", "20240102T030405", "20240102T0304Z", "20240102T03", "20240102", "2024-01-02", "2024-01-02T03:04:05Z",
             "2024-01-02T03:04:05.123456+02:00", "2024-01-02T03:04:05+0200", "2024-01-02T03:04+02", "20240102T030405+0200", "20240102T030405.5Z",
             "2024-01-02 03:04", "2024-01-02T03:04:05,25Z", "1704164645", "2024", "abc", "2024-13-01", "20241301T000000Z", "2024-01-02T25:00:00Z", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_instant(F.col("t")).alias("got"))
    assert {r.t: r.got for r in df.collect()} == {t: _instant(t) for t in texts}


def test_keyword_index_equals_single_searches(spark):
    rnd = random.Random(3)
    keywords = ["the", "in the", "c++", ".net", "Node.js", "New  York", "new york", "a b c", "x", "É té", "  ", "THE", "foo-bar"]
    bits = ["the", "in", " ", "  ", "c++", ".net", "node.js", "new", "york", "a", "b", "c", "x", "é", "té", "-", "foo", "bar", ",", "_"]
    rows = [("".join(rnd.choices(bits, k=14)),) for _ in range(2000)] + [("",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(keyword_index(F.coalesce("t", F.lit("")), keywords).alias("one"),
                                                        keyword_hits(F.coalesce("t", F.lit("")), keywords).alias("each"))
    found = df.collect()
    assert all(r.one == r.each for r in found) and sum(map(len, (r.each for r in found))) > 500


def test_windows_as_settings():
    assert (FIXTURE_PREFS.us_only_chars, FIXTURE_PREFS.language_chars) == (800, 6000)
    whole = Prefs.from_dict({"remote": {"us_only_chars": None}, "candidate": {"language_chars": 0}})
    assert (whole.us_only_chars, whole.language_chars) == (None, None)
    assert Prefs.from_json('{"digest": {"max_jobs": 7}}').max_jobs == 7 and Prefs.from_json("[]") == Prefs.from_dict({})


def test_run_goes_on_where_it_stopped(spark, tmp_path):
    """Stop after each step in turn; the next call with the folder finishes, and the digest goes out once."""
    from feedmatch import job
    from feedmatch.plans.inputs import postings_fx
    from feedmatch.session import written
    postings = written(postings_fx(spark, SF_SMALL), "postings")
    seen = spark.createDataFrame([], "job_key string, source string, source_id string, url string, title string, company string, "
                                     "first_seen timestamp_ntz, last_seen timestamp_ntz, notified int")
    prefs, sent, out = FIXTURE_PREFS.with_(max_jobs=3), [], str(tmp_path / "run")
    steps = ["matched", "top", "to_classify", "digest", "rejects", "verdicts", "delivered", "seen"]

    class Stop(Exception):
        pass

    commit = Ledger.commit
    for stop in steps[:-1]:
        def stopping(self, step, *rest, stop=stop):
            commit(self, step, *rest)
            if step == stop:
                raise Stop
        Ledger.commit = stopping
        try:
            with pytest.raises(Stop):
                job.run(postings, seen, prefs, FIXTURE_NOW, "deliver", out, sink=lambda d: sent.append(d.count()), run_id="one")
        finally:
            Ledger.commit = commit
        done = {r.step for r in Ledger(spark, out, "one").rows().collect()}
        assert done - {"begun"} == set(steps[:steps.index(stop) + 1])
    last = job.run(postings, seen, prefs, FIXTURE_NOW, "deliver", out, sink=lambda d: sent.append(d.count()), run_id="one")
    assert sent == [3] and last.seen.count() == 3 and last.backlog > 0
    assert {r.job_key for r in last.seen.collect()} == {r.job_key for r in last.digest.collect()}
    with pytest.raises(ValueError):
        job.run(postings, seen, prefs, FIXTURE_NOW, "deliver", out, sink=print, run_id="two")


def test_delivery_is_never_repeated_unasked(spark, tmp_path):
    ledger, sent = Ledger(spark, str(tmp_path), "r"), []
    digest = spark.createDataFrame([(1,)], "n int")

    def refuse(_):
        raise OSError("no route")

    with pytest.raises(OSError):
        ledger.deliver(digest, refuse)
    ledger.deliver(digest, sent.append)  # it had failed, so it is made
    ledger.deliver(digest, sent.append)
    assert len(sent) == 1
    lost = Ledger(spark, str(tmp_path / "lost"), "r")
    lost.commit("begun", 1)  # a process that died in the sink
    with pytest.raises(DeliveryUnknown):
        lost.deliver(digest, sent.append)
    lost.deliver(digest, sent.append, again=True)
    assert len(sent) == 2


def test_quarantine_and_replay(spark, tmp_path):
    from feedmatch.sources import quarantine as Q
    good = '{"id": 1, "text": "Engineer", "hostedUrl": "u1", "categories": {"location": "Bonn"}}'
    bodies = [("lever", "b", 0, 200, f'{{"jobs": [{good}, {good.replace(chr(34) + "Engineer" + chr(34), "[1]")}, 7, {{"id": 2}}]}}'),
              ("lever", "b", 1, 500, f'{{"jobs": [{good}]}}'), ("remoteok", "all", 0, 200, "not json"), ("adzuna", "de", 0, 200, '{"jobs": [{}]}')]
    df = spark.createDataFrame(bodies, "source string, board string, page bigint, status int, body string")
    out, again = str(tmp_path / "a"), str(tmp_path / "b")
    Q.land(df, out)
    assert [(r.source_id, r.title, r.location) for r in Q.landed_postings(spark, out).collect()] == [("b:1", "Engineer", "Bonn")]
    broken = Q.quarantined(spark, out)
    assert [(r.source, r.board, r.page, r.pos, r.offending) for r in broken.collect()] == [("lever", "b", 0, 1, "text")]
    assert [r.pos for r in Q.quarantined(spark, out, "dropped").collect()] == [3]
    Q.replay(broken, lambda sent: F.regexp_replace(sent, r'"text":\[1\]', '"text":"Mended"'), again)
    assert [(r.title, r.ord.pos) for r in Q.landed_postings(spark, again).collect()] == [("Mended", 1)]


def test_register_reader(spark, tmp_path):
    from feedmatch.sources.payloads import read_register
    (tmp_path / "names.csv").write_text('# export\n"Acme, Inc.",x\n\nBeta "B" GmbH,y\n')
    (tmp_path / "names.txt").write_text("Acme, Inc.\n# no\n Gamma\n")
    assert [r.line for r in read_register(spark, str(tmp_path / "names.txt")).collect()] == ["Acme, Inc.", "# no", " Gamma"]
    assert {r.line for r in read_register(spark, str(tmp_path / "names.csv")).collect()} >= {"Acme, Inc.", 'Beta "B" GmbH'}
    assert read_register(spark, str(tmp_path / "none.csv")).count() == read_register(spark, None).count() == 0


def test_windowed_health_of_a_stream_equals_the_batch_form(spark, tmp_path):
    from feedmatch.streaming.ingest import land_windowed_health, windowed_health
    rnd, landing, out = random.Random(9), str(tmp_path / "landing"), str(tmp_path / "out")
    rows, mark, counted, day = [], None, [], timedelta(days=1)
    closes = lambda r: r[0].replace(hour=0) + day
    for first in (1, 4, 7, 10):
        batch = [(datetime(2024, 1, max(1, first + rnd.randint(-4, 2)), rnd.randint(0, 23)), rnd.choice("ab"), rnd.choice([200, 200, 500]), 3,
                  rnd.randint(1, 3)) for _ in range(60)]
        df = spark.createDataFrame(batch, "ts timestamp_ntz, source string, status int, n_records int, n_mapped int")
        df.coalesce(1).write.mode("append").parquet(landing)
        windows = land_windowed_health(spark, landing, df.schema, "ts", out)
        counted += [r for r in batch if mark is None or closes(r) > mark]
        rows += batch
        mark = max(r[0] for r in rows) - 2 * day
    closed = [r for r in counted if closes(r) <= mark]
    want = windowed_health(spark.createDataFrame(closed, df.schema), "ts")
    assert sorted(map(tuple, windows.collect())) == sorted(map(tuple, want.collect())) and len(counted) < len(rows) and len(closed) < len(counted)
