import itertools
import re

import pytest
from feedmatch.llm import ann, chat, htmltext, toxicity, urls, warc
from feedmatch.llm.scratch import scratch_path
from pyspark.sql import functions as F


def _cheapest(roles):
    """Least cost over every choice of options."""
    best = {chat.START: 0}
    for role in roles:
        following = {}
        for state, cost in best.items():
            for extra, to, *_ in chat.options(state, role):
                following[to] = min(following.get(to, 10**9), cost + extra)
        best = following
    return min(cost + chat.FINAL[state] for state, cost in best.items())


def test_repair_is_cheapest_and_slices_agree():
    for roles in itertools.product(range(4), repeat=4):
        chosen, state = chat.repair(list(roles))
        assert sum(o[0] for o in chosen) + chat.FINAL[state] == _cheapest(roles)
        head, tail = list(roles[:2]), list(roles[2:])
        to_come = (chat.slice_matrix(tail) + chat.FINAL).min(axis=1).tolist()
        first, middle = chat.repair(head, chat.START, to_come)
        second, last = chat.repair(tail, middle)
        assert (first + second, last) == (chosen, state)


def test_chat_table(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(300)] + [(2, 0, "tool", None), (2, 1, "user", "x"), (2, 1, "user", "x"), (None, None, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df).collect()
    assert len(got) == len(rows)
    whole = "".join(r["piece"] for r in got if r["conv_id"] == 1)
    assert whole == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, _, r, t in rows[:300])
    assert chat.format_conversations(df.where("false")).count() == 0


def test_warc_chunks_round_trip(spark):
    rows = [(1, "http://a\r\nX: y", "é" * 50), (2, None, "é" * 50), (3, "u", None), (4, "u", ""), (5, "u", "x" * 64), (None, "u", "é" * 50), (2, None, "é" * 50)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, payload string")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(df, path, chunk_bytes=7)
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.read_archive(spark, path).collect())
    assert got == [(0, 100, "response", 0), (1, 100, "revisit", 2), (2, 100, "response", 0), (2, 100, "response", 0), (3, 0, "revisit", 4), (4, 0, "response", 0), (5, 64, "response", 0)]


def test_url_rules_edge_cases(spark):
    found = [(1, "HTTP://X.Net/a"), (2, None), (3, "no scheme"), (4, "http://net"), (5, "http://notnet/"), (6, "s://a.b.net/en/x?q"), (1, "HTTP://X.Net/a")]
    df = spark.createDataFrame(found, "page_id long, url string")
    got = sorted((r["page_id"], r["host"], r["rule"] or "", r["verdict"]) for r in urls.judge(df, [("net", "/", "block"), ("b.net", "/en/", "allow")]).collect())
    assert got == [(1, "x.net", "net/", "block"), (1, "x.net", "net/", "block"), (2, "", "", "allow"), (3, "", "", "allow"), (4, "net", "", "allow"),
                   (5, "notnet", "", "allow"), (6, "a.b.net", "b.net/en/", "allow")]
    assert urls.judge(df.where("false"), [("net", "/", "block")]).count() == 0
    assert {r["verdict"] for r in urls.judge(df, [], "block").collect()} == {"block"}


@pytest.mark.parametrize("max_bits", [urls.MAX_BITS, 5000])  # one cascade each, and shards
def test_many_url_rules_are_exact(spark, max_bits):
    import random
    rnd = random.Random(6)
    hosts, paths = [f"h{i}.example.{t}" for i in range(800) for t in ("com", "net")], ["/", "/a", "/a/b/", "/long/path/of/a/rule", ""]
    rules = {(rnd.choice(["", "www.", "x.y."]) + h, p): rnd.choice(["block", "allow"]) for h in rnd.sample(hosts, 900) for p in rnd.sample(paths, 2)}
    pages = [(i, "http://" + rnd.choice(["", "www.", "x.y.", "z."]) + rnd.choice(hosts) + rnd.choice([*paths, "/a/bc", "/zzz", "?q"])) for i in range(3000)]
    pages += [(5000, "http:///a/b/"), (5001, None), (5002, "http://h1.example.com:80/a")]

    def verdict(url):
        host, path = ("", "") if url is None or "://" not in url else re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        labels = host.split(".")
        fits = [(len(h + p), h + p, v) for n in range(len(labels)) for p in paths for h in [".".join(labels[n:])] if path.startswith(p) and (v := rules.get((h, p)))]
        return max(fits)[1:] if fits else (None, "allow")

    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, [(*k, v) for k, v in rules.items()], max_bits=max_bits).collect()}
    assert got == {i: verdict(u) for i, u in pages}


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<nav>m</nav><article><h1>T&eacute;</h1><p>a<br>b</article><footer>f", "Té\na b"), ("<script>x</script><p>only", "only"),
    ("<article>a<div class='comments'>c</div><p>b</article>", "a\nb")])
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_nearest_small_tables_are_exact(spark):
    rows = [(i, [float(i % 5), 1.0, -float(i)]) for i in range(12)] + [(40, [0.0, 0.0, 0.0]), (60, None), (20, [1.0, float("nan"), 2.0]), (None, [1.0, 1.0, 1.0]), (3, [3.0, 1.0, -3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 5).orderBy("rank").collect()
    vectors = {i: v for i, v in rows[:12]}
    want = sorted(((-sum(a * b for a, b in zip(vectors[0], v, strict=True)), i) for i, v in vectors.items() if i))[:5]
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0


def test_toxicity_learns_words_and_keeps_rows(spark):
    rows = [(i, ("vile words here " if i % 4 == 0 else "kind words here ") + f"w{i}", "s") for i in range(80)] + [(None, None, None), (0, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1, 60)], "doc_id long, toxic int")
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted((d is None, d or 0, t) for d, t, _ in rows if not (t or "").startswith("vile"))
    assert toxicity.clean(docs, labels.where("false")).count() == len(rows)
    assert toxicity.clean(docs.where("false"), labels).count() == 0


LONG = " ".join(["Long words of the main text of this page, enough of them to count."] * 5)


def test_article_tags_do_not_replace_the_distribution():
    page = f"<div><p>{LONG}</p><p>{LONG}</p></div><article><h2>Teaser</h2></article><article class='comment'>{LONG}</article>"
    assert htmltext.main_text(page) == f"{LONG}\n{LONG}"
    assert htmltext.main_text(f"<article><p>Yes.</p><p>No.</p><p>Oh.</p><p>{LONG}</p></article>") == f"Yes.\nNo.\nOh.\n{LONG}"


@pytest.mark.parametrize("page,text", [
    (f"<div class='with-sidebar'><p>{LONG}</p></div>", LONG), (f"<form><div><p>{LONG}</p></div></form>", LONG), (f"<form><article><p>{LONG}</p></article></form>", LONG),
    (f"<div class='widget'><p>{LONG}</p></div><div class='widget'><p>More.</p></div><footer>{LONG}</footer>", f"{LONG}\nMore."),
    (f"<article><div class='article-header'><h1>Title</h1></div><p>{LONG}</p><section id='related-work'><p>work</p></section></article>", f"Title\n{LONG}\nwork"),
    (f"<p>{LONG} {LONG}</p><section class='comments'><article>{LONG}</article></section>", f"{LONG} {LONG}")])
def test_names_do_not_drop_main_text(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize("page,text", [
    (f"<p>{LONG}</p><div class='ad'>buy</div><p>Short closing words.</p>", f"{LONG}\nShort closing words."),
    (f"<p>{LONG}</p><div class='ad'>buy</div><p>Short.</p><aside>b</aside><p>{LONG}</p>", f"{LONG}\nShort.\n{LONG}"),
    (f"<div>Logo</div><nav>menu</nav><h1>T</h1><div class='share'>s</div><p>{LONG}</p><nav>x</nav><p>End.</p>", f"T\n{LONG}\nEnd.")])
def test_removed_regions_do_not_break_the_text(page, text):
    assert htmltext.main_text(page) == text


def test_nearest_widens_buckets_that_hold_too_few(spark):
    import warnings

    import numpy as np
    rnd = np.random.default_rng(5)
    rows = [(0, [-1.0] + [0.0] * 38)] + [(i, [1.0, *(1e-4 * rnd.normal(size=38)).tolist()]) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        got = ann.nearest(df, F.col("vec_id") == 0, 20).collect()
    assert len(got) == 20 and len({r["vec_id"] for r in got}) == 20


@pytest.mark.parametrize("page,text", [
    (f"<h1>T</h1><p>by A</p><p>3 May</p><p>Intro.</p><p>{LONG}</p>", f"T\nby A\n3 May\nIntro.\n{LONG}"),
    (f"<p>Logo</p><nav>x</nav><h1>T</h1><p>by A</p><p>3 May</p><p>Intro.</p><p>{LONG}</p>", f"T\nby A\n3 May\nIntro.\n{LONG}"),
    (f"<p>{LONG}</p><ul>" + "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(5)) + f"</ul><p>{LONG}</p>",
     "\n".join([LONG, *(f"Link {i}" for i in range(5)), LONG])),
    (f"<article><p>{LONG}</p></article><article><p>Short one.</p></article><div class='col-sidebar'><p>{LONG}</p></div>", f"{LONG}\nShort one."),
    (f"<article><p>{LONG}</p></article><div class='gdpr-notice'><p>We use cookies.</p></div>", LONG),
    ("<p>" + "word " * 200_000 + "</p><nav>unclosed", ("word " * 200_000).strip())])
def test_text_beside_the_surge_is_kept(page, text):
    assert htmltext.main_text(page) == text


def test_extraction_query_equals_the_pages_articles(spark):
    """The pages of the small table hold their text in one <article>: strip its markup plainly and compare."""
    import html
    import re

    from conftest import SF_SMALL
    from feedmatch.llm.queries import op9_line_blocks

    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op9_line_blocks(spark, SF_SMALL).collect()}
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "html").collect()
    exact = 0
    for page_id, source in pages:
        body = re.search(r"<article[^>]*>(.*)</article>", source, re.S)[1]
        body = re.sub(r"<!--.*?-->|<(script|style|form|aside|nav)\b.*?</\1>", "", body, flags=re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|div|h\d|li|ul|ol|tr|td|th|table|blockquote|pre|section|figure|figcaption)\b[^>]*>", body)]
        exact += got[page_id] == ((text := "\n".join(filter(None, blocks))), len(text))
    assert len(got) == len(pages) and exact >= 0.9 * len(pages)
