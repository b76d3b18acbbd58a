"""Golden rows for the text functions and classifiers."""

import pytest
from pyspark.sql import functions as F

from feedmatch.functions.text import fold_company, normalize_url, strip_html, unescape_html
from feedmatch.operators import matching as M


def _eval(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r.y for r in df.select(fn(F.col("x")).alias("y")).collect()]


STRIP = [(None, ""), ("", ""), ("no markup at all", "no markup at all"), ("<div>We <em>bake</em> bread</div>", "We bake bread"),
         ("<h2>Tasks</h2><ol><li>Mix</li><li>Knead</li></ol>", "Tasks Mix Knead"),
         ("first\r\n\t second\u00a0third", "first second third"), ("Flour &amp; Water", "Flour & Water"),
         ("<i>Pay</i>: <u>high</u>, <b>fair</b>?", "Pay: high, fair?")]


def test_strip_html(spark):
    assert _eval(spark, [r for r, _ in STRIP], strip_html) == [e for _, e in STRIP]


def test_unescape_matches_python(spark):
    import html
    cases = ["a &amp;lt; b", "&#39;x&#x27; &#X41;", "&middot;&copy;&quot;", "&unknown; & plain", "&#128512;"]
    assert _eval(spark, cases, unescape_html) == [html.unescape(c) for c in cases]


URLS = [("HTTP://Bakery.test/Work/77/", "http://bakery.test/work/77"),
        ("https://bakery.test/work?id=3&ref=mail", "https://bakery.test/work"),
        ("\thttps://bakery.test/a \n", "https://bakery.test/a")]


def test_normalize_url(spark):
    assert _eval(spark, [r for r, _ in URLS], normalize_url) == [e for _, e in URLS]
    assert _eval(spark, [None], normalize_url) == [None]  # no identity


LEVELS = [("SENIOR baker (nights)", "senior"), ("Sr. Miller", "senior"), ("Staff Data Engineer II", "staff"),
          ("Principal Miller", "principal"), ("Oven Architect", "principal"), ("Lead Miller", "lead"),
          ("VP Flour", "executive"), ("Head of Ovens", "executive"), ("CTO at Bakery", "executive"),
          ("Junior/Trainee Miller", "junior"), ("Baking Intern", "intern"), ("Werkstudent Backstube", "intern"),
          ("Medior Miller", "mid"), ("Miller", "unknown"), ("Internal Tools Miller", "unknown"),
          ("Seniority Researcher", "unknown"), ("", "unknown"), (None, "unknown"),
          ("Miller Engineer II", "mid"), ("Oven Engineer III", "senior")]


def test_seniority(spark):
    assert _eval(spark, [t for t, _ in LEVELS], M.seniority) == [lvl for _, lvl in LEVELS]


RESTRICTED = ["Sadly we do not offer visa sponsorship to bakers.", "There is no visa sponsorship with this oven job.",
              "The bakery is unable to sponsor visas.", "Our mill cannot provide sponsorship to anyone.",
              "Bakers must already have the right to work in Austria.", "For this mill: EU citizens only."]
NOT_RESTRICTED = ["", "The bakery pays for visa sponsorship.", "Moving costs and flat are on us.",
                  "We sponsor visas for every miller.", "Ovens, flour and a garden in Graz."]


def test_hard_restriction(spark):
    fn = lambda c: M.hard_restriction(F.lower(c))
    assert all(_eval(spark, RESTRICTED, fn))
    assert not any(_eval(spark, NOT_RESTRICTED, fn))


@pytest.mark.parametrize("a,b", [("Brot & Co GmbH", "BROT & CO"), ("Molen B.V.", "molen"), ("Mill BV", "Mill"),
                                 ("Ovens N.V.", "ovens"), ("Flour Holding Group", "flour")])
def test_company_fold_pairs(spark, a, b):
    x, y = _eval(spark, [a, b], fold_company)
    assert x == y


def test_distinct_companies_stay_distinct(spark):
    x, y = _eval(spark, ["Molen BV", "Oven BV"], fold_company)
    assert x != y


def test_move_offer_negation(spark):
    cases = {"we sponsor visas for you.": True, "we cannot support visas.": False,
             "relocation package included.": True, "there is no relocation package.": False,
             "no visa help here. later: we offer visa sponsorship.": True, "nothing here": False}
    assert _eval(spark, list(cases), M.offers_move) == list(cases.values())


def _times(spark, fn, part):
    """How often ``part`` stands in the optimised plan of a function of one text."""
    df = spark.createDataFrame([("x",)], "x string").select(fn(F.col("x")).alias("y"))
    return df._jdf.queryExecution().optimizedPlan().toString().count(part)


def test_keyword_index_cuts_a_text_into_words_once(spark):
    from feedmatch.functions.text import keyword_index
    words = ("in the", "the", "of the mill", "c++")
    assert _times(spark, lambda c: keyword_index(c, words), "regexp_extract_all(") == 1
    text = "in the the of the mill, in  the c++ " * 2000
    assert _eval(spark, [text, "", None], lambda c: F.array_join(keyword_index(F.coalesce(c, F.lit("")), words), "|")) == \
        ["in the|the|of the mill|c++", "", ""]


def test_html_is_unescaped_from_one_text(spark):
    assert _times(spark, strip_html, "<[^>]+>") == 1
    assert _times(spark, M.offers_move, "regexp_extract_all(") == 1


@pytest.mark.parametrize("text", ["&&amp;&amp &ampx; &notit; &#x41 &#65;&# &", "&lt;b&gt;&nbsp;x &eacute;&Eacute;&euro;", "a&b=1&copy=2"])
def test_pieces_behind_ampersands(spark, text):
    import html
    assert _eval(spark, [text], unescape_html) == [html.unescape(text)]


def test_white_space_is_joined_and_stripped_as_before(spark):
    import re
    from feedmatch.functions import patterns as P
    from feedmatch.functions.text import strip_ws
    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = ["", " ", "  ", "a b", " a ", "a  b", "\xe9 \xe9", " \u0435 \u4e2d ", "a \n", "\u200ba\u200b ", *(f"{w}a{w}b {w}c{w} \xe9{w}" for w in spaces)]
    run = lambda c: F.regexp_replace(c, P.WS_TO_JOIN, " ")
    assert _eval(spark, texts, run) == [re.sub(f"[{spaces}]+", " ", t) for t in texts]
    assert _eval(spark, texts, strip_ws) == [t.strip(spaces) for t in texts]
    # the class of first characters only passes over what begins no word of a pattern
    assert all(" " not in first and first == first.lower() for first in P.FIRST.values())


def test_rejected_postings_cost_no_text(spark):
    """reasons and matches are those of the full annotation; the rules of the text leave decided rows alone."""
    from feedmatch.prefs import FIXTURE_NOW, FIXTURE_PREFS, STRICT_PREFS
    rows = [(i, "s", str(i), title, "Acme", f"u{i}", place, text, ["x"], remote, posted, None, None, None, None)
            for i, (title, place, text, remote, posted) in enumerate(
                (title, place, text, remote, posted)
                for title in ("Senior Engineer", "Consultant", "Intern", None) for place in ("Berlin", "Lima", "Remote", None)
                for text in ("python, visa sponsorship", "unpaid python", "java", None) for remote in (True, None)
                for posted in ("1999-12-01 00:00:00", "1990-01-01 00:00:00", None))]
    df = spark.createDataFrame(rows, "ord int, source string, source_id string, title string, company string, url string, location string, "
                               "description string, tags array<string>, remote boolean, posted string, salary string, job_type string, "
                               "visa_sponsorship boolean, extra struct<eligible_regions:array<string>>").withColumn(
                                   "posted_at", F.col("posted").cast("timestamp_ntz"))
    for prefs in (FIXTURE_PREFS, STRICT_PREFS):
        full = {r.ord: r for r in M.match(df, prefs, FIXTURE_NOW).collect()}
        lazy = {r.ord: r for r in M.match(df, prefs, FIXTURE_NOW, rejected_flags=False).collect()}
        opened = {r.ord: r for r in M.match(M.may_match(df, prefs, FIXTURE_NOW), prefs, FIXTURE_NOW, rejected_flags=False).collect()}
        assert {k: (r.reject_reason, r.reloc_reason) for k, r in full.items()} == {k: (r.reject_reason, r.reloc_reason) for k, r in lazy.items()}
        matched = {k: r for k, r in full.items() if r.reject_reason is None}
        assert matched or prefs is STRICT_PREFS
        assert matched == {k: r for k, r in lazy.items() if r.reject_reason is None} == {k: r for k, r in opened.items() if r.reject_reason is None}
        assert all(r.haystack is None for r in lazy.values() if r.reject_reason == "too_old")
        assert all(r.restricted is None for r in lazy.values() if r.reject_reason == "no_keyword")
        assert not {r.reject_reason for r in opened.values()} & {"too_old", "rejected_title", "rejected_seniority"}


def test_places_and_languages_reject_before_the_rest_of_the_text(spark):
    """a place that no text can mend is rejected unread; sponsorship is not asked of what its language or a clearance rejects."""
    from feedmatch.prefs import FIXTURE_NOW, FIXTURE_PREFS
    german = "python und der die das wir sie mit ist nicht eine oder bei"
    places = ("Berlin", "Lima, Peru", "Remote", "Remote - Peru", "", None, "USA only", "UK only", "Malta", "Worldwide", " / Cork", "India (Remote)", "USA", "DE")
    texts = ("python, visa sponsorship", "remote python, no visa sponsorship", "python, usa only, remote", german, "python. fluent dutch is required.",
             "python. a security clearance is required.", None)
    rows = [(i, "s", str(i), "Senior Engineer", "Acme", f"u{i}", place, text, [], remote, None, None, None, None)
            for i, (place, text, remote) in enumerate((p, t, r) for p in places for t in texts for r in (True, False, None))]
    df = spark.createDataFrame(rows, "ord int, source string, source_id string, title string, company string, url string, location string, "
                               "description string, tags array<string>, remote boolean, salary string, job_type string, "
                               "visa_sponsorship boolean, extra struct<eligible_regions:array<string>>").withColumn(
                                   "posted_at", F.lit(None).cast("timestamp_ntz"))
    at_home = FIXTURE_PREFS.with_(candidate_based_in="")
    for prefs in (FIXTURE_PREFS, at_home, FIXTURE_PREFS.with_(accept_onsite=False, accept_hybrid=False, remote_accept_locations=()),
                  FIXTURE_PREFS.with_(accept_remote=False), FIXTURE_PREFS.with_(countries=("USA",), cities=()), FIXTURE_PREFS.with_(visa_require=True)):
        full = {r.ord: r for r in M.match(df, prefs, FIXTURE_NOW).collect()}
        lazy = {r.ord: r for r in M.match(df, prefs, FIXTURE_NOW, rejected_flags=False).collect()}
        kept = M.may_match(df, prefs, FIXTURE_NOW)
        opened = {r.ord: r for r in M.match(kept, prefs, FIXTURE_NOW, rejected_flags=False).collect()}
        assert {k: (r.reject_reason, r.reloc_reason) for k, r in full.items()} == {k: (r.reject_reason, r.reloc_reason) for k, r in lazy.items()}
        matched = {k: r for k, r in full.items() if r.reject_reason is None}
        assert matched and matched == {k: r for k, r in lazy.items() if r.reject_reason is None} == {k: r for k, r in opened.items() if r.reject_reason is None}
        if prefs is FIXTURE_PREFS:
            assert not {r.location for r in kept.collect()} & {"Lima, Peru", "Remote - Peru", "USA only", "UK only", "Malta", " / Cork"}
            early = [r for r in lazy.values() if (r.reloc_reason or "").startswith(("posting written in", "requires ", "citizenship"))]
            assert len({r.reloc_reason for r in early}) == 3 and all(r.restricted is None and r.offers_move is None for r in early)
            assert all(full[r.ord].restricted is not None for r in early)


def test_a_phrase_is_searched_by_its_letters(spark):
    """patterns begin with the phrase, or with the letters that one can begin with, not with a guard that is tried everywhere."""
    from feedmatch.functions.regex import any_phrase, literal_first, phrase
    from feedmatch.functions.text import any_phrase_in, phrase_in, rx
    tokens = ["visa", "blue card", "c++", ".net", "a-b", "é", "aa", "𝒜b", "x_", "^", "[a]"]
    texts = [f"{a}{t}{b}" for t in tokens for a in ("", " ", "x", "_", "é", "1", "𝒜", "-", "a", "aa") for b in ("", " ", "s", "_", "é", "2", "𝒜", ".", "a")]
    texts += ["", None, "visavisa visa", "aaa aa", "visa" * 3, "x " * 50]
    for t in tokens:
        assert not literal_first(t).startswith("(")
        assert _eval(spark, texts, lambda c: phrase_in(c, t)) == _eval(spark, texts, lambda c: c.rlike(rx(phrase(t))))
    for some in (tokens[:3], tokens, ["-", "]", "^", "&&"]):
        assert _eval(spark, texts, lambda c: any_phrase_in(c, some)) == _eval(spark, texts, lambda c: c.rlike(rx(any_phrase(some))))
    assert _times(spark, lambda c: any_phrase_in(c, [f"word{i}" for i in range(20)]), "Contains(") == 0


def test_residency_is_searched_once(spark):
    from feedmatch.prefs import FIXTURE_PREFS
    assert _times(spark, lambda c: M.residency_elsewhere(c, FIXTURE_PREFS), "regexp_extract_all(") == 1
    texts = ["must be based in ireland", "must be based in india", "open to candidates in peru", "spain residents only", "must be located in a timezone", ""]
    assert _eval(spark, texts, lambda c: M.residency_elsewhere(c, FIXTURE_PREFS)) == [True, False, True, True, False, False]


def test_a_field_of_a_record_is_read_once():
    """the path of a field is parsed and followed once, and the record is bound."""
    from feedmatch.sources import spec as K
    from feedmatch.sources.mapping import SPECS
    assert all(read("p").count("record") == 1 for read in (K._text, K._number, K._flag))
    assert K.readers(SPECS).startswith("transform(array(record), record -> ")
