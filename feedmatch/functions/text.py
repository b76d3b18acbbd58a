"""Text functions as Column -> Column expressions (FN-01..FN-11, FN-17).

All of these stay on the JVM inside whole-stage codegen; none is a UDF.
"""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedmatch import dims
from feedmatch.functions import patterns as P
from feedmatch.functions.regex import any_phrase, escape, literal_first, spark_sql_literal, trie_alternation

_C = lambda c: F.col(c) if isinstance(c, str) else c


def rx(template: str) -> str:
    """Render a pattern template for Spark (java.util.regex)."""
    return P.render(template)


def contains_any(col, needles) -> Column:
    c = _C(col)
    out = None
    for n in needles:
        out = c.contains(n) if out is None else out | c.contains(n)
    return F.lit(True) if out is None else out


def matches(col, template: str | None, needles=None) -> Column:
    """Boolean search of a rendered template; False when there is no template.

    ``needles`` are substrings one of which every match contains; the cheap
    ``contains`` test runs first and the regex only where it may match
    (``And`` short-circuits).  Known templates carry their needles.
    """
    if template is None:
        return F.lit(False)
    if needles is None:
        needles = P.NEEDLES.get(template)
    regex = _C(col).rlike(rx(template))
    return regex if not needles else contains_any(col, needles) & regex


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body reads it.

    Expressions have no names for their parts: what an array function or a branch reads twice is computed twice, and what the
    function of a ``transform`` reads is computed for every element.  The element of an array of one is a name.
    """
    return F.get(F.transform(F.array(value), body), 0)


#: Named references that also stand without a semicolon; the longest that begins what follows the ampersand counts.
_LEGACY = "(" + trie_alternation(sorted(n for n in html5 if not n.endswith(";"))) + ")"
#: The reference that stands behind an ampersand; empty where none does.
_REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;|" + _LEGACY[1:-1] + ")?"
#: What numeric references to the C1 range stand for.
_C1 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)]
#: Every named reference, as one foldable literal; the frequent ones come first, since a lookup goes through it in order.
_FREQUENT = [name[1:] for name, _ in reversed(P.HTML_ENTITIES)]
_NAMED = "\x02".join(f"&{name}\x01{html5[name]}" for name in dict.fromkeys([*_FREQUENT, *html5]))


def _code_point(code: Column) -> Column:
    """The character of a code point, via its UTF-32 bytes (no Python worker).

    As in HTML: zero, surrogates and numbers beyond Unicode (NULL: too long to
    read) are U+FFFD, the C1 range is read as Windows-1252, control and
    non-characters vanish.
    """
    low = code.bitwiseAND(F.lit(0xFFFF))
    gone = (code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF)
            | (low >= 0xFFFE))
    sane = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), code)
    return (F.when(sane.isNull(), F.lit("\ufffd"))
             .when(code.between(0x80, 0x9F), F.get(F.array(*map(F.lit, _C1)), (code - 0x80).cast("int")))
             .when(gone, F.lit(""))
             .otherwise(F.decode(F.unhex(F.lpad(F.hex(F.coalesce(sane, F.lit(0xFFFD))), 8, "0")), "UTF-32")))


def _decode_entity(e: Column, named: Column) -> Column:
    digits = F.regexp_extract(e, r"^&#[xX]0*([0-9a-fA-F]{1,8});?$", 1)
    hexa = F.conv(F.nullif(digits, F.lit("")), 16, 10).try_cast("bigint")
    deci = F.regexp_extract(e, r"^&#([0-9]+);?$", 1).try_cast("bigint")
    begins = F.regexp_extract(e, "^&" + _LEGACY, 1)
    rest = F.substring(e, F.length(begins) + 2, F.length(e))
    legacy = F.when(begins != "", F.concat(F.try_element_at(named, F.concat(F.lit("&"), begins)), rest))
    return (F.when(e.startswith("&#x") | e.startswith("&#X"), _code_point(hexa))
             .when(e.startswith("&#"), _code_point(deci))
             .otherwise(F.coalesce(F.try_element_at(named, e), legacy, e)))


def unescape_html(col) -> Column:
    """FN-02 on the JVM, in one left-to-right pass like ``html.unescape``.

    The text is split at its ampersands, since no reference holds a second one;
    the reference that begins a piece is decoded (named ones from the fixed
    table, decimal/hex ones to their code point) and the pieces re-joined, so
    "&amp;lt;" correctly becomes "&lt;".  A reference without a semicolon, or
    unknown with one, is decoded by the longest legacy name that it begins
    with.  Rows without "&" skip the work.
    """
    named = F.str_to_map(F.lit(_NAMED), F.lit("\x02"), F.lit("\x01"))

    def decoded(piece: Column) -> Column:
        return bound(F.regexp_extract(piece, _REFERENCE, 0), lambda ref: F.concat(
            F.when(ref == "", F.lit("&")).otherwise(_decode_entity(F.concat(F.lit("&"), ref), named)),
            F.substring(piece, F.length(ref) + 1, F.length(piece))))

    def joined(pieces: Column) -> Column:
        return F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decoded), ""))

    return bound(F.coalesce(_C(col), F.lit("")),
                 lambda c: F.when(~c.contains("&"), c).otherwise(bound(F.split(c, "&", -1), joined)))


def strip_html(col) -> Column:
    """FN-01: tags -> space, unescape, collapse whitespace, unhug punctuation, trim."""
    c = F.regexp_replace(F.coalesce(_C(col), F.lit("")), P.TAG, " ")
    c = unescape_html(c)
    c = F.regexp_replace(c, P.WS_TO_JOIN, " ")
    c = F.regexp_replace(c, P.SPACE_BEFORE_PUNCT, "$1")
    return F.trim(c)


def strip_ws(col) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    return F.btrim(_C(col), F.lit(P.WS_CHARS))


def normalize_url(col) -> Column:
    """FN-03: trim, drop trailing '/', cut at '?', lower.  Empty -> NULL (no identity)."""
    c = F.regexp_replace(strip_ws(_C(col)), "/+$", "")
    c = F.lower(F.substring_index(c, "?", 1))
    return F.nullif(c, F.lit(""))


def fold_identity(col) -> Column:
    """FN-04: lower, non [a-z0-9] runs -> one space, trim."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_C(col), F.lit(""))), "[^a-z0-9]+", " "))


_SUFFIX_TAIL = "(?: (?:" + "|".join(dims.LEGAL_SUFFIXES) + "))+$"


def fold_company(col) -> Column:
    """FN-05: identity fold, runs of single letters rejoined, trailing legal forms dropped."""
    words = F.split(fold_identity(col), " ")
    prev = F.concat(F.array(F.lit("")), words)  # prev[i] = word before words[i] ("" first)
    glued = F.array_join(
        F.zip_with(words, prev, lambda w, pw: F.concat(
            F.when((F.length(w) == 1) & (F.length(pw) == 1), F.lit("")).otherwise(F.lit(" ")), w)),
        "")
    return F.trim(F.regexp_replace(glued, _SUFFIX_TAIL, ""))


def searchable_text(title="title", company="company", location="location",
                    description="description", tags="tags", salary="salary",
                    job_type="job_type") -> Column:
    """``Job.searchable_text``: non-empty parts joined by a space, in this order."""
    parts = [_C(title), _C(company), _C(location), _C(description),
             F.array_join(_C(tags), " "), _C(salary), _C(job_type)]
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def haystack(**cols) -> Column:
    """FN-09: lower(strip_html(searchable_text)) -- the second strip is deliberate."""
    return F.lower(strip_html(searchable_text(**cols)))


def segments(location_l, split_pattern: str = P.LOCATION_SPLIT) -> Column:
    """FN-08: split a lower-cased location, strip parts, drop empties, distinct."""
    parts = F.transform(F.split(_C(location_l), split_pattern, -1), strip_ws)
    return F.array_distinct(F.filter(parts, lambda s: s != ""))


#: More tokens than these are searched at once, without a veto by substrings.
MANY_TOKENS = 8


def phrase_in(col, token: str) -> Column:
    """FN-06: whole-phrase test of one literal token; blank never matches."""
    t = token.lower().strip()
    if not t:
        return F.lit(False)
    return contains_any(col, (t,)) & _C(col).rlike(literal_first(t))


def any_phrase_in(col, tokens) -> Column:
    clean = tuple(dict.fromkeys(t.lower().strip() for t in tokens if t.strip()))
    if not clean:
        return F.lit(False)
    firsts = "".join(sorted({escape(t[0]) for t in clean}))
    found = _C(col).rlike(f"(?=[{firsts}])" + rx(any_phrase(clean)))
    # Each ``contains`` goes through the text once more, which many tokens would do many times before the one search.
    return found if len(clean) > MANY_TOKENS else contains_any(col, clean) & found


def keyword_hits(col, keywords) -> Column:
    """FN-07: the keywords found, in configured order, case-insensitively distinct."""
    seen, items = set(), []
    for kw in keywords:
        k = kw.lower().strip()
        if not k or k in seen:
            continue
        seen.add(k)
        items.append(F.when(phrase_in(col, k), F.lit(kw)))
    if not items:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*items))


_WORD = r"[\p{L}\p{N}_]+"
_PLAIN_ENDS = re.compile(r"\w(?:.*\w)?", re.DOTALL)


def _run_of(words: Column, gaps: Column, n: int):
    """The text from a word to the n-th from there."""
    return lambda i: F.concat(F.get(words, i), *(x for k in range(1, n) for x in (F.get(gaps, i + k), F.get(words, i + k))))


def keyword_index(col, keywords) -> Column:
    """FN-07 for long lists: the same keywords as ``keyword_hits``, in one pass whatever their number.

    The text is cut into words once.  A keyword of n words is found among the runs of n words, taken with what stands
    between them, by one hashed intersection with the list; runs are formed only behind a first word of some longer
    keyword.  Keywords that begin or end with another character than a word's are searched for one by one.
    """
    c, shown = _C(col), {}
    for kw in keywords:
        shown.setdefault(kw.lower().strip(), kw)
    shown.pop("", None)
    by_size: dict[int, list[str]] = {}
    for k in shown:
        if _PLAIN_ENDS.fullmatch(k):
            by_size.setdefault(len(re.findall(r"\w+", k)), []).append(k)
    strings = lambda values: F.expr(f"array({', '.join(map(spark_sql_literal, values))})") if values else F.array().cast("array<string>")
    odd = [k for k in shown if not _PLAIN_ENDS.fullmatch(k)]
    table = F.map_from_arrays(strings(list(shown)), strings(list(shown.values())))

    def runs(words: Column, gaps: Column, n: int, keys: list[str]) -> Column:
        firsts = strings(sorted({re.match(r"\w+", k)[0] for k in keys}))
        starts = F.transform(words, lambda w, i: F.when(F.array_contains(firsts, w), i))
        at = F.filter(starts, lambda i: i.isNotNull() & (i + n <= F.size(words)))
        return F.array_intersect(strings(keys), F.transform(at, _run_of(words, gaps, n)))

    def found(c: Column, words: Column, gaps: Column) -> Column:
        hits = [F.array_intersect(strings(by_size.get(1, [])), words)]
        hits += [runs(words, gaps, n, keys) for n, keys in sorted(by_size.items()) if n > 1]
        if odd:
            hits.append(F.array_compact(F.array(*(F.when(phrase_in(c, k), F.lit(k)) for k in odd))))
        hit = F.array_intersect(strings(list(shown)), F.concat(*hits))
        return F.transform(hit, lambda k: F.try_element_at(table, k))

    # The words are bound before anything reads them by place; gaps: what stands before each word, and behind the last.
    return bound(c, lambda t: bound(F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)), lambda words: bound(
        F.split(t, _WORD, -1), lambda gaps: found(t, words, gaps))))


def sentences(col) -> Column:
    """FN-17: split on sentence punctuation, newlines and bullets."""
    return F.split(_C(col), P.SENTENCE_SPLIT, -1)


def job_key(source="source", source_id="source_id") -> Column:
    """FN-11: ``source:source_id``."""
    return F.concat(_C(source), F.lit(":"), _C(source_id))


def initcap_word(col) -> Column:
    """``str.title()`` for one word: first letter upper, rest lower."""
    c = _C(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))
