"""Regex templates for the classifiers (render with :func:`regex.render`).

FIXED VALUES. These phrasings decide which postings are kept; they must equal
the behaviour being reproduced and are stated plainly here, one family per
constant.  ``{B0}``/``{B1}`` are word-boundary guards and ``{W}`` a word
character (see ``regex.py``); ``{GAP60}`` is "a word end, at most 60
characters without a full stop, then a word start".  Text handed to these
patterns is already lower case.
"""

from __future__ import annotations

from feedmatch.functions.regex import DUCKDB, SPARK, render as _render

# Python's Unicode whitespace, spelled out so Java and RE2 agree with it.
WS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}]")

# The same with most characters, which lie in one range, told by one test.
_WS = r"[\x{00}-\x{20}\x{85}-\x{A0}\x{1680}-\x{3000}&&" + WS + "]"

#: White space to be joined to one space.  A single space is joined already, so that few matches are replaced.
WS_TO_JOIN = _WS + "(?:" + _WS + "+|(?<! ))"

#: The characters of WS, as ``btrim`` takes them: it reads the ends of a text only, where a pattern tries every place.
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                             0x202F, 0x205F, 0x3000)))

_GAP60 = {
    SPARK: r"{B1}[^.]{0,60}{B0}",
    DUCKDB: r"[^\p{L}\p{N}_.](?:[^.]{0,58}[^\p{L}\p{N}_.])?",
}


def render(template: str, engine: str = SPARK) -> str:
    rendered = _render(template.replace("{GAP60}", _GAP60[engine]), engine)
    # Most characters begin no match: one test of a small class stands before the word guard (RE2 needs none).
    first = FIRST.get(template) if engine == SPARK else None
    return f"(?=[{first}])" + rendered if first else rendered


# --- fixed values: seniority, most senior first (first hit wins) -------------
SENIORITY: tuple[tuple[str, str], ...] = (
    ("executive", r"{B0}(?:chief|cto|cio|vp|vice president|head of|director){B1}"),
    ("lead", r"{B0}(?:lead|leader|team lead|tech lead|technical lead|manager){B1}"),
    ("principal", r"{B0}(?:principal|distinguished|fellow|architect){B1}"),
    ("staff", r"{B0}(?:staff|senior staff){B1}"),
    ("senior", r"{B0}(?:senior|snr|sr|iii|iv|expert|experienced){B1}"),
    ("intern", r"{B0}(?:intern|internship|working student|werkstudent|stagiair|stage){B1}"),
    ("junior", r"{B0}(?:junior|jr|graduate|grad|trainee|apprentice|entry[\s-]?level|i){B1}"),
    ("mid", r"{B0}(?:mid|medior|intermediate|ii){B1}"),
)

# --- fixed values: work mode hints -------------------------------------------
REMOTE_HINT = r"{B0}(?:remote|work from home|wfh|distributed team){B1}"
HYBRID_HINT = r"{B0}hybrid{B1}"
US_ONLY = (r"{B0}(?:usa?\s*only|united states\s*only|u\.s\.?\s*only|north america(?:n)?\s*only|"
           r"canada\s*only|(?:must|only)\s+be\s+(?:located\s+)?in\s+the\s+(?:usa|us|united states)|"
           r"authorized to work in the (?:usa|us|united states)){B1}")

# --- fixed values: sponsorship refused or presupposed (hard restriction) -----
_SP = r"(?:visa\s+|work\s+)?sponsor(?:ship|ing|s)?"
HARD_RESTRICTION = "{B0}(?:" + "|".join((
    r"no\s+" + _SP + r"{B1}",
    r"(?:do(?:es)?\s+not|don'?t|will\s+not|won'?t)\s+(?:be\s+able\s+to\s+)?"
    r"(?:provide|offer|support|consider)?\s*" + _SP,
    r"(?:un(?:able)?|not\s+able)\s+to\s+(?:provide|offer|support)?\s*" + _SP,
    r"can(?:no|'?)t\s+(?:provide|offer|support)?\s*" + _SP,
    r"" + _SP + r"\s+is\s+not\s+(?:available|offered|provided|possible){B1}",
    r"without\s+(?:the\s+need\s+for\s+)?" + _SP + r"{B1}",
    r"not\s+(?:currently\s+)?(?:be\s+)?(?:able\s+to\s+)?" + _SP,
    r"must\s+(?:already\s+)?(?:have|hold|possess){GAP60}"
    r"(?:right\s+to\s+work|work\s+authori[sz]ation|work\s+permit){B1}",
    r"(?:existing|current|valid)\s+(?:right\s+to\s+work|work\s+authori[sz]ation){B1}",
    r"(?:eu|eea)(?:/eea)?\s+(?:citizens?|nationals?|passport\s+holders?)\s+only{B1}",
    r"must\s+be\s+(?:legally\s+)?(?:authori[sz]ed|eligible|entitled)\s+to\s+work{GAP60}without{B1}",
)) + ")"

# --- fixed values: a move offered in so many words, and its negation ---------
MOVE_OFFER = "{B0}(?:" + "|".join((
    r"(?:sponsor|sponsors|sponsoring|support|supports)\s+(?:your\s+|work\s+)?visas?{B1}",
    r"visa\s+(?:sponsorship|support|assistance|help){B1}",
    r"relocation\s+(?:package|support|assistance|bonus|allowance|budget|help){B1}",
    r"(?:help|support|assist)\s+(?:you\s+)?(?:with\s+)?(?:your\s+)?relocat{W}*",
    r"(?:eu\s+)?blue\s+card{B1}",
    r"kennismigrant{B1}",
    r"highly\s+skilled\s+migrant{B1}",
)) + ")"
NEGATION = r"{B0}(?:no|not|never|cannot|unable|without){B1}|n't{B1}|n’t{B1}"
NEGATION_LOOKBACK = 30

# --- fixed values: relocation rules ------------------------------------------
SENTENCE_SPLIT = r"[.;!?\n•·]+"
REQUIRED_WORDS = (r"{B0}(?:fluent|fluency|fluently|native|mother tongue|required|requirement|must|"
                  r"mandatory|essential|c1|c2|business[- ]level|business fluent|professional working|"
                  r"proficien{W}*|excellent|verhandlungssicher|fließend|fliessend|vloeiend){B1}")
SOFT_WORDS = (r"{B0}(?:plus|nice to have|nice-to-have|advantage|advantageous|bonus|beneficial|"
              r"preferred|preferably|ideally|not required|not necessary|no need|not needed|optional|"
              r"learn|learning|lessons|courses?|help you|support you|asset|helpful|welcome){B1}")
WORD = r"[a-zà-ÿäöüß]+"
CLEARANCE = "{B0}(?:" + "|".join((
    r"(?:security|sc|dv|nato|government|top secret|secret)\s+clearance{B1}",
    r"clearance\s+(?:is\s+)?required{B1}",
    r"citizenship\s+(?:is\s+)?required{B1}",
    r"must\s+(?:be|hold)\s+(?:an?\s+)?(?:[a-z]+\s+){0,2}(?:citizen|citizenship|national){B1}",
    r"(?:citizens?|nationals?)\s+only{B1}",
)) + ")"
LOCAL_ONLY = "{B0}(?:" + "|".join((
    r"no\s+relocation{B1}",
    r"relocation\s+(?:is\s+)?(?:not|cannot\s+be)\s+(?:offered|provided|available|supported|"
    r"possible|covered){B1}",
    r"(?:unable|not\s+able)\s+to\s+(?:offer|provide|support)\s+relocation{B1}",
    r"local\s+(?:candidates|applicants|residents)\s+only{B1}",
    r"only\s+(?:consider|accept|considering|accepting)\s+(?:local|eu[- ]based|in[- ]country)\s+"
    r"(?:candidates|applicants){B1}",
    r"must\s+(?:already\s+|currently\s+)?(?:be\s+)?(?:based|located|living|residing|reside|live|"
    r"resident)\s+in{B1}",
    r"(?:must|need\s+to|should)\s+(?:already\s+)?(?:live|reside)\s+(?:in|within){B1}",
)) + ")"
RELOCATION_OFFER = r"{B0}(?:relocat|visa{B1}|sponsor)"
NO_RELOCATION = r"{B0}(?:no\s+relocation|relocation\s+(?:is\s+)?not){B1}"
RESIDENCY = "{B0}(?:" + "|".join((
    r"(?:must|need\s+to|needs\s+to|should|required\s+to)\s+(?:already\s+|currently\s+)?(?:be\s+)?"
    r"(?:based|located|living|residing|reside|live|resident)\s+(?:in|within)\s+(?:the\s+)?"
    r"([a-z][a-z .&/-]{1,40})",
    r"open\s+(?:only\s+)?to\s+(?:candidates|applicants|residents|people)\s+"
    r"(?:based\s+|located\s+|living\s+)?(?:in|from)\s+(?:the\s+)?([a-z][a-z .&/-]{1,40})",
    r"([a-z][a-z ]{1,25})\s+(?:residents|based\s+candidates)\s+only{B1}",
)) + ")"
NOT_A_PLACE = r"^(?:a|an|one|your|their|our){B1}"

# --- fixed values: text clean-up ----------------------------------------------
TAG = r"<[^>]+>"
SPACE_BEFORE_PUNCT = r" ([,.;:!?%)\]])"
LOCATION_SPLIT = r"[,/|()\-–—]"
PLACES_SPLIT = r"[,/|()\-–—;]"
REGION_SPLIT = r"[,/;|&]"

# Named HTML entities decoded on the JVM, "&amp;" last so "&amp;lt;" stays "&lt;".
HTML_ENTITIES: tuple[tuple[str, str], ...] = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "),
    ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&hellip;", "…"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&bull;", "•"), ("&euro;", "€"), ("&pound;", "£"), ("&eacute;", "é"),
    ("&amp;", "&"),
)

# --- fixed values: necessary substrings -------------------------------------
# Every match of the pattern contains at least one of these (lower case), so a
# cheap ``contains`` test may veto the regex without changing any result.
NEEDLES: dict[str, tuple[str, ...]] = {
    REMOTE_HINT: ("remote", "work from home", "wfh", "distributed team"),
    HYBRID_HINT: ("hybrid",),
    HARD_RESTRICTION: ("sponsor", "work", "citizen", "national", "passport"),
    MOVE_OFFER: ("visa", "relocat", "card", "migrant"),
    CLEARANCE: ("clearance", "citizen", "national"),
    LOCAL_ONLY: ("relocation", "local", "only", "based", "locat", "liv", "resid"),
    RESIDENCY: ("based", "locat", "liv", "resid", "open"),
}

# --- fixed values: the characters that a match can begin with ----------------
FIRST: dict[str, str] = {
    HARD_RESTRICTION: "ndwucvsme",
    MOVE_OFFER: "svrhaebk",
    REMOTE_HINT: "rwd",
    HYBRID_HINT: "h",
    US_ONLY: "uncmoa",
    CLEARANCE: "sdngtcm",
    LOCAL_ONLY: "nruloms",
    REQUIRED_WORDS: "fnmrecbpv",
    RELOCATION_OFFER: "rvs",
    NO_RELOCATION: "nr",
}
