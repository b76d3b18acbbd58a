"""Regex templates shared by the Spark library and the DuckDB oracle.

Patterns are written once with three placeholders and rendered per engine:

* ``{B0}`` -- start of a word (nothing word-like before this point),
* ``{B1}`` -- end of a word (nothing word-like after this point),
* ``{W}``  -- one word character.

A word character is a letter, a digit or ``_`` in any script, i.e. Python's
Unicode ``\\w``.  Spark runs on ``java.util.regex``, which supports
look-around, so the guards there are zero-width and exact.  DuckDB runs RE2,
which has none, so the oracle rendering uses consuming guards; the two agree
for every boolean test and differ only when two matches touch each other.
"""

from __future__ import annotations

_WORD_CLASS = r"\p{L}\p{N}_"

SPARK = "spark"
DUCKDB = "duckdb"

_GUARDS = {
    SPARK: {
        "B0": rf"(?<![{_WORD_CLASS}])",
        "B1": rf"(?![{_WORD_CLASS}])",
        "W": rf"[{_WORD_CLASS}]",
    },
    DUCKDB: {
        "B0": rf"(?:^|[^{_WORD_CLASS}])",
        "B1": rf"(?:[^{_WORD_CLASS}]|$)",
        "W": rf"[{_WORD_CLASS}]",
    },
}

_SPECIAL = set(r".^$*+?()[]{}|\/-")


def escape(text: str) -> str:
    """Escape regex metacharacters in a form both Java and RE2 accept."""
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in text)


def render(template: str, engine: str = SPARK) -> str:
    """Fill the guard placeholders of a template for one engine."""
    out = template
    for name, value in _GUARDS[engine].items():
        out = out.replace("{" + name + "}", value)
    return out


def phrase(token: str) -> str:
    """Template for a whole-phrase match of a literal token (FN-06)."""
    return "{B0}" + escape(token.lower().strip()) + "{B1}"


def literal_first(token: str) -> str:
    """The Spark pattern of ``phrase`` with the word guard behind the token: a pattern that begins with a literal is searched for
    by its letters (Boyer-Moore), one that begins with a guard is tried at every place."""
    t = escape(token.lower().strip())
    return f"{t}(?<![{_WORD_CLASS}]{t}){_GUARDS[SPARK]['B1']}"


def trie_alternation(words) -> str:
    """One regex matching exactly the given literal words, shaped as a prefix trie.

    ``a|an|and`` becomes ``an?(?:d)?``-like nesting, so a backtracking engine
    dispatches on one character per level instead of trying every word at
    every position.  The set of strings matched is the same as the flat
    alternation.
    """
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        end = "" in node
        branches = [escape(ch) + emit(child) for ch, child in sorted(node.items()) if ch != ""]
        if not branches:
            return ""
        if len(branches) == 1:
            return f"(?:{branches[0]})?" if end else branches[0]
        group = "(?:" + "|".join(branches) + ")"
        return group + "?" if end else group

    return "(?:" + emit(root) + ")"


def any_phrase(tokens) -> str | None:
    """Template matching any of the tokens as a whole phrase; None if no tokens."""
    clean = []
    for t in tokens:
        k = t.lower().strip()
        if k and k not in clean:
            clean.append(k)
    if not clean:
        return None
    return "{B0}" + trie_alternation(clean) + "{B1}"


def sql_literal(text: str) -> str:
    """Quote a string as an SQL literal (both engines use '' doubling).

    Spark SQL additionally treats backslash as an escape inside literals, so
    Spark-bound SQL should pass patterns through :func:`spark_sql_literal`.
    """
    return "'" + text.replace("'", "''") + "'"


def spark_sql_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
