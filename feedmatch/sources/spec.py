"""Source specifications and their compiled readers (EXT-01, EXT-02, SRC-12, SRC-13, SRC-18).

A ``SourceSpec`` says where a source keeps each thing: the envelope keys of its
payloads, the paths of every field with their fallbacks, which fields a record
must have, which must be text and which objects, and what an HTTP error does.
A set of specs compiles to one typed extraction per field: the paths are a
literal table by source, and the path that a record is read at is looked up in
it, so the plan has one reader per field however many sources there are.
Readers are SQL text, which the driver parses at once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from feedmatch.functions import patterns as P
from feedmatch.functions.regex import spark_sql_literal as lit

#: What a field is read as: the first non-empty text, all non-empty texts, a list of texts, the names of objects,
#: the number at the first path that is there, a flag, or an instant's text and number.
TEXTS = ("source_id", "title", "url", "company", "location", "plain", "html", "salary_text", "low_text", "high_text", "currency", "period",
         "job_text", "workplace", "category", "level_text")
ALL_TEXTS, LISTS, NAMES = ("tag_texts",), ("tag_list", "area", "job_list"), ("tag_names", "region_names", "level_names")
NUMBERS, FLAGS, INSTANTS = ("low", "high"), ("remote_flag", "visa_flag"), ("at", "at_else")
FIELDS = TEXTS + ALL_TEXTS + LISTS + NAMES + NUMBERS + FLAGS + INSTANTS
REQUIRED = ("source_id", "title", "url")


@dataclass(frozen=True)
class SourceSpec:
    """One source. ``paths`` maps a field to its path or paths, the first non-empty one of which counts."""

    name: str
    paths: dict[str, str | tuple[str, ...]]
    envelope: tuple[str, ...] = ("jobs",)
    required: tuple[str, ...] = REQUIRED
    objects: tuple[str, ...] = ()  # fields of a record that are objects where they are there
    failure: str = "feed"  # what an HTTP error fails: the "board", or the whole "feed"
    quiet: bool = False  # in compat mode an error is an empty page
    board_ids: bool = False  # ids are unique within a board only
    extra: dict[str, str] = field(default_factory=dict)  # SQL over the fields, by name

    def __post_init__(self) -> None:
        unknown = set(self.paths) - set(FIELDS)
        if unknown or self.failure not in ("board", "feed"):
            raise ValueError(f"{self.name}: unknown {', '.join(sorted(unknown)) or self.failure}")

    def of(self, name: str) -> tuple[str, ...]:
        paths = self.paths.get(name, ())
        return (paths,) if isinstance(paths, str) else paths

    @property
    def texts(self) -> tuple[str, ...]:
        """Paths that must hold text or numbers: the first of each required field."""
        return tuple(self.of(f)[0] for f in self.required)


def _by_source(values: dict[str, Iterable[str]]) -> str:
    """The row's own list of paths, from a literal table."""
    table = ", ".join(f"{lit(name)}, array({', '.join(lit('$.' + p) for p in paths)})" for name, paths in values.items() if paths)
    return f"try_element_at(map({table}), source)" if table else "cast(null as array<string>)"


def _read(path: str, kind: str) -> str:
    return f"try_variant_get(record, {path}, '{kind}')"


def _value(path: str, body: str) -> str:
    """``body`` over ``v``, what stands at a path: the path is parsed and followed once, however often the body reads ``v``."""
    return f"get(transform(array({_read(path, 'variant')}), v -> {body}), 0)"


def _as(kind: str) -> str:
    return f"try_variant_get(v, '$', '{kind}')"


_KIND = "schema_of_variant(v)"


def strip(text: str) -> str:
    return f"btrim({text}, {lit(P.WS_CHARS)})"


def _text(p: str) -> str:
    """A field as trimmed text, numbers rendered; '' when absent or a list or an object."""
    return _value(p, strip(f"coalesce(CASE WHEN {_KIND} NOT RLIKE '^(?:ARRAY|OBJECT)' THEN {_as('string')} END, '')"))


def _number(p: str) -> str:
    """A number; booleans and strings are none."""
    return _value(p, f"CASE WHEN {_KIND} RLIKE '^(?:BIGINT$|DOUBLE$|INT$|SMALLINT$|TINYINT$|FLOAT$|DECIMAL)' THEN {_as('double')} END")


def _flag(p: str) -> str:
    """FN-12: null and '' are unknown; a boolean as it is; true, 1, yes and remote; else whether it is not zero."""
    text = f"lower({strip(f'coalesce({_as("string")}, {chr(39) * 2})')})"
    return _value(p, f"CASE WHEN v IS NULL OR {_KIND} = 'VOID' THEN NULL WHEN {_KIND} = 'BOOLEAN' THEN {_as('boolean')} "
                     f"WHEN {_KIND} = 'STRING' THEN CASE WHEN {text} = '' THEN NULL ELSE {text} IN ('true', '1', 'yes', 'remote') END "
                     f"ELSE coalesce({_as('double')} <> 0, true) END")


def _names(p: str) -> str:
    """FN-14: strings, or the names of objects, trimmed; others dropped."""
    one = strip("coalesce(CASE WHEN schema_of_variant(x) = 'STRING' THEN try_variant_get(x, '$', 'string') END, try_variant_get(x, '$.name', 'string'), '')")
    return f"filter(transform({_read(p, 'array<variant>')}, x -> {one}), x -> x <> '')"


def _first(paths: str, each: str) -> str:
    return f"get(transform({paths}, p -> {each}), 0)"


def readers(specs: Iterable[SourceSpec]) -> str:
    """SQL of an array of one struct with every field of ``FIELDS`` (instants as text and number), read from ``record`` by
    ``source``.  The record is bound, since a column of a row is copied whole wherever it is read."""
    specs = list(specs)
    out = []
    for name in FIELDS:
        paths = _by_source({s.name: s.of(name) for s in specs})
        none = "cast(array() as array<string>)"
        if name in TEXTS:
            out.append((name, f"coalesce(get(filter(transform({paths}, p -> {_text('p')}), x -> x <> ''), 0), '')"))
        elif name in ALL_TEXTS:
            out.append((name, f"coalesce(filter(transform({paths}, p -> {_text('p')}), x -> x <> ''), {none})"))
        elif name in LISTS:
            out.append((name, f"coalesce({_first(paths, f'filter({_read("p", "array<string>")}, x -> x IS NOT NULL)')}, {none})"))
        elif name in NAMES:
            out.append((name, f"coalesce({_first(paths, _names('p'))}, {none})"))
        elif name in NUMBERS:
            there = f"filter({paths}, p -> {_read('p', 'variant')} IS NOT NULL)"
            out.append((name, _first(there, _number("p"))))
        elif name in FLAGS:
            out.append((name, _first(paths, _flag("p"))))
        else:
            out += [(f"{name}_text", _first(paths, _read("p", "string"))), (f"{name}_number", _first(paths, _number("p")))]
    return "transform(array(record), record -> named_struct(" + ", ".join(f"'{n}', {sql}" for n, sql in out) + "))"


def offending(specs: Iterable[SourceSpec]) -> str:
    """SRC-13: SQL of the first path of a record whose type broke (a required text that is a list or an object, or an object that
    is neither that nor null); NULL when none did."""
    specs = list(specs)
    texts, objects = _by_source({s.name: s.texts for s in specs}), _by_source({s.name: s.objects for s in specs})
    kind = f"coalesce(schema_of_variant({_read('p', 'variant')}), 'VOID')"
    found = (f"substr(coalesce(get(filter({texts}, p -> {kind} RLIKE '^(?:ARRAY|OBJECT)'), 0), "
             f"get(filter({objects}, p -> {kind} NOT RLIKE '^(?:OBJECT|VOID$)'), 0)), 3)")
    return f"get(transform(array(record), record -> {found}), 0)"


def envelope(specs: Iterable[SourceSpec], body: str) -> str:
    """SRC-01: SQL of a payload's list of records: itself if it is a list, else the first of its source's keys that holds one."""
    keys = _by_source({s.name: s.envelope for s in specs})
    held = f"filter(transform({keys}, p -> try_variant_get(v, p, 'array<variant>')), x -> x IS NOT NULL)"
    return f"get(transform(array(try_parse_json({body})), v -> coalesce(try_variant_get(v, '$', 'array<variant>'), get({held}, 0))), 0)"
