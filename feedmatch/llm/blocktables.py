"""Conversation structure repair by Four-Russians block tables.

A conversation is a word over nine symbols: a turn that must go (blank or
duplicate), or a turn by the initial of its role (s, u, a, other) and whether
it is truncated. The legal role sequences are ``(s?(ua)+)?``. For a position
and a state of their automaton, the cost to come is the least cost of the edits
from there on: keep 0, rerole 1, delete 2, insert an empty turn 5, and 5 more
for a truncated turn that stays. Less its least entry, the vector of these
costs over the four states takes few values, all found by walking back from the
end. For every such vector and every block of ``BLOCK`` symbols a table holds
the vector before the block and what it adds.

A conversation is then read from its end, a block per lookup. For the edits,
each block is expanded backward from the vector behind it to the vectors
between its symbols, and traced forward: among the edits that reach the least
cost the ASCII-least initial (D, I, K, R) is taken first, so ties fall to the
least string.

A conversation may be longer than a task's share: turns are range-partitioned
in order. A slice's effect on each of the vectors is found by the same lookups,
so the driver (two small rows per partition) chains vectors from the last slice
to the first and states from the first to the last, and each slice is traced on
its own with the result of the whole. A duplicate is found by the first turn of
its (conversation, role, text), aggregated before the slices are made.

Defined results: a null role or text is one space; rows with a null conv_id are
one conversation; a null turn comes first, rows of equal turn follow role, then
text; a role counts by its initial, and an empty role has none; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmatch.llm.scratch import ensure_checkpoint_dir

BLOCK = 4
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what the last turn kept was
NEXT = (USER, USER, ASSISTANT, USER)  # the turn that user or assistant may follow with
FINAL = (0, 2 * INSERT, INSERT, 0)  # cost to come behind the last turn
CLOSING = ("", "II", "I", "")
SYMBOLS = 9
_CLASS = {"s": 0, "u": 1, "a": 2}
_ROLE = {USER: "user", ASSISTANT: "assistant"}


def symbol(role: str, gone: bool, truncated: bool) -> int:
    return 0 if gone else 1 + 2 * _CLASS.get(role[:1], 3) + truncated


def _direct(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a turn without an insertion before it, by initial."""
    out = [("D", DELETE, state)]
    if sym:
        role, cut = divmod(sym - 1, 2)
        to = NEXT[state]
        if (role == 0 and state == START) or (role == 1 and to == USER) or (role == 2 and to == ASSISTANT):
            out.append(("K", TRUNCATED * cut, SYSTEM if role == 0 else to))
        out.append(("R", REROLE + TRUNCATED * cut, to))
    return out


def _before(sym: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to come before a turn, from those behind it."""
    plain = [min(cost + after[to] for _, cost, to in _direct(sym, s)) for s in range(4)]
    once = [min(plain[s], INSERT + plain[NEXT[s]]) for s in range(4)]
    return tuple(min(plain[s], INSERT + once[NEXT[s]]) for s in range(4))


def _edits(sym: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The least string of edits of a turn (insertions before it included) among the cheapest, and the state behind."""
    letters, before = "", _before(sym, after)
    while True:
        options = [(e, cost + after[to], to) for e, cost, to in _direct(sym, state)] + [("I", INSERT + before[NEXT[state]], None)]
        edit, _, to = min(o for o in options if o[1] == before[state])
        letters += edit
        if edit != "I":
            return letters, to
        state = NEXT[state]


class Tables:
    """All normalised vectors, their transitions by symbol and by block, and the edits chosen before each."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        vectors, number = [FINAL], {FINAL: 0}
        step: list[list[int]] = []
        add: list[list[int]] = []
        for v in vectors:  # grows while it is walked
            step.append([])
            add.append([])
            for sym in range(SYMBOLS):
                raw = _before(sym, v)
                low = min(raw)
                new = tuple(c - low for c in raw)
                if new not in number:
                    number[new] = len(vectors)
                    vectors.append(new)
                step[-1].append(number[new])
                add[-1].append(low)
        self.vectors = np.array(vectors, np.int64)
        self.step, self.add = np.array(step, np.int32), np.array(add, np.int64)
        self.edits = [[[_edits(sym, s, v) for s in range(4)] for sym in range(SYMBOLS)] for v in vectors]
        # block code: its first symbol is the highest digit; the last symbol is applied first
        to, plus = np.arange(len(vectors), dtype=np.int32)[:, None], np.zeros((len(vectors), 1), np.int64)
        for _ in range(block):
            plus = np.concatenate([plus + self.add[to, sym] for sym in range(SYMBOLS)], axis=1)
            to = np.concatenate([self.step[to, sym] for sym in range(SYMBOLS)], axis=1)
        self.block_step, self.block_add = to, plus

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Block codes of the whole blocks at the front."""
        whole = len(symbols) // self.block * self.block
        return symbols[:whole].reshape(-1, self.block).astype(np.int64) @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))

    def effect(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind the symbols: the vector before them and what they add."""
        at, plus = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        codes = self.codes(symbols)
        for sym in symbols[len(codes) * self.block:][::-1].tolist():
            plus, at = plus + self.add[at, sym], self.step[at, sym]
        for code in codes[::-1].tolist():
            plus, at = plus + self.block_add[at, code], self.block_step[at, code]
        return at, plus

    def trace(self, symbols: np.ndarray, state: int = START, behind: int = 0) -> tuple[list[str], int]:
        """Edits of each turn, insertions before it included, and the state behind the last."""
        codes = self.codes(symbols)
        tail = symbols[len(codes) * self.block:].tolist()
        after_tail = self._expand(tail, behind)
        ends, v = [], after_tail[0]
        for code in codes[::-1].tolist():
            ends.append(v)
            v = int(self.block_step[v, code])
        out: list[str] = []
        for k in range(len(codes)):
            own = symbols[k * self.block:(k + 1) * self.block].tolist()
            state = self._follow(own, self._expand(own, ends[-1 - k]), state, out)
        return out, self._follow(tail, after_tail, state, out)

    def _expand(self, symbols: list[int], behind: int) -> list[int]:
        """The vector before each symbol, then the one behind the last."""
        vectors = [behind]
        for sym in reversed(symbols):
            vectors.append(int(self.step[vectors[-1], sym]))
        return vectors[::-1]

    def _follow(self, symbols: list[int], vectors: list[int], state: int, out: list[str]) -> int:
        for sym, after in zip(symbols, vectors[1:], strict=True):
            letters, state = self.edits[after][sym][state]
            out.append(letters)
        return state


@cache
def tables(block: int = BLOCK) -> Tables:
    """The worker's tables, built once from the rules."""
    return Tables(block)


EDIT_SCHEMA = ("conv_id long, part int, place long, turn long, edits string, role string, text string, fault string, illegal boolean, "
               "cost long, lines string, whole boolean")
_EDIT = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("turn", pa.int64()), ("edits", pa.string()),
                   ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("illegal", pa.bool_()), ("cost", pa.int64()),
                   ("lines", pa.string()), ("whole", pa.bool_())])
_COST = {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_LEGAL = {"su", "ua", "au"}


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int | None, list[tuple]]]:
    """Runs of equal conv_id in a slice."""
    name, held, begun = None, [], False
    for batch in batches:
        for conv, *rest in zip(batch.column("conv_id").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if begun and conv != name:
                yield name, held
                held = []
            name, begun = conv, True
            held.append(tuple(rest))
    if begun:
        yield name, held


def _faults(rows: list[tuple], last: tuple | None) -> list[str]:
    """The first fault of each row (role, key, fault of the text alone, at_first); ``last``: (turn, key) before the run."""
    out = []
    for turn, _, key, own, at_first in rows:
        again = not at_first or (turn, key) == last  # equal rows of one turn stand next to each other
        out.append("blank" if own == "blank" else "duplicate" if again else own)
        last = (turn, key)
    return out


def _symbols(rows: list[tuple], faults: list[str]) -> np.ndarray:
    return np.array([symbol(r[1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)], np.uint8)


_NARROW = ("turn", "role", "key", "own", "at_first")


def repair(turns: DataFrame) -> DataFrame:
    """The edits of every turn in order of (conv_id, part, place): edits (insertions before a turn, then its own; the closing
    insertions of a conversation stand behind its last turn's), role (after the edit), text, fault, illegal (with the turn
    before), cost, lines (the repaired ``role:text`` lines that the edits leave, null for none) and whole (the conversation
    lies in one slice, where its rows follow each other)."""
    ensure_checkpoint_dir(turns.sparkSession)
    space = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    bare = F.rtrim(F.translate("text", _SPACE[1:], " " * 5))
    rows = (rows.withColumn("key", F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256))
            .withColumn("own", F.when(bare == "", "blank").when(bare.rlike(r"[.!?]\z"), "").otherwise("truncated")))
    known = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    first = rows.groupBy("conv_id", "key").agg(F.min(known).alias("first"))
    # the many rows of a hot key meet one row: AQE splits them
    joined = rows.alias("r").join(first.alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.key") == F.col("f.key")))
    marked = joined.select("r.*", F.col("r.turn").eqNullSafe(F.col("first.turn")).alias("at_first"))
    order = ("conv_id", "turn", "role", "text")
    # The slices must stay the same in every pass, also after an executor is lost.
    near = ("conv_id", "turn", "role", F.substring("text", 1, 64), "key")  # what the sample brings to the driver stays short
    slices = marked.repartitionByRange(*near).sortWithinPartitions(*order).checkpoint()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for conv, held in _runs(batches, _NARROW):
            last = (conv, held)
            first = first or last
        if first:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": first[0], "last": last[0], "only": first is last,
                                               "turn": last[1][-1][0], "key": last[1][-1][2], "initial": last[1][-1][1][:1]}],
                                             schema=pa.schema([("part", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("only", pa.bool_()),
                                                               ("turn", pa.int64()), ("key", pa.string()), ("initial", pa.string())]))

    narrow = slices.select("conv_id", *_NARROW)
    end_schema = "part int, first long, last long, only boolean, turn long, key string, initial string"
    found = {r["part"]: r for r in narrow.mapInArrow(ends, end_schema).collect()}  # one short row per partition
    parts = sorted(found)
    pairs = list(zip(parts, parts[1:], strict=False))
    goes_on = {a: found[a]["last"] == found[b]["first"] for a, b in pairs}
    comes_in = {b: found[a] for a, b in pairs if goes_on[a]}

    def last_key(part: int) -> tuple | None:
        return (comes_in[part]["turn"], comes_in[part]["key"]) if part in comes_in else None

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), True
        if part not in comes_in:
            return
        for _, held in _runs(batches, _NARROW):
            if first:
                at, _ = tables().effect(_symbols(held, _faults(held, last_key(part))))
                yield pa.RecordBatch.from_pylist([{"part": part, "before": at.tolist()}], schema=pa.schema([("part", pa.int32()), ("before", pa.list_(pa.int32()))]))
            first = False

    behind = dict.fromkeys(parts, 0)  # number of the vector behind each partition's last conversation
    entered = dict.fromkeys(parts, START)
    if comes_in:
        before = {r["part"]: r["before"] for r in narrow.mapInArrow(effects, "part int, before array<int>").collect()}
        for a, b in reversed(pairs):
            if goes_on[a]:
                behind[a] = before[b][behind[b] if found[b]["only"] else 0]

        def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, last, count = TaskContext.get().partitionId(), None, 0
            if not goes_on.get(part):
                return
            for _, held in _runs(batches, _NARROW):
                last, count = held, count + 1
            symbols = _symbols(last, _faults(last, last_key(part) if count == 1 else None))
            yield pa.RecordBatch.from_pylist([{"part": part, "exits": [tables().trace(symbols, s, behind[part])[1] for s in range(4)]}],
                                             schema=pa.schema([("part", pa.int32()), ("exits", pa.list_(pa.int32()))]))

        exit_of = {r["part"]: r["exits"] for r in narrow.mapInArrow(exits, "part int, exits array<int>").collect()}
        for a, b in pairs:
            if goes_on[a]:
                entered[b] = exit_of[a][entered[a] if found[a]["only"] else START]

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, first = TaskContext.get().partitionId(), 0, True
        runs = _runs(batches, (*_NARROW, "text"))
        run = next(runs, None)
        columns: list[list] = [[] for _ in _EDIT]
        while run is not None:
            (conv, held), run = run, next(runs, None)
            into, beyond = first and part in comes_in, run is None and goes_on.get(part, False)
            narrow_rows = [r[:5] for r in held]
            faults = _faults(narrow_rows, last_key(part) if into else None)
            state = entered[part] if into else START
            edits, end = tables().trace(_symbols(narrow_rows, faults), state, behind[part] if beyond else 0)
            initial = comes_in[part]["initial"] if into else None
            for i, (row, fault, own) in enumerate(zip(held, faults, edits, strict=True)):
                turn, role, text = row[0], row[1], row[5]
                closing = CLOSING[end] if i + 1 == len(held) and not beyond else ""
                lines, new_role = [], None
                for e in own:
                    if e == "D":
                        continue
                    state = SYSTEM if e == "K" and role[:1] == "s" else NEXT[state]
                    new_role = role if e == "K" else _ROLE[state]
                    lines.append(f"{new_role}:{'' if e == 'I' else text}")
                if own[-1] == "D":
                    new_role = None
                for _ in closing:
                    state = NEXT[state]
                    lines.append(f"{_ROLE[state]}:")
                cost = sum(_COST[e] for e in own + closing) + TRUNCATED * (fault == "truncated" and own[-1] != "D")
                values = (conv, part, place, turn, own + closing, new_role, text, fault or None,
                          initial is not None and initial + role[:1] not in _LEGAL, cost, "\n".join(lines) if lines else None, not (into or beyond))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
                initial, place = role[:1], place + 1
            if len(columns[0]) >= 4096 or run is None:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDIT, strict=True)], schema=_EDIT)
                columns = [[] for _ in _EDIT]
            first = False

    return slices.mapInArrow(trace, EDIT_SCHEMA)


DIGEST_SCHEMA = ("conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
                 "whole boolean, part int, place long, lines string")
_DIGEST = pa.schema([("conv_id", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                     ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("whole", pa.bool_()), ("part", pa.int32()),
                     ("place", pa.int64()), ("lines", pa.string())])


class _Digest:
    """Counts, audit and running hash of one conversation; no text is kept."""

    def __init__(self) -> None:
        self.counts, self.audit, self.sha, self.lines = [0, 0, 0, 0, 0], [], hashlib.sha256(), 0

    def add(self, counts: tuple[int, ...], edits: str, lines: str | None) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.audit.append(edits)
        if lines is not None:
            self.sha.update((("\n" if self.lines else "") + lines).encode())
            self.lines += 1


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the conversations that have turns.

    Conversations within a slice are digested where they are. The rows of the few that cross slices (at most one for each
    boundary) are brought in order and streamed; a hash over one text has one order, so one task runs through each of them,
    keeping its counts, hash and edits only."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _digested(batches, True)

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _digested(batches, False)

    first = edits.select(*_USED).mapInArrow(local, DIGEST_SCHEMA)
    first = first.checkpoint()
    rest = first.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    out = first.where("whole").unionByName(rest.mapInArrow(crossing, DIGEST_SCHEMA))
    return out.drop("whole", "part", "place", "lines")


_USED = ("conv_id", "part", "place", "edits", "fault", "illegal", "cost", "lines", "whole")


def _digested(batches: Iterator[pa.RecordBatch], rows_of_turns: bool) -> Iterator[pa.RecordBatch]:
    name, held = None, None
    out: list[tuple] = []

    def table() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[] for _ in _DIGEST]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DIGEST, strict=True)], schema=_DIGEST)

    def close() -> None:
        if held is not None:
            out.append((name, *held.counts, "".join(held.audit), held.sha.hexdigest(), True, None, None, None))

    for batch in batches:
        for r in batch.to_pylist():
            if rows_of_turns:
                counts = (r["fault"] == "blank", r["fault"] == "duplicate", r["fault"] == "truncated", r["illegal"], r["cost"])
                if not r["whole"]:
                    out.append((r["conv_id"], *map(int, counts), r["edits"], None, False, r["part"], r["place"], r["lines"]))
                    continue
                edits = r["edits"]
            else:
                counts, edits = (r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"]), r["audit"]
            if held is None or r["conv_id"] != name:
                close()
                name, held = r["conv_id"], _Digest()
            held.add(counts, edits, r["lines"])
        if len(out) >= 1024:
            yield table()
            out.clear()
    close()
    yield table()


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with ``dropped``: every twentieth by crc32 of ``conv_id:turn`` (null: one space) dropped, emptied, without end marks,
    repeated, or made the user's, by the remainder."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.when(fate == 4, "user").otherwise(role).alias("role"),
                        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), fate.alias("fate"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("fate") == 0).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")


def audit(turns: DataFrame) -> DataFrame:
    """The digest of every conversation of ``turns`` after damage, those without rows left included."""
    rows = damaged(turns)
    kept = F.when(~F.col("dropped"), F.col("turn"))
    spans = rows.groupBy("conv_id").agg(F.min(kept).alias("low"), F.max(kept).alias("high"), F.count_distinct(kept).alias("n"))
    gaps = spans.select("conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).alias("gaps"))
    found = digests(repair(rows.where("NOT dropped"))).withColumnRenamed("conv_id", "found_id")
    out = gaps.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "gaps", *(F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
