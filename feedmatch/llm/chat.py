"""Chat formatting with minimum-cost role repair.

The legal turns are those of an automaton: an optional system turn first, then
user and assistant in turn, an assistant last. Each given turn may be kept,
relabelled, merged into the turn before it (if that has its role) and preceded
by empty turns; a dynamic program over the automaton's states picks the
cheapest repair of the whole conversation. Among equally cheap repairs the
earliest turn's first option wins, in the order of ``options``.

A conversation may be longer than a task's share: turns are range-partitioned
in order, and for conversations that cross a boundary each slice first gives
its min-plus cost matrix over the states. From those the driver (two small
matrices per partition) works out the cost still to come behind each slice,
then the state in which each slice is entered, so slices are repaired on their
own with the result of the whole.

Output is a row per given turn with its piece of the rendered text; pieces of a
conversation joined in order are the rendered conversation. Texts are rendered
as they are.

Defined results: unknown and null roles are relabelled; null texts are empty;
a null turn comes first, rows of equal turn follow the hash of role and text;
rows with a null conv_id are one conversation; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmatch.llm.scratch import ensure_checkpoint_dir

RELABEL, MERGE, INSERT = 3, 1, 2
ROLES = ("system", "user", "assistant")
START = 3  # states: the role of the turn before, or START
AFTER = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
SCHEMA = "conv_id long, turn long, role string, new_role string, action string, inserted array<string>, closing array<string>, piece string"
_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()),
                    ("inserted", pa.list_(pa.string())), ("closing", pa.list_(pa.string())), ("piece", pa.string())])


@cache
def _to(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns that make ``role`` legal after ``state``; None if it can't be."""
    paths: list[tuple[int, ...]] = [()]
    for path in paths:
        last = path[-1] if path else state
        if role in AFTER[last]:
            return path
        if len(path) < 3:
            paths += [(*path, r) for r in AFTER[last] if r]
    return None


@cache
def options(state: int, role: int) -> tuple[tuple[int, int, str, tuple[int, ...]], ...]:
    """(cost, next state, action, inserted roles) of a turn with a role (3: unknown) after a state."""
    out = []
    for target in sorted(range(3), key=lambda r: r != role):
        relabel = 0 if target == role else RELABEL
        name = "keep" if target == role else "relabel"
        path = _to(state, target)
        if path is not None:
            out.append((relabel + INSERT * len(path), target, name, path))
        if state == target:
            out.append((relabel + MERGE, target, "merge" if target == role else "relabel+merge", ()))
    return tuple(out)


#: Cost of the empty turns after the last given one, by state.
CLOSING = {START: (), 0: (1, 2), 1: (2,), 2: ()}
FINAL = [float(INSERT * len(CLOSING[s])) for s in range(4)]


def role_index(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES else 3


@cache
def _step(role: int) -> np.ndarray:
    """Min-plus matrix of one turn."""
    out = np.full((4, 4), np.inf)
    for s in range(4):
        for cost, to, *_ in options(s, role):
            out[s, to] = min(out[s, to], cost)
    return out


def slice_matrix(roles: list[int]) -> np.ndarray:
    """Least cost from each state before a slice to each state behind it."""
    out = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for role in roles:
        out = (out[:, :, None] + _step(role)[None, :, :]).min(axis=1)
    return out


def repair(roles: list[int], state: int = START, to_come: list[float] = FINAL) -> tuple[list[tuple[int, int, str, tuple[int, ...]]], int]:
    """The chosen option of each turn and the state behind them, where ``to_come`` is the cost still to come by state."""
    ahead = [list(to_come)]
    for role in reversed(roles):
        last = ahead[-1]
        ahead.append([min(cost + last[to] for cost, to, *_ in options(s, role)) for s in range(4)])
    chosen = []
    for i, role in enumerate(roles):
        after = ahead[len(roles) - 1 - i]
        chosen.append(min(options(state, role), key=lambda o: o[0] + after[o[1]]))
        state = chosen[-1][1]
    return chosen, state


def _piece(option, text: str | None, first: bool, last: bool, state: int) -> str:
    _, target, action, inserted = option
    out = "\n" if action.endswith("merge") else "" if first else "<|im_end|>\n"
    if not action.endswith("merge"):
        out += "".join(f"<|im_start|>{ROLES[r]}\n<|im_end|>\n" for r in inserted) + f"<|im_start|>{ROLES[target]}\n"
    out += text or ""
    if last:
        out += "<|im_end|>\n" + "".join(f"<|im_start|>{ROLES[r]}\n<|im_end|>\n" for r in CLOSING[state])
    return out


def _conversations(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int | None, list[tuple]]]:
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


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, new_role, action, inserted, closing, piece."""
    ensure_checkpoint_dir(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text",
                        F.xxhash64("role", "text").alias("tie"))
    order = ("conv_id", "turn", "tie")
    # The slices must stay the same in every pass, also after an executor is lost.
    slices = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").checkpoint()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for conv, held in _conversations(batches, ("role",)):
            last = (conv, [role_index(r) for r, in held])
            first = first or last
        if first:
            both = [("first", *first), ("last", *last)]
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "side": side, "conv_id": conv, "only": first is last,
                                               "matrix": slice_matrix(roles).ravel().tolist()} for side, conv, roles in both],
                                             schema=pa.schema([("part", pa.int32()), ("side", pa.string()), ("conv_id", pa.int64()), ("only", pa.bool_()),
                                                               ("matrix", pa.list_(pa.float64()))]))

    found = {(r["part"], r["side"]): r for r in slices.mapInArrow(ends, "part int, side string, conv_id long, only boolean, matrix array<double>").collect()}
    parts = sorted({p for p, _ in found})  # two rows per partition
    goes_on = {a: found[a, "last"]["conv_id"] == found[b, "first"]["conv_id"] for a, b in zip(parts, parts[1:], strict=False)}
    comes_in = {b: goes_on[a] for a, b in zip(parts, parts[1:], strict=False)}
    to_come = {p: list(FINAL) for p in parts}  # behind each partition's last conversation
    for a, b in reversed(list(zip(parts, parts[1:], strict=False))):
        if goes_on[a]:
            after = np.array(to_come[b] if found[b, "first"]["only"] else FINAL)
            to_come[a] = (np.array(found[b, "first"]["matrix"]).reshape(4, 4) + after[None, :]).min(axis=1).tolist()

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        if not goes_on.get(part):
            return
        for _, held in _conversations(batches, ("role",)):
            last = [role_index(r) for r, in held]
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "exits": [repair(last, s, to_come[part])[1] for s in range(4)]}],
                                             schema=pa.schema([("part", pa.int32()), ("exits", pa.list_(pa.int32()))]))

    entered = dict.fromkeys(parts, START)
    if any(goes_on.values()):
        exit_of = {r["part"]: r["exits"] for r in slices.select("conv_id", "role").mapInArrow(exits, "part int, exits array<int>").collect()}
        for a, b in zip(parts, parts[1:], strict=False):
            if goes_on[a]:
                entered[b] = exit_of[a][entered[a] if found[a, "last"]["only"] else START]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        runs = _conversations(batches, ("turn", "role", "text"))
        held = next(runs, None)
        first = True
        while held is not None:
            following = next(runs, None)
            conv, given = held
            into, beyond = first and comes_in.get(part, False), following is None and goes_on.get(part, False)
            chosen, state = repair([role_index(r) for _, r, _ in given], entered[part] if into else START, to_come[part] if beyond else FINAL)
            columns: list[list] = [[] for _ in _ARROW]
            for i, (option, (turn, role, text)) in enumerate(zip(chosen, given, strict=True)):
                last = i + 1 == len(given) and not beyond
                closing = [ROLES[r] for r in CLOSING[state]] if last else []
                values = (conv, turn, role, ROLES[option[1]], option[2], [ROLES[r] for r in option[3]], closing,
                          _piece(option, text, i == 0 and not into, last, state))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
            first, held = False, following

    return slices.mapInArrow(render, SCHEMA)
