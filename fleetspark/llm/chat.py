"""Chat formatting by minimum-cost role repair.

The legal-turn automaton: an optional system turn, then user and assistant in turn, and
an assistant at the end. Each turn is kept, relabelled, or merged into the turn before
it, and empty turns may be inserted; the cheapest legal sequence wins. What a turn does
to the costs of the four states (start, system, user, assistant) depends only on its
role, so a run of turns is a 4 x 4 min-plus matrix and runs combine by matrix products.

Conversations are cut into runs of turn numbers (crowded runs further, by turn and by
hash), each run gives one matrix, the runs of a conversation are chained to find where
the best path enters and leaves each, and then every run is repaired on its own. So the
turns of one conversation, however many, need not meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.base import Scratch

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
RUN_TURNS, CROWDED = 1024, 4096
MERGE, RELABEL, INSERT = 1.0, 2.0, 2.0
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_KEYS = ["conv_id", "block", "turn_key", "part"]


def _shortest(state: int, goal: int) -> list[int] | None:
    """Empty turns to insert after ``state`` so that ``goal`` may follow."""
    paths = [[]]
    while paths:
        path = paths.pop(0)
        last = path[-1] if path else state
        if goal in FOLLOWS[last]:
            return path
        if len(path) < 3:
            paths += [[*path, n] for n in FOLLOWS[last]]
    return None


def _moves(role: int) -> list[list[tuple[float, str, list[int]] | None]]:
    """For a turn of a role (0: unknown): cheapest (cost, action, inserted) between two states."""
    table = [[None] * 4 for _ in range(4)]
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            options = []
            if a == b:
                options.append((MERGE if role in (a, START) else MERGE + RELABEL, "merge", []))
            between = _shortest(a, b)
            if between is not None:
                change = 0.0 if role == b else RELABEL / 2 if role == START else RELABEL
                options.append((INSERT * len(between) + change, "keep" if role == b else "relabel", between))
            table[a][b] = min(options, default=None, key=lambda x: x[0])
    return table


MOVES = [_moves(r) for r in range(4)]
COSTS = np.array([[[m[0] if m else np.inf for m in row] for row in table] for table in MOVES])
#: Empty turns that close a sequence, and their cost.
CLOSING = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
CLOSE_COST = np.array([INSERT * len(CLOSING[s]) for s in range(4)])


def role_number(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), START)


def best_path(roles: list[int], first: int, last: int) -> list[int]:
    """States after each turn on the cheapest path from ``first`` to ``last``; ties to the lower state."""
    costs = [np.where(np.arange(4) == last, 0.0, np.inf)]
    for role in reversed(roles[1:]):
        costs.append((COSTS[role] + costs[-1]).min(axis=1))
    path, state = [], first
    for role, ahead in zip(roles, reversed(costs)):
        state = int(np.argmin(COSTS[role][state] + ahead))
        path.append(state)
    return path


def escaped(text: str | None) -> str:
    """Markers inside a text lose their meaning."""
    return (text or "").replace("<|", "< |")


def opening(role: int, text: str = "") -> str:
    return f"<|im_start|>{NAMES[role]}\n{text}"


CLOSE = "<|im_end|>\n"


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for key, rows in _groups(batches, _KEYS):
        matrix, n = np.where(np.eye(4), 0.0, np.inf), 0
        for row in rows:
            matrix, n = (matrix[:, :, None] + COSTS[role_number(row["role"])]).min(axis=1), n + 1
        out.append((*key, matrix.tobytes(), n))
        if len(out) >= 5000:
            yield _table([*_KEYS, "matrix", "n"], out)
            out = []
    if out:
        yield _table([*_KEYS, "matrix", "n"], out)


_TYPES = {"conv_id": pa.int64(), "block": pa.int64(), "turn_key": pa.int64(), "part": pa.int64(), "matrix": pa.binary(), "n": pa.int64(), "enter": pa.int32(), "leave": pa.int32(), "before": pa.int64(), "last": pa.bool_(), "turn": pa.int64(), "position": pa.int64(), "role_in": pa.string(), "role_out": pa.string(), "action": pa.string(), "inserted": pa.int64(), "fragment": pa.string()}


def _table(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[n]) for n, c in zip(names, zip(*rows))], names=names)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a conversation in order: states where the best path enters and leaves each."""
    names = [*_KEYS, "enter", "leave", "before", "last"]
    out = []
    for _, rows in _groups(batches, ["conv_id"]):
        rows = list(rows)
        ahead = [CLOSE_COST]
        for row in reversed(rows):
            ahead.append((np.frombuffer(row["matrix"]).reshape(4, 4) + ahead[-1]).min(axis=1))
        ahead = ahead[-2::-1]
        state, before = START, 0
        for i, row in enumerate(rows):
            after = int(np.argmin(np.frombuffer(row["matrix"]).reshape(4, 4)[state] + ahead[i]))
            out.append((*(row[k] for k in _KEYS), state, after, before, i == len(rows) - 1))
            state, before = after, before + row["n"]
        if len(out) >= 5000:
            yield _table(names, out)
            out = []
    if out:
        yield _table(names, out)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "turn", "position", "role_in", "role_out", "action", "inserted", "fragment"]
    out, size = [], 0
    for key, rows in _groups(batches, _KEYS):
        rows = list(rows)
        roles = [role_number(r["role"]) for r in rows]
        state = rows[0]["enter"]
        for i, (row, role, after) in enumerate(zip(rows, roles, best_path(roles, state, rows[0]["leave"]))):
            _, action, between = MOVES[role][state][after]
            if action == "merge":
                text = "\n" + escaped(row["text"])
            else:
                text = (CLOSE if state != START else "") + "".join(opening(b) + CLOSE for b in between) + opening(after, escaped(row["text"]))
            closing = CLOSING[after] if row["last"] and i == len(rows) - 1 else []
            if row["last"] and i == len(rows) - 1:
                text += CLOSE + "".join(opening(b) + CLOSE for b in closing)
            out.append((key[0], row["turn"], row["before"] + i, row["role"], NAMES[after], action, len(between) + len(closing), text))
            size += len(text)
            state = after
            if size > 2_000_000:
                yield _table(names, out)
                out, size = [], 0
    if out:
        yield _table(names, out)


def formatted_chats(turns: DataFrame, run_turns: int = RUN_TURNS, crowded: int = CROWDED) -> DataFrame:
    """(conv_id, turn, role, text) to one row per turn in its repaired conversation.

    Columns: conv_id, turn, position (from 0), role_in, role_out, action (keep, relabel,
    merge), inserted (empty turns beside it) and fragment; the fragments of a conversation
    in order of position are its rendering. Turns go by number (NULL last), then hash, role
    and text. Rows repeated in all four columns count once. NULL or unknown roles can take
    any role; NULL text is empty; rows without conv_id form a conversation of their own.
    An empty table gives no rows. Further columns are not read.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").distinct()
    rows = rows.withColumn("tie", F.xxhash64("role", "text")).withColumn(
        "block", F.coalesce(F.expr(f"turn div {run_turns} - if(turn < 0, 1, 0)"), F.lit(2**62))
    )
    rows = scratch.put(rows, "rows")
    sizes = rows.groupBy("conv_id", "block").count().filter(F.col("count") > crowded)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ("conv_id", "block")]
    cut = F.col("count").isNotNull()
    # a crowded run is cut by turn, and by as many ranges of the tie's hash as it needs
    parts = F.expr(f"count div {crowded} + 1")
    keyed = rows.alias("r").join(sizes.alias("s"), same, "left").select(
        "r.*",
        F.when(cut, F.coalesce("turn", F.lit(2**62))).otherwise(F.lit(0)).alias("turn_key"),
        F.when(cut, F.floor((F.shiftright("tie", 32) + 2**31) * parts / 2**32)).otherwise(F.lit(0)).cast("long").alias("part"),
    )
    keyed = scratch.put(keyed, "keyed")
    runs = (
        keyed.select(*_KEYS, "turn", "tie", "role", "text")
        .repartition(*_KEYS).sortWithinPartitions(*_KEYS, F.asc_nulls_last("turn"), "tie", "role", "text")
        .select(*_KEYS, "role")
        .mapInArrow(_matrices, "conv_id long, block long, turn_key long, part long, matrix binary, n long")
    )
    chained = scratch.put(
        runs.repartition("conv_id").sortWithinPartitions(*_KEYS)
        .mapInArrow(_chained, "conv_id long, block long, turn_key long, part long, enter int, leave int, before long, last boolean"),
        "chained",
    )
    same = [F.col(f"k.{k}").eqNullSafe(F.col(f"c.{k}")) for k in _KEYS]
    return (
        keyed.alias("k").join(chained.alias("c"), same).select("k.*", "enter", "leave", "before", "last")
        .repartition(*_KEYS).sortWithinPartitions(*_KEYS, F.asc_nulls_last("turn"), "tie", "role", "text")
        .drop("tie")
        .mapInArrow(_repaired, "conv_id long, turn long, position long, role_in string, role_out string, action string, inserted long, fragment string")
    )
