"""Chat formatting: the cheapest repair of each conversation's roles, then rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the assistant.
A turn may be merged with the one before (cost 1), an empty turn inserted (2) or a turn relabelled (3). Which of them to
use is a shortest path over (turn, automaton state). Its steps are min-plus matrices over four states, so a conversation
of any length is cut into segments of SEGMENT turns: tasks reduce each segment to one matrix, the matrices of a conversation
settle the states at the cuts, and tasks trace each segment between its states. One segment alone is settled where it is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, partitions

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, INSERT, RELABEL = 1, 2, 3
#: Turns in a segment.
SEGMENT = 512
INF = 1 << 40
#: Turns inserted before a turn of this state, by the state before it; others are impossible.
_PATHS = {(START, SYSTEM): (), (START, USER): (), (SYSTEM, USER): (), (USER, ASSISTANT): (), (ASSISTANT, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, ASSISTANT): (USER,)}
#: Turns inserted at the end.
_ENDS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def steps(role: int | None) -> list[tuple[int, int, int, bool, tuple[int, ...]]]:
    """(cost, state before, state after, merged, inserted) of every way to take a turn of this role, in order of preference."""
    out = []
    for label in (SYSTEM, USER, ASSISTANT):
        extra = 0 if label == role else RELABEL
        for before in range(4):
            if before == label:
                out.append((extra + MERGE, before, label, True, ()))
            elif (before, label) in _PATHS:
                out.append((extra + INSERT * len(_PATHS[before, label]), before, label, False, _PATHS[before, label]))
    return sorted(out, key=lambda s: (s[0], s[3], s[2]))


_STEPS = {r: steps(r) for r in (None, SYSTEM, USER, ASSISTANT)}


def role_number(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else None


def matrix(roles: list[int | None]) -> list[list[int]]:
    """The least cost from each state to each other over the roles."""
    out = [[0 if a == b else INF for b in range(4)] for a in range(4)]
    for role in roles:
        new = [[INF] * 4 for _ in range(4)]
        for cost, before, after, _, _ in _STEPS[role]:
            for a in range(4):
                if out[a][before] + cost < new[a][after]:
                    new[a][after] = out[a][before] + cost
        out = new
    return out


def trace(roles: list[int | None], entry: int, exit_: int) -> list[tuple[int, int, int, bool, tuple[int, ...]]]:
    """The cheapest steps from entry to exit; of equally cheap ones the first in the order of steps()."""
    cost, back = [0 if s == entry else INF for s in range(4)], []
    for role in roles:
        new, via = [INF] * 4, [None] * 4
        for step in _STEPS[role]:
            if cost[step[1]] + step[0] < new[step[2]]:
                new[step[2]], via[step[2]] = cost[step[1]] + step[0], step
        cost = new
        back.append(via)
    out, state = [], exit_
    for via in reversed(back):
        out.append(via[state])
        state = via[state][1]
    return out[::-1]


def route(matrices: list[list[list[int]]]) -> list[int]:
    """The states at the cuts of a conversation, from START to its end."""
    cost, back = [0, INF, INF, INF], []
    for m in matrices:
        best = [min((cost[a] + m[a][b], a) for a in range(4)) for b in range(4)]
        cost, via = [c for c, _ in best], [a for _, a in best]
        back.append(via)
    state = min(range(4), key=lambda s: (cost[s] + INSERT * len(_ENDS[s]), s))
    out = [state]
    for via in reversed(back):
        state = via[state]
        out.append(state)
    return out[::-1]


def render(texts: list[str], path: list, first: bool, last: bool) -> str:
    """The segment's share of the conversation: turns that begin in it, text merged into the turn before, and the end."""
    out, is_open = [], not first

    def begin(state: int) -> None:
        nonlocal is_open
        out.append(("<|im_end|>\n" if is_open else "") + f"<|im_start|>{ROLES[state - 1]}\n")
        is_open = True

    for text, (_, _, after, merged, inserted) in zip(texts, path, strict=True):
        for state in inserted:
            begin(state)
        if merged:
            out.append("\n")
        else:
            begin(after)
        out.append(text)
    if last:
        for state in _ENDS[path[-1][2]]:
            begin(state)
        out.append("<|im_end|>\n")
    return "".join(out)


_PIECE = "conv_id bigint, part bigint, start bigint, whole boolean, alone boolean, roles array<string>, texts array<string>, n_rows bigint"


def _pieces(batches: Iterator[pa.RecordBatch], before: dict[tuple[int, int | None], int], spanning: frozenset) -> Iterator[pa.RecordBatch]:
    """Rows in order in, segments out; cut where a turn's position in its conversation is a multiple of SEGMENT.

    before: the turns in earlier tasks of the conversations (spanning) that several tasks share. Their segments may come in
    pieces (not whole). alone: the conversation's only segment.
    """
    held, conv, at, began = [], None, 0, True

    def out(ended: bool) -> pa.RecordBatch:
        shared = conv in spanning
        row = (conv, (at - 1) // SEGMENT, at - len(held), not shared or len(held) == SEGMENT, not shared and ended and at <= SEGMENT, [r for r, _, _ in held], [t or "" for _, t, _ in held], sum(n for _, _, n in held))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["conv_id", "part", "start", "whole", "alone", "roles", "texts", "n_rows"])

    for batch in batches:
        for task, c, role, text, n in zip(*[batch.column(k).to_pylist() for k in ("task", "conv_id", "role", "text", "n")], strict=True):
            if began or c != conv:
                if held:
                    yield out(True)
                held, conv, began = [], c, False
                at = before.get((task, c), 0)
            elif at % SEGMENT == 0 and held:
                yield out(False)
                held = []
            held.append((role, text, n))
            at += 1
    if held:
        yield out(True)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [sum(matrix([role_number(r) for r in roles]), []) for roles in batch.column("roles").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "part", "costs"])


def _settle(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    states = route([[c[4 * a : 4 * a + 4] for a in range(4)] for c in table.column("costs").to_pylist()])
    n = table.num_rows
    return pa.table({"id": table.column("conv_id"), "at": table.column("part"), "entry": pa.array(states[:-1], pa.int32()), "exit": pa.array(states[1:], pa.int32()), "last": pa.array([k == n - 1 for k in range(n)])})


_RENDERED = "conv_id bigint, part bigint, n_rows bigint, n_merged bigint, n_relabelled bigint, n_inserted bigint, cost bigint, text string"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "part", "n_rows", "n_merged", "n_relabelled", "n_inserted", "cost", "text"]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            roles = [role_number(x) for x in r["roles"]]
            entry, exit_ = (r["entry"], r["exit"]) if "entry" in r else route([matrix(roles)])
            last = r.get("last", True)
            path = trace(roles, entry, exit_)
            ends = len(_ENDS[path[-1][2]]) if last else 0
            inserted = sum(len(s[4]) for s in path) + ends
            relabelled = sum(s[2] != role for s, role in zip(path, roles, strict=True))
            rows.append((r["conv_id"], r["part"], r["n_rows"], sum(s[3] for s in path), relabelled, inserted, sum(s[0] for s in path) + INSERT * ends, render(r["texts"], path, r["part"] == 0, last)))
        kinds = [pa.int64()] * 7 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_rows, n_merged, n_relabelled, n_inserted, cost, text for the conversations of turns.

    turns: conv_id, turn, role, text. Each SEGMENT turns of a conversation are a part, numbered from 0, whatever the
    partitions; the parts' texts in order are its rendered text. Turns are ordered by turn (null first), then role and text;
    rows that repeat a turn exactly are one turn and count in n_rows. A role that is null or not one of ROLES (whatever its
    case) must be relabelled. Of equally cheap repairs the first in the order of steps() is taken. Null texts are empty; a text
    may have any length that a Spark string has, and is never cut. Rows with a null conv_id form a conversation of their
    own. Other columns are ignored. An empty table gives an empty result.
    """
    spark = turns.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.groupBy(*order).agg(F.count("*").alias("n"))
    rows = materialise(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id()))
    # A conversation that n tasks share fills the borders between them, so there are fewer such rows than twice the tasks.
    counts = rows.groupBy("conv_id", "task").agg(F.count("*").alias("n")).withColumn("tasks", F.count("*").over(W.partitionBy("conv_id")))
    before, total = {}, {}
    for conv, task, n in sorted(counts.where("tasks > 1").select("conv_id", "task", "n").collect(), key=lambda r: r[1]):
        before[task, conv] = total.get(conv, 0)
        total[conv] = before[task, conv] + n
    spanning = frozenset(total)
    pieces = materialise(rows.mapInArrow(lambda it: _pieces(it, before, spanning), _PIECE))
    alone = pieces.where("alone").select("conv_id", "part", "roles", "texts", "n_rows").mapInArrow(_render, _RENDERED)
    parts = pieces.where("NOT alone AND whole").select("conv_id", "part", "roles", "texts", "n_rows")
    if spanning:
        cut = F.sort_array(F.collect_list(F.struct("start", "roles", "texts", "n_rows")))
        cut = pieces.where("NOT whole").groupBy("conv_id", "part").agg(cut.alias("p"))  # at most SEGMENT turns
        parts = parts.union(cut.select("conv_id", "part", F.flatten("p.roles"), F.flatten("p.texts"), F.aggregate("p.n_rows", F.lit(0).cast("bigint"), lambda a, x: a + x)))
    settled = parts.mapInArrow(_reduce, "conv_id bigint, part bigint, costs array<bigint>").groupBy("conv_id").applyInArrow(_settle, "id bigint, at bigint, entry int, exit int, last boolean")
    long = parts.join(settled, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("part") == F.col("at"))).drop("id", "at")
    return alone.union(long.mapInArrow(_render, _RENDERED))
