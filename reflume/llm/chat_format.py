"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in
turn, the assistant last. Each input turn is kept, joined to the message before
it, given another role, or preceded by empty messages; each choice moves a
small automaton (the role of the last message) and has a cost. The cheapest
sequence of choices is found by dynamic programming.

Costs add up along min-plus products of 4 x 4 matrices, one a turn, so a
conversation of any length can be cut: rows sorted by conversation and turn are
packed into chunks of bounded size, each chunk gives the matrix of every
conversation part in it, and only the matrices of conversations that cross
chunks are brought together. With the states at the cuts known, every chunk is
repaired on its own. A second cost, a hash of the turn and the choice, decides
between repairs of equal cost, so cuts do not show in the result.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reflume.llm.common import Scratch, bound_batches, tidy

ROLES = ("system", "user", "assistant")
NONE, SYSTEM, USER, ASSISTANT = range(4)
_FOLLOWS = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs of a choice. Other role names, and null, are of no role: giving them one costs OTHER.
JOIN, JOIN_EMPTY, RELABEL, OTHER, INSERT = 2, 1, 5, 3, 4
CHUNK_ROWS, CHUNK_BYTES = 1024, 1_000_000
#: Bits of the second cost (sums over a billion turns fit), and a cost of no way, far above what costs differ by.
_TIE, _FAR = 40, np.int64(2**21)


def _choices(role: int, empty: bool) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(from, to, cost, action, inserted roles) of a turn whose own role is `role` (NONE: no known one)."""
    out = []
    for last in range(4):
        if last != NONE:
            out.append((last, last, (JOIN_EMPTY if empty else JOIN) + (0 if role == last else OTHER if role == NONE else RELABEL), "join", ()))
        for n in (0, 1, 2):
            for put in itertools.product((SYSTEM, USER, ASSISTANT), repeat=n):
                for new in (SYSTEM, USER, ASSISTANT):
                    path = (last, *put, new)
                    if all(b in _FOLLOWS[a] for a, b in zip(path, path[1:], strict=False)):
                        cost = INSERT * n + (0 if role == new else OTHER if role == NONE else RELABEL)
                        out.append((last, new, cost, "keep" if role == new else "relabel", put))
    best: dict[tuple[int, int], tuple] = {}
    for c in out:
        if (c[0], c[1]) not in best or c[2] < best[c[0], c[1]][2]:
            best[c[0], c[1]] = c
    return list(best.values())


#: For the end: what is inserted to leave the assistant last.
_END = {NONE: (2 * INSERT, (USER, ASSISTANT)), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}
_TABLE = {(role, empty): _choices(role, empty) for role in range(4) for empty in (False, True)}
_COST = {k: np.full((4, 4), _FAR) for k in _TABLE}
for _k, _v in _TABLE.items():
    for _a, _b, _c, *_ in _v:
        _COST[_k][_a, _b] = _c


def _kind(role: str | None, text: str | None) -> tuple[int, bool]:
    name = (role or "").strip().lower()
    return (ROLES.index(name) + 1 if name in ROLES else NONE), not (text or "").strip()


def _matrix(role, text, turn) -> np.ndarray:
    """(4, 4) costs, the second cost in the low bits: one integer orders both."""
    kind = _kind(role, text)
    seed = zlib.crc32(f"{turn}|{role}|{len(text or '')}|{(text or '')[:64]}".encode("utf-8", "replace"))
    tie = (np.arange(16, dtype=np.int64) * 40503 + seed % 1_000_003) * 2654435761 % 1009
    return (_COST[kind] << _TIE) + tie.reshape(4, 4)


def _above_least(x: np.ndarray) -> np.ndarray:
    """Costs less the least of them, which decides nothing, so that sums stay small however many turns there are."""
    return np.minimum(x - x.min(), _FAR << _TIE)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _above_least((a[:, :, None] + b[None, :, :]).min(1))


def _path(mats: list[np.ndarray], start: int, stop: int) -> list[int]:
    """The states of the cheapest way from start to stop, the first left out."""
    value = np.full(4, _FAR << _TIE)
    value[start] = 0
    back = []
    for m in mats:
        step = value[:, None] + m
        back.append(step.argmin(0))
        value = _above_least(step.min(0))
    states = [stop]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1][1:]


_CHUNK = "chunk long, n int, conv array<long>, turn array<long>, role array<string>, text array<string>, part_conv array<long>, part_size array<int>, part_cost array<array<long>>"


def _pack(most: int):
    """Sorted turns -> one row a chunk of at most `most` turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        size = number = 0

        def told() -> pa.RecordBatch:
            groups = [(k, list(g)) for k, g in itertools.groupby(held, key=lambda r: r[0])]
            costs = []
            for _, g in groups:
                m = _matrix(g[0][2], g[0][3], g[0][1])
                for r in g[1:]:
                    m = _times(m, _matrix(r[2], r[3], r[1]))
                costs.append(np.minimum(m, _FAR << _TIE).ravel().tolist())
            cols = [[r[k] for r in held] for k in range(4)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number], pa.int64()), pa.array([len(held)], pa.int32()), *(pa.array([c], pa.list_(t)) for c, t in zip(cols, kinds, strict=True)),
                 pa.array([[k for k, _ in groups]], pa.list_(pa.int64())), pa.array([[len(g) for _, g in groups]], pa.list_(pa.int32())), pa.array([costs], pa.list_(pa.list_(pa.int64())))],
                ["chunk", "n", "conv", "turn", "role", "text", "part_conv", "part_size", "part_cost"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                held.append(row)
                size += len(row[3] or "")
                if len(held) >= most or size >= CHUNK_BYTES:
                    yield told()
                    held, size, number = [], 0, number + 1
        if held:
            yield told()

    return run


def _cuts(key, pdf):
    """States and row numbers at the cuts of one conversation, from the costs of its parts in order."""
    import pandas as pd

    pdf = pdf.sort_values("chunk")
    mats = [np.array(c, np.int64).reshape(4, 4) for c in pdf["cost"]]
    ends = np.array([_END[s][0] for s in range(4)], np.int64) << _TIE
    total = mats[0][NONE]
    for m in mats[1:]:
        total = _above_least((total[:, None] + m).min(0))
    states = _path(mats, NONE, int((total + ends).argmin()))
    sizes = pdf["size"].to_numpy()
    return pd.DataFrame({
        "chunk": pdf["chunk"], "conv": key[0], "entry": [NONE, *states[:-1]], "leave": states, "first": np.cumsum(sizes) - sizes, "last": [False] * (len(states) - 1) + [True],
    })


OPEN, CLOSE, GLUE = "<|{}|>\n", "<|end|>\n", "\n\n"
_OUT = "conv_id long, place long, turn long, role string, action string, cost int, inserted array<string>, rendered string"


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the states at their cuts -> a row for each turn, and one for what closes a conversation."""
    for batch in batches:
        for chunk in batch.to_pylist():
            cuts = {c["conv"]: c for c in chunk["cuts"] or []}
            out: list[tuple] = []
            at = 0
            for conv, size in zip(chunk["part_conv"], chunk["part_size"], strict=True):
                rows = [(chunk["turn"][k], chunk["role"][k], chunk["text"][k]) for k in range(at, at + size)]
                at += size
                mats = [_matrix(r[1], r[2], r[0]) for r in rows]
                cut = cuts.get(conv)
                if cut:
                    state, leave, place, last = cut["entry"], cut["leave"], cut["first"], cut["last"]
                else:
                    total = mats[0][NONE]
                    for m in mats[1:]:
                        total = _above_least((total[:, None] + m).min(0))
                    state, leave, place, last = NONE, int((total + (np.array([_END[s][0] for s in range(4)], np.int64) << _TIE)).argmin()), 0, True
                for row, to in zip(rows, _path(mats, state, leave), strict=True):
                    turn, role, text = row
                    _, _, cost, action, put = next(c for c in _TABLE[_kind(role, text)] if c[0] == state and c[1] == to)
                    text = text or ""
                    if action == "join":
                        shown = GLUE + text if text else ""
                    else:
                        shown = (CLOSE if state != NONE else "") + "".join(OPEN.format(ROLES[p - 1]) + CLOSE for p in put) + OPEN.format(ROLES[to - 1]) + text
                    out.append((conv, place, turn, ROLES[to - 1], action, cost, [ROLES[p - 1] for p in put], shown))
                    state, place = to, place + 1
                if last:
                    cost, put = _END[state]
                    shown = CLOSE + "".join(OPEN.format(ROLES[p - 1]) + CLOSE for p in put)
                    out.append((conv, place, None, None, "end", cost, [ROLES[p - 1] for p in put], shown))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", "place", "turn", "role", "action", "cost", "inserted", "rendered"])


def format_chats(turns: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """conv_id, place, turn, role, action, cost, inserted, rendered: the repaired turns of turns (conv_id, turn, role, text, any more columns).

    A row for each input turn and one `end` row a conversation; `rendered` in the
    order of place is the whole conversation as text. Turns come in the order of
    turn (null last), then role and a hash of the text; equal rows are turns of their own.
    Roles are compared in lower case without outer spaces; others, and null,
    count as no role. Null texts are empty. Rows without a conv_id are one
    conversation. An empty table gives an empty result.
    """
    bound_batches(turns.sparkSession)
    scratch = Scratch(turns.sparkSession, "chats")
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("nth"),
    )
    order = ["conv_id", F.asc_nulls_last("turn"), "role", "h", "nth"]  # of the cuts and within them
    chunks = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("h", "nth")
    chunks = chunks.mapInArrow(tidy(_pack(chunk_rows)), _CHUNK)
    chunks = scratch.write(chunks, "chunks")
    parts = chunks.select("chunk", F.explode(F.arrays_zip(F.col("part_conv").alias("conv"), F.col("part_size").alias("size"), F.col("part_cost").alias("cost"))).alias("p")).select("chunk", "p.*")
    crossing = parts.groupBy("conv").count().where("count > 1").select(F.col("conv").alias("c"))
    cuts = (
        parts.join(crossing, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "chunk", "size", "cost")
        .groupBy("conv").applyInPandas(_cuts, "chunk long, conv long, entry int, leave int, first long, last boolean")
        .groupBy("chunk").agg(F.collect_list(F.struct("conv", "entry", "leave", "first", "last")).alias("cuts"))  # two of a chunk at most
    )
    cuts = scratch.write(cuts, "cuts")
    return chunks.join(cuts, "chunk", "left").select("part_conv", "part_size", "turn", "role", "text", "cuts").mapInArrow(tidy(_repair), _OUT)
