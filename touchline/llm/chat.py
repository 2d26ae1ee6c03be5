"""Chat formatting with minimum-cost repair of roles.

Legal conversations are an automaton: an optional system turn, then user and assistant in turn, an assistant turn last.
For each turn the repair keeps it, merges it into the turn before, gives it another role, or puts an empty turn before
it; a conversation that ends early gets empty turns. Dynamic programming finds the cheapest repair.

A conversation may be longer than a task should hold. Rows are range-partitioned by conversation and turn; a slice of a
conversation is a matrix of least costs from each state to each state, and matrices compose, so one row per slice is
enough to know in which states each slice starts and ends. Slices are then repaired on their own. The result is one row
per turn; the rendered pieces of a conversation, in order, are its text.

Defined results: a null or unknown role always needs another one; null and empty texts are empty turns; null
conversation ids form one conversation and null turns come first; equal turn numbers are ordered by role and text; of
equally cheap repairs the option listed first in ``options`` wins within a slice; an empty table gives none; extra
columns are not carried.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.spread import keep, runs

ROLES = ("none", "system", "user", "assistant")
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, INSERT, RELABEL = 1, 2, 3
FINAL = np.array([0, 2 * INSERT, INSERT, 0])
ENDING = {0: (), 1: (2, 3), 2: (3,), 3: ()}
ACTIONS = ("keep", "merge", "relabel", "relabel_merge", "insert", "relabel_insert")
OUT = "conv_id long, turn long, place long, action string, role string, inserted string, cost int, rendered string"


@lru_cache(maxsize=32)
def options(role: int, state: int) -> tuple[tuple[int, int, int, int], ...]:
    """(cost, action, inserted role, next state) for a turn of ``role`` after ``state``, cheapest kinds first."""
    found = []
    for to in LEGAL[state]:
        found.append((0, 0, 0, to) if to == role else (RELABEL, 2, 0, to))
    if state:
        found.append((MERGE, 1, 0, state) if state == role else (MERGE + RELABEL, 3, 0, state))
    for between in LEGAL[state]:
        for to in LEGAL[between]:
            found.append((INSERT, 4, between, to) if to == role else (INSERT + RELABEL, 5, between, to))
    return tuple(sorted(found, key=lambda x: (x[0], x[1], x[3])))


@lru_cache(maxsize=8)
def step(role: int) -> np.ndarray:
    """Least cost from each state to each state over one turn."""
    out = np.full((4, 4), np.inf)
    for state in range(4):
        for cost, _, _, to in options(role, state):
            out[state, to] = min(out[state, to], cost)
    return out


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def roles_matrix(roles: np.ndarray) -> np.ndarray:
    """Least costs over a run of turns, composed pair by pair."""
    if not len(roles):
        return np.where(np.eye(4) > 0, 0.0, np.inf)
    stack = np.stack([step(r) for r in range(4)])[roles]
    while len(stack) > 1:
        odd = stack[-1:] if len(stack) % 2 else stack[:0]
        even = stack[: len(stack) // 2 * 2]
        stack = np.concatenate([(even[::2, :, :, None] + even[1::2, None, :, :]).min(axis=2), odd])
    return stack[0]


def repair(roles: list[int], start: int, after: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The options taken for a run of turns from ``start``; ``after`` is the cost to go from each final state."""
    to_go = np.empty((len(roles) + 1, 4))
    to_go[-1] = after
    for k in range(len(roles) - 1, -1, -1):
        to_go[k] = (step(roles[k]) + to_go[k + 1][None, :]).min(axis=1)
    state, taken = start, []
    for k, role in enumerate(roles):
        taken.append(next(o for o in options(role, state) if o[0] + to_go[k + 1][o[3]] == to_go[k][state]))
        state = taken[-1][3]
    return taken


def opened(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSED = "<|end|>\n"


def _plan(fragments):
    """Start state, required end state and kind of each slice of one conversation."""
    import pandas as pd

    fragments = fragments.sort_values("slice")
    matrices = [np.array(m).reshape(4, 4) for m in fragments["matrix"]]
    to_go = [FINAL.astype(float)]
    for m in reversed(matrices):
        to_go.append((m + to_go[-1][None, :]).min(axis=1))
    to_go.reverse()
    state, starts, ends = 0, [], []
    for k, m in enumerate(matrices):
        starts.append(state)
        state = int(np.argmin(m[state] + to_go[k + 1]))
        ends.append(state)
    last = [False] * (len(matrices) - 1) + [True]
    return pd.DataFrame({"slice": fragments["slice"], "conv": fragments["conv"], "start": starts, "stop": ends, "last": last})


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per turn with its repair and its piece of the rendered conversation."""
    role = F.lower(F.trim(F.col("role").cast("string")))
    number = F.when(role == "system", 1).when(role == "user", 2).when(role == "assistant", 3).otherwise(0)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), number.alias("r"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    order = ["conv_id", "turn", "r", "h"]
    sliced = keep(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "*", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("place"),
            F.struct(F.col("conv_id").isNull().alias("missing"), F.coalesce("conv_id", F.lit(0)).alias("id")).alias("conv"),
        ).drop("h"),
        "turns",
    ).select("conv_id", "turn", "r", "text", "slice", "place", F.xxhash64("conv.missing", "conv.id").alias("conv"))

    def matrices(batches):
        for table in runs(batches, ["slice", "conv"]):
            matrix = roles_matrix(table.column("r").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [table.column("slice").combine_chunks()[:1], table.column("conv").combine_chunks()[:1], pa.array([matrix.reshape(-1).tolist()])],
                ["slice", "conv", "matrix"],
            )

    slim = sliced.select("slice", "conv", "place", "r").repartition("slice", "conv").sortWithinPartitions("slice", "conv", "place")
    fragments = slim.mapInArrow(matrices, "slice int, conv long, matrix array<double>")
    several = fragments.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    known = fragments.join(several, "conv")
    alone = known.where("n = 1").select("slice", "conv", F.lit(0).alias("start"), F.lit(-1).alias("stop"), F.lit(True).alias("last"))
    plan = known.where("n > 1").select("slice", "conv", "matrix").groupBy("conv").applyInPandas(
        _plan, "slice int, conv long, start int, stop int, last boolean"
    )
    planned = sliced.join(alone.unionByName(plan.select(alone.columns)), ["slice", "conv"])

    def apply(batches):
        for table in runs(batches, ["slice", "conv"]):
            start, stop, last = (table.column(c)[0].as_py() for c in ("start", "stop", "last"))
            after = FINAL.astype(float) if stop < 0 else np.where(np.arange(4) == stop, 0.0, np.inf)
            roles = table.column("r").to_pylist()
            taken = repair(roles, start, after)
            texts = table.column("text").to_pylist()
            state, pieces = start, []
            for (_, action, inserted, to), text in zip(taken, texts, strict=True):
                text = text.replace("<|", "<\\|")
                if action in (1, 3):
                    pieces.append("\n" + text)
                else:
                    empty = opened(inserted) + CLOSED if inserted else ""
                    pieces.append((CLOSED if state else "") + empty + opened(to) + text)
                state = to
            costs = [c for c, *_ in taken]
            if last:
                pieces[-1] += CLOSED + "".join(opened(r) + CLOSED for r in ENDING[state])
                costs[-1] += int(FINAL[state])
            yield pa.RecordBatch.from_arrays(
                [table.column("conv_id").combine_chunks(), table.column("turn").combine_chunks(), table.column("place").combine_chunks(),
                 pa.array([ACTIONS[a] for _, a, _, _ in taken]), pa.array([ROLES[t] for *_, t in taken]),
                 pa.array([ROLES[i] if i else None for _, _, i, _ in taken], pa.string()), pa.array(costs, pa.int32()), pa.array(pieces)],
                ["conv_id", "turn", "place", "action", "role", "inserted", "cost", "rendered"],
            )

    dealt = planned.repartition("slice", "conv").sortWithinPartitions("slice", "conv", "place")
    return dealt.mapInArrow(apply, OUT)
