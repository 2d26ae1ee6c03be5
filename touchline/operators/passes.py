"""All history columns of a team's rows in one pass over its sorted slices.

``rolling_features``, ``prior_count`` and ``ewm_features`` are the same columns as single steps. Here a slice's rows go
to Python once, as Arrow batches, and come back with every column added: no window evaluates a frame again for each row
and each column, and nothing is joined back. What a slice needs from earlier ones is the last rows of the team that goes
on into it, their number and the state of the weighted means: one state for each border between slices.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.scalars import unix_micros
from touchline.operators.ewm import compose_state, shifted_means, summarise_values
from touchline.operators.history import DAY_MICROS, MEAN_WINDOWS, SPREAD_WINDOW
from touchline.operators.ordered import SLICE, sliced_once

NOTHING = -(1 << 63)  # an unknown time


def history_features(
    rows: DataFrame,
    columns: Sequence[str],
    *,
    team: str = "team_id",
    order: Sequence[str] = ("kickoff_utc", "event_id"),
    means: Sequence[int] = MEAN_WINDOWS,
    spread: int = SPREAD_WINDOW,
    trend: tuple[int, int] = (3, 10),
    trend_name: str = "trend_{c}_{a}_minus_{b}",
    flags: dict[str, tuple[str, int]] | None = None,
    rest: str = "rest_days",
    prior: str = "prior_match_count",
    span: int = 5,
) -> DataFrame:
    """Means, spread, trend and weighted mean of each column over a team's earlier rows, its counts and rest days.

    ``flags`` maps a name to a (boolean column, window) whose true values are counted.
    """
    columns, order, flags = list(columns), list(order), dict(flags or {})
    sliced = sliced_once(rows, [team], order)
    values = [f"_v{i}" for i in range(len(columns))]
    marks = [f"_f{i}" for i in range(len(flags))]
    reach = max([*means, *trend, spread, *(n for _, n in flags.values())])
    ready = sliced.select(
        "*",
        *[F.col(f"`{c}`").cast("double").alias(v) for c, v in zip(columns, values, strict=True)],
        *[F.coalesce(F.col(flag), F.lit(False)).alias(m) for (flag, _), m in zip(flags.values(), marks, strict=True)],
        unix_micros(order[0]).alias("_at"),
    )
    carried = sliced.sparkSession.sparkContext.broadcast(_carried(ready, team, order, values, marks, reach, span))
    kept = [c for c in sliced.columns]
    floats = [n for c in columns for n in (
        *(f"rolling_{c}_{k}" for k in means), f"rolling_std_{c}_{spread}", trend_name.format(c=c, a=trend[0], b=trend[1]), f"ewm_{c}_{span}",
    )]
    schema = T.StructType([
        *[sliced.schema[c] for c in kept], *[T.StructField(n, T.DoubleType()) for n in floats],
        *[T.StructField(n, T.LongType()) for n in flags], T.StructField(rest, T.DoubleType()), T.StructField(prior, T.LongType()),
    ])
    windows = [n for _, n in flags.values()]

    def run(batches):
        state = slice_ = last = None
        for batch in batches:
            done = 0
            for first, end, heads, own, same in _groups(batch, team, slice_, last):
                part = batch.slice(first, end - first)
                if own != slice_:
                    slice_, state = own, carried.value.get(own)
                elif not same:
                    state = None
                made, state = _features(part, heads, state, values, marks, windows, reach, means, spread, trend, span)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made], schema.names)
                done = end
            if done:
                last = batch.column(team)[done - 1].as_py()

    return ready.sortWithinPartitions(team, *order).mapInArrow(run, schema)


def _same(a, b) -> bool:
    """Whether two keys are one group: unknown keys are, and so are two that are no number."""
    return (a is None and b is None) or (a is not None and b is not None and (a == b or (a != a and b != b)))


def _groups(batch: pa.RecordBatch, team: str, slice_, last):
    """(first row, end, heads of groups, slice, whether the first group goes on) for each slice in a batch."""
    n = batch.num_rows
    if not n:
        return
    slices = batch.column(SLICE).to_numpy(zero_copy_only=False)
    keys = batch.column(team)
    if not pa.types.is_dictionary(keys.type):
        keys = keys.dictionary_encode()
    codes = pc.fill_null(keys.indices, -1).to_numpy(zero_copy_only=False)
    change = np.flatnonzero((codes[1:] != codes[:-1]) | (slices[1:] != slices[:-1])) + 1
    borders = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist(), n]
    for first, end in zip(borders[:-1], borders[1:], strict=True):
        own = int(slices[first])
        heads = np.concatenate([[0], change[(change > first) & (change < end)] - first])
        yield first, end, heads, own, first == 0 and own == slice_ and _same(last, batch.column(team)[0].as_py())


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) numbers and whether each is known."""
    out, known = np.zeros((len(names), batch.num_rows)), np.ones((len(names), batch.num_rows), dtype=bool)
    for i, name in enumerate(names):
        column = batch.column(name)
        if pa.types.is_boolean(column.type):
            column = column.cast(pa.int8())
        if column.null_count:
            known[i] = column.is_valid().to_numpy(zero_copy_only=False)
            column = pc.fill_null(column, 0)
        out[i] = column.to_numpy(zero_copy_only=False)
    return out, known


def _times(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(batch.column("_at"), NOTHING).to_numpy(zero_copy_only=False)


def _features(batch, heads, state, values, marks, windows, reach, means, spread, trend, span):
    """Arrow columns of one slice's rows, and the state after the last one.

    The state is what the first group had before: its number of rows, the last of them and their times, and the weighted
    means with the rows since their last values.
    """
    n, sources = batch.num_rows, len(values)
    now, sure = _matrix(batch, [*values, *marks])
    at = _times(batch)
    count, tail, tail_sure, before_at, mean, gap = state or (
        0, np.zeros((len(now), reach)), np.zeros((len(now), reach), dtype=bool), NOTHING, np.full(sources, np.nan), np.zeros(sources),
    )
    line, known = np.concatenate([tail, now], axis=1), np.concatenate([tail_sure, sure], axis=1)
    sizes = np.diff(np.append(heads, n))
    group = np.repeat(np.arange(len(heads)), sizes)
    prior = np.arange(n) - np.repeat(heads, sizes)
    prior[: sizes[0]] += count
    near = [None, *(prior >= k for k in range(1, reach + 1))]  # whether the k-th row before is of the same team
    out, ends = [], []
    for i in range(sources):
        total, seen, sums, counts = np.zeros(n), np.zeros(n, dtype=np.int32), {}, {}
        part = {}
        for k in range(reach, 0, -1):
            ok = known[i, reach - k : reach - k + n] & near[k]
            x = np.where(ok, line[i, reach - k : reach - k + n], 0.0)
            for w in {*means, *trend}:
                if w == k:
                    sums[w], counts[w] = np.zeros(n), np.zeros(n, dtype=np.int32)
            for w in sums:
                sums[w] += x
                counts[w] += ok
            if k <= spread:
                if k == spread:
                    total, seen, square = np.zeros(n), np.zeros(n), np.zeros(n)
                delta = x - total
                times = seen + 1.0
                step = delta / times
                total = np.where(ok, total + step, total)
                square = np.where(ok, square + delta * (delta - step), square)
                seen = np.where(ok, times, seen)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = {w: sums[w] / counts[w] for w in sums}
            deviation = np.sqrt(square / (seen - 1.0))
        out += [pa.array(part[w], mask=counts[w] == 0) for w in means]
        out.append(pa.array(deviation, mask=seen < 2))
        a, b = trend
        out.append(pa.array(part[a] - part[b], mask=(counts[a] == 0) | (counts[b] == 0)))
        start, gaps = np.full(len(heads), np.nan), np.zeros(len(heads))
        start[0], gaps[0] = mean[i], gap[i]
        weighted, end = shifted_means(np.where(sure[i], now[i], np.nan), group, heads, start, gaps, span)
        out.append(pa.array(weighted, mask=np.isnan(weighted)))
        ends.append(end)
    for i, window in enumerate(windows, sources):
        total = np.zeros(n)
        for k in range(window, 0, -1):
            total += np.where(known[i, reach - k : reach - k + n] & near[k], line[i, reach - k : reach - k + n], 0.0)
        out.append(pa.array(total.astype(np.int64), mask=prior == 0))
    earlier = np.concatenate([[before_at], at[:-1]])
    unknown = ~near[1] | (earlier == NOTHING) | (at == NOTHING)
    out.append(pa.array(np.where(unknown, 0, at - np.where(unknown, at, earlier)) / DAY_MICROS, mask=unknown))
    out.append(pa.array(prior))
    after = int(prior[-1]) + 1
    mine = np.arange(reach, 0, -1) <= after
    state = (after, line[:, n:], known[:, n:] & mine, int(at[-1]), *(np.array(x) for x in zip(*ends, strict=True)))
    return out, state


def _carried(ready: DataFrame, team: str, order, values, marks, reach: int, span: int) -> dict:
    """The state on entry of each slice that goes on with the team of the one before it."""
    # Slices are ranges, so at most one team goes over each border between them, and all rows of it there are its first.
    bounds = ready.groupBy(F.col(team).alias("_k_team")).agg(F.min(SLICE).alias("_lo"), F.max(SLICE).alias("_hi")).where("_lo < _hi")
    crossing = ready.join(F.broadcast(bounds), ready[team].eqNullSafe(F.col("_k_team")))
    crossing = crossing.sortWithinPartitions(team, *order).select(SLICE, "_lo", "_at", *values, *marks)  # Spark drops a sort below a join
    alpha = 2.0 / (span + 1)

    def summarise(batches):
        open_key, rows, sums, tail, sure, at = None, 0, [], None, None, NOTHING

        def closed():
            return pa.RecordBatch.from_pylist([{
                "slice": open_key[0], "lo": open_key[1], "rows": rows, "at": int(at), "sums": np.array(sums, dtype="float64").tobytes(),
                "tail": tail.tobytes(), "sure": sure.tobytes(),
            }], schema=summary)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (SLICE, "_lo")])
            heads = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for first, end in zip(heads[:-1], heads[1:], strict=True):
                key = (int(keys[0, first]), int(keys[1, first]))
                if key != open_key:
                    if open_key is not None:
                        yield closed()
                    open_key, rows, sums, at = key, 0, [None] * len(values), NOTHING
                    tail, sure = np.zeros((len(values) + len(marks), reach)), np.zeros((len(values) + len(marks), reach), dtype=bool)
                part = batch.slice(first, end - first)
                now, known = _matrix(part, [*values, *marks])
                sums = [summarise_values(acc, np.where(known[i], now[i], np.nan), rows, alpha) for i, acc in enumerate(sums)]
                rows, at = rows + end - first, _times(part)[-1]
                tail, sure = (np.concatenate([a, b[:, -reach:]], axis=1)[:, -reach:] for a, b in ((tail, now), (sure, known)))
        if open_key is not None:
            yield closed()

    names = "slice int, lo int, rows long, at long, sums binary, tail binary, sure binary"
    summary = pa.schema([("slice", pa.int32()), ("lo", pa.int32()), ("rows", pa.int64()), ("at", pa.int64()), *((c, pa.binary()) for c in ("sums", "tail", "sure"))])
    found = crossing.mapInArrow(summarise, names).collect()  # at most two for each slice
    out, teams = {}, {}
    for row in sorted(found, key=lambda r: r["slice"]):
        shape = (len(values) + len(marks), reach)
        if row["lo"] in teams:
            out[row["slice"]] = teams[row["lo"]]
            count, tail, sure, _, mean, gap = teams[row["lo"]]
        else:
            count, tail, sure, mean, gap = 0, np.zeros(shape), np.zeros(shape, dtype=bool), np.full(len(values), np.nan), np.zeros(len(values))
        own, known = np.frombuffer(row["tail"]).reshape(shape), np.frombuffer(row["sure"], dtype=bool).reshape(shape)
        new = min(reach, row["rows"])
        tail, sure = (np.concatenate([a, b[:, reach - new :]], axis=1)[:, -reach:] for a, b in ((tail, own), (sure, known)))
        ends = [
            compose_state(m, g, *part, row["rows"], alpha)
            for m, g, part in zip(mean, gap, np.frombuffer(row["sums"]).reshape(len(values), 5).tolist(), strict=True)
        ]
        teams[row["lo"]] = (count + row["rows"], tail, sure, row["at"], *(np.array(x, dtype="float64") for x in zip(*ends, strict=True)))
    return out
