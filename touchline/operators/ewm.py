"""Exponentially weighted means of earlier rows.

The recurrence is: after a value, m <- (d*m + a*x) / (d + a) with d = (1-a)^gap,
where gap counts rows since the last value; a null row keeps m. It runs as a
stream over sorted partitions, one Arrow batch at a time, keeping only the state
of the current group. A step is linear in m, so a slice of a hot group is
summarised by its first value and one (scale, offset) pair; slices are then
composed and every slice starts from the state the earlier ones leave.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.ordered import SLICE, sliced_once


def _blocks(frames: Iterator[pd.DataFrame], keys: list[str]):
    """Batches with an integer group number that goes on across batches."""
    number, last = 0, None
    for frame in frames:
        if frame.empty:
            continue
        key = frame[keys].astype(object).where(frame[keys].notna(), None)
        first = tuple(key.iloc[0])
        change = (key != key.shift()) & ~(key.isna() & key.shift().isna())
        step = change.any(axis=1).to_numpy().astype(np.int64)
        step[0] = int(last is not None and first != last)
        group = number + np.cumsum(step)
        number, last = int(group[-1]), tuple(key.iloc[-1])
        yield frame, group


def shifted_means(values, group, heads, means, gaps, span):
    """The mean before each row, and after the last one its mean and the rows since the last value.

    ``means`` and ``gaps`` are what the groups, which begin at ``heads``, had before.
    """
    alpha = 2.0 / (span + 1)
    merged, known = values.copy(), {}
    for i in np.flatnonzero(~np.isnan(means)):
        a, b = heads[i], heads[i + 1] if i + 1 < len(heads) else len(values)
        seen = np.flatnonzero(~np.isnan(values[a:b]))
        known[i] = int(seen[0]) if len(seen) else b - a
        if len(seen):
            d = (1 - alpha) ** (gaps[i] + seen[0] + 1)
            merged[a + seen[0]] = (d * means[i] + alpha * values[a + seen[0]]) / (d + alpha)
    column = pd.Series(merged)
    if len(heads) > 1:  # the groups stand in order, so their results do
        smooth = column.groupby(group, sort=False).ewm(span=span, adjust=False).mean().to_numpy().copy()
    else:
        smooth = column.ewm(span=span, adjust=False).mean().to_numpy().copy()
    for i, n in known.items():
        smooth[heads[i] : heads[i] + n] = means[i]
    shifted = np.r_[np.nan, smooth[:-1]]
    shifted[heads] = means
    own = values[heads[-1] :]
    seen = np.flatnonzero(~np.isnan(own))
    trailing = len(own) - 1 - seen[-1] if len(seen) else np.nan_to_num(gaps[-1]) + len(own)
    return shifted, (smooth[-1], float(trailing))


def _ewm_batches(frames, keys, columns, span, starts):
    """Yield (frame, {column: shifted ewm}) with state carried across batches.

    The state is a mean and the rows since its last value. It enters the first
    value of a group in closed form, so the length of a gap costs nothing.
    """
    state_group, state = None, {}
    for frame, group in _blocks(frames, keys):
        if state_group != group[0]:
            state = {}
        heads = np.r_[0, np.flatnonzero(np.diff(group)) + 1]
        out, new_state = {}, {}
        for c in columns:
            values = pd.to_numeric(frame[c], errors="coerce").to_numpy("float64")
            means, gaps = np.full(len(heads), np.nan), np.zeros(len(heads))
            if starts is not None:
                means = frame[f"{starts}_m_{c}"].to_numpy("float64")[heads].copy()
                gaps = frame[f"{starts}_g_{c}"].to_numpy("float64")[heads].copy()
            if c in state:
                means[0], gaps[0] = state[c]
            out[c], new_state[c] = shifted_means(values, group, heads, means, gaps, span)
        state, state_group = new_state, group[-1]
        yield frame, out


def _schema(df: DataFrame, names: Sequence[str]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])


def ewm_features(
    rows: DataFrame,
    columns: Sequence[str],
    *,
    team: str = "team_id",
    order: Sequence[str] = ("kickoff_utc", "event_id"),
    span: int = 5,
    name: str = "ewm_{c}_{span}",
    row_key: Sequence[str] = ("event_id", "side"),
    bounded: bool = False,
) -> DataFrame:
    """Exponentially weighted mean of each column over the earlier rows of a team.

    Only the key, the order and the source columns go to Python; the results
    come back joined on ``row_key``.
    """
    columns, order, keys = list(columns), list(order), list(row_key)
    names = [name.format(c=c, span=span) for c in columns]
    needed = list(dict.fromkeys([team, *order, *keys, *([SLICE] if SLICE in rows.columns else [])]))
    slim = rows.select(*needed, *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    vs = [f"v{i}" for i in range(len(columns))]
    result = T.StructType(
        [*[slim.schema[k] for k in keys], *[T.StructField(n, T.DoubleType()) for n in names]]
    )

    def run(frames, groups, starts):
        for frame, out in _ewm_batches(frames, groups, vs, span, starts):
            done = frame[keys].copy()
            for v, n in zip(vs, names):
                done[n] = out[v]
            yield done

    if bounded:
        sorted_rows = slim.repartition(team).sortWithinPartitions(team, *order)
        smoothed = sorted_rows.mapInPandas(lambda frames: run(frames, [team], None), result)
    else:
        sliced = sliced_once(slim, [team], order)
        if SLICE in rows.columns:  # joins since the cut may have dealt the rows otherwise
            sliced = sliced.repartition(SLICE, team)
        sliced = sliced.sortWithinPartitions(team, *order)
        started = _slice_starts(sliced, team, vs, span)
        smoothed = started.sortWithinPartitions(team, *order).mapInPandas(
            lambda frames: run(frames, [SLICE, team], "s"), result
        )
    if set(rows.columns) <= {*keys, SLICE}:
        return smoothed
    return rows.join(smoothed, keys, "left")


def _slice_starts(sliced: DataFrame, team: str, vs: list[str], span: int) -> DataFrame:
    """Attach ``s_m_*`` (mean) and ``s_g_*`` (rows since the last value) on entry."""
    alpha = 2.0 / (span + 1)
    fields = [sliced.schema[SLICE], sliced.schema[team], T.StructField("rows", T.LongType())]
    for v in vs:
        fields += [T.StructField(f"{p}_{v}", T.DoubleType()) for p in ("first", "at", "scale", "offset", "gap")]
    summary_schema = T.StructType(fields)

    def summarise(frames):
        open_key, acc = None, None

        def close(key, acc):
            row = {SLICE: key[0], team: key[1], "rows": acc["rows"]}
            for v in vs:
                row.update({f"{p}_{v}": x for p, x in zip(("first", "at", "scale", "offset", "gap"), acc[v])})
            return row

        for frame in frames:
            done = []
            for key, part in frame.groupby([SLICE, team], sort=False, dropna=False):
                if key != open_key:
                    if acc is not None:
                        done.append(close(open_key, acc))
                    open_key, acc = key, {"rows": 0, **{v: None for v in vs}}
                for v in vs:
                    acc[v] = summarise_values(acc[v], part[v].to_numpy("float64"), acc["rows"], alpha)
                acc["rows"] += len(part)
            if done:
                yield pd.DataFrame(done, columns=summary_schema.names)
        if acc is not None:
            yield pd.DataFrame([close(open_key, acc)], columns=summary_schema.names)

    start_fields = [sliced.schema[SLICE], sliced.schema[team]]
    for v in vs:
        start_fields += [T.StructField(f"s_m_{v}", T.DoubleType()), T.StructField(f"s_g_{v}", T.DoubleType())]

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        # One row per slice of one team: bounded by the number of slices.
        group = group.sort_values(SLICE)
        state = {v: (np.nan, 0.0) for v in vs}
        out = []
        for row in group.to_dict("records"):
            out.append({SLICE: row[SLICE], team: row[team], **{f"s_m_{v}": state[v][0] for v in vs},
                        **{f"s_g_{v}": state[v][1] for v in vs}})
            for v in vs:
                state[v] = compose_state(*state[v], *(row[f"{p}_{v}"] for p in ("first", "at", "scale", "offset", "gap")), row["rows"], alpha)
        return pd.DataFrame(out, columns=[f.name for f in start_fields])

    # Only a team that goes on into another slice leaves a state there; slices are ranges, so there is at most one for each border.
    bounds = sliced.groupBy(F.col(team).alias("_k_team")).agg(F.min(SLICE).alias("_lo"), F.max(SLICE).alias("_hi")).where("_lo < _hi")
    crossing = sliced.join(F.broadcast(bounds), sliced[team].eqNullSafe(F.col("_k_team")), "left_semi")
    summary = crossing.mapInPandas(summarise, summary_schema)
    starts = summary.groupBy(team).applyInPandas(compose, T.StructType(start_fields))
    # Only slices that start inside a team carry a state: one per boundary.
    carried = starts.where(" or ".join(f"s_m_{v} is not null" for v in vs))
    renamed = carried.withColumnRenamed(SLICE, "_k_slice").withColumnRenamed(team, "_k_team")
    condition = sliced[SLICE].eqNullSafe(renamed["_k_slice"]) & sliced[team].eqNullSafe(renamed["_k_team"])
    return sliced.join(renamed, condition, "left").drop("_k_slice", "_k_team")


def summarise_values(acc, values, offset_rows, alpha):
    """(first, at, scale, offset, gap) of a group's values, extended by one more block."""
    places = np.flatnonzero(~np.isnan(values))
    if len(places) == 0:
        if acc is None:
            return (np.nan, np.nan, np.nan, np.nan, np.nan)
        first, at, scale, offset, gap = acc
        return (first, at, scale, offset, gap + len(values))
    if acc is None or np.isnan(acc[0]):
        first, at = float(values[places[0]]), float(offset_rows + places[0])
        scale, offset = 1.0, 0.0
        steps, previous = places[1:], places[:-1]
        gaps = steps - previous
    else:
        first, at, scale, offset, gap = acc
        steps = places
        gaps = np.r_[gap + places[0] + 1, np.diff(places)]
    if len(steps):
        d = (1 - alpha) ** np.asarray(gaps, dtype="float64")
        keep, add = d / (d + alpha), alpha * values[steps] / (d + alpha)
        # Weight a step still has at the end: the product of the later factors.
        after = np.r_[np.cumprod(keep[::-1])[::-1][1:], 1.0]
        whole = float(np.prod(keep))
        scale, offset = scale * whole, offset * whole + float(np.sum(add * after))
    return (first, at, scale, offset, float(len(values) - 1 - places[-1]))


def compose_state(mean, since, first, at, scale, offset, gap, rows, alpha):
    """The mean and the rows since the last value after a slice that ``summarise_values`` describes."""
    if np.isnan(first):
        return mean, since + rows
    if not np.isnan(mean):
        d = (1 - alpha) ** (since + at + 1)
        first = (d * mean + alpha * first) / (d + alpha)
    return scale * first + offset, gap
