"""Leakage-safe history features per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import clip, unix_micros
from touchline.operators.joins import count_between, totals_between
from touchline.operators.ordered import over_recent, running_totals

DAY_MICROS = 86_400_000_000
MEAN_WINDOWS = (3, 5, 10)
SPREAD_WINDOW = 5


def _number(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def rolling_features(
    rows: DataFrame,
    columns: Sequence[str],
    *,
    team: str = "team_id",
    order: Sequence[str] = ("kickoff_utc", "event_id"),
    means: Sequence[int] = MEAN_WINDOWS,
    spread: int | None = SPREAD_WINDOW,
    counts: Sequence[int] = (),
    trend: tuple[int, int] | None = (3, 10),
    trend_name: str = "trend_{c}_{a}_minus_{b}",
    flags: dict[str, tuple[str, int]] | None = None,
    rest: str | None = "rest_days",
    bounded: bool = False,
) -> DataFrame:
    """Means, spread, counts, trends and rest days of earlier rows.

    The current row never enters its own features. ``flags`` maps a name to a
    (boolean column, window) whose true values are counted. Everything is one
    window operator over one sort.
    """
    reach = max([*means, *counts, spread or 0, *(w for _, w in (flags or {}).values()), *(trend or ()), 1])

    def features(frame, ordered):
        out = {}
        for c in columns:
            for n in means:
                out[f"rolling_{c}_{n}"] = F.avg(_number(c)).over(frame(n))
            for n in counts:
                out[f"rolling_{c}_count_{n}"] = F.count(_number(c)).over(frame(n))
            if spread:
                out[f"rolling_std_{c}_{spread}"] = F.stddev_samp(_number(c)).over(frame(spread))
            if trend:
                a, b = trend
                out[trend_name.format(c=c, a=a, b=b)] = (
                    F.avg(_number(c)).over(frame(a)) - F.avg(_number(c)).over(frame(b))
                )
        for name, (flag, n) in (flags or {}).items():
            out[name] = F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")).over(frame(n))
        if rest:
            at = unix_micros(order[0])
            out[rest] = (at - F.lag(at).over(ordered)) / DAY_MICROS
        return out

    return over_recent(rows, [team], list(order), reach, features, bounded=bounded)


def whole_day_gap(
    rows: DataFrame, team: str, order: Sequence[str], name: str = "days_since_last_match",
    bounded: bool = False,
) -> DataFrame:
    """Whole days since the previous row."""
    at = unix_micros(order[0])
    return over_recent(
        rows, [team], list(order), 1,
        lambda frame, w: {name: F.floor((at - F.lag(at).over(w)) / DAY_MICROS)},
        bounded=bounded,
    )


def prior_count(
    rows: DataFrame, team: str, order: Sequence[str], name: str = "prior_match_count",
    upto: Sequence[int] = (), bounded: bool = False,
) -> DataFrame:
    """Number of earlier rows, and copies limited to each value in ``upto``."""
    out = running_totals(rows, [team], list(order), {name: F.lit(1).cast("bigint")}, bounded=bounded)
    out = out.withColumn(name, F.col(name) - 1)
    if not upto:
        return out
    return out.select("*", *[clip(F.col(name), high=n).alias(f"rolling_matches_available_{n}") for n in upto])


def count_recent(
    rows: DataFrame, team: str, time: str, days: int, name: str, row_key: Sequence[str],
    bounded: bool = False,
) -> DataFrame:
    """Rows of the team in ``[t - days, t)``; rows of the same instant do not count.

    Two growing frames are subtracted: both only ever add rows, while one
    sliding frame would be summed again for every row.
    """
    at = unix_micros(time)
    if bounded:
        w = Window.partitionBy(team).orderBy(at)
        before = F.count(at).over(w.rangeBetween(Window.unboundedPreceding, -1))
        too_old = F.count(at).over(w.rangeBetween(Window.unboundedPreceding, -days * DAY_MICROS - 1))
        return rows.select("*", F.when(at.isNotNull(), before - too_old).otherwise(F.lit(0)).alias(name))
    counted = rows.join(recent_totals(rows, team, time, days, name, row_key), list(row_key), "left")
    return counted.select(*rows.columns, F.coalesce(name, F.lit(0)).alias(name))


def recent_totals(rows: DataFrame, team: str, time: str, days: int, name: str, row_key: Sequence[str]) -> DataFrame:
    """The counts of ``count_recent`` by ``row_key``; a key without any is left out or null."""
    at = unix_micros(time)
    return totals_between(
        rows, rows, probe_id=row_key, key=(team, team), low=at - days * DAY_MICROS, high=at, time=at,
        name=name, bounded=False,
    )


def prior_within_days(
    rows: DataFrame, team: str, order: Sequence[str], days: Sequence[int], row_key: Sequence[str],
    name: str = "matches_last_{d}_days", bounded: bool = False,
) -> DataFrame:
    """Earlier rows (ties in ``order`` included) not older than ``days``."""
    at = unix_micros(order[0])
    if bounded:
        w = Window.partitionBy(team).orderBy(*order)
        by_time = Window.partitionBy(team).orderBy(at)
        return rows.select(
            "*",
            *[
                (
                    F.row_number().over(w) - 1
                    - F.count(at).over(by_time.rangeBetween(Window.unboundedPreceding, -d * DAY_MICROS - 1))
                ).cast("bigint").alias(name.format(d=d))
                for d in days
            ],
        )
    out = prior_count(rows, team, order, "_prior", bounded=False)
    for d in days:
        out = count_between(
            out, rows, probe_id=row_key, key=(team, team), low=F.lit(-(2**62)), high=at - d * DAY_MICROS,
            time=at, name=f"_old_{d}", bounded=False,
        )
    return out.select(
        *rows.columns, *[(F.col("_prior") - F.col(f"_old_{d}")).alias(name.format(d=d)) for d in days]
    )


def rolling_mismatches(
    rows: DataFrame, source: str, rolling: str, window: int, team: str = "team",
    order: Sequence[str] = ("kickoff_utc", "event_id"), tolerance: float = 1e-8,
) -> DataFrame:
    """Rows whose rolling value is not the mean of the earlier rows."""
    checked = over_recent(
        rows, [team], list(order), window, lambda frame, w: {"_expected": F.avg(_number(source)).over(frame(window))}
    )
    actual, expected = _number(rolling), F.col("_expected")
    off = F.abs(actual - expected) > tolerance + 1e-5 * F.abs(expected)
    return checked.where(
        (actual.isNull() != expected.isNull()) | F.coalesce(off, F.lit(False))
    )


def assert_rolling_excludes_current(rows: DataFrame, source: str, rolling: str, window: int, **kw) -> DataFrame:
    """Fail when a rolling column sees its own row."""
    if rolling_mismatches(rows, source, rolling, window, **kw).head(1):
        raise ValueError(f"{rolling} does not equal the shifted {source}")
    return rows
