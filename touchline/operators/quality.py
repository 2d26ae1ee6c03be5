"""Data-quality rules as aggregates (Q1-Q11)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.joins import duplicate_keys
from touchline.operators.reshape import off_balance


class DataQualityError(ValueError):
    """Rows violate a rule that has to hold."""


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class RowRule:
    """A rule on single rows: ``bad`` is true for a violating row."""

    name: str
    bad: Column


@dataclass(frozen=True)
class KeyRule:
    """A rule that ``keys`` identify a row."""

    name: str
    keys: tuple[str, ...]


def not_null(column: str) -> RowRule:
    return RowRule(f"{column} contains nulls", _q(column).isNull())


def accepted(column: str, values: Sequence) -> RowRule:
    return RowRule(
        f"{column} contains other values than {'/'.join(map(str, values))}",
        ~F.coalesce(_q(column).isin(*values), F.lit(False)),
    )


def not_negative(column: str) -> RowRule:
    return RowRule(f"{column} contains negative values", _q(column) < 0)


def within(column: str, low: float, high: float) -> RowRule:
    return RowRule(f"{column} is outside [{low}, {high}]", ~_q(column).between(low, high))


def unique(*keys: str) -> KeyRule:
    return KeyRule(f"{' + '.join(keys)} is not unique", keys)


def violations(df: DataFrame, rules: Sequence[RowRule | KeyRule]) -> DataFrame:
    """Q1-Q3, Q5, Q7: one row per rule with the number of violating rows.

    All row rules share one pass; a key rule counts the surplus rows of its
    keys after a map-side combine.
    """
    row_rules = [r for r in rules if isinstance(r, RowRule)]
    parts = []
    if row_rules:
        counted = df.agg(
            *[F.count_if(F.coalesce(r.bad, F.lit(False))).alias(f"r{i}") for i, r in enumerate(row_rules)]
        )
        pairs = [F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, r in enumerate(row_rules)]
        parts.append(counted.select(F.inline(F.array(*pairs))))
    for rule in rules:
        if isinstance(rule, KeyRule):
            parts.append(
                duplicate_keys(df, rule.keys).agg(
                    F.coalesce(F.sum(F.col("row_count") - 1), F.lit(0)).alias("violations")
                ).select(F.lit(rule.name).alias("rule"), "violations")
            )
    return reduce(DataFrame.unionByName, parts)


def enforce(df: DataFrame, rules: Sequence[RowRule | KeyRule]) -> DataFrame:
    """Fail with every broken rule in one message, else return ``df``."""
    broken = [r["rule"] for r in violations(df, rules).where("violations > 0").collect()]
    if broken:
        raise DataQualityError("; ".join(broken))
    return df


def team_event_rules(today: Column, team: str = "registry_team_id") -> list:
    """Q1: keys known and unique, no future date unless the event is scheduled."""
    future = (F.col("match_date") > today) & ~F.coalesce(F.col("status_type") == "notstarted", F.lit(False))
    return [
        not_null("event_id"),
        unique(team, "event_id"),
        RowRule("non-scheduled event has a future match date", future),
    ]


def match_rules() -> list:
    """Q2: unique events with non-negative scores."""
    return [not_null("event_id"), unique("event_id"), not_negative("home_score"), not_negative("away_score")]


def team_stat_rules(columns: Sequence[str]) -> list:
    """Q3: unique (event, side), known sides, percentages inside [0, 1]."""
    percents = [c for c in columns if c.endswith("_pct") or "possession" in c.lower()]
    return [unique("event_id", "side"), accepted("side", ["home", "away"]), *[within(c, 0, 1) for c in percents]]


def unbalanced_pairs(wide: DataFrame, column: str, key: str = "event_id") -> DataFrame:
    """Q3: events whose two possession shares do not sum to about 1."""
    pairs = wide.groupBy(key).pivot("side", ["home", "away"]).agg(F.first(_q(column), ignorenulls=True))
    return pairs.where(off_balance(F.col("home") + F.col("away")))


def validate_team_stats(wide: DataFrame, possession: str = "ALL_Ball possession") -> DataFrame:
    """Q3: all team-statistics rules, strict."""
    problems = [r["rule"] for r in violations(wide, team_stat_rules(wide.columns)).where("violations > 0").collect()]
    if possession in wide.columns and unbalanced_pairs(wide, possession).head(1):
        problems.append("home and away possession do not sum to ~1")
    if problems:
        raise DataQualityError("; ".join(problems))
    return wide


def unexpected_values(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Q9: distinct offending values."""
    return df.where(~F.coalesce(_q(column).isin(*allowed), F.lit(False))).select(column).distinct()


def registry_rules(required: Sequence[str]) -> list:
    """Q7: required fields filled, ids and codes unique."""
    return [*[not_null(c) for c in required], unique("team_id"), unique("fifa_code")]


def grain_parity(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q8: row and key counts of two builds and keys found in one of them only."""
    tagged = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    per_key = tagged.groupBy(*keys).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    return per_key.agg(
        F.sum("l").alias("left_rows"),
        F.sum("r").alias("right_rows"),
        F.count_if(F.col("l") > 0).alias("left_keys"),
        F.count_if(F.col("r") > 0).alias("right_keys"),
        F.count_if((F.col("l") > 0) != (F.col("r") > 0)).alias("unmatched_keys"),
    )


def stage_mass(probabilities: DataFrame, expected: dict[str, float], tolerance: float = 1e-9) -> DataFrame:
    """Q10: total probability per stage against the number of places."""
    totals = probabilities.agg(*[F.sum(_q(c)).alias(c) for c in expected])
    rows = [
        F.struct(
            F.lit(c).alias("stage"), _q(c).alias("total"), F.lit(float(e)).alias("expected"),
            (F.abs(_q(c) - float(e)) <= tolerance).alias("reconciles"),
        )
        for c, e in expected.items()
    ]
    return totals.select(F.inline(F.array(*rows)))


def monotone(ordered_columns: Sequence[str]) -> RowRule:
    """Q11: over-probabilities must not rise with the line."""
    pairs = zip(ordered_columns, ordered_columns[1:])
    return RowRule("over lines are not monotone", reduce(lambda a, b: a | b, [_q(hi) > _q(lo) for lo, hi in pairs]))


def sums_to_one(columns: Sequence[str], tolerance: float = 1e-9) -> RowRule:
    """Q11: probabilities of one row must add up to 1."""
    total = reduce(lambda a, b: a + b, [_q(c) for c in columns])
    return RowRule("probabilities do not sum to 1", F.abs(total - 1.0) > tolerance)
