"""Sequential ratings of entities.

Every update depends on both sides' latest ratings, so a pool of connected
entities is one chain: pools run in parallel, a pool runs in order in one task.
The caller names the pool and thereby says that each one fits a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import COUNTRY_ALIASES_LEGACY, RATING_IMPORTANCE, lookup, normalize_country

# Fixed values of the rating models.
INITIAL_RATING = 1500.0
HOME_ADVANTAGE = 55.0
DEFAULT_IMPORTANCE = 20
LEGACY_K, LEGACY_ADVANTAGE = 20.0, 60.0

FOLDED = (
    "pool string, event_id bigint, home_pre double, away_pre double, expected_home double, "
    "delta double, home_change_before double, away_change_before double"
)


def _fold(initial: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Ordered update of one pool."""

    def run(matches: pd.DataFrame) -> pd.DataFrame:
        matches = matches.sort_values(["kickoff", "event_id"], kind="stable")
        ratings: dict = {}
        changes: dict = {}
        n = len(matches)
        out = np.full((n, 6), np.nan)
        source = zip(
            matches["home"].to_numpy(), matches["away"].to_numpy(), matches["advantage"].to_numpy(),
            matches["k"].to_numpy("float64"), matches["actual"].to_numpy("float64"),
        )
        for i, (home, away, advantage, k, actual) in enumerate(source):
            hp, ap = ratings.get(home, initial), ratings.get(away, initial)
            expected = 1.0 / (1.0 + 10.0 ** ((ap - hp - advantage) / 400.0))
            out[i, 0], out[i, 1], out[i, 2] = hp, ap, expected
            out[i, 4], out[i, 5] = changes.get(home, np.nan), changes.get(away, np.nan)
            if k == k:  # a null k marks a match that does not count
                delta = k * (actual - expected)
                out[i, 3] = delta
                ratings[home], ratings[away] = hp + delta, ap - delta
                changes[home], changes[away] = delta, -delta
        result = matches[["pool", "event_id"]].reset_index(drop=True)
        names = ["home_pre", "away_pre", "expected_home", "delta", "home_change_before", "away_change_before"]
        return pd.concat([result, pd.DataFrame(out, columns=names)], axis=1)

    return run


def fold_ratings(prepared: DataFrame, initial: float = INITIAL_RATING) -> DataFrame:
    """Fold ``(pool, event_id, kickoff, home, away, advantage, k, actual)`` in order."""
    return prepared.groupBy("pool").applyInPandas(_fold(initial), FOLDED)


def _actual(home: Column, away: Column) -> Column:
    return F.when(home > away, 1.0).when(home == away, 0.5).otherwise(0.0)


def elo_history(
    matches: DataFrame,
    *,
    pool: Column,
    initial: float = INITIAL_RATING,
    home_advantage: float = HOME_ADVANTAGE,
) -> DataFrame:
    """Ratings before and after every match, two rows per match.

    Expects the canonical match columns. The step size is the competition's
    importance times a margin factor; matches that are not eligible leave the
    ratings as they are.
    """
    home, away = F.col("home_score_regulation"), F.col("away_score_regulation")
    gap = F.abs(home - away).cast("double")
    margin = F.when(gap <= 1, 1.0).when(gap == 2, 1.5).otherwise((gap + 11) / 8)
    importance = lookup("competition_type", RATING_IMPORTANCE, F.lit(DEFAULT_IMPORTANCE))
    prepared = matches.select(
        pool.cast("string").alias("pool"),
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("kickoff_utc").alias("kickoff"),
        F.col("home_team_id").cast("string").alias("home"),
        F.col("away_team_id").cast("string").alias("away"),
        F.when(F.col("neutral_site") != 0, 0.0).otherwise(home_advantage).alias("advantage"),
        F.when(F.col("training_eligible"), importance * margin).alias("k"),
        _actual(home, away).alias("actual"),
    )
    folded = fold_ratings(prepared, initial).drop("pool")
    ids = matches.select("event_id", "home_team_id", "away_team_id")
    delta = F.coalesce("delta", F.lit(0.0))

    def side(name: str, me: str, other: str, sign: int, expected: Column) -> Column:
        return F.struct(
            F.lit(name).alias("side"),
            F.col(f"{me}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("opponent_id"),
            F.col(f"{me}_pre").alias("elo_pre"),
            F.col(f"{other}_pre").alias("opponent_elo_pre"),
            (F.col(f"{me}_pre") + delta * sign).alias("elo_post"),
            expected.alias("elo_expected_score"),
            (F.col(f"{me}_pre") - F.col(f"{other}_pre")).alias("elo_difference"),
        )

    expected = F.col("expected_home")
    return ids.join(folded, "event_id").select(
        "event_id",
        F.inline(F.array(side("home", "home", "away", 1, expected), side("away", "away", "home", -1, 1 - expected))),
    )


def elo_legacy(
    rows: DataFrame,
    *,
    pool: Column,
    initial: float = INITIAL_RATING,
    k: float = LEGACY_K,
) -> DataFrame:
    """Constant step, advantage by venue country, previous rating changes.

    ``rows`` has one or two rows per match with ``event_id, date, side,
    home_team, away_team, home_score, away_score, venue_country_normalized``.
    """
    matches = rows.select(
        pool.cast("string").alias("pool"), "event_id", "date", "home_team", "away_team", "home_score", "away_score",
        "venue_country_normalized",
    ).dropDuplicates(["event_id"])
    venue = F.col("venue_country_normalized")
    home, away = F.col("home_score"), F.col("away_score")
    at_home = venue == normalize_country("home_team", COUNTRY_ALIASES_LEGACY)
    at_away = venue == normalize_country("away_team", COUNTRY_ALIASES_LEGACY)
    prepared = matches.select(
        "pool",
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("date").cast("timestamp").alias("kickoff"),
        F.col("home_team").alias("home"),
        F.col("away_team").alias("away"),
        F.when(at_home, LEGACY_ADVANTAGE).when(at_away, -LEGACY_ADVANTAGE).otherwise(0.0).alias("advantage"),
        F.when(home.isNotNull() & away.isNotNull(), F.lit(k)).alias("k"),
        _actual(home, away).alias("actual"),
    )
    folded = fold_ratings(prepared, initial).drop("pool")
    own = F.col("side") == "home"

    def pick(home_name: str, away_name: str) -> Column:
        return F.when(own, F.col(home_name)).otherwise(F.col(away_name))

    joined = rows.join(folded, "event_id", "left")
    team, other = pick("home_pre", "away_pre"), pick("away_pre", "home_pre")
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        team.alias("team_elo_pre"),
        other.alias("opponent_elo_pre"),
        (team - other).alias("elo_difference"),
        pick("home_change_before", "away_change_before").alias("team_elo_change_previous_match"),
        pick("away_change_before", "home_change_before").alias("opponent_elo_change_previous_match"),
    )
