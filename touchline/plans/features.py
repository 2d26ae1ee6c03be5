"""Canonical facts to the leakage-safe feature master."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.ewm import ewm_features
from touchline.operators.history import count_recent, prior_count, recent_totals, rolling_features
from touchline.operators.joins import checked_join, with_opponent
from touchline.operators.ordered import SLICE, cut
from touchline.operators.passes import history_features
from touchline.operators.perspective import matchup, playable
from touchline.operators.sets import by_prefix, present
from touchline.session import cut_lineage

# Columns of the exported marts.
CONTEXT_COLUMNS = [
    "event_id",
    "kickoff_utc",
    "team_id",
    "opponent_id",
    "side",
    "is_home",
    "competition_type",
    "round_name",
    "neutral_site",
    "elo_pre",
    "opponent_elo_pre",
    "elo_difference",
    "ranking_difference",
    "rest_days",
    "fixture_congestion_14d",
    "confederation_matchup",
    "prior_match_count",
    "prior_advanced_stats_count_10",
]
TARGET_COLUMNS = [
    "event_id",
    "team_id",
    "side",
    "result",
    "goals_for",
    "goals_against",
    "goal_difference",
    "training_eligible",
]
FEATURE_PREFIXES = ["rolling_", "opponent_rolling_", "ewm_", "trend_"]
MART_NAMES = [
    "feat_match_outcome",
    "feat_scoreline",
    "feat_goal_markets",
    "feat_team_shots",
    "feat_team_corners",
]
ELO_COLUMNS = [
    "event_id",
    "kickoff_utc",
    "team_id",
    "opponent_id",
    "side",
    "elo_pre",
    "opponent_elo_pre",
    "elo_post",
    "elo_expected_score",
    "elo_difference",
]
READABLE_STATS = {
    "shots": "ALL_Total shots",
    "shots_on_target": "ALL_Shots on target",
    "corners": "ALL_Corner kicks",
    "xg": "ALL_Expected goals",
    "penalty_area_touches": "ALL_Touches in penalty area",
}
MODEL_FEATURES_LEGACY = [
    "team_elo_pre",
    "opponent_elo_pre",
    "elo_difference",
    "team_elo_change_previous_match",
    "is_home",
    "neutral_site",
    "team_is_host_country",
    "opponent_is_host_country",
    "team_playing_in_own_country",
    "opponent_playing_in_own_country",
    "team_confederation",
    "opponent_confederation",
    "same_confederation",
    "competition_type",
    "competition_importance",
    "stage_name",
    "prior_matches_count",
    "rolling_matches_available_5",
    "days_since_last_match",
    "opponent_days_since_last_match",
    "rest_difference",
    "matches_last_30_days",
    "opponent_matches_last_30_days",
    "rolling_ALL_Total shots_count_5",
    "rolling_ALL_Expected goals_count_5",
    "rolling_goals_for_5",
    "rolling_goals_for_10",
    "rolling_goals_against_5",
    "rolling_goals_against_10",
    "rolling_goal_diff_5",
    "opponent_rolling_goals_for_5",
    "opponent_rolling_goals_against_5",
    "rolling_shots_for_5",
    "rolling_shots_against_5",
    "opponent_rolling_shots_for_5",
    "opponent_rolling_shots_against_5",
    "rolling_shots_on_target_for_5",
    "rolling_shots_on_target_against_5",
    "rolling_corners_for_5",
    "rolling_corners_against_5",
    "rolling_xg_for_5",
    "rolling_xg_against_5",
    "rolling_penalty_area_touches_for_5",
    "rolling_penalty_area_touches_against_5",
    "rolling_ALL_Ball possession_5",
    "rolling_ALL_Final third entries_5",
    "rolling_ALL_Recoveries_5",
    "ewm_ALL_Total shots_5",
    "rolling_std_ALL_Total shots_5",
    "trend_ALL_Total shots_5_vs_10",
]
TARGETS_LEGACY = [
    "event_id",
    "date",
    "team",
    "opponent",
    "home_score",
    "away_score",
    "goals_for",
    "goals_against",
    "result",
    "points",
    "goal_diff",
    "team_scored",
    "team_conceded",
    "result_90",
    "qualified_team",
]


def feature_master(
    team_rows: DataFrame,
    matches: DataFrame,
    stats: DataFrame | None = None,
    *,
    ratings: DataFrame | None = None,
    with_ewm: bool = True,
    bounded: bool = False,
    finish: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Gold table: one row per (event, side) with features of earlier rows only.

    Statistics columns start with ``ALL_``. Both sides' histories use one sort
    per team; the opponent's features come from one self join on the event. With
    weighted means, all columns over a team's history come from one pass. ``finish``
    makes the final form of a history column, once, before the opponent gets it.
    """
    base = team_rows
    stat_columns: list[str] = []
    if stats is not None:
        extra = [c for c in stats.columns if c not in {"team_id", "opponent_id"}]
        stat_columns = [c for c in extra if c.startswith("ALL_")]
        wide = cut_lineage(stats.select(*[F.col(f"`{c}`") for c in extra]))  # the check and the join read it
        base = checked_join(base, wide, ["event_id", "side"])
    if ratings is not None:
        base = base.join(ratings, ["event_id", "team_id", "opponent_id", "side"], "left")
    asked, base = playable(team_rows if ratings is None else base), playable(base)  # the same rows, the first without statistics
    whole = with_ewm and not bounded
    recent, row_key = "fixture_congestion_14d", ["event_id", "side"]
    if whole:  # joined while rows are narrow
        counted = base.join(recent_totals(asked, "team_id", "kickoff_utc", 14, recent, row_key), row_key, "left")
        base = counted.select(*[F.col(f"`{c}`") for c in base.columns], F.coalesce(recent, F.lit(0)).alias(recent))
    if "team_displayed_ranking" in base.columns:
        base = base.withColumn(
            "ranking_difference", F.col("team_displayed_ranking") - F.col("opponent_displayed_ranking")
        )
    if "team_confederation" in base.columns:
        base = base.withColumn("confederation_matchup", matchup("team_confederation", "opponent_confederation"))
    sources = [*present(base, ["goals_for", "goals_against", "goal_difference"]), *stat_columns]
    if stat_columns:
        base = with_opponent(base, stat_columns, lambda c: f"against_{c}", paired=True)
        sources += [f"against_{c}" for c in stat_columns]
    flagged = base if "has_statistics" in base.columns else base.withColumn("has_statistics", F.lit(False))
    order = ["kickoff_utc", "event_id"]
    if whole:  # both sides of an event may be of the unknown team: the home side comes first, wherever joins dealt the rows
        order += present(flagged, ["is_away"])
    ready = flagged if bounded else cut(flagged, ["team_id"], order)  # one cut for all steps over a team's history
    advanced = {"prior_advanced_stats_count_10": ("has_statistics", 10)}
    if whole:
        out = history_features(ready, sources, order=order, flags=advanced)
        last = [recent, *(c for c in out.columns if c.startswith("ewm_") and c not in ready.columns)]
        out = out.select(*[F.col(f"`{c}`") for c in [*(c for c in out.columns if c not in last), *last]])
    else:
        out = rolling_features(ready, sources, order=order, bounded=bounded, flags=advanced)
        out = prior_count(out, "team_id", order, bounded=bounded)
        out = count_recent(out, "team_id", "kickoff_utc", 14, recent, row_key, bounded)
        if with_ewm:
            out = ewm_features(out, sources, order=order, bounded=bounded)
    shared = [c for c in out.columns if c.startswith(("rolling_", "ewm_", "trend_"))]
    out = out.drop(SLICE)
    if finish is not None:
        out = out.select(*[finish(c).alias(c) if c in shared else F.col(f"`{c}`") for c in out.columns])
    return with_opponent(out, shared, paired=True)


def leakage_safe(master: DataFrame, targets: bool = False) -> DataFrame:
    """Context and history columns of the master, with the targets if asked."""
    also = [*CONTEXT_COLUMNS, *(TARGET_COLUMNS if targets else [])]
    return by_prefix(master, FEATURE_PREFIXES, also)


def marts(master: DataFrame) -> dict[str, Sequence[str]]:
    """Column lists of the five feature marts and the rating history."""
    columns = leakage_safe(master, targets=True).columns
    return {**{name: columns for name in MART_NAMES}, "team_elo_history": present(master, ELO_COLUMNS)}


def readable_aliases(df: DataFrame, windows=(5, 10)) -> DataFrame:
    """Short for/against names of the common statistics, where present."""
    added = []
    for label, source in READABLE_STATS.items():
        for n in windows:
            for prefix in ("", "opponent_"):
                for kind, column in (
                    ("for", f"{prefix}rolling_{source}_{n}"),
                    ("against", f"{prefix}rolling_{source}_against_{n}"),
                ):
                    if column in df.columns:
                        added.append(F.col(f"`{column}`").alias(f"{prefix}rolling_{label}_{kind}_{n}"))
    return df.select(*[F.col(f"`{c}`") for c in df.columns], *added)


def model_features_legacy(df: DataFrame) -> DataFrame:
    """Identifiers and the model columns that exist."""
    names = ["event_id", "date", "team", "opponent", *present(df, MODEL_FEATURES_LEGACY)]
    return df.select(*[F.col(f"`{c}`") for c in names])


def targets_legacy(df: DataFrame) -> DataFrame:
    """P20: target columns that exist."""
    return df.select(*present(df, TARGETS_LEGACY))
