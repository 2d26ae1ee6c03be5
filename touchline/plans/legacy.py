"""Single-team exploratory feature set over enriched rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import (
    COMPETITION_IMPORTANCE,
    COUNTRY_ALIASES_LEGACY,
    attach_host_flags,
    classify_competition_legacy,
    infer_stage,
    lookup,
    normalize_country,
    nullable_equal,
    to_number,
)
from touchline.operators.ewm import ewm_features
from touchline.operators.history import prior_count, prior_within_days, rolling_features, whole_day_gap
from touchline.operators.joins import require_unique, with_opponent
from touchline.operators.ordered import SLICE, cut
from touchline.operators.perspective import knockout_fields, matchup
from touchline.operators.sets import present, require_columns
from touchline.plans.features import readable_aliases

# The input contract and the statistics used as form.
REQUIRED_COLUMNS = [
    "event_id",
    "date",
    "team",
    "opponent",
    "side",
    "home_team",
    "away_team",
    "home_score",
    "away_score",
    "venue_country",
]
AGAINST_STATS = [
    "ALL_Total shots",
    "ALL_Shots on target",
    "ALL_Corner kicks",
    "ALL_Expected goals",
    "ALL_Touches in penalty area",
]
FORM_STATS = [
    "ALL_Total shots",
    "ALL_Shots on target",
    "ALL_Corner kicks",
    "ALL_Ball possession",
    "ALL_Passes",
    "ALL_Accurate passes",
    "ALL_Final third entries",
    "ALL_Touches in penalty area",
    "ALL_Expected goals",
    "ALL_Big chances",
    "ALL_Clearances",
    "ALL_Interceptions",
    "ALL_Recoveries",
    "ALL_Goalkeeper saves",
    "goals_for",
    "goals_against",
    "goal_diff",
]
REST_COLUMNS = ["days_since_last_match", "matches_last_30_days", "matches_last_90_days"]
ORDER = ["date", "event_id"]
TEAM = {"team": "team", "opponent": "opponent"}


def context_features(
    rows: DataFrame, confederations: DataFrame, hosts: DataFrame, bounded: bool = False
) -> DataFrame:
    """Rest, congestion, countries, confederations, competition, stage and host flags."""
    out = prior_count(rows, "team", ORDER, "prior_matches_count", upto=(5, 10), bounded=bounded)
    out = whole_day_gap(out, "team", ORDER, bounded=bounded)
    out = prior_within_days(out, "team", ORDER, (30, 90), ["event_id", "team"], bounded=bounded)
    out = with_opponent(out, REST_COLUMNS, **TEAM)
    for side in ("team", "opponent"):
        names = confederations.select(F.col("team").alias("_name"), F.col("confederation").alias(f"{side}_confederation"))
        out = out.join(names, F.col(side) == F.col("_name"), "left").drop("_name")
    def text(name):
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    kind = classify_competition_legacy(text("tournament"), text("unique_tournament"), text("season"))
    out = out.select(
        *[F.col(f"`{c}`") for c in out.columns],
        (F.col("days_since_last_match") - F.col("opponent_days_since_last_match")).alias("rest_difference"),
        *[
            normalize_country(c, COUNTRY_ALIASES_LEGACY).alias(n)
            for c, n in (
                ("team", "team_country_normalized"), ("opponent", "opponent_country_normalized"),
                ("venue_country", "venue_country_normalized"),
            )
        ],
        nullable_equal("team_confederation", "opponent_confederation").alias("same_confederation"),
        matchup("team_confederation", "opponent_confederation", "Unknown").alias("confederation_matchup"),
        F.coalesce(text("unique_tournament"), text("tournament")).alias("competition_name"),
        kind.alias("competition_type"),
        lookup(kind, COMPETITION_IMPORTANCE).alias("competition_importance"),
        text("season").alias("season_name"),
        infer_stage(text("round_name"), text("tournament")).alias("stage_name"),
        to_number(text("round")).alias("round_number"),
    )
    out = out.select(
        "*",
        nullable_equal("team_country_normalized", "venue_country_normalized").alias("team_playing_in_own_country"),
        nullable_equal("opponent_country_normalized", "venue_country_normalized").alias("opponent_playing_in_own_country"),
    )
    return attach_host_flags(
        out, hosts, competition="competition_type", year=F.year("date"),
        countries={
            "team_is_host_country": "team_country_normalized", "opponent_is_host_country": "opponent_country_normalized"
        },
    )


def lagged_features(rows: DataFrame, bounded: bool = False) -> tuple[DataFrame, list[str]]:
    """Counts, means, spread, trends and weighted means of earlier matches."""
    statistics = [c for c in rows.columns if c.startswith("ALL_") and not c.endswith("_against")]
    against = [f"{c}_against" for c in AGAINST_STATS if f"{c}_against" in rows.columns]
    goals = present(rows, ["goals_for", "goals_against", "goal_diff"])
    form = present(rows, [*FORM_STATS, *against])
    before = {*rows.columns, SLICE}
    rows = rows if bounded else cut(rows, ["team"], ORDER)
    counted = list(dict.fromkeys([*statistics, *goals, *against]))
    means = list(dict.fromkeys([*statistics, *goals, *against]))
    out = rolling_features(
        rows, counted, team="team", order=ORDER, means=(), counts=(5, 10), spread=None, trend=None, rest=None, bounded=bounded
    )
    out = rolling_features(
        out, means, team="team", order=ORDER, means=(5, 10), spread=None, trend=None, rest=None, bounded=bounded
    )
    out = rolling_features(
        out, form, team="team", order=ORDER, means=(), spread=5, trend=(5, 10), trend_name="trend_{c}_{a}_vs_{b}",
        rest=None, bounded=bounded,
    )
    out = ewm_features(out, form, team="team", order=ORDER, row_key=["event_id", "team"], bounded=bounded)
    out = out.drop(SLICE)
    return out, [c for c in out.columns if c not in before]


def advanced_features(
    rows: DataFrame, confederations: DataFrame, hosts: DataFrame, ratings: DataFrame | None = None, bounded: bool = False
) -> DataFrame:
    """The whole feature set; two rows per match, checked for its columns and keys.

    ``ratings`` are finished rating columns per (event_id, team).
    """
    require_columns(rows, REQUIRED_COLUMNS)
    require_unique(rows, ["event_id", "team"], "input")
    out = context_features(rows, confederations, hosts, bounded)
    out = knockout_fields(out)
    if ratings is not None:
        out = out.join(ratings, ["event_id", "team"], "left")
    stats: Sequence[str] = present(out, AGAINST_STATS)
    if stats:
        out = with_opponent(out, stats, lambda c: f"{c}_against", **TEAM)
    out, generated = lagged_features(out, bounded)
    return readable_aliases(with_opponent(out, generated, **TEAM))
