"""Match rows, derived flags and the two-sided perspective."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import (
    KNOCKOUT_PATTERN,
    _col,
    classify_competition,
    normalize_country,
    nullable_flag,
)

SIDES = ("home", "away")


def win_draw_loss(left, right, labels=("win", "draw", "loss")) -> Column:
    """Three-way label of two scores, null unless both are known."""
    a, b = _col(left), _col(right)
    return F.when(a > b, labels[0]).when(a == b, labels[1]).when(a < b, labels[2])


def derive_match_fields(matches: DataFrame) -> DataFrame:
    """Own-country flags, neutral site, host flags and the 90-minute result.

    Expects ``home_team_name, away_team_name, venue_country, home_score_90,
    away_score_90``; every flag is null while the venue country is unknown.
    """
    venue = normalize_country("venue_country")
    home = F.coalesce(venue == normalize_country("home_team_name"), F.lit(False))
    away = F.coalesce(venue == normalize_country("away_team_name"), F.lit(False))
    known = venue.isNotNull()
    kept = [c for c in matches.columns if c not in {
        "home_team_playing_in_own_country", "away_team_playing_in_own_country",
        "neutral_site", "home_host_team", "away_host_team", "result_90"}]
    return matches.select(
        *kept,
        F.when(known, home.cast("int")).alias("home_team_playing_in_own_country"),
        F.when(known, away.cast("int")).alias("away_team_playing_in_own_country"),
        F.when(known, (~home & ~away).cast("int")).alias("neutral_site"),
        F.when(known, home.cast("int")).alias("home_host_team"),
        F.when(known, away.cast("int")).alias("away_host_team"),
        win_draw_loss("home_score_90", "away_score_90", ("home_win", "draw", "away_win")).alias("result_90"),
    )


def regulation_scores(matches: DataFrame) -> DataFrame:
    """Regulation scores, training eligibility and the advancing team."""
    home90 = F.col("home_score_90") if "home_score_90" in matches.columns else F.lit(None)
    away90 = F.col("away_score_90") if "away_score_90" in matches.columns else F.lit(None)
    home = F.coalesce(home90, F.col("home_score"))
    away = F.coalesce(away90, F.col("away_score"))
    eligible = (F.col("status_type") == "finished") & home.isNotNull() & away.isNotNull()
    advancing = F.when(F.col("home_score") > F.col("away_score"), F.col("home_team_id")).when(
        F.col("away_score") > F.col("home_score"), F.col("away_team_id")
    )
    return matches.select(
        "*",
        home.alias("home_score_regulation"),
        away.alias("away_score_regulation"),
        F.coalesce(eligible, F.lit(False)).alias("training_eligible"),
        advancing.alias("final_advancing_team_id"),
    )


def with_competition(matches: DataFrame) -> DataFrame:
    """Competition class of the unique tournament name, else the tournament name."""
    name = F.coalesce(F.col("unique_tournament_name"), F.col("tournament_name"))
    return matches.withColumn("competition_type", classify_competition(name))


def two_sided(
    matches: DataFrame,
    keep: Sequence[str],
    pairs: dict[str, tuple[str, str]],
) -> DataFrame:
    """One home row and one away row per match, in one scan.

    ``keep`` columns are repeated on both rows. ``pairs`` maps an output name to
    its (home, away) source columns; the own value is taken for the row's side.
    """
    def one(side: int) -> Column:
        return F.struct(
            F.lit(SIDES[side]).alias("side"),
            *[F.col(sources[side]).alias(name) for name, sources in pairs.items()],
            F.lit(1 - side).alias("is_home"),
            F.lit(side).alias("is_away"),
        )

    return matches.select(*keep, F.inline(F.array(one(0), one(1))))


TEAM_PAIRS = {
    "team_id": ("home_team_id", "away_team_id"),
    "opponent_id": ("away_team_id", "home_team_id"),
    "goals_for": ("home_score_regulation", "away_score_regulation"),
    "goals_against": ("away_score_regulation", "home_score_regulation"),
}


def with_result(rows: DataFrame) -> DataFrame:
    """Result, points, goal difference and scoring flags; null unless known."""
    gf, ga = F.col("goals_for"), F.col("goals_against")
    known = gf.isNotNull() & ga.isNotNull()
    if "training_eligible" in rows.columns:
        known = known & F.col("training_eligible")
    result = F.when(known, win_draw_loss(gf, ga))
    return rows.select(
        "*",
        result.alias("result"),
        F.when(result == "win", 3).when(result == "draw", 1).when(result == "loss", 0).alias("points"),
        (gf - ga).alias("goal_difference"),
        nullable_flag(gf > 0, known).alias("team_scored"),
        nullable_flag(ga > 0, known).alias("team_conceded"),
    )


def team_matches(matches: DataFrame, keep: Sequence[str], extra_pairs=None) -> DataFrame:
    """Canonical team-match fact: R1 followed by P13."""
    return with_result(two_sided(matches, keep, {**TEAM_PAIRS, **(extra_pairs or {})}))


def project_side(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Pick home or away columns by the row's ``side``."""
    own = F.col("side") == "home"
    picks = [
        F.when(own, F.col(home)).when(F.col("side") == "away", F.col(away)).alias(name)
        for name, (home, away) in pairs.items()
    ]
    return rows.select(
        "*",
        *picks,
        own.cast("int").alias("is_home"),
        (F.col("side") == "away").cast("int").alias("is_away"),
    )


def playable(rows: DataFrame) -> DataFrame:
    """Rows that take a place in match-count windows."""
    return rows.where(F.col("training_eligible") | (F.col("status_type") == "notstarted"))


def matchup(left, right, unknown: str = "UNK") -> Column:
    """``left_vs_right`` with a name for the unknown."""
    return F.concat(
        F.coalesce(_col(left), F.lit(unknown)), F.lit("_vs_"), F.coalesce(_col(right), F.lit(unknown))
    )


# Statistics whose presence marks advanced coverage.
ADVANCED_STATS = [
    "ALL_Expected goals",
    "ALL_Final third entries",
    "ALL_Touches in penalty area",
    "ALL_Big chances",
]


def _any_known(columns: Sequence[str]) -> Column:
    """True when any of the columns is non-null."""
    if not columns:
        return F.lit(False)
    known = F.lit(False)
    for name in columns:
        known = known | F.col(f"`{name}`").isNotNull()
    return known


def knockout_fields(rows: DataFrame) -> DataFrame:
    """Coverage flags, extra-time tri-state, 90-minute result, qualified team."""
    names = rows.columns
    all_stats = [c for c in names if c.startswith("ALL_")]
    extra_stats = [c for c in names if c.startswith(("ET1_", "ET2_"))]
    flags = {
        "has_xg": _any_known([c for c in names if c == "ALL_Expected goals"]),
        "has_advanced_stats": _any_known([c for c in ADVANCED_STATS if c in names]),
        "has_first_half_stats": _any_known([c for c in names if c.startswith("1ST_")]),
        "has_extra_time_stats": _any_known(extra_stats),
        "has_distance_data": _any_known([c for c in names if c == "ALL_Distance covered"]),
    }
    extra = F.when(_any_known(extra_stats), 1).when(_any_known(all_stats), 0)
    no_extra = extra == 0
    home90 = F.when(no_extra, F.col("home_score"))
    away90 = F.when(no_extra, F.col("away_score"))
    knockout = F.coalesce(F.lower("stage_name").rlike(KNOCKOUT_PATTERN), F.lit(False))
    winner = F.when(F.col("home_score") > F.col("away_score"), F.col("home_team")).when(
        F.col("away_score") > F.col("home_score"), F.col("away_team")
    )
    return rows.select(
        "*",
        *[c.cast("int").alias(n) for n, c in flags.items()],
        extra.alias("went_to_extra_time"),
        home90.alias("home_score_90"),
        away90.alias("away_score_90"),
        F.when(extra == 1, "draw")
        .otherwise(win_draw_loss(home90, away90, ("home_win", "draw", "away_win")))
        .alias("result_90"),
        F.when(knockout, winner).alias("qualified_team"),
    )
