"""Marts and tests of the warehouse layer (A20, Q5, Q6); ``graph.py`` runs them as models."""

from __future__ import annotations

from pyspark.sql import DataFrame

from touchline.operators.joins import with_opponent, without_exceptions
from touchline.operators.quality import accepted, not_null, unique

EVENT_DETAILS = [
    "event_id",
    "venue_id",
    "venue_name",
    "venue_city",
    "venue_country",
    "venue_latitude",
    "venue_longitude",
    "venue_capacity",
]
RANKINGS = ["event_id", "home_team_id", "away_team_id", "home_displayed_ranking", "away_displayed_ranking"]
COMPETITION_COLUMNS = [
    "unique_tournament_id",
    "unique_tournament_name",
    "tournament_id",
    "tournament_name",
    "competition_type",
]
VENUE_COLUMNS = [c for c in EVENT_DETAILS if c != "event_id"]
AGAINST_COLUMNS = {
    "ALL_Total shots": "against_total_shots",
    "ALL_Shots on target": "against_shots_on_target",
    "ALL_Corner kicks": "against_corner_kicks",
}


def distinct_dimension(events: DataFrame, columns, required: str | None = None) -> DataFrame:
    """Distinct attribute rows, optionally only where a key is known."""
    rows = events.select(*columns)
    return (rows if required is None else rows.where(rows[required].isNotNull())).distinct()


def dim_competitions(events: DataFrame) -> DataFrame:
    return distinct_dimension(events, COMPETITION_COLUMNS)


def dim_venues(details: DataFrame) -> DataFrame:
    return distinct_dimension(details, VENUE_COLUMNS, "venue_id")


def stats_for_against(stats: DataFrame, columns: dict[str, str] = AGAINST_COLUMNS) -> DataFrame:
    """Statistics with the opponent's figures of the same event."""
    return with_opponent(stats, list(columns), lambda c: columns[c])


def match_context(matches: DataFrame) -> DataFrame:
    """Context columns and the ranking difference."""
    return matches.selectExpr(
        "event_id", "kickoff_utc", "home_team_id", "away_team_id", "neutral_site", "competition_type",
        "round_name", "home_displayed_ranking - away_displayed_ranking as ranking_difference",
    )


def finished_without_score(matches: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Q6: finished matches without a score that are not listed exceptions."""
    broken = matches.where("status_type = 'finished' and (home_score is null or away_score is null)")
    return without_exceptions(broken, exceptions, "event_id", "finished_missing_score")


def grain_rules(model: str) -> list:
    """Q5: grain and domain tests per mart."""
    if model == "fct_matches":
        return [not_null("event_id"), unique("event_id")]
    if model in {"fct_team_matches", "fct_team_match_stats"}:
        return [not_null("event_id"), accepted("side", ["home", "away"]), unique("event_id", "side")]
    if model == "dim_teams":
        return [not_null("team_id"), unique("team_id")]
    raise ValueError(f"no tests are declared for {model}")
