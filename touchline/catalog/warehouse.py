"""The warehouse models as views and catalog tables over the given tables, read back through SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.catalog.base import MT, TM, matches, query, team_rows
from touchline.plans.graph import run_models, upstream, warehouse_models
from touchline.session import fresh_path


def sources(spark, sf):
    e, home, away = F.col("event_id"), F.col("home_team_id"), F.col("away_team_id")
    venue = F.when(e % 7 != 0, e % 20)
    events = matches(spark, sf).select(
        "*", venue.alias("venue_id"), F.concat(F.lit("Venue "), venue.cast("string")).alias("venue_name"),
        F.concat(F.lit("City "), (venue % 6).cast("string")).alias("venue_city"),
        F.concat(F.lit("Country "), (venue % 3).cast("string")).alias("venue_country"),
        (venue * 1.5).cast("double").alias("venue_latitude"), (venue * -2.5).cast("double").alias("venue_longitude"),
        (venue * 1000).alias("venue_capacity"), (home * 2).alias("home_displayed_ranking"), away.alias("away_displayed_ranking"),
        F.lit(None).cast("bigint").alias("unique_tournament_id"), F.length("tournament_name").alias("tournament_id"),
    )
    rows = team_rows(spark, sf)
    statistics = rows.select(
        "event_id", "side", "team_id", "opponent_id",
        F.when(e % 5 != 0, F.col("goals_for") * 3 + 2).alias("ALL_Total shots"),
        (F.col("goals_for") + 1).alias("ALL_Shots on target"),
        (e % 11 + F.col("is_home")).alias("ALL_Corner kicks"),
    )
    teams = rows.select("team_id").distinct().withColumn("team_name", F.concat(F.lit("Team "), F.col("team_id").cast("string")))
    return {"raw.fct_matches": events, "raw.fct_team_matches": rows, "raw.fct_team_match_stats": statistics, "raw.dim_teams": teams}


def published(spark, sf, *names: str) -> str:
    """A schema of its own in the shared folder with the named models over the given tables and what they need."""
    schema = f"touchline_{uuid.uuid4().hex}"
    spark.sql(f"create schema {schema} location '{fresh_path(spark, 'warehouse')}'")
    run_models(spark, upstream(warehouse_models(), names), sources(spark, sf), schema)
    return schema


@query(
    "marts_sql",
    f"""with {TM} select team_id, count(*) as matches, cast(sum(points) as bigint) as points from tm group by 1""",
)
def marts_sql(spark, sf):
    """Marts read through SQL from the catalog."""
    schema = published(spark, sf, "fct_team_matches", "dim_teams")
    return spark.sql(
        f"""select team_id, count(*) as matches, sum(points) as points
        from {schema}.fct_team_matches join {schema}.dim_teams using (team_id) group by team_id"""
    )


@query(
    "mart_team_stats",
    f"""with {TM}, st as (select event_id, side, team_id, opponent_id,
        case when event_id % 5 <> 0 then goals_for * 3 + 2 end as shots, goals_for + 1 as target,
        event_id % 11 + is_home as corners from tm)
    select a.event_id, a.side, a.team_id, a.shots as total_shots, b.shots as against_total_shots,
      b.target as against_shots_on_target, b.corners as against_corner_kicks
    from st a left join st b on a.event_id = b.event_id and a.opponent_id = b.team_id""",
)
def mart_team_stats(spark, sf):
    schema = published(spark, sf, "fct_team_match_stats")
    return spark.sql(
        f"""select event_id, side, team_id, `ALL_Total shots` as total_shots, against_total_shots,
          against_shots_on_target, against_corner_kicks from {schema}.fct_team_match_stats"""
    )


@query(
    "mart_dimensions",
    f"""with {MT}, v as (select *, case when event_id % 7 <> 0 then event_id % 20 end as venue_id from mt)
    select 'venue' as dimension, cast(venue_id as varchar) as id, 'City ' || cast(venue_id % 6 as varchar) as label,
      count(*) as matches, cast(sum(home_team_id * 2 - away_team_id) as bigint) as ranking_difference
    from v where venue_id is not null group by venue_id
    union all select 'competition', cast(length(tournament_name) as varchar), competition_type, count(*),
      cast(sum(home_team_id * 2 - away_team_id) as bigint) from mt group by tournament_name, competition_type""",
)
def mart_dimensions(spark, sf):
    """Venues and competitions with their matches and the context features of these."""
    s = published(spark, sf, "dim_venues", "dim_competitions", "feat_match_context")
    return spark.sql(
        f"""select 'venue' as dimension, cast(venue_id as string) as id, d.venue_city as label, count(*) as matches,
          sum(ranking_difference) as ranking_difference
        from {s}.dim_venues d join {s}.fct_matches m using (venue_id) join {s}.feat_match_context c using (event_id)
        group by venue_id, d.venue_city
        union all
        select 'competition', cast(d.tournament_id as string), d.competition_type, count(*), sum(ranking_difference)
        from {s}.dim_competitions d join {s}.fct_matches m
          on m.tournament_name = d.tournament_name and m.competition_type <=> d.competition_type
        join {s}.feat_match_context c using (event_id) group by d.tournament_id, d.tournament_name, d.competition_type"""
    )
