"""Query registry, table readers and the two-sided adapter over the given tables.

The sports-shaped inputs are derived row by row from the TPC-H-like tables, in
Spark and in the oracle SQL alike, so every query's work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.perspective import regulation_scores, team_matches, with_competition
from touchline.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(column, digits: int = 6) -> Column:
    """Round for comparison; both engines sum doubles in different orders."""
    return F.round(F.col(f"`{column}`") if isinstance(column, str) else column, digits)


def rounded(column, digits: int) -> Column:
    """``r`` for many columns: a double is only rounded by its decimal digits, which is slow, where a tie is near or it is large."""
    x = F.col(f"`{column}`") if isinstance(column, str) else column
    scale = float(10**digits)
    near = x * scale
    plain = (F.abs(x) < 1e9 / scale) & (F.abs(near - F.rint(near)) < 0.499999)
    return F.when(plain, F.floor(near + 0.5) / scale).otherwise(F.round(x, digits))


def by_case(value: Column, names: dict, default: str | None = None) -> Column:
    out = None
    for key, name in names.items():
        out = F.when(value == key, name) if out is None else out.when(value == key, name)
    return out if default is None else out.otherwise(default)


TOURNAMENTS = {
    "1-URGENT": "World Cup",
    "2-HIGH": "World Cup Qual. UEFA A",
    "3-MEDIUM": "UEFA Nations League",
    "4-NOT SPECIFIED": "Int. Friendly Games",
    "5-LOW": "EURO Finals, Gr. B",
}


def fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """Two-sided fixtures over ``orders``, one per order."""
    o = table(spark, sf, "orders")
    finished = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").alias("kickoff_utc"),
        (F.col("o_custkey") % 48).alias("home_team_id"),
        ((F.col("o_custkey") % 48 + 1 + F.col("o_orderkey") % 47) % 48).alias("away_team_id"),
        F.when(finished, "finished").when(F.col("o_orderstatus") == "O", "notstarted").otherwise("canceled").alias("status_type"),
        F.when(finished, (F.floor("o_totalprice") % 6).cast("int")).alias("home_score"),
        F.when(finished, (F.floor(F.col("o_totalprice") / 7) % 5).cast("int")).alias("away_score"),
        (F.col("o_orderkey") % 2).cast("int").alias("neutral_site"),
        by_case(F.col("o_orderpriority"), TOURNAMENTS).alias("tournament_name"),
        F.lit(None).cast("string").alias("unique_tournament_name"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Round "), (F.col("o_orderkey") % 9).cast("string"))).alias("round_name"),
    )


FX = """fx as (
  select o_orderkey as event_id, o_orderdate as kickoff_utc,
    o_custkey % 48 as home_team_id,
    (o_custkey % 48 + 1 + o_orderkey % 47) % 48 as away_team_id,
    case o_orderstatus when 'F' then 'finished' when 'O' then 'notstarted' else 'canceled' end as status_type,
    case when o_orderstatus = 'F' then cast(cast(floor(o_totalprice) as bigint) % 6 as int) end as home_score,
    case when o_orderstatus = 'F' then cast(cast(floor(o_totalprice / 7) as bigint) % 5 as int) end as away_score,
    cast(o_orderkey % 2 as int) as neutral_site,
    case o_orderpriority when '1-URGENT' then 'World Cup' when '2-HIGH' then 'World Cup Qual. UEFA A'
      when '3-MEDIUM' then 'UEFA Nations League' when '4-NOT SPECIFIED' then 'Int. Friendly Games'
      else 'EURO Finals, Gr. B' end as tournament_name,
    case o_orderpriority when '1-URGENT' then 'world_cup' when '2-HIGH' then 'world_cup_qualifier'
      when '3-MEDIUM' then 'nations_league' when '4-NOT SPECIFIED' then 'friendly'
      else 'continental_championship' end as competition_type,
    case when o_orderkey % 3 = 0 then 'Round ' || cast(o_orderkey % 9 as varchar) end as round_name
  from orders)"""


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical matches of the adapter."""
    return regulation_scores(with_competition(fixtures(spark, sf)))


MT = FX + """, mt as (
  select *, home_score as home_score_regulation, away_score as away_score_regulation,
    status_type = 'finished' and home_score is not null and away_score is not null as training_eligible,
    case when home_score > away_score then home_team_id when away_score > home_score then away_team_id end
      as final_advancing_team_id
  from fx)"""

MATCH_COLUMNS = [
    "event_id", "kickoff_utc", "status_type", "competition_type", "round_name", "neutral_site", "training_eligible",
]


def team_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical team rows of the adapter."""
    return team_matches(matches(spark, sf), MATCH_COLUMNS)


TM = MT + """, sides as (
  select event_id, kickoff_utc, status_type, competition_type, round_name, neutral_site, training_eligible,
    'home' as side, home_team_id as team_id, away_team_id as opponent_id,
    home_score_regulation as goals_for, away_score_regulation as goals_against, 1 as is_home, 0 as is_away from mt
  union all
  select event_id, kickoff_utc, status_type, competition_type, round_name, neutral_site, training_eligible,
    'away', away_team_id, home_team_id, away_score_regulation, home_score_regulation, 0, 1 from mt),
tm as (
  select *, case when not training_eligible then null when goals_for > goals_against then 'win'
      when goals_for = goals_against then 'draw' else 'loss' end as result,
    case when not training_eligible then null when goals_for > goals_against then 3
      when goals_for = goals_against then 1 else 0 end as points,
    goals_for - goals_against as goal_difference,
    case when training_eligible then cast(goals_for > 0 as int) end as team_scored,
    case when training_eligible then cast(goals_against > 0 as int) end as team_conceded
  from sides),
pl as (select * from tm where training_eligible or status_type = 'notstarted')"""
