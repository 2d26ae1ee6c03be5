"""Canonical match and team-row queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import FX, MT, TM, by_case, fixtures, matches, query, table, team_rows
from touchline.functions.scalars import (
    COMPETITION_IMPORTANCE,
    COUNTRY_ALIASES_LEGACY,
    attach_host_flags,
    classify_competition,
    classify_competition_legacy,
    infer_stage,
    lookup,
    normalize_country,
    nullable_equal,
)
from touchline.operators.perspective import (
    derive_match_fields,
    knockout_fields,
    matchup,
    playable,
    project_side,
    win_draw_loss,
)


@query(
    "team_perspective",
    f"with {TM} select event_id, side, team_id, opponent_id, goals_for, goals_against, is_home, is_away from tm",
)
def team_perspective(spark, sf):
    return team_rows(spark, sf).select(
        "event_id", "side", "team_id", "opponent_id", "goals_for", "goals_against", "is_home", "is_away"
    )


@query(
    "match_results",
    f"with {TM} select event_id, side, result, points, goal_difference, team_scored, team_conceded from tm",
)
def match_results(spark, sf):
    return team_rows(spark, sf).select(
        "event_id", "side", "result", "points", "goal_difference", "team_scored", "team_conceded"
    )


@query(
    "training_eligible",
    f"""with {MT} select event_id, home_score_regulation, away_score_regulation, training_eligible,
    competition_type from mt""",
)
def training_eligible(spark, sf):
    return matches(spark, sf).select(
        "event_id", "home_score_regulation", "away_score_regulation", "training_eligible", "competition_type"
    )


@query("advancing_team", f"with {MT} select event_id, final_advancing_team_id from mt")
def advancing_team(spark, sf):
    return matches(spark, sf).select("event_id", "final_advancing_team_id")


@query(
    "playable_rows",
    f"with {TM} select team_id, status_type, cast(count(*) as bigint) as rows from pl group by 1, 2",
)
def playable_rows(spark, sf):
    return playable(team_rows(spark, sf)).groupBy("team_id", "status_type").agg(F.count(F.lit(1)).alias("rows"))


NAMED = """named as (
  select event_id, home_score as home_score_90, away_score as away_score_90,
    case home_team_id % 25 when 0 then 'USA' when 1 then 'Turkiye' else 'Nation_' || cast(home_team_id % 25 as varchar) end as home_team_name,
    case away_team_id % 25 when 0 then 'USA' when 1 then 'Turkiye' else 'Nation_' || cast(away_team_id % 25 as varchar) end as away_team_name,
    case when event_id % 7 = 0 then null when event_id % 25 = 0 then ' United States '
      when event_id % 25 = 1 then 'TÜRKIYE' else ' NATION_' || cast(event_id % 25 as varchar) end as venue_country
  from fx)"""


def named_fixtures(spark, sf):
    def name(column):
        n = F.col(column) % 25
        return F.when(n == 0, "USA").when(n == 1, "Turkiye").otherwise(F.concat(F.lit("Nation_"), n.cast("string")))

    at = F.col("event_id") % 25
    venue = (
        F.when(F.col("event_id") % 7 == 0, F.lit(None))
        .when(at == 0, " United States ")
        .when(at == 1, "TÜRKIYE")
        .otherwise(F.concat(F.lit(" NATION_"), at.cast("string")))
    )
    return fixtures(spark, sf).select(
        "event_id", "home_score", "away_score",
        F.col("home_score").alias("home_score_90"), F.col("away_score").alias("away_score_90"),
        name("home_team_id").alias("home_team_name"), name("away_team_id").alias("away_team_name"),
        venue.alias("venue_country"),
    )


COUNTRY_SQL = """case lower(trim({c})) when 'usa' then 'united states' when 'turkiye' then 'türkiye'
  else lower(trim({c})) end"""


@query(
    "derived_match_flags",
    f"""with {FX}, {NAMED}, norm as (
      select *, {COUNTRY_SQL.format(c='home_team_name')} as h, {COUNTRY_SQL.format(c='away_team_name')} as a,
        {COUNTRY_SQL.format(c='venue_country')} as v from named)
    select event_id, cast(v = h as int) as home_team_playing_in_own_country,
      cast(v = a as int) as away_team_playing_in_own_country,
      cast(v <> h and v <> a as int) as neutral_site,
      cast(v = h as int) as home_host_team, cast(v = a as int) as away_host_team,
      case when home_score_90 > away_score_90 then 'home_win' when home_score_90 = away_score_90 then 'draw'
        when home_score_90 < away_score_90 then 'away_win' end as result_90
    from norm""",
)
def derived_match_flags(spark, sf):
    return derive_match_fields(named_fixtures(spark, sf)).select(
        "event_id", "home_team_playing_in_own_country", "away_team_playing_in_own_country", "neutral_site",
        "home_host_team", "away_host_team", "result_90",
    )


@query(
    "country_normalize",
    f"""with {FX}, {NAMED} select {COUNTRY_SQL.format(c='venue_country')} as country,
      case lower(trim(venue_country)) when 'türkiye' then 'turkey' else lower(trim(venue_country)) end
        as country_legacy,
      cast(count(*) as bigint) as matches from named group by 1, 2""",
)
def country_normalize(spark, sf):
    return (
        named_fixtures(spark, sf)
        .groupBy(
            normalize_country("venue_country").alias("country"),
            normalize_country("venue_country", COUNTRY_ALIASES_LEGACY).alias("country_legacy"),
        )
        .agg(F.count(F.lit(1)).alias("matches"))
    )


@query(
    "host_flags",
    """with c as (
      select c_custkey, c_nationkey, 'NATION_' || cast(c_nationkey as varchar) as country from customer),
    m as (
      select o_orderkey as event_id, year(o_orderdate) as y, country,
        case when o_custkey % 11 = 0 then null else country end as team_country,
        'NATION_' || cast((c_nationkey + o_orderkey) % 25 as varchar) as opponent_country,
        case o_orderpriority when '1-URGENT' then 'world_cup' when '5-LOW' then 'continental_championship'
          else 'friendly' end as competition_type
      from orders join c on o_custkey = c_custkey),
    hosts as (
      select distinct case when n_regionkey % 2 = 0 then 'world_cup' else 'continental_championship' end
          as competition_type, 1995 + n_nationkey % 5 as y, n_name as country from nation)
    select event_id, case when team_country is null or l.competition_type is null then null
        else cast(exists (select 1 from hosts h where h.competition_type = m.competition_type and h.y = m.y
          and h.country = m.team_country) as int) end as team_is_host_country,
      case when l.competition_type is null then null
        else cast(exists (select 1 from hosts h where h.competition_type = m.competition_type and h.y = m.y
          and h.country = m.opponent_country) as int) end as opponent_is_host_country,
      cast(team_country = opponent_country as int) as same_country
    from m left join (select distinct competition_type, y from hosts) l
      on l.competition_type = m.competition_type and l.y = m.y""",
)
def host_flags(spark, sf):
    customers = table(spark, sf, "customer")
    orders = table(spark, sf, "orders")
    nation = table(spark, sf, "nation")
    country = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    played = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("event_id"),
        F.year("o_orderdate").alias("y"),
        F.when(F.col("o_custkey") % 11 != 0, country).alias("team_country"),
        F.concat(F.lit("NATION_"), ((F.col("c_nationkey") + F.col("o_orderkey")) % 25).cast("string")).alias("opponent_country"),
        by_case(
            F.col("o_orderpriority"), {"1-URGENT": "world_cup", "5-LOW": "continental_championship"}, "friendly"
        ).alias("competition_type"),
    )
    hosts = nation.select(
        F.when(F.col("n_regionkey") % 2 == 0, "world_cup").otherwise("continental_championship").alias("competition_type"),
        (F.lit(1995) + F.col("n_nationkey") % 5).alias("year"),
        F.col("n_name").alias("country"),
    )
    flagged = attach_host_flags(
        played, hosts, competition="competition_type", year=F.col("y"),
        countries={"team_is_host_country": "team_country", "opponent_is_host_country": "opponent_country"},
    )
    return flagged.select(
        "event_id", "team_is_host_country", "opponent_is_host_country",
        nullable_equal("team_country", "opponent_country").alias("same_country"),
    )


CLASS_SQL = """case when t like '%friendly%' then 'friendly' when t like '%nations league%' then 'nations_league'
  when (t like '%world cup%' or t like '%world championship%') and t like '%qual%' then 'world_cup_qualifier'
  when t like '%qual%' then 'continental_qualifier'
  when t like '%world cup%' or t like '%world championship%' then 'world_cup'
  when t like '%euro%' or t like '%copa am%' or t like '%africa cup%' or t like '%asian cup%' or t like '%gold cup%'
    then 'continental_championship' else 'other' end"""
LEGACY_CLASS_SQL = """case when t like '%friendly%' then 'friendly' when t like '%nations league%' then 'nations_league'
  when t like '%world cup qual%' or t like '%world championship qual%' then 'world_cup_qualifier'
  when t like '%qualification%' or t like '%qualifier%' then 'continental_qualifier'
  when t like '%world cup%' or t like '%world championship%' then 'world_cup'
  when t like '%euro%' then 'continental_championship' else 'other' end"""
NAMES_SQL = """named as (
  select p_partkey, case p_type when 'STANDARD' then 'World Championship' when 'PROMO' then 'World Cup Qualification'
    when 'ECONOMY' then 'Copa América' when 'MEDIUM' then 'Friendly' when 'SMALL' then 'AFC Asian Cup Qualifier'
    else null end || case when p_size % 4 = 0 then ', Knockout' when p_size % 4 = 1 then ' Gr. ' || p_brand
      when p_size % 4 = 2 then ' Finals' else '' end as name,
    case when p_size % 5 = 0 then 'Quarterfinals' end as round_name from part)"""


def competition_names(spark, sf):
    size = F.col("p_size")
    kind = by_case(
        F.col("p_type"),
        {
            "STANDARD": "World Championship", "PROMO": "World Cup Qualification", "ECONOMY": "Copa América",
            "MEDIUM": "Friendly", "SMALL": "AFC Asian Cup Qualifier",
        },
    )
    suffix = (
        F.when(size % 4 == 0, ", Knockout")
        .when(size % 4 == 1, F.concat(F.lit(" Gr. "), "p_brand"))
        .when(size % 4 == 2, " Finals")
        .otherwise("")
    )
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(kind, suffix).alias("name"),
        F.when(size % 5 == 0, "Quarterfinals").alias("round_name"),
    )


@query(
    "classify_competition",
    f"""with {NAMES_SQL}, t as (select p_partkey, lower(coalesce(name, '')) as t from named),
    k as (select p_partkey, {CLASS_SQL} as competition_type, {LEGACY_CLASS_SQL} as competition_legacy from t)
    select *, case competition_legacy when 'friendly' then 1 when 'nations_league' then 2
      when 'continental_qualifier' then 3 when 'world_cup_qualifier' then 4 when 'continental_championship' then 5
      when 'world_cup' then 6 end as competition_importance from k""",
)
def classify_competition_query(spark, sf):
    named = competition_names(spark, sf).select(
        "p_partkey", classify_competition("name").alias("competition_type"),
        classify_competition_legacy("name").alias("competition_legacy"),
    )
    return named.select("*", lookup("competition_legacy", COMPETITION_IMPORTANCE).alias("competition_importance"))


@query(
    "infer_stage",
    f"""with {NAMES_SQL}, t as (select p_partkey, round_name, lower(coalesce(name, '')) as t from named)
    select p_partkey, coalesce(round_name, case when t like '%qualification playoff%' then 'Qualification playoff'
      when t like '%qualification%' or t like '%qual.%' then 'Qualification group'
      when t like '%knockout%' then 'Knockout' when t like '%finals%' then 'Finals'
      when t like '%group%' or t like '%gr.%' then 'Group stage' end) as stage_name from t""",
)
def infer_stage_query(spark, sf):
    return competition_names(spark, sf).select("p_partkey", infer_stage("round_name", "name").alias("stage_name"))


@query(
    "side_projection",
    f"""with {FX} select event_id, s.side, case s.side when 'home' then home_team_id else away_team_id end as team,
      case s.side when 'home' then away_team_id else home_team_id end as opponent,
      case s.side when 'home' then home_score else away_score end as goals_for,
      case s.side when 'home' then away_score else home_score end as goals_against,
      cast(s.side = 'home' as int) as is_home, cast(s.side = 'away' as int) as is_away
    from fx, (values ('home'), ('away')) s(side)""",
)
def side_projection(spark, sf):
    rows = fixtures(spark, sf).withColumn("side", F.explode(F.array(F.lit("home"), F.lit("away"))))
    return project_side(
        rows,
        {
            "team": ("home_team_id", "away_team_id"),
            "opponent": ("away_team_id", "home_team_id"),
            "goals_for": ("home_score", "away_score"),
            "goals_against": ("away_score", "home_score"),
        },
    ).select("event_id", "side", "team", "opponent", "goals_for", "goals_against", "is_home", "is_away")


@query(
    "knockout_fields",
    f"""with {MT}, s as (
      select event_id, home_team_id as home_team, away_team_id as away_team, home_score, away_score,
        coalesce(round_name, 'EURO Finals') as stage_name,
        case when event_id % 4 <> 0 then 1.0 end as all_x, case when event_id % 5 = 0 then 2.0 end as et_x,
        case when event_id % 3 = 0 then 3.0 end as h_x from mt),
    f as (select *, case when et_x is not null then 1 when all_x is not null then 0 end as went from s)
    select event_id, cast(all_x is not null as int) as has_xg, cast(h_x is not null as int) as has_first_half_stats,
      cast(et_x is not null as int) as has_extra_time_stats, went as went_to_extra_time,
      case when went = 0 then home_score end as home_score_90, case when went = 0 then away_score end as away_score_90,
      case when went = 1 then 'draw' when went = 0 and home_score > away_score then 'home_win'
        when went = 0 and home_score = away_score then 'draw'
        when went = 0 and home_score < away_score then 'away_win' end as result_90,
      case when regexp_matches(lower(stage_name), 'final|knockout|round of|quarter|semi') then
        case when home_score > away_score then home_team when away_score > home_score then away_team end end
        as qualified_team
    from f""",
)
def knockout_fields_query(spark, sf):
    m = matches(spark, sf)
    e = F.col("event_id")
    rows = m.select(
        "event_id", F.col("home_team_id").alias("home_team"), F.col("away_team_id").alias("away_team"),
        "home_score", "away_score", F.coalesce("round_name", F.lit("EURO Finals")).alias("stage_name"),
        F.when(e % 4 != 0, 1.0).alias("ALL_Expected goals"),
        F.when(e % 5 == 0, 2.0).alias("ET1_Total shots"),
        F.when(e % 3 == 0, 3.0).alias("1ST_Total shots"),
    )
    return knockout_fields(rows).select(
        "event_id", "has_xg", "has_first_half_stats", "has_extra_time_stats", "went_to_extra_time",
        "home_score_90", "away_score_90", "result_90", "qualified_team",
    )


@query(
    "confederation_matchup",
    f"""with {TM} select event_id, side, coalesce(a.r_name, 'UNK') || '_vs_' || coalesce(b.r_name, 'UNK')
      as confederation_matchup,
      case when goals_for > goals_against then 'win' when goals_for = goals_against then 'draw'
        when goals_for < goals_against then 'loss' end as raw_result
    from tm left join region a on a.r_regionkey = team_id % 6 left join region b on b.r_regionkey = opponent_id % 6""",
)
def confederation_matchup(spark, sf):
    region = table(spark, sf, "region").select("r_regionkey", "r_name")
    own = region.select(F.col("r_regionkey").alias("_a"), F.col("r_name").alias("team_confederation"))
    theirs = region.select(F.col("r_regionkey").alias("_b"), F.col("r_name").alias("opponent_confederation"))
    rows = team_rows(spark, sf)
    joined = rows.join(own, F.col("team_id") % 6 == F.col("_a"), "left").join(
        theirs, F.col("opponent_id") % 6 == F.col("_b"), "left"
    )
    return joined.select(
        "event_id", "side", matchup("team_confederation", "opponent_confederation").alias("confederation_matchup"),
        win_draw_loss("goals_for", "goals_against").alias("raw_result"),
    )
