"""Checked, anti, as-of, interval and lookup join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import FX, TM, fixtures, query, r, table, team_rows
from touchline.functions.scalars import unix_micros
from touchline.operators.history import DAY_MICROS, rolling_features
from touchline.operators.joins import (
    asof_latest,
    checked_join,
    count_between,
    duplicate_keys,
    first_available,
    only_listed,
    pending,
    split_supported,
    team_dimension,
    with_lookup,
)
from touchline.operators.perspective import playable
from touchline.plans.marts import finished_without_score
from touchline.plans.serving import fixture_features


@query(
    "checked_join_one_to_one",
    """with l as (select l_orderkey, cast(count(*) as bigint) as lines, round(sum(l_quantity), 4) as quantity
      from lineitem group by 1)
    select o_orderkey, o_custkey, lines, quantity from orders left join l on l_orderkey = o_orderkey""",
)
def checked_join_one_to_one(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 4).alias("quantity")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return checked_join(orders, lines, ["o_orderkey"])


@query(
    "checked_join_many_to_one",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_brand, p_size
    from lineitem join part on p_partkey = l_partkey""",
)
def checked_join_many_to_one(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return checked_join(lines, part, ["l_partkey"], how="inner", validate="many_to_one", lazy=True)


@query(
    "checked_join_one_to_many",
    """select c_custkey, c_mktsegment, o_orderkey from customer left join orders on o_custkey = c_custkey""",
)
def checked_join_one_to_many(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return checked_join(customers, orders, ["c_custkey"], validate="one_to_many")


@query(
    "duplicate_keys",
    """select l_orderkey, l_linenumber, count(*) as row_count from lineitem group by 1, 2 having count(*) > 1""",
)
def duplicate_keys_query(spark, sf):
    return duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "left_anti_exceptions",
    f"""with {FX}, broken as (select event_id, status_type, case when event_id % 10 <> 3 then home_score end as home_score,
        away_score from fx),
      exceptions as (select distinct l_orderkey as event_id from lineitem where l_returnflag = 'R')
    select event_id from broken where status_type = 'finished' and (home_score is null or away_score is null)
      and event_id not in (select event_id from exceptions)""",
)
def left_anti_exceptions(spark, sf):
    broken = fixtures(spark, sf).withColumn("home_score", F.when(F.col("event_id") % 10 != 3, F.col("home_score")))
    exceptions = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("event_id"),
        F.when(F.col("l_returnflag") == "R", "finished_missing_score").otherwise("other").alias("exception_type"),
    )
    return finished_without_score(broken, exceptions).select("event_id")


@query(
    "pending_events",
    """select distinct o_orderkey as event_id from orders where o_orderkey not in (
      select l_orderkey from lineitem where l_linestatus = 'F')""",
)
def pending_events(spark, sf):
    events = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"))
    done = table(spark, sf, "lineitem").where(F.col("l_linestatus") == "F").select(F.col("l_orderkey").alias("event_id"))
    return pending(events, done, "event_id")


@query(
    "semi_restrict",
    """select o_orderkey, o_orderstatus from orders where o_orderkey in (
      select l_orderkey from lineitem where l_returnflag = 'R')""",
)
def semi_restrict(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    listed = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return only_listed(orders, listed, "o_orderkey")


PROBES = """p as (select o_orderkey as probe_id, o_custkey % 150 as who,
  timestamp '2024-01-01' + to_hours(o_orderkey % 720) as at from orders)"""


def probes(spark, sf):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("probe_id"),
        (F.col("o_custkey") % 150).alias("who"),
        (start + F.make_dt_interval(hours=(F.col("o_orderkey") % 720).cast("int"))).alias("at"),
    )


@query(
    "asof_latest",
    f"""with {PROBES} select probe_id, event_id as last_event, event_type as last_type, value as last_value
    from p asof left join events e on p.who = e.user_id and p.at > e.ts""",
)
def asof_latest_query(spark, sf):
    out = asof_latest(
        probes(spark, sf), table(spark, sf, "events"), key=("who", "user_id"), at="at", time="ts", tie="event_id",
        columns={"event_id": "last_event", "event_type": "last_type", "value": "last_value"},
    )
    return out.select("probe_id", "last_event", "last_type", "last_value")


@query(
    "interval_count",
    f"""with {PROBES} select probe_id, count(e.event_id) as events_14d from p
    left join events e on e.user_id = p.who and e.ts >= p.at - interval 14 days and e.ts < p.at group by 1""",
)
def interval_count(spark, sf):
    at = unix_micros("at")
    out = count_between(
        probes(spark, sf), table(spark, sf, "events"), probe_id=["probe_id"], key=("who", "user_id"),
        low=at - 14 * DAY_MICROS, high=at, time=unix_micros("ts"), name="events_14d",
    )
    return out.select("probe_id", "events_14d")


@query(
    "fixture_features",
    f"""with {TM}, f as (select *, avg(goals_for) over w as rolling_goals_for_5,
        avg(goals_against) over w as rolling_goals_against_5 from pl
        window w as (partition by team_id order by kickoff_utc, event_id rows between 5 preceding and 1 preceding)),
      past as (select fx.event_id, s.side, f.*, row_number() over (partition by fx.event_id, s.side
          order by f.kickoff_utc desc, f.event_id desc) as place
        from fx, (values ('home'), ('away')) s(side), f
        where f.team_id = case s.side when 'home' then fx.home_team_id else fx.away_team_id end
          and f.kickoff_utc < fx.kickoff_utc),
      latest as (select * from past where place = 1),
      busy as (select fx.event_id, count(pl.event_id) as n from fx left join pl on pl.team_id = fx.home_team_id
        and pl.kickoff_utc < fx.kickoff_utc and pl.kickoff_utc >= fx.kickoff_utc - interval 14 days group by 1)
    select fx.event_id, fx.neutral_site, fx.competition_type, fx.round_name,
      round(h.rolling_goals_for_5, 6) as rolling_goals_for_5,
      round(a.rolling_goals_for_5, 6) as opponent_rolling_goals_for_5,
      round(a.rolling_goals_against_5, 6) as opponent_rolling_goals_against_5,
      round((epoch_us(fx.kickoff_utc) - epoch_us(h.kickoff_utc)) / 86400000000.0, 6) as rest_days,
      busy.n as fixture_congestion_14d, h.team_id is not null and a.team_id is not null as has_history
    from fx left join latest h on h.event_id = fx.event_id and h.side = 'home'
      left join latest a on a.event_id = fx.event_id and a.side = 'away' join busy on busy.event_id = fx.event_id"""
    .replace("select fx.event_id, s.side, f.*,", "select fx.event_id, s.side, f.team_id, f.kickoff_utc, "
             "f.rolling_goals_for_5, f.rolling_goals_against_5,"),
)
def fixture_features_query(spark, sf):
    master = rolling_features(
        playable(team_rows(spark, sf)), ["goals_for", "goals_against"], means=(5,), spread=None, trend=None, rest=None
    )
    from touchline.operators.perspective import with_competition

    upcoming = with_competition(fixtures(spark, sf)).select(
        "event_id", "kickoff_utc", "home_team_id", "away_team_id", "neutral_site", "competition_type", "round_name"
    )
    names = [
        "rolling_goals_for_5", "opponent_rolling_goals_for_5", "opponent_rolling_goals_against_5", "rest_days",
        "fixture_congestion_14d", "neutral_site", "competition_type", "round_name",
    ]
    out = fixture_features(upcoming, master, names)
    decimals = [n for n in names if "rolling" in n or n == "rest_days"]
    return out.select(
        "event_id", "neutral_site", "competition_type", "round_name", "fixture_congestion_14d", "has_history",
        *[r(c).alias(c) for c in decimals],
    )


@query(
    "dim_fallback",
    """select s_suppkey, coalesce(lower(n_name), 'source_' || cast(s_suppkey as varchar)) as team_id,
      coalesce(n_name, s_name) as team_name, n_name is not null as is_registered
    from supplier left join nation on n_nationkey = s_nationkey + 3""",
)
def dim_fallback(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf, "supplier").withColumn("key", F.col("s_nationkey") + 3)
    out = with_lookup(
        supplier, nation, "key", "n_nationkey",
        {
            "team_id": F.coalesce(F.lower("n_name"), F.concat(F.lit("source_"), F.col("s_suppkey").cast("string"))),
            "team_name": F.coalesce("n_name", "s_name"),
            "is_registered": F.col("n_name").isNotNull(),
        },
    )
    return out.select("s_suppkey", "team_id", "team_name", "is_registered")


@query(
    "team_dimension",
    f"""with {FX}, seen as (
        select home_team_id as id, 'H' || cast(event_id as varchar) as name, kickoff_utc, event_id, 0 as sd from fx
        union all select away_team_id, 'A' || cast(event_id as varchar), kickoff_utc, event_id, 1 from fx),
      last as (select id, name from (select *, row_number() over (partition by id
        order by kickoff_utc desc, event_id desc, sd desc) as place from seen) where place = 1)
    select coalesce(lower(n_name), 'source_' || cast(id as varchar)) as team_id, coalesce(n_name, name) as team_name,
      id as source_team_id, n_name is not null as is_registered_team, r_name as confederation,
      coalesce(n_nationkey % 9 = 0, false) as host_country_flag
    from last left join nation on n_nationkey = id left join region on r_regionkey = n_regionkey""",
)
def team_dimension_query(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    registry = nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        F.col("n_nationkey").cast("bigint").alias("source_team_id"),
        F.lower("n_name").alias("team_id"), F.col("n_name").alias("team_name"),
        F.lit(None).cast("string").alias("fifa_code"), F.col("r_name").alias("confederation"),
        F.lit(None).cast("string").alias("world_cup_group"), (F.col("n_nationkey") % 9 == 0).alias("host_country_flag"),
    )
    m = fixtures(spark, sf).select(
        "event_id", "kickoff_utc", F.col("home_team_id").alias("home_source_id"),
        F.col("away_team_id").alias("away_source_id"),
        F.concat(F.lit("H"), F.col("event_id").cast("string")).alias("home_team_name"),
        F.concat(F.lit("A"), F.col("event_id").cast("string")).alias("away_team_name"),
    )
    return team_dimension(m, registry).select(
        "team_id", "team_name", "source_team_id", "is_registered_team", "confederation", "host_country_flag"
    )


@query(
    "payload_fallback",
    """with live as (select event_id, case when event_id % 4 <> 0 then props end as payload from events),
      cache as (select event_id, '{"k": 0}' as payload from events where event_type <> 'click')
    select live.event_id, coalesce(live.payload, cache.payload) as payload,
      case when live.payload is not null then 'live' when cache.payload is not null then 'cache' end as source
    from live left join cache on cache.event_id = live.event_id""",
)
def payload_fallback(spark, sf):
    events = table(spark, sf, "events")
    live = events.select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("payload"))
    cache = events.where(F.col("event_type") != "click").select("event_id", F.lit('{"k": 0}').alias("payload"))
    return first_available(live, cache, "event_id", "payload")


@query(
    "supported_teams",
    f"""with {FX} select event_id, case when h.n_nationkey is not null and a.n_nationkey is not null then null
        else concat_ws(', ', case when h.n_nationkey is null then cast(home_team_id as varchar) end,
          case when a.n_nationkey is null then cast(away_team_id as varchar) end) end as reject_reason
    from fx left join nation h on h.n_nationkey = home_team_id left join nation a on a.n_nationkey = away_team_id""",
)
def supported_teams(spark, sf):
    known = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    rows = (
        fixtures(spark, sf)
        .join(known.select(F.col("id").alias("h")), F.col("home_team_id") == F.col("h"), "left")
        .join(known.select(F.col("id").alias("a")), F.col("away_team_id") == F.col("a"), "left")
    )
    reason = F.concat_ws(
        ", ", F.when(F.col("h").isNull(), F.col("home_team_id").cast("string")),
        F.when(F.col("a").isNull(), F.col("away_team_id").cast("string")),
    )
    ok, rejected = split_supported(rows, F.col("h").isNotNull() & F.col("a").isNotNull(), reason)
    return ok.select("event_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        rejected.select("event_id", "reject_reason")
    )
