"""Leakage-safe history queries over the two-sided rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import TM, matches, query, r, rounded, table, team_rows
from touchline.catalog.stats import FEATURES, WIDE, wide_stats
from touchline.operators.ewm import ewm_features
from touchline.operators.history import (
    count_recent,
    prior_count,
    prior_within_days,
    rolling_features,
    rolling_mismatches,
    whole_day_gap,
)
from touchline.operators.joins import with_opponent
from touchline.operators.ordered import over_recent
from touchline.operators.perspective import playable
from touchline.plans.features import feature_master, leakage_safe, readable_aliases

KEY = ["event_id", "side"]
ORDER = ["kickoff_utc", "event_id"]
W = "partition by team_id order by kickoff_utc, event_id"


def played(spark, sf):
    return playable(team_rows(spark, sf))


def _rounded(df, columns):
    return df.select(*KEY, *[r(c).alias(c) for c in columns])


@query(
    "rolling_mean_k",
    f"""with {TM} select event_id, side, {', '.join(
        f'round(avg(goals_for) over ({W} rows between {n} preceding and 1 preceding), 6) as rolling_goals_for_{n}'
        for n in (3, 5, 10))} from pl""",
)
def rolling_mean_k(spark, sf):
    out = rolling_features(played(spark, sf), ["goals_for"], spread=None, trend=None, rest=None)
    return _rounded(out, [f"rolling_goals_for_{n}" for n in (3, 5, 10)])


@query(
    "rolling_std",
    f"""with {TM} select event_id, side, round(stddev_samp(goals_for) over
      ({W} rows between 5 preceding and 1 preceding), 6) as rolling_std_goals_for_5 from pl""",
)
def rolling_std(spark, sf):
    out = rolling_features(played(spark, sf), ["goals_for"], means=(), trend=None, rest=None)
    return _rounded(out, ["rolling_std_goals_for_5"])


@query(
    "rolling_count",
    f"""with {TM} select event_id, side, {', '.join(
        f'count(goals_for) over ({W} rows between {n} preceding and 1 preceding) as rolling_goals_for_count_{n}'
        for n in (5, 10))} from pl""",
)
def rolling_count(spark, sf):
    out = rolling_features(
        played(spark, sf), ["goals_for"], means=(), spread=None, trend=None, rest=None, counts=(5, 10)
    )
    return out.select(*KEY, "rolling_goals_for_count_5", "rolling_goals_for_count_10")


@query(
    "rolling_sum_flag",
    f"""with {TM} select event_id, side, cast(sum(case when event_id % 3 = 0 then 1 else 0 end) over
      ({W} rows between 10 preceding and 1 preceding) as bigint) as prior_advanced_stats_count_10 from pl""",
)
def rolling_sum_flag(spark, sf):
    rows = played(spark, sf).withColumn("has_statistics", F.col("event_id") % 3 == 0)
    out = rolling_features(
        rows, [], means=(), spread=None, trend=None, rest=None,
        flags={"prior_advanced_stats_count_10": ("has_statistics", 10)},
    )
    return out.select(*KEY, "prior_advanced_stats_count_10")


@query(
    "trend",
    f"""with {TM} select event_id, side,
      round(avg(goal_difference) over ({W} rows between 3 preceding and 1 preceding)
        - avg(goal_difference) over ({W} rows between 10 preceding and 1 preceding), 6)
        as trend_goal_difference_3_minus_10,
      round(avg(goals_against) over ({W} rows between 5 preceding and 1 preceding)
        - avg(goals_against) over ({W} rows between 10 preceding and 1 preceding), 6)
        as trend_goals_against_5_vs_10 from pl""",
)
def trend(spark, sf):
    rows = rolling_features(played(spark, sf), ["goal_difference"], means=(), spread=None, rest=None)
    out = rolling_features(
        rows, ["goals_against"], means=(), spread=None, rest=None, trend=(5, 10), trend_name="trend_{c}_{a}_vs_{b}"
    )
    return _rounded(out, ["trend_goal_difference_3_minus_10", "trend_goals_against_5_vs_10"])


@query(
    "rolling_events",
    """select event_id, round(avg(value) over w5, 6) as rolling_value_5, round(stddev_samp(value) over w5, 6)
      as rolling_std_value_5, round(avg(value) over (partition by user_id order by ts, event_id
        rows between 10 preceding and 1 preceding), 6) as rolling_value_10
    from (select * exclude (value), case when event_id % 7 <> 0 then value end as value from events)
    window w5 as (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding)""",
)
def rolling_events(spark, sf):
    out = rolling_features(
        gappy_events(spark, sf), ["value"], team="user_id", order=["ts", "event_id"], means=(5, 10), trend=None,
        rest=None,
    )
    return out.select(
        "event_id", r("rolling_value_5").alias("rolling_value_5"), r("rolling_std_value_5").alias("rolling_std_value_5"),
        r("rolling_value_10").alias("rolling_value_10"),
    )


def gappy_events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value")
    )


EWM_SQL = """with recursive e as (
    select event_id, user_id, case when event_id % 7 <> 0 then value end as x,
      row_number() over (partition by user_id order by ts, event_id) as rn from events),
  s as (
    select event_id, user_id, rn, cast(null as double) as before, x as m, 1.0::double as w from e where rn = 1
    union all
    select e.event_id, e.user_id, e.rn, s.m,
      case when e.x is null then s.m when s.m is null then e.x
        else (s.w * (2.0 / 3.0) * s.m + e.x / 3.0) / (s.w * (2.0 / 3.0) + 1.0 / 3.0) end,
      case when s.m is null and e.x is null then 1.0 when e.x is null then s.w * (2.0 / 3.0) else 1.0 end
    from s join e on e.user_id = s.user_id and e.rn = s.rn + 1)
  select event_id, round(before, 6) as ewm_value_5 from s"""


@query("ewm", EWM_SQL)
def ewm(spark, sf):
    out = ewm_features(
        gappy_events(spark, sf), ["value"], team="user_id", order=["ts", "event_id"], row_key=["event_id"]
    )
    return out.select("event_id", r("ewm_value_5").alias("ewm_value_5"))


@query(
    "rest_days",
    """select o_orderkey as event_id,
      round((epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) over w) / 86400000000.0, 6) as rest_days,
      cast(floor((epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) over w) / 86400000000.0) as bigint)
        as days_since_last_match
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
)
def rest_days(spark, sf):
    order = ["o_orderdate", "o_orderkey"]
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = rolling_features(o, [], team="o_custkey", order=order, means=(), spread=None, trend=None)
    out = whole_day_gap(out, "o_custkey", order)
    return out.select(
        F.col("o_orderkey").alias("event_id"), r("rest_days").alias("rest_days"), "days_since_last_match"
    )


@query(
    "congestion_range",
    """select o_orderkey as event_id, count(*) over (partition by o_custkey order by o_orderdate
        range between interval 14 days preceding and interval 1 microsecond preceding) as congestion_14d,
      count(*) over (partition by o_custkey order by o_orderdate
        range between interval 90 days preceding and interval 1 microsecond preceding) as congestion_90d
    from orders""",
)
def congestion_range(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    for days in (14, 90):
        o = count_recent(o, "o_custkey", "o_orderdate", days, f"congestion_{days}d", ["o_orderkey"])
    return o.select(F.col("o_orderkey").alias("event_id"), "congestion_14d", "congestion_90d")


@query(
    "congestion_teams",
    f"""with {TM} select event_id, side, count(*) over (partition by team_id order by kickoff_utc
      range between interval 14 days preceding and interval 1 microsecond preceding) as fixture_congestion_14d
    from pl""",
)
def congestion_teams(spark, sf):
    out = count_recent(played(spark, sf), "team_id", "kickoff_utc", 14, "fixture_congestion_14d", KEY)
    return out.select(*KEY, "fixture_congestion_14d")


@query(
    "prior_within_days",
    """select o_orderkey as event_id, {} from orders""".format(
        ", ".join(
            f"""row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1
      - count(*) over (partition by o_custkey order by o_orderdate range between unbounded preceding
          and interval '{d} days 1 microsecond' preceding) as matches_last_{d}_days"""
            for d in (30, 90)
        )
    ),
)
def prior_within_days_query(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = prior_within_days(o, "o_custkey", ["o_orderdate", "o_orderkey"], (30, 90), ["o_orderkey"])
    return out.select(F.col("o_orderkey").alias("event_id"), "matches_last_30_days", "matches_last_90_days")


@query(
    "prior_count",
    f"""with {TM}, n as (select event_id, side, row_number() over ({W}) - 1 as n from pl)
    select event_id, side, n as prior_match_count, least(n, 5) as rolling_matches_available_5,
      least(n, 10) as rolling_matches_available_10 from n""",
)
def prior_count_query(spark, sf):
    out = prior_count(played(spark, sf), "team_id", ORDER, upto=(5, 10))
    return out.select(*KEY, "prior_match_count", "rolling_matches_available_5", "rolling_matches_available_10")


@query(
    "opponent_self_join",
    f"""with {TM} select a.event_id, a.side, a.goals_for, b.goals_for as against_goals_for, b.points as against_points
    from tm a left join tm b on a.event_id = b.event_id and a.opponent_id = b.team_id""",
)
def opponent_self_join(spark, sf):
    rows = team_rows(spark, sf).select(*KEY, "team_id", "opponent_id", "goals_for", "points")
    out = with_opponent(rows, ["goals_for", "points"], lambda c: f"against_{c}")
    return out.select(*KEY, "goals_for", "against_goals_for", "against_points")


@query(
    "opponent_form",
    f"""with {TM}, f as (
      select event_id, side, team_id, opponent_id, result, points,
        round(avg(goals_for) over w5, 6) as rolling_goals_for_5,
        round(avg(goals_against) over w5, 6) as rolling_goals_against_5,
        round(avg(goal_difference) over w5, 6) as rolling_goal_difference_5
      from pl window w5 as ({W} rows between 5 preceding and 1 preceding))
    select a.*, b.rolling_goals_for_5 as opponent_rolling_goals_for_5,
      b.rolling_goals_against_5 as opponent_rolling_goals_against_5,
      b.rolling_goal_difference_5 as opponent_rolling_goal_difference_5
    from f a left join f b on a.event_id = b.event_id and a.opponent_id = b.team_id""",
)
def opponent_form(spark, sf):
    sources = ["goals_for", "goals_against", "goal_difference"]
    names = [f"rolling_{c}_5" for c in sources]
    rows = rolling_features(played(spark, sf), sources, means=(5,), spread=None, trend=None, rest=None)
    rows = rows.select(*KEY, "team_id", "opponent_id", "result", "points", *[r(c).alias(c) for c in names])
    return with_opponent(rows, names, paired=True)


FEATURE_SQL = f"""with {TM}, f as (
      select event_id, side, team_id, opponent_id,
        {', '.join(f'avg({c}) over (w rows between {n} preceding and 1 preceding) as rolling_{c}_{n}'
                   for c in ('goals_for', 'goals_against', 'goal_difference') for n in (3, 5, 10))},
        {', '.join(f'stddev_samp({c}) over (w rows between 5 preceding and 1 preceding) as rolling_std_{c}_5'
                   for c in ('goals_for', 'goals_against', 'goal_difference'))},
        (epoch_us(kickoff_utc) - lag(epoch_us(kickoff_utc)) over w) / 86400000000.0 as rest_days,
        row_number() over w - 1 as prior_match_count,
        count(*) over (partition by team_id order by kickoff_utc
          range between interval 14 days preceding and interval 1 microsecond preceding) as fixture_congestion_14d
      from pl window w as ({W})),
    t as (select *, {', '.join(f'rolling_{c}_3 - rolling_{c}_10 as trend_{c}_3_minus_10'
                   for c in ('goals_for', 'goals_against', 'goal_difference'))} from f)
    select a.event_id, a.side, a.team_id, a.prior_match_count, a.fixture_congestion_14d,
      round(a.rest_days, 6) as rest_days,
      {', '.join(f'round({p}.{k}, 6) as {q}{k}' for p, q in (('a', ''), ('b', 'opponent_')) for k in
        [f'rolling_{c}_{n}' for c in ('goals_for', 'goals_against', 'goal_difference') for n in (3, 5, 10)]
        + [f'rolling_std_{c}_5' for c in ('goals_for', 'goals_against', 'goal_difference')])},
      {', '.join(f'round(a.trend_{c}_3_minus_10, 6) as trend_{c}_3_minus_10'
                 for c in ('goals_for', 'goals_against', 'goal_difference'))}
    from t a left join t b on a.event_id = b.event_id and a.opponent_id = b.team_id"""


@query("feature_master", FEATURE_SQL)
def feature_master_query(spark, sf):
    master = feature_master(team_rows(spark, sf), matches(spark, sf), with_ewm=False)
    safe = leakage_safe(master)
    numbers = [c for c in safe.columns if c.startswith(("rolling_", "opponent_rolling_", "trend_"))]
    return safe.select(
        *KEY, "team_id", "prior_match_count", "fixture_congestion_14d", r("rest_days").alias("rest_days"),
        *[r(c).alias(c) for c in numbers],
    )


STATISTICS = [f for f in FEATURES if f.startswith("ALL_")]
HISTORY = ["goals_for", "goals_against", "goal_difference", *STATISTICS, *(f"against_{c}" for c in STATISTICS)]


def _full_sql() -> str:
    """The master over all sources; the weighted means step from one row of a team to its next."""
    sources = range(len(HISTORY))
    named = ", ".join(f'w."{c}" as "{c}", v."{c}" as "against_{c}"' for c in STATISTICS)
    step = ", ".join(
        f"""case when e.c{i} is null then s.m{i} when s.m{i} is null then e.c{i}
          else (s.w{i} * (2.0 / 3.0) * s.m{i} + e.c{i} / 3.0) / (s.w{i} * (2.0 / 3.0) + 1.0 / 3.0) end,
          case when s.m{i} is null and e.c{i} is null then 1.0 when e.c{i} is null then s.w{i} * (2.0 / 3.0) else 1.0 end"""
        for i in sources
    )
    rolled = ", ".join(
        f"""avg(c{i}) over (w rows between 3 preceding and 1 preceding) as "rolling_{c}_3",
          avg(c{i}) over (w rows between 5 preceding and 1 preceding) as "rolling_{c}_5",
          avg(c{i}) over (w rows between 10 preceding and 1 preceding) as "rolling_{c}_10",
          stddev_samp(c{i}) over (w rows between 5 preceding and 1 preceding) as "rolling_std_{c}_5" """
        for i, c in enumerate(HISTORY)
    )
    shared = [
        n for c in HISTORY
        for n in (f"rolling_{c}_3", f"rolling_{c}_5", f"rolling_{c}_10", f"rolling_std_{c}_5", f"trend_{c}_3_minus_10", f"ewm_{c}_5")
    ]
    return f"""with recursive {WIDE}, {TM},
    base as (select pl.*, w.event_id is not null as has_statistics, {named} from pl
      left join wide w on w.event_id = pl.event_id and w.side = pl.side
      left join wide v on v.event_id = pl.event_id and v.side <> pl.side),
    e as (select event_id, side, team_id, opponent_id, kickoff_utc, has_statistics,
      row_number() over (partition by team_id order by kickoff_utc, event_id) as rn,
      {", ".join(f'cast("{c}" as double) as c{i}' for i, c in enumerate(HISTORY))} from base),
    s as (
      select event_id, side, team_id, rn, {", ".join(f"cast(null as double) as b{i}" for i in sources)},
        {", ".join(f"c{i} as m{i}, 1.0::double as w{i}" for i in sources)} from e where rn = 1
      union all
      select e.event_id, e.side, e.team_id, e.rn, {", ".join(f"s.m{i}" for i in sources)}, {step}
      from s join e on e.team_id = s.team_id and e.rn = s.rn + 1),
    f as (select *, {rolled},
        sum(cast(has_statistics as int)) over (w rows between 10 preceding and 1 preceding) as prior_advanced
      from e window w as (partition by team_id order by kickoff_utc, event_id)),
    t as (select f.*, {", ".join(f'"rolling_{c}_3" - "rolling_{c}_10" as "trend_{c}_3_minus_10", s.b{i} as "ewm_{c}_5"' for i, c in enumerate(HISTORY))}
      from f join s on s.event_id = f.event_id and s.side = f.side)
    select a.event_id, a.side, a.rn - 1 as prior_match_count, cast(coalesce(a.prior_advanced, 0) as bigint) as prior_advanced_stats_count_10,
      {", ".join(f'round({p}."{n}", 5) as "{q}{n}"' for p, q in (("a", ""), ("b", "opponent_")) for n in shared)}
    from t a left join t b on a.event_id = b.event_id and a.opponent_id = b.team_id"""


@query("feature_master_full", _full_sql())
def feature_master_full(spark, sf):
    """The whole master: all statistics of the match, those of the other side, weighted means and the opponent's columns."""
    wide = wide_stats(spark, sf).select("event_id", "side", *[F.col(f"`{c}`") for c in STATISTICS], F.lit(True).alias("has_statistics"))
    master = feature_master(team_rows(spark, sf), matches(spark, sf), wide, finish=lambda c: rounded(c, 5))
    numbers = [c for c in master.columns if c.startswith(("rolling_", "opponent_", "trend_", "ewm_")) and c != "opponent_id"]
    return master.select(
        *KEY, "prior_match_count", F.coalesce("prior_advanced_stats_count_10", F.lit(0)).cast("long").alias("prior_advanced_stats_count_10"),
        *[F.col(f"`{c}`") for c in numbers],
    )


@query(
    "feature_aliases",
    f"""with {TM}, f as (select event_id, side, team_id, opponent_id,
        avg(case when event_id % 5 <> 0 then 3 * goals_for + 2 end) over
          ({W} rows between 5 preceding and 1 preceding) as a5,
        avg(case when event_id % 5 <> 0 then 3 * goals_for + 2 end) over
          ({W} rows between 10 preceding and 1 preceding) as a10 from pl)
    select a.event_id, a.side, round(a.a5, 6) as rolling_shots_for_5, round(a.a10, 6) as rolling_shots_for_10,
      round(b.a5, 6) as opponent_rolling_shots_for_5, round(b.a10, 6) as opponent_rolling_shots_for_10
    from f a left join f b on a.event_id = b.event_id and a.opponent_id = b.team_id""",
)
def feature_aliases(spark, sf):
    shots = F.when(F.col("event_id") % 5 != 0, F.col("goals_for") * 3 + 2)
    rows = played(spark, sf).withColumn("ALL_Total shots", shots)
    rows = rolling_features(rows, ["ALL_Total shots"], means=(5, 10), spread=None, trend=None, rest=None)
    names = ["rolling_ALL_Total shots_5", "rolling_ALL_Total shots_10"]
    out = readable_aliases(with_opponent(rows, names, paired=True))
    wanted = [f"{p}rolling_shots_for_{n}" for p in ("", "opponent_") for n in (5, 10)]
    return _rounded(out, wanted)


@query(
    "rolling_assert",
    f"""with {TM}, f as (select *, avg(goals_for) over ({W} rows between 5 preceding and 1 preceding) as own,
        avg(goals_for) over ({W} rows between 4 preceding and current row) as leaked from pl),
    p as (select *, case when event_id % 9 = 0 then leaked when event_id % 11 = 0 then null else own end as seen from f)
    select team_id, cast(count(*) as bigint) as mismatches from p
    where (seen is null) <> (own is null) or abs(seen - own) > 1e-8 + 1e-5 * abs(own) group by 1""",
)
def rolling_assert(spark, sf):
    """Rows whose mean sees its own row, or is missing, are planted and found by team."""
    rows = rolling_features(played(spark, sf), ["goals_for"], means=(5,), spread=None, trend=None, rest=None)
    with_own = over_recent(
        rows, ["team_id"], ["kickoff_utc", "event_id"], 4, lambda frame, w: {"_leaked": F.avg("goals_for").over(w.rowsBetween(-4, 0))}
    )
    planted = F.when(F.col("event_id") % 9 == 0, F.col("_leaked")).when(F.col("event_id") % 11 != 0, F.col("rolling_goals_for_5"))
    wrong = rolling_mismatches(with_own.withColumn("rolling_goals_for_5", planted), "goals_for", "rolling_goals_for_5", 5, team="team_id")
    return wrong.groupBy("team_id").agg(F.count(F.lit(1)).alias("mismatches"))
