"""Coverage, ranking, metric and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import FX, MT, TM, fixtures, matches, query, r, table, team_rows
from touchline.operators import aggregates as agg
from touchline.operators.drift import drift_report
from touchline.operators.joins import bracket_teams
from touchline.operators.ordered import exact_quantiles
from touchline.operators.split import chronological_split
from touchline.plans.marts import distinct_dimension
from touchline.plans.serving import team_form

NOW = "2000-01-01 00:00:00"


@query(
    "coverage_by_team",
    """with s as (select o_custkey, min(o_orderdate) as earliest_match, max(o_orderdate) as latest_match,
        count(distinct o_orderkey) as event_count, count(*) filter (o_orderstatus = 'F') as completed_match_count,
        count(*) filter (o_orderdate > timestamp '2000-01-01') as upcoming_match_count from orders group by 1)
    select c_custkey as team_id, c_name as team_name, earliest_match, latest_match,
      coalesce(event_count, 0) as event_count, coalesce(completed_match_count, 0) as completed_match_count,
      coalesce(upcoming_match_count, 0) as upcoming_match_count
    from customer left join s on o_custkey = c_custkey""",
)
def coverage_by_team(spark, sf):
    registry = table(spark, sf, "customer").select(F.col("c_custkey").alias("team_id"), F.col("c_name").alias("team_name"))
    events = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("team_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("match_date"),
        F.when(F.col("o_orderstatus") == "F", "finished").otherwise("other").alias("status_type"),
    )
    return agg.team_coverage(registry, events, F.lit(NOW).cast("timestamp_ntz"))


@query(
    "coverage_team_year",
    """with s as (select l_orderkey as event_id, case min(l_linenumber) % 3 when 0 then 'failed' when 1 then 'available'
        else 'unsupported' end as status from lineitem group by 1)
    select o_custkey % 48 as team_id, cast(year(o_orderdate) as int) as year, count(distinct o_orderkey) as eligible_matches,
      count(*) filter (status = 'available') as statistics_matches,
      count(*) filter (status = 'unsupported') as unsupported_matches,
      count(*) filter (status = 'failed') as failed_matches,
      round(count(*) filter (status = 'available') / count(distinct o_orderkey), 6) as statistics_coverage
    from orders left join s on s.event_id = o_orderkey group by 1, 2""",
)
def coverage_team_year(spark, sf):
    events = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 48).alias("team_id"), F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").alias("match_date"),
    )
    place = F.min("l_linenumber") % 3
    states = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(
        F.when(place == 0, "failed").when(place == 1, "available").otherwise("unsupported").alias("status")
    )
    out = agg.statistics_coverage(events, states)
    return out.withColumn("statistics_coverage", r("statistics_coverage"))


GAPPY = """g as (select event_id, case when event_id % 3 <> 0 then user_id end as user_id,
  case when event_id % 7 <> 0 then value end as value, case when event_id % 200 = 0 then event_type end as event_type,
  case when event_id % 150 = 0 then 1 else 0 end as rare from events)"""


def gappy(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", F.when(e % 3 != 0, F.col("user_id")).alias("user_id"), F.when(e % 7 != 0, F.col("value")).alias("value"),
        F.when(e % 200 == 0, F.col("event_type")).alias("event_type"), F.when(e % 150 == 0, 1).otherwise(0).alias("rare"),
    )


GAPPY_COLUMNS = ["event_id", "user_id", "value", "event_type", "rare"]


@query(
    "column_coverage",
    f"with {GAPPY} " + " union all ".join(
        f"select '{c}' as feature, count({c}) as non_null_count, round(count({c}) / count(*), 6) as coverage from g"
        for c in GAPPY_COLUMNS
    ),
)
def column_coverage(spark, sf):
    return agg.column_coverage(gappy(spark, sf)).withColumn("coverage", r("coverage"))


@query(
    "coverage_extended",
    f"with {GAPPY}, e as (" + " union all ".join(
        f"""select '{c}' as feature, count({c}) / count(*) as non_null_rate,
        count(*) filter (try_cast(cast({c} as varchar) as double) <> 0) / nullif(count(try_cast(cast({c} as varchar) as double)), 0)
          as nonzero_rate_among_available, count(distinct {c}) as unique_non_null_values from g"""
        for c in GAPPY_COLUMNS
    ) + """) select feature, round(non_null_rate, 6) as non_null_rate,
      round(nonzero_rate_among_available, 6) as nonzero_rate_among_available, unique_non_null_values,
      non_null_rate < 0.2 as low_coverage_below_20pct, nonzero_rate_among_available < 0.01 as rare_nonzero_below_1pct from e""",
)
def coverage_extended(spark, sf):
    out = agg.extended_coverage(gappy(spark, sf))
    return out.select(
        "feature", r("non_null_rate").alias("non_null_rate"),
        r("nonzero_rate_among_available").alias("nonzero_rate_among_available"), "unique_non_null_values",
        "low_coverage_below_20pct", "rare_nonzero_below_1pct",
    )


REDUNDANT = [("l_tax", "l_discount"), ("l_quantity", "l_extendedprice"), ("l_linenumber", "l_quantity")]


@query(
    "redundancy",
    " union all ".join(
        f"""select '{a}' as left_feature, '{b}' as right_feature, count(*) as rows_both_available,
        round(avg(cast({a} = {b} as int)), 6) as equality_rate, round(corr({a}, {b}), 6) as correlation from lineitem
        where {a} is not null and {b} is not null"""
        for a, b in REDUNDANT
    ),
)
def redundancy(spark, sf):
    out = agg.redundancy(table(spark, sf, "lineitem"), REDUNDANT)
    return out.withColumn("equality_rate", r("equality_rate")).withColumn("correlation", r("correlation"))


@query(
    "spearman",
    """with x as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as a,
      rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as b from lineitem)
    select count(*) as n, round(corr(a, b), 6) as spearman from x""",
)
def spearman(spark, sf):
    out = agg.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return out.withColumn("spearman", r("spearman"))


STAND = f"""{TM}, st as (select team_id % 12 as "group", team_id, cast(sum(points) as bigint) as points,
    cast(sum(goals_for - goals_against) as bigint) as gd, cast(sum(goals_for) as bigint) as gf,
    count(*) filter (result = 'win') as wins from tm where training_eligible group by 1, 2),
  rk as (select *, cast(row_number() over (partition by "group" order by points desc, gd desc, gf desc, team_id) as int)
    as position from st)"""


def standings(spark, sf):
    rows = team_rows(spark, sf).where("training_eligible").withColumn("group", F.col("team_id") % 12)
    return agg.standings(rows)


@query("group_standings", f"with {STAND} select * from st")
def group_standings(spark, sf):
    return standings(spark, sf)


@query("group_rank", f'with {STAND} select "group", team_id, position from rk')
def group_rank(spark, sf):
    return agg.rank_group(standings(spark, sf)).select("group", "team_id", "position")


@query(
    "best_thirds",
    f"with {STAND} select * from rk where position = 3 order by points desc, gd desc, gf desc, team_id limit 8",
)
def best_thirds(spark, sf):
    return agg.best_thirds(agg.rank_group(standings(spark, sf)))


@query(
    "group_sizes",
    f"""with {FX}, g as (select home_team_id % 12 as "group", home_team_id, away_team_id from fx)
    select a."group", fixtures, teams from (select "group", count(*) as fixtures from g group by 1) a
    join (select "group", count(distinct t) as teams from (select "group", home_team_id as t from g
      union all select "group", away_team_id from g) group by 1) b on a."group" = b."group" """,
)
def group_sizes(spark, sf):
    return agg.group_sizes(fixtures(spark, sf).withColumn("group", F.col("home_team_id") % 12))


STAGES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STAGE_SQL = f"""sp as (select o_custkey % 48 as team_id, {', '.join(
    f'''count(*) filter (o_orderpriority = '{s}') / (select count(distinct o_custkey) from orders) as "prob_{s}"''' for s in STAGES)}
  from orders group by 1)"""


def stage_table(spark, sf):
    runs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), (F.col("o_custkey") % 48).alias("team_id"), F.col("o_orderpriority").alias("stage")
    )
    return agg.stage_probabilities(runs, STAGES)


@query(
    "stage_probabilities",
    f"with {STAGE_SQL} select team_id, {', '.join(f'round(\"prob_{s}\", 6) as \"prob_{s}\"' for s in STAGES)} from sp",
)
def stage_probabilities(spark, sf):
    return stage_table(spark, sf).select("team_id", *[r(f"prob_{s}").alias(f"prob_{s}") for s in STAGES])


@query(
    "top_champions",
    f"""with {STAGE_SQL} select team_id, round("prob_1-URGENT", 6) as probability from sp
    order by "prob_1-URGENT" desc, team_id limit 20""",
)
def top_champions(spark, sf):
    out = stage_table(spark, sf).orderBy(F.desc("`prob_1-URGENT`"), "team_id").limit(20)
    return out.select("team_id", r("prob_1-URGENT").alias("probability"))


@query(
    "team_form",
    f"""with {TM}, f as (select *, row_number() over (partition by team_id order by kickoff_utc desc, event_id desc)
      as place from pl) select event_id, kickoff_utc, team_id, opponent_id, goals_for, goals_against, result
    from f where place <= 5""",
)
def team_form_query(spark, sf):
    from touchline.operators.perspective import playable

    return team_form(playable(team_rows(spark, sf)), 5)


PROBS = """pb as (select l_orderkey, l_linenumber, l_partkey,
  case l_returnflag when 'A' then 'loss' when 'N' then 'draw' else 'win' end as y, l_quantity as goals,
  l_quantity / (l_quantity + 30 + l_linenumber) as p_loss, case when l_linenumber = 7 then 0 else
    30 / (l_quantity + 30 + l_linenumber) end as p_draw, l_linenumber / (l_quantity + 30 + l_linenumber) as p_win,
  0.5 + l_linenumber * 4 + l_discount * 10 as mu from lineitem)"""
LABELS = {"loss": "p_loss", "draw": "p_draw", "win": "p_win"}


def probabilities(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    total = q + 30 + n
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.when(flag == "A", "loss").when(flag == "N", "draw").otherwise("win").alias("y"),
        q.alias("goals"), (q / total).alias("p_loss"),
        F.when(n == 7, 0.0).otherwise(F.lit(30.0) / total).alias("p_draw"), (n / total).alias("p_win"),
        (F.lit(0.5) + n * 4 + F.col("l_discount") * 10).alias("mu"), n.alias("n"),
    )


@query(
    "class_metrics",
    f"""with {PROBS}, c as (select y, greatest(p_loss, 1e-12) as a, greatest(p_draw, 1e-12) as b, greatest(p_win, 1e-12) as c from pb),
    k as (select y, a / (a + b + c) as a, b / (a + b + c) as b, c / (a + b + c) as c from c)
    select count(*) as rows, round(avg(-ln(case y when 'loss' then a when 'draw' then b else c end)), 6) as log_loss,
      round(avg(pow(a - cast(y = 'loss' as int), 2) + pow(b - cast(y = 'draw' as int), 2) + pow(c - cast(y = 'win' as int), 2)), 6)
        as brier_score,
      round(avg(cast(case when a >= b and a >= c then 'loss' when b >= c then 'draw' else 'win' end = y as int)), 6) as accuracy
    from k""",
)
def class_metrics(spark, sf):
    out = agg.probability_metrics(probabilities(spark, sf), "y", LABELS)
    return out.select("rows", *[r(c).alias(c) for c in ("log_loss", "brier_score", "accuracy")])


@query(
    "mae_deviance",
    f"""with {PROBS}, g as (select l_linenumber as n, case when goals < 5 then 0 else goals end as y, mu from pb)
    select n, count(*) as rows, round(avg(abs(y - mu)), 6) as mae,
      round(2 * avg(case when y = 0 then mu else y * ln(y / mu) - y + mu end), 6) as poisson_deviance from g group by 1""",
)
def mae_deviance(spark, sf):
    rows = probabilities(spark, sf).withColumn("goals", F.when(F.col("goals") < 5, 0.0).otherwise(F.col("goals")))
    out = agg.count_metrics(rows, "goals", "mu", ["n"])
    return out.select("n", "rows", r("mae").alias("mae"), r("poisson_deviance").alias("poisson_deviance"))


@query(
    "calibration_bins",
    f"""with {PROBS}, t as (select y, 'loss' as label, p_loss as p from pb union all select y, 'draw', p_draw from pb
      union all select y, 'win', p_win from pb)
    select label, greatest(1, least(10, cast(ceil(p * 10) as int))) - 1 as bin, count(*) as rows,
      round(avg(p), 6) as mean_predicted, round(avg(cast(y = label as int)), 6) as observed_share from t group by 1, 2""",
)
def calibration_bins(spark, sf):
    out = agg.calibration_bins(probabilities(spark, sf), "y", LABELS)
    return out.select("label", "bin", "rows", r("mean_predicted").alias("mean_predicted"), r("observed_share").alias("observed_share"))


@query(
    "nb_dispersion",
    """with d as (select l_returnflag, avg(l_quantity) as mean, var_samp(l_quantity) as variance from lineitem group by 1)
    select l_returnflag, round(mean, 6) as mean, round(variance, 6) as variance,
      round(greatest((variance - mean) / greatest(mean * mean, 1e-9), 1e-6), 6) as dispersion from d""",
)
def nb_dispersion(spark, sf):
    out = agg.dispersion(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", *[r(c).alias(c) for c in ("mean", "variance", "dispersion")])


QS = [0.0, 0.1, 0.25, 0.5, 0.8, 0.99, 1.0]


@query(
    "quantiles",
    "select l_returnflag, count(l_extendedprice) as n, " + ", ".join(
        f"round(quantile_cont(l_extendedprice, {q}), 4) as q{round(q * 100)}" for q in QS
    ) + " from lineitem group by 1",
)
def quantiles(spark, sf):
    out = exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", QS)
    return out.select(
        "l_returnflag", "n", *[F.round(F.col("quantiles")[i], 4).alias(f"q{round(q * 100)}") for i, q in enumerate(QS)]
    )


DRIFT_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "flat"]
DRIFT_SQL = f"""with d as (select *, l_shipdate as dt, 1.0 as flat from lineitem),
  cut as (select quantile_cont(epoch_us(dt), 0.8) as c from d),
  t as ({' union all '.join(
      f"select '{f}' as feature, cast({f} as double) as v, epoch_us(dt) >= (select c from cut) as cur from d" for f in DRIFT_FEATURES)}),
  b as (select feature, list_sort(list_distinct(quantile_cont(v, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])
    filter (not cur))) as e from t group by 1),
  h as (select t.feature, len(e) as edges, len(list_filter(e[2:-2], lambda x: x <= v)) as bin,
    count(*) filter (cur) as c, count(*) filter (not cur) as r from t join b using (feature) group by 1, 2, 3),
  full_bins as (select b.feature, len(e) as edges, unnest(range(greatest(len(e) - 1, 1))) as bin from b),
  sh as (select f.feature, f.edges, f.bin, coalesce(c, 0) / sum(coalesce(c, 0)) over (partition by f.feature) as c,
    coalesce(r, 0) / sum(coalesce(r, 0)) over (partition by f.feature) as r
    from full_bins f left join h on h.feature = f.feature and h.bin = f.bin),
  psi as (select feature, case when max(edges) < 3 then 0 else sum((greatest(c, 1e-6) - greatest(r, 1e-6))
    * ln(greatest(c, 1e-6) / greatest(r, 1e-6))) end as psi from sh group by 1)
  select feature, round(avg(v) filter (not cur), 6) as reference_mean, round(avg(v) filter (cur), 6) as current_mean,
    round(max(psi), 6) as psi from t join psi using (feature) group by 1"""


@query("drift_report", DRIFT_SQL)
def drift_report_query(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("flat", F.lit(1.0))
    out = drift_report(rows, DRIFT_FEATURES, time="l_shipdate")
    return out.select("feature", *[r(c).alias(c) for c in ("reference_mean", "current_mean", "psi")])


PSI_SQL = """with t as (select 'value' as feature, value as v, ts >= timestamp '2024-01-20' as cur from events
    union all select 'hour', cast(hour(ts) as double), ts >= timestamp '2024-01-20' from events),
  b as (select feature, list_sort(list_distinct(quantile_cont(v, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])
    filter (not cur))) as e from t group by 1),
  h as (select t.feature, len(list_filter(e[2:-2], lambda x: x <= v)) as bin,
    count(*) filter (cur) as c, count(*) filter (not cur) as r from t join b using (feature) group by 1, 2),
  sh as (select feature, greatest(c / sum(c) over (partition by feature), 1e-6) as c,
    greatest(r / sum(r) over (partition by feature), 1e-6) as r from h)
  select feature, round(sum((c - r) * ln(c / r)), 6) as psi from sh group by 1"""


@query("psi", PSI_SQL)
def psi(spark, sf):
    from touchline.operators.drift import population_stability, unpivot_features

    events = table(spark, sf, "events").withColumn("hour", F.hour("ts"))
    edge = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    tall = unpivot_features(events, ["value", "hour"], {"is_current": F.col("ts") >= edge})
    return population_stability(tall).withColumn("psi", r("psi"))


@query(
    "feature_ranking",
    f"with {GAPPY}, c as (" + " union all ".join(
        f"select '{c}' as feature, count({c}) as non_null_count, count({c}) / count(*) as coverage from g" for c in GAPPY_COLUMNS
    ) + """) select feature, non_null_count, round(coverage, 6) as coverage from c
      order by case when feature in ('event_type') then 0 else 1 end, coverage desc, feature limit 3""",
)
def feature_ranking(spark, sf):
    ranked = agg.rank_features(agg.column_coverage(gappy(spark, sf)), ["event_type"], 3)
    return ranked.withColumn("coverage", r("coverage"))


# Columns of the given tables, counted here and not in SQL, where a view doesn't tell them.
TABLES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
    "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query(
    "shape_inventory",
    " union all ".join(f"select '{name}' as dataset, count(*) as row_count, {n} as column_count from {name}" for name, n in TABLES.items()),
)
def shape_inventory(spark, sf):
    return agg.shape_inventory({n: table(spark, sf, n) for n in TABLES})


@query(
    "dataset_version",
    """with t as (select to_json({'c0': cast(o_orderkey as varchar), 'c1': cast(o_custkey as varchar), 'c2': o_orderstatus,
      'c3': o_orderpriority, 'c4': case when o_orderkey % 3 = 0 then o_orderstatus end}) as j from orders),
    s as (select sum(cast('0x' || substr(md5(cast(j as varchar)), 1, 15) as bigint)::hugeint) as s, count(*) as n from t)
    select substr(sha256(cast(s as varchar) || '|' || cast(n as varchar)
      || '|o_orderkey,o_custkey,o_orderstatus,o_orderpriority,sometimes'), 1, 16) as dataset_version from s""",
)
def dataset_version(spark, sf):
    orders = table(spark, sf, "orders").withColumn("sometimes", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")))
    return agg.dataset_version(orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "sometimes"])


@query(
    "chrono_split",
    f"""with {MT}, n as (select event_id, row_number() over (order by kickoff_utc, event_id) as n,
      count(*) over () as c from mt)
    select event_id, case when n <= floor(c * 0.7::double) then 'train' when n <= floor(c * 0.85::double) then 'validation'
      else 'test' end as split from n""",
)
def chrono_split(spark, sf):
    return chronological_split(matches(spark, sf)).select("event_id", "split")


@query(
    "dims_distinct",
    f"""with {MT} select distinct competition_type, tournament_name, round_name from mt where round_name is not null""",
)
def dims_distinct(spark, sf):
    return distinct_dimension(matches(spark, sf), ["competition_type", "tournament_name", "round_name"], "round_name")


STATE_SQL = """st as (select o_custkey % 48 as team_id, max(o_orderdate) as latest_match_date,
    bool_or(o_orderstatus = 'P' and o_custkey % 48 % 3 <> 0) as history_complete from orders group by 1)"""


@query(
    "incremental_cutoff",
    f"""with {STATE_SQL} select team_id, latest_match_date, history_complete, case when history_complete then
      greatest(timestamp '1998-01-01', latest_match_date - interval 14 days) else timestamp '1998-01-01' end as cutoff
    from st""",
)
def incremental_cutoff(spark, sf):
    events = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 48).alias("team_id"), F.col("o_orderdate").alias("match_date"), "o_orderstatus"
    )
    state = agg.high_water(
        events, (F.col("o_orderstatus") == "P") & (F.col("team_id") % 3 != 0), F.col("match_date")
    )
    since = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return state.select(
        "team_id", "latest_match_date", "history_complete", agg.refetch_cutoff(state, since).alias("cutoff")
    )


@query(
    "refetch_rows",
    f"""with {STATE_SQL}, c as (select team_id, case when history_complete then
      greatest(timestamp '1998-01-01', latest_match_date - interval 14 days) else timestamp '1998-01-01' end as cutoff from st)
    select o_orderkey as event_id from orders join c on c.team_id = o_custkey % 48
    where o_orderdate is null or o_orderdate >= cutoff""",
)
def refetch_rows(spark, sf):
    cutoffs = incremental_cutoff(spark, sf).select("team_id", "cutoff")
    events = table(spark, sf, "orders").withColumn("team_id", F.col("o_custkey") % 48)
    joined = events.join(cutoffs, "team_id")
    return joined.where(F.col("o_orderdate").isNull() | (F.col("o_orderdate") >= F.col("cutoff"))).select(
        F.col("o_orderkey").alias("event_id")
    )


@query(
    "bracket_teams",
    f"""with {STAND}, slots as (select distinct '1' || cast(g.n as varchar) as home_ref, '2' || cast((g.n + 1) % 12 as varchar) as away_ref
      from (select "group" as n from rk) g)
    select home_ref, away_ref, h.team_id as home_team_id, a.team_id as away_team_id from slots
      left join rk h on cast(h.position as varchar) || cast(h."group" as varchar) = home_ref
      left join rk a on cast(a.position as varchar) || cast(a."group" as varchar) = away_ref""",
)
def bracket_teams_query(spark, sf):
    ranked = agg.rank_group(standings(spark, sf))
    slots = ranked.select(
        F.concat(F.lit("1"), F.col("group").cast("string")).alias("home_ref"),
        F.concat(F.lit("2"), ((F.col("group") + 1) % 12).cast("string")).alias("away_ref"),
    ).distinct()
    return bracket_teams(slots, ranked).select("home_ref", "away_ref", "home_team_id", "away_team_id")
